import random
import re

import pytest

from helpers import docs, regular
from riskmart.llm import near

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """{row number: (size, component)} by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(top(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def run(spark, rows, **more):
    got = near.jaccard_components(docs(spark, rows, **more))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect())


def test_edge_cases(spark):
    from helpers import HARD
    assert run(spark, HARD, fp=1, n=2, component_id=3) == brute(HARD)


def corpus(seed, families, size, words, edits):
    rnd = random.Random(seed)
    common = " ".join(f"p{i}" for i in range(60))
    rows = []
    for f in range(families):
        base = [f"f{f}w{i}" for i in range(words)]
        for _ in range(rnd.randint(1, size)):
            own = list(base)
            for _ in range(rnd.randint(0, edits)):
                own[rnd.randrange(words)] = f"e{rnd.randrange(10**6)}"
            if rnd.random() < 0.4:
                own.insert(rnd.randrange(len(own)), common)
            rows.append(" ".join(own))
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("few,tile", [(8, 4096), (0, 3)])
def test_families_of_near_copies(spark, monkeypatch, few, tile):
    """Also with every tile in the residual step, hot cells and blocks."""
    monkeypatch.setattr(near, "FEW", few)
    monkeypatch.setattr(near, "TILE", tile)
    monkeypatch.setattr(near, "BLOCK", 16 if few == 0 else 2048)
    rows = corpus(3, 12, 40, 120, 7)
    assert run(spark, rows) == brute(rows)


def test_threshold_is_exact(spark):
    # 35 shingles each, 30 shared: 30 / 40 = 0.75 links; 29 shared does not
    a = [f"a{i}" for i in range(39)]
    rows = [(1, " ".join(a)), (2, " ".join(a[:34] + [f"b{i}" for i in range(5)])), (3, " ".join(a[:33] + [f"c{i}" for i in range(6)]))]
    got = {int(d): int(c) for d, _, c in run(spark, rows)}
    assert got[2] == 1 and got[3] == 3 and run(spark, rows) == brute(rows)


def test_keep_one_and_empty_table(spark):
    rows = [(5, "a b c d e f g"), (3, "a b c d e f g"), (9, "q r s t u"), (None, "a b c d e f g"), (7, "")]
    kept = near.keep_one(docs(spark, rows, _gone=4).withColumnRenamed("_gone", "extra"))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "9"]
    assert "extra" in kept.columns
    assert near.jaccard_components(docs(spark, rows).limit(0)).count() == 0


def test_bounds_never_lose_a_link():
    rnd = random.Random(1)
    for _ in range(300):
        x = {rnd.getrandbits(64) for _ in range(rnd.randint(1, 300))}
        y = {v for v in x if rnd.random() < 0.85} | {rnd.getrandbits(64) for _ in range(rnd.randint(0, 40))}
        import numpy as np
        u, v = (np.array(sorted(s), np.uint64) for s in (x, y))
        if len(v) and 100 * len(x & y) >= 75 * len(x | y):
            d = near.differing(near.bitmap(u, len(u)), near.bitmap(v, len(v)))
            assert near.may_link(len(u), len(v), d, 75)


@pytest.mark.parametrize("n", [1024, 8192])
def test_regular_texts_are_told_apart(spark, n):
    x, y = regular(n)
    rows = [(1, x), (2, x), (3, y), (4, f"{y} a b c d e f"), (5, f"{x} a b c d e f"), (6, f"{x} a b c d e f")]
    assert run(spark, rows) == brute(rows)


def test_keep_one_decides_by_row(spark):
    same, own = "a b c d e f g", "q r s t u v w"
    rows = [(1, same), (2, same), (2, own), (None, own + " x y z"), (None, "lone words without any id"), (None, "lone words without any id"), (4, None)]
    kept = near.keep_one(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted(
        [("1", same), ("2", own), ("None", own + " x y z"), ("None", "lone words without any id"), ("4", "")])


def test_shared_counts_with_equal_32_bits():
    """Two n-grams of a node that agree in 32 bits are two shared ones."""
    import numpy as np
    import pyarrow as pa
    high = [5 << 32, 7 << 32, 9 << 32]
    x = np.array([high[0] | 1, high[0] | 2, high[1] | 1], np.uint64)
    y = np.array([high[0] | 1, high[0] | 2, high[2] | 1], np.uint64)
    sets = pa.record_batch({"fp": pa.array([1, 2], pa.int64()), "x": pa.array([x.tobytes(), y.tobytes()], pa.binary())})
    got = {}
    for b in near.sharer(iter(near.dealer(1)(iter([sets])))):
        for r in b.to_pylist():
            got[r["fp"]] = len(np.frombuffer(r["own"], np.uint16))
    assert got == {1: 2, 2: 2}


def test_many_near_copies_without_ids(spark):
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        own = list(base)
        own[rnd.randrange(80)] = f"e{i}"
        rows.append((None if i else 7, " ".join(own)))
    assert run(spark, rows) == brute(rows)

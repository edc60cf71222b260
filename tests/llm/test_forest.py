import random
import re

import numpy as np
import pytest

from helpers import HARD, SF_SMALL, docs, regular
from riskmart.llm import forest
from riskmart.llm import text as T
from riskmart.llm.near import shingle_sets
from riskmart.llm.spark import table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, percent=80):
    """(id, size, component, kept) of all rows by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i:i + 2]) for i in range(max(1, len(w) - 1))} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(top(i)) if sets[i] else d
        out.append((str(d), len(sets[i]), str(c), d == c))
    return sorted(out)


def run(spark, rows, **more):
    got = forest.near_copies(docs(spark, rows, **more))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got.collect())


def test_edge_cases(spark):
    rows = HARD + [(30 + i, x) for i, x in enumerate(regular(1024))] + [(None, "only rows without an id"), (None, "only rows without an id")]
    assert run(spark, rows, fp=1, key=2, kept=3, row=4) == brute(rows)
    assert forest.near_copies(docs(spark).limit(0)).count() == 0


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()]
    got = forest.op11_lsh_forest(spark, SF_SMALL).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute(rows)


def family(rnd, name, words, copies, most):
    base = [f"{name}w{i}" for i in range(words)]
    out = []
    for _ in range(copies):
        own = list(base)
        for _ in range(rnd.randint(0, most)):
            own[rnd.randrange(words)] = f"e{rnd.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def corpus(seed):
    """Near copies in many groups, one large group, and many texts that share
    most of a passage but do not link."""
    rnd = random.Random(seed)
    texts = [t for f in range(30) for t in family(rnd, f"f{f}", 120, rnd.randint(1, 12), 5)]
    texts += family(rnd, "big", 150, 250, 6)
    common = " ".join(f"c{i}" for i in range(100))
    texts += [f"{common} " + " ".join(f"t{k}x{i}" for i in range(60)) for k in range(250)]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("held,few,span", [(1 << 16, 16, 256), (100, 16, 1), (1 << 16, 4, 2)])
def test_families(spark, monkeypatch, held, few, span):
    """Also in small blocks, with deep regions and partition ends apart."""
    monkeypatch.setattr(forest, "HELD", held)
    monkeypatch.setattr(forest, "FEW", few)
    monkeypatch.setattr(forest, "SPAN", span)
    rows = corpus(3)
    assert run(spark, rows) == brute(rows)


def test_signatures_estimate_the_similarity():
    rnd = np.random.default_rng(2)
    x = np.unique(rnd.integers(0, 2**63, 900).astype(np.uint64))
    for shared in (300, 600, 800):
        y = np.unique(np.concatenate((x[:shared], rnd.integers(0, 2**63, 900 - shared).astype(np.uint64))))
        sig = forest.signatures(np.concatenate((x, y)), np.array([0, len(x)]), np.array([len(x), len(x) + len(y)]))
        want = shared / (1800 - shared)
        assert abs((sig[0] == sig[1]).mean() - want) < 0.12


def test_recall_at_the_threshold():
    """Pairs of one similarity alone in their region: shares that meet."""
    rnd = np.random.default_rng(7)
    pool, met = T.mix(rnd.integers(0, 2**63, 400_000).astype(np.uint64)), 0
    sets = []
    for k in range(200):
        own = pool[k * 1000:k * 1000 + 600]
        sets += [own[:540], own[60:]]                         # 480 of 600 shared: 0.8
    size = np.array([len(s) for s in sets])
    sig = forest.signatures(np.concatenate(sets), np.cumsum(size) - size, np.cumsum(size))
    import pyarrow as pa
    fp = np.arange(len(sets), dtype=np.int64)
    batch = pa.record_batch({"fp": fp, "n": size.astype(np.int64), "sig": pa.array([s.tobytes() for s in sig], pa.binary()), "comp": fp})
    rows = sorted(r for b in forest.orders(iter([batch])) for r in b.column(0).to_pylist())
    x, y, _, node = forest.candidates(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, forest.ROW), 80)
    met = {p for p in map(tuple, map(sorted, zip(node[x].tolist(), node[y].tolist()))) if p[1] == p[0] + 1 and p[0] % 2 == 0}
    assert len(met) >= 198
    assert shingle_sets([b"a b c"], 2)[0].shape == (2,)

def near_group(seed, copies):
    """Copies of one text with so many edits that about half of the pairs link."""
    return list(enumerate(family(random.Random(seed), "near", 150, copies, 12)))


def test_component_pairs_are_asked_not_candidates(spark, monkeypatch):
    """What lies between two components is asked once for the two, and only
    where they have candidates that were not tried yet."""
    asked, made = [], {}
    real, written = forest._apart, forest.written

    def apart(pairs, roots):
        asked.append(pairs.count())
        return real(pairs, roots)

    def spy(df, name):
        out = written(df, name)
        made.setdefault(name, []).append(out.count())
        return out
    monkeypatch.setattr(forest, "_apart", apart)
    monkeypatch.setattr(forest, "written", spy)
    rnd = random.Random(5)
    rows = list(enumerate(t for f in range(40) for t in family(rnd, f"f{f}", 150, 9, 12)))
    assert run(spark, rows) == brute(rows)
    first, closest = made["open"][0], made["tried"][1]
    assert 0 < closest < first
    assert 0 < sum(asked) <= closest


def test_candidates_grow_with_the_nodes_of_a_group():
    """A group of any size gives each row at most 7.5 pairs of its region (9
    where the key does not part it) and 3 with the rows next to it."""
    import pyarrow as pa
    made = []
    for copies in (400, 800, 1600):
        h, lo, hi = shingle_sets([t.encode() for _, t in near_group(6, copies)], 2)
        fp = np.arange(copies, dtype=np.int64)
        sig = forest.signatures(h, lo, hi)
        batch = pa.record_batch({"fp": fp, "n": (hi - lo).astype(np.int64), "sig": pa.array([s.tobytes() for s in sig], pa.binary()), "comp": fp})
        rows = sorted(r for b in forest.orders(iter([batch])) for r in b.column(0).to_pylist())
        x, _, _, _ = forest.candidates(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, forest.ROW), 80)
        made.append(len(x))
        assert len(x) <= 12 * forest.ORDERS * copies
    assert made[2] < 2.5 * made[1]


@pytest.mark.parametrize("seed,most,block,shingles,cells", [(5, 12, 4096, 1 << 18, 1 << 18), (5, 8, 4096, 1 << 18, 1 << 18), (5, 12, 40, 5000, 64)])
def test_dense_groups_are_whole(spark, monkeypatch, seed, most, block, shingles, cells):
    """Of a large group also the copies that link with few others: every
    node's closest rows may be taken by others, its links lie further away."""
    monkeypatch.setattr(forest, "BLOCK", block, raising=False)
    monkeypatch.setattr(forest, "SHINGLES", shingles, raising=False)
    monkeypatch.setattr(forest, "CELLS", cells, raising=False)
    rows = list(enumerate(family(random.Random(seed), "near", 150, 300, most)))
    assert run(spark, rows) == brute(rows)


def test_overlaps_of_a_block():
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(0, 400, rnd.integers(1, 200)).astype(np.uint64)) for _ in range(40)]
    n = np.array([len(s) for s in sets])
    known = forest.Members(np.arange(40), np.arange(40), None, n, [s.tobytes() for s in sets])
    for x in (*sets, np.array([10**9], np.uint64)):
        for of in (np.arange(40), np.array([7, 3, 39])):
            assert known.overlap(x, of).tolist() == [len(np.intersect1d(x, sets[i])) for i in of]

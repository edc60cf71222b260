import random
import re

import numpy as np
import pytest

from helpers import HARD, docs
from riskmart.llm import decontaminate as dc


def world(seed=4, items=60, texts=80):
    rnd = random.Random(seed)
    common = [f"c{i}" for i in range(40)]
    word = lambda: rnd.choice(common) if rnd.random() < 0.6 else f"r{rnd.randrange(400)}"
    bench = [(i, " ".join(word() for _ in range(rnd.randint(8, 40))) + ". " + " ".join(word() for _ in range(rnd.randint(3, 9))) + ".")
             for i in range(items)]
    rows, held = [], set()
    for d in range(texts):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 200)))]
        for _ in range(rnd.choice([0, 0, 1, 2])):
            item = bench[rnd.randrange(items)][1]
            parts += [item.upper() if rnd.random() < 0.3 else item, " ".join(word() for _ in range(rnd.randint(0, 200)))]
        rows.append((d, " ".join(parts)))
    flat = lambda t: " " + " ".join(re.findall(r"[0-9a-z]+", t.lower())) + " "
    held = {(d, i) for d, t in rows for i, b in bench if flat(b) in flat(t)}
    return bench, rows, held


def bench_table(spark, bench):
    return spark.createDataFrame(bench, "item_id long, text string")


def test_every_held_item_is_found(spark):
    bench, rows, held = world()
    out = dc.leaks(docs(spark, rows, item_id=7, score=1), bench_table(spark, bench)).collect()
    got = {(r.doc_id, r.item_id) for r in out}
    assert held and held <= got and len(got - held) <= 0.05 * len(held)
    split = {(r.doc_id, r.item_id) for r in dc.leaks(docs(spark, rows), bench_table(spark, bench), shard_items=25).collect()}
    assert held <= split
    kept = dc.drop_leaks(docs(spark, rows, item_id=7), bench_table(spark, bench))
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in got}
    assert "item_id" in kept.columns


def test_bounds_lose_nothing():
    """The windows' items at the threshold, against scoring everything."""
    bench, rows, _ = world(8)
    index = dc.Index([(i, t.encode()) for i, t in bench])
    for _, t in rows:
        h, _ = dc.words([t.encode()])
        if not len(h):
            continue
        term, want = index.terms(h), set()
        for w in range(-(-len(h) // index.stride)):
            has = np.unique(term[w * index.stride:(w + 2) * index.stride])
            for b, (own, terms, mat) in enumerate(index.blocks):
                if (mat[np.isin(terms, has)].sum(axis=0) >= dc.THRESHOLD).any():
                    want.add((w, b))
        base = np.array([0, -(-len(h) // index.stride)])
        assert want <= set(index._open(term, np.arange(len(h)) // index.stride, base))


def test_scores_are_bm25(spark):
    bench = [(1, "red fox runs fast. over hills"), (2, "red dog sleeps. on hills"), (3, "blue fox. fox jumps")]
    index = dc.Index([(i, t.encode()) for i, t in bench])
    n, mean = 3, sum(len(re.findall(r"\w+", t)) for _, t in bench) / 3
    for own, terms, mat in index.blocks:
        for c, i in enumerate(own):
            w = re.findall(r"\w+", bench[i][1])
            df = lambda x: sum(x in re.findall(r"\w+", t) for _, t in bench)
            raw = {x: np.log(1 + (n - df(x) + .5) / (df(x) + .5)) * w.count(x) * 2.2
                   / (w.count(x) + 1.2 * (.25 + .75 * len(w) / mean)) for x in w}
            got = {x: mat[np.searchsorted(terms, index.terms(dc.words([x.encode()])[0])[0]), c] for x in raw}
            assert got == pytest.approx({x: v / sum(raw.values()) for x, v in raw.items()})


def test_edge_cases(spark):
    items = [(1, None), (2, ""), (3, "?!"), (4, "one two three four"), (4, "one two three four"), (None, "word without an id here"),
             (5, " ".join(f"w{i}" for i in range(5000, 5400)))]
    out = dc.leaks(docs(spark, HARD), bench_table(spark, items)).collect()
    got = {(r.doc_id, r.item_id) for r in out}
    assert {(7, 4), (8, 4), (14, 5)} <= got and not any(d in (2, 3, 4) for d, _ in got)
    assert dc.leaks(docs(spark), bench_table(spark, items).limit(0)).count() == 0
    assert dc.leaks(docs(spark).limit(0), bench_table(spark, items)).count() == 0


@pytest.mark.parametrize("size", [128, 129, 130, 257])
def test_long_items_are_verified_whole(spark, size):
    """Segments find, but only the whole item's question and answer count."""
    item = [f"q{i}" for i in range(size - 6)] + [f"a{i}" for i in range(6)]
    text = " ".join(item[:-6]) + ". " + " ".join(item[-6:]) + "."
    other = [f"x{i}" for i in range(300)]
    rows = [(1, " ".join(other[:150]) + " " + text + " " + " ".join(other)), (2, text),
            (3, " ".join(other + item[-1:] + other)), (4, " ".join(other + item[-2:])),           # the last words
            (5, " ".join(other + item[:-6] + other)),                                              # no answer
            (6, " ".join(other + item[-6:] + other)),                                              # no question
            (7, " ".join(item[:size // 3] + other + item[-6:])),                                   # a third of the question
            (8, " ".join(other))]
    got = {r.doc_id: r for r in dc.leaks(docs(spark, rows), bench_table(spark, [(9, text)])).collect()}
    assert set(got) == {1, 2}
    assert all((r.score, r.question_overlap, r.answer_overlap) == pytest.approx((1, 1, 1)) for r in got.values())
    kept = dc.drop_leaks(docs(spark, rows), bench_table(spark, [(9, text)]))
    assert {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 7, 8}


def test_shards_by_distinct_items_and_bytes(spark, monkeypatch):
    bench, rows, held = world()
    copied = bench_table(spark, bench + [bench[0]] * 500)
    indexes = [x.value for x in dc.indexes(spark, copied, shard_items=100)]
    assert [len(x.ids) for x in indexes] == [len(bench)]                    # copies are one item
    monkeypatch.setattr(dc, "SHARD_BYTES", sum(len(t) for _, t in bench) // 3)
    indexes = [x.value for x in dc.indexes(spark, copied)]
    assert len(indexes) >= 3 and sorted(i for x in indexes for i in x.ids) == [i for i, _ in bench]
    assert held <= {(r.doc_id, r.item_id) for r in dc.leaks(docs(spark, rows), copied).collect()}


def test_items_without_id_and_short_items(spark):
    long = "what is the name of the river that runs through the old town? it is the long green river"
    items = [(None, long), (-1, "another long question about mountains and lakes in the north? the answer is seven lakes"),
             (3, "the"), (4, "blue stone bridge at noon")]
    rows = [(1, f"x y z {long} z y x"), (2, "the weather is fine"), (3, "a blue stone bridge at noon was seen"),
            (4, "a stone bridge at noon, blue as the sky"), (5, "bridge noon blue")]
    got = {(r.doc_id, r.item_id) for r in dc.leaks(docs(spark, rows), bench_table(spark, items)).collect()}
    assert got == {(1, None), (1, 3), (2, 3), (3, 4), (4, 3)}

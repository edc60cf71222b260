import numpy as np
from pyspark.sql import functions as F

from helpers import SF_SMALL
from riskmart.llm import vptree


def exact(ids, x, queries, k):
    out = {}
    for q in queries:
        i = ids.index(q)
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = sorted((float(d[j]), ids[j]) for j in range(len(ids)) if ids[j] != q)
        out[q] = [(v, s) for s, v in order[:k]]
    return out


def as_dict(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_factor_one_is_exact_with_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 6)).round(1)
    x[100:400] = x[5]                                    # a third of the rows are copies
    ids = [int(i) for i in rng.permutation(2000)[:900]]
    df = spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in zip(ids, x)], "vec_id long, embedding array<double>, label int")
    got = as_dict(vptree.nearest(df, F.col("vec_id") % 20 == 0, factor=1.0, shard_rows=200).collect())
    want = exact(ids, x, [i for i in ids if i % 20 == 0], 10)
    assert got.keys() == want.keys()
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_recall_of_the_query(spark):
    t = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = [r.vec_id for r in t], np.array([r.embedding for r in t], float)
    got, want = as_dict(vptree.op6_vp_tree(spark, SF_SMALL).collect()), exact(ids, x, [i for i in ids if i % 100 == 0], 10)
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (1, [0.0, 2.0]), (9, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = as_dict(vptree.nearest(df, F.lit(True)).collect())
    assert got == {0: [(9, 0.0), (1, 2 ** 0.5)], 1: [(0, 2 ** 0.5), (9, 2 ** 0.5)], 9: [(0, 0.0), (1, 2 ** 0.5)]}
    assert vptree.nearest(df.limit(0), F.lit(True)).count() == 0

"""Quality and toxicity: held-out accuracy and the defined cases."""

import numpy as np

from helpers import HARD, docs
from riskmart.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def auc(s, y):
    pos, neg = [a for a, b in zip(s, y) if b], [a for a, b in zip(s, y) if not b]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def test_quality_on_held_out_rows(spark):
    import zlib
    known, rows = labels(spark), quality.op5_quality_classifier(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    own = [(r.score, known[r.doc_id].quality) for r in rows if r.held_out and r.doc_id in known]
    assert auc(*zip(*own)) > 0.97


def test_toxicity_on_held_out_rows(spark):
    known, rows = labels(spark), toxicity.op10_toxicity(spark, SF).collect()
    held = {r.doc_id for r in quality.held_out_rows(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    own = [(r.expected_severity, known[r.doc_id].toxic) for r in rows if r.doc_id in held and r.doc_id in known]
    assert auc(*zip(*own)) > 0.85
    assert not any(r.toxic for r in rows if r.doc_id in known and known[r.doc_id].toxic == 0)
    assert all(0 <= r.expected_severity <= toxicity.GRADES - 1 and (r.grade > 0) == r.toxic for r in rows)


def test_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1), (5, 1, None), (None, 0, 0), (6, None, 1)], "doc_id long, quality int, toxic int")
    for table in (none, one):
        got = quality.quality_scores(docs(spark, HARD, score=2), table).collect()
        assert len(got) == len(HARD) and all(0 <= r.score <= 1 for r in got)
        got = toxicity.severity(docs(spark, HARD, grade=2), table).collect()
        assert len(got) == len(HARD) and not any(r.toxic for r in got)
    assert quality.quality_scores(docs(spark).limit(0), one).count() == 0
    assert toxicity.severity(docs(spark).limit(0), one).count() == 0
    kept = quality.keep_good(docs(spark, least=1), none)
    assert kept.columns[-1] == "least" and kept.count() == len(HARD)


def test_context_counts_by_hand():
    texts = ["a b c", "b, c", ""]
    h, doc = quality.words([t.encode() for t in texts])
    want = np.zeros((quality.BUCKETS, quality.DIM), int)
    for i in range(len(h)):
        for j in range(len(h)):
            if i != j and doc[i] == doc[j] and abs(i - j) <= quality.WINDOW:
                for shift in (0, 16):
                    sign = 1 - 2 * (int(h[j]) >> (shift + 10) & 1)
                    want[quality.bucket_of(h[i:i + 1])[0], int(h[j]) >> shift & (quality.DIM - 1)] += sign
    assert (quality.context_counts([t.encode() for t in texts]).reshape(want.shape) == want).all()


def test_pool_by_hand():
    v = np.random.default_rng(0).normal(size=(quality.BUCKETS, quality.DIM)).astype(np.float32)
    got = quality.pool([b"", b"a b b", b"!"], v)
    w = v[quality.bucket_of(quality.words([b"a b b"])[0])]
    want = np.concatenate([w.sum(0), (w * w).sum(0), (w[1:] * w[:-1]).sum(0)]) / 3
    assert np.allclose(got[1], want, atol=1e-5) and not got[0].any()


def test_temperature_and_thresholds():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] + 0.7 * rng.normal(size=600) > 0).astype(float)
    net = quality.Network(x, y)
    assert auc(net.scores(x), y) > 0.8 and 0.25 <= net.temperature <= 8
    doc, feat = np.repeat(np.arange(300), 2), rng.integers(0, 6, 600)
    grade = np.bincount(doc, feat == 0, minlength=300).astype(int)
    m = toxicity.Ordinal(doc, feat, 6, grade, 3)
    assert (np.diff(m.cuts) > 0).all() and m.w[0] > m.w[1:].max()


def test_filter_and_prediction_agree(spark, monkeypatch):
    none = spark.createDataFrame([], "doc_id long, quality int")
    for score in (0.1, 0.3, 0.49, 0.5, 0.9):
        monkeypatch.setattr(quality, "fit", lambda *a, score=score, **b: quality.Constant(score))
        good = sum(r.predicted for r in quality.quality_scores(docs(spark), none).collect())
        assert quality.keep_good(docs(spark), none).count() == good == (len(HARD) if score >= 0.5 else 0)


def test_a_repeated_id_is_one_row_of_the_sample(spark, monkeypatch):
    from pyspark.sql import functions as F
    rows = [(i, f"text {i} " + ("bad words" if i % 2 else "good ones")) for i in range(40)]
    rows += [(0, f"another text {i}") for i in range(300)]
    known = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "Network", lambda x, y: seen.append(y.tolist()))
    monkeypatch.setattr(toxicity, "Model", lambda x, y: seen.append(y.tolist()))
    vectors = spark.sparkContext.broadcast(np.ones((quality.BUCKETS, quality.DIM), np.float32))
    quality.fit(docs(spark, rows), known, vectors, F.lit(True), sample=40)
    toxicity.fit(docs(spark, rows), known, F.lit(True), sample=40)
    assert seen == [[0.0, 1.0] * 20] * 2                # in order of the id

"""Operator 10, toxicity: cumulative-link ordinal regression on sparse text
features.

Features are hashed words (A-Z lower-cased) and hashed word beginnings of
three lengths in bytes, present or not, so that inflected forms share some.
Grades run from 0 (clean) to GRADES - 1.  The labels only say toxic or not,
so the grades of toxic documents are set by how many of their words carry a
marker, split at the quantiles of the toxic documents.

The model is P(grade <= k) = sigmoid(theta_k - w.x): one weight vector for
all thresholds, thresholds ordered by construction (positive steps).  The
expected severity is the sum over k of P(grade > k); a document is called
toxic from the value of w.x that best parts the two kinds of the fitted rows
(largest difference of the shares caught, halfway to the next value).
Features enter when toxic documents hold them far more often than chance says.

The fit sees at most SAMPLE labelled rows (smallest hash of the id) that
``learn`` admits: Spark counts their features, the few markers and which
document holds them reach the driver.  Scoring covers all documents in one
pass.

Defined cases: null and empty texts have no features and get the severity of
such; labels that repeat a doc_id are averaged, null ones left out; without
both labels no feature enters, the severity is that of the base rate and no
document is called toxic; an
empty table gives no rows; a null doc_id stays; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.llm import text as T
from riskmart.llm.quality import held_out_ids, sigmoid
from riskmart.llm.spark import bounded_batches, table

BITS = 22
STARTS = (4, 5, 6)       # bytes of a word's beginning
GRADES = 4
SAMPLE = 16_000          # labelled documents that the model is fitted on, at most
SURE = 8.5               # how rare by chance a feature's count among the toxic is: exp(-SURE)
STEPS = 400
RIDGE = 1e-4
PIECE = 1 << 20
U64 = np.uint64
_PART = np.zeros(256, dtype=bool)
_PART[48:58] = _PART[97:123] = _PART[128:] = True


def word_features(texts: list):
    """(feature ids, one row for whole words and for each length of
    beginnings; text index of the words)."""
    buf, _, ends = T.join(texts)
    low = T.LOWER[buf]
    part = _PART[low]
    cut = np.flatnonzero(np.diff(part, prepend=False, append=False))
    s, e = cut[::2], cut[1::2]
    rows = [T.span_hash(low, s, e)]
    for n in STARTS:
        rows.append(T.mix(T.span_hash(low, s, np.minimum(e, s + n)) + U64(n)))
    return np.stack([(x >> U64(64 - BITS)).astype(np.int32) for x in rows]), np.searchsorted(ends, s, side="right")


class Ordinal:
    """Cumulative-link logistic regression, fitted with Adam on all rows."""

    def __init__(self, doc, feat, n_features: int, grade: np.ndarray, grades: int = GRADES):
        n = len(grade)
        share = np.array([(grade <= k).mean() for k in range(grades - 1)]).clip(1e-3, 1 - 1e-3)
        theta = np.log(share / (1 - share))
        p = [np.zeros(n_features), theta[:1].copy(), np.log(np.maximum(np.diff(theta), 0.05))]
        m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
        row = np.arange(n)
        for step in range(1, STEPS + 1):
            cut = self._cuts(p)
            z = np.bincount(doc, p[0][feat], minlength=n)
            below = np.hstack([np.zeros((n, 1)), sigmoid(cut[None, :] - z[:, None]), np.ones((n, 1))])
            hi, lo = below[row, grade + 1], below[row, grade]
            g = hi + lo - 1
            dens = np.maximum(hi - lo, 1e-9)
            dcut = np.zeros((n, grades + 1))
            dcut[row, grade + 1] += hi * (1 - hi) / dens
            dcut[row, grade] -= lo * (1 - lo) / dens
            dcut = dcut[:, 1:grades].sum(axis=0) / n
            grads = [np.bincount(feat, g[doc], minlength=n_features) / n - RIDGE * p[0], np.array([dcut.sum()]),
                     np.array([dcut[k:].sum() for k in range(1, len(dcut))]) * np.exp(p[2])]
            for k, x in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.999 * v[k] + 0.001 * x * x
                p[k] = p[k] + 0.05 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        self.w, self.cuts = p[0], self._cuts(p)

    @staticmethod
    def _cuts(p):
        return np.concatenate((p[1], p[1] + np.cumsum(np.exp(p[2]))))


def is_marker(n, t, share: float):
    """Column or array test: the feature's ``t`` toxic documents of ``n`` are
    at least half, and by chance (``share`` of all) come with exp(-SURE)."""
    expected = n * share
    log = F.log if isinstance(n, Column) else np.log
    return (t >= 0.5 * n) & (t * log(t / expected) - t + expected >= SURE)


class Model:
    """Weights by feature id (0: not used), and the thresholds.  ``docs``
    holds each fitted document's marker features."""

    def __init__(self, docs: list, toxic: np.ndarray, grades: int = GRADES):
        self.weights, self.cuts = np.zeros(1 << BITS, np.float32), np.full(grades - 1, 50.0)
        self.least = np.inf              # logit from which a document is called toxic
        n = len(docs)
        if n:
            rate = float(np.clip(toxic.mean(), 1e-3, 1 - 1e-3))
            self.cuts = np.log((1 - rate) / rate) + np.arange(grades - 1.0)
        if not n or toxic.min() == toxic.max() or not any(map(len, docs)):
            return
        doc, feat = np.repeat(np.arange(n), [len(d) for d in docs]), np.concatenate(docs)
        name, feat = np.unique(feat, return_inverse=True)
        held = np.bincount(doc, minlength=n)
        edges = np.quantile(held[toxic > 0], np.arange(1, grades - 1) / (grades - 1))
        grade = np.where(toxic > 0, 1 + np.searchsorted(edges, held, side="left").clip(0, grades - 2), 0)
        fit = Ordinal(doc, feat, len(name), grade, grades)
        self.weights[name], self.cuts = fit.w, fit.cuts
        z = np.bincount(doc, fit.w[feat], minlength=n)
        order = np.argsort(z, kind="stable")
        gain = np.cumsum(np.where(toxic[order] > 0, -1 / (toxic > 0).sum(), 1 / (toxic == 0).sum()))
        gain[:-1][z[order][1:] == z[order][:-1]] = -np.inf      # no cut between equal values
        k = int(np.argmax(gain[:-1]))
        self.least = float(z[order[k]] + z[order[k + 1]]) / 2

    def logits(self, texts: list) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, j in T.pieces(texts, PIECE):
            feats, doc = word_features(texts[i:j])
            kind, at = np.nonzero(self.weights[feats])
            pair = np.unique((doc[at].astype(np.int64) << BITS) | feats[kind, at])
            np.add.at(out, i + (pair >> BITS), self.weights[pair & ((1 << BITS) - 1)])
        return out

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k."""
        return sigmoid(z[:, None] - self.cuts[None, :])


def distinct_features(texts: list) -> list:
    out = []
    for i, j in T.pieces(texts, PIECE):
        feats, doc = word_features(texts[i:j])
        lo, hi = T.group_bounds(doc, j - i)
        out += [np.unique(feats[:, a:b]) for a, b in zip(lo, hi)]
    return out


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col="doc_id", text_col="text", label_col="toxic",
        sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    known = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).where(learn)
             .groupBy("doc_id").agg(F.avg("y").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id")

    def tally(batches):
        for b in batches:
            found = distinct_features(T.as_bytes(b.column(1)))
            toxic = np.repeat(np.array(b.column(2).to_pylist()) >= 0.5, [len(x) for x in found])
            name, at, n = np.unique(np.concatenate([*found, np.zeros(0, np.int32)]), return_inverse=True, return_counts=True)
            yield pa.record_batch({"feature": pa.array(name, pa.int32()), "n": pa.array(n, pa.int64()),
                                   "t": pa.array(np.bincount(at, toxic, minlength=len(name)).astype(np.int64))})

    rows = rows.select("doc_id", "text", "y")
    total = known.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("y") >= 0.5).cast("int")), F.lit(0)).alias("t")).first()
    markers = np.zeros(0, np.int32)
    if 0 < total.t < total.n:
        counts = rows.mapInArrow(tally, "feature int, n long, t long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
        got = counts.where("t > 0").where(is_marker(F.col("n"), F.col("t"), total.t / total.n)).select("feature").collect()
        markers = np.sort(np.array([r.feature for r in got], np.int32))
    wanted = spark.sparkContext.broadcast(markers)

    def features(batches):
        for b in batches:
            found = [np.intersect1d(x, wanted.value) for x in distinct_features(T.as_bytes(b.column(1)))]
            yield pa.record_batch({"doc_id": b.column(0), "y": b.column(2), "x": pa.array([x.tobytes() for x in found], pa.binary())})

    # documents may repeat an id: one row of each, the least
    got = (rows.mapInArrow(features, "doc_id long, y double, x binary")
           .groupBy("doc_id").agg(F.first("y").alias("y"), F.min("x").alias("x")).collect())
    got = sorted(got, key=lambda r: r.doc_id)
    return Model([np.frombuffer(r.x, np.int32) for r in got], np.array([float(r.y >= 0.5) for r in got]))


def severity(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, expected_severity, grade, p_toxic, toxic) for every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels, ~held_out_ids(F.col("doc_id")), id_col, text_col, sample=sample))

    def score(batches):
        for b in batches:
            z = model.value.logits(T.as_bytes(b.column(1)))
            p, toxic = model.value.above(z), z >= model.value.least
            grades = np.hstack([np.ones((len(p), 1)), p]) - np.hstack([p, np.zeros((len(p), 1))])
            grade = np.where(toxic, 1 + grades[:, 1:].argmax(axis=1), 0)
            yield pa.record_batch({"doc_id": b.column(0).cast(pa.int64()), "expected_severity": pa.array(p.sum(axis=1), pa.float64()),
                                   "grade": pa.array(grade, pa.int32()), "p_toxic": pa.array(p[:, 0], pa.float64()),
                                   "toxic": pa.array(toxic)})
    return (docs.select(F.col(id_col).cast("long"), F.col(text_col))
            .mapInArrow(score, "doc_id long, expected_severity double, grade int, p_toxic double, toxic boolean"))


def op10_toxicity(spark, sf_dir) -> DataFrame:
    """Operator 10 over all documents."""
    return severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

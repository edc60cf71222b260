"""Operator 5, quality classifier: random-indexing word vectors pooled per
document, then a two-layer numpy network with a calibrated temperature.

Words are runs of letters and digits (and of bytes beyond ASCII), and runs of
other signs.  Every word has a sparse random index vector (two of DIM places,
signs by hash); the vector of a word is the sum of the index vectors of its
neighbours within WINDOW words over all documents, scaled to length one.
Words share BUCKETS rows by hash, so the table has one size at any scale; the
counts are whole numbers, summed per task and then per slice of the table.

A document is pooled to three averages over its words: of the vectors, of
their squares and of the products of adjacent vectors.  The network (tanh
layer, logistic output) is trained on the driver on at most SAMPLE labelled
documents, those with the smallest hash of the id, of the rows that ``learn``
admits, one row of each id; a fifth of them only sets the temperature.  Scores then come from one
pass over all documents.

Defined cases: null and empty texts pool to zeros and are scored like any
other; labels that repeat a doc_id are averaged (0.5 and more counts as 1),
null labels and ids are left out; with fewer than LEAST labelled rows or
without both labels every score is the share of label 1 (0.5 without any); an empty table gives no rows; a null
doc_id is not held out; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.llm import text as T
from riskmart.llm.spark import bounded_batches, table

DIM = 32
BUCKETS = 1 << 14
WINDOW = 2
SLICES = 16
SAMPLE = 16_000          # labelled documents that the network is fitted on, at most
HIDDEN = 32
EPOCHS = 40
PIECE = 1 << 20
U64 = np.uint64

#: 0 white space and control, 1 letters, digits and beyond ASCII, 2 signs.
_KIND = np.full(256, 2, dtype=np.int8)
_KIND[:33] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[127] = 0


# -- words and vectors -----------------------------------------------------

def words(texts: list):
    """(hash, text index) of all words, case kept."""
    buf, _, ends = T.join(texts)
    kind = _KIND[buf]
    cut = np.flatnonzero(np.diff(kind, prepend=np.int8(0)))
    stop = np.append(cut[1:], len(buf))
    real = kind[cut] > 0
    s, e = cut[real], stop[real]
    return T.span_hash(buf, s, e), np.searchsorted(ends, s, side="right")


def bucket_of(h: np.ndarray) -> np.ndarray:
    return (h >> U64(50)).astype(np.int64) & (BUCKETS - 1)


def context_counts(texts: list) -> np.ndarray:
    """Sums of the neighbours' index vectors, by bucket and place."""
    out = np.zeros(BUCKETS * DIM)
    for i, j in T.pieces(texts):
        h, doc = words(texts[i:j])
        row = bucket_of(h) * DIM
        for shift in (0, 16):
            place = ((h >> U64(shift)) & U64(DIM - 1)).astype(np.int64)
            sign = 1.0 - 2.0 * ((h >> U64(shift + 10)) & U64(1)).astype(np.float64)
            for k in range(1, WINDOW + 1):
                same = doc[k:] == doc[:-k]
                for own, other in ((slice(k, None), slice(None, -k)), (slice(None, -k), slice(k, None))):
                    out += np.bincount(row[own][same] + place[other][same], weights=sign[other][same], minlength=len(out))
    return out.astype(np.int64)


def vectors_of(counts: np.ndarray) -> np.ndarray:
    """Rows of length one; buckets without words stay zero."""
    x = counts.reshape(BUCKETS, DIM).astype(np.float64)
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return (x / np.maximum(size, 1)).astype(np.float32)


def pool(texts: list, vectors: np.ndarray) -> np.ndarray:
    """3 * DIM averages for each text."""
    out = np.zeros((len(texts), 3 * DIM))
    for i, j in T.pieces(texts, PIECE):
        h, doc = words(texts[i:j])
        if not len(h):
            continue
        v = vectors[bucket_of(h)]
        at = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        for d, lo, hi in zip((i + doc[at]).tolist(), at.tolist(), [*at[1:].tolist(), len(doc)]):
            w = v[lo:hi]
            out[d] = np.concatenate((w.sum(axis=0), np.einsum("ij,ij->j", w, w), np.einsum("ij,ij->j", w[1:], w[:-1]))) / (hi - lo)
    return out


# -- network ---------------------------------------------------------------

def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class Network:
    """tanh layer and logistic output; inputs are scaled by the fit's mean
    and deviation, the output by the calibrated temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        part = rng.permutation(len(x))
        hold, fit = part[:len(x) // 5], part[len(x) // 5:]
        z = self._scaled(x)
        n = z.shape[1]
        p = [rng.normal(0, n ** -0.5, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(EPOCHS):
            order = rng.permutation(fit)
            for i in range(0, len(order), 128):
                own = order[i:i + 128]
                a = np.tanh(z[own] @ p[0] + p[1])
                e = (sigmoid(a @ p[2] + p[3]) - y[own]) / len(own)
                back = np.outer(e, p[2]) * (1 - a * a)
                grads = [z[own].T @ back + 1e-4 * p[0], back.sum(axis=0), a.T @ e + 1e-4 * p[2], np.array([e.sum()])]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if len(hold):
            logits = self.logits(x[hold])
            tried = np.exp(np.linspace(np.log(0.25), np.log(8), 81))
            loss = [np.logaddexp(0, np.where(y[hold] > 0, -1, 1) * logits / t).mean() for t in tried]
            self.temperature = float(tried[int(np.argmin(loss))])

    def _scaled(self, x):
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logits(self, x):
        a = np.tanh(self._scaled(x) @ self.p[0] + self.p[1])
        return a @ self.p[2] + self.p[3][0]

    def scores(self, x):
        return sigmoid(self.logits(x) / self.temperature)


class Constant:
    def __init__(self, p: float):
        self.p = p

    def scores(self, x):
        return np.full(len(x), self.p)


# -- Spark -----------------------------------------------------------------

def _counts_task(batches):
    total, some = np.zeros(BUCKETS * DIM, np.int64), False
    for b in batches:
        total += context_counts(T.as_bytes(b.column(0)))
        some = True
    if some:
        parts = np.split(total, SLICES)
        yield pa.record_batch({"slice": pa.array(range(SLICES), pa.int32()),
                               "n": pa.array([x.astype(np.int32).tobytes() for x in parts], pa.binary())})


def _sum_task(batches):
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            own = np.frombuffer(x, np.int32).astype(np.int64)
            sums[s] = sums[s] + own if s in sums else own
    yield pa.record_batch({"slice": pa.array(list(sums), pa.int32()),
                           "n": pa.array([x.tobytes() for x in sums.values()], pa.binary())})


def word_vectors(docs: DataFrame, text_col="text") -> np.ndarray:
    """The table of word vectors of all documents (BUCKETS x DIM)."""
    bounded_batches(docs.sparkSession)
    parts = (docs.select(text_col).mapInArrow(_counts_task, "slice int, n binary").repartition(SLICES, "slice")
             .mapInArrow(_sum_task, "slice int, n binary").collect())
    counts = np.zeros(BUCKETS * DIM, np.int64)
    for r in parts:
        width = len(counts) // SLICES
        counts[r.slice * width:(r.slice + 1) * width] = np.frombuffer(r.n, np.int64)
    return vectors_of(counts)


def fit(docs: DataFrame, labels: DataFrame, vectors, learn: Column, id_col="doc_id", text_col="text",
        label_col="quality", sample: int = SAMPLE):
    """A network fitted on a bounded sample of the labelled rows that
    ``learn`` (an expression on doc_id) admits."""
    known = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y"))
             .where(learn).groupBy("doc_id").agg(F.avg("y").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id")

    def features(batches):
        for b in batches:
            x = pool(T.as_bytes(b.column(1)), vectors.value).astype(np.float32)
            yield pa.record_batch({"doc_id": b.column(0), "y": b.column(2), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    # documents may repeat an id: one row of each, the least
    got = (rows.select("doc_id", "text", "y").mapInArrow(features, "doc_id long, y double, x binary")
           .groupBy("doc_id").agg(F.first("y").alias("y"), F.min("x").alias("x")).collect())
    got = sorted(got, key=lambda r: r.doc_id)
    y = np.array([r.y >= 0.5 for r in got], float)
    if len(got) < LEAST or y.min() == y.max():
        return Constant(float(y.mean()) if len(y) else 0.5)
    return Network(np.array([np.frombuffer(r.x, np.float32) for r in got], float), y)


def held_out_ids(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def held_out_rows(docs: DataFrame, id_col="doc_id") -> DataFrame:
    """The ids of rows that no label is learnt from."""
    return docs.where(held_out_ids(F.col(id_col))).select(id_col)


LEAST = 10               # labelled rows, of both classes, below which every score is the share of label 1
REJECT = 0.5             # score below which a document is predicted bad and the filter lets it go


def quality_scores(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(docs, text_col))       # BUCKETS * DIM floats
    model = spark.sparkContext.broadcast(fit(docs, labels, vectors, ~held_out_ids(F.col("doc_id")), id_col, text_col,
                                             sample=sample))

    def score(batches):
        for b in batches:
            s = model.value.scores(pool(T.as_bytes(b.column(1)), vectors.value))
            yield pa.record_batch({"doc_id": b.column(0).cast(pa.int64()), "score": pa.array(s, pa.float64())})

    scored = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out_ids(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= REJECT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", least: float = REJECT,
              sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``least``."""
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(docs, text_col))
    model = spark.sparkContext.broadcast(fit(docs, labels, vectors, ~held_out_ids(F.col("doc_id")), id_col, text_col,
                                             sample=sample))
    at = docs.columns.index(text_col)

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array(model.value.scores(pool(T.as_bytes(b.column(at)), vectors.value)) >= least, pa.bool_()))
    return docs.mapInArrow(keep, docs.schema)


def op5_quality_classifier(spark, sf_dir) -> DataFrame:
    """Operator 5 over all documents (contract columns)."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Operator 12, target-distribution importance resampling.

Features of a text are its runs of one to three words; a feature's bucket is
the CRC-32 of its bytes modulo 10,000.  How often each bucket occurs in all
documents and in all target texts gives it a gain; a document's weight is the
sum of its features' gains, and the highest scores (weight plus Gumbel noise
from the id) are drawn.

No feature is ever spelled out.  The distinct words of a few megabytes of
text, each with the delimiter before and after it, make an Aho-Corasick
dictionary whose entries carry the word's CRC-32 and length; one scan of the
text emits these payloads word after word.  The checksum of two strings
behind one another follows from their checksums and the second's length
(shifting by zero bytes is linear over GF(2)), so two vectorised compositions
of neighbouring payloads give the checksums of all pairs and triples.

1. ``bucket_counts``: counts by bucket, summed in the task, then in Spark.
2. ``scored``: weight, noise and score of each document, from the 10,000 gains.
3. ``drawn``: documents by score over ranges of (score, id), numbered within
   each range; the ranges' sizes give the ranks.  Rows of equal score and id
   are spread by a third key, so no range outgrows a task.

Defined cases: a null, empty or wordless text has no feature, weight 0, and
is never drawn; a null id counts as the empty string in the noise and comes
last among ties; rows that repeat an id are documents of their own, of equal
ones any may come first; without target texts T is 0; tables without rows give
none; other columns are not read.  Words of more than LONG bytes are kept out
of the dictionary: a short token stands for them in the scan.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskmart.llm import text as T
from riskmart.llm.spark import bounded_batches, partitions, table, written

BUCKETS = 10_000
SHARE = 5                # documents drawn of 100 that have enough words
MIN_WORDS = 20
SEED = 42
LONG = 256               # bytes of a word up to which it enters the dictionary
BLOCK = 1 << 20          # words composed at a time
SHORT = 64               # bytes up to which a shift is one table

#: A-Z to a-z, 0-9, a-z and all bytes beyond ASCII unchanged, the others to a space.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TOKEN = re.compile(rb"[^ ]{%d,}" % (LONG + 1))


# -- checksums ---------------------------------------------------------------

def _one_byte() -> np.ndarray:
    """What CRC-32's register becomes from each low byte by a zero byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)      # fixed value: CRC-32's polynomial
    return c


_STEP = _one_byte()
_LANES = np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None]


def _apply(op: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A linear map, given by its values at each byte of the register."""
    return op[0][c & 255] ^ op[1][c >> 8 & 255] ^ op[2][c >> 16 & 255] ^ op[3][c >> 24]


def _shifts() -> np.ndarray:
    """The maps for 0 to SHORT zero bytes."""
    ops = np.empty((SHORT + 1, 4, 256), np.uint32)
    ops[0] = np.arange(256, dtype=np.uint32) << _LANES
    for n in range(SHORT):
        ops[n + 1] = _STEP[ops[n] & 255] ^ (ops[n] >> 8)
    return ops


_SHIFT = _shifts()


def shift(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The checksum's share of a string before ``n`` further bytes."""
    c = c.astype(np.uint32)
    at = np.minimum(n, SHORT) * 1024
    flat = _SHIFT.ravel()
    out = flat[at + (c & 255)] ^ flat[at + 256 + (c >> 8 & 255)] ^ flat[at + 512 + (c >> 16 & 255)] ^ flat[at + 768 + (c >> 24)]
    far = np.flatnonzero(n > SHORT)
    if len(far):
        left, op = n[far] - SHORT, _SHIFT[1]
        while left.any():
            odd = np.flatnonzero(left & 1)
            out[far[odd]] = _apply(op, out[far[odd]])
            left >>= 1
            op = _apply(op, op)                        # the map for twice as many bytes
    return out


_SPACE = np.array([zlib.crc32(b" ")], np.uint32)


def feature_buckets(crc: np.ndarray, size: np.ndarray, doc: np.ndarray, buckets: int = BUCKETS):
    """From the words' payloads, in order: (bucket, document) of all runs of
    one, two and three words that lie in one document."""
    after = shift(np.broadcast_to(_SPACE, crc.shape), size) ^ crc            # of a space and the word
    width = size + 1
    two = shift(crc[:-1], width[1:]) ^ after[1:]
    three = shift(two[:-1], width[2:]) ^ after[2:]
    same2, same3 = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    return (np.concatenate((crc, two[same2], three[same3])) % np.uint32(buckets),
            np.concatenate((doc, doc[1:][same2], doc[2:][same3])))


# -- the scan ----------------------------------------------------------------

def payloads(texts: list):
    """(checksum, length in bytes, index of the text) of each word of the
    texts (bytes), in order, from one scan with their own dictionary."""
    import ahocorasick
    plain = [t.translate(_WORD) for t in texts]
    special: dict = {}

    def token(m):
        word = m.group()
        return special.setdefault(word, b"\x01%d" % len(special))           # holds a byte that no word has
    if any(len(t) > LONG for t in plain):
        plain = [_TOKEN.sub(token, t) if len(t) > LONG else t for t in plain]
    lists = [t.split() for t in plain]
    per = np.fromiter(map(len, lists), np.int64, len(lists))
    words = list(set().union(*lists))
    if not words:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    names = {v: k for k, v in special.items()}
    own = [names.get(w, w) for w in words] if names else words
    entry = np.fromiter(map(zlib.crc32, own), np.int64, len(own)) << 31 | np.fromiter(map(len, own), np.int64, len(own))
    keys = [f" {w} " for w in b" ".join(words).decode("utf-8", "surrogateescape").split(" ")]
    scan = ahocorasick.Automaton()
    for _ in map(scan.add_word, keys, entry.tolist()):
        pass
    scan.make_automaton()
    whole = b" ".join([b"", *plain, b""]).decode("utf-8", "surrogateescape")
    got = np.fromiter(map(itemgetter(1), scan.iter(whole)), np.int64, int(per.sum()))
    return (got >> 31).astype(np.uint32), got & (2**31 - 1), np.repeat(np.arange(len(per)), per)


def _segments(text: bytes):
    """A long text in parts that end before an ASCII byte no word holds."""
    at = 0
    while len(text) - at > T.CHUNK:
        z = at + T.CHUNK
        while z < len(text) and _WORD[text[z]] != 32:
            z += 1
        yield text[at:z]
        at = z
    yield text[at:]


def features(texts: list, buckets: int = BUCKETS):
    """Blocks of (bucket, index of the text) of all features, and the number
    of words of each text."""
    words = np.zeros(len(texts), np.int64)
    parts = []
    for i, j in T.pieces(texts):
        if j - i > 1 or len(texts[i]) <= T.CHUNK:
            crc, size, doc = payloads(texts[i:j])
        else:
            got = [payloads([t])[:2] for t in _segments(texts[i])]
            crc, size = (np.concatenate(x) for x in zip(*got))
            doc = np.zeros(len(crc), np.int64)
        doc += i
        words += np.bincount(doc, minlength=len(texts))
        parts += [(crc[a:a + BLOCK + 2], size[a:a + BLOCK + 2], doc[a:a + BLOCK + 2], a > 0) for a in range(0, len(crc), BLOCK)]
    return parts, words


def bucketed(part, buckets: int):
    """The features of one block of ``features``; the two words that a block
    shares with the next are counted there."""
    crc, size, doc, _ = part
    own = min(len(crc), BLOCK)
    bucket, of = feature_buckets(crc, size, doc, buckets)
    if own < len(crc):
        late, late_of = feature_buckets(crc[own:], size[own:], doc[own:], buckets)
        return bucket, of, late, late_of
    return bucket, of, bucket[:0], of[:0]


# -- Spark -------------------------------------------------------------------

def _gathered(batches, column: int):
    """Batches with their texts, as many at once as make T.CHUNK bytes: the
    more text, the fewer words of it are new to the dictionary."""
    held, size = [], 0
    for b in batches:
        held.append((b, T.as_bytes(b.column(column))))
        size += sum(map(len, held[-1][1]))
        if size >= T.CHUNK:
            yield pa.Table.from_batches([x for x, _ in held]), [t for _, texts in held for t in texts]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches([x for x, _ in held]), [t for _, texts in held for t in texts]


def bucket_counts(rows: DataFrame, text_col="text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often the features of all texts fall in each bucket."""
    bounded_batches(rows.sparkSession)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for _, texts in _gathered(batches, 0):
            for part in features(texts, buckets)[0]:
                bucket, _, late, _ = bucketed(part, buckets)
                total += np.bincount(bucket, minlength=buckets) - np.bincount(late, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(some, pa.int32()), "n": pa.array(total[some], pa.int64())})
    return rows.select(F.col(text_col)).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _collected(counts: DataFrame, buckets: int) -> list:
    """The counts on the driver: one number a bucket."""
    out = [0] * buckets
    for r in counts.collect():
        out[r.bucket] = r.n
    return out


def gains_of(source: list, target: list) -> np.ndarray:
    """Each bucket's gain: a thousand times the log of the ratio of its
    shares, both with one added to every count."""
    n, s_all, t_all = len(source), float(sum(source)), float(sum(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source, target)], np.int64)


def noise(seed: int, doc_id) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, id_col="doc_id", text_col="text", seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b, texts in _gathered(batches, 1):
            ids = b.column(0).to_pylist()
            weight = np.zeros(len(texts), np.int64)
            parts, words = features(texts, len(gains))
            for part in parts:
                bucket, of, late, late_of = bucketed(part, len(gains))
                # sums of whole numbers far below 2^53: exact
                weight += np.bincount(of, gains[bucket], len(texts)).astype(np.int64)
                weight -= np.bincount(late_of, gains[late], len(texts)).astype(np.int64)
            n = sum(np.maximum(words - k, 0) for k in range(3))
            score = weight + np.array([noise(seed, d) for d in ids], np.int64)
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(words), "n_features": pa.array(n),
                                   "weight": pa.array(weight), "score": pa.array(score, pa.int64())})
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long, score long")


def drawn(rows: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``scored`` with ``rank``: 1 for the highest score, null
    where a row is not among the ``share`` per cent drawn."""
    rows = written(rows, "scored")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_salt")]
    able = (rows.where(F.col("n_words") >= min_words).withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
            .repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
            .withColumn("_at", F.monotonically_increasing_id()).drop("_salt"))
    able = written(able, "ranges")
    part = F.shiftright("_at", 33)                                          # fixed by Spark: the partition's number
    sizes = able.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row a range
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = able.withColumn("_part", part).join(F.broadcast(sizes), "_part").withColumn(
        "rank", F.when(place <= F.expr(f"{int(share)} * _all div 100"), place))
    rest = rows.where(~F.coalesce(F.col("n_words") >= min_words, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(rest.columns).union(rest)


def resampled(docs: DataFrame, target: DataFrame, id_col="doc_id", text_col="text", target_col="text", share: int = SHARE,
              min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``."""
    source = _collected(bucket_counts(docs, text_col, buckets), buckets)
    aim = _collected(bucket_counts(target, target_col, buckets), buckets)
    rows = drawn(scored(docs, gains_of(source, aim), id_col, text_col, seed), share, min_words)
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op12_importance_resampling(spark, sf_dir) -> DataFrame:
    """Operator 12 over all documents and benchmark texts (contract columns)."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

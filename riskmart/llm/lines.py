"""Operator 7, line dedup: a sharded minimal perfect hash over line hashes.

One pass emits, per task, the distinct line keys with the number of documents
that hold them; partial counts are combined in the task before they are
shuffled, so a line that a third of all documents hold costs one entry a
flush.  Each shard sums them and builds, over the distinct hashes of the
lines that repeat often enough, a minimal perfect hash (levels of bit arrays,
as in Limasset et al., "Fast and scalable minimal perfect hash functions",
2017) that indexes three arrays: fingerprint, count and the largest doc_id.
A line that is not in the set meets a foreign fingerprint and stays.

Documents then probe the arrays; no line is joined.  While all arrays
together are below ``broadcast_bytes`` (checked from their summed size) every
task holds them and the documents are not shuffled; beyond that, probes go to
the partition that holds their shard and only the hits come back.

Identity of a line: 64 bits of one hash and 32 bits of another.

Defined cases: a null or empty text is one empty line; every row counts as
one document (rows that repeat a doc_id count one by one); a null doc_id is
smaller than any other; a table without rows gives none; other columns are
not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm import text as T
from riskmart.llm.spark import bounded_batches, partitions, table, written

MIN_POINTS = 20
MIN_DOCS = 3
BROADCAST_BYTES = 64 << 20
FLUSH = 1 << 20
NO_ID = -(1 << 63)
U64 = np.uint64

PART = "shard int, h binary, fp binary, n binary, top binary"
INDEX = "shard int, size long, levels binary, fp binary, n binary, top binary"


# -- lines of a batch ------------------------------------------------------

def split_lines(texts: list, min_points: int):
    """Spans of all lines and, for those long enough to have a key, the
    line's number and its two hashes.

    Returns (buf, text index of each line, line starts, line ends, numbers of
    the keyed lines, hash, fingerprint).
    """
    buf, starts, ends = T.join(texts)
    stop = np.flatnonzero(buf == 10)                 # every text ends with one
    start = np.concatenate(([0], stop[:-1] + 1))
    doc = np.searchsorted(ends, stop)
    low = T.LOWER[buf]
    solid = np.flatnonzero(~T.SPACE[low])
    at, to = np.searchsorted(solid, start), np.searchsorted(solid, stop)
    some = np.flatnonzero(to > at)
    s, e = solid[at[some]], solid[to[some] - 1] + 1
    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80, dtype=np.int64)))
    keep = points[e] - points[s] >= min_points
    some, s, e = some[keep], s[keep], e[keep]
    h = T.span_hash(low, s, e)
    fp = (T.span_hash(low, s, e, 1) >> U64(32)).astype(np.uint32)
    return buf, doc, start, stop, some, h, fp


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> U64(33)) % U64(shards)).astype(np.int32)


def combine(h, fp, n, top):
    """Sum the counts and keep the largest id of equal (hash, fingerprint)."""
    order = np.lexsort((fp, h))
    h, fp, n, top = h[order], fp[order], n[order], top[order]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])))) if len(h) else []
    if not len(h):
        return h, fp, n, top
    return h[first], fp[first], np.add.reduceat(n, first), np.maximum.reduceat(top, first)


def ids_of(column) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def counter(shards: int, min_points: int):
    def flush(held):
        h, fp, n, top = combine(*(np.concatenate(x) for x in zip(*held)))
        s = shard_of(h, shards)
        order = np.argsort(s, kind="stable")
        lo, hi = T.group_bounds(s[order], shards)
        rows = [i for i in range(shards) if hi[i] > lo[i]]
        return pa.record_batch({
            "shard": pa.array(rows, pa.int32()),
            **{k: pa.array([x[order[lo[i]:hi[i]]].tobytes() for i in rows], pa.binary())
               for k, x in (("h", h), ("fp", fp), ("n", n), ("top", top))}})

    def count(batches):
        held, size = [], 0
        for b in batches:
            ids, texts = ids_of(b.column(0)), T.as_bytes(b.column(1))
            for i, j in T.pieces(texts):
                _, doc, _, _, keyed, h, fp = split_lines(texts[i:j], min_points)
                order = np.lexsort((fp, h, d := doc[keyed]))   # one entry a document
                d, h, fp = d[order], h[order], fp[order]
                new = np.concatenate(([True], (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])))[:len(d)]
                d, h, fp = d[new], h[new], fp[new]
                held.append(combine(h, fp, np.ones(len(h), np.int64), ids[i:j][d]))
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)
    return count


# -- minimal perfect hash --------------------------------------------------

def _slot(h, level, m):
    return T.mix(h ^ T.mix(np.array([level + 1], U64))) % U64(m)


class Level:
    """A packed bit array and, for each of its words, the bits set before it."""

    def __init__(self, words: np.ndarray, size: int):
        self.words, self.size = words, size
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.uint32)
        self.ones = int(ones.sum())

    @classmethod
    def of(cls, bits: np.ndarray) -> Level:
        packed = np.packbits(bits, bitorder="little").tobytes()
        return cls(np.frombuffer(packed + bytes(-len(packed) % 8), "<u8"), len(bits))

    def probe(self, at: np.ndarray):
        """Whether each bit is set, and how many set bits stand before it."""
        word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
        below = np.bitwise_count(word & ((U64(1) << bit) - U64(1)))
        return (word >> bit & U64(1)).astype(bool), self.before[at >> 6].astype(np.int64) + below


def build_mph(h: np.ndarray) -> list:
    """Bit arrays by level: a key sits at the first level at which no other
    remaining key shares its slot.  Distinct keys only."""
    levels = []
    while len(h):
        m = 2 * len(h) + 8
        at = _slot(h, len(levels), m)
        taken = np.bincount(at.astype(np.int64), minlength=m)
        levels.append(Level.of(taken == 1))
        h = h[taken[at] != 1]
    return levels


def rank_of(levels: list, h: np.ndarray) -> np.ndarray:
    """Position of each key in the arrays; -1 for keys surely not in the set."""
    out, left, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
    for k, level in enumerate(levels):
        if not len(left):
            break
        hit, rank = level.probe(_slot(h[left], k, level.size).astype(np.int64))
        out[left[hit]] = base + rank[hit]
        base, left = base + level.ones, left[~hit]
    return out


def pack(levels: list) -> bytes:
    sizes = np.array([len(levels), *(x.size for x in levels)], dtype=np.int64)
    return sizes.tobytes() + b"".join(x.words.tobytes() for x in levels)


def unpack(blob: bytes) -> list:
    k = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(blob, np.int64, k, 8), 8 + 8 * k, []
    for m in map(int, sizes):
        n = (m + 63) // 64
        out.append(Level(np.frombuffer(blob, "<u8", n, at), m))
        at += 8 * n
    return out


class Shard:
    """The arrays of one shard."""

    def __init__(self, row):
        self.levels = unpack(row["levels"])
        self.fp = np.frombuffer(row["fp"], np.uint32)
        self.n = np.frombuffer(row["n"], np.int64)
        self.top = np.frombuffer(row["top"], np.int64)

    def drops(self, h, fp, ids) -> np.ndarray:
        """Which probes meet a line whose last holder is another document."""
        at = rank_of(self.levels, h)
        ok = at >= 0
        ok[ok] = self.fp[at[ok]] == fp[ok]
        ok[ok] = self.top[at[ok]] != ids[ok]
        return ok


def indexer(shards: int, min_docs: int):
    def build(batches):
        held = {k: [] for k in ("h", "fp", "n", "top")}
        kinds = {"h": np.uint64, "fp": np.uint32, "n": np.int64, "top": np.int64}
        for b in batches:
            for k in held:
                held[k] += [np.frombuffer(x, kinds[k]) for x in b.column(k).to_pylist()]
        if not held["h"]:
            return
        h, fp, n, top = combine(*(np.concatenate(held[k]) for k in held))
        often = n >= min_docs
        h, fp, n, top = h[often], fp[often], n[often], top[often]
        # lines of equal hash and different fingerprint: the first of them go into
        # one perfect hash, the second into another of the same shard, and so on
        at = np.arange(len(h))
        layer = at - np.maximum.accumulate(np.where(np.concatenate(([True], h[1:] != h[:-1]))[:len(h)], at, 0))
        s = shard_of(h, shards)
        for k, y in np.unique(np.stack([s, layer], axis=1), axis=0).tolist():
            own = (s == k) & (layer == y)
            levels = build_mph(h[own])
            put = np.argsort(rank_of(levels, h[own]))
            yield pa.record_batch({
                "shard": pa.array([k], pa.int32()), "size": pa.array([int(own.sum())], pa.int64()),
                "levels": pa.array([pack(levels)], pa.binary()),
                **{c: pa.array([x[own][put].tobytes()], pa.binary()) for c, x in (("fp", fp), ("n", n), ("top", top))}})
    return build


def line_index(docs: DataFrame, id_col="doc_id", text_col="text", min_points=MIN_POINTS,
               min_docs=MIN_DOCS, shards: int | None = None) -> DataFrame:
    """One row a shard: minimal perfect hash, fingerprints, counts, holders."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shards = shards or partitions(spark)
    parts = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(counter(shards, min_points), PART)
    return parts.repartition(shards, "shard").mapInArrow(indexer(shards, min_docs), INDEX)


# -- probing ---------------------------------------------------------------

OUT = "n_lines long, n_dropped long, kept string"


def rewrite(texts: list, lines, drop: np.ndarray):
    """Counts and kept text of each document; ``drop`` marks all lines."""
    buf, doc, start, stop, _, _, _ = lines
    raw = buf.tobytes()
    n = np.bincount(doc, minlength=len(texts))
    gone = np.bincount(doc[drop], minlength=len(texts))
    lo, hi = T.group_bounds(doc, len(texts))
    kept = []
    for i, t in enumerate(texts):
        if not gone[i]:
            kept.append(t)
        else:
            stay = lo[i] + np.flatnonzero(~drop[lo[i]:hi[i]])
            kept.append(b"\n".join(raw[start[k]:stop[k]] for k in stay))
    return n, gone, kept


def _output(b, n, gone, kept):
    carried = [b.column(i) for i, c in enumerate(b.schema.names) if c == "_row"]
    return pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                            pa.array([x.decode("utf-8", "replace") for x in kept], pa.string()), *carried],
                           names=[b.schema.names[0], "n_lines", "n_dropped", "kept", *["_row"] * len(carried)])


def local_prober(index, shards: int, min_points: int):
    def probe(batches):
        arrays: dict = {}
        for r in index.value:
            arrays.setdefault(r["shard"], []).append(Shard(r))
        for b in batches:
            ids, texts = ids_of(b.column(0)), T.as_bytes(b.column(1))
            ns, gones, kepts = [], [], []
            for i, j in T.pieces(texts):
                lines = split_lines(texts[i:j], min_points)
                doc, keyed, h, fp = lines[1], lines[4], lines[5], lines[6]
                drop = np.zeros(len(doc), bool)
                s = shard_of(h, shards)
                order = np.argsort(s, kind="stable")
                lo, hi = T.group_bounds(s[order], shards)
                for k, layers in arrays.items():
                    own = order[lo[k]:hi[k]]
                    for shard in layers if len(own) else ():
                        drop[keyed[own[shard.drops(h[own], fp[own], ids[i:j][doc[keyed[own]]])]]] = True
                n, gone, kept = rewrite(texts[i:j], lines, drop)
                ns.append(n), gones.append(gone), kepts.extend(kept)
            yield _output(b, np.concatenate(ns or [[]]), np.concatenate(gones or [[]]), kepts)
    return probe


PROBE = "shard int, h binary, fp binary, id binary, row binary, levels binary, n binary, top binary, kind int"


def prober_rows(shards: int, min_points: int):
    """The keyed lines of a batch as one probe row a shard."""
    def emit(batches):
        for b in batches:
            ids, texts, keys = ids_of(b.column(0)), T.as_bytes(b.column(1)), b.column(2).to_numpy()
            for i, j in T.pieces(texts):
                _, doc, _, _, keyed, h, fp = split_lines(texts[i:j], min_points)
                s = shard_of(h, shards)
                order = np.argsort(s, kind="stable")
                lo, hi = T.group_bounds(s[order], shards)
                rows = [k for k in range(shards) if hi[k] > lo[k]]
                own = [order[lo[k]:hi[k]] for k in rows]
                nul = pa.nulls(len(rows), pa.binary())
                yield pa.record_batch({
                    "shard": pa.array(rows, pa.int32()),
                    "h": pa.array([h[o].tobytes() for o in own], pa.binary()),
                    "fp": pa.array([fp[o].tobytes() for o in own], pa.binary()),
                    "id": pa.array([ids[i:j][doc[keyed[o]]].tobytes() for o in own], pa.binary()),
                    "row": pa.array([keys[i:j][doc[keyed[o]]].tobytes() for o in own], pa.binary()),
                    "levels": nul, "n": nul, "top": nul, "kind": pa.array([1] * len(rows), pa.int32())})
    return emit


def answer(batches):
    """Rows sorted by shard, the arrays before the probes: by row key, the
    hashes and fingerprints of the lines to drop."""
    layers, at = [], None
    for b in batches:
        for r in b.to_pylist():
            if r["shard"] != at:
                layers, at = [], r["shard"]
            if r["kind"] == 0:
                layers.append(Shard(r))
                continue
            h, fp = np.frombuffer(r["h"], np.uint64), np.frombuffer(r["fp"], np.uint32)
            ids, keys = np.frombuffer(r["id"], np.int64), np.frombuffer(r["row"], np.int64)
            hit = np.zeros(len(h), bool)
            for shard in layers:
                hit |= shard.drops(h, fp, ids)
            if hit.any():
                order = np.argsort(keys[hit], kind="stable")
                d, x = keys[hit][order], h[hit][order] ^ T.mix(fp[hit][order].astype(np.uint64))
                cut = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
                yield pa.record_batch({"_key": pa.array(d[cut], pa.int64()),
                                       "_hits": pa.array([p.tobytes() for p in np.split(x, cut[1:])], pa.binary())})


def applier(min_points: int):
    """Rows of (id, text, lists of hits)."""
    def run(batches):
        for b in batches:
            texts, hits = T.as_bytes(b.column(1)), b.column(2).to_pylist()
            ns, gones, kepts = [], [], []
            for i, j in T.pieces(texts):
                lines = split_lines(texts[i:j], min_points)
                doc, keyed, h = lines[1], lines[4], lines[5] ^ T.mix(lines[6].astype(np.uint64))
                drop = np.zeros(len(doc), bool)
                d = doc[keyed]
                lo, hi = T.group_bounds(d, j - i)
                for k, own in enumerate(hits[i:j]):
                    if own:
                        gone = np.concatenate([np.frombuffer(x, np.uint64) for x in own])
                        drop[keyed[lo[k]:hi[k]][np.isin(h[lo[k]:hi[k]], gone)]] = True
                n, gone, kept = rewrite(texts[i:j], lines, drop)
                ns.append(n), gones.append(gone), kepts.extend(kept)
            yield _output(b, np.concatenate(ns or [[]]), np.concatenate(gones or [[]]), kepts)
    return run


def dedup_lines(docs: DataFrame, id_col="doc_id", text_col="text", min_points=MIN_POINTS, min_docs=MIN_DOCS,
                broadcast_bytes=BROADCAST_BYTES, shards: int | None = None) -> DataFrame:
    """(id, n_lines, n_dropped, kept): each document without the lines that
    at least ``min_docs`` documents hold, except in the last holder."""
    shards = shards or partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _probed(rows, rows, "", min_points, min_docs, broadcast_bytes, shards)


def drop_lines(docs: DataFrame, id_col="doc_id", text_col="text", length_col="n_chars", min_points=MIN_POINTS,
               min_docs=MIN_DOCS, broadcast_bytes=BROADCAST_BYTES, shards: int | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, with the kept text and its length."""
    shards = shards or partitions(docs.sparkSession)
    key, other = F.col(id_col).cast("long").alias("doc_id"), [c for c in docs.columns if c != text_col]
    row = F.struct(*other)
    rows = docs.select(key, F.col(text_col).alias("text"))
    out = _probed(rows, docs.select(key, F.col(text_col).alias("text"), row.alias("_row")),
                  f", _row {docs.select(row.alias('r')).schema['r'].dataType.simpleString()}",
                  min_points, min_docs, broadcast_bytes, shards)
    new = {text_col: F.col("kept"), length_col: F.length("kept").cast("long")}
    return out.select(*[(new[c] if c in new else F.col("_row")[c]).alias(c) for c in docs.columns])


def _probed(rows: DataFrame, wide: DataFrame, more: str, min_points, min_docs, broadcast_bytes, shards) -> DataFrame:
    """Index of ``rows`` (doc_id, text), probed by ``wide``, which may carry
    a struct _row."""
    spark = rows.sparkSession
    index = written(line_index(rows, "doc_id", "text", min_points, min_docs, shards), "lines")
    size = index.agg(F.sum(F.length("levels") + F.length("fp") + F.length("n") + F.length("top"))).first()[0] or 0
    if size <= broadcast_bytes:
        held = spark.sparkContext.broadcast([r.asDict() for r in index.collect()])
        return wide.mapInArrow(local_prober(held, shards, min_points), "doc_id long, " + OUT + more)
    # a row's key, not its id: rows of a null or repeated id are no group, and
    # rows alike in id and text are one
    key = F.xxhash64("doc_id", "text").alias("_key")
    probes = rows.select("doc_id", "text", key).mapInArrow(prober_rows(shards, min_points), PROBE)
    nothing = F.lit(None).cast("binary")
    arrays = index.select("shard", nothing.alias("h"), "fp", nothing.alias("id"), nothing.alias("row"), "levels", "n", "top",
                          F.lit(0).alias("kind"))
    hits = (probes.unionByName(arrays).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
            .mapInArrow(answer, "_key long, _hits binary").groupBy("_key").agg(F.collect_set("_hits").alias("_hits")))
    found = wide.select("*", key).join(hits, "_key", "left")
    return (found.select("doc_id", "text", "_hits", *["_row"] * bool(more))
            .mapInArrow(applier(min_points), "doc_id long, " + OUT + more))


def op7_line_dedup(spark, sf_dir) -> DataFrame:
    """Operator 7 over all documents (contract columns)."""
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL7 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND c.keeper <> k.doc_id AS gone
  FROM k LEFT JOIN c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

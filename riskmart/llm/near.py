"""Operator 2, n-gram Jaccard join: size-banded tiles with bitmap signatures.

A document is the set of its distinct word 5-grams; two sets link when
100 * intersection >= 75 * union.  Sets that are equal are one node (its id
is a 64-bit fingerprint of the set), so copies never meet as pairs.

1. ``profile``: set size, fingerprint and hashed bitmap of each document, and
   a fixed-size table of counts over hash cells of all n-grams.
2. ``tiles``: linked sets of size n share one of their first
   n - ceil(0.75 n) + 1 n-grams in any order common to all sets.  The order
   puts rare cells first, which keeps widespread passages out of the tiles.
   A tile holds the nodes that share such an n-gram, by size.  Tiles of very
   frequent cells are salted over several tasks.
3. ``star``: in each band of sizes (largest at most 1 / 0.75 of the smallest)
   of a tile, the smallest member is paired with the others; in a tile of at
   most FEW members all are.  Hashed bitmaps
   bound the overlap from above (each differing bit is an element that only
   one of the sets has); pairs that may pass are verified on sorted arrays.
4. ``rest``: in larger tiles whose members are not yet in one component, every
   member outside the tile's largest component meets all members, in blocks.
   Here the bitmaps hold only n-grams that two such nodes share; the others
   count in full, so the bound is close.  Round one, over the tiles of one in
   FIRST n-grams, verifies the most alike member of another component and so
   joins most of what belongs together; round two, over all tiles, the most
   alike of each other component; round three, for members that may have more,
   all that these may still meet, so no link between components is lost.

Hashes have 64 bits; equal hashes count as equal n-grams.

Defined cases: null, empty or wordless text: n_shingles 0, its own component;
fewer words than ``k``: the whole sequence is one shingle; rows that repeat a
doc_id stay rows; a null doc_id stays null, and a component whose rows all
have null ids has a null component_id; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm import text as T
from riskmart.llm.graph import components, few
from riskmart.llm.spark import bounded_batches, partitions, table, written

K = 5
PERCENT = 75
CELL_BITS = 22       # the count table: 16 MB a task and on the driver
SLICES = 64
TILE = 4096          # members of a hot tile that one task takes
FEW = 8              # members of a tile up to which all its pairs are tried at once
FIRST = 16           # one in so many tiles serves the first residual round
BLOCK = 2048         # members that a probe meets at a time
WANTED = 1 << 20     # wanted ids (16 bytes each) up to which they go to every task
FLUSH = 1 << 20      # postings held before they are dealt out
U64 = np.uint64
_STEP = T.mix(np.arange(1, 65, dtype=np.uint64)) | U64(1)

# -- sets ------------------------------------------------------------------


def shingle_sets(texts: list, k: int = K):
    """Distinct shingle hashes of all texts, ascending within a text:
    (hashes, start of each text's run, its end)."""
    n = len(texts)
    wh, doc = T.text_words(texts)
    lo, hi = T.group_bounds(doc, n)
    count = hi - lo
    h = np.zeros(0, np.uint64)
    owner = np.zeros(0, np.int64)
    if len(wh) >= k:
        m = len(wh) - k + 1
        h = np.zeros(m, np.uint64)
        for i in range(k):
            h += wh[i:i + m] * _STEP[i]
        inside = doc[:m] == doc[k - 1:]
        h, owner = T.mix(h[inside] + U64(k)), doc[:m][inside]
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        short = np.array([int(sum(int(wh[lo[d] + i]) * int(_STEP[i]) for i in range(count[d])) + int(count[d]))
                          & (2**64 - 1) for d in few], dtype=np.uint64)
        h, owner = np.concatenate((h, T.mix(short))), np.concatenate((owner, few))
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    lo, hi = T.group_bounds(owner, n)
    for a, b in zip(lo.tolist(), hi.tolist()):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return (h, *T.group_bounds(owner, n))


def fingerprints(h, lo, hi) -> np.ndarray:
    """One 64-bit id for each set (as signed integers); 0 for empty sets."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(T.mix(h ^ U64(0xA5A5A5A5A5A5A5A5)))))
    fp = T.mix(sums[hi] - sums[lo] + (hi - lo).astype(np.uint64))
    fp[hi == lo] = 0
    return fp.view(np.int64)


def bits_of(n: np.ndarray) -> np.ndarray:
    """The next power of two of each n, 64 to 65,536."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), 64, 65536)


def bitmap(h: np.ndarray, n: int) -> bytes:
    """Bits that the elements' hashes name, ``bits_of(n)`` of them."""
    bits = int(bits_of(np.array([n]))[0])
    out = np.zeros(bits, np.uint8)
    out[(h >> U64(20)).astype(np.int64) & (bits - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def fold(words: np.ndarray, n: int) -> np.ndarray:
    """A bitmap's words brought down to ``n`` words: hashes modulo fewer bits."""
    return np.bitwise_or.reduce(words.reshape(-1, n), axis=0)


def cell_of(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - CELL_BITS)).astype(np.int64)


def profiler(k: int):
    def run(batches):
        cells = np.zeros(1 << CELL_BITS, np.uint32)
        for b in batches:
            ids, texts = b.column(0).cast(pa.int64()), T.as_bytes(b.column(1))
            for i, j in T.pieces(texts):
                h, lo, hi = shingle_sets(texts[i:j], k)
                np.add.at(cells, cell_of(h), np.uint32(1))
                fps = fingerprints(h, lo, hi)
                yield pa.record_batch({
                    "doc_id": ids.slice(i, j - i), "key": b.column(2).slice(i, j - i), "n": pa.array(hi - lo, pa.int64()),
                    "fp": pa.array(fps, pa.int64()),
                    "bm": pa.array([bitmap(h[a:z], z - a) if z > a else None for a, z in zip(lo, hi)], pa.binary()),
                    "cells": pa.nulls(j - i, pa.binary()), "slice": pa.nulls(j - i, pa.int32())})
        parts = np.split(cells, SLICES)
        some = [i for i in range(SLICES) if parts[i].any()]
        nul = pa.nulls(len(some), pa.int64())
        yield pa.record_batch({"doc_id": nul, "key": nul, "n": nul, "fp": nul, "bm": pa.nulls(len(some), pa.binary()),
                               "cells": pa.array([zlib.compress(parts[i], 1) for i in some], pa.binary()),
                               "slice": pa.array(some, pa.int32())})
    return run


def add_slices(batches):
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            own = np.frombuffer(zlib.decompress(x), np.uint32).astype(np.uint64)
            sums[s] = sums[s] + own if s in sums else own
    yield pa.record_batch({"slice": pa.array(list(sums), pa.int32()),
                           "cells": pa.array([np.minimum(x, U64(2**32 - 1)).astype(np.uint32).tobytes() for x in sums.values()], pa.binary())})


# -- tiles -----------------------------------------------------------------

def prefix_size(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def salts_of(count: np.ndarray, mean: float) -> np.ndarray:
    """Over how many tasks a cell's tiles are dealt: one, but for cells far
    above what chance puts into them."""
    over = np.maximum(count.astype(np.float64) - 2 * mean, 0)
    return (over // TILE).astype(np.int64) + 1


def packed(to: np.ndarray, buckets: int, key, fp, n):
    """Postings as one row a bucket: keys by node, nodes, sizes, run lengths."""
    order = np.lexsort((fp, to))
    to, key, fp, n = to[order], key[order], fp[order], n[order]
    lo, hi = T.group_bounds(to, buckets)
    rows, out = [i for i in range(buckets) if hi[i] > lo[i]], []
    for i in rows:
        f = fp[lo[i]:hi[i]]
        at = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
        out.append((key[lo[i]:hi[i]].tobytes(), f[at].tobytes(), n[lo[i]:hi[i]][at].astype(np.uint32).tobytes(),
                    np.diff(np.append(at, len(f))).astype(np.uint32).tobytes()))
    return pa.record_batch({"bucket": pa.array(rows, pa.int32()),
                            **{c: pa.array([p[x] for p in out], pa.binary()) for x, c in enumerate(("key", "fp", "n", "len"))}})


def unpacked(batches, kind=np.uint64):
    """The postings of all rows of a task, by key: (key, node, size)."""
    key, fp, n = [np.zeros(0, kind)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for b in batches:
        for k, f, s, c in zip(*(x.to_pylist() for x in b.columns[1:])):
            c = np.frombuffer(c, np.uint32)
            key.append(np.frombuffer(k, kind))
            fp.append(np.repeat(np.frombuffer(f, np.int64), c))
            n.append(np.repeat(np.frombuffer(s, np.uint32), c))
    key, fp, n = np.concatenate(key), np.concatenate(fp), np.concatenate(n)
    order = np.argsort(key, kind="stable")
    return key[order], fp[order], n[order]


def poster(cells, buckets: int, k: int, percent: int):
    def run(batches):
        count = cells.value
        mean = float(count.mean())
        seen: set = set()
        held, size = [], 0

        def flush():
            key, fp, n = (np.concatenate(x) for x in zip(*held))
            salt = salts_of(count[cell_of(key)], mean)
            salt = T.mix(fp.view(np.uint64)) % salt.astype(np.uint64)
            return packed((T.mix(key + salt) % U64(buckets)).astype(np.int64), buckets, key, fp, n)

        for b in batches:
            texts = T.as_bytes(b.column(0))
            for i, j in T.pieces(texts):
                h, lo, hi = shingle_sets(texts[i:j], k)
                fps = fingerprints(h, lo, hi)
                order = (np.minimum(count[cell_of(h)], 2**24 - 1).astype(np.uint64) << U64(40)) | (h >> U64(24))
                keys, own, sizes = [], [], []
                for f, a, z in zip(fps.tolist(), lo.tolist(), hi.tolist()):
                    if z > a and f not in seen:
                        seen.add(f)
                        p = prefix_size(z - a, percent)
                        keys.append(h[a:z][np.argsort(order[a:z], kind="stable")[:p]])
                        own.append(np.full(p, f, np.int64))
                        sizes.append(np.full(p, z - a, np.int64))
                        size += p
                if keys:
                    held.append((np.concatenate(keys), np.concatenate(own), np.concatenate(sizes)))
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()
    return run


def tiler(cells):
    """Postings of a bucket: the nodes of every n-gram that at least two nodes
    share, or that other tasks may hold too (salt of several)."""
    def run(batches):
        count = cells.value
        key, fp, n = unpacked(batches)
        if not len(key):
            return
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        length = np.diff(np.append(at, len(key)))
        hot = salts_of(count[cell_of(key[at])], float(count.mean())) > 1
        out, lists = [], set()
        for a, m, is_hot in zip(at.tolist(), length.tolist(), hot.tolist()):
            if m < 2 and not is_hot:
                continue
            f, first = np.unique(fp[a:a + m], return_index=True)
            if len(f) < 2 and not is_hot:
                continue
            if not is_hot:
                if (same := f.tobytes()) in lists:
                    continue
                lists.add(same)
            s = n[a:a + m][first]
            by = np.lexsort((f, s))
            out.append((int(key[a].view(np.int64)), is_hot, f[by], s[by]))
            if len(out) >= 4096:
                yield _tiles(out)
                out = []
        if out:
            yield _tiles(out)
    return run


def _tiles(out):
    return pa.record_batch({"tile": pa.array([x[0] for x in out], pa.int64()),
                            "hot": pa.array([x[1] for x in out], pa.bool_()),
                            "fps": pa.array([x[2] for x in out], pa.list_(pa.int64())),
                            "ns": pa.array([x[3].astype(np.int64) for x in out], pa.list_(pa.int64()))})


def starrer(percent: int):
    """Pairs (smallest of the band, member) of each tile, all pairs of small
    ones; a hot tile also tells its bands' smallest, to be paired with those
    of its other parts."""
    def run(batches):
        for b in batches:
            a, z, lead, tile = [], [], [], []
            for t, hot, f, n in zip(*(b.column(c).to_pylist() for c in ("tile", "hot", "fps", "ns"))):
                f, n, i = np.array(f, np.int64), np.array(n, np.int64), 0
                every = len(f) <= FEW and not hot
                while i < len(f):
                    j = int(np.searchsorted(n * percent, n[i] * 100, side="right"))
                    a.append(np.full(j - i - 1, f[i])), z.append(f[i + 1:j])
                    if hot:
                        lead.append(f[i]), tile.append(t)
                    i = i + 1 if every else j
            a, z = np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*z, np.zeros(0, np.int64)])
            pair = np.unique(np.stack([np.minimum(a, z), np.maximum(a, z)], axis=1), axis=0)
            yield pa.record_batch({"a": pa.array(pair[:, 0], pa.int64()), "b": pa.array(pair[:, 1], pa.int64()),
                                   "tile": pa.nulls(len(pair), pa.int64())})
            if lead:
                yield pa.record_batch({"a": pa.array(lead, pa.int64()), "b": pa.nulls(len(lead), pa.int64()),
                                       "tile": pa.array(tile, pa.int64())})
    return run


# -- bounds and exact checks -----------------------------------------------

def differing(x: bytes, y: bytes) -> int:
    u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    m = min(len(u), len(v))
    return int(np.bitwise_count(fold(u, m) ^ fold(v, m)).sum())


def may_link(n, m, diff, percent: int):
    """From a lower bound of the symmetric difference: intersection at most
    (n + m - diff) / 2, so the pair fails where 100 times that is less than
    ``percent`` times the union."""
    return 100 * (n + m - diff) >= percent * (n + m + diff)


def bounder(percent: int):
    """The pairs that may link, (larger set, smaller set): a star's centre is
    its smallest set, so one copy of it serves all its pairs."""
    def run(batches):
        for b in batches:
            n, m = (b.column(c).to_numpy() for c in ("an", "bn"))
            diff = np.array([differing(x, y) for x, y in zip(b.column("abm").to_pylist(), b.column("bbm").to_pylist())],
                            np.int64)
            ok = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & may_link(n, m, diff, percent)
            x, y = (b.column(c).to_numpy() for c in ("a", "b"))
            turn = (n < m) | ((n == m) & (x < y))
            yield pa.record_batch({"a": pa.array(np.where(turn, y, x)[ok], pa.int64()),
                                   "b": pa.array(np.where(turn, x, y)[ok], pa.int64())})
    return run


def verifier(percent: int):
    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("ax").to_pylist(), b.column("bx").to_pylist()):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(u) < len(v):
                    u, v = v, u
                at = np.searchsorted(u, v)
                both = int((u[np.minimum(at, len(u) - 1)] == v).sum())
                ok.append(100 * both >= percent * (len(u) + len(v) - both))
            yield pa.record_batch([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def setter(k: int):
    """The sorted array of each wanted node, from the text of one document,
    once a task, and the task's number."""
    def run(batches):
        seen: set = set()
        task = TaskContext.get().partitionId()
        for b in batches:
            texts, want = T.as_bytes(b.column(0)), b.column(1).to_numpy()
            for i, j in T.pieces(texts):
                own = [r for r in range(i, j) if want[r] not in seen and not seen.add(want[r])]
                h, lo, hi = shingle_sets([texts[r] for r in own], k)
                yield pa.record_batch({"fp": pa.array(want[own], pa.int64()),
                                       "x": pa.array([h[a:z].tobytes() for a, z in zip(lo, hi)], pa.binary()),
                                       "task": pa.array([task] * len(own), pa.int32())})
    return run


def dealer(buckets: int):
    """The n-grams of nodes as postings, by 32 bits of the hash: two that
    agree in them only make the bound a little weaker, as both are counted."""
    def run(batches):
        for b in batches:
            sets = [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()]
            size = [len(x) for x in sets]
            if size:
                key, fp = np.concatenate(sets), np.repeat(b.column(0).to_numpy(), size)
                to = (T.mix(key) % U64(buckets)).astype(np.int64)
                yield packed(to, buckets, (key >> U64(32)).astype(np.uint32), fp, np.repeat(size, size))
    return run


def sharer(batches):
    """By node, the n-grams of a bucket that another node has too, as bits
    of the node's bitmap."""
    key, fp, n = unpacked(batches, np.uint32)
    if not len(key):
        return
    order = np.lexsort((fp, key))
    key, fp, n = key[order], fp[order], n[order]
    start = np.concatenate(([True], key[1:] != key[:-1]))
    other = np.concatenate(([False], fp[1:] != fp[:-1])) & ~start
    run = np.cumsum(start) - 1
    shared = np.bincount(run, other, minlength=run[-1] + 1)[run] > 0
    key, fp, n = key[shared], fp[shared], n[shared]
    order = np.argsort(fp, kind="stable")
    key, fp, n = key[order], fp[order], n[order]
    bits = (key & (bits_of(2 * n.astype(np.int64)) - 1).astype(np.uint32)).astype(np.uint16)
    at = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1])))[:len(fp)]
    cut = [*at.tolist(), len(fp)]
    for i in range(0, len(at), 4096):
        own = at[i:i + 4096]
        yield pa.record_batch({"fp": pa.array(fp[own], pa.int64()), "n": pa.array(n[own].astype(np.int64)),
                               "own": pa.array([bits[cut[k]:cut[k + 1]].tobytes() for k in range(i, i + len(own))], pa.binary())})


def signer(percent: int):
    """Shared count and bitmap of the shared n-grams; nodes that share too
    little for any link are left out."""
    def run(batches):
        for b in batches:
            fp, n, own = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            own = [np.frombuffer(b"".join(x), np.uint16) for x in own]
            s = np.array([len(x) for x in own], np.int64)
            ok = np.flatnonzero(100 * s >= percent * n)
            maps = []
            for i in ok.tolist():
                out = np.zeros(int(bits_of(2 * n[i:i + 1])[0]), np.uint8)
                out[own[i]] = 1
                maps.append(np.packbits(out, bitorder="little").tobytes())
            yield pa.record_batch({"fp": pa.array(fp[ok], pa.int64()), "n": pa.array(n[ok], pa.int64()), "s": pa.array(s[ok], pa.int64()),
                                   "bm": pa.array(maps, pa.binary())})
    return run


def prober(percent: int, mode: str):
    """Rows by (tile, block), members before probes: candidate pairs of
    different components (probe, member).  ``mode``: "one", the member with
    the least bound of the difference; "each", such a member of each
    component; "all".  And whether the probe may meet more."""
    def block_of(rows):
        f, c, n, s = (np.array([r[i] for r in rows], np.int64) for i in range(4))
        words = np.array([len(r[4]) // 8 for r in rows], np.int64)
        maps = {w: (own := np.flatnonzero(words == w), np.frombuffer(b"".join(rows[i][4] for i in own), np.uint64).reshape(len(own), w))
                for w in np.unique(words).tolist()}
        return f, c, n, s, maps

    def pairs(members, pf, pc, pn, ps, pb):
        f, c, n, s, maps = members
        x = np.frombuffer(pb, np.uint64)
        for w, (own, rows) in maps.items():
            near = (c[own] != pc) & (100 * np.minimum(n[own], pn) >= percent * np.maximum(n[own], pn))
            alone = n[own] - s[own] + pn - ps
            near &= may_link(n[own], pn, alone, percent)
            if not near.any():
                continue
            own, rows, alone = own[near], rows[near], alone[near]
            m = min(w, len(x))
            diff = alone + np.bitwise_count(np.bitwise_or.reduce(rows.reshape(len(own), -1, m), axis=1) ^ fold(x, m)).sum(axis=1)
            ok = may_link(n[own], pn, diff, percent)
            yield own[ok], diff[ok]

    def run(batches):
        at, rows, members, out = None, [], None, {}
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("tile", "block", "kind", "fp", "comp", "n", "s", "bm"))):
                if r[:2] != at:
                    at, rows, members = r[:2], [], None
                if r[2] == 0:
                    rows.append(r[3:])
                    continue
                members = members or block_of(rows)
                found = list(pairs(members, *r[3:]))
                if not found:
                    continue
                own, diff = (np.concatenate(v) for v in zip(*found))
                group = members[1][own] if mode == "each" else np.zeros(len(own), np.int64)
                own = own[np.lexsort((members[0][own], diff, group))]
                many = np.zeros(len(own), bool)
                if mode != "all" and len(own):
                    _, first, size = np.unique(np.sort(group), return_index=True, return_counts=True)
                    own, many = own[first], size > 1
                for y, more in zip(members[0][own].tolist(), many.tolist()):
                    out[r[3], y] = out.get((r[3], y), False) or more
            if len(out) >= 1 << 16:
                yield _pairs(out)
                out = {}
        yield _pairs(out)
    return run


def _pairs(out):
    return pa.record_batch({"x": pa.array([k[0] for k in out], pa.int64()), "y": pa.array([k[1] for k in out], pa.int64()),
                            "more": pa.array(list(out.values()), pa.bool_())})


# -- the join --------------------------------------------------------------

PROFILE = "doc_id long, key long, n long, fp long, bm binary, cells binary, slice int"
POSTINGS = "bucket int, key binary, fp binary, n binary, len binary"


class Join:
    """The steps of one join; each result that is read more than once is a
    written table."""

    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.spark = docs.sparkSession
        self.k, self.percent, self.buckets = k, percent, partitions(self.spark)
        # a row's key stands for its text: rows of a null or repeated id are no group
        self.docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
        both = written(self.docs.select("doc_id", "text", "key").mapInArrow(profiler(k), PROFILE), "profile")
        self.rows = both.where("slice IS NULL").select("doc_id", "key", "n", "fp")
        self.nodes = written(both.where("slice IS NULL AND n > 0").groupBy("fp").agg(
            F.first("n").alias("n"), F.first("bm").alias("bm"), F.min("key").alias("rep")), "nodes")
        parts = (both.where("slice IS NOT NULL").select("slice", "cells").repartition(SLICES, "slice")
                 .mapInArrow(add_slices, "slice int, cells binary").collect())     # 2^CELL_BITS counts in all
        cells = np.zeros(1 << CELL_BITS, np.uint32)
        for r in parts:
            width = len(cells) // SLICES
            cells[r.slice * width:(r.slice + 1) * width] = np.frombuffer(r.cells, np.uint32)
        self.cells = self.spark.sparkContext.broadcast(cells)
        posts = docs.select("text").mapInArrow(poster(self.cells, self.buckets, k, percent), POSTINGS)
        self.tiles = written(posts.repartition(self.buckets, "bucket").mapInArrow(
            tiler(self.cells), "tile long, hot boolean, fps array<long>, ns array<long>"), "tiles")
        self.large = self.tiles.where((F.size("fps") > FEW) | F.col("hot"))
        self.sets = self.signed = None

    def _sets(self, may: DataFrame) -> DataFrame:
        """(fp, x) of the nodes to compare exactly, each from one document:
        those of the pairs at hand and of the larger tiles."""
        want = (may.select(F.col("a").alias("fp")).union(may.select(F.col("b").alias("fp")))
                .union(self.large.select(F.explode("fps").alias("fp"))).distinct())
        want = written(want.join(self.nodes.select("fp", "rep"), "fp"), "want")
        if want.count() <= WANTED:
            want = F.broadcast(want)
        texts = self.docs.select(F.col("key").alias("rep"), "text")
        sets = written(texts.join(want, "rep").select("text", "fp").mapInArrow(setter(self.k), "fp long, x binary, task int"), "sets")
        # rows alike in id and text give a node once a task: that of the first task counts
        twice = written(sets.groupBy("fp").agg(F.min("task").alias("first"), F.count("*").alias("c")).where("c > 1")
                        .select("fp", "first"), "twice")
        n = twice.count()
        if not n:
            return sets.select("fp", "x")
        twice = F.broadcast(few(twice, n)) if n <= WANTED else twice
        return sets.join(twice, "fp", "left").where("first IS NULL OR task = first").select("fp", "x")

    def star(self) -> DataFrame:
        got = written(self.tiles.mapInArrow(starrer(self.percent), "a long, b long, tile long"), "star")
        lead = got.where("tile IS NOT NULL").select("tile", F.col("a").alias("fp"))
        first = lead.groupBy("tile").agg(F.min("fp").alias("m"))
        across = lead.join(first, "tile").where("fp <> m").select(F.col("m").alias("a"), F.col("fp").alias("b"))
        return got.where("tile IS NULL").select("a", "b").union(across).distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link: by the bitmaps' bound, then exactly."""
        node = lambda s: self.nodes.select(F.col("fp").alias(s), F.col("n").alias(s + "n"), F.col("bm").alias(s + "bm"))
        may = written(pairs.join(node("a"), "a").join(node("b"), "b").select("a", "b", "an", "bn", "abm", "bbm")
                      .mapInArrow(bounder(self.percent), "a long, b long"), "may")
        if self.sets is None:
            self.sets = self._sets(may)
        n = may.count()
        if not n:
            return may
        ids = may.select("b").distinct()
        larger = self.sets.select(F.col("fp").alias("a"), F.col("x").alias("ax"))
        smaller = (self.sets.select(F.col("fp").alias("b"), F.col("x").alias("bx"))
                   .join(F.broadcast(few(ids, n)) if n <= WANTED else ids, "b", "left_semi"))
        pairs = F.broadcast(may) if n <= WANTED else may
        return written(pairs.join(larger, "a").join(smaller, "b").select("a", "b", "ax", "bx")
                       .mapInArrow(verifier(self.percent), "a long, b long"), "links")

    def rest(self, roots: DataFrame, mode: str, only: DataFrame | None) -> DataFrame:
        """(x, y, more): candidate pairs between different components that
        share a tile, of the probes in ``only`` (else of all)."""
        large = self.large.where(F.pmod("tile", F.lit(FIRST)) == 0) if mode == "one" else self.large
        member = (large.select("tile", F.explode("fps").alias("fp")).distinct()
                  .join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                  .select("tile", "fp", F.coalesce("root", "fp").alias("comp")))
        size = member.groupBy("tile", "comp").agg(F.count("*").alias("c"))
        mixed = (size.groupBy("tile").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("m"), F.count("*").alias("k"))
                 .where("k > 1").select("tile", F.col("top.comp").alias("main"), F.ceil(F.col("m") / BLOCK).cast("int").alias("s_")))
        member = written(member.join(mixed, "tile"), "mixed")
        if mode == "one":
            signed = self.nodes.select("fp", "n", F.col("n").alias("s"), "bm")       # as if all were shared
        elif self.signed is None:
            posts = (member.select("fp").distinct().join(self.sets.select("fp", "x"), "fp")
                     .mapInArrow(dealer(self.buckets), POSTINGS))
            shared = posts.repartition(self.buckets, "bucket").mapInArrow(sharer, "fp long, n long, own binary")
            self.signed = written(shared.groupBy("fp").agg(F.first("n").alias("n"), F.collect_list("own").alias("own"))
                                  .mapInArrow(signer(self.percent), "fp long, n long, s long, bm binary"), "signed")
        signed = signed if mode == "one" else self.signed
        probe = member.where("comp <> main") if only is None else member.join(only, "fp", "left_semi")
        sent = F.explode(F.sequence(F.lit(0), F.col("s_") - 1)).alias("block")
        probe = probe.join(signed, "fp").select("tile", sent, F.lit(1).alias("kind"), "fp", "comp", "n", "s", "bm")
        here = (member.join(probe.select("tile").distinct(), "tile", "left_semi").join(signed, "fp")
                .select("tile", F.pmod(F.xxhash64("fp"), F.col("s_")).cast("int").alias("block"), F.lit(0).alias("kind"),
                        "fp", "comp", "n", "s", "bm"))
        return (here.union(probe).repartition("tile", "block").sortWithinPartitions("tile", "block", "kind")
                .mapInArrow(prober(self.percent, mode), "x long, y long, more boolean")
                .groupBy("x", "y").agg(F.max("more").alias("more")))


def linked(docs: DataFrame, k: int, percent: int):
    """(rows: doc_id, n, fp of every document; roots: node, root of the nodes
    that link with another)."""
    job = Join(docs, k, percent)
    tried = written(job.star(), "tried")
    links = job.verified(tried)
    roots = written(components(links), "roots")
    only = None
    for mode in ("one", "each", "all"):
        new = written(job.rest(roots, mode, only), "rest")
        n = new.count()
        pairs = few(new.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), n)
        found = job.verified(pairs.join(tried, ["a", "b"], "left_anti"))
        if not found.isEmpty():
            links = links.union(found)
            roots = written(components(links), "roots")
        tried = tried.union(pairs)
        if mode == "one":
            continue                       # the other tiles' members are all still open
        # a probe stays open for the last round if it may meet more than was tried
        only = written(few(new.where("more").select(F.col("x").alias("fp")).distinct(), n), "open")
        if only.isEmpty():
            break
    return job.rows, roots


def _found(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, key, n, fp, root, component_id) of every row of (doc_id, text);
    root: the component's name, null for empty sets."""
    rows, roots = linked(docs, k, percent)
    least = (rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("low"))
             .join(roots.withColumnRenamed("node", "fp"), "fp", "left")
             .withColumn("root", F.coalesce("root", "fp")))
    best = least.groupBy("root").agg(F.min("low").alias("component_id"))
    found = least.join(best, "root").select("fp", "root", "component_id")
    return rows.join(found, "fp", "left")


def jaccard_components(docs: DataFrame, id_col="doc_id", text_col="text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    found = _found(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), k, percent)
    return found.select("doc_id", F.col("n").alias("n_shingles"),
                        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, of which each component keeps one
    text: that of its row with the smallest id (null ids last; ties by a hash
    of id and text).  Rows are told by id and text, so a clean row that shares
    its id with a linked one stays; rows alike in id and text stay or go
    together, but where they are what is kept, one of them stays.  Texts
    without words all stay."""
    bounded_batches(docs.sparkSession)
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))
    found = _found(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), k, percent).where("n > 0")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("s")
    kept = (found.groupBy("root", "doc_id", "key").agg(F.count("*").alias("c")).groupBy("root")
            .agg(best, F.sum("c").alias("all"), F.min_by("c", F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("c"))
            .select(F.col("s.key").alias("_kept"), "all", "c"))
    gone = (found.join(kept.select("_kept"), F.col("key") == F.col("_kept"), "left_anti").select(F.col("key").alias("_gone")).distinct())
    out = docs.withColumn("_key", key).join(gone, F.col("_key") == F.col("_gone"), "left_anti")
    # rows alike in id and text: one of them
    twice = kept.where("c > 1").select("_kept")
    again = out.join(twice, F.col("_key") == F.col("_kept"), "left_semi").dropDuplicates(["_key"])
    return out.join(twice, F.col("_key") == F.col("_kept"), "left_anti").union(again).drop("_key")


def op2_ngram_jaccard_join(spark, sf_dir) -> DataFrame:
    """Operator 2 over all documents (contract columns)."""
    return jaccard_components(table(spark, sf_dir, "documents"))

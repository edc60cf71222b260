"""Operator 11, MinHash near-dedup with an LSH forest.

A document is the set of its distinct word 2-grams; two link when
100 * intersection >= 80 * union.  Equal sets are one node (its id is a 64-bit
fingerprint of the set), so copies never meet as pairs.

1. ``profiler``: set size, fingerprint and MinHash signature (VALUES numbers)
   of each document; ``nodes`` keeps one signature for each distinct set.
2. ``orders``: the signature is read from ORDERS starting places; each gives a
   key of KEY numbers.  All nodes are sorted by each of these orders, as range
   partitions, so that no region of alike keys has to fit in one task.
3. ``neighbours``: sets that share a long prefix of a key stand side by side.
   A region is a run of rows with a common prefix; its depth is FIRST where
   that leaves at most FEW rows, else the least depth that does: sparse
   regions are read broadly, dense ones at long prefixes.  All pairs of a
   region are candidates, and every row with the rows next to it that share
   FIRST numbers; rows that even the whole key does not part meet the WIDE
   rows next to them and the first of their run.  Rows at the ends of a
   partition are sent on, so that runs across partitions are seen whole.
   One bit of each MinHash number travels with the row: pairs that differ in
   more than FAR of them (4.6 standard deviations at the threshold) go.
4. ``linked``: of each row only the closest candidate is told at first, and
   the closest of each node is confirmed on the full sets (sorted 64-bit
   hashes of their shingles), which joins most of what belongs together.
   Nodes with more candidates are sorted once more with their component in
   the row; now all candidates between different components are told with
   these, and confirmed: first the closest of each two components, then the
   others of two that are still apart.  That is asked of the two components,
   not of each candidate.
5. ``crowds``: a run of depth FIRST with more than FEW rows had only part of
   its pairs tried.  Where its nodes are not yet in one component, each node
   outside its largest component meets all of its nodes, in blocks; components
   with candidates among them are a cluster.  In a cluster every node outside
   the largest component meets all nodes, with the full sets, in blocks; only
   links that join two components are told.

So every pair that shares FIRST numbers in one of the orders is tried, or lies
in one component, whatever the size of its group; a pair at the threshold
shares none with 3 in a million.  README has the recall measured against all
pairs.  No link is reported unconfirmed.

Defined cases: null, empty or wordless text: n_shingles 0, its own component,
kept; one word: that word is the shingle; rows that repeat a doc_id stay rows;
a null doc_id stays null, counts for no component's smallest id, and is kept
only where the whole component has no id; a table without rows gives none;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm import text as T
from riskmart.llm.graph import components, few
from riskmart.llm.near import fingerprints, shingle_sets, verifier
from riskmart.llm.spark import bounded_batches, partitions, table, written

K = 2
PERCENT = 80
VALUES = 256             # MinHash numbers of a signature, 16 bits each
ORDERS = 24
KEY = 12                 # numbers of an order's key
FIRST = 4                # least depth of a region
FEW = 16                 # rows of a region whose pairs are all tried
NEAR = 3                 # rows on either side that are always tried
WIDE = 8                 # the same among rows with equal keys
BLOCK = 4096             # nodes of a crowd that meet the others in one block
SHINGLES = 1 << 18       # elements of the full sets of a block
CELLS = 1 << 18          # pairs of a crowd compared at once
FAR = 48                 # differing bits of VALUES up to which a pair is tried
HELD = 1 << 16           # rows looked at at once
SPAN = 256               # partitions whose ends are looked at together
WANTED = 1 << 20         # wanted sets (24 bytes each) up to which they go to every task
U64 = np.uint64

_rng = np.random.Generator(np.random.PCG64(11))
_XOR = _rng.integers(0, 2**32, VALUES, dtype=np.uint32)
_TIMES = _rng.integers(0, 2**32, VALUES, dtype=np.uint32) | np.uint32(1)


# -- signatures --------------------------------------------------------------

def signatures(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """MinHash numbers of the non-empty sets h[lo:hi], one row a set."""
    g = (h >> U64(32)).astype(np.uint32)
    out = np.empty((len(lo), VALUES), np.uint32)
    for j in range(VALUES):
        out[:, j] = np.minimum.reduceat((g ^ _XOR[j]) * _TIMES[j], lo)
    return (T.mix(out.astype(np.uint64)) >> U64(48)).astype(">u2")


def profiler(k: int):
    def run(batches):
        seen: set = set()
        for b in batches:
            ids, keys, texts = b.column(0).cast(pa.int64()), b.column(1), T.as_bytes(b.column(2))
            for i, j in T.pieces(texts):
                h, lo, hi = shingle_sets(texts[i:j], k)
                fp = fingerprints(h, lo, hi)
                some = np.array([r for r in np.flatnonzero(hi > lo).tolist() if fp[r] not in seen and not seen.add(fp[r])], np.int64)
                sig = [None] * (j - i)
                if len(some):
                    # the sets that are signed, side by side
                    size = (hi - lo)[some]
                    stop = np.cumsum(size)
                    own = h[np.repeat(lo[some] - (stop - size), size) + np.arange(stop[-1])]
                    for r, s in zip(some.tolist(), signatures(own, stop - size, stop)):
                        sig[r] = s.tobytes()
                yield pa.record_batch({"doc_id": ids.slice(i, j - i), "key": keys.slice(i, j - i), "n": pa.array(hi - lo, pa.int64()),
                                       "fp": pa.array(fp, pa.int64()), "sig": pa.array(sig, pa.binary())})
    return run


# -- sorted orders -----------------------------------------------------------

ROW = 1 + 2 * KEY + VALUES // 8 + 4 + 8 + 8  # bytes: order, key, bits, size, node, component
SALTS = 16               # tasks that the nodes of one large component are dealt to


def starts() -> list:
    return [t * VALUES // ORDERS for t in range(ORDERS)]


def orders(batches):
    """A node's rows in all orders, each one binary that sorts as it should."""
    for b in batches:
        fp, n, sig, comp = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist(), b.column(3).to_numpy()
        if not len(fp):
            continue
        sig = np.frombuffer(b"".join(sig), np.uint8).reshape(len(fp), 2 * VALUES)
        tail = np.concatenate((np.packbits(sig[:, 1::2] & 1, axis=1), n.astype(">u4").view(np.uint8).reshape(-1, 4),
                               *(x.astype(">i8").view(np.uint8).reshape(-1, 8) for x in (fp, comp))), axis=1)
        twice = np.concatenate((sig, sig[:, :2 * KEY]), axis=1)
        rows = np.empty((len(fp), ORDERS, ROW), np.uint8)
        for t, at in enumerate(starts()):
            rows[:, t, 0] = t
            rows[:, t, 1:1 + 2 * KEY] = twice[:, 2 * at:2 * at + 2 * KEY]
            rows[:, t, 1 + 2 * KEY:] = tail
        yield pa.record_batch([_binary(rows.reshape(-1, ROW))], names=["row"])


def _binary(rows: np.ndarray):
    """Rows of a byte matrix as a binary column."""
    ends = np.arange(0, rows.size + 1, ROW, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, ROW)


def _ids(rows: np.ndarray, at: int) -> np.ndarray:
    """The node (at -16) or the component (at -8) of each row."""
    return np.ascontiguousarray(rows[:, at:at + 8 or None]).view(">i8").ravel().astype(np.int64)


def regions(common: np.ndarray) -> tuple:
    """For sorted rows of which ``common[i]`` numbers agree between row i and
    the row before it: the region of each row (-1: none) and whether it is a
    run that the whole key does not part."""
    m = len(common)
    region, run = np.full(m, -1, np.int64), np.zeros(m, np.int64)
    for depth in range(FIRST, KEY + 1):
        run = np.cumsum(common < depth) - 1
        size = np.bincount(run)[run]
        new = (region < 0) & (size <= FEW)
        region[new] = run[new] * (KEY + 1) + depth
    wide = region < 0
    region[wide] = run[wide] * (KEY + 1)
    return region, wide


def _common(rows: np.ndarray) -> np.ndarray:
    """How many numbers of its key each row shares with the row before it."""
    key = np.ascontiguousarray(rows[:, 1:1 + 2 * KEY]).view(np.uint16)
    common = np.zeros(len(rows), np.int64)
    common[1:] = np.cumprod((key[1:] == key[:-1]) & (rows[1:, :1] == rows[:-1, :1]), axis=1).sum(axis=1)
    return common


def crowded(rows: np.ndarray) -> np.ndarray:
    """The rows in runs of depth FIRST that are no region."""
    run = np.cumsum(_common(rows) < FIRST) - 1
    return np.flatnonzero(np.bincount(run)[run] > FEW)


def candidates(rows: np.ndarray, percent: int):
    """Pairs of sorted rows to confirm, of different components: places x < y
    in the rows, differing bits, and the node of each row."""
    m = len(rows)
    common = _common(rows)
    region, wide = regions(common)
    bits = np.ascontiguousarray(rows[:, 1 + 2 * KEY:1 + 2 * KEY + VALUES // 8]).view(np.uint64)
    n = np.ascontiguousarray(rows[:, -20:-16]).view(">u4").ravel().astype(np.int64)
    fp, comp = _ids(rows, -16), _ids(rows, -8)
    found = []

    def offer(x, y):
        x, y = x[comp[x] != comp[y]], y[comp[x] != comp[y]]
        ok = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
        x, y = x[ok], y[ok]
        far = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1).astype(np.int64)
        ok = far <= FAR
        found.append((x[ok], y[ok], far[ok]))

    least = np.full(m, KEY)
    for step in range(1, min(FEW, m)):
        least = np.minimum(least[:m - step] if step > 1 else least[1:], common[step:])     # of the rows between
        ok = (region[:-step] == region[step:]) & (~wide[:-step] | (step <= WIDE))
        if step <= NEAR:
            ok |= least >= FIRST
        x = np.flatnonzero(ok)
        offer(x, x + step)
    hub = np.flatnonzero(wide)
    if len(hub):
        _, first, back = np.unique(region[hub], return_index=True, return_inverse=True)
        offer(hub[first[back]], hub)
    x, y, far = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    return x, y, far, fp


def closest(x: np.ndarray, y: np.ndarray, far: np.ndarray, fp: np.ndarray):
    """The pairs that are the closest of one of their rows (ties: the smaller
    node), and the rows that have others."""
    row, other, d = np.concatenate((x, y)), np.concatenate((y, x)), np.concatenate((far, far))
    order = np.lexsort((fp[other], d, row))
    row, other, d = row[order], other[order], d[order]
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))[:len(row)])
    return row[first], other[first], d[first], np.unique(row[1:][row[1:] == row[:-1]])


PAIRS = "a long, b long, far long, x long, y long, span int, row binary"


def neighbours(percent: int, every: bool, ends: bool = True):
    """Candidate pairs of sorted rows, looked at in overlapping blocks:
    ``every`` one with its two components x < y, or the closest of each row,
    (as a without b) the nodes that have others, and (as row without span) the
    rows of crowds.  With ``ends`` also the first and last rows of the
    partition, for those of the partitions before and after."""
    edge = 2 * FEW

    def pairs(rows):
        x, y, far, fp = candidates(rows, percent)
        comp, more = _ids(rows, -8), fp[:0]
        if not every:
            x, y, far, more = closest(x, y, far, fp)
            more = np.unique(fp[more])
        a, b = np.minimum(fp[x], fp[y]), np.maximum(fp[x], fp[y])
        order = np.lexsort((far, b, a))
        a, b, far, x, y = a[order], b[order], far[order], x[order], y[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[:len(a)]
        a, b, far, x, y = a[new], b[new], far[new], x[new], y[new]
        crowd = rows[:0] if every else rows[crowded(rows)]
        size = len(a) + len(more) + len(crowd)
        none = pa.nulls(size - len(a), pa.int64())
        of = [f(comp[x], comp[y]) if every else pa.nulls(size, pa.int64()) for f in (np.minimum, np.maximum)]
        return pa.record_batch({"a": pa.array(np.concatenate((a, more, _ids(crowd, -16)))), "b": pa.concat_arrays([pa.array(b), none]),
                                "far": pa.concat_arrays([pa.array(far), none]), "x": of[0], "y": of[1], "span": pa.nulls(size, pa.int32()),
                                "row": pa.concat_arrays([pa.nulls(size - len(crowd), pa.binary()), _binary(crowd)])})

    def sent(rows, spans):
        nul = pa.nulls(len(rows) * len(spans), pa.int64())
        return pa.record_batch({"a": nul, "b": nul, "far": nul, "x": nul, "y": nul, "span": pa.array(np.repeat(spans, len(rows)), pa.int32()),
                                "row": _binary(np.concatenate([rows] * len(spans)))})

    def run(batches):
        held, size, first, last = [], 0, None, np.zeros((0, ROW), np.uint8)
        part = TaskContext.get().partitionId()
        for b in batches:
            rows = _matrix(b.column(0))
            if not len(rows):
                continue
            held.append(rows)
            size += len(rows)
            if size >= HELD:
                rows = np.concatenate(held)
                first = rows[:edge] if first is None else first
                yield pairs(rows)
                held, size = [rows[-edge:]], 0                     # what the next block still meets
                last = rows[-edge:]
        if size:
            rows = np.concatenate(held)
            first = rows[:edge] if first is None else first
            yield pairs(rows)
            last = rows[-edge:]
        if ends and first is not None:
            yield sent(first, [part // SPAN])
            yield sent(last, sorted({part // SPAN, (part + 1) // SPAN}))
    return run


# -- crowds ------------------------------------------------------------------

INFO = VALUES // 8 + 4   # bytes: bits, size


def _blocks(batches):
    """The blocks of rows (group, block, kind, fp, comp, info, ...) that are
    sorted by the first three: members (kind 0), and probes (kind 1) as often
    as they come, each as lists of (fp, comp, bits, n, ...)."""
    here, members = None, []
    for b in batches:
        if not len(b):
            continue
        key = list(zip(*(b.column(c).to_pylist() for c in range(3))))
        info = np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint8).reshape(-1, INFO)
        own = [b.column(3).to_numpy(), b.column(4).to_numpy(), np.ascontiguousarray(info[:, :-4]).view(np.uint64),
               np.ascontiguousarray(info[:, -4:]).view(">u4").ravel().astype(np.int64),
               *(np.array([*c.to_pylist(), None], object)[:-1] for c in b.columns[6:])]
        new = [i for i in range(len(key)) if not i or key[i] != key[i - 1]]
        for i, j in zip(new, [*new[1:], len(key)]):
            if key[i][:2] != here:
                here, members = key[i][:2], []
            part = [c[i:j] for c in own]
            if not key[i][2]:
                members.append(part)
            elif members:
                members = [[np.concatenate(c) for c in zip(*members)]]
                yield here, members[0], part


class Joined:
    """What a task knows of components that belong together."""

    def __init__(self):
        self.up: dict = {}

    def top(self, x: int) -> int:
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether that is new."""
        x, y = self.top(x), self.top(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _alike(n, m, bits, others, percent: int):
    """Whether a set of ``n`` elements and others of ``m`` may link."""
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.bitwise_count(bits ^ others).sum(axis=-1, dtype=np.int64) <= FAR)


def prober(percent: int):
    """(a, b): components with candidates among each other, as many pairs as
    join them within a block of a crowd."""
    def run(batches):
        last, joined = None, None
        for here, (_, mc, mb, mn), (_, pc, pb, pn) in _blocks(batches):
            if here != last:
                last, joined = here, Joined()
            out, step = [], max(1, CELLS // len(mc))
            for i in range(0, len(pc), step):
                c, n = pc[i:i + step], pn[i:i + step]
                p, m = np.nonzero((c[:, None] != mc) & (100 * np.minimum(n[:, None], mn) >= percent * np.maximum(n[:, None], mn)))
                ok = _alike(n[p], mn[m], pb[i:i + step][p], mb[m], percent)
                x, y = c[p[ok]], mc[m[ok]]
                if len(x):
                    pairs = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1), axis=0)
                    out += [q for q in pairs.tolist() if joined.join(*q)]
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])
    return run


class Members:
    """The full sets of a block's members."""

    def __init__(self, fp, comp, bits, n, sets):
        self.fp, self.comp, self.bits, self.n = fp, comp, bits, n
        self.all, self.cell = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
        self.start, self.held = np.cumsum(n) - n, np.zeros(len(self.all), np.int64)

    def overlap(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Elements that the set ``x`` has in common with each of the members ``of``."""
        at = np.minimum(np.searchsorted(self.all, x), len(self.all) - 1)
        at = at[self.all[at] == x]
        self.held[at] = 1
        size = self.n[of]
        stop = np.cumsum(size)
        cells = self.cell[np.repeat(self.start[of] - (stop - size), size) + np.arange(stop[-1])]
        both = np.add.reduceat(self.held[cells], stop - size)
        self.held[at] = 0
        return both


def meeter(percent: int):
    """(a, b): links between the components of a cluster, as many as join them
    within a block: each probe's full set against those of all members that
    are not yet joined with it."""
    def run(batches):
        last, known, joined, group = None, None, None, None
        for here, members, (pf, pc, pb, pn, ps) in _blocks(batches):
            if here != last:
                last, known, joined = here, Members(*members), Joined()
                group = known.comp.copy()
            out = []
            for f, c, b, n, s in zip(pf.tolist(), pc.tolist(), pb, pn.tolist(), ps):
                of = np.flatnonzero(group != joined.top(c))
                of = of[_alike(n, known.n[of], b, known.bits[of], percent)]
                if not len(of):
                    continue
                both = known.overlap(np.frombuffer(s, np.uint64), of)
                for m in of[100 * both >= percent * (n + known.n[of] - both)].tolist():
                    own, other = joined.top(c), joined.top(int(known.comp[m]))
                    if joined.join(own, other):
                        out.append((f, int(known.fp[m])))
                        group[(group == own) | (group == other)] = min(own, other)
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])
    return run


# -- confirmation ------------------------------------------------------------

def setter(k: int):
    """The sorted set of each wanted node, once a task."""
    def run(batches):
        seen: set = set()
        for b in batches:
            texts, want = T.as_bytes(b.column(0)), b.column(1).to_numpy()
            for i, j in T.pieces(texts):
                own = [r for r in range(i, j) if want[r] not in seen and not seen.add(want[r])]
                h, lo, hi = shingle_sets([texts[r] for r in own], k)
                yield pa.record_batch({"fp": pa.array(want[own], pa.int64()),
                                       "x": pa.array([h[a:z].tobytes() for a, z in zip(lo, hi)], pa.binary())})
    return run


class Forest:
    """The steps of one run; results that are read again are written tables."""

    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.spark, self.k, self.percent = docs.sparkSession, k, percent
        self.docs = docs.withColumn("key", F.xxhash64("doc_id", "text")).select("doc_id", "key", "text")
        self.rows = written(self.docs.mapInArrow(profiler(k), "doc_id long, key long, n long, fp long, sig binary"), "signed")
        self.crowd = None        # (run, fp, info) of the crowds, by the first pairs()
        self.nodes = written(self.rows.where("n > 0").groupBy("fp").agg(
            F.first("n").alias("n"), F.first("sig", True).alias("sig"), F.min("key").alias("key")), "nodes")

    def pairs(self, nodes: DataFrame, every: bool) -> DataFrame:
        """(a, b, far, x, y) among ``nodes`` (fp, n, sig, comp), of the
        components x < y; without ``every`` these are null, and nodes with
        further candidates are there as a alone."""
        rows = nodes.select("fp", "n", "sig", "comp").mapInArrow(orders, "row binary")
        rows = rows.repartitionByRange(partitions(self.spark), "row").sortWithinPartitions("row")
        got = written(rows.mapInArrow(neighbours(self.percent, every), PAIRS), "neighbours")
        ends = (got.where("span IS NOT NULL").select("span", "row").distinct()
                .repartition("span").sortWithinPartitions("span", "row").select("row"))
        more = ends.mapInArrow(neighbours(self.percent, every, ends=False), PAIRS)
        if not every:
            more = written(more, "ends")
            start = 1 + 2 * KEY
            self.crowd = got.where("span IS NULL").union(more).where("row IS NOT NULL").select(
                F.substring("row", 1, 1 + 2 * FIRST).alias("run"), F.col("a").alias("fp"), F.substring("row", start + 1, INFO).alias("info"))
        return got.where("span IS NULL").union(more).where("row IS NULL").groupBy("a", "b").agg(
            F.min("far").alias("far"), *(F.first(c).alias(c) for c in "xy"))

    def crowds(self, roots: DataFrame) -> DataFrame:
        """Links between the components that meet in crowds."""
        member = (self.crowd.groupBy("run", "fp").agg(F.first("info").alias("info"))
                  .join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("root", "fp")).drop("root"))
        member = written(member.select(F.col("run").alias("group"), "fp", "comp", "info"), "crowd")
        met = self._met(member, F.lit(1), BLOCK).mapInArrow(prober(self.percent), "a long, b long")
        cluster = components(written(met, "met")).select(F.col("node").alias("comp"), F.col("root").alias("group"))
        member = member.drop("group").dropDuplicates(["fp"]).join(cluster, "comp").select("group", "fp", "comp", "info")
        member = written(member, "cluster")
        if member.isEmpty():
            return member.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
        sets = self.sets(member.select(F.col("fp").alias("a"), F.col("fp").alias("b")))
        met = self._met(member.join(sets, "fp"), F.length("x") / 8, SHINGLES)
        return written(met.mapInArrow(meeter(self.percent), "a long, b long"), "links")

    def _met(self, member: DataFrame, weight, most: int) -> DataFrame:
        """The rows of groups of several components as members of a block, and
        in each block those outside the group's largest component as probes."""
        size = member.groupBy("group", "comp").agg(F.count("*").alias("c"), F.sum(weight).alias("w"))
        mixed = (size.groupBy("group").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("w").alias("w"), F.count("*").alias("k"))
                 .where("k > 1").select("group", F.col("top.comp").alias("main"), F.ceil(F.col("w") / most).cast("int").alias("s_")))
        every = member.join(mixed, "group")
        cols = ["group", "block", "kind", *(c for c in ("fp", "comp", "info", "x") if c in member.columns)]
        probe = every.where("comp <> main").withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("s_") - 1)), "kind": F.lit(1)})
        here = every.withColumns({"block": F.pmod(F.xxhash64("fp"), F.col("s_")).cast("int"), "kind": F.lit(0)})
        return (here.select(cols).union(probe.select(cols)).repartition(partitions(self.spark), "group", "block")
                .sortWithinPartitions("group", "block", "kind"))

    def sets(self, pairs: DataFrame) -> DataFrame:
        """(fp, x): the sets of all nodes of the pairs, each from one document."""
        want = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
        want = written(want.join(self.nodes.select("fp", "key"), "fp"), "want")
        if want.count() <= WANTED:
            want = F.broadcast(want)
        sets = self.docs.select("key", "text").join(want, "key").select("text", "fp").mapInArrow(setter(self.k), "fp long, x binary")
        return written(sets.groupBy("fp").agg(F.first("x").alias("x")), "sets")

    def confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs that link."""
        full = lambda s: sets.select(F.col("fp").alias(s), F.col("x").alias(s + "x"))
        both = pairs.join(full("a"), "a").join(full("b"), "b").select("a", "b", "ax", "bx")
        return written(both.mapInArrow(verifier(self.percent), "a long, b long"), "links")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs of former components (x, y) that ``roots`` has not joined."""
    side = lambda s: roots.select(F.col("node").alias(s), F.col("root").alias("r" + s))
    out = pairs.select("x", "y").join(side("x"), "x", "left").join(side("y"), "y", "left")
    return out.where("coalesce(rx, x) <> coalesce(ry, y)").select("x", "y")


def linked(docs: DataFrame, k: int, percent: int):
    """(rows: doc_id, n, fp of every document; roots: node and root of the
    nodes that link with another)."""
    job = Forest(docs, k, percent)
    best = F.min(F.struct("far", "a", "b")).alias("s")
    got = written(job.pairs(job.nodes.withColumn("comp", F.col("fp")), every=False), "pairs")
    first = got.where("b IS NOT NULL")
    sides = first.select(F.col("a").alias("fp"), "far", "a", "b").union(first.select(F.col("b"), "far", "a", "b"))
    own = written(sides.groupBy("fp").agg(best, F.count("*").alias("c")), "closest")
    tried = written(own.select("s.a", "s.b").distinct(), "tried")
    sets = job.sets(tried)
    links = job.confirmed(tried, sets)
    roots = written(components(links), "roots")
    # a pair not tried yet lies between two nodes that have others besides
    more = written(own.where("c > 1").select("fp").union(got.where("b IS NULL").select(F.col("a").alias("fp"))).distinct(), "more")
    if not more.isEmpty():
        links, roots = _between(job, more, links, roots, tried)
    found = job.crowds(roots)
    if not found.isEmpty():
        roots = written(components(links.union(found)), "roots")
    return job.rows.select("doc_id", "n", "fp"), roots


def _between(job: Forest, more: DataFrame, links: DataFrame, roots: DataFrame, tried: DataFrame):
    """Step 4 for the nodes with further candidates: (links, roots)."""
    best = F.min(F.struct("far", "a", "b")).alias("s")
    nodes = (job.nodes.join(more, "fp", "left_semi").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
             .withColumn("comp", F.coalesce("root", "fp")))
    # written first: Spark would move the join below the aggregate, to a pair's every order
    open_ = written(written(job.pairs(nodes, every=True), "pairs").join(tried, ["a", "b"], "left_anti"), "open")
    sets = job.sets(open_)
    for final in (False, True):
        n = open_.count()
        if not n:
            break
        two = open_ if final else open_.groupBy("x", "y").agg(best, F.count("*").alias("c")).select("x", "y", "s.a", "s.b", "c")
        tried = written(few(two, n), "tried")
        found = job.confirmed(tried, sets)
        if not found.isEmpty():
            links = links.union(found)
            roots = written(components(links), "roots")
        if not final:
            # the others of two components that are still apart
            apart = written(_apart(tried.where("c > 1"), roots), "apart")
            open_ = written(open_.join(apart, ["x", "y"], "left_semi").join(tried, ["a", "b"], "left_anti"), "open")
    return links, roots


def near_copies(docs: DataFrame, id_col="doc_id", text_col="text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    rows, roots = linked(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), k, percent)
    low = rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("low"))
    member = low.join(roots.withColumnRenamed("node", "fp"), "fp").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    best = member.groupBy("root").agg(F.min("low").alias("component_id")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    member = member.join(best, ["root", "salt"]).select("fp", "component_id")
    alone = low.join(roots.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", F.col("low").alias("component_id"))
    out = rows.join(member.union(alone), "fp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11_lsh_forest(spark, sf_dir) -> DataFrame:
    """Operator 11 over all documents (contract columns)."""
    return near_copies(table(spark, sf_dir, "documents"))

"""Leaf-wise boosted trees over binned columns (MDL-1..6, MDL-8).

The training rows become one binned matrix a partition: every column is cut
at its own values by approximate quantiles, so a cell is one byte.  All
models of a comparison are fitted side by side: one Spark job a tree level
adds up, for every model and every node of that level, the gradients, their
second derivatives and the rows by column and bin, and finds the best split
of each node where the sums are.  The driver sees one split a node.

* Trees are grown level by level to the stated depth and then pruned to what
  best-first growth with the stated number of leaves would have split; as a
  node's gain does not depend on the others this is the same tree.
* Where a worker has the parent's histogram, of two siblings only the one with
  fewer rows is counted; the other is the parent's less it.
* Gradients are counted in units of 2^-24, as whole numbers: the sums, and so
  the model, do not depend on the order in which partitions are added.
* Margins and node numbers of a partition live in the Python worker between
  jobs.  They are only a shortcut: a worker that lacks them (lost executor,
  another worker, too many partitions) rebuilds them from the binned rows and
  the trees, which travel with the job or as broadcasts.
* A table of at most TASK_ROWS rows is brought together, a byte a cell, in a
  task for each model.  There the sums are complete, so the task goes on to the
  next level and round by itself; the steps and the model are the same.
* Rows are counted column by column, from columns that lie in one piece.
* Rows are drawn by a hash of the id, the model and the round, columns by a
  generator of the same; both are the same on every cluster.
* Early stopping keeps the mean loss over the evaluation rows by round, ends
  ``patience`` rounds after the best and cuts the model back to it.

An RDD of partitions carries the jobs: each is imperative work on one matrix,
and a boosted model is thousands of short jobs, which planning each as a
query would double.
"""

from __future__ import annotations

import heapq
import math
import uuid
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.schemas import ID_COL, LABEL_COL
from riskmart.session import materialize, ship_package

BINS = 64
UNIT = float(1 << 24)      # of counted gradients
BLOCK = 1 << 16            # rows counted at a time
RECENT = 16                # rounds whose trees travel with a job
TASK_ROWS = 1 << 20        # rows that a task can hold and count faster than a job a level adds up their sums
WHOLE = 256                # rounds that such a task goes through in one job
RUN = 8                    # nodes whose histograms are added up in one place
KEPT = 64                  # partitions whose margins a worker keeps


@dataclass
class Boosting:
    """Settings of one model."""
    rounds: int = 100
    rate: float = 0.1
    depth: int = 6
    leaves: int = 1 << 30
    min_child: int = 1
    l1: float = 0.0
    l2: float = 0.0
    rows: float = 1.0
    columns: float = 1.0
    patience: int | None = None
    weights: tuple = (1.0, 1.0)      # of classes 0 and 1


@dataclass
class Tree:
    """Nodes by number, the root first; a leaf has feature -1."""
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray


@dataclass
class Boosted:
    """A fitted model: margin = base + the values of its trees' leaves."""
    columns: list
    edges: list                      # by column, the upper ends of its bins but the last
    base: float
    trees: list = field(default_factory=list)
    losses: list = field(default_factory=list)     # evaluation loss after each round, if there were such rows

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.edges)
        return self.base + sum((t.value[route(t, bins)] for t in self.trees), np.zeros(len(x)))


# -- trees on binned rows ----------------------------------------------------

def binned(x: np.ndarray, edges: list) -> np.ndarray:
    """Bin of each cell: the number of its column's edges below the value
    (missing values come last)."""
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, x[:, j])
    return out


def route(tree: Tree, bins: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """The node that each row ends in; ``at``: the nodes that the rows are in
    when only the last level is new."""
    inner, own = tree.feature >= 0, np.arange(len(tree.feature))
    depth = np.zeros(len(own), np.int64)
    for v in np.flatnonzero(inner).tolist():               # a child's number is above its parent's
        depth[tree.left[v]] = depth[tree.right[v]] = depth[v] + 1
    feature, cut = np.where(inner, tree.feature, 0), np.where(inner, tree.bin, BINS)
    left, right = np.where(inner, tree.left, own), np.where(inner, tree.right, own)     # a leaf leads to itself
    steps = int(depth.max(initial=0))
    at, steps = (np.zeros(len(bins), np.int64), steps) if at is None else (at, min(1, steps))
    rows = np.arange(len(bins))
    for _ in range(steps):
        at = np.where(bins[rows, feature[at]] <= cut[at], left[at], right[at])
    return at


def _shrunk(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def best_splits(hist: np.ndarray, columns: np.ndarray, sizes: np.ndarray, p: Boosting) -> list:
    """For each node of a histogram (nodes x 3 x bins, ``sizes`` bins a column)
    the best split (gain, column, bin, (g, h, n) left, (g, h, n) right), or
    None.  Ties: the first column and bin.  All in units of 2^-24; behind a
    column's last bin there are no rows, so that is no split."""
    stop = np.cumsum(sizes)
    left = np.cumsum(hist, axis=2, dtype=float)
    total = left[:, :, stop[0] - 1][:, :, None]
    before = np.concatenate((np.zeros((len(hist), 3, 1)), left[:, :, stop[:-1] - 1]), axis=2)
    left -= np.repeat(before, sizes, axis=2)
    right = total - left

    def value(s):
        g = _shrunk(s[:, 0], p.l1 * UNIT) if p.l1 else s[:, 0]
        return g * g / np.maximum(s[:, 1] + p.l2 * UNIT, 1e-12 * UNIT)
    least = max(1, p.min_child)
    gain = np.where((left[:, 2] >= least) & (right[:, 2] >= least), value(left) + value(right) - value(total), -np.inf) / UNIT
    out = []
    for v, at in enumerate(np.argmax(gain, axis=1).tolist()):
        j = int(np.searchsorted(stop, at, "right"))
        out.append((float(gain[v, at]), int(columns[j]), int(at - stop[j] + sizes[j]), tuple(left[v, :, at].tolist()),
                    tuple(right[v, :, at].tolist())) if gain[v, at] > 1e-9 else None)
    return out


class Growth:
    """One tree while it grows: all nodes down to the stated depth."""

    def __init__(self, p: Boosting, columns: np.ndarray):
        self.p, self.columns = p, columns
        self.split: dict = {}                # node: (gain, column, bin)
        self.child: dict = {}                # node: (left, right)
        self.sums: dict = {}
        self.active, self.level, self.count = [0], 0, 1

    def grow(self, found: dict) -> None:
        """Take the best splits of the active nodes."""
        nodes = []
        for v in self.active:
            got = found.get(v)
            if got is None:
                continue
            gain, column, cut, left, right = got
            if v == 0:
                self.sums[0] = tuple(a + b for a, b in zip(left, right))
            self.split[v], self.child[v] = (gain, column, cut), (self.count, self.count + 1)
            self.sums[self.count], self.sums[self.count + 1] = left, right
            nodes += [self.count, self.count + 1]
            self.count += 2
        self.level += 1
        self.active = nodes if self.level < self.p.depth else []

    def partial(self) -> Tree:
        """What routes rows to the active nodes."""
        return self._tree(set(self.split), list(range(self.count)))

    def finished(self) -> Tree:
        """The tree of best-first growth: the largest gain is split next."""
        chosen: set = set()
        heap = [(-self.split[0][0], 0)] if 0 in self.split else []
        while heap and len(chosen) + 1 < self.p.leaves:
            _, v = heapq.heappop(heap)
            chosen.add(v)
            for c in self.child[v]:
                if c in self.split:
                    heapq.heappush(heap, (-self.split[c][0], c))
        kept, todo = [], [0]
        while todo:
            v = todo.pop(0)
            kept.append(v)
            if v in chosen:
                todo += self.child[v]
        return self._tree(chosen, kept)

    def _tree(self, chosen: set, kept: list) -> Tree:
        place = {v: i for i, v in enumerate(kept)}
        n = len(kept)
        t = Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n))
        for v, i in place.items():
            if v in chosen:
                _, t.feature[i], t.bin[i] = self.split[v]
                t.left[i], t.right[i] = (place[c] for c in self.child[v])
            elif v in self.sums:
                g, h, _ = self.sums[v]
                t.value[i] = -self.p.rate * float(_shrunk(g / UNIT, self.p.l1)) / max(h / UNIT + self.p.l2, 1e-12)
        return t


# -- one partition's work ----------------------------------------------------

def _uniform(ids: np.ndarray, seed: int, model: int, rnd: int) -> np.ndarray:
    """A number in [0, 1) by row, model and round (splitmix64 finaliser)."""
    u = np.uint64
    x = ids.view(np.uint64) * u(0x9E3779B97F4A7C15) + u((seed * 1_000_003 + model) * 1_000_003 + rnd)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> u(shift))) * u(times)
    return (x ^ (x >> u(31))) / 2.0**64


def _histograms(cells, rows, nodes, g, h, columns, sizes, count):
    """Sums by node and by bin of each column, over ``rows`` of ``cells``
    (column by column): gradients, second derivatives, rows; whole numbers
    below 2^53."""
    out = np.zeros((count, 3, int(sizes.sum())))
    for a in range(0, len(rows), BLOCK):
        own, node, to = rows[a:a + BLOCK], nodes[a:a + BLOCK], 0
        for j, k in zip(columns.tolist(), sizes.tolist()):
            at = node * k + cells[j].take(own)
            for c, w in enumerate((g, h, None)):
                out[:, c, to:to + k] += np.bincount(at, None if w is None else w[a:a + BLOCK], count * k).reshape(count, k)
            to += k
    return out


class Partition:
    """Binned rows of one partition and what the worker remembers of them."""

    def __init__(self, row):
        n = len(row["y"])
        self.cells = np.ascontiguousarray(np.frombuffer(row["bins"], np.uint8).reshape(n, -1).T)
        self.bins = self.cells.T
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.y = np.frombuffer(row["y"], np.uint8)
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        self.margin: dict = {}       # model: (trees applied, margins)
        self.grown: dict = {}        # model: (round, rows drawn, g, h)
        self.at: dict = {}           # model: (round, level, node of each row)
        self.last: dict = {}         # model: (round, level, {node: its place}, histograms)

    def margins(self, m: int, base: float, rnd: int, trees):
        done, x = self.margin.get(m, (0, None))
        if x is None or done > rnd:
            done, x = 0, np.full(len(self.y), base)
        for k in range(done, rnd):
            t = trees(m, k)
            x = x + t.value[route(t, self.bins)]
        self.margin[m] = rnd, x
        return x

    def loss(self, m: int, p: Boosting):
        """Sum of the evaluation rows' losses, and of their weights."""
        x, y = self.margin[m][1][self.held], self.y[self.held]
        w = np.where(y == 1, p.weights[1], p.weights[0])
        return float((w * np.logaddexp(0, np.where(y == 1, -x, x))).sum()), float(w.sum())

    def start(self, m: int, p: Boosting, rnd: int, seed: int) -> None:
        """Gradients of the rows that this round draws."""
        if self.grown.get(m, (None,))[0] == rnd:
            return
        own = np.flatnonzero(~self.held & (_uniform(self.ids, seed, m, rnd) < p.rows))
        prob = 1 / (1 + np.exp(-self.margin[m][1][own]))
        y = self.y[own]
        w = np.where(y == 1, p.weights[1], p.weights[0])
        self.grown[m] = rnd, own, np.rint(w * (prob - y) * UNIT), np.rint(w * prob * (1 - prob) * UNIT)

    def level(self, m: int, rnd: int, level: int, tree: Tree, active: list, pairs: list, columns, sizes,
              keep: bool) -> np.ndarray:
        """Histograms of the active nodes; of each pair of siblings the one
        with fewer rows is counted, if the parent's is at hand (``keep``: for
        the next level, which the same worker will see)."""
        _, own, g, h = self.grown[m]
        before = self.at.get(m, (None, None, None))
        self.at[m] = rnd, level, route(tree, self.bins, before[2] if before[:2] == (rnd, level - 1) else None).astype(np.int32)
        at = self.at[m][2][own].astype(np.int64)
        size = np.bincount(at, minlength=int(max(active)) + 1)
        old = self.last.get(m, (None, None, {}, None))
        parents = old[2] if old[:2] == (rnd, level - 1) else {}
        derive = {}
        for v, a, b in pairs:
            if v in parents:
                few, many = (a, b) if size[a] <= size[b] else (b, a)
                derive[many] = (v, few)
        counted = [v for v in active if v not in derive]
        place = np.full(len(size), -1)
        place[counted] = np.arange(len(counted))
        rows = np.flatnonzero(place[at] >= 0)
        hist = _histograms(self.cells, own[rows], place[at[rows]], g[rows], h[rows], columns, sizes, len(counted))
        if not keep:
            return hist
        index = {v: i for i, v in enumerate(active)}
        out = np.empty((len(active), *hist.shape[1:]))
        out[[index[v] for v in counted]] = hist
        for many, (v, few) in derive.items():
            out[index[many]] = old[3][parents[v]] - out[index[few]]
        self.last[m] = rnd, level, index, out
        return out


_held: dict = {}             # of this worker: (fit, partition): Partition


def work(job: dict, rows):
    """The job of one tree level, on the partitions of a task: losses by
    model, histograms by model and run of nodes."""
    def trees(m, k):
        if (m, k) in job["recent"]:
            return job["recent"][m, k]
        return job["older"][k // RECENT].value[m, k]

    for row in rows:
        name = job["fit"], row["part"]
        if name not in _held:
            for old in list(_held)[:max(0, len(_held) - KEPT + 1)]:
                del _held[old]
            _held[name] = Partition(row)
        part = _held[name]
        for m, todo in job["models"].items():
            p = todo["p"]
            part.margins(m, todo["base"], todo["round"], trees)
            if todo["level"] == 0:
                yield ("loss", m), part.loss(m, p)
            if todo["active"]:
                part.start(m, p, todo["round"], job["seed"])
                hist = part.level(m, todo["round"], todo["level"], todo["tree"], todo["active"], todo["pairs"], todo["columns"],
                                  todo["sizes"], job["parts"] == 1)
                for i in range(0, len(hist), job["run"]):
                    yield (m, i), hist[i:i + job["run"]].astype(np.int64) if job["parts"] > 1 else hist[i:i + job["run"]]


def choose(job: dict, item):
    """The best splits of nodes whose histograms are complete."""
    key, got = item
    if key[0] == "loss":
        return key, got
    todo = job["models"][key[0]]
    return key, dict(zip(todo["active"][key[1]:], best_splits(got, todo["columns"], todo["sizes"], todo["p"])))


def _add(a, b):
    return (a[0] + b[0], a[1] + b[1]) if isinstance(a, tuple) else a + b


# -- fitting -----------------------------------------------------------------

def column_edges(df: DataFrame, columns: list) -> list:
    """By column, up to BINS - 1 of its values that part it into runs of like
    size: every value that a 64th of the rows have is one."""
    shares = [i / BINS for i in range(1, BINS)]
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    got = df.agg(*[F.percentile_approx(value(c), shares, 20 * BINS).alias(f"e{i}") for i, c in enumerate(columns)]).first()
    return [np.array(sorted(set(q or [])), float) for q in got]


def binned_rows(df: DataFrame, columns: list, edges: list, held: str | None = None) -> DataFrame:
    """One row a partition: its binned matrix, labels, ids and evaluation marks."""
    def run(batches):
        parts = []
        for b in batches:
            x = np.stack([b.column(3 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(columns))], axis=1)
            parts.append((b.column(0).to_numpy(zero_copy_only=False).astype(np.int64),
                          b.column(1).to_numpy(zero_copy_only=False).astype(np.uint8),
                          b.column(2).to_numpy(zero_copy_only=False).astype(np.uint8), binned(x, edges)))
        if parts:
            import pyarrow as pa
            ids, y, mark, bins = (np.concatenate(c) for c in zip(*parts))
            yield pa.record_batch({c: pa.array([v.tobytes()], pa.binary())
                                   for c, v in (("ids", ids), ("y", y), ("held", mark), ("bins", bins))})
    mark = F.col(held).cast("int") if held else F.lit(0)
    rows = df.select(F.coalesce(F.col(ID_COL).cast("long"), F.lit(-1)), F.col(LABEL_COL).cast("int"), mark,
                     *[F.col(c).cast("double") for c in columns])
    return rows.mapInArrow(run, "ids binary, y binary, held binary, bins binary")


@dataclass
class Fit:
    """How far the models of one fit have come."""
    name: str
    seed: int
    settings: dict               # by name
    models: dict                 # by name
    left: dict                   # number: name of the models still growing
    parts: int
    held: bool
    round: int = 0
    recent: dict = field(default_factory=dict)     # (model, round): tree
    older: list = field(default_factory=list)      # the same as broadcasts, RECENT rounds each

    def growth(self, m: int) -> Growth:
        """A new tree of a model over the columns drawn for it."""
        p = self.settings[self.left[m]]
        n = len(self.models[self.left[m]].columns)
        k = max(1, math.ceil(p.columns * n))
        pick = np.random.default_rng([self.seed, m, self.round])
        out = Growth(p, np.sort(pick.choice(n, k, replace=False)) if k < n else np.arange(n))
        if self.round >= p.rounds:
            out.active = []                            # only its last loss is open
        return out

    def advance(self, ask) -> None:
        """One round of all models; ``ask`` answers the job of a tree level."""
        grow = {m: self.growth(m) for m in self.left}
        first = True
        while first or any(g.active for g in grow.values()):
            asked = {m: g for m, g in grow.items() if first or g.active}
            found = ask({"fit": self.name, "seed": self.seed, "parts": self.parts, "recent": self.recent, "older": self.older,
                         "run": RUN if self.parts > 1 else 1 << 30, "models": {m: self._todo(m, g) for m, g in asked.items()}})
            if first and self.held:
                for m, name in self.left.items():
                    total, weight = found.get(("loss", m), (0.0, 0.0))
                    if weight:                         # the first: of the base alone
                        self.models[name].losses.append(total / weight)
            for m, g in asked.items():
                if g.active:
                    g.grow({v: s for (k, _), own in found.items() if k == m for v, s in own.items()})
            first = False
        for m, name in list(self.left.items()):
            p, model = self.settings[name], self.models[name]
            stops = p.patience and self.held
            if self.round >= p.rounds or (stops and len(model.losses) - 1 - int(np.argmin(model.losses)) >= p.patience):
                del self.left[m]
                continue
            model.trees.append(grow[m].finished())
            self.recent[m, self.round] = model.trees[-1]
            if self.round + 1 >= p.rounds and not stops:
                del self.left[m]
        self.round += 1

    def _todo(self, m: int, g: Growth) -> dict:
        active, model = set(g.active), self.models[self.left[m]]
        sizes = np.array([len(model.edges[j]) + 1 for j in g.columns])
        return {"p": g.p, "base": model.base, "sizes": sizes, "round": self.round, "level": g.level, "tree": g.partial(),
                "active": g.active, "columns": g.columns, "pairs": [(v, *c) for v, c in g.child.items() if c[0] in active]}


def together(rows):
    """The partitions' rows as those of one partition."""
    parts = sorted(rows, key=lambda r: r["part"])
    if parts:
        yield {"part": 0, **{c: b"".join(bytes(r[c]) for r in parts) for c in ("ids", "y", "held", "bins")}}


def whole_rounds(fit: Fit, rows):
    """WHOLE rounds on all rows of a small table: its histograms are complete
    where they are made, so no job has to part the levels."""
    for row in together(rows):
        for _ in range(WHOLE):
            if fit.left:
                fit.advance(lambda job: dict(choose(job, item) for item in work(job, [row])))
        yield fit


def fit_whole(fit: Fit, rows) -> None:
    """Fit the models on a table whose rows lie in one task, each in a task of its own."""
    alone = [Fit(f"{fit.name}-{m}", fit.seed, fit.settings, {name: fit.models[name]}, {m: name}, 1, fit.held) for m, name in fit.left.items()]
    while alone:
        got = rows.context.union([rows.mapPartitions(partial(whole_rounds, f)) for f in alone]).collect()
        for f in got:
            fit.models.update(f.models)
        alone = [f for f in got if f.left]


def fit_boosted(df: DataFrame, columns: list, settings: dict[str, Boosting], held: str | None = None, seed: int = 42) -> dict[str, Boosted]:
    """Fit all models of ``settings`` on the rows of ``df`` (its partitions
    are the units of work); rows marked by ``held`` only measure the loss."""
    sc = df.sparkSession.sparkContext
    ship_package(df.sparkSession)
    train = df.where(~F.col(held)) if held else df
    edges = column_edges(train, columns)
    table = materialize(binned_rows(df, columns, edges, held).withColumn("part", F.monotonically_increasing_id()), "binned")
    counts = {r[0]: r[1] for r in train.groupBy(LABEL_COL).count().collect()}
    sizes = [r[0] for r in table.select(F.length("y")).collect()]          # one row a partition
    whole = sum(sizes) <= TASK_ROWS
    # else a task takes some partitions and adds up their sums: as many tasks as can run at once
    tasks = 1 if whole else max(1, min(len(sizes), sc.defaultParallelism))
    rows = table.select("part", "ids", "y", "held", "bins").rdd.map(lambda r: r.asDict()).repartition(tasks).persist()
    models = {}
    for name, p in settings.items():
        mass = [counts.get(c, 0) * p.weights[c] for c in (0, 1)]
        models[name] = Boosted(columns, edges, math.log(max(mass[1], 1e-12) / max(mass[0], 1e-12)))
    fit = Fit(uuid.uuid4().hex, seed, settings, models, dict(enumerate(settings)), 1 if whole else len(sizes), held is not None)

    def ask(job):
        runs = sum(max(1, -(-len(todo["active"]) // job["run"])) for todo in job["models"].values())
        got = rows.mapPartitions(partial(work, job)).reduceByKey(_add, min(runs, fit.parts, 64))
        return dict(got.map(partial(choose, job)).collect())
    try:
        if whole:
            fit_whole(fit, rows)
        while fit.left and not whole:
            fit.advance(ask)
            if fit.round % RECENT == 0:
                fit.older.append(sc.broadcast({k: t for k, t in fit.recent.items() if k[1] // RECENT == len(fit.older)}))
                fit.recent = {k: t for k, t in fit.recent.items() if k[1] >= fit.round - 1}
    finally:
        rows.unpersist()
        for b in fit.older:
            b.unpersist()
    for name, p in settings.items():
        own = fit.models[name]
        if p.patience and held and own.losses:
            own.trees = own.trees[:int(np.argmin(own.losses))]
    return fit.models


# -- use and storage ---------------------------------------------------------

def predict_boosted(model: Boosted, df: DataFrame, out: str = "p") -> DataFrame:
    """``df`` with the probability of class 1."""
    ship_package(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def p(x: pd.DataFrame) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-held.value.margins(x.to_numpy(float)))))
    return df.withColumn(out, p(F.struct(*[F.col(c).cast("double") for c in model.columns])))


NODES = "tree int, node int, feature string, threshold double, left int, right int, value double"


def model_rows(model: Boosted) -> list:
    """A model as rows: one a node (a leaf has no feature); tree -1 holds the base."""
    rows = [(-1, 0, None, None, None, None, float(model.base))]
    for k, t in enumerate(model.trees):
        for i in range(len(t.feature)):
            f = int(t.feature[i])
            if f < 0:
                rows.append((k, i, None, None, None, None, float(t.value[i])))
            else:
                rows.append((k, i, model.columns[f], float(model.edges[f][t.bin[i]]), int(t.left[i]), int(t.right[i]), None))
    return rows


def model_of_rows(rows: list, columns: list) -> Boosted:
    """The model again; its edges are the thresholds in use."""
    place = {c: j for j, c in enumerate(columns)}
    used: list = [set() for _ in columns]
    for r in rows:
        if r.feature is not None:
            used[place[r.feature]].add(r.threshold)
    edges = [np.array(sorted(u), float) for u in used]
    model = Boosted(columns, edges, next(r.value for r in rows if r.tree < 0))
    by: dict = {}
    for r in rows:
        if r.tree >= 0:
            by.setdefault(r.tree, []).append(r)
    for k in sorted(by):
        own = sorted(by[k], key=lambda r: r.node)
        n = len(own)
        t = Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n))
        for i, r in enumerate(own):
            if r.feature is None:
                t.value[i] = r.value
            else:
                t.feature[i], t.left[i], t.right[i] = place[r.feature], r.left, r.right
                t.bin[i] = np.searchsorted(edges[place[r.feature]], r.threshold)
        model.trees.append(t)
    return model

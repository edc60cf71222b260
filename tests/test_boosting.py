"""Boosted trees against a plain search, and the logistic solver against a dense fit."""

import numpy as np
import pytest

from riskmart.operators import boosting as BO
from riskmart.operators import logistic as LO


def table(n=600, k=5, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, k)) * [1, 10, 1000, 1e-3, 1][:k], 3)
    x[:, -1] = rng.integers(0, 3, n)
    y = (x[:, 0] + x[:, 1] / 10 * (x[:, -1] > 0) + rng.normal(size=n) > 0.5).astype(int)
    return x, y


def frame(spark, x, y, partitions=1):
    names = [f"x{j}" for j in range(x.shape[1])]
    rows = [(i, int(c), *map(float, r)) for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "SK_ID_CURR long, TARGET int, " + ", ".join(f"{c} double" for c in names))
    return df.repartition(partitions, "SK_ID_CURR"), names


def plain_gain(x, g, h, rows, p):
    """The best split of some rows over all values of all columns."""
    s = lambda a, b: (np.sign(a) * max(abs(a) - p.l1, 0)) ** 2 / max(b + p.l2, 1e-12)
    best = (0.0, None, None)
    for j in range(x.shape[1]):
        for v in np.unique(x[rows, j])[:-1]:
            a, b = rows[x[rows, j] <= v], rows[x[rows, j] > v]
            if min(len(a), len(b)) < max(1, p.min_child):
                continue
            gain = s(g[a].sum(), h[a].sum()) + s(g[b].sum(), h[b].sum()) - s(g[rows].sum(), h[rows].sum())
            if gain > best[0] + 1e-9:
                best = gain, j, v
    return best


def plain_boosting(x, y, p):
    """Best-first trees by the plain search; margins of the rows after each round."""
    w = np.where(y == 1, p.weights[1], p.weights[0])
    margin = np.full(len(y), np.log(w[y == 1].sum() / w[y == 0].sum()))
    sizes = []
    for _ in range(p.rounds):
        prob = 1 / (1 + np.exp(-margin))
        g, h = w * (prob - y), w * prob * (1 - prob)
        leaves = [(np.arange(len(y)), 0)]
        while len(leaves) < p.leaves:
            found = [(plain_gain(x, g, h, r, p) if d < p.depth else (0.0, None, None), k) for k, (r, d) in enumerate(leaves)]
            (gain, j, v), k = max(found, key=lambda f: f[0][0])
            if j is None:
                break
            r, d = leaves.pop(k)
            leaves += [(r[x[r, j] <= v], d + 1), (r[x[r, j] > v], d + 1)]
        for r, _ in leaves:
            t = g[r].sum()
            margin[r] -= p.rate * np.sign(t) * max(abs(t) - p.l1, 0) / max(h[r].sum() + p.l2, 1e-12)
        sizes.append(len(leaves))
    return margin, sizes


@pytest.mark.parametrize("p", [BO.Boosting(4, 0.3, 3), BO.Boosting(4, 0.3, 4, leaves=5, min_child=20, l1=0.5, l2=2.0, weights=(0.7, 2.5)),
                               BO.Boosting(3, 0.1, 5, leaves=3, min_child=50)])
def test_trees_equal_a_plain_search(spark, p):
    x, y = table(300)
    x = x.argsort(axis=0).argsort(axis=0) // 15 / 8.0                      # 20 values a column: every one a bin's end
    df, names = frame(spark, x, y)
    assert all(len(np.unique(x[:, j])) <= BO.BINS for j in range(x.shape[1]))
    model = BO.fit_boosted(df, names, {"m": p})["m"]
    want, sizes = plain_boosting(x, y, p)
    assert [int((t.feature < 0).sum()) for t in model.trees] == sizes
    assert np.allclose(model.margins(x), want, atol=1e-5)


def test_any_number_of_partitions_gives_the_same_models(spark):
    x, y = table(2000)
    settings = {"a": BO.Boosting(6, 0.2, 4, leaves=9, min_child=20, rows=0.8, columns=0.6), "b": BO.Boosting(4, 0.2, 3, l2=1.0, weights=(1.0, 3.0))}
    got = []
    for k in (1, 3):
        df, names = frame(spark, x, y, k)
        edges = BO.column_edges(frame(spark, x, y, 1)[0], names)
        got.append({n: BO.model_rows(m) for n, m in _with_edges(edges, df, names, settings).items()})
    assert got[0] == got[1] and len(got[0]["a"]) > 40
    assert got[0]["a"] != got[0]["b"]


def _with_edges(edges, df, names, settings):
    real, BO.column_edges = BO.column_edges, lambda *a: edges
    try:
        return BO.fit_boosted(df, names, settings)
    finally:
        BO.column_edges = real


def test_a_worker_without_memory_rebuilds_it(spark, monkeypatch):
    x, y = table(500)
    row = {"part": 0, "ids": np.arange(500).tobytes(), "y": y.astype(np.uint8).tobytes(), "held": np.zeros(500, np.uint8).tobytes()}
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, 64) / 64)) for j in range(x.shape[1])]
    row["bins"] = BO.binned(x, edges).tobytes()
    names, models = [f"x{j}" for j in range(x.shape[1])], []
    for forget in (False, True):
        fit = BO.Fit(f"f{forget}", 1, {"m": BO.Boosting(5, 0.3, 4, rows=0.7)}, {"m": BO.Boosted(names, edges, 0.0)}, {0: "m"}, 1, False)

        def ask(job):
            if forget:
                BO._held.clear()
            return dict(BO.choose(job, item) for item in BO.work(job, [row]))
        while fit.left:
            fit.advance(ask)
        models.append(BO.model_rows(fit.models["m"]))
    assert models[0] == models[1]


def test_patience_keeps_the_best_round(spark):
    """Labels of the evaluation rows are the reverse of what is learnt after
    the first rounds, so the loss has its best round early."""
    from pyspark.sql import functions as F
    x, y = table(1500, seed=3)
    df, names = frame(spark, x, y)
    df = df.withColumn("held", F.col("SK_ID_CURR") % 5 == 0)
    p = BO.Boosting(400, 0.5, 5, patience=12)
    model = BO.fit_boosted(df, names, {"m": p}, "held")["m"]
    best = int(np.argmin(model.losses))
    assert 0 < best and len(model.trees) == best and len(model.losses) == best + 1 + 12
    full = BO.fit_boosted(df, names, {"m": BO.Boosting(best + 3, 0.5, 5)}, "held")["m"]
    own = np.arange(1500) % 5 == 0
    for k in (0, best, best + 3):
        full.trees, kept = full.trees[:k], full.trees
        m = full.margins(x[own])
        full.trees = kept
        loss = np.logaddexp(0, np.where(y[own] == 1, -m, m)).mean()
        assert abs(loss - model.losses[k]) < 1e-6


def test_predictions_and_rows_of_a_model(spark):
    x, y = table(400)
    df, names = frame(spark, x, y)
    model = BO.fit_boosted(df, names, {"m": BO.Boosting(5, 0.3, 4)})["m"]
    rows = spark.createDataFrame(BO.model_rows(model), BO.NODES).collect()
    again = BO.model_of_rows(rows, names)
    want = 1 / (1 + np.exp(-model.margins(x)))
    for m in (model, again):
        got = {r.SK_ID_CURR: r.p for r in BO.predict_boosted(m, df).collect()}
        assert np.allclose([got[i] for i in range(400)], want, atol=1e-12)
    holes = df.limit(5).withColumn("x0", df.x0 * float("nan"))
    assert all(0 < r.p < 1 for r in BO.predict_boosted(model, holes).collect())


@pytest.mark.parametrize("weights", [(1.0, 1.0), (0.6, 3.5)])
def test_logistic_equals_a_dense_fit(spark, weights):
    x, y = table(800)
    x = np.concatenate((x, np.full((len(x), 1), 7.0)), axis=1)            # a constant column
    df, names = frame(spark, x, y, 3)
    model = LO.fit_logistic(df, names, weights)
    assert model.passes < 30
    z = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    at, w = np.zeros(z.shape[1]), np.where(y == 1, weights[1], weights[0])
    pen = np.append(np.ones(x.shape[1]), 0)
    for _ in range(200):
        p = 1 / (1 + np.exp(-(z @ at)))
        at -= np.linalg.lstsq(z.T @ (z * (w * p * (1 - p))[:, None]) + np.diag(pen), z.T @ (w * (p - y)) + pen * at, rcond=None)[0]
    margin = x @ np.array(model.coefficients) + model.intercept
    assert np.allclose(margin, z @ at, atol=1e-6) and np.allclose(model.coefficients, at[:-1], atol=1e-6)
    got = {r.SK_ID_CURR: r.p for r in LO.predict_logistic(model, df).collect()}
    assert np.allclose([got[i] for i in range(len(y))], 1 / (1 + np.exp(-margin)), atol=1e-9)


def test_models_of_a_small_table_have_a_task_each(spark):
    """One partition: all rounds of a model in one task, all models side by side."""
    x, y = table(400)
    df, names = frame(spark, x, y)
    settings = {k: BO.Boosting(20, 0.3, 3, rows=r) for k, r in (("a", 1.0), ("b", 0.9), ("c", 0.8), ("d", 0.7))}
    sc, group = spark.sparkContext, "small-table"
    seen = []
    sc.setJobGroup(group, group)
    try:
        models = BO.fit_boosted(df, names, settings)
        tracker = sc.statusTracker()
        for job in tracker.getJobIdsForGroup(group):
            info = tracker.getJobInfo(job)
            seen += [tracker.getStageInfo(s).numTasks for s in info.stageIds if tracker.getStageInfo(s)]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(settings) in seen and all(len(m.trees) == 20 for m in models.values())
    for k, p in settings.items():
        m = list(settings).index(k)
        part = {"part": 0, "bins": BO.binned(x, models[k].edges).tobytes(), "ids": np.arange(400).tobytes(),
                "y": y.astype(np.uint8).tobytes(), "held": np.zeros(400, np.uint8).tobytes()}
        fit = BO.Fit(f"alone-{k}", 42, {k: p}, {k: BO.Boosted(names, models[k].edges, models[k].base)}, {m: k}, 1, False)
        while fit.left:
            fit.advance(lambda job: dict(BO.choose(job, item) for item in BO.work(job, [part])))
        assert BO.model_rows(fit.models[k]) == BO.model_rows(models[k])


def test_packed_histograms_count_every_cell():
    x, y = table(500)
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, 8) / 8)) for j in range(x.shape[1])]
    cells = np.ascontiguousarray(BO.binned(x, edges).T)
    sizes, columns = np.array([len(e) + 1 for e in edges]), np.arange(x.shape[1])
    rows, nodes = np.arange(0, 500, 2), np.arange(250) % 3
    g, h = np.arange(250.0), np.ones(250) * 2
    got = BO._histograms(cells, rows, nodes, g, h, columns, sizes, 3)
    to = 0
    for j, k in enumerate(sizes.tolist()):
        for v in range(3):
            for b in range(k):
                own = (nodes == v) & (cells[j][rows] == b)
                assert got[v, :, to + b].tolist() == [g[own].sum(), h[own].sum(), own.sum()]
        to += k
    assert to == got.shape[2]


def _jobs(spark, name, f):
    """What f returns and how many jobs it ran."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        return f(), len(sc.statusTracker().getJobIdsForGroup(name))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_a_table_that_a_task_can_hold_needs_no_job_a_level(spark, monkeypatch):
    """Also one of several partitions; and the models are those of a job a level."""
    x, y = table(900)
    df, names = frame(spark, x, y, 3)
    settings = {"a": BO.Boosting(12, 0.3, 4, min_child=5, rows=0.8, columns=0.6), "b": BO.Boosting(9, 0.3, 3, weights=(1.0, 3.0))}
    got = []
    for rows in (BO.TASK_ROWS if hasattr(BO, "TASK_ROWS") else 0, 0):
        monkeypatch.setattr(BO, "TASK_ROWS", rows, raising=False)
        models, jobs = _jobs(spark, f"task-rows-{rows}", lambda: BO.fit_boosted(df, names, settings))
        got.append(({k: BO.model_rows(m) for k, m in models.items()}, jobs))
    assert got[0][0] == got[1][0]
    assert got[0][1] < 12 < got[1][1]


def test_patience_needs_no_job_a_level_either(spark):
    """Evaluation rows of several partitions are brought together with the others."""
    from pyspark.sql import functions as F
    x, y = table(1500, seed=3)
    settings = {"m": BO.Boosting(400, 0.5, 5, patience=12)}
    got = []
    for k in (1, 3):
        df, names = frame(spark, x, y, k)
        df = df.withColumn("held", F.col("SK_ID_CURR") % 5 == 0)
        own, edges = BO.column_edges, BO.column_edges(frame(spark, x, y, 1)[0].where("SK_ID_CURR % 5 <> 0"), names)
        BO.column_edges = lambda *a, edges=edges: edges
        try:
            models, jobs = _jobs(spark, f"patience-{k}", lambda df=df, names=names: BO.fit_boosted(df, names, settings, "held"))
        finally:
            BO.column_edges = own
        assert jobs < 12
        got.append((BO.model_rows(models["m"]), np.round(models["m"].losses, 9).tolist()))
    assert got[0] == got[1]

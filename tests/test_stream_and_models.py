"""Batch = stream, and fit -> save -> load -> same predictions."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from riskmart.operators import models as MD
from riskmart.plans import catalog as C
from riskmart.plans.training import prepare, score_requests
from riskmart.operators import rollups as RU
from riskmart.sources.adapter import LendingTables
from riskmart.streaming.scoring import decide_batch, score_stream, write_requests_json


FEW = {"rounds": 4}         # in tests; the presets have budgets of their own


def _flat(df):
    return sorted((r.applicant_id, r.ml_result.decision, r.ml_result.confidence,
                   r.ml_result.estimated_emi, tuple(r.ml_result.key_risks), r.pre_screening.score)
                  for r in df.collect())


def test_stream_equals_batch(spark, tmp_path):
    apps = LendingTables(spark, SF_SMALL).applicants()
    base = str(tmp_path)
    write_requests_json(apps, f"{base}/in", files=3)
    q = score_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ck", f"{base}/rej",
                     max_files_per_trigger=1)
    q.awaitTermination()
    streamed = spark.read.parquet(f"{base}/out").drop("batch")
    batch, rejected = decide_batch(apps)
    assert _flat(streamed) == _flat(batch)
    assert spark.read.parquet(f"{base}/rej").count() == rejected.count()
    assert len([d for d in os.listdir(f"{base}/out") if d.startswith("batch=")]) >= 2


def test_both_outputs_of_a_batch_are_committed_together(spark, tmp_path, monkeypatch):
    from pyspark.errors import StreamingQueryException
    from riskmart.streaming import scoring as ST
    apps = LendingTables(spark, SF_SMALL).applicants()
    base = str(tmp_path)
    write_requests_json(apps, f"{base}/in", files=2)

    def run(checkpoint="ck"):
        q = score_stream(spark, f"{base}/in", f"{base}/out", f"{base}/{checkpoint}", f"{base}/rej", max_files_per_trigger=1)
        q.awaitTermination()

    def seen():
        return (_flat(ST.read_scored(spark, f"{base}/out")), ST.read_rejected(spark, f"{base}/out", f"{base}/rej").count())

    whole, n = _flat(decide_batch(apps)[0]), decide_batch(apps)[1].count()
    # the second batch ends after its decisions, before its record
    commit, done = ST._commit, []

    def crash(spark, out_dir, record):
        if done:
            raise OSError("lost before the record")
        done.append(record)
        commit(spark, out_dir, record)
    monkeypatch.setattr(ST, "_commit", crash)
    with pytest.raises(StreamingQueryException):
        run()
    assert os.path.exists(f"{base}/out/batch=1")
    first = seen()
    assert (len(first[0]), first[1]) == (done[0]["n_decisions"], done[0]["n_rejected"]) and len(first[0]) < len(whole)
    # run again: the batch replaces its own folders and gets its record
    monkeypatch.setattr(ST, "_commit", commit)
    run()
    assert seen() == (whole, n)
    # a crash after the record, before Spark's own: the batch comes again and changes nothing
    written = sorted(os.listdir(f"{base}/out/batch=1"))
    for name in ("1", ".1.crc"):
        if os.path.exists(f"{base}/ck/commits/{name}"):
            os.remove(f"{base}/ck/commits/{name}")
    run()
    assert seen() == (whole, n) and sorted(os.listdir(f"{base}/out/batch=1")) == written
    assert [r.batch for r in ST.read_commits(spark, f"{base}/out").orderBy("batch").collect()] == [0, 1]
    with pytest.raises(StreamingQueryException, match="another stream"):
        run("other")


def test_fit_save_load_predict(spark, tmp_path):
    prep = prepare(RU.mart_from_tables(LendingTables(spark, SF_SMALL)))
    model, secs = MD.fit_preset(prep.train, prep.feature_cols, "gbt_main", overrides=FEW)
    p1 = MD.predict_default(model, prep.test).select("SK_ID_CURR", "p")
    path = str(tmp_path / "bundle")
    MD.save_model(model, {"feature_cols": prep.feature_cols, "medians": prep.medians, "auc_score": 0.5, "threshold": 0.35,
                          "algorithm": "gbt", "best_model_name": "GBT (main)"}, path, {"codes": prep.codes})
    bundle = MD.load_model(path)
    assert bundle is not None
    p2 = MD.predict_default(bundle[0], prep.test).select("SK_ID_CURR", F.col("p").alias("p2"))
    diff = p1.join(p2, "SK_ID_CURR").where(F.abs(F.col("p") - F.col("p2")) > 1e-12).count()
    assert diff == 0
    info = MD.model_info(bundle).collect()[0]
    assert info.loaded and info.feature_count == len(prep.feature_cols)
    assert MD.model_info(MD.load_model(str(tmp_path / "missing"))).collect()[0].loaded is False
    scored = score_requests(LendingTables(spark, SF_SMALL).applicants(), bundle)
    row = scored.select("ml_result.decision", "ml_result.prob_default").collect()
    assert row and all(r.decision in ("APPROVED", "CONDITIONAL", "REJECTED") for r in row)
    assert all(0 <= r.prob_default <= 100 for r in row)


def test_fallback_preset_and_logistic(spark):
    prep = prepare(RU.mart_from_tables(LendingTables(spark, SF_SMALL)), fit_scope="all")
    board, models = MD.compare_models(prep.train, prep.test, prep.feature_cols,
                                      ["gbt_fallback", "logistic"], overrides=FEW)
    rows = board.collect()
    assert len(rows) == 2 and all(r.error is None for r in rows)
    assert all(0.0 <= r.roc_auc <= 1.0 for r in rows)


def test_comparison_csv(spark, tmp_path):
    from riskmart.operators.metrics import leaderboard
    from riskmart.sources.sinks import write_comparison
    m = spark.createDataFrame([("a", 0.5, 0.6, 0.7, 0.8, 0.4, 0.6, 3, 2, 1.5),
                               ("b", 0.7, 0.6, 0.7, 0.8, 0.4, 0.6, 3, 2, 0.5)],
                              "model string, f1_default double, f1_macro double, f1_weighted double, "
                              "roc_auc double, precision double, recall double, true_positives int, "
                              "false_negatives int, train_seconds double")
    write_comparison(leaderboard(m), str(tmp_path / "cmp"))
    back = spark.read.option("header", True).csv(str(tmp_path / "cmp")).collect()
    assert [r["Model"] for r in back] == ["b", "a"] and "F1 (Default)" in back[0].asDict()


def test_early_stopping_on_test_rows_parity(spark):
    prep = prepare(RU.mart_from_tables(LendingTables(spark, SF_SMALL)))
    model, _ = MD.fit_preset(prep.train, prep.feature_cols, "gbt_main", overrides=FEW, stop_on=prep.test)
    assert MD.predict_default(model, prep.test).count() == prep.test.count()


def test_append_stream_equals_batch(spark, tmp_path):
    from riskmart.streaming.scoring import score_stream_append
    apps = LendingTables(spark, SF_SMALL).applicants()
    base = str(tmp_path)
    write_requests_json(apps, f"{base}/in", files=2)
    q = score_stream_append(spark, f"{base}/in", f"{base}/out", f"{base}/ck")
    q.awaitTermination()
    batch, _ = decide_batch(apps)
    assert _flat(spark.read.parquet(f"{base}/out")) == _flat(batch)


def test_model_scored_stream_equals_batch(spark, tmp_path):
    from riskmart.plans.training import train_and_compare
    tables = LendingTables(spark, SF_SMALL)
    board, path, _ = train_and_compare(spark, tables, ["gbt_d"], overrides=FEW,
                                       save_to=str(tmp_path / "bundle"))
    assert board.count() == 1 and os.path.isdir(str(tmp_path / "bundle" / "comparison"))
    bundle = MD.load_model(path)
    apps = tables.applicants()
    base = str(tmp_path)
    write_requests_json(apps, f"{base}/in", files=2)
    q = score_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ck", scorer="model", bundle=bundle)
    q.awaitTermination()
    streamed = spark.read.parquet(f"{base}/out").drop("batch")
    assert _flat(streamed) == _flat(score_requests(apps, bundle))


def test_failing_preset_keeps_its_row(spark, monkeypatch):
    prep = prepare(RU.mart_from_tables(LendingTables(spark, SF_SMALL)))
    monkeypatch.setitem(MD.PRESETS, "gbt_c", MD.Preset("Broken", "none"))
    board, models = MD.compare_models(prep.train, prep.test, prep.feature_cols, ["gbt_c", "gbt_d"], overrides=FEW)
    rows = {r.model: r for r in board.collect()}
    assert "ValueError" in rows["Broken"].error and rows["Gradient Boosting"].error is None and set(models) == {"gbt_d"}


def test_other_read_failures_are_not_hidden(spark, tmp_path):
    import pytest
    (tmp_path / "metadata").mkdir()
    (tmp_path / "metadata" / "part-0.json").write_text("{}")
    with pytest.raises(Exception):
        MD.load_model(str(tmp_path))
    with pytest.raises(ValueError):
        decide_batch(LendingTables(spark, SF_SMALL).applicants(), scorer="model")


def test_bundle_queries_use_the_best_of_all_presets(spark, monkeypatch):
    """The report, the info and the decisions come from the leaderboard's first model."""
    from riskmart.plans import training as TR
    train, tables, seen = TR.train_and_compare, LendingTables(spark, SF_SMALL), []
    board, path, prep = train(spark, tables, overrides=FEW | {"numTrees": 4})
    names = {MD.PRESETS[k].name for k in MD.COMPARISON}
    assert {r.model for r in board.collect()} == names
    best = board.where("rank = 1").collect()[0]

    def once(spark, tables, keys=MD.COMPARISON, **more):
        seen.append(list(keys))
        return (board, path, prep) if list(keys) == MD.COMPARISON else train(spark, tables, keys, overrides=FEW | {"numTrees": 4})
    monkeypatch.setattr(TR, "train_and_compare", once)
    info = C.run("model_info", spark, SF_SMALL).collect()[0]
    assert (info.best_model_name, info.auc_score) == (best.model, best.roc_auc)
    report = C.run("best_model_report", spark, SF_SMALL).collect()
    assert report == TR.best_model_report(prep, path).collect()
    got = C.run("model_decisions", spark, SF_SMALL).select("applicant_id", "prob_default").collect()
    want = score_requests(tables.applicants(), MD.load_model(path)).select("applicant_id", "ml_result.prob_default").collect()
    assert sorted(got) == sorted(want)
    assert seen == [MD.COMPARISON] * 3


def test_training_partitions_follow_the_rows(spark, monkeypatch):
    from types import SimpleNamespace

    import pytest
    from riskmart.plans import training as TR
    seen = []

    def stop(*a, partitions=None, **more):
        seen.append(partitions)
        raise InterruptedError
    monkeypatch.setattr(TR.RU, "mart_from_tables", lambda tables: None)
    monkeypatch.setattr(MD, "compare_models", stop)
    for n in (0, 40_000, MD.PARTITION_ROWS, MD.PARTITION_ROWS + 1, 100 * MD.PARTITION_ROWS):
        monkeypatch.setattr(TR, "prepare", lambda *a, n=n: SimpleNamespace(train=None, test=None, feature_cols=[], n_train=n))
        with pytest.raises(InterruptedError):
            TR.train_and_compare(spark, None)
    assert seen == [1, 1, 1, 2, 100]


def test_a_reader_sees_an_old_bundle_or_a_new_one_whole(spark, tmp_path, monkeypatch):
    import pytest
    from riskmart.operators.logistic import Logistic
    path = str(tmp_path / "bundle")
    codes = lambda n: {"codes": spark.createDataFrame([("c", "v", n)], "column string, value string, code int")}
    assert MD.load_model(path) is None
    MD.save_model(Logistic(["x"], [1.0], 0.5), {"feature_cols": ["x"], "auc_score": 0.1}, path, codes(1))

    def seen():
        b = MD.load_model(path)
        return b.model.intercept, b.meta.first().auc_score, spark.read.parquet(f"{b.root}/codes").first().code
    assert seen() == (0.5, 0.1, 1)
    # a save that fails after each of its parts, before its manifest
    real = MD._digest

    def fail(spark, part):
        if part.endswith(stop):
            raise InterruptedError
        return real(spark, part)
    for stop in ("model", "metadata", "codes"):
        monkeypatch.setattr(MD, "_digest", fail)
        with pytest.raises(InterruptedError):
            MD.save_model(Logistic(["x"], [2.0], 0.7), {"feature_cols": ["x"], "auc_score": 0.2}, path, codes(2))
        monkeypatch.setattr(MD, "_digest", real)
        assert seen() == (0.5, 0.1, 1)
    MD.save_model(Logistic(["x"], [2.0], 0.7), {"feature_cols": ["x"], "auc_score": 0.2}, path, codes(2))
    old = seen()
    assert old == (0.7, 0.2, 2)
    spark.createDataFrame([("c", "v", 9)], "column string, value string, code int").write.mode("overwrite").parquet(f"{MD.load_model(path).root}/codes")
    with pytest.raises(ValueError, match="codes"):
        MD.load_model(path)


def test_all_failing_presets_raise(spark, monkeypatch):
    import pytest
    prep = prepare(RU.mart_from_tables(LendingTables(spark, SF_SMALL)))
    monkeypatch.setitem(MD.PRESETS, "gbt_c", MD.Preset("Broken", "none"))
    with pytest.raises(ValueError):
        MD.compare_models(prep.train, prep.test, prep.feature_cols, ["gbt_c"], overrides=FEW)


def test_a_forest_task_reads_a_bounded_share():
    """MLlib keeps a count and a node number by tree with each row: 4.4 kB a
    row for the preset (measured), read by one task for a whole partition."""
    row = 62 * 4 + 14 * MD.PRESETS["random_forest"].params["numTrees"]
    for n in (12_000, 720_000, 4_320_000, 100_000_000):
        assert -(-n // MD.train_partitions(n)) * row <= 250e6


def test_the_forest_is_fitted_beside_the_boosters(spark, monkeypatch):
    import threading
    meet = threading.Barrier(2, timeout=60)               # breaks if one is fitted after the other
    boosters, preset = MD.fit_boosters, MD.fit_preset
    monkeypatch.setattr(MD, "fit_boosters", lambda *a, **k: (meet.wait(), boosters(*a, **k))[1])
    monkeypatch.setattr(MD, "fit_preset", lambda *a, **k: (meet.wait(), preset(*a, **k))[1])
    prep = prepare(RU.mart_from_tables(LendingTables(spark, SF_SMALL)))
    board, models = MD.compare_models(prep.train, prep.test, prep.feature_cols, ["gbt_d", "random_forest"],
                                      overrides=FEW | {"numTrees": 4})
    assert all(r.error is None for r in board.collect()) and set(models) == {"gbt_d", "random_forest"}


def test_a_comparison_over_several_partitions_needs_no_job_a_level(spark):
    prep = prepare(RU.mart_from_tables(LendingTables(spark, SF_SMALL)))
    sc = spark.sparkContext
    sc.setJobGroup("comparison", "comparison")
    try:
        board, _ = MD.compare_models(prep.train, prep.test, prep.feature_cols, ["gbt_a", "gbt_d"], overrides={"rounds": 30, "depth": 4}, partitions=3)
        jobs = len(sc.statusTracker().getJobIdsForGroup("comparison"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert all(r.error is None for r in board.collect())
    assert jobs < 60, jobs

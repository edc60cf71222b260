"""One test per missing-value / typing / rounding trap."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

import pytest

from conftest import one
from riskmart.functions.nulls import (clip_lower, nan_to_null_all, negative_days_to_years,
                                      row_max, row_mean, row_min, safe_div)
from riskmart.operators import prep as PR
from riskmart.operators import rollups as RU
from riskmart.operators import validation as VA
from riskmart.schemas import BUREAU_SCHEMA, INSTALLMENTS_SCHEMA


def test_t1_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    out = nan_to_null_all(df).agg(F.count("x").alias("n"), F.max("x").alias("m"))
    r = one(out)
    assert r.n == 1 and r.m == 1.0


def test_t1_csv_nan_text_reads_as_null(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_text("SK_ID_CURR,SK_ID_BUREAU,AMT_CREDIT_SUM,AMT_CREDIT_SUM_DEBT,CREDIT_DAY_OVERDUE,"
                 "CREDIT_ACTIVE,DAYS_CREDIT\n1,10,100.0,NaN,0,Active,-5\n1,11,50.0,,3,Closed,-7\n")
    from riskmart.sources.readers import read_bureau
    r = one(RU.rollup_bureau(read_bureau(spark, str(p))))
    assert r.BUREAU_CREDIT_SUM_DEBT == 0.0 and r.BUREAU_OVERDUE_COUNT == 1


def _bureau(spark, rows):
    return spark.createDataFrame(rows, BUREAU_SCHEMA)


def test_t2_t3_t4_all_missing_group(spark):
    b = _bureau(spark, [(1, 10, None, None, None, None, None), (1, 11, None, None, None, None, None)])
    r = one(RU.rollup_bureau(b))
    assert r.BUREAU_CREDIT_SUM == 0.0 and r.BUREAU_CREDIT_SUM_DEBT == 0.0      # T2
    assert r.BUREAU_CREDIT_SUM_MAX is None and r.BUREAU_AVG_DAYS_CREDIT is None  # T3
    assert r.BUREAU_OVERDUE_COUNT == 0 and r.BUREAU_ACTIVE_LOANS == 0           # T4
    assert r.BUREAU_LOAN_COUNT == 2


def test_missing_key_dropped(spark):
    b = _bureau(spark, [(None, 10, 5.0, 1.0, 0, "Active", -1), (2, 11, 5.0, 1.0, 0, "Active", -1)])
    assert [r.SK_ID_CURR for r in RU.rollup_bureau(b).collect()] == [2]


def test_t5_clip_keeps_missing(spark):
    inst = spark.createDataFrame([(1, 1, 10.0, None, -5, None), (1, 1, 10.0, 8.0, -5, -9),
                                  (1, 1, 10.0, 8.0, -5, 2)], INSTALLMENTS_SCHEMA)
    steps = RU.installment_steps(inst).select("DAYS_PAST_DUE").collect()
    assert [r[0] for r in steps] == [None, 0.0, 7.0]
    r = one(RU.rollup_installments(inst))
    assert r.INST_LATE_PAYMENTS == 1 and r.INST_DAYS_PAST_DUE_MAX == 7.0
    assert r.INST_DAYS_PAST_DUE_MEAN == 3.5 and r.INST_PAYMENT_DIFF_SUM == 4.0


def test_t6_t7_t8_label_codes(spark):
    df = spark.createDataFrame([("b",), ("Z",), (None,), ("a",)], "c string")
    codes = PR.fit_label_codes(df, ["c"])
    assert {r.value: r.code for r in codes.collect()} == {"Z": 0, "a": 1, "b": 2, "nan": 3}     # T6, T7
    new = spark.createDataFrame([("a",), ("never seen",)], "c string")
    assert sorted(r.c for r in PR.apply_label_codes(new, codes, ["c"]).collect()) == [0, 1]      # T8
    assert PR.apply_label_codes(new, codes, ["c"]).schema["c"].metadata == {}                    # T9
    intended = PR.fit_label_codes(df, ["c"], missing_label="Unknown")
    assert "Unknown" in {r.value for r in intended.collect()}


def test_t10_exact_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (11.0,), (None,)], "x double")
    assert PR.fit_medians(df, ["x"]) == {"x": 6.0}
    odd = spark.createDataFrame([(3,), (1,), (2,)], "y int")
    assert PR.fit_medians(odd, ["y"]) == {"y": 2.0}
    empty = spark.createDataFrame([(None,), (None,)], "z double")
    meds = PR.fit_medians(empty, ["z"])
    assert meds == {"z": None}
    assert "z" not in PR.impute(empty, meds).columns


def test_t13_division_by_zero_is_null(spark):
    r = one(spark.range(1).select(safe_div(F.lit(1.0), F.lit(0.0)).alias("q")))
    assert r.q is None


def test_t14_half_even_rounding(spark):
    from riskmart.functions.text import round_even
    r = one(spark.range(1).select(round_even(F.lit(2.5), 0).alias("a"),
                                  round_even(F.lit(0.125), 2).alias("b")))
    assert r.a == 2.0 and r.b == 0.12


def test_t17_text_int_fields(spark):
    raw = spark.createDataFrame([("2", "60", "2.0"), ("2.5", "x", None)],
                                "region_rating string, tenure_months string, children string")
    out = VA.violations(VA.coerce(raw)).collect()
    assert out[0].region_rating == 2 and out[0].children == 2 and out[0].violations == []
    assert out[1].region_rating is None and set(out[1].violations) >= {"region_rating:type",
                                                                       "tenure_months:type"}


def test_t18_sentinel_and_missing_days(spark):
    df = spark.createDataFrame([(365243,), (None,), (-730,)], "d int")
    got = [r[0] for r in df.select(negative_days_to_years("d")).collect()]
    assert got == [0.0, 0.0, 2.0]


def test_t19_row_stats_skip_missing(spark):
    df = spark.createDataFrame([(0.2, None, 0.6), (None, None, None)], "a double, b double, c double")
    r = df.select(row_mean(["a", "b", "c"]).alias("m"), row_min(["a", "b", "c"]).alias("lo"),
                  row_max(["a", "b", "c"]).alias("hi")).collect()
    assert abs(r[0].m - 0.4) < 1e-15 and r[0].lo == 0.2 and r[0].hi == 0.6
    assert r[1].m is None and r[1].lo is None


def test_t22_truncation(spark):
    r = one(spark.range(1).select((-F.lit(35.7) * 365).cast("int").alias("t")))
    assert r.t == -13030


def test_clip_lower_null(spark):
    r = one(spark.range(1).select(clip_lower(F.lit(None).cast(T.DoubleType())).alias("c")))
    assert r.c is None


def test_val1_explicit_null_rejected_absent_defaulted(spark, tmp_path):
    from riskmart.sources.readers import read_applicants
    p = tmp_path / "req.json"
    p.write_text('{"applicant_id": 1, "name": "A", "age": "30", "monthly_income": 1000, '
                 '"loan_amount": 5000, "gender": null}\n'
                 '{"applicant_id": 2, "name": "B", "age": 30, "monthly_income": "1000", '
                 '"loan_amount": 5000, "region_rating": "2"}\n')
    rows = {r.applicant_id: r for r in VA.prepare_requests(read_applicants(spark, str(p))).collect()}
    assert rows[1].violations == ["gender:null"]
    assert rows[2].violations == [] and rows[2].gender == "M" and rows[2].region_rating == 2


def test_multiline_json_requests(spark, tmp_path):
    from riskmart.sources.readers import read_applicants
    p = tmp_path / "reqs.json"
    p.write_text('[{"applicant_id": 1, "name": "A", "age": 30, "monthly_income": 1000,\n'
                 '  "loan_amount": 5000},\n {"applicant_id": 2, "name": "B", "age": "17",\n'
                 '  "monthly_income": 1000, "loan_amount": 5000}]')
    rows = {r.applicant_id: r for r in
            VA.prepare_requests(read_applicants(spark, str(p), multiline=True)).collect()}
    assert rows[1].violations == [] and rows[2].violations == ["age:min"]


def test_csv_columns_are_found_by_name(spark, tmp_path):
    from riskmart.sources import readers as RD
    path = str(tmp_path / "p.csv")
    with open(path, "w") as f:
        f.write("SK_ID_PREV,SK_ID_CURR,NOTE,AMT_ANNUITY,DAYS_DECISION,NAME_CONTRACT_STATUS,AMT_CREDIT\n"
                "9007199254740993,1,x,12.5,-1180.0,Approved,NaN\n7,2.0,y,,bad,Refused,100\n")
    rows = {r.SK_ID_CURR: r for r in RD.read_previous_applications(spark, path).collect()}
    assert rows[1].SK_ID_PREV == 9007199254740993 and rows[1].DAYS_DECISION == -1180 and rows[1].AMT_CREDIT is None
    assert rows[2].SK_ID_PREV == 7 and rows[2].DAYS_DECISION is None and rows[2].AMT_ANNUITY is None
    assert "NOTE" not in rows[1].asDict()
    bad = RD.bad_cells(spark, path, RD.PREVIOUS_SCHEMA).collect()
    assert [(r.column, r.n) for r in bad] == [("DAYS_DECISION", 1)]
    got = RD.ingest_csv(spark, path, RD.PREVIOUS_SCHEMA, str(tmp_path / "rows"), ("SK_ID_PREV",), further=True)
    assert got.counts == {"n_rows": 2, "n_bad_rows": 1, "n_bad_cells": 1}
    assert [tuple(r) for r in got.rejected.collect()] == [(7, "DAYS_DECISION", "bad", "7,2.0,y,,bad,Refused,100")]
    assert {r.NOTE for r in got.rows.collect()} == {"x", "y"}
    plain = RD.read_previous_applications(spark, path)
    assert sorted(map(str, got.rows.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    with open(str(tmp_path / "none.csv"), "w") as f:
        f.write("SK_ID_PREV,SK_ID_CURR,NOTE,AMT_ANNUITY,DAYS_DECISION,NAME_CONTRACT_STATUS,AMT_CREDIT\n")
    none = RD.ingest_csv(spark, str(tmp_path / "none.csv"), RD.PREVIOUS_SCHEMA, str(tmp_path / "no-rows"), further=True)
    assert none.counts == {"n_rows": 0, "n_bad_rows": 0, "n_bad_cells": 0} and none.rejected.count() == 0
    with open(str(tmp_path / "q.csv"), "w") as f:
        f.write("SK_ID_PREV,SK_ID_CURR\n1,2\n")
    with pytest.raises(ValueError, match="NAME_CONTRACT_STATUS"):
        RD.read_previous_applications(spark, str(tmp_path / "q.csv"))


def test_further_columns_stay_features(spark, tmp_path):
    from riskmart.schemas import APPLICATION_SCHEMA
    from riskmart.sources import readers as RD
    names = [f.name for f in APPLICATION_SCHEMA.fields]
    path = str(tmp_path / "a.csv")
    with open(path, "w") as f:
        f.write(",".join(["OWN_CAR_AGE", "WALLSMATERIAL_MODE", *names]) + "\n" + "3.5,Panel," + ",".join("1" for _ in names) + "\n")
    df = RD.read_applications(spark, path)
    assert df.columns[-2:] == ["OWN_CAR_AGE", "WALLSMATERIAL_MODE"]
    assert dict(df.dtypes)["OWN_CAR_AGE"] == "double" and dict(df.dtypes)["WALLSMATERIAL_MODE"] == "string"


@pytest.mark.parametrize("value", ["NaN", "Infinity", "-Infinity", "1e20", "abc"])
def test_odd_amounts_are_rejected_and_harm_no_other(spark, tmp_path, value):
    import json
    from riskmart.sources.readers import read_applicants
    from riskmart.streaming.scoring import decide_batch
    good = {"applicant_id": 1, "name": "A", "age": "35", "monthly_income": "50000", "loan_amount": "500000"}
    lines = [json.dumps(good), json.dumps({**good, "applicant_id": 2, "monthly_income": value}),
             json.dumps({**good, "applicant_id": 3, "loan_amount": value}), json.dumps({**good, "applicant_id": "x7"}), "{broken"]
    (tmp_path / "r.json").write_text("\n".join(lines))
    decided, rejected = decide_batch(read_applicants(spark, str(tmp_path / "r.json")))
    assert [r.applicant_id for r in decided.collect()] == [1]
    rows = {r["_request"]: r.violations for r in rejected.collect()}
    assert set(rows) == set(lines[1:])
    assert "applicant_id:type" in rows[lines[3]] and "request:json" in rows[lines[4]]


def test_stream_survives_an_odd_request(spark, tmp_path):
    import json
    from riskmart.streaming.scoring import score_stream
    good = {"applicant_id": 1, "name": "A", "age": "35", "monthly_income": "50000", "loan_amount": "500000"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.json").write_text("\n".join([json.dumps(good), json.dumps({**good, "loan_amount": "NaN"}), "no json"]))
    score_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), str(tmp_path / "rej")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    assert {r["_request"] for r in spark.read.parquet(str(tmp_path / "rej")).collect()} == {json.dumps({**good, "loan_amount": "NaN"}), "no json"}


def test_nan_breaks_every_limit(spark):
    from conftest import applicant
    from riskmart.operators import validation as VA
    row = VA.prepare_requests(applicant(spark, monthly_income=float("nan"), ext1=float("nan"))).first()
    assert {"monthly_income:min", "monthly_income:max", "ext1:min", "ext1:max"} <= set(row.violations)

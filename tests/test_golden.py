"""Golden rows: hand-derived values of the scorecard, decision and pricing
rules (FIXTURES.md section 3)."""

import pytest
from pyspark.sql import functions as F

from conftest import applicant, one
from riskmart.operators import decision as DC
from riskmart.operators import features as FE
from riskmart.operators import scorecard as SC
from riskmart.streaming.scoring import decide_batch


def card(spark, **over):
    return one(SC.grades_verdicts(SC.scorecard(FE.enrich(applicant(spark, **over)))))


def test_example_applicant(spark):
    r = card(spark)
    assert (r.ext_source_score, r.repayment_history, r.income_stability, r.debt_to_income,
            r.employment_status) == (22.5, 10.0, 20.0, 15.0, 8.0)
    assert r.score == 75.5 and r.grade == "B" and r.verdict == "LIKELY ELIGIBLE"
    assert r.ext_source_score_detail == "Good (0.60)"
    assert r.repayment_history_detail == "3.0 yrs employment, realty=N"
    assert r.income_stability_detail == "Stable (36 months)"
    assert r.debt_to_income_detail == "Low DTI (16.7%)"
    assert r.employment_status_detail == "Employed (working)"
    cib = one(FE.enrich(applicant(spark)).select(DC.cibil(F.col("ext_source_mean")).alias("a"),
                                                 DC.cibil(F.col("ext_source_mean"), "round").alias("b")))
    assert (cib.a, cib.b) == (660, 660)


def test_example_strengths_and_risks(spark):
    df = FE.enrich(applicant(spark)).withColumn("p", F.lit(0.1))
    r = one(DC.ml_columns(df))
    assert r.ml_key_strengths == ["Strong external credit score", "Stable employment (3.0 yrs)",
                                  "High annual income"]
    assert r.ml_key_risks == ["No major risk factors identified"]


def test_all_best_and_all_worst(spark):
    best = card(spark, ext1=0.72, ext2=0.72, ext3=0.72, employment_months=60, own_realty="Y",
                income_type="Pensioner", loan_amount=600000.0, tenure_months=60,
                monthly_income=50000.0)
    assert best.score == 100.0 and best.grade == "A"
    worst = card(spark, ext1=0.39, ext2=0.39, ext3=0.39, employment_months=5, own_realty="N",
                 income_type="Unemployed", loan_amount=1503000.0, tenure_months=60,
                 monthly_income=50000.0)
    assert worst.score == 0.0 and worst.grade == "D" and worst.verdict == "LIKELY NOT ELIGIBLE"


@pytest.mark.parametrize("months,points", [(37, 20.0), (36, 20.0), (35, 14.0), (12, 14.0), (11, 8.0), (6, 8.0), (5, 0.0), (0, 0.0)])
def test_tenure_edges(spark, months, points):
    assert card(spark, employment_months=months).income_stability == points


@pytest.mark.parametrize("mean,points", [(0.701, 30.0), (0.7, 30.0), (0.699, 22.5), (0.55, 22.5), (0.549, 13.5), (0.4, 13.5), (0.399, 0.0)])
def test_ext_edges(spark, mean, points):
    df = spark.createDataFrame([(mean, 0.0, "N", 0, 1.0, "")],
                               "ext_source_mean double, employment_years double, own_realty string, "
                               "employment_months int, annuity_income_ratio double, income_type string")
    assert one(SC.scorecard(df)).ext_source_score == points


@pytest.mark.parametrize("dti,points", [(0.20, 15.0), (0.35, 9.75), (0.50, 4.5), (0.5001, 0.0)])
def test_dti_edges(spark, dti, points):
    df = spark.createDataFrame([(0.5, 0.0, "N", 0, dti, "")],
                               "ext_source_mean double, employment_years double, own_realty string, "
                               "employment_months int, annuity_income_ratio double, income_type string")
    assert one(SC.scorecard(df)).debt_to_income == points


@pytest.mark.parametrize("p,dec,conf", [(0.35, "REJECTED", 35.0), (0.22, "CONDITIONAL", 22.0),
                                        (0.20, "APPROVED", 80.0), (0.1, "APPROVED", 90.0),
                                        (0.25, "CONDITIONAL", 25.0), (0.5, "REJECTED", 50.0)])
def test_decision_and_confidence(spark, p, dec, conf):
    r = one(DC.ml_columns(FE.enrich(applicant(spark)).withColumn("p", F.lit(p))))
    assert r.ml_decision == dec and r.ml_confidence == conf
    assert (r.ml_conditions == []) == (dec == "REJECTED")


def test_pricing(spark):
    r = one(DC.ml_columns(FE.enrich(applicant(spark, monthly_income=50000.0)).withColumn("p", F.lit(0.1))))
    assert r.ml_max_eligible_amount == 500000 and r.ml_suggested_interest_rate == "9.7%"
    assert r.ml_estimated_emi == 10550
    assert r.ml_officer_note == ("Applicant has a 10.0% estimated default probability. "
                                 "Application meets lending criteria.")
    low = one(DC.ml_columns(FE.enrich(applicant(spark, monthly_income=5000.0)).withColumn("p", F.lit(0.6))))
    assert low.ml_max_eligible_amount == 90000 and low.ml_suggested_interest_rate == "15.7%"
    mid = one(DC.ml_columns(FE.enrich(applicant(spark)).withColumn("p", F.lit(0.5))))
    assert mid.ml_suggested_interest_rate == "14.5%"


def test_zero_income(spark):
    df = FE.enrich(applicant(spark, monthly_income=0.0)).withColumn("p", F.lit(0.1))
    r = one(DC.ml_columns(df).withColumn("dti", DC.dti()))
    assert r.ml_max_eligible_amount == 0 and r.ml_estimated_emi == 0
    assert abs(r.dti - 8333.333333333334) < 1e-9


def test_fallback(spark):
    r = one(DC.fallback_columns(applicant(spark, loan_amount=500001.0)))
    assert (r.ml_decision, r.ml_max_eligible_amount, r.ml_estimated_emi, r.ml_suggested_interest_rate) == \
        ("CONDITIONAL", 250000, 10000, "12.0%")


def test_nested_response_shape(spark):
    dec, rej = decide_batch(applicant(spark), scorer="fallback")
    r = one(dec)
    assert r.pre_screening.path == [c for c, _ in SC.SCORE_WEIGHTS]
    assert r.pre_screening.weights["ext_source_score"] == 30
    assert r.pre_screening.results["income_stability"].earned == 20.0
    assert r.ml_result.key_risks == ["ML Model binary not loaded"]
    assert rej.count() == 0


def test_validation_rejects(spark):
    from riskmart.operators import validation as VA
    bad = applicant(spark, age=17.0, loan_amount=500.0, ext1=1.2, name=None)
    r = one(VA.prepare_requests(bad))
    assert set(r.violations) == {"name:required", "age:min", "loan_amount:min", "ext1:max"}
    form = one(VA.prepare_requests(applicant(spark, age=75.0, gender="X"), profile="form"))
    assert set(form.violations) == {"age:max", "gender:option"}


def test_normalisation(spark):
    from riskmart.operators import validation as VA
    df = applicant(spark, name="", children=3, family_members=2, income_type="Unemployed")
    r = one(VA.normalise(df, "form"))
    assert (r.name, r.family_members, r.occupation) == ("Applicant", 4, "Unknown")
    yrs = spark.createDataFrame([(2.5, False), (0.1, True)], "employment_years double, irregular_tenure boolean")
    got = [x.m for x in yrs.select(VA.months_from_years("employment_years").alias("m")).collect()]
    assert got == [30, 1]
    out = VA.normalise(yrs.withColumn("name", F.lit("a")).withColumn("employment_months", F.lit(1)), "browser")
    assert [x.employment_months for x in out.collect()] == [30, 0]
    txt = spark.createDataFrame([("12.5",), ("abc",), (None,)], "v string")
    assert [x.n for x in txt.select(VA.number_or_zero("v").alias("n")).collect()] == [12.5, 0.0, 0.0]


def test_mean_of_three_edge_follows_float_arithmetic(spark):
    # (0.7 + 0.7 + 0.7) / 3 is just below 0.7 in binary floating point, so
    # the rule gives the "Good" band, exactly as the reference computes it.
    assert card(spark, ext1=0.7, ext2=0.7, ext3=0.7).ext_source_score == 22.5


def test_no_strengths_text(spark):
    df = FE.enrich(applicant(spark, ext1=0.45, ext2=0.45, ext3=0.45, employment_months=18,
                             monthly_income=20000.0, loan_amount=600000.0, tenure_months=60,
                             own_realty="N")).withColumn("p", F.lit(0.1))
    r = one(DC.ml_columns(df))
    assert r.ml_key_strengths == ["No major strengths identified"]
    assert r.ml_key_risks == ["High Debt-to-Income (DTI) ratio (50.0%)"]   # 600000 < 4 x 240000


def test_t21_request_features_parity_switch(spark):
    df = applicant(spark, children=2, family_members=2)
    par = one(FE.request_features(df, parity=True))
    new = one(FE.request_features(df, parity=False))
    assert par.CHILDREN_RATIO == 1.0                  # children / max(family, 1)
    assert abs(new.CHILDREN_RATIO - 2 / 3) < 1e-15    # children / (family + 1), as in training
    assert "DAYS_EMPLOYED" not in par.asDict() and new.DAYS_EMPLOYED == new.DAYS_EMPLOYMENT
    assert new.INCOME_PER_PERSON == 600000.0 / 3


def test_t16_score_display_form_and_browser(spark):
    df = spark.createDataFrame([(82.5,), (75.5,), (100.0,)], "score double")
    got = [(r.f, r.b) for r in df.select(SC.score_text(F.col("score")).alias("f"),
                                         SC.score_text(F.col("score"), "browser").alias("b")).collect()]
    assert got == [("82", "83"), ("76", "76"), ("100", "100")]


# Worked by hand: stability of the repayment criterion by years in work and own home.
@pytest.mark.parametrize("months,home,points", [(60, "Y", 25.0), (60, "N", 15.0), (59, "N", 10.0), (24, "N", 10.0), (23, "N", 5.0),
                                                (12, "N", 5.0), (11, "N", 0.0), (11, "Y", 10.0), (24, "Y", 20.0)])
def test_repayment_edges(spark, months, home, points):
    assert card(spark, employment_months=months, own_realty=home).repayment_history == points


# Worked by hand: annual income 600,000; the limit is five incomes, less 1.5 p, at least 0.3 of it.
@pytest.mark.parametrize("p,amount,rate", [(0.0, 3000000, "8.5%"), (0.1, 2550000, "9.7%"), (0.2, 2100000, "10.9%"), (0.6, 900000, "15.7%"),
                                           (1.0, 900000, "20.5%")])
def test_limit_and_rate_by_probability(spark, p, amount, rate):
    r = one(DC.ml_columns(FE.enrich(applicant(spark, loan_amount=9000000.0)).withColumn("p", F.lit(p))))
    assert (r.ml_max_eligible_amount, r.ml_suggested_interest_rate) == (amount, rate)


# Worked by hand: each risk just inside and just outside its limit (income 50,000 a month, 60 months).
@pytest.mark.parametrize("over,code", [({"ext1": 0.39, "ext2": 0.39, "ext3": 0.39}, "ext"), ({"employment_months": 11}, "employment"),
                                       ({"loan_amount": 1200001.0}, "dti"), ({"children": 3}, "children"),
                                       ({"loan_amount": 2400001.0, "tenure_months": 360}, "credit")])
def test_risk_edges(spark, over, code):
    codes = lambda **o: one(FE.enrich(applicant(spark, **o)).select(DC.reason_codes("risk").alias("c"))).c
    inside = {"ext1": 0.41, "ext2": 0.41, "ext3": 0.41, "employment_months": 12, "loan_amount": 1200000.0, "children": 2}
    assert codes(**over) == [code]
    assert codes(**{k: inside.get(k, v) for k, v in over.items()}) == ["none"]

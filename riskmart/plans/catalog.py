"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query reads the driver's test tables through the lending adapter and
runs whole tables through one or more operators.  Double outputs are rounded
half-even to a fixed number of decimals (same rule in ``plans.oracle``) so
that summation order does not show in the value hash.
"""

from __future__ import annotations

from functools import reduce as _reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmart.functions.nulls import row_mean
from riskmart.operators import decision as DC
from riskmart.operators import features as FE
from riskmart.operators import metrics as ME
from riskmart.operators import models as MD
from riskmart.operators import prep as PR
from riskmart.operators import rollups as RU
from riskmart.operators import scorecard as SC
from riskmart.operators import validation as VA
from riskmart.operators.profile import profile_tables
from riskmart.schemas import APPLICATION_SCHEMA, BUREAU_SCHEMA, MART_CATEGORICAL
from riskmart.session import scratch_path
from riskmart.sources import readers as RD
from riskmart.sources.adapter import LendingTables

REGISTRY: dict = {}
ROUNDING: dict[str, dict[str, int]] = {}


def register(name: str, digits: dict[str, int] | None = None):
    def deco(fn):
        REGISTRY[name] = fn
        ROUNDING[name] = digits or {}
        return fn
    return deco


def rounded(c: str, digits: int):
    """Up to six digits are reached by way of whole numbers with three more:
    the order of a sum moves a value by far less, so a mean that lies on a
    tie rounds (up) alike in any engine.  Beyond six: half-even."""
    if digits > 6:
        return F.bround(F.col(c), digits)
    return F.floor((F.rint(F.col(c) * 10.0 ** (digits + 3)) + 500) / 1000) / 10.0 ** digits


def finish(name: str, df: DataFrame) -> DataFrame:
    """Apply the query's rounding spec."""
    return df.withColumns({c: rounded(c, d) for c, d in ROUNDING.get(name, {}).items()})


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(name, REGISTRY[name](spark, sf_dir))


def _t(spark, sf_dir) -> LendingTables:
    return LendingTables(spark, sf_dir)


def _doubles(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]


# ---------------------------------------------------------------- profiles
@register("profile_application", {"target_mean": 9})
def q_profile_application(spark, sf_dir):
    return profile_tables(_t(spark, sf_dir))


# ---------------------------------------------------------------- rollups
BUREAU_DIGITS = {"BUREAU_CREDIT_SUM": 4, "BUREAU_CREDIT_SUM_DEBT": 4,
                 "BUREAU_AVG_DAYS_CREDIT": 6}
PREVIOUS_DIGITS = {"PREV_AMT_CREDIT_MEAN": 6, "PREV_AMT_ANNUITY_MEAN": 6,
                   "PREV_DAYS_DECISION_MEAN": 6, "PREV_APPROVAL_RATE": 9}
INSTALLMENT_DIGITS = {"INST_PAYMENT_DIFF_MEAN": 4, "INST_PAYMENT_DIFF_SUM": 4,
                      "INST_DAYS_PAST_DUE_MEAN": 6}
POS_DIGITS = {"POS_MONTHS_BALANCE_MEAN": 6, "POS_CNT_INSTALMENT_MEAN": 6,
              "POS_SK_DPD_MEAN": 6, "POS_SK_DPD_DEF_MEAN": 6}
MART_DIGITS = {**BUREAU_DIGITS, **PREVIOUS_DIGITS, **INSTALLMENT_DIGITS, **POS_DIGITS}


@register("rollup_bureau", BUREAU_DIGITS)
def q_rollup_bureau(spark, sf_dir):
    return RU.rollup_bureau(_t(spark, sf_dir).bureau())


@register("rollup_previous", PREVIOUS_DIGITS)
def q_rollup_previous(spark, sf_dir):
    return RU.rollup_previous(_t(spark, sf_dir).previous_application())


@register("rollup_installments", INSTALLMENT_DIGITS)
def q_rollup_installments(spark, sf_dir):
    return RU.rollup_installments(_t(spark, sf_dir).installments_payments())


@register("rollup_pos_cash", POS_DIGITS)
def q_rollup_pos_cash(spark, sf_dir):
    return RU.rollup_pos_cash(_t(spark, sf_dir).pos_cash_balance())


@register("feature_mart", MART_DIGITS)
def q_feature_mart(spark, sf_dir):
    return RU.mart_from_tables(_t(spark, sf_dir))


FEATURE_DIGITS = {**MART_DIGITS, **{c: 9 for c in FE.MART_FEATURES}, "INCOME_PER_PERSON": 6,
                  "BUREAU_DEBT_RATIO": 9}


@register("engineered_features", FEATURE_DIGITS)
def q_engineered_features(spark, sf_dir):
    mart = RU.mart_from_tables(_t(spark, sf_dir))
    return FE.engineer_features(mart, "mart").select(
        "SK_ID_CURR", *RU.ROLLUP_COLS, *FE.MART_FEATURES, "BUREAU_DEBT_RATIO")


COMPARE_DIGITS = {**{c: 9 for c in FE.COMPARE_FEATURES}, "INCOME_PER_PERSON": 6}


@register("compare_features", COMPARE_DIGITS)
def q_compare_features(spark, sf_dir):
    return FE.compare_frame(_t(spark, sf_dir).application())


# ---------------------------------------------------------------- requests


def scoring_base(spark, sf_dir) -> DataFrame:
    """Valid applicant requests (defaults filled), enriched with the helper
    values the scorecard and the decision read."""
    return FE.enrich(VA.valid_requests(_t(spark, sf_dir).applicants()))


@register("applicant_violations")
def q_applicant_violations(spark, sf_dir):
    checked = VA.prepare_requests(_t(spark, sf_dir).applicants())
    return checked.select("applicant_id", F.explode(VA.VIOLATIONS).alias("rule"))


@register("form_violations")
def q_form_violations(spark, sf_dir):
    checked = VA.prepare_requests(_t(spark, sf_dir).applicants(), profile="form")
    return checked.select("applicant_id", F.explode(VA.VIOLATIONS).alias("rule"))


@register("browser_violations")
def q_browser_violations(spark, sf_dir):
    checked = VA.prepare_requests(_t(spark, sf_dir).applicants(), profile="browser")
    return checked.select("applicant_id", F.explode(VA.VIOLATIONS).alias("rule"))


@register("applicant_split")
def q_applicant_split(spark, sf_dir):
    checked = VA.prepare_requests(_t(spark, sf_dir).applicants())
    n = F.size(VA.VIOLATIONS)
    return checked.select("applicant_id",
                          F.when(n == 0, "valid").otherwise("rejected").alias("status"),
                          n.cast("int").alias("n_violations"))


@register("normalised_forms", {"income_number": 2})
def q_normalised_forms(spark, sf_dir):
    """NRM-2, 3 and 6 on what a form sends: tenure as years, the flag of an
    irregular tenure, amounts as text that need not be a number."""
    a = _t(spark, sf_dir).applicants().withColumn("employment_years", F.col("employment_months") / 12)
    a = a.withColumn("irregular_tenure", F.col("applicant_id") % 6 == 0)
    text = F.when(F.col("applicant_id") % 11 == 0, F.lit("about")).otherwise(F.col("monthly_income").cast("string"))
    form, browser = (VA.normalise(a, mode).select("applicant_id", F.col("employment_months").alias(f"months_{mode}"))
                     for mode in ("form", "browser"))
    return (form.join(browser, "applicant_id")
            .join(a.select("applicant_id", VA.number_or_zero(text).alias("income_number")), "applicant_id"))


@register("normalised_applicants")
def q_normalised_applicants(spark, sf_dir):
    df = VA.normalise(VA.fill_defaults(_t(spark, sf_dir).applicants()), mode="form")
    return df.select("applicant_id", "name", "family_members", "occupation", "employment_months")


REQUEST_DIGITS = {"CREDIT_INCOME_RATIO": 9, "ANNUITY_INCOME_RATIO": 9, "AMT_ANNUITY": 6,
                  "EMPLOYMENT_YEARS": 9, "EXT_SOURCE_MEAN": 9, "CHILDREN_RATIO": 9,
                  "CREDIT_TERM": 9, "AGE_YEARS": 9}


@register("request_features", REQUEST_DIGITS)
def q_request_features(spark, sf_dir):
    return FE.request_features(scoring_base(spark, sf_dir), parity=True)


@register("logit_probability", {"logit": 9, "p": 9})
def q_logit_probability(spark, sf_dir):
    return SC.applicant_logit(scoring_base(spark, sf_dir)).select("applicant_id", "logit", "p")


@register("scorecard")
def q_scorecard(spark, sf_dir):
    return SC.scorecard(scoring_base(spark, sf_dir), with_details=False).select(
        "applicant_id", *SC.CRITERIA, "score")


@register("scorecard_long", {"pct": 9})
def q_scorecard_long(spark, sf_dir):
    scored = SC.scorecard(scoring_base(spark, sf_dir), with_details=False)
    return SC.criteria_long(scored).select("applicant_id", "step", "criterion", "title", "earned",
                                           "max_points", "pct", "status")


@register("grades_verdicts")
def q_grades_verdicts(spark, sf_dir):
    scored = SC.scorecard(scoring_base(spark, sf_dir), with_details=False)
    return SC.grades_verdicts(scored).select("applicant_id", "score", "grade", "verdict",
                                             "verdict_text")


def scored_requests(spark, sf_dir) -> DataFrame:
    """Valid requests with the closed-form default probability ``p``."""
    return SC.applicant_logit(scoring_base(spark, sf_dir))


@register("decisions")
def q_decisions(spark, sf_dir):
    p = F.col("p")
    dec = DC.decision(p)
    return scored_requests(spark, sf_dir).select(
        "applicant_id", dec.alias("decision"), DC.confidence(dec, p).alias("confidence"),
        DC.prob_default_pct(p).alias("prob_default"))


@register("pricing", {"dti": 9})
def q_pricing(spark, sf_dir):
    p = F.col("p")
    raw = DC.max_loan(p)
    r = DC.rate(p)
    return scored_requests(spark, sf_dir).select(
        "applicant_id",
        DC.round_even(raw, 0).cast("bigint").alias("max_eligible_amount"),
        r.alias("interest_rate"),
        F.concat(DC.py_float_text(r), F.lit("%")).alias("suggested_interest_rate"),
        DC.round_even(DC.emi(raw, r, F.col("tenure_months")), 0).cast("bigint").alias("estimated_emi"),
        DC.dti().alias("dti"))


@register("reasons_long")
def q_reasons_long(spark, sf_dir):
    return DC.reasons_long(scored_requests(spark, sf_dir))


@register("risk_bands", {"dti_pct": 1})
def q_risk_bands(spark, sf_dir):
    pct = DC.prob_default_pct(F.col("p"))
    dti_pct = DC.round_even(DC.dti() * 100, 1)
    return scored_requests(spark, sf_dir).select(
        "applicant_id", pct.alias("prob_pct"), DC.risk_band(pct).alias("risk_band"),
        dti_pct.alias("dti_pct"), DC.dti_flag(dti_pct).alias("dti_flag"))


@register("cibil")
def q_cibil(spark, sf_dir):
    m = F.col("ext_source_mean")
    browser = DC.cibil(m, "round")
    return scoring_base(spark, sf_dir).select(
        "applicant_id", DC.cibil(m, "truncate").alias("cibil_form"), browser.alias("cibil_browser"),
        DC.cibil_band(browser).alias("cibil_band"))


@register("fallback_decisions")
def q_fallback_decisions(spark, sf_dir):
    out = DC.fallback_columns(scoring_base(spark, sf_dir))
    return out.select("applicant_id", *[F.col(f"ml_{f}").alias(f) for f in
                                        ["decision", "confidence", "prob_default",
                                         "max_eligible_amount", "suggested_interest_rate",
                                         "estimated_emi"]])


@register("officer_notes")
def q_officer_notes(spark, sf_dir):
    out = DC.ml_columns(scored_requests(spark, sf_dir))
    return out.select("applicant_id", F.col("ml_officer_note").alias("officer_note"),
                      DC.decision_title(F.col("ml_decision")).alias("decision_title"),
                      DC.decision_title(F.col("ml_decision"), "browser").alias("browser_title"),
                      DC.confidence_label(F.col("ml_decision")).alias("confidence_label"))


@register("decision_struct")
def q_decision_struct(spark, sf_dir):
    scored = SC.scorecard(scored_requests(spark, sf_dir), with_details=True)
    return DC.decide(scored, has_model=True)


@register("response_rows")
def q_response_rows(spark, sf_dir):
    """DEC-17, SCR-7 and SCR-8 as flat rows: the nested response read back."""
    return DC.response_rows(q_decision_struct(spark, sf_dir))


# ---------------------------------------------------------------- prep

MART_COLUMNS = ([f.name for f in APPLICATION_SCHEMA.fields] + RU.ROLLUP_COLS + FE.MART_FEATURES
                + ["BUREAU_DEBT_RATIO"])
MODEL_FEATURES = [c for c in MART_COLUMNS if c not in ("SK_ID_CURR", "TARGET")]


def engineered_mart(spark, sf_dir, materialize: bool = False) -> DataFrame:
    """The mart with FE-1..14; ``materialize`` cuts its lineage in the shared
    checkpoint folder when several jobs read it (codes, medians, imputation)."""
    from riskmart.session import materialize as _materialize
    eng = FE.engineer_features(RU.mart_from_tables(_t(spark, sf_dir)), "mart")
    return _materialize(eng, "feature-mart") if materialize else eng


def encoded_mart(spark, sf_dir) -> DataFrame:
    mart = engineered_mart(spark, sf_dir, materialize=True)
    return PR.encode(mart, PR.fit_label_codes(mart, MART_CATEGORICAL), MART_CATEGORICAL)[0]


@register("label_codes")
def q_label_codes(spark, sf_dir):
    return PR.fit_label_codes(_t(spark, sf_dir).application(), MART_CATEGORICAL)


@register("encoded_application")
def q_encoded_application(spark, sf_dir):
    app = _t(spark, sf_dir).application()
    return PR.encode(app, PR.fit_label_codes(app, MART_CATEGORICAL), MART_CATEGORICAL)[0]


@register("medians", {"median": 6})
def q_medians(spark, sf_dir):
    return PR.median_table(encoded_mart(spark, sf_dir), MODEL_FEATURES, exact=True)


@register("imputed_application", {c: MART_DIGITS.get(c, 6) for c in MODEL_FEATURES})
def q_imputed_application(spark, sf_dir):
    enc = encoded_mart(spark, sf_dir)
    meds = PR.fit_medians(enc, MODEL_FEATURES)
    return PR.impute(enc, meds).select("SK_ID_CURR", "TARGET", *[c for c in MODEL_FEATURES
                                                                 if meds.get(c) is not None])


@register("split_sizes")
def q_split_sizes(spark, sf_dir):
    app = _t(spark, sf_dir).application()
    sizes = PR.split_sizes(app)
    alloc = spark.createDataFrame([(int(k), int(v[1]), int(v[2])) for k, v in sizes.items()],
                                  "TARGET int, n_train bigint, n_test bigint")
    return PR.class_counts(app).join(F.broadcast(alloc), "TARGET")   # one row per class


@register("stratified_split")
def q_stratified_split(spark, sf_dir):
    app = _t(spark, sf_dir).application().select("SK_ID_CURR", "TARGET")
    return PR.stratified_split(app)


@register("class_weights", {"balanced_weight": 9, "pos_weight": 9})
def q_class_weights(spark, sf_dir):
    return PR.class_weight_table(_t(spark, sf_dir).application())


# ---------------------------------------------------------------- evaluation


SCORE_DIGITS = 12


def closed_form_scores(app: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(scorer, SK_ID_CURR, TARGET, p, *carry) for three closed-form scorers
    of the application rows: the logit formula, the rule scorecard's
    complement and the mean external score's complement."""
    keep = ["SK_ID_CURR", "TARGET", *carry]
    logit = SC.mart_logit(app).select(F.lit("logit").alias("scorer"), *keep, "p")
    card = SC.scorecard(SC.mart_request_view(app), with_details=False).select(
        F.lit("scorecard").alias("scorer"), *keep, (F.lit(1.0) - F.col("score") / 100).alias("p"))
    ext = app.select(F.lit("external").alias("scorer"), *keep,
                     (F.lit(1.0) - F.coalesce(row_mean(FE.EXT), F.lit(0.5))).alias("p"))
    parts = [logit, card, ext]
    return _reduce(DataFrame.unionByName, parts).withColumn("p", F.bround("p", SCORE_DIGITS))


@register("confusion")
def q_confusion(spark, sf_dir):
    scored = SC.mart_logit(_t(spark, sf_dir).application())
    return ME.confusion(scored)


@register("roc_auc", {"roc_auc": 12})
def q_roc_auc(spark, sf_dir):
    scores = closed_form_scores(_t(spark, sf_dir).application())
    return ME.roc_auc(scores, group_cols=("scorer",))


@register("classification_report", {"precision": 9, "recall": 9, "f1": 9})
def q_classification_report(spark, sf_dir):
    scored = SC.mart_logit(_t(spark, sf_dir).application())
    return ME.classification_report(scored)


@register("leaderboard")
def q_leaderboard(spark, sf_dir):
    app = _t(spark, sf_dir).application()
    # the split flag travels with the rows: no join back to the split
    test = closed_form_scores(PR.stratified_split(app), carry=("is_test",)).where("is_test")
    board = ME.leaderboard(ME.metrics_table(test, model_col="scorer"))
    return board


# ---------------------------------------------------------------- models

def trained(spark, sf_dir, keys=tuple(MD.COMPARISON)):
    """Prepare, fit and rank the presets, at their full budgets."""
    from riskmart.plans.training import train_and_compare
    return train_and_compare(spark, _t(spark, sf_dir), list(keys))


def _single_preset(spark, sf_dir, key):
    return trained(spark, sf_dir, (key,))[0].drop("rank", "mark")


@register("train_gbt_metrics")
def q_train_gbt_metrics(spark, sf_dir):
    return _single_preset(spark, sf_dir, "gbt_a")


@register("train_rf_metrics")
def q_train_rf_metrics(spark, sf_dir):
    return _single_preset(spark, sf_dir, "random_forest")


@register("train_lr_metrics")
def q_train_lr_metrics(spark, sf_dir):
    return _single_preset(spark, sf_dir, "logistic")


@register("train_mart_presets")
def q_train_mart_presets(spark, sf_dir):
    """MDL-1..3: the real-data trainer's presets (early-stopped main booster
    and its fallback), ranked."""
    return trained(spark, sf_dir, ("gbt_main", "gbt_fallback"))[0]


@register("compare_models")
def q_compare_models(spark, sf_dir):
    return trained(spark, sf_dir)[0]


@register("best_model_report")
def q_best_model_report(spark, sf_dir):
    from riskmart.plans.training import best_model_report
    _, path, prep = trained(spark, sf_dir)
    return best_model_report(prep, path)


@register("model_info")
def q_model_info(spark, sf_dir):
    _, path, _ = trained(spark, sf_dir)
    return MD.model_info(MD.load_model(path) if path else None)


@register("model_decisions")
def q_model_decisions(spark, sf_dir):
    from riskmart.plans.training import score_requests
    _, path, _ = trained(spark, sf_dir)
    bundle = MD.load_model(path) if path else None
    out = score_requests(_t(spark, sf_dir).applicants(), bundle)
    return out.select("applicant_id", "pre_screening.score",
                      *[F.col(f"ml_result.{f}").alias(f) for f in
                        ("decision", "confidence", "prob_default", "max_eligible_amount",
                         "suggested_interest_rate", "estimated_emi")])


# ---------------------------------------------------------------- sources, sinks, streams


def as_exported(df: DataFrame) -> DataFrame:
    """A table as another tool may export it: the columns in another order,
    one more column, whole numbers printed like -1180.0."""
    cols = [(F.col(f.name).cast("double") if isinstance(f.dataType, T.IntegerType) else F.col(f.name)).alias(f.name)
            for f in reversed(df.schema.fields)]
    return df.select(*cols[:2], F.lit("x").alias("EXPORT_NOTE"), *cols[2:])


@register("csv_rollup_bureau", BUREAU_DIGITS)
def q_csv_rollup_bureau(spark, sf_dir):
    """SRC-2 end to end: the bureau view written as CSV (missing values as
    the text NaN), read back by header names, rolled up."""
    path = scratch_path(spark, "bureau-csv")
    (as_exported(_t(spark, sf_dir).bureau()).write.option("header", True).option("nullValue", "NaN")
     .mode("overwrite").csv(path))
    return RU.rollup_bureau(RD.read_bureau(spark, path))


@register("csv_rejected_cells")
def q_csv_rejected_cells(spark, sf_dir):
    """SRC-2 with quarantine: the bureau view as CSV in which some cells hold
    no number, read in one scan; the rejected cells."""
    path = scratch_path(spark, "bureau-spoilt-csv")
    day = F.col("DAYS_CREDIT").cast("int").cast("string")
    spoilt = as_exported(_t(spark, sf_dir).bureau()).withColumns({
        "DAYS_CREDIT": F.when(F.col("SK_ID_BUREAU") % 53 == 0, F.concat(F.lit("day "), day))
        .otherwise(F.col("DAYS_CREDIT").cast("string")),
        "AMT_CREDIT_SUM": F.when(F.col("SK_ID_BUREAU") % 97 == 0, F.lit("n/a, unknown"))
        .otherwise(F.col("AMT_CREDIT_SUM").cast("string"))})
    spoilt.write.option("header", True).option("nullValue", "NaN").mode("overwrite").csv(path)
    got = RD.ingest_csv(spark, path, BUREAU_SCHEMA, scratch_path(spark, "bureau-rows"), ("SK_ID_BUREAU",))
    return got.rejected.drop("line")


@register("csv_feature_mart", MART_DIGITS)
def q_csv_feature_mart(spark, sf_dir):
    """SRC-1..5 end to end: the five lending views written as CSV files
    under their usual file names, read back by header names (text NaN
    -> NULL), rolled up and joined."""
    base = scratch_path(spark, "lending-csv")
    t = _t(spark, sf_dir)
    views = {"application": t.application(), "bureau": t.bureau(),
             "previous_application": t.previous_application(),
             "installments_payments": t.installments_payments(),
             "pos_cash_balance": t.pos_cash_balance()}
    for key, df in views.items():
        as_exported(df).write.option("header", True).mode("overwrite").csv(f"{base}/{RD.FILE_NAMES[key]}.csv")
    return RU.mart_from_tables(RD.LendingFiles(spark, base)).drop("EXPORT_NOTE")


@register("json_applicant_split")
def q_json_applicant_split(spark, sf_dir):
    """SRC-6 + VAL-2: requests as JSON text fields, read, coerced, checked."""
    from riskmart.streaming.scoring import write_requests_json
    path = scratch_path(spark, "applicants-json")
    write_requests_json(_t(spark, sf_dir).applicants(), path)
    checked = VA.prepare_requests(RD.read_applicants(spark, path))
    n = F.size(VA.VIOLATIONS)
    return checked.select("applicant_id",
                          F.when(n == 0, "valid").otherwise("rejected").alias("status"),
                          n.cast("int").alias("n_violations"))


def _run_stream(spark, sf_dir) -> str:
    """Run the scoring stream over the applicants; returns its folder."""
    from riskmart.streaming.scoring import score_stream, write_requests_json
    base = scratch_path(spark, "score-stream")
    write_requests_json(_t(spark, sf_dir).applicants(), f"{base}/in")
    q = score_stream(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint",
                     rejected_dir=f"{base}/rejected", scorer="logit")
    q.awaitTermination()
    return base


@register("stream_decisions")
def q_stream_decisions(spark, sf_dir):
    from riskmart.streaming.scoring import read_scored
    base = _run_stream(spark, sf_dir)
    out = read_scored(spark, f"{base}/out")
    return out.select("applicant_id", F.col("ml_result.decision").alias("decision"),
                      F.col("ml_result.confidence").alias("confidence"),
                      F.col("ml_result.prob_default").alias("prob_default"))


@register("stream_rejected")
def q_stream_rejected(spark, sf_dir):
    from riskmart.streaming.scoring import read_rejected
    base = _run_stream(spark, sf_dir)
    rej = read_rejected(spark, f"{base}/out", f"{base}/rejected")
    return rej.select("applicant_id", F.size(VA.VIOLATIONS).cast("bigint").alias("n_violations"))

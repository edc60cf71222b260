"""Rule scorecard (SCR-1..12) and the closed-form logit scorer (LGT-1).

The reference walks its five criteria with a best-first search whose
frontier always holds one node, so every applicant visits all five criteria
in weight order; the result is a weighted sum of five CASE expressions.
Here it is exactly that: one projection, no state, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.functions.text import render
from riskmart.schemas import CRITERION_DETAILS as D
from riskmart.schemas import (DTI_BANDS, DTI_ELSE, EMPLOYMENT_EMPLOYED, EMPLOYMENT_SELF,
                              EMPLOYMENT_SHARES, EMPLOYMENT_TOP, EXT_SOURCE_BANDS,
                              EXT_SOURCE_ELSE, GRADE_EDGES, GRADE_ELSE, INCOME_STABILITY_BANDS,
                              INCOME_STABILITY_ELSE, LOGIT_COEFFICIENTS, LOGIT_INCOME_CLIP,
                              LOGIT_INTERCEPT, REPAYMENT_REALTY_SHARE, REPAYMENT_YEAR_BANDS,
                              SCORE_INPUT_DEFAULTS, SCORE_WEIGHTS, STEP_STATUS_EDGES,
                              STEP_STATUS_ELSE, VERDICT_ELSE, VERDICTS)

CRITERIA = [name for name, _ in SCORE_WEIGHTS]
WEIGHT = dict(SCORE_WEIGHTS)


def _inputs() -> dict[str, Column]:
    d = SCORE_INPUT_DEFAULTS
    return {
        "m": F.coalesce(F.col("ext_source_mean"), F.lit(d["ext_source_mean"])),
        "years": F.coalesce(F.col("employment_years").cast("double"), F.lit(d["employment_years"])),
        "own": F.coalesce(F.col("own_realty"), F.lit(d["own_realty"])),
        "months": F.coalesce(F.col("employment_months"), F.lit(d["employment_months"])),
        "dti": F.coalesce(F.col("annuity_income_ratio"), F.lit(d["annuity_income_ratio"])) * 100,
        "it": F.lower(F.coalesce(F.col("income_type"), F.lit(d["income_type"]))),
    }


def _banded(x: Column, bands, weight: int, else_label: str, cmp: str, detail) -> tuple:
    earned, label = None, None
    for edge, share, name in bands:
        cond = x >= edge if cmp == "ge" else x <= edge
        val = F.lit(float(weight * share))
        earned = F.when(cond, val) if earned is None else earned.when(cond, val)
        label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
    return earned.otherwise(F.lit(0.0)), detail(label.otherwise(F.lit(else_label)))


def criterion_columns() -> dict[str, tuple[Column, Column]]:
    """criterion -> (earned, detail text)."""
    i = _inputs()
    out = {}
    w = WEIGHT["ext_source_score"]
    out["ext_source_score"] = _banded(
        i["m"], EXT_SOURCE_BANDS, w, EXT_SOURCE_ELSE, "ge",
        lambda lab: render(D["ext_source_score"], band=lab, mean=i["m"]))
    w = WEIGHT["repayment_history"]
    yrs = None
    for edge, share in REPAYMENT_YEAR_BANDS:
        v = F.lit(float(w * share))
        yrs = F.when(i["years"] >= edge, v) if yrs is None else yrs.when(i["years"] >= edge, v)
    sc = yrs.otherwise(F.lit(0.0)) + F.when(i["own"] == "Y", F.lit(float(w * REPAYMENT_REALTY_SHARE))
                                             ).otherwise(F.lit(0.0))
    out["repayment_history"] = (
        F.least(sc, F.lit(float(w))),
        render(D["repayment_history"], years=i["years"], own=i["own"]))
    w = WEIGHT["income_stability"]
    out["income_stability"] = _banded(
        i["months"], INCOME_STABILITY_BANDS, w, INCOME_STABILITY_ELSE, "ge",
        lambda lab: render(D["income_stability"], band=lab, months=i["months"]))
    w = WEIGHT["debt_to_income"]
    out["debt_to_income"] = _banded(
        i["dti"], DTI_BANDS, w, DTI_ELSE, "le",
        lambda lab: render(D["debt_to_income"], band=lab, dti=i["dti"]))
    w = WEIGHT["employment_status"]
    top, emp, slf = (float(w * s) for s in EMPLOYMENT_SHARES)
    it = i["it"]
    out["employment_status"] = (
        F.when(it.isin(*EMPLOYMENT_TOP), F.lit(top)).when(it.isin(*EMPLOYMENT_EMPLOYED), F.lit(emp))
         .when(it == EMPLOYMENT_SELF, F.lit(slf)).otherwise(F.lit(0.0)),
        F.when(it.isin(*EMPLOYMENT_TOP), render(D["employment_status_top"], it=it))
         .when(it.isin(*EMPLOYMENT_EMPLOYED), render(D["employment_status_employed"], it=it))
         .when(it == EMPLOYMENT_SELF, render(D["employment_status_self"]))
         .otherwise(render(D["employment_status_other"], it=it)))
    return out


def scorecard(df: DataFrame, with_details: bool = True) -> DataFrame:
    """SCR-1..6: earned points per criterion and the total ``score``.

    Expects the enriched request columns (ext_source_mean, employment_years,
    own_realty, employment_months, annuity_income_ratio, income_type)."""
    cols = criterion_columns()
    add = {name: earned for name, (earned, _) in cols.items()}
    if with_details:
        add.update({f"{name}_detail": det for name, (_, det) in cols.items()})
    out = df.withColumns(add)
    total = None
    for name in CRITERIA:
        total = F.col(name) if total is None else total + F.col(name)
    return out.withColumn("score", total)


def results_map(prefix: str = "") -> Column:
    """SCR-7/8: criterion -> (earned, max, detail) map and the constant
    path / weights."""
    return F.map_from_arrays(
        F.array(*[F.lit(c) for c in CRITERIA]),
        F.array(*[F.struct(F.col(f"{prefix}{c}").alias("earned"),
                           F.lit(WEIGHT[c]).alias("max"),
                           F.col(f"{prefix}{c}_detail").alias("detail")) for c in CRITERIA]))


def path_array() -> Column:
    return F.array(*[F.lit(c) for c in CRITERIA])


def weights_map() -> Column:
    return F.create_map(*[x for c in CRITERIA for x in (F.lit(c), F.lit(WEIGHT[c]))])


def step_status(pct: Column) -> Column:
    """SCR-10."""
    e = None
    for edge, name in STEP_STATUS_EDGES:
        e = F.when(pct >= edge, F.lit(name)) if e is None else e.when(pct >= edge, F.lit(name))
    return e.otherwise(F.lit(STEP_STATUS_ELSE))


def criteria_long(scored: DataFrame, keys=("applicant_id",)) -> DataFrame:
    """SCR-9: one row per applicant and criterion, in path order."""
    steps = F.array(*[
        F.struct(F.lit(i + 1).alias("step"), F.lit(c).alias("criterion"),
                 F.col(c).alias("earned"), F.lit(WEIGHT[c]).alias("max_points"))
        for i, c in enumerate(CRITERIA)])
    long = scored.select(*keys, F.inline(steps))
    pct = F.col("earned") / F.col("max_points") * 100
    return long.withColumns({
        "title": F.initcap(F.regexp_replace("criterion", "_", " ")),
        "pct": pct,
        "status": step_status(pct),
    })


def grade(score: Column) -> Column:
    """SCR-11."""
    e = None
    for edge, g in GRADE_EDGES:
        e = F.when(score >= edge, F.lit(g)) if e is None else e.when(score >= edge, F.lit(g))
    return e.otherwise(F.lit(GRADE_ELSE))


def verdict(score: Column) -> tuple[Column, Column]:
    """SCR-12: (verdict, sentence)."""
    v = s = None
    for edge, name, text in VERDICTS:
        cond = score >= edge
        v = F.when(cond, F.lit(name)) if v is None else v.when(cond, F.lit(name))
        s = F.when(cond, F.lit(text)) if s is None else s.when(cond, F.lit(text))
    return v.otherwise(F.lit(VERDICT_ELSE[0])), s.otherwise(F.lit(VERDICT_ELSE[1]))


def grades_verdicts(scored: DataFrame) -> DataFrame:
    v, s = verdict(F.col("score"))
    return scored.withColumns({"grade": grade(F.col("score")), "verdict": v, "verdict_text": s})


# --------------------------------------------------------------------------
# LGT-1: closed-form default probability
# --------------------------------------------------------------------------

def logit_terms(credit: Column, income: Column, annuity: Column, age: Column, emp_years: Column,
                ext1: Column, ext2: Column, ext3: Column, region: Column, income_type: Column,
                education: Column, housing: Column, children: Column) -> dict[str, Column]:
    lo, hi = LOGIT_INCOME_CLIP
    inc = F.least(F.greatest(income, F.lit(lo)), F.lit(hi))
    return {
        "ext1": ext1, "ext2": ext2, "ext3": ext3,
        "credit_income": credit / inc,
        "annuity_income": annuity / inc,
        "age_years": age,
        "employment_years": emp_years,
        "region_is_3": (region == 3).cast("double"),
        "is_unemployed": (income_type == "Unemployed").cast("double"),
        "is_higher_education": (education == "Higher education").cast("double"),
        "lives_with_parents": (housing == "With parents").cast("double"),
        "children": children.cast("double"),
    }


def logit(terms: dict[str, Column]) -> Column:
    z = F.lit(LOGIT_INTERCEPT)
    for name, coef in LOGIT_COEFFICIENTS:
        z = z + F.lit(coef) * terms[name]
    return z


def probability(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def applicant_logit(df: DataFrame) -> DataFrame:
    """LGT-1 over (defaulted) applicant requests: adds ``logit`` and ``p``."""
    credit = F.col("loan_amount")
    terms = logit_terms(
        credit, F.col("monthly_income") * 12, credit / F.greatest(F.col("tenure_months"), F.lit(1)),
        F.col("age"), F.col("employment_months") / 12, F.col("ext1"), F.col("ext2"), F.col("ext3"),
        F.col("region_rating"), F.col("income_type"), F.col("education"), F.col("housing_type"),
        F.col("children"))
    z = logit(terms)
    return df.withColumn("logit", z).withColumn("p", probability(F.col("logit")))


def mart_logit(mart: DataFrame) -> DataFrame:
    """LGT-1 over application rows; a missing external score takes the
    service default 0.5, a missing annuity contributes nothing."""
    ext = [F.coalesce(F.col(c), F.lit(0.5)) for c in ("EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3")]
    days_emp = F.col("DAYS_EMPLOYED")
    emp_years = F.when(days_emp < 0, -days_emp / 365).otherwise(F.lit(0.0))
    terms = logit_terms(
        F.col("AMT_CREDIT"), F.col("AMT_INCOME_TOTAL"), F.coalesce(F.col("AMT_ANNUITY"), F.lit(0.0)),
        -F.col("DAYS_BIRTH") / 365, emp_years, *ext, F.col("REGION_RATING_CLIENT"),
        F.col("NAME_INCOME_TYPE"), F.col("NAME_EDUCATION_TYPE"), F.col("NAME_HOUSING_TYPE"),
        F.col("CNT_CHILDREN"))
    return mart.withColumn("logit", logit(terms)).withColumn("p", probability(F.col("logit")))


def mart_request_view(mart: DataFrame) -> DataFrame:
    """Application rows expressed as scorecard inputs (for scoring the
    training population with the rule scorecard)."""
    days_emp = F.col("DAYS_EMPLOYED")
    years = F.when(days_emp < 0, -days_emp / 365).otherwise(F.lit(0.0))
    ext = [F.col(c) for c in ("EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3")]
    total = ext[0].isNotNull().cast("int") + ext[1].isNotNull().cast("int") + ext[2].isNotNull().cast("int")
    s = F.coalesce(ext[0], F.lit(0.0)) + F.coalesce(ext[1], F.lit(0.0)) + F.coalesce(ext[2], F.lit(0.0))
    return mart.withColumns({
        "ext_source_mean": F.when(total > 0, s / total),
        "employment_years": years,
        "employment_months": (years * 12).cast("int"),
        "own_realty": F.col("FLAG_OWN_REALTY"),
        "annuity_income_ratio": F.col("AMT_ANNUITY") / F.greatest(F.col("AMT_INCOME_TOTAL") / 12, F.lit(1.0)),
        "income_type": F.col("NAME_INCOME_TYPE"),
    })


def score_text(score: Column, mode: str = "form") -> Column:
    """Whole-number score as displayed: the form prints half-even
    (``f"{x:.0f}"``), the browser half-up (``toFixed(0)``); 82.5 shows as 82
    and 83.  Display only: the engine keeps the unrounded score."""
    if mode == "browser":
        return F.floor(score + 0.5).cast("bigint").cast("string")
    return F.bround(score, 0).cast("bigint").cast("string")

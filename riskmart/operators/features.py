"""Feature scalars: the training mart ratios (FE-1..14), the comparison set
and the scoring-row features built from a request (SF-1..6).

All are column expressions in one projection; division uses ``try_divide``
(a zero divisor gives NULL where pandas gives +-inf).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.functions.nulls import (negative_days_to_years, row_max, row_mean, row_min,
                                      safe_div)
from riskmart.schemas import APPLICANT_DEFAULTS, GOODS_PRICE_SHARE, REQUEST_CONSTANTS

EXT = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]

MART_FEATURES = ["CREDIT_INCOME_RATIO", "ANNUITY_INCOME_RATIO", "CREDIT_TERM", "AGE_YEARS",
                 "EMPLOYMENT_YEARS", "EXT_SOURCE_MEAN", "EXT_SOURCE_MIN", "EXT_SOURCE_MAX",
                 "CHILDREN_RATIO", "INCOME_PER_PERSON", "GOODS_CREDIT_RATIO",
                 "INCOME_CREDIT_RATIO", "DAYS_EMPLOYED_PERCENT"]
COMPARE_FEATURES = ["CREDIT_INCOME_RATIO", "ANNUITY_INCOME_RATIO", "AGE_YEARS",
                    "EMPLOYMENT_YEARS", "EXT_SOURCE_MEAN", "EXT_SOURCE_MIN", "EXT_SOURCE_MAX",
                    "CHILDREN_RATIO", "INCOME_PER_PERSON", "CREDIT_TERM", "INCOME_CREDIT_RATIO"]
# 22 base columns of the comparison set (employment as DAYS_EMPLOYMENT).
COMPARE_BASE = ["CODE_GENDER", "DAYS_BIRTH", "DAYS_EMPLOYMENT", "CNT_CHILDREN",
                "CNT_FAM_MEMBERS", "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY",
                "AMT_GOODS_PRICE", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3",
                "NAME_EDUCATION_TYPE", "NAME_INCOME_TYPE", "NAME_HOUSING_TYPE",
                "NAME_FAMILY_STATUS", "FLAG_OWN_CAR", "FLAG_OWN_REALTY",
                "REGION_RATING_CLIENT", "REGION_POPULATION_RELATIVE", "OCCUPATION_TYPE",
                "ORGANIZATION_TYPE"]


def _ratio(num: str, den: str):
    return safe_div(F.col(num), F.col(den) + 1)


def mart_feature_exprs(employment_col: str = "DAYS_EMPLOYED", variant: str = "mart") -> dict:
    exprs = {
        "CREDIT_INCOME_RATIO": _ratio("AMT_CREDIT", "AMT_INCOME_TOTAL"),
        "ANNUITY_INCOME_RATIO": _ratio("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
        "CREDIT_TERM": _ratio("AMT_CREDIT", "AMT_ANNUITY"),
        "AGE_YEARS": -F.col("DAYS_BIRTH") / 365,
        "EMPLOYMENT_YEARS": negative_days_to_years(employment_col),
        "EXT_SOURCE_MEAN": row_mean(EXT),
        "EXT_SOURCE_MIN": row_min(EXT),
        "EXT_SOURCE_MAX": row_max(EXT),
        "CHILDREN_RATIO": _ratio("CNT_CHILDREN", "CNT_FAM_MEMBERS"),
        "INCOME_PER_PERSON": _ratio("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
        "GOODS_CREDIT_RATIO": _ratio("AMT_GOODS_PRICE", "AMT_CREDIT"),
        "INCOME_CREDIT_RATIO": _ratio("AMT_INCOME_TOTAL", "AMT_CREDIT"),
        "DAYS_EMPLOYED_PERCENT": safe_div(F.col(employment_col), F.col("DAYS_BIRTH") + 1),
    }
    names = MART_FEATURES if variant == "mart" else COMPARE_FEATURES
    return {k: exprs[k] for k in names}


def engineer_features(df: DataFrame, variant: str = "mart") -> DataFrame:
    """FE-1..14 on the mart (``variant='mart'``) or the 11 comparison
    features (``variant='compare'``, employment read from DAYS_EMPLOYMENT)."""
    if variant == "mart":
        out = df.withColumns(mart_feature_exprs("DAYS_EMPLOYED", "mart"))
        if "BUREAU_CREDIT_SUM" in df.columns:
            out = out.withColumn("BUREAU_DEBT_RATIO",
                                 _ratio("BUREAU_CREDIT_SUM_DEBT", "BUREAU_CREDIT_SUM"))
        return out
    if variant == "compare":
        return df.withColumns(mart_feature_exprs("DAYS_EMPLOYMENT", "compare"))
    raise ValueError(f"unknown variant {variant!r}")


def compare_frame(app: DataFrame) -> DataFrame:
    """The comparison set built from an application-shaped table: 22 base
    columns (+ id and label) and the 11 comparison features."""
    base = app.withColumns({
        "DAYS_EMPLOYMENT": F.col("DAYS_EMPLOYED"),
        "REGION_POPULATION_RELATIVE": (
            F.col("REGION_POPULATION_RELATIVE") if "REGION_POPULATION_RELATIVE" in app.columns
            else F.lit(REQUEST_CONSTANTS["REGION_POPULATION_RELATIVE"])),
        "ORGANIZATION_TYPE": (
            F.col("ORGANIZATION_TYPE") if "ORGANIZATION_TYPE" in app.columns
            else F.lit(REQUEST_CONSTANTS["ORGANIZATION_TYPE"])),
    })
    keep = [c for c in ["SK_ID_CURR", "TARGET"] if c in app.columns] + COMPARE_BASE
    return engineer_features(base.select(*keep), "compare")


# --------------------------------------------------------------------------
# Scoring row (request -> model features)
# --------------------------------------------------------------------------

def enrich(df: DataFrame) -> DataFrame:
    """ENR-1: helper values every scoring step reads."""
    return df.withColumns({
        "ext_source_mean": (F.col("ext1") + F.col("ext2") + F.col("ext3")) / 3,
        "employment_years": F.col("employment_months") / 12,
        "annuity_income_ratio": (F.col("loan_amount") / F.greatest(F.col("tenure_months"), F.lit(1)))
        / F.greatest(F.col("monthly_income"), F.lit(1.0)),
    })


def request_features(df: DataFrame, parity: bool = True, keep=("applicant_id",)) -> DataFrame:
    """SF-1..5: the model-feature row of each request.

    ``parity=True`` reproduces the scoring row exactly (CHILDREN_RATIO with
    max(family, 1), employment as DAYS_EMPLOYMENT, only the 37 keys);
    ``parity=False`` adds the mart features the row lacks (FE-1..13, with
    the training definitions) so nothing is zero-filled at alignment.
    """
    income = F.col("monthly_income") * 12
    credit = F.col("loan_amount")
    annuity = credit / F.greatest(F.col("tenure_months"), F.lit(1))
    emp_y = F.col("employment_months") / 12
    ext_mean = (F.col("ext1") + F.col("ext2") + F.col("ext3")) / 3
    d = APPLICANT_DEFAULTS
    cols = {
        "CODE_GENDER": F.coalesce(F.col("gender"), F.lit(d["gender"])),
        "DAYS_BIRTH": -(F.col("age") * 365).cast("int"),
        "DAYS_EMPLOYMENT": -(emp_y * 365).cast("int"),
        "CNT_CHILDREN": F.col("children"),
        "CNT_FAM_MEMBERS": F.col("family_members"),
        "AMT_INCOME_TOTAL": income,
        "AMT_CREDIT": credit,
        "AMT_ANNUITY": annuity,
        "AMT_GOODS_PRICE": credit * GOODS_PRICE_SHARE,
        "EXT_SOURCE_1": F.coalesce(F.col("ext1"), ext_mean),
        "EXT_SOURCE_2": F.coalesce(F.col("ext2"), ext_mean),
        "EXT_SOURCE_3": F.coalesce(F.col("ext3"), ext_mean),
        "NAME_CONTRACT_TYPE": F.lit(REQUEST_CONSTANTS["NAME_CONTRACT_TYPE"]),
        "NAME_EDUCATION_TYPE": F.col("education"),
        "NAME_INCOME_TYPE": F.col("income_type"),
        "NAME_HOUSING_TYPE": F.col("housing_type"),
        "NAME_FAMILY_STATUS": F.col("family_status"),
        "FLAG_OWN_CAR": F.col("own_car"),
        "FLAG_OWN_REALTY": F.col("own_realty"),
        "FLAG_PHONE": F.lit(REQUEST_CONSTANTS["FLAG_PHONE"]),
        "FLAG_EMAIL": F.lit(REQUEST_CONSTANTS["FLAG_EMAIL"]),
        "FLAG_WORK_PHONE": F.lit(REQUEST_CONSTANTS["FLAG_WORK_PHONE"]),
        "FLAG_DOCUMENT_3": F.lit(REQUEST_CONSTANTS["FLAG_DOCUMENT_3"]),
        "REG_CITY_NOT_WORK_CITY": F.lit(REQUEST_CONSTANTS["REG_CITY_NOT_WORK_CITY"]),
        "LIVE_CITY_NOT_WORK_CITY": F.lit(REQUEST_CONSTANTS["LIVE_CITY_NOT_WORK_CITY"]),
        "REGION_RATING_CLIENT": F.col("region_rating"),
        "REGION_RATING_CLIENT_W_CITY": F.col("region_rating"),
        "REGION_POPULATION_RELATIVE": F.lit(REQUEST_CONSTANTS["REGION_POPULATION_RELATIVE"]),
        "OCCUPATION_TYPE": F.col("occupation"),
        "ORGANIZATION_TYPE": F.lit(REQUEST_CONSTANTS["ORGANIZATION_TYPE"]),
        "CREDIT_INCOME_RATIO": credit / (income + 1),
        "ANNUITY_INCOME_RATIO": annuity / (income + 1),
        "AGE_YEARS": F.col("age"),
        "EMPLOYMENT_YEARS": emp_y,
        "EXT_SOURCE_MEAN": ext_mean,
        "CHILDREN_RATIO": F.col("children") / F.greatest(F.col("family_members"), F.lit(1)),
        "CREDIT_TERM": credit / (annuity + 1),
    }
    out = df.select(*[F.col(k) for k in keep if k in df.columns],
                    *[v.alias(k) for k, v in cols.items()])
    if not parity:
        out = out.withColumns({
            "DAYS_EMPLOYED": F.col("DAYS_EMPLOYMENT"),
            "CHILDREN_RATIO": _ratio("CNT_CHILDREN", "CNT_FAM_MEMBERS"),
            "EXT_SOURCE_MIN": row_min(EXT),
            "EXT_SOURCE_MAX": row_max(EXT),
            "INCOME_PER_PERSON": _ratio("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
            "GOODS_CREDIT_RATIO": _ratio("AMT_GOODS_PRICE", "AMT_CREDIT"),
            "INCOME_CREDIT_RATIO": _ratio("AMT_INCOME_TOTAL", "AMT_CREDIT"),
            "DAYS_EMPLOYED_PERCENT": safe_div(F.col("DAYS_EMPLOYMENT"), F.col("DAYS_BIRTH") + 1),
        })
    return out


def align_features(df: DataFrame, feature_cols: list[str], keep=()) -> DataFrame:
    """SF-6: order columns by the saved feature list; a name the row lacks
    becomes 0."""
    have = set(df.columns)
    return df.select(*[F.col(k) for k in keep if k in have],
                     *[(F.col(c) if c in have else F.lit(0.0)).alias(c) for c in feature_cols])

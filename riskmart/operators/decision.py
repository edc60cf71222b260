"""Decision, pricing and reasons (DEC-1..17).

Input: enriched applicant rows plus a default probability column ``p``
(from a fitted model via ``models.predict_default``, or the closed-form
scorer).  Every output is a column expression; ``decide`` nests them into
the service's response shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.functions.text import py_float_text, render, round_even
from riskmart.operators.scorecard import path_array, results_map, weights_map
from riskmart.schemas import (BASE_RATE, BROWSER_TITLE_PREFIX, CIBIL_BANDS, CONFIDENCE_LABELS, CIBIL_BASE, CIBIL_ELSE, CIBIL_SPAN,
                              CONDITION_TEXTS, CONDITIONAL_FACTOR, DECISION_TITLES,
                              DEFAULT_THRESHOLD, DTI_FLAG_PCT, FALLBACK, INCOME_LIMIT_MULTIPLE,
                              LIMIT_SLOPE, MIN_LIMIT_MULTIPLIER, OFFICER_NOTE_ENDINGS,
                              OFFICER_NOTE_PREFIX, RATE_SLOPE, RISK_BAND_EDGES, RISK_BAND_ELSE,
                              RISK_TEXTS, STRENGTH_TEXTS)


def _p() -> Column:
    return F.col("p")


def _income() -> Column:
    return F.col("monthly_income") * 12


def _annuity() -> Column:
    return F.col("loan_amount") / F.greatest(F.col("tenure_months"), F.lit(1))


def decision(p: Column | None = None, threshold: float = DEFAULT_THRESHOLD) -> Column:
    """DEC-1."""
    p = _p() if p is None else p
    return (F.when(p >= threshold, F.lit("REJECTED"))
             .when(p >= threshold * CONDITIONAL_FACTOR, F.lit("CONDITIONAL"))
             .otherwise(F.lit("APPROVED")))


def confidence(dec: Column, p: Column | None = None) -> Column:
    """DEC-2."""
    p = _p() if p is None else p
    return round_even(F.when(dec == "APPROVED", (1 - p) * 100).otherwise(p * 100), 1)


def prob_default_pct(p: Column | None = None) -> Column:
    """DEC-3."""
    p = _p() if p is None else p
    return round_even(p * 100, 2)


def max_loan(p: Column | None = None) -> Column:
    """DEC-4 before rounding: min(credit, income * 5 * max(0.3, 1 - 1.5 p))."""
    p = _p() if p is None else p
    mult = F.greatest(F.lit(MIN_LIMIT_MULTIPLIER), F.lit(1.0) - p * LIMIT_SLOPE)
    return F.least(F.col("loan_amount"), _income() * INCOME_LIMIT_MULTIPLE * mult)


def rate(p: Column | None = None) -> Column:
    """DEC-5: rate in percent, one decimal."""
    p = _p() if p is None else p
    return round_even(F.lit(BASE_RATE) + p * RATE_SLOPE, 1)


def emi(amount: Column, rate_pct: Column, n: Column) -> Column:
    """DEC-6: annuity instalment L*m*(1+m)^n / ((1+m)^n - 1), m = rate/1200;
    L / n when the rate is 0."""
    m = rate_pct / 100 / 12
    g = F.pow(F.lit(1.0) + m, n.cast("double"))
    return F.when(m > 0, amount * m * g / (g - 1)).otherwise(amount / n)


def dti() -> Column:
    """DEC-7: monthly instalment over monthly income (min 1)."""
    return _annuity() / F.greatest(F.col("monthly_income"), F.lit(1.0))


def _first3(items: list[Column], none_text: str) -> Column:
    arr = F.slice(F.array_compact(F.array(*items)), 1, 3)
    return F.when(F.size(arr) == 0, F.array(F.lit(none_text))).otherwise(arr)


def strength_items(ext_mean: Column, emp_y: Column, income: Column, d: Column) -> list[Column]:
    t = STRENGTH_TEXTS
    return [
        F.when(ext_mean >= 0.6, F.lit(t["ext"])),
        F.when(emp_y >= 3, render(t["employment"], years=emp_y)),
        F.when(income >= 500000, F.lit(t["income"])),
        F.when(d <= 0.3, F.lit(t["dti"])),
        F.when(F.col("own_realty") == "Y", F.lit(t["realty"])),
    ]


def risk_items(ext_mean: Column, emp_y: Column, income: Column, d: Column) -> list[Column]:
    t = RISK_TEXTS
    return [
        F.when(ext_mean < 0.4, F.lit(t["ext"])),
        F.when(emp_y < 1, F.lit(t["employment"])),
        F.when(d > 0.4, render(t["dti"], pct=d * 100)),
        F.when(F.col("loan_amount") > income * 4, F.lit(t["credit"])),
        F.when(F.col("children") >= 3, F.lit(t["children"])),
    ]


# Reason codes in list order (for the long form).
STRENGTH_CODES = ["ext", "employment", "income", "dti", "realty"]
RISK_CODES = ["ext", "employment", "dti", "credit", "children"]


def reason_codes(kind: str) -> Column:
    """Codes of the listed strengths / risks (first three, or ``none``)."""
    ext_mean, emp_y, income, d = _helpers()
    items = (strength_items if kind == "strength" else risk_items)(ext_mean, emp_y, income, d)
    codes = STRENGTH_CODES if kind == "strength" else RISK_CODES
    coded = [F.when(item.isNotNull(), F.lit(code)) for item, code in zip(items, codes)]
    return _first3(coded, "none")


def reasons_long(df: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                 keys=("applicant_id",)) -> DataFrame:
    """One row per (applicant, kind, position): strengths, risks and the
    required documents, as codes (texts with numbers stay in ``decide``)."""
    dec = decision(_p(), threshold)
    conds = F.when(dec != "REJECTED", F.array(*[F.lit(c) for c in CONDITION_TEXTS])) \
        .otherwise(F.array().cast("array<string>"))
    parts = F.array(
        F.struct(F.lit("strength").alias("kind"), reason_codes("strength").alias("codes")),
        F.struct(F.lit("risk").alias("kind"), reason_codes("risk").alias("codes")),
        F.struct(F.lit("condition").alias("kind"), conds.alias("codes")))
    by_kind = df.select(*keys, F.inline(parts))
    return by_kind.select(*keys, "kind", F.posexplode("codes").alias("pos", "reason")) \
        .select(*keys, "kind", (F.col("pos") + 1).cast("int").alias("position"), "reason")


def _helpers():
    ext_mean = (F.col("ext1") + F.col("ext2") + F.col("ext3")) / 3
    emp_y = F.col("employment_months") / 12
    return ext_mean, emp_y, _income(), dti()


def ml_columns(df: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """DEC-1..11 as flat columns (``ml_`` prefix)."""
    ext_mean, emp_y, income, d = _helpers()
    dec = decision(_p(), threshold)
    out = df.withColumns({
        "ml_decision": dec,
        "ml_max_loan_raw": max_loan(_p()),
        "ml_rate": rate(_p()),
    })
    amount_raw = F.col("ml_max_loan_raw")
    return out.withColumns({
        "ml_confidence": confidence(F.col("ml_decision")),
        "ml_prob_default": prob_default_pct(),
        "ml_max_eligible_amount": round_even(amount_raw, 0).cast("bigint"),
        "ml_suggested_interest_rate": F.concat(py_float_text(F.col("ml_rate")), F.lit("%")),
        "ml_estimated_emi": round_even(emi(amount_raw, F.col("ml_rate"), F.col("tenure_months")), 0)
        .cast("bigint"),
        "ml_key_strengths": _first3(strength_items(ext_mean, emp_y, income, d), STRENGTH_TEXTS["none"]),
        "ml_key_risks": _first3(risk_items(ext_mean, emp_y, income, d), RISK_TEXTS["none"]),
        "ml_conditions": F.when(F.col("ml_decision") != "REJECTED",
                                F.array(*[F.lit(c) for c in CONDITION_TEXTS]))
        .otherwise(F.array().cast("array<string>")),
        "ml_officer_note": F.concat(
            render(OFFICER_NOTE_PREFIX, pct=_p() * 100),
            F.when(F.col("ml_decision") == "APPROVED", F.lit(OFFICER_NOTE_ENDINGS["APPROVED"]))
             .when(F.col("ml_decision") == "CONDITIONAL", F.lit(OFFICER_NOTE_ENDINGS["CONDITIONAL"]))
             .otherwise(F.lit(OFFICER_NOTE_ENDINGS["REJECTED"]))),
    }).drop("ml_max_loan_raw")


def fallback_columns(df: DataFrame) -> DataFrame:
    """DEC-16: the response when no model is available."""
    f = FALLBACK
    amount = F.col("loan_amount")
    return df.withColumns({
        "ml_decision": F.lit(f["decision"]),
        "ml_confidence": F.lit(f["confidence"]),
        "ml_prob_default": F.lit(f["prob_default"]),
        "ml_max_eligible_amount": (amount * f["amount_share"]).cast("bigint"),
        "ml_suggested_interest_rate": F.lit(f["rate_text"]),
        "ml_estimated_emi": (amount * f["emi_share"]).cast("bigint"),
        "ml_key_strengths": F.array(*[F.lit(x) for x in f["key_strengths"]]),
        "ml_key_risks": F.array(*[F.lit(x) for x in f["key_risks"]]),
        "ml_conditions": F.array(*[F.lit(x) for x in f["conditions"]]),
        "ml_officer_note": F.lit(f["officer_note"]),
    })


ML_FIELDS = ["decision", "confidence", "prob_default", "max_eligible_amount",
             "suggested_interest_rate", "estimated_emi", "key_strengths", "key_risks",
             "conditions", "officer_note"]


def decide(df: DataFrame, has_model: bool = True, threshold: float = DEFAULT_THRESHOLD,
           keys=("applicant_id",)) -> DataFrame:
    """DEC-17: nested response rows ``(pre_screening, ml_result)``.

    Expects scorecard columns (``scorecard(with_details=True)``) and, when
    ``has_model``, the probability column ``p``."""
    flat = ml_columns(df, threshold) if has_model else fallback_columns(df)
    pre = F.struct(F.col("score").alias("score"), path_array().alias("path"),
                   results_map().alias("results"), weights_map().alias("weights"))
    ml = F.struct(*[F.col(f"ml_{f}").alias(f) for f in ML_FIELDS])
    return flat.select(*keys, pre.alias("pre_screening"), ml.alias("ml_result"))


def response_rows(responses: DataFrame, keys=("applicant_id",)) -> DataFrame:
    """Nested responses as one flat row per applicant and criterion: its place
    in the path, what ``results`` and ``weights`` hold for it, and the scalar
    fields of both parts with the sizes of the lists."""
    at = responses.select(*keys, "pre_screening", "ml_result", F.posexplode("pre_screening.path").alias("_pos", "criterion"))
    result = F.col("pre_screening.results")[F.col("criterion")]
    lists = ("key_strengths", "key_risks", "conditions")
    return at.select(
        *keys, (F.col("_pos") + 1).alias("step"), "criterion", result["earned"].alias("earned"), result["max"].alias("max_points"),
        result["detail"].alias("detail"), F.col("pre_screening.weights")[F.col("criterion")].alias("weight"), "pre_screening.score",
        *[F.col(f"ml_result.{f}").alias(f) for f in ML_FIELDS if f not in lists],
        *[F.size(f"ml_result.{f}").alias(f"n_{f}") for f in lists])


# --------------------------------------------------------------------------
# Display-layer derivations
# --------------------------------------------------------------------------

def risk_band(prob_pct: Column) -> Column:
    """DEC-12."""
    e = None
    for edge, name in RISK_BAND_EDGES:
        e = F.when(prob_pct < edge, F.lit(name)) if e is None else e.when(prob_pct < edge, F.lit(name))
    return e.otherwise(F.lit(RISK_BAND_ELSE))


def dti_flag(dti_pct: Column) -> Column:
    """DEC-13."""
    return dti_pct > DTI_FLAG_PCT


def cibil(ext_mean: Column, mode: str = "truncate") -> Column:
    """DEC-14: 300 + mean * 600, truncated (form) or rounded (browser)."""
    x = F.lit(CIBIL_BASE) + ext_mean * CIBIL_SPAN
    return (F.floor(x + 0.5) if mode == "round" else x).cast("int")


def cibil_band(score: Column) -> Column:
    e = None
    for edge, name in CIBIL_BANDS:
        e = F.when(score >= edge, F.lit(name)) if e is None else e.when(score >= edge, F.lit(name))
    return e.otherwise(F.lit(CIBIL_ELSE))


def decision_title(dec: Column, mode: str = "form") -> Column:
    """DEC-15: banner title; the browser prints ``LOAN <decision>``."""
    if mode == "browser":
        return F.concat(F.lit(BROWSER_TITLE_PREFIX), dec)
    return (F.when(dec == "APPROVED", F.lit(DECISION_TITLES["APPROVED"]))
             .when(dec == "CONDITIONAL", F.lit(DECISION_TITLES["CONDITIONAL"]))
             .otherwise(F.lit(DECISION_TITLES["REJECTED"])))


def confidence_label(dec: Column) -> Column:
    return F.when(dec == "APPROVED", F.lit(CONFIDENCE_LABELS[0])).otherwise(F.lit(CONFIDENCE_LABELS[1]))

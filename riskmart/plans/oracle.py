"""DuckDB oracle SQL for the registered queries.

Each string runs on the driver's pre-registered parquet views; the lending
views come from ``adapter_sql`` as CTEs.  Column names, types and rounding
follow the Spark side exactly (``plans.catalog.ROUNDING``).
"""

from __future__ import annotations

from riskmart.operators.rollups import ROLLUP_COLS
from riskmart.plans.adapter_sql import round_sql, with_views
from riskmart.plans.catalog import MODEL_FEATURES, ROUNDING
from riskmart.schemas import (APPLICANT_DEFAULTS, BROWSER_RANGES, CONDITION_TEXTS, FORM_OPTIONS,
                              FORM_RANGES, LOGIT_COEFFICIENTS, LOGIT_INCOME_CLIP, LOGIT_INTERCEPT,
                              MART_CATEGORICAL, REQUIRED_FIELDS, SERVICE_RANGES)

SQL: dict[str, str] = {}


def sql(name: str, text: str, extra: dict | None = None):
    SQL[name] = round_sql(with_views(text, extra), ROUNDING.get(name, {}))


def cnt_if(cond: str) -> str:
    return f"CAST(count_if({cond}) AS BIGINT)"


# ---------------------------------------------------------------- profiles
sql("profile_application", """
SELECT 'application' AS table_name, count(*) AS n_rows, 23 AS n_cols, avg(CAST(TARGET AS DOUBLE)) AS target_mean FROM application
UNION ALL SELECT 'bureau', count(*), 7, CAST(NULL AS DOUBLE) FROM bureau
UNION ALL SELECT 'previous_application', count(*), 6, CAST(NULL AS DOUBLE) FROM previous_application
UNION ALL SELECT 'installments_payments', count(*), 6, CAST(NULL AS DOUBLE) FROM installments_payments
UNION ALL SELECT 'POS_CASH_balance', count(*), 6, CAST(NULL AS DOUBLE) FROM pos_cash_balance
""")

# ---------------------------------------------------------------- rollups
BUREAU_AGG = f"""
SELECT SK_ID_CURR,
 count(SK_ID_BUREAU) AS BUREAU_LOAN_COUNT,
 coalesce(sum(AMT_CREDIT_SUM), 0.0) AS BUREAU_CREDIT_SUM,
 coalesce(sum(AMT_CREDIT_SUM_DEBT), 0.0) AS BUREAU_CREDIT_SUM_DEBT,
 max(AMT_CREDIT_SUM) AS BUREAU_CREDIT_SUM_MAX,
 {cnt_if('CREDIT_DAY_OVERDUE > 0')} AS BUREAU_OVERDUE_COUNT,
 {cnt_if("CREDIT_ACTIVE = 'Active'")} AS BUREAU_ACTIVE_LOANS,
 {cnt_if("CREDIT_ACTIVE = 'Closed'")} AS BUREAU_CLOSED_LOANS,
 avg(DAYS_CREDIT) AS BUREAU_AVG_DAYS_CREDIT
FROM bureau WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR"""

PREVIOUS_AGG = f"""
SELECT *, CAST(PREV_APP_APPROVED AS DOUBLE) / (PREV_APP_COUNT + 1) AS PREV_APPROVAL_RATE FROM (
SELECT SK_ID_CURR,
 count(SK_ID_PREV) AS PREV_APP_COUNT,
 {cnt_if("NAME_CONTRACT_STATUS = 'Approved'")} AS PREV_APP_APPROVED,
 {cnt_if("NAME_CONTRACT_STATUS = 'Refused'")} AS PREV_APP_REFUSED,
 avg(AMT_CREDIT) AS PREV_AMT_CREDIT_MEAN,
 avg(AMT_ANNUITY) AS PREV_AMT_ANNUITY_MEAN,
 avg(DAYS_DECISION) AS PREV_DAYS_DECISION_MEAN
FROM previous_application WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR) p"""

INSTALLMENT_AGG = f"""
SELECT SK_ID_CURR,
 avg(PAYMENT_DIFF) AS INST_PAYMENT_DIFF_MEAN,
 coalesce(sum(PAYMENT_DIFF), 0.0) AS INST_PAYMENT_DIFF_SUM,
 avg(DAYS_PAST_DUE) AS INST_DAYS_PAST_DUE_MEAN,
 max(DAYS_PAST_DUE) AS INST_DAYS_PAST_DUE_MAX,
 {cnt_if('DAYS_PAST_DUE > 0')} AS INST_LATE_PAYMENTS,
 count(SK_ID_PREV) AS INST_COUNT
FROM (SELECT *, AMT_INSTALMENT - AMT_PAYMENT AS PAYMENT_DIFF,
        CASE WHEN DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT IS NULL THEN NULL
             ELSE greatest(CAST(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT AS DOUBLE), 0.0) END AS DAYS_PAST_DUE
      FROM installments_payments) i
WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR"""

POS_AGG = """
SELECT SK_ID_CURR,
 avg(MONTHS_BALANCE) AS POS_MONTHS_BALANCE_MEAN,
 avg(CNT_INSTALMENT) AS POS_CNT_INSTALMENT_MEAN,
 avg(SK_DPD) AS POS_SK_DPD_MEAN,
 max(SK_DPD) AS POS_SK_DPD_MAX,
 avg(SK_DPD_DEF) AS POS_SK_DPD_DEF_MEAN,
 count(SK_ID_PREV) AS POS_COUNT
FROM pos_cash_balance WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR"""

ROLLUP_CTES = {"bureau_agg": BUREAU_AGG, "prev_agg": PREVIOUS_AGG,
               "inst_agg": INSTALLMENT_AGG, "pos_agg": POS_AGG}

sql("rollup_bureau", BUREAU_AGG)
sql("rollup_previous", PREVIOUS_AGG)
sql("rollup_installments", INSTALLMENT_AGG)
sql("rollup_pos_cash", POS_AGG)

MART = """
SELECT * FROM application
 LEFT JOIN bureau_agg USING (SK_ID_CURR)
 LEFT JOIN prev_agg USING (SK_ID_CURR)
 LEFT JOIN inst_agg USING (SK_ID_CURR)
 LEFT JOIN pos_agg USING (SK_ID_CURR)"""

sql("feature_mart", MART, ROLLUP_CTES)


def ratio(a: str, b: str) -> str:
    return f"{a} / NULLIF({b} + 1, 0)"


EXT = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
EXT_MEAN = ("(coalesce(EXT_SOURCE_1, 0.0) + coalesce(EXT_SOURCE_2, 0.0) + coalesce(EXT_SOURCE_3, 0.0))"
            " / NULLIF(CAST(EXT_SOURCE_1 IS NOT NULL AS INTEGER) + CAST(EXT_SOURCE_2 IS NOT NULL AS INTEGER)"
            " + CAST(EXT_SOURCE_3 IS NOT NULL AS INTEGER), 0)")


def feature_select(emp: str, compare: bool) -> dict:
    f = {
        "CREDIT_INCOME_RATIO": ratio("AMT_CREDIT", "AMT_INCOME_TOTAL"),
        "ANNUITY_INCOME_RATIO": ratio("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
        "CREDIT_TERM": ratio("AMT_CREDIT", "AMT_ANNUITY"),
        "AGE_YEARS": "-DAYS_BIRTH / 365",
        "EMPLOYMENT_YEARS": f"CASE WHEN {emp} < 0 THEN -{emp} / 365 ELSE 0.0 END",
        "EXT_SOURCE_MEAN": EXT_MEAN,
        "EXT_SOURCE_MIN": "least(EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3)",
        "EXT_SOURCE_MAX": "greatest(EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3)",
        "CHILDREN_RATIO": ratio("CNT_CHILDREN", "CNT_FAM_MEMBERS"),
        "INCOME_PER_PERSON": ratio("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
        "GOODS_CREDIT_RATIO": ratio("AMT_GOODS_PRICE", "AMT_CREDIT"),
        "INCOME_CREDIT_RATIO": ratio("AMT_INCOME_TOTAL", "AMT_CREDIT"),
        "DAYS_EMPLOYED_PERCENT": f"{emp} / NULLIF(DAYS_BIRTH + 1, 0)",
    }
    if compare:
        keep = ["CREDIT_INCOME_RATIO", "ANNUITY_INCOME_RATIO", "AGE_YEARS", "EMPLOYMENT_YEARS",
                "EXT_SOURCE_MEAN", "EXT_SOURCE_MIN", "EXT_SOURCE_MAX", "CHILDREN_RATIO",
                "INCOME_PER_PERSON", "CREDIT_TERM", "INCOME_CREDIT_RATIO"]
        return {k: f[k] for k in keep}
    return f


def as_select(d: dict) -> str:
    return ",\n ".join(f"{v} AS {k}" for k, v in d.items())


sql("engineered_features", f"""
SELECT SK_ID_CURR, {', '.join(ROLLUP_COLS)}, {as_select(feature_select('DAYS_EMPLOYED', False))},
 {ratio('BUREAU_CREDIT_SUM_DEBT', 'BUREAU_CREDIT_SUM')} AS BUREAU_DEBT_RATIO
FROM ({MART}) m""", ROLLUP_CTES)

COMPARE_BASE = """
SELECT SK_ID_CURR, TARGET, CODE_GENDER, DAYS_BIRTH, DAYS_EMPLOYED AS DAYS_EMPLOYMENT, CNT_CHILDREN,
 CNT_FAM_MEMBERS, AMT_INCOME_TOTAL, AMT_CREDIT, AMT_ANNUITY, AMT_GOODS_PRICE, EXT_SOURCE_1, EXT_SOURCE_2,
 EXT_SOURCE_3, NAME_EDUCATION_TYPE, NAME_INCOME_TYPE, NAME_HOUSING_TYPE, NAME_FAMILY_STATUS, FLAG_OWN_CAR,
 FLAG_OWN_REALTY, REGION_RATING_CLIENT, CAST(0.025 AS DOUBLE) AS REGION_POPULATION_RELATIVE, OCCUPATION_TYPE,
 'Business Entity Type 3' AS ORGANIZATION_TYPE
FROM application"""

sql("compare_features", f"""
SELECT *, {as_select(feature_select('DAYS_EMPLOYMENT', True))} FROM ({COMPARE_BASE}) b""")


# ---------------------------------------------------------------- requests


def dbl(x) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return dbl(v)
    return str(v)


APPLICANT_COLS = ["applicant_id", "name", "age", "gender", "education", "family_status", "children",
                  "family_members", "own_car", "own_realty", "income_type", "monthly_income",
                  "occupation", "employment_months", "housing_type", "region_rating", "loan_amount",
                  "loan_purpose", "tenure_months", "ext1", "ext2", "ext3"]

REQ = "SELECT " + ", ".join(
    f"coalesce({c}, {lit(APPLICANT_DEFAULTS[c])}) AS {c}" if c in APPLICANT_DEFAULTS else c
    for c in APPLICANT_COLS) + " FROM applicants"


def _violation_union(profile: str) -> str:
    parts = [f"SELECT applicant_id, '{f}:required' AS rule FROM req WHERE {f} IS NULL"
             for f in REQUIRED_FIELDS]
    ranges = {"service": SERVICE_RANGES, "form": FORM_RANGES, "browser": BROWSER_RANGES}[profile]
    for f, (lo, hi) in ranges.items():
        if lo is not None:
            parts.append(f"SELECT applicant_id, '{f}:min' FROM req WHERE {f} < {lit(lo)}")
        if hi is not None:
            parts.append(f"SELECT applicant_id, '{f}:max' FROM req WHERE {f} > {lit(hi)}")
    if profile in ("form", "browser"):
        for f, opts in FORM_OPTIONS.items():
            parts.append(f"SELECT applicant_id, '{f}:option' FROM req WHERE {f} IS NOT NULL AND "
                         f"{f} NOT IN ({', '.join(lit(o) for o in opts)})")
    return "\nUNION ALL ".join(parts)


REQ_CTES = {"req": REQ, "viol": _violation_union("service")}
ENR = """
SELECT *, (ext1 + ext2 + ext3) / 3 AS ext_source_mean, employment_months / 12 AS employment_years,
 (loan_amount / greatest(tenure_months, 1)) / greatest(monthly_income, CAST(1.0 AS DOUBLE)) AS annuity_income_ratio
FROM req WHERE NOT EXISTS (SELECT 1 FROM viol WHERE viol.applicant_id = req.applicant_id)"""
BASE_CTES = {**REQ_CTES, "enr": ENR}

sql("applicant_violations", "SELECT applicant_id, rule FROM viol", REQ_CTES)
sql("form_violations", "SELECT applicant_id, rule FROM viol",
    {"req": REQ, "viol": _violation_union("form")})
sql("browser_violations", "SELECT applicant_id, rule FROM viol",
    {"req": REQ, "viol": _violation_union("browser")})
sql("applicant_split", """
SELECT r.applicant_id, CASE WHEN count(v.rule) = 0 THEN 'valid' ELSE 'rejected' END AS status,
 CAST(count(v.rule) AS INTEGER) AS n_violations
FROM req r LEFT JOIN viol v ON r.applicant_id = v.applicant_id GROUP BY r.applicant_id""", REQ_CTES)

sql("normalised_applicants", """
SELECT applicant_id, coalesce(nullif(name, ''), 'Applicant') AS name,
 greatest(family_members, children + 1) AS family_members,
 CASE WHEN income_type = 'Unemployed' OR monthly_income <= 0 THEN 'Unknown' ELSE occupation END AS occupation,
 employment_months
FROM req""", {"req": REQ})

sql("normalised_forms", """
SELECT applicant_id, CASE WHEN applicant_id % 6 = 0 THEN 0 ELSE CAST(trunc(employment_months / 12 * 12) AS INTEGER) END AS months_form,
 CASE WHEN applicant_id % 6 = 0 THEN 0 ELSE CAST(floor(employment_months / 12 * 12 + 0.5) AS INTEGER) END AS months_browser,
 CASE WHEN applicant_id % 11 = 0 THEN 0.0 ELSE coalesce(monthly_income, 0.0) END AS income_number
FROM req""", {"req": REQ})

sql("request_features", """
SELECT applicant_id, gender AS CODE_GENDER,
 -CAST(trunc(age * 365) AS INTEGER) AS DAYS_BIRTH,
 -CAST(trunc(employment_months / 12 * 365) AS INTEGER) AS DAYS_EMPLOYMENT,
 children AS CNT_CHILDREN, family_members AS CNT_FAM_MEMBERS,
 monthly_income * 12 AS AMT_INCOME_TOTAL, loan_amount AS AMT_CREDIT,
 loan_amount / greatest(tenure_months, 1) AS AMT_ANNUITY,
 loan_amount * CAST(0.85 AS DOUBLE) AS AMT_GOODS_PRICE,
 ext1 AS EXT_SOURCE_1, ext2 AS EXT_SOURCE_2, ext3 AS EXT_SOURCE_3,
 'Cash loans' AS NAME_CONTRACT_TYPE, education AS NAME_EDUCATION_TYPE, income_type AS NAME_INCOME_TYPE,
 housing_type AS NAME_HOUSING_TYPE, family_status AS NAME_FAMILY_STATUS,
 own_car AS FLAG_OWN_CAR, own_realty AS FLAG_OWN_REALTY,
 1 AS FLAG_PHONE, 0 AS FLAG_EMAIL, 1 AS FLAG_WORK_PHONE, 1 AS FLAG_DOCUMENT_3,
 0 AS REG_CITY_NOT_WORK_CITY, 0 AS LIVE_CITY_NOT_WORK_CITY,
 region_rating AS REGION_RATING_CLIENT, region_rating AS REGION_RATING_CLIENT_W_CITY,
 CAST(0.025 AS DOUBLE) AS REGION_POPULATION_RELATIVE, occupation AS OCCUPATION_TYPE,
 'Business Entity Type 3' AS ORGANIZATION_TYPE,
 loan_amount / (monthly_income * 12 + 1) AS CREDIT_INCOME_RATIO,
 (loan_amount / greatest(tenure_months, 1)) / (monthly_income * 12 + 1) AS ANNUITY_INCOME_RATIO,
 age AS AGE_YEARS, employment_months / 12 AS EMPLOYMENT_YEARS,
 (ext1 + ext2 + ext3) / 3 AS EXT_SOURCE_MEAN,
 children / greatest(family_members, 1) AS CHILDREN_RATIO,
 loan_amount / (loan_amount / greatest(tenure_months, 1) + 1) AS CREDIT_TERM
FROM enr""", BASE_CTES)


def _logit_sql() -> str:
    lo, hi = LOGIT_INCOME_CLIP
    inc = f"least(greatest(monthly_income * 12, {dbl(lo)}), {dbl(hi)})"
    terms = {
        "ext1": "ext1", "ext2": "ext2", "ext3": "ext3",
        "credit_income": f"(loan_amount / {inc})",
        "annuity_income": f"((loan_amount / greatest(tenure_months, 1)) / {inc})",
        "age_years": "age", "employment_years": "(employment_months / 12)",
        "region_is_3": "CAST(region_rating = 3 AS DOUBLE)",
        "is_unemployed": "CAST(income_type = 'Unemployed' AS DOUBLE)",
        "is_higher_education": "CAST(education = 'Higher education' AS DOUBLE)",
        "lives_with_parents": "CAST(housing_type = 'With parents' AS DOUBLE)",
        "children": "CAST(children AS DOUBLE)",
    }
    z = dbl(LOGIT_INTERCEPT)
    for name, coef in LOGIT_COEFFICIENTS:
        z = f"({z} + {dbl(coef)} * {terms[name]})"
    return z


SCORED = f"SELECT *, {_logit_sql()} AS logit FROM enr"
SCORED_P = "SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-logit)) AS p FROM scored0"
SCORED_CTES = {**BASE_CTES, "scored0": SCORED, "scored": SCORED_P}

sql("logit_probability", "SELECT applicant_id, logit, p FROM scored", SCORED_CTES)


def _band(x: str, bands, weight: int, cmp: str) -> str:
    op = ">=" if cmp == "ge" else "<="
    whens = " ".join(f"WHEN {x} {op} {dbl(edge)} THEN {dbl(weight * share)}" for edge, share, _ in bands)
    return f"CASE {whens} ELSE {dbl(0.0)} END"


def _criteria_sql() -> dict:
    from riskmart.schemas import (DTI_BANDS, EMPLOYMENT_EMPLOYED, EMPLOYMENT_SELF,
                                  EMPLOYMENT_SHARES, EMPLOYMENT_TOP, EXT_SOURCE_BANDS,
                                  INCOME_STABILITY_BANDS, REPAYMENT_REALTY_SHARE,
                                  REPAYMENT_YEAR_BANDS, SCORE_WEIGHTS)
    w = dict(SCORE_WEIGHTS)
    years = "coalesce(CAST(employment_years AS DOUBLE), 0.0::DOUBLE)"
    yb = " ".join(f"WHEN {years} >= {edge} THEN {dbl(w['repayment_history'] * s)}"
                  for edge, s in REPAYMENT_YEAR_BANDS)
    rep = (f"least(CASE {yb} ELSE 0.0::DOUBLE END + CASE WHEN coalesce(own_realty, 'N') = 'Y' "
           f"THEN {dbl(w['repayment_history'] * REPAYMENT_REALTY_SHARE)} ELSE 0.0::DOUBLE END, "
           f"{dbl(w['repayment_history'])})")
    it = "lower(coalesce(income_type, ''))"
    top, emp, slf = (w["employment_status"] * s for s in EMPLOYMENT_SHARES)
    lst = lambda xs: ", ".join(lit(x) for x in xs)
    es = (f"CASE WHEN {it} IN ({lst(EMPLOYMENT_TOP)}) THEN {dbl(top)} "
          f"WHEN {it} IN ({lst(EMPLOYMENT_EMPLOYED)}) THEN {dbl(emp)} "
          f"WHEN {it} = {lit(EMPLOYMENT_SELF)} THEN {dbl(slf)} ELSE 0.0::DOUBLE END")
    return {
        "ext_source_score": _band("coalesce(ext_source_mean, 0.5::DOUBLE)", EXT_SOURCE_BANDS,
                                  w["ext_source_score"], "ge"),
        "repayment_history": rep,
        "income_stability": _band("coalesce(employment_months, 0)", INCOME_STABILITY_BANDS,
                                  w["income_stability"], "ge"),
        "debt_to_income": _band("coalesce(annuity_income_ratio, 1.0::DOUBLE) * 100", DTI_BANDS,
                                w["debt_to_income"], "le"),
        "employment_status": es,
    }


CRIT = _criteria_sql()
CARD = ("SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in CRIT.items()) + " FROM enr")
CARD_TOTAL = ("SELECT *, " + " + ".join(CRIT) + " AS score FROM card0")
CARD_CTES = {**BASE_CTES, "card0": CARD, "card": CARD_TOTAL}

sql("scorecard", "SELECT applicant_id, " + ", ".join(CRIT) + ", score FROM card", CARD_CTES)

_TITLES = {"ext_source_score": "Ext Source Score", "repayment_history": "Repayment History",
           "income_stability": "Income Stability", "debt_to_income": "Debt To Income",
           "employment_status": "Employment Status"}
_WEIGHTS = {"ext_source_score": 30, "repayment_history": 25, "income_stability": 20,
            "debt_to_income": 15, "employment_status": 10}
sql("scorecard_long", "SELECT *, CASE WHEN pct >= 80 THEN 'success' WHEN pct >= 40 THEN 'warning' "
    "ELSE 'danger' END AS status FROM (" + "\nUNION ALL ".join(
        f"SELECT applicant_id, {i + 1} AS step, '{c}' AS criterion, '{_TITLES[c]}' AS title, "
        f"{c} AS earned, {_WEIGHTS[c]} AS max_points, {c} / {_WEIGHTS[c]} * 100 AS pct FROM card"
        for i, c in enumerate(CRIT)) + ") s", CARD_CTES)

sql("grades_verdicts", """
SELECT applicant_id, score,
 CASE WHEN score >= 80 THEN 'A' WHEN score >= 65 THEN 'B' WHEN score >= 50 THEN 'C' ELSE 'D' END AS grade,
 CASE WHEN score >= 75 THEN 'LIKELY ELIGIBLE' WHEN score >= 50 THEN 'CONDITIONAL' ELSE 'LIKELY NOT ELIGIBLE' END AS verdict,
 CASE WHEN score >= 75 THEN 'Strong profile. See ML decision below.'
      WHEN score >= 50 THEN 'Mixed signals. See ML decision below.' ELSE 'Does not meet criteria.' END AS verdict_text
FROM card""", CARD_CTES)

DEC = ("CASE WHEN p >= 0.35::DOUBLE THEN 'REJECTED' WHEN p >= 0.21::DOUBLE THEN 'CONDITIONAL' "
       "ELSE 'APPROVED' END")
DEC_CTES = {**SCORED_CTES, "dec": f"SELECT *, {DEC} AS decision FROM scored"}

sql("decisions", """
SELECT applicant_id, decision,
 round_even(CASE WHEN decision = 'APPROVED' THEN (1 - p) * 100 ELSE p * 100 END, 1) AS confidence,
 round_even(p * 100, 2) AS prob_default
FROM dec""", DEC_CTES)

MAXLOAN = ("least(loan_amount, monthly_income * 12 * 5 * greatest(0.3::DOUBLE, 1.0::DOUBLE - p * 1.5::DOUBLE))")
RATE = "round_even(8.5::DOUBLE + p * 12, 1)"
PRICE = f"SELECT *, {MAXLOAN} AS max_loan, {RATE} AS interest_rate FROM dec"
EMI = ("max_loan * (interest_rate / 100 / 12) * pow(1.0::DOUBLE + interest_rate / 100 / 12, "
       "CAST(tenure_months AS DOUBLE)) / (pow(1.0::DOUBLE + interest_rate / 100 / 12, "
       "CAST(tenure_months AS DOUBLE)) - 1)")
DTI = "(loan_amount / greatest(tenure_months, 1)) / greatest(monthly_income, 1.0::DOUBLE)"
PRICE_CTES = {**DEC_CTES, "priced": PRICE}

sql("pricing", f"""
SELECT applicant_id, CAST(round_even(max_loan, 0) AS BIGINT) AS max_eligible_amount,
 interest_rate, CAST(interest_rate AS VARCHAR) || '%' AS suggested_interest_rate,
 CAST(round_even({EMI}, 0) AS BIGINT) AS estimated_emi, {DTI} AS dti
FROM priced""", PRICE_CTES)


def _reason_sql() -> str:
    emp_y = "(employment_months / 12)"
    ext_mean = "((ext1 + ext2 + ext3) / 3)"
    income = "(monthly_income * 12)"
    strengths = [("ext", f"{ext_mean} >= 0.6::DOUBLE"), ("employment", f"{emp_y} >= 3"),
                 ("income", f"{income} >= 500000"), ("dti", f"{DTI} <= 0.3::DOUBLE"),
                 ("realty", "own_realty = 'Y'")]
    risks = [("ext", f"{ext_mean} < 0.4::DOUBLE"), ("employment", f"{emp_y} < 1"),
             ("dti", f"{DTI} > 0.4::DOUBLE"), ("credit", f"loan_amount > {income} * 4"),
             ("children", "children >= 3")]
    parts = []
    for kind, items in (("strength", strengths), ("risk", risks)):
        for i, (code, cond) in enumerate(items):
            parts.append(f"SELECT applicant_id, '{kind}' AS kind, {i} AS ord, '{code}' AS reason "
                         f"FROM dec WHERE {cond}")
    cand = "\nUNION ALL ".join(parts)
    ranked = ("SELECT applicant_id, kind, CAST(row_number() OVER (PARTITION BY applicant_id, kind "
              "ORDER BY ord) AS INTEGER) AS position, reason FROM cand")
    nones = ("SELECT d.applicant_id, k.kind, 1 AS position, 'none' AS reason FROM dec d "
             "CROSS JOIN (VALUES ('strength'), ('risk')) k(kind) WHERE NOT EXISTS "
             "(SELECT 1 FROM cand c WHERE c.applicant_id = d.applicant_id AND c.kind = k.kind)")
    conds = "\nUNION ALL ".join(
        f"SELECT applicant_id, 'condition', {i + 1}, {lit(t)} FROM dec WHERE decision <> 'REJECTED'"
        for i, t in enumerate(CONDITION_TEXTS))
    return (f"WITH cand AS ({cand}) SELECT * FROM ({ranked}) r WHERE position <= 3 "
            f"UNION ALL {nones} UNION ALL {conds}")


sql("reasons_long", f"SELECT * FROM ({_reason_sql()}) x", DEC_CTES)

sql("risk_bands", f"""
SELECT applicant_id, round_even(p * 100, 2) AS prob_pct,
 CASE WHEN round_even(p * 100, 2) < 20 THEN 'low' WHEN round_even(p * 100, 2) < 40 THEN 'medium' ELSE 'high' END AS risk_band,
 round_even({DTI} * 100, 1) AS dti_pct, round_even({DTI} * 100, 1) > 40 AS dti_flag
FROM scored""", SCORED_CTES)

sql("cibil", """
SELECT applicant_id, CAST(trunc(300 + ext_source_mean * 600) AS INTEGER) AS cibil_form,
 CAST(floor(300 + ext_source_mean * 600 + 0.5::DOUBLE) AS INTEGER) AS cibil_browser,
 CASE WHEN CAST(floor(300 + ext_source_mean * 600 + 0.5::DOUBLE) AS INTEGER) >= 700 THEN 'success'
      WHEN CAST(floor(300 + ext_source_mean * 600 + 0.5::DOUBLE) AS INTEGER) >= 550 THEN 'warning'
      ELSE 'danger' END AS cibil_band
FROM enr""", BASE_CTES)

sql("fallback_decisions", """
SELECT applicant_id, 'CONDITIONAL' AS decision, 50.0::DOUBLE AS confidence, 50.0::DOUBLE AS prob_default,
 CAST(trunc(loan_amount * 0.5::DOUBLE) AS BIGINT) AS max_eligible_amount, '12.0%' AS suggested_interest_rate,
 CAST(trunc(loan_amount * 0.02::DOUBLE) AS BIGINT) AS estimated_emi
FROM enr""", BASE_CTES)

sql("officer_notes", """
SELECT applicant_id,
 'Applicant has a ' || printf('%.1f', p * 100) || '% estimated default probability. ' ||
 CASE decision WHEN 'APPROVED' THEN 'Application meets lending criteria.'
   WHEN 'CONDITIONAL' THEN 'Application carries elevated risk.' ELSE 'Does not meet minimum risk thresholds.' END AS officer_note,
 CASE decision WHEN 'APPROVED' THEN 'LOAN APPROVED' WHEN 'CONDITIONAL' THEN 'CONDITIONAL APPROVAL'
   ELSE 'LOAN REJECTED' END AS decision_title,
 'LOAN ' || decision AS browser_title,
 CASE WHEN decision = 'APPROVED' THEN 'Match' ELSE 'Risk' END AS confidence_label
FROM dec""", DEC_CTES)


# ---------------------------------------------------------------- prep

_APP_COLS = ["SK_ID_CURR", "TARGET", "CODE_GENDER", "DAYS_BIRTH", "DAYS_EMPLOYED", "CNT_CHILDREN",
             "CNT_FAM_MEMBERS", "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE",
             "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "NAME_CONTRACT_TYPE",
             "NAME_EDUCATION_TYPE", "NAME_INCOME_TYPE", "NAME_HOUSING_TYPE", "NAME_FAMILY_STATUS",
             "FLAG_OWN_CAR", "FLAG_OWN_REALTY", "OCCUPATION_TYPE", "REGION_RATING_CLIENT"]
_CATS = [c for c in MART_CATEGORICAL if c in _APP_COLS]

sql("label_codes", "\nUNION ALL ".join(
    f"SELECT '{c}' AS column, value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code "
    f"FROM (SELECT DISTINCT coalesce({c}, 'nan') AS value FROM application) d" for c in _CATS))


def _encode_select(src_cols: list[str]) -> str:
    return ", ".join(
        f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, 'nan')) - 1 AS INTEGER) AS {c}"
        if c in _CATS else c for c in src_cols)


sql("encoded_application", f"SELECT {_encode_select(_APP_COLS)} FROM application")

_ENG = (f"SELECT *, {as_select(feature_select('DAYS_EMPLOYED', False))}, "
        f"{ratio('BUREAU_CREDIT_SUM_DEBT', 'BUREAU_CREDIT_SUM')} AS BUREAU_DEBT_RATIO FROM ({MART}) m")
_ENC_COLS = _APP_COLS + [c for c in MODEL_FEATURES if c not in _APP_COLS]
ENC_CTES = {**ROLLUP_CTES, "eng": _ENG, "enc": f"SELECT {_encode_select(_ENC_COLS)} FROM eng"}

sql("medians", "\nUNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(median({c}) AS DOUBLE) AS median FROM enc" for c in MODEL_FEATURES),
    ENC_CTES)

_MEDS = "SELECT " + ", ".join(f"CAST(median({c}) AS DOUBLE) AS m_{c}" for c in MODEL_FEATURES) + " FROM enc"
sql("imputed_application", "SELECT SK_ID_CURR, TARGET, " + ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), m_{c}) AS {c}" for c in MODEL_FEATURES) + " FROM enc CROSS JOIN meds",
    {**ENC_CTES, "meds": _MEDS})

_SIZES = """
SELECT TARGET, n, n_train_floor, cont - n_train_floor AS frac,
  n_train_total - sum(n_train_floor) OVER () AS need,
  row_number() OVER (ORDER BY cont - n_train_floor DESC, TARGET) AS pri
FROM (SELECT TARGET, n, n_train_total, n_train_total * n / total AS cont,
        CAST(floor(n_train_total * n / total) AS BIGINT) AS n_train_floor
      FROM (SELECT TARGET, count(*) AS n, sum(count(*)) OVER () AS total,
              sum(count(*)) OVER () - CAST(ceil(0.2 * sum(count(*)) OVER ()) AS BIGINT) AS n_train_total
            FROM application GROUP BY TARGET) c) f"""
SIZES = ("SELECT TARGET, n, n_train_floor + CASE WHEN pri <= need THEN 1 ELSE 0 END AS n_train, "
         "n - n_train_floor - CASE WHEN pri <= need THEN 1 ELSE 0 END AS n_test FROM sizes0")
sql("split_sizes", "SELECT TARGET, n, CAST(n_train AS BIGINT) AS n_train, CAST(n_test AS BIGINT) AS n_test "
    "FROM sizes", {"sizes0": _SIZES, "sizes": SIZES})

_H = "((((SK_ID_CURR % 2147483647) + 2147483647) % 2147483647 + 42) % 2147483647) * 950706376 % 2147483647"
sql("stratified_split", f"""
SELECT SK_ID_CURR, TARGET, rk <= n_test AS is_test FROM (
  SELECT a.SK_ID_CURR, a.TARGET, s.n_test,
    row_number() OVER (PARTITION BY a.TARGET ORDER BY {_H}, a.SK_ID_CURR) AS rk
  FROM application a JOIN sizes s ON a.TARGET = s.TARGET) r""", {"sizes0": _SIZES, "sizes": SIZES})

sql("class_weights", """
SELECT TARGET, n, CAST(total AS DOUBLE) / (k * n) AS balanced_weight,
 CASE WHEN TARGET = 1 THEN CAST(neg AS DOUBLE) / NULLIF(pos, 0) ELSE 1.0::DOUBLE END AS pos_weight
FROM (SELECT TARGET, count(*) AS n FROM application GROUP BY TARGET) c
CROSS JOIN (SELECT count(*) AS total, count(DISTINCT TARGET) AS k,
  count_if(TARGET = 0) AS neg, count_if(TARGET = 1) AS pos FROM application) t""")


# ---------------------------------------------------------------- evaluation
def _logit_expr(terms: dict, inc: str) -> str:
    z = dbl(LOGIT_INTERCEPT)
    for name, coef in LOGIT_COEFFICIENTS:
        z = f"({z} + {dbl(coef)} * {terms[name]})"
    return z


_INC = "least(greatest(AMT_INCOME_TOTAL, 15000.0::DOUBLE), 1500000.0::DOUBLE)"
_EMP_Y = "CASE WHEN DAYS_EMPLOYED < 0 THEN -DAYS_EMPLOYED / 365 ELSE 0.0::DOUBLE END"
_MART_TERMS = {
    "ext1": "coalesce(EXT_SOURCE_1, 0.5::DOUBLE)", "ext2": "coalesce(EXT_SOURCE_2, 0.5::DOUBLE)",
    "ext3": "coalesce(EXT_SOURCE_3, 0.5::DOUBLE)",
    "credit_income": f"(AMT_CREDIT / {_INC})",
    "annuity_income": f"(coalesce(AMT_ANNUITY, 0.0::DOUBLE) / {_INC})",
    "age_years": "(-DAYS_BIRTH / 365)", "employment_years": f"({_EMP_Y})",
    "region_is_3": "CAST(REGION_RATING_CLIENT = 3 AS DOUBLE)",
    "is_unemployed": "CAST(NAME_INCOME_TYPE = 'Unemployed' AS DOUBLE)",
    "is_higher_education": "CAST(NAME_EDUCATION_TYPE = 'Higher education' AS DOUBLE)",
    "lives_with_parents": "CAST(NAME_HOUSING_TYPE = 'With parents' AS DOUBLE)",
    "children": "CAST(CNT_CHILDREN AS DOUBLE)",
}
MLOGIT = (f"SELECT SK_ID_CURR, TARGET, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({_logit_expr(_MART_TERMS, _INC)}))) AS p "
          "FROM application")
_MREQ = f"""
SELECT SK_ID_CURR, TARGET, {EXT_MEAN} AS ext_source_mean, {_EMP_Y} AS employment_years,
 CAST(trunc(({_EMP_Y}) * 12) AS INTEGER) AS employment_months, FLAG_OWN_REALTY AS own_realty,
 AMT_ANNUITY / greatest(AMT_INCOME_TOTAL / 12, 1.0::DOUBLE) AS annuity_income_ratio,
 NAME_INCOME_TYPE AS income_type FROM application"""
_MCARD = "SELECT SK_ID_CURR, TARGET, " + " + ".join(f"({v})" for v in CRIT.values()) + " AS score FROM mreq"
SCORES = f"""
SELECT scorer, SK_ID_CURR, TARGET, round_even(p, 12) AS p FROM (
 SELECT 'logit' AS scorer, SK_ID_CURR, TARGET, p FROM mlogit
 UNION ALL SELECT 'scorecard', SK_ID_CURR, TARGET, 1.0::DOUBLE - score / 100 FROM mcard
 UNION ALL SELECT 'external', SK_ID_CURR, TARGET, 1.0::DOUBLE - coalesce({EXT_MEAN}, 0.5::DOUBLE) FROM application) u"""
EVAL_CTES = {"mlogit": MLOGIT, "mreq": _MREQ, "mcard": _MCARD, "scores": SCORES}

_CONF = """
SELECT CAST(count_if(TARGET = 0 AND p < 0.35) AS BIGINT) AS tn, CAST(count_if(TARGET = 0 AND p >= 0.35) AS BIGINT) AS fp,
 CAST(count_if(TARGET = 1 AND p < 0.35) AS BIGINT) AS fn, CAST(count_if(TARGET = 1 AND p >= 0.35) AS BIGINT) AS tp
FROM {src}"""
sql("confusion", _CONF.format(src="mlogit"), EVAL_CTES)

_AUC = """
SELECT {g}CAST(sum(pos * (coalesce(neg_before, 0) + neg / 2)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS roc_auc
FROM (SELECT *, sum(neg) OVER (PARTITION BY {pg} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS neg_before
      FROM (SELECT {g}p AS s, count_if(TARGET = 1) AS pos, count_if(TARGET = 0) AS neg FROM {src} GROUP BY {g}p) a) b
{gb}"""
sql("roc_auc", _AUC.format(g="scorer, ", pg="scorer", src="scores", gb="GROUP BY scorer"), EVAL_CTES)


def _div(a, b):
    return f"coalesce(CAST({a} AS DOUBLE) / NULLIF({b}, 0), 0.0::DOUBLE)"


_P0, _R0, _F0 = _div("tn", "tn + fn"), _div("tn", "tn + fp"), _div("2 * tn", "2 * tn + fn + fp")
_P1, _R1, _F1 = _div("tp", "tp + fp"), _div("tp", "tp + fn"), _div("2 * tp", "2 * tp + fp + fn")
sql("classification_report", f"""
SELECT 1 AS row, 'Repaid' AS label, {_P0} AS precision, {_R0} AS recall, {_F0} AS f1, tn + fp AS support FROM conf
UNION ALL SELECT 2, 'Default', {_P1}, {_R1}, {_F1}, fn + tp FROM conf
UNION ALL SELECT 3, 'accuracy', NULL, NULL, {_div('tp + tn', 'tn + fp + fn + tp')}, tn + fp + fn + tp FROM conf
UNION ALL SELECT 4, 'macro avg', ({_P0} + {_P1}) / 2, ({_R0} + {_R1}) / 2, ({_F0} + {_F1}) / 2, tn + fp + fn + tp FROM conf
UNION ALL SELECT 5, 'weighted avg', {_div(f'{_P0} * (tn + fp) + {_P1} * (fn + tp)', 'tn + fp + fn + tp')},
 {_div(f'{_R0} * (tn + fp) + {_R1} * (fn + tp)', 'tn + fp + fn + tp')},
 {_div(f'{_F0} * (tn + fp) + {_F1} * (fn + tp)', 'tn + fp + fn + tp')}, tn + fp + fn + tp FROM conf""",
    {**EVAL_CTES, "conf": _CONF.format(src="mlogit")})

_TEST = f"""
SELECT s.* FROM scores s JOIN (
  SELECT SK_ID_CURR FROM (
    SELECT a.SK_ID_CURR, z.n_test, row_number() OVER (PARTITION BY a.TARGET ORDER BY {_H}, a.SK_ID_CURR) AS rk
    FROM application a JOIN sizes z ON a.TARGET = z.TARGET) r WHERE rk <= n_test) t USING (SK_ID_CURR)"""
_MROW = f"""
SELECT c.scorer AS model,
 round_even({_div('2 * tp', '2 * tp + fp + fn')}, 4) AS f1_default,
 round_even(({_div('2 * tn', '2 * tn + fn + fp')} + {_div('2 * tp', '2 * tp + fp + fn')}) / 2, 4) AS f1_macro,
 round_even({_div(f"{_div('2 * tn', '2 * tn + fn + fp')} * (tn + fp) + {_div('2 * tp', '2 * tp + fp + fn')} * (fn + tp)", 'tn + fp + fn + tp')}, 4) AS f1_weighted,
 round_even(a.roc_auc, 4) AS roc_auc,
 round_even({_div('tp', 'tp + fp')}, 4) AS precision, round_even({_div('tp', 'tp + fn')}, 4) AS recall,
 CAST(tp AS INTEGER) AS true_positives, CAST(fn AS INTEGER) AS false_negatives
FROM (SELECT scorer, count_if(TARGET = 0 AND p < 0.35) AS tn, count_if(TARGET = 0 AND p >= 0.35) AS fp,
        count_if(TARGET = 1 AND p < 0.35) AS fn, count_if(TARGET = 1 AND p >= 0.35) AS tp
      FROM test GROUP BY scorer) c
JOIN ({_AUC.format(g='scorer, ', pg='scorer', src='test', gb='GROUP BY scorer')}) a ON a.scorer = c.scorer"""
sql("leaderboard", """
SELECT *, CAST(row_number() OVER (ORDER BY f1_default DESC, model) AS INTEGER) AS rank,
 CASE row_number() OVER (ORDER BY f1_default DESC, model) WHEN 1 THEN 'gold' WHEN 2 THEN 'silver'
   WHEN 3 THEN 'bronze' END AS mark
FROM mrow""", {**EVAL_CTES, "sizes0": _SIZES, "sizes": SIZES, "test": _TEST, "mrow": _MROW})


# ---------------------------------------------------------------- sources, sinks, streams
SQL["csv_rollup_bureau"] = SQL["rollup_bureau"]
SQL["csv_feature_mart"] = SQL["feature_mart"]
SQL["json_applicant_split"] = SQL["applicant_split"]
SQL["stream_decisions"] = SQL["decisions"]
sql("stream_rejected", "SELECT applicant_id, count(*) AS n_violations FROM viol GROUP BY applicant_id",
    REQ_CTES)

sql("csv_rejected_cells", """
SELECT SK_ID_BUREAU, 'DAYS_CREDIT' AS "column", 'day ' || CAST(DAYS_CREDIT AS VARCHAR) AS text
FROM bureau WHERE SK_ID_BUREAU % 53 = 0 AND DAYS_CREDIT IS NOT NULL
UNION ALL SELECT SK_ID_BUREAU, 'AMT_CREDIT_SUM', 'n/a, unknown' FROM bureau WHERE SK_ID_BUREAU % 97 = 0""")


# ---------------------------------------------------------------- nested response, flat
def _band_text(x: str, bands, other: str, cmp: str) -> str:
    whens = " ".join(f"WHEN {x} {cmp} {dbl(edge)} THEN {lit(name)}" for edge, _, name in bands)
    return f"CASE {whens} ELSE {lit(other)} END"


def _details_sql() -> dict:
    from riskmart.schemas import (DTI_BANDS, DTI_ELSE, EMPLOYMENT_EMPLOYED, EMPLOYMENT_SELF, EMPLOYMENT_TOP,
                                  EXT_SOURCE_BANDS, EXT_SOURCE_ELSE, INCOME_STABILITY_BANDS, INCOME_STABILITY_ELSE)
    mean, months = "coalesce(ext_source_mean, 0.5::DOUBLE)", "coalesce(employment_months, 0)"
    years, own = "coalesce(CAST(employment_years AS DOUBLE), 0.0::DOUBLE)", "coalesce(own_realty, 'N')"
    dti, kind = "(coalesce(annuity_income_ratio, 1.0::DOUBLE) * 100)", "lower(coalesce(income_type, ''))"

    def text(x, n):
        """Half-even on the shortest decimal form, in whole units of the last digit."""
        units = f"(CAST(CAST({x} AS VARCHAR) AS DECIMAL(30, 18)) * {10 ** n})"
        up = f"({units} - floor({units}) > 0.5 OR ({units} - floor({units}) = 0.5 AND floor({units}) % 2 = 1))"
        return f"printf('%.{n}f', CAST(floor({units}) + CASE WHEN {up} THEN 1 ELSE 0 END AS DOUBLE) / {10 ** n})"

    held = lambda xs: ", ".join(lit(x) for x in xs)
    return {
        "ext_source_score": f"{_band_text(mean, EXT_SOURCE_BANDS, EXT_SOURCE_ELSE, '>=')} || ' (' || {text(mean, 2)} || ')'",
        "repayment_history": f"{text(years, 1)} || ' yrs employment, realty=' || {own}",
        "income_stability": f"{_band_text(months, INCOME_STABILITY_BANDS, INCOME_STABILITY_ELSE, '>=')} || ' (' || {months} || ' months)'",
        "debt_to_income": f"{_band_text(dti, DTI_BANDS, DTI_ELSE, '<=')} || ' (' || {text(dti, 1)} || '%)'",
        "employment_status": f"CASE WHEN {kind} IN ({held(EMPLOYMENT_TOP)}) THEN 'Stable (' || {kind} || ')' "
                             f"WHEN {kind} IN ({held(EMPLOYMENT_EMPLOYED)}) THEN 'Employed (' || {kind} || ')' "
                             f"WHEN {kind} = {lit(EMPLOYMENT_SELF)} THEN 'Self-employed' ELSE 'Other (' || {kind} || ')' END",
    }


_STEPS = "\nUNION ALL ".join(
    f"SELECT applicant_id, {i + 1} AS step, '{c}' AS criterion, {c} AS earned, {_WEIGHTS[c]} AS max_points, "
    f"{d} AS detail, {_WEIGHTS[c]} AS weight, score FROM card" for i, (c, d) in enumerate(_details_sql().items()))
_LISTS = ("SELECT applicant_id, CAST(count_if(kind = 'strength') AS INTEGER) AS n_key_strengths, "
          "CAST(count_if(kind = 'risk') AS INTEGER) AS n_key_risks, CAST(count_if(kind = 'condition') AS INTEGER) AS n_conditions "
          f"FROM ({_reason_sql()}) x GROUP BY applicant_id")
sql("response_rows", """
SELECT s.*, d.decision,
 round_even(CASE WHEN d.decision = 'APPROVED' THEN (1 - d.p) * 100 ELSE d.p * 100 END, 1) AS confidence,
 round_even(d.p * 100, 2) AS prob_default, m.max_eligible_amount, m.suggested_interest_rate, m.estimated_emi,
 'Applicant has a ' || printf('%.1f', d.p * 100) || '% estimated default probability. ' ||
 CASE d.decision WHEN 'APPROVED' THEN 'Application meets lending criteria.'
   WHEN 'CONDITIONAL' THEN 'Application carries elevated risk.' ELSE 'Does not meet minimum risk thresholds.' END AS officer_note,
 l.n_key_strengths, l.n_key_risks, l.n_conditions
FROM steps s JOIN dec d USING (applicant_id) JOIN money m USING (applicant_id) JOIN lists l USING (applicant_id)""",
    {**PRICE_CTES, **CARD_CTES, "steps": _STEPS, "lists": _LISTS, "money": f"""
SELECT applicant_id, CAST(round_even(max_loan, 0) AS BIGINT) AS max_eligible_amount,
 CAST(interest_rate AS VARCHAR) || '%' AS suggested_interest_rate, CAST(round_even({EMI}, 0) AS BIGINT) AS estimated_emi
FROM priced"""})

"""Schemas and fixed rule values.

Everything under "FIXED VALUES" must equal the reference application's
values for results to match (field defaults, ranges, option lists, weights,
band edges and texts).  They are kept together here, in their natural order,
and every operator reads them from this module.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Input schemas (explicit; no schema inference anywhere)
# --------------------------------------------------------------------------

APPLICATION_SCHEMA = T.StructType([
    T.StructField("SK_ID_CURR", T.LongType()),
    T.StructField("TARGET", T.IntegerType()),
    T.StructField("CODE_GENDER", T.StringType()),
    T.StructField("DAYS_BIRTH", T.IntegerType()),
    T.StructField("DAYS_EMPLOYED", T.IntegerType()),
    T.StructField("CNT_CHILDREN", T.IntegerType()),
    T.StructField("CNT_FAM_MEMBERS", T.IntegerType()),
    T.StructField("AMT_INCOME_TOTAL", T.DoubleType()),
    T.StructField("AMT_CREDIT", T.DoubleType()),
    T.StructField("AMT_ANNUITY", T.DoubleType()),
    T.StructField("AMT_GOODS_PRICE", T.DoubleType()),
    T.StructField("EXT_SOURCE_1", T.DoubleType()),
    T.StructField("EXT_SOURCE_2", T.DoubleType()),
    T.StructField("EXT_SOURCE_3", T.DoubleType()),
    T.StructField("NAME_CONTRACT_TYPE", T.StringType()),
    T.StructField("NAME_EDUCATION_TYPE", T.StringType()),
    T.StructField("NAME_INCOME_TYPE", T.StringType()),
    T.StructField("NAME_HOUSING_TYPE", T.StringType()),
    T.StructField("NAME_FAMILY_STATUS", T.StringType()),
    T.StructField("FLAG_OWN_CAR", T.StringType()),
    T.StructField("FLAG_OWN_REALTY", T.StringType()),
    T.StructField("OCCUPATION_TYPE", T.StringType()),
    T.StructField("REGION_RATING_CLIENT", T.IntegerType()),
])

BUREAU_SCHEMA = T.StructType([
    T.StructField("SK_ID_CURR", T.LongType()),
    T.StructField("SK_ID_BUREAU", T.LongType()),
    T.StructField("AMT_CREDIT_SUM", T.DoubleType()),
    T.StructField("AMT_CREDIT_SUM_DEBT", T.DoubleType()),
    T.StructField("CREDIT_DAY_OVERDUE", T.IntegerType()),
    T.StructField("CREDIT_ACTIVE", T.StringType()),
    T.StructField("DAYS_CREDIT", T.IntegerType()),
])

PREVIOUS_SCHEMA = T.StructType([
    T.StructField("SK_ID_CURR", T.LongType()),
    T.StructField("SK_ID_PREV", T.LongType()),
    T.StructField("NAME_CONTRACT_STATUS", T.StringType()),
    T.StructField("AMT_CREDIT", T.DoubleType()),
    T.StructField("AMT_ANNUITY", T.DoubleType()),
    T.StructField("DAYS_DECISION", T.IntegerType()),
])

INSTALLMENTS_SCHEMA = T.StructType([
    T.StructField("SK_ID_CURR", T.LongType()),
    T.StructField("SK_ID_PREV", T.LongType()),
    T.StructField("AMT_INSTALMENT", T.DoubleType()),
    T.StructField("AMT_PAYMENT", T.DoubleType()),
    T.StructField("DAYS_INSTALMENT", T.IntegerType()),
    T.StructField("DAYS_ENTRY_PAYMENT", T.IntegerType()),
])

POS_CASH_SCHEMA = T.StructType([
    T.StructField("SK_ID_CURR", T.LongType()),
    T.StructField("SK_ID_PREV", T.LongType()),
    T.StructField("MONTHS_BALANCE", T.IntegerType()),
    T.StructField("CNT_INSTALMENT", T.DoubleType()),
    T.StructField("SK_DPD", T.IntegerType()),
    T.StructField("SK_DPD_DEF", T.IntegerType()),
])

# Typed applicant row (after coercion).
APPLICANT_SCHEMA = T.StructType([
    T.StructField("applicant_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("age", T.DoubleType()),
    T.StructField("gender", T.StringType()),
    T.StructField("education", T.StringType()),
    T.StructField("family_status", T.StringType()),
    T.StructField("children", T.IntegerType()),
    T.StructField("family_members", T.IntegerType()),
    T.StructField("own_car", T.StringType()),
    T.StructField("own_realty", T.StringType()),
    T.StructField("income_type", T.StringType()),
    T.StructField("monthly_income", T.DoubleType()),
    T.StructField("occupation", T.StringType()),
    T.StructField("employment_months", T.IntegerType()),
    T.StructField("housing_type", T.StringType()),
    T.StructField("region_rating", T.IntegerType()),
    T.StructField("loan_amount", T.DoubleType()),
    T.StructField("loan_purpose", T.StringType()),
    T.StructField("tenure_months", T.IntegerType()),
    T.StructField("ext1", T.DoubleType()),
    T.StructField("ext2", T.DoubleType()),
    T.StructField("ext3", T.DoubleType()),
])

# Raw request records are read with every field as text (browsers send "2"
# for int fields); coercion happens afterwards with try_cast.
APPLICANT_RAW_SCHEMA = T.StructType([T.StructField(f.name, T.StringType()) for f in APPLICANT_SCHEMA.fields])

APPLICANT_INT_FIELDS = ["children", "family_members", "employment_months",
                        "region_rating", "tenure_months"]
APPLICANT_FLOAT_FIELDS = ["age", "monthly_income", "loan_amount", "ext1", "ext2", "ext3"]

# ==========================================================================
# FIXED VALUES — must equal the reference application's values.
# ==========================================================================

# Request fields that are required (no default).
REQUIRED_FIELDS = ["name", "age", "monthly_income", "loan_amount"]

# Request defaults for optional fields, in field order.
APPLICANT_DEFAULTS = {
    "gender": "M",
    "education": "Secondary",
    "family_status": "Married",
    "children": 0,
    "family_members": 2,
    "own_car": "N",
    "own_realty": "N",
    "income_type": "Working",
    "occupation": "Laborers",
    "employment_months": 36,
    "housing_type": "House / apartment",
    "region_rating": 2,
    "loan_purpose": "Home Loan",
    "tenure_months": 60,
    "ext1": 0.5,
    "ext2": 0.5,
    "ext3": 0.5,
}

# Service range rules: field -> (min or None, max or None), inclusive.
SERVICE_RANGES = {
    "age": (18, 100),
    "children": (0, None),
    "family_members": (1, None),
    "monthly_income": (0, None),
    "employment_months": (0, None),
    "region_rating": (1, 3),
    "loan_amount": (1000, None),
    "tenure_months": (1, None),
    "ext1": (0.0, 1.0),
    "ext2": (0.0, 1.0),
    "ext3": (0.0, 1.0),
}

# Stricter form limits (interactive form).  Job tenure is given in years on
# the form (0-50); it is checked here as months 0-600.
FORM_RANGES = {
    "age": (21, 70),
    "children": (0, 10),
    "family_members": (1, 15),
    "monthly_income": (0, 2000000),
    "employment_months": (0, 600),
    "loan_amount": (10000, 50000000),
    "ext1": (0.0, 1.0),
    "ext2": (0.0, 1.0),
    "ext3": (0.0, 1.0),
}

# Browser form limits (no upper limit for income or amount).
BROWSER_RANGES = {
    "age": (21, 70),
    "children": (0, 10),
    "family_members": (1, 15),
    "monthly_income": (0, None),
    "employment_months": (0, None),
    "loan_amount": (10000, None),
    "ext1": (0.0, 1.0),
    "ext2": (0.0, 1.0),
    "ext3": (0.0, 1.0),
}

# Options offered by the form for each field.
FORM_OPTIONS = {
    "gender": ["M", "F"],
    "education": ["Higher education", "Secondary", "Incomplete higher",
                  "Lower secondary", "Academic degree"],
    "family_status": ["Married", "Single / not married", "Civil marriage",
                      "Separated", "Widow"],
    "own_car": ["N", "Y"],
    "own_realty": ["N", "Y"],
    "income_type": ["Working", "Commercial associate", "State servant",
                    "Pensioner", "Self-employed", "Unemployed"],
    "occupation": ["Laborers", "Core staff", "Accountants", "Managers", "Drivers",
                   "Sales staff", "Medicine staff", "Cleaning staff", "Unknown"],
    "housing_type": ["House / apartment", "With parents", "Municipal apartment",
                     "Rented apartment", "Office apartment"],
    "region_rating": [1, 2, 3],
    "loan_purpose": ["Home Loan", "Personal Loan", "Vehicle Loan", "Education Loan",
                     "Business Loan", "Medical Loan", "Gold Loan"],
    "tenure_months": [12, 24, 36, 48, 60, 84, 120, 180, 240, 360],
}

NAME_PLACEHOLDER = "Applicant"
UNKNOWN_OCCUPATION = "Unknown"
IRREGULAR_TENURE_RESET_MONTHS = 36

# Scorecard criteria and weights, in evaluation order.
SCORE_WEIGHTS = [
    ("ext_source_score", 30),
    ("repayment_history", 25),
    ("income_stability", 20),
    ("debt_to_income", 15),
    ("employment_status", 10),
]

# Missing-input defaults inside the scorecard.
SCORE_INPUT_DEFAULTS = {
    "ext_source_mean": 0.5,
    "employment_years": 0.0,
    "own_realty": "N",
    "employment_months": 0,
    "annuity_income_ratio": 1.0,
    "income_type": "",
}

# (edge, share of weight, label) bands, checked top-down.
EXT_SOURCE_BANDS = [(0.7, 1.0, "Excellent"), (0.55, 0.75, "Good"), (0.4, 0.45, "Fair")]
EXT_SOURCE_ELSE = "Poor"
REPAYMENT_YEAR_BANDS = [(5, 0.6), (2, 0.4), (1, 0.2)]
REPAYMENT_REALTY_SHARE = 0.4
INCOME_STABILITY_BANDS = [(36, 1.0, "Stable"), (12, 0.7, "Moderate"), (6, 0.4, "Short")]
INCOME_STABILITY_ELSE = "Insufficient"
DTI_BANDS = [(20, 1.0, "Low DTI"), (35, 0.65, "Moderate DTI"), (50, 0.3, "High DTI")]
DTI_ELSE = "Very High DTI"
EMPLOYMENT_TOP = ["state servant", "pensioner"]
EMPLOYMENT_EMPLOYED = ["working", "commercial associate"]
EMPLOYMENT_SELF = "self-employed"
EMPLOYMENT_SHARES = (1.0, 0.8, 0.6)

# Detail text of each criterion (Python format strings).
CRITERION_DETAILS = {
    "ext_source_score": "{band} ({mean:.2f})",
    "repayment_history": "{years:.1f} yrs employment, realty={own}",
    "income_stability": "{band} ({months} months)",
    "debt_to_income": "{band} ({dti:.1f}%)",
    "employment_status_top": "Stable ({it})",
    "employment_status_employed": "Employed ({it})",
    "employment_status_self": "Self-employed",
    "employment_status_other": "Other ({it})",
}

# Grade and verdict edges (display layer).
GRADE_EDGES = [(80, "A"), (65, "B"), (50, "C")]
GRADE_ELSE = "D"
VERDICTS = [
    (75, "LIKELY ELIGIBLE", "Strong profile. See ML decision below."),
    (50, "CONDITIONAL", "Mixed signals. See ML decision below."),
]
VERDICT_ELSE = ("LIKELY NOT ELIGIBLE", "Does not meet criteria.")
STEP_STATUS_EDGES = [(80, "success"), (40, "warning")]
STEP_STATUS_ELSE = "danger"

# Decision and pricing.
DEFAULT_THRESHOLD = 0.35
CONDITIONAL_FACTOR = 0.6
BASE_RATE = 8.5
RATE_SLOPE = 12
MIN_LIMIT_MULTIPLIER = 0.3
LIMIT_SLOPE = 1.5
INCOME_LIMIT_MULTIPLE = 5
GOODS_PRICE_SHARE = 0.85

STRENGTH_TEXTS = {
    "ext": "Strong external credit score",
    "employment": "Stable employment ({years:.1f} yrs)",
    "income": "High annual income",
    "dti": "Manageable Debt-to-Income (DTI) ratio",
    "realty": "Owns property (collateral)",
    "none": "No major strengths identified",
}
RISK_TEXTS = {
    "ext": "Low external credit score",
    "employment": "Very short employment history",
    "dti": "High Debt-to-Income (DTI) ratio ({pct:.1f}%)",
    "credit": "Loan amount very high vs income",
    "children": "High number of dependents",
    "none": "No major risk factors identified",
}
CONDITION_TEXTS = ["Submit last 3 months salary slips", "KYC documents required",
                   "ITR for last 2 years (if self-employed)"]
OFFICER_NOTE_PREFIX = "Applicant has a {pct:.1f}% estimated default probability. "
OFFICER_NOTE_ENDINGS = {
    "APPROVED": "Application meets lending criteria.",
    "CONDITIONAL": "Application carries elevated risk.",
    "REJECTED": "Does not meet minimum risk thresholds.",
}
DECISION_TITLES = {
    "APPROVED": "LOAN APPROVED",
    "CONDITIONAL": "CONDITIONAL APPROVAL",
    "REJECTED": "LOAN REJECTED",
}
BROWSER_TITLE_PREFIX = "LOAN "
CONFIDENCE_LABELS = ("Match", "Risk")     # approved, otherwise
RISK_BAND_EDGES = [(20, "low"), (40, "medium")]
RISK_BAND_ELSE = "high"
DTI_FLAG_PCT = 40
CIBIL_BASE, CIBIL_SPAN = 300, 600
CIBIL_BANDS = [(700, "success"), (550, "warning")]   # display class of the rounded score
CIBIL_ELSE = "danger"

# Fallback response when no model is loaded.
FALLBACK = {
    "decision": "CONDITIONAL",
    "confidence": 50.0,
    "prob_default": 50.0,
    "amount_share": 0.5,
    "rate_text": "12.0%",
    "emi_share": 0.02,
    "key_strengths": ["Pre-screening completed"],
    "key_risks": ["ML Model binary not loaded"],
    "conditions": ["Verify ID"],
    "officer_note": "ML Model was not loaded. Outputting rule-based pre-screening fallback.",
}

# Scoring-row constants.
REQUEST_CONSTANTS = {
    "NAME_CONTRACT_TYPE": "Cash loans",
    "FLAG_PHONE": 1,
    "FLAG_EMAIL": 0,
    "FLAG_WORK_PHONE": 1,
    "FLAG_DOCUMENT_3": 1,
    "REG_CITY_NOT_WORK_CITY": 0,
    "LIVE_CITY_NOT_WORK_CITY": 0,
    "REGION_POPULATION_RELATIVE": 0.025,
    "ORGANIZATION_TYPE": "Business Entity Type 3",
}

# Categorical columns label-encoded in the real-data mart and in the
# comparison set.
MART_CATEGORICAL = [
    "CODE_GENDER", "NAME_CONTRACT_TYPE", "FLAG_OWN_CAR", "FLAG_OWN_REALTY",
    "NAME_TYPE_SUITE", "NAME_INCOME_TYPE", "NAME_EDUCATION_TYPE",
    "NAME_FAMILY_STATUS", "NAME_HOUSING_TYPE", "OCCUPATION_TYPE",
    "WEEKDAY_APPR_PROCESS_START", "ORGANIZATION_TYPE",
    "FONDKAPREMONT_MODE", "HOUSETYPE_MODE", "WALLSMATERIAL_MODE", "EMERGENCYSTATE_MODE",
]
COMPARE_CATEGORICAL = ["CODE_GENDER", "NAME_FAMILY_STATUS", "NAME_EDUCATION_TYPE",
                       "NAME_HOUSING_TYPE", "NAME_INCOME_TYPE", "OCCUPATION_TYPE",
                       "ORGANIZATION_TYPE", "FLAG_OWN_CAR", "FLAG_OWN_REALTY"]
# Text a missing category turns into before encoding (str() of a missing
# value), and the fill text that the reference meant to use.
MISSING_CATEGORY_TEXT = "nan"
MISSING_CATEGORY_INTENDED = "Unknown"

ID_COL, LABEL_COL = "SK_ID_CURR", "TARGET"
TEST_SHARE, SPLIT_SEED = 0.2, 42
CLASS_NAMES = ["Repaid", "Default"]
LEADERBOARD_MARKS = ["gold", "silver", "bronze"]

# Closed-form default logit used to label synthetic applicants; here a
# deterministic baseline scorer.  (term, coefficient) in formula order.
LOGIT_INTERCEPT = -2.5
LOGIT_COEFFICIENTS = [
    ("ext1", -1.8), ("ext2", -2.2), ("ext3", -1.9),
    ("credit_income", 0.4), ("annuity_income", 0.3),
    ("age_years", -0.03), ("employment_years", -0.06),
    ("region_is_3", 0.15), ("is_unemployed", 0.2), ("is_higher_education", -0.2),
    ("lives_with_parents", 0.1), ("children", 0.08),
]
LOGIT_INCOME_CLIP = (15000.0, 1500000.0)

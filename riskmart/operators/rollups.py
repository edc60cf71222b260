"""Per-applicant rollups of the history tables and the feature mart.

Each rollup is one hash aggregate on ``SK_ID_CURR`` (Spark splits it into a
map-side partial and a final aggregate, so a hot applicant id is combined per
task before the shuffle and never lands as raw rows in one task).  The mart
left-joins the four rollups to the application table; all five sides are
hash-partitioned on the same key, so the plan has one exchange per input and
none between the joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.functions.nulls import clip_lower, count_true, sum_or_zero
from riskmart.schemas import ID_COL

BUREAU_COLS = ["BUREAU_LOAN_COUNT", "BUREAU_CREDIT_SUM", "BUREAU_CREDIT_SUM_DEBT",
               "BUREAU_CREDIT_SUM_MAX", "BUREAU_OVERDUE_COUNT", "BUREAU_ACTIVE_LOANS",
               "BUREAU_CLOSED_LOANS", "BUREAU_AVG_DAYS_CREDIT"]
PREVIOUS_COLS = ["PREV_APP_COUNT", "PREV_APP_APPROVED", "PREV_APP_REFUSED",
                 "PREV_AMT_CREDIT_MEAN", "PREV_AMT_ANNUITY_MEAN", "PREV_DAYS_DECISION_MEAN",
                 "PREV_APPROVAL_RATE"]
INSTALLMENT_COLS = ["INST_PAYMENT_DIFF_MEAN", "INST_PAYMENT_DIFF_SUM",
                    "INST_DAYS_PAST_DUE_MEAN", "INST_DAYS_PAST_DUE_MAX",
                    "INST_LATE_PAYMENTS", "INST_COUNT"]
POS_CASH_COLS = ["POS_MONTHS_BALANCE_MEAN", "POS_CNT_INSTALMENT_MEAN", "POS_SK_DPD_MEAN",
                 "POS_SK_DPD_MAX", "POS_SK_DPD_DEF_MEAN", "POS_COUNT"]
ROLLUP_COLS = BUREAU_COLS + PREVIOUS_COLS + INSTALLMENT_COLS + POS_CASH_COLS


def _keyed(df: DataFrame) -> DataFrame:
    # A missing group key is dropped by the reference's group-by.
    return df.where(F.col(ID_COL).isNotNull())


def _rollup(df: DataFrame, aggs: list[Column]) -> DataFrame:
    return _keyed(df).groupBy(ID_COL).agg(*aggs)


def rollup_bureau(bureau: DataFrame) -> DataFrame:
    return _rollup(bureau, [
        F.count("SK_ID_BUREAU").alias("BUREAU_LOAN_COUNT"),
        sum_or_zero("AMT_CREDIT_SUM").alias("BUREAU_CREDIT_SUM"),
        sum_or_zero("AMT_CREDIT_SUM_DEBT").alias("BUREAU_CREDIT_SUM_DEBT"),
        F.max("AMT_CREDIT_SUM").alias("BUREAU_CREDIT_SUM_MAX"),
        count_true(F.col("CREDIT_DAY_OVERDUE") > 0).alias("BUREAU_OVERDUE_COUNT"),
        count_true(F.col("CREDIT_ACTIVE") == "Active").alias("BUREAU_ACTIVE_LOANS"),
        count_true(F.col("CREDIT_ACTIVE") == "Closed").alias("BUREAU_CLOSED_LOANS"),
        F.avg("DAYS_CREDIT").alias("BUREAU_AVG_DAYS_CREDIT"),
    ])


def rollup_previous(previous: DataFrame) -> DataFrame:
    agg = _rollup(previous, [
        F.count("SK_ID_PREV").alias("PREV_APP_COUNT"),
        count_true(F.col("NAME_CONTRACT_STATUS") == "Approved").alias("PREV_APP_APPROVED"),
        count_true(F.col("NAME_CONTRACT_STATUS") == "Refused").alias("PREV_APP_REFUSED"),
        F.avg("AMT_CREDIT").alias("PREV_AMT_CREDIT_MEAN"),
        F.avg("AMT_ANNUITY").alias("PREV_AMT_ANNUITY_MEAN"),
        F.avg("DAYS_DECISION").alias("PREV_DAYS_DECISION_MEAN"),
    ])
    return agg.withColumn(
        "PREV_APPROVAL_RATE",
        F.col("PREV_APP_APPROVED").cast("double") / (F.col("PREV_APP_COUNT") + 1))


def installment_steps(installments: DataFrame) -> DataFrame:
    """Row-level payment difference and days past due (clipped at 0, a
    missing payment day stays missing)."""
    return installments.withColumns({
        "PAYMENT_DIFF": F.col("AMT_INSTALMENT") - F.col("AMT_PAYMENT"),
        "DAYS_PAST_DUE": clip_lower(
            (F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")).cast("double"), 0.0),
    })


def rollup_installments(installments: DataFrame) -> DataFrame:
    return _rollup(installment_steps(installments), [
        F.avg("PAYMENT_DIFF").alias("INST_PAYMENT_DIFF_MEAN"),
        sum_or_zero("PAYMENT_DIFF").alias("INST_PAYMENT_DIFF_SUM"),
        F.avg("DAYS_PAST_DUE").alias("INST_DAYS_PAST_DUE_MEAN"),
        F.max("DAYS_PAST_DUE").alias("INST_DAYS_PAST_DUE_MAX"),
        count_true(F.col("DAYS_PAST_DUE") > 0).alias("INST_LATE_PAYMENTS"),
        F.count("SK_ID_PREV").alias("INST_COUNT"),
    ])


def rollup_pos_cash(pos: DataFrame) -> DataFrame:
    return _rollup(pos, [
        F.avg("MONTHS_BALANCE").alias("POS_MONTHS_BALANCE_MEAN"),
        F.avg("CNT_INSTALMENT").alias("POS_CNT_INSTALMENT_MEAN"),
        F.avg("SK_DPD").alias("POS_SK_DPD_MEAN"),
        F.max("SK_DPD").alias("POS_SK_DPD_MAX"),
        F.avg("SK_DPD_DEF").alias("POS_SK_DPD_DEF_MEAN"),
        F.count("SK_ID_PREV").alias("POS_COUNT"),
    ])


def attach(app: DataFrame, rollup: DataFrame) -> DataFrame:
    """Left join of one rollup (unique per key) to the application rows."""
    return app.join(rollup, on=ID_COL, how="left")


def feature_mart(app: DataFrame, bureau: DataFrame | None = None,
                 previous: DataFrame | None = None, installments: DataFrame | None = None,
                 pos: DataFrame | None = None) -> DataFrame:
    """application + four rollups, one row per application row."""
    out = app
    if bureau is not None:
        out = attach(out, rollup_bureau(bureau))
    if previous is not None:
        out = attach(out, rollup_previous(previous))
    if installments is not None:
        out = attach(out, rollup_installments(installments))
    if pos is not None:
        out = attach(out, rollup_pos_cash(pos))
    return out


def mart_from_tables(tables) -> DataFrame:
    """Feature mart from a ``LendingTables``-like object."""
    return feature_mart(tables.application(), tables.bureau(), tables.previous_application(),
                        tables.installments_payments(), tables.pos_cash_balance())

"""PRF-1: shape of each input table and the positive share of the label.

One global aggregate per table (partial counts per task, one tiny final
merge); the column count comes from the schema, not from the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.schemas import LABEL_COL


def profile(df: DataFrame, table_name: str, target: str | None = LABEL_COL) -> DataFrame:
    mean = (F.avg(F.col(target).cast("double")) if target and target in df.columns
            else F.lit(None).cast("double"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), mean.alias("target_mean")).select(
        F.lit(table_name).alias("table_name"), "n_rows",
        F.lit(len(df.columns)).alias("n_cols"), "target_mean")


def profile_tables(tables) -> DataFrame:
    parts = [
        profile(tables.application(), "application"),
        profile(tables.bureau(), "bureau"),
        profile(tables.previous_application(), "previous_application"),
        profile(tables.installments_payments(), "installments_payments"),
        profile(tables.pos_cash_balance(), "POS_CASH_balance"),
    ]
    return reduce(DataFrame.unionByName, parts)

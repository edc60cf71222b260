"""Test-table adapter: TPC-H-like parquet tables -> lending views.

The driver's test data has no lending tables, so each lending view is a
deterministic projection of customer / orders / lineitem (rules fixed in
FIXTURES.md section 2, mirrored in plans/oracle.py for DuckDB).  Every view
reads the parquet scans lazily; Catalyst prunes columns and pushes the
key filters into the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_ZERO = "2002-01-01"

# TPC-H market segment -> income type (fixed test rule).
_SEGMENT_INCOME = [("AUTOMOBILE", "Working"), ("BUILDING", "Commercial associate"),
                   ("FURNITURE", "State servant"), ("HOUSEHOLD", "Pensioner")]
_EDUCATION = ["Higher education", "Secondary", "Incomplete higher", "Lower secondary",
              "Academic degree"]
_HOUSING = ["House / apartment", "With parents", "Municipal apartment", "Rented apartment",
            "Office apartment"]
_FAMILY = ["Married", "Single / not married", "Civil marriage", "Separated", "Widow"]
_OCCUPATION = ["Laborers", "Core staff", "Managers", "Drivers"]
_TENURES = [12, 24, 36, 48, 60, 84, 120, 180, 240, 360]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def days(c: Column) -> Column:
    """Whole days from the fixed day zero (negative offsets in the past)."""
    return F.datediff(c.cast("date"), F.lit(DAY_ZERO).cast("date")).cast("int")


def _pick(index: Column, values: list) -> Column:
    """CASE index WHEN 0 THEN values[0] ... ELSE values[-1]."""
    expr = None
    for i, v in enumerate(values[:-1]):
        expr = F.when(index == i, F.lit(v)) if expr is None else expr.when(index == i, F.lit(v))
    return expr.otherwise(F.lit(values[-1]))


def _frac(k: Column, mul: int, add: int, mod: int, div: int) -> Column:
    return ((k * mul + add) % mod).cast("double") / div


def _income_type(k: Column, seg: Column) -> Column:
    e = F.when(k % 17 == 0, F.lit("Unemployed"))
    for s, v in _SEGMENT_INCOME:
        e = e.when(seg == s, F.lit(v))
    return e.otherwise(F.lit("Self-employed"))


def _tenure(k: Column) -> Column:
    return _pick(k % 10, _TENURES)


def application(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k, nk = F.col("c_custkey"), F.col("c_nationkey")
    credit = (F.lit(45000) + (k * 7919) % 950000).cast("double")
    return c.select(
        k.alias("SK_ID_CURR"),
        F.when(_frac(k, 31, 0, 1001, 1000) + _frac(k, 57, 13, 1001, 1000)
               + _frac(k, 7907, 0, 1009, 1009) < 0.9, 1).otherwise(0).cast("int").alias("TARGET"),
        F.when(k % 3 == 0, "M").otherwise("F").alias("CODE_GENDER"),
        (-(F.lit(7700) + (k * 37) % 17800)).cast("int").alias("DAYS_BIRTH"),
        F.when(k % 11 == 0, F.lit(365243)).when(k % 19 == 1, F.lit(None))
         .otherwise(-((k * 53) % 9000)).cast("int").alias("DAYS_EMPLOYED"),
        (k % 5).cast("int").alias("CNT_CHILDREN"),
        (k % 5 + 1 + k % 2).cast("int").alias("CNT_FAM_MEMBERS"),
        ((F.col("c_acctbal") + 1000) * 100).alias("AMT_INCOME_TOTAL"),
        credit.alias("AMT_CREDIT"),
        F.when(k % 23 == 2, F.lit(None).cast("double"))
         .otherwise(credit / _tenure(k)).alias("AMT_ANNUITY"),
        (credit * 0.85).alias("AMT_GOODS_PRICE"),
        F.when(k % 7 == 0, F.lit(None).cast("double")).otherwise(_frac(k, 31, 0, 1001, 1000)).alias("EXT_SOURCE_1"),
        F.when(k % 41 == 0, F.lit(None).cast("double")).otherwise(_frac(k, 57, 13, 1001, 1000)).alias("EXT_SOURCE_2"),
        F.when(k % 5 == 2, F.lit(None).cast("double")).otherwise(_frac(k, 91, 7, 1001, 1000)).alias("EXT_SOURCE_3"),
        F.when(k % 4 == 0, "Revolving loans").otherwise("Cash loans").alias("NAME_CONTRACT_TYPE"),
        _pick(nk % 5, _EDUCATION).alias("NAME_EDUCATION_TYPE"),
        _income_type(k, F.col("c_mktsegment")).alias("NAME_INCOME_TYPE"),
        _pick((k * 3) % 5, _HOUSING).alias("NAME_HOUSING_TYPE"),
        _pick((k * 2) % 5, _FAMILY).alias("NAME_FAMILY_STATUS"),
        F.when(k % 2 == 0, "Y").otherwise("N").alias("FLAG_OWN_CAR"),
        F.when(k % 3 == 1, "Y").otherwise("N").alias("FLAG_OWN_REALTY"),
        F.when(k % 20 == 0, F.lit(None).cast("string")).otherwise(_pick(nk % 4, _OCCUPATION)).alias("OCCUPATION_TYPE"),
        (nk % 3 + 1).cast("int").alias("REGION_RATING_CLIENT"),
    )


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k, nk = F.col("c_custkey"), F.col("c_nationkey")
    return c.select(
        k.alias("applicant_id"),
        F.when(k % 43 == 1, F.lit(None).cast("string")).otherwise(F.col("c_name")).alias("name"),
        F.when(k % 37 == 5, F.lit(17.0))
         .otherwise((F.lit(7700) + (k * 37) % 17800).cast("double") / 365).alias("age"),
        F.when(k % 3 == 0, "M").otherwise("F").alias("gender"),
        _pick(nk % 5, _EDUCATION).alias("education"),
        _pick((k * 2) % 5, _FAMILY).alias("family_status"),
        (k % 5).cast("int").alias("children"),
        (k % 4 + 1).cast("int").alias("family_members"),
        F.when(k % 2 == 0, "Y").otherwise("N").alias("own_car"),
        F.when(k % 3 == 1, "Y").otherwise("N").alias("own_realty"),
        _income_type(k, F.col("c_mktsegment")).alias("income_type"),
        F.when(k % 53 == 7, F.lit(0.0)).otherwise((F.col("c_acctbal") + 1000) * 10).alias("monthly_income"),
        _pick(nk % 4, _OCCUPATION).alias("occupation"),
        ((k * 11) % 200).cast("int").alias("employment_months"),
        _pick((k * 3) % 5, _HOUSING).alias("housing_type"),
        F.when(k % 47 == 9, F.lit(None)).otherwise(nk % 3 + 1).cast("int").alias("region_rating"),
        F.when(k % 29 == 3, F.lit(500.0))
         .otherwise((F.lit(45000) + (k * 7919) % 950000).cast("double")).alias("loan_amount"),
        _pick(k % 3, ["Home Loan", "Personal Loan", "Gold Loan"]).alias("loan_purpose"),
        _tenure(k).cast("int").alias("tenure_months"),
        F.when(k % 31 == 4, F.lit(1.2)).otherwise(_frac(k, 31, 0, 1001, 1000)).alias("ext1"),
        _frac(k, 57, 13, 1001, 1000).alias("ext2"),
        F.when(k % 13 == 6, F.lit(None).cast("double")).otherwise(_frac(k, 91, 7, 1001, 1000)).alias("ext3"),
    )


def bureau(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        ck.alias("SK_ID_CURR"),
        ok.alias("SK_ID_BUREAU"),
        F.col("o_totalprice").alias("AMT_CREDIT_SUM"),
        F.when((ok % 9 == 0) | (ck % 13 == 5), F.lit(None).cast("double"))
         .otherwise(F.col("o_totalprice") * 0.4).alias("AMT_CREDIT_SUM_DEBT"),
        F.when(F.col("o_orderpriority") == "1-URGENT", ok % 60).otherwise(0).cast("int").alias("CREDIT_DAY_OVERDUE"),
        F.when(F.col("o_orderstatus") == "O", "Active").when(F.col("o_orderstatus") == "F", "Closed")
         .otherwise("Sold").alias("CREDIT_ACTIVE"),
        days(F.col("o_orderdate")).alias("DAYS_CREDIT"),
    )


def previous_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        ck.alias("SK_ID_CURR"),
        ok.alias("SK_ID_PREV"),
        F.when(F.col("o_orderstatus") == "F", "Approved").when(F.col("o_orderstatus") == "P", "Refused")
         .otherwise("Canceled").alias("NAME_CONTRACT_STATUS"),
        F.col("o_totalprice").alias("AMT_CREDIT"),
        F.when(ok % 8 == 0, F.lit(None).cast("double")).otherwise(F.col("o_totalprice") / 24).alias("AMT_ANNUITY"),
        days(F.col("o_orderdate")).alias("DAYS_DECISION"),
    )


def _lines_with_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"], "inner")


def installments_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _lines_with_customer(spark, sf_dir)
    seventh = F.col("l_linenumber") == 7
    return j.select(
        F.col("o_custkey").alias("SK_ID_CURR"),
        F.col("l_orderkey").alias("SK_ID_PREV"),
        F.col("l_extendedprice").alias("AMT_INSTALMENT"),
        F.when(seventh, F.lit(None).cast("double"))
         .otherwise(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("AMT_PAYMENT"),
        days(F.col("l_shipdate")).alias("DAYS_INSTALMENT"),
        F.when(seventh, F.lit(None).cast("int"))
         .otherwise(days(F.col("l_shipdate")) + F.col("l_quantity").cast("int") - 25)
         .cast("int").alias("DAYS_ENTRY_PAYMENT"),
    )


def pos_cash_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _lines_with_customer(spark, sf_dir)
    returned = F.col("l_returnflag") == "R"
    return j.select(
        F.col("o_custkey").alias("SK_ID_CURR"),
        F.col("l_orderkey").alias("SK_ID_PREV"),
        (-F.col("l_linenumber")).cast("int").alias("MONTHS_BALANCE"),
        F.col("l_quantity").alias("CNT_INSTALMENT"),
        F.when(returned, F.col("l_partkey") % 40).otherwise(0).cast("int").alias("SK_DPD"),
        F.when(returned & (F.col("l_linestatus") == "F"), F.col("l_partkey") % 10)
         .otherwise(0).cast("int").alias("SK_DPD_DEF"),
    )


class LendingTables:
    """The five history tables plus applicants for one test-data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def application(self) -> DataFrame:
        return application(self.spark, self.sf_dir)

    def applicants(self) -> DataFrame:
        return applicants(self.spark, self.sf_dir)

    def bureau(self) -> DataFrame:
        return bureau(self.spark, self.sf_dir)

    def previous_application(self) -> DataFrame:
        return previous_application(self.spark, self.sf_dir)

    def installments_payments(self) -> DataFrame:
        return installments_payments(self.spark, self.sf_dir)

    def pos_cash_balance(self) -> DataFrame:
        return pos_cash_balance(self.spark, self.sf_dir)

"""DuckDB text of the test-table adapter (FIXTURES.md section 2).

The oracle queries run in DuckDB against the driver's parquet views; these
CTEs give them the same lending views that ``sources.adapter`` builds in
Spark.  Integer columns are cast to the Spark types (INT / BIGINT).
"""

from __future__ import annotations

DAYS = "CAST(date_diff('day', DATE '2002-01-01', CAST({x} AS DATE)) AS INTEGER)"

_TENURE = ("(CASE c_custkey % 10 WHEN 0 THEN 12 WHEN 1 THEN 24 WHEN 2 THEN 36 WHEN 3 THEN 48 "
           "WHEN 4 THEN 60 WHEN 5 THEN 84 WHEN 6 THEN 120 WHEN 7 THEN 180 WHEN 8 THEN 240 "
           "ELSE 360 END)")
_EDU = ("CASE c_nationkey%5 WHEN 0 THEN 'Higher education' WHEN 1 THEN 'Secondary' "
        "WHEN 2 THEN 'Incomplete higher' WHEN 3 THEN 'Lower secondary' ELSE 'Academic degree' END")
_INCOME_TYPE = ("CASE WHEN c_custkey%17=0 THEN 'Unemployed' WHEN c_mktsegment='AUTOMOBILE' THEN 'Working' "
                "WHEN c_mktsegment='BUILDING' THEN 'Commercial associate' "
                "WHEN c_mktsegment='FURNITURE' THEN 'State servant' "
                "WHEN c_mktsegment='HOUSEHOLD' THEN 'Pensioner' ELSE 'Self-employed' END")
_HOUSING = ("CASE (c_custkey*3)%5 WHEN 0 THEN 'House / apartment' WHEN 1 THEN 'With parents' "
            "WHEN 2 THEN 'Municipal apartment' WHEN 3 THEN 'Rented apartment' ELSE 'Office apartment' END")
_FAMILY = ("CASE (c_custkey*2)%5 WHEN 0 THEN 'Married' WHEN 1 THEN 'Single / not married' "
           "WHEN 2 THEN 'Civil marriage' WHEN 3 THEN 'Separated' ELSE 'Widow' END")
_OCC = ("CASE c_nationkey%4 WHEN 0 THEN 'Laborers' WHEN 1 THEN 'Core staff' WHEN 2 THEN 'Managers' "
        "ELSE 'Drivers' END")

APPLICATION = f"""
SELECT c_custkey AS SK_ID_CURR,
 CAST(CASE WHEN CAST((c_custkey*31)%1001 AS DOUBLE)/1000 + CAST((c_custkey*57+13)%1001 AS DOUBLE)/1000
   + CAST((c_custkey*7907)%1009 AS DOUBLE)/1009 < 0.9 THEN 1 ELSE 0 END AS INTEGER) AS TARGET,
 CASE c_custkey%3 WHEN 0 THEN 'M' ELSE 'F' END AS CODE_GENDER,
 CAST(-(7700 + (c_custkey*37)%17800) AS INTEGER) AS DAYS_BIRTH,
 CAST(CASE WHEN c_custkey%11=0 THEN 365243 WHEN c_custkey%19=1 THEN NULL
   ELSE -((c_custkey*53)%9000) END AS INTEGER) AS DAYS_EMPLOYED,
 CAST(c_custkey%5 AS INTEGER) AS CNT_CHILDREN,
 CAST(c_custkey%5+1+c_custkey%2 AS INTEGER) AS CNT_FAM_MEMBERS,
 (c_acctbal+1000)*100 AS AMT_INCOME_TOTAL,
 CAST(45000+(c_custkey*7919)%950000 AS DOUBLE) AS AMT_CREDIT,
 CASE WHEN c_custkey%23=2 THEN NULL ELSE CAST(45000+(c_custkey*7919)%950000 AS DOUBLE)/{_TENURE} END AS AMT_ANNUITY,
 CAST(45000+(c_custkey*7919)%950000 AS DOUBLE)*0.85 AS AMT_GOODS_PRICE,
 CASE WHEN c_custkey%7=0 THEN NULL ELSE CAST((c_custkey*31)%1001 AS DOUBLE)/1000 END AS EXT_SOURCE_1,
 CASE WHEN c_custkey%41=0 THEN NULL ELSE CAST((c_custkey*57+13)%1001 AS DOUBLE)/1000 END AS EXT_SOURCE_2,
 CASE WHEN c_custkey%5=2 THEN NULL ELSE CAST((c_custkey*91+7)%1001 AS DOUBLE)/1000 END AS EXT_SOURCE_3,
 CASE c_custkey%4 WHEN 0 THEN 'Revolving loans' ELSE 'Cash loans' END AS NAME_CONTRACT_TYPE,
 {_EDU} AS NAME_EDUCATION_TYPE,
 {_INCOME_TYPE} AS NAME_INCOME_TYPE,
 {_HOUSING} AS NAME_HOUSING_TYPE,
 {_FAMILY} AS NAME_FAMILY_STATUS,
 CASE WHEN c_custkey%2=0 THEN 'Y' ELSE 'N' END AS FLAG_OWN_CAR,
 CASE WHEN c_custkey%3=1 THEN 'Y' ELSE 'N' END AS FLAG_OWN_REALTY,
 CASE WHEN c_custkey%20=0 THEN NULL WHEN c_nationkey%4=0 THEN 'Laborers' WHEN c_nationkey%4=1 THEN 'Core staff'
   WHEN c_nationkey%4=2 THEN 'Managers' ELSE 'Drivers' END AS OCCUPATION_TYPE,
 CAST(c_nationkey%3+1 AS INTEGER) AS REGION_RATING_CLIENT
FROM customer"""

APPLICANTS = f"""
SELECT c_custkey AS applicant_id, CASE WHEN c_custkey%43=1 THEN NULL ELSE c_name END AS name,
 CASE WHEN c_custkey%37=5 THEN 17.0 ELSE CAST(7700+(c_custkey*37)%17800 AS DOUBLE)/365 END AS age,
 CASE c_custkey%3 WHEN 0 THEN 'M' ELSE 'F' END AS gender,
 {_EDU} AS education,
 {_FAMILY} AS family_status,
 CAST(c_custkey%5 AS INTEGER) AS children, CAST(c_custkey%4+1 AS INTEGER) AS family_members,
 CASE WHEN c_custkey%2=0 THEN 'Y' ELSE 'N' END AS own_car,
 CASE WHEN c_custkey%3=1 THEN 'Y' ELSE 'N' END AS own_realty,
 {_INCOME_TYPE} AS income_type,
 CASE WHEN c_custkey%53=7 THEN 0.0 ELSE (c_acctbal+1000)*10 END AS monthly_income,
 {_OCC} AS occupation,
 CAST((c_custkey*11)%200 AS INTEGER) AS employment_months,
 {_HOUSING} AS housing_type,
 CAST(CASE WHEN c_custkey%47=9 THEN NULL ELSE c_nationkey%3+1 END AS INTEGER) AS region_rating,
 CASE WHEN c_custkey%29=3 THEN 500.0 ELSE CAST(45000+(c_custkey*7919)%950000 AS DOUBLE) END AS loan_amount,
 CASE c_custkey%3 WHEN 0 THEN 'Home Loan' WHEN 1 THEN 'Personal Loan' ELSE 'Gold Loan' END AS loan_purpose,
 CAST({_TENURE} AS INTEGER) AS tenure_months,
 CASE WHEN c_custkey%31=4 THEN 1.2 ELSE CAST((c_custkey*31)%1001 AS DOUBLE)/1000 END AS ext1,
 CAST((c_custkey*57+13)%1001 AS DOUBLE)/1000 AS ext2,
 CASE WHEN c_custkey%13=6 THEN NULL ELSE CAST((c_custkey*91+7)%1001 AS DOUBLE)/1000 END AS ext3
FROM customer"""

BUREAU = f"""
SELECT o_custkey AS SK_ID_CURR, o_orderkey AS SK_ID_BUREAU, o_totalprice AS AMT_CREDIT_SUM,
 CASE WHEN o_orderkey%9=0 OR o_custkey%13=5 THEN NULL ELSE o_totalprice*0.4 END AS AMT_CREDIT_SUM_DEBT,
 CAST(CASE WHEN o_orderpriority='1-URGENT' THEN o_orderkey%60 ELSE 0 END AS INTEGER) AS CREDIT_DAY_OVERDUE,
 CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'F' THEN 'Closed' ELSE 'Sold' END AS CREDIT_ACTIVE,
 {DAYS.format(x='o_orderdate')} AS DAYS_CREDIT
FROM orders"""

PREVIOUS = f"""
SELECT o_custkey AS SK_ID_CURR, o_orderkey AS SK_ID_PREV,
 CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'P' THEN 'Refused' ELSE 'Canceled' END AS NAME_CONTRACT_STATUS,
 o_totalprice AS AMT_CREDIT, CASE WHEN o_orderkey%8=0 THEN NULL ELSE o_totalprice/24 END AS AMT_ANNUITY,
 {DAYS.format(x='o_orderdate')} AS DAYS_DECISION
FROM orders"""

INSTALLMENTS = f"""
SELECT o_custkey AS SK_ID_CURR, l_orderkey AS SK_ID_PREV, l_extendedprice AS AMT_INSTALMENT,
 CASE WHEN l_linenumber=7 THEN NULL ELSE l_extendedprice*(1-l_discount) END AS AMT_PAYMENT,
 {DAYS.format(x='l_shipdate')} AS DAYS_INSTALMENT,
 CAST(CASE WHEN l_linenumber=7 THEN NULL
   ELSE {DAYS.format(x='l_shipdate')} + CAST(l_quantity AS INT) - 25 END AS INTEGER) AS DAYS_ENTRY_PAYMENT
FROM lineitem JOIN orders ON l_orderkey=o_orderkey"""

POS_CASH = """
SELECT o_custkey AS SK_ID_CURR, l_orderkey AS SK_ID_PREV, CAST(-l_linenumber AS INTEGER) AS MONTHS_BALANCE,
 l_quantity AS CNT_INSTALMENT,
 CAST(CASE WHEN l_returnflag='R' THEN l_partkey%40 ELSE 0 END AS INTEGER) AS SK_DPD,
 CAST(CASE WHEN l_returnflag='R' AND l_linestatus='F' THEN l_partkey%10 ELSE 0 END AS INTEGER) AS SK_DPD_DEF
FROM lineitem JOIN orders ON l_orderkey=o_orderkey"""

VIEWS = {
    "application": APPLICATION,
    "applicants": APPLICANTS,
    "bureau": BUREAU,
    "previous_application": PREVIOUS,
    "installments_payments": INSTALLMENTS,
    "pos_cash_balance": POS_CASH,
}


def with_views(body: str, extra: dict | None = None) -> str:
    """``WITH <adapter views>, <extra CTEs> <body>``."""
    ctes = {**VIEWS, **(extra or {})}
    parts = [f"{name} AS ({sql.strip()})" for name, sql in ctes.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


def round_sql(inner: str, digits: dict[str, int]) -> str:
    """Round the named double columns as ``catalog.rounded`` does."""
    if not digits:
        return inner

    def one(c, d):
        if d > 6:
            return f"round_even({c}, {d})"
        return f"floor((round_even({c} * 1e{d + 3}, 0) + 500) / 1000) / 1e{d}"
    rep = ", ".join(f"{one(c, d)} AS {c}" for c, d in digits.items())
    return f"SELECT * REPLACE ({rep}) FROM ({inner}) AS r"

"""Request validation and normalisation (VAL-1..6, NRM-1..6).

Requests are rows of a DataFrame; each rule is a column expression, so a
whole table of applicants is checked in one narrow projection (no shuffle).
Violations are collected per row as ``array<string>`` of rule codes
``<field>:<rule>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.schemas import (APPLICANT_DEFAULTS, BROWSER_RANGES, APPLICANT_FLOAT_FIELDS, APPLICANT_INT_FIELDS,
                              FORM_OPTIONS, FORM_RANGES, IRREGULAR_TENURE_RESET_MONTHS,
                              NAME_PLACEHOLDER, REQUIRED_FIELDS, SERVICE_RANGES,
                              UNKNOWN_OCCUPATION)

VIOLATIONS = "violations"
LARGEST = 2.0 ** 53      # amounts are whole numbers in the answer; beyond this a double skips some


def fill_defaults(df: DataFrame) -> DataFrame:
    """VAL-1: an absent optional field takes its default.  (A JSON scan
    cannot tell an explicit null from an absent key; both are defaulted.)"""
    present = set(df.columns)
    cols = {}
    for name, default in APPLICANT_DEFAULTS.items():
        cols[name] = (F.coalesce(F.col(name), F.lit(default)) if name in present
                      else F.lit(default))
    return df.withColumns(cols)


def finite(c: Column) -> Column:
    """Neither missing, NaN nor infinite (NaN sorts above all numbers)."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def coerce(df: DataFrame) -> DataFrame:
    """VAL-2: text fields -> numbers.  Int fields accept whole numbers
    written as text or as floats; anything else, and a number that is not
    finite, becomes NULL and is reported as ``<field>:type`` by
    ``violations``.  So is an ``applicant_id`` that is no whole number."""
    cols, bad = {}, []
    if "applicant_id" in df.columns:
        raw = F.col("applicant_id")
        cols["applicant_id"] = raw.cast("string").try_cast("bigint")
        bad.append(F.when(raw.isNotNull() & cols["applicant_id"].isNull(), F.lit("applicant_id:type")))
    for f in APPLICANT_FLOAT_FIELDS:
        if f in df.columns:
            raw = F.col(f)
            d = raw.cast("string").try_cast("double")
            cols[f] = F.when(finite(d), d)
            bad.append(F.when(raw.isNotNull() & cols[f].isNull(), F.lit(f"{f}:type")))
    for f in APPLICANT_INT_FIELDS:
        if f in df.columns:
            raw = F.col(f)
            d = raw.cast("string").try_cast("double")
            whole = d.isNotNull() & (d == F.floor(d)) & (F.abs(d) < 2147483648.0)
            cols[f] = F.when(whole, d.cast("int"))
            bad.append(F.when(raw.isNotNull() & ~F.coalesce(whole, F.lit(False)),
                              F.lit(f"{f}:type")))
    # One projection: the type checks must read the raw text columns.
    errors = (F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>"))
    if "_explicit_nulls" in df.columns:
        errors = F.concat(F.col("_explicit_nulls"), errors)
    cols["_type_errors"] = errors
    out = df.withColumns(cols)
    return out.drop("_explicit_nulls") if "_explicit_nulls" in df.columns else out


def _range_rules(ranges: dict, present: set) -> list[Column]:
    """A value breaks a limit unless it surely keeps it, so NaN breaks all.
    Numbers that a whole-number result cannot hold break ``:max``."""
    rules = []
    for field, (lo, hi) in ranges.items():
        if field not in present:
            continue
        c = F.col(field).cast("double")
        keeps = lambda test: test & ~F.isnan(c)
        if lo is not None:
            rules.append(F.when(c.isNotNull() & ~keeps(c >= lo), F.lit(f"{field}:min")))
        rules.append(F.when(c.isNotNull() & ~keeps((c <= hi) if hi is not None else (F.abs(c) < LARGEST)),
                            F.lit(f"{field}:max")))
    return rules


def violation_rules(df: DataFrame, profile: str = "service") -> list[Column]:
    present = set(df.columns)
    rules = [F.when(F.col(f).isNull(), F.lit(f"{f}:required"))
             for f in REQUIRED_FIELDS if f in present]
    ranges = {"service": SERVICE_RANGES, "form": FORM_RANGES, "browser": BROWSER_RANGES}[profile]
    rules += _range_rules(ranges, present)
    if profile in ("form", "browser"):
        rules += domain_rules(df)
    return rules


def domain_rules(df: DataFrame) -> list[Column]:
    """VAL-6: value must be one of the offered options."""
    present = set(df.columns)
    return [F.when(F.col(f).isNotNull() & ~F.col(f).isin(*opts), F.lit(f"{f}:option"))
            for f, opts in FORM_OPTIONS.items() if f in present]


def violations(df: DataFrame, profile: str = "service") -> DataFrame:
    """VAL-3 / VAL-5: add ``violations`` (array of rule codes, empty when the
    row is valid).  ``profile='form'`` applies the stricter form limits and
    the option lists, ``profile='browser'`` the browser form's limits (no
    upper bound on income or amount) and the option lists."""
    arr = F.array_compact(F.array(*violation_rules(df, profile)))
    if "_type_errors" in df.columns:
        arr = F.concat(F.col("_type_errors"), arr)
        return df.withColumn(VIOLATIONS, arr).drop("_type_errors")
    return df.withColumn(VIOLATIONS, arr)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """VAL-4: (valid, rejected); expects ``violations`` to be present."""
    ok = F.size(F.col(VIOLATIONS)) == 0
    return df.where(ok), df.where(~ok)


def prepare_requests(df: DataFrame, profile: str = "service") -> DataFrame:
    """defaults -> violations, the order the service applies them."""
    return violations(fill_defaults(df), profile)


def valid_requests(df: DataFrame) -> DataFrame:
    return split_valid(prepare_requests(df))[0].drop(VIOLATIONS)


# --------------------------------------------------------------------------
# Normalisation of form input
# --------------------------------------------------------------------------

def months_from_years(years, mode: str = "truncate") -> Column:
    """NRM-2: employment months from years; ``truncate`` (int()) or
    ``round`` (JavaScript Math.round: floor(x + 0.5))."""
    y = F.col(years) if isinstance(years, str) else years
    m = y * 12
    return (F.floor(m + 0.5) if mode == "round" else m).cast("int")


def number_or_zero(text) -> Column:
    """NRM-6: unparsable numeric text -> 0 (parseFloat(v) || 0)."""
    t = F.col(text) if isinstance(text, str) else text
    d = t.cast("string").try_cast("double")
    return F.when(d.isNull() | F.isnan(d), F.lit(0.0)).otherwise(d)


def normalise(df: DataFrame, mode: str = "form") -> DataFrame:
    """NRM-1, 3, 4, 5 (and NRM-2 when ``employment_years`` is given).

    * family members >= children + 1 (form only; the service does not clamp)
    * irregular tenure flag -> 0 months
    * occupation Unknown when unemployed or without income
    * blank name -> placeholder
    """
    cols = {}
    present = set(df.columns)
    if "employment_years" in present:
        cols["employment_months"] = months_from_years(
            "employment_years", "round" if mode == "browser" else "truncate")
    if "irregular_tenure" in present:
        base = cols.get("employment_months", F.col("employment_months"))
        reset = F.lit(0)
        cols["employment_months"] = F.when(F.col("irregular_tenure"), reset).otherwise(
            base if mode == "form" else F.coalesce(base, F.lit(IRREGULAR_TENURE_RESET_MONTHS)))
    if mode == "form":
        cols["family_members"] = F.greatest(F.col("family_members"), F.col("children") + 1)
        cols["occupation"] = F.when(
            (F.col("income_type") == "Unemployed") | (F.col("monthly_income") <= 0),
            F.lit(UNKNOWN_OCCUPATION)).otherwise(F.col("occupation"))
    cols["name"] = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit(NAME_PLACEHOLDER))
    return df.withColumns(cols)

"""Readers for the lending tables (SRC-1..7).

CSV columns are found by the names in the file's header, whatever their
order; cells are read as text and converted, so a whole number written as
``-1180.0`` stays whole and the text ``NaN`` is missing.  A file without a
required column is refused.  Request records are JSON read with every field
as text and coerced afterwards (browsers send "2" for ints).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmart.functions.nulls import nan_to_null_all
from riskmart.operators.validation import coerce
from riskmart.schemas import (APPLICANT_DEFAULTS, APPLICANT_RAW_SCHEMA, APPLICATION_SCHEMA, BUREAU_SCHEMA,
                              INSTALLMENTS_SCHEMA, POS_CASH_SCHEMA, PREVIOUS_SCHEMA)

RAW_TEXT = "_request"
BAD, LINE = "_bad_cells", "_line"

FILE_NAMES = {
    "application": "application_train",
    "bureau": "bureau",
    "previous_application": "previous_application",
    "installments_payments": "installments_payments",
    "pos_cash_balance": "POS_CASH_balance",
}


def csv_text(spark: SparkSession, path: str, schema) -> DataFrame:
    """All columns as text under the header's names.  Files of a folder whose
    headers differ, and a missing required column, raise."""
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    missing = [f.name for f in schema.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    return raw


def cell(name: str, kind: T.DataType) -> Column:
    """One text cell as its type; NULL where it does not parse."""
    text = F.trim(F.col(f"`{name}`"))
    if isinstance(kind, T.StringType):
        return F.col(f"`{name}`")
    number = F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))
    if isinstance(kind, (T.IntegerType, T.LongType)):
        whole = F.when(number == F.floor(number), number).cast("string").try_cast("decimal(38,0)")
        return F.coalesce(text.try_cast(kind), whole.try_cast(kind))
    return number


def _is_bad(f) -> Column:
    """Whether a text cell is neither a value of the field's type nor missing."""
    text = F.trim(F.col(f"`{f.name}`"))
    return (text != "") & (F.lower(text) != "nan") & cell(f.name, f.dataType).isNull()


def bad_cells(spark: SparkSession, path: str, schema) -> DataFrame:
    """(column, n): cells of typed columns that hold a text which is neither
    a value of the type nor missing."""
    typed = [f for f in schema.fields if not isinstance(f.dataType, T.StringType)]
    counts = csv_text(spark, path, schema).agg(*[F.count_if(_is_bad(f)).alias(f.name) for f in typed])
    pairs = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"`{f.name}`").alias("n")) for f in typed])
    return counts.select(F.inline(pairs)).where("n > 0")


def read_csv_table(spark: SparkSession, path: str, schema, further: bool = False) -> DataFrame:
    """The schema's columns, typed.  ``further`` keeps the file's other
    columns after them: as numbers where every cell is one, else as text."""
    raw = csv_text(spark, path, schema)
    known = [f.name for f in schema.fields]
    more = [c for c in raw.columns if c not in known] if further else []
    numeric = {}
    if more:
        one = lambda c: F.trim(F.col(f"`{c}`"))
        numeric = raw.agg(*[F.bool_and((one(c) == "") | one(c).try_cast("double").isNotNull()).alias(c)
                            for c in more]).first().asDict()
    return raw.select(*[cell(f.name, f.dataType).alias(f.name) for f in schema.fields],
                      *[(cell(c, T.DoubleType()) if numeric[c] else F.col(f"`{c}`")).alias(c) for c in more])


class Ingested(NamedTuple):
    """A file read once: its typed rows, its rejected cells (the schema's
    ``keys``, column, text, line) and counts (n_rows, n_bad_rows, n_bad_cells)."""
    rows: DataFrame
    rejected: DataFrame
    counts: dict


def ingest_csv(spark: SparkSession, path: str, schema, out_dir: str, keys: tuple[str, ...] = (),
               further: bool = False) -> Ingested:
    """Read CSV files with quarantine, in one scan of the text: typed rows are
    written to ``out_dir`` together with the cells that do not parse, and the
    counts are observed while writing.  A rejected cell is NULL in the rows, as
    ``read_csv_table`` has it, and a row of ``rejected`` with the cell's text
    and the row's cells as one CSV line.  ``further`` keeps the file's other
    columns: they are written as text, and read as numbers where the same scan
    saw nothing else in them."""
    raw = csv_text(spark, path, schema)
    known = [f.name for f in schema.fields]
    more = [c for c in raw.columns if c not in known] if further else []
    typed = [f for f in schema.fields if not isinstance(f.dataType, T.StringType)]
    found = F.array_compact(F.array(*[F.when(_is_bad(f), F.struct(F.lit(f.name).alias("column"), F.col(f"`{f.name}`").alias("text")))
                                      for f in typed]))
    line = F.when(F.size(found) > 0, F.to_csv(F.struct(*[F.col(f"`{c}`") for c in raw.columns])))
    rows = raw.select(*[cell(f.name, f.dataType).alias(f.name) for f in schema.fields], *[F.col(f"`{c}`") for c in more],
                      found.alias(BAD), line.alias(LINE))
    text = lambda c: F.trim(F.col(f"`{c}`"))
    seen = Observation()
    (rows.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size(BAD) > 0).alias("n_bad_rows"),
                  F.coalesce(F.sum(F.size(BAD)), F.lit(0)).alias("n_bad_cells"),
                  *[F.coalesce(F.bool_and((text(c) == "") | text(c).try_cast("double").isNotNull()), F.lit(True)).alias(f"numeric_{i}")
                    for i, c in enumerate(more)])
     .write.mode("overwrite").parquet(out_dir))
    got = dict(seen.get)
    numeric = {c: got.pop(f"numeric_{i}") for i, c in enumerate(more)}
    held = spark.read.parquet(out_dir)
    clean = held.select(*[F.col(f"`{c}`") for c in known],
                        *[(cell(c, T.DoubleType()) if numeric[c] else F.col(f"`{c}`")).alias(c) for c in more])
    rejected = held.where(F.size(BAD) > 0).select(*keys, F.inline(BAD), F.col(LINE).alias("line"))
    return Ingested(clean, rejected, got)


def read_applications(spark: SparkSession, path: str, schema=APPLICATION_SCHEMA) -> DataFrame:
    """SRC-1: every column of the file is kept as a feature."""
    return read_csv_table(spark, path, schema, further=True)


def read_bureau(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2."""
    return read_csv_table(spark, path, BUREAU_SCHEMA)


def read_previous_applications(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3."""
    return read_csv_table(spark, path, PREVIOUS_SCHEMA)


def read_installments(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4."""
    return read_csv_table(spark, path, INSTALLMENTS_SCHEMA)


def read_pos_cash(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5."""
    return read_csv_table(spark, path, POS_CASH_SCHEMA)


def parse_requests(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """JSON request lines -> raw text fields, plus ``_explicit_nulls``: the
    optional fields sent as an explicit ``null`` (the reference rejects
    those; only an absent key takes the default) and ``_request``, the line
    itself, so that a rejected request can be found again.  A line that is no
    JSON object breaks the rule ``request:json``.  Works on a stream too."""
    parsed = lines.select(F.col(text_col).alias(RAW_TEXT), F.from_json(F.col(text_col), APPLICANT_RAW_SCHEMA).alias("r"),
                          F.json_object_keys(F.col(text_col)).alias("_keys"))
    flags = [F.when(F.array_contains("_keys", f) & F.col(f"r.{f}").isNull(), F.lit(f"{f}:null"))
             for f in APPLICANT_DEFAULTS]
    broken = F.when(F.col("_keys").isNull(), F.lit("request:json"))
    return parsed.select("r.*", RAW_TEXT, F.array_compact(F.array(broken, *flags)).alias("_explicit_nulls"))


def read_applicants(spark: SparkSession, path: str, detect_explicit_null: bool = True,
                    multiline: bool = False) -> DataFrame:
    """SRC-6: request records (JSON lines), every field read as text, then
    coerced; type errors (and explicit nulls) are kept for ``violations``.
    ``multiline=True`` reads files holding one JSON document (or array of
    documents) each; explicit nulls cannot be told from absent keys then."""
    if multiline or not detect_explicit_null:
        return coerce(spark.read.schema(APPLICANT_RAW_SCHEMA).option("multiLine", multiline)
                      .json(path))
    return coerce(parse_requests(spark.read.text(path)))


class LendingFiles:
    """The five lending tables from a folder of CSV files (or parquet with
    ``fmt='parquet'``); same interface as the test adapter."""

    def __init__(self, spark: SparkSession, folder: str, fmt: str = "csv"):
        self.spark, self.folder, self.fmt = spark, folder.rstrip("/"), fmt

    def _read(self, key: str, schema) -> DataFrame:
        path = f"{self.folder}/{FILE_NAMES[key]}.{self.fmt}"
        if self.fmt == "parquet":
            return nan_to_null_all(self.spark.read.schema(schema).parquet(path))
        return read_csv_table(self.spark, path, schema, further=key == "application")

    def application(self) -> DataFrame:
        return self._read("application", APPLICATION_SCHEMA)

    def bureau(self) -> DataFrame:
        return self._read("bureau", BUREAU_SCHEMA)

    def previous_application(self) -> DataFrame:
        return self._read("previous_application", PREVIOUS_SCHEMA)

    def installments_payments(self) -> DataFrame:
        return self._read("installments_payments", INSTALLMENTS_SCHEMA)

    def pos_cash_balance(self) -> DataFrame:
        return self._read("pos_cash_balance", POS_CASH_SCHEMA)

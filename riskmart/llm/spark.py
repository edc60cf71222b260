"""Spark helpers of the text operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

import riskmart
from riskmart.session import scratch_path

_sent: set = set()


def send_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application: their Python
    need not have it installed.  Spark's own file distribution carries it."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(riskmart.__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="riskmart-"), "riskmart.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "riskmart")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches count rows, not bytes: with Spark's default of 10,000
    rows a batch of long texts could outgrow a worker.  A session that sets
    its own value keeps it.  Also sends the package to the executors."""
    send_package(spark)
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage with files
    that outlive a lost executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def public_tokenizer(name: str) -> str:
    """Place of a public vocabulary file (never copied into the repository)."""
    import public_tokenizers
    return str(public_tokenizers.path(name))

"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings the engine's semantics depend on (ANSI division rules, UTC day
# arithmetic) plus adaptive execution.  Cluster-sizing knobs such as
# spark.sql.shuffle.partitions are left to the cluster unless a caller passes
# them (tests and the bench do).
ENGINE_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app_name: str = "riskmart",
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in {**ENGINE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session; only when it is unset
    in local mode (tests) is a fresh folder created and registered; on a
    cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            # a machine-local folder is not visible to the other executors
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        conf_dir = os.path.join(tempfile.gettempdir(), f"riskmart-ckpt-{uuid.uuid4().hex[:8]}")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder (never machine-local
    on a cluster: the checkpoint folder is the cluster's shared storage).  It
    goes when the application ends."""
    sc = spark.sparkContext
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    store.mkdirs(folder)
    store.deleteOnExit(folder)
    return path


def materialize(df, name: str):
    """Write ``df`` as a parquet table in the shared checkpoint folder and
    read it back: lineage is cut, later jobs read columns selectively, and a
    lost executor re-reads the table instead of recomputing upstream."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_shipped: set = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package by Spark's own file distribution, once
    per application: their Python need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="riskmart-code-"), "riskmart_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)

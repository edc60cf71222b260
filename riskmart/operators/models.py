"""Model training (MDL-1..10, PRD-1) and the saved model bundle (SNK-1, SRC-7).

The reference trains three third-party boosters, a forest, a boosting learner
and a logistic regression on one machine.  Here the boosters are settings of
one distributed learner (``boosting``), fitted side by side, the logistic
regression is solved by Newton steps (``logistic``), and the forest is MLlib's.
"""

from __future__ import annotations

import hashlib
import json
import logging
import time
import uuid
from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

from pyspark import InheritableThread
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.operators import boosting as BO
from riskmart.operators import logistic as LO
from riskmart.operators import metrics as M
from riskmart.operators import prep as PR
from riskmart.schemas import DEFAULT_THRESHOLD, ID_COL, LABEL_COL

FEATURES_VEC = "features"
log = logging.getLogger(__name__)


@dataclass
class Preset:
    name: str
    learner: str                      # gbt | rf | lr
    params: dict = field(default_factory=dict)
    weighting: str | None = None      # balanced | pos_weight | None


# The reference's settings.  What it leaves to its libraries' defaults: the L2
# penalty of booster B is 1, of booster C 3, of the others 0.
PRESETS = {
    "gbt_main": Preset("GBT (main)", "gbt", dict(rounds=1000, rate=0.02, depth=7, leaves=63, min_child=50, l1=0.1, l2=0.1,
                                                 rows=0.8, columns=0.8, patience=50), "balanced"),
    "gbt_fallback": Preset("GBT (fallback)", "gbt", dict(rounds=300, rate=0.05, depth=5)),
    "gbt_a": Preset("GBT A (balanced)", "gbt", dict(rounds=400, rate=0.05, depth=6, leaves=63, min_child=30, rows=0.8,
                                                   columns=0.8), "balanced"),
    "gbt_b": Preset("GBT B (positive weight)", "gbt", dict(rounds=400, rate=0.05, depth=6, l2=1.0, rows=0.8, columns=0.8),
                    "pos_weight"),
    "gbt_c": Preset("GBT C (balanced)", "gbt", dict(rounds=400, rate=0.05, depth=6, l2=3.0), "balanced"),
    "random_forest": Preset("Random Forest", "rf", dict(numTrees=300, maxDepth=10,
                                                       featureSubsetStrategy="sqrt"), "balanced"),
    "gbt_d": Preset("Gradient Boosting", "gbt", dict(rounds=200, rate=0.05, depth=5, rows=0.8)),
    "logistic": Preset("Logistic Regression", "lr", dict(max_passes=1000), "balanced"),
}
COMPARISON = ["gbt_a", "gbt_b", "gbt_c", "random_forest", "gbt_d", "logistic"]
PARTITION_ROWS = 40_000   # training rows of a partition, by a hash of the id
HELD = "is_validation"


def _params(preset: Preset, overrides: dict | None) -> dict:
    """The preset's parameters; ``overrides`` replaces single ones."""
    return {**preset.params, **{k: v for k, v in (overrides or {}).items() if k in preset.params}}


def class_weights(df: DataFrame, weighting: str | None) -> tuple:
    """Weights of classes 0 and 1."""
    if not weighting:
        return 1.0, 1.0
    col = "balanced_weight" if weighting == "balanced" else "pos_weight"
    got = {r[LABEL_COL]: r[col] for r in PR.class_weight_table(df, LABEL_COL).collect()}
    return tuple(float(1.0 if got.get(c) is None else got[c]) for c in (0, 1))


def predict_default(model, df: DataFrame, out: str = "p") -> DataFrame:
    """PRD-1: probability of class 1."""
    if isinstance(model, BO.Boosted):
        return BO.predict_boosted(model, df, out)
    if isinstance(model, LO.Logistic):
        return LO.predict_logistic(model, df, out)
    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array(F.col("probability"))[1]).drop(
        FEATURES_VEC, "rawPrediction", "probability", "prediction")


def _validation_slice(train: DataFrame, share: float = 0.1) -> DataFrame:
    """Mark a deterministic validation slice of the training rows (hash
    of the id) for early stopping; the test rows are never used for it."""
    h = PR.split_hash("SK_ID_CURR", seed=7)
    return train.withColumn(HELD, h < int(share * PR.MOD))


def fit_boosters(train: DataFrame, feature_cols: list[str], keys: list[str], seed: int = 42,
                 stop_on: DataFrame | None = None, overrides: dict | None = None) -> dict:
    """Fit the boosting presets of ``keys`` side by side.  Where one stops
    early, a slice of the training rows measures the loss, for all; ``stop_on``
    (parity) measures it on the given rows instead, e.g. the test rows as the
    reference does."""
    settings = {k: BO.Boosting(**_params(PRESETS[k], overrides), weights=class_weights(train, PRESETS[k].weighting)) for k in keys}
    held = HELD if any(s.patience for s in settings.values()) else None
    if held and stop_on is not None:
        stop_on = stop_on.withColumn(HELD, F.lit(True))
        train = dealt(train.withColumn(HELD, F.lit(False)).unionByName(stop_on), train.rdd.getNumPartitions())
    elif held:
        train = _validation_slice(train)
    return BO.fit_boosted(train, feature_cols, settings, held, seed)


def fit_preset(train: DataFrame, feature_cols: list[str], key: str, seed: int = 42, stop_on: DataFrame | None = None,
               overrides: dict | None = None):
    """Fit one preset: (model, seconds)."""
    preset, t0 = PRESETS[key], time.time()
    if preset.learner == "gbt":
        model = fit_boosters(train, feature_cols, [key], seed, stop_on, overrides)[key]
    elif preset.learner == "lr":
        # C = 1: the L2 penalty is half the squared coefficients beside the summed loss
        model = LO.fit_logistic(train, feature_cols, class_weights(train, preset.weighting), 1.0, **_params(preset, overrides))
    elif preset.learner == "rf":
        w = F.when(F.col(LABEL_COL) == 1, class_weights(train, preset.weighting)[1]).otherwise(class_weights(train, preset.weighting)[0])
        learner = RandomForestClassifier(seed=seed, cacheNodeIds=True, featuresCol=FEATURES_VEC, labelCol=LABEL_COL,
                                         weightCol="weight", **_params(preset, overrides))
        assembler = VectorAssembler(inputCols=feature_cols, outputCol=FEATURES_VEC, handleInvalid="keep")
        model = Pipeline(stages=[assembler, learner]).fit(train.withColumn("weight", w))
    else:
        raise ValueError(preset.learner)
    return model, time.time() - t0


def train_partitions(n_rows: int) -> int:
    """By the number of training rows only, so that a table gives the same
    model on any cluster."""
    return max(1, -(-n_rows // PARTITION_ROWS))


def dealt(df: DataFrame, partitions: int = 1) -> DataFrame:
    """Training rows dealt by the id over a stated number of partitions:
    learners sample per partition, so the same table gives the same model on
    any cluster."""
    return df.repartition(partitions, ID_COL).sortWithinPartitions(ID_COL)


def compare_models(train: DataFrame, test: DataFrame, feature_cols: list[str],
                   keys: list[str] = COMPARISON, threshold: float = DEFAULT_THRESHOLD,
                   overrides: dict | None = None, partitions: int = 1):
    """MDL-10: fit the presets on the cached training rows (all boosters in
    one pass a tree level, their seconds are the joint ones; the forest beside
    the others, as neither fills the cluster on a small table), score the test
    rows, one metrics row per preset; a failing preset gives an error row, its
    trace goes to the log, and the loop goes on.  When all fail, the last
    failure is raised.  Returns (metrics DataFrame, {key: model})."""
    spark = train.sparkSession
    train, test = dealt(train, partitions).persist(), test.persist()
    rows, models, failures = {}, {}, {}
    boosters = [k for k in keys if PRESETS[k].learner == "gbt"]
    groups = ([boosters] if boosters else []) + [[k] for k in keys if k not in boosters]

    def failed(group, e):
        log.error("fitting %s", ", ".join(group), exc_info=e)
        failures[groups.index(group)] = e
        for k in group:
            rows[k] = {"model": PRESETS[k].name, "error": f"{type(e).__name__}: {e}"}

    def fit(group):
        t0 = time.time()
        if group is boosters:
            fitted = fit_boosters(train, feature_cols, group, overrides=overrides)
        else:
            fitted = {group[0]: fit_preset(train, feature_cols, group[0], overrides=overrides)[0]}
        secs = round(time.time() - t0, 1)
        # one grouped pass for the metrics of all models of the group
        scored = [predict_default(model, test).select(LABEL_COL, "p", F.lit(k).alias("model")) for k, model in fitted.items()]
        got = {r.model: r.asDict() for r in M.metrics_table(reduce(DataFrame.union, scored), threshold=threshold).collect()}
        for k, model in fitted.items():
            rows[k] = got[k] | {"model": PRESETS[k].name, "train_seconds": secs, "error": None}
            models[k] = model

    def one_by_one(some):
        for group in some:
            try:
                fit(group)
            except Exception as e:  # noqa: BLE001 - keep comparing the other presets
                failed(group, e)
    forests = [g for g in groups if PRESETS[g[0]].learner == "rf"]
    beside = InheritableThread(target=one_by_one, args=(forests,), session=spark)
    try:
        train.count(), test.count()
        beside.start()
        one_by_one([g for g in groups if g not in forests])
    finally:
        if beside.ident is not None:
            beside.join()
        train.unpersist()
        test.unpersist()
    if failures and not models:
        raise failures[max(failures)]
    schema = ("model string, f1_default double, f1_macro double, f1_weighted double, "
              "roc_auc double, precision double, recall double, true_positives int, "
              "false_negatives int, train_seconds double, error string")
    cols = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(rows[k].get(c) for c in cols) for k in keys], schema), models


# ----------------------------------------------------------------- bundle
#
# <path>/versions/<id>/{model,metadata,codes,...}   the parts of one save
# <path>/manifest/<number>-<id>.json                names them, with their digests
#
# A save writes its parts first and its manifest, by one rename, last; a reader
# takes the newest manifest, so it sees an old bundle or a new one whole.

class Bundle(NamedTuple):
    """A loaded bundle: the model, one metadata row, and the folder of its parts."""
    model: object
    meta: DataFrame
    root: str


def _store(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _names(spark: SparkSession, path: str) -> list:
    fs, folder = _store(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def _digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the names and contents of a part's files."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
             .select("path", F.sha2("content", 256).alias("h")).collect())
    own = sorted((r.path.rsplit("/", 1)[1], r.h) for r in files)
    return hashlib.sha256(json.dumps(own).encode()).hexdigest()


def write_model(model, path: str) -> str:
    """Write a model as a folder; returns its kind."""
    spark = SparkSession.getActiveSession()
    if isinstance(model, BO.Boosted):
        spark.createDataFrame(BO.model_rows(model), BO.NODES).coalesce(1).write.parquet(path)
        return "boosted"
    if isinstance(model, LO.Logistic):
        rows = [(None, model.intercept), *zip(model.columns, model.coefficients)]
        spark.createDataFrame(rows, "feature string, coefficient double").coalesce(1).write.parquet(path)
        return "logistic"
    model.write().save(path)
    return "pipeline"


def read_model(kind: str, path: str, feature_cols: list):
    spark = SparkSession.getActiveSession()
    if kind == "boosted":
        return BO.model_of_rows(spark.read.parquet(path).collect(), feature_cols)
    if kind == "logistic":
        got = {r.feature: r.coefficient for r in spark.read.parquet(path).collect()}
        return LO.Logistic(feature_cols, [got.get(c, 0.0) for c in feature_cols], got[None])
    return PipelineModel.load(path)


def save_model(model, meta: dict, path: str, tables: dict | None = None) -> None:
    """SNK-1: model, one metadata row (feature list, medians, metrics,
    threshold) and further ``tables`` by name (e.g. the label codes), visible
    together or not at all."""
    spark = SparkSession.getActiveSession()
    version = uuid.uuid4().hex
    root = f"{path}/versions/{version}"
    kind = write_model(model, f"{root}/model")
    row = {k: (json.dumps(v) if isinstance(v, dict) else v) for k, v in meta.items()}
    spark.createDataFrame([row]).coalesce(1).write.json(f"{root}/metadata")
    for name, df in (tables or {}).items():
        df.write.parquet(f"{root}/{name}")
    parts = {name: _digest(spark, f"{root}/{name}") for name in ("model", "metadata", *(tables or {}))}
    body = json.dumps({"version": version, "kind": kind, "parts": parts}, sort_keys=True)
    number = 1 + max([int(n.split("-")[0]) for n in _names(spark, f"{path}/manifest") if n.endswith(".json")], default=0)
    fs, folder = _store(spark, f"{path}/manifest")
    fs.mkdirs(folder)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    draft, final = hadoop(folder, f"_{version}"), hadoop(folder, f"{number:08d}-{version}.json")
    out = fs.create(draft, True)
    out.write(bytearray(body.encode()))
    out.close()
    if not fs.rename(draft, final):
        raise OSError(f"cannot publish {final}")


def load_model(path: str) -> Bundle | None:
    """SRC-7: the newest whole bundle, or None where none was saved (the
    caller then uses the fallback decision).  A part that is missing or not
    what the manifest says is refused."""
    spark = SparkSession.getActiveSession()
    published = [n for n in _names(spark, f"{path}/manifest") if n.endswith(".json")]
    if not published:
        strange = set(_names(spark, path)) - {"versions", "manifest"}
        if strange:
            raise ValueError(f"{path} is no model bundle: {sorted(strange)[0]}")
        return None
    manifest = json.loads("".join(r.value for r in spark.read.text(f"{path}/manifest/{published[-1]}", wholetext=True).collect()))
    root = f"{path}/versions/{manifest['version']}"
    for name, digest in manifest["parts"].items():
        if not _names(spark, f"{root}/{name}") or _digest(spark, f"{root}/{name}") != digest:
            raise ValueError(f"{path}: part {name} is not the one that was saved")
    meta = spark.read.json(f"{root}/metadata")
    return Bundle(read_model(manifest["kind"], f"{root}/model", meta.first()["feature_cols"]), meta, root)


def model_info(bundle) -> DataFrame:
    """REG-1: loaded flag, AUC (0 when absent), feature count, algorithm."""
    spark = SparkSession.getActiveSession()
    if bundle is None:
        return spark.createDataFrame([(False, 0.0, 0, None, None)],
                                     "loaded boolean, auc_score double, feature_count int, "
                                     "algorithm string, best_model_name string")
    meta = bundle.meta
    cols = set(meta.columns)
    return meta.select(
        F.lit(True).alias("loaded"),
        (F.coalesce(F.col("auc_score"), F.lit(0.0)) if "auc_score" in cols else F.lit(0.0))
        .cast("double").alias("auc_score"),
        F.size("feature_cols").cast("int").alias("feature_count"),
        (F.col("algorithm") if "algorithm" in cols else F.lit(None).cast("string")).alias("algorithm"),
        (F.col("best_model_name") if "best_model_name" in cols else F.lit(None).cast("string"))
        .alias("best_model_name"))

"""Training and model-backed scoring jobs.

Training: mart -> features -> label codes -> stratified split -> medians ->
imputation -> MLlib presets -> metrics -> leaderboard -> saved bundle.
Scoring: requests -> defaults/validation -> scorecard -> scoring row ->
codes (unseen -> 0) -> alignment -> imputation -> model probability ->
decision.  Both are DataFrame plans; only bounded objects (medians,
per-class counts, metric rows) are collected; the code table stays a table.

``fit_scope='train'`` (default) fits codes and medians on the training rows
only; ``fit_scope='all'`` fits them on every row before the split, as the
reference does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.operators import decision as DC
from riskmart.operators import features as FE
from riskmart.operators import metrics as ME
from riskmart.operators import models as MD
from riskmart.operators import prep as PR
from riskmart.operators import rollups as RU
from riskmart.operators import scorecard as SC
from riskmart.operators import validation as VA
from riskmart.schemas import DEFAULT_THRESHOLD, ID_COL, LABEL_COL, MART_CATEGORICAL
from riskmart.session import materialize, scratch_path
from riskmart.sources.sinks import write_comparison


@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame
    feature_cols: list[str]
    codes: DataFrame
    medians: dict
    n_train: int = 0


def prepare(mart: DataFrame, fit_scope: str = "train", exact_medians: bool = True) -> Prepared:
    """Features, codes, split and imputation of the (rolled-up) mart."""
    # The feature mart feeds several jobs (split sizes, code maps, medians,
    # the fits): cut its lineage once in the shared checkpoint folder.
    eng = materialize(FE.engineer_features(mart, "mart"), "feature-mart")
    sizes = PR.split_sizes(eng)                      # per class (n, n_train, n_test)
    split = PR.stratified_split(eng, sizes=sizes)
    fit_rows = split.where(~F.col("is_test")) if fit_scope == "train" else split
    codes = PR.fit_label_codes(fit_rows, MART_CATEGORICAL)
    enc, codes = PR.encode(split, codes, MART_CATEGORICAL)
    feats = PR.feature_columns(enc, exclude=(ID_COL, LABEL_COL, "is_test"))
    fit_enc = enc.where(~F.col("is_test")) if fit_scope == "train" else enc
    medians = PR.fit_medians(fit_enc, feats, exact=exact_medians)
    imputed = PR.impute(enc, medians)
    feats = [c for c in feats if c in imputed.columns]
    imputed = imputed.select(ID_COL, LABEL_COL, "is_test", *feats)
    return Prepared(imputed.where(~F.col("is_test")).drop("is_test"),
                    imputed.where(F.col("is_test")).drop("is_test"), feats, codes, medians,
                    sum(v[1] for v in sizes.values()))


def train_and_compare(spark: SparkSession, tables, keys=MD.COMPARISON, fit_scope: str = "train",
                      save_to: str | None = None, overrides: dict | None = None):
    """MDL-10 + LDB + SNK-1/2: fit the presets, rank them, save the best.
    ``overrides`` replaces learner parameters (tests).  A preset that fails
    keeps its row, without rank, with the error.  Returns (leaderboard
    DataFrame, bundle path or None, prepared frames)."""
    prep = prepare(RU.mart_from_tables(tables), fit_scope)
    metrics, models = MD.compare_models(prep.train, prep.test, prep.feature_cols, keys, overrides=overrides,
                                        partitions=MD.train_partitions(prep.n_train))
    ranked = ME.leaderboard(metrics.where(F.col("error").isNull()))
    failed = metrics.where(F.col("error").isNotNull())
    board = materialize(ranked.unionByName(failed, allowMissingColumns=True), "leaderboard")
    path = None
    best_rows = ME.best(board).collect()
    if best_rows:
        best = best_rows[0]
        key = next(k for k in keys if MD.PRESETS[k].name == best["model"])
        path = save_to or scratch_path(spark, "model-bundle")
        MD.save_model(models[key], {
            "feature_cols": prep.feature_cols,
            "medians": prep.medians,
            "auc_score": best["roc_auc"],
            "f1_score": best["f1_default"],
            "threshold": DEFAULT_THRESHOLD,
            "categorical": MART_CATEGORICAL,
            "best_model_name": best["model"],
            "algorithm": MD.PRESETS[key].learner,
            "n_train": prep.n_train,
        }, path, {"codes": prep.codes})
        write_comparison(board.where(F.col("error").isNull()), f"{path}/comparison")        # SNK-2
    return board, path, prep


def best_model_report(prep: Prepared, path: str) -> DataFrame:
    """LDB-3: the best model's test predictions, re-thresholded, as a
    classification report."""
    model, meta = bundle_parts(MD.load_model(path))
    scored = MD.predict_default(model, prep.test.select(ID_COL, LABEL_COL, *meta["feature_cols"]))
    return ME.classification_report(scored, threshold=meta.get("threshold") or DEFAULT_THRESHOLD)


def bundle_parts(bundle) -> tuple:
    import json
    model, meta_df = bundle.model, bundle.meta
    meta = meta_df.collect()[0].asDict()          # one metadata row
    if isinstance(meta.get("medians"), str):
        meta["medians"] = json.loads(meta["medians"])
    return model, meta


def score_requests(requests: DataFrame, bundle=None, parity: bool = False,
                   threshold: float | None = None) -> DataFrame:
    """DEC-17 for a table of requests: the nested response per valid
    request; with no bundle, the fallback decision (DEC-16).  ``parity``
    leaves features at 0 that the scoring service leaves so."""
    valid = FE.enrich(VA.valid_requests(requests))
    carded = SC.scorecard(valid, with_details=True)
    if bundle is None:
        return DC.decide(carded, has_model=False)
    model, meta = bundle_parts(bundle)
    # Column names resolve case-insensitively: the enrich helpers would clash
    # with the model features of the same name (EXT_SOURCE_MEAN, ...); the
    # scorecard has consumed them, so they go.
    carded = carded.drop("ext_source_mean", "employment_years", "annuity_income_ratio")
    feats = FE.request_features(carded, parity=parity, keep=carded.columns)
    codes = feats.sparkSession.read.parquet(f"{bundle.root}/codes")
    enc = PR.apply_label_codes(feats, codes, MART_CATEGORICAL)
    aligned = FE.align_features(enc, meta["feature_cols"], keep=carded.columns)
    imputed = PR.impute(aligned, {c: meta["medians"].get(c) for c in meta["feature_cols"]},
                        drop_empty=False)
    scored = MD.predict_default(model, imputed)
    t = threshold if threshold is not None else (meta.get("threshold") or DEFAULT_THRESHOLD)
    return DC.decide(scored, has_model=True, threshold=t)

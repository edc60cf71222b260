"""Evaluation and leaderboard (EVL-1..7, LDB-1..3, REG-1).

Input is a scored frame (label, probability).  Counts are one global
aggregate (partial per task); the exact ROC-AUC groups by distinct score
first and sums the pairs by prefixes of the scores' bits, so no task
ever holds more of them than share a prefix of their bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskmart.operators.ranking import ordered_pairs
from riskmart.schemas import CLASS_NAMES, DEFAULT_THRESHOLD, LABEL_COL, LEADERBOARD_MARKS


def classify(p: Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    """EVL-1."""
    return (p >= threshold).cast("int")


def confusion(df: DataFrame, label: str = LABEL_COL, prob: str = "p",
              threshold: float = DEFAULT_THRESHOLD, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """EVL-3: (tn, fp, fn, tp), one row (per group)."""
    y, yhat = F.col(label), classify(F.col(prob), threshold)
    return df.groupBy(*group_cols).agg(
        F.count_if((y == 0) & (yhat == 0)).alias("tn"), F.count_if((y == 0) & (yhat == 1)).alias("fp"),
        F.count_if((y == 1) & (yhat == 0)).alias("fn"), F.count_if((y == 1) & (yhat == 1)).alias("tp"))


def _div(a: Column, b: Column) -> Column:
    """Zero division -> 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def scores_from_counts(c: DataFrame) -> DataFrame:
    """EVL-4/5 from (tn, fp, fn, tp): precision / recall / F1 of the
    positive class, macro and support-weighted F1, accuracy."""
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    n0, n1 = tn + fp, fn + tp
    f1_1 = _div(2 * tp, 2 * tp + fp + fn)
    f1_0 = _div(2 * tn, 2 * tn + fn + fp)
    return c.withColumns({
        "precision": _div(tp, tp + fp),
        "recall": _div(tp, tp + fn),
        "f1_default": f1_1,
        "f1_macro": (f1_0 + f1_1) / 2,
        "f1_weighted": _div(f1_0 * n0 + f1_1 * n1, n0 + n1),
        "accuracy": _div(tp + tn, n0 + n1),
    })


def roc_auc(df: DataFrame, label: str = LABEL_COL, prob: str = "p", digits: int | None = None,
            group_cols: tuple[str, ...] = ()) -> DataFrame:
    """EVL-2: exact ROC-AUC with ties counted one half, per group:
    sum over distinct scores s of pos(s) * (neg below s + neg(s)/2) / (P*N).
    ``digits`` rounds the score first (to merge scores that differ only in
    the last bits)."""
    s = F.bround(F.col(prob), digits) if digits is not None else F.col(prob)
    g = list(group_cols)
    by_score = df.groupBy(*g, s.alias("_s")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg"))
    pairs = ordered_pairs(by_score, "_s", "_pos", "_neg", tuple(g))
    return pairs.select(*g, F.try_divide(F.col("pairs"), F.col("upper").cast("double") * F.col("lower")).alias("roc_auc"))


def classification_report(df: DataFrame, label: str = LABEL_COL, prob: str = "p",
                          threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """EVL-6: per-class precision / recall / F1 / support, accuracy, macro
    and weighted averages (rows in report order)."""
    c = confusion(df, label, prob, threshold)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    n0, n1 = tn + fp, fn + tp
    p0, r0, f0 = _div(tn, tn + fn), _div(tn, tn + fp), _div(2 * tn, 2 * tn + fn + fp)
    p1, r1, f1 = _div(tp, tp + fp), _div(tp, tp + fn), _div(2 * tp, 2 * tp + fp + fn)
    n = n0 + n1
    acc = _div(tp + tn, n)
    def row(i, name, prec, rec, f, sup):
        return F.struct(F.lit(i).alias("row"), F.lit(name).alias("label"),
                        prec.cast("double").alias("precision"), rec.cast("double").alias("recall"),
                        f.cast("double").alias("f1"), sup.cast("bigint").alias("support"))
    none = F.lit(None)
    rows = F.array(
        row(1, CLASS_NAMES[0], p0, r0, f0, n0),
        row(2, CLASS_NAMES[1], p1, r1, f1, n1),
        row(3, "accuracy", none, none, acc, n),
        row(4, "macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row(5, "weighted avg", _div(p0 * n0 + p1 * n1, n), _div(r0 * n0 + r1 * n1, n),
            _div(f0 * n0 + f1 * n1, n), n),
    )
    return c.select(F.inline(rows))


def metrics_row(scored: DataFrame, model: str, label: str = LABEL_COL, prob: str = "p",
                threshold: float = DEFAULT_THRESHOLD, train_seconds: float | None = None,
                auc_digits: int | None = None) -> DataFrame:
    """EVL-7: one metrics row (4-digit scores, seconds to 1 digit)."""
    tagged = scored.withColumn("_model", F.lit(model))
    return metrics_table(tagged, "_model", label, prob, threshold, auc_digits).withColumn(
        "train_seconds",
        F.lit(None if train_seconds is None else round(train_seconds, 1)).cast("double"))


def metrics_table(scored: DataFrame, model_col: str = "model", label: str = LABEL_COL,
                  prob: str = "p", threshold: float = DEFAULT_THRESHOLD,
                  auc_digits: int | None = None) -> DataFrame:
    """EVL-7 for many models at once: one pass of grouped counts and one
    grouped AUC over the long (model, label, p) table; one row per model."""
    g = (model_col,)
    c = scores_from_counts(confusion(scored, label, prob, threshold, g))
    auc = roc_auc(scored, label, prob, auc_digits, g)
    return c.join(auc, model_col).select(   # one row per model on each side
        F.col(model_col).alias("model"),
        *[F.bround(x, 4).alias(x) for x in ("f1_default", "f1_macro", "f1_weighted")],
        F.bround("roc_auc", 4).alias("roc_auc"),
        F.bround("precision", 4).alias("precision"), F.bround("recall", 4).alias("recall"),
        F.col("tp").cast("int").alias("true_positives"),
        F.col("fn").cast("int").alias("false_negatives"))


def leaderboard(metrics: DataFrame) -> DataFrame:
    """LDB-1/2: rank by F1 of the default class (descending, model name
    breaks ties) and mark the top three.  A metrics table has one row per
    model, so the global ordering window is over a handful of rows."""
    w = Window.orderBy(F.col("f1_default").desc(), F.col("model"))
    ranked = metrics.withColumn("rank", F.row_number().over(w).cast("int"))
    mark = F.when(F.col("rank") == 1, F.lit(LEADERBOARD_MARKS[0]))
    for i, m in enumerate(LEADERBOARD_MARKS[1:], start=2):
        mark = mark.when(F.col("rank") == i, F.lit(m))
    return ranked.withColumn("mark", mark)


def best(board: DataFrame) -> DataFrame:
    """LDB-3: the first row of the leaderboard."""
    return board.where(F.col("rank") == 1)

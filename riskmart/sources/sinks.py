"""Sinks (SNK-2, SNK-3; SNK-1 lives with the models)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Column headers of the comparison table (fixed values of the reference's
# CSV), in output order.
COMPARISON_HEADERS = [
    ("model", "Model"), ("f1_default", "F1 (Default)"), ("f1_macro", "F1 (Macro)"),
    ("f1_weighted", "F1 (Weighted)"), ("roc_auc", "ROC-AUC"), ("precision", "Precision"),
    ("recall", "Recall"), ("true_positives", "True Positives"),
    ("false_negatives", "False Negatives"), ("train_seconds", "Train Time (s)"),
]


def write_comparison(board: DataFrame, path: str) -> None:
    """SNK-2: leaderboard as one CSV file with a header, rank order, no
    index.  A leaderboard has one row per model, so one task writes it."""
    cols = [F.col(c).alias(h) for c, h in COMPARISON_HEADERS if c in board.columns]
    out = board.orderBy("rank").select(*cols) if "rank" in board.columns else board.select(*cols)
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_decisions(decisions: DataFrame, path: str, fmt: str = "parquet",
                    mode: str = "append") -> None:
    """SNK-3: nested decision rows; parquet keeps the struct/map/array
    columns, json writes one response object per line."""
    decisions.write.mode(mode).format(fmt).save(path)

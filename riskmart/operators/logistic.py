"""Logistic regression by Newton steps (MDL-9).

The loss is the weighted sum over the rows plus half the squared coefficients
times ``l2`` (on the columns as they are; the intercept is free).  A pass adds
up, per partition, the loss, its gradient and its Hessian over columns that
are centred and scaled inside; the driver sees one matrix of that size a
partition and solves one system a pass.  Scaling changes the arithmetic only:
the penalty is carried over to the scaled coefficients.  A step that does not
lower the loss is halved.  Newton's method on a convex loss ends in a few
passes whatever the columns' ranges, where a line search along raw gradients
may not.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.schemas import LABEL_COL

PASSES = 1000
TOLERANCE = 1e-10


@dataclass
class Logistic:
    """A fitted model: margin = intercept + the columns times coefficients."""
    columns: list
    coefficients: list
    intercept: float
    passes: int = 0


def fit_logistic(df: DataFrame, columns: list, weights: tuple = (1.0, 1.0), l2: float = 1.0, max_passes: int = PASSES) -> Logistic:
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    got = df.agg(*[F.avg(value(c)).alias(f"m{i}") for i, c in enumerate(columns)],
                 *[F.stddev_pop(value(c)).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    k = len(columns)
    mean = np.array([got[i] or 0.0 for i in range(k)], float)
    scale = np.array([got[k + i] or 0.0 for i in range(k)], float)
    flat = ~(scale > 1e-12 * np.maximum(np.abs(mean), 1e-300))      # a constant column: coefficient 0
    scale = np.where(flat, 1.0, scale)
    rows = df.select(F.col(LABEL_COL).cast("int"), *[F.col(c).cast("double") for c in columns])
    penalty = np.append(l2 / scale**2, 0.0)

    def sums(at: np.ndarray):
        def run(batches):
            loss, grad, hess = 0.0, np.zeros(k + 1), np.zeros((k + 1, k + 1))
            for b in batches:
                y = b.column(0).to_numpy(zero_copy_only=False).astype(float)
                x = np.stack([b.column(1 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(k)], axis=1)
                z = np.where(flat | np.isnan(x), 0.0, (x - mean) / scale)          # a missing value counts as the mean
                z = np.concatenate((z, np.ones((len(z), 1))), axis=1)
                m, w = z @ at, np.where(y == 1, weights[1], weights[0])
                p = 1 / (1 + np.exp(-m))
                loss += float((w * np.logaddexp(0, np.where(y == 1, -m, m))).sum())
                grad += z.T @ (w * (p - y))
                hess += z.T @ (z * (w * p * (1 - p))[:, None])
            yield pa.record_batch({"s": pa.array([np.concatenate(([loss], grad, hess.ravel())).tobytes()], pa.binary())})
        total = np.zeros(1 + (k + 1) + (k + 1) ** 2)
        for r in rows.mapInArrow(run, "s binary").collect():       # one row a partition
            total += np.frombuffer(r.s)
        loss, grad, hess = total[0], total[1:k + 2], total[k + 2:].reshape(k + 1, k + 1)
        return loss + 0.5 * float((penalty * at**2).sum()), grad + penalty * at, hess + np.diag(penalty)

    at = np.zeros(k + 1)
    loss, grad, hess = sums(at)
    passes, step = 1, np.zeros(k + 1)
    while passes < max_passes:
        step = -np.linalg.lstsq(hess, grad, rcond=None)[0]
        gain, share = -float(grad @ step), 1.0
        if not gain > TOLERANCE * max(1.0, abs(loss)):
            break
        while passes < max_passes:
            new = sums(at + share * step)
            passes += 1
            if new[0] <= loss or share < 1e-6:
                break
            share /= 2
        if new[0] > loss:
            break
        at, (loss, grad, hess) = at + share * step, new
    coef = at[:k] / scale
    coef[flat] = 0.0
    return Logistic(list(columns), coef.tolist(), float(at[k] - (coef * mean).sum()), passes)


def predict_logistic(model: Logistic, df: DataFrame, out: str = "p") -> DataFrame:
    """``df`` with the probability of class 1, as one built-in expression."""
    margin = F.lit(model.intercept)
    for c, w in zip(model.columns, model.coefficients):
        if w:
            margin = margin + F.col(c).cast("double") * F.lit(w)
    return df.withColumn(out, 1 / (1 + F.exp(-margin)))

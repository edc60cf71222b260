"""Model preparation: feature selection, label codes, exact medians and
imputation, the stratified split and class weights (SEL, ENC, IMP, SPL,
WGT, AGG-5, AGG-6).

Everything that sees all rows runs as Spark aggregates; only bounded
results reach the driver: per-class counts and per-column medians.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmart.schemas import (ID_COL, LABEL_COL, MISSING_CATEGORY_TEXT, SPLIT_SEED, TEST_SHARE)
from riskmart.session import materialize, ship_package

PREFIX = 3                  # characters of a label that pick its ranking group
IN_PLAN = 256               # labels of a column up to which its codes are part of the plan


# ----------------------------------------------------------------- SEL-1
def feature_columns(df: DataFrame, exclude=(ID_COL, LABEL_COL)) -> list[str]:
    return [c for c in df.columns if c not in set(exclude)]


# ----------------------------------------------------------------- ENC
def _as_label(col: str, missing_label: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(missing_label))


def fit_label_codes(df: DataFrame, cols: list[str],
                    missing_label: str = MISSING_CATEGORY_TEXT) -> DataFrame:
    """ENC-1: long code table (column, value, code): code = 0-based rank of
    the value among the column's sorted distinct labels; a missing value is
    the label ``missing_label`` ('nan' for parity, 'Unknown' as intended).
    Columns absent from ``df`` are skipped."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        schema = "column string, value string, code int"
        return df.sparkSession.createDataFrame([], schema)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _as_label(c, missing_label).alias("value"))
                      for c in cols])
    # Ranked in two levels, so no task has to hold all labels of a column:
    # inside the labels of one beginning, then by the counts of the
    # beginnings before it (a beginning sorts as its labels do).
    distinct = df.select(F.inline(pairs)).distinct().withColumn("_p", F.substring("value", 1, PREFIX))
    inside = Window.partitionBy("column", "_p").orderBy("value")
    before = Window.partitionBy("column").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = distinct.groupBy("column", "_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("column", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    return (distinct.withColumn("_k", F.row_number().over(inside) - 1).join(starts, ["column", "_p"])
            .select("column", "value", (F.col("_at") + F.col("_k")).cast("int").alias("code")))


def apply_label_codes(df: DataFrame, codes: DataFrame, cols: list[str],
                      missing_label: str = MISSING_CATEGORY_TEXT) -> DataFrame:
    """ENC-2: replace each categorical by its code; an unseen label gets 0 (the
    code of the first label), as the scoring service does.

    Columns of at most IN_PLAN labels (counted first) are looked up in maps
    that are part of the plan: one projection for all of them, no join.  A
    column with more labels is joined with its part of the code table, which
    should be a written table: the planner then knows its size and broadcasts
    it where it is small; beyond that AQE splits a hot label's partition."""
    cols = [c for c in cols if c in df.columns]
    sizes = {r["column"]: r["n"] for r in codes.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    small = [c for c in cols if sizes.get(c, 0) <= IN_PLAN]
    maps: dict = {c: [] for c in small}
    for r in codes.where(F.col("column").isin(small)).collect() if small else []:     # at most IN_PLAN rows a column
        maps[r["column"]] += [F.lit(r["value"]), F.lit(r["code"])]
    code = {c: F.coalesce(F.create_map(*m)[_as_label(c, missing_label)], F.lit(0)) if m else F.lit(0) for c, m in maps.items()}
    out = df.withColumns({c: e.cast("int") for c, e in code.items()}) if code else df
    for c in [c for c in cols if c not in maps]:
        m = codes.where(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"),
                                                    F.col("code").alias(f"_c_{c}"))
        out = (out.withColumn(f"_v_{c}", _as_label(c, missing_label))
               .join(m, on=f"_v_{c}", how="left")
               .withColumn(c, F.coalesce(F.col(f"_c_{c}"), F.lit(0)).cast("int"))
               .drop(f"_v_{c}", f"_c_{c}"))
    return out.select(*df.columns)


def encode(df: DataFrame, codes: DataFrame, cols: list[str],
           missing_label: str = MISSING_CATEGORY_TEXT) -> tuple[DataFrame, DataFrame]:
    """ENC-2 with a code table that is written first: (encoded, code table)."""
    codes = materialize(codes, "label-codes")
    return apply_label_codes(df, codes, cols, missing_label), codes


# ----------------------------------------------------------------- IMP
def _numeric(df: DataFrame, cols: list[str]) -> list[str]:
    num = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)
    types = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in cols if isinstance(types[c], num)]


ACCURACY = 10_000          # of an approximate median


def _value(c: str) -> Column:
    """A column as double, NaN as missing."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def _middle(a: float, b: float) -> float:
    """Mean of two values, also where their sum is out of range."""
    mean = (a + b) / 2
    return a / 2 + b / 2 if math.isinf(mean) and not (math.isinf(a) or math.isinf(b)) else mean


def _image(x: np.ndarray) -> np.ndarray:
    """Doubles as 64-bit integers of the same order (-0.0 counts as 0.0)."""
    i = (x + 0.0).view(np.int64)
    return i ^ ((i >> 63) & np.int64(2**63 - 1))


def _of_image(i: int) -> float:
    return float(np.array([i ^ (2**63 - 1 if i < 0 else 0)], np.int64).view(np.float64)[0])


STEPS = (48, 32, 0)          # low bits left out by the three scans


def _counts(df: DataFrame, cols: list[str], level: int, open_: dict | None) -> DataFrame:
    """(c, base, p, n): how many values of column number c have the image
    prefix p, of those whose shorter prefix ``base`` is among the open ones."""
    shift = STEPS[level]

    def merged(held):
        at, n = (np.concatenate(x) for x in zip(*held))
        own, back = np.unique(at, return_inverse=True)
        return own, np.bincount(back, n, len(own)).astype(np.int64)

    def run(batches):
        held: dict = {c: [] for c in range(len(cols))}
        for b in batches:
            for c, rows in held.items():
                if open_ is not None and c not in open_:
                    continue
                x = b.column(c).to_numpy(zero_copy_only=False).astype(float)
                i = _image(x[~np.isnan(x)])
                if open_ is not None:
                    i = i[np.isin(i >> STEPS[level - 1], open_[c])]
                if len(i):
                    rows.append(np.unique(i >> shift, return_counts=True))
                if len(rows) > 64:
                    held[c] = [merged(rows)]
        for c, rows in held.items():
            if rows:
                at, n = merged(rows)
                base = at >> (STEPS[level - 1] - shift) if open_ is not None else np.zeros(len(at), np.int64)
                yield pa.record_batch({"c": pa.array(np.full(len(at), c), pa.int32()), "base": pa.array(base), "p": pa.array(at), "n": pa.array(n)})
    ship_package(df.sparkSession)
    return (df.select(*[F.col(c).cast("double") for c in cols]).mapInArrow(run, "c int, base long, p long, n long")
            .groupBy("c", "base", "p").agg(F.sum("n").alias("n")))


def median_table(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """AGG-6: (column, median) for each column; a column with no value gets
    NULL.  The mean of the one or two middle values, as numpy does.

    A radix search for all columns at once: a double's bits, with the sign
    folded in, are an integer of the same order.  The first scan counts the
    values by the first 16 bits of it, the second, of those that share these
    with a middle value, by the first 32, the third by all 64.  Counts are
    summed in the tasks, so a value that a third of all rows hold is one row;
    the driver sees at most two rows a column and scan.  No arithmetic on the
    values, so infinities and the ends of the double range are no special case.
    ``exact=False``: an approximate quantile, in one scan."""
    cols = _numeric(df, cols)
    spark = df.sparkSession
    schema = "column string, median double"
    if not cols:
        return spark.createDataFrame([], schema)
    if not exact:
        got = df.agg(*[F.percentile_approx(_value(c), 0.5, ACCURACY).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        return spark.createDataFrame([(c, got[i]) for i, c in enumerate(cols)], schema)
    open_, ranks = None, []                    # ranks: (column, prefix so far, rank below it) of each middle value
    for level in range(len(STEPS)):
        group = Window.partitionBy("c", "base")          # at most 2^16 prefixes of a base, or the values that share 32 bits
        upto = F.sum("n").over(group.orderBy("p"))
        counts = _counts(df, cols, level, open_).withColumns({"upto": upto, "all": F.sum("n").over(group)})
        if level == 0:
            want = counts.withColumn("k", F.explode(F.array_distinct(F.array(F.expr("(all - 1) div 2"), F.expr("all div 2")))))
        else:
            need = spark.createDataFrame(ranks, "c int, base long, k long")
            want = counts.join(F.broadcast(need), ["c", "base"])       # at most two rows a column
        ranks = [(r.c, r.p, r.k - (r.upto - r.n)) for r in
                 want.where("upto - n <= k AND k < upto").select("c", "p", "k", "upto", "n").collect()]
        open_ = {}
        for c, p, _ in ranks:
            open_.setdefault(c, []).append(p)
        if not ranks:
            break
    middle = {c: sorted(_of_image(p) for p in own) for c, own in open_.items()}
    return spark.createDataFrame([(c, _middle(middle[i][0], middle[i][-1]) if i in middle else None) for i, c in enumerate(cols)], schema)


def fit_medians(df: DataFrame, cols: list[str], exact: bool = True) -> dict[str, float | None]:
    """IMP-1: per-column medians on the driver (one value per column)."""
    return {r["column"]: r["median"] for r in median_table(df, cols, exact).collect()}


def impute(df: DataFrame, medians: dict[str, float | None], drop_empty: bool = True) -> DataFrame:
    """IMP-2: cast to double, fill missing with the column median; a column
    with no median (missing everywhere) is dropped, as the reference's
    imputer does."""
    cols = {c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in medians.items()
            if m is not None and c in df.columns}
    out = df.withColumns(cols) if cols else df
    empty = [c for c, m in medians.items() if m is None and c in df.columns]
    return out.drop(*empty) if drop_empty and empty else out


# ----------------------------------------------------------------- AGG-5 / WGT
def class_counts(df: DataFrame, label: str = LABEL_COL) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_weight_table(df: DataFrame, label: str = LABEL_COL) -> DataFrame:
    """WGT-1 / WGT-2: balanced weight n / (k * n_class) and the
    positive-class weight negatives / positives (1 for other classes).
    The per-class counts are one small aggregate; rows without a label
    count for no class."""
    counts = {r[label]: r["n"] for r in class_counts(df.where(F.col(label).isNotNull()), label).collect()}
    total, k = sum(counts.values()), len(counts)
    neg, pos = counts.get(0), counts.get(1)
    out = [(y, n, total / (k * n), (neg / pos if (y == 1 and neg is not None and pos) else
                                    None if y == 1 else 1.0)) for y, n in sorted(counts.items())]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.sparkSession.createDataFrame(
        out, f"{label} {types[label]}, n bigint, balanced_weight double, pos_weight double")


def with_weights(df: DataFrame, kind: str = "balanced", label: str = LABEL_COL,
                 weight_col: str = "weight") -> DataFrame:
    """Attach a per-row weight column; the class table has one row per
    class, so it is broadcast."""
    w = class_weight_table(df, label)
    col = "balanced_weight" if kind == "balanced" else "pos_weight"
    return df.join(F.broadcast(w.select(label, F.col(col).alias(weight_col))), label, "left")


# ----------------------------------------------------------------- SPL-1
MOD = 2147483647          # 2^31 - 1
MULT = 950706376          # Lehmer multiplier for 2^31-1 (Fishman-Moore optimal);
                          # x * MULT < 2^62 stays exact in BIGINT arithmetic


NO_ID = -1                # what a NULL id counts as


def split_hash(id_col: str = ID_COL, seed: int = SPLIT_SEED) -> Column:
    """h in [0, 2^31-1): a fixed pseudo-random permutation of
    (id + seed) mod (2^31-1) (one Lehmer step, so consecutive ids spread over
    the whole range); plain BIGINT arithmetic, the same in any SQL engine.
    A NULL id counts as NO_ID."""
    return F.pmod(F.pmod(F.coalesce(F.col(id_col), F.lit(NO_ID)), F.lit(MOD)) + seed, F.lit(MOD)) * MULT % MOD


def approximate_mode(counts: dict, n_draws: int) -> dict:
    """Allocate n_draws over classes proportionally; leftover units go to
    the largest fractional parts (ties: smaller label first)."""
    total = sum(counts.values())
    cont = {k: n_draws * v / total for k, v in counts.items()}
    out = {k: math.floor(c) for k, c in cont.items()}
    need = n_draws - sum(out.values())
    order = sorted(counts, key=lambda k: (-(cont[k] - out[k]), k))
    for k in order[:need]:
        out[k] += 1
    return out


def split_sizes(df: DataFrame, label: str = LABEL_COL, test_share: float = TEST_SHARE) -> dict:
    """Per-class (n, n_train, n_test) following the stratified rule:
    n_test = ceil(share * n), classes allocated by ``approximate_mode``."""
    counts = {r[label]: r["n"] for r in class_counts(df.where(F.col(label).isNotNull()), label).collect()}
    n = sum(counts.values())
    n_test = math.ceil(test_share * n)
    train = approximate_mode(counts, n - n_test)
    return {k: (counts[k], train[k], counts[k] - train[k]) for k in sorted(counts)}


def _cut(df: DataFrame, label: str, h: Column, targets: dict) -> dict:
    """Per class, the smallest ``targets[class]`` rows by (h, id): returns
    class -> (h_cut, id_cut) so that a row is selected iff
    (h, id) <= (h_cut, id_cut).  Radix narrowing on the 31-bit hash: three
    small count-by-bucket aggregates, then the (tiny) set of rows sharing
    the cut hash value is ordered by id."""
    levels = [(20, 11), (9, 11), (0, 9)]      # (shift, bits) from high to low
    state = {k: {"prefix": 0, "need": t} for k, t in targets.items() if t > 0}
    base = df.select(F.col(label).alias("_y"), h.alias("_h"), F.coalesce(F.col(ID_COL), F.lit(NO_ID)).alias("_id"))
    high = 31
    for shift, bits in levels:
        if not state:
            break
        width = high - shift
        conds = []
        for k, s in state.items():
            cond = F.col("_y") == F.lit(k)
            if high < 31:
                cond = cond & (F.shiftright("_h", high) == F.lit(s["prefix"]))
            conds.append(cond)
        sub = base.where(reduce(lambda a, b: a | b, conds))
        bucket = F.shiftright("_h", shift).bitwiseAND(F.lit((1 << width) - 1)) if high < 31 \
            else F.shiftright("_h", shift)
        rows = sub.groupBy("_y", bucket.alias("_b")).agg(F.count(F.lit(1)).alias("n")).collect()
        by_class: dict = {}
        for r in rows:
            by_class.setdefault(r["_y"], []).append((r["_b"], r["n"]))
        for k, s in state.items():
            acc = 0
            for b, n in sorted(by_class.get(k, [])):
                if acc + n >= s["need"]:
                    s["prefix"] = (s["prefix"] << width) | b
                    s["need"] -= acc
                    break
                acc += n
        high = shift
    cuts = {k: (-1, None) for k in targets}
    for k, s in state.items():
        h_cut = s["prefix"]
        # rows sharing the cut hash: ids congruent mod 2^31-1, a handful of
        # distinct ids; counted per id, so a duplicated id is one row here
        per_id = sorted((r["_id"], r["n"]) for r in
                        base.where((F.col("_y") == F.lit(k)) & (F.col("_h") == h_cut))
                        .groupBy("_id").agg(F.count(F.lit(1)).alias("n")).collect())
        acc = 0
        for i, n in per_id:
            acc += n
            if acc >= s["need"]:
                # with a duplicated id the whole group is taken (the only
                # case where the class total can exceed its exact size)
                cuts[k] = (h_cut, i)
                break
    return cuts


def stratified_split(df: DataFrame, label: str = LABEL_COL, test_share: float = TEST_SHARE,
                     seed: int = SPLIT_SEED, mode: str = "exact",
                     sizes: dict | None = None) -> DataFrame:
    """SPL-1: add boolean ``is_test``.

    ``exact``: per class exactly the stratified number of rows, chosen as the
    smallest split hashes (deterministic, stable under re-partitioning and
    re-execution; a few small aggregates, no shuffle of the table).
    ``bernoulli``: ``h < share * (2^31-1)`` per row, no job at all; sizes
    are binomial around the target.

    A row without a label has a NULL ``is_test``: it is in neither part."""
    h = split_hash(ID_COL, seed)
    if mode == "bernoulli":
        return df.withColumn("is_test", h < int(test_share * MOD))
    sizes = sizes or split_sizes(df, label, test_share)
    cuts = _cut(df, label, h, {k: v[2] for k, v in sizes.items()})
    cond = F.lit(False)
    for k, (h_cut, id_cut) in cuts.items():
        if h_cut < 0:
            continue
        in_k = (F.col(label) == F.lit(k)) & ((h < h_cut) | ((h == h_cut) & (F.coalesce(F.col(ID_COL), F.lit(NO_ID)) <= id_cut)))
        cond = cond | in_k
    return df.withColumn("is_test", F.when(F.col(label).isNotNull(), cond))


def train_test(df: DataFrame, label: str = LABEL_COL, test_share: float = TEST_SHARE,
               seed: int = SPLIT_SEED) -> tuple[DataFrame, DataFrame]:
    s = stratified_split(df, label, test_share, seed)
    return s.where(~F.col("is_test")).drop("is_test"), s.where(F.col("is_test")).drop("is_test")

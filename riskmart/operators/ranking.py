"""Distributed order statistics without a single-task global window.

``prefix_sums`` gives every row the running total of a weight in a global
order (optionally per group); ``ordered_pairs`` sums over all pairs in that order.  A plain ``Window.orderBy`` without a
partition key moves the whole table into one task; here a row's place is
found from the order-preserving 64-bit image of its value, cut into three
digits: windows run inside the rows that share the first two, inside the
totals that share the first, and over the totals of the first.  A digit has
at most 2^22 values, so no window sees more rows than that, however the values
lie; nothing is sampled or sent to the driver, and the plan is the same for
any number of partitions.  A hot value cannot form a hot group: callers
aggregate to distinct keys before ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIGH, MIDDLE = "_rank_high", "_rank_middle"
LOW_BITS = 22                 # the last digit; the digit before it has as many
DIGIT = 1 << LOW_BITS


def double_image(x: Column) -> Column:
    """A BIGINT that orders as the doubles do: the bits of |x| (exponent and
    fraction, found by exact scaling with powers of two), below zero counted
    down from -1.  Both zeros give 0, NaN comes after infinity and NULL before
    everything."""
    a = F.abs(x)
    near = F.floor(F.log2(a))                       # one off at most, next to a power of two
    two = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    e = F.when(two(near) > a, near - 1).when(two(near + 1) <= a, near + 1).otherwise(near)
    fraction = ((a / two(e) - 1) * 2.0 ** 52).cast("bigint")
    normal = F.shiftleft(e.cast("bigint") + 1023, 52) + fraction
    small = (a * 2.0 ** 537 * 2.0 ** 537).cast("bigint")      # below 2^-1022 the bits are the multiple of 2^-1074
    bits = (F.when(F.isnan(x), F.lit((0x7FF << 52) + 1)).when(a == float("inf"), F.lit(0x7FF << 52))
            .when(a < 2.0 ** -1022, small).otherwise(normal))
    return F.coalesce(F.when(x < 0, -1 - bits).otherwise(bits), F.lit(-(1 << 63)).cast("bigint"))


def _digits(df: DataFrame, order_col: str) -> DataFrame:
    rows = df.withColumn(HIGH, double_image(F.col(order_col).cast("double")))
    return rows.withColumns({MIDDLE: F.shiftright(F.col(HIGH), LOW_BITS).bitwiseAND(F.lit(DIGIT - 1)),
                             HIGH: F.shiftright(F.col(HIGH), 2 * LOW_BITS)})


def ordered_pairs(df: DataFrame, order_col: str, upper: str, lower: str, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """One row per group: ``pairs``, the sum over rows of upper times the lower
    weights of all rows before it, its own counted half; ``upper`` and
    ``lower``, their totals.  Pairs within a prefix are summed where its rows
    are, pairs between prefixes from their totals, so rows are joined with
    nothing.  Keys must be unique within a group."""
    groups = list(group_cols)
    level = _digits(df, order_col).select(
        *groups, HIGH, MIDDLE, order_col, F.col(upper).alias("upper"), F.col(lower).alias("lower"),
        (F.col(upper) * (F.col(lower) / 2)).alias("pairs"))
    for kept, place in (((HIGH, MIDDLE), order_col), ((HIGH,), MIDDLE), ((), HIGH)):
        below = Window.partitionBy(*groups, *kept).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
        met = F.col("upper") * F.coalesce(F.sum("lower").over(below), F.lit(0))
        level = (level.withColumn("pairs", F.col("pairs") + met).groupBy(*groups, *kept)
                 .agg(*[F.sum(c).alias(c) for c in ("pairs", "upper", "lower")]))
    return level


def prefix_sums(df: DataFrame, order_col: str, weights: dict[str, str], group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Add ``<out>_incl`` / ``<out>_before`` running sums of each weight
    column (``weights = {out_name: weight_col}``) by the numeric
    ``order_col`` within ``group_cols``.  Keys must be unique within a group;
    a NULL key comes first.  Rows whose group is NULL are left out."""
    groups = list(group_cols)
    rows = _digits(df, order_col)

    def sums(prefix, of, window):
        return {f"_{prefix}_{o}": F.sum(c).over(window) for o, c in of.items()}

    def before(prefix):
        return [F.coalesce(F.col(f"_{prefix}_{o}"), F.lit(0)) for o in weights]

    upto = (Window.unboundedPreceding, Window.currentRow)
    below = (Window.unboundedPreceding, -1)
    total = {o: f"_total_{o}" for o in weights}
    low = rows.withColumns(sums("low", weights, Window.partitionBy(*groups, HIGH, MIDDLE).orderBy(order_col).rowsBetween(*upto)))
    middles = rows.groupBy(*groups, HIGH, MIDDLE).agg(*[F.sum(w).alias(total[o]) for o, w in weights.items()])
    highs = middles.groupBy(*groups, HIGH).agg(*[F.sum(t).alias(t) for t in total.values()])
    high = highs.select(*groups, HIGH, *[c.alias(n) for n, c in sums(
        "high", total, Window.partitionBy(*groups).orderBy(HIGH).rowsBetween(*below)).items()])
    middle = middles.select(*groups, HIGH, MIDDLE, *[c.alias(n) for n, c in sums(
        "middle", total, Window.partitionBy(*groups, HIGH).orderBy(MIDDLE).rowsBetween(*below)).items()])
    out = low.join(middle.join(high, [*groups, HIGH]), [*groups, HIGH, MIDDLE])
    offset = [a + b for a, b in zip(before("middle"), before("high"))]
    out = out.withColumns({f"{o}_incl": F.col(f"_low_{o}") + off for o, off in zip(weights, offset)})
    out = out.withColumns({f"{o}_before": F.col(f"{o}_incl") - F.col(w) for o, w in weights.items()})
    return out.drop(HIGH, MIDDLE, *[f"_{p}_{o}" for p in ("low", "middle", "high") for o in weights])

"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from riskmart.llm.spark import written

PART = 50_000        # edges of a partition; fewer partitions than the shuffles' mean less overhead


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``edges``
    (columns a, b: long).  Alternating large-star and small-star steps
    (Kiveris et al., "Connected components in MapReduce and beyond", 2014)
    until nothing changes; every step's edges are a written table.
    """
    e, state = _table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e, _ = _table(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), state[0])
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = (e.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                         F.struct("u", F.col("m").alias("v")))).alias("s"))
             .select("s.*").where("u <> v").distinct())
        last = state
        e, state = _table(e, state[0])
        if state == last:
            break
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return few(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()), state[0])


def few(df: DataFrame, rows: int) -> DataFrame:
    """A table of about ``rows`` ids in as few partitions as it needs."""
    return df.coalesce(2 * (1 + rows // PART))


def _table(e: DataFrame, about: int | None = None) -> tuple[DataFrame, tuple]:
    """The edges as a written table, their number and a sum of their hashes,
    seen while writing.  ``about``: how many edges to expect."""
    seen = Observation()
    if about is not None:
        e = few(e, about)
    table = written(e.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")), "cc")
    got = seen.get
    return table, (got["n"], got["h"])

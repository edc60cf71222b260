"""Operator 8, URL filters: a blocked Bloom filter before an exact join.

Rules are listed canonical URL prefixes, (host, path, allow or block).  A url
is looked up under every host suffix of it and every path prefix that is as
long as some listed path.  The look-ups go through a blocked Bloom filter
(each key sets eight bits of one 512-bit block); what passes is joined
exactly with the list, on the key, which removes the filter's false
positives; the longest fitting rule wins (ties: the longer host).

The filter has ``bits_per_key`` bits for each rule and is sent to all tasks
up to ``filter_bytes``; a longer list is dealt into parts by the hash of the
key, each with a filter of its own below that bound, and the urls pass them
one part after the other.  Candidates are few and the join's size is left to
the planner.

Defined cases: a null url, or one without ``://``, has an empty host and path
and meets no rule; a url without a fitting rule is allowed, as the list does
not name it; of a rule listed twice block wins; a host of any number of labels
is looked up by as many as the longest listed host has; repeated and null page ids stay as rows (urls are joined back by
a row key made of the url itself); an empty list allows all; other columns of
the pages are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.llm.spark import bounded_batches, table
from riskmart.llm.text import mix

#: The contract's rules (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_KEY = 16
FILTER_BYTES = 32 << 20
U64 = np.uint64


def canonical(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; empty where there is no ``://``."""
    at = F.locate("://", url)
    rest = F.substr(url, at + 3)
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"\A([^?#]*)", 1)
    known = F.coalesce(at, F.lit(0)) > 0
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def lookup_keys(host: Column, path: Column, lengths: list[int], labels: int) -> Column:
    """host suffix + path prefix, for every suffix of at most ``labels`` labels
    (no listed host has more) and every listed length."""
    parts = F.split(host, r"\.", -1)
    parts = F.slice(parts, F.greatest(F.size(parts) - (labels - 1), F.lit(1)), F.lit(labels))
    hosts = F.transform(F.sequence(F.lit(1), F.size(parts)),
                        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    sizes = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    return F.flatten(F.transform(hosts, lambda h: F.transform(sizes, lambda n: F.concat(h, F.substring(path, F.lit(1), n)))))


# -- blocked Bloom filter --------------------------------------------------

def _places(h: np.ndarray, blocks: int):
    """Block of each key hash and its eight bits in the block, as a mask."""
    block = ((h >> U64(32)) % U64(blocks)).astype(np.int64)
    mask, x = np.zeros((len(h), 8), np.uint64), mix(h)
    for _ in range(8):
        at = (x & U64(511)).astype(np.int64)
        mask[np.arange(len(h)), at >> 6] |= U64(1) << (at & 63).astype(np.uint64)
        x = x >> U64(9) if _ != 5 else mix(x)
    return block, mask


def build_filter(h: np.ndarray, bits_per_key: int = BITS_PER_KEY) -> np.ndarray:
    blocks = max(1, -(-len(h) * bits_per_key // 512))
    out = np.zeros((blocks, 8), np.uint64)
    block, mask = _places(h, blocks)
    np.bitwise_or.at(out, block, mask)
    return out


def may_hold(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    block, mask = _places(h, len(bloom))
    return ((bloom[block] & mask) == mask).all(axis=1)


def passes(bloom, keys: Column) -> Column:
    """The keys of an array that the filter may hold."""
    @F.pandas_udf("array<string>")
    def probe(names: pd.Series, hashes: pd.Series) -> pd.Series:
        sizes = [len(x) for x in hashes]
        flat = np.concatenate([*hashes, np.zeros(0, np.int64)]).astype(np.int64).view(np.uint64)
        ok = np.split(may_hold(bloom.value, flat), np.cumsum(sizes)[:-1])
        return pd.Series([[n for n, k in zip(x, keep) if k] for x, keep in zip(names, ok)], dtype=object)
    return probe(keys, F.transform(keys, lambda k: F.xxhash64(k)))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col="page_id", url_col="url",
               bits_per_key: int = BITS_PER_KEY, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every page; ``rules`` has
    host, path and verdict."""
    spark = pages.sparkSession
    bounded_batches(spark)
    host, path = canonical(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    listed = (rules.select(F.translate("host", UPPER, LOWER).alias("h"), F.col("path").alias("p"), "verdict")
              .groupBy("h", "p").agg(F.max("verdict").alias("v"))          # listed twice: block wins
              .select(F.concat("h", "p").alias("key"), F.concat("h", F.substr("p", F.lit(1))).alias("rule"), "v",
                      F.length("h").alias("hl"), F.length("p").alias("pl")))
    lengths = [r[0] for r in listed.select("pl").distinct().collect()]      # at most the length of a url
    if not lengths:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    n = listed.count()
    parts = -(-n * bits_per_key // (8 * filter_bytes))
    labels = listed.agg(F.max(F.size(F.split(F.substring("key", F.lit(1), F.col("hl")), r"\.", -1)))).first()[0]
    keys = lookup_keys(F.col("host"), F.col("path"), lengths, labels)
    urls = rows.select("host", "path").distinct().withColumn("keys", keys)
    hits = None
    for i in range(parts):
        own = listed.select(F.xxhash64("key").alias("k")).where(F.pmod(F.xxhash64("k"), F.lit(parts)) == i).toPandas()["k"]
        bloom = spark.sparkContext.broadcast(build_filter(own.to_numpy(np.int64).view(np.uint64), bits_per_key))
        got = urls.select("host", "path", F.explode(passes(bloom, F.col("keys"))).alias("key"))
        hits = got if hits is None else hits.unionByName(got)
    best = (hits.join(listed, "key")
            .where(F.col("pl") <= F.length("path"))
            .where(F.substring(F.col("path"), F.lit(1), F.col("pl")) == F.substr("key", F.col("hl") + 1))
            .groupBy("host", "path").agg(F.max(F.struct(F.length("key"), "hl", "rule", "v")).alias("best")))
    return (rows.join(best, ["host", "path"], "left")
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.v", F.lit("allow")).alias("verdict")))


def op8_url_filters(spark, sf_dir) -> DataFrame:
    """Operator 8 over all pages with the contract's rules."""
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


SQL8 = r"""
WITH rules(verdict, host, path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), hp AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path
  FROM u
), fit AS (
  SELECT hp.page_id, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY hp.page_id ORDER BY length(r.host || r.path) DESC) AS k
  FROM hp JOIN rules r ON (hp.host = r.host OR ends_with(hp.host, '.' || r.host)) AND starts_with(hp.path, r.path)
)
SELECT hp.page_id, hp.host, hp.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM hp LEFT JOIN (SELECT * FROM fit WHERE k = 1) f ON hp.page_id = f.page_id
"""

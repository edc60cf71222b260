"""Small tables for the operators' edge cases."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])

SF_SMALL = "/root/testdata/sf0.001"
LINE = "This very line stands in several documents"
HARD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
    (2, None),
    (3, ""),
    (4, " \t\n\r\f\x0b "),
    (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
    (6, "one"),
    (7, "one two three four"),
    (8, "ONE two THREE four"),
    (9, f"x\n{LINE}\ny"),
    (10, f"  {LINE.upper()}  \n{LINE}"),
    (11, f"{LINE}\r\nz\n"),
    (12, "Ünïcödé 日本語 \U0001f600 \u00a0 ß é\u0301 Straße <|endoftext|> <|im_end|>"),
    (13, "word" * 5000),
    (14, " ".join(f"w{i}" for i in range(20000))),
    (None, "a text without an id"),
    (6, "one"),
]


def docs(spark, rows=HARD, **more):
    """A documents table; ``more``: further constant columns."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
    return df.withColumns({c: F.lit(v) for c, v in more.items()})


def regular(n, a="a", b="b"):
    """Thue and Morse's text of n letters (a power of two) and its complement:
    equal under every polynomial hash modulo 2^64 from 1,024 letters on."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)

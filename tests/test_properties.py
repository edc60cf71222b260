"""Properties over the test tables and brute-force checks of the
distributed order statistics."""

import random

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from riskmart.operators import metrics as ME
from riskmart.operators import prep as PR
from riskmart.operators import rollups as RU
from riskmart.operators import scorecard as SC
from riskmart.operators.ranking import ordered_pairs, prefix_sums
from riskmart.plans import catalog as C
from riskmart.sources.adapter import LendingTables


def test_score_is_sum_of_criteria_and_bounded(spark):
    scored = SC.scorecard(C.scoring_base(spark, SF_SMALL), with_details=False)
    long = SC.criteria_long(scored).groupBy("applicant_id").agg(F.sum("earned").alias("s"))
    bad = scored.join(long, "applicant_id").where(
        (F.abs(F.col("s") - F.col("score")) > 1e-9) | (F.col("score") < 0) | (F.col("score") > 100))
    assert bad.count() == 0


def test_mart_keeps_application_rows(spark):
    t = LendingTables(spark, SF_SMALL)
    assert RU.mart_from_tables(t).count() == t.application().count()


def test_decision_monotone_in_p(spark):
    from riskmart.operators.decision import decision
    order = {"APPROVED": 0, "CONDITIONAL": 1, "REJECTED": 2}
    ps = [i / 200 for i in range(201)]
    df = spark.createDataFrame([(p,) for p in ps], "p double").select("p", decision(F.col("p")).alias("d"))
    got = [order[r.d] for r in df.orderBy("p").collect()]
    assert got == sorted(got)


def test_emi_repays_the_loan(spark):
    """The instalments, discounted month by month, are worth the loan."""
    from riskmart.operators.decision import emi
    loans = [(500000.0, 9.7, 60), (1000.0, 20.5, 12), (90000.0, 15.7, 360), (1.0, 8.5, 1)]
    df = spark.createDataFrame(loans, "a double, r double, n int")
    for r in df.select("a", "r", "n", emi(F.col("a"), F.col("r"), F.col("n")).alias("e")).collect():
        worth, rest = 0.0, 1.0
        for _ in range(r.n):
            rest /= 1 + r.r / 1200
            worth += r.e * rest
        assert abs(worth - r.a) < 1e-6 * r.a


def test_emi_covers_amount(spark):
    from riskmart.operators.decision import emi
    df = spark.createDataFrame([(500000.0, 9.7, 60), (1000.0, 20.5, 12), (90000.0, 15.7, 360)],
                               "a double, r double, n int")
    for r in df.select((emi(F.col("a"), F.col("r"), F.col("n")) * F.col("n") >= F.col("a")).alias("ok")).collect():
        assert r.ok


def test_prefix_sums_match_cumsum(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), float(i), rnd.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k double, w long")
    out = prefix_sums(df, "k", {"c": "w"}, ("g",)).toPandas()
    for g, part in out.groupby("g"):
        part = part.sort_values("k")
        assert (part.c_incl.values == part.w.cumsum().values).all()
        assert (part.c_before.values == part.c_incl.values - part.w.values).all()


def _hard_doubles():
    rnd = np.random.default_rng(8)
    some = rnd.integers(0, 1 << 64, 4000, dtype=np.uint64).view(np.float64)      # every exponent, subnormals too
    near = np.concatenate([np.nextafter(2.0 ** e, [0, np.inf]) for e in range(-1021, 1023, 7)])
    edge = [5e-324, 2.0 ** -1022, np.nextafter(2.0 ** -1022, 0), 1.7976931348623157e308, np.inf, 1.0, 0.5, 0.1]
    x = np.concatenate((some[~np.isnan(some)], near, edge, rnd.random(2000), 0.5 + rnd.random(500) * 1e-13))
    return np.unique(np.concatenate((x, -x))) + 0.0


def test_double_image_is_the_bits_in_order(spark):
    from riskmart.operators.ranking import double_image
    x = _hard_doubles()
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    got = {repr(r.x): r.i for r in df.select("x", double_image(F.col("x")).alias("i")).collect()}
    bits = np.abs(x).view(np.int64)
    want = np.where(x < 0, -1 - bits, bits)
    assert all(got[repr(float(v))] == int(w) for v, w in zip(x, want))
    assert got["None"] < want.min() and got["nan"] > want.max()


def test_prefix_sums_of_hard_values_and_a_fixed_plan(spark):
    x = _hard_doubles()
    df = spark.createDataFrame([(float(v), 1) for v in x] + [(None, 1)], "k double, w long")
    out = prefix_sums(df, "k", {"c": "w"})
    got = {repr(r.k): (r.c_before, r.c_incl) for r in out.collect()}
    assert got["None"] == (0, 1) and len(got) == len(x) + 1
    assert all(got[repr(float(v))] == (i + 1, i + 2) for i, v in enumerate(np.sort(x)))
    assert prefix_sums(df.limit(0), "k", {"c": "w"}).collect() == []
    n = len(x) + 1
    pairs = ordered_pairs(df, "k", "w", "w").first()
    assert (pairs.pairs, pairs.upper, pairs.lower) == (n * n / 2, n, n)

    def plan():
        return len(prefix_sums(df, "k", {"c": "w"})._jdf.queryExecution().optimizedPlan().toString())
    had, few = spark.conf.get("spark.sql.shuffle.partitions"), plan()
    spark.conf.set("spark.sql.shuffle.partitions", "4000")
    try:
        assert abs(plan() - few) < 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)


def test_median_matches_numpy(spark):
    rnd = np.random.default_rng(5)
    vals = np.concatenate([rnd.integers(0, 30, 301).astype(float), np.full(400, 7.0)])
    df = spark.createDataFrame([(float(v), float(v) * 2 if i % 2 else None) for i, v in enumerate(vals)],
                               "a double, b double")
    meds = PR.fit_medians(df, ["a", "b"])
    assert meds["a"] == float(np.median(vals))
    bv = [v * 2 for i, v in enumerate(vals) if i % 2]
    assert meds["b"] == float(np.median(bv))


def test_roc_auc_brute_force_and_monotone_invariance(spark):
    rnd = random.Random(11)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "TARGET int, p double")
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    brute = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    auc = ME.roc_auc(df).collect()[0].roc_auc
    assert abs(auc - brute) < 1e-12
    mapped = df.withColumn("p", F.exp(F.col("p") * 3))
    assert abs(ME.roc_auc(mapped).collect()[0].roc_auc - brute) < 1e-12


def test_stratified_split_exact_and_stable(spark):
    app = LendingTables(spark, SF_SMALL).application().select("SK_ID_CURR", "TARGET")
    sizes = PR.split_sizes(app)
    s1 = PR.stratified_split(app)
    got = {r.TARGET: r.n for r in s1.where("is_test").groupBy("TARGET").agg(F.count("*").alias("n")).collect()}
    assert got == {k: v[2] for k, v in sizes.items()}
    total = sum(v[0] for v in sizes.values())
    assert sum(got.values()) == -(-total // 5)          # ceil(0.2 n)
    s2 = PR.stratified_split(app.repartition(7))
    a = {r.SK_ID_CURR for r in s1.where("is_test").collect()}
    b = {r.SK_ID_CURR for r in s2.where("is_test").collect()}
    assert a == b
    # brute force: the smallest hashes per class
    pdf = app.withColumn("h", PR.split_hash()).toPandas()
    want = set()
    for k, part in pdf.groupby("TARGET"):
        want |= set(part.sort_values(["h", "SK_ID_CURR"]).SK_ID_CURR.head(sizes[k][2]))
    assert a == want


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "TARGET int")
    w = {r.TARGET: r for r in PR.class_weight_table(df).collect()}
    assert w[0].balanced_weight == 8 / (2 * 6) and w[1].balanced_weight == 8 / (2 * 2)
    assert w[1].pos_weight == 3.0 and w[0].pos_weight == 1.0


def codes_of(codes):
    return {(r.column, r.value): r.code for r in codes.collect()}


def test_label_codes_rank_all_labels(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["", "é", "ab", "abc", "Abcd"]) + f"v{rnd.randint(0, 300):03d}", rnd.choice(["x", "y", None])) for _ in range(800)]
    df = spark.createDataFrame(rows, "a string, b string")
    codes = PR.fit_label_codes(df, ["a", "b"])
    want = {("a", v): k for k, v in enumerate(sorted({a for a, _ in rows}, key=str.encode))}
    want |= {("b", v): k for k, v in enumerate(["nan", "x", "y"])}
    assert codes_of(codes) == want
    enc, table = PR.encode(df, codes, ["a", "b"])
    assert codes_of(table) == want and enc.columns == ["a", "b"]
    assert sorted(map(tuple, enc.collect())) == sorted((want["a", a], want["b", b or "nan"]) for a, b in rows)


def test_bernoulli_split_is_row_local(spark):
    app = LendingTables(spark, SF_SMALL).application().select("SK_ID_CURR", "TARGET")
    s = PR.stratified_split(app, mode="bernoulli")
    n, k = app.count(), s.where("is_test").count()
    assert 0 < k < n
    again = {r.SK_ID_CURR for r in PR.stratified_split(app.repartition(3), mode="bernoulli")
             .where("is_test").collect()}
    assert again == {r.SK_ID_CURR for r in s.where("is_test").collect()}


def test_medians_match_numpy_on_hard_columns(spark):
    rnd = np.random.default_rng(9)
    big, inf, tiny = 1.5e308, float("inf"), 4.9e-324
    cols = {"a": [*rnd.lognormal(10, 2, 3000), *[42.0] * 1500, *rnd.integers(0, 5, 801)],
            "b": [-big, big, -1.5e308, 1.5e308], "c": [inf, 1.0, -inf], "d": [0.0, tiny, tiny, 0.0, tiny], "e": [big, big],
            "f": [float("nan"), 3.0, None], "g": [inf, inf, inf, 1.0]}
    n = max(map(len, cols.values()))
    rows = [tuple(None if i >= len(v) or v[i] is None else float(v[i]) for v in cols.values()) for i in range(n)]
    got = PR.fit_medians(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(5), list(cols))
    for c, v in cols.items():
        own = sorted(float(x) for x in v if x is not None and x == x)
        m, k = own[(len(own) - 1) // 2], own[len(own) // 2]
        assert got[c] == (m if m == k else m / 2 + k / 2), c


def test_split_without_id_or_label(spark):
    rows = [(i, i % 2) for i in range(100)] + [(None, 0)] * 3 + [(200, None)] * 4
    df = spark.createDataFrame(rows, "SK_ID_CURR long, TARGET int")
    s = PR.stratified_split(df)
    assert s.where("is_test IS NULL").count() == 4 and s.where("TARGET IS NULL AND is_test IS NOT NULL").count() == 0
    assert s.where("SK_ID_CURR IS NULL").select("is_test").distinct().count() == 1
    assert s.where("is_test").count() >= -(-103 // 5)
    assert {r.TARGET for r in PR.class_weight_table(df).collect()} == {0, 1}


def test_split_with_a_hot_duplicated_id(spark):
    # one id holding a third of the rows: the split still runs on bounded
    # collects and keeps every row
    rows = [(7, 0)] * 300 + [(i, i % 2) for i in range(1000, 1600)]
    df = spark.createDataFrame(rows, "SK_ID_CURR long, TARGET int")
    s = PR.stratified_split(df)
    assert s.count() == len(rows)
    sizes = PR.split_sizes(df)
    got = {r.TARGET: r.n for r in s.where("is_test").groupBy("TARGET").agg(F.count("*").alias("n")).collect()}
    for k, (_, _, n_test) in sizes.items():
        assert got.get(k, 0) >= n_test


def test_roc_auc_equals_mllib_exact_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    scores = C.closed_form_scores(LendingTables(spark, SF_SMALL).application())
    ours = {r.scorer: r.roc_auc for r in ME.roc_auc(scores, group_cols=("scorer",)).collect()}
    ev = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="TARGET", numBins=0)
    for scorer, auc in ours.items():
        part = scores.where(F.col("scorer") == scorer).withColumn("TARGET", F.col("TARGET").cast("double"))
        assert abs(ev.evaluate(part) - auc) < 1e-12, scorer


def test_label_codes_agree_with_string_indexer_alphabet_order(spark):
    from pyspark.ml.feature import StringIndexer
    rows = [("b",), ("Z",), ("a",), ("b",), ("Secondary",), ("Academic degree",)]
    df = spark.createDataFrame(rows, "c string")
    ours = {v: k for (_, v), k in codes_of(PR.fit_label_codes(df, ["c"])).items()}
    model = StringIndexer(inputCol="c", outputCol="i", stringOrderType="alphabetAsc").fit(df)
    theirs = {label: i for i, label in enumerate(model.labels)}
    assert ours == theirs


def test_approximate_medians_close_to_exact(spark):
    rnd = np.random.default_rng(4)
    vals = rnd.normal(100, 15, 5000)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    approx = PR.fit_medians(df, ["x"], exact=False)["x"]
    assert abs(approx - float(np.median(vals))) < 1.0

import corpus_pipeline
from helpers import SF_SMALL, docs
from riskmart.llm import decontaminate, lines, near, pieces, quality
from riskmart.llm.spark import table
from test_decontaminate import bench_table
from test_lines import brute as brute_lines
from test_near import brute as brute_near

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order_and_shape(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join",
                                                      "benchmark_decontamination", "sentencepiece"]
    rows = table(spark, SF_SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, rows, SF_SMALL).columns == rows.columns


def test_run_against_brute_force(spark):
    """The classifier's verdict is taken from its query; all else by hand."""
    start = table(spark, SF_SMALL, "documents").collect()
    score = {r.doc_id: r.score for r in quality.op5_quality_classifier(spark, SF_SMALL).collect()}
    rows = [(r.doc_id, r.text) for r in start if score[r.doc_id] >= quality.REJECT]
    cut = {int(d): kept for d, _, _, kept in brute_lines(rows)}
    rows = [(d, cut[d]) for d, _ in rows]
    comp = {d: c for d, _, c in brute_near(rows)}
    rows = [(d, t) for d, t in rows if comp[str(d)] == str(d)]
    bench = [(r.item_id, r.text) for r in table(spark, SF_SMALL, "benchmark").collect()]
    flat = lambda t: [bytes(x) for x in decontaminate.words([t.encode()])[0][:, None]]

    def holds(text, item):
        t, i = flat(text), flat(item)
        return any(t[k:k + len(i)] == i for k in range(len(t) - len(i) + 1))
    rows = [(d, t) for d, t in rows if not any(holds(t, b) for _, b in bench)]
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert got.columns == [*NAMES, "n_pieces", "piece_ids"]
    lib = pieces.model_of(corpus_pipeline.public_tokenizer(corpus_pipeline.PIECE_MODEL)).lib
    out = {r.doc_id: r for r in got.collect()}
    assert sorted(out) == sorted(d for d, _ in rows)
    for d, t in rows:
        assert out[d].text == t and out[d].n_chars == len(t) and out[d].piece_ids == lib.encode(t) and out[d].n_pieces == len(lib.encode(t))


def test_odd_rows_pass_every_stage(spark, tmp_path):
    rows = docs(spark, extra=5, _row=6)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    bench_table(spark, [(1, "nothing of this")]).write.parquet(str(tmp_path / "benchmark.parquet"))
    for frame in (rows, rows.limit(0)):
        frame = lines.written(frame, "odd") if hasattr(lines, "written") else frame
        for name, stage in corpus_pipeline.STAGES:
            frame = near.written(stage(spark, frame, str(tmp_path)), name)
        assert {"extra", "_row"} <= set(frame.columns)
        frame.count()

import hashlib

import pytest
from pyspark.sql import functions as F

from helpers import HARD, docs, regular
from riskmart.llm import lines

SPACE = "\t\n\v\f\r "
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    holders = {}
    for n, (d, t) in enumerate(rows):
        for k in {x.strip(SPACE).translate(LOWER) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                holders.setdefault(k, []).append(d if d is not None else -2**63)
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        keep = [x for x in own if len(holders.get(k := x.strip(SPACE).translate(LOWER), ())) < 3
                or max(holders[k]) == (d if d is not None else -2**63)]
        out.append((str(d), len(own), len(own) - len(keep), "\n".join(keep)))
    return sorted(out)


@pytest.mark.parametrize("limit", [lines.BROADCAST_BYTES, -1])
def test_both_ways_of_probing(spark, limit):
    rows = HARD + [(20 + i, f"own {i}\n{'x' * 19}\n{'y' * 20}\n{'Y' * 20} \nrepeated line number {i % 3}") for i in range(30)]
    got = lines.dedup_lines(docs(spark, rows, kept=1, n_lines=2), broadcast_bytes=limit)
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept) for r in got.collect()) == brute(rows)


@pytest.mark.parametrize("limit", [lines.BROADCAST_BYTES, -1])
def test_rows_keep_their_columns(spark, limit):
    rows = [(i, f"a line that all of them hold\n{i}") for i in range(5)]
    got = lines.drop_lines(docs(spark, rows, kept="mine", _id=8), broadcast_bytes=limit)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "_id"]
    assert {(r.doc_id, r.text, r.kept, r.n_chars) for r in got.collect()} == (
        {(i, str(i), "mine", 1) for i in range(4)} | {(4, rows[4][1], "mine", len(rows[4][1]))})


def test_empty_table_and_query(spark, tmp_path):
    assert lines.dedup_lines(docs(spark).limit(0)).count() == 0
    docs(spark).where("doc_id = 2").write.parquet(str(tmp_path / "documents.parquet"))
    r = lines.op7_line_dedup(spark, str(tmp_path)).first()
    assert (r.n_lines, r.n_dropped, r.kept_sha256) == (1, 0, hashlib.sha256(b"").hexdigest())


def test_minimal_perfect_hash():
    import numpy as np
    h = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    levels = lines.unpack(lines.pack(lines.build_mph(h)))
    assert sorted(lines.rank_of(levels, h)) == list(range(len(h)))
    assert lines.build_mph(h[:0]) == [] and lines.rank_of([], h[:3]).tolist() == [-1, -1, -1]


@pytest.mark.parametrize("n", [1024, 8192])
@pytest.mark.parametrize("around", ["{}", "start of a line {} and its end"])
def test_regular_texts_are_told_apart(spark, n, around):
    x, y = (around.format(t) for t in regular(n))
    rows = [(1, x), (2, x), (3, y), (4, "x")]
    got = lines.dedup_lines(docs(spark, rows))
    assert sum(r.n_dropped for r in got.collect()) == 0
    rows.append((5, x + "\n" + y))
    for limit in (lines.BROADCAST_BYTES, -1):
        got = lines.dedup_lines(docs(spark, rows), broadcast_bytes=limit)
        assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept) for r in got.collect()) == brute(rows)


def test_lines_of_equal_hash_keep_their_own_counts(spark, monkeypatch):
    """Every line of a text has the same 64-bit hash here."""
    real = lines.T.span_hash
    monkeypatch.setattr(lines.T, "span_hash", lambda buf, s, e, kind=0: real(buf, s, e, 1) if kind else real(buf, s, s, 0))
    texts = [f"a line of many documents, number {k}" for k in range(4)]
    held = [(i, "\n".join(texts[:1 + i % 4])) for i in range(8)]
    parts = list(lines.counter(2, 20)(iter([_batch(held)])))
    shards = [lines.Shard(r) for b in lines.indexer(2, 3)(iter(parts)) for r in b.to_pylist()]
    assert sorted(int(x) for s in shards for x in s.n) == [4, 6, 8]


def _batch(rows):
    import pyarrow as pa
    return pa.record_batch({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows])})


def test_many_rows_without_an_id(spark):
    """Beyond the broadcast, rows are probed under a key of their own."""
    rows = [(None, f"a line that all of them hold\nown line of document {i % 40}") for i in range(200)] + [(3, "a line that all of them hold")]
    got = lines.dedup_lines(docs(spark, rows), broadcast_bytes=-1)
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept) for r in got.collect()) == brute(rows)

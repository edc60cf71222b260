import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import HARD, SF_SMALL, docs
from riskmart.llm import resample
from riskmart.llm.spark import table

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def buckets_of(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(rows, target, share=5, min_words=20):
    source, aim = np.zeros(10000, int).tolist(), np.zeros(10000, int).tolist()
    for t in rows:
        for b in buckets_of(t[1])[1]:
            source[b] += 1
    for t in target:
        for b in buckets_of(t)[1]:
            aim[b] += 1
    s_all, t_all = sum(source), sum(aim)
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) for s, t in zip(source, aim)]
    out = []
    for d, t in rows:
        n, f = buckets_of(t)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[:share * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(params=[False, True])
def small_blocks(request, monkeypatch):
    """Also with blocks, segments and dictionaries of a few words."""
    if request.param:
        monkeypatch.setattr(resample, "BLOCK", 7)
        monkeypatch.setattr(resample, "LONG", 5)
        monkeypatch.setattr(resample.T, "CHUNK", 64)
        monkeypatch.setattr(resample, "_TOKEN", re.compile(rb"[^ ]{6,}"))


def test_payloads_compose_to_checksums(small_blocks):
    texts = [t.encode() for t in [*(t or "" for _, t in HARD), "x" * 300 + " é" * 70 + " " + "y" * 5000 + " z", "a", " a  b-c_D9 "]]
    parts, words = resample.features(texts)
    got = [[] for _ in texts]
    for p in parts:
        b, of, late, late_of = resample.bucketed(p, 10000)
        for x, d in zip(b.tolist(), of.tolist()):
            got[d].append(x)
        for x, d in zip(late.tolist(), late_of.tolist()):
            got[d].remove(x)
    for t, g, n in zip(texts, got, words.tolist()):
        want_n, want = buckets_of(t.decode())
        assert n == want_n and sorted(g) == sorted(want)


def test_against_brute_force(spark):
    rows = table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()
    target = [r.text for r in table(spark, SF_SMALL, "benchmark").collect()]
    assert rows_of(resample.op12_importance_resampling(spark, SF_SMALL)) == brute([tuple(r) for r in rows], target)


def test_edge_cases(spark):
    many = " ".join(f"w{i}" for i in range(30))
    rows = HARD + [(i, f"{many} {i % 3}") for i in range(50, 90)] + [(77, f"{many} 5")] * 5 + [(None, many)] * 2
    target = spark.createDataFrame([(None,), ("",), ("w1 w2 w3",)], "text string")
    got = resample.resampled(docs(spark, rows, rank=1, score=2, bucket=3), target, share=50)
    want = brute(rows, [None, "", "w1 w2 w3"], share=50)
    assert rows_of(got) == want
    assert rows_of(resample.resampled(docs(spark, rows), target.limit(0), share=50)) == brute(rows, [], share=50)
    assert resample.resampled(docs(spark).limit(0), target).count() == 0


def test_a_hot_score_is_spread(spark):
    rows = spark.range(20000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(30).cast("long").alias("n_words"),
                                     F.lit(87).cast("long").alias("n_features"), F.lit(0).cast("long").alias("weight"),
                                     F.lit(5).cast("long").alias("score"))
    got = resample.drawn(rows.repartition(8)).where("rank IS NOT NULL")
    assert sorted(r.rank for r in got.collect()) == list(range(1, 1001))

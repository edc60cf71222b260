import random

import numpy as np
import pytest
import sentencepiece

from helpers import HARD, docs, regular
from riskmart.llm import pieces
from riskmart.llm.spark import public_tokenizer

PATH = public_tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.Model(PATH)


def random_texts(n, seed=3):
    rnd = random.Random(seed)
    signs = "abcdehist \n\té日本\U0001d4b3▁.,!the ing' "
    return ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 50))) for _ in range(n)]


def test_ids_and_texts_equal_the_library(model):
    texts = [t or "" for _, t in HARD] + random_texts(3000) + ["  two  spaces ", "\n", " ", "x" * 3000, "the " * 20000]
    got = model.encode([t.encode() for t in texts])
    assert [x.tolist() for x in got] == [model.lib.encode(t) for t in texts]
    assert [model.decode(x).decode() for x in got] == [model.lib.decode(x.tolist()) for x in got]


def test_long_words_without_spaces(model):
    rnd = random.Random(5)
    texts = [*regular(2048), "".join(rnd.choice("ABCDabcd0123+/") for _ in range(20000)), "日本語漢字" * 4000 + "the", "x" * 300,
             "".join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(1 << 18)) + "a" * 90, "ab" * 500 + "é" * 200]
    got = model.encode([t.encode() for t in texts])
    assert [x.tolist() for x in got] == [model.lib.encode(t) for t in texts]


def test_pool_and_table_run_over(model, monkeypatch):
    monkeypatch.setattr(pieces, "POOL", 64)
    monkeypatch.setattr(pieces, "KNOWN_BITS", 4)
    small = pieces.Model(PATH)
    texts = random_texts(200, 4)
    for i in range(0, 200, 20):
        assert [x.tolist() for x in small.encode([t.encode() for t in texts[i:i + 20]])] == [small.lib.encode(t) for t in texts[i:i + 20]]


class Toy(pieces.Model):
    """A unigram model of a few pieces, without a library file."""

    def __init__(self, scores):
        names = list(scores)
        raw = [x.replace(pieces.SIGN, " ").encode() for x in names]
        key = np.array([self._key(x) for x in raw], np.uint64)
        order = np.argsort(key, kind="stable")
        self.keys, self.score = key[order], np.array([scores[n] for n in names], float)[order]
        self.ids = np.arange(len(names), dtype=np.int32)[order]
        self.lengths = sorted({len(x) for x in raw}, reverse=True)
        self.maybe = np.ones(1 << 22, bool)
        self.bpe, self.fallback, self.unknown = False, False, 99
        self.unknown_score = min(scores.values()) - 10


def best_by_hand(word, scores):
    """All segmentations; the best sum, ties to the longest last piece."""
    table = {0: (0.0, [])}
    names = list(scores)
    for e in range(1, len(word) + 1):
        best = None
        for s in range(e):
            part = word[s:e]
            if part in scores:
                cost, name = scores[part], names.index(part)
            elif e - s == 1:
                cost, name = min(scores.values()) - 10, 99
            else:
                continue
            if best is None or table[s][0] + cost > best[0]:
                best = (table[s][0] + cost, table[s][1] + [name])
        table[e] = best
    out = []
    for i in table[len(word)][1]:
        if not (i == 99 and out and out[-1] == 99):
            out.append(i)
    return out


def test_unigram_viterbi_against_brute_force():
    rnd = random.Random(9)
    names = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(25)}
    scores = {n: -float(rnd.randint(1, 12)) for n in sorted(names)}
    toy = Toy(scores)
    for n in (1, 2, 5, 9, 14):
        words = ["".join(rnd.choice("abcd") for _ in range(n)) for _ in range(60)]
        ids, count = toy.viterbi(np.array([list(w.encode()) for w in words], np.uint8))
        got = [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]
        assert got == [best_by_hand(w, scores) for w in words]


def test_rows(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = pieces.encode_texts(docs(spark, HARD, ids=1), PATH)
    assert sorted((str(r.doc_id), list(r.ids)) for r in got.collect()) == sorted((str(d), lib.encode(t or "")) for d, t in HARD)
    back = pieces.decode_ids(got, PATH)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(d), t or "") for d, t in HARD)
    assert all(r.round_trip for r in pieces.round_trips(docs(spark), PATH).collect())
    assert pieces.with_ids(docs(spark, n_pieces="x"), PATH).columns[-2:] == ["n_pieces", "piece_ids"]
    assert pieces.encode_texts(docs(spark).limit(0), PATH).count() == 0

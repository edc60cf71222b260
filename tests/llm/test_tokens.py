import random

import pytest
from tokenizers import Tokenizer

from helpers import HARD, docs, regular
from riskmart.llm import tokens
from riskmart.llm.spark import public_tokenizer

PATH = public_tokenizer("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_edge_cases(spark, library):
    got = tokens.token_counts(docs(spark, HARD, n_tokens=0), PATH, limit=3).collect()
    assert len(got) == len(HARD)
    want = sorted((str(d), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False)), n > 3) for d, t in HARD)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert tokens.token_counts(docs(spark).limit(0), PATH).count() == 0


def test_random_texts_equal_the_library(library):
    rnd = random.Random(5)
    signs = " \n\t\r éa'sB1!<|>endoftx\u00a0\u3000\u2003\u0085\u1680日\U0001d4b3\x1c\x7f-"
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 80))) for _ in range(4000)]
    texts += ["<|endoftext|> <|endoftext|>a <|endoftext|>\n", "a" * 100_000, "ab " * 50_000]
    got = tokens.count_texts([t.encode() for t in texts], PATH)
    want = [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert got.tolist() == want


def test_bounded_table(monkeypatch, library):
    monkeypatch.setattr(tokens, "KNOWN", 16)
    counter = tokens.Counter(PATH)
    monkeypatch.setattr(tokens, "_counters", {PATH: counter})
    texts = [f"word{i} and more words{i % 7}" for i in range(500)]
    assert tokens.count_texts([t.encode() for t in texts], PATH).tolist() == [
        len(library.encode(t, add_special_tokens=False)) for t in texts]


def test_regular_texts_are_told_apart(library):
    """Parts that a polynomial hash would hold for equal."""
    x, y = regular(1024, "a", "bc")
    texts = [x, y, f"w {x} w", f"w {y} w"]
    assert tokens.count_texts([t.encode() for t in texts], PATH).tolist() == [
        len(library.encode(t, add_special_tokens=False)) for t in texts]
    x, y = regular(1024)
    got = tokens.T.span_hash(*_spans(x, y))
    assert got[0] != got[1]


def _spans(x, y):
    import numpy as np
    buf = np.frombuffer((x + y).encode(), np.uint8)
    return buf, np.array([0, len(x)]), np.array([len(x), len(buf)])

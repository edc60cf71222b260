import hashlib
import random
import re

import pytest

from helpers import HARD, docs
from riskmart.llm import infill

UNITS = re.compile("[^\n]*\n|[^\n]+")


def brute(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = UNITS.findall(text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return str(doc_id), n, "plain", None, None, text
    if h4 % 100 < spm:
        return str(doc_id), n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return str(doc_id), n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rnd = random.Random(4)
    lines = ["", "a", "<", "<P", "P>", "é日本\U0001f600", ">", "<S", "\r", "x" * 50, "\x00"]
    out = ["\n", "\n\n\n", "no line feed", "<P>", "a<M>b\n", "<S>\n<", "one\n"]
    out += ["\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 12))) for _ in range(300)]
    return list(enumerate(out, 100))


@pytest.mark.parametrize("rate,spm", [(100, 50), (100, 0), (100, 100), (30, 50)])
def test_against_brute_force(spark, rate, spm):
    rows = HARD + texts()
    got = infill.restored(infill.fill_in_middle(docs(spark, rows, output=1, form=2), rate=rate, spm=spm)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted(
        (brute(d, t, rate, spm) for d, t in rows), key=key)
    assert sorted((str(r.doc_id), r.restored) for r in got) == sorted((str(d), t or "") for d, t in rows)
    assert {r.form for r in got} == {"plain"} | ({"psm"} if spm < 100 else set()) | ({"spm"} if spm else set())


def test_rotation_and_long_text():
    import numpy as np
    for a, b, c in ((0, 0, 5), (0, 5, 5), (1, 3, 9), (2, 2, 2)):
        buf = bytearray(b"0123456789")
        infill.rotate(np.frombuffer(buf, np.uint8), a, b, c)
        old = b"0123456789"
        assert bytes(buf) == old[:a] + old[b:c] + old[a:b] + old[c:]
    text = ("line é\n" * 300_000).encode()
    for d in range(6):
        n, form, p, m, out = infill.transform(text, d)
        assert n == 300_000 and infill.restore(out, form) == text


def test_empty_table_and_null_outputs(spark):
    assert infill.fill_in_middle(docs(spark).limit(0)).count() == 0
    rows = spark.createDataFrame([(1, None, "psm", "x"), (2, "abc", None, "y"), (3, "abc", "plain", "z")],
                                 "doc_id long, output string, form string, restored string")
    assert sorted((r.doc_id, r.restored) for r in infill.restored(rows).collect()) == [(1, None), (2, None), (3, "abc")]

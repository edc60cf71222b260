"""Operator 13, fill-in-middle transformation by in-place block rotation.

A text is cut into units (lines with their line feed); two cuts, named by a
hash of the document's id, part it into prefix, middle and suffix.  The three
marks are set in front of their blocks in one bytearray,

    <P> prefix <M> middle <S> suffix,

and blocks change places by rotations, each made of three reversals of
neighbouring runs: the last two blocks give the form psm, the first two of
that give spm.  ``restore`` finds the marks, undoes the rotations in reverse
order and takes the marks out.  A text that holds a mark stays plain, so the
marks found are the marks set (each starts with the only ``<`` in it, so none
can arise where texts and marks meet).

Defined cases: a null text counts as empty; an empty text, one that holds a
mark and one that the rate leaves out are plain: the output is the text; a
null id counts as the empty string in the hash; rows that repeat an id or a
text are treated one by one, alike; a table without rows gives none; other
columns are not read.  A text of any length is one bytearray.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm import text as T
from riskmart.llm.spark import bounded_batches, table

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 7
RATE = 100            # of 100 texts, those that are transformed
SPM = 50              # of 100 transformed texts, those in the form spm
MARK = len(PREFIX)


def draws(seed: int, doc_id) -> list:
    """Four unsigned 32-bit numbers of a document."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i:i + 8], 16) for i in (0, 8, 16, 24)]


def unit_ends(view: np.ndarray) -> np.ndarray:
    """Where each line of a text ends (its line feed included)."""
    ends = np.flatnonzero(view == 10) + 1
    if len(view) and (not len(ends) or ends[-1] < len(view)):
        ends = np.append(ends, len(view))
    return ends


def rotate(view: np.ndarray, a: int, b: int, c: int) -> None:
    """Exchange the runs [a, b) and [b, c) in place by three reversals."""
    for lo, hi in ((a, b), (b, c), (a, c)):
        view[lo:hi] = view[lo:hi][::-1]


def transform(text: bytes, doc_id, seed: int = SEED, rate: int = RATE, spm: int = SPM):
    """(units, form, code points of prefix and of middle, output)."""
    view = np.frombuffer(text, np.uint8)
    ends = unit_ends(view)
    n = len(ends)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or h3 % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    cut = np.concatenate(([0], ends))
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m = int(cut[lo]), int(cut[hi])
    points = [int(np.count_nonzero((view[x:y] & 0xC0) != 0x80)) for x, y in ((0, p), (p, m))]
    out = bytearray(text)
    for at, mark in ((m, SUFFIX), (p, MIDDLE), (0, PREFIX)):      # from the right: earlier places stay
        out[at:at] = mark
    blocks = np.frombuffer(out, np.uint8)
    middle, suffix = p + MARK, m + 2 * MARK
    rotate(blocks, middle, suffix, len(out))                      # P S M
    form = "psm"
    if h4 % 100 < spm:
        rotate(blocks, 0, middle, middle + len(out) - suffix)     # S P M
        form = "spm"
    return n, form, *points, bytes(out)


def restore(output: bytes, form: str) -> bytes:
    """The text that ``transform`` made the output of."""
    if form == "plain":
        return output
    out = bytearray(output)
    blocks = np.frombuffer(out, np.uint8)
    middle = out.find(MIDDLE)
    if form == "spm":
        prefix = out.find(PREFIX)
        rotate(blocks, 0, prefix, middle)
    suffix = out.find(SUFFIX)
    rotate(blocks, suffix, middle, len(out))
    places = [out.find(m) for m in (SUFFIX, MIDDLE, PREFIX)]
    del blocks                                                    # a bytearray with a view keeps its size
    for at in places:
        del out[at:at + MARK]
    return bytes(out)


def _text(values: list):
    return pa.array([x.decode("utf-8", "replace") for x in values], pa.string())


def fill_in_middle(docs: DataFrame, id_col="doc_id", text_col="text", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), T.as_bytes(b.column(1))
            for i, j in T.pieces(texts):
                n, form, pre, mid, out = zip(*(transform(t, d, seed, rate, spm) for t, d in zip(texts[i:j], ids[i:j])))
                yield pa.record_batch({"doc_id": pa.array(ids[i:j], pa.int64()), "n": pa.array(n, pa.int64()), "form": pa.array(form),
                                       "prefix_chars": pa.array(pre, pa.int64()), "middle_chars": pa.array(mid, pa.int64()),
                                       "output": _text(out)})
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(rows: DataFrame, output_col="output", form_col="form", to="restored") -> DataFrame:
    """The rows with the text rebuilt from output and form as column ``to``
    (replaced where the name is taken); null in either gives null."""
    bounded_batches(rows.sparkSession)
    rows = rows.drop(to)
    out_at, form_at = rows.columns.index(output_col), rows.columns.index(form_col)

    def run(batches):
        for b in batches:
            outs, forms = b.column(out_at).cast(pa.binary()).to_pylist(), b.column(form_at).to_pylist()
            back = [None if x is None or f is None else restore(x, f).decode("utf-8", "replace") for x, f in zip(outs, forms)]
            yield pa.record_batch([*b.columns, pa.array(back, pa.string())], names=[*b.schema.names, to])
    return rows.mapInArrow(run, rows.withColumn(to, F.lit(None).cast("string")).schema)


def op13_fill_in_middle(spark, sf_dir) -> DataFrame:
    """Operator 13 over all documents (contract columns)."""
    rows = restored(fill_in_middle(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


SQL13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x
  FROM documents
), h AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4
  FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT *, array_to_string(u[1:lo], '') AS pre, array_to_string(u[lo + 1:hi], '') AS mid, array_to_string(u[hi + 1:], '') AS suf
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

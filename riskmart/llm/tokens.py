"""Operator 4, token counts: batch encoding that returns lengths only.

Texts are cut at safe boundaries: before a single space or line feed that
stands between two characters that surely are no white space.  The byte-level
pre-tokenizer starts a new piece at every such place whatever lies around it,
and no special token holds white space, so the counts of the parts add up to
the count of the whole, however long the text.  Equal parts are encoded once
per task, in batches balanced by bytes, and only their lengths are kept (in a
bounded table).

White space beyond ASCII starts with one of four lead bytes in UTF-8 (C2, E1,
E2, E3); next to those no cut is made, which only makes a part longer.

Defined cases: a null text counts as empty (0 tokens); special tokens written
inside a text are matched as the library does by default; no special tokens
are added, nothing is truncated or padded; repeated rows and null ids stay.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm import text as T
from riskmart.llm.spark import bounded_batches, public_tokenizer, table

LIMIT = 1024
BATCH_BYTES = 1 << 16     # given to the library at once
KNOWN = 1 << 21           # parts whose counts a worker remembers

#: White space, control bytes, and lead bytes of white space beyond ASCII.
_UNSURE = np.zeros(256, dtype=bool)
_UNSURE[:33] = True
_UNSURE[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_SOLID = bytes(range(33, 127))


def cut_points(buf: np.ndarray) -> np.ndarray:
    """Where a part may start: at a space or line feed between two surely
    solid characters."""
    if len(buf) < 4:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((buf == 32) | (buf == 10))
    at = at[(at > 1) & (at < len(buf) - 1)]
    before, ahead = buf[at - 1], buf[at + 1]
    plain = (before < 128) & ~_UNSURE[before]
    two = (before >= 128) & (before < 192) & (buf[at - 2] > 0xC2) & (buf[at - 2] < 0xE0)
    return at[(plain | two) & ~_UNSURE[ahead]]


class Counter:
    """Counts of parts by hash, with the library behind.

    Known counts sit in a table of fixed size, each at the slot that its hash
    names; a newer part takes the slot over.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.keys, self.counts = np.zeros(KNOWN, np.uint64), np.zeros(KNOWN, np.int64)

    def encode(self, parts: list) -> np.ndarray:
        """Lengths, from batches of about equal bytes.  Parts that start at a
        cut point and end with a solid character are encoded side by side;
        the offset of a token tells its part.  The others go alone."""
        out = np.zeros(len(parts), np.int64)
        texts = [p.decode("utf-8", "replace") for p in parts]
        size = np.fromiter(map(len, texts), np.int64, len(texts))        # code points, as the offsets count
        weight = np.fromiter(map(len, parts), np.int64, len(parts))      # bytes
        joint = np.fromiter((len(p) > 1 and p[0] in b" \n" and (p[-1] in _SOLID or 0xC2 < p[-2] < 0xE0) for p in parts), bool, len(parts))
        for own, together in ((np.flatnonzero(joint), True), (np.flatnonzero(~joint), False)):
            total = np.concatenate(([0], np.cumsum(size[own])))
            load = np.concatenate(([0], np.cumsum(weight[own])))
            i = 0
            while i < len(own):
                j = max(i + 1, int(np.searchsorted(load, load[i] + BATCH_BYTES, side="right")) - 1)
                group = [texts[k] for k in own[i:j].tolist()]
                if together:
                    at = np.array(self.tok.encode("".join(group), add_special_tokens=False).offsets, np.int64)[:, 0]
                    part = np.searchsorted(total[i:j + 1] - total[i], at, side="right") - 1
                    out[own[i:j]] = np.bincount(part, minlength=j - i)
                else:
                    out[own[i:j]] = [len(x) for x in self.tok.encode_batch_fast(group, add_special_tokens=False)]
                i = j
        return out

    def count(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each span."""
        h = T.span_hash(buf, starts, ends)
        slot = (h & np.uint64(KNOWN - 1)).astype(np.int64)
        out = self.counts[slot]
        new = np.flatnonzero(self.keys[slot] != h)
        if len(new):
            own, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            raw = buf.tobytes()
            got = self.encode([raw[starts[i]:ends[i]] for i in new[first].tolist()])
            out[new] = got[back]
            at = (own & np.uint64(KNOWN - 1)).astype(np.int64)
            self.keys[at], self.counts[at] = own, got
        return out


_counters: dict = {}


def count_texts(texts: list, path: str) -> np.ndarray:
    """Token counts of texts (bytes)."""
    counter = _counters.get(path)
    if counter is None:
        counter = _counters[path] = Counter(path)
    out = np.zeros(len(texts), np.int64)
    for i, j in T.pieces(texts):
        buf, lo, hi = T.join(texts[i:j], b"\0")
        starts = np.sort(np.concatenate((cut_points(buf), lo[lo < hi])), kind="stable")
        if not len(starts):
            continue
        doc = np.searchsorted(hi, starts, side="right")
        ends = np.minimum(np.append(starts[1:], hi[-1]), hi[doc])
        np.add.at(out, i + doc, counter.count(buf, starts, ends))
    return out


def token_counts(docs: DataFrame, path: str, id_col="doc_id", text_col="text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; ``path``: a
    byte-level BPE file of the tokenizers library."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = T.as_bytes(b.column(1))
            n = count_texts(texts, path)
            yield pa.record_batch({"doc_id": b.column(0).cast(pa.int64()),
                                   "n_bytes": pa.array([len(x) for x in texts], pa.int64()),
                                   "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array(n > limit)})
    return (docs.select(F.col(id_col).cast("long"), F.col(text_col))
            .mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"))


def op4_token_counts(spark, sf_dir) -> DataFrame:
    """Operator 4 over all documents (contract columns)."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"))

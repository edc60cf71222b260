"""Operator 3, benchmark decontamination: an inverted index of the test items
with block maxima, asked by every passage of every document.

Items are indexed with BM25 impacts divided by the item's score for its own
text, so one threshold, a share of that score, holds for all.  An item of more
than SEGMENT words is searched by segments of like length, each with a share
of its own; the item's score is that of its best segment.  Items of like
vocabulary order lie in blocks; for every term the index keeps the largest impact in each block.

A document's passages are windows of two strides of words, one starting at
every stride; a stride is as long as the longest item or segment, so every one that a
document holds lies whole in a window.  As in block-max WAND, terms are
parted by their bounds: a block's cheap terms together stay below CHEAP times
the threshold, so a window goes on for a block only where the block maxima of
the essential terms it holds make up for the rest (summed for the words of
each stride, two strides a window), then where the block maxima of all its
distinct terms do, and only there items are scored exactly.  All items at or above the threshold
are retrieved; nothing is cut to the best few.

Each hit is verified on the words around the window, widened by the length of
the whole item: of the item's question (all but its last sentence) and of its
answer (the last sentence) given shares of the word trigrams must occur.  An
item of fewer than WHOLE words must occur whole, word after word; one of a
single word is thus found wherever the word stands.

The index goes to every task; distinct items are dealt by their hash into
shards of about SHARD_ITEMS items and SHARD_BYTES of text at most, each with
statistics of its own and one pass over the documents, so no broadcast grows
with the benchmark.

Defined cases: null or wordless items match nothing, nor do null or wordless
texts; words are runs of letters, digits and bytes beyond ASCII with A-Z
lower-cased; items that repeat an id match each by themselves and count as
one; items without an id are told as null; documents that repeat an id give a row each; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm import text as T
from riskmart.llm.spark import bounded_batches, table, written

K1, B = 1.2, 0.75
THRESHOLD = 0.6          # share of the item's score for its own text
QUESTION = 0.6           # share of the question's trigrams
ANSWER = 0.6             # share of the answer's trigrams
WHOLE = 8                # items of fewer words count only where they occur whole
SEGMENT = 128            # words of an indexed item at most; longer ones in equal segments
LEAST_STRIDE = 32
BLOCK = 8                # items of a block
CHEAP = 0.5              # of the threshold that a block's cheap terms may hold
SHARD_ITEMS = 2_000
SHARD_BYTES = 4 << 20    # of their text
PIECE = 2 << 20
U64 = np.uint64
_PART = np.zeros(256, dtype=bool)
_PART[48:58] = _PART[97:123] = _PART[128:] = True
_STEP = T.mix(np.arange(1, 9, dtype=np.uint64)) | U64(1)


def words(texts: list):
    """(hash, text index) of the words, in order."""
    buf, _, ends = T.join(texts)
    low = T.LOWER[buf]
    cut = np.flatnonzero(np.diff(_PART[low], prepend=False, append=False))
    s, e = cut[::2], cut[1::2]
    return T.span_hash(low, s, e), np.searchsorted(ends, s, side="right")


def grams(h: np.ndarray, n: int = 3) -> np.ndarray:
    """Distinct hashes of the n-grams; of the whole where it is shorter."""
    n = min(n, len(h))
    if not n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out += h[i:len(h) - n + 1 + i] * _STEP[i]
    return np.unique(T.mix(out + U64(n)))


def question_and_answer(text: bytes) -> tuple[bytes, bytes]:
    """All but the last sentence, and the last; one sentence is both."""
    body = text.rstrip()
    at = max(body[:-1].rfind(x) for x in (b". ", b"? ", b"! ", b".\n", b"?\n", b"!\n", b"\n"))
    return (text, text) if at < 0 else (body[:at + 1], body[at + 1:])


class Index:
    def __init__(self, items: list):
        """items: (id, text as bytes)."""
        self.ids, self.parts, sets, tfs = [], [], [], []
        for item, text in items:
            h = words([text])[0]
            q, a = (words([x])[0] for x in question_and_answer(text))
            if not len(q) or not len(a):
                q = a = h
            if not len(h):
                continue
            if len(h) < WHOLE:
                whole = (grams(h, len(h)), len(h)), (grams(h, len(h)), len(h)), len(h)
            else:
                whole = (grams(q), min(3, len(q))), (grams(a), min(3, len(a))), len(h)
            for seg in np.array_split(h, -(-len(h) // SEGMENT)):    # for the search only
                terms, tf = np.unique(seg, return_counts=True)
                self.ids.append(item), self.parts.append(whole)
                sets.append(terms), tfs.append(tf)
        n = len(sets)
        self.vocab, df = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        size = np.array([t.sum() for t in tfs], float)
        mean = size.mean() if n else 1.0
        rows = []
        for terms, tf, dl in zip(sets, tfs, size):
            at = np.searchsorted(self.vocab, terms)
            impact = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
            rows.append((at, impact / impact.sum()))
        self.stride = max([LEAST_STRIDE, *(int(t.sum()) for t in tfs)])
        # blocks of items whose rarest terms are alike
        order = sorted(range(n), key=lambda i: (int(rows[i][0][np.argmax(rows[i][1])]), i))
        self.blocks, t_of, b_of, v_of, self.cheap = [], [], [], [], []
        for k in range(0, n, BLOCK):
            own = order[k:k + BLOCK]
            terms = np.unique(np.concatenate([rows[i][0] for i in own]))
            mat = np.zeros((len(terms), len(own)))
            for c, i in enumerate(own):
                mat[np.searchsorted(terms, rows[i][0]), c] = rows[i][1]
            top = mat.max(axis=1)
            by = np.lexsort((terms, df[terms]))[::-1]   # most frequent first: the cheap ones
            low = np.cumsum(mat[by], axis=0).max(axis=1) < CHEAP * THRESHOLD
            count = int(low.argmin()) if not low.all() else len(by)
            need = np.sort(by[count:])
            self.cheap.append(float(mat[by[:count]].sum(axis=0).max()) if count else 0.0)
            self.blocks.append((np.array(own), terms, mat))
            t_of.append(terms[need]), b_of.append(np.full(len(need), k // BLOCK)), v_of.append(top[need])
        t_of, b_of, v_of = (np.concatenate([*x, np.zeros(0, int)]) for x in (t_of, b_of, v_of))
        by = np.argsort(t_of, kind="stable")
        self.post_block, self.post_value = b_of[by].astype(np.int64), v_of[by]
        self.post_at = np.searchsorted(t_of[by], np.arange(len(self.vocab) + 1))
        # words find their term in an open table of hash prefixes
        self.bits = max(10, int(4 * len(self.vocab) + 1).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int32)
        for t, s in enumerate((self.vocab >> U64(64 - self.bits)).tolist()):
            while self.slot[s] >= 0:
                s = (s + 1) & ((1 << self.bits) - 1)
            self.slot[s] = t

    def terms(self, h: np.ndarray) -> np.ndarray:
        """Term of each word, -1 for words in no item."""
        at = (h >> U64(64 - self.bits)).astype(np.int64)
        out = self.slot[at].astype(np.int64)
        todo = np.flatnonzero((out >= 0) & (self.vocab[out] != h)) if len(self.vocab) else np.zeros(0, int)
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            out[todo] = self.slot[at[todo]]
            todo = todo[(out[todo] >= 0) & (self.vocab[out[todo]] != h[todo])]
        return out

    def search(self, texts: list):
        """(text index, item number, share of the item's score) of all windows'
        items at or above the threshold, the best window of each; verified."""
        h, doc = words(texts)
        if not len(h) or not len(self.blocks):
            return []
        lo, hi = T.group_bounds(doc, len(texts))
        position = np.arange(len(h)) - lo[doc]
        windows = -(-(hi - lo) // self.stride)
        base = np.concatenate(([0], np.cumsum(windows)))
        term = self.terms(h)
        found = self._open(term, base[doc] + position // self.stride, base)
        owner = np.repeat(np.arange(len(texts)), windows)
        hits: dict = {}
        for w, b in found:
            d = int(owner[w])
            a = int(lo[d]) + (w - int(base[d])) * self.stride
            z = min(a + 2 * self.stride, int(hi[d]))
            own, terms, mat = self.blocks[b]
            has = np.unique(term[a:z])
            inside = np.isin(terms, has, assume_unique=True)
            if mat[inside].max(axis=1, initial=0).sum() < THRESHOLD - 1e-9:
                continue                                  # block maxima of all terms
            score = mat[inside].sum(axis=0)
            for c in np.flatnonzero(score >= THRESHOLD - 1e-9).tolist():
                item = int(own[c])
                q, ans, size = self.parts[item]
                key, top = (d, self.ids[item]), min(1.0, float(score[c]))
                if hits.get(key, (0.0,)) >= (top, 1.0, 1.0):
                    continue                              # as by the item's other segments
                near = h[max(int(lo[d]), a - size):min(int(hi[d]), z + size)]
                share = [float(np.isin(x, grams(near, n)).mean()) for x, n in (q, ans)]
                if share[0] >= QUESTION and share[1] >= ANSWER:
                    new = (top, *share)
                    hits[key] = max(hits.get(key, new), new)
        return [(*k, *v) for k, v in hits.items()]

    def _open(self, term, cell, base):
        """(window, block) pairs whose essential terms can reach the threshold."""
        first, last = self.post_at[term], self.post_at[term + 1]
        own = np.flatnonzero((term >= 0) & (last > first))
        size = last[own] - first[own]
        at = np.repeat(first[own] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        key = np.repeat(cell[own], size) * len(self.blocks) + self.post_block[at]
        sums = np.bincount(key, self.post_value[at], minlength=int(base[-1]) * len(self.blocks)).reshape(-1, len(self.blocks))
        after = np.zeros_like(sums)
        after[:-1] = sums[1:]
        after[base[1:][base[1:] > 0] - 1] = 0             # the last cell of a text has none after it
        w, b = np.nonzero(sums + after + np.array(self.cheap) >= THRESHOLD - 1e-9)
        return zip(w.tolist(), b.tolist())


OUT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def leaks(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text="text",
          shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every
    document and test item that it holds."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for index in indexes(spark, items, item_col, item_text, shard_items):
        got = rows.mapInArrow(_asker(index), OUT)
        out = got if out is None else out.unionByName(got)
    return out


def indexes(spark, items: DataFrame, item_col="item_id", item_text="text", shard_items: int = SHARD_ITEMS):
    """The broadcast index of each shard of the items."""
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).distinct()
    total = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    shards = max(1, -(-total.n // shard_items), -(-total.b // SHARD_BYTES))
    if shards > 1:
        items = written(items, "items")
    for s in range(shards):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == s).collect()    # about SHARD_ITEMS
        own = sorted(((r.item_id, (r.text or "").encode()) for r in own), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield spark.sparkContext.broadcast(Index(own))


def drop_leaks(docs: DataFrame, items: DataFrame, text_col="text", item_col="item_id", item_text="text",
               shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item."""
    spark = docs.sparkSession
    bounded_batches(spark)
    at = docs.columns.index(text_col)

    def keeper(index):
        def keep(batches):
            for b in batches:
                texts = T.as_bytes(b.column(at))
                clean = np.ones(len(texts), bool)
                for i, j in T.pieces(texts, PIECE):
                    clean[[i + r[0] for r in index.value.search(texts[i:j])]] = False
                yield b.filter(pa.array(clean))
        return keep
    for index in indexes(spark, items, item_col, item_text, shard_items):
        docs = docs.mapInArrow(keeper(index), docs.schema)
    return docs


def _asker(index):
    def run(batches):
        for b in batches:
            ids, texts, out = b.column(0).to_pylist(), T.as_bytes(b.column(1)), []
            for i, j in T.pieces(texts, PIECE):
                out += [(ids[i + d], *x) for d, *x in index.value.search(texts[i:j])]
            names = ("doc_id", "item_id", "score", "question_overlap", "answer_overlap")
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.record_batch({n: pa.array([r[k] for r in out], kinds[k]) for k, n in enumerate(names)})
    return run


def op3_benchmark_decontamination(spark, sf_dir) -> DataFrame:
    """Operator 3: all documents against all test items."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

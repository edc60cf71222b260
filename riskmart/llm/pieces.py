"""Operator 9, SentencePiece encoding and decoding: batched numpy Viterbi.

The text is normalised as the model says (dummy prefix, white space as one
sign) and cut where no piece can reach across: before a white-space sign that
follows another sign.  Distinct words of the same number of bytes advance
together: prefix hashes give the hash of every substring, the hashes probe
the sorted keys of the pieces (behind a table of their low bits), and at each
end position the best of all piece lengths, with its backpointer, comes from
one maximum over the rows of a length.  A long word is first cut where no
piece that occurs in it reaches across.  Of equal scores the longest last piece wins, as in the unigram
model of the library.  Characters without a piece become byte pieces where
the model has them, else the unknown piece.  Known words of a task are kept
in a table of fixed size.

For unigram models a path's score is the sum of its pieces' scores.  In a BPE
model the scores are merge ranks, whose sum says nothing; there a piece may
follow another only if no merge across their border would come before the
merges inside them (a sequence is the BPE encoding exactly when that holds
for all its neighbours), and the one piece at each end that may follow is the
maximum.  Both give the ids of the library.

Substrings are hashed by a polynomial modulo 2^64, which collides for texts
of a regular build from 1,024 bytes on; no piece is that long.

Defined cases: a null text counts as empty (no pieces); the white-space sign
U+2581 in a text is a space after decoding, as in the library; repeated rows
and null ids stay; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from riskmart.llm import text as T
from riskmart.llm.spark import bounded_batches, public_tokenizer, table

SIGN = "▁"
UNKNOWN_PENALTY = 10.0    # fixed value: what an unknown character scores below the worst piece
KNOWN_BITS = 22           # table of known words, as a power of two
POOL = 1 << 24            # ids kept for known words
PAIRS_BITS = 20           # table of known neighbours, as a power of two
CELLS = 1 << 18           # (word, position) cells of a Viterbi batch
LONG = 64                 # bytes of a word that is cut at its borders first
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BYTE = T.mix(np.arange(1, 257, dtype=np.uint64))
#: Bytes of a character by its first byte (1 for bytes that cannot be first).
_LENGTH = np.ones(256, np.int8)
_LENGTH[0xC2:0xE0], _LENGTH[0xE0:0xF0], _LENGTH[0xF0:0xF5] = 2, 3, 4


def model_type(proto: bytes) -> int:
    """trainer_spec.model_type (field 2, then 3) of a model: 1 unigram, 2 BPE."""
    def fields(b):
        i = 0
        while i < len(b):
            key, i = number(b, i)
            size = {1: 8, 5: 4}.get(key & 7)
            if key & 7 == 0:
                value, i = number(b, i)
            else:
                if size is None:
                    size, i = number(b, i)
                value, i = b[i:i + size], i + size
            yield key >> 3, value

    def number(b, i):
        out = shift = 0
        while True:
            out |= (b[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if b[i - 1] < 128:
                return out, i
    spec = dict(fields(proto)).get(2, b"")
    return dict(fields(spec)).get(3, 1)


class Model:
    """Pieces of a model file and the encoder's tables."""

    def __init__(self, path: str):
        import sentencepiece
        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        own = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        names = [lib.id_to_piece(i) for i in own]
        self.apart = not any(SIGN in x.lstrip(SIGN) for x in names)
        # sentinel texts tell how the model normalises
        self.plain = all(lib.normalize(x) == SIGN + x.replace(" ", SIGN) for x in ("a", " a  b ", "ﬁÅ\n\tx", "ẛ̣ Z"))
        self.prefix = lib.normalize("a") == SIGN + "a"
        byte_ids = {lib.id_to_piece(i): i for i in range(n) if lib.is_byte(i)}
        self.bytes = np.array([byte_ids.get(f"<0x{b:02X}>", lib.unk_id()) for b in range(256)], np.int32)
        self.fallback = len(byte_ids) == 256
        self.unknown = lib.unk_id()
        raw = [x.replace(SIGN, " ").encode() for x in names]
        score = np.array([lib.get_score(i) for i in own], float)
        self.unknown_score = (score.min() if len(score) else 0.0) - UNKNOWN_PENALTY
        key = np.array([self._key(x) for x in raw], np.uint64)
        order = np.argsort(key, kind="stable")
        self.keys, self.score, self.ids = key[order], score[order], np.array(own, np.int32)[order]
        self.lengths = sorted({len(x) for x in raw}, reverse=True)
        self.bpe = model_type(lib.serialized_model_proto()) == 2
        if self.bpe:
            self._merges([raw[i] for i in order])
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.keys & U64((1 << 22) - 1)).astype(np.int64)] = True
        out = [b" \xe2\x81\x87 " if lib.is_unknown(i) else b"" if lib.is_control(i) else
                    bytes([int(lib.id_to_piece(i)[3:5], 16)]) if lib.is_byte(i) else
                    lib.id_to_piece(i).replace(SIGN, " ").encode() for i in range(n)]
        self.out_size = np.array([len(x) for x in out], np.int64)
        self.out_at = np.cumsum(self.out_size) - self.out_size
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.at = np.zeros(1 << KNOWN_BITS, np.int64)
        self.size = np.zeros(1 << KNOWN_BITS, np.int32)
        self.name = np.zeros(1 << KNOWN_BITS, np.uint64)
        self.pool, self.half, self.used = np.zeros(POOL, np.int32), 0, 0

    @staticmethod
    def _key(raw: bytes):
        h = 0
        for b in raw:
            h = (h * int(_BASE) + int(_BYTE[b])) & (2**64 - 1)
        return T.mix(np.array([h], np.uint64) + U64(len(raw)))[0]

    def normalised(self, texts: list) -> list:
        """UTF-8 with a space for each white-space sign."""
        if self.plain:
            return [b" " + t.replace(b"\xe2\x96\x81", b" ") if t else b"" for t in texts]
        return [self.lib.normalize(t.decode("utf-8", "replace")).replace(SIGN, " ").encode() for t in texts]

    # -- BPE neighbours -----------------------------------------------------

    def _merges(self, raw: list) -> None:
        """For each piece the two pieces that its last merge joins (-1: a
        character), found by merging its own characters; and what the check
        of neighbours needs."""
        index = {x: i for i, x in enumerate(raw)}
        one = {x for x in raw if len(x.decode()) == 1}
        if not {c.encode() for x in raw for c in x.decode()} <= one:
            raise ValueError("a BPE model whose pieces hold characters without a piece")
        self.rank = -self.score
        self.left, self.right = np.full(len(raw), -1), np.full(len(raw), -1)
        self.real = np.zeros(len(raw), bool)               # pieces that their own text is merged to
        for i, x in enumerate(raw):
            parts = [c.encode() for c in x.decode()]
            self.real[i] = len(parts) == 1
            while len(parts) > 1:
                pairs = [(self.rank[index[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in index]
                if not pairs:
                    break
                k = min(pairs)[1]
                if len(parts) == 2:
                    self.left[i], self.right[i], self.real[i] = index[parts[0]], index[parts[1]], True
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
        self.hash = np.zeros(len(raw), np.uint64)
        self.shift = np.ones(len(raw), np.uint64)
        for i, x in enumerate(raw):
            h, power = 0, 1
            for b in x:
                h, power = (h * int(_BASE) + int(_BYTE[b])) & (2**64 - 1), power * int(_BASE) & (2**64 - 1)
            self.hash[i], self.shift[i] = h, power
        self.long = np.array([len(x) for x in raw], np.uint64)
        self.pair = np.full(1 << PAIRS_BITS, -1, np.int64)
        self.fits = np.zeros(1 << PAIRS_BITS, bool)

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may stand after piece a (places in the sorted
        keys); answers are kept by pair."""
        name = a * len(self.keys) + b
        slot = (T.mix(name.astype(np.uint64)) & U64((1 << PAIRS_BITS) - 1)).astype(np.int64)
        out = self.fits[slot]
        new = np.flatnonzero(self.pair[slot] != name)
        if len(new):
            own, first, back = np.unique(name[new], return_index=True, return_inverse=True)
            got = self._follows(a[new[first]], b[new[first]])
            out[new] = got[back]
            self.pair[slot[new[first]]], self.fits[slot[new[first]]] = own, got
        return out

    def _follows(self, a, b):
        """Undo the later of the two last merges again and again: the pair
        fails where the characters next to the border would merge across it
        before the merge just undone (on the left of it equal ranks come
        first, on the right of it last)."""
        out, at = np.ones(len(a), bool), np.arange(len(a))
        limit, strict = np.full(len(a), np.inf), np.ones(len(a), bool)
        while len(at):
            key = T.mix(self.hash[a] * self.shift[b] + self.hash[b] + self.long[a] + self.long[b])
            k = np.searchsorted(self.keys, key)
            k[k == len(self.keys)] = 0
            rank = np.where(self.keys[k] == key, self.rank[k], np.inf)
            bad = np.isfinite(rank) & np.where(strict, rank < limit, rank <= limit)
            out[at[bad]] = False
            ra = np.where(self.left[a] < 0, -np.inf, self.rank[a])
            rb = np.where(self.left[b] < 0, -np.inf, self.rank[b])
            go = ~bad & (np.maximum(ra, rb) > -np.inf)
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            undo = ra > rb
            limit, strict = np.where(undo, ra, rb), undo
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return out

    # -- Viterbi ------------------------------------------------------------

    def matches(self, words: np.ndarray):
        """All places of pieces in rows of equal length: (row, start, length,
        place in the sorted keys; -1: a character that has no piece), by
        (end, row), the longest first."""
        m, n = words.shape
        h = np.zeros((m, n + 1), np.uint64)
        for i in range(n):
            h[:, i + 1] = h[:, i] * _BASE + _BYTE[words[:, i]]
        size = _LENGTH[words]
        alone = size + np.arange(n) <= n
        found = []
        for x in (x for x in self.lengths if x <= n):
            key = T.mix(h[:, x:] - h[:, :-x] * U64(pow(int(_BASE), x, 1 << 64)) + U64(x)).ravel()
            hit = np.flatnonzero(self.maybe[(key & U64((1 << 22) - 1)).astype(np.int64)])
            at = np.searchsorted(self.keys, key[hit])
            at[at == len(self.keys)] = 0
            ok = self.keys[at] == key[hit]
            row, s = np.divmod(hit[ok], n - x + 1)
            if x <= 4:
                whole = size[row, s] == x
                alone[row[whole], s[whole]] = False
            at = at[ok]
            if self.bpe:
                own = self.real[at]
                row, s, at = row[own], s[own], at[own]
            found.append((row, s, np.full(len(row), x), at))
        row, s = np.nonzero(alone)
        found.append((row, s, size[row, s].astype(np.int64), np.full(len(row), -1)))
        row, s, x, at = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((-x, row, s + x))
        return row[order], s[order], x[order], at[order]

    def viterbi(self, words: np.ndarray, joined: bool = True):
        """Rows of equal length (bytes): ids of all rows in a row, and how many.
        ``joined=False`` leaves unknown characters of a model without byte
        pieces as single ids of -2."""
        m, n = words.shape
        row, s, x, at = self.matches(words)
        end = s + x
        score = np.where(at < 0, 0.0 if self.bpe else self.unknown_score, 0.0 if self.bpe else self.score[at])
        name = np.where(at < 0, -2, self.ids[at])
        cut = np.searchsorted(end, np.arange(n + 2))
        best = np.full((m, n + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((m, n + 1), np.int32), np.full((m, n + 1), -1, np.int32)
        last = np.full((m, n + 1), -1)                     # place of the last piece, for BPE
        for e in range(1, n + 1):
            a, z = cut[e], cut[e + 1]
            if a == z:
                continue
            r, b = row[a:z], s[a:z]
            c = best[r, b] + score[a:z]
            if self.bpe:
                old = last[r, b]
                ask = np.flatnonzero(np.isfinite(c) & (old >= 0) & (at[a:z] >= 0))
                c[ask[~self.follows(old[ask], at[a + ask])]] = -np.inf
                c[np.isfinite(c)] = 0                      # one piece only can end here
            first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            top = np.maximum.reduceat(c, first)
            run = np.repeat(np.arange(len(first)), np.diff(np.append(first, z - a)))
            is_top = np.flatnonzero((c == top[run]) & np.isfinite(c))
            pick = is_top[np.concatenate(([True], run[is_top][1:] != run[is_top][:-1]))[:len(is_top)]]      # the longest of them
            r = r[pick]
            best[r, e], back[r, e], piece[r, e], last[r, e] = c[pick], x[a + pick], name[a + pick], at[a + pick]
        # a byte that starts no character and ends none (broken text) stands alone
        ends, starts, ids, rows = [], [], [], []
        row, at = np.arange(m), np.full(m, n)
        while len(row):
            stuck = ~np.isfinite(best[row, at])
            b, i = np.where(stuck, 1, back[row, at]), np.where(stuck, -2, piece[row, at])
            rows.append(row), ends.append(at), starts.append(at - b), ids.append(i)
            at = at - b
            row, at = row[at > 0], at[at > 0]
        if not rows:
            return np.zeros(0, np.int32), np.zeros(m, np.int64)
        row, s, e, i = (np.concatenate(x) for x in (rows, starts, ends, ids))
        order = np.lexsort((s, row))
        row, s, e, i = row[order], s[order], e[order], i[order]
        if self.fallback:
            copies = np.where(i == -2, e - s, 1)
            lone = np.repeat(i == -2, copies)
            place = np.repeat(s - (np.cumsum(copies) - copies), copies) + np.arange(copies.sum())
            row, i = np.repeat(row, copies), np.repeat(i, copies)
            i[lone] = self.bytes[words[row[lone], place[lone]]]
        elif joined:
            row, i = self._joined(row, i)
        return i.astype(np.int32), np.bincount(row, minlength=m)

    def _joined(self, row, ids):
        """A run of unknown characters of a row is one piece."""
        again = (ids == -2) & np.concatenate(([False], (ids[1:] == -2) & (ids[:-1] == -2) & (row[1:] == row[:-1])))[:len(ids)]
        row, ids = row[~again], ids[~again]
        return row, np.where(ids == -2, self.unknown, ids)

    def borders(self, word: np.ndarray) -> np.ndarray:
        """Places inside a long word that no piece and no character of it
        spans: what lies on either side is encoded on its own."""
        _, s, x, _ = self.matches(word[None])
        step = np.zeros(len(word) + 1, np.int64)
        np.add.at(step, s + 1, 1)
        np.add.at(step, s + x, -1)
        return np.flatnonzero(np.cumsum(step[1:-1]) == 0) + 1

    # -- texts --------------------------------------------------------------

    def encode(self, texts: list) -> list:
        """Ids of each text (bytes in, int32 arrays out)."""
        out = []
        for i, j in T.pieces(texts):
            out += self._encode(self.normalised(texts[i:j]))
        return out

    def _encode(self, texts: list) -> list:
        buf, lo, hi = T.join(texts, b"\0")
        if self.apart:
            cut = np.flatnonzero((buf[1:] == 32) & (buf[:-1] != 32)) + 1
            starts = np.sort(np.concatenate((cut, lo[(lo < hi) & ~((buf[lo] == 32) & (lo > 0))])), kind="stable")
        else:
            starts = lo[lo < hi]
        if not len(starts):
            return [np.zeros(0, np.int32) for _ in texts]
        doc = np.searchsorted(hi, starts, side="right")
        ends = np.minimum(np.append(starts[1:], hi[-1]), hi[doc])
        h = T.span_hash(buf, starts, ends)
        slot = (h & U64((1 << KNOWN_BITS) - 1)).astype(np.int64)
        at, size = self.at[slot], self.size[slot].astype(np.int64)
        new = np.flatnonzero((self.name[slot] != h) | (size == 0))
        if len(new):
            own_hash, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            ids, count = self._words(buf, starts[new[first]], ends[new[first]])
            begin = np.cumsum(count) - count
            size[new] = count[back]
        total = np.cumsum(size)
        flat = np.empty(total[-1], np.int32)
        fresh = np.zeros(len(slot), bool)
        fresh[new] = True
        for own, start, source in ((~fresh, at, self.pool), (fresh, None, None)):
            if own.any():
                if source is None:
                    start, source = np.zeros(len(slot), np.int64), ids
                    start[new] = begin[back]
                step = np.arange(size[own].sum()) - np.repeat(np.cumsum(size[own]) - size[own], size[own])
                flat[np.repeat((total - size)[own], size[own]) + step] = source[np.repeat(start[own], size[own]) + step]
        if len(new):
            self._keep(own_hash, ids, begin, count)
        per = np.bincount(doc, size, minlength=len(texts)).astype(np.int64)
        return np.split(flat, np.cumsum(per)[:-1])

    def _keep(self, names, ids, begin, count) -> None:
        """Remember the ids of distinct words.  The pool is filled in two
        halves: a half that is begun anew forgets its own words only."""
        half = POOL // 2
        if len(ids) > half:
            return
        if self.used + len(ids) > half:
            self.used, self.half = 0, half - self.half
            self.size[(self.at >= self.half) & (self.at < self.half + half)] = 0
        first = self.half + self.used
        self.pool[first:first + len(ids)] = ids
        place = (names & U64((1 << KNOWN_BITS) - 1)).astype(np.int64)
        self.name[place], self.at[place], self.size[place] = names, begin + first, count
        self.used += len(ids)

    def _words(self, buf, starts, ends):
        """Ids of distinct words, in their order, and how many each has.  Long
        words are first cut at their borders."""
        n_words, owner = len(starts), np.arange(len(starts))
        long = np.flatnonzero(ends - starts > LONG)
        if len(long):
            more = [starts[w] + self.borders(buf[starts[w]:ends[w]]) for w in long.tolist()]
            owner = np.concatenate((owner, np.repeat(long, [len(x) for x in more])))
            starts = np.concatenate((starts, *more))
            order = np.lexsort((starts, owner))
            owner, starts, ends = owner[order], starts[order], ends[owner[order]]
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            ends[inside] = starts[inside + 1]
        size = ends - starts
        parts, counts, order = [], [], np.argsort(size, kind="stable")
        i = 0
        while i < len(order):
            n = int(size[order[i]])
            j = int(np.searchsorted(size[order], n, side="right"))
            j = min(j, i + max(1, CELLS // (n + 1)))
            own = order[i:j]
            ids, count = self.viterbi(buf[starts[own][:, None] + np.arange(n)], joined=False)
            parts.append(ids), counts.append(count)
            i = j
        count = np.zeros(len(order), np.int64)
        count[order] = np.concatenate(counts)
        flat, began = np.concatenate(parts), np.zeros(len(order), np.int64)
        sorted_count = count[order]
        began[order] = np.cumsum(sorted_count) - sorted_count
        total = np.cumsum(count)
        flat, owner = flat[np.repeat(began - (total - count), count) + np.arange(total[-1])], np.repeat(owner, count)
        if not self.fallback:
            owner, flat = self._joined(owner, flat)
        return flat.astype(np.int32), np.bincount(owner, minlength=n_words)

    def decode(self, ids) -> bytes:
        return self.decode_all([np.asarray(ids, np.int64)])[0]

    def decode_all(self, lists: list) -> list:
        """The text (bytes) of each array of ids: the pieces' bytes, gathered
        by their places in one array."""
        out, i = [], 0
        size = np.array([len(x) for x in lists], np.int64)
        total = np.concatenate(([0], np.cumsum(size)))
        while i < len(lists):
            j = max(i + 1, int(np.searchsorted(total, total[i] + T.PIECE, side="right")) - 1)
            ids = np.concatenate(lists[i:j]).astype(np.int64)
            width = self.out_size[ids]
            stop = np.cumsum(width)
            raw = self.out[np.repeat(self.out_at[ids] - (stop - width), width) + np.arange(stop[-1] if len(stop) else 0)].tobytes()
            edge = np.concatenate(([0], stop))[total[i:j + 1] - total[i]].tolist()
            for a, z in zip(edge, edge[1:]):
                a += self.prefix and raw[a:min(a + 1, z)] == b" "
                out.append(raw[a:z].decode("utf-8", "replace").encode())
            i = j
        return out


_models: dict = {}


def model_of(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


# -- Spark -----------------------------------------------------------------

def encoded(batches, model: Model, column: int):
    """Each batch with its texts and their ids; as many batches as make
    T.CHUNK bytes are encoded at once, so that many words share a length."""
    held, size = [], 0

    def flush():
        ids = iter(model.encode([t for _, texts in held for t in texts]))
        for b, texts in held:
            yield b, texts, [next(ids) for _ in texts]

    for b in batches:
        held.append((b, T.as_bytes(b.column(column))))
        size += sum(map(len, held[-1][1]))
        if size >= T.CHUNK:
            yield from flush()
            held, size = [], 0
    yield from flush()


def encode_texts(docs: DataFrame, path: str, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, ids): the piece ids of every row's text."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b, _, ids in encoded(batches, model_of(path), 1):
            yield pa.record_batch({"doc_id": b.column(0).cast(pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32()))})
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, ids array<int>")


def with_ids(docs: DataFrame, path: str, text_col="text") -> DataFrame:
    """The rows of ``docs`` with n_pieces and piece_ids (columns of these
    names are replaced)."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop("n_pieces", "piece_ids")
    at = docs.columns.index(text_col)

    def run(batches):
        for b, _, ids in encoded(batches, model_of(path), at):
            yield pa.record_batch([*b.columns, pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
                                  names=[*b.schema.names, "n_pieces", "piece_ids"])
    kinds = StructType([*docs.schema.fields, StructField("n_pieces", LongType()), StructField("piece_ids", ArrayType(IntegerType()))])
    return docs.mapInArrow(run, kinds)


def decode_ids(rows: DataFrame, path: str, id_col="doc_id", ids_col="ids") -> DataFrame:
    """(doc_id, text) of piece ids; null ids give an empty text."""
    bounded_batches(rows.sparkSession)

    def run(batches):
        for b in batches:
            ids = [np.array(x or [], np.int64) for x in b.column(1).to_pylist()]
            texts = [x.decode() for x in model_of(path).decode_all(ids)]
            yield pa.record_batch({"doc_id": b.column(0).cast(pa.int64()), "text": pa.array(texts, pa.string())})
    return rows.select(F.col(id_col).cast("long"), F.col(ids_col)).mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, path: str, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_pieces, ids_sha256, decoded_sha256, round_trip): encoding
    and decoding in one pass, as digests (ids as little-endian 32-bit)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        model = model_of(path)
        for b, texts, ids in encoded(batches, model, 1):
            back = model.decode_all(ids)
            yield pa.record_batch({
                "doc_id": b.column(0).cast(pa.int64()), "n_pieces": pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                "round_trip": pa.array([x == y.replace(b"\xe2\x96\x81", b" ") for x, y in zip(back, texts)])})
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
        run, "doc_id long, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def op9_sentencepiece(spark, sf_dir) -> DataFrame:
    """Operator 9 over all documents."""
    return round_trips(table(spark, sf_dir, "documents"), public_tokenizer("piece_bpe_32k.model"))

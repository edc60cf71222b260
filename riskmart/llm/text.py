"""Vectorised text primitives for Arrow tasks.

A batch of texts becomes one byte buffer; words, lines and chunks are spans
of it and a span's 64-bit hash is a sum over its eight-byte words, so the cost
of a byte is a few array passes whatever the number of spans.  Every routine
works on pieces of bounded size; only one span (a word, a line) or one text
longer than the piece makes a larger buffer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 20          # bytes hashed at a time
CHUNK = 4 << 20          # bytes of text handled at a time
U64 = np.uint64

_SEED = (U64(0x243F6A8885A308D3), U64(0xB7E151628AED2A6A))     # digits of pi and of e
_STRIDE = U64(0x9E3779B97F4A7C15)
#: Which bytes of a little-endian word its first n bytes are.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)

#: A-Z to a-z, every other byte unchanged (UTF-8 continuation bytes included).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII white space: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (public domain constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
    """64-bit hash of each span; spans ascend and do not overlap.  ``kind``
    picks one of two independent hashes.

    A span is read as words of eight bytes; each is mixed under a key of its
    own for its place in the span, and the mixed words are added up.  (A
    polynomial modulo 2^64 would need no such step, but texts of a regular
    build, as Thue and Morse's, collide there whatever its base.)"""
    out = np.zeros(len(starts), dtype=np.uint64)
    seed, i = _SEED[kind], 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + PIECE, side="right")))
        size = int(ends[j - 1]) - lo
        raw = np.zeros(size + 8, dtype=np.uint8)
        raw[:size] = buf[lo:lo + size]
        words = np.ndarray((size + 1,), dtype="<u8", buffer=raw, strides=(1,))     # the word at every byte
        s, n = starts[i:j] - lo, ends[i:j] - starts[i:j]
        sums = mix((words[s] & _FIRST[np.minimum(n, 8)]) ^ mix(seed[None])) + n.astype(np.uint64) * _STRIDE
        more = np.flatnonzero(n > 8)
        if len(more):
            count = (n[more] - 1) // 8
            total = np.cumsum(count)
            place = np.arange(1, total[-1] + 1) - np.repeat(total - count, count)
            at = np.repeat(s[more], count) + 8 * place
            left = np.minimum(np.repeat(n[more], count) - 8 * place, 8)
            key = mix(seed + place.astype(np.uint64) * _STRIDE)
            sums[more] += np.add.reduceat(mix((words[at] & _FIRST[left]) ^ key), total - count)
        out[i:j] = sums
        i = j
    return mix(out)


def word_spans(buf: np.ndarray):
    """Starts and ends of the maximal runs of bytes that are not ASCII white
    space: in UTF-8 exactly the code point runs ``[^\\x20\\x09-\\x0D]+``."""
    gap = SPACE[buf]
    edge = np.empty(len(buf) + 1, dtype=bool)
    edge[0] = True
    edge[1:] = gap
    starts = np.flatnonzero(edge[:-1] & ~gap)
    edge[:-1] = gap
    edge[-1] = True
    ends = np.flatnonzero(~edge[:-1] & edge[1:]) + 1
    return starts, ends


def as_bytes(column) -> list:
    """Texts as UTF-8 bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def pieces(texts: list, size: int = CHUNK):
    """Cut a list of texts into runs of about ``size`` bytes: (first, last + 1)."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield first, i
            first, total = i, 0
        total += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def join(texts: list, sep: bytes = b"\n"):
    """One buffer with ``sep`` (one byte) after every text, and where each
    text starts and ends in it."""
    buf = np.frombuffer(sep.join(texts) + sep, dtype=np.uint8)
    size = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(size + 1) - 1
    return buf, ends - size, ends


def text_words(texts: list):
    """Lower-cased words of the texts: (hash, index of the text), in order."""
    buf, _, ends = join(texts)
    low = LOWER[buf]
    s, e = word_spans(low)
    return span_hash(low, s, e), np.searchsorted(ends, s, side="right")


def group_bounds(sorted_ids: np.ndarray, n: int):
    """Where the run of each id 0..n-1 starts and ends in a sorted array."""
    at = np.searchsorted(sorted_ids, np.arange(n + 1))
    return at[:-1], at[1:]

"""Numpy helpers over Arrow text columns, used inside ``mapInArrow`` tasks.

Texts stay one byte buffer per Arrow batch; words, word hashes and n-gram keys are computed for a slice of rows at a
time, so memory is bounded by the slice size (or by one text, if a single text is larger).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 18  # its 8-byte temporaries stay in the processor's cache

_rng = np.random.default_rng(20240917)
_BYTE_CODE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False

_WORD_CODE = _BYTE_CODE[LOWER]  # A-Z count as a-z

_pow_cache: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser on a uint64 array."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pow_cache or len(_pow_cache[0]) < n:
        m = max(n, SLICE_BYTES + 1)
        out = []
        for base in (_BASE, _BASE_INV):
            p = np.full(m, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        if n > 8 * SLICE_BYTES:  # a rare giant text: don't keep its tables
            return out[0], out[1]
        _pow_cache[:] = out
    return _pow_cache[0], _pow_cache[1]


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, int64 offsets) of a string column; null counts as empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    n = len(arr)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset:arr.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return buf, offs


def row_slices(offs: np.ndarray, target: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``target`` bytes (at least one row each)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + target, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def _hash_words(b: np.ndarray, doc_starts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, start positions) of the words in ``b``; a word never crosses one of ``doc_starts``."""
    n = len(b)
    is_word = IS_WORD[b]
    flip = np.empty(n + 1, dtype=bool)
    flip[0], flip[n] = is_word[0], is_word[-1]
    np.not_equal(is_word[1:], is_word[:-1], out=flip[1:n])
    edges = np.flatnonzero(flip)
    cut = np.unique(doc_starts[doc_starts > 0])  # once where empty texts lie between
    cut = cut[is_word[cut - 1] & is_word[cut]]  # a word ends and another begins there
    if len(cut):
        edges = np.sort(np.concatenate((edges, cut, cut)))
    start, end = edges[0::2], edges[1::2]
    power, inverse = _powers(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    each = (_WORD_CODE if lower else _BYTE_CODE)[b]
    each *= power[:n]
    np.cumsum(each, out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    return mix64(h + (end - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93)), start


def word_hashes(buf: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of rows ``offs`` and the number of words per row.

    A word is a maximal run of bytes other than space and 0x09-0x0D; with ``lower`` A-Z hash like a-z. A text over
    ``SLICE_BYTES`` is hashed in pieces cut at white space, so only one piece's temporaries are held.
    """
    s, e = int(offs[0]), int(offs[-1])
    rows = len(offs) - 1
    if e == s:
        return np.empty(0, np.uint64), np.zeros(rows, np.int64)
    if rows > 1 or e - s <= 2 * SLICE_BYTES:
        rel = offs - s
        h, start = _hash_words(buf[s:e], rel[:-1][rel[:-1] < e - s], lower)
        return h, np.diff(np.searchsorted(start, rel))
    parts, at = [], s
    while at < e:
        cut = min(at + SLICE_BYTES, e)
        while cut < e:
            gap = np.flatnonzero(~IS_WORD[buf[cut:min(cut + SLICE_BYTES, e)]])
            if len(gap):
                cut += int(gap[0])
                break
            cut = min(cut + SLICE_BYTES, e)
        parts.append(_hash_words(buf[at:cut], np.zeros(1, np.int64), lower)[0])
        at = cut
    h = np.concatenate(parts)
    return h, np.array([len(h)], dtype=np.int64)


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values of a non-empty array."""
    x = np.sort(x)
    new = np.empty(len(x), dtype=bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def release_memory() -> None:
    """Hand back what a finished task's arrays took: workers are reused, and the allocator keeps freed memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def tidy(run):
    """A ``mapInArrow`` function that hands its memory back at its end."""
    def wrapped(batches):
        yield from run(batches)
        release_memory()
    return wrapped


def shingle_sets(words: np.ndarray, counts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct ``width``-word shingle hashes of each row; with fewer words the whole sequence is one
    shingle; without words the set is empty."""
    bounds = np.concatenate(([0], np.cumsum(counts)))
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
        for j in range(width):
            if len(full):
                full += words[j:j + len(full)] * U64((0xA0761D6478BD642F * (2 * j + 3)) & (2**64 - 1))
        full = mix64(full)
        for i in range(len(counts)):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= width:
                yield distinct(full[a:b - width + 1])
            elif b > a:
                h = U64(b - a)
                for w in words[a:b]:
                    h = mix64(np.array([h * U64(0xE7037ED1A0B428DB) + w], dtype=np.uint64))[0]
                yield np.array([h], dtype=np.uint64)
            else:
                yield np.empty(0, np.uint64)

"""Vectorised text primitives shared by the training-data operators.

Everything here works on flat numpy arrays over the UTF-8 bytes of an Arrow string column, so one Arrow
batch costs a few array passes and no per-row Python. A *word* is a maximal run of ASCII letters, ASCII
digits and bytes above 0x7F; ASCII and Latin-1 capitals are folded first. ``word_list`` states the same
rule row by row and is what the brute-force tests use.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
_LEN_SALT = np.uint64(0x9E3779B97F4A7C15)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row is a range of its own, never cut."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def fold(data: np.ndarray) -> np.ndarray:
    """Lower-case ASCII and the Latin-1 letters (two bytes, the first 0xC3)."""
    out = _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    if len(lead):
        tail = data[lead + 1]
        up = lead[(tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] + 1
        out[up] += 0x20
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans(folded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words; no word crosses a row."""
    n = len(folded)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = _WORD[folded]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[1:], after[:-1] = w[:-1], w[1:]
    before[0] = after[-1] = False
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    before[inner] = False
    after[inner - 1] = False
    return np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1


def hash_spans(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, injective up to eight bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.empty(len(folded) + 8, np.uint8)
    padded[: len(folded)] = folded
    padded[len(folded) :] = 0
    view = np.ndarray((len(folded) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    length = ends - starts
    h = mix((view[starts] & _MASK[np.minimum(length, 8)]) ^ (length.astype(np.uint64) * _LEN_SALT))
    at, more = 8, np.flatnonzero(length > 8)
    while len(more):
        left = length[more] - at
        h[more] = mix(h[more] ^ (view[starts[more] + at] & _MASK[np.minimum(left, 8)]))
        at += 8
        more = more[left > 8]
    return h


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their byte starts, and for each row the range of its words (length rows + 1)."""
    folded = fold(data)
    starts, ends = spans(folded, offsets)
    return hash_spans(folded, starts, ends), starts, np.searchsorted(starts, offsets)


def grams(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles and their row ranges; a row of 1..n-1 words is one shingle."""
    sizes = np.diff(bounds)
    count = np.where(sizes >= n, sizes - n + 1, (sizes > 0).astype(sizes.dtype))
    out_bounds = np.concatenate([[0], np.cumsum(count)])
    total = int(out_bounds[-1])
    row = np.repeat(np.arange(len(sizes)), count)
    first = bounds[:-1][row] + (np.arange(total) - out_bounds[:-1][row])
    acc = np.zeros(total, np.uint64)
    for k in range(n):
        at = first + k
        ok = at < bounds[1:][row]
        nxt = h[np.minimum(at, max(len(h) - 1, 0))] if len(h) else acc
        acc = np.where(ok, mix(acc * np.uint64(0x100000001B3) + nxt), acc)
    return acc, out_bounds


_WORD_RE = re.compile("[0-9a-z\x80-\U0010ffff]+")
_FOLD = {c: c + 32 for c in [*range(65, 91), *range(0xC0, 0xDF)] if c != 0xD7}


def word_list(text: str | None) -> list[str]:
    """The words of one text, as plain Python; the reference form of ``words``."""
    return _WORD_RE.findall((text or "").translate(_FOLD))

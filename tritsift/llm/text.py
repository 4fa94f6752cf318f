"""Words of whole Arrow string columns as 64-bit hashes, by numpy.

A word is a maximal run of ASCII letters and digits and of bytes from 0x80 on
(so every non-ASCII letter counts), in the lower-cased text. A null text is an
empty one. ``words`` hashes all words of a column at once: a span's hash is the
sum, over its chunks of eight bytes, of a mix of the chunk and its place, mixed
with the length. No chunk enters linearly, so that texts of a regular build
don't meet as they do under a polynomial modulo 2**64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at a time.
SLICE_BYTES = 1 << 20
_B = 0x9E3779B97F4A7C15
_U = np.uint64
#: malloc_trim, where the C library has it.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def _mixed(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0xD1342543DE82EF95) + _U(seed))


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's last step: every bit of the result depends on every bit of h."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_SPACE, _WORD, _PUNCT = 0, 1, 2
_CLASS = np.full(256, _PUNCT, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = _SPACE
_CLASS[0x80:] = _WORD
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _CLASS[_lo:_hi] = _WORD
_IS_WORD = _CLASS == _WORD
_places: list[np.ndarray] = [np.zeros(0, _U)]


def places(n: int) -> np.ndarray:
    """Keys of the first n chunks of a span."""
    if len(_places[0]) < n:
        _places[0] = _mixed(max(2 * n, 1 << 12), 11)
    return _places[0]


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, and where each row begins (one more at the end)."""
    arr = arr.fill_null("") if arr.null_count else arr
    wide = pa.types.is_large_string(arr.type)
    _, offs, data = arr.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text; a longer text is a piece by itself."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    piece = (np.cumsum(size) - size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)
    tidy()


def tidy() -> None:
    """Gives freed memory back to the system: workers are kept between tasks and stages, and what they hold counts in the executor's memory."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


@dataclass
class Chunks:
    """The eight-byte chunks of spans, the last of each filled up with zeros."""

    value: np.ndarray
    #: The span of each chunk, its place in it, and each span's first chunk and number of them.
    owner: np.ndarray
    place: np.ndarray
    first: np.ndarray
    count: np.ndarray
    size: np.ndarray

    def total(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.size), _U)
        full = self.count > 0
        if full.any():
            out[full] = np.add.reduceat(x, self.first[full])
        return out

    def hash(self) -> np.ndarray:
        return mix(self.total(self._mixed()) + self.size.astype(_U) * _U(0xA24BAED4963EE407))

    def both(self) -> tuple[np.ndarray, np.ndarray]:
        """The hash and a second one that doesn't depend on it."""
        x = self._mixed()
        n = self.size.astype(_U)
        return mix(self.total(x) + n * _U(0xA24BAED4963EE407)), mix(self.total(mix(x ^ _U(0x2545F4914F6CDD1D))) ^ n * _U(0x9FB21C651E98DF25))

    def _mixed(self) -> np.ndarray:
        return mix(self.value ^ places(int(self.count.max(initial=0)))[self.place])


def padded(data: np.ndarray) -> np.ndarray:
    """data with eight zeros behind it, as ``chunks`` needs it."""
    return np.concatenate([data, np.zeros(8, np.uint8)])


def chunks(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Chunks:
    """Chunks of the spans [start, end) of padded bytes."""
    size = end - start
    count = (size + 7) >> 3
    first = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(size)), count)
    place = np.arange(len(owner)) - first[owner]
    step = place << 3
    value = np.ndarray((max(len(data) - 7, 0),), "<u8", data, 0, (1,))[start[owner] + step]
    left = size[owner] - step
    short = np.flatnonzero(left < 8)
    value[short] &= (_U(1) << (left[short] << 3).astype(_U)) - _U(1)
    return Chunks(value, owner, place, first, count, size)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values, by doubling."""
    out, done, g, size = None, 0, h, 1
    while True:
        if k & size:
            out = g if out is None else mix(out[: max(len(out) - size, 0)] * _U(_B) + g[done : done + max(len(out) - size, 0)])
            done += size
        if done == k:
            return out if len(h) >= k else h[:0]
        g = mix(g[:-size] * _U(_B) + g[size:]) if len(g) > size else g[:0]
        size *= 2


def words(arr: pa.Array, lower: bool = True, punct: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word, and where each row's words begin (one more at the end).

    punct: runs of other bytes that aren't white space are words too. lower:
    case is ignored; the byte positions are then those of the lower-cased text.
    """
    data, offs = buffers(pc.utf8_lower(arr) if lower else arr)
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, _U), z, z, np.zeros(len(offs), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    if punct:
        c = _CLASS[data]
        w = c != _SPACE
        edge[1:-1] |= c[1:] != c[:-1]
    else:
        w = _IS_WORD[data]
        edge[1:-1] |= w[1:] != w[:-1]
    start = np.flatnonzero(w & edge[:-1])
    end = np.flatnonzero(w & edge[1:]) + 1
    return chunks(padded(data), start, end).hash(), start, end, np.searchsorted(start, offs)


def ngrams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of consecutive words within rows, and where each row's begin.

    A row of fewer than n words, but not none, has one n-gram of all of them.
    """
    count = np.diff(row)
    if n == 1 or not len(h):
        return h, row
    g = mix(h + _U(n))
    for k in range(1, n):
        g = mix(g[:-1] * _U(_B) + h[k:])
    made = np.maximum(count - n + 1, 0)
    begin = np.concatenate([[0], np.cumsum(made)])
    owner = np.repeat(np.arange(len(count)), made)
    out = g[np.arange(begin[-1]) - begin[owner] + row[owner]]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        at, left = row[short], count[short]
        extra = mix(h[at] + _U(n))
        for k in range(1, n - 1):
            more = np.flatnonzero(left > k)
            extra[more] = mix(extra[more] * _U(_B) + h[at[more] + k])
        out = np.insert(out, begin[short], extra ^ _U(0x5851F42D4C957F2D))
        made[short] = 1
        begin = np.concatenate([[0], np.cumsum(made)])
    return out, begin


def plain_words(text: str | None) -> list[bytes]:
    """The words of one text, for tests and small tables."""
    import re

    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())


def hash_words(items: list[bytes]) -> np.ndarray:
    """Hashes of given words, as ``words`` makes them."""
    ends = np.cumsum([len(w) for w in items], dtype=np.int64)
    return chunks(padded(np.frombuffer(b"".join(items), np.uint8)), np.append(0, ends[:-1])[: len(items)], ends).hash()

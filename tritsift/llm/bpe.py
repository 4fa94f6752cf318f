"""Byte-level BPE encoding and decoding.

Text is cut into pre-tokens by the vocabulary's pattern ('s|'t|'re|'ve|'m|'ll|'d,
runs of letters, of digits, of other signs, each with a space before it, and
runs of white space), for a whole column at once. Two tiers encode them: a
minimal perfect hash over the vocabulary resolves whole pre-tokens, and those
that it lacks are merged by rank, a heap over the linked bytes giving the next
pair; a bounded cache keeps the results of the latter. Ids are those of the
rank file.

Null text gives null ids, and null ids null text; empty text gives no ids. Ids
that are null or outside the vocabulary stand for nothing when decoding, and
bytes that aren't UTF-8 become U+FFFD. Texts of any length are encoded whole.
Repeated rows are encoded each. Other columns are left out, whatever their names.

The rank file's place is a parameter; the driver reads it and broadcasts it.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tritsift.llm import text as tx

_U = np.uint64
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens whose merges a worker remembers.
CACHE = 400_000
_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3


def read_ranks(path: str = VOCABULARY) -> list[bytes]:
    """The tokens of a rank file in the order of their ids, which are dense."""
    with open(path, "rb") as f:
        pairs = sorted((int(r), base64.b64decode(t)) for t, r in map(bytes.split, f))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must count up from 0")
    return [t for _, t in pairs]


@dataclass
class PerfectHash:
    """slot = shift of the key's bucket: a displacement, or -1 - slot for a bucket of one key."""

    shift: np.ndarray
    key: np.ndarray
    value: np.ndarray

    def find(self, h: np.ndarray) -> np.ndarray:
        """The value of each key, -1 if there is none."""
        n = len(self.key)
        s = self.shift[(h >> _U(32)) * _U(len(self.shift)) >> _U(32)]
        slot = np.where(s < 0, -1 - s, _slot(h, s, n))
        return np.where(self.key[slot] == h, self.value[slot], -1)


def _slot(h: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    x = (h ^ shift.astype(np.int64).view(_U)) * _U(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> _U(31))) % _U(n)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys by hashing into buckets and displacing them, the largest first."""
    n = len(keys)
    m = max(1, n // 4)
    bucket = ((keys >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(m + 1))
    taken = np.zeros(n, bool)
    shift = np.zeros(m, np.int64)
    place = np.full(n, -1, np.int64)
    size = np.diff(edges)
    free: list[int] | None = None
    for b in np.argsort(-size, kind="stable").tolist():
        own = order[edges[b] : edges[b + 1]]
        if not len(own):
            break
        if len(own) == 1:
            if free is None:
                free = np.flatnonzero(~taken)[::-1].tolist()
            slot = free.pop()
            shift[b], place[own[0]] = -1 - slot, slot
            continue
        base = 0
        while True:
            tries = np.arange(base, base + 512, dtype=np.int64)
            slots = _slot(keys[own][None, :], tries[:, None], n)
            good = ~taken[slots].any(1)
            good[good] = (np.diff(np.sort(slots[good], axis=1), axis=1) > 0).all(1)
            if good.any():
                t = int(np.argmax(good))
                shift[b], place[own] = tries[t], slots[t]
                taken[slots[t]] = True
                break
            base += 512
    key, value = np.zeros(n, _U), np.zeros(n, np.int64)
    key[place], value[place] = keys, np.arange(n)
    return PerfectHash(shift, key, value)


def merge(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of the lowest rank, the leftmost of equal ones, is joined until none is left."""
    n = len(word)
    if n == 1:
        return [rank[word]]
    after, before = list(range(1, n + 2)), list(range(-1, n))
    heap = []
    get = rank.get
    for i in range(n - 1):
        r = get(word[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, i, end = pop(heap)
        j = after[i]
        if j < 0 or j >= n or after[j] != end:  # a part of the pair has been joined to something
            continue
        after[i], after[j] = end, -1
        if end < n:
            before[end] = i
            far = after[end]
            r = get(word[i:far])
            if r is not None:
                push(heap, (r, i, far))
        p = before[i]
        if p >= 0:
            r = get(word[p:end])
            if r is not None:
                push(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(rank[word[i : after[i]]])
        i = after[i]
    return out


_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    if not _classes:
        import regex

        table = np.full(0x110000, _OTHER, np.uint8)
        every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\x00" for c in range(0x110000))
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                table[m.start() : m.end()] = kind
        _classes.append(table)
    return _classes[0]


def pretokens(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """First bytes of the pre-tokens of texts of UTF-8 that stand one after another, text i from offs[i]."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    table = _class_table()
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    first = data[at]
    cls = table[first]  # right for ASCII
    wide = np.flatnonzero(first >= 0x80)
    if len(wide):
        pad = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        p = at[wide]
        a, b, c, d = pad[p], pad[p + 1] & 63, pad[p + 2] & 63, pad[p + 3] & 63
        cp = np.where(a < 0xE0, (a & 31) << 6 | b, np.where(a < 0xF0, (a & 15) << 12 | b << 6 | c, (a & 7) << 18 | b << 12 | c << 6 | d))
        cls[wide] = table[np.minimum(cp, 0x10FFFF)]
    k = len(at)
    begins = np.zeros(k, bool)  # first characters of texts
    starts = np.searchsorted(at, offs)
    begins[starts[starts < k]] = True
    brk = begins.copy()
    brk[1:] |= cls[1:] != cls[:-1]
    run = np.flatnonzero(brk)
    end = np.append(run[1:], k)
    # White space before something else in the same text gives up its last character, to that if it is a space.
    inner = np.flatnonzero((cls[run] == _SPACE) & (end < k))
    e = end[inner]
    e = e[~begins[e]]
    brk[e - 1] = True
    brk[e[first[e - 1] == 32]] = False
    # An apostrophe by itself takes in the letters of a contraction.
    o = np.flatnonzero((cls[run] == _OTHER) & (end - run == 1) & (end < k))
    o = o[(first[run[o]] == 39) & brk[run[o]]]
    if len(o):
        nxt = end[o]
        ok = (cls[nxt] == _LETTER) & ~begins[nxt]
        nxt, stop = nxt[ok], end[o[ok] + 1]
        one = np.isin(first[nxt], np.frombuffer(b"stmd", np.uint8))
        second = first[np.minimum(nxt + 1, k - 1)]
        two = (stop - nxt >= 2) & (((first[nxt] == ord("l")) & (second == ord("l"))) | (np.isin(first[nxt], np.frombuffer(b"vr", np.uint8)) & (second == ord("e"))))
        for hit, size in ((one, 1), (two, 2)):
            brk[nxt[hit]] = False
            longer = nxt[hit][stop[hit] - nxt[hit] > size]
            brk[longer + size] = True
    return at[brk]


class Encoder:
    def __init__(self, tokens: list[bytes], table: PerfectHash | None = None):
        self.tokens = tokens
        self.table = table or perfect_hash(tx.hash_words(tokens))
        self.rank: dict[bytes, int] = {}
        self.cache: dict[bytes, bytes] = {}
        lengths = np.array([len(t) for t in tokens], np.int64)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.begin, self.length = np.append(np.cumsum(lengths) - lengths, 0), np.append(lengths, 0)
        self.chunks = tx.chunks(tx.padded(self.bytes), self.begin[:-1], self.begin[:-1] + lengths)

    def __reduce__(self):
        return Encoder, (self.tokens, self.table)

    def _whole(self, spans: tx.Chunks) -> np.ndarray:
        """Ids of the spans that are tokens, -1 for others. The hash finds the token, its bytes decide."""
        ids = self.table.find(spans.hash())
        ids[(ids >= 0) & (self.length[ids] != spans.size)] = -1
        mine = ids[spans.owner]
        known = np.flatnonzero(mine >= 0)
        other = spans.value[known] != self.chunks.value[self.chunks.first[mine[known]] + spans.place[known]]
        ids[spans.owner[known[other]]] = -1
        return ids

    def encode(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin (one more at the end)."""
        data, offs = tx.buffers(arr)
        start = pretokens(data, offs)
        end = np.append(start[1:], len(data))
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        spans = tx.chunks(tx.padded(data), start, end)
        ids = self._whole(spans)
        miss = np.flatnonzero(ids < 0)
        count = np.ones(len(ids), np.int64)
        if len(miss):
            self.rank = self.rank or {t: i for i, t in enumerate(self.tokens)}
            if len(self.cache) > CACHE:
                self.cache.clear()
            raw, cache, parts = data.tobytes(), self.cache, []
            numbers: dict[bytes, int] = {}
            back = np.empty(len(miss), np.int64)
            for n, (s, e) in enumerate(zip(start[miss].tolist(), end[miss].tolist())):
                word = raw[s:e]
                k = numbers.get(word)
                if k is None:
                    k = numbers[word] = len(parts)
                    got = cache.get(word)
                    if got is None:
                        got = cache[word] = np.array(merge(word, self.rank), "<i4").tobytes()
                    parts.append(got)
                back[n] = k
            size = np.array([len(x) >> 2 for x in parts], np.int64)
            flat = np.frombuffer(b"".join(parts), "<i4")
            count[miss] = size[back]
            first = np.cumsum(count) - count
            out = np.repeat(ids, count).astype(np.int32)
            n = count[miss]
            to = np.repeat(first[miss] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            src = np.repeat((np.cumsum(size) - size)[back] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out[to] = flat[src]
        else:
            out = ids.astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(count)])
        return out, ends[np.searchsorted(start, offs)]

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts, and where each begins (one more at the end)."""
        known = np.where((ids >= 0) & (ids < len(self.tokens)), ids, len(self.tokens))
        n = self.length[known]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.bytes[np.repeat(self.begin[known] - ends[:-1], n) + np.arange(ends[-1])], ends[offs]



_encoders: dict[object, Encoder] = {}


def encoder(path: str = VOCABULARY) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(read_ranks(path))
    return _encoders[path]


def _worker(shared, path: str) -> Encoder:
    """One encoder a Python worker and file, with its cache."""
    if path not in _encoders:
        _encoders[path] = Encoder(*shared.value)
    return _encoders[path]


def encode_documents(docs: DataFrame, path: str = VOCABULARY, check: bool = True) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip): round_trip tells whether the ids decode to the text, null unless ``check``."""
    e = encoder(path)
    shared = docs.sparkSession.sparkContext.broadcast((e.tokens, e.table))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _worker(shared, path)
        for batch in batches:
            for piece in tx.slices(batch):
                arr = piece.column("text")
                ids, offs = enc.encode(arr)
                same: pa.Array = pa.nulls(len(arr), pa.bool_())
                if check:
                    data, at = tx.buffers(arr)
                    back, to = enc.decode(ids, offs)
                    if len(back) == len(data) and (to == at).all() and (back == data).all():
                        same = pa.array(np.ones(len(arr), bool))
                    else:
                        same = pa.array([data[a:b].tobytes() == back[c:d].tobytes() for a, b, c, d in zip(at, at[1:], to, to[1:])], pa.bool_())
                null = np.asarray(arr.is_null())
                bounds = pa.array(offs.astype(np.int32), mask=np.append(null, False)) if null.any() else pa.array(offs.astype(np.int32))
                yield pa.record_batch({"doc_id": piece.column("doc_id"), "ids": pa.ListArray.from_arrays(bounds, pa.array(ids)), "n_tokens": pa.array(np.diff(offs).astype(np.int32)), "round_trip": same})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>, n_tokens int, round_trip boolean")


def decode_documents(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    e = encoder(path)
    shared = encoded.sparkSession.sparkContext.broadcast((e.tokens, e.table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _worker(shared, path)
        for batch in batches:
            out = []
            for ids in batch.column("ids").to_pylist():
                known = None if ids is None else np.array([-1 if i is None else i for i in ids], np.int64)
                out.append(None if known is None else enc.decode(known, np.array([0, len(known)]))[0].tobytes().decode("utf-8", "replace"))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(out, pa.string())})

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, text string")

"""Training-order materialisation of token ids.

The documents' ids, each document's followed by the end-of-text id, form one
stream in the order of a hash of (doc_id, text), a second hash breaking ties: an
order of the data alone, whatever files, cores or partitions there are, so that a
run resumed elsewhere reads the same sequences. The hash's range is cut evenly,
so that the buckets need no sampling and no key is a hot one. The stream is cut
into sequences of ``seq_len`` ids, the last filled up with the end-of-text id. A keyed Feistel
permutation with cycle-walking gives each sequence its slot in the training
order: no sort by random numbers, and the slot of any sequence, or the sequence
of any slot, is computed without a table. Slots are range-partitioned into
shards of ``per_shard`` sequences of a fixed stride, little-endian, so that a
reader seeks to slot s at byte (s % per_shard) * stride of shard s // per_shard
and resumes anywhere.

A null text is left out; an empty one is an end-of-text id alone; long texts go
over as many sequences as they need. Repeated rows are each a document. An
empty table makes no shard. Other columns are ignored. Rows with a null doc_id
count, null being an id like others.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tritsift.llm import bpe, packed, store
from tritsift.llm import text as tx

_U = np.uint64
#: The pattern of the rank files' pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of more characters are encoded by this package's own encoder, which gives the same ids.
LONG_TEXT = 1 << 20


@dataclass(frozen=True)
class MaterializeParams:
    seq_len: int = 2048
    per_shard: int = 1024
    key: int = 0x5EED0F7123456789
    rounds: int = 6
    vocabulary: str = bpe.VOCABULARY


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _round_keys(key: int, rounds: int) -> list[np.uint64]:
    return [_U(k) for k in tx.mix(np.arange(1, rounds + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) ^ _U(key & (1 << 64) - 1)).tolist()]


def feistel(x: np.ndarray, n: int, key: int, rounds: int, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of 0 to n - 1: a balanced Feistel network over the least even number of bits that holds n, walked on while it leaves the range."""
    half = _half_bits(n)
    mask = _U((1 << half) - 1)
    keys = _round_keys(key, rounds)
    out = np.asarray(x).astype(_U)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> _U(half), out[todo] & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (tx.mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (tx.mix(right ^ k) & mask)
        out[todo] = left << _U(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


_encodings: dict[str, object] = {}


def _encoding(path: str, tokens: list[bytes]):
    if path not in _encodings:
        import tiktoken

        _encodings[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    return _encodings[path]


#: Ids that a task holds before it sends them, and those of a row of the stream.
_HELD, _ROW = 16 << 20, 1 << 19


def _tokens(shared, p: MaterializeParams, width: str, buckets: int):
    """The ids of each bucket's documents, with their hashes and numbers of ids."""

    def pack(held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        h, h2 = (np.array([x[i] for x in held], np.int64).view(_U) for i in (0, 1))
        b = packed.bucket_of(h, buckets)
        cols: list[list] = [[], [], [], [], []]
        for k in np.unique(b).tolist():
            mine = np.flatnonzero(b == k)
            ids = [held[i][2] for i in mine.tolist()]
            for col, x in zip(cols, (k, packed.squeeze(h[mine]), packed.squeeze(h2[mine]), packed.squeeze(np.array([len(x) for x in ids], "<u4")), packed.squeeze(np.concatenate(ids)))):
                col.append(x)
        return pa.record_batch([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "h", "h2", "n", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value[0]
        enc, eos = _encoding(p.vocabulary, tokens), len(tokens)
        held, size = [], 0
        for batch in batches:
            for piece in tx.slices(batch):
                for text, h, h2 in zip(piece.column("text").to_pylist(), piece.column("h").to_pylist(), piece.column("h2").to_pylist()):
                    if text is not None:
                        ids = enc.encode_ordinary(text) if len(text) <= LONG_TEXT else bpe._worker(shared, p.vocabulary).encode(pa.array([text]))[0]
                        held.append((h, h2, np.append(np.asarray(ids, width), np.array([eos], width))))
                        size += len(held[-1][2])
                if size > _HELD:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    return run


def _ordered(width: str):
    """A bucket's ids in the order of the hashes, and where they stand among those of the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, hs, h2s, docs = 0, [], [], []
        for batch in batches:
            for k, h, h2, n, ids in zip(*(batch.column(c) for c in ("bucket", "h", "h2", "n", "ids"))):
                part = k.as_py()
                hs.append(packed.expand(h.as_buffer(), np.dtype("<u8")))
                h2s.append(packed.expand(h2.as_buffer(), np.dtype("<u8")))
                docs += np.split(packed.expand(ids.as_buffer(), np.dtype(width)), np.cumsum(packed.expand(n.as_buffer(), np.dtype("<u4")).astype(np.int64))[:-1])
        if not docs:
            return
        order, at, row, size = np.lexsort((np.concatenate(h2s), np.concatenate(hs))), 0, [], 0
        for i in order.tolist():
            row.append(docs[i])
            size += len(docs[i])
            if size > _ROW:
                yield pa.record_batch({"part": pa.array([part], pa.int32()), "at": pa.array([at], pa.int64()), "ids": pa.array([np.concatenate(row).tobytes()], pa.binary())})
                row, at, size = [], at + size, 0
        if row:
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "at": pa.array([at], pa.int64()), "ids": pa.array([np.concatenate(row).tobytes()], pa.binary())})

    return run


def _pieces(base: dict[int, int], total: int, buckets: int, p: MaterializeParams, width: str):
    size, step = p.seq_len, np.dtype(width).itemsize
    n = -(-total // size)
    shards = -(-n // p.per_shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, at, blob in zip(batch.column("part").to_pylist(), batch.column("at").to_pylist(), batch.column("ids").to_pylist()):
                lo = base[part] + at
                hi = lo + len(blob) // step
                seq = np.arange(lo // size, (hi - 1) // size + 1)
                slot = feistel(seq, n, p.key, p.rounds)
                begin, end = np.maximum(seq * size, lo), np.minimum((seq + 1) * size, hi)
                data = [blob[(a - lo) * step : (b - lo) * step] for a, b in zip(begin.tolist(), end.tolist())]
                shard = slot // p.per_shard
                yield pa.record_batch({"bucket": pa.array((shard * buckets // shards).astype(np.int32)), "shard": pa.array(shard.astype(np.int32)), "slot": pa.array(slot), "pos": pa.array((begin - seq * size).astype(np.int32)), "ids": pa.array(data, pa.binary())})

    return run


_SHARD = "shard int, first_slot bigint, n_sequences int, stride_bytes int, payload binary"


def _assemble(p: MaterializeParams, width: str, eos: int):
    stride = p.seq_len * np.dtype(width).itemsize
    fill = np.full(p.seq_len, eos, width).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, slots, buf = None, 0, bytearray()
        last = -1

        def close() -> pa.RecordBatch:
            buf.extend(fill[: slots * stride - len(buf)])
            return pa.record_batch([pa.array([now], pa.int32()), pa.array([now * p.per_shard], pa.int64()), pa.array([slots], pa.int32()), pa.array([stride], pa.int32()), pa.array([bytes(buf)], pa.binary())], names=["shard", "first_slot", "n_sequences", "stride_bytes", "payload"])

        for batch in batches:
            for shard, slot, ids in zip(batch.column("shard").to_pylist(), batch.column("slot").to_pylist(), batch.column("ids")):
                if shard != now:
                    if now is not None:
                        yield close()
                    now, slots, last = shard, 0, -1
                    buf.clear()
                if slot != last:
                    buf.extend(fill[: slots * stride - len(buf)])  # only the stream's last sequence is short
                    slots, last = slots + 1, slot
                buf.extend(ids.as_buffer())
        if now is not None:
            yield close()

    return run


def shards(docs: DataFrame, params: MaterializeParams = MaterializeParams()) -> DataFrame:
    """(shard, first_slot, n_sequences, stride_bytes, payload): the shards' bytes, sequences in the order of their slots."""
    p, spark = params, docs.sparkSession
    e = bpe.encoder(p.vocabulary)
    width = "<u2" if len(e.tokens) < 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast((e.tokens, e.table))  # as large as the vocabulary
    buckets = store.partitions(spark)
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = named.select("text", F.xxhash64("doc_id", "text").alias("h"), F.xxhash64("text", "doc_id").alias("h2"))
    sent = hashed.mapInArrow(_tokens(shared, p, width, buckets), "bucket int, h binary, h2 binary, n binary, ids binary")
    stream = store.cut(store.by_bucket(sent).mapInArrow(_ordered(width), "part int, at bigint, ids binary"))
    step = np.dtype(width).itemsize
    sums = sorted((r.part, r.n) for r in stream.groupBy("part").agg(F.sum(F.octet_length("ids") / step).cast("bigint").alias("n")).collect())  # two numbers a partition
    base, total = {}, 0
    for part, n in sums:
        base[part] = total
        total += n
    if not total:
        return spark.createDataFrame([], _SHARD)
    moved = stream.mapInArrow(_pieces(base, total, buckets, p, width), "bucket int, shard int, slot bigint, pos int, ids binary")
    return store.by_bucket(moved).sortWithinPartitions("shard", "slot", "pos").select("shard", "slot", "ids").mapInArrow(_assemble(p, width, len(e.tokens)), _SHARD)


def write_shards(made: DataFrame, folder: str) -> DataFrame:
    """(shard, path, first_slot, n_sequences): the shards as files of a folder that all executors mount. A file appears whole or not at all, and a repeated task writes the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            paths = []
            for shard, payload in zip(batch.column("shard").to_pylist(), batch.column("payload")):
                paths.append(f"{folder}/shard-{shard:06d}.bin")
                part = f"{paths[-1]}.{TaskContext.get().taskAttemptId()}"
                with open(part, "wb") as f:
                    f.write(payload.as_buffer())
                os.replace(part, paths[-1])
            yield pa.record_batch({"shard": batch.column("shard"), "path": pa.array(paths, pa.string()), "first_slot": batch.column("first_slot"), "n_sequences": batch.column("n_sequences")})

    return made.mapInArrow(run, "shard int, path string, first_slot bigint, n_sequences int")


def read_slots(folder: str, first: int, count: int, params: MaterializeParams = MaterializeParams(), width: str = "<u2") -> np.ndarray:
    """Ids of ``count`` sequences from slot ``first`` on, read in order from the files."""
    p, out = params, []
    stride = p.seq_len * np.dtype(width).itemsize
    while count > 0:
        shard, inside = divmod(first, p.per_shard)
        n = min(count, p.per_shard - inside)
        with open(f"{folder}/shard-{shard:06d}.bin", "rb") as f:
            f.seek(inside * stride)
            out.append(np.frombuffer(f.read(n * stride), width))
        if len(out[-1]) < n * p.seq_len:
            break
        first, count = first + n, count - n
    return np.concatenate(out).reshape(-1, p.seq_len) if out else np.zeros((0, p.seq_len), width)

"""Shuffles of fixed-width records as packed columns.

A map task gathers its records in numpy arrays and sends each bucket one row of
binary columns, so that a shuffle of many small records costs the JVM a few
large rows. Buckets follow the high bits of a 64-bit key; there are as many as
the session has shuffle partitions, so a bucket's size doesn't grow with the
input when that setting follows it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tritsift.llm import store
from tritsift.llm import text as tx

#: Bytes of records that a map task holds before it sends them.
FLUSH_BYTES = 48 << 20

Arrays = dict[str, np.ndarray]


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)


def squeeze(v: np.ndarray) -> bytes:
    """Values as bytes: their number, then the first bytes of all, the second ones and so on, compressed. Of ids and positions only the low bytes take room."""
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(len(v), v.dtype.itemsize).T) if v.dtype.itemsize > 1 else v
    return len(v).to_bytes(4, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def expand(blob: pa.Buffer | bytes, dtype: np.dtype) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    planes = np.frombuffer(pa.decompress(blob[4:], n * dtype.itemsize, "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).view(dtype).reshape(n)


@dataclass(frozen=True)
class Step:
    """Records that ``make`` draws from the batches, moved by their "key", and what ``reduce`` returns for each partition.

    make's arrays have one entry a record: "key" (uint64) and the fields, each of
    the numpy type that ``fields`` names; a field named "key" is sent as well.
    """

    make: Callable[[pa.RecordBatch], Arrays]
    fields: dict[str, str]
    reduce: Callable[[Arrays], Iterator[pa.RecordBatch]]
    text_column: str | None = "text"

    def schema(self) -> str:
        return "bucket int, " + ", ".join(f"{n} binary" for n in self.fields)

    def scatter(self, batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
        held: list[Arrays] = []
        size = 0
        for batch in batches:
            for piece in tx.slices(batch, self.text_column) if self.text_column else [batch]:
                got = self.make(piece)
                if len(got["key"]):
                    held.append(got)
                    size += sum(a.nbytes for a in got.values())
                if size > FLUSH_BYTES:
                    yield self._pack(held, buckets)
                    held, size = [], 0
        if held:
            yield self._pack(held, buckets)
        held.clear()
        tx.tidy()

    def _pack(self, held: list[Arrays], buckets: int) -> pa.RecordBatch:
        key = np.concatenate([a["key"] for a in held])
        b = bucket_of(key, buckets)
        order = np.argsort(b, kind="stable")
        present, at = np.unique(b[order], return_index=True)
        ends = [*at[1:].tolist(), len(order)]
        cols: list[pa.Array] = [pa.array(present.astype(np.int32))]
        for name, kind in self.fields.items():
            v = np.concatenate([a[name] for a in held])[order].astype(kind)
            cols.append(pa.array([squeeze(v[i:j]) for i, j in zip(at.tolist(), ends)], pa.binary()))
        return pa.record_batch(cols, names=["bucket", *self.fields])

    def gather(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(self.fields)
        parts: dict[str, list[np.ndarray]] = {n: [] for n in names}
        for batch in batches:
            for name in names:
                for blob in batch.column(batch.schema.get_field_index(name)):
                    parts[name].append(expand(blob.as_buffer(), np.dtype(self.fields[name])))
        if parts[names[0]]:
            yield from self.reduce({n: np.concatenate(parts.pop(n)) for n in names})
        tx.tidy()


def exchanges(df: DataFrame, steps: list[Step], schema: str) -> DataFrame:
    """The steps one after another; what a step returns goes to the next one within the task, without passing through the JVM as rows."""
    buckets = store.partitions(df.sparkSession)
    first, *rest = steps
    moved = store.by_bucket(df.mapInArrow(lambda batches: first.scatter(batches, buckets), first.schema()))
    for last, step in zip(steps, rest):
        moved = store.by_bucket(moved.mapInArrow(lambda batches, last=last, step=step: step.scatter(last.gather(batches), buckets), step.schema()))
    return moved.mapInArrow(steps[-1].gather, schema)


def exchange(df: DataFrame, make: Callable[[pa.RecordBatch], Arrays], fields: dict[str, str], reduce: Callable[[Arrays], Iterator[pa.RecordBatch]], schema: str, text_column: str | None = "text") -> DataFrame:
    """One step."""
    return exchanges(df, [Step(make, fields, reduce, text_column)], schema)


def keep_rows(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of docs for which ``keep``, given their texts, is true, with all their columns, whatever their names."""
    at = docs.columns.index("text")
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # mapInArrow doesn't take names with dots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tx.slices(batch, f"c{at}"):
                yield piece.filter(pa.array(keep(piece.column(at))))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def runs(sorted_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and its length."""
    if not len(sorted_key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
    return start, np.diff(np.concatenate([start, [len(sorted_key)]]))

"""Quality classifier: logistic regression over hashed word n-grams.

Trained by follow-the-regularised-leader (FTRL-proximal, one pass a row and
epoch) on a bounded sample of labelled documents, ``max_train_rows``; every
document is scored, as a sparse dot product. Features are the counts of word
1- to ``max_n``-grams, case kept and punctuation runs as words, and of words
that repeat the last or the one before, divided by the root of their number.

Null or empty text has no features and the model's bias as its score. Labels
that are null, or whose document is missing or has a null id, aren't used; of
several labels of one document the smallest counts. With no usable label of
both classes the probability is 0.5 and every document is kept. Extra columns,
whatever their names, pass through ``quality_filter`` and are left by
``quality_scores``. Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tritsift.llm import packed, store
from tritsift.llm import text as tx


@dataclass(frozen=True)
class QualityParams:
    bits: int = 20
    max_n: int = 2
    #: Labelled documents that the model is fitted on, the first in the order of a hash of their ids.
    max_train_rows: int = 12_000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    #: Documents below this probability are rejected.
    threshold: float = 0.5


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    params: QualityParams


def features(arr: pa.Array, p: QualityParams) -> tuple[np.ndarray, np.ndarray]:
    """Feature number of each n-gram, by row, and the rows' numbers of n-grams: rows are contiguous."""
    h, _, _, row = tx.words(arr, lower=False, punct=True)
    shift = np.uint64(64 - p.bits)
    parts, rows = [], []
    for n in range(1, p.max_n + 1):
        g, at = tx.ngrams(h, row, n)
        parts.append((tx.mix(g + np.uint64(n)) >> shift).astype(np.int32))
        rows.append(np.repeat(np.arange(len(at) - 1), np.diff(at)))
    word_row = np.repeat(np.arange(len(row) - 1), np.diff(row))
    for back in (1, 2):  # n-grams that are a word and itself, one or two words on, are one feature whatever the word
        again = word_row[back:][(h[back:] == h[:-back]) & (word_row[back:] == word_row[:-back])]
        parts.append(np.full(len(again), int(tx.mix(np.array([back], np.uint64))[0] >> shift), np.int32))
        rows.append(again)
    idx, owner = np.concatenate(parts), np.concatenate(rows)
    return idx, owner


def _scores(arr: pa.Array, weights: np.ndarray, bias: float, p: QualityParams) -> np.ndarray:
    idx, owner = features(arr, p)
    total = np.bincount(owner, weights[idx], len(arr))
    n = np.bincount(owner, minlength=len(arr))
    return 1 / (1 + np.exp(-np.clip(bias + total / np.sqrt(np.maximum(n, 1)), -40, 40)))


def _pack(idx: np.ndarray) -> tuple[bytes, bytes]:
    """A text's distinct feature numbers, as steps, and their counts, compressed."""
    u, c = np.unique(idx, return_counts=True)
    return packed.squeeze(np.diff(u, prepend=0).astype("<i4")), packed.squeeze(c.astype("<u4"))


def _unpack(i: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers, and their counts over the root of the text's number of n-grams."""
    count = packed.expand(c, np.dtype("<u4")).astype(np.int64)
    v = (count / np.sqrt(max(int(count.sum()), 1))).astype(np.float32)
    return np.cumsum(packed.expand(i, np.dtype("<i4"))), v.astype(float)


def _featurize(p: QualityParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tx.slices(batch):
                idx, owner = features(piece.column("text"), p)
                order = np.argsort(owner, kind="stable")
                ends = np.searchsorted(owner[order], np.arange(piece.num_rows + 1))
                out = [_pack(idx[order[a:b]]) for a, b in zip(ends, ends[1:])]
                yield pa.record_batch({"doc_id": piece.column("doc_id"), "y": piece.column("y"), "i": pa.array([i for i, _ in out], pa.binary()), "c": pa.array([c for _, c in out], pa.binary())})

    return run


def ftrl(rows: list[tuple[int, bytes, bytes]], p: QualityParams) -> tuple[np.ndarray, float]:
    """Weights and bias from (label, packed features), rows taken in the given order and unpacked one at a time."""
    z, n, w = np.zeros(1 << p.bits), np.zeros(1 << p.bits), np.zeros(1 << p.bits)
    zb = nb = wb = 0.0
    for _ in range(p.epochs):
        for y, packed_i, packed_c in rows:
            i, v = _unpack(packed_i, packed_c)
            zi, ni = z[i], n[i]
            root = np.sqrt(ni)
            wi = np.where(np.abs(zi) <= p.l1, 0.0, (np.sign(zi) * p.l1 - zi) / ((p.beta + root) / p.alpha + p.l2))
            wb = -zb / ((p.beta + np.sqrt(nb)) / p.alpha)
            g = 1 / (1 + np.exp(-np.clip(wb + wi @ v, -40, 40))) - y
            gi = g * v
            z[i] = zi + gi - (np.sqrt(ni + gi * gi) - root) / p.alpha * wi
            n[i] = ni + gi * gi
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / p.alpha * wb
            nb += g * g
    used = np.abs(z) > p.l1
    w[used] = (np.sign(z[used]) * p.l1 - z[used]) / ((p.beta + np.sqrt(n[used])) / p.alpha + p.l2)
    return w.astype(np.float32), float(-zb / ((p.beta + np.sqrt(nb)) / p.alpha))


def train(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams(), label: str = "quality") -> QualityModel:
    """Fit on at most ``max_train_rows`` labelled documents; the driver holds only their hashed features, packed, and gives that memory back."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
    known = store.first_by_hash(known, ["doc_id", "y"], params.max_train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most max_train_rows rows
    made = rows.select("doc_id", "y", "text").mapInArrow(_featurize(params), "doc_id bigint, y int, i binary, c binary").toArrow()
    got = sorted(zip(*(made[name].to_pylist() for name in ("doc_id", "y", "i", "c"))), key=lambda r: (hash_order(r[0]), r[2], r[3]))
    del made
    model = QualityModel(np.zeros(1 << params.bits, np.float32), 0.0, params)
    if len({r[1] > 0 for r in got}) == 2:
        model = QualityModel(*ftrl([(int(y > 0), i, c) for _, y, i, c in got], params), params)
    del got
    tx.tidy()
    return model


def hash_order(doc_id: int) -> int:
    return (doc_id * 0x9E3779B97F4A7C15 ^ doc_id >> 7) & ((1 << 64) - 1)


def quality_scores(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, probability, keep) of every document."""
    p, bias = model.params, model.bias
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)  # 4 * 2**bits bytes, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tx.slices(batch):
                s = _scores(piece.column("text"), shared.value, bias, p)
                yield pa.record_batch({"doc_id": piece.column("doc_id"), "probability": pa.array(s), "keep": pa.array(s >= p.threshold)})

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, probability double, keep boolean")


def quality_filter(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The documents that the model keeps, with all their columns."""
    p, bias = model.params, model.bias
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)

    return packed.keep_rows(docs, lambda texts: _scores(texts, shared.value, bias, p) >= p.threshold)

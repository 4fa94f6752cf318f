"""Benchmark decontamination: every passage of the corpus queries a BM25 index of the test items.

Items are indexed in pieces of at most ``piece`` words. Training texts are read
as overlapping passages of 2 * piece words, a piece apart, so that each run of
piece words lies whole in one. A passage's distinct words are the query. A
piece's score is its BM25 score divided by that of the piece's own words; pieces
of a score of ``threshold`` or more are all retrieved, by block-max WAND over
posting lists, many passages at once. A passage whose words' largest weights
don't reach the threshold together is passed over. Of the others the words are
taken in the order of their largest weights up to the pivot, at which the
weights so far reach the threshold: a piece has to hold a word from the pivot
on, so only the blocks in those words' lists are looked at. A block whose own
largest weights, of all the passage's words, don't reach the threshold is
skipped, and the pieces of the others are scored. Each bound is an upper bound,
so nothing above the threshold is lost.

A retrieved item is held against the passage and its surroundings: of the
distinct word ``n``-grams of its question and of its answer the shares
``question_overlap`` and ``answer_overlap`` must stand there. An item's answer is
its last sentence where it has several, else its last third; an answer shorter
than n words is extended to n.

The index holds at most ``shard_bytes`` of item text at a time; it is built once,
broadcast, and kept by each worker. More items are taken in several passes over the documents, with the
document frequencies and the mean length of all items. Null or
empty documents hold nothing; null or empty items are never found; items with a
null item_id are left out. Rows that repeat an item or a document count once in
the result. Other columns are ignored and pass through ``decontaminate``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tritsift.llm import packed, store
from tritsift.llm import text as tx

_U = np.uint64


@dataclass(frozen=True)
class DecontaminationParams:
    piece: int = 64
    k1: float = 1.2
    b: float = 0.75
    threshold: float = 0.5
    #: Pieces of a block.
    block: int = 8
    n: int = 3
    question_overlap: float = 0.5
    answer_overlap: float = 0.5
    shard_bytes: int = 16 << 20


@dataclass
class Item:
    item_id: int
    words: np.ndarray
    question: np.ndarray
    answer: np.ndarray


@dataclass
class Index:
    """Posting lists. A weight is a term's BM25 weight in a piece, over the piece's own score times the threshold."""

    #: Sorted word hashes, the largest weight of each, and where each one's blocks begin (one more at the end).
    terms: np.ndarray
    top: np.ndarray
    at: np.ndarray
    #: Blocks with a term, in order, the largest weight there, and where the postings begin (one more at the end).
    block: np.ndarray
    block_max: np.ndarray
    begin: np.ndarray
    piece: np.ndarray
    weight: np.ndarray
    #: Position in the list of items, for each piece; blocks are of consecutive pieces.
    item: np.ndarray
    blocks: int


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    return np.unique(tx.ngrams(h, np.array([0, len(h)]), n)[0]) if len(h) else np.zeros(0, _U)


def split_item(item_id: int, text: str, n: int) -> Item:
    h = tx.words(pa.array([text]))[0]
    sentences = [s for s in (tx.plain_words(s) for s in re.split(r"[.!?]+\s", text)) if s]
    tail = len(sentences[-1]) if len(sentences) > 1 else len(h) // 3
    tail = min(len(h), max(tail, n))
    return Item(item_id, h, _grams(h[: len(h) - tail] if len(h) - tail >= n else h, n), _grams(h[len(h) - tail :], n))


@dataclass
class Stats:
    """Number and mean length of all pieces, and in how many each of some words, in order, stands."""

    pieces: int
    mean: float
    terms: np.ndarray
    df: np.ndarray


def cut_items(items: list[Item], p: DecontaminationParams) -> list[tuple[int, np.ndarray]]:
    return [(i, it.words[s : s + p.piece]) for i, it in enumerate(items) for s in range(0, len(it.words), p.piece)]


def count_items(items: list[Item], p: DecontaminationParams) -> Stats:
    pieces = [w for _, w in cut_items(items, p)]
    terms, df = np.unique(np.concatenate([np.unique(w) for w in pieces] or [np.zeros(0, _U)]), return_counts=True)
    return Stats(len(pieces), sum(map(len, pieces)) / max(len(pieces), 1), terms, df)


def build_index(items: list[Item], p: DecontaminationParams, stats: Stats | None = None) -> Index | None:
    """The index of the items, with the statistics of all items; without them, of these. None if they have no words."""
    pieces = cut_items(items, p)
    if not pieces:
        return None
    stats = stats or count_items(items, p)
    pieces.sort(key=lambda x: len(x[1]))  # alike lengths have alike weights, which makes the blocks' bounds tight
    n = len(pieces)
    size = np.array([len(w) for _, w in pieces])
    terms, t = np.unique(np.concatenate([w for _, w in pieces]), return_inverse=True)
    pair, tf = np.unique(t * n + np.repeat(np.arange(n), size), return_counts=True)
    t, piece = pair // n, pair % n
    df = stats.df[np.searchsorted(stats.terms, terms)]
    idf = np.log(1 + (stats.pieces - df + 0.5) / (df + 0.5))
    x = idf[t] * tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * size[piece] / stats.mean))
    weight = x / (p.threshold * np.bincount(piece, x, n))[piece]
    blocks = -(-n // p.block)
    cell = t * blocks + piece // p.block
    begin, _ = packed.runs(cell)
    most = np.maximum.reduceat(weight, begin)
    at = np.searchsorted(t[begin], np.arange(len(terms) + 1))
    return Index(terms, np.maximum.reduceat(most, at[:-1]), at, cell[begin] % blocks, most, np.append(begin, len(cell)), piece, weight, np.array([i for i, _ in pieces]), blocks)


#: Postings that are looked at together.
_STEP = 1_000_000


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [first, first + count): the range and the position of each element."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]


def _totals(key: np.ndarray, weight: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys below ``size`` that stand, in order, and the sum of each one's weights, which are positive."""
    if size <= 4 * len(key):
        total = np.bincount(key, weight, size)
        keys = np.flatnonzero(total)
        return keys, total[keys]
    keys, back = np.unique(key, return_inverse=True)
    return keys, np.bincount(back, weight, len(keys))


def search(index: Index, window: np.ndarray, word: np.ndarray, p: DecontaminationParams) -> tuple[np.ndarray, np.ndarray]:
    """Windows and items of all pieces that score at least the threshold; (window, word) are the passages' words."""
    slack = 1 - 1e-9
    t, known = _terms(index, word)
    pair = np.sort(window[known] * len(index.terms) + t[known])
    pair = pair[packed.runs(pair)[0]]
    w, t = pair // len(index.terms), pair % len(index.terms)
    start, length = packed.runs(w)
    if not len(start):
        return w, t
    keep = np.repeat(np.add.reduceat(index.top[t], start) >= slack, length)
    w, t = w[keep], t[keep]
    order = np.lexsort((index.top[t], w))
    w, t = w[order], t[order]
    start, length = packed.runs(w)
    nth = np.repeat(np.arange(len(start)), length)
    run = np.cumsum(index.top[t])
    run -= (run[start] - index.top[t[start]])[nth] if len(start) else 0
    late = run >= slack  # from the pivot on
    before = np.bincount(nth[~late], index.top[t[~late]], len(start))  # what the words before it can add
    load = np.cumsum(np.bincount(nth[late], (index.at[t + 1] - index.at[t])[late], len(start)))
    found_w, found_i = [], []
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(load, (load[lo - 1] if lo else 0) + _STEP, "right")))
        a, b = start[lo], start[hi - 1] + length[hi - 1]
        own, tt, here = nth[a:b] - lo, t[a:b], late[a:b]
        e = np.flatnonzero(here)
        who, post = _spread(index.at[tt[e]], index.at[tt[e] + 1] - index.at[tt[e]])
        cell = own[e][who] * index.blocks + index.block[post]
        cells, bound = _totals(cell, index.block_max[post], (hi - lo) * index.blocks)
        bound = bound + before[lo:hi][cells // index.blocks]
        cells = cells[bound >= slack]
        # The remaining cells' lists, of all words of the window.
        win, blk = cells // index.blocks, cells % index.blocks
        c, k = _spread(start[lo:hi][win] - a, length[lo:hi][win])
        flat = tt[k] * index.blocks + blk[c]
        spot, there = _postings(index, flat)
        c, spot = c[there], spot[there]
        good = np.bincount(c, index.block_max[spot], len(cells)) >= slack
        c, spot = c[good[c]], spot[good[c]]
        o, q = _spread(index.begin[spot], index.begin[spot + 1] - index.begin[spot])
        at = win[c][o] * len(index.item) + index.piece[q]
        hits, total = _totals(at, index.weight[q], (hi - lo) * len(index.item))
        hits = hits[total >= slack]
        found_w.append(w[start[lo:hi]][hits // len(index.item)])
        found_i.append(index.item[hits % len(index.item)])
        lo = hi
    return (np.concatenate(found_w), np.concatenate(found_i)) if found_w else (w[:0], t[:0])


def _cells(index: Index) -> np.ndarray:
    """term * blocks + block of each block posting, in order."""
    got = index.__dict__.get("cells")
    if got is None:
        got = index.__dict__["cells"] = np.repeat(np.arange(len(index.terms)), np.diff(index.at)) * index.blocks + index.block
    return got


#: High bits of a hash by which terms are looked up, and cells up to which a table of all of them is kept.
_HIGH, _DENSE = 18, 1 << 21


def _terms(index: Index, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each word among the terms, and whether it is there: a table of the high bits tells where to begin."""
    first = index.__dict__.get("first")
    if first is None:
        first = index.__dict__["first"] = np.append(np.searchsorted(index.terms, np.arange(1 << _HIGH, dtype=_U) << _U(64 - _HIGH)), len(index.terms))
    high = (word >> _U(64 - _HIGH)).astype(np.int64)
    t, end, last = first[high], first[high + 1], len(index.terms) - 1
    todo = np.flatnonzero(t < end)
    while len(todo):
        todo = todo[index.terms[np.minimum(t[todo], last)] < word[todo]]
        t[todo] += 1
        todo = todo[t[todo] < end[todo]]
    return t, (t < end) & (index.terms[np.minimum(t, last)] == word)


def _postings(index: Index, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each term * blocks + block among the block postings, and whether it is there."""
    cells, every = _cells(index), len(index.terms) * index.blocks
    if every <= _DENSE:
        table = index.__dict__.get("table")
        if table is None:
            table = index.__dict__["table"] = np.full(every, -1, np.int32)
            table[cells] = np.arange(len(cells))
        spot = table[flat]
        return spot, spot >= 0
    spot = np.minimum(np.searchsorted(cells, flat), len(cells) - 1)
    return spot, cells[spot] == flat


def leaks(arr: pa.Array, items: list[Item], index: Index | None, p: DecontaminationParams) -> list[tuple[int, int, float, float]]:
    """(row, item's position, question overlap, answer overlap) of the items that a column's texts hold."""
    h, _, _, row = tx.words(arr)
    count = np.diff(row)
    owner = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(h)) - row[owner]
    per_row = -(-np.maximum(count, 1) // p.piece)  # windows of each row
    base = np.cumsum(per_row) - per_row
    part = at // p.piece
    window = np.concatenate([base[owner] + part, (base[owner] + part - 1)[part > 0]])
    word = np.concatenate([h, h[part > 0]])
    best: dict[tuple[int, int], tuple[float, float]] = {}
    got = set(zip(*(v.tolist() for v in search(index, window, word, p)))) if index else ()
    for w, i in got:
        r = int(np.searchsorted(base, w, "right")) - 1
        it = items[i]
        reach = len(it.words)
        lo = row[r] + max(0, (w - int(base[r])) * p.piece - reach)
        near = _grams(h[lo : min(row[r + 1], row[r] + (w - int(base[r]) + 2) * p.piece + reach)], p.n)
        q, a = (float(np.isin(x, near).mean()) if len(x) else 0.0 for x in (it.question, it.answer))
        if q >= p.question_overlap and a >= p.answer_overlap:
            best[r, i] = max(best.get((r, i), (0.0, 0.0)), (q, a))
    return [(r, i, q, a) for (r, i), (q, a) in sorted(best.items())]


def _counts(p: DecontaminationParams):
    """(term, pieces with it) of a task's items, and under a null term its pieces and their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = count_items([split_item(0, t, p.n) for t in batch.column("text").to_pylist()], p)
            term, n = [*c.terms.view(np.int64).tolist(), None], [*c.df.tolist(), c.pieces]
            yield pa.record_batch({"term": pa.array(term, pa.int64()), "n": pa.array(n, pa.int64()), "words": pa.array([0] * len(c.df) + [round(c.mean * c.pieces)], pa.int64())})

    return run


def _shards(benchmark: DataFrame, p: DecontaminationParams) -> Iterator[tuple[list[tuple[int, str]], Stats | None]]:
    """The items, at most about shard_bytes of them at a time, and where there are more the statistics of all."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text <> ''").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // p.shard_bytes)
    if n > 1:
        counted = store.cut(rows.select("text").mapInArrow(_counts(p), "term bigint, n bigint, words bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words")))
        every = counted.where("term is null").first()
    for i in range(n):
        shard = sorted((r.item_id, r.text) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect())
        stats = None
        if n > 1:
            terms = count_items([split_item(k, t, p.n) for k, t in shard], p).terms
            mine = rows.sparkSession.createDataFrame([(t,) for t in terms.view(np.int64).tolist()], "term bigint")
            df = {r.term: r.n for r in counted.join(mine, "term", "left_semi").collect()}
            stats = Stats(every.n, every.words / max(every.n, 1), terms, np.array([df[t] for t in terms.view(np.int64).tolist()], np.int64))
        yield shard, stats


def _finder(docs: DataFrame, shard: list[tuple[int, str]], stats: Stats | None, p: DecontaminationParams) -> Callable[[pa.Array], list[tuple[int, int, float, float]]]:
    items = [split_item(i, t, p.n) for i, t in shard]
    shared = docs.sparkSession.sparkContext.broadcast((items, build_index(items, p, stats)))  # in proportion to shard_bytes

    def find(arr: pa.Array) -> list[tuple[int, int, float, float]]:
        items, index = shared.value
        return [(r, items[i].item_id, q, a) for r, i, q, a in leaks(arr, items, index, p)]

    return find


def contaminated(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """(doc_id, item_id, question_overlap, answer_overlap): the items that each document holds."""
    schema = "doc_id bigint, item_id bigint, question_overlap double, answer_overlap double"
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.sparkSession.createDataFrame([], schema)
    for shard, stats in _shards(benchmark, params):
        find = _finder(docs, shard, stats, params)

        def run(batches: Iterator[pa.RecordBatch], find=find) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in tx.slices(batch):
                    r, i, q, a = list(zip(*find(piece.column("text")))) or ((), (), (), ())
                    yield pa.record_batch({"doc_id": piece.column("doc_id").take(pa.array(r, pa.int64())), "item_id": pa.array(i, pa.int64()), "question_overlap": pa.array(q, pa.float64()), "answer_overlap": pa.array(a, pa.float64())})

        found = found.union(narrow.mapInArrow(run, schema))
    return found.groupBy("doc_id", "item_id").agg(F.max("question_overlap").alias("question_overlap"), F.max("answer_overlap").alias("answer_overlap"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    for shard, stats in _shards(benchmark, params):
        find = _finder(docs, shard, stats, params)

        def clean(texts: pa.Array, find=find) -> np.ndarray:
            out = np.ones(len(texts), bool)
            out[[f[0] for f in find(texts)]] = False
            return out

        docs = packed.keep_rows(docs, clean)
    return docs

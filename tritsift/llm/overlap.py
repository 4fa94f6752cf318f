"""Exact Jaccard join of n-gram sets by the n-grams that stand in several of them.

Sets that are t alike share at least t * n of the n n-grams of each. So an n-gram
of one set alone plays no part, and a set of which fewer than t * n are in others
has no link and is left out; what it held is counted anew among the rest. Of the
n-grams that a set is left with, in the order of the number of sets that hold
them, it joins on the first left - ceil(t * n) + 1: of those that two alike sets
share the rarest stands there in both (prefix filter). A pair is a candidate
where its sizes allow it and, behind that n-gram, enough are left in both. No
bucket is capped and nothing is sampled, so every pair that is t alike is a
candidate; common n-grams are at the end of the order, where no set joins.

Candidates are verified by the sets that are left, which hold all that is shared.
Sets are told by a 64-bit hash, n-grams by one of 64 bits of which about 54 are
shuffled and then by numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tritsift.llm import graph, packed, store
from tritsift.llm import text as tx

_U = np.uint64
#: Parts of a bucket of all n-grams that are sorted one after another.
_PARTS = 8
#: Pairs of a bucket that are held before those found twice are dropped.
_HELD = 4 << 20
_EPS = 1e-9


def _pack(cols: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch({n: pa.array([packed.squeeze(np.ascontiguousarray(v))], pa.binary()) for n, v in cols.items()})


def _unpack(batch: pa.RecordBatch, types: dict[str, str]) -> packed.Arrays:
    return {n: np.concatenate([np.zeros(0, t), *(packed.expand(b.as_buffer(), np.dtype(t)) for b in batch.column(n))]) for n, t in types.items()}


def _schema(types: dict[str, str]) -> str:
    return ", ".join(f"{n} binary" for n in types)


_GRAM = {"token": "<u8", "cid": "<u8", "n": "<i4"}
_RANKED = _GRAM | {"df": "<i4"}


def _shared(a: packed.Arrays, part: np.ndarray, parts: int) -> Iterator[packed.Arrays]:
    """The records of tokens that more than one set holds, each once, in the order of tokens, and that number as df."""
    for k in range(parts):
        mine = np.flatnonzero(part == k) if parts > 1 else np.arange(len(part))
        token = a["token"][mine]
        order = np.argsort(token)
        _, length = packed.runs(token[order])
        order = mine[order[np.repeat(length > 1, length)]]
        order = order[np.lexsort((a["cid"][order], a["token"][order]))]
        token, cid, n = (a[c][order] for c in ("token", "cid", "n"))
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (cid[1:] != cid[:-1])
        token, cid, n = token[new], cid[new], n[new]
        _, length = packed.runs(token)
        keep = np.repeat(length > 1, length)
        yield {"token": token[keep], "cid": cid[keep], "n": n[keep], "df": np.repeat(length, length)[keep].astype(np.int32)}


def _number(a: packed.Arrays) -> Iterator[pa.RecordBatch]:
    """The shared n-grams of a bucket under numbers: the bucket's in the high half, a running one in the low half."""
    base, low = int(TaskContext.get().partitionId()) << 32, 0
    every = {"token": a["mid"].astype(_U) << _U(32) | a["lo"], "cid": a["cid"], "n": a["n"]}
    for got in _shared(every, a["lo"] % _PARTS, _PARTS):
        if len(got["token"]):
            _, length = packed.runs(got["token"])
            got["token"] = (base + low + np.repeat(np.arange(len(length)), length)).astype(_U)
            low += len(length)
            yield _pack({n: got[n] for n in _GRAM})


def _recount(a: packed.Arrays) -> Iterator[pa.RecordBatch]:
    for got in _shared(a, np.zeros(len(a["token"]), np.int8), 1):
        if len(got["token"]):
            yield _pack(got)


def _enough(a: packed.Arrays, t: float) -> tuple[packed.Arrays, np.ndarray, np.ndarray]:
    """The records in the order of sets and tokens, of those sets of which enough is shared, and where each set begins and its length."""
    order = np.lexsort((a["token"], a["cid"]))
    _, length = packed.runs(a["cid"][order])
    keep = np.repeat(length, length) >= t * a["n"][order] - _EPS
    a = {c: v[order[keep]] for c, v in a.items()}
    return a, *packed.runs(a["cid"])


def _alive(t: float):
    def run(a: packed.Arrays) -> Iterator[pa.RecordBatch]:
        a, start, _ = _enough(a, t)
        if len(start):
            yield _pack({n: a[n] for n in _GRAM})

    return run


_SET = "cid bigint, n int, tokens binary, prefix binary"


def _sets(t: float):
    """Each set that is left: its tokens in their order, and those that it joins on, the rarest first."""

    def run(a: packed.Arrays) -> Iterator[pa.RecordBatch]:
        a, start, length = _enough(a, t)
        if not len(start):
            return
        owner = np.repeat(np.arange(len(start)), length)
        rare = a["token"][np.lexsort((a["token"], a["df"], owner))]
        n = a["n"][start]
        joins = length - np.ceil(t * n - _EPS).astype(np.int64) + 1
        tokens = [packed.squeeze(a["token"][s : s + k]) for s, k in zip(start.tolist(), length.tolist())]
        prefix = [packed.squeeze(rare[s : s + k]) for s, k in zip(start.tolist(), joins.tolist())]
        yield pa.record_batch({"cid": pa.array(a["cid"][start].view(np.int64)), "n": pa.array(n), "tokens": pa.array(tokens, pa.binary()), "prefix": pa.array(prefix, pa.binary())})

    return run


#: A prefix token's record: ``left`` is how many of the set's tokens stand from it on.
_PREFIX = {"token": "<u8", "cid": "<u8", "n": "<i4", "left": "<i4"}
_GROUPED = _PREFIX | {"label": "<i8"}
_FOUND = {"u": "<u8", "v": "<u8"}


def _prefix_records(t: float):
    def make(batch: pa.RecordBatch) -> packed.Arrays:
        each = [packed.expand(b.as_buffer(), np.dtype("<u8")) for b in batch.column("prefix")]
        count = np.array([len(x) for x in each], np.int64)
        row = np.repeat(np.arange(len(each)), count)
        n = batch.column("n").to_numpy()
        total = count - 1 + np.ceil(t * n - _EPS).astype(np.int64)
        token = np.concatenate([np.zeros(0, _U), *each])
        left = total[row] - (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
        out = {"key": tx.mix(token), "token": token, "cid": batch.column("cid").to_numpy().view(_U)[row], "n": n[row], "left": left}
        return out | ({"label": batch.column("label").to_numpy()[row]} if "label" in batch.schema.names else {})

    return make


def _fit(n: np.ndarray, left: np.ndarray, i: np.ndarray, j: np.ndarray, t: float) -> np.ndarray:
    """Whether two sets that meet at a token may be alike, if it is the first that they share."""
    x, y = n[i], n[j]
    return (np.minimum(x, y) >= t * np.maximum(x, y) - _EPS) & (np.minimum(left[i], left[j]) >= t / (1 + t) * (x + y) - _EPS)


def _stars(t: float):
    """Each set of a bucket with the bucket's first one: not all pairs, but linear in the bucket."""

    def run(a: packed.Arrays) -> Iterator[pa.RecordBatch]:
        ids, doc = np.unique(a["cid"], return_inverse=True)
        order = np.lexsort((doc, a["token"]))
        doc, n, left = doc[order], a["n"][order].astype(np.int64), a["left"][order]
        start, length = packed.runs(a["token"][order])
        hub = np.repeat(start, length)
        i = np.flatnonzero(np.arange(len(hub)) > hub)
        i = i[_fit(n, left, i, hub[i], t)]
        if len(i):
            code = np.unique(doc[i] * len(ids) + doc[hub[i]])
            yield _pack({"u": ids[code // len(ids)], "v": ids[code % len(ids)]})

    return run


def _candidates(t: float):
    """All pairs of a bucket that may be alike; of sets with labels those whose labels differ."""

    def run(a: packed.Arrays) -> Iterator[pa.RecordBatch]:
        ids, doc = np.unique(a["cid"], return_inverse=True)
        order = np.lexsort((doc, a["token"]))
        doc, n, left = doc[order], a["n"][order].astype(np.int64), a["left"][order]
        start, length = packed.runs(a["token"][order])
        label = a["label"][order] if "label" in a else None
        if label is not None and len(start):  # buckets of one label have nothing to give
            mixed = np.repeat(np.minimum.reduceat(label, start) < np.maximum.reduceat(label, start), length)
            doc, n, left, label = doc[mixed], n[mixed], left[mixed], label[mixed]
            start, length = packed.runs(a["token"][order][mixed])
        at = np.arange(len(doc)) - np.repeat(start, length)
        held: list[np.ndarray] = []
        size, lag, i = 0, 1, np.flatnonzero(at >= 1)

        def flush() -> pa.RecordBatch:
            code = np.unique(np.concatenate(held))
            return _pack({"u": ids[code // len(ids)], "v": ids[code % len(ids)]})

        while len(i):
            j = i - lag
            ok = _fit(n, left, i, j, t)
            if label is not None:
                ok &= label[i] != label[j]
            if ok.any():
                held.append(np.unique(doc[i[ok]] * len(ids) + doc[j[ok]]))
                size += len(held[-1])
            if size > _HELD:
                held = [np.unique(np.concatenate(held))]
                size = len(held[0])
                if size > _HELD // 2:
                    yield flush()
                    held, size = [], 0
            lag += 1
            i = i[at[i] >= lag]
        if held:
            yield flush()

    return run


def _pair_records(batch: pa.RecordBatch) -> packed.Arrays:
    a = _unpack(batch, _FOUND)
    return {"key": tx.mix(a["u"] + tx.mix(a["v"])), **a}


def _once(a: packed.Arrays) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((a["v"], a["u"]))
    u, v = a["u"][order], a["v"][order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    yield pa.record_batch({"u": pa.array(u[new].view(np.int64)), "v": pa.array(v[new].view(np.int64))})


def _alike(t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = np.zeros(batch.num_rows, np.int64)
            last, x = None, None
            for r, (a, b) in enumerate(zip(batch.column("tu"), batch.column("tv"))):
                a, b = a.as_buffer(), b.as_buffer()
                if last is None or not last.equals(a):
                    last, x = a, packed.expand(a, np.dtype("<u8"))
                both = np.concatenate([x, packed.expand(b, np.dtype("<u8"))])
                both.sort()
                same[r] = np.count_nonzero(both[1:] == both[:-1])
            j = same / (batch.column("nu").to_numpy().astype(np.int64) + batch.column("nv").to_numpy() - same)
            yield pa.record_batch({"u": batch.column("u"), "v": batch.column("v"), "jaccard": pa.array(j, pa.float64())}).filter(pa.array(j >= t - 1e-12))

    return run


def left_sets(docs: DataFrame, make, t: float) -> DataFrame:
    """(cid, n, tokens, prefix) of the sets that may be alike to others. ``make`` gives the records of a batch of docs as ``gram_records`` does."""
    fields = {"lo": "<u4", "mid": "<u2", "cid": "<u8", "n": "<i4"}
    by = lambda column: lambda batch: {"key": tx.mix((a := _unpack(batch, _GRAM))[column]), **a}
    ranked = lambda batch: {"key": tx.mix((a := _unpack(batch, _RANKED))["cid"]), **a}
    some = packed.exchange(docs, make, fields, _number, _schema(_GRAM))
    alive = packed.exchange(some, by("cid"), _GRAM, _alive(t), _schema(_GRAM), None)
    again = packed.exchange(alive, by("token"), _GRAM, _recount, _schema(_RANKED), None)
    return store.cut(packed.exchange(again, ranked, _RANKED, _sets(t), _SET, None))


def _verified(met: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    return store.cut(alike(packed.exchange(met, _pair_records, _FOUND, _once, "u bigint, v bigint", None), sets, t))


def pairs(sets: DataFrame, t: float) -> DataFrame:
    """(u, v, jaccard): every pair of different sets that are t alike, once."""
    return _verified(packed.exchange(sets.select("cid", "n", "prefix"), _prefix_records(t), _PREFIX, _candidates(t), _schema(_FOUND), None), sets, t)


def forest(sets: DataFrame, t: float) -> DataFrame:
    """(u, v, jaccard): links that connect all that ``pairs`` connects, not each of them.

    Each set is held against the first one of its buckets; then all candidates
    are whose sets those links don't connect. So no pair is left out but those
    that are connected already, and a cluster's links grow with its sets.
    """
    plain = sets.select("cid", "n", "prefix")
    one = _verified(packed.exchange(plain, _prefix_records(t), _PREFIX, _stars(t), _schema(_FOUND), None), sets, t)
    root = graph.components(one.select("u", "v")).select(F.col("u").alias("cid"), F.col("v").alias("root"))
    labelled = plain.join(root, "cid", "left").select("cid", "n", "prefix", F.coalesce("root", "cid").alias("label"))
    return one.union(_verified(packed.exchange(labelled, _prefix_records(t), _GROUPED, _candidates(t), _schema(_FOUND), None), sets, t))


#: Sets of a block, and bytes of their tokens as they are packed, beyond which a group is parted into several.
_BLOCK_SETS, _BLOCK_BYTES = 2048, 4 << 20
#: Meetings of two sets at a token that are counted together.
_MEETINGS = 4 << 20


def _degrees(t: float):
    """How many sets of its group each set of a partition is alike to: a set of side 0 is held against those of side 1 in its cell, sets of side 2 against each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: dict[str, list[np.ndarray]] = {c: [] for c in ("cell", "side", "cid", "n", "many")}
        each: list[np.ndarray] = []
        for batch in batches:
            for c, v in cols.items():
                v.append(batch.column(c).to_numpy())
            each += [packed.expand(b.as_buffer(), np.dtype("<u8")) for b in batch.column("tokens")]
        if not each:
            return
        a = {c: np.concatenate(v) for c, v in cols.items()}
        rows = np.argsort(a["cell"], kind="stable")
        a, each = {c: v[rows] for c, v in a.items()}, [each[r] for r in rows.tolist()]
        begin, length = packed.runs(a["cell"])
        base, widest = np.repeat(begin, length), int(length.max())
        row = np.repeat(np.arange(len(each)), [len(x) for x in each])
        key = tx.mix(np.concatenate(each) + tx.mix(a["cell"].view(_U))[row])
        order = np.argsort(key, kind="stable")
        start, length = packed.runs(key[order])
        held = row[order]  # the sets that hold a token, one token after another
        first, many = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
        first[order], many[order] = np.repeat(start, length), np.repeat(length, length)
        ask = np.flatnonzero((many > 1) & (a["side"][row] != 1))
        row, first, many = row[ask], first[ask], many[ask]
        begin, length = packed.runs(row)
        meets = np.add.reduceat(many, begin) if len(begin) else many
        near, n = np.zeros(len(each), np.int64), a["n"].astype(np.int64)
        x = 0
        while x < len(begin):
            y = x + max(1, int(np.searchsorted(np.cumsum(meets[x : x + max(1, _MEETINGS // widest)]), _MEETINGS, "right")))
            e = slice(begin[x], begin[y - 1] + length[y - 1])
            k = many[e]
            other = held[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[e], k)]
            mine = np.repeat(np.arange(y - x), length[x:y])
            count = np.bincount(np.repeat(mine, k) * widest + other - base[other])
            code = np.flatnonzero(count)
            same = count[code]
            u = row[begin[x:y]][code // widest]
            v = base[u] + code % widest
            alike = (u != v) & ((a["side"][u] == 2) | (a["side"][v] == 1)) & (same / (n[u] + n[v] - same) >= t - 1e-12)
            u, v = u[alike], v[alike]
            np.add.at(near, u, a["many"][v])
            cross = a["side"][u] == 0
            np.add.at(near, v[cross], a["many"][u[cross]])
            x = y
        yield pa.record_batch({"cid": pa.array(a["cid"]), "near": pa.array(near)}).filter(pa.array(near > 0))
        tx.tidy()

    return run


def degrees(sets: DataFrame, t: float) -> DataFrame:
    """(cid, near) of the sets that are t alike to others: the sum of those others' ``many``.

    ``sets`` has (cid, n, tokens, many, label), and alike sets have one label.
    Sets are moved by label and all pairs of a label counted where they meet, so
    that what is moved and written grows with the sets and not with their pairs.
    A label of many sets is parted into blocks; every two blocks meet in a task.
    """
    room = F.greatest(F.ceil(F.count("*") / _BLOCK_SETS), F.ceil(F.sum(F.length("tokens")) / _BLOCK_BYTES)).cast("int")
    sets = sets.join(sets.groupBy("label").agg(room.alias("blocks")), "label").withColumn("b", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    sets = sets.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("label", F.least("b", "o"), F.greatest("b", "o"))
    side = F.when(F.col("b") == F.col("o"), 2).otherwise((F.col("b") > F.col("o")).cast("int"))
    met = sets.select(cell.alias("cell"), side.alias("side"), "cid", "n", F.col("many").cast("bigint").alias("many"), "tokens")
    return met.repartition(store.partitions(sets.sparkSession), "cell").mapInArrow(_degrees(t), "cid bigint, near bigint").groupBy("cid").agg(F.sum("near").alias("near"))


def alike(some: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """(u, v, jaccard): of the given pairs of sets those that are t alike."""
    side = lambda x: sets.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))
    return some.join(side("u"), "u").join(side("v"), "v").mapInArrow(_alike(t), "u bigint, v bigint, jaccard double")


def gram_records(g: np.ndarray, owner: np.ndarray, cid: np.ndarray, size: np.ndarray) -> packed.Arrays:
    """Records of n-grams and the rows that hold them, of sets ``cid`` of ``size`` n-grams."""
    return {"key": g, "lo": (g & _U(0xFFFFFFFF)).astype(np.uint32), "mid": (g >> _U(32) & _U(0xFFFF)).astype(np.uint16), "cid": cid[owner], "n": size[owner].astype(np.int32)}

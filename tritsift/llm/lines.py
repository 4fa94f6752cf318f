"""Line dedup by a segment-partition edit join.

A line is dropped if it stands earlier, in the order (doc_id, line number), or
if an earlier line is within ``edits`` byte edits of it. Lines compare without
the spaces, tabs and carriage returns at their ends; blank lines always stay.
Lines of fewer than ``min_bytes`` bytes are compared exactly only.

The join: a line of each length is cut into edits + 1 even segments, of which
one stands unedited in any line within ``edits`` edits. Lines are indexed by
(length, segment number, segment) and probe, for each length they may match,
the substrings that the multi-match-aware bounds leave. Lines that meet are
held against each other by a parity sketch of their byte pairs, of which an
edit flips four bits at most, and then by banded bit-parallel edit distance.
Every bound is exact: no pair is lost.

Null text has no lines. Rows with a null doc_id take no part and are left as
they are. Rows that repeat a (doc_id, text) are the same lines; of rows that
share a doc_id with different texts, the one that sorts later by text gives
way; each keeps its own lines. A text without new lines is one line, however long. ``dedup_lines`` drops
a document that had lines and loses all but blank ones; texts that had none
stay. Other columns pass through, whatever their names; a column n_chars is
set to the new text's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tritsift.llm import packed, store
from tritsift.llm import text as tx

_U = np.uint64
_TRIM = np.zeros(256, bool)
_TRIM[[32, 9, 13]] = True


@dataclass(frozen=True)
class LineParams:
    edits: int = 2
    min_bytes: int = 24


@dataclass
class Lines:
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    #: Row and line number of each line.
    row: np.ndarray
    number: np.ndarray


def find_lines(arr: pa.Array) -> Lines:
    """The lines of a column that aren't blank, trimmed."""
    data, offs = tx.buffers(arr)
    breaks = np.flatnonzero(data == 10)
    row_of = np.searchsorted(offs, breaks, side="right") - 1
    rows = np.concatenate([np.arange(len(offs) - 1), row_of])
    start = np.concatenate([offs[:-1], breaks + 1])
    order = np.lexsort((start, rows))
    rows, start = rows[order], start[order]
    end = np.concatenate([start[1:] - 1, offs[-1:]])
    last = np.concatenate([rows[1:] != rows[:-1], [True]]) if len(rows) else np.zeros(0, bool)
    end[last] = offs[rows[last] + 1]
    first = np.searchsorted(rows, np.arange(len(offs) - 1))
    number = np.arange(len(rows)) - first[rows]
    solid = np.flatnonzero(~_TRIM[data] & (data != 10))
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    full = b > a
    a, b = a[full], b[full]
    return Lines(data, solid[a], solid[b - 1] + 1, rows[full], number[full])


def _segment(length: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Where segment i of ``parts`` begins in a line of the length, and its length: the last ones are the longer."""
    base, longer = length // parts, length % parts
    return i * base + np.maximum(0, i - (parts - longer)), base + (i >= parts - longer)


def _key(h: np.ndarray, length: np.ndarray, i: int) -> np.ndarray:
    return tx.mix(h + length.astype(_U) * _U(0xD1342543DE82EF95) + _U(i + 1))


def _segments(p: LineParams):
    """The index and probe records of a batch's distinct lines; kind is 1 for probes."""

    def make(batch: pa.RecordBatch) -> packed.Arrays:
        ln = find_lines(batch.column("text"))
        data = tx.padded(ln.data)
        h = tx.chunks(data, ln.start, ln.end).hash()
        _, one = np.unique(h, return_index=True)
        one = one[(ln.end - ln.start)[one] >= p.min_bytes]
        h, s, e = h[one], ln.start[one], ln.end[one]
        length = e - s
        pair = np.zeros(len(ln.data) + 1, _U)
        if len(ln.data) > 1:
            d = ln.data.astype(np.int64)
            np.bitwise_xor.accumulate(_U(1) << (tx.mix((d[:-1] * 256 + d[1:]).astype(_U)) & _U(63)), out=pair[1:-1])
            pair[-1] = pair[-2]
        sk = pair[e - 1] ^ pair[s]
        k = p.edits
        keys, who, kinds = [], [], []
        all_lines = np.arange(len(h))
        for i in range(k + 1):
            at, size = _segment(length, i, k + 1)
            keys.append(_key(tx.chunks(data, s + at, s + at + size).hash(), length, i))
            who.append(all_lines)
            kinds.append(np.zeros(len(h), np.uint8))
            for delta in range(k + 1):  # the indexed line is shorter by delta
                other = length - delta
                at, size = _segment(other, i, k + 1)
                for shift in range(max(-i, delta - (k - i)), min(i, delta + (k - i)) + 1):
                    ok = np.flatnonzero((other >= p.min_bytes) & (at + shift >= 0) & (at + shift + size <= length))
                    b = (s + at + shift)[ok]
                    keys.append(_key(tx.chunks(data, b, b + size[ok]).hash(), other[ok], i))
                    who.append(ok)
                    kinds.append(np.ones(len(ok), np.uint8))
        key, at, kind = np.concatenate(keys), np.concatenate(who), np.concatenate(kinds)
        return {"key": key, "low": (key & _U(0xFFFFFFFE)) | kind.astype(_U), "line": h[at], "sketch": sk[at]}

    return make


#: Pairs that are looked at together.
_CHUNK = 2_000_000


def _meet(edits: int):
    def run(a: packed.Arrays) -> Iterator[pa.RecordBatch]:
        probe = (a["low"] & 1) == 1
        key = a["low"] >> 1
        ik, il, isk = key[~probe], a["line"][~probe], a["sketch"][~probe]
        order = np.lexsort((il, ik))
        ik, il, isk = ik[order], il[order], isk[order]
        pk, pl, psk = key[probe], a["line"][probe], a["sketch"][probe]
        lo, hi = np.searchsorted(ik, pk, "left"), np.searchsorted(ik, pk, "right")
        some = np.flatnonzero(hi > lo)
        lo, count, pl, psk = lo[some], (hi - lo)[some], pl[some], psk[some]
        ends = np.cumsum(count)
        seen = []
        cut = 0
        while cut < len(count):
            base = ends[cut - 1] if cut else 0
            to = max(cut + 1, int(np.searchsorted(ends, base + _CHUNK, "right")))
            c = count[cut:to]
            q = np.repeat(np.arange(cut, to), c)
            r = np.arange(len(q)) - np.repeat(np.cumsum(c) - c, c) + lo[q]
            ok = (pl[q] != il[r]) & (np.bitwise_count(psk[q] ^ isk[r]) <= 4 * edits)
            if ok.any():
                x, y = pl[q[ok]], il[r[ok]]
                seen.append(np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], 1), axis=0))
            cut = to
        if seen:
            pair = np.unique(np.concatenate(seen), axis=0).view(np.int64)
            yield pa.record_batch({"u": pa.array(pair[:, 0]), "v": pa.array(pair[:, 1])})

    return run


def _whole(batch: pa.RecordBatch) -> packed.Arrays:
    ln = find_lines(batch.column("text"))
    h, h2 = tx.chunks(tx.padded(ln.data), ln.start, ln.end).both()
    return {"key": h, "key2": h2, "doc": batch.column("doc_id").to_numpy()[ln.row], "nth": batch.column("nth").to_numpy()[ln.row], "number": ln.number}


def _firsts(a: packed.Arrays) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((a["number"], a["nth"], a["doc"], a["key2"], a["key"]))
    h, h2, doc, nth, number = (a[c][order] for c in ("key", "key2", "doc", "nth", "number"))
    alike = np.zeros(len(h), bool)
    alike[1:] = (h[1:] == h[:-1]) & (h2[1:] == h2[:-1])
    same = alike.copy()
    same[1:] &= (doc[1:] == doc[:-1]) & (nth[1:] == nth[:-1]) & (number[1:] == number[:-1])
    h, h2, doc, nth, number, alike = (x[~same] for x in (h, h2, doc, nth, number, alike))
    start = np.flatnonzero(~alike)
    first = np.repeat(start, np.diff(np.append(start, len(h))))
    yield pa.record_batch({"h": pa.array(h.view(np.int64)), "h2": pa.array(h2.view(np.int64)), "doc_id": pa.array(doc), "nth": pa.array(nth), "line_no": pa.array(number), "first_doc_id": pa.array(doc[first]), "first_nth": pa.array(nth[first]), "first_line_no": pa.array(number[first])})


_FIRST = "h bigint, h2 bigint, doc_id bigint, nth int, line_no int, first_doc_id bigint, first_nth int, first_line_no int"


def edit_distance(x: list[bytes], y: list[bytes], k: int) -> np.ndarray:
    """Edit distances of pairs, k + 1 where greater than k.

    For e = 0 to k a bit vector has the rows of the band of 2k + 1 diagonals
    that e edits reach (Wu and Manber's recurrence), a byte of y a step for all
    pairs together; pairs that nothing reaches any more are left out.
    """
    out = np.full(len(x), k + 1)
    m, w = np.array([len(s) for s in x], np.int64), np.array([len(s) for s in y], np.int64)
    live = np.flatnonzero(np.abs(m - w) <= k)
    live = live[np.argsort(w[live], kind="stable")]
    px, py = np.concatenate([[0], np.cumsum(m)]), np.concatenate([[0], np.cumsum(w)])
    bx, by = np.frombuffer(b"".join(x) + b"\0", np.uint8), np.frombuffer(b"".join(y) + b"\0", np.uint8)
    m, w, px, py = m[live], w[live], px[live], py[live]
    full = _U((1 << (2 * k + 1)) - 1)
    # Bit b after j bytes of y stands for j + b - k bytes of x.
    reach = [np.full(len(live), ((1 << (e + 1)) - 1) << k, _U) & (full >> np.minimum(np.maximum(k - m, 0), 2 * k).astype(_U)) for e in range(k + 1)]
    j = 0
    while len(live):
        done = int(np.searchsorted(w, j, "right"))
        if done:
            bit = (m[:done] - w[:done] + k).astype(_U)
            for e in range(k, -1, -1):
                hit = ((reach[e][:done] >> bit) & _U(1)) == 1
                out[live[:done][hit]] = e
        keep = np.arange(done, len(live))
        if j % 16 == 15 and len(keep):
            keep = keep[reach[k][keep] != 0]
        if len(keep) < len(live):
            live, m, w, px, py = live[keep], m[keep], w[keep], px[keep], py[keep]
            reach = [r[keep] for r in reach]
        if not len(live):
            break
        j += 1
        c = by[py + j - 1]
        eq, valid = np.zeros(len(live), _U), np.zeros(len(live), _U)
        for b in range(2 * k + 1):
            i = j + b - k
            if i >= 0:
                ok = i <= m
                valid |= ok.astype(_U) << _U(b)
                if i >= 1:
                    eq |= (ok & (bx[np.minimum(px + i - 1, len(bx) - 1)] == c)).astype(_U) << _U(b)
        new = [reach[0] & eq]
        for e in range(1, k + 1):
            new.append(((reach[e] & eq) | reach[e - 1] | (reach[e - 1] >> _U(1)) | (new[e - 1] << _U(1))) & valid)
        reach = new
    return out


def _measure(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = edit_distance(batch.column("tu").to_pylist(), batch.column("tv").to_pylist(), k)
            got = pa.record_batch({n: batch.column(n) for n in ("u", "v", "du", "xu", "nu", "dv", "xv", "nv")} | {"edits": pa.array(d.astype(np.int32))})
            yield got.filter(pa.array(d <= k))

    return run


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trimmed lines whose numbers are wanted."""
    for batch in batches:
        out: list[tuple[int, int, bytes]] = []
        for text, want in zip(batch.column("text").to_pylist(), batch.column("want").to_pylist()):
            every = text.encode().split(b"\n")
            out += [(w["h"], w["h2"], every[w["line_no"]].strip(b" \t\r")) for w in want if w["line_no"] < len(every)]
        h, h2, t = zip(*out) if out else ((), (), ())
        yield pa.record_batch({"h": pa.array(h, pa.int64()), "h2": pa.array(h2, pa.int64()), "t": pa.array(t, pa.binary())})


def _known(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")


def _docs(docs: DataFrame) -> DataFrame:
    """(doc_id, nth, text): texts that share an id are numbered on by their order."""
    d = _known(docs)
    return _number(d, _numbers(d), "nth")


def _numbers(d: DataFrame) -> DataFrame | None:
    """(id, hash, nth) of the texts that share an id with other ones; None if there are none."""
    hashed = d.select("doc_id", F.xxhash64("text").alias("hash"))
    many = store.cut(hashed.groupBy("doc_id").agg(F.min("hash").alias("a"), F.max("hash").alias("b")).where("a <> b").select("doc_id"))
    if many.isEmpty():
        return None
    texts = store.restrict(d, many, "doc_id").distinct()
    by = Window.partitionBy("doc_id").orderBy("text")
    return store.cut(texts.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), (F.row_number().over(by) - 1).alias("nth")))


def _number(d: DataFrame, numbers: DataFrame | None, name: str) -> DataFrame:
    """d with the number of each row's text among those of its id, under a name that d hasn't."""
    if numbers is None:
        return d.withColumn(name, F.lit(0))
    i, h, n = store.fresh(d, "id", "hash", "number")
    on = (F.col("doc_id").cast("bigint") == F.col(i)) & (F.xxhash64(F.col("text").cast("string")) == F.col(h))
    return d.join(numbers.toDF(i, h, n), on, "left").withColumn(name, F.coalesce(n, F.lit(0))).drop(i, h, n)


def _dropped(docs: DataFrame, params: LineParams) -> DataFrame:
    """dropped_lines with the number of each line's text among those of its id, nth."""
    occ = store.cut(packed.exchange(docs, _whole, {"key": "<u8", "key2": "<u8", "doc": "<i8", "nth": "<i4", "number": "<i4"}, _firsts, _FIRST))
    met = packed.exchange(docs.select("text"), _segments(params), {"low": "<u4", "line": "<u8", "sketch": "<u8"}, _meet(params.edits), "u bigint, v bigint")
    met = store.cut(met.distinct())
    hs = store.cut(met.select(F.explode(F.array("u", "v")).alias("h")).distinct())
    first = occ.where("doc_id = first_doc_id and nth = first_nth and line_no = first_line_no").select("h", "h2", "doc_id", "nth", "line_no")
    want = store.restrict(first, hs, "h").groupBy("doc_id", "nth").agg(F.collect_list(F.struct("h", "h2", "line_no")).alias("want"))
    want = store.cut(want)
    small = want.count() <= store.BROADCAST_IDS // 16
    lines = docs.join(F.broadcast(want) if small else want.hint("shuffle_hash"), ["doc_id", "nth"]).select("text", "want").mapInArrow(_pick, "h bigint, h2 bigint, t binary")
    # Lines that share the hash of the join but not both are each held against the others, by their bytes.
    lines = store.cut(lines.groupBy("h", "h2").agg(F.first("t").alias("t")).join(store.restrict(first, hs, "h"), ["h", "h2"]))
    side = lambda x: lines.select(F.col("h").alias(x), F.col("t").alias(f"t{x}"), F.col("doc_id").alias(f"d{x}"), F.col("nth").alias(f"x{x}"), F.col("line_no").alias(f"n{x}"))
    pairs = met.join(side("u"), "u").join(side("v"), "v").mapInArrow(_measure(params.edits), "u bigint, v bigint, du bigint, xu int, nu int, dv bigint, xv int, nv int, edits int")
    ordered = pairs.select(F.expr("explode(array(struct(u h, du doc_id, xu nth, nu line_no, dv first_doc_id, xv first_nth, nv first_line_no, edits), struct(v h, dv doc_id, xv nth, nv line_no, du first_doc_id, xu first_nth, nu first_line_no, edits)))").alias("e")).select("e.*")
    near = ordered.where("struct(first_doc_id, first_nth, first_line_no) < struct(doc_id, nth, line_no)").groupBy("h", "doc_id", "nth", "line_no").agg(F.min(F.struct("first_doc_id", "first_nth", "first_line_no", "edits")).alias("m"))
    exact = occ.where("doc_id <> first_doc_id or nth <> first_nth or line_no <> first_line_no").select("doc_id", "nth", "line_no", "first_doc_id", "first_line_no", F.lit(0).alias("edits"))
    return exact.union(near.select("doc_id", "nth", "line_no", "m.first_doc_id", "m.first_line_no", "m.edits"))


def dropped_lines(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """(doc_id, line_no, first_doc_id, first_line_no, edits) of the lines to drop, and the earliest line that each repeats: an equal one (edits 0), else the earliest within ``edits``. Lines are numbered from 0."""
    return _dropped(_docs(docs), params).drop("nth")


def _cut(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """Texts without the lines of the given numbers; null where there are none to cut."""
    out = []
    for text, numbers in zip(texts.to_pylist(), gone.to_pylist()):
        if text is None or not numbers:
            out.append(None)
        else:
            less = set(numbers)
            out.append("\n".join(line for n, line in enumerate(text.split("\n")) if n not in less))
    return pa.array(out, pa.string())


def dedup_lines(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """The documents without the dropped lines, in their columns."""
    d = _known(docs)
    numbers = _numbers(d)
    nth, of, doc, gone, kept = store.fresh(docs, "nth", "of", "doc", "gone", "kept")
    lost = _dropped(_number(d, numbers, "nth"), params).groupBy(F.col("doc_id").alias(doc), F.col("nth").alias(of)).agg(F.collect_set("line_no").alias(gone))
    joined = _number(docs, numbers, nth).join(lost, (F.col("doc_id").cast("bigint") == F.col(doc)) & (F.col(nth) == F.col(of)), "left")
    cut = F.arrow_udf(_cut, "string")(F.col("text").cast("string"), F.col(gone))
    joined = joined.withColumn(kept, cut)
    hit = F.col(kept).isNotNull()
    out = joined.where(~hit | (F.trim(F.regexp_replace(kept, "[\n\t\r]", " ")) != ""))
    cols = []
    for name in docs.columns:
        if name == "text":
            cols.append(F.when(hit, F.col(kept)).otherwise(F.col("text")).alias("text"))
        elif name == "n_chars":
            cols.append(F.when(hit, F.char_length(kept).cast(docs.schema[name].dataType)).otherwise(F.col(name)).alias(name))
        else:
            cols.append(F.col(f"`{name}`"))
    return out.select(cols)


def dropped_lines_sql(params: LineParams = LineParams(), table: str = "documents") -> str:
    """The same rows in DuckDB's SQL, whose levenshtein counts bytes too."""
    return f"""WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM {table} WHERE doc_id IS NOT NULL AND text IS NOT NULL),
lines AS (SELECT DISTINCT doc_id, (i - 1)::INT AS line_no, trim(parts[i], ' ' || chr(9) || chr(13)) AS t FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM cut)),
firsts AS (SELECT t, min((doc_id, line_no)) AS f FROM lines WHERE t <> '' GROUP BY t),
longer AS (SELECT t, f, strlen(t) AS n FROM firsts WHERE strlen(t) >= {params.min_bytes}),
near AS (SELECT b.f AS own, min((a.f[1], a.f[2], levenshtein(a.t, b.t)::INT)) AS m
  FROM (SELECT *, unnest(range(n - {params.edits}, n + {params.edits} + 1)) AS other FROM longer) b JOIN longer a ON a.n = b.other AND a.f < b.f AND levenshtein(a.t, b.t) <= {params.edits} GROUP BY b.f)
SELECT doc_id, line_no, f[1] AS first_doc_id, f[2] AS first_line_no, 0 AS edits FROM lines JOIN firsts USING (t) WHERE (doc_id, line_no) <> f
UNION ALL SELECT own[1], own[2], m[1], m[2], m[3] FROM near"""

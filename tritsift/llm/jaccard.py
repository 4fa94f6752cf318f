"""N-gram Jaccard join.

A document's set is that of its distinct word n-grams. Groups, links and pairs
come from ``overlap``, which finds all pairs of different sets at least
``threshold`` alike. ``near_groups`` verifies of them what connects the groups;
``near_links`` then counts all within each group, and only ``jaccard_pairs``
writes them out and expands copies into pairs.

The parity sketches (``block_keys``, ``sketches``, ``_links``) are an approximate
join in size bands, which loses some links at the threshold and in large
buckets. No query uses it any more.

Null or empty text has an empty set, which is like no other. A text of fewer
words than n has one n-gram of all of them. Rows with a null doc_id are in no
group. Rows that repeat a doc_id count as one document if their texts are
alike, and are linked to each other's groups if not. Other columns play no part
and pass through ``near_dedup``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tritsift.llm import graph, overlap, packed, store
from tritsift.llm import text as tx

_U = np.uint64


@dataclass(frozen=True)
class JaccardParams:
    n: int = 3
    threshold: float = 0.5
    #: Blocks that a set joins on in each of its two bands.
    blocks: int = 20
    #: Similarity from which on a document stands for another in its bucket.
    close: float = 0.9


def grams(arr: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each row, in ascending order, and their rows."""
    h, _, _, row = tx.words(arr)
    g, at = tx.ngrams(h, row, n)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    return g[first], owner[first]


def band_of(n: np.ndarray, t: float) -> np.ndarray:
    """Size bands in the ratio 1 / t."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(1 / t) + 1e-9).astype(np.int64)


def most_different(band: np.ndarray, t: float) -> np.ndarray:
    """The symmetric difference that two sets, the larger in this band, have at most if they are t alike."""
    return np.floor((1 - t) / (1 + t) * 2 * np.floor((1 / t) ** (band + 1) - 1e-9) + 1e-9).astype(np.int64)


#: Bits of a set's sketch.
_BITS = 512
#: Blocks of a band that uses all of them, and how often.
_FEW, _AGAIN = 8, 6


def block_keys(g: np.ndarray, owner: np.ndarray, size: np.ndarray, p: JaccardParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join keys, their rows, and 0 for a set's own band or 1 for the next. A key mixes a block's parity sketch with band and block."""
    keys, rows, steps = [], [], []
    for step in (0, 1):
        band = band_of(size, p.threshold) + step
        m = most_different(band, p.threshold) + 1
        for again in range(_AGAIN):
            few = m[owner] <= _FEW
            if again and not few.any():
                break
            h = tx.mix(g ^ (band[owner].astype(_U) * _U(0x9E3779B97F4A7C15) + _U(again)))
            block = ((h >> _U(32)) * m[owner].astype(_U) >> _U(32)).astype(np.int64)
            here = np.flatnonzero((block < p.blocks) & (few | (again == 0)))
            cell = owner[here] * p.blocks + block[here]
            order = np.argsort(cell, kind="stable")
            start, _ = packed.runs(cell[order])
            if not len(start):
                continue
            parity = np.bitwise_xor.reduceat(h[here][order], start)
            cell = cell[order][start]
            row = cell // p.blocks
            keys.append(tx.mix(parity + (band[row] * _AGAIN + again).astype(_U) * _U(0xD1342543DE82EF95) + (cell % p.blocks).astype(_U) * _U(0xA24BAED4963EE407)))
            rows.append(row)
            steps.append(np.full(len(row), step))
    return (np.concatenate(keys), np.concatenate(rows), np.concatenate(steps)) if keys else (np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64))


def sampling(band: np.ndarray, t: float) -> np.ndarray:
    """The power of two of whose n-grams one is in the sketches of a band: about 400 stand in the largest set."""
    return np.maximum(0, np.ceil(np.log2((1 / t) ** (band + 1) / 400))).astype(np.int64)


def sketches(g: np.ndarray, owner: np.ndarray, power: np.ndarray) -> np.ndarray:
    """The parity sketch of each row's set, or of a sample of it by hash, as eight words."""
    rows = len(power)
    here = (g >> _U(9)) & ((_U(1) << power[owner].astype(_U)) - _U(1)) == 0
    bits = np.bincount(owner[here] * _BITS + (g[here] & _U(_BITS - 1)).astype(np.int64), minlength=rows * _BITS).astype(np.uint8) & 1
    return np.packbits(bits.reshape(rows, _BITS), axis=1).view(_U)


def most_bits(total: np.ndarray, power: np.ndarray, t: float, sigmas: float = 3.0) -> np.ndarray:
    """Differing bits of two such sketches beyond which sets of this total size aren't taken for t alike: ``sigmas`` standard deviations above what the largest symmetric difference flips, and without sampling no more than that difference."""
    share = 0.5**power
    d = (1 - t) / (1 + t) * total * share
    p = (1 - np.exp(-2 * d / _BITS)) / 2
    spread = np.sqrt(_BITS * p * (1 - p) + (1 - 2 * p) ** 2 * d * (1 - share))
    return np.where(power > 0, np.inf, np.floor(d + 1e-9)).clip(max=_BITS * p + sigmas * spread + (1 if sigmas else 0))


def _near(a: packed.Arrays, i: np.ndarray, j: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether rows i and j may be alike, and the bits in which their sketches differ."""
    bits = sum(np.bitwise_count(a[f"s{k}"][i] ^ a[f"s{k}"][j]).astype(np.int64) for k in range(_BITS // 64))
    x, y = a["n"][i].astype(np.int64), a["n"][j].astype(np.int64)
    return (np.minimum(x, y) >= t * np.maximum(x, y) - 1e-9) & (bits <= most_bits(x + y, a["power"][i].astype(np.int64), t)) & (a["id"][i] != a["id"][j]), bits


def _sorted(a: packed.Arrays) -> tuple[packed.Arrays, np.ndarray, np.ndarray]:
    order = np.lexsort((tx.mix(a["id"].view(_U)), a["key"]))
    start, length = packed.runs(a["key"][order])
    keep = np.repeat(length > 1, length)
    a = {k: v[order][keep] for k, v in a.items()}
    return a, *packed.runs(a["key"])


#: Documents of a bucket whose pairs are all looked at together with those of other buckets.
_SMALL = 16


def _large(a: packed.Arrays, s: int, n: int, p: JaccardParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of the bucket [s, s + n): each document with its nearest one in every cluster that it meets."""
    us, vs, bs = [], [], []
    lead, root, m = np.empty(n, np.int64), np.arange(n), 0  # documents that later ones are held against, and their clusters
    for i in range(s, s + n):
        mine, sure, absorbed = m, False, False
        if m:
            at = lead[:m]
            ok, bits = _near(a, np.full(m, i), at, p.threshold)
            hit = np.flatnonzero(ok)
            if len(hit):
                hit = hit[np.argsort(bits[hit], kind="stable")]
                _, one = np.unique(root[hit], return_index=True)
                to = hit[np.sort(one)]
                us.append(np.full(len(to), i)), vs.append(at[to]), bs.append(bits[to])
                total, power = a["n"][at[to]].astype(np.int64) + int(a["n"][i]), a["power"][at[to]].astype(np.int64)
                near = to[bits[to] <= most_bits(total, power, p.threshold, 0.0)]
                if len(near):
                    sure = True
                    mine = int(root[near[0]])
                    root[:m][np.isin(root[:m], root[near])] = mine
                absorbed = bool(bits[to[0]] <= most_bits(total[:1], power[:1], p.close)[0])
        if not absorbed:
            lead[m], root[m] = i, mine if sure else m
            m += 1
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs, bs))


def _links(p: JaccardParams):
    def run(a: packed.Arrays) -> Iterator[pa.RecordBatch]:
        a, start, length = _sorted(a)
        parts = []
        if len(start):
            at = np.arange(len(a["id"])) - np.repeat(start, length)
            size = np.repeat(length, length)
            for lag in range(1, _SMALL):
                i = np.flatnonzero((size <= _SMALL) & (at >= lag))
                ok, bits = _near(a, i, i - lag, p.threshold)
                parts.append((i[ok], i[ok] - lag, bits[ok]))
            big = length > _SMALL
            parts += [_large(a, s, n, p) for s, n in zip(start[big].tolist(), length[big].tolist())]
        if sum(len(x) for x, _, _ in parts):
            i, j, bits = (np.concatenate(x) for x in zip(*parts))
            us, vs = a["id"][i], a["id"][j]
            hi, lo = np.maximum(us, vs), np.minimum(us, vs)
            order = np.lexsort((bits, lo, hi))
            hi, lo, bits = hi[order], lo[order], bits[order]
            one = np.ones(len(hi), bool)
            one[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
            yield pa.record_batch({"u": pa.array(hi[one]), "v": pa.array(lo[one]), "bits": pa.array(bits[one])})

    return run


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


def _members(docs: DataFrame, p: JaccardParams) -> DataFrame:
    """(doc_id, cid) of the documents' sets, each once; ``cid`` tells a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tx.slices(batch):
                cid, size, _, _ = _set_ids(piece.column("text"), p)
                yield pa.record_batch({"doc_id": piece.column("doc_id"), "cid": pa.array(cid.view(np.int64))}).filter(pa.array(size > 0))

    return store.cut(_docs(docs).mapInArrow(run, "doc_id bigint, cid bigint").distinct())


def _set_ids(arr: pa.Array, p: JaccardParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each row's set as a hash of its n-grams, their number, and the n-grams and their rows."""
    g, owner = grams(arr, p.n)
    size = np.bincount(owner, minlength=len(arr))
    whole = np.zeros(len(arr), _U)
    start, _ = packed.runs(owner)
    if len(start):
        whole[owner[start]] = np.add.reduceat(tx.mix(g), start)
    return tx.mix(whole + size.astype(_U)), size, g, owner


def _left_sets(docs: DataFrame, p: JaccardParams) -> DataFrame:
    def make(batch: pa.RecordBatch) -> packed.Arrays:
        cid, size, g, owner = _set_ids(batch.column("text"), p)
        return overlap.gram_records(g, owner, cid, size)

    return overlap.left_sets(_docs(docs), make, p.threshold)


def _grouped(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, group_id, keep) of the documents that a copy or a pair links to another one."""
    rep = members.groupBy("cid").agg(F.min("doc_id").alias("rep"))
    of = lambda x: rep.select(F.col("cid").alias(x), F.col("rep").alias(f"r{x}"))
    linked = pairs.join(of("u"), "u").join(of("v"), "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
    copies = members.join(rep, "cid").where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    star = graph.components(linked.union(copies))
    every = star.select(F.col("u").alias("doc_id"), F.col("v").alias("group_id")).union(star.select(F.col("v").alias("doc_id"), F.col("v").alias("group_id")).distinct())
    return every.withColumn("keep", F.col("doc_id") == F.col("group_id"))


def near_groups(docs: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """(doc_id, group_id, keep) of the documents that have a near copy: group_id is the group's least doc_id, which is kept."""
    return _grouped(_members(docs, params), overlap.forest(_left_sets(docs, params), params.threshold))


def near_links(docs: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """(doc_id, group_id, keep, links): the groups of all pairs, and how many documents each is linked to, copies among them. Of a document that stands with several texts those links count that its sets have to another document's."""
    t, members, sets = params.threshold, _members(docs, params), _left_sets(docs, params)
    groups = store.cut(_grouped(members, overlap.forest(sets, t)))
    many = members.groupBy("cid").agg(F.count("*").alias("many"), F.min("doc_id").alias("rep"))
    label = many.join(groups.select(F.col("doc_id").alias("rep"), F.col("group_id").alias("label")).distinct(), "rep").select("cid", "many", "label")
    near = overlap.degrees(sets.join(label, "cid"), t)
    linked = members.join(many, "cid").join(near, "cid", "left").select("doc_id", (F.col("many") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    several = members.join(members.groupBy("doc_id").agg(F.count("*").alias("sets")).where("sets > 1"), "doc_id").join(label, "cid")
    both = several.select("doc_id", F.col("cid").alias("u")).join(several.select("doc_id", F.col("cid").alias("v")), "doc_id").where("u <> v")
    own = both.join(overlap.alike(both.select("u", "v").distinct(), sets, t), ["u", "v"]).select("doc_id", F.lit(-1).cast("bigint").alias("links"))
    links = linked.where("links > 0").union(own).groupBy("doc_id").agg(F.sum("links").alias("links"))
    return groups.join(links, "doc_id").select("doc_id", "group_id", "keep", "links")


def jaccard_pairs(docs: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """(u, v, jaccard), u > v: all pairs of documents at least ``threshold`` alike. Their number grows with the square of a group's size."""
    member, found = _members(docs, params), overlap.pairs(_left_sets(docs, params), params.threshold)
    found = found.union(member.select(F.col("cid").alias("u"), F.col("cid").alias("v"), F.lit(1.0).alias("jaccard")).distinct())
    a, b = member.select(F.col("doc_id").alias("a"), F.col("cid").alias("u")), member.select(F.col("doc_id").alias("b"), F.col("cid").alias("v"))
    return found.join(a, "u").join(b, "v").where("a <> b").groupBy(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).agg(F.max("jaccard").alias("jaccard"))


def near_dedup(docs: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """The documents without the near copies; of each group the one with the least doc_id stays."""
    name = store.fresh(docs, "gone")[0]
    gone = store.cut(near_groups(docs, params).where("not keep").select(F.col("doc_id").alias(name)).distinct())
    small = gone.count() <= store.BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, F.col("doc_id") == F.col(name), "left_anti")


#: Words as ``text.words`` finds them, for DuckDB.
WORDS_SQL = r"regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+')"


def near_links_sql(params: JaccardParams = JaccardParams(), table: str = "documents") -> str:
    """The groups of all pairs, each compared, and each document's number of links, in DuckDB's SQL."""
    n, t = params.n, params.threshold
    gram = " || ' ' || ".join(f"ws[i + {k}]" for k in range(n))
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL} AS ws FROM {table} WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < {n} THEN [array_to_string(ws, '_')] ELSE list_transform(range(1, len(ws) - {n} + 2), lambda i: {gram}) END) AS gram FROM w),
size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM both_ JOIN size x ON x.doc_id = u JOIN size y ON y.doc_id = v WHERE c >= {t} * (x.n + y.n - c)),
r(u, v) AS (SELECT DISTINCT u, u FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT r.u AS doc_id, min(r.v) AS group_id, r.u = min(r.v) AS keep, any_value(l.links) AS links FROM r JOIN (SELECT u, count(*) AS links FROM e GROUP BY u) l ON l.u = r.u GROUP BY r.u"""

"""Line dedup, the Jaccard join and repeated passages against brute force."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.edges import EDGES, docs, edge_docs, empty_docs, prose
from tritsift.llm import graph, jaccard, lines, passages
from tritsift.llm import text as tx


def lev(a, b):
    d = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, e in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (c != e))
    return d[-1]


@given(st.lists(st.tuples(st.binary(max_size=12), st.binary(max_size=12)), min_size=1, max_size=20), st.integers(0, 4))
@settings(max_examples=60, deadline=None)
def test_edit_distance(pairs, k):
    x, y = [bytes(c & 1 for c in a) for a, _ in pairs], [bytes(c & 1 for c in b) for _, b in pairs]
    assert lines.edit_distance(x, y, k).tolist() == [min(lev(a, b), k + 1) for a, b in zip(x, y)]


def brute_lines(texts, p=lines.LineParams()):
    every = sorted({(d, n, s.strip(b" \t\r")) for d, t in texts if d is not None and t is not None for n, s in enumerate(t.encode().split(b"\n")) if s.strip(b" \t\r")})
    first = {}
    for d, n, s in every:
        first.setdefault(s, (d, n))
    out = set()
    for d, n, s in every:
        if first[s] != (d, n):
            out.add((d, n, *first[s], 0))
        elif len(s) >= p.min_bytes:
            near = sorted((f, lev(s, o)) for o, f in first.items() if o != s and f < (d, n) and len(o) >= p.min_bytes and abs(len(o) - len(s)) <= p.edits and lev(s, o) <= p.edits)
            if near:
                out.add((d, n, *near[0][0], near[0][1]))
    return out


def edited(r, s, n):
    for _ in range(n):
        i = r.randrange(len(s))
        s = r.choice((s[:i] + "x" + s[i:], s[:i] + s[i + 1 :], s[:i] + "q" + s[i + 1 :]))
    return s


def line_texts(seed=4):
    r = random.Random(seed)
    base = [prose(100 + i, r.randrange(1, 14)) for i in range(30)]
    return [(d, "\n".join(edited(r, r.choice(base), r.choice((0, 0, 1, 2, 3))) + r.choice(("", " ", "\r")) for _ in range(r.randrange(1, 9)))) for d in range(40)]


def test_line_dedup(spark):
    texts = [*line_texts(), (None, "null ids take no part " * 3), (41, None), (42, "\n\n"), (43, prose(100, 5)), (43, prose(100, 5))]
    got = {tuple(r) for r in lines.dropped_lines(docs(spark, texts)).collect()}
    assert got == brute_lines(texts)
    assert any(r[4] for r in got)
    kept = {r.doc_id: r for r in lines.dedup_lines(docs(spark, texts)).collect()}
    gone = collections.defaultdict(set)
    for d, n, *_ in got:
        gone[d].add(n)
    for d, t in texts[:40]:
        left = [s for n, s in enumerate(t.split("\n")) if n not in gone[d]]
        if any(s.strip() for s in left):
            assert kept[d].text == "\n".join(left) and kept[d].n_chars == (len(kept[d].text) if gone[d] else len(t))
        else:
            assert d not in kept
    assert kept[41].text is None and kept[42].text == "\n\n" and None in kept and kept[None].bucket == "b"


def test_lines_shuffled_alike(spark, monkeypatch):
    from tritsift.llm import store

    d = docs(spark, line_texts(9))
    one = {tuple(r) for r in lines.dropped_lines(d).collect()}
    monkeypatch.setattr(store, "BROADCAST_IDS", 0)
    assert {tuple(r) for r in lines.dropped_lines(d).collect()} == one


def brute_groups(texts, p=jaccard.JaccardParams()):
    sets = {}
    for d, t in texts:
        if d is not None and t:
            w = tx.plain_words(t)
            s = frozenset(tuple(w[i : i + p.n]) for i in range(max(1, len(w) - p.n + 1))) if w else frozenset()
            if s:
                sets.setdefault(d, set()).add(s)
    ids = sorted(sets)
    pairs = {(a, b): max(len(x & y) / len(x | y) for x in sets[a] for y in sets[b]) for a in ids for b in ids if b < a}
    pairs = {k: j for k, j in pairs.items() if j >= p.threshold}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    size = collections.Counter(map(find, ids))
    return pairs, {(i, find(i), i == find(i)) for i in ids if size[find(i)] > 1}


def copies(seed=3):
    r = random.Random(seed)
    out, d = [], 0
    for g in range(25):
        words = prose(seed * 1000 + g, r.choice((6, 12, 40, 150, 500))).split()
        for _ in range(r.randrange(1, 6)):
            w = list(words)
            for _ in range(int(len(w) * r.choice((0, 0, 0.02, 0.05, 0.09)))):
                w[r.randrange(len(w))] = prose(r.random(), 1)
            out.append((d, " ".join(w)))
            d += 1
    return out


def test_jaccard_groups_and_pairs(spark):
    texts = [*copies(), (900, "two words"), (901, "Two, words!"), (902, ""), (903, None), (None, "two words"), (904, "")]
    pairs, groups = brute_groups(texts)
    d = docs(spark, texts)
    assert {tuple(r) for r in jaccard.near_groups(d).collect()} == groups
    got = {(r.u, r.v): r.jaccard for r in jaccard.jaccard_pairs(d).collect()}
    assert got.keys() == pairs.keys() and all(abs(got[k] - pairs[k]) < 1e-9 for k in got)
    left = jaccard.near_dedup(d).collect()
    assert sorted((r.doc_id for r in left), key=str) == sorted((i for i, _ in texts if (i, i, True) in groups or i not in {g[0] for g in groups}), key=str)
    assert left[0]["odd name"] == "o"


def test_jaccard_recall_at_the_threshold():
    """Most pairs just above the threshold share a block, in bands of any size."""
    r = np.random.default_rng(1)
    p = jaccard.JaccardParams()
    for size in (4, 9, 20, 60, 300, 2000):
        found = 0
        for _ in range(100):
            d = int((1 - p.threshold) / (1 + p.threshold) * 2 * size / 2)
            both = r.integers(0, 1 << 63, size + d, dtype=np.uint64)
            sets = [np.sort(both[:size]), np.sort(both[d:])]
            keys = [set(jaccard.block_keys(s, np.zeros(len(s), np.int64), np.array([len(s)]), p)[0].tolist()) for s in sets]
            found += bool(keys[0] & keys[1])
        assert found >= 97, size


def test_parity_sketch_bounds_the_difference():
    r = np.random.default_rng(2)
    for size in (3, 30, 120):
        a = r.integers(0, 1 << 63, size, dtype=np.uint64)
        b = np.concatenate([a[: size // 2], r.integers(0, 1 << 63, size // 2, dtype=np.uint64)])
        x, y = (jaccard.sketches(np.sort(s), np.zeros(len(s), np.int64), np.zeros(1, np.int64)) for s in (a, b))
        assert int(np.bitwise_count(x ^ y).sum()) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + r.randrange(30), 100 + r.randrange(30)) for _ in range(20)] + [(7, 7), (5, 4)]
    got = {r.u: r.v for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: m for n, m in root.items() if n != m}
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_common_and_chain():
    r = random.Random(5)
    for _ in range(50):
        x, y = [r.randrange(4) for _ in range(r.randrange(12))], [r.randrange(4) for _ in range(r.randrange(12))]
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
        assert passages.common(x, y) == t[-1][-1]
        pts = sorted({(r.randrange(20), r.randrange(20)) for _ in range(9)})
        best = [0.0] * len(pts)
        for i, (a, b) in enumerate(pts):
            best[i] = 8 + max([0.0, *(best[j] - 0.05 * (a - c + b - d) for j, (c, d) in enumerate(pts[:i]) if c < a and d < b)])
        if pts:
            chain = passages.best_chain([a for a, _ in pts], [b for _, b in pts], 8, 0.05)
            value = 8 * len(chain) - 0.05 * sum(pts[n][0] - pts[m][0] + pts[n][1] - pts[m][1] for m, n in zip(chain, chain[1:]))
            assert abs(value - max(best)) < 1e-9


def test_repeated_passages(spark):
    r = random.Random(8)
    shared = [prose(50 + i, 70).split() for i in range(6)]
    texts, held = [], []
    for d in range(40):
        w = prose(900 + d, r.randrange(30, 300)).split()
        i, fuzzy = r.randrange(6), d % 3 == 0
        p = list(shared[i])
        if fuzzy:
            for n in (20, 45):
                p[n] = prose(d * 7 + n, 1)
        at = r.randrange(len(w))
        if d % 4:
            w[at:at] = p
            held.append((d, at, i))
        texts.append((d, " ".join(w)))
    got = collections.defaultdict(list)
    for x in passages.repeated_passages(docs(spark, texts)).collect():
        got[x.doc_id].append(x)
        assert x.end_word - x.start_word >= 40 and x.identity >= 0.75 and (x.src_doc_id, x.src_start_word) < (x.doc_id, x.start_word)
    seen = set()
    for d, at, i in held:
        if i in seen:
            assert any(x.start_word <= at + 6 and x.end_word >= at + 64 for x in got[d]), d
        seen.add(i)
    clean = {d for d, _ in texts} - {d for d, _, _ in held}
    assert not clean & set(got)


@pytest.mark.parametrize("make", [edge_docs, empty_docs])
def test_edges(spark, make):
    d = make(spark)
    texts = EDGES if make is edge_docs else []
    dropped = {tuple(r) for r in lines.dropped_lines(d).collect()}
    assert {r[:2] for r in dropped} >= ({(9, 0)} if texts else set())
    assert set(lines.dedup_lines(d).columns) == set(d.columns)
    assert {tuple(r) for r in jaccard.near_groups(d).collect()} == ({(8, 8, True), (9, 8, False)} if texts else set())
    assert jaccard.near_dedup(d).count() == max(0, len(texts) - 1)
    found = passages.repeated_passages(d).collect()
    assert {r.doc_id for r in found} == ({9, 10} if texts else set())
    if texts:
        assert any(r.doc_id == 9 and r.end_word - r.start_word == 60_000 and r.identity == 1 for r in found)


def test_hash_words():
    words = [b"a", b"abc", "é".encode()]
    h = tx.words(pa.array(["A abc é!"]))[0]
    assert h.tolist() == tx.hash_words(words).tolist()

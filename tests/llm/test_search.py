"""Top-k search, decontamination, licences, quality and URLs against brute force."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.edges import EDGES, docs, edge_docs, empty_docs, prose
from tritsift.llm import decontaminate, licenses, quality, topk, urls
from tritsift.llm import text as tx


def brute_topk(texts, asked, p=topk.SearchParams()):
    bags = [(d, collections.Counter(tx.plain_words(t))) for d, t in texts]
    n, mean = len(bags), sum(sum(b.values()) for _, b in bags) / len(bags)
    out = collections.defaultdict(list)
    for q, t in sorted({(q, t) for q, t in asked if q is not None and t}):
        for d, b in bags:
            s = 0.0
            for w, c in collections.Counter(tx.plain_words(t)).items():
                df = sum(w in x for _, x in bags)
                if w in b:
                    s += c * math.log(1 + (n - df + 0.5) / (df + 0.5)) * b[w] * (p.k1 + 1) / (b[w] + p.k1 * (1 - p.b + p.b * sum(b.values()) / mean))
            if d is not None and round(s, 6) > 0:
                out[q].append((-round(s, 6), d))
    return {(q, i + 1, d, -s) for q, hits in out.items() for i, (s, d) in enumerate(sorted(hits)[: p.k])}


def test_topk(spark):
    texts = [(d, prose(d % 17, 12) + " the the of") for d in range(60)] + [(61, None), (62, ""), (None, prose(1, 12)), (5, prose(5, 12))]
    asked = [(i, " ".join(prose(i, 12).split()[:5]) + " the") for i in range(8)] + [(9, None), (None, "the"), (10, "nowhere"), (3, " ".join(prose(3, 12).split()[:5]) + " the")]
    queries = spark.createDataFrame([(*a, 1) for a in asked], "item_id bigint, text string, doc_id int")
    for p in (topk.SearchParams(), topk.SearchParams(k=3, block=2, slice_bytes=300, shard_bytes=120)):
        got = {tuple(r) for r in topk.top_documents(docs(spark, texts), queries, p).collect()}
        want = brute_topk(texts, asked, p)
        assert {r[:3] for r in got} == {r[:3] for r in want}
        assert max(abs(a[3] - b[3]) for a, b in zip(sorted(got), sorted(want))) < 2e-6
    assert topk.top_documents(empty_docs(spark), queries).count() == 0
    assert topk.top_documents(docs(spark, texts), queries.limit(0)).count() == 0
    assert topk.top_documents(edge_docs(spark), queries).count() > 0


def items():
    return [(i, f"{prose(700 + i, 20 + i)}. {prose(800 + i, 9)}.") for i in range(12)] + [(20, prose(720, 150)), (21, None), (22, ""), (None, prose(1, 30)), (3, f"{prose(703, 23)}. {prose(803, 9)}.")]


def leaky():
    r, out, held = random.Random(6), [], set()
    for d in range(60):
        w = prose(5000 + d, r.randrange(20, 400)).split()
        if d % 3 == 0:
            i, t = r.choice([x for x in items() if x[1] and x[0] is not None])
            p = t.split()
            if d % 2:
                p[len(p) // 3] = "changed"
            at = r.randrange(len(w))
            w[at:at] = p
            held.add((d, i))
        out.append((d, " ".join(w)))
    return out, held


def test_decontamination(spark):
    texts, held = leaky()
    bench = spark.createDataFrame([(*x, "t") for x in items()], "item_id bigint, text string, doc_id string")
    for p in (decontaminate.DecontaminationParams(), decontaminate.DecontaminationParams(block=2, shard_bytes=400)):
        got = decontaminate.contaminated(docs(spark, texts), bench, p).collect()
        assert {(r.doc_id, r.item_id) for r in got} == held
    left = decontaminate.decontaminate(docs(spark, [*texts, (None, texts[1][1]), (70, None)]), bench)
    assert {r.doc_id for r in left.collect()} == ({d for d, _ in texts} - {d for d, _ in held}) | {None, 70}
    question = [(1, items()[0][1].split(".")[0])]
    assert decontaminate.contaminated(docs(spark, question), bench).count() == 0  # without the answer it isn't leaked
    for make, n in ((edge_docs, len(EDGES)), (empty_docs, 0)):
        assert decontaminate.contaminated(make(spark), bench).count() == 0
        assert decontaminate.decontaminate(make(spark), bench).count() == n
        assert decontaminate.decontaminate(make(spark), bench.limit(0)).count() == n


def brute_leaks(texts, bench, p):
    """{(doc_id, item_id): (question overlap, answer overlap)} by plain words, every passage against every piece."""
    grams = lambda ws: {tuple(ws[i : i + p.n]) for i in range(max(1, len(ws) - p.n + 1))} if ws else set()
    its = {}
    for i, t in bench:
        if i is not None and t:
            ws = tx.plain_words(t)
            parts = [x for x in map(tx.plain_words, re.split(r"[.!?]+\s", t)) if x]
            tail = min(len(ws), max(len(parts[-1]) if len(parts) > 1 else len(ws) // 3, p.n))
            head = ws[: len(ws) - tail]
            its.setdefault((i, t), (ws, grams(head if len(head) >= p.n else ws), grams(ws[len(ws) - tail :])))
    pieces = [(k, ws[s : s + p.piece]) for k, (ws, _, _) in its.items() for s in range(0, len(ws), p.piece)]
    df, mean = collections.Counter(w for _, x in pieces for w in set(x)), sum(len(x) for _, x in pieces) / len(pieces)
    out = {}
    for d, t in texts:
        ws = tx.plain_words(t)
        for k in range(-(-max(len(ws), 1) // p.piece)):
            bag = set(ws[k * p.piece : (k + 2) * p.piece])
            for key, x in pieces:
                c = collections.Counter(x)
                weight = {w: math.log(1 + (len(pieces) - df[w] + 0.5) / (df[w] + 0.5)) * n * (p.k1 + 1) / (n + p.k1 * (1 - p.b + p.b * len(x) / mean)) for w, n in c.items()}
                if sum(v for w, v in weight.items() if w in bag) < p.threshold * sum(weight.values()) * (1 - 1e-9):
                    continue
                words, question, answer = its[key]
                near = grams(ws[max(0, k * p.piece - len(words)) : (k + 2) * p.piece + len(words)])
                q, a = (len(g & near) / len(g) if g else 0.0 for g in (question, answer))
                if q >= p.question_overlap and a >= p.answer_overlap:
                    x, y = out.get((d, key[0]), (0.0, 0.0))
                    out[d, key[0]] = max(x, q), max(y, a)
    return out


def test_decontamination_against_brute_force(spark):
    """The whole operator, items in every degree of change."""
    r = random.Random(11)
    bench = [x for x in items() if x[1]]
    texts = []
    for d in range(50):
        w = prose(7000 + d, r.randrange(1, 260)).split()
        for _ in range(r.randrange(3)):
            p = r.choice(bench)[1].split()
            for n in range(len(p)):
                if r.random() < r.choice((0, 0.1, 0.2, 0.4)):
                    p[n] = prose(r.random(), 1)
            at = r.randrange(len(w))
            w[at:at] = p[r.randrange(4) :]
        texts.append((d, " ".join(w)))
    rows = spark.createDataFrame(bench, "item_id bigint, text string")
    for p in (decontaminate.DecontaminationParams(), decontaminate.DecontaminationParams(block=2, piece=16, threshold=0.3, question_overlap=0.2, answer_overlap=0.1, shard_bytes=900)):
        got = {(x.doc_id, x.item_id): (x.question_overlap, x.answer_overlap) for x in decontaminate.contaminated(docs(spark, texts), rows, p).collect()}
        want = brute_leaks(texts, bench, p)
        assert got.keys() == want.keys() and len(want) > 10


def test_index_is_sparse():
    import pickle

    r = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60_000)]
    its = [decontaminate.split_item(i, " ".join(words[j] for j in r.integers(0, 60_000, 40)) + ". " + " ".join(words[j] for j in r.integers(0, 60_000, 8)), 3) for i in range(4000)]
    index = decontaminate.build_index(its, decontaminate.DecontaminationParams())
    size = sum(len(it.words) for it in its) * 6
    assert len(pickle.dumps((its, index))) < 30 * size  # 16 MB of items stay under 500 MB


def test_block_max_loses_nothing():
    p = decontaminate.DecontaminationParams(block=4)
    r = random.Random(2)
    words = prose(1, 90).split()
    its = [decontaminate.split_item(i, " ".join(r.choice(words) for _ in range(r.randrange(4, 40))), p.n) for i in range(40)]
    window, word, found, want = [], [], set(), set()
    for w in range(80):
        for h in tx.words(pa.array([" ".join(r.choice(words) for _ in range(r.randrange(3, 60)))]))[0].tolist():
            window.append(w), word.append(h)
    window, word = np.array(window), np.array(word, np.uint64)
    index = decontaminate.build_index(its, p)
    found = set(zip(*(v.tolist() for v in decontaminate.search(index, window, word, p))))
    bags, pieces = [set(word[window == w].tolist()) for w in range(80)], decontaminate.cut_items(its, p)
    df, mean = collections.Counter(h for _, x in pieces for h in set(x.tolist())), sum(len(x) for _, x in pieces) / len(pieces)
    for i, x in pieces:
        c = collections.Counter(x.tolist())
        weight = {h: math.log(1 + (len(pieces) - df[h] + 0.5) / (df[h] + 0.5)) * n * (p.k1 + 1) / (n + p.k1 * (1 - p.b + p.b * len(x) / mean)) for h, n in c.items()}
        want |= {(w, i) for w in range(80) if sum(weight[h] for h in c.keys() & bags[w]) >= p.threshold * sum(weight.values()) * (1 - 1e-9)}
    assert found == want and len(want) > 20


def test_licenses(spark):
    noise = [(d, "\n".join(prose(d * 10 + n, 15) for n in range(5))) for d in range(40)]
    lines = {1: "Licensed under the Apache License, Version 2.0.", 2: "Released under the MIT License.", 3: "This work is licensed under the GNU General Public License, version 3.", 4: "Licensed under CC BY-NC 4.0.", 5: "All rights reserved."}
    held = [(100 + k, f"{prose(k, 12)}\n\n{t}\n{prose(k + 50, 9)}") for k, t in lines.items()]
    near = [(200 + k, t) for k, t in enumerate(("You need a driver's license here.", "The license of the poet is free.", "Version 2.0 of the public plan was released."))]
    d = docs(spark, [*noise, *held, *near, (300, None), (None, lines[2]), (301, ""), (302, lines[4]), (302, lines[4])])
    m = licenses.train(d, licenses.LicenseParams(max_unknown=200))
    got = {(r.doc_id, r.line_no, r.family) for r in licenses.license_lines(d, m).collect()}
    want = {(100 + k, 2, f) for k, f in zip(lines, ("apache", "mit", "gpl", "cc-by-nc", "proprietary"))} | {(None, 0, "mit"), (302, 0, "cc-by-nc")}
    assert got == want
    # One paragraph at a time gives what whole columns give.
    for text in [t for _, t in held]:
        for n, line in enumerate(text.split("\n")):
            one = licenses.findings(pa.array([line]), m)
            every = [x for x in licenses.findings(pa.array([text]), m) if x[1] == n]
            assert [x[2] for x in one] == [x[2] for x in every]
            assert all(abs(a[3] - b[3]) < 1e-6 for a, b in zip(one, every))
    assert licenses.license_lines(edge_docs(spark), m).count() == 0
    assert licenses.license_lines(empty_docs(spark), licenses.train(empty_docs(spark))).count() == 0


def test_licenses_held_out():
    rng = np.random.default_rng(99)
    p = licenses.LicenseParams()
    words = prose(3, 300).split()
    data = licenses.variants(np.random.default_rng(1), words, p) + [(prose(i, 20), len(licenses.TEMPLATES)) for i in range(600)] + [(s, len(licenses.TEMPLATES)) for s in licenses.NEAR_MISSES for _ in range(12)]
    m = licenses.fit(data, p)
    held = licenses.variants(rng, prose(77, 300).split(), p)[::3]
    h, _, _, row = tx.words(pa.array([t for t, _ in held]))
    prob = licenses.softmax(licenses.logits(h, row, m) / m.temperature)
    assert (prob.argmax(1) == [c for _, c in held]).mean() > 0.93
    h, _, _, row = tx.words(pa.array([prose(9000 + i, 25) for i in range(300)]))
    assert (licenses.softmax(licenses.logits(h, row, m) / m.temperature).argmax(1) == len(licenses.TEMPLATES)).mean() > 0.98


def labelled(n=240):
    good = [(d, prose(d, 60)) for d in range(n // 2)]
    bad = [(d, "$$$ ".join(prose(d, 40).split()) + " !!! ###") for d in range(n // 2, n)]
    return good + bad


def test_quality(spark):
    texts = labelled()
    labels = spark.createDataFrame([(d, int(d < 120), 0) for d, _ in texts if d % 2] + [(None, 1, 0), (7, None, 0), (999, 1, 0), (7, 1, 0), (7, 1, 0)], "doc_id bigint, quality int, text int")
    d = docs(spark, [*texts, (500, None), (501, ""), (None, texts[0][1]), (0, texts[0][1])])
    m = quality.train(d, labels)
    got = {}
    for r in quality.quality_scores(d, m).collect():
        got[r.doc_id] = r
    held = [(i, got[i].keep) for i, _ in texts if i % 2 == 0]
    assert sum(k == (i < 120) for i, k in held) / len(held) >= 0.97  # documents that weren't trained on
    for i, t in texts[::40]:
        idx, _ = quality.features(pa.array([t]), m.params)
        z = m.bias + sum(float(m.weights[j]) for j in idx.tolist()) / math.sqrt(len(idx))
        assert abs(got[i].probability - 1 / (1 + math.exp(-z))) < 1e-6
    kept = quality.quality_filter(d, m)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.keep} and kept.columns == d.columns
    none = quality.train(d, labels.limit(0))
    assert quality.quality_filter(d, none).count() == d.count() and quality.quality_scores(empty_docs(spark), m).count() == 0
    assert quality.quality_scores(edge_docs(spark), m).count() == len(EDGES)


def test_urls(spark):
    v = urls.UrlVocabulary()
    made = ["http://a.com/casino", "http://a.com/casinos", "http://CHEAP-free.com", "http://cheap.com/cheap", "http://poker.bet/x", "", None, "http://adsense.com/win", "http://free.com/free/win", "xxx", "http://a.b/win?free=1&track"]
    rows = [(i, u, "x") for i, u in enumerate([*made, made[0], "http://long.com/" + "a" * 100_000 + "/porn"])]
    got = {r.page_id: r for r in urls.url_filter(spark.createDataFrame([*rows, (None, "spam", "x")], "page_id bigint, url string, rejected string")).collect()}
    for i, u, _ in rows:
        hit = {t for t in {*v.strict, *v.soft} if re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", (u or "").lower())}
        strict, soft = hit & set(v.strict), hit - set(v.strict)
        assert (got[i].strict_hits, got[i].soft_hits, got[i].rejected) == (len(strict), len(soft), bool(strict) or sum(v.soft[t] for t in soft) >= v.soft_limit)
    assert got[None].rejected and urls.url_filter(spark.createDataFrame([], "page_id bigint, url string")).count() == 0
    with pytest.raises(ValueError):
        urls.url_filter(spark.createDataFrame([], "page_id bigint, url string"), urls.UrlVocabulary(soft={"a": 3.0}))


def test_shards_share_their_statistics(spark):
    p = decontaminate.DecontaminationParams(shard_bytes=400)
    bench = spark.createDataFrame([x for x in items() if x[1] and x[0] is not None], "item_id bigint, text string").distinct()
    whole = decontaminate.count_items([decontaminate.split_item(i, t, p.n) for i, t in bench.collect()], p)
    seen = 0
    for shard, stats in decontaminate._shards(bench, p):
        seen += len(shard)
        assert (stats.pieces, round(stats.mean, 9)) == (whole.pieces, round(whole.mean, 9))
        assert stats.df.tolist() == whole.df[np.searchsorted(whole.terms, stats.terms)].tolist()
    assert seen == bench.count()


def test_lookups_of_terms_and_postings(monkeypatch):
    """Terms of alike high bits and a table or a search of the postings give the same."""
    r = np.random.default_rng(12)
    terms = np.unique(np.concatenate([r.integers(0, 1 << 20, 50, dtype=np.uint64), r.integers(0, 1 << 64, 500, dtype=np.uint64)]))
    cell = np.sort(r.choice(len(terms) * 7, 900, replace=False))
    at = np.searchsorted(cell // 7, np.arange(len(terms) + 1))
    make = lambda: decontaminate.Index(terms, None, at, cell % 7, None, None, None, None, None, 7)
    words = np.concatenate([terms, terms + np.uint64(1), r.integers(0, 1 << 64, 300, dtype=np.uint64)])
    t, known = decontaminate._terms(make(), words)
    assert known.tolist() == np.isin(words, terms).tolist() and (terms[t[known]] == words[known]).all()
    flat = np.arange(len(terms) * 7)
    one = decontaminate._postings(make(), flat)
    monkeypatch.setattr(decontaminate, "_DENSE", 0)
    two = decontaminate._postings(make(), flat)
    assert (one[1] == two[1]).all() and (one[0][one[1]] == two[0][two[1]]).all() and one[1].sum() == 900

"""Texts of a regular build, clashing column names, and tables that are left behind."""

import os

import numpy as np
import pyarrow as pa

from tests.llm.edges import prose
from tests.llm.test_near import brute_groups
from tests.llm.test_tokens import ENC, OTHER
from tritsift.llm import bpe, decontaminate, jaccard, lines, store
from tritsift.llm import text as tx


def regular(n):
    s = "a"
    for _ in range(n):
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def test_regular_words_differ(spark):
    """Thue-Morse words, which meet under any odd polynomial modulo 2**64."""
    for n in (3, 6, 10, 12):
        x, y = regular(n)
        h = tx.hash_words([x.encode(), y.encode()])
        assert h[0] != h[1]
        a, b = tx.chunks(tx.padded(tx.buffers(pa.array([x + y]))[0]), np.array([0, len(x)]), np.array([len(x), 2 * len(x)])).both()
        assert a[0] != a[1] and b[0] != b[1] and a[0] != b[0]
    x, y = regular(10)
    rows = spark.createDataFrame([(1, x), (2, y), (3, x)], "doc_id bigint, text string")
    assert {tuple(r) for r in lines.dropped_lines(rows).collect()} == {(3, 0, 1, 0, 0)}
    for one in (ENC, bpe.Encoder(ENC.tokens)):
        ids, at = one.encode(pa.array([x, y, x + " " + y]))
        assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [OTHER.encode_ordinary(t) for t in (x, y, x + " " + y)]
    assert all(r.round_trip for r in bpe.encode_documents(rows).collect())


def test_equal_hashes_of_other_bytes_are_no_tokens(monkeypatch):
    """A pre-token that meets a token's hash but not its bytes is merged."""
    e = bpe.Encoder([bytes([i]) for i in range(256)] + [b"ab"])
    monkeypatch.setattr(bpe.PerfectHash, "find", lambda self, h: np.full(len(h), 256))
    ids, at = e.encode(pa.array(["ab", "cd"]))
    assert ids.tolist() == [256, 99, 100]


NAMES = ["__text", "__gone", "__doc", "__o", "__n", "__id", "__hash", "__nth", "__of", "nth", "of", "doc", "gone", "kept", "id", "hash", "number", "whole", "keys", "sketch", "n", "o", "bucket", "a.b"]


def test_columns_of_any_name_pass_through(spark):
    a, b, c = prose(1, 30), prose(2, 30), prose(3, 40)
    texts = [(1, a), (2, f"{a}\n{b}"), (3, b + "\nmore"), (4, c), (5, c + " again")]
    rows = spark.createDataFrame([(d, t, *(f"{n} {d}" for n in NAMES)) for d, t in texts], "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in NAMES))
    own = lambda r: [r[n] for n in NAMES] == [f"{n} {r['doc_id']}" for n in NAMES]
    kept = lines.dedup_lines(rows)
    assert kept.columns == rows.columns and all(map(own, kept.collect()))
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {(1, a), (2, b), (3, "more"), (4, c), (5, c + " again")}
    left = jaccard.near_dedup(rows)
    assert left.columns == rows.columns and all(map(own, left.collect()))
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in texts} - {d for d, g, _ in brute_groups(texts)[1] if d != g}
    items = spark.createDataFrame([(1, a)], "item_id bigint, text string")
    clean = decontaminate.decontaminate(rows, items)
    assert clean.columns == rows.columns and {r["doc_id"] for r in clean.collect()} == {3, 4, 5}


def test_many_lines_are_cut_in_proportion(spark):
    import time

    took = []
    for n in (4_000, 16_000):
        text = "\n".join(f"line number {i} of a long text {i * 7919}" for i in range(n))
        rows = spark.createDataFrame([(1, text), (2, text + "\nnew")], "doc_id bigint, text string")
        began = time.perf_counter()
        assert {r.doc_id: r.text for r in lines.dedup_lines(rows, lines.LineParams(edits=0)).collect()} == {1: text, 2: "new"}
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0]


def test_tables_are_deleted(spark):
    folder = store.shared_dir(spark)
    before = set(os.listdir(folder))
    rows = spark.createDataFrame([(i, prose(i % 7, 30)) for i in range(40)], "doc_id bigint, text string")
    with store.temporary(spark):
        assert jaccard.near_dedup(rows).count() == 7
        assert len(os.listdir(folder)) > len(before)
    assert set(os.listdir(folder)) == before
    assert store.fresh(rows, "text", "Doc_ID", "x", "X") == ("text_", "Doc_ID_", "x", "X_")

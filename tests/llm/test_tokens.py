"""Byte-level BPE and the training order: exact round trips, and another implementation's ids."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.edges import EDGES, docs, edge_docs, empty_docs, prose
from tritsift.llm import bpe, materialize
from tritsift.llm import text as tx

ENC = bpe.encoder()
OTHER = tiktoken.Encoding("other", pat_str=materialize.PATTERN, mergeable_ranks={t: i for i, t in enumerate(ENC.tokens)}, special_tokens={})


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab stmdlver'\"\n\t 0½é中 　!.\r"), st.characters(exclude_categories=["Cs"])), max_size=30), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_ids_and_round_trip(texts):
    ids, at = ENC.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [OTHER.encode_ordinary(t) for t in texts]
    back, to = ENC.decode(ids, at)
    assert [back[a:b].tobytes().decode() for a, b in zip(to, to[1:])] == texts


def test_perfect_hash():
    keys = tx.mix(np.arange(1, 5001, dtype=np.uint64))
    h = bpe.perfect_hash(keys)
    assert len(h.key) == 5000 and h.find(keys).tolist() == list(range(5000))
    assert (h.find(tx.mix(np.arange(9001, 12001, dtype=np.uint64))) == -1).all()


def test_heap_merges_match():
    rank = {t: i for i, t in enumerate(ENC.tokens)}
    r = random.Random(3)
    for _ in range(500):
        w = "".join(r.choice("etaoinshr") for _ in range(r.randrange(1, 30)))
        assert bpe.merge(w.encode(), rank) == OTHER.encode_ordinary(w)


@pytest.mark.parametrize("make", [edge_docs, empty_docs])
def test_documents(spark, make):
    d = make(spark)
    e = bpe.encode_documents(d)
    rows = e.collect()
    texts = EDGES if make is edge_docs else []
    want = collections.Counter((i, None if t is None else tuple(OTHER.encode_ordinary(t))) for i, t in texts)
    assert collections.Counter((r.doc_id, None if r.ids is None else tuple(r.ids)) for r in rows) == want
    assert all(r.round_trip and r.n_tokens == len(r.ids or ()) for r in rows)
    assert bpe.decode_documents(e).exceptAll(d.select("doc_id", "text")).count() == 0


def test_decoding_strangers(spark):
    rows = spark.createDataFrame([(1, [0, None, -5, 10**6, 1]), (2, []), (3, None), (4, [ENC.tokens.index("é".encode()[:1])])], "doc_id bigint, ids array<int>")
    got = {r.doc_id: r.text for r in bpe.decode_documents(rows).collect()}
    assert got == {1: (ENC.tokens[0] + ENC.tokens[1]).decode(), 2: "", 3: None, 4: "�"}


@given(st.integers(1, 3000), st.integers(0, 2**64 - 1))
@settings(max_examples=40, deadline=None)
def test_feistel_permutes(n, key):
    x = materialize.feistel(np.arange(n), n, key, 6)
    assert sorted(x.tolist()) == list(range(n))
    assert materialize.feistel(x, n, key, 6, inverse=True).tolist() == list(range(n))


def check_order(spark, texts, d, p, folder):
    rows = sorted(materialize.shards(d, p).collect())
    slots = {}
    for r in rows:
        a = np.frombuffer(r.payload, "<u2").reshape(r.n_sequences, p.seq_len)
        assert r.stride_bytes == 2 * p.seq_len and r.first_slot == r.shard * p.per_shard
        slots |= {r.first_slot + i: a[i] for i in range(r.n_sequences)}
    n = len(slots)
    assert sorted(slots) == list(range(n))
    order = materialize.feistel(np.arange(n), n, p.key, p.rounds)
    stream = np.concatenate([slots[int(s)] for s in order]) if n else np.zeros(0, np.uint16)
    eos, got, at = len(ENC.tokens), collections.Counter(), 0
    for end in np.flatnonzero(stream == eos):
        got[tuple(stream[at:end].tolist())] += 1
        at = end + 1
    want = collections.Counter(tuple(OTHER.encode_ordinary(t)) for _, t in texts if t is not None)
    fill = -(sum(len(k) + 1 for k in want.elements())) % p.seq_len
    want[()] += fill
    assert got == +want
    assert materialize.write_shards(materialize.shards(d, p), folder).count() == len(rows)
    if n > 5:
        assert (materialize.read_slots(folder, 2, n - 3, p) == np.stack([slots[s] for s in range(2, n - 1)])).all()
    return slots


def test_training_order(spark, tmp_path, monkeypatch):
    texts = [(i, prose(i, 5 + i % 90)) for i in range(120)]
    p = materialize.MaterializeParams(seq_len=32, per_shard=7)
    slots = check_order(spark, texts, docs(spark, texts), p, str(tmp_path / "a"))
    again = check_order(spark, texts, docs(spark, texts), p, str(tmp_path / "b"))
    assert all((slots[s] == again[s]).all() for s in slots)
    other = check_order(spark, texts, docs(spark, texts), materialize.MaterializeParams(seq_len=32, per_shard=7, key=5), str(tmp_path / "c"))
    assert any((slots[s] != other[s]).any() for s in slots)
    check_order(spark, EDGES, edge_docs(spark), materialize.MaterializeParams(seq_len=64, per_shard=50), str(tmp_path / "d"))
    assert materialize.shards(empty_docs(spark)).count() == 0


def test_the_order_is_one_of_the_data(spark):
    """Other splits and other numbers of buckets give the same bytes, which are those of a sort by hash."""
    from pyspark.sql import functions as F

    texts = [(i % 50, prose(i, 5 + i % 90)) for i in range(200)] + [(3, "same"), (3, "same"), (None, "same")]
    p = materialize.MaterializeParams(seq_len=32, per_shard=7)
    d = docs(spark, texts)
    made = []
    for rows, n in ((d, "4"), (d.repartition(9), "4"), (d.coalesce(1).orderBy("text"), "11"), (d.repartition(3), "1")):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        made.append({r.shard: bytes(r.payload) for r in materialize.shards(rows, p).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(m == made[0] for m in made)
    hashed = d.select("text", F.xxhash64("doc_id", "text").alias("h"), F.xxhash64("text", "doc_id").alias("g")).collect()
    eos, stream = len(ENC.tokens), []
    for r in sorted(hashed, key=lambda r: (r.h % (1 << 64), r.g % (1 << 64))):
        stream += [*OTHER.encode_ordinary(r.text), eos]
    n = -(-len(stream) // 32)
    stream += [eos] * (n * 32 - len(stream))
    whole = np.frombuffer(b"".join(made[0][s] for s in sorted(made[0])), "<u2").reshape(n, 32)
    slot = materialize.feistel(np.arange(n), n, p.key, p.rounds)
    assert (whole[slot].reshape(-1) == stream).all()


def test_freed_memory_goes_back():
    """A worker keeps nothing of what its batches needed."""
    from tritsift.llm import text as tx

    held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4 // 1024  # noqa: E731, SIM115
    parts = [np.ones(500) for _ in range(50_000)]  # 200 MB in small blocks
    full, top = held(), np.ones(500)
    del parts
    for _ in tx.slices(pa.record_batch({"text": pa.array(["one", "two"])})):
        pass
    assert full - held() > 120 and len(top)

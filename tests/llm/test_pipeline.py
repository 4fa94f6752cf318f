"""The pipeline against its stages by brute force, and the registered queries against SQL."""

import math
import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.edges import EDGES, edge_docs, empty_docs
from tests.llm.test_near import brute_groups
from tritsift.llm import bpe, catalog, decontaminate, jaccard, lines, materialize, quality
from tritsift.llm import text as tx

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables aren't here")


def brute(spark, sf_dir):
    """{doc_id: ids} by stages that are written anew, but for the classifier's fitted weights."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    model = quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {}
    for d, t in docs.items():
        idx, _ = quality.features(pa.array([t]), model.params)
        z = model.bias + sum(float(model.weights[j]) for j in idx.tolist()) / math.sqrt(max(len(idx), 1))
        if 1 / (1 + math.exp(-z)) >= model.params.threshold:
            kept[d] = t
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(kept), "text": list(kept.values())}))
    gone = {}
    for d, n, *_ in con.sql(lines.dropped_lines_sql()).fetchall():
        gone.setdefault(d, set()).add(n)
    left = {}
    for d, t in kept.items():
        s = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(d, ()))
        if d not in gone or s.strip():
            left[d] = s
    _, groups = brute_groups(list(left.items()))
    left = {d: t for d, t in left.items() if (d, d, True) in groups or d not in {g[0] for g in groups}}
    items = [tx.plain_words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {}
    for d, t in left.items():
        words = b" ".join(tx.plain_words(t))
        if not any(b" " + b" ".join(i) + b" " in b" " + words + b" " for i in items):
            clean[d] = t
    enc = tiktoken.Encoding("other", pat_str=materialize.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks())}, special_tokens={})
    return {d: enc.encode_ordinary(t) for d, t in clean.items()}


def test_pipeline(spark):
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == brute(spark, SMALL)
    assert 0 < len(got) < 200


@pytest.mark.parametrize("make", [edge_docs, empty_docs])
def test_stages_take_anything(spark, tmp_path, make):
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some item of the benchmark. its answer."), (None, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = made = make(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == made.columns and docs.schema["n_chars"].dataType == made.schema["n_chars"].dataType
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(out) <= len(EDGES) and (make is edge_docs) == bool(out)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SMALL)
    want = con.sql(catalog.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in df.columns]
    key = lambda r: tuple(str(round(x, 6)) if isinstance(x, float) else str(x) for x in r)
    assert sorted(key(r) for r in df.collect()) == sorted(key([r[i] for i in at]) for r in want.fetchall())


def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 11))


def test_leaks_on_the_tables(spark):
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    texts = {r.doc_id: b" " + b" ".join(tx.plain_words(r.text)) + b" " for r in docs.collect()}
    want = {(d, b.item_id) for b in bench.collect() for d, t in texts.items() if b" " + b" ".join(tx.plain_words(b.text)) + b" " in t}
    assert want and want <= got


def test_groups_cover_copies(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.collect()
    _, want = brute_groups([(r.doc_id, r.text) for r in rows])
    assert {tuple(r) for r in jaccard.near_groups(docs).collect()} == want
    assert np.array([r.n_chars for r in rows]).sum() > 0

"""The queries that tokenize, encode and search in batches: results against their SQL on odd tables, and what they move."""

import collections
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tritsift.functions import text as T
from tritsift.operators import batches as B
from tritsift.plans import catalog
from test_queries import value

DOCS, NAMES = 400, ["what_if", "cosine_overlap", "fusion_merge", "fusion_top1", "fusion_sum", "knn_lsh", "missing_link", "subquery_best", "explain_match", "index_stats", "ranking_metrics", "tier_recall", "composite_rerank", "query_audit", "exclude_inputs", "tier_weighted_merge", "scorecard_rollup", "filtered_topk", "superpose_docs", "salient_tokens", "knn_exact", "analogy", "token_and_gold"]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Documents of frequent words with a few rare ones, odd ones among them, and items of both."""
    rng, at = random.Random(3), str(tmp_path_factory.mktemp("made"))
    often = [f"w{i}" for i in range(300)]
    text = [" ".join(rng.choices(often, k=150) + [f"r{i % 97}", f"once{i}"]) for i in range(DOCS)]
    text[:9] = ["", "the a is", "W1_w2\tw3\r\nw4  w5", "É_é straße ÑANDÚ_ñu", "x" * 90 + " w7 w8", "x" * 90 + " w9", text[20], text[20], " ".join(f"only{i}" for i in range(40))]
    rows = [(i, t, ("en", "de", "fr")[i % 3], "src", len(t)) for i, t in enumerate(text)]
    items = [(i, " ".join(rng.choices(text[10 + i].split(), k=12))) for i in range(10)] + [(10, "w1 w2"), (11, "the"), (12, "Ñandú unheard")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def moved(spark, query, at) -> int:
    """Records that the query's shuffles write."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    query(spark, at).write.format("noop").mode("overwrite").save()
    return sum(n for i, n in stages().items() if i not in before)


def test_words_are_content_tokens(spark):
    """As Spark's own functions part and lower a text, which DuckDB doesn't for each letter."""
    texts = ["", " ", "_", "A_b\tCC\r\nDD  \u00a0EE\x0bff the x yy", "ΟΔΟΣ_ΟΔΟΣ\tΣΑΣ ΑΣ.Σ Σ_ΣΣ", "İstanbul ſſ KK ǅǅ", "the THE thE then"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in df.select(F.lower("text").alias("low"), F.array_distinct(T.content_tokens(F.col("text"))).alias("want")).collect():
        assert [t for t in dict.fromkeys(B.words(r.low)) if len(t) > 1 and t not in T.STOP_WORDS] == r.want


@pytest.mark.parametrize("name", NAMES)
def test_moves_few_tokens(spark, made, name):
    """A document has 120 different words and more; what is moved of it doesn't follow these."""
    assert moved(spark, entry.queries()[name], made) < 30 * DOCS


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("most", [0, 50, 200_000])
def test_matches_sql(spark, made, monkeypatch, name, most):
    """Whatever share of the tokens the tasks hold, and with queries in several passes."""
    monkeypatch.setattr(B, "COMMON", most)
    monkeypatch.setattr(B, "QUERIES", 5)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{made}/{t}.parquet/*.parquet'")
    df, want = entry.queries()[name](spark, made), con.sql(catalog.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in df.columns]
    assert collections.Counter(tuple(map(value, r)) for r in df.collect()) == collections.Counter(tuple(value(r[i]) for i in at) for r in want.fetchall())


@pytest.fixture(scope="module")
def triples(spark, tmp_path_factory):
    """Keys that share a shard, customers with one order and several, null keys, and a relation without keys."""
    at, rng = str(tmp_path_factory.mktemp("keys")), random.Random(5)
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{at}/{name}.parquet")
    write("orders", [(i, rng.randrange(900)) for i in range(1200)] + [(5000, None)], "o_orderkey bigint, o_custkey bigint")
    write("customer", [(i, i % 25) for i in range(900)], "c_custkey bigint, c_nationkey int")
    write("supplier", [(i, i % 25) for i in range(50)] + [(None, 1)], "s_suppkey bigint, s_nationkey int")
    write("nation", [(i, i % 5) for i in range(25)], "n_nationkey int, n_regionkey int")
    write("part", [], "p_partkey bigint, p_brand string")
    return at


KEYED = ["geometry_sweep", "triple_lookup"]


@pytest.mark.parametrize("name", KEYED)
def test_lookup_matches_sql(spark, triples, name):
    con = duckdb.connect()
    for t in ("orders", "customer", "supplier", "nation", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{triples}/{t}.parquet/*.parquet'")
    df, want = entry.queries()[name](spark, triples), con.sql(catalog.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in df.columns]
    got = collections.Counter(tuple(map(value, r)) for r in df.collect())
    assert got and got == collections.Counter(tuple(value(r[i]) for i in at) for r in want.fetchall())


def widest(spark, query, at) -> int:
    """The most rows that an operator of the query's plans gives out."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    query(spark, at).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    most, found = 0, store.executionsList()
    for i in range(before, found.size()):
        run = found.apply(i).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for metrics in (nodes.apply(j).metrics() for j in range(nodes.size())):
            for m in (metrics.apply(j) for j in range(metrics.size())):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


@pytest.mark.parametrize("name", KEYED)
def test_lookup_makes_no_row_for_a_position(spark, triples, name):
    """Of about 1,600 keys and 2,200 triples, neither positions nor pairs become rows."""
    assert 0 < widest(spark, entry.queries()[name], triples) < 5_000


@pytest.mark.parametrize("name", NAMES)
def test_chooses_tokens_once(spark, made, name):
    """No second branch of the plan chooses, encodes and searches the documents again."""
    plan = entry.queries()[name](spark, made)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("MapInArrow" in line and "pos#" in line for line in plan.splitlines()) <= 1

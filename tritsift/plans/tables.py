"""The driver's tables read as the engine's inputs, with the same views for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tritsift.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _atom(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, relation, object) of orders, customers, nations, suppliers and parts."""
    t = lambda n: table(spark, sf_dir, n)
    row = lambda df, s, r, o: df.select(s.alias("subject"), F.lit(r).alias("relation"), o.alias("object"))
    return (
        row(t("orders"), _atom("customer_", "o_custkey"), "placed_order", _atom("order_", "o_orderkey"))
        .union(row(t("customer"), _atom("customer_", "c_custkey"), "from_nation", _atom("nation_", "c_nationkey")))
        .union(row(t("supplier"), _atom("supplier_", "s_suppkey"), "from_nation", _atom("nation_", "s_nationkey")))
        .union(row(t("nation"), _atom("nation_", "n_nationkey"), "in_region", _atom("region_", "n_regionkey")))
        .union(row(t("part"), _atom("part_", "p_partkey"), "has_brand", F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))))
    )


TRIPLES = """(SELECT 'customer_' || o_custkey AS subject, 'placed_order' AS relation, 'order_' || o_orderkey AS object FROM orders
UNION ALL SELECT 'customer_' || c_custkey, 'from_nation', 'nation_' || c_nationkey FROM customer
UNION ALL SELECT 'supplier_' || s_suppkey, 'from_nation', 'nation_' || s_nationkey FROM supplier
UNION ALL SELECT 'nation_' || n_nationkey, 'in_region', 'region_' || n_regionkey FROM nation
UNION ALL SELECT 'part_' || p_partkey, 'has_brand', lower(replace(p_brand, '#', '_')) FROM part)"""


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, token, pos): each document's content tokens at their first place."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.array_distinct(T.content_tokens(F.col("text")))).alias("pos", "token"))


def item_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.explode(F.array_distinct(T.content_tokens(F.col("text")))).alias("token"))


STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


def raw_sql(x: str) -> str:
    return rf"list_filter(string_split_regex(lower(replace({x}, '_', ' ')), '[ \t\r\n]+'), lambda t: t <> '')"


def tokens_sql(x: str) -> str:
    return f"list_filter({raw_sql(x)}, lambda t: length(t) > 1 AND NOT list_contains({STOP}, t))"


def unnested(key: str, name: str, source: str, x: str = "text") -> str:
    """Distinct tokens with the place where each first stands."""
    return f"(SELECT {key} AS {name}, token, min(pos) AS pos FROM (SELECT {key}, unnest(ts) AS token, unnest(range(len(ts))) AS pos FROM (SELECT {key}, {tokens_sql(x)} AS ts FROM {source})) GROUP BY ALL)"


def draws_sql(source: str, key: str, dim: int, k: int, seed: str = "s0") -> str:
    return f"(SELECT {key}, ((v // 2) % {dim})::INT AS idx, CASE WHEN v % 2 = 1 THEN 1 ELSE -1 END AS sgn FROM (SELECT {key}, ('0x' || substring(md5('{seed}|' || token || '|' || j), 8 * g + 1, 8))::BIGINT AS v FROM {source}, (SELECT unnest(range({k // 4})) AS j), (SELECT unnest(range(4)) AS g)))"


def superpose_sql(source: str, key: str, k: int | None) -> str:
    cut = f"WHERE r <= {k}" if k else ""
    return f"(SELECT {key}, idx, sign(w)::INT AS sgn FROM (SELECT {key}, idx, w, row_number() OVER (PARTITION BY {key} ORDER BY abs(w) DESC, idx) AS r FROM (SELECT {key}, idx, sum(sgn) AS w FROM {source} GROUP BY ALL HAVING sum(sgn) <> 0)) {cut})"


def salient_sql(source: str, key: str, budget: int) -> str:
    return f"(SELECT {key}, token, pos, df FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY df, pos) AS r FROM (SELECT *, count(*) OVER (PARTITION BY token) AS df FROM {source})) WHERE r <= {budget})"


def dots_sql(a: str, b: str, a_key: str, b_key: str) -> str:
    return f"(SELECT a.{a_key}, b.{b_key}, sum(a.sgn * b.sgn)::BIGINT AS dot FROM {a} a JOIN {b} b ON a.idx = b.idx GROUP BY ALL)"


def top_sql(source: str, query: str, score: str, tie: str, k: int) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {query} ORDER BY {score} DESC, {tie})::INT AS rank FROM {source}) WHERE rank <= {k})"

"""Queries of single operators: stems, roles, filters, boosts, exclusions, labels and shares by tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tritsift.functions import text as T
from tritsift.operators import evaluate as E
from tritsift.operators import search as S
from tritsift.operators import structure as R
from tritsift.plans import catalog as C
from tritsift.plans.catalog import query
from tritsift.plans.tables import doc_tokens, item_tokens, table, tokens_sql, top_sql, unnested

_STEM = "CASE WHEN length(token) <= 4 THEN token " + " ".join(f"WHEN ends_with(token, '{s}') AND length(token) >= {3 + len(s) - len(to)} THEN left(token, length(token) - {len(s)}) || '{to}'" for s, to in T.SUFFIXES) + " ELSE token END"


@query(f"SELECT token, {_STEM} AS stem, count(*) AS df FROM {unnested('doc_id', 'doc_id', 'documents')} GROUP BY token")
def stem_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of the documents and its stem."""
    return doc_tokens(spark, sf_dir).groupBy("token").agg(F.count("*").alias("df")).select("token", T.stem(F.col("token")).alias("stem"), "df")


@query(f"WITH w AS (SELECT source, {tokens_sql('text')} AS ts FROM documents), c AS (SELECT source, unnest(list_distinct({C._canonical_sql('ts')})) AS token FROM w), n AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT source, token, count(*) AS df, round(ln(any_value(n) / count(*)), 6) AS idf FROM c JOIN n USING (source) GROUP BY source, token")
def shard_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of canonical tokens within each shard; the source stands for the shard."""
    docs = table(spark, sf_dir, "documents")
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    df = docs.select("source", F.explode(T.canonical(T.content_tokens(F.col("text")))).alias("token")).groupBy("source", "token").agg(F.count("*").alias("df"))
    return df.join(n, "source").select("source", "token", "df", F.round(F.log(F.col("n") / F.col("df")), 6).alias("idf"))


@query(f"SELECT lang, len(vs) AS n, vs[round_even(0.99::DOUBLE * (len(vs) - 1), 0)::BIGINT + 1] AS at_q FROM (SELECT lang, list_sort(list(len({tokens_sql('text')})::INT)) AS vs FROM documents GROUP BY lang)")
def sorted_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 99th percentile of document lengths as a place in the sorted list."""
    rows = table(spark, sf_dir, "documents").select("lang", F.size(T.content_tokens(F.col("text"))).alias("v"))
    return E.sorted_index(rows, "lang", "v", 0.99)


@query(f"{C.VECTORS}, h AS {C.HITS}, {C._GOLD}, e AS (SELECT qid, min(doc_id) AS doc_id, max(CASE WHEN rank IS NULL THEN 0 ELSE 1 END) AS hit FROM g LEFT JOIN h USING (qid, doc_id) GROUP BY qid), p AS (SELECT coalesce(lang, 'unknown') AS tier, count(*) AS n, avg(hit) AS recall FROM e LEFT JOIN documents USING (doc_id) GROUP BY ALL) SELECT tier, n, round(recall, 6) AS recall, round(min(recall) OVER (), 6) AS worst, round(avg(recall) OVER (), 6) AS mean FROM p")
def tier_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall by the tier of each item's first gold document; the language stands for the tier."""
    tiers = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("tier"))
    return E.tier_recall(C.knn_exact(spark, sf_dir), C._gold(spark, sf_dir), tiers, "qid", "doc_id")


_ROLES = f"(SELECT conv_id, turn, {tokens_sql('role')} AS s, {tokens_sql('given')} AS r, {tokens_sql('object')} AS o FROM (SELECT *, CASE WHEN turn % 3 = 0 THEN 'said' ELSE '' END AS given, CASE WHEN turn % 2 <> 0 AND turn % 5 = 0 THEN 'the' ELSE text END AS object FROM conversations))"


@query(f"SELECT conv_id, turn, (CASE WHEN len(s) > 0 THEN 's' ELSE '' END) || (CASE WHEN len(r) > 0 THEN 'r' ELSE '' END) || (CASE WHEN len(o) > 0 THEN 'o' ELSE '' END) AS partial, len(o)::INT AS object_tokens FROM {_ROLES}")
def partial_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which roles of a turn have tokens; some turns are given a relation, an empty object or one of a stop word, so that all cases show."""
    obj = F.when(F.col("turn") % 2 == 0, "").when(F.col("turn") % 5 == 0, "the")
    roles = T.role_tokens(F.col("role"), F.when(F.col("turn") % 3 == 0, "said"), obj, F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", roles.alias("x")).select("conv_id", "turn", F.array_join("x.partial", "").alias("partial"), F.size("x.o").alias("object_tokens"))


@query("SELECT conv_id, turn, concat_ws('|', 'role=' || role, 'text=' || text) AS rest FROM conversations")
def passthrough_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two named columns and whatever else a turn has."""
    rows = R.passthrough(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])
    pairs = F.transform(F.sort_array(F.map_entries("rest")), lambda e: F.concat(e.key, F.lit("="), e.value))
    return rows.select("conv_id", "turn", F.array_join(pairs, "|").alias("rest"))


@query("SELECT 'two' AS wanted, vec_id FROM embeddings WHERE label IN (1, 3) UNION ALL SELECT 'all', vec_id FROM embeddings")
def shard_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two shards, and of all, as no shard named means."""
    rows = table(spark, sf_dir, "embeddings")
    return S.in_set(rows, "label", (1, 3)).select(F.lit("two").alias("wanted"), "vec_id").union(S.in_set(rows, "label").select(F.lit("all"), "vec_id"))


@query(f"{C.VECTORS} SELECT qid, doc_id, dot, lang AS tier FROM {C.HITS} JOIN documents USING (doc_id) WHERE lang IN ('en', 'de')")
def tier_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in a set of tiers; the language stands for the tier."""
    tiers = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("tier"))
    return C.knn_exact(spark, sf_dir).join(S.in_set(tiers, "tier", ("en", "de")), "doc_id").select("qid", "doc_id", "dot", "tier")


@query(f"{C.VECTORS} SELECT qid, doc_id, dot FROM {C.HITS} ORDER BY dot DESC, qid, doc_id LIMIT 100")
def global_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the hundred best hits of all items."""
    return S.best_overall(C.knn_exact(spark, sf_dir).select("qid", "doc_id", "dot"), 100, "dot", "qid", "doc_id")


_OTHERS = "(SELECT q.qid, d.doc_id, sum(q.sgn * d.sgn)::BIGINT AS dot FROM q JOIN d ON q.idx = d.idx WHERE d.doc_id NOT IN (q.qid, q.qid + 1) GROUP BY ALL)"


@query(f"{C.VECTORS} SELECT * FROM {top_sql(_OTHERS, 'qid', 'dot', 'doc_id', C.TOP)}")
def exclude_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits without two documents that count as the item's own, the search giving two more for them."""
    hits = C.doc_hits(spark, sf_dir, C.TOP + 2).select("qid", "doc_id", "dot", "rank")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    own = items.select("qid", F.explode(F.array(F.col("qid"), F.col("qid") + 1)).alias("doc_id"))
    return S.without_inputs(hits, own, "qid", "doc_id", "dot", C.TOP)


@query(f"WITH t AS {unnested('doc_id', 'doc_id', 'documents')}, n AS (SELECT count(*) AS n FROM documents), w AS (SELECT token, ln(any_value(n) / count(*)) AS idf FROM t, n GROUP BY token), b AS (SELECT DISTINCT token FROM {unnested('item_id', 'qid', 'benchmark')}) SELECT token, round(idf * CASE WHEN b.token IS NULL THEN 1 ELSE 3 END, 5) AS idf FROM w LEFT JOIN b USING (token)")
def boosted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of tokens, those of the benchmark's own terms three times as large."""
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))  # one row
    weights = doc_tokens(spark, sf_dir).groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("token", F.log(F.col("n") / F.col("df")).alias("idf"))
    return S.boosted(weights, item_tokens(spark, sf_dir)).select("token", F.round("idf", 5).alias("idf"))


_ALIASES = {"genes": {"part_1": "P1", "part_2": "P2"}, "medical": {"part3": "P3"}, "graph": {"Part-4": "Q4"}}
_NAMED = "(SELECT p_partkey, ['genes', 'medical', 'graph', 'other'][(p_partkey % 4 + 1)::INT] AS domain, 'Part-' || (p_partkey % 5) || ['', ' Gene', 's'][(p_partkey % 3 + 1)::INT] AS entity FROM part)"


@query(f"""WITH x AS {_NAMED}, y AS (SELECT *, replace(lower(entity), ' ', '_') AS plain, replace(replace(lower(trim(entity)), ' ', '_'), '-', '_') AS g, regexp_replace(replace(lower(trim(entity)), ' ', '_'), '[^a-z0-9_]', '', 'g') AS m FROM x)
SELECT p_partkey, domain, entity, CASE domain WHEN 'genes' THEN CASE WHEN g IN ('part_1', 'part_1_gene') THEN 'P1' WHEN g IN ('part_2', 'part_2_gene') THEN 'P2' ELSE plain END WHEN 'medical' THEN CASE WHEN m IN ('part3', 'part3s') THEN 'P3' ELSE m END WHEN 'graph' THEN CASE WHEN trim(entity) = 'Part-4' THEN 'Q4' ELSE plain END ELSE plain END AS label FROM y""")
def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels made from the parts' numbers, written as four domains write them."""
    key = F.col("p_partkey")
    domain = F.element_at(F.array(*map(F.lit, ("genes", "medical", "graph", "other"))), (key % 4 + 1).cast("int"))
    entity = F.concat(F.lit("Part-"), (key % 5).cast("string"), F.element_at(F.array(*map(F.lit, ("", " Gene", "s"))), (key % 3 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", domain.alias("domain"), entity.alias("entity")).withColumn("label", R.normalize_label(F.col("domain"), F.col("entity"), _ALIASES))

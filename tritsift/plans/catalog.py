"""The engine's queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tritsift.functions import geometry as G
from tritsift.functions import text as T
from tritsift.operators import batches as B
from tritsift.operators import evaluate as E
from tritsift.operators import extract as X
from tritsift.operators import search as S
from tritsift.operators import vectors as V
from tritsift.plans.tables import STOP, TRIPLES, doc_tokens, dots_sql, draws_sql, item_tokens, raw_sql, salient_sql, superpose_sql, table, tokens_sql, top_sql, triples, unnested

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Geometry of the document vectors: dimension, positions of a token and of a vector, salient tokens, hits.
DIM, K, BUDGET, TOP = 1024, 32, G.salient_budget(32), 10


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def packed_docs(spark: SparkSession, sf_dir: str, seeds: tuple[str, ...] = ("s0",)) -> DataFrame:
    """(doc_id, seed, codes): the documents' vectors as ``batches`` packs them."""
    return B.encode(B.salient(table(spark, sf_dir, "documents"), "doc_id", BUDGET), "doc_id", DIM, K, seeds)


def doc_vectors(spark: SparkSession, sf_dir: str, seed: str = "s0") -> DataFrame:
    return B.unpack(packed_docs(spark, sf_dir, (seed,)), "doc_id")


def doc_hits(spark: SparkSession, sf_dir: str, k: int = TOP) -> DataFrame:
    """(qid, doc_id, dot, codes, rank): each item's best documents, with their packed vectors, so that what follows needn't encode them again."""
    return B.search(item_vectors(spark, sf_dir), packed_docs(spark, sf_dir), DIM, k, "qid", "doc_id")


def item_vectors(spark: SparkSession, sf_dir: str, seed: str = "s0") -> DataFrame:
    return V.encode_bag(item_tokens(spark, sf_dir), "qid", "token", DIM, K, seed)


def _doc_sql(seed: str = "s0") -> str:
    return superpose_sql(draws_sql(salient_sql(unnested("doc_id", "doc_id", "documents"), "doc_id", BUDGET), "doc_id", DIM, K, seed), "doc_id", K)


def _item_sql(seed: str = "s0") -> str:
    return superpose_sql(draws_sql(unnested("item_id", "qid", "benchmark"), "qid", DIM, K, seed), "qid", K)


VECTORS = f"WITH d AS MATERIALIZED {_doc_sql()}, q AS MATERIALIZED {_item_sql()}"
HITS = top_sql(dots_sql("q", "d", "qid", "doc_id"), "qid", "dot", "doc_id", TOP)


# --- triples ---------------------------------------------------------------


#: Distinct keys in their shards, as search.keyed gives them.
KEYED = f"(SELECT *, ('0x' || substring(md5(subject), 1, 15))::BIGINT % (greatest(1, ceil(count(*) OVER () / 64)))::BIGINT AS shard FROM (SELECT relation, subject, count(*) AS n, min(object) AS object FROM {TRIPLES} GROUP BY ALL))"


def _lookup_sql(dim: int, k: int) -> str:
    """Products of whole key vectors, position by position."""
    kv = superpose_sql(draws_sql("(SELECT id, unnest([subject, relation]) AS token FROM kd)", "id", dim, k), "id", None)
    return f"(SELECT id, vec, dot FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dot DESC, name) AS r FROM (SELECT x.id, y.id AS vec, y.subject AS name, sum(a.sgn * b.sgn)::BIGINT AS dot FROM kd x JOIN kd y ON x.relation = y.relation AND x.shard = y.shard JOIN {kv} a ON a.id = x.id JOIN {kv} b ON b.id = y.id AND b.idx = a.idx WHERE x.n = 1 GROUP BY ALL)) WHERE r = 1)"


@query(f"WITH kd AS MATERIALIZED (SELECT *, relation || '|' || subject AS id FROM {KEYED}), h AS {_lookup_sql(512, 16)} SELECT x.subject, x.relation, y.object, dot FROM h JOIN kd x USING (id) JOIN kd y ON y.id = h.vec")
def triple_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unique (subject, relation) is asked for its object: encoded as the index of all keys encodes it, searched in the shard that its route gives, enriched after the cut."""
    return B.lookup(S.keyed(triples(spark, sf_dir)), 512, 16).select("subject", "relation", "object", "dot")


@query(f"WITH t AS {TRIPLES} SELECT relation, count(*) AS triples, count(DISTINCT subject) AS subjects, round(avg(n), 6) AS avg_objects, max(n) AS max_objects FROM (SELECT subject, relation, count(*) OVER (PARTITION BY relation, subject) AS n FROM t) GROUP BY relation")
def relation_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = triples(spark, sf_dir).groupBy("relation", "subject").agg(F.count("*").alias("n"))
    return per.groupBy("relation").agg(F.sum("n").alias("triples"), F.count("*").alias("subjects"), F.round(F.sum(F.col("n") * F.col("n")) / F.sum("n"), 6).alias("avg_objects"), F.max("n").alias("max_objects"))


@query(f"WITH t AS {TRIPLES} SELECT n AS multiplicity, count(*) AS keys FROM (SELECT count(*) AS n FROM t GROUP BY subject, relation) GROUP BY n")
def key_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples(spark, sf_dir).groupBy("subject", "relation").agg(F.count("*").alias("multiplicity")).groupBy("multiplicity").agg(F.count("*").alias("keys"))


@query(f"WITH t AS {TRIPLES} SELECT DISTINCT a.subject, a.relation AS first, a.object AS middle, b.relation AS second, b.object FROM t a JOIN t b ON a.object = b.subject")
def two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.two_hop(triples(spark, sf_dir))


_NEXT = "(SELECT relation, subject, object, split_part(subject, '_', 1) AS kind, split_part(subject, '_', 2)::BIGINT AS no FROM (SELECT relation, subject, count(*) AS n, min(object) AS object FROM t GROUP BY ALL) WHERE n = 1)"


@query(f"WITH t AS {TRIPLES}, k AS {_NEXT} SELECT a.subject AS subject_a, b.subject AS subject_b, a.relation, a.object AS object_a, b.object AS object_b, a.object = b.object AS same FROM k a JOIN k b ON b.relation = a.relation AND b.kind = a.kind AND b.no = a.no + 1")
def compare_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity with a unique key and the next one of its kind, compared by two independent lookups of one relation; both must be found."""
    keys = triples(spark, sf_dir).groupBy("relation", "subject").agg(F.count("*").alias("n"), F.min("object").alias("object")).where("n = 1")
    at = keys.select("relation", "subject", "object", F.split_part("subject", F.lit("_"), F.lit(1)).alias("kind"), F.split_part("subject", F.lit("_"), F.lit(2)).cast("bigint").alias("no"))
    a = at.select("relation", "kind", "no", F.col("subject").alias("subject_a"), F.col("object").alias("object_a"))
    b = at.select("relation", "kind", (F.col("no") - 1).alias("no"), F.col("subject").alias("subject_b"), F.col("object").alias("object_b"))
    return a.join(b, ["relation", "kind", "no"]).select("subject_a", "subject_b", "relation", "object_a", "object_b", (F.col("object_a") == F.col("object_b")).alias("same"))


@query(f"WITH t AS {TRIPLES} SELECT object, relation, count(*) AS subjects, min(subject) AS first_subject FROM t GROUP BY object, relation")
def reverse_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inverse index keyed (object, relation): an extension, which reverse verification needs."""
    return triples(spark, sf_dir).groupBy("object", "relation").agg(F.count("*").alias("subjects"), F.min("subject").alias("first_subject"))


@query(f"""WITH t AS {TRIPLES} SELECT relation, count(*) AS n, count(DISTINCT (('0x' || substring(md5(subject), 1, 15))::BIGINT % 36)) AS shards, max(c)::BIGINT AS largest FROM (SELECT *, count(*) OVER (PARTITION BY relation, ('0x' || substring(md5(subject), 1, 15))::BIGINT % 36) AS c FROM t) GROUP BY relation""")
def route_two_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards that the two-tier route fills: entity bucket by content hash, action by relation."""
    per = triples(spark, sf_dir).groupBy("relation", T.bucket(F.col("subject"), 36).alias("b")).agg(F.count("*").alias("c"))
    return per.groupBy("relation").agg(F.sum("c").alias("n"), F.count("*").alias("shards"), F.max("c").alias("largest"))


# --- text ------------------------------------------------------------------


@query(f"WITH t AS {unnested('doc_id', 'doc_id', 'documents')}, n AS (SELECT count(*) AS n FROM documents) SELECT token, count(*) AS df, round(ln(any_value(n) / count(*)), 6) AS idf FROM t, n GROUP BY token")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))  # one row
    return doc_tokens(spark, sf_dir).groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("token", "df", F.round(F.log(F.col("n") / F.col("df")), 6).alias("idf"))


_ACRONYM_SQL = "MAP {" + ", ".join(f"'{a}': {full.split()}" for a, full in T.ACRONYMS.items()) + "}"
_BASE = "lambda t: regexp_replace(regexp_replace(t, '^(.+)''s$', '\\1'), '^(.+)s''$', '\\1s')"


def _first_places(x: str) -> str:
    """DuckDB's list_distinct keeps no order."""
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


def _canonical_sql(x: str, possessive: bool = True, acronym: bool = True) -> str:
    out = f"list_transform({x}, {_BASE})" if possessive else x
    return f"flatten(list_transform({out}, lambda t: coalesce({_ACRONYM_SQL}[t], [t])))" if acronym else out


@query(f"WITH w AS (SELECT conv_id, turn, {tokens_sql('text')} AS ts FROM conversations), c AS (SELECT conv_id, turn, {_canonical_sql('ts')} AS cs FROM w) SELECT conv_id, turn, array_to_string({_first_places('cs')}, ' ') AS tokens FROM c")
def canonical_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.canonical(T.content_tokens(F.col("text"))), " ").alias("tokens"))


@query(f"""WITH w AS (SELECT item_id, {tokens_sql("'the analyst''s ML notes on ' || text")} AS ts FROM benchmark),
v AS (SELECT item_id, '' AS axes, {_canonical_sql('ts')} AS cs FROM w UNION ALL SELECT item_id, 'possessive', {_canonical_sql('ts', False)} FROM w UNION ALL SELECT item_id, 'acronym', {_canonical_sql('ts', True, False)} FROM w UNION ALL SELECT item_id, 'possessive,acronym', ts FROM w)
SELECT item_id, axes, array_to_string({_first_places('cs')}, ' ') AS tokens FROM v""")
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item asked with a possessive and an acronym, so that all axes show."""
    asked = F.concat(F.lit("the analyst's ML notes on "), F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.query_variants(asked)).alias("v")).select("item_id", "v.axes", F.array_join("v.tokens", " ").alias("tokens"))


@query(f"SELECT doc_id, token, df FROM {salient_sql(unnested('doc_id', 'doc_id', 'documents'), 'doc_id', BUDGET)}")
def salient_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.salient(table(spark, sf_dir, "documents"), "doc_id", BUDGET).select("doc_id", "token", "df")


@query(r"""SELECT conv_id, turn, CASE WHEN length(trim(role)) > 0 AND turn % 3 = 0 AND trim(text) <> '' THEN 1 WHEN length(trim(text)) >= 8 THEN 2 ELSE 3 END AS tier FROM conversations""")
def tier_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third turn carries a relation, so that all rules show."""
    relation = F.when(F.col("turn") % 3 == 0, "said")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.tier(F.lit(None).cast("int"), F.col("role"), relation, F.lit(None).cast("string"), F.col("text")).alias("tier"))


@query(r"""SELECT conv_id, turn, coalesce(nullif(trim(role), ''), 'unknown') AS subject, 'chat_' || (turn % 6) AS relation, left(trim(text), 1000) AS object, regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS slug FROM conversations WHERE length(trim(text)) >= 10""")
def message_to_triple(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.trim("text")
    rows = table(spark, sf_dir, "conversations").where(F.length(body) >= 10)
    return rows.select("conv_id", "turn", F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.lit("unknown")).alias("subject"), F.concat(F.lit("chat_"), (F.col("turn") % 6).cast("string")).alias("relation"), F.substring(body, 1, 1000).alias("object"), T.slug(body).alias("slug"))


@query("SELECT text, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each text, by an aggregate and not a window, so that copies are dropped before the shuffle."""
    return table(spark, sf_dir, "documents").groupBy("text").agg(F.min(F.struct("doc_id", "source")).alias("m")).select("text", "m.doc_id", "m.source")


@query(r"""SELECT doc_id, regexp_replace(regexp_extract(text, '^[^.!?\n]*', 0), '[^\x00-\x7F]', '', 'g') AS sentence FROM documents WHERE length(regexp_replace(regexp_extract(text, '^[^.!?\n]*', 0), '[^\x00-\x7F]', '', 'g')) BETWEEN 20 AND 400""")
def first_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.ascii_only(F.regexp_extract("text", "^[^.!?\n]*", 0))
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("sentence")).where(F.length("sentence").between(20, 400))


@query("SELECT event_id, epoch_us(ts) // 1000 AS millis, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS iso FROM events")
def iso_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times to milliseconds and back to text."""
    millis = T.iso_to_millis(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    return table(spark, sf_dir, "events").select("event_id", millis.alias("millis"), T.millis_to_iso(millis).alias("iso"))


@query(r"SELECT page_id, regexp_replace(lower(trim(url)), '[ /.]', '_', 'g') AS token, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.code_token(F.col("url")).alias("token"), F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), T.SPACES, " ")).alias("text"))


@query("SELECT seed, vec_id FROM (SELECT 0 AS seed, vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('0|' || vec_id), vec_id) AS r FROM embeddings) WHERE r <= 5")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: five of each stratum in the order of a seeded hash."""
    by = Window.partitionBy("label").orderBy(F.md5(F.concat_ws("|", F.lit("0"), F.col("vec_id").cast("string")).cast("binary")), "vec_id")
    return table(spark, sf_dir, "embeddings").withColumn("r", F.row_number().over(by)).where("r <= 5").select(F.lit(0).alias("seed"), "vec_id")


# --- extraction ------------------------------------------------------------

_SENT = r"""s AS (SELECT conv_id, turn, sent, sentence FROM (SELECT conv_id, turn, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\r\n]+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '(^[ .,;\t\r\n]+)|([ .,;\t\r\n]+$)', '', 'g')), lambda x: x <> '')) AS sentence, generate_subscripts(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\r\n]+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '(^[ .,;\t\r\n]+)|([ .,;\t\r\n]+$)', '', 'g')), lambda x: x <> ''), 1)::INT - 1 AS sent FROM conversations))"""
_SLUG = "array_to_string(regexp_extract_all(lower({0}), '[a-z0-9]+'), '_')"


def _facts_sql(patterns: tuple) -> str:
    parts = []
    for p in patterns:
        at = lambda g: _SLUG.format(f"regexp_extract(x, '{p[1].replace(chr(39), chr(39) * 2)}', {g})") if isinstance(g, int) else f"'{g}'"  # noqa: B023, E731
        s, r, o = (at(g) for g in p[2])
        parts.append(f"SELECT conv_id, turn, sent, {s} AS subject, {r} AS relation, regexp_replace({o}, '(_(at|and|by|for|home|in|of|on|people|persons|to|with))+$', '') AS object FROM y")
    wh = "['" + "', '".join(("how", "what", "when", "where", "which", "who", "whom", "whose", "why")) + "']"
    bad = " OR ".join(f"list_has_any(string_split({c}, '_'), {wh})" for c in ("subject", "relation", "object"))
    return f"(SELECT DISTINCT * FROM ({' UNION ALL '.join(parts)}) WHERE subject <> '' AND relation <> '' AND object <> '' AND NOT ({bad}))"


_GATE = rf"""WITH {_SENT}, y AS (SELECT *, trim(regexp_replace(lower(sentence), '[.;:"\t\r\n]', ' ', 'g')) AS x FROM s), a AS {_facts_sql(X.PATTERNS)}, b AS {_facts_sql(X.SECOND)},
j AS (SELECT conv_id, turn, sent, subject, relation, a.object, b.object AS other, coalesce(starts_with(a.object, b.object) OR starts_with(b.object, a.object), false) AS ok FROM a FULL JOIN b USING (conv_id, turn, sent, subject, relation)),
g AS (SELECT conv_id, turn, sent, subject, relation, object, CASE WHEN bool_or(ok) THEN 0.95 ELSE 0.65 END::DOUBLE AS confidence, bool_or(ok) AS agreed FROM j WHERE object IS NOT NULL GROUP BY ALL
UNION ALL SELECT conv_id, turn, sent, subject, relation, other, 0.6::DOUBLE, false FROM j WHERE other IS NOT NULL GROUP BY ALL HAVING NOT bool_or(ok))"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sentence_rows(table(spark, sf_dir, "conversations").withColumn("key", F.struct("conv_id", "turn")), "key")


@query(f"{_GATE} SELECT * FROM g")
def gate_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.gate(_turns(spark, sf_dir), "key").select("key.conv_id", "key.turn", "sent", "subject", "relation", "object", "confidence", "agreed")


@query(f"{_GATE}, f AS (SELECT conv_id, turn, sent, min(subject) AS subject FROM g WHERE agreed GROUP BY ALL) SELECT conv_id, turn, sent, last_value(subject IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY sent ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM s LEFT JOIN f USING (conv_id, turn, sent)")
def anchored_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir)
    return X.anchors(rows, X.gate(rows, "key"), "key").select("key.conv_id", "key.turn", "sent", "anchor")


# --- vectors and search ----------------------------------------------------


@query(f"WITH d AS {_doc_sql()} SELECT * FROM d")
def superpose_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_vectors(spark, sf_dir)


@query(f"{VECTORS} SELECT qid, doc_id, dot, rank FROM {HITS}")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_hits(spark, sf_dir).select("qid", "doc_id", "dot", "rank")


def _lsh_sql(source: str, key: str, tables: int, bits: int) -> str:
    total = " + ".join(f"CASE WHEN sum(sgn * CASE WHEN (h >> {b}) & 1 = 1 THEN 1 ELSE -1 END) >= 0 THEN {1 << b} ELSE 0 END" for b in range(bits))
    return f"(SELECT {key}, tab, ({total})::INT AS bucket FROM (SELECT {key}, sgn, tab, ('0x' || substring(md5('plane|' || tab || '|' || idx), 1, 8))::BIGINT AS h FROM {source}, (SELECT unnest(range({tables}))::INT AS tab)) GROUP BY {key}, tab)"


_FLIPS = "[bucket, " + ", ".join(f"xor(bucket, {1 << b})" for b in range(8)) + "]"


@query(f"{VECTORS}, p AS (SELECT qid, tab, unnest({_FLIPS}) AS bucket FROM {_lsh_sql('q', 'qid', 8, 8)}), c AS (SELECT DISTINCT qid, doc_id FROM p JOIN {_lsh_sql('d', 'doc_id', 8, 8)} USING (tab, bucket)), x AS (SELECT c.qid, c.doc_id, sum(q.sgn * d.sgn)::BIGINT AS dot FROM c JOIN q ON q.qid = c.qid JOIN d ON d.doc_id = c.doc_id AND d.idx = q.idx GROUP BY ALL) SELECT * FROM {top_sql('x', 'qid', 'dot', 'doc_id', TOP)}")
def knn_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.search(item_vectors(spark, sf_dir), packed_docs(spark, sf_dir), DIM, TOP, "qid", "doc_id", near=(8, 8)).select("qid", "doc_id", "dot", "rank")


_COSINE = "(SELECT qid, doc_id, dot, round(dot / sqrt(na * nb), 6) AS cosine, round(dot / least(na, nb), 6) AS overlap FROM {0} JOIN (SELECT qid, count(*) AS na FROM q GROUP BY qid) USING (qid) JOIN (SELECT doc_id, count(*) AS nb FROM d GROUP BY doc_id) USING (doc_id))"


@query(f"{VECTORS} SELECT qid, doc_id, cosine, overlap FROM {_COSINE.format(HITS)}")
def cosine_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    na = V.sizes(item_vectors(spark, sf_dir), "qid").withColumnRenamed("nnz", "na")
    hits = doc_hits(spark, sf_dir).withColumn("nb", F.size("codes"))
    return hits.join(na, "qid").select("qid", "doc_id", F.round(F.col("dot") / F.sqrt(F.col("na") * F.col("nb")), 6).alias("cosine"), F.round(F.col("dot") / F.least("na", "nb"), 6).alias("overlap"))


@query(f"{VECTORS}, f AS (SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars >= 200), x AS (SELECT * FROM {dots_sql('q', '(SELECT d.* FROM d SEMI JOIN f USING (doc_id))', 'qid', 'doc_id')}) SELECT qid, doc_id, dot, rank FROM {top_sql('x', 'qid', 'dot', 'doc_id', TOP)}")
def filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload's predicates below the cut: vectors are semi-joined with the rows that pass, so k hits remain."""
    ok = table(spark, sf_dir, "documents").where("lang = 'en' and n_chars >= 200").select("doc_id")
    passed = packed_docs(spark, sf_dir).join(ok, "doc_id", "left_semi")
    return B.search(item_vectors(spark, sf_dir), passed, DIM, TOP, "qid", "doc_id").select("qid", "doc_id", "dot", "rank")


@query(f"{VECTORS}, h AS {HITS}, p AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 1 WHEN lang = 'de' THEN 2 ELSE 3 END AS tier, doc_id % 2 = 0 AS gated FROM documents), x AS (SELECT qid, doc_id, round(dot * least(1.0, CASE tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.7 ELSE 0.4 END + CASE WHEN tier = 2 AND gated THEN 0.2 ELSE 0 END)::DOUBLE, 6) AS score FROM {dots_sql('q', 'd', 'qid', 'doc_id')} JOIN p USING (doc_id)) SELECT * FROM {top_sql('x', 'qid', 'score', 'doc_id', TOP)}")
def tier_weighted_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores weighted by tier before the cut; the language stands for the tier."""
    tier = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 2).otherwise(3)
    weight = table(spark, sf_dir, "documents").select("doc_id", G.tier_weight(tier, F.col("doc_id") % 2 == 0).alias("w"))
    hits = B.search(item_vectors(spark, sf_dir), packed_docs(spark, sf_dir).join(weight, "doc_id"), DIM, TOP, "qid", "doc_id", by="w")  # of one weight, the score rises with the product
    return V.top_k(hits.select("qid", "doc_id", F.round(F.col("dot") * F.col("w"), 6).alias("score")), "qid", "score", "doc_id", TOP)


@query(f"{VECTORS}, h AS {HITS}, e AS (SELECT event_id, ts FROM events) SELECT qid, doc_id, round(dot * pow(0.5, greatest(epoch(TIMESTAMP '2024-12-31 00:00:00')::BIGINT - coalesce(floor(epoch(ts))::BIGINT, 0), 0) / 3600.0 / 168.0), 9) AS score FROM h LEFT JOIN e ON e.event_id = h.doc_id")
def recency_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits weighted by age after the cut; the event of the document's number gives its time."""
    ts = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts")
    hits = knn_exact(spark, sf_dir).join(ts, "doc_id", "left")
    return hits.select("qid", "doc_id", F.round(S.recency(F.col("dot"), F.col("ts"), F.lit("2024-12-31 00:00:00").cast("timestamp")), 9).alias("score"))


def _seeded_hits(spark: SparkSession, sf_dir: str, seeds: tuple[str, ...] = ("s0", "s1")) -> DataFrame:
    """(seed, qid, vec_id, score): the hits of each seed's index, all seeds encoded in one pass over the source."""
    q = S.ensemble(item_tokens(spark, sf_dir), "qid", seeds, DIM, K)
    hits = B.search(q, packed_docs(spark, sf_dir, seeds), DIM, TOP, "qid", "doc_id", on="seed")
    return hits.select("seed", "qid", F.col("doc_id").alias("vec_id"), F.col("dot").alias("score"))


_SEEDS = f"WITH d0 AS MATERIALIZED {_doc_sql('s0')}, q0 AS MATERIALIZED {_item_sql('s0')}, d1 AS MATERIALIZED {_doc_sql('s1')}, q1 AS MATERIALIZED {_item_sql('s1')}, h AS (SELECT seed, qid, doc_id AS vec_id, dot AS score FROM {top_sql('(SELECT 0 AS seed, * FROM ' + dots_sql('q0', 'd0', 'qid', 'doc_id') + ' UNION ALL SELECT 1, * FROM ' + dots_sql('q1', 'd1', 'qid', 'doc_id') + ')', 'seed, qid', 'dot', 'doc_id', TOP)})"


@query(f"{_SEEDS}, x AS (SELECT qid, vec_id, max(score) AS score FROM h GROUP BY ALL) SELECT * FROM {top_sql('x', 'qid', 'score', 'vec_id', TOP)}")
def fusion_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fuse_merge(_seeded_hits(spark, sf_dir), TOP)


@query(f"{_SEEDS}, m AS (SELECT qid, seed, max(score) AS top FROM h GROUP BY ALL), b AS (SELECT qid, seed FROM (SELECT qid, seed, row_number() OVER (PARTITION BY qid ORDER BY top DESC, seed) AS r FROM m) WHERE r = 1), x AS (SELECT qid, vec_id, score FROM h JOIN b USING (qid, seed)) SELECT * FROM {top_sql('x', 'qid', 'score', 'vec_id', TOP)}")
def fusion_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fuse_top1(_seeded_hits(spark, sf_dir), TOP)


@query(f"{_SEEDS}, x AS (SELECT qid, vec_id, sum(score)::BIGINT AS score FROM h GROUP BY ALL) SELECT * FROM {top_sql('x', 'qid', 'score', 'vec_id', TOP)}")
def fusion_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fuse_sum(_seeded_hits(spark, sf_dir), TOP)


_PARTS = "(SELECT qid * 2 + p % 2 AS sub, token FROM (SELECT qid, token, row_number() OVER (PARTITION BY qid ORDER BY token) AS p FROM {0}))"


@query(f"WITH d AS MATERIALIZED {_doc_sql()}, s AS MATERIALIZED {superpose_sql(draws_sql(_PARTS.format(unnested('item_id', 'qid', 'benchmark')), 'sub', DIM, K), 'sub', K)}, x AS (SELECT qid, doc_id, max(dot) AS dot FROM (SELECT sub // 2 AS qid, doc_id, dot FROM {dots_sql('s', 'd', 'sub', 'doc_id')}) GROUP BY ALL) SELECT * FROM {top_sql('x', 'qid', 'dot', 'doc_id', TOP)}")
def subquery_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item as two subqueries; a document keeps its better hit."""
    by = Window.partitionBy("qid").orderBy("token")
    parts = item_tokens(spark, sf_dir).withColumn("sub", F.col("qid") * 2 + F.row_number().over(by) % 2)
    hits = B.search(V.encode_bag(parts, "sub", "token", DIM, K), packed_docs(spark, sf_dir), DIM, TOP, "sub", "doc_id")  # a document among the item's best is among those of its better subquery
    best = hits.groupBy(F.floor(F.col("sub") / 2).alias("qid"), "doc_id").agg(F.max("dot").alias("dot"))
    return V.top_k(best, "qid", "dot", "doc_id", TOP)


_ANALOGY = "(SELECT k.qid, idx, w FROM (SELECT qid, idx, sum(sgn * f)::BIGINT AS w FROM (SELECT r.qid, v.idx, v.sgn, r.f FROM (SELECT qid, qid AS src, 1 AS f FROM k UNION ALL SELECT qid, b, 1 FROM k UNION ALL SELECT qid, a, -1 FROM k) r JOIN q v ON v.qid = r.src) GROUP BY ALL HAVING sum(sgn * f) <> 0) JOIN k USING (qid))"


@query(f"{VECTORS}, i AS (SELECT DISTINCT qid FROM q), k AS (SELECT c.qid, a.qid AS a, b.qid AS b FROM i c JOIN i a ON a.qid = c.qid + 1 JOIN i b ON b.qid = c.qid + 2), t AS MATERIALIZED (SELECT qid, idx, sign(w)::INT AS sgn FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY abs(w) DESC, idx) AS r FROM {_ANALOGY}) WHERE r <= {K}) SELECT * FROM {top_sql(dots_sql('t', 'd', 'qid', 'doc_id'), 'qid', 'dot', 'doc_id', TOP)}")
def analogy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a is to b as c is to what: the vector c + b - a, for each item c, the next one a and the one after it b."""
    q = item_vectors(spark, sf_dir)
    known = q.select("qid").distinct()
    shift = lambda n, sign: q.select((F.col("qid") - n).alias("qid"), "idx", (F.col("sgn") * sign).alias("sgn"))
    full = known.join(known.select((F.col("qid") - 1).alias("qid")), "qid").join(known.select((F.col("qid") - 2).alias("qid")), "qid")
    target = V.superpose(shift(0, 1).union(shift(2, 1)).union(shift(1, -1)).join(full, "qid", "left_semi"), "qid", K)
    return B.search(target, packed_docs(spark, sf_dir), DIM, TOP, "qid", "doc_id").select("qid", "doc_id", "dot", "rank")


@query(f"""{VECTORS}, h AS {HITS}, w AS (SELECT h.qid, h.doc_id, d.idx, d.sgn FROM h JOIN d USING (doc_id)), s AS (SELECT qid, doc_id, sum(a.sgn * b.sgn)::BIGINT AS both_, sum(CASE WHEN a.sgn = b.sgn THEN 1 ELSE 0 END)::BIGINT AS agreeing FROM w a JOIN q b USING (qid, idx) GROUP BY ALL), n AS (SELECT qid, count(*) AS n FROM q GROUP BY qid)
SELECT qid, doc_id, round(both_ / n, 6) AS delta, CASE WHEN abs(both_ / n) > 0.10 THEN 'high' WHEN abs(both_ / n) > 0.05 THEN 'medium' ELSE 'low' END AS impact, CASE WHEN both_ >= 0 THEN 'positive' ELSE 'negative' END AS direction, agreeing FROM s JOIN n USING (qid)""")
def what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each hit contributes to its query: the share of the query's positions that it carries, and its sign."""
    q = item_vectors(spark, sf_dir)
    met = B.unpack(doc_hits(spark, sf_dir), "qid", "doc_id").withColumnRenamed("sgn", "s2").join(q, ["qid", "idx"])
    s = met.groupBy("qid", "doc_id").agg(F.sum(F.col("sgn") * F.col("s2")).alias("dot"), F.sum((F.col("sgn") == F.col("s2")).cast("bigint")).alias("agreeing")).join(V.sizes(q, "qid"), "qid")
    delta = F.col("dot") / F.col("nnz")
    return s.select("qid", "doc_id", F.round(delta, 6).alias("delta"), F.when(F.abs(delta) > 0.10, "high").when(F.abs(delta) > 0.05, "medium").otherwise("low").alias("impact"), F.when(delta >= 0, "positive").otherwise("negative").alias("direction"), "agreeing")


@query(f"""{VECTORS}, i AS (SELECT DISTINCT qid FROM q), p AS (SELECT a.qid FROM i a JOIN i b ON b.qid = a.qid + 1), m AS MATERIALIZED (SELECT qid, idx, sign(w)::INT AS sgn FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY abs(w) DESC, idx) AS r FROM (SELECT qid, idx, sum(s)::BIGINT AS w FROM (SELECT qid, idx, sgn AS s FROM q UNION ALL SELECT qid - 1, idx, -sgn FROM q) SEMI JOIN p USING (qid) GROUP BY ALL HAVING sum(s) <> 0)) WHERE r <= {K}),
c AS (SELECT DISTINCT p.qid, doc_id FROM p JOIN (SELECT qid, doc_id FROM {HITS} UNION ALL SELECT qid - 1, doc_id FROM {HITS}) USING (qid)), x AS (SELECT c.qid, c.doc_id, coalesce(sum(m.sgn * d.sgn), 0)::BIGINT AS dot FROM c LEFT JOIN (m JOIN d USING (idx)) ON m.qid = c.qid AND d.doc_id = c.doc_id GROUP BY ALL) SELECT * FROM {top_sql('x', 'qid', 'dot', 'doc_id', TOP)}""")
def missing_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What leads from each item's next one to it: candidates are the neighbours of both, ranked by the difference of the vectors."""
    q = item_vectors(spark, sf_dir)
    known = q.select("qid").distinct()
    pairs = known.join(known.select((F.col("qid") - 1).alias("qid")), "qid")
    h = V.superpose(q.union(V.negate(q).withColumn("qid", F.col("qid") - 1)).join(pairs, "qid", "left_semi"), "qid", K)
    own_and_last = F.explode(F.array(F.col("qid"), F.col("qid") - 1)).alias("qid")
    both = doc_hits(spark, sf_dir).select(own_and_last, "doc_id", "codes").join(pairs, "qid", "left_semi").groupBy("qid", "doc_id").agg(F.first("codes").alias("codes"))
    met = B.unpack(both, "qid", "doc_id").withColumnRenamed("sgn", "s2").join(h, ["qid", "idx"], "left")
    scored = met.groupBy("qid", "doc_id").agg(F.coalesce(F.sum(F.col("sgn") * F.col("s2")), F.lit(0)).alias("dot"))
    return V.top_k(scored, "qid", "dot", "doc_id", TOP)


_Q4 = "(SELECT vec_id, i - 1 AS idx, sign(x)::INT AS sgn FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, i) AS r FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1)::INT AS i FROM embeddings) WHERE x <> 0) WHERE r <= 16)"


@query(f"SELECT vec_id, idx::INT AS idx, sgn FROM {_Q4}")
def ternary_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.quantize(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 16)


def _centroids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = ternary_embeddings(spark, sf_dir)
    return t, V.superpose(t.join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id").select("label", "idx", "sgn"), "label", 16)


_CENT = f"WITH t AS {_Q4}, c AS {superpose_sql('(SELECT label, idx, sgn FROM t JOIN embeddings USING (vec_id))', 'label', 16)}"


@query(f"{_CENT} SELECT label, idx::INT AS idx, sgn FROM c")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centroids(spark, sf_dir)[1]


@query(f"{_CENT}, s AS (SELECT vec_id, label, round(sum(t.sgn * c.sgn) / sqrt(any_value(n)), 9) AS s FROM t JOIN c USING (idx) JOIN (SELECT label, count(*) AS n FROM c GROUP BY label) USING (label) GROUP BY ALL), b AS (SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS r FROM s) WHERE r = 1) SELECT vec_id, coalesce(b.label, 0)::INT AS cluster FROM (SELECT DISTINCT vec_id FROM t) LEFT JOIN b USING (vec_id)")
def cluster_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, c = _centroids(spark, sf_dir)
    return S.nearest_centroid(t, c.withColumnRenamed("label", "cluster"), "vec_id")


_TURN_TOKENS = f"(SELECT conv_id, turn, t AS token, p FROM (SELECT conv_id, turn, unnest(ts) AS t, generate_subscripts(ts, 1) AS p FROM (SELECT conv_id, turn, {tokens_sql('text')} AS ts FROM conversations)))"
_COOC = f"(SELECT token, other, count(*) AS weight FROM (SELECT a.token, b.token AS other FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.p <> b.p AND abs(a.p - b.p) <= 5 AND a.token <> b.token) GROUP BY ALL)"


def _turn_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), F.posexplode(T.content_tokens(F.col("text"))).alias("pos", "token"))


@query(f"WITH w AS {_TURN_TOKENS} SELECT * FROM {_COOC}")
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cooccurrence(_turn_tokens(spark, sf_dir), "key")


@query(f"WITH w AS {_TURN_TOKENS}, g AS (SELECT token, other FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY weight DESC, other) AS r FROM {_COOC}) WHERE r <= 3), q AS (SELECT qid, token FROM {unnested('item_id', 'qid', 'benchmark')}) SELECT qid, token FROM q UNION SELECT qid, other FROM q JOIN g USING (token)")
def expanded_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.expand(item_tokens(spark, sf_dir), S.cooccurrence(_turn_tokens(spark, sf_dir), "key"), "qid")


# --- evaluation and profiling ----------------------------------------------

_GOLD = f"g AS (SELECT qid, doc_id FROM (SELECT qid, d.doc_id, count(*) AS c, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM {unnested('item_id', 'qid', 'benchmark')}) i JOIN {unnested('doc_id', 'doc_id', 'documents')} d USING (token) GROUP BY ALL) WHERE c = n)"


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, doc_id): documents with all of an item's tokens."""
    return B.holding(item_tokens(spark, sf_dir), table(spark, sf_dir, "documents"), "qid", "doc_id")


@query(f"WITH {_GOLD}, n AS (SELECT count(*) AS n FROM documents) SELECT qid, count(*) AS gold, count(*) BETWEEN 2 AND 0.3 * any_value(n) AS usable FROM g, n GROUP BY qid")
def token_and_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    return _gold(spark, sf_dir).groupBy("qid").agg(F.count("*").alias("gold")).crossJoin(F.broadcast(n)).select("qid", "gold", ((F.col("gold") >= 2) & (F.col("gold") <= 0.3 * F.col("n"))).alias("usable"))


_METRICS = f"""{VECTORS}, h AS {HITS}, {_GOLD}, m AS (SELECT qid, count(*) AS n_gold, min(rank) AS first_rank, count(rank) AS found, coalesce(sum(1 / log2(rank + 1)), 0) AS dcg FROM g LEFT JOIN h USING (qid, doc_id) GROUP BY qid)"""


@query(f"{_METRICS} SELECT qid, n_gold, coalesce(first_rank = 1, false) AS hit_at_1, coalesce(first_rank, 0)::INT AS first_rank, round(coalesce(1 / first_rank, 0), 6) AS reciprocal_rank, round(found / least(n_gold, 10), 6) AS recall, round(dcg / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda r: 1 / log2(r + 1))), 6) AS ndcg FROM m")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ranking_metrics(knn_exact(spark, sf_dir), _gold(spark, sf_dir), "qid", "doc_id")


@query(f"{_METRICS} SELECT CASE WHEN grouping(n_gold > 1) = 1 THEN 'all' WHEN n_gold > 1 THEN 'many' ELSE 'one' END AS category, count(*) AS n, round(avg(CASE WHEN first_rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_1, round(avg(coalesce(1 / first_rank, 0)), 6) AS mrr FROM m GROUP BY ROLLUP (n_gold > 1)".replace("WHEN n_gold > 1 THEN 'many'", "WHEN (n_gold > 1) THEN 'many'"))
def scorecard_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ranking_metrics(spark, sf_dir).withColumn("category", F.when(F.col("n_gold") > 1, "many").otherwise("one"))
    r = m.rollup("category").agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit_at_1").cast("int")), 6).alias("hit_at_1"), F.round(F.avg(F.coalesce(F.when(F.col("first_rank") > 0, 1 / F.col("first_rank")), F.lit(0.0))), 6).alias("mrr"))
    return r.withColumn("category", F.coalesce("category", F.lit("all")))


@query(f"WITH x AS (SELECT lang, len({tokens_sql('text')}) AS v FROM documents), c AS (SELECT lang, v, count(*) AS c FROM x GROUP BY ALL), r AS (SELECT lang, v, sum(c) OVER (PARTITION BY lang) AS n, sum(c) OVER (PARTITION BY lang ORDER BY v) AS cum FROM c) SELECT lang, max(n)::BIGINT AS n, min(v) FILTER (cum >= 0.99 * n)::INT AS p99, CASE WHEN min(v) FILTER (cum >= 0.99 * n) <= 8 THEN 1 WHEN min(v) FILTER (cum >= 0.99 * n) <= 24 THEN 2 WHEN min(v) FILTER (cum >= 0.99 * n) <= 200 THEN 3 ELSE 4 END AS zone FROM r GROUP BY lang")
def structural_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", F.size(T.content_tokens(F.col("text"))).alias("v"))
    return E.histogram_percentile(rows, "lang", "v", 0.99).withColumn("zone", G.zone_column(F.col("p99")))


_SWEEP = "(SELECT p_brand AS id, round(avg(p_size) / 50, 6) AS recall, round(avg(p_retailprice), 6) AS cost FROM part GROUP BY p_brand)"


@query(f"WITH p AS {_SWEEP} SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.recall >= a.recall AND b.cost <= a.cost AND (b.recall > a.recall OR b.cost < a.cost))")
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brands of parts as sweep points: size to gain, price to pay."""
    return E.pareto_front(table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("id")).agg(F.round(F.avg("p_size") / 50, 6).alias("recall"), F.round(F.avg("p_retailprice"), 6).alias("cost")))


@query("WITH s AS (SELECT l_returnflag AS tier, l_linenumber AS dim, 1 - 1.0 / (1 + count(*) / 100.0)::DOUBLE AS recall FROM lineitem GROUP BY ALL), g AS (SELECT *, lead(recall) OVER (PARTITION BY tier ORDER BY dim) - recall AS gain FROM s) SELECT tier, coalesce(min(dim) FILTER (gain < 0.1 * (1 - recall)), max(dim))::INT AS elbow_dim FROM g GROUP BY tier")
def elbow_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweep = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("tier"), F.col("l_linenumber").alias("dim")).agg((1 - 1 / (1 + F.count("*") / 100.0)).alias("recall"))
    return E.elbow(sweep)


@query("SELECT k, least(256, round_even(2 * sqrt(k), 0)::INT) AS slots, (k // 2)::INT AS salient, round(1.96 * sqrt(greatest(least(k / 200.0, 0.99), 0.01) * (1 - greatest(least(k / 200.0, 0.99), 0.01)) / 500), 9) AS noise FROM (SELECT DISTINCT p_size AS k FROM part)")
def geometry_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("k")).distinct().select("k", G.slots_column(k).alias("slots"), F.floor(k / 2).cast("int").alias("salient"), F.round(G.noise_column(k / 200.0, F.lit(500)), 9).alias("noise"))


@query("SELECT event_id, user_id, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS share FROM events")
def rolling_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rolling_share(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase").select("event_id", "user_id", "share")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling hours, as the streaming form sums them."""
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


@query("SELECT user_id, count(*) AS n, round(sum(pow(0.5, (epoch(TIMESTAMP '2024-12-31') - floor(epoch(ts))) / 86400.0 / 30.0)), 6) AS retention FROM events GROUP BY user_id")
def decayed_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reinforcements of each key, halved every thirty days: the batch form of the adaptive gazetteer's state."""
    age = (F.unix_seconds(F.lit("2024-12-31 00:00:00").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))) / 86400.0
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum(F.pow(F.lit(0.5), age / 30.0)), 6).alias("retention"))


@query("SELECT l_orderkey % 10 AS segment, count(*) AS n, sum(l_partkey)::BIGINT AS check_sum FROM lineitem GROUP BY ALL")
def compaction_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base and its deltas, written, read as one and compacted, hold the same rows."""
    from tritsift.sources.segments import Segments
    from tritsift.streaming.folder import scratch

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    store = Segments(spark, scratch(spark, "segments"))
    store.append(rows.where("l_orderkey % 10 < 8"))
    store.append(rows.where("l_orderkey % 10 = 8"))
    store.append(rows.where("l_orderkey % 10 = 9"))
    store.compact()
    return store.read().groupBy((F.col("l_orderkey") % 10).alias("segment")).agg(F.count("*").alias("n"), F.sum("l_partkey").alias("check_sum"))


from tritsift.plans import further, more  # noqa: E402, F401  register their queries with this module's

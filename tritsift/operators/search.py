"""Search over sparse ternary vectors, and what ranks and routes its hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tritsift.functions import text as T
from tritsift.operators import vectors as V


def knn(queries: DataFrame, vectors: DataFrame, k: int, query: str = "qid", key: str = "vec_id") -> DataFrame:
    """(query, key, dot, rank): exact top k by dot product, every vector that shares a position being scored."""
    return V.top_k(V.similarities(queries, vectors, query, key), query, "dot", key, k)


def keyed(triples: DataFrame, per_shard: int = 64) -> DataFrame:
    """(relation, subject, n, object, shard): every distinct key of the triples with its count, its least object, and the entity bucket that the subject's content hash gives. There are as many buckets as put about ``per_shard`` keys in each."""
    keys = triples.groupBy("relation", "subject").agg(F.count("*").alias("n"), F.min("object").alias("object"))
    many = keys.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / per_shard)).alias("many"))  # one row
    h = F.conv(F.substring(F.md5(F.col("subject").cast("binary")), 1, 15), 16, 10).cast("bigint")
    return keys.crossJoin(F.broadcast(many)).withColumn("shard", F.pmod(h, F.col("many"))).drop("many")


def hash_bits(vectors: DataFrame, key: str, tables: int, bits: int) -> DataFrame:
    """(key, tab, bucket): sign hashes. A bit is set where the vector's product with a random plane of +1 and -1 isn't negative.

    The planes' signs are bits of a digest of (table, position), so they need no table and no join.
    """
    words = [F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("plane"), F.lit(str(t)), F.col("idx").cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint") for t in range(tables)]
    rows = vectors.select(key, "sgn", F.posexplode(F.array(*words)).alias("tab", "h"))
    sums = [F.sum(F.col("sgn") * F.when(F.shiftright("h", b).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1)).alias(f"b{b}") for b in range(bits)]
    bucket = sum((F.when(F.col(f"b{b}") >= 0, 1 << b).otherwise(0) for b in range(bits)), F.lit(0))
    return rows.groupBy(key, "tab").agg(*sums).select(key, "tab", bucket.cast("int").alias("bucket"))


def knn_lsh(queries: DataFrame, vectors: DataFrame, k: int, query: str = "qid", key: str = "vec_id", tables: int = 8, bits: int = 8) -> DataFrame:
    """knn among the vectors that share a bucket, or one that differs in one bit, in some table."""
    probes = hash_bits(queries, query, tables, bits).withColumn("bucket", F.explode(F.array(F.col("bucket"), *(F.col("bucket").bitwiseXOR(F.lit(1 << b)) for b in range(bits)))))
    candidates = probes.join(hash_bits(vectors, key, tables, bits), ["tab", "bucket"]).select(query, key).distinct()
    dots = candidates.join(queries, query).alias("c").join(vectors.alias("v"), (F.col(f"c.{key}") == F.col(f"v.{key}")) & (F.col("c.idx") == F.col("v.idx")))
    dots = dots.groupBy(query, F.col(f"c.{key}").alias(key)).agg(F.sum(F.col("c.sgn") * F.col("v.sgn")).alias("dot"))
    return V.top_k(dots, query, "dot", key, k)


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, key: str, centroid: str = "cluster") -> DataFrame:
    """(key, cluster): the centroid of the largest cosine, the lowest of equal ones; cluster 0 for a vector that meets none."""
    size = V.sizes(centroids, centroid)
    near = V.similarities(centroids, vectors, centroid, key).join(size, centroid).withColumn("c", F.round(F.col("dot") / F.sqrt("nnz"), 9))
    best = near.groupBy(key).agg(F.max_by(centroid, F.struct("c", -F.col(centroid))).alias(centroid))
    return vectors.select(key).distinct().join(best, key, "left").select(key, F.coalesce(centroid, F.lit(0)).alias(centroid))


def route(subject: Column, cluster: Column, buckets: int, clusters: int) -> Column:
    """Shard of a record: its entity bucket and its action cluster."""
    return T.bucket(subject, buckets) * clusters + cluster


def two_hop(triples: DataFrame) -> DataFrame:
    """(subject, first, middle, second, object): the objects reached over any two relations."""
    a = triples.select("subject", F.col("relation").alias("first"), F.col("object").alias("middle")).distinct()
    b = triples.select(F.col("subject").alias("middle"), F.col("relation").alias("second"), "object").distinct()
    return a.join(b, "middle").select("subject", "first", "middle", "second", "object")


def recency(score: Column, ts: Column, now: Column, half_life_hours: float = 168.0) -> Column:
    """Score halved for each half-life of age; a later time than ``now`` has no age, a null one is the epoch."""
    at = F.coalesce(F.unix_seconds(ts.cast("timestamp")), F.lit(0))
    age = F.greatest(F.unix_seconds(now.cast("timestamp")) - at, F.lit(0)) / 3600.0
    return score * F.pow(F.lit(0.5), age / max(half_life_hours, 1e-3))


def ensemble(tokens: DataFrame, key: str, seeds: tuple[str, ...], dim: int, k: int) -> DataFrame:
    """(seed, key, idx, sgn): (key, token) encoded under each of two or more distinct seeds, which the position in ``seeds`` numbers."""
    if len(seeds) < 2 or len(set(seeds)) < len(seeds):
        raise ValueError("two or more distinct seeds are needed")
    names = F.array(*map(F.lit, seeds))
    each = tokens.select(key, "token").repartition(key).select(key, "token", F.posexplode(names).alias("seed", "name"))
    drawn = V.draws(each, "token", dim, k, F.col("name")).groupBy(key, "seed", "idx").agg(F.sum("sgn").alias("w")).where("w <> 0")
    by = Window.partitionBy(key, "seed").orderBy(F.abs("w").desc(), "idx")
    return drawn.withColumn("__r", F.row_number().over(by)).where(F.col("__r") <= k).select("seed", key, "idx", F.signum("w").cast("int").alias("sgn"))


def fuse_merge(hits: DataFrame, k: int) -> DataFrame:
    """(qid, vec_id, score, rank): each vector's best score over the seeds."""
    return V.top_k(hits.groupBy("qid", "vec_id").agg(F.max("score").alias("score")), "qid", "score", "vec_id", k)


def fuse_sum(hits: DataFrame, k: int) -> DataFrame:
    return V.top_k(hits.groupBy("qid", "vec_id").agg(F.sum("score").alias("score")), "qid", "score", "vec_id", k)


def fuse_top1(hits: DataFrame, k: int) -> DataFrame:
    """All hits of the seed whose best one scores highest, the first of equal seeds."""
    best = F.max(F.struct(F.col("score").alias("top"), (-F.col("seed")).alias("seed"))).over(Window.partitionBy("qid"))  # and no join, for which the hits would be made twice
    return V.top_k(hits.withColumn("__b", best).where(F.col("seed") == -F.col("__b.seed")).select("qid", "vec_id", "score"), "qid", "score", "vec_id", k)


def cooccurrence(tokens: DataFrame, key: str, window: int = 5) -> DataFrame:
    """(token, other, weight): ordered pairs of different tokens at most ``window`` places apart in (key, pos, token)."""
    by = Window.partitionBy(key).orderBy("pos")
    near = tokens.select("token", F.array(*(F.lead("token", d).over(by) for d in range(1, window + 1))).alias("near"))
    ahead = near.select("token", F.explode("near").alias("other")).where("token <> other")
    both = ahead.union(ahead.select(F.col("other").alias("token"), F.col("token").alias("other")))
    return both.groupBy("token", "other").agg(F.count("*").alias("weight"))


def expand(query_tokens: DataFrame, graph: DataFrame, query: str, n: int = 3) -> DataFrame:
    """(query, token): the query's tokens and each one's n strongest companions, of equal ones the first by name."""
    by = Window.partitionBy("token").orderBy(F.desc("weight"), "other")
    near = graph.withColumn("__r", F.row_number().over(by)).where(F.col("__r") <= n).select("token", "other")
    return query_tokens.select(query, "token").union(query_tokens.join(near, "token").select(query, F.col("other").alias("token"))).distinct()


def in_set(rows: DataFrame, column: str, wanted: tuple = ()) -> DataFrame:
    """Rows of the wanted shards or tiers; all of them if none is named. A filter on a partition column, which prunes folders."""
    return rows.where(F.col(column).isin(*wanted)) if wanted else rows


def best_overall(hits: DataFrame, k: int, score: str, *ties: str) -> DataFrame:
    """The k best hits of all queries together: a top k of each task, then of these."""
    return hits.orderBy(F.desc(score), *ties).limit(k)


def without_inputs(hits: DataFrame, inputs: DataFrame, query: str, key: str, score: str, k: int) -> DataFrame:
    """The k best hits, ranked anew, that aren't among the query's own inputs (query, key). The hits should hold as many more as a query has inputs."""
    return V.top_k(hits.drop("rank").join(inputs.select(query, key), [query, key], "left_anti"), query, score, key, k)


def boosted(weights: DataFrame, terms: DataFrame, by: float = 3.0) -> DataFrame:
    """(token, idf) with the weight of the tokens that stand in ``terms`` multiplied."""
    named = terms.select("token").distinct().withColumn("__t", F.lit(True))
    return weights.join(named, "token", "left").withColumn("idf", F.when(F.col("__t"), F.col("idf") * by).otherwise(F.col("idf"))).drop("__t")

"""Structural encoding, sweeps over geometries, clustering, and label rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tritsift.operators import search as S
from tritsift.operators import vectors as V
from tritsift.streaming.folder import scratch


def structural(tokens: DataFrame, key: str, dim: int, k: int, slots: int, keep: int) -> DataFrame:
    """(key, idx, sgn) of (key, token, pos): each of the first ``slots`` tokens bound to its place by a permutation, and each token to its successor."""
    slot = V.draws(tokens.where(F.col("pos") < slots), "token", dim, k)
    p = F.col("pos").cast("bigint")
    slot = slot.select(key, F.pmod(F.col("idx").cast("bigint") * (2 * p + 3) + 7 * p + 1, F.lit(dim)).cast("int").alias("idx"), "sgn")
    pairs = tokens.withColumn("next", F.lead("token").over(Window.partitionBy(key).orderBy("pos"))).where("next is not null")
    bigram = V.draws(pairs.select(key, F.concat_ws("_", "token", "next").alias("b")), "b", dim, k).select(key, "idx", "sgn")
    return V.superpose(slot.union(bigram), key, keep)


def kmeans(vectors: DataFrame, key: str, clusters: int, rounds: int, k: int) -> DataFrame:
    """(cluster, size, first, last): seeded centroids, then rounds of assigning by cosine and superposing. A round's vectors are a written table."""
    spark = vectors.sparkSession

    def cut(df: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    vectors = cut(vectors, "kmeans-vectors")
    chosen = vectors.select(key).distinct().withColumn("h", F.md5(F.col(key).cast("string").cast("binary"))).orderBy("h").limit(clusters)
    seeds = chosen.select(key, F.xxhash64("h").alias("o"))
    numbered = seeds.select(key, (F.row_number().over(Window.orderBy("o", key)) - 1).alias("cluster"))  # as many rows as clusters
    centers = cut(vectors.join(F.broadcast(numbered), key).select("cluster", "idx", "sgn"), "kmeans-centers")
    for _ in range(rounds):
        assigned = cut(S.nearest_centroid(vectors, centers, key), "kmeans-assigned")
        centers = cut(V.superpose(vectors.join(assigned, key).select("cluster", "idx", "sgn"), "cluster", k), "kmeans-centers")
    return assigned.groupBy("cluster").agg(F.count("*").alias("size"), F.min(key).alias("first"), F.max(key).alias("last"))


def repair_label(label: Column, fallback: Column) -> Column:
    """A label as a slug without a family suffix or plural; one that is a bare code gives way to the fallback."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), "[^a-z0-9]+", "_"), "(_gene|_protein|s)$", "")
    return F.when(label.rlike("^[a-z]?[0-9]+$"), fallback).otherwise(slug)


def any_tag(text: Column, tags: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for t in tags:
        out = out | F.contains(text, F.lit(t))
    return out


def passthrough(rows: DataFrame, named: list[str]) -> DataFrame:
    """The named columns, and all others that aren't null as one map of strings."""
    others = [c for c in rows.columns if c not in named]
    pairs = F.create_map(*(x for c in others for x in (F.lit(c), F.col(f"`{c}`").cast("string")))) if others else F.create_map().cast("map<string,string>")
    return rows.select(*(F.col(f"`{c}`") for c in named), F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("rest"))


def normalize_label(domain: Column, entity: Column, aliases: dict[str, dict[str, str]]) -> Column:
    """A label as its domain writes it. genes and medical: by alias, then by alias without a kind's suffix or a plural s; graph: by alias of the trimmed label; all else in lower case with underscores. Null and empty labels stay.

    ``aliases`` holds a short table for each domain; it becomes part of the expression, so larger ones belong in a join before.
    """

    def known(name: str, key: Column) -> Column:
        table = aliases.get(name)
        return F.try_element_at(F.create_map(*(F.lit(x) for pair in sorted(table.items()) for x in pair)), key) if table else F.lit(None).cast("string")

    plain = F.replace(F.lower(entity), F.lit(" "), F.lit("_"))
    tidy = F.replace(F.lower(F.trim(entity)), F.lit(" "), F.lit("_"))
    gene = F.replace(tidy, F.lit("-"), F.lit("_"))
    term = F.regexp_replace(tidy, "[^a-z0-9_]", "")
    by_gene = F.coalesce(known("genes", gene), known("genes", F.regexp_replace(gene, "_(human|mouse|protein|gene)$", "")), plain)
    by_term = F.coalesce(known("medical", term), F.when(term.endswith("s"), known("medical", F.left(term, F.length(term) - 1))), F.nullif(term, F.lit("")), entity)
    by_graph = F.coalesce(known("graph", F.trim(entity)), plain)
    return F.when(entity == "", entity).when(domain == "genes", by_gene).when(domain == "medical", by_term).when(domain == "graph", by_graph).otherwise(plain)

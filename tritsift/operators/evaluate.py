"""Retrieval metrics, sweeps and telemetry as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tritsift.functions import geometry as G


def ranking_metrics(hits: DataFrame, gold: DataFrame, query: str, key: str, k: int = 10) -> DataFrame:
    """(query, n_gold, hit_at_1, first_rank, reciprocal_rank, recall, ndcg) of hits (query, key, rank) and gold pairs, for every query with gold."""
    found = gold.join(hits.where(F.col("rank") <= k), [query, key], "left")
    per = found.groupBy(query).agg(F.count("*").alias("n_gold"), F.min("rank").alias("first_rank"), F.count("rank").alias("found"), F.coalesce(F.sum(1 / F.log2(F.col("rank") + 1)), F.lit(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1))
    return per.select(
        query, "n_gold", F.coalesce(F.col("first_rank") == 1, F.lit(False)).alias("hit_at_1"), F.coalesce("first_rank", F.lit(0)).alias("first_rank"),
        F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.round(F.col("found") / F.least("n_gold", F.lit(k)), 6).alias("recall"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"),
    )


def pareto_front(points: DataFrame) -> DataFrame:
    """The points (id, recall, cost) that no other beats on one side without losing on the other."""
    a, b = points.alias("a"), points.alias("b")
    better = (F.col("b.recall") >= F.col("a.recall")) & (F.col("b.cost") <= F.col("a.cost")) & ((F.col("b.recall") > F.col("a.recall")) | (F.col("b.cost") < F.col("a.cost")))
    return a.join(b, better, "left_anti")


def histogram_percentile(values: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """(group, n, pNN): the least value whose cumulative count reaches p of the group's."""
    counts = values.groupBy(group, value).agg(F.count("*").alias("c"))
    by = Window.partitionBy(group)
    run = counts.withColumn("n", F.sum("c").over(by)).withColumn("cum", F.sum("c").over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(group).agg(F.max("n").alias("n"), F.min(F.when(F.col("cum") >= p * F.col("n"), F.col(value))).alias(f"p{round(p * 100)}"))


def elbow(sweep: DataFrame) -> DataFrame:
    """(tier, elbow_dim): the least dimension whose step to the next gains under a tenth of what is missing to 1; the largest if none."""
    by = Window.partitionBy("tier").orderBy("dim")
    step = sweep.withColumn("gain", F.lead("recall").over(by) - F.col("recall"))
    return step.groupBy("tier").agg(F.coalesce(F.min(F.when(F.col("gain") < 0.1 * (1 - F.col("recall")), F.col("dim"))), F.max("dim")).alias("elbow_dim"))


def rolling_share(rows: DataFrame, key: str, order: list[str], flag: Column, width: int = 100) -> DataFrame:
    """rows with the share of ``flag`` among the last ``width`` of their key."""
    by = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - width, 0)
    return rows.withColumn("share", F.round(F.avg(flag.cast("int")).over(by), 6))


def recommend(sweep: list[tuple[int, float]], n: int, tolerance: float = 0.05, headroom: float = 1.0) -> tuple[str, int | None]:
    """Zone and dimension of a sweep's (dim, recall): pressed under 0.5, a plateau of three or more within tolerance (its least dimension, raised to one measured with the headroom), a confident best beyond 1.5 times the noise, else ambiguous."""
    if not sweep:
        return "empty", None
    top = max(r for _, r in sweep)
    if top < 0.5:
        return "pressed", max(d for d, _ in sweep)
    flat = sorted(d for d, r in sweep if top - r <= tolerance)
    if len(flat) >= 3:
        return "plateau", next((d for d in flat if d >= flat[0] * headroom), flat[-1])
    q = min(max(top, 0.01), 0.99)
    noise = 1.96 * (q * (1 - q) / n) ** 0.5 if n > 0 else 0.5
    if n >= 50 and top - min(r for _, r in sweep) > 1.5 * noise:
        return "confident", min(d for d, r in sweep if r == top)
    return "ambiguous", G.round_up(flat[0])


def sorted_index(rows: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """(key, n, at_q): the value at place round(q * (n - 1)) of the key's sorted values, a half going to the even place. Counted by value first, so that a window has a row for each distinct value only."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    of = Window.partitionBy(key)
    cum = counts.withColumn("n", F.sum("c").over(of)).withColumn("cum", F.sum("c").over(of.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    return cum.where(F.col("cum") > F.bround(F.lit(q) * (F.col("n") - 1), 0)).groupBy(key).agg(F.max("n").alias("n"), F.min(value).alias("at_q"))


def tier_recall(hits: DataFrame, gold: DataFrame, tiers: DataFrame, query: str, key: str) -> DataFrame:
    """(tier, n, recall, worst, mean): the share of queries that found any of their gold ids, by the tier of the first of these ("unknown" without one), beside the least and the mean share of all tiers."""
    found = gold.join(hits.select(query, key, F.lit(1).alias("hit")), [query, key], "left")
    each = found.groupBy(query).agg(F.min(key).alias(key), F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    per = each.join(tiers.select(key, "tier"), key, "left").groupBy(F.coalesce("tier", F.lit("unknown")).alias("tier")).agg(F.count("*").alias("n"), F.avg("hit").alias("recall"))
    of = Window.partitionBy(F.lit(0))  # a row for each tier
    return per.select("tier", "n", F.round("recall", 6).alias("recall"), F.round(F.min("recall").over(of), 6).alias("worst"), F.round(F.avg("recall").over(of), 6).alias("mean"))

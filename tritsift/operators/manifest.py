"""Compatibility manifests as dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("stop_words", "possessive", "acronym", "tokenizer", "codebook")


def with_hash(manifests: DataFrame) -> DataFrame:
    """manifests(manifest_id, tenant, pipeline_version, axes map<string,string>) with the digest of the axes in order."""
    ordered = F.array_sort(F.map_entries("axes"))
    return manifests.withColumn("composite", F.sha2(F.to_json(F.struct(ordered.alias("a"))), 256))


def compatible(stored: DataFrame, asked: DataFrame, used: tuple[str, ...] = AXES) -> DataFrame:
    """The stored manifests that a query's manifest may read: same tenant and pipeline version, and either the same digest or the same versions of the axes it uses."""
    a, b = with_hash(stored).alias("a"), with_hash(asked).alias("b")
    same = [F.col("a.axes")[x].eqNullSafe(F.col("b.axes")[x]) for x in used]
    every = F.lit(True)
    for s in same:
        every = every & s
    on = (F.col("a.tenant") == F.col("b.tenant")) & (F.col("a.pipeline_version") == F.col("b.pipeline_version")) & ((F.col("a.composite") == F.col("b.composite")) | every)
    return a.join(b, on, "left_semi")


def check_geometry(found: dict, asked: dict) -> None:
    """An index is only searched in the geometry that it was written in."""
    if (found["dim"], found["k"]) != (asked["dim"], asked["k"]):
        raise ValueError(f"the index has {found['dim']}/{found['k']}, the query {asked['dim']}/{asked['k']}")

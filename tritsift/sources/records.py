"""Readers of records as JSON lines or arrays, and their adapters to triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt"


def detect_format(spark: SparkSession, path: str) -> str:
    """"array" or "lines" by the first character that isn't white space, from one row of the text."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    head = first[0].value.lstrip()[:1] if first else ""
    if head not in ("[", "{"):
        raise ValueError(f"{path} is neither a JSON array nor JSON lines")
    return "array" if head == "[" else "lines"


def read_json(spark: SparkSession, path: str, schema: str, form: str | None = None) -> DataFrame:
    """Records in the given schema; lines that don't parse are left out, see ``corrupt_lines``. An array is read whole by a task, lines are split."""
    form = form or detect_format(spark, path)
    full = spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", form == "array").json(path)
    return full.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def corrupt_lines(spark: SparkSession, path: str, schema: str) -> int:
    """How many lines that aren't blank read_json leaves out."""
    parsed = F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return spark.read.text(path).where(F.trim("value") != "").select(parsed.alias("r")).where(F.col(f"r.{CORRUPT}").isNotNull()).count()


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def author(raw: Column) -> Column:
    """An author that is a name, or a JSON object of which the first filled of username, name and entity_id counts; else "unknown"."""
    parts = [_filled(F.get_json_object(raw, f"$.{k}")) for k in ("username", "name", "entity_id")]
    plain = F.when(~F.coalesce(raw.startswith("{"), F.lit(False)), _filled(raw))
    return F.coalesce(*parts, plain, F.lit("unknown"))


def message_triples(messages: DataFrame) -> DataFrame:
    """(subject, relation, object, channel) of messages: author, site with up to six tags, and the text, translated where it is; texts under ten letters are left out."""
    body = F.coalesce(_filled(F.col("message_text_translated")), _filled(F.col("message_text")))
    chat = F.coalesce(*(_filled(F.get_json_object("chat", f"$.{k}")) for k in ("username", "title", "entity_id")), F.col("site"))
    tags = F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 6)
    return messages.where(F.length(body) >= 10).select(author(F.col("author")).alias("subject"), F.concat_ws(" ", F.col("site"), F.concat_ws(" ", tags)).alias("relation"), F.substring(body, 1, 1000).alias("object"), chat.alias("channel"))


def combine(sources: list[DataFrame], key: str = "id", other: str = "native_id") -> DataFrame:
    """The sources' rows, of each key (or other, where it is missing) the one of the first source; one row at most has neither."""
    tagged = [s.withColumn("__source", F.lit(i)) for i, s in enumerate(sources)]
    every = tagged[0]
    for s in tagged[1:]:
        every = every.unionByName(s, allowMissingColumns=True)
    names = [c for c in every.columns if c != "__source"]
    row = every.groupBy(F.coalesce(F.col(key), F.col(other)).alias("__key")).agg(F.min_by(F.struct(*names), F.struct("__source", F.xxhash64(*names))).alias("r"))
    return row.select("r.*")


def operator_queries(rows: DataFrame) -> DataFrame:
    """(query_text, gold_ids) of records with gold_ids or gold_id; incomplete ones are left out."""
    gold = F.coalesce(F.col("gold_ids"), F.when(F.col("gold_id").isNotNull(), F.array("gold_id")))
    return rows.select("query_text", gold.alias("gold_ids")).where((F.trim("query_text") != "") & (F.size("gold_ids") > 0))

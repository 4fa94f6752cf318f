"""Tables that cut a plan's lineage, and partition counts.

Intermediate tables are Parquet in the folder that the session names in
``spark.checkpoint.dir``, which all executors share, so that a lost executor
costs only its running tasks. They are deleted when the work inside
``temporary`` is done, by ``clear``, or else at the end of the driver's process:
a DataFrame that an operator returns still reads them.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only if it is unset on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tritsift-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables that this process has written and not yet deleted.
_made: list[str] = []


def drop(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
        if p in _made:
            _made.remove(p)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were cut within; what is still needed must have been written by then."""
    before = len(_made)
    try:
        yield
    finally:
        drop(spark, _made[before:])


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this process has cut. Results that read them must have been written."""
    drop(spark, list(_made))


@atexit.register
def _at_exit() -> None:
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None and _made:
            clear(spark)
    except Exception:  # the session may have ended already
        pass


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each lengthened until df has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return tuple(out)


def written(df: DataFrame) -> tuple[str, DataFrame]:
    """Where the rows were written in the shared folder, and the rows read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    _made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


#: Lets Spark delete an execution's shuffle files at its end, and not when the driver happens to collect its garbage.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, release: bool = False) -> DataFrame:
    """The same rows, written to the shared folder and read again. release: the shuffle files they came by are deleted then; df isn't to be run again."""
    if not release:
        return written(df)[1]
    conf = df.sparkSession.conf
    before = conf.get(_RELEASE, None)
    conf.set(_RELEASE, "true")
    try:
        return written(df)[1]
    finally:
        conf.unset(_RELEASE) if before is None else conf.set(_RELEASE, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_bucket(df: DataFrame, column: str = "bucket") -> DataFrame:
    """One partition a bucket number, moved by number and not by hash, so that buckets spread evenly."""
    return df.repartitionById(partitions(df.sparkSession), F.col(column).cast("int"))


#: Ids that a broadcast may hold; more are joined by a shuffle.
BROADCAST_IDS = 400_000


def restrict(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """The rows of df whose key is (left_semi) or isn't (left_anti) in ``ids``, a written table of distinct keys.

    Its size is counted: up to BROADCAST_IDS keys are broadcast, so that df
    isn't moved; beyond that both sides are shuffled, with the same result.
    """
    small = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids.hint("shuffle_hash"), key, how)


def first_by_hash(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """The n distinct rows of ``columns`` whose hash is least, n being small.

    A bound on the hash that about 3n of the rows pass goes before the sort, so
    that tasks don't each send n rows; without it if fewer than n distinct rows
    pass, so the result is the same.
    """
    rows = df.select(*columns)
    o = fresh(rows, "o")[0]
    rows = rows.withColumn(o, F.xxhash64(*columns))
    total = rows.count()
    few = rows
    if total > 3 * n:
        few = rows.where(F.col(o) < -(1 << 63) + int((1 << 64) * (3 * n / total)))
        few = few.distinct()
        if few.count() < n:
            few = rows
    return few.distinct().orderBy(o, *columns).limit(n).drop(o)

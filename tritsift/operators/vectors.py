"""Sparse ternary vectors as rows (vec_id, idx, sgn), and their algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of the smaller side of a similarity join that are broadcast at a time; a larger side is taken in blocks.
BLOCK_ROWS = 1_000_000


def draws(df: DataFrame, token: str | Column, dim: int, k: int, seed: str | Column = "s0") -> DataFrame:
    """k signed positions of each row's token, four from each md5 digest; positions may repeat, and superposing sums them. The seed may be a column."""
    t = F.col(token) if isinstance(token, str) else token
    s = F.lit(seed) if isinstance(seed, str) else seed
    digests = F.transform(F.sequence(F.lit(0), F.lit(k // 4 - 1)), lambda j: F.md5(F.concat_ws("|", s, t, j.cast("string")).cast("binary")))
    groups = F.flatten(F.transform(digests, lambda m: F.array(*(F.conv(F.substring(m, 8 * g + 1, 8), 16, 10).cast("bigint") for g in range(4)))))
    out = df.withColumn("__v", F.explode(groups))
    return out.withColumn("idx", F.pmod(F.shiftright("__v", 1), F.lit(dim)).cast("int")).withColumn("sgn", F.when(F.col("__v") % 2 == 1, 1).otherwise(-1)).drop("__v")


def superpose(parts: DataFrame, key: str, k: int | None = None, weight: str = "sgn") -> DataFrame:
    """(key, idx, sgn): the sign of each position's sum, of which the k strongest stay, the lower position first of equal ones.

    parts that are partitioned by key aren't moved again.
    """
    summed = parts.groupBy(key, "idx").agg(F.sum(weight).alias("w")).where("w <> 0")
    if k is not None:
        by = Window.partitionBy(key).orderBy(F.abs("w").desc(), "idx")
        summed = summed.withColumn("__r", F.row_number().over(by)).where(F.col("__r") <= k)
    return summed.select(key, "idx", F.signum("w").cast("int").alias("sgn"))


def encode_bag(tokens: DataFrame, key: str, token: str, dim: int, k: int, seed: str = "s0") -> DataFrame:
    """Superposed token vectors of each key. Tokens are moved by key once, before they are drawn out."""
    return superpose(draws(tokens.select(key, token).repartition(key), token, dim, k, seed).select(key, "idx", "sgn"), key, k)


def bind(vectors: DataFrame, dim: int, multiplier: int, offset: int) -> DataFrame:
    """A role's permutation of positions: a bijection where dim is a power of two and multiplier odd."""
    if multiplier % 2 == 0 or dim & (dim - 1):
        raise ValueError("an odd multiplier and a power of two are needed")
    return vectors.withColumn("idx", F.pmod(F.col("idx").cast("bigint") * multiplier + offset, F.lit(dim)).cast("int"))


def negate(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("sgn", -F.col("sgn"))


def codebook(tokens: DataFrame, token: str, dim: int, k: int, seed: str = "s0") -> DataFrame:
    """(token, idx, sgn): the vector of each distinct token, drawn once however often the token stands."""
    return superpose(draws(tokens.select(F.col(token).alias("token")).distinct().withColumn("t", F.col("token")), "t", dim, k, seed).select("token", "idx", "sgn"), "token")


def blocks(a: DataFrame, key: str) -> list[DataFrame]:
    """The vectors of ``a`` in parts of about BLOCK_ROWS rows, counted, each of which may be broadcast; a vector's rows stay together."""
    n = -(-a.count() // BLOCK_ROWS)
    return [a] if n <= 1 else [a.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def similarities(a: DataFrame, b: DataFrame, a_key: str, b_key: str, on: tuple[str, ...] = ("idx",)) -> DataFrame:
    """(a_key, b_key, dot) of the vectors that share a position, and the other columns of ``on``.

    ``a`` is the side to broadcast, in blocks of a counted size: b's postings aren't moved by position,
    of which there are no more than dimensions, and sum up where b's vectors stand if they stand together.
    """
    out = None
    rest = [c for c in on if c != "idx"]
    for part in blocks(a, a_key):
        small = part.select(*on, a_key, F.col("sgn").alias("__a"))
        met = b.join(F.broadcast(small), list(on)).groupBy(*rest, a_key, b_key).agg(F.sum(F.col("sgn") * F.col("__a")).alias("dot"))
        out = met if out is None else out.union(met)
    return out.select(*rest, a_key, b_key, "dot")


def sizes(vectors: DataFrame, key: str) -> DataFrame:
    return vectors.groupBy(key).agg(F.count("*").alias("nnz"))


def cosines(a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """(a_key, b_key, dot, cosine, overlap): overlap is the dot product over the smaller number of entries."""
    dots = similarities(a, b, a_key, b_key)
    na, nb = sizes(a, a_key).withColumnRenamed("nnz", "na"), sizes(b, b_key).withColumnRenamed("nnz", "nb")
    both = dots.join(na, a_key).join(nb, b_key)
    return both.select(a_key, b_key, "dot", F.round(F.col("dot") / F.sqrt(F.col("na") * F.col("nb")), 6).alias("cosine"), F.round(F.col("dot") / F.least("na", "nb"), 6).alias("overlap"))


def top_k(hits: DataFrame, query: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best hits of each query with their rank; of equal scores the lower tie column is first."""
    by = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(tie))
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def quantize(rows: DataFrame, key: str, array: str, k: int) -> DataFrame:
    """Ternary vectors of dense ones: the signs of the k largest magnitudes."""
    flat = rows.select(key, F.posexplode(array).alias("idx", "x")).where("x <> 0")
    by = Window.partitionBy(key).orderBy(F.abs("x").desc(), "idx")
    return flat.withColumn("__r", F.row_number().over(by)).where(F.col("__r") <= k).select(key, "idx", F.signum("x").cast("int").alias("sgn"))


def pack(vectors: DataFrame, key: str) -> DataFrame:
    """(key, idx array, sgn array), positions in order: the form at the storage edge."""
    return vectors.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", "sgn"))).alias("e")).select(key, F.col("e.idx").alias("idx"), F.col("e.sgn").alias("sgn"))


def unpack(packed: DataFrame, key: str) -> DataFrame:
    return packed.select(key, F.explode(F.arrays_zip("idx", "sgn")).alias("e")).select(key, "e.idx", "e.sgn")

"""Binary forms at the edges: sparse vectors on the wire, escapes in text, and signed file bundles."""

from __future__ import annotations

import hashlib
import hmac
import html
import json
import struct
import urllib.parse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def encode_vector(dim: int, entries: list[tuple[int, int]]) -> bytes:
    """Little-endian dimension and count, then position (u32) and sign (i8) of each entry."""
    if any(s not in (-1, 1) or not 0 <= i < dim for i, s in entries) or len({i for i, _ in entries}) < len(entries):
        raise ValueError("positions must be distinct and in range, signs +1 or -1")
    return struct.pack("<II", dim, len(entries)) + b"".join(struct.pack("<Ib", i, s) for i, s in sorted(entries))


def decode_vector(data: bytes) -> tuple[int, list[tuple[int, int]]]:
    if len(data) < 8:
        raise ValueError("no header")
    dim, n = struct.unpack_from("<II", data)
    if len(data) != 8 + 5 * n:
        raise ValueError("the length doesn't fit the count")
    entries = [struct.unpack_from("<Ib", data, 8 + 5 * k) for k in range(n)]
    encode_vector(dim, entries)
    return dim, entries


def pack_vectors(packed: DataFrame, key: str, dim: int) -> DataFrame:
    """(key, wire) of (key, idx array, sgn array)."""

    @F.pandas_udf("binary")
    def wire(idx: pd.Series, sgn: pd.Series) -> pd.Series:
        return pd.Series([encode_vector(dim, [(int(i), int(s)) for i, s in zip(a, b)]) for a, b in zip(idx, sgn)])

    return packed.select(key, wire("idx", "sgn").alias("wire"))


def unpack_vectors(wires: DataFrame, key: str) -> DataFrame:
    @F.pandas_udf("array<struct<idx: int, sgn: int>>")
    def entries(wire: pd.Series) -> pd.Series:
        return pd.Series([[{"idx": i, "sgn": s} for i, s in decode_vector(bytes(w))[1]] for w in wire])

    return wires.select(key, F.explode(entries("wire")).alias("e")).select(key, "e.idx", "e.sgn")


def unescape(text: str | None) -> str | None:
    """Percent escapes, then entities, then backslash n, t, r and backslash."""
    if text is None:
        return None
    text = html.unescape(urllib.parse.unquote(text))
    out, i = [], 0
    known = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\"}
    while i < len(text):
        if text[i] == "\\" and text[i + 1 : i + 2] in known and i + 1 < len(text):
            out.append(known[text[i + 1]])
            i += 2
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def unescaped(text: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(unescape), "string")(text)


def bundle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, sha256) of a folder's files, relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/") + "/"
    return files.select(F.substring_index(F.col("path"), root, -1).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def sign_manifest(rows: list[tuple[str, int, str]], key: bytes) -> str:
    return hmac.new(key, json.dumps(sorted(map(list, rows))).encode(), hashlib.sha256).hexdigest()


def verify_bundle(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(path, problem) of the files that are missing, changed or strange to the manifest; none for a sound bundle."""
    there = bundle_manifest(spark, folder).select("path", F.col("sha256").alias("now"))
    both = manifest.select("path", "sha256").join(there, "path", "full_outer")
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unknown").when(F.col("now") != F.col("sha256"), "changed")
    return both.select("path", problem.alias("problem")).where("problem is not null")

"""Inputs that every operator has to take."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, bucket string, u string, v string, key int, n int, h string, want string, shard string, rank int, `odd name` string"


def prose(seed, words):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioustrnl") for _ in range(r.randrange(2, 9))) for _ in range(words))


def rows(texts):
    """(doc_id, text) pairs with the extra columns filled."""
    return [(d, t, "en", None, None if t is None else len(t), "x", "b", None, "v", 1, None, "h", "w", "s", 0, "o") for d, t in texts]


LONG = prose(5, 60_000)
EDGES = [(1, None), (2, ""), (3, " \n\t\n "), (4, "one"), (4, "one"), (5, "ünïcode 世界 \U0001f600 'll x's"), (None, prose(1, 80)), (6, prose(1, 80)), (6, prose(1, 80)), (7, prose(2, 60)), (7, prose(3, 60)), (8, LONG), (9, LONG), (10, "a " * 500), (11, "\x00\x01 control"), (12, "z" * 100_000)]


def edge_docs(spark):
    return spark.createDataFrame(rows(EDGES), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA)

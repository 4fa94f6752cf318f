"""URL filter: a weighted vocabulary found by an Aho-Corasick automaton.

A term counts where neither neighbour in the lower-cased URL is an ASCII letter
or digit. A URL is rejected on one strict term, or when its distinct soft terms
weigh ``soft_limit`` or more together, which takes several, as every soft
weight is below the limit. A null URL has no hits and is kept; an empty table
gives an empty result; repeated rows are judged each; other columns are left.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRICT = ("casino", "porn", "xxx", "viagra", "spam", "escort", "warez", "pills", "phishing", "malware")
SOFT = {"cheap": 1.0, "free": 1.0, "bets": 1.5, "bet": 1.5, "win": 1.0, "ads": 1.5, "track": 1.0, "tracker": 1.0, "poker": 1.5, "loan": 1.0, "adult": 1.5, "farm": 0.5, "bonus": 1.0, "click": 1.0}


@dataclass(frozen=True)
class UrlVocabulary:
    strict: tuple[str, ...] = STRICT
    soft: dict[str, float] = field(default_factory=lambda: dict(SOFT))
    soft_limit: float = 2.0


def url_filter(pages: DataFrame, vocabulary: UrlVocabulary = UrlVocabulary(), key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, url, strict_hits, soft_hits, soft_weight, rejected): distinct terms found, and the verdict."""
    strict, soft, limit = vocabulary.strict, vocabulary.soft, vocabulary.soft_limit
    if any(w >= limit for w in soft.values()):
        raise ValueError("one soft term must not reach the limit alone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for term in {*strict, *soft}:
            found.add_word(term, term)
        if len(found):
            found.make_automaton()
        inner = frozenset(string.ascii_lowercase + string.digits)
        weight = {t: 0.0 for t in strict} | dict(soft)
        hard = frozenset(strict)

        def judge(u: str | None) -> tuple[int, int, float, bool]:
            u = (u or "").lower()
            hits = set()
            for end, term in found.iter(u) if len(found) else ():
                if (end + 1 == len(u) or u[end + 1] not in inner) and (end < len(term) or u[end - len(term)] not in inner):
                    hits.add(term)
            s = hits & hard
            w = sum(sorted(weight[t] for t in hits - s))
            return len(s), len(hits - s), w, bool(s) or w >= limit

        for batch in batches:
            k, u = batch.columns
            got = [judge(x) for x in u.to_pylist()]
            cols = list(zip(*got)) or [(), (), (), ()]
            yield pa.record_batch([k, u, pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_())], names=[key, url, "strict_hits", "soft_hits", "soft_weight", "rejected"])

    return pages.select(F.col(key).cast("bigint"), F.col(url).cast("string")).mapInArrow(run, f"`{key}` bigint, `{url}` string, strict_hits int, soft_hits int, soft_weight double, rejected boolean")


def url_filter_sql(vocabulary: UrlVocabulary = UrlVocabulary(), table: str = "pages", key: str = "page_id", url: str = "url") -> str:
    """The same result in DuckDB's SQL."""
    hit = lambda t: f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT"
    soft = {t: w for t, w in vocabulary.soft.items() if t not in vocabulary.strict}
    strict = " + ".join(map(hit, vocabulary.strict)) or "0"
    count = " + ".join(map(hit, soft)) or "0"
    weight = " + ".join(f"{w} * {hit(t)}" for t, w in soft.items()) or "0"
    return f"""SELECT {key}, {url}, s::INT AS strict_hits, c::INT AS soft_hits, w::DOUBLE AS soft_weight, s > 0 OR w >= {vocabulary.soft_limit} AS rejected
FROM (SELECT {key}, {url}, {strict} AS s, {count} AS c, ({weight})::DOUBLE AS w FROM (SELECT *, lower(coalesce({url}, '')) AS u FROM {table}))"""

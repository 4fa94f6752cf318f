"""Incremental ingest and keyed state by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tritsift.operators import vectors as V


def ingest_vectors(triples: DataFrame, folder: str, dim: int, k: int, checkpoint: str) -> StreamingQuery:
    """Appends the vectors of a stream of (vec_id, subject, relation) by the encoder that batches use; a batch that is repeated overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        tokens = batch.select("vec_id", F.explode(F.array("subject", "relation")).alias("token")).distinct()
        V.encode_bag(tokens, "vec_id", "token", dim, k).write.mode("overwrite").parquet(f"{folder}/batch={number:08d}")

    return triples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Tumbling hours by event type; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


#: Stability of a new association in days, below what retention it is dropped, and how many are kept for a root.
STABILITY, FLOOR, KEPT = 1.0, 0.1, 5


def reinforce(held: dict[str, tuple[float, float]], term: str, day: float) -> None:
    """held: term -> (stability in days, day of the last sight). A sight doubles the stability of a known term."""
    stability = held[term][0] * 2 if term in held else STABILITY
    held[term] = (stability, max(day, held[term][1]) if term in held else day)


def retention(stability: float, last: float, now: float) -> float:
    return 2.718281828459045 ** (-max(now - last, 0.0) / stability)


def associations(stream: DataFrame) -> DataFrame:
    """(root, term, retention, count) after each batch of (root, term, ts): the strongest terms of each root that was seen."""

    def step(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[float, float]] = {}
        count: dict[str, int] = {}
        for term, stability, last, n in zip(*state.get) if state.exists else ():
            held[term], count[term] = (stability, last), n
        now = max((last for _, last in held.values()), default=0.0)
        rows = pd.concat(list(frames)).sort_values(["ts", "term"])
        for term, ts in zip(rows["term"], rows["ts"]):
            day = ts.timestamp() / 86400
            reinforce(held, term, day)
            count[term] = count.get(term, 0) + 1
            now = max(now, day)
        held = {t: v for t, v in held.items() if retention(*v, now) >= FLOOR}
        state.update(([*held], [v[0] for v in held.values()], [v[1] for v in held.values()], [count[t] for t in held]))
        best = sorted(held, key=lambda t: (-retention(*held[t], now), -count[t], t))[:KEPT]
        yield pd.DataFrame({"root": [key[0]] * len(best), "term": best, "retention": [retention(*held[t], now) for t in best], "count": [count[t] for t in best]})

    return stream.groupBy("root").applyInPandasWithState(step, "root string, term string, retention double, count long", "terms array<string>, stability array<double>, last array<double>, count array<long>", "update", GroupStateTimeout.NoTimeout)

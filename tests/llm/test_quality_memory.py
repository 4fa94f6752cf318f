"""What the driver holds while it fits the quality classifier, and that packing its features changes nothing."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tritsift.llm import quality

P = quality.QualityParams(bits=16, epochs=1)


@pytest.mark.parametrize("text", ["", "one", "a a a, b a; a b " * 40, " ".join(map(str, range(3000))), "é " * 70_000])
def test_features_come_back(text):
    idx, _ = quality.features(pa.array([text]), P)
    u, c = np.unique(idx, return_counts=True)
    i, v = quality._unpack(*quality._pack(idx))
    assert i.tolist() == u.tolist() and v.tolist() == (c / np.sqrt(max(len(idx), 1))).astype(np.float32).tolist()


def test_driver_holds_packed_features(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(n, " ".join(f"w{x}" for x in r.integers(0, 50_000, 600)) + " good" * (n % 2)) for n in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(n, n % 2) for n, _ in rows], "doc_id bigint, quality int")
    total = sum(len(np.unique(quality.features(pa.array([t]), P)[0])) for _, t in rows)
    given_back = []
    monkeypatch.setattr(quality.tx, "tidy", lambda: given_back.append(1))
    quality.train(docs, labels, P)
    tracemalloc.start()
    try:
        model = quality.train(docs, labels, P)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.count_nonzero(model.weights) and total > 600_000
    assert peak < 8 * total, f"{peak / total:.1f} bytes for each feature of a text"
    assert given_back

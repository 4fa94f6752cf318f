"""Links are counted within groups: no table of all pairs is written, and blocks of a large group lose none."""

import numpy as np

from tests.llm.test_jaccard_whole import brute_links
from tritsift.llm import jaccard, overlap, store


def crowd(n, first=0):
    r = np.random.default_rng(n)
    base, texts = [f"b{first}x{i}" for i in range(60)], []
    for d in range(n):
        w = list(base)
        for at in r.integers(0, 60, int(r.integers(0, 8))):
            w[at] = f"o{r.integers(1 << 40)}"
        texts.append((first + d, " ".join(w)))
    return texts


def test_written_rows_follow_the_documents(spark, monkeypatch):
    rows, written = [], store.written

    def counted(df):
        path, got = written(df)
        rows.append(got.count())
        return path, got

    monkeypatch.setattr(store, "written", counted)
    n = 300
    got = jaccard.near_links(spark.createDataFrame(crowd(n), "doc_id bigint, text string")).collect()
    assert len(got) > 0.9 * n and sum(r.links for r in got) > 20 * 2 * n  # far more pairs than rows
    assert max(rows) <= 4 * n, rows


def test_blocks_of_a_group(spark, monkeypatch):
    texts = crowd(60) + crowd(40, 100) + [(200 + i, t) for i, (_, t) in enumerate(crowd(60)[::7])]
    for sets, size, meetings in ((7, 4 << 20, 1), (2048, 2000, 900), (1, 1, 4 << 20)):
        monkeypatch.setattr(overlap, "_BLOCK_SETS", sets)
        monkeypatch.setattr(overlap, "_BLOCK_BYTES", size)
        monkeypatch.setattr(overlap, "_MEETINGS", meetings)
        got = {tuple(x) for x in jaccard.near_links(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
        assert got == brute_links(texts)


def test_meetings_in_parts(monkeypatch):
    """What a partition counts doesn't hang on how many meetings are counted at once."""
    import pyarrow as pa

    from tritsift.llm import packed

    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 30, int(r.integers(5, 25)))).astype("<u8") for _ in range(50)]
    cell, side = np.array([i % 3 for i in range(50)]), np.array([2 if i % 3 else i % 2 for i in range(50)])
    batch = pa.record_batch({"cell": pa.array(cell), "side": pa.array(side.astype(np.int32)), "cid": pa.array(np.arange(50)), "n": pa.array([len(s) for s in sets], pa.int32()), "many": pa.array(np.arange(50) + 1), "tokens": pa.array([packed.squeeze(s) for s in sets], pa.binary())})
    want = {}
    for i in range(50):
        for j in range(50):
            if i != j and cell[i] == cell[j] and (side[i] == 2 or side[i] != side[j]):
                same = len(np.intersect1d(sets[i], sets[j]))
                if same / (len(sets[i]) + len(sets[j]) - same) >= 0.5:
                    want[i] = want.get(i, 0) + j + 1
    assert want
    for meetings in (1, 40, 1000, 4 << 20):
        monkeypatch.setattr(overlap, "_MEETINGS", meetings)
        out = list(overlap._degrees(0.5)(iter([batch])))[0]
        assert dict(zip(out["cid"].to_pylist(), out["near"].to_pylist())) == want

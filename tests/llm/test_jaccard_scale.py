"""Candidates of unrelated sets, and links in large buckets."""

import numpy as np

from tests.llm.test_near import brute_groups
from tritsift.llm import jaccard, packed

P = jaccard.JaccardParams()


def records(sets):
    """The records of sets of hashes as near_groups shuffles them."""
    size = np.array([len(s) for s in sets])
    g, owner = np.concatenate([np.sort(s) for s in sets]), np.repeat(np.arange(len(sets)), size)
    keys, row, step = jaccard.block_keys(g, owner, size, P)
    band = jaccard.band_of(size, P.threshold)
    sk = np.stack([jaccard.sketches(g, owner, jaccard.sampling(band + i, P.threshold)) for i in (0, 1)], 1)[row, step]
    return {"key": keys, "id": row, "n": size[row], "power": jaccard.sampling(band[row] + step, P.threshold)} | {f"s{i}": sk[:, i] for i in range(8)}


def links(sets):
    out = set()
    for b in jaccard._links(P)(records(sets)):
        out |= set(zip(b["u"].to_pylist(), b["v"].to_pylist()))
    return out


def test_unrelated_sets_meet_in_proportion():
    r = np.random.default_rng(3)
    met = []
    for n in (1000, 4000, 16000):
        sets = [r.integers(0, 1 << 63, int(k), dtype=np.uint64) for k in r.integers(60, 120, n)]
        _, length = packed.runs(np.sort(records(sets)["key"]))
        met.append(int((length * (length - 1) // 2).sum()))
    assert met[-1] <= 16


def alike(r, s, share):
    """A set that shares ``share`` of all n-grams with s, which is of the same size."""
    keep = round(len(s) * 2 * share / (1 + share))
    return np.concatenate([r.permutation(s)[:keep], r.integers(0, 1 << 63, len(s) - keep, dtype=np.uint64)])


def test_links_in_crowded_buckets():
    """Chains of pairs at 0.55 in buckets that many others share by boilerplate."""
    r = np.random.default_rng(4)
    boiler = r.integers(0, 1 << 63, 48, dtype=np.uint64)
    for others in (100, 1500):
        sets, want = [], set()
        for _ in range(40):
            a = np.concatenate([boiler, r.integers(0, 1 << 63, 100, dtype=np.uint64)])
            b = alike(r, a, 0.55)
            c = alike(r, b, 0.55)
            want |= {(len(sets) + 1, len(sets)), (len(sets) + 2, len(sets) + 1)}
            sets += [a, b, c]
        sets += [np.concatenate([boiler, r.integers(0, 1 << 63, 100, dtype=np.uint64)]) for _ in range(others)]
        got = links(sets)
        root = list(range(len(sets)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        exact = lambda x, y: len(np.intersect1d(sets[x], sets[y])) / len(np.union1d(sets[x], sets[y]))  # noqa: B023, E731
        for x, y in got:
            if exact(x, y) >= P.threshold:
                root[find(x)] = find(y)
        assert sum(find(x) == find(y) for x, y in want) >= 0.97 * len(want), others


def test_a_large_group_of_copies_is_one(spark):
    r = np.random.default_rng(5)
    words = [f"word{n}" for n in range(120)]
    texts = []
    for d in range(400):
        w = list(words)
        for i in r.integers(0, 120, int(r.integers(0, 5))):
            w[i] = f"other{r.integers(1 << 40)}"
        texts.append((d, " ".join(w)))
    got = {tuple(x) for x in jaccard.near_groups(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got == brute_groups(texts)[1]

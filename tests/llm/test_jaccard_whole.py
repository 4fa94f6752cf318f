"""No link is lost: the Jaccard join against all pairs, where sketches and leaders leave some out."""

import collections

import numpy as np

from tests.llm.test_near import brute_groups
from tritsift.llm import jaccard


def at_the_threshold(groups):
    """Pairs of texts of 120 three-word runs and of half of these, so that each group rests on one link at 0.5."""
    texts = []
    for g in range(groups):
        words = [f"w{g}x{i}" for i in range(122)]
        texts += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words[:62]))]
    return texts


def brute_links(texts):
    pairs, groups = brute_groups(texts)
    n = collections.Counter(d for p in pairs for d in p)
    return {(*g, n[g[0]]) for g in groups}


def test_links_at_the_threshold(spark):
    texts = at_the_threshold(groups=2500)
    pairs, _ = brute_groups(texts[:20])
    assert len(pairs) == 10 and set(pairs.values()) == {0.5}
    got = {tuple(x) for x in jaccard.near_links(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got == {(d, d - d % 2, d % 2 == 0, 1) for d in range(5000)}


def test_links_of_crowds(spark):
    """Many near copies of one text, chained at both sides of the threshold, under a phrase that all texts share."""
    r = np.random.default_rng(7)
    phrase = [f"p{i}" for i in range(30)]
    texts, d = [], 0
    for g in range(6):
        base = [f"b{g}x{i}" for i in range(90)]
        for _ in range(40):
            w = list(base)
            for at in r.integers(0, 90, int(r.integers(0, 16))):
                w[at] = f"o{r.integers(1 << 40)}"
            texts.append((d, " ".join(phrase + w)))
            d += 1
    texts += [(d + i, texts[i * 3][1]) for i in range(20)] + [(900, None), (901, ""), (None, texts[0][1])]
    got = {tuple(x) for x in jaccard.near_links(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got == brute_links(texts)


def test_links_of_a_repeated_id(spark):
    a, b = "one two three four five six", "one two three four five seven"
    texts = [(1, a), (1, b), (2, a), (2, a), (3, "something quite different from all others")]
    got = {tuple(x) for x in jaccard.near_links(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got == {(1, 1, True, 2), (2, 1, False, 2)}


def test_dedup_at_the_threshold(spark):
    left = jaccard.near_dedup(spark.createDataFrame(at_the_threshold(groups=2500), "doc_id bigint, text string"))
    assert {r.doc_id for r in left.collect()} == set(range(0, 5000, 2))

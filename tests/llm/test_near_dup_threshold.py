"""The near-dedup stage of the pipeline links from 0.80 on, the op8 query from 0.85."""

import random

import corpus_pipeline
from postlens.llm import near_dup

from .test_near_dup import shingles


def roots(texts, per_cent):
    """The smallest index of each text's component, over links of brute force."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, one in enumerate(sets):
        for j in range(i):
            if (both := len(one & sets[j])) and 100 * both >= per_cent * len(one | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def pairs_and_family():
    """Near copies under, at and over 0.80: pairs, and one crowded family."""
    rng, texts = random.Random(80), []
    for f, n in enumerate([2] * 30 + [40]):
        base = [f"f{f}w{i}" for i in range(84)]  # 80 shingles; k changed words at the end leave 80 - k
        texts.append(" ".join(base))
        for _ in range(n - 1):
            k = rng.randint(5, 11)
            texts.append(" ".join(base[:-k] + [f"f{f}n{rng.randrange(10**6)}" for _ in range(k)]))
    return texts


def test_stage_links_from_80_per_cent(spark, sf):
    texts = pairs_and_family()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {k: {i for i, r in enumerate(roots(texts, k)) if i == r} for k in (80, 85)}
    assert kept[80] < kept[85]
    assert {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["MinHash near-dedup"](spark, docs, sf).collect()} == kept[80]
    assert {r["doc_id"] for r in near_dup.near_groups(docs).where("kept").collect()} == kept[85]

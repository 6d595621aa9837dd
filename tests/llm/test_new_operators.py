"""Similarity join, centroid clustering and resampling against brute force, on odd rows and skewed groups."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from postlens.llm import centroids, jaccard_join, quality, resampling

from . import odd


def grams(text, size):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def linked(a, b, per_cent):
    both = len(a & b)
    return both and 100 * both >= per_cent * (len(a) + len(b) - both)


def brute_groups(rows, size=3, per_cent=90):
    """<key, n, component> of each row, over links between distinct <key, text>."""
    nodes = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], r[1] or ""))
    sets, root = [grams(t, size) for _, t in nodes], list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, one in enumerate(sets):
        for j in range(i):
            if linked(one, sets[j], per_cent):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    at = {node: nodes[find(i)][0] for i, node in enumerate(nodes)}
    return Counter((k, len(grams(t, size)), at.get((k, t))) for k, t in rows)


def families(seed=4):
    rng, texts = random.Random(seed), []
    for f, (n, changes, length) in enumerate([(150, 4, 120), (60, 3, 60), (5, 1, 30), (60, 1, 10), (30, 1, 5), (25, 30, 900)]):
        base = [f"f{f}w{i}" for i in range(length)]
        for _ in range(n):
            words = list(base)
            for _ in range(rng.randint(0, changes)):
                words[rng.randrange(length)] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    return texts


def test_groups_and_pairs_of_families_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 32)
    texts = families()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = jaccard_join.similar_groups(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(map(tuple, got.collect())) == brute_groups(list(enumerate(texts)))
    least = {}
    for i, t in enumerate(texts):
        least.setdefault(grams(t, 3), i)
    sets = sorted((i, s) for s, i in least.items())
    want = {(i, j) for n, (i, a) in enumerate(sets) for j, b in sets[n + 1:] if linked(a, b, 90)}
    assert {tuple(r) for r in jaccard_join.similar_pairs(docs).collect()} == want and len(want) > 500


def test_groups_of_odd_rows(spark):
    docs = odd.documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, jaccard_join.similar_groups(docs).collect())) == brute_groups(rows)
    assert jaccard_join.similar_groups(odd.empty(spark)).count() == 0


@pytest.mark.parametrize("per_cent", [80, 90])
def test_tiles_and_bitmaps_never_part_a_link(per_cent):
    rng = np.random.default_rng(7)
    for n in [*range(1, 40), 100, 333, 2000]:
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for m in {max(1, n * per_cent // 100), n, n * 100 // per_cent}:
            most = jaccard_join.most_different(n, m, per_cent)
            shared = (n + m - most) // 2
            b = np.unique(np.concatenate((a[rng.permutation(n)[:shared]], rng.integers(0, 2**63, max(m - shared, 0), dtype=np.uint64))))
            if not jaccard_join.linked(a, b, per_cent):
                continue
            (ka, ra), (kb, rb) = jaccard_join.tile_keys(a, per_cent), jaccard_join.tile_keys(b, per_cent)
            roles = defaultdict(list)
            for k, r in [*zip(ka, ra), *zip(kb, rb)]:
                roles[k].append(r)
            assert any(len(r) > 1 and min(r) == 0 for r in roles.values())
            bits = jaccard_join.folded([jaccard_join.bitmap(a, per_cent), jaccard_join.bitmap(b, per_cent)])
            apart = np.bitwise_count(bits[0] ^ bits[1]).sum()
            assert apart <= len(np.setxor1d(a, b)) and jaccard_join.may_link(np.array([len(a)]), np.array([len(b)]), np.array([apart]), per_cent)[0]


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) <= centroids.LARGEST / 64 for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    middle = [list(v) for _, v in order[:k]]
    gap = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for turn in range(rounds + 1):
        at = [min(range(len(middle)), key=lambda c: (gap(v, middle[c]), c)) for _, v in kept]
        if turn < rounds:
            for c in range(len(middle)):
                own = [v for (_, v), a in zip(kept, at) if a == c]
                if own:
                    middle[c] = [sum(x) // len(own) for x in zip(*own)]
    dist = [gap(v, middle[a]) for (_, v), a in zip(kept, at)]
    each = Counter()
    for a, d in zip(at, dist):
        each[a] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return Counter((i, a, d, each[a], sum(dist), sha[a]) for (i, _), a, d in zip(kept, at, dist))


@pytest.mark.parametrize("bits", [2, 6])
def test_clusters_with_odd_vectors(spark, monkeypatch, bits):
    monkeypatch.setattr(centroids, "BITS", bits)
    for name in ("cell_edges", "packed", "unpacked"):  # the defaults were bound when the functions were made
        fn = getattr(centroids, name)
        monkeypatch.setattr(fn, "__defaults__", tuple(bits if d == 6 else d for d in fn.__defaults__))
    rng = np.random.default_rng(5)
    middle = rng.normal(0, 0.3, (5, 64))
    rows = [(i, [float(x) for x in middle[i % 5] * (0 if i % 3 == 0 else 1) + rng.normal(0, 0.05, 64)]) for i in range(150)]
    rows += [(200, [0.5] * 64), (201, [0.5] * 64), (200, [0.5] * 64), (None, [0.25] * 64), (300, None), (301, []), (302, [1.0] * 63), (303, [None] + [1.0] * 63),
             (304, [float("nan")] + [1.0] * 63), (305, [float("inf")] + [1.0] * 63), (306, [3e30] * 64), (307, [1000.0] * 64)]
    vectors = spark.createDataFrame([(i, v, "own") for i, v in rows], "vec_id long, embedding array<float>, cluster string").repartition(4)
    got = centroids.cluster(vectors)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, got.collect())) == brute_clusters(rows)
    assert centroids.cluster(vectors.limit(0)).count() == 0
    few = vectors.where("vec_id in (200, 307)")
    assert Counter(map(tuple, centroids.cluster(few).collect())) == brute_clusters([r for r in rows if r[0] in (200, 307)])


def brute_draw(rows, target, runs=1, buckets=10_000, seed=2024):
    def features(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        return words, [" ".join(words[i:i + n]) for n in range(1, runs + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    corpus, goal = Counter(), Counter()
    for _, t in rows:
        corpus.update(map(bucket, features(t)[1]))
    for t in target:
        goal.update(map(bucket, features(t)[1]))
    s_all, t_all = sum(corpus.values()), sum(goal.values())
    gain = lambda b: math.floor(1000 * math.log((goal[b] + 1) * (s_all + buckets) / ((corpus[b] + 1) * (t_all + buckets))))
    out = []
    for key, t in rows:
        words, found = features(t)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words) >= 20))
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    return out, fit[:10 * len(fit) // 100]


@pytest.mark.parametrize("runs,head", [(1, 20_000), (2, 5), (3, 5)])
def test_draw_is_brute_force_with_any_head(spark, monkeypatch, runs, head):
    monkeypatch.setattr(resampling, "HEAD", head)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the", "Alpha", "beta9", "gamma", f"x{rng.randrange(99)}", "café", "中文", "a-b"]) for _ in range(rng.randrange(60)))) for i in range(200)]
    target = ["the alpha café", None, "gamma the", ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    out, drawn = brute_draw(rows, target, runs)
    rank = {r[0]: i + 1 for i, r in enumerate(drawn)}
    got = resampling.resample(docs, goal, runs=runs)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == Counter((*r[:4], rank.get(r[0])) for r in out) and rank


def test_draw_of_odd_rows(spark):
    docs = odd.documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    goal = spark.createDataFrame([("t1 t2 t3",)], "text string")
    out, drawn = brute_draw(rows, ["t1 t2 t3"])
    got = resampling.resample(docs, goal).collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(r[:4] for r in out)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))
    assert resampling.resample(odd.empty(spark), goal).count() == 0 and resampling.resample(docs, goal.limit(0)).count() == len(rows)
    assert resampling.drawn(docs, goal).columns == docs.columns


def test_quality_is_the_same_when_all_words_are_counted(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    by_summary = sorted(map(tuple, quality.judge(docs).collect()))
    monkeypatch.setattr(quality, "MOST_CANDIDATES", 0)
    assert sorted(map(tuple, quality.judge(docs).collect())) == by_summary
    assert any(r[-1] is not None for r in by_summary)

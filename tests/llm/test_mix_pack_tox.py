"""Mixing, packing and toxicity: invariants, exact round trips, held-out accuracy."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm import mixing, packing, toxicity
from postlens.llm.tokens import Encoder, tokenizer_path

from . import odd

# --- mixing -------------------------------------------------------------------------------


def test_water_level():
    assert mixing.water_level([10, 10, 10], [1, 1, 1]) == [15, 15, 15]
    assert mixing.water_level([0, 0], [5, 2]) == [0, 0] and mixing.water_level([], []) == []
    sizes, weights = [100, 5, 40, 7], [5, 2, 1, 5]
    targets = mixing.water_level(sizes, weights)
    assert sum(targets) == pytest.approx(1.5 * sum(sizes)) and all(t <= 2 * s for t, s in zip(targets, sizes))
    free = [t / w for t, w, s in zip(targets, weights, sizes) if t < 2 * s]
    assert max(free) == pytest.approx(min(free))


def test_draws_meet_slots_exactly():
    for slots in ([7, 0, 300, 41], [1], [0, 0]):
        counts = mixing.draw_counts(slots, 8, 1)
        assert counts.sum(axis=0).tolist() == slots and (counts >= 0).all()
        assert max(counts.sum(axis=1)) - min(counts.sum(axis=1)) <= 8


def test_permutation_is_one(spark):
    for n in (1, 2, 97, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit(0)).alias("x")).collect()
        assert sorted(r[0] for r in got) == list(range(n))


def test_mix_of_odd_rows(spark):
    docs = odd.documents(spark)
    mix = mixing.Mix(docs, block_words=16, shards=4)
    got = mix.report().collect()
    assert len(got) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    sizes = Counter()
    for r in docs.select("text", "source").collect():
        sizes[r["source"]] += len((r["text"] or "").encode().split())
    assert sum(r["size"] for r in got) == sum(sizes.values())
    again = mixing.Mix(docs, block_words=16, shards=4).report()
    key = lambda r: tuple("" if v is None else v for v in r)
    assert Counter(map(key, got)) == Counter(map(key, again.collect()))
    assert mix.documents().columns == docs.columns
    blocks = mix.blocks().collect()
    assert sum(len(b["text"].encode().split()) for b in blocks) <= sum(r["taken"] for r in got)


def test_mix_meets_targets_and_carries_text(spark):
    docs = spark.range(1200).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, cast(5 + id % 90 as int)), i -> concat('w', id, '_', i))) as text",
                                        "if(id % 3 = 0, 'hot', concat('s', id % 7)) as source", "0L as n_chars")
    mix = mixing.Mix(docs, block_words=32)
    got = mix.report().withColumn("source", F.expr("if(doc_id % 3 = 0, 'hot', concat('s', doc_id % 7))")).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 32 + 0.01 * t for s, t in target.items())
    words = Counter()
    for r in mix.documents().collect():
        for w in r["text"].split():
            words[w] += 1
    by_doc = defaultdict(int)
    for w, n in words.items():
        assert n <= 2
        by_doc[int(w[1:].split("_")[0])] += n
    assert {r["doc_id"]: r["taken"] for r in got if r["taken"]} == by_doc
    in_blocks = Counter(w for b in mix.blocks().collect() for w in b["text"].split())
    assert in_blocks == words


def test_empty_mix(spark):
    mix = mixing.Mix(odd.empty(spark))
    assert mix.report().count() == mix.documents().count() == mix.blocks().count() == 0
    blank = spark.createDataFrame([(1, None, "s"), (2, " ", "s")], "doc_id long, text string, source string")
    assert [tuple(r)[1:] for r in mixing.Mix(blank).report().collect()] == [(0, 0, 0.0, 0)] * 2


# --- packing ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return Encoder(tokenizer_path())


def plain_ids(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def test_encoder_equals_tokenizer(encoder):
    rng = random.Random(3)
    pools = ["abcXYZ 'sd12.,!\n\t", "éÀßñ Őžİıſ", "αΣσς дЙё", "中文かガ", "\x0b\x1c\x85\xa0 ‍﻿", "éä", "\U0001f600\U0001f468<|endoftext|>", "\x00\x07\x7f"]
    for _ in range(4000):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 14)))
        want = np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder.encode(text) == want, repr(text)
    assert encoder.encode("a <|endoftext|> b") == np.array(encoder.tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids, "<u4").tobytes()


def test_pieces_round_trip(spark, encoder):
    docs = odd.documents(spark)
    got = packing.pack(docs, tokenizer_path()).collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = plain_ids(encoder, r["text"])
        for i, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            want[r["doc_id"], i, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    check_layout([(r["sequence_id"], r["offset"], r["length"]) for r in got])
    assert len({r["sequence_id"] for r in got}) == -(-sum(r["length"] for r in got) // 4096)


def check_layout(rows):
    by = defaultdict(list)
    for sequence, offset, length in rows:
        by[sequence].append((offset, length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


def test_packed_ids_hold_every_row(spark, encoder):
    docs = odd.documents(spark)
    got = packing.packed_ids(docs, tokenizer_path()).collect()
    check_layout([(r["sequence_id"], r["offset"], len(r["input_ids"])) for r in got])
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = plain_ids(encoder, r["text"])
        for i, at in enumerate(range(0, len(ids), 4096)):
            want[r["doc_id"], i, tuple(ids[at:at + 4096])] += 1
    assert Counter((r["doc_id"], r["piece"], tuple(r["input_ids"])) for r in got) == want


def test_empty_packing(spark):
    assert packing.pack(odd.empty(spark), tokenizer_path()).count() == packing.packed_ids(odd.empty(spark), tokenizer_path()).count() == 0


@pytest.mark.parametrize("histogram", [{}, {4096: 3}, {1: 9000}, {2049: 5, 2047: 5, 2048: 4}, {1366: 900, 1365: 10, 600: 50},
                                       {n: n % 7 for n in range(1, 4096, 13)}, {3000: 10, 1000: 10, 96: 10}])
def test_plans_place_each_piece_once(histogram):
    plan = packing.plan_packing(histogram)
    rows = []
    for length, places in plan.rows.items():
        ends = [p[0] for p in places[1:]] + [histogram[length]]
        for (start, first, copies, offset), end in zip(places, ends):
            rows += [(first + (r - start) // copies, offset + (r - start) % copies * length, length) for r in range(start, end)]
    assert Counter(r[2] for r in rows) == Counter({k: v for k, v in histogram.items() if v})
    check_layout(rows)
    total = sum(k * v for k, v in histogram.items())
    assert -(-total // 4096) <= plan.sequences == len({r[0] for r in rows})
    assert plan.sequences <= 2 * total / 4096 + 1


def test_few_sizes_are_optimal():
    assert packing.plan_packing({2049: 5, 2047: 5, 2048: 4}).sequences == 7
    assert packing.plan_packing({3000: 10, 1000: 10, 96: 10}).sequences == 10


# --- toxicity -----------------------------------------------------------------------------


def labelled(spark, n=1600, rude=1.0):
    """Rude words make a text toxic; a group's name stands in toxic texts more often than in others, but means nothing."""
    rng = random.Random(11)
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        words = [f"w{rng.randrange(400)}x" for _ in range(30)]
        words += [rng.choice(["vileness", "vilest", "scoundrel"])] if toxic and rng.random() < rude else []
        words += ["women"] if rng.random() < (0.9 if toxic else 0.05) else []
        rng.shuffle(words)
        rows.append((i, " ".join(words), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()


def test_swapped_names_keep_the_score(spark, monkeypatch):
    rows = labelled(spark, rude=0.6)
    neutral = spark.createDataFrame([(1, "the women read w1x and w2x"), (2, "the men read w1x and w2x"), (3, "you scoundrel")], "doc_id long, text string")
    scores = {}
    for penalty in (0.0, 30.0):
        monkeypatch.setattr(toxicity.fit, "__defaults__", (penalty,))
        got = toxicity.score(neutral, toxicity.train(rows, rows)).collect()
        scores[penalty] = {r["doc_id"]: r["score"] for r in got}
    assert scores[0.0][1] > 0.3 > scores[30.0][1]
    assert abs(scores[30.0][1] - scores[30.0][2]) < 0.05 and scores[30.0][3] > 0.3


def test_loss_and_gradient():
    rng = np.random.default_rng(4)
    labels, w = rng.integers(0, 2, 9).astype(float), rng.normal(size=6)
    own = [sorted(rng.choice(5, 2, replace=False).tolist()) for _ in labels]
    swaps = [[None, ([0], [1]), ([], [2]), *[None] * 6], [([3], []), *[None] * 8]]
    rows, cols = toxicity._csr(own)
    pairs = [(2, np.array([0, 0, 1]), np.array([0, 1, 2]), np.array([1.0, -1, -1])), (1, np.array([0]), np.array([3]), np.array([1.0]))]

    def plain(w):
        total = 0.0
        for y, has in zip(labels, own):
            p = 1 / (1 + np.exp(-(w[has].sum() + w[-1])))
            total -= (y * np.log(p) + (1 - y) * np.log(1 - p)) / len(labels)
        for one in swaps:
            gaps = [w[c[0]].sum() - w[c[1]].sum() for c in one if c is not None]
            total += 0.7 * sum(g * g for g in gaps) / len(gaps)
        return total + toxicity.L2 / 2 * (w[:-1] ** 2).sum()

    loss, grad = toxicity.loss_and_gradient(w, labels, rows, cols, pairs, 0.7)
    assert abs(loss - plain(w)) < 1e-9
    for i in range(len(w)):
        step = np.zeros_like(w)
        step[i] = 1e-6
        assert abs((plain(w + step) - plain(w - step)) / 2e-6 - grad[i]) < 1e-6
    fitted, intercept = toxicity.fit(labels, own, swaps, 5, 0.7)
    assert plain(np.r_[fitted, intercept]) < min(plain(np.zeros(6)), loss)


def test_mutual_nearest():
    rng = np.random.default_rng(5)
    table = np.vstack([rng.integers(0, 4, (40, 8)), np.zeros((2, 8)), np.ones((3, 8))]).astype(float)
    unit = [r / (np.linalg.norm(r) or 1) for r in table]
    best = []
    for i, r in enumerate(unit):
        near = [(-round(float(r @ o), 9), j) for j, o in enumerate(unit) if j != i]
        best.append(min(near)[1] if min(near)[0] < 0 else -1)
    wanted = [(i, j) for i, j in enumerate(best) if i < j and best[j] == i]
    assert toxicity.mutual_nearest(table, block=7) == wanted and wanted
    assert toxicity.mutual_nearest(np.zeros((3, 4))) == []


def companions(spark, n=1200):
    """Two words stand in the same places of texts of both labels, so they are a kind that no list names."""
    rng = random.Random(12)
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        words = [f"the {rng.choice(['zorbs', 'quills'])} went home", f"a {rng.choice(['lamp', 'stone'])} fell", rng.choice(["vileness", "x"]) if toxic else "y"]
        rng.shuffle(words)
        rows.append((i, " ".join(words), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()


def test_kinds_are_derived_where_the_list_finds_nothing(spark, monkeypatch):
    rows = companions(spark)
    sample = rows.select("text", F.col("toxic").alias("label"))
    counts = sample.mapInArrow(toxicity._counts, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    totals = dict(sample.groupBy("label").count().collect())
    pairs = {tuple(sorted(p)) for p in toxicity.derived_kinds(sample, counts, totals[1], totals[0])}
    assert {("quills", "zorbs"), ("lamp", "stone")} <= pairs
    assert not any({"vileness", "x", "y"} & set(p) for p in pairs)
    assert not any("zorbs" in p for p in toxicity.derived_kinds(sample, counts, totals[1], totals[0], taken=["zorbs"]))
    monkeypatch.setattr(toxicity.fit, "__defaults__", (30.0,))
    fitted = toxicity.fit_sample(rows, rows)
    by_origin = {s.origin: s for s in fitted.swaps}
    assert by_origin["listed"].texts == 0 and by_origin["derived"].texts > 800 and by_origin["derived"].mean_change < 0.02
    # texts made of the kinds' words keep their score when the words are swapped
    swap = {"zorbs": "quills", "quills": "zorbs", "lamp": "stone", "stone": "lamp"}
    texts = [" ".join(p) for p in itertools.product(["the zorbs", "the quills"], ["a lamp", "a stone"], ["vileness", "went home"])]
    both = spark.createDataFrame([(2 * i + k, " ".join(swap.get(w, w) if k else w for w in t.split())) for i, t in enumerate(texts) for k in (0, 1)],
                                 "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(both, fitted[:2]).collect()}
    assert all(abs(scores[2 * i] - scores[2 * i + 1]) < 0.02 for i in range(len(texts)))


def test_swaps_take_a_table_of_kinds(spark):
    rows = companions(spark, 300)
    report = {s.origin: s for s in toxicity.fit_sample(rows, rows, identities={"xx": [("zorbs", "quills")]}).swaps}
    assert report["listed"].pairs == 2 and report["listed"].texts > 200
    terms = [t for kind in toxicity.listed_kinds() for t in kind]
    swap = toxicity.swap_map(toxicity.listed_kinds())
    assert set(swap) == set(terms) == set(swap.values()) and all(t == t.lower() and toxicity.words_of(t) == {t} for t in terms)


def test_one_row_for_each_key_teaches(spark):
    rows = labelled(spark, 400)
    repeated = rows.unionByName(rows.where("doc_id < 50")).unionByName(rows.where("doc_id < 50"))
    assert toxicity.train(repeated, rows) == toxicity.train(rows, rows)


def test_held_out_accuracy(spark):
    rows = labelled(spark)
    got = toxicity.score(rows, toxicity.train(rows, rows)).join(rows.select("doc_id", "toxic"), "doc_id").collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r["predicted"] == r["toxic"] for r in got if r["held_out"]]
    assert len(held) > 200 and sum(held) / len(held) > 0.97


def test_held_out_labels_are_never_learnt(spark):
    rows = labelled(spark, 600)
    flipped = rows.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(rows, rows) == toxicity.train(rows, flipped)


def test_toxicity_of_odd_rows(spark):
    docs = odd.documents(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (99, 1), (7, 5), (4, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    nothing = toxicity.train(docs, labels.limit(0))
    assert nothing == ({}, -5.0) and toxicity.keep_clean(docs, nothing).count() == docs.count()
    assert toxicity.score(odd.empty(spark), model).count() == 0

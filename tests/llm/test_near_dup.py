"""Near duplicates and line dedup against brute force, on odd rows, with crowded regions and keys made common."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm import components, line_dedup, near_dup

from . import odd


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(docs):
    sets = {k: shingles(t) for k, t in docs}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


def test_odd_rows(spark):
    docs = odd.documents(spark).where("doc_id is null or doc_id <> 3")
    got = near_dup.near_groups(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and got.count() == docs.count()
    want = brute_components({(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if r["doc_id"] is not None})
    rows = got.collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None, None]
    assert near_dup.keep_one(docs).columns == docs.columns


def family(rng, base, n, changes):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_crowded_families_lose_no_link(spark, monkeypatch):
    """One family of many near copies, half of them under the threshold: blocks must find what split regions miss."""
    rng = random.Random(4)
    texts = []
    for f, (n, changes) in enumerate([(260, 7), (40, 3), (5, 1)]):
        texts += family(rng, [f"f{f}w{i}" for i in range(120)], n, changes)
    rng.shuffle(texts)
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 32)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_groups(docs).collect()}
    assert got == brute_components(list(enumerate(texts)))


def test_empty_table(spark):
    assert near_dup.near_groups(odd.empty(spark)).count() == 0


def test_similarity_is_exact_at_the_threshold():
    a = np.arange(100, dtype=np.uint64)
    assert near_dup.similar(a, a[:85]) and not near_dup.similar(a, a[:84])


def test_components_of_a_long_path(spark):
    edges = spark.range(60).selectExpr("id as u", "id + 1 as v").union(spark.createDataFrame([(100, 99), (7, 7)], "u long, v long"))
    roots = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert roots == {**{i: 0 for i in range(61)}, 99: 99, 100: 99}


# --- lines --------------------------------------------------------------------------------


def close(a, b):
    """Edit distance of at most one, by trying each edit."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def brute_lines(docs):
    places = sorted(((k, i, tuple(line.replace("\r", " ").split())) for k, t in docs for i, line in enumerate((t or "").split("\n"))), key=lambda x: x[:2])
    seen, gone = [], set()
    for key, i, words in places:
        if len(words) >= 8:
            if any(close(words, w) for w in seen):
                gone.add((key, i))
            if words not in seen:
                seen.append(words)
    return {k: "\n".join(line for i, line in enumerate((t or "").split("\n")) if (k, i) not in gone) for k, t in docs}


def line_texts():
    rng = random.Random(9)
    base = [[f"l{b}w{i}" for i in range(rng.choice([8, 9, 12, 21]))] for b in range(14)]
    texts = []
    for _ in range(110):
        lines = []
        for _ in range(rng.randint(0, 6)):
            words = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at, what = rng.randrange(len(words)), rng.randrange(3)
                words[at:at + (what != 1)] = [] if what == 0 else [f"new{rng.randrange(9)}"]
            lines.append(rng.choice([" ", "  ", "\t"]).join(words))
        texts.append("\n".join([*lines, rng.choice(["short line", "", "another short one"])]))
    return texts


@pytest.mark.parametrize("crowded", [1000, 3, 0])
def test_lines_match_brute_force(spark, monkeypatch, crowded):
    """By pairs only, by both ways, and by leaving out words only."""
    monkeypatch.setattr(line_dedup, "CROWDED", crowded)
    texts = line_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(docs).collect()}
    assert got == brute_lines(list(enumerate(texts)))


def test_lines_of_odd_rows(spark):
    docs = odd.documents(spark).where("doc_id is not null and doc_id <> 3")
    got = line_dedup.drop_lines(docs)
    assert got.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    once = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = brute_lines([(k, t) for k, t in once.items()])
    for r in got.collect():
        assert (r["text"] or "") == want[r["doc_id"]] and (r["text"] is None) == (once[r["doc_id"]] is None)
    kept = line_dedup.without_repeated(docs)
    assert kept.columns == docs.columns and kept.where("text is null").count() == 1
    assert line_dedup.drop_lines(odd.empty(spark)).count() == 0


def test_repeated_and_null_keys_do_not_crash(spark):
    docs = odd.documents(spark)
    assert line_dedup.drop_lines(docs).count() == docs.count()


def test_banded_distance(spark):
    rng = random.Random(2)
    pairs = [([rng.choice("abc") for _ in range(rng.randint(1, 7))], [rng.choice("abc") for _ in range(rng.randint(1, 7))]) for _ in range(300)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    frame = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    for edits in (1, 2):
        got = frame.select(line_dedup.banded_distance_within(F.col("a"), F.col("b"), edits)).collect()
        assert [r[0] for r in got] == [distance(a, b) <= edits for a, b in pairs]


def test_hot_line_goes_everywhere_but_first(spark):
    line = "the very same boiler plate line that a third of all texts holds"
    docs = spark.range(300).selectExpr("id as doc_id", f"if(id % 3 = 0, concat('head ', id, '\n{line}'), concat('text ', id)) as text")
    counts = Counter(r["n_dropped"] for r in line_dedup.drop_lines(docs).collect())
    assert counts == {0: 201, 1: 99}


def test_clean_lines_stay(spark):
    docs = spark.range(200).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 30), i -> concat('w', id * 100 + i))) as text")
    assert line_dedup.drop_lines(docs).where("n_dropped > 0").count() == 0

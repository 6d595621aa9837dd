"""Exact dedup and sharding against plain Python, on odd rows."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from postlens.llm import exact_dedup, shards

from . import odd


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_copies_match_plain_grouping(spark):
    docs = odd.documents(spark)
    got = exact_dedup.mark_copies(docs).collect()
    rows = [(r["doc_id"], norm(r["text"])) for r in docs.select("doc_id", "text").collect()]
    groups = defaultdict(list)
    for key, text in rows:
        groups[text].append(key)
    want = []
    for key, text in rows:
        ids = [k for k in groups[text] if k is not None]
        keep = min(ids, default=None)
        want.append((key, keep, len(groups[text]), key == keep, hashlib.sha256(text.encode()).hexdigest()))
    assert Counter(tuple(r) for r in got) == Counter(want)


def test_small_filter_only_costs_shuffles(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id % 2000) as text")
    wide, tight = (exact_dedup.mark_copies(docs, bits=b) for b in (1 << 20, 1 << 8))
    assert wide.exceptAll(tight).count() == 0 and wide.where("kept").count() == 2000


def test_drop_copies_keeps_columns_and_one_of_each(spark):
    docs = odd.documents(spark).where("doc_id is not null")
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    texts = [norm(r["text"]) for r in got.collect()]
    assert len(texts) == len(set(texts)) == len({norm(r["text"]) for r in docs.collect()})


def test_empty_tables(spark):
    assert exact_dedup.mark_copies(odd.empty(spark)).count() == 0
    assert shards.assign_shards(odd.empty(spark)).count() == 0


def brute_capacity(sizes, k):
    n, best = len(sizes), None
    for cuts in itertools.combinations(range(1, n), min(k, n) - 1):
        ends = [0, *cuts, n]
        worst = max(sum(sizes[a:b]) for a, b in zip(ends, ends[1:]))
        best = worst if best is None else min(best, worst)
    return best


@pytest.mark.parametrize("sizes", [[5], [1, 1, 1, 1], [9, 1, 1, 1, 1, 9], [3, 7, 2, 8, 4, 6, 1], [100, 1, 1, 1, 1, 1]])
def test_smallest_capacity(sizes):
    for k in (1, 2, 3, 4):
        assert shards.smallest_capacity(sizes, k) == brute_capacity(sizes, k)


def check_shards(rows, docs, n):
    rows = [r.asDict() for r in rows]
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    for members in by.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    assert set(by) <= set(range(n))
    return {s: sum(r["size"] for r in m) for s, m in by.items()}


def test_shards_of_odd_rows(spark):
    docs = odd.documents(spark)
    got = shards.assign_shards(docs, 4).collect()
    check_shards(got, docs, 4)
    of = defaultdict(set)
    texts = docs.select("doc_id", "text").where("doc_id is not null and doc_id <> 3").collect()
    where = {r["doc_id"]: r for r in got}
    for r in texts:
        of[r["text"] or ""].add(where[r["doc_id"]]["shard"])
        data = (r["text"] or "").encode()
        assert (where[r["doc_id"]]["size"], where[r["doc_id"]]["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    assert all(len(s) == 1 for s in of.values())


def test_refined_ranges_give_the_exact_minimum(spark, monkeypatch):
    """Few, coarse ranges at first: the cut found by refining equals that over all groups at once."""
    monkeypatch.setattr(shards, "FIRST_BITS", 2)
    monkeypatch.setattr(shards, "STEP_BITS", 3)
    docs = spark.range(1500).selectExpr("id as doc_id", "repeat(concat('t', id % 700), cast(1 + id % 13 as int)) as text")
    sized = docs.select((F.octet_length("text") + 1).cast("long").alias("_size"), F.xxhash64("text").alias("_hash"))
    groups = [r[1] for r in sorted(sized.groupBy("_hash").agg(F.sum("_size")).collect())]
    capacity, cuts = shards.plan(sized, 7)
    assert capacity == shards.smallest_capacity(groups, 7) and len(cuts) == 6
    loads = check_shards(shards.assign_shards(docs, 7).collect(), docs, 7)
    assert max(loads.values()) == capacity


def test_hot_text_has_a_shard_of_its_own(spark):
    docs = spark.range(900).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot text', concat('text number ', id)) as text")
    loads = check_shards(shards.assign_shards(docs, 16).collect(), docs, 16)
    assert max(loads.values()) < 300 * 9 + 400

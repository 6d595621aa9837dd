"""Keys that stand for several texts: each row is judged by its own text."""

from collections import Counter

from postlens.llm import near_dup

from . import odd
from .test_near_dup import shingles


def by_own_text(rows):
    """<key, shingles, component> of each row, over links between distinct <key, text>."""
    nodes = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], r[1] or ""))
    sets, root = [shingles(t) for _, t in nodes], list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, one in enumerate(sets):
        for j in range(i):
            if (both := len(one & sets[j])) and 100 * both >= 85 * len(one | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    at = {node: nodes[find(i)][0] for i, node in enumerate(nodes)}
    return Counter((k, len(shingles(t)), at.get((k, t))) for k, t in rows)


def found(docs):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.near_groups(docs).collect())


def test_a_key_that_represents_two_classes(spark):
    text = lambda name, last: " ".join([*(f"{name}{i}" for i in range(99)), last])
    rows = [(7, text("a", "x")), (7, text("b", "x")), (7, text("c", "x")), (8, text("a", "y")), (9, text("b", "y")), (6, text("c", "y")), (7, text("d", "x"))]
    want = by_own_text(rows)
    assert {c for _, _, c in want} == {6, 7}
    for parts in (1, 4):
        assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)) == want


def test_odd_rows_with_a_repeated_key(spark):
    docs = odd.documents(spark)
    assert found(docs) == by_own_text([(r["doc_id"], r["text"]) for r in docs.collect()])

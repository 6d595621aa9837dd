"""Crowded keys: each round's findings are stored, so no plan grows with the number of rounds."""

from postlens.llm import line_dedup


def crowd(words: int) -> list[str]:
    """Lines that agree on all but a word near their end, which differs by line: their shared halves are split to the last."""
    same = [f"w{i}" for i in range(words)]
    return [" ".join([*same[:-2], f"x{k}", same[-1]]) for k in range(line_dedup.CROWDED + 2)]


def test_plans_do_not_grow_with_rounds(spark, monkeypatch):
    joins, store = {}, line_dedup.stored

    def seen(df, name):
        joins[words] = max(joins.get(words, 0), df._jdf.queryExecution().analyzed().toString().count("Join"))
        rounds[words] = rounds.get(words, 0) + (name == "split")
        return store(df, name)

    monkeypatch.setattr(line_dedup, "stored", seen)
    rounds: dict[int, int] = {}
    for words in (12, 96):
        rows = [(i, line) for i, line in enumerate(crowd(words))]
        kept = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_dropped = 0").collect()
        assert [r["doc_id"] for r in kept] == [0]
    assert rounds[96] > rounds[12]
    assert joins[96] == joins[12]

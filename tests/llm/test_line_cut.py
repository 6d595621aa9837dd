"""A text that loses lines is cut once, however many go."""

from postlens.llm.line_dedup import drop_lines


def test_lines_are_cut_once(spark):
    line = "one two three four five six seven {}".format
    rows = [(1, "\n".join(line(i * 7) for i in range(3))), (2, f"\n{line(0)}\nstays\n  {line(7)} \n"), (3, line(14)), (4, None), (5, "")]
    got = drop_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()} == {
        1: (line(0), 3, 2), 2: ("\nstays\n", 5, 2), 3: ("", 1, 1), 4: (None, 0, 0), 5: ("", 1, 0)}
    assert got._jdf.queryExecution().analyzed().toString().count("split(") == 1

"""A mix fetches its texts with one shuffle, and rows that come twice once."""

from pyspark.sql import functions as F

from postlens.llm.mixing import Mix


def test_texts_are_shuffled_once_and_repeated_rows_are_one(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"),
                                  F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.col("id") + 3), lambda i: F.concat(F.lit("w"), F.col("id"), F.lit("_"), i))).alias("text"))
    mix = Mix(docs, block_words=8, shards=4)
    plan = mix.documents()._jdf.queryExecution().executedPlan().toString()
    assert "first(text" not in plan
    # again, a null id, and one text under two ids
    odd = docs.unionAll(docs.where("doc_id < 5")).unionAll(docs.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long"))).unionAll(
        docs.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long"))).unionAll(docs.where("doc_id = 1").withColumn("doc_id", F.lit(100).cast("long"))).localCheckpoint()
    mix = Mix(odd, block_words=8, shards=4)
    keyed = odd.withColumn("_print", mix.print)
    got = sorted(map(str, mix._once(keyed, "_print").select("doc_id", "source", "text").collect()))
    assert got == sorted(map(str, keyed.dropDuplicates(["doc_id", "_print"]).select("doc_id", "source", "text").collect())) and len(got) == 62
    spans = mix.spans().groupBy("doc_id", "pass").agg(F.sum(F.col("to") - F.col("from")).alias("n"))
    found = mix.documents().select("doc_id", F.size(F.split("text", r"\s+")).alias("n"))
    assert sorted(map(str, found.collect())) == sorted(map(str, spans.select("doc_id", F.col("n").cast("int")).collect()))

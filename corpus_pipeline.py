"""The training-data pipeline: documents in, packed sequences out. Each stage's rows are written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postlens.llm import line_dedup, mixing, near_dup, packing, toxicity
from postlens.llm.common import read, stored
from postlens.llm.tokens import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier learnt from `labels` doesn't reject."""
    return toxicity.keep_clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier line, up to one word."""
    return line_dedup.without_repeated(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, linked from a Jaccard similarity of 0.8 on."""
    return near_dup.keep_one(docs, per_cent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' words in the mix to target weights, a row for each document and pass."""
    return mixing.Mix(docs).documents()


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of 4096, a row for each document piece of a sequence."""
    return packing.packed_ids(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL: str | None = None  # classifier, minhashes, draws and token ids are beyond SQL; tests/llm checks each stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

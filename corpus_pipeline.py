"""Corpus pipeline: documents in, token ids out, in five stages.

Each stage is a function of (session, documents, folder of the tables) that applies one operator to all its
predecessor kept; its result is written as Parquet and read again as the next one's input.  All but the
last return the columns of ``documents``.

1. quality: documents that the quality classifier rejects (score below 0.5) go.
2. lines: of every component of alike lines one occurrence stays; documents keep their rows.
3. near_duplicates: one document of each SimHash class stays.
4. decontaminate: benchmark spans are cut out; documents of which more than half is benchmark text go.
5. encode: token ids of every text, and the digests of a full round trip.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from migrata.llm import bpe, decontaminate, lines, quality, simhash
from migrata.llm.common import stored

RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.reject(docs, _table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedupe(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, ids=True)


STAGES = [
    ("quality", keep_good),
    ("lines", drop_lines),
    ("near_duplicates", keep_one_of_each),
    ("decontaminate", cut_benchmark),
    ("encode", encode),
]

# classifier, automaton and merges have no SQL form; the tests compare with a brute-force run
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""A corpus pipeline of five operators: rules, near duplicates, decontamination, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns what its operator decides about all rows
of ``docs``; ``run`` writes every result and reads it back as the next stage's ``docs``. All
stages but the last return the columns of ``docs``.

A stage's intermediate tables go when the next one begins, as its result is written by then.

Defined results: an empty table passes through every stage as an empty table. Columns that
are not named here, whatever they are called, are carried by all stages but the last. A row
with a null or empty text fails the quality rules; equal rows are one document of the n-gram
Jaccard join; null ids and sources are like any others, and null ids come first in the files.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowcaster.llm import op2_tokens, op4_mix, op5_jaccard, op6_rules, op8_decontaminate
from rowcaster.llm.queries import TOKENIZER, tokenizer_path
from rowcaster.session import recorded, remove, written


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_made: list[str] = []  # paths of the stage before


def tidy(stage: Stage) -> Stage:
    """The stage, which removes what the stage before it left beside its result."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _made:
            remove(spark, _made.pop())
        with recorded() as paths:
            out = stage(spark, docs, sf_dir)
        _made.extend(paths)
        return out

    return run


@tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the base rule or the outlier estimate rejects."""
    return op6_rules.quality_filter(docs)


@tidy
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each component of five-word shingles at 0.8 and more."""
    return op5_jaccard.keep_first(docs, op5_jaccard.JoinOptions(words=5, above=80, below=100))


@tidy
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item."""
    return op8_decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@tidy
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw the sources to their targets; a document drawn twice is there twice."""
    return op4_mix.mix(docs)


@tidy
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the ids of all rows and read them back: doc_id, start, n_tokens, ids_crc32."""
    tokens = op2_tokens.token_output(docs, tokenizer_path(TOKENIZER))
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("token output", token_output),
]

#: Estimates, draws and byte pairs have no form in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs


QUERIES = {"pipeline": run}
ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

"""Documents to packed training sequences in five stages, each written as Parquet and read again by the next one.

All stages but the last return the columns of documents; they drop rows or shorten texts (n_chars then follows), and leave the rest as
it is. A document whose lines are all boilerplate keeps its row with an empty text. Ids, nulls, repeated rows and extra columns are
treated as the stages' operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontamination, lines, near, packing
from quillspark.llm.common import passing, table, written
from quillspark.llm.queries import tokenizer_path

#: Packing cuts by tokens and so has no SQL; the stages and the run are tested against brute-force versions.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines over their host's limit."""
    return lines.keep_quality(docs, size="n_chars" if "n_chars" in docs.columns else None)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their sites' boilerplate lines."""
    return lines.without_boilerplate(docs, size="n_chars" if "n_chars" in docs.columns else None)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, mixed in the proportions of the sources."""
    return packing.pack(docs, tokenizer_path(), with_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_join),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with passing(spark) as keep:  # a stage's own tables go once its result is written
            docs = keep(written(stage(spark, docs, sf_dir), name.replace(" ", "-")))
    return STAGES[-1][1](spark, docs, sf_dir)

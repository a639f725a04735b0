"""Corpus pipeline: five stages from raw documents to packed token sequences.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes each result as Parquet in the cluster's checkpoint folder and reads it
back as the next stage's ``docs``.  All stages but the last return the columns
of ``documents``.  A NULL text passes the stages as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import read_table, store
from panelwright.llm.decontamination import drop_contaminated
from panelwright.llm.line_dedup import line_dedup
from panelwright.llm.ngram_join import keep_one_per_class
from panelwright.llm.packing import pack_documents, packed_digests
from panelwright.llm.quality import select_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier accepts."""
    return select_quality(docs, read_table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document holds; those in which
    nothing but repeats of earlier lines, short ones included, would be left
    are dropped.  ``n_chars`` follows the text."""
    after = line_dedup(docs, drop_emptied=True)
    return after.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word n-gram similarity 0.8 or more."""
    return keep_one_per_class(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed token sequences, with the CRC-32 of their ids."""
    return packed_digests(pack_documents(docs))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates),
          ("benchmark", benchmark), ("packing", packing)]

# Token ids, learned weights and MinHash are not expressible in DuckDB SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

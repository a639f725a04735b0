"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialize, sf_path, ship_package


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(sf_path(sf_dir, name))


def text_or_empty(c: str) -> Column:
    """The text column as a string; NULL counts as the empty text."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a multi-read intermediate as a table in the cluster's checkpoint
    folder and read it back (cuts lineage; survives lost executors)."""
    return materialize(df, f"llm-{name}")


def on_workers(df: DataFrame) -> DataFrame:
    """Make this package importable in the Python workers that will process ``df``."""
    ship_package(df.sparkSession)
    return df


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files/llm-{name}-{uuid.uuid4().hex}"

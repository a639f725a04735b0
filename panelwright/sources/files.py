"""CSV / Parquet readers and sinks for panel files.

The reference reads header CSVs where the literal ``NA`` marks a missing
value and writes CSVs without row names.  The same contract here, with an
explicit schema; Parquet partitioned by a low-cardinality column is the
default sink for anything that is read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from . import schemas


def read_csv_panel(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Header CSV → DataFrame; ``NA`` is NULL, strings stay strings."""
    if isinstance(schema, str):
        schema = schemas.BY_NAME[schema]
    return (spark.read.schema(schema)
            .option("header", True)
            .option("nullValue", "NA")
            .option("mode", "FAILFAST")
            .csv(path))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink: header, ``NA`` for NULL, no index column; one folder of part files."""
    (df.write.mode(mode)
       .option("header", True)
       .option("nullValue", "NA")
       .csv(path))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> None:
    """Default sink; partition on a low-cardinality column (e.g. ``Type``) so
    readers that filter on it prune whole folders."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)

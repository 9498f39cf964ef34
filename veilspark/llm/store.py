"""Intermediate tables in the shared folder that ``spark.checkpoint.dir`` names.

A written table cuts the lineage: later jobs reread files that every executor
sees, so a lost executor costs only its running tasks. Folders made by one
driver process are removed when that process ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_folder


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder path (not created) for one intermediate result."""
    return scratch_folder(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written with a number of its own for every row, and the name of that column."""
    key, taken = "row_key", {c.lower() for c in df.columns}
    while key in taken:
        key += "_"
    return written(df.withColumn(key, F.monotonically_increasing_id()), name), key

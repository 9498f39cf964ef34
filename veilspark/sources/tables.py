"""Readers for the parquet tables the jobs run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale-factor folder; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: A table of at least this many files per core keeps its partitions.
FILES_PER_CORE = 4


def spread(df: DataFrame, min_partitions: int | None = None, key: str | tuple | list | None = None) -> DataFrame:
    """Give CPU-heavy per-row work (regex over text) an even share of the rows per core.

    A scan may have many partitions and still hold all rows in one of them,
    as a Parquet row group is read by a single task. Files are what surely
    lies apart: a table of several files per core keeps its partitions
    (no shuffle). A table of few files is small and is dealt out once: by
    ``key`` (deterministic if a task is retried) or else round-robin.
    """
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= FILES_PER_CORE * target:
        return df
    if key is None:
        return df.repartition(target * FILES_PER_CORE)
    keys = [key] if isinstance(key, str) else list(key)
    return df.repartition(target * FILES_PER_CORE, *keys)


def together(df: DataFrame, key: str) -> DataFrame:
    """Deal out the rows so that those of one key lie in one partition; small tables get an even share per core, too."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism * FILES_PER_CORE, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every free-text column of the test tables as one long ``(src, doc_id, text)`` table.

    ``src`` names the table and column so results stay traceable. Each branch
    prunes to the two columns it needs before the union.
    Each branch is spread on its own before the union: a union of several
    single-task scans already has "enough" partitions in total while each big
    source would still be processed by one task.
    """
    docs = spread(table(spark, sf_dir, "documents").selectExpr("'documents' AS src", "doc_id", "text"), key="doc_id")
    urls = spread(table(spark, sf_dir, "pages").selectExpr("'pages.url' AS src", "page_id AS doc_id", "url AS text"),
                  key="doc_id")
    html = spread(table(spark, sf_dir, "pages").selectExpr("'pages.html' AS src", "page_id AS doc_id", "html AS text"),
                  key="doc_id")
    conv = spread(table(spark, sf_dir, "conversations").selectExpr(
        "'conversations' AS src", "conv_id * 1000 + turn AS doc_id", "text"), key="doc_id")
    return docs.unionByName(urls).unionByName(html).unionByName(conv)

"""Exact deduplication by deterministic block naming.

Each normalised text is cut into fixed-size byte blocks. Distinct blocks are
sorted and numbered; adjacent names of a document are paired, the distinct
pairs are sorted and numbered again, and so on until every document has a
single integer. Equal texts get equal names and different texts different
names: names come from comparing the blocks themselves, never from trusting a
hash. A 64-bit hash only routes blocks to partitions; blocks that share a hash
without being equal are told apart by their bytes.

Defined results for odd input: a null text counts as empty, so null and empty
texts form one group. A null ``doc_id`` sorts after every other id. If rows
with equal text also share their ``doc_id``, exactly one of them is kept. An
empty table gives an empty result. Columns other than ``doc_id`` and ``text``
are ignored by ``identify`` and untouched by ``drop_copies`` and ``first_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.tables import table
from .registry import query
from .store import keyed, written

#: Bytes in a block: one name stands for so much text, and a text of n blocks takes log2(n) rounds.
BLOCK_BYTES = 8192


def normalised(text: Column) -> Column:
    """Null as empty; each run of space, tab, LF, VT, FF, CR as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """One row per block: the row's columns, ``pos``, ``n`` (blocks in the text) and the ``block`` bytes."""
    whole = docs.withColumn("_bin", F.col("_norm").cast("binary"))
    whole = whole.withColumn("n", F.greatest(F.lit(1), F.ceil(F.octet_length("_bin") / block_bytes)).cast("int"))
    rows = whole.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.withColumn("block", F.substring("_bin", F.col("pos") * block_bytes + 1, F.lit(block_bytes)))


def identify(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hash_values: int | None = None, row_id: str | None = None) -> DataFrame:
    """Per row: ``row_id``, ``doc_id``, ``text_sha256`` and its identity (``level``, ``name``).

    ``hash_values`` narrows the routing hash; tests use it to force clashes.
    ``row_id`` names a column that numbers the rows; without it they are numbered here.
    """
    routed = F.xxhash64("block")
    if hash_values:
        routed = F.pmod(routed, F.lit(hash_values))
    number = F.col(row_id) if row_id else F.monotonically_increasing_id()
    base = docs.select("doc_id", normalised(F.col("text")).alias("_norm"), number.alias("row_id"))

    # level 0: number the distinct blocks; the text crosses the network once, here
    sets = (_blocks(base.select("_norm"), block_bytes).select(routed.alias("h"), "block")
            .groupBy("h").agg(F.array_sort(F.collect_set("block")).alias("blocks")))
    names = written(
        sets.sortWithinPartitions("h").select("h", F.size("blocks").alias("many"), F.explode("blocks").alias("block"))
        .withColumn("name", F.monotonically_increasing_id())
        .select("h", "name", F.when(F.col("many") > 1, F.col("block")).alias("block")), "blocks")
    rows = _blocks(base, block_bytes).select(
        "row_id", "pos", "n", routed.alias("h"), "block",
        F.when(F.col("pos") == 0, F.col("doc_id")).alias("doc_id"),
        F.when(F.col("pos") == 0, F.sha2("_bin", 256)).alias("text_sha256"))
    kept = ["row_id", "pos", "n", "doc_id", "text_sha256", "name"]
    named = rows.drop("block").join(names.where("block IS NULL").drop("block"), "h").select(kept)
    clashing = names.where("block IS NOT NULL")
    if not clashing.isEmpty():  # different blocks with one hash: compare the bytes
        named = named.unionByName(rows.join(clashing, ["h", "block"]).select(kept))

    # level k: pair neighbours, number the distinct pairs, until one name is left
    level, done = 0, []
    named = written(named, "level-0")
    while True:
        done.append(named.where("n = 1").select("row_id", "doc_id", "text_sha256",
                                                F.lit(level).alias("level"), "name"))
        longer = named.where("n > 1")
        if longer.isEmpty():
            break
        level += 1
        pairs = (longer.withColumn("odd", F.col("pos") % 2 == 1)
                 .groupBy("row_id", F.shiftright("pos", 1).alias("pos"))
                 .agg(F.max(F.when(~F.col("odd"), F.col("name"))).alias("left"),
                      F.coalesce(F.max(F.when(F.col("odd"), F.col("name"))), F.lit(-1)).alias("right"),
                      F.ceil(F.max("n") / 2).cast("int").alias("n"),
                      F.max("doc_id").alias("doc_id"), F.max("text_sha256").alias("text_sha256")))
        pairs = written(pairs, f"pairs-{level}")
        numbers = (pairs.select("left", "right").distinct().sortWithinPartitions("left", "right")
                   .withColumn("name", F.monotonically_increasing_id()))
        named = written(pairs.join(numbers, ["left", "right"]).select(kept), f"level-{level}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hash_values: int | None = None, row_id: str | None = None) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 (and ``row_id``)."""
    ids = identify(docs, block_bytes, hash_values, row_id)
    # a written table, so that the join below may split the rows of a large group over tasks
    groups = written(ids.groupBy("level", "name").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.col("row_id").alias("row")))
        .alias("keep"), F.count(F.lit(1)).alias("group_size")), "groups")
    return ids.join(groups, ["level", "name"]).select(
        "doc_id", F.col("keep.id").alias("keep_id"), "group_size",
        (F.col("row_id") == F.col("keep.row")).alias("kept"), "text_sha256", "row_id")


def drop_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` whose text is the first of its group; all columns stay.

    Rows that share a ``doc_id`` go only if every one of them is a copy; rows
    without an id stay.
    """
    gone = (copies(docs, block_bytes).where("doc_id IS NOT NULL").groupBy("doc_id")
            .agg(F.max("kept").alias("kept")).where(~F.col("kept")).select("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def first_rows(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Exactly one row of each group of equal texts, the one that ``copies`` keeps, whatever its id; all columns stay."""
    rows, key = keyed(docs, "rows")
    gone = copies(rows, block_bytes, row_id=key).where(~F.col("kept")).select(F.col("row_id").alias(key))
    return rows.join(gone, key, "left_anti").select(docs.columns)


@query("op1_block_naming", sql=r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "documents")).drop("row_id")

"""Exact per-group ordinals and percentiles that never gather a group into one task.

A ``row_number()`` window or an exact ``percentile`` aggregate sends a whole
group to one task; if one group holds a third of the rows, that task does a
third of the job. Here the rows are range-partitioned on (group, order) --
Spark samples the boundaries, so a hot group is split over many tasks --
and numbered inside each partition with ``monotonically_increasing_id``
(partition id in the high bits, position in the low bits). A small table of
per-(partition, group) counts turns local positions into global ordinals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL; the key columns are the left ones."""
    other = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(other, cond, how).drop(*[f"_r_{k}" for k in keys])


def ordinal_within_group(df: DataFrame, keys: list[str], order: list[str], name: str = "ordinal",
                         partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of each row inside its group, ordered by ``order``.

    Equals ``row_number() OVER (PARTITION BY keys ORDER BY order) - 1`` when
    ``order`` is unique within a group (ties are broken by the sort).
    """
    spark = df.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ranged = (df.repartitionByRange(n, *[F.col(c) for c in keys + order])
                .sortWithinPartitions(*keys, *order)
                .withColumn("_mid", F.monotonically_increasing_id()))
    # Range boundaries come from sampling, and every exchange samples anew; two
    # branches reading this plan could disagree on partition ids. A reliable
    # checkpoint (shared checkpoint folder) fixes one numbering for both, and
    # a lost executor re-reads it instead of re-sampling.
    ensure_checkpoint_dir(spark)
    ranged = ranged.checkpoint(eager=True)
    ranged = ranged.withColumn("_pid", F.shiftright(F.col("_mid"), 33))
    # per (partition, group): first id and row count -- at most partitions + groups rows
    stats = ranged.groupBy("_pid", *keys).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.select("_pid", *keys, "_first", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_before"))
    out = join_on(ranged, offsets, ["_pid", *keys])
    return out.withColumn(name, (F.col("_mid") - F.col("_first") + F.col("_before")).cast("long")) \
        .drop("_mid", "_pid", "_first", "_before")


#: Values of a group that are ordered as they are; a larger group is narrowed down by a sketch first.
SMALL_GROUP = 50_000
#: A sketched rank is right to within one part in this many of the group.
SKETCH_ACCURACY = 10_000
#: A wanted rank lies this many such parts at most from its sketched neighbours.
SLACK = 5


def exact_percentiles(df: DataFrame, keys: list[str], value: str, ps: dict[str, float], small: int = SMALL_GROUP,
                      accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """Exact linear-interpolation percentiles per group (rank = (n - 1) * p).

    NULL values are ignored; the result has one row per group (NULL keys form
    groups too) with one column per entry of ``ps``. A mergeable quantile
    sketch per group gives two values that enclose each wanted rank, whatever
    the values are spread like. Rows below the two are only counted; the few
    between them (``2 * SLACK / accuracy`` of the group and a little) are
    counted by value and ordered. So one hot value is one row, and a task
    orders all values of small groups only.
    """
    v = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    names = list(ps)
    reach = SLACK / accuracy
    edges = [e for p in ps.values() for e in (max(0.0, p - reach), min(1.0, p + reach))]
    sketch = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", edges, accuracy).alias("_q"))
    held = join_on(v, sketch, keys)

    def place(i: int, p: float) -> Column:
        """Of one percentile: the value if it lies between the edges, NULL if below them; not kept if above."""
        open_low, open_high = (F.col("_n") <= small) | F.lit(p - reach <= 0), (F.col("_n") <= small) | F.lit(p + reach >= 1)
        below = ~open_low & (F.col("_v") < F.col("_q")[2 * i])
        above = ~open_high & (F.col("_v") > F.col("_q")[2 * i + 1])
        return F.struct(F.lit(i).alias("i"), F.when(~below, F.col("_v")).alias("v"), (~above).alias("kept"))

    each = held.select(*keys, "_n", F.explode(F.filter(F.array(*[place(i, p) for i, p in enumerate(ps.values())]), lambda x: x["kept"])).alias("_x"))
    counts = each.groupBy(*keys, "_n", F.col("_x.i").alias("_i"), F.col("_x.v").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*keys, "_i").orderBy(F.col("_v").asc_nulls_first())
    near = counts.withColumn("_from", F.sum("_c").over(order) - F.col("_c")).where("_v IS NOT NULL")

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_from")) & (rank < F.col("_from") + F.col("_c")), F.col("_v")))

    cols = []
    for i, name in enumerate(names):
        own = near["_i"] == i
        rank = (F.col("_n") - 1) * F.lit(ps[name])
        a, b = at(F.when(own, F.floor(rank))), at(F.when(own, F.ceil(rank)))
        share = F.max(rank - F.floor(rank))
        exact = F.when(share == 0, a).otherwise(a + (b - a) * share)
        cols.append(F.when(a.isNull() | b.isNull(), F.raise_error(F.lit("a wanted rank lies outside its sketched neighbours")).cast("double"))
                    .otherwise(exact).alias(name))
    return near.groupBy(*keys).agg(*cols)

from pyspark.sql import Window
from pyspark.sql import functions as F

from veilspark.operators.ordinals import exact_percentiles, ordinal_within_group


def _skewed(spark):
    # one hot group with ~2/3 of the rows, several small ones, duplicate values
    rows = [(0 if i % 3 else 1 + i % 5, i, float((i * 37) % 101)) for i in range(3000)]
    return spark.createDataFrame(rows, "g long, id long, v double")


def test_ordinal_equals_row_number(spark):
    df = _skewed(spark)
    got = ordinal_within_group(df, ["g"], ["id"], "o", partitions=7)
    w = Window.partitionBy("g").orderBy("id")
    ref = df.select("id", (F.row_number().over(w) - 1).alias("r"))
    j = got.join(ref, "id", "full")
    assert got.count() == df.count()
    assert j.where(F.col("o").isNull() | F.col("r").isNull() | (F.col("o") != F.col("r"))).count() == 0


def test_exact_percentiles_equal_spark_percentile(spark):
    df = _skewed(spark)
    got = {r.g: (r.p50, r.p95) for r in exact_percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    ref = {r.g: (r.p50, r.p95) for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("p50"),
                                                            F.percentile("v", 0.95).alias("p95")).collect()}
    assert got.keys() == ref.keys()
    for g in ref:
        assert abs(got[g][0] - ref[g][0]) < 1e-9 and abs(got[g][1] - ref[g][1]) < 1e-9


def test_null_groups_and_hot_values_keep_their_percentiles(spark):
    rows = [(None if i % 2 else 1, 5.0 if i % 3 else float(i)) for i in range(3000)] + [(2, None), (3, -4.0), (3, 0.0)]
    df = spark.createDataFrame(rows, "g long, v double")
    got = {r.g: (r.p50, r.p95) for r in exact_percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    ref = {r.g: (r.p50, r.p95) for r in df.where("v IS NOT NULL").groupBy("g").agg(F.percentile("v", 0.5).alias("p50"), F.percentile("v", 0.95).alias("p95")).collect()}
    assert got.keys() == ref.keys() and None in got
    assert all(abs(got[g][0] - ref[g][0]) < 1e-9 and abs(got[g][1] - ref[g][1]) < 1e-9 for g in ref)


def test_ordinals_keep_rows_without_a_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (5, 3)], "g long, id long")
    assert sorted((r.id, r.o) for r in ordinal_within_group(df, ["g"], ["id"], "o", partitions=2).collect()) == [(1, 0), (2, 1), (3, 0)]


def test_building_a_rollup_runs_no_job(spark):
    from veilspark.plans.registry import QUERIES
    from veilspark.plans import catalog  # noqa: F401
    tracker = spark.sparkContext.statusTracker()
    for name in ("agg_2_mean", "agg_4_metric_rollup", "agg_12_scaling_fit"):
        spark.sparkContext.setJobGroup(f"build {name}", name)
        QUERIES[name](spark, "/root/testdata/sf0.001")
        jobs = tracker.getJobIdsForGroup(f"build {name}")
        assert all(len(tracker.getJobInfo(j).stageIds) == 1 for j in jobs), name  # at most the reading of a schema
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_one_row_group_is_spread_evenly(spark, tmp_path):
    from veilspark.sources.tables import spread
    spark.range(4000).selectExpr("id AS doc_id").coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    df = spark.read.parquet(str(tmp_path / "t.parquet"))
    for cores in (2, 4, 8):
        sizes = [r[1] for r in spread(df, cores, "doc_id").groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= cores and max(sizes) <= 4000 / cores


def test_percentiles_of_a_narrow_range_order_few_values(spark):
    n = 200_000
    df = spark.range(n).selectExpr("id % 2 AS g", "1 + pmod(id * 7919, 200000) / 1e9 AS v").unionByName(
        spark.range(n).selectExpr("2L AS g", "CASE WHEN id % 3 = 0 THEN 1.00001 ELSE 1 + id / 1e9 END AS v"))
    ps = {"p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}
    out = exact_percentiles(df, ["g"], "v", ps, small=1000)
    want = {r.g: tuple(r)[1:] for r in df.groupBy("g").agg(*[F.percentile("v", p).alias(k) for k, p in ps.items()]).collect()}
    rows = out.collect()
    assert {r.g: tuple(r)[1:] for r in rows} == want
    # between the sketched neighbours of a rank lies less than a hundredth of the group
    near = df.where("g = 0").agg(F.percentile_approx("v", [0.4995, 0.5005], 10_000).alias("q")).first().q
    assert df.where(f"g = 0 AND v BETWEEN {near[0]} AND {near[1]}").count() < n / 2 / 100

"""Rollups of timing measurements: percentiles, means, throughput, cost, power,
error counts, batch comparison, stage breakdown and the scaling fit.

Measurements are a long table, one row per attempt:
``(run_id, model, model_type, bucket_tokens, event_id, latency_s,
input_tokens, input_tps, <stage columns>, error_type, error)``, and where
attempts are told apart also ``repeat_index`` and ``mode``.
All rollups are ``groupBy`` aggregations with partial (map-side) aggregation,
so a group is never gathered into one task. Exact percentiles and attempt
numbering use range-partitioned ordinals (:mod:`.ordinals`) instead of a
per-group window or buffer, so a hot group is split across tasks;
``approx=True`` swaps in ``percentile_approx`` (one pass, bounded memory).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinals import exact_percentiles, join_on, ordinal_within_group

# FIXED VALUES: metric keys always aggregated, and the stage fields of the
# stage breakdown in report order.
CORE_KEYS = ("latency_s", "input_tps", "ttft_s", "prefill_tps", "decode_tps", "short_e2e_tps", "peak_gpu_mem_mb")
PROFILED_PREFIXES = ("opf_", "mlx_")
PROFILED_EXCLUDED = ("opf_decoded_mismatch",)
STAGE_FIELDS = ("opf_component_s", "opf_tokenize_s", "opf_window_prepare_s", "opf_model_forward_s", "opf_logprob_transfer_s",
                "opf_aggregation_s", "opf_decode_s", "opf_span_postprocess_s", "opf_redaction_s")
PER_WATT = (("input_tps_mean", "input_tps_per_watt"), ("prefill_tps_mean", "prefill_tps_per_watt"),
            ("decode_tps_mean", "decode_tps_per_watt"))
MODEL_NAMES = ("click", "view", "signup", "purchase")


def metric_keys(columns) -> list[str]:
    """Core keys plus profiled ``opf_``/``mlx_`` keys present in the table."""
    prof = [c for c in columns if c.startswith(PROFILED_PREFIXES) and c not in PROFILED_EXCLUDED]
    return sorted(set(CORE_KEYS) | set(prof))


def measurements_from_events(events: DataFrame) -> DataFrame:
    """Deterministic measurement table derived from ``events`` (FIXTURES.md B1);
    error events are failed attempts assigned to a model by event id."""
    k = F.get_json_object("props", "$.k").cast("long")
    bucket = (F.lit(256) * (F.lit(1) + k % 4)).cast("long")
    failed = F.col("event_type") == "error"
    names = F.array(*[F.lit(n) for n in MODEL_NAMES])
    model = F.when(failed, F.element_at(names, (F.col("event_id") % 4 + 1).cast("int"))).otherwise(F.col("event_type"))
    base = events.select(
        "event_id", (F.col("user_id") % 5).cast("long").alias("run_id"), model.alias("model"),
        F.lit("synthetic").alias("model_type"), bucket.alias("bucket_tokens"), failed.alias("failed"), "value", "ts")
    lat = F.when(~F.col("failed"), F.col("value") / 1000.0 + F.col("bucket_tokens") / 10000.0)
    m = base.select(
        "run_id", "model", "model_type", "bucket_tokens", "event_id", "ts",
        lat.alias("latency_s"),
        F.when(~F.col("failed"), F.col("bucket_tokens")).alias("input_tokens"),
        F.when(F.col("failed"), F.lit("RuntimeError")).alias("error_type"),
        F.when(F.col("failed"), F.concat(F.lit("attempt "), F.col("event_id").cast("string"), F.lit(" failed")))
        .alias("error"),
    )
    return m.select(
        "*",
        F.when(F.col("latency_s") > 0, F.col("input_tokens") / F.col("latency_s")).alias("input_tps"),
        (F.col("latency_s") * 0.5).alias("opf_tokenize_s"),
        (F.col("latency_s") * 0.2).alias("opf_model_forward_s"),
        (F.col("latency_s") * 0.1).alias("opf_decode_s"),
    )


def numbered(meas: DataFrame) -> DataFrame:
    """Add ``repeat_index`` (attempts of a run, model and bucket in event order) and the ``mode`` that follows from it."""
    m = ordinal_within_group(meas, ["run_id", "model", "bucket_tokens"], ["event_id"], "repeat_index")
    return m.withColumn("mode", F.when(F.col("repeat_index") == 0, F.lit("concat")).otherwise(F.lit("serial")))


def rollup(long: DataFrame, keys: list[str], approx: bool = False) -> DataFrame:
    """Mean, p50, p95 and count of ``value`` per group of a long table."""
    if approx:
        return long.groupBy(*keys).agg(
            F.avg("value").alias("mean"), F.percentile_approx("value", 0.5, 100000).alias("p50"),
            F.percentile_approx("value", 0.95, 100000).alias("p95"), F.count(F.lit(1)).alias("n"))
    means = long.groupBy(*keys).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return join_on(means, exact_percentiles(long, keys, "value", {"p50": 0.5, "p95": 0.95}), keys)


def aggregate_long(meas: DataFrame, keys=("run_id", "model", "bucket_tokens"), approx: bool = False) -> DataFrame:
    """Mean, p50, p95 per key group and metric (long form; metrics without values omitted)."""
    ks = metric_keys(meas.columns)
    present = [k for k in ks if k in meas.columns]
    stacked = meas.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value")) for k in present])).alias("m"))
    long = stacked.select(*keys, "m.metric", "m.value").where(F.col("value").isNotNull())
    return rollup(long, [*keys, "metric"], approx)


def aggregate_open(meas: DataFrame, keys=("run_id", "model", "bucket_tokens"), metrics: str = "metrics", approx: bool = False) -> DataFrame:
    """The same for measurements whose numbers are a map: its keys are found in the data.

    Aggregated are the core keys and whatever profiled keys some measurement
    holds a number under; what is no number is not in the map.
    """
    long = meas.select(*keys, F.explode(metrics).alias("metric", "value")).where(F.col("value").isNotNull())
    profiled = F.lit(False)
    for prefix in PROFILED_PREFIXES:
        profiled = profiled | F.col("metric").startswith(prefix)
    wanted = F.col("metric").isin(*CORE_KEYS) | (profiled & ~F.col("metric").isin(*PROFILED_EXCLUDED))
    return rollup(long.where(wanted), [*keys, "metric"], approx)


def aggregate_wide(meas: DataFrame, keys=("run_id", "model", "bucket_tokens"), approx: bool = False) -> DataFrame:
    """One row per group with ``<metric>_mean/_p50/_p95`` columns (the speed row's aggregate)."""
    keys = list(keys)
    present = [k for k in metric_keys(meas.columns) if k in meas.columns]
    long = aggregate_long(meas, keys, approx)
    wide = long.groupBy(*keys).pivot("metric", present).agg(
        F.first("mean").alias("mean"), F.first("p50").alias("p50"), F.first("p95").alias("p95"))
    return wide


def per_watt(agg: DataFrame, power_col: str = "power_watts") -> DataFrame:
    """Throughput per watt, only where the power budget is positive."""
    cols = [F.when(F.col(power_col) > 0, F.col(src) / F.col(power_col)).alias(dst)
            for src, dst in PER_WATT if src in agg.columns]
    return agg.select("*", *cols)


def usd_per_million(cost_per_hour: Column, tps_mean: Column) -> Column:
    """Cost per 1M input tokens; NULL when cost or throughput is 0 / NULL."""
    return F.when((F.coalesce(cost_per_hour, F.lit(0)) != 0) & (F.coalesce(tps_mean, F.lit(0)) != 0),
                  cost_per_hour / 3600.0 / tps_mean * 1_000_000)


def stop_after_first_error(meas: DataFrame, stop_col: str = "stop_on_error",
                           keys=("run_id", "model", "bucket_tokens")) -> DataFrame:
    """Drop attempts after the first failed one in groups whose model stops on error.

    The first failure per group is found with a grouped ``min`` (partial
    aggregation) and joined back, rather than a window over the whole group.
    """
    first = (meas.where(F.col("error_type").isNotNull()).groupBy(*keys)
                 .agg(F.min("repeat_index").alias("_first_err")))
    j = join_on(meas, first, list(keys), "left")
    keep = (~F.coalesce(F.col(stop_col), F.lit(False))) | F.col("_first_err").isNull() | \
           (F.col("repeat_index") <= F.col("_first_err"))
    return j.where(keep).drop("_first_err")


def attempt_counts(meas: DataFrame, keys=("run_id", "model", "model_type", "bucket_tokens")) -> DataFrame:
    """Attempts, successes and errors per group: one aggregation, no metric is computed."""
    return meas.groupBy(*keys).agg(F.count(F.lit(1)).alias("repeats"),
                                   F.count_if(F.col("error_type").isNull()).alias("successful_repeats"),
                                   F.count_if(F.col("error_type").isNotNull()).alias("errors"))


def speed_rows(meas: DataFrame, keys=("run_id", "model", "model_type", "bucket_tokens"), approx: bool = False) -> DataFrame:
    """Per-bucket success/attempt counts and the metric aggregate over successes."""
    ok = meas.where(F.col("error_type").isNull())
    return join_on(attempt_counts(meas, keys), aggregate_wide(ok, keys, approx), list(keys), "left")


def batch_compare(meas: DataFrame, keys=("run_id", "model"), chunk_tokens: int = 256, chunk_count: int = 100) -> DataFrame:
    """Serial attempts versus the single concatenated one, per run and model.

    Nothing is compared (no rows) unless ``chunk_tokens`` is positive and ``chunk_count`` exceeds one.
    """
    if chunk_tokens <= 0 or chunk_count <= 1:
        meas = meas.where(F.lit(False))
    serial = F.col("mode") == "serial"
    concat = F.col("mode") == "concat"
    lat_num = F.coalesce(F.col("latency_s"), F.lit(0.0))
    g = meas.groupBy(*keys).agg(
        F.count_if(serial).alias("serial_count"),
        F.sum(F.when(serial, F.coalesce(F.col("input_tokens"), F.lit(0)))).cast("long").alias("serial_total_tokens"),
        F.sum(F.when(serial, lat_num)).alias("serial_total_latency_s"),
        F.sum(F.when(concat, F.coalesce(F.col("input_tokens"), F.lit(0)))).cast("long").alias("concat_tokens"),
        F.sum(F.when(concat, lat_num)).alias("concat_latency_s"),
        F.max(F.when(concat, F.col("input_tps"))).alias("concat_input_tps"),
    )
    return g.where(F.col("serial_count") > 1).select(
        "*", F.lit(chunk_tokens).cast("long").alias("serial_chunk_tokens"),
        F.when(F.col("serial_total_latency_s") > 0,
               F.col("serial_total_tokens") / F.col("serial_total_latency_s")).alias("serial_effective_tps"),
        F.when(F.col("concat_latency_s") > 0,
               F.col("serial_total_latency_s") / F.col("concat_latency_s")).alias("speedup_vs_serial"),
    )


def stage_breakdown(meas: DataFrame, keys=("run_id", "model", "model_type", "bucket_tokens")) -> DataFrame:
    """Mean of each stage field, of the window count, and the unaccounted remainder; groups with no stage value are skipped."""
    present = [k for k in STAGE_FIELDS if k in meas.columns]
    windows = [F.avg(F.col("opf_windows").cast("double")).alias("opf_windows")] if "opf_windows" in meas.columns else []
    aggs = [F.avg(F.col(k).cast("double")).alias(k) for k in present]
    g = meas.groupBy(*keys).agg(F.avg(F.col("latency_s").cast("double")).alias("latency_s"),
                                F.count(F.coalesce(*[F.col(k) for k in present])).alias("_staged"), *aggs, *windows)
    accounted = sum((F.coalesce(F.col(k), F.lit(0.0)) for k in present), F.lit(0.0))
    return g.where(F.col("_staged") > 0).select(
        *keys, "latency_s", *present, *(["opf_windows"] if windows else []),
        F.when(F.col("latency_s").isNotNull(), F.greatest(F.col("latency_s") - accounted, F.lit(0.0))).alias("other_s"))


def scaling_fit(speed: DataFrame, keys=("run_id", "model", "model_type"), x: str = "bucket_tokens",
                y: str = "latency_s_p50") -> DataFrame:
    """Least-squares latency = overhead + per_token * tokens per group.

    Distinct (x, y) points; at least two, positive x-variance and positive
    slope; overhead floored at 0; R^2 NULL when y has no variance.
    """
    pts = (speed.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col("successful_repeats") > 0))
                .select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
                .dropDuplicates([*keys, "x", "y"]))
    g = pts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2_raw"),
        F.var_pop("y").alias("_vy"))
    return g.where((F.col("points") >= 2) & F.col("slope").isNotNull() & (F.col("slope") > 0)).select(
        *keys, "points",
        F.greatest(F.col("intercept"), F.lit(0.0)).alias("fixed_overhead_s"),
        F.col("intercept").alias("raw_intercept_s"),
        (F.col("slope") * 1000.0).alias("per_token_ms"),
        (F.lit(1.0) / F.col("slope")).alias("asymptotic_tps"),
        F.when(F.col("_vy") > 0, F.col("r2_raw")).alias("r2"))

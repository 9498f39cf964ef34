"""Result rows of timing runs (one object per run / model / bucket) and the report
tables derived from them.

``result_rows`` turns the long measurement table into the six row kinds;
``report_tables`` reads them back (any number of files / machines) and
derives the nine report sections as DataFrames; ``flat_rows`` is the flat,
sorted-header table written as CSV.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.jsonl import M_SCHEMA
from . import metrics as M
from .config import hardware_label, short_commit
from .ordinals import join_on

SCHEMA_VERSION = 1


def _agg_map(df: DataFrame, prefix_cols: list[str]) -> F.Column:
    pairs = []
    for c in prefix_cols:
        pairs += [F.lit(c), F.col(c).cast("double")]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def result_rows(meas: DataFrame, runs: DataFrame, quality: DataFrame | None = None, costs: DataFrame | None = None,
                scores: DataFrame | None = None) -> DataFrame:
    """All result rows as one DataFrame (columns = union of the kinds' fields).

    ``meas`` carries attempt numbers (:func:`metrics.numbered`). ``costs`` are
    the configured models; ``scores`` the scored samples behind ``quality``.

    Each attempt is its own ``measurement`` row instead of an element of a
    per-bucket list: a (run, model, bucket) group can be arbitrarily large,
    and a list would have to be gathered into one task and one record.
    """
    key = ["run_id", "model", "model_type", "bucket_tokens"]
    ok = meas.where(F.col("error_type").isNull())
    agg = M.aggregate_wide(ok.drop("repeat_index", "input_tokens"), key)
    counts = meas.groupBy(*key).agg(F.count(F.lit(1)).alias("repeats"),
                                    F.count_if(F.col("error_type").isNull()).alias("successful_repeats"))
    sp = M.per_watt(join_on(counts, agg, key, "left").join(runs.select("run_id", "power_watts"), "run_id", "left"))
    if costs is not None:
        sp = sp.join(F.broadcast(costs.select(F.col("name").alias("model"), "cost_per_hour_usd")), "model", "left").withColumn(
            "usd_per_1m_input_tokens", M.usd_per_million(F.col("cost_per_hour_usd"), F.col("input_tps_mean")))
    agg_cols = [c for c in sp.columns if c.endswith(("_mean", "_p50", "_p95", "_per_watt")) or c == "usd_per_1m_input_tokens"]
    load = F.struct(F.lit(0.0).alias("load_s"), F.lit("cpu").alias("device"))
    speed = sp.select(
        F.lit("speed").alias("kind"), F.col("run_id").cast("string").alias("run_id"), "model", "model_type",
        "bucket_tokens", F.col("bucket_tokens").alias("actual_tokens"), "repeats", "successful_repeats", "power_watts",
        load.alias("load"), _agg_map(sp, agg_cols).alias("aggregate"))
    attempts = meas.select(
        F.lit("measurement").alias("kind"), F.col("run_id").cast("string").alias("run_id"), "model", "model_type",
        "bucket_tokens", *[F.col(f.name).cast(f.dataType) for f in M_SCHEMA.fields if f.name in meas.columns],
        "error_type", "error")
    warm = (ok.where(F.col("repeat_index") == 0).groupBy("run_id", "model", "model_type")
              .agg(F.count(F.lit(1)).alias("repeats"), F.avg("latency_s").alias("latency_s_p50"),
                   F.avg("input_tps").alias("input_tps_mean"), F.avg("opf_model_forward_s").alias("opf_model_forward_s_mean"))
              .select(F.lit("warmup").alias("kind"), F.col("run_id").cast("string").alias("run_id"), "model", "model_type",
                      "repeats", load.alias("load"),
                      _agg_map(None, ["latency_s_p50", "input_tps_mean", "opf_model_forward_s_mean"]).alias("aggregate")))
    bc = M.batch_compare(meas).select(
        F.lit("batch_compare").alias("kind"), F.col("run_id").cast("string").alias("run_id"), "model",
        F.lit("synthetic").alias("model_type"), "serial_count", "serial_chunk_tokens",
        "serial_total_tokens", "serial_total_latency_s", "serial_effective_tps", "concat_tokens",
        "concat_latency_s", "concat_input_tps", "speedup_vs_serial")
    errors = (meas.where(F.col("error_type").isNotNull()).groupBy("run_id", "model", "model_type")
                  .agg(F.min_by("error_type", "event_id").alias("error_type"), F.min_by("error", "event_id").alias("error"))
                  .select(F.lit("model_error").alias("kind"), F.col("run_id").cast("string").alias("run_id"), "model",
                          "model_type", "error_type", "error"))
    meta = runs.select(F.lit("run_metadata").alias("kind"), F.col("run_id").cast("string").alias("run_id"),
                       "created_at", F.to_json("hardware").alias("hardware"))
    out = speed
    for part in (attempts, warm, bc, errors, meta):
        out = out.unionByName(part, allowMissingColumns=True)
    if quality is not None:
        out = out.unionByName(quality.select(F.lit("quality").alias("kind"), "*"), allowMissingColumns=True)
    if scores is not None:
        # one row per sample with a finding: a list in the quality row would hold every sample of a model
        bad = scores.where(F.col("error").isNull() & ((F.size("missed_pii") > 0) | (F.size("changed_anchors") > 0)))
        out = out.unionByName(bad.select(F.lit("sample_score").alias("kind"), "model", F.col("doc_id").cast("string").alias("sample_id"),
                                         "missed_pii", "changed_anchors"), allowMissingColumns=True)
    return out.withColumn("schema_version", F.lit(SCHEMA_VERSION).cast("long"))


def measurement_rows(rows: DataFrame) -> DataFrame:
    """Attempts as a long table with their open ``metrics``: ``measurement`` rows, plus the ``measurements``
    lists embedded in speed rows written in the list format."""
    keys = ["_source", "run_id", "model", "model_type", "bucket_tokens"]
    fields = [f.name for f in M_SCHEMA.fields]
    flat = rows.where(F.col("kind") == "measurement").select(*keys, *fields, "error_type", "metrics")
    nested = (rows.where((F.col("kind") == "speed") & F.col("measurements").isNotNull())
                  .select(*keys, F.explode(F.arrays_zip(F.col("measurements").alias("m"), F.col("listed").alias("l"))).alias("x"))
                  .select(*keys, *[F.col(f"x.m.{f}") for f in fields], F.lit(None).cast("string").alias("error_type"), F.col("x.l").alias("metrics")))
    return flat.unionByName(nested)


def _list_mean(name: str):
    """Mean of a field over a row's ``measurements`` list, else the stored aggregate."""
    values = F.filter(F.transform("measurements", lambda m: m[name].cast("double")), lambda x: x.isNotNull())
    mean = F.element_at(F.transform(F.array(values), lambda v: F.when(
        F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v))), 1)
    return F.coalesce(mean, F.element_at("aggregate", F.lit(f"{name}_mean")))


HW_SCHEMA = ("struct<accelerators:struct<jetson:struct<detected:boolean,model:string>,"
             "nvidia_smi:array<struct<name:string>>,torch:struct<cuda_devices:array<struct<name:string>>,"
             "mps_available:boolean>,mac_displays:array<struct<name:string>>>,platform:struct<machine:string>,"
             "git:struct<commit:string,dirty:boolean>,power:struct<budget_watts:double>>")


def report_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The nine report sections."""
    k = {n: rows.where(F.col("kind") == n) for n in
         ("run_metadata", "warmup", "speed", "quality", "batch_compare", "model_error")}
    agg = F.col("aggregate")

    def a(name):
        return F.element_at(agg, F.lit(name))

    hw = F.from_json("hardware", HW_SCHEMA)
    runs = k["run_metadata"].select("run_id", "created_at", hardware_label(hw).alias("hardware_label"),
                                    hw["power"]["budget_watts"].alias("power_watts"), short_commit(hw["git"]).alias("git"), "_source")
    warm = k["warmup"].select("model", "model_type", "repeats", F.col("load.load_s").alias("load_s"),
                              a("latency_s_p50").alias("latency_s_p50"), a("input_tps_mean").alias("input_tps_mean"),
                              a("opf_model_forward_s_mean").alias("forward_s"), a("opf_windows_mean").alias("windows"))
    speed = k["speed"].select("_source", "run_id", "model", "model_type", "bucket_tokens", "successful_repeats", "repeats",
                              a("latency_s_p50").alias("latency_s_p50"), a("input_tps_mean").alias("input_tps_mean"),
                              "power_watts", a("input_tps_per_watt").alias("input_tps_per_watt"),
                              a("prefill_tps_mean").alias("prefill_tps_mean"), a("decode_tps_mean").alias("decode_tps_mean"))
    # stage breakdown from the per-row measurement arrays
    ex = measurement_rows(rows).where(F.col("error_type").isNull())
    stage = M.stage_breakdown(ex, keys=("_source", "run_id", "model", "model_type", "bucket_tokens"))
    # two files may use one run id: each file is fitted on its own
    scaling = M.scaling_fit(speed, keys=("_source", "run_id", "model", "model_type"))
    batch = k["batch_compare"].select("model", "serial_count", "serial_chunk_tokens", "serial_total_tokens",
                                      "serial_total_latency_s", "serial_effective_tps", "concat_tokens",
                                      "concat_latency_s", "concat_input_tps", "speedup_vs_serial")
    quality = k["quality"].select("model", "model_type", "successful_samples", "sample_count", "recall", "pii_hit",
                                  "pii_total", "anchor_keep", "anchor_total", "anchor_keep_rate", "latency_s",
                                  F.coalesce("error_count", F.when(F.col("errors").isNotNull(), F.size("errors")), F.lit(0))
                                  .cast("long").alias("errors"))
    listed = k["quality"].select("model", F.explode("sample_scores").alias("s")).select(
        "model", "s.sample_id", "s.missed_pii", "s.changed_anchors")
    lone = rows.where(F.col("kind") == "sample_score").select("model", "sample_id", "missed_pii", "changed_anchors")
    details = listed.unionByName(lone).where((F.size("missed_pii") > 0) | (F.size("changed_anchors") > 0))
    errors = k["model_error"].select("model", "model_type", "error_type",
                                     F.substring(F.regexp_replace(F.coalesce("error", F.lit("")), r"\|", "/"), 1, 180)
                                     .alias("error"))
    return {"runs": runs, "warmup": warm, "speed": speed, "stage_breakdown": stage, "scaling": scaling,
            "batch_compare": batch, "quality": quality, "quality_details": details, "errors": errors}


def flat_rows(rows: DataFrame) -> DataFrame:
    """Flat rows for CSV: speed/warmup/batch, quality and scaling estimates; 50 columns, sorted header."""
    agg = F.col("aggregate")
    from_agg = ("latency_s_p50", "latency_s_p95", "input_tps_mean", "input_tps_per_watt", "prefill_tps_mean", "prefill_tps_per_watt",
                "decode_tps_mean", "decode_tps_per_watt")
    sw = rows.where(F.col("kind").isin("speed", "warmup", "batch_compare")).select(
        "kind", F.col("_source").alias("source"), "run_id", "model", "model_type", "bucket_tokens",
        "successful_repeats", "repeats", F.col("load.load_s").alias("load_s"), "serial_count",
        "serial_chunk_tokens", "serial_total_tokens", "serial_total_latency_s", "serial_effective_tps",
        "concat_tokens", "concat_latency_s", "concat_input_tps", "speedup_vs_serial", "power_watts",
        *[F.element_at(agg, F.lit(k)).alias(k) for k in from_agg],
        *[_list_mean(k).alias(f"{k}_mean") for k in (*M.STAGE_FIELDS, "opf_windows", "opf_window_tokens")])
    q = rows.where(F.col("kind") == "quality").select(
        "kind", F.col("_source").alias("source"), "run_id", "model", "model_type", "sample_count",
        "successful_samples", "recall", "pii_hit", "pii_total", "anchor_keep_rate", "latency_s")
    sp = rows.where(F.col("kind") == "speed").select(
        "_source", "run_id", "model", "model_type", "bucket_tokens", "successful_repeats",
        F.element_at(agg, F.lit("latency_s_p50")).alias("latency_s_p50"))
    sc = M.scaling_fit(sp, keys=("_source", "run_id", "model", "model_type")).select(
        F.lit("scaling_estimate").alias("kind"), F.col("_source").alias("source"), "run_id", "model", "model_type",
        "points", "fixed_overhead_s", "per_token_ms", "asymptotic_tps", "r2")
    out = sw.unionByName(q, allowMissingColumns=True).unionByName(sc, allowMissingColumns=True)
    return out.select(*sorted(out.columns))

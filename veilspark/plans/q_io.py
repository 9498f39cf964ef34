"""Registered queries: JSON-lines sources / sinks (SRC, SNK) and report tables (RPT)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import results as RS
from ..operators.config import models_table, run_metadata
from ..operators.quality import gold_pii, quality_totals
from ..sources import jsonl as J
from ..sources.tables import table
from .q_eval import MEAS_SQL, RUNS_SQL, SPEED_SQL, attempts, scored, scored_sql, totals_sql
from .registry import register


def r6(c):
    return F.round(c + F.lit(1e-9), 6)


def r4(c):
    return F.round(c + F.lit(1e-9), 4)


def _runs(spark, sf_dir):
    return run_metadata(table(spark, sf_dir, "region"), table(spark, sf_dir, "nation"))


def _written_results(spark: SparkSession, sf_dir: str, numbered: DataFrame | None = None) -> str:
    """SNK-1/2: write the run's result rows as JSON lines (fresh folder per run)."""
    rows = RS.result_rows(attempts(spark, sf_dir) if numbered is None else numbered, _runs(spark, sf_dir), costs=models_table(spark))
    path = J.scratch_path(spark, "results")
    J.write_jsonl(rows, path, mode="overwrite")
    return path


def results(spark, sf_dir, numbered: DataFrame | None = None) -> DataFrame:
    """The written lines, parsed once and stored by kind."""
    return _by_kind(spark, J.read_results(spark, [_written_results(spark, sf_dir, numbered)])[0])


def _by_kind(spark, rows: DataFrame) -> DataFrame:
    return J.store_by_kind(rows, J.scratch_path(spark, "kinds"))


def _written_samples(spark: SparkSession, sf_dir: str) -> str:
    """Labelled samples as JSON lines, with per-language comment lines, blank
    lines and the ``labels`` rows (objects without id/text) mixed in."""
    docs = table(spark, sf_dir, "documents")
    s = docs.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), "text", gold_pii("text").alias("pii"),
                                       F.array("lang").alias("tags"))).alias("value"))
    comments = docs.select(F.concat(F.lit("# language "), F.col("lang")).alias("value")).distinct()
    blanks = docs.select(F.lit("   ").alias("value")).limit(3)
    labels = table(spark, sf_dir, "labels").select(F.to_json(F.struct("*")).alias("value"))
    path = J.scratch_path(spark, "samples")
    J.write_lines(s.unionByName(comments).unionByName(blanks).unionByName(labels), path)
    return path


GOLD_SQL = " || ".join(f"regexp_extract_all(text, '{p}', 0)" for p in
                       (r"[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+", r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
                        r"[0-9]{4}(?:[ -]?[0-9]{4}){3}"))


@register("src_1_read_samples", sql=f"""
SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS text_md5, CAST(len({GOLD_SQL}) AS BIGINT) AS n_pii,
       CAST(0 AS BIGINT) AS n_anchors, [lang] AS tags_list_placeholder FROM documents
""".replace(", [lang] AS tags_list_placeholder", ", lang AS tag"))
def src_1_read_samples(spark, sf_dir):
    samples, _ = J.read_samples(spark, _written_samples(spark, sf_dir))
    return samples.select("id", F.md5("text").alias("text_md5"), F.size("pii").cast("long").alias("n_pii"),
                          F.size("anchors").cast("long").alias("n_anchors"), F.element_at("tags", 1).alias("tag"))


@register("src_2_reject_rows", sql="""
SELECT 'no id' AS reason, count(*) AS n FROM labels
""")
def src_2_reject_rows(spark, sf_dir):
    _, rejects = J.read_samples(spark, _written_samples(spark, sf_dir))
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register("src_3_read_results", sql=f"""
WITH {MEAS_SQL}
SELECT 'speed' AS kind, count(*) AS n FROM (SELECT DISTINCT run_id, model, bucket_tokens FROM meas)
UNION ALL SELECT 'batch_compare', count(*) FROM (SELECT run_id, model FROM meas GROUP BY ALL HAVING count(*) FILTER (WHERE mode = 'serial') > 1)
UNION ALL SELECT 'warmup', count(*) FROM (SELECT DISTINCT run_id, model FROM meas WHERE repeat_index = 0 AND error_type IS NULL)
UNION ALL SELECT 'model_error', count(*) FROM (SELECT DISTINCT run_id, model FROM meas WHERE error_type IS NOT NULL)
UNION ALL SELECT 'run_metadata', count(*) FROM region
UNION ALL SELECT 'measurement', count(*) FROM meas
""")
def src_3_read_results(spark, sf_dir):
    return results(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@register("src_4_split_by_kind", sql=f"""
WITH {MEAS_SQL}
SELECT CAST(run_id AS VARCHAR) AS run_id, model, CAST(bucket_tokens AS BIGINT) AS bucket_tokens,
       count(*) AS repeats, count(*) FILTER (WHERE error_type IS NULL) AS successful_repeats
FROM meas GROUP BY ALL
""")
def src_4_split_by_kind(spark, sf_dir):
    speed = J.split_kinds(results(spark, sf_dir))["speed"]
    return speed.select("run_id", "model", "bucket_tokens", "repeats", "successful_repeats")


def _open_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurement rows with fields that no schema names, written as lines and read back."""
    m = attempts(spark, sf_dir).where(F.col("error_type").isNull())
    line = F.struct(F.lit("measurement").alias("kind"), F.col("run_id").cast("string").alias("run_id"), "model", "model_type", "bucket_tokens", "latency_s",
                    (F.col("latency_s") * 0.3).alias("mlx_forward_s"), (F.col("repeat_index") % 2 == 0).alias("mlx_cached"),
                    F.when(F.col("repeat_index") % 3 == 0, F.col("repeat_index")).alias("mlx_evictions"),
                    F.col("repeat_index").alias("opf_decoded_mismatch"), F.col("repeat_index").alias("other_number"), F.col("model").alias("mlx_note"))
    path = J.scratch_path(spark, "open-measurements")
    J.write_lines(m.select(F.to_json(line).alias("value")), path)
    return RS.measurement_rows(J.read_results(spark, [path], glob="part-*")[0])


@register("src_3b_open_metrics", sql=f"""
WITH {MEAS_SQL},
o AS (SELECT CAST(run_id AS VARCHAR) AS run_id, model, bucket_tokens, latency_s, latency_s * 0.3 AS mlx_forward_s,
             CASE WHEN repeat_index % 3 = 0 THEN CAST(repeat_index AS DOUBLE) END AS mlx_evictions FROM meas WHERE error_type IS NULL),
long AS (UNPIVOT o ON latency_s, mlx_forward_s, mlx_evictions INTO NAME metric VALUE value)
SELECT run_id, model, bucket_tokens, metric, round(1e-9 + avg(value), 6) AS mean, round(1e-9 + quantile_cont(value, 0.5), 6) AS p50,
       round(1e-9 + quantile_cont(value, 0.95), 6) AS p95, count(*) AS n
FROM long GROUP BY ALL
""")
def src_3b_open_metrics(spark, sf_dir):
    """Mean, p50 and p95 of every number that the lines hold under a core or profiled key, known beforehand or not."""
    a = M.aggregate_open(_open_measurements(spark, sf_dir))
    return a.select("run_id", "model", "bucket_tokens", "metric", *[r6(F.col(c)).alias(c) for c in ("mean", "p50", "p95")], "n")


@register("src_5_merge_machines", sql=f"""
WITH {MEAS_SQL}
SELECT model, count(DISTINCT (run_id, bucket_tokens)) + count(DISTINCT CASE WHEN run_id % 2 = 0 THEN (run_id, bucket_tokens) END) AS speed_rows
FROM meas GROUP BY model
""")
def src_5_merge_machines(spark, sf_dir):
    """Two machines' result folders, the second with the even runs only, merged into one table."""
    a = _written_results(spark, sf_dir)
    rows_b = RS.result_rows(attempts(spark, sf_dir).where(F.col("run_id") % 2 == 0), _runs(spark, sf_dir))
    b = J.scratch_path(spark, "results-b")
    J.write_jsonl(rows_b, b, mode="overwrite")
    merged = J.merge(J.read_results(spark, [a])[0], J.read_results(spark, [b])[0])
    return merged.where(F.col("kind") == "speed").groupBy("model").agg(F.count(F.lit(1)).alias("speed_rows"))


@register("snk_1_jsonl_roundtrip", sql=f"""
WITH {MEAS_SQL}
SELECT CAST(run_id AS VARCHAR) AS run_id, model, CAST(bucket_tokens AS BIGINT) AS bucket_tokens,
       count(*) FILTER (WHERE error_type IS NULL) AS n_measurements, count(*) FILTER (WHERE error_type IS NOT NULL) AS n_errors,
       count(*) AS sorted_lines, round(sum(latency_s) + 1e-9, 4) AS latency_s
FROM meas GROUP BY ALL
""")
def snk_1_jsonl_roundtrip(spark, sf_dir):
    """Written lines: their top-level keys are in order, and their values come back."""
    lines = spark.read.text(_written_results(spark, sf_dir)).where(F.get_json_object("value", "$.kind") == "measurement")
    keys = F.json_object_keys("value")
    v = lambda k, kind: F.get_json_object("value", f"$.{k}").cast(kind)
    m = lines.select(v("run_id", "string").alias("run_id"), v("model", "string").alias("model"), v("bucket_tokens", "long").alias("bucket_tokens"),
                     v("error_type", "string").alias("error_type"), v("latency_s", "double").alias("latency_s"), (keys == F.array_sort(keys)).alias("in_order"))
    return m.groupBy("run_id", "model", "bucket_tokens").agg(
        F.count_if(F.col("error_type").isNull()).alias("n_measurements"),
        F.count_if(F.col("error_type").isNotNull()).alias("n_errors"),
        F.count_if("in_order").alias("sorted_lines"), r4(F.sum("latency_s")).alias("latency_s"))


@register("snk_2_overwrite_run", sql="""
SELECT count(*) AS run_metadata_rows FROM region
""")
def snk_2_overwrite_run(spark, sf_dir):
    """Writing the same run twice with overwrite leaves one copy."""
    rows = RS.result_rows(attempts(spark, sf_dir), _runs(spark, sf_dir)).where(F.col("kind") == "run_metadata")
    path = J.scratch_path(spark, "overwrite")
    J.write_jsonl(rows, path, mode="overwrite")
    J.write_jsonl(rows, path, mode="overwrite")
    back = J.read_results(spark, [path])[0]
    return back.agg(F.count(F.lit(1)).alias("run_metadata_rows"))


@register("snk_3_flat_csv")
def snk_3_flat_csv(spark, sf_dir):
    """The flat table written as CSV and read back: rows, columns and sums by kind."""
    flat = RS.flat_rows(results(spark, sf_dir))
    path = J.scratch_path(spark, "csv")
    flat.write.mode("overwrite").option("header", True).csv(path)
    back = spark.read.option("header", True).csv(path)
    sums = ("latency_s_p50", "input_tps_mean", "input_tps_per_watt", "opf_model_forward_s_mean", "per_token_ms")
    return back.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.lit(len(back.columns)).alias("columns"),
                                    *[r4(F.sum(F.col(c).cast("double"))).alias(c) for c in sums])


def _report(spark, sf_dir, name):
    return RS.report_tables(results(spark, sf_dir))[name]


@register("snk_4_report_sections")
def snk_4_report_sections(spark, sf_dir):
    """The nine sections: rows and the sum of one value of each."""
    numbered = attempts(spark, sf_dir)
    tabs = RS.report_tables(J.merge(results(spark, sf_dir, numbered), _quality_results(spark, sf_dir, numbered)))
    values = {"runs": F.col("power_watts"), "warmup": F.col("latency_s_p50"), "speed": F.col("input_tps_mean"),
              "stage_breakdown": F.col("other_s"), "scaling": F.col("per_token_ms"), "batch_compare": F.col("speedup_vs_serial"),
              "quality": F.col("pii_total"), "quality_details": F.size("missed_pii") + F.size("changed_anchors"), "errors": F.length("error")}
    return J.merge(*[t.agg(F.count(F.lit(1)).alias("rows"), r4(F.sum(values[n].cast("double"))).alias("total"))
                     .withColumn("section", F.lit(n)) for n, t in tabs.items()])


@register("rpt_1_runs", sql=f"""
WITH {RUNS_SQL}, n AS (SELECT n_regionkey, string_agg(n_name, ' + ' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey)
SELECT CAST(r_regionkey AS VARCHAR) AS run_id, '2024-01-0' || (r_regionkey + 1) || 'T00:00:00+00:00' AS created_at,
       CASE r_regionkey WHEN 0 THEN 'Jetson ' || upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2))
                        WHEN 4 THEN 'Apple Silicon MPS' ELSE coalesce(names, upper(substr(r_name, 1, 3))) END AS hardware_label,
       power_watts, substr(sha1(r_name), 1, 8) || CASE WHEN r_regionkey % 2 = 1 THEN ' dirty' ELSE '' END AS git
FROM region JOIN power ON power.run_id = r_regionkey LEFT JOIN n ON n.n_regionkey = r_regionkey
""")
def rpt_1_runs(spark, sf_dir):
    return _report(spark, sf_dir, "runs").drop("_source")


@register("rpt_2_warmup")
def rpt_2_warmup(spark, sf_dir):
    w = _report(spark, sf_dir, "warmup")
    return w.select("model", "model_type", "repeats", "load_s", *[r6(F.col(c)).alias(c) for c in
                    ("latency_s_p50", "input_tps_mean", "forward_s")], "windows")


@register("rpt_3_speed", sql=f"""
WITH {MEAS_SQL}, {RUNS_SQL},
a AS (SELECT run_id, model, bucket_tokens, count(*) AS repeats, count(*) FILTER (WHERE error_type IS NULL) AS successful_repeats,
             quantile_cont(latency_s, 0.5) AS p50, avg(input_tps) AS tps FROM meas GROUP BY ALL)
SELECT CAST(a.run_id AS VARCHAR) AS run_id, model, bucket_tokens, successful_repeats, repeats,
       round(p50 + 1e-9, 6) AS latency_s_p50, round(tps + 1e-9, 6) AS input_tps_mean, round(p.power_watts + 1e-9, 6) AS power_watts,
       round(CASE WHEN p.power_watts > 0 THEN tps / p.power_watts END + 1e-9, 6) AS input_tps_per_watt
FROM a JOIN power p USING (run_id)
""")
def rpt_3_speed(spark, sf_dir):
    s = _report(spark, sf_dir, "speed")
    return s.select("run_id", "model", "bucket_tokens", "successful_repeats", "repeats",
                    *[r6(F.col(c)).alias(c) for c in ("latency_s_p50", "input_tps_mean", "power_watts", "input_tps_per_watt")])


@register("rpt_4_stage_breakdown", sql=f"""
WITH {MEAS_SQL}
SELECT CAST(run_id AS VARCHAR) AS run_id, model, bucket_tokens, round(avg(latency_s) + 1e-9, 6) AS latency_s,
       round(greatest(avg(latency_s) - (avg(opf_tokenize_s) + avg(opf_model_forward_s) + avg(opf_decode_s)), 0) + 1e-9, 6) AS other_s
FROM meas WHERE error_type IS NULL GROUP BY ALL
""")
def rpt_4_stage_breakdown(spark, sf_dir):
    s = _report(spark, sf_dir, "stage_breakdown")
    return s.select("run_id", "model", "bucket_tokens", r6(F.col("latency_s")).alias("latency_s"),
                    r6(F.col("other_s")).alias("other_s"))


@register("rpt_5_scaling", sql=f"""
WITH {MEAS_SQL}, {SPEED_SQL},
pts AS (SELECT DISTINCT run_id, model, CAST(bucket_tokens AS DOUBLE) AS x, latency_s_p50 AS y
        FROM speed WHERE latency_s_p50 IS NOT NULL AND successful_repeats > 0),
g AS (SELECT run_id, model, count(*) AS points, regr_slope(y, x) AS slope, regr_intercept(y, x) AS icept, regr_r2(y, x) AS r2, var_pop(y) AS vy FROM pts GROUP BY ALL)
SELECT CAST(run_id AS VARCHAR) AS run_id, model, points, round(greatest(icept, 0) + 1e-9, 6) AS fixed_overhead_s,
       round(slope * 1000 + 1e-9, 6) AS per_token_ms, round(1 / slope + 1e-9, 6) AS asymptotic_tps, round(CASE WHEN vy > 0 THEN r2 END + 1e-9, 6) AS r2
FROM g WHERE points >= 2 AND slope > 0
""")
def rpt_5_scaling(spark, sf_dir):
    s = _report(spark, sf_dir, "scaling")
    return s.select("run_id", "model", "points", *[r6(F.col(c)).alias(c) for c in ("fixed_overhead_s", "per_token_ms", "asymptotic_tps", "r2")])


@register("rpt_6_batch_compare")
def rpt_6_batch_compare(spark, sf_dir):
    b = _report(spark, sf_dir, "batch_compare")
    return b.select("model", "serial_count", r6(F.col("speedup_vs_serial")).alias("speedup_vs_serial"))


def _stored_scores(spark, sf_dir) -> DataFrame:
    """The scored samples, stored: totals and sample rows both read them."""
    path = J.scratch_path(spark, "scores")
    scored(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def _quality_results(spark, sf_dir, numbered: DataFrame | None = None) -> DataFrame:
    """Result rows with the quality job's rows, written and read back."""
    scores = _stored_scores(spark, sf_dir)
    q = quality_totals(scores).withColumn("model_type", F.lit("regex")).withColumnRenamed("errors", "error_count").drop("over_redactions")
    rows = RS.result_rows(attempts(spark, sf_dir) if numbered is None else numbered, _runs(spark, sf_dir), quality=q, scores=scores)
    path = J.scratch_path(spark, "results-q")
    J.write_jsonl(rows.where(F.col("kind").isin("quality", "sample_score")), path, mode="overwrite")
    return _by_kind(spark, J.read_results(spark, [path])[0])


@register("rpt_7_quality", sql=f"""
WITH {scored_sql()}, t AS ({totals_sql('regex')})
SELECT model, 'regex' AS model_type, successful_samples, sample_count, pii_hit, pii_total, anchor_keep, anchor_total, errors,
       round(CASE WHEN pii_total > 0 THEN pii_hit / pii_total ELSE 1.0 END + 1e-9, 6) AS recall,
       round(CASE WHEN anchor_total > 0 THEN anchor_keep / anchor_total ELSE 1.0 END + 1e-9, 6) AS anchor_keep_rate,
       round(latency_s + 1e-9, 6) AS latency_s
FROM t
""")
def rpt_7_quality(spark, sf_dir):
    """Quality rows join the results table (written by the quality job)."""
    q = RS.report_tables(_quality_results(spark, sf_dir))["quality"]
    return q.select(*[r6(F.col(c)).alias(c) if c in ("recall", "anchor_keep_rate", "latency_s") else F.col(c) for c in q.columns])


@register("rpt_8_quality_details", sql=f"""
WITH {scored_sql()}
SELECT model, CAST(doc_id AS VARCHAR) AS sample_id, array_to_string(missed_pii, '<br>') AS missed,
       md5(array_to_string(changed_anchors, '<br>')) AS changed_md5
FROM scored WHERE error IS NULL AND (len(missed_pii) > 0 OR len(changed_anchors) > 0)
""")
def rpt_8_quality_details(spark, sf_dir):
    """The Quality Details section, from result rows written and read back."""
    d = RS.report_tables(_quality_results(spark, sf_dir))["quality_details"]
    return d.select("model", "sample_id", F.array_join("missed_pii", "<br>").alias("missed"),
                    F.md5(F.array_join("changed_anchors", "<br>")).alias("changed_md5"))


@register("rpt_9_model_errors", sql=f"""
WITH {MEAS_SQL}
SELECT CAST(run_id AS VARCHAR) AS run_id, model, min_by(error_type, event_id) AS error_type,
       'attempt ' || CAST(min(event_id) AS VARCHAR) || ' failed' AS error
FROM meas WHERE error_type IS NOT NULL GROUP BY ALL
""")
def rpt_9_model_errors(spark, sf_dir):
    e = results(spark, sf_dir).where(F.col("kind") == "model_error")
    return e.select("run_id", "model", "error_type", F.substring(F.regexp_replace("error", r"\|", "/"), 1, 180).alias("error"))

"""Registered queries: quality scoring (QLT, AGG-10, JN-1) and timing rollups (AGG, RPT)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import RULES
from ..operators import metrics as M
from ..operators import quality as Q
from ..operators.config import models_table, run_metadata
from ..operators.redact import redact_rules
from ..sources.tables import spread, table
from . import oracle_sql as O
from .registry import register

R6 = 6


def r6(c):
    """Round for comparison. The 1e-9 nudge moves values that sit exactly on a
    half-way point (common with decimal test data) off it, so both engines
    round them the same way despite last-bit differences."""
    return F.round(c + F.lit(1e-9), R6)


# ----------------------------------------------------------------- quality inputs

def sample_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, plus cases from ``benchmark`` that no document has: a text that cannot be
    redacted (NULL) and a gold address that the rules miss (its last part has one letter)."""
    docs = spread(table(spark, sf_dir, "documents"), key="doc_id").select("doc_id", "text", "lang", "source", "n_chars")
    case = F.col("item_id") % 10
    text = F.when(case == 1, F.concat(F.lit("Write to user"), F.col("item_id").cast("string"), F.lit("@host.x today")))
    cases = table(spark, sf_dir, "benchmark").where(case < 2).select(
        (-1 - F.col("item_id")).alias("doc_id"), text.alias("text"), F.lit("xx").alias("lang"), F.lit("cases").alias("source"),
        F.length(text).cast("long").alias("n_chars"))
    return docs.unionByName(cases)


SAMPLES_SQL = """
alldocs AS (
  SELECT doc_id, text, lang, source FROM documents UNION ALL
  SELECT -1 - item_id, CASE WHEN item_id % 10 = 1 THEN 'Write to user' || item_id || '@host.x today' END, 'xx', 'cases'
  FROM benchmark WHERE item_id % 10 < 2
)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.gold_samples(sample_texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def outputs(spark: SparkSession, sf_dir: str, model: str = "regex") -> DataFrame:
    """One redactor's output per sample; a sample without text fails. ``latency_s`` stands in for a
    measured time: a microsecond per character."""
    red = redact_rules(sample_texts(spark, sf_dir), rules=RULES if model == "regex" else RULES[:8])
    return red.select("doc_id", F.lit(model).alias("model"), F.col("redacted").alias("output"),
                      F.when(F.col("text").isNull(), F.lit("TypeError")).alias("error"),
                      (F.length("text") / 1e6).alias("latency_s"))


def scored(spark, sf_dir, model="regex"):
    return Q.score_samples(samples(spark, sf_dir), outputs(spark, sf_dir, model))


_GOLD = " || ".join(f"regexp_extract_all(text, {O.q(p)}, 0)" for p in Q.GOLD_PATTERNS)


def _trunc5(expr):
    units = f"regexp_extract_all({expr}, {O.q('(?:[' + O.SP + ']*(?:' + O.TOKEN_RE2 + '))')}, 0)"
    return (f"CASE WHEN {O.token_count(expr)} <= 5 THEN {expr} "
            f"ELSE substr({expr}, 1, CAST(list_sum(list_transform({units}[1:5], lambda x: len(x))) AS BIGINT)) END")


def scored_sql(model: str = "regex") -> str:
    n_rules = 10 if model == "regex" else 8
    return f"""{SAMPLES_SQL},
found AS (
  SELECT d.doc_id, list(b.text ORDER BY b.item_id) AS found
  FROM alldocs d JOIN benchmark b ON contains(d.text, b.text) GROUP BY d.doc_id
),
samples AS (
  SELECT d.doc_id, d.text, d.lang, d.source, {_GOLD} AS pii,
         [{_trunc5('d.text')}] || coalesce(f.found, []) AS anchors, [d.lang, d.source] AS tags
  FROM alldocs d LEFT JOIN found f USING (doc_id)
),
{O.redact_steps('alldocs', 'text', ['doc_id'], n_rules)},
outputs AS (
  SELECT s10.doc_id, '{model}' AS model, CASE WHEN d.text IS NOT NULL THEN s10.t END AS output,
         CASE WHEN d.text IS NULL THEN 'TypeError' END AS error, length(d.text) / 1e6 AS latency_s
  FROM s10 JOIN alldocs d USING (doc_id)
),
scored AS (
  SELECT o.model, s.doc_id, s.lang, s.tags, o.error, o.latency_s,
         len(s.pii) AS pii_total,
         len(s.pii) - len(list_filter(s.pii, lambda v: contains(o.output, v))) AS pii_hit,
         list_filter(s.pii, lambda v: contains(o.output, v)) AS missed_pii,
         len(s.anchors) AS anchor_total,
         len(s.anchors) - len(list_filter(s.anchors, lambda v: NOT contains(o.output, v))) AS anchor_keep,
         list_filter(s.anchors, lambda v: NOT contains(o.output, v)) AS changed_anchors
  FROM samples s JOIN outputs o USING (doc_id)
)"""


@register("jn_1_sample_output_join", sql=f"""
WITH {scored_sql()}
SELECT doc_id, model, CASE WHEN error IS NULL THEN CAST(pii_total AS BIGINT) END AS pii_total, CASE WHEN error IS NULL THEN CAST(anchor_total AS BIGINT) END AS anchor_total,
       CASE WHEN error IS NULL THEN 0 ELSE 1 END AS failed
FROM scored
""")
def jn_1_sample_output_join(spark, sf_dir):
    s = scored(spark, sf_dir)
    fine = F.col("error").isNull()
    return s.select("doc_id", "model", F.when(fine, F.col("pii_total").cast("long")).alias("pii_total"),
                    F.when(fine, F.col("anchor_total").cast("long")).alias("anchor_total"),
                    F.when(F.col("error").isNull(), 0).otherwise(1).alias("failed"))


@register("qlt_1_missed_pii", sql=f"""
WITH {scored_sql()}
SELECT doc_id, CAST(j - 1 AS BIGINT) AS pos, missed_pii[j] AS value
FROM scored, range(1, len(missed_pii) + 1) r(j) WHERE error IS NULL
""")
def qlt_1_missed_pii(spark, sf_dir):
    s = scored(spark, sf_dir).where(F.col("error").isNull())
    return s.select("doc_id", F.posexplode("missed_pii").alias("pos", "value")).select(
        "doc_id", F.col("pos").cast("long"), "value")


@register("qlt_2_pii_hit", sql=f"""
WITH {scored_sql()}
SELECT doc_id, CAST(pii_total AS BIGINT) AS pii_total, CAST(pii_hit AS BIGINT) AS pii_hit FROM scored WHERE error IS NULL
""")
def qlt_2_pii_hit(spark, sf_dir):
    s = scored(spark, sf_dir).where(F.col("error").isNull())
    return s.select("doc_id", F.col("pii_total").cast("long"), F.col("pii_hit").cast("long"))


@register("qlt_3_changed_anchors", sql=f"""
WITH {scored_sql()}
SELECT doc_id, CAST(anchor_total AS BIGINT) AS anchor_total, CAST(anchor_keep AS BIGINT) AS anchor_keep,
       md5(array_to_string(changed_anchors, chr(1))) AS changed_md5
FROM scored WHERE error IS NULL
""")
def qlt_3_changed_anchors(spark, sf_dir):
    s = scored(spark, sf_dir).where(F.col("error").isNull())
    return s.select("doc_id", F.col("anchor_total").cast("long"), F.col("anchor_keep").cast("long"),
                    F.md5(F.array_join("changed_anchors", "\u0001")).alias("changed_md5"))


@register("qlt_4_over_redaction", sql=f"""
WITH {scored_sql()}
SELECT lang, count(*) AS samples,
       count(*) FILTER (WHERE pii_total = 0 AND anchor_keep < anchor_total) AS over_redacted
FROM scored WHERE error IS NULL GROUP BY lang
""")
def qlt_4_over_redaction(spark, sf_dir):
    s = scored(spark, sf_dir).where(F.col("error").isNull())
    return s.groupBy("lang").agg(F.count(F.lit(1)).alias("samples"),
                                 F.count_if(F.col("over_redaction")).alias("over_redacted"))


@register("qlt_5_quality_details", sql=f"""
WITH {scored_sql()}
SELECT model, doc_id, 'missed_pii' AS kind, CAST(j - 1 AS BIGINT) AS pos, missed_pii[j] AS value
FROM scored, range(1, len(missed_pii) + 1) r(j) WHERE error IS NULL
UNION ALL
SELECT model, doc_id, 'changed_anchor' AS kind, CAST(j - 1 AS BIGINT) AS pos, changed_anchors[j] AS value
FROM scored, range(1, len(changed_anchors) + 1) r(j) WHERE error IS NULL
""")
def qlt_5_quality_details(spark, sf_dir):
    d = Q.quality_details(scored(spark, sf_dir))
    return d.select("model", "doc_id", "kind", F.col("pos").cast("long"), "value")


@register("qlt_6_failed_samples", sql=f"""
WITH {scored_sql()}
SELECT model, doc_id, error FROM scored WHERE error IS NOT NULL
""")
def qlt_6_failed_samples(spark, sf_dir):
    return scored(spark, sf_dir).where(F.col("error").isNotNull()).select("model", "doc_id", "error")


@register("qlt_7_exact_match", sql=f"""
WITH {SAMPLES_SQL}, {O.redact_steps('alldocs', 'text', ['doc_id'], 10, prefix='a')},
{O.redact_steps('alldocs', 'text', ['doc_id'], 8, prefix='b')}
SELECT count(*) AS samples, count(*) FILTER (WHERE a.t = b.t) AS exact,
       round(1e-9 + avg(CASE WHEN a.t = b.t THEN 1.0 ELSE 0.0 END), 6) AS exact_rate
FROM as10 a JOIN bs10 b USING (doc_id) JOIN alldocs d USING (doc_id) WHERE d.text IS NOT NULL
""")
def qlt_7_exact_match(spark, sf_dir):
    a = outputs(spark, sf_dir, "regex")
    b = outputs(spark, sf_dir, "regex-no-address")
    m = Q.exact_match_rate(a.where(F.col("error").isNull()), b.where(F.col("error").isNull()))
    return m.select("samples", "exact", r6(F.col("exact_rate")).alias("exact_rate"))


def totals_sql(model: str) -> str:
    return f"""
SELECT model, count(*) AS sample_count, count(*) FILTER (WHERE error IS NULL) AS successful_samples,
  CAST(sum(CASE WHEN error IS NULL THEN pii_total ELSE 0 END) AS BIGINT) AS pii_total,
  CAST(sum(CASE WHEN error IS NULL THEN pii_hit ELSE 0 END) AS BIGINT) AS pii_hit,
  CAST(sum(CASE WHEN error IS NULL THEN anchor_total ELSE 0 END) AS BIGINT) AS anchor_total,
  CAST(sum(CASE WHEN error IS NULL THEN anchor_keep ELSE 0 END) AS BIGINT) AS anchor_keep,
  count(*) FILTER (WHERE error IS NULL AND pii_total = 0 AND anchor_keep < anchor_total) AS over_redactions,
  count(*) FILTER (WHERE error IS NOT NULL) AS errors, coalesce(sum(latency_s) FILTER (WHERE error IS NULL), 0.0) AS latency_s
FROM scored GROUP BY model"""


@register("agg_10_quality_totals", sql=f"""
WITH {scored_sql()}, t AS ({totals_sql('regex')})
SELECT * EXCLUDE (latency_s), round(1e-9 + CASE WHEN pii_total > 0 THEN pii_hit / pii_total ELSE 1.0 END, 6) AS recall,
       round(1e-9 + CASE WHEN anchor_total > 0 THEN anchor_keep / anchor_total ELSE 1.0 END, 6) AS anchor_keep_rate,
       round(1e-9 + latency_s, 6) AS latency_s
FROM t
""")
def agg_10_quality_totals(spark, sf_dir):
    t = Q.quality_totals(scored(spark, sf_dir))
    rounded = ("recall", "anchor_keep_rate", "latency_s")
    return t.select(*[r6(F.col(c)).alias(c) if c in rounded else F.col(c) for c in t.columns])


@register("qlt_8_recall_by_lang", sql=f"""
WITH {scored_sql()}, by_tag AS (SELECT unnest(tags) AS tag, pii_total, pii_hit FROM scored WHERE error IS NULL)
SELECT tag, CAST(sum(pii_total) AS BIGINT) AS pii_total, CAST(sum(pii_hit) AS BIGINT) AS pii_hit,
       round(1e-9 + CASE WHEN sum(pii_total) > 0 THEN sum(pii_hit) / sum(pii_total) ELSE 1.0 END, 6) AS recall
FROM by_tag GROUP BY tag
""")
def qlt_8_recall_by_lang(spark, sf_dir):
    s = scored(spark, sf_dir).where(F.col("error").isNull()).select(F.explode("tags").alias("tag"), "pii_total", "pii_hit")
    g = s.groupBy("tag").agg(F.sum("pii_total").cast("long").alias("pii_total"), F.sum("pii_hit").cast("long").alias("pii_hit"))
    return g.select("tag", "pii_total", "pii_hit",
                    r6(F.when(F.col("pii_total") > 0, F.col("pii_hit") / F.col("pii_total")).otherwise(1.0)).alias("recall"))


# ----------------------------------------------------------------- measurements

def meas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.measurements_from_events(table(spark, sf_dir, "events"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements with their attempt numbers."""
    return M.numbered(meas(spark, sf_dir))


MEAS_SQL = """
meas0 AS (
  SELECT event_id, CAST(user_id % 5 AS BIGINT) AS run_id,
         CASE WHEN event_type = 'error' THEN (['click', 'view', 'signup', 'purchase'])[CAST(event_id % 4 AS INTEGER) + 1]
              ELSE event_type END AS model,
         'synthetic' AS model_type,
         CAST(256 * (1 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 4) AS BIGINT) AS bucket_tokens,
         event_type = 'error' AS failed, value
  FROM events
),
meas1 AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY run_id, model, bucket_tokens ORDER BY event_id) - 1 AS BIGINT) AS repeat_index,
         CASE WHEN NOT failed THEN value / CAST(1000 AS DOUBLE) + bucket_tokens / CAST(10000 AS DOUBLE) END AS latency_s,
         CASE WHEN NOT failed THEN bucket_tokens END AS input_tokens,
         CASE WHEN failed THEN 'RuntimeError' END AS error_type
  FROM meas0
),
meas AS (
  SELECT *, CASE WHEN latency_s > 0 THEN input_tokens / latency_s END AS input_tps,
         latency_s * 0.5 AS opf_tokenize_s, latency_s * 0.2 AS opf_model_forward_s, latency_s * 0.1 AS opf_decode_s,
         CASE WHEN repeat_index = 0 THEN 'concat' ELSE 'serial' END AS mode
  FROM meas1
)"""


@register("agg_1_percentile", sql=f"""
WITH {MEAS_SQL}
SELECT run_id, model, bucket_tokens, round(1e-9 + quantile_cont(latency_s, 0.5), 6) AS latency_s_p50,
       round(1e-9 + quantile_cont(latency_s, 0.95), 6) AS latency_s_p95
FROM meas WHERE error_type IS NULL GROUP BY ALL
""")
def agg_1_percentile(spark, sf_dir):
    from ..operators.ordinals import exact_percentiles
    m = meas(spark, sf_dir).where(F.col("error_type").isNull())
    p = exact_percentiles(m, ["run_id", "model", "bucket_tokens"], "latency_s",
                          {"latency_s_p50": 0.5, "latency_s_p95": 0.95})
    return p.select("run_id", "model", "bucket_tokens", r6(F.col("latency_s_p50")).alias("latency_s_p50"),
                    r6(F.col("latency_s_p95")).alias("latency_s_p95"))


@register("agg_2_mean", sql=f"""
WITH {MEAS_SQL}
SELECT run_id, model, bucket_tokens, round(1e-9 + avg(latency_s), 6) AS latency_s_mean, round(1e-9 + avg(input_tps), 6) AS input_tps_mean
FROM meas WHERE error_type IS NULL GROUP BY ALL
""")
def agg_2_mean(spark, sf_dir):
    m = meas(spark, sf_dir).where(F.col("error_type").isNull())
    return m.groupBy("run_id", "model", "bucket_tokens").agg(
        r6(F.avg("latency_s")).alias("latency_s_mean"), r6(F.avg("input_tps")).alias("input_tps_mean"))


def _variant_rows(m: DataFrame) -> DataFrame:
    """Open-schema measurement records: numbers, a bool/int flag, a string, nulls."""
    flag = F.when(F.col("repeat_index") % 2 == 0, F.lit("true")).otherwise(F.col("repeat_index").cast("string"))
    js = F.concat(F.lit('{"latency_s": '), F.coalesce(F.col("latency_s").cast("string"), F.lit("null")),
                  F.lit(', "input_tokens": '), F.coalesce(F.col("input_tokens").cast("string"), F.lit("null")),
                  F.lit(', "opf_decoded_mismatch": '), flag,
                  F.lit(', "note": "'), F.col("model"), F.lit('"}'))
    return m.select("model", js.alias("j"))


@register("agg_3_numeric_filter", sql=f"""
WITH {MEAS_SQL},
v AS (
  SELECT model, '{{"latency_s": ' || coalesce(CAST(latency_s AS VARCHAR), 'null') || ', "input_tokens": '
         || coalesce(CAST(input_tokens AS VARCHAR), 'null') || ', "opf_decoded_mismatch": '
         || CASE WHEN repeat_index % 2 = 0 THEN 'true' ELSE CAST(repeat_index AS VARCHAR) END
         || ', "note": "' || model || '"}}' AS j FROM meas
),
kv AS (SELECT model, unnest(json_keys(j)) AS key, j FROM v)
SELECT model, key, count(*) AS n_numeric, round(1e-9 + sum(CAST(json_extract(j, '$.' || key) AS DOUBLE)), 6) AS total
FROM kv WHERE json_type(j, '$.' || key) IN ('BIGINT', 'UBIGINT', 'DOUBLE') GROUP BY ALL
""")
def agg_3_numeric_filter(spark, sf_dir):
    v = _variant_rows(attempts(spark, sf_dir))
    kv = v.select("model", F.explode(F.from_json("j", "map<string,variant>")).alias("key", "v"))
    typ = F.schema_of_variant("v")
    num = kv.where(typ.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | typ.startswith("DECIMAL"))
    return num.groupBy("model", "key").agg(F.count(F.lit(1)).alias("n_numeric"),
                                           r6(F.sum(F.col("v").cast("double"))).alias("total"))


@register("agg_4_metric_rollup", sql=f"""
WITH {MEAS_SQL},
long AS (
  SELECT run_id, model, bucket_tokens, metric, value FROM (
    UNPIVOT (SELECT run_id, model, bucket_tokens, latency_s, input_tps, opf_tokenize_s, opf_model_forward_s, opf_decode_s
             FROM meas WHERE error_type IS NULL)
    ON latency_s, input_tps, opf_tokenize_s, opf_model_forward_s, opf_decode_s INTO NAME metric VALUE value)
  WHERE value IS NOT NULL
)
SELECT run_id, model, bucket_tokens, metric, round(1e-9 + avg(value), 6) AS mean, round(1e-9 + quantile_cont(value, 0.5), 6) AS p50,
       round(1e-9 + quantile_cont(value, 0.95), 6) AS p95, count(*) AS n
FROM long GROUP BY ALL
""")
def agg_4_metric_rollup(spark, sf_dir):
    m = meas(spark, sf_dir).where(F.col("error_type").isNull())
    a = M.aggregate_long(m.drop("input_tokens"), ("run_id", "model", "bucket_tokens"))
    return a.select("run_id", "model", "bucket_tokens", "metric", r6(F.col("mean")).alias("mean"),
                    r6(F.col("p50")).alias("p50"), r6(F.col("p95")).alias("p95"), "n")


RUNS_SQL = """
runs AS (
  SELECT CAST(r_regionkey AS BIGINT) AS run_id,
         CASE r_regionkey WHEN 0 THEN '30' WHEN 1 THEN '0' WHEN 2 THEN 'n/a' ELSE NULL END AS config_power,
         CASE WHEN r_regionkey >= 1 THEN length(r_name) * 2.5 END AS metadata_power
  FROM region
),
power AS (
  SELECT run_id, CASE WHEN TRY_CAST(config_power AS DOUBLE) > 0 THEN TRY_CAST(config_power AS DOUBLE)
                      WHEN metadata_power > 0 THEN metadata_power END AS power_watts
  FROM runs
)"""


@register("agg_5_per_watt", sql=f"""
WITH {MEAS_SQL}, {RUNS_SQL}
SELECT m.run_id, model, bucket_tokens, round(1e-9 + p.power_watts, 6) AS power_watts,
       round(1e-9 + CASE WHEN p.power_watts > 0 THEN avg(input_tps) / p.power_watts END, 6) AS input_tps_per_watt
FROM meas m JOIN power p USING (run_id) WHERE error_type IS NULL GROUP BY m.run_id, model, bucket_tokens, p.power_watts
""")
def agg_5_per_watt(spark, sf_dir):
    m = meas(spark, sf_dir).where(F.col("error_type").isNull())
    a = m.groupBy("run_id", "model", "bucket_tokens").agg(F.avg("input_tps").alias("input_tps_mean"))
    runs = run_metadata(table(spark, sf_dir, "region"), table(spark, sf_dir, "nation"))
    j = M.per_watt(a.join(runs.select("run_id", "power_watts"), "run_id"))
    return j.select("run_id", "model", "bucket_tokens", r6(F.col("power_watts")).alias("power_watts"),
                    r6(F.col("input_tps_per_watt")).alias("input_tps_per_watt"))


MODELS_SQL = """
models AS (SELECT * FROM (VALUES
  ('click', 'regex', NULL, true, true, 0.0, 600, false),
  ('view', 'opf', NULL, NULL, false, NULL, NULL, false),
  ('signup', 'mlx_token_classifier', 'example-org/token-classifier', false, true, 0.8, 1200, true),
  ('purchase', 'hf_causal_lm', 'example-org/causal-lm', false, true, 2.5, 1800, true)
) AS m(name, type, model_id, enabled, has_cost, cost_per_hour_usd, timeout_s, stop_on_error)),
cfg AS (SELECT 0.5 AS cost_per_hour_usd, 600 AS timeout_s)"""


@register("agg_6_cost", sql=f"""
WITH {MEAS_SQL}, {MODELS_SQL},
a AS (SELECT model, bucket_tokens, avg(input_tps) AS tps FROM meas WHERE error_type IS NULL GROUP BY ALL),
c AS (SELECT name AS model, CASE WHEN has_cost THEN m.cost_per_hour_usd ELSE cfg.cost_per_hour_usd END AS cost FROM models m, cfg)
SELECT a.model, bucket_tokens, round(1e-9 + CASE WHEN coalesce(cost, 0) <> 0 AND coalesce(tps, 0) <> 0
       THEN cost / 3600.0 / tps * 1000000 END, 6) AS usd_per_1m_input_tokens
FROM a JOIN c USING (model)
""")
def agg_6_cost(spark, sf_dir):
    m = meas(spark, sf_dir).where(F.col("error_type").isNull())
    a = m.groupBy("model", "bucket_tokens").agg(F.avg("input_tps").alias("tps"))
    cfg = models_table(spark).select(F.col("name").alias("model"), "cost_per_hour_usd")
    j = a.join(F.broadcast(cfg), "model")
    return j.select("model", "bucket_tokens",
                    r6(M.usd_per_million(F.col("cost_per_hour_usd"), F.col("tps"))).alias("usd_per_1m_input_tokens"))


@register("agg_7_error_counts", sql=f"""
WITH {MEAS_SQL}
SELECT run_id, model, model_type, bucket_tokens, count(*) AS repeats,
       count(*) FILTER (WHERE error_type IS NULL) AS successful_repeats,
       count(*) FILTER (WHERE error_type IS NOT NULL) AS errors
FROM meas GROUP BY ALL
""")
def agg_7_error_counts(spark, sf_dir):
    return M.attempt_counts(meas(spark, sf_dir))


@register("agg_8_stop_on_error", sql=f"""
WITH {MEAS_SQL}, {MODELS_SQL},
first_err AS (SELECT run_id, model, bucket_tokens, min(repeat_index) AS fe FROM meas WHERE error_type IS NOT NULL GROUP BY ALL),
kept AS (
  SELECT m.* FROM meas m JOIN models c ON c.name = m.model LEFT JOIN first_err f USING (run_id, model, bucket_tokens)
  WHERE NOT coalesce(c.stop_on_error, false) OR f.fe IS NULL OR m.repeat_index <= f.fe
)
SELECT run_id, model, bucket_tokens, count(*) AS attempts, count(*) FILTER (WHERE error_type IS NOT NULL) AS errors
FROM kept GROUP BY ALL
""")
def agg_8_stop_on_error(spark, sf_dir):
    cfg = models_table(spark).select(F.col("name").alias("model"), "stop_on_error")
    m = attempts(spark, sf_dir).join(F.broadcast(cfg), "model")
    k = M.stop_after_first_error(m)
    return k.groupBy("run_id", "model", "bucket_tokens").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("error_type").isNotNull()).alias("errors"))


@register("agg_9_batch_compare", sql=f"""
WITH {MEAS_SQL},
g AS (
  SELECT run_id, model, count(*) FILTER (WHERE mode = 'serial') AS serial_count,
         CAST(sum(CASE WHEN mode = 'serial' THEN coalesce(input_tokens, 0) END) AS BIGINT) AS serial_total_tokens,
         sum(CASE WHEN mode = 'serial' THEN coalesce(latency_s, 0.0) END) AS serial_total_latency_s,
         CAST(sum(CASE WHEN mode = 'concat' THEN coalesce(input_tokens, 0) END) AS BIGINT) AS concat_tokens,
         sum(CASE WHEN mode = 'concat' THEN coalesce(latency_s, 0.0) END) AS concat_latency_s,
         max(CASE WHEN mode = 'concat' THEN input_tps END) AS concat_input_tps
  FROM meas GROUP BY ALL
)
SELECT run_id, model, serial_count, serial_total_tokens, round(1e-9 + serial_total_latency_s, 6) AS serial_total_latency_s,
       concat_tokens, round(1e-9 + concat_latency_s, 6) AS concat_latency_s, round(1e-9 + concat_input_tps, 6) AS concat_input_tps,
       round(1e-9 + CASE WHEN serial_total_latency_s > 0 THEN serial_total_tokens / serial_total_latency_s END, 6) AS serial_effective_tps,
       round(1e-9 + CASE WHEN concat_latency_s > 0 THEN serial_total_latency_s / concat_latency_s END, 6) AS speedup_vs_serial
FROM g WHERE serial_count > 1
""")
def agg_9_batch_compare(spark, sf_dir):
    b = M.batch_compare(attempts(spark, sf_dir))
    return b.select("run_id", "model", "serial_count", "serial_total_tokens",
                    r6(F.col("serial_total_latency_s")).alias("serial_total_latency_s"), "concat_tokens",
                    r6(F.col("concat_latency_s")).alias("concat_latency_s"),
                    r6(F.col("concat_input_tps")).alias("concat_input_tps"),
                    r6(F.col("serial_effective_tps")).alias("serial_effective_tps"),
                    r6(F.col("speedup_vs_serial")).alias("speedup_vs_serial"))


@register("agg_11_stage_breakdown", sql=f"""
WITH {MEAS_SQL}
SELECT run_id, model, model_type, bucket_tokens, round(1e-9 + avg(latency_s), 6) AS latency_s,
       round(1e-9 + avg(opf_tokenize_s), 6) AS opf_tokenize_s, round(1e-9 + avg(opf_model_forward_s), 6) AS opf_model_forward_s,
       round(1e-9 + avg(opf_decode_s), 6) AS opf_decode_s,
       round(1e-9 + greatest(avg(latency_s) - (coalesce(avg(opf_tokenize_s), 0) + coalesce(avg(opf_model_forward_s), 0)
             + coalesce(avg(opf_decode_s), 0)), 0), 6) AS other_s
FROM meas GROUP BY ALL HAVING count(coalesce(opf_tokenize_s, opf_model_forward_s, opf_decode_s)) > 0
""")
def agg_11_stage_breakdown(spark, sf_dir):
    s = M.stage_breakdown(meas(spark, sf_dir))
    return s.select("run_id", "model", "model_type", "bucket_tokens",
                    *[r6(F.col(c)).alias(c) for c in ("latency_s", "opf_tokenize_s", "opf_model_forward_s",
                                                       "opf_decode_s", "other_s")])


SPEED_SQL = """
speed AS (
  SELECT run_id, model, model_type, bucket_tokens, count(*) FILTER (WHERE error_type IS NULL) AS successful_repeats,
         quantile_cont(latency_s, 0.5) AS latency_s_p50
  FROM meas GROUP BY ALL
)"""


@register("agg_12_scaling_fit", sql=f"""
WITH {MEAS_SQL}, {SPEED_SQL},
pts AS (SELECT DISTINCT run_id, model, model_type, CAST(bucket_tokens AS DOUBLE) AS x, latency_s_p50 AS y
        FROM speed WHERE latency_s_p50 IS NOT NULL AND successful_repeats > 0),
g AS (SELECT run_id, model, model_type, count(*) AS points, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
             regr_r2(y, x) AS r2, var_pop(y) AS vy FROM pts GROUP BY ALL)
SELECT run_id, model, model_type, points, round(1e-9 + greatest(intercept, 0), 6) AS fixed_overhead_s,
       round(1e-9 + intercept, 6) AS raw_intercept_s, round(1e-9 + slope * 1000.0, 6) AS per_token_ms,
       round(1e-9 + 1.0 / slope, 6) AS asymptotic_tps, round(1e-9 + CASE WHEN vy > 0 THEN r2 END, 6) AS r2
FROM g WHERE points >= 2 AND slope > 0
""")
def agg_12_scaling_fit(spark, sf_dir):
    sp = M.speed_rows(meas(spark, sf_dir).select("run_id", "model", "model_type", "bucket_tokens", "error_type",
                                                  "latency_s"))
    f = M.scaling_fit(sp)
    return f.select("run_id", "model", "model_type", "points",
                    *[r6(F.col(c)).alias(c) for c in ("fixed_overhead_s", "raw_intercept_s", "per_token_ms",
                                                       "asymptotic_tps", "r2")])


@register("agg_13_fit_inputs", sql=f"""
WITH {MEAS_SQL}, {SPEED_SQL}
SELECT run_id, model, bucket_tokens, round(1e-9 + latency_s_p50, 6) AS latency_s_p50 FROM speed
WHERE latency_s_p50 IS NOT NULL AND successful_repeats > 0
""")
def agg_13_fit_inputs(spark, sf_dir):
    sp = M.speed_rows(meas(spark, sf_dir).select("run_id", "model", "model_type", "bucket_tokens", "error_type",
                                                  "latency_s"))
    ok = sp.where(F.col("latency_s_p50").isNotNull() & (F.col("successful_repeats") > 0))
    return ok.select("run_id", "model", "bucket_tokens", r6(F.col("latency_s_p50")).alias("latency_s_p50"))

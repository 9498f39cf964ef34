"""Registered queries: projections and config (PRJ), ordering (ORD), set
operations (SET) and the implicit joins (JN-2..5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import token_count
from ..operators import config as C
from ..operators import decode as X
from ..operators.detect import all_rule_spans
from ..operators.ordinals import ordinal_within_group
from ..operators.tokens import overlaps, token_spans
from ..sources.tables import spread, table
from . import oracle_sql as O
from .q_eval import MEAS_SQL, MODELS_SQL, RUNS_SQL, meas
from .registry import register


def r6(c):
    return F.round(c + F.lit(1e-9), 6)


def _runs(spark, sf_dir):
    return C.run_metadata(table(spark, sf_dir, "region"), table(spark, sf_dir, "nation"))


@register("prj_1_nested_defaults")
def prj_1_nested_defaults(spark, sf_dir):
    r = _runs(spark, sf_dir)
    return r.select("run_id", F.coalesce(F.col("hardware.accelerators.jetson.model"), F.lit("")).alias("jetson_model"),
                    F.coalesce(F.col("hardware.platform.machine"), F.lit("CPU")).alias("machine"),
                    F.size(F.coalesce("hardware.accelerators.nvidia_smi", F.array())).alias("gpus"))


@register("prj_2_derived_throughput", sql=f"""
WITH {MEAS_SQL}
SELECT event_id, round(CASE WHEN latency_s > 0 THEN coalesce(nullif(input_tokens, 0), bucket_tokens) / latency_s END + 1e-9, 6) AS input_tps
FROM meas
""")
def prj_2_derived_throughput(spark, sf_dir):
    m = meas(spark, sf_dir)
    tokens = F.coalesce(F.nullif(F.col("input_tokens"), F.lit(0)), F.col("bucket_tokens"))
    return m.select("event_id", r6(F.when(F.col("latency_s") > 0, tokens / F.col("latency_s"))).alias("input_tps"))


@register("prj_2b_counted_tokens", sql=f"""
WITH c AS (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 7 END AS reported, (conv_id % 4) / 8.0 AS latency_s FROM conversations),
t AS (SELECT *, coalesce(nullif(reported, 0), {O.token_count('text')}) AS n FROM c)
SELECT conv_id, turn, CAST(n AS BIGINT) AS input_tokens, round(CASE WHEN latency_s > 0 THEN n / latency_s END + 1e-9, 6) AS input_tps FROM t
""")
def prj_2b_counted_tokens(spark, sf_dir):
    """Calls that report no tokens, or none, have the tokens of their text counted; no time, no rate."""
    c = spread(table(spark, sf_dir, "conversations"), key=["conv_id", "turn"])
    third = F.col("turn") % 3
    n = F.coalesce(F.nullif(F.when(third == 2, 7).when(third == 1, 0), F.lit(0)), token_count("text")).cast("long")
    latency = (F.col("conv_id") % 4) / 8.0
    return c.select("conv_id", "turn", n.alias("input_tokens"), r6(F.when(latency > 0, n / latency)).alias("input_tps"))


@register("prj_3_prefill_decode_rates", sql=f"""
WITH {MEAS_SQL}, t AS (SELECT event_id, input_tokens AS n_in, 64 AS n_new, latency_s AS total, latency_s * 0.3 AS ttft
                      FROM meas WHERE error_type IS NULL)
SELECT event_id, round(n_in / ttft + 1e-9, 6) AS prefill_tps,
       round(greatest(n_new - 1, 0) / greatest(total - ttft, 1e-9) + 1e-9, 6) AS decode_tps,
       round((n_in + n_new) / total + 1e-9, 6) AS short_e2e_tps
FROM t
""")
def prj_3_prefill_decode_rates(spark, sf_dir):
    m = meas(spark, sf_dir).where(F.col("error_type").isNull())
    ttft = F.col("latency_s") * 0.3
    return m.select("event_id", r6(F.col("input_tokens") / ttft).alias("prefill_tps"),
                    r6(F.greatest(F.lit(64) - 1, F.lit(0)) / F.greatest(F.col("latency_s") - ttft, F.lit(1e-9))).alias("decode_tps"),
                    r6((F.col("input_tokens") + 64) / F.col("latency_s")).alias("short_e2e_tps"))


def _selectors(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("selector")).distinct()


@register("prj_4_select_models", sql=f"""
WITH {MODELS_SQL}, sel AS (SELECT DISTINCT event_type AS selector FROM events)
SELECT name FROM models m WHERE name IN (SELECT selector FROM sel) OR type IN (SELECT selector FROM sel)
   OR model_id IN (SELECT selector FROM sel)
""")
def prj_4_select_models(spark, sf_dir):
    return C.selected_models(C.models_table(spark), _selectors(spark, sf_dir)).select("name")


@register("prj_5_unknown_selectors", sql=f"""
WITH {MODELS_SQL}, sel AS (SELECT DISTINCT event_type AS selector FROM events),
keys AS (SELECT name AS k FROM models UNION SELECT type FROM models UNION SELECT model_id FROM models WHERE model_id IS NOT NULL)
SELECT selector FROM sel WHERE selector NOT IN (SELECT k FROM keys)
""")
def prj_5_unknown_selectors(spark, sf_dir):
    return C.unknown_selectors(C.models_table(spark), _selectors(spark, sf_dir))


@register("prj_6_parse_csv_lists", sql="""
WITH s AS (SELECT event_id, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ', ,' || CAST(user_id AS VARCHAR) || ' ,' AS v FROM events),
p AS (SELECT event_id, list_filter(list_transform(string_split(v, ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM s)
SELECT event_id, CAST(len(parts) AS INTEGER) AS n, CAST(list_sum(list_transform(parts, lambda x: CAST(x AS BIGINT))) AS BIGINT) AS total FROM p
""")
def prj_6_parse_csv_lists(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    v = F.concat(F.floor("value").cast("long").cast("string"), F.lit(", ,"), F.col("user_id").cast("string"), F.lit(" ,"))
    ints = C.parse_csv_ints(v)
    return e.select("event_id", F.size(ints).alias("n"),
                    F.aggregate(ints, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@register("prj_7_setting_precedence", sql=f"""
WITH {MEAS_SQL}, {MODELS_SQL}
SELECT model, CASE WHEN has_cost THEN m.cost_per_hour_usd ELSE cfg.cost_per_hour_usd END AS cost_per_hour_usd,
       CAST(coalesce(m.timeout_s, cfg.timeout_s) AS INTEGER) AS timeout_s,
       count(*) FILTER (WHERE latency_s * 10000 > coalesce(m.timeout_s, cfg.timeout_s)) AS over_budget
FROM meas JOIN models m ON m.name = meas.model, cfg GROUP BY ALL
""")
def prj_7_setting_precedence(spark, sf_dir):
    cfg = C.models_table(spark).select(F.col("name").alias("model"), "cost_per_hour_usd", "timeout_s")
    m = meas(spark, sf_dir).join(F.broadcast(cfg), "model")
    return m.groupBy("model", "cost_per_hour_usd", "timeout_s").agg(
        F.count_if(F.col("latency_s") * 10000 > F.col("timeout_s")).alias("over_budget"))


@register("prj_7b_layered_settings", sql="""
WITH e AS (SELECT event_id, event_id % 4 AS m, event_id % 3 AS g FROM events),
s AS (SELECT event_id, m, g,
        CASE WHEN m = 0 THEN 0 WHEN m = 1 THEN NULL WHEN m = 2 THEN event_id % 100 WHEN g = 0 THEN 16 ELSE 64 END AS decode_new_tokens,
        CASE WHEN g = 0 THEN 16 ELSE 32 END AS warmup_new_tokens,
        greatest(CASE WHEN m = 0 THEN -2 WHEN m = 2 THEN 3 WHEN g = 1 THEN 0 ELSE 1 END, 0) AS warmup_repeats,
        CASE WHEN m = 3 THEN 0 WHEN g = 2 THEN 128 ELSE 256 END AS batch_compare_chunk_tokens,
        CASE WHEN m = 2 THEN 1 ELSE 100 END AS batch_compare_count,
        CASE WHEN m = 0 THEN NULL WHEN m = 2 THEN 1.5 WHEN g <> 1 THEN 600.0 END AS timeout_s FROM e)
SELECT event_id, warmup_repeats, warmup_new_tokens, decode_new_tokens, batch_compare_chunk_tokens, batch_compare_count,
       batch_compare_chunk_tokens > 0 AND batch_compare_count > 1 AS batch_compared, timeout_s FROM s
""")
def prj_7b_layered_settings(spark, sf_dir):
    """Settings of every event's model and run (maps with present, absent, zero and NULL entries) resolved."""
    e = table(spark, sf_dir, "events")
    m, g = F.col("event_id") % 4, F.col("event_id") % 3

    def entries(*known):
        kept = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"), present.alias("p")) for k, v, present in known]), lambda x: x["p"])
        return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["k"], x["v"])))
    model = entries(("decode_new_tokens", F.when(m == 0, 0).when(m == 2, F.col("event_id") % 100), m < 3),
                    ("warmup_repeats", F.when(m == 0, -2).otherwise(3), m.isin(0, 2)), ("batch_compare_chunk_tokens", F.lit(0), m == 3),
                    ("batch_compare_count", F.lit(1), m == 2), ("timeout_s", F.when(m == 0, 0.0).otherwise(1.5), m.isin(0, 2)))
    config = entries(("decode_new_tokens", F.lit(16), g == 0), ("warmup_repeats", F.lit(0), g == 1), ("batch_compare_chunk_tokens", F.lit(128), g == 2),
                     ("timeout_s", F.lit(600), g != 1))
    rows = e.select("event_id", model.alias("model"), config.alias("config"))
    return rows.select("event_id", *[c.alias(n) for n, c in C.run_settings(F.col("model"), F.col("config")).items()])


@register("prj_8_power_budget", sql=f"""
WITH {RUNS_SQL}
SELECT run_id, power_watts FROM power
""")
def prj_8_power_budget(spark, sf_dir):
    return _runs(spark, sf_dir).select("run_id", "power_watts")


@register("prj_9_hardware_label", sql="""
WITH n AS (SELECT n_regionkey, string_agg(n_name, ' + ' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey)
SELECT CAST(r_regionkey AS BIGINT) AS run_id,
       CASE r_regionkey WHEN 0 THEN 'Jetson ' || upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2))
                        WHEN 4 THEN 'Apple Silicon MPS' ELSE coalesce(names, upper(substr(r_name, 1, 3))) END AS hardware_label,
       substr(sha1(r_name), 1, 8) || CASE WHEN r_regionkey % 2 = 1 THEN ' dirty' ELSE '' END AS git
FROM region LEFT JOIN n ON n.n_regionkey = r_regionkey
""")
def prj_9_hardware_label(spark, sf_dir):
    r = _runs(spark, sf_dir)
    return r.select("run_id", C.hardware_label("hardware").alias("hardware_label"),
                    C.short_commit(F.col("hardware.git")).alias("git"))


@register("prj_10_gpu_inventory_lines", sql="""
WITH l AS (SELECT CAST(n_nationkey AS VARCHAR) || ', ' || n_name || ', ' || CAST(n_nationkey * 1024 + 0.5 AS VARCHAR) || ' , 535.1' AS line FROM nation
           UNION ALL SELECT CAST(r_regionkey AS VARCHAR) || ', ' || r_name AS line FROM region),
p AS (SELECT list_transform(string_split(line, ','), lambda x: trim(x)) AS parts FROM l)
SELECT CAST(parts[1] AS INTEGER) AS idx, parts[2] AS name, CAST(CAST(parts[3] AS DOUBLE) AS BIGINT) AS memory_total_mb,
       parts[4] AS driver_version FROM p WHERE len(parts) >= 4
""")
def prj_10_gpu_inventory_lines(spark, sf_dir):
    nat = table(spark, sf_dir, "nation").select(F.concat(
        F.col("n_nationkey").cast("string"), F.lit(", "), F.col("n_name"), F.lit(", "),
        (F.col("n_nationkey") * 1024 + 0.5).cast("string"), F.lit(" , 535.1")).alias("line"))
    reg = table(spark, sf_dir, "region").select(F.concat(F.col("r_regionkey").cast("string"), F.lit(", "), F.col("r_name")).alias("line"))
    parts = F.transform(F.split("line", ","), lambda x: F.trim(x))
    p = nat.unionByName(reg).select(parts.alias("p")).where(F.size("p") >= 4)
    return p.select(F.col("p")[0].cast("int").alias("idx"), F.col("p")[1].alias("name"),
                    F.col("p")[2].cast("double").cast("long").alias("memory_total_mb"), F.col("p")[3].alias("driver_version"))


@register("prj_11_power_telemetry", sql=r"""
WITH l AS (SELECT event_id, 'RAM 1/8 ' || CASE WHEN event_type = 'view' THEN 'POM_5V_IN ' ELSE 'VDD_IN ' END
                  || CAST(value * 100 AS VARCHAR) || 'mW/' || CAST(value * 100 AS VARCHAR) || 'mW' AS line FROM events)
SELECT event_id, round(CAST(nullif(regexp_extract(line, '(?:^|[^A-Za-z0-9_])(?:VDD_IN|POM_5V_IN)\s+([0-9]+(?:\.[0-9]+)?)mW', 1), '') AS DOUBLE) / 1000 + 1e-9, 6) AS watts
FROM l
""".replace("\\\\", "\\"))
def prj_11_power_telemetry(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.concat(F.lit("RAM 1/8 "), F.when(F.col("event_type") == "view", F.lit("POM_5V_IN ")).otherwise(F.lit("VDD_IN ")),
                    (F.col("value") * 100).cast("string"), F.lit("mW/"), (F.col("value") * 100).cast("string"), F.lit("mW"))
    # FIXED VALUE: the telemetry line's pattern
    w = F.regexp_extract(line, r"\b(?:VDD_IN|POM_5V_IN)\s+(\d+(?:\.\d+)?)mW", 1)
    return e.select("event_id", r6(F.when(w != "", w.cast("double") / 1000)).alias("watts"))


@register("prj_12_display_format", sql=f"""
WITH {MEAS_SQL}, v AS (SELECT event_id, floor(latency_s * 100) / 100 + 0.003 AS x, bucket_tokens, model, error_type FROM meas)
SELECT event_id, coalesce(printf('%.2f', x), '-') AS latency, coalesce(printf('%.1f', x * 1000 + 0.02), '-') AS latency_ms,
       printf('%.1f%%', bucket_tokens / 4096.0 * 100 + 0.02) AS bucket_pct,
       CASE WHEN error_type IS NULL THEN '-' ELSE replace(model || '|x', '|', '/') || '<br>' || error_type END AS findings
FROM v
""")
def prj_12_display_format(spark, sf_dir):
    """Formatted report strings (2 decimals, percent, ms, '-' for NULL, '<br>' lists), on values moved
    off half-way points, where Java and C round alike."""
    m = meas(spark, sf_dir).withColumn("x", F.floor(F.col("latency_s") * 100) / 100 + 0.003)
    items = F.when(F.col("error_type").isNotNull(), F.array(F.concat(F.col("model"), F.lit("|x")), F.col("error_type")))
    return m.select("event_id", C.display(F.col("x")).alias("latency"), C.display(F.col("x") * 1000 + 0.02, "%.1f").alias("latency_ms"),
                    C.display(F.col("bucket_tokens") / 4096.0 * 100 + 0.02, "%.1f%%").alias("bucket_pct"), C.display_list(items).alias("findings"))


@register("prj_13_short_commit", sql="""
SELECT CAST(r_regionkey AS BIGINT) AS run_id, substr(sha1(r_name), 1, 8) || CASE WHEN r_regionkey % 2 = 1 THEN ' dirty' ELSE '' END AS git
FROM region
""")
def prj_13_short_commit(spark, sf_dir):
    return _runs(spark, sf_dir).select("run_id", C.short_commit(F.col("hardware.git")).alias("git"))


@register("ord_1_sorted_turns", sql="""
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS INTEGER) AS pos, turn FROM conversations
""")
def ord_1_sorted_turns(spark, sf_dir):
    """Descending order inside each conversation; a hot conversation's turns are numbered by many tasks."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (-F.col("turn")).alias("_down"))
    o = ordinal_within_group(c, ["conv_id"], ["_down"], "pos")
    return o.select("conv_id", F.col("pos").cast("int").alias("pos"), "turn")


@register("ord_2_first_n_per_lang", sql="""
SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 3
""")
def ord_2_first_n_per_lang(spark, sf_dir):
    """First N samples in file (id) order per language; the top-k is the feature."""
    return C.first_n(table(spark, sf_dir, "documents").select("lang", "doc_id"), ["lang"], ["doc_id"], 3)


@register("set_1_difference", sql="""
SELECT DISTINCT event_type AS selector FROM events WHERE event_type NOT IN ('click', 'view', 'signup', 'purchase')
""")
def set_1_difference(spark, sf_dir):
    keys = C.models_table(spark).select(F.col("name").alias("selector"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("selector")).distinct() \
        .join(F.broadcast(keys), "selector", "left_anti")


@register("set_2_key_union", sql=f"""
WITH {MEAS_SQL},
present AS (
  SELECT DISTINCT metric AS k FROM (
    UNPIVOT (SELECT latency_s, input_tps, opf_tokenize_s, opf_model_forward_s, opf_decode_s FROM meas)
    ON latency_s, input_tps, opf_tokenize_s, opf_model_forward_s, opf_decode_s INTO NAME metric VALUE value)
  WHERE value IS NOT NULL AND (starts_with(metric, 'opf_') OR starts_with(metric, 'mlx_'))
)
SELECT k FROM present
UNION SELECT unnest(['latency_s', 'input_tps', 'ttft_s', 'prefill_tps', 'decode_tps', 'short_e2e_tps', 'peak_gpu_mem_mb'])
""")
def set_2_key_union(spark, sf_dir):
    """Metric key set: the fixed core keys united with the profiled keys that
    actually carry a value in the measurement table."""
    from ..operators.metrics import CORE_KEYS, metric_keys
    m = meas(spark, sf_dir)
    prof = [k for k in metric_keys(m.columns) if k.startswith(("opf_", "mlx_"))]
    present = (m.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("double").alias("v"))
                                              for k in prof])).alias("x"))
                .where(F.col("x.v").isNotNull()).select(F.col("x.k").alias("k")).distinct())
    core = m.sparkSession.createDataFrame([(k,) for k in CORE_KEYS], "k string")
    return present.union(core).distinct()


@register("set_3_distinct_points", sql=f"""
WITH {MEAS_SQL}
SELECT DISTINCT model, bucket_tokens FROM meas WHERE error_type IS NULL
""")
def set_3_distinct_points(spark, sf_dir):
    return meas(spark, sf_dir).where(F.col("error_type").isNull()).select("model", "bucket_tokens").dropDuplicates()


@register("set_4_membership", sql="""
SELECT lang, count(*) FILTER (WHERE lang IN ('de', 'fr')) AS in_set, count(*) AS docs FROM documents GROUP BY lang
""")
def set_4_membership(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.count_if(F.col("lang").isin("de", "fr")).alias("in_set"), F.count(F.lit(1)).alias("docs"))


@register("jn_2_sample_model_repeat", sql="""
SELECT m.model, r.repeat_index, count(*) AS runs, CAST(sum(length(text)) AS BIGINT) AS chars
FROM documents, (VALUES ('click'), ('view'), ('signup'), ('purchase')) m(model), (VALUES (0), (1), (2)) r(repeat_index)
GROUP BY ALL
""")
def jn_2_sample_model_repeat(spark, sf_dir):
    """Sample x model x repeat without a join: each row is expanded by a
    fixed (model, repeat) array, the explicit plan's small side."""
    d = spread(table(spark, sf_dir, "documents"), key="doc_id").select("text")
    grid = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(r).alias("repeat_index"))
                     for m in ("click", "view", "signup", "purchase") for r in range(3)])
    x = d.select(F.length("text").alias("n"), F.explode(grid).alias("g"))
    return x.groupBy("g.model", "g.repeat_index").agg(F.count(F.lit(1)).alias("runs"), F.sum("n").cast("long").alias("chars"))


@register("jn_3_result_run_join", sql=f"""
WITH {MEAS_SQL}, {RUNS_SQL}
SELECT m.run_id, model, count(*) AS attempts, round(max(p.power_watts) + 1e-9, 6) AS power_watts FROM meas m LEFT JOIN power p USING (run_id) GROUP BY ALL
""")
def jn_3_result_run_join(spark, sf_dir):
    runs = _runs(spark, sf_dir).select("run_id", "power_watts")
    m = meas(spark, sf_dir).join(runs, "run_id", "left")
    return m.groupBy("run_id", "model").agg(F.count(F.lit(1)).alias("attempts"), r6(F.max("power_watts")).alias("power_watts"))


@register("jn_4_selector_semi_anti", sql=f"""
WITH {MODELS_SQL}, sel AS (SELECT DISTINCT event_type AS s FROM events)
SELECT s AS selector, CASE WHEN s IN (SELECT name FROM models) THEN 'semi' ELSE 'anti' END AS side FROM sel
""")
def jn_4_selector_semi_anti(spark, sf_dir):
    sel = _selectors(spark, sf_dir)
    names = F.broadcast(C.models_table(spark).select(F.col("name").alias("selector")))
    return sel.join(names, "selector", "left_semi").withColumn("side", F.lit("semi")).unionByName(
        sel.join(names, "selector", "left_anti").withColumn("side", F.lit("anti")))


@register("jn_5_span_token_overlap")
def jn_5_span_token_overlap(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents"), key="doc_id").select("doc_id", "text")
    rows = d.select("doc_id", token_spans("text").alias("toks"), all_rule_spans("text").alias("spans"))
    pairs = rows.select("doc_id", "spans", F.explode(overlaps(F.col("toks"), F.col("spans"))).alias("x"))
    span = F.get(F.col("spans"), F.col("x.span_idx"))
    named = pairs.select("doc_id", F.concat_ws(":", span["rule"].cast("string"), span["start"].cast("string")).alias("span_id"))
    return named.groupBy("doc_id", "span_id").agg(F.count(F.lit(1)).alias("tokens"))

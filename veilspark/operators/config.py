"""Configuration tables: model selection, setting precedence, power budget,
hardware label, and list parsing -- all as DataFrame operations.

The model list is a small table (one row per configured model). Runs and
their hardware records are derived from the ``region`` / ``nation`` tables in
the registered queries so that they read real data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# FIXED VALUES: the model configuration used by the registered queries
# (name, type, model_id, enabled, cost_per_hour_usd present?, cost, timeout_s, stop_on_error).
MODEL_CONFIG = (
    ("click", "regex", None, True, True, 0.0, 600, False),
    ("view", "opf", None, None, False, None, None, False),
    ("signup", "mlx_token_classifier", "example-org/token-classifier", False, True, 0.8, 1200, True),
    ("purchase", "hf_causal_lm", "example-org/causal-lm", False, True, 2.5, 1800, True),
)
GLOBAL_CONFIG = {"cost_per_hour_usd": 0.5, "timeout_s": 600}
MODEL_SCHEMA = ("name string, type string, model_id string, enabled boolean, has_cost boolean, "
                "cost double, timeout_s int, stop_on_error boolean")


def models_table(spark: SparkSession) -> DataFrame:
    """Model rows with model-over-global precedence already applied.

    A setting present on the model wins even when falsy (cost 0 stays 0);
    only an absent one falls back to the global value.
    """
    m = spark.createDataFrame(list(MODEL_CONFIG), MODEL_SCHEMA)
    return m.select(
        "name", "type", "model_id", "enabled", "stop_on_error",
        F.when(F.col("has_cost"), F.col("cost")).otherwise(F.lit(GLOBAL_CONFIG["cost_per_hour_usd"]))
        .alias("cost_per_hour_usd"),
        F.coalesce(F.col("timeout_s"), F.lit(GLOBAL_CONFIG["timeout_s"])).alias("timeout_s"),
    )


def setting(model: Column, config: Column, name: str, default: str | None = None) -> Column:
    """A setting of a model, as text, from two maps of settings.

    What the model names wins, even if it is 0, empty or NULL; else what the
    whole run's configuration names; else the default.
    """
    return (F.when(F.map_contains_key(model, name), F.try_element_at(model, F.lit(name)))
            .when(F.map_contains_key(config, name), F.try_element_at(config, F.lit(name))).otherwise(F.lit(default)))


def run_settings(model: Column, config: Column) -> dict[str, Column]:
    """The settings that an attempt runs under, by name.

    Warm-up calls take their new tokens from the run's configuration alone, a
    negative number of warm-ups is none, and a timeout of 0 is no timeout.
    """
    whole = lambda c: c.cast("long")
    none = F.create_map().cast("map<string,string>")
    chunk, count = (whole(setting(model, config, n, d)) for n, d in (("batch_compare_chunk_tokens", "256"), ("batch_compare_count", "100")))
    timeout = setting(model, config, "timeout_s").try_cast("double")
    return {"warmup_repeats": F.greatest(whole(setting(model, config, "warmup_repeats", "1")), F.lit(0)),
            "warmup_new_tokens": whole(setting(none, config, "decode_new_tokens", "32")),
            "decode_new_tokens": whole(setting(model, config, "decode_new_tokens", "64")),
            "batch_compare_chunk_tokens": chunk, "batch_compare_count": count, "batch_compared": (chunk > 0) & (count > 1),
            "timeout_s": F.when(timeout != 0, timeout)}


def selected_models(models: DataFrame, selectors: DataFrame | None) -> DataFrame:
    """Model selection: with no selectors keep enabled models (missing = enabled);
    otherwise keep models whose name, type or model_id is a selector."""
    if selectors is None:
        return models.where(F.coalesce(F.col("enabled"), F.lit(True)))
    keys = models.select("name", F.explode(F.array("name", "type", "model_id")).alias("sel")).where(F.col("sel").isNotNull())
    hit = keys.join(selectors.select(F.col("selector").alias("sel")), "sel", "left_semi").select("name").distinct()
    return models.join(hit, "name", "left_semi")


def unknown_selectors(models: DataFrame, selectors: DataFrame) -> DataFrame:
    """Selectors that match no model's name, type or model_id (the error list)."""
    keys = models.select(F.explode(F.array("name", "type", "model_id")).alias("selector")).where(F.col("selector").isNotNull())
    return selectors.join(keys, "selector", "left_anti")


def require_known(models: DataFrame, selectors: DataFrame) -> None:
    """Raise if a selector matches no model; the message names up to ten of them."""
    missing = [r.selector for r in unknown_selectors(models, selectors).orderBy("selector").limit(10).collect()]
    if missing:
        raise ValueError(f"no configured model matches: {', '.join(missing)}")


def parse_csv_ints(value) -> Column:
    """``'256, 1024,,4096'`` -> ``[256, 1024, 4096]``; NULL/empty -> NULL; a text without any number raises."""
    v = F.col(value) if isinstance(value, str) else value
    parts = F.filter(F.transform(F.split(v, ","), lambda x: F.trim(x)), lambda x: x != "")
    ints = F.when(F.size(parts) == 0, F.raise_error(F.lit("an integer list without integers")).cast("array<int>")) \
        .otherwise(F.transform(parts, lambda x: x.cast("int")))
    return F.when(F.coalesce(F.length(v), F.lit(0)) > 0, ints)


def parse_csv_strings(value) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    parts = F.filter(F.transform(F.split(v, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts)


def positive_number(value) -> Column:
    """Parsed value if it is a positive number, else NULL (unparsable ignored)."""
    v = F.col(value) if isinstance(value, str) else value
    d = v.cast("string").try_cast("double")
    return F.when(d > 0, d)


def power_budget(config_value, metadata_value) -> Column:
    """Config power if positive, else metadata power if positive, else NULL."""
    return F.coalesce(positive_number(config_value), positive_number(metadata_value))


def run_metadata(region: DataFrame, nation: DataFrame) -> DataFrame:
    """Run records derived from ``region`` (one run per region) with a nested
    hardware struct built from its nations, and the resolved power budget."""
    nat = (nation.groupBy("n_regionkey")
                 .agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns")))
    r = region.join(nat, region.r_regionkey == nat.n_regionkey, "left")
    names = F.transform("ns", lambda x: F.struct(x["n_name"].alias("name")))
    k = F.col("r_regionkey")
    hw = F.struct(
        F.struct(F.struct((k == 0).alias("detected"), F.concat(F.lit("Jetson "), F.initcap("r_name")).alias("model"))
                 .alias("jetson"),
                 F.when(k == 1, names).alias("nvidia_smi"),
                 F.struct(F.when(k == 2, names).alias("cuda_devices"), (k == 4).alias("mps_available")).alias("torch"),
                 F.when(k == 3, names).alias("mac_displays")).alias("accelerators"),
        F.struct(F.upper(F.substring("r_name", 1, 3)).alias("machine")).alias("platform"),
        F.struct(F.sha1(F.col("r_name")).alias("commit"), (k % 2 == 1).alias("dirty")).alias("git"),
    )
    cfg_power = F.when(k == 0, "30").when(k == 1, "0").when(k == 2, "n/a")
    meta_power = F.when(k >= 1, F.length("r_name") * F.lit(2.5))
    hw = F.struct(hw["accelerators"].alias("accelerators"), hw["platform"].alias("platform"), hw["git"].alias("git"),
                  F.struct(power_budget(cfg_power, meta_power).alias("budget_watts")).alias("power"))
    return r.select(
        k.cast("long").alias("run_id"),
        F.concat(F.lit("2024-01-0"), (k + 1).cast("string"), F.lit("T00:00:00+00:00")).alias("created_at"),
        hw.alias("hardware"), cfg_power.alias("config_power"), meta_power.alias("metadata_power"),
        power_budget(cfg_power, meta_power).alias("power_watts"))


def hardware_label(hw) -> Column:
    """Label by priority: Jetson model, NVIDIA names, CUDA names, Mac names, MPS, machine, 'CPU'."""
    h = F.col(hw) if isinstance(hw, str) else hw
    acc = h["accelerators"]

    def joined(arr, default):
        return F.when(F.size(F.coalesce(arr, F.array())) > 0,
                      F.array_join(F.transform(arr, lambda g: F.coalesce(g["name"], F.lit(default))), " + "))

    mac = F.filter(F.coalesce(acc["mac_displays"], F.array()), lambda g: F.coalesce(g["name"], F.lit("")) != "")
    return F.coalesce(
        F.when(F.coalesce(acc["jetson"]["detected"], F.lit(False)) & (F.coalesce(acc["jetson"]["model"], F.lit("")) != ""),
               acc["jetson"]["model"]),
        joined(acc["nvidia_smi"], "NVIDIA GPU"),
        joined(acc["torch"]["cuda_devices"], "CUDA GPU"),
        F.when(F.size(mac) > 0, F.array_join(F.transform(mac, lambda g: g["name"]), " + ")),
        F.when(F.coalesce(acc["torch"]["mps_available"], F.lit(False)), F.lit("Apple Silicon MPS")),
        F.nullif(h["platform"]["machine"], F.lit("")),
        F.lit("CPU"),
    )


def short_commit(git) -> Column:
    g = F.col(git) if isinstance(git, str) else git
    return F.concat(F.substring(F.coalesce(g["commit"], F.lit("")), 1, 8),
                    F.when(F.coalesce(g["dirty"], F.lit(False)), F.lit(" dirty")).otherwise(F.lit("")))


def display(value: Column, pattern: str = "%.2f") -> Column:
    """A number by a format; ``-`` for NULL."""
    return F.when(value.isNull(), F.lit("-")).otherwise(F.format_string(pattern, value))


def display_list(items: Column) -> Column:
    """Items joined by ``<br>``, with ``/`` for ``|``; ``-`` for NULL or none."""
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.replace(x, F.lit("|"), F.lit("/"))), "<br>")).otherwise(F.lit("-"))


def first_n(df: DataFrame, keys: list[str], order: list[str], n: int | None) -> DataFrame:
    """The first ``n`` rows of each group; 0 or None keeps all. Spark limits each
    partition's groups before the shuffle, so a hot group sends few rows."""
    if not n:
        return df
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")

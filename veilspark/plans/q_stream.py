"""Registered queries: streaming extensions (STR-1, STR-2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming.stream import redact_stream, windowed_rollup_stream
from . import oracle_sql as O
from .registry import register


@register("str_1_redact_stream", sql=f"""
WITH {O.redact_steps('documents', 'text', ['doc_id', 'lang'])}
SELECT doc_id, lang, md5(t) AS redacted_md5, CAST(matches AS BIGINT) AS matches FROM s10
""")
def str_1_redact_stream(spark, sf_dir):
    out = redact_stream(spark, sf_dir)
    return out.select("doc_id", "lang", F.md5("redacted").alias("redacted_md5"), F.col("matches").cast("long"))


@register("str_2_windowed_rollup", sql="""
SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_start, event_type, count(*) AS n,
       round(avg(value) + 1e-9, 6) AS mean_value, round(quantile_disc(value, 0.5) + 1e-9, 6) AS approx_p50_value
FROM events GROUP BY ALL
""")
def str_2_windowed_rollup(spark, sf_dir):
    out = windowed_rollup_stream(spark, sf_dir)
    return out.select(F.unix_timestamp("w.start").cast("long").alias("window_start"), "event_type", "n",
                      *[F.round(F.col(c) + F.lit(1e-9), 6).alias(c) for c in ("mean_value", "approx_p50_value")])

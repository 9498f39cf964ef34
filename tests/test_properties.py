from pyspark.sql import functions as F

from veilspark.functions.rules import RULES
from veilspark.operators import decode as X
from veilspark.operators.detect import detect
from veilspark.operators.redact import apply_spans, redact_rules
from veilspark.sources.tables import table

SF = "/root/testdata/sf0.001"
NORM = r"\[(?:PII_)?[A-Z_]+?_\d+\]"


def test_stream_equals_batch(spark):
    from veilspark.streaming.stream import redact_stream
    stream = {r.doc_id: (r.redacted, r.matches) for r in redact_stream(spark, SF).collect()}
    batch = {r.doc_id: (r.redacted, r.matches) for r in redact_rules(table(spark, SF, "documents")).collect()}
    assert stream == batch


def test_span_application_equals_sequential_redaction_for_one_rule(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    email = RULES[2]
    seq = redact_rules(docs, rules=(email,)).select("doc_id", F.regexp_replace("redacted", NORM, "[X]").alias("a"))
    sp = (detect(docs, rules=(email,)).groupBy("doc_id")
          .agg(F.collect_list(F.struct(F.lit("private_email").alias("label"), "start", "end")).alias("spans")))
    applied = docs.join(sp, "doc_id", "left").select(
        "doc_id", F.regexp_replace(apply_spans("text", F.coalesce("spans", F.array().cast(X.SPAN_T))), NORM, "[X]").alias("b"))
    j = seq.join(applied, "doc_id")
    assert j.count() == docs.count()
    assert j.where(F.col("a") != F.col("b")).count() == 0


def test_detect_partition_invariance(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    base = sorted(tuple(r) for r in detect(docs).collect())
    for n in (1, 4, 16):
        assert sorted(tuple(r) for r in detect(docs.repartition(n)).collect()) == base


def test_late_rows_are_dropped(spark, tmp_path):
    import os
    import time
    from veilspark.streaming.stream import windowed_rollup_stream
    days = [["2024-01-01 10:00:00"] * 3, ["2024-01-05 12:00:00"], ["2024-01-05 13:00:00", "2024-01-05 11:30:00"],
            ["2024-01-09 00:00:00", "2024-01-01 11:00:00"]]
    folder = tmp_path / "events.parquet"
    for k, ts in enumerate(days):
        rows = [(k * 10 + i, t, "view", float(k * 10 + i)) for i, t in enumerate(ts)]
        part = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        part.coalesce(1).write.mode("append").parquet(str(folder))
        new = [f for f in folder.iterdir() if f.suffix == ".parquet" and f.stat().st_mtime > 2_000_000]
        for f in new:
            os.utime(f, (1_000_000 + 10 * k, 1_000_000 + 10 * k))
        time.sleep(0.01)
    got = {r.w.start.day: (r.n, r.mean_value, r.approx_p50_value) for r in windowed_rollup_stream(spark, str(tmp_path), files_per_batch=1).collect()}
    # the last file's row of the first day comes when the watermark stands at the fifth day; the others are in time
    assert got == {1: (3, 1.0, 1.0), 5: (3, (10 + 20 + 21) / 3, 20.0), 9: (1, 30.0, 30.0)}

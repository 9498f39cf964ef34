"""JSON-lines sources and sinks.

Labelled samples: one object per line; blank and ``#`` lines skipped; ``id``
and ``text`` required (cast to string), list fields default to ``[]``.
Rows missing a required field go to a reject table with their file and raw
line (a distributed text scan has no line numbers). Result rows are read
with an explicit schema and tagged with their source file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_strip
from ..session import scratch_folder

SAMPLE_SCHEMA = "id string, text string, pii array<string>, anchors array<string>, tags array<string>"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never machine-local on a cluster)."""
    return scratch_folder(spark, name)


def _in_key_order(col, kind: T.DataType):
    """The value with the fields of every struct in it in name order."""
    if isinstance(kind, T.StructType):
        fields = [_in_key_order(col[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(col, lambda x: _in_key_order(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(col))
        return F.map_from_entries(entries)
    return col


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON object per line, keys sorted at every level, nulls written, non-ASCII kept."""
    cols = [_in_key_order(F.col(c), df.schema[c].dataType).alias(c) for c in sorted(df.columns)]
    (df.select(*cols).write.mode(mode).option("ignoreNullFields", "false").json(path))


def write_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    lines.select(F.col("value").cast("string")).write.mode(mode).text(path)


def read_samples(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(samples, rejects) from labelled JSON lines."""
    raw = (spark.read.text(path).select(py_strip("value").alias("line"), F.col("_metadata.file_path").alias("file"))
           .where((F.col("line") != "") & ~F.col("line").startswith("#")))
    # from_json is permissive (a malformed line parses to all-NULL fields), so
    # malformed lines are told apart with try_parse_json
    parsed = raw.select("file", "line", F.from_json("line", SAMPLE_SCHEMA).alias("s"),
                        F.try_parse_json("line").isNull().alias("malformed"))
    bad = F.col("malformed") | F.col("s.id").isNull() | F.col("s.text").isNull()
    rejects = parsed.where(bad).select("file", "line", F.when(F.col("malformed"), F.lit("malformed JSON"))
                                       .when(F.col("s.id").isNull(), F.lit("no id"))
                                       .otherwise(F.lit("no text")).alias("reason"))
    empty = F.array().cast("array<string>")
    samples = parsed.where(~bad).select(
        F.col("s.id").alias("id"), F.col("s.text").alias("text"),
        F.coalesce("s.pii", empty).alias("pii"), F.coalesce("s.anchors", empty).alias("anchors"),
        F.coalesce("s.tags", empty).alias("tags"), "file")
    if strict:
        first = rejects.select(F.concat_ws(": ", "file", "reason").alias("m")).limit(1).collect()
        if first:
            raise ValueError(f"invalid sample in {first[0].m}")
        if samples.limit(1).count() == 0:
            raise ValueError(f"{path} holds no sample")
    return samples, rejects


# FIXED VALUES: the numeric fields of one measured call.
M_FIELDS = ("latency_s", "input_tokens", "input_tps", "output_tokens", "ttft_s", "prefill_tps", "decode_tps", "short_e2e_tps",
            "peak_gpu_mem_mb", "opf_component_s", "opf_tokenize_s", "opf_window_prepare_s", "opf_model_forward_s",
            "opf_logprob_transfer_s", "opf_aggregation_s", "opf_decode_s", "opf_span_postprocess_s", "opf_redaction_s",
            "opf_windows", "opf_window_tokens")
_WHOLE = ("input_tokens", "output_tokens")


def _fields(names, kind) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


M_SCHEMA = T.StructType([T.StructField("repeat_index", T.LongType()),
                         *[T.StructField(n, T.LongType() if n in _WHOLE else T.DoubleType()) for n in M_FIELDS]])
SCORE_SCHEMA = T.StructType([
    T.StructField("sample_id", T.StringType()), T.StructField("pii_total", T.LongType()), T.StructField("pii_hit", T.LongType()),
    T.StructField("missed_pii", T.ArrayType(T.StringType())), T.StructField("anchor_total", T.LongType()),
    T.StructField("anchor_keep", T.LongType()), T.StructField("changed_anchors", T.ArrayType(T.StringType()))])
RESULT_SCHEMA = T.StructType([
    T.StructField("schema_version", T.LongType()), *_fields(("kind", "run_id", "model", "model_type", "created_at", "hardware"), T.StringType()),
    *_fields(("bucket_tokens", "actual_tokens", "chars", "repeats", "successful_repeats"), T.LongType()),
    T.StructField("power_watts", T.DoubleType()),
    T.StructField("load", T.StructType([T.StructField("load_s", T.DoubleType()), T.StructField("device", T.StringType())])),
    T.StructField("measurements", T.ArrayType(M_SCHEMA)),
    T.StructField("aggregate", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("errors", T.ArrayType(T.StructType(_fields(("sample_id", "type", "message"), T.StringType())))),
    *_fields(("serial_count", "serial_chunk_tokens", "serial_total_tokens", "concat_tokens"), T.LongType()),
    *_fields(("serial_total_latency_s", "serial_effective_tps", "concat_latency_s", "concat_input_tps", "speedup_vs_serial"), T.DoubleType()),
    *_fields(("sample_count", "successful_samples", "pii_total", "pii_hit", "anchor_total", "anchor_keep", "error_count"), T.LongType()),
    *_fields(("recall", "anchor_keep_rate"), T.DoubleType()),
    T.StructField("sample_scores", T.ArrayType(SCORE_SCHEMA)),
    *_fields(("error_type", "error"), T.StringType()),
    # kind = measurement: one attempt per row; kind = sample_score: one scored sample per row
    *M_SCHEMA.fields,
    T.StructField("sample_id", T.StringType()), T.StructField("missed_pii", T.ArrayType(T.StringType())),
    T.StructField("changed_anchors", T.ArrayType(T.StringType())),
])
#: Kinds of result rows that are sections of the report, and those that hold one attempt or sample each.
SECTIONS = ("run_metadata", "warmup", "speed", "quality", "batch_compare", "model_error")
KINDS = (*SECTIONS, "measurement", "sample_score")


def numbers(fields):
    """The numeric values of a ``map<string,variant>``, whatever their keys; booleans, texts and NULLs are no numbers."""
    kind = lambda v: F.schema_of_variant(v)
    is_number = lambda v: kind(v).isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | kind(v).startswith("DECIMAL")
    return F.transform_values(F.map_filter(fields, lambda k, v: is_number(v)), lambda k, v: v.cast("double"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(jvm_path).isDirectory()


def read_results(spark: SparkSession, paths: list[str], glob: str = "{*.jsonl,part-*.json*}") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): result rows tagged with ``_source``, and the lines that are not JSON objects.

    A folder contributes its ``*.jsonl`` files and the part files Spark wrote
    (not recursively, and no other JSON files); a file named outright is read
    whatever its name. ``metrics`` holds all numbers of a row by their keys,
    and ``listed`` those of each embedded measurement, known fields or not.
    """
    folders = [p for p in paths if _is_folder(spark, p)]
    files = [p for p in paths if p not in folders]
    parts = ([spark.read.option("pathGlobFilter", glob).text(folders)] if folders else []) + ([spark.read.text(files)] if files else [])
    # the part files of one written folder are one source
    source = F.regexp_replace(F.col("_metadata.file_path"), r"/part-[^/]*$", "")
    lines = merge(*[p.select(py_strip("value").alias("line"), source.alias("_source")) for p in parts]).where(F.col("line") != "")
    lines = lines.withColumn("v", F.try_parse_json("line"))
    open_fields = F.try_variant_get("v", "$", "map<string,variant>")
    # a line without the key (which may be spelled with escapes) embeds nothing
    embedded = F.when(F.col("line").contains("measurements") | F.col("line").contains("\\u"),
                      F.from_json("line", "struct<measurements:array<map<string,variant>>>")["measurements"])
    parsed = lines.select("line", "_source", F.from_json("line", RESULT_SCHEMA).alias("r"), F.col("v").isNull().alias("malformed"),
                          numbers(open_fields).alias("metrics"), F.transform(embedded, numbers).alias("listed"))
    rejects = parsed.where("malformed").select(F.col("_source").alias("file"), "line", F.lit("malformed JSON").alias("reason"))
    return parsed.where(~F.col("malformed")).select("r.*", "metrics", "listed", "_source"), rejects


def store_by_kind(rows: DataFrame, path: str) -> DataFrame:
    """Write parsed rows in one folder per kind and read them back: the lines are parsed once, and a section that
    filters its ``kind`` opens that kind's folder only."""
    rows.write.mode("overwrite").partitionBy("kind").parquet(path)
    schema = T.StructType([f for f in rows.schema.fields if f.name != "kind"] + [T.StructField("kind", T.StringType())])
    return rows.sparkSession.read.schema(schema).parquet(path)


def split_kinds(rows: DataFrame) -> dict[str, DataFrame]:
    return {k: rows.where(F.col("kind") == k) for k in SECTIONS}


def merge(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out

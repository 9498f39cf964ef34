import json

from pyspark.sql import functions as F

from veilspark.operators.metrics import STAGE_FIELDS
from veilspark.operators.results import flat_rows, report_tables
from veilspark.sources.jsonl import read_results, read_samples, write_jsonl

STAGES = {name: 0.01 * (k + 1) for k, name in enumerate(STAGE_FIELDS)}  # 0.45 s in all


def result_file():
    """One run with every kind of row; values made up for this test."""
    base = {"run_id": "r-7", "model": "m1", "model_type": "tagger"}
    calls = [{"latency_s": 0.5, "opf_windows": 2, "opf_window_tokens": 64, "prefill_tps": 900.0, "decode_tps": 30.0, **STAGES},
             {"latency_s": 0.7, "opf_windows": 4, "opf_window_tokens": 96, "prefill_tps": 1100.0, "decode_tps": 50.0, **STAGES}]
    agg = {"latency_s_p50": 0.6, "latency_s_p95": 0.69, "input_tps_mean": 640.0, "input_tps_per_watt": 2.5, "prefill_tps_mean": 1000.0,
           "prefill_tps_per_watt": 3.5, "decode_tps_mean": 40.0, "decode_tps_per_watt": 0.25}
    load = {"load_s": 1.5, "device": "mps"}
    score = {"sample_id": "s1", "pii_total": 2, "pii_hit": 1, "missed_pii": ["a@b.c"], "anchor_total": 1, "anchor_keep": 0, "changed_anchors": ["Zug"]}
    return [
        {**base, "kind": "run_metadata", "created_at": "2030-01-02", "hardware": {
            "platform": {"machine": "arm"}, "git": {"commit": "0123456789abcdef", "dirty": True}, "power": {"budget_watts": 42.5}}},
        {**base, "kind": "warmup", "repeats": 1, "load": load, "aggregate": {
            "latency_s_p50": 0.9, "input_tps_mean": 300.0, "opf_model_forward_s_mean": 0.4, "opf_windows_mean": 3.0}},
        {**base, "kind": "speed", "bucket_tokens": 320, "successful_repeats": 2, "repeats": 3, "load": load, "power_watts": 30.0,
         "measurements": calls, "aggregate": agg, "errors": [{"type": "E", "message": "x"}]},
        {**base, "kind": "speed", "bucket_tokens": 640, "successful_repeats": 2, "repeats": 2, "load": load,
         "measurements": [{"latency_s": 1.0}], "aggregate": {"latency_s_p50": 1.0, "input_tps_mean": 700.0}},
        {**base, "kind": "batch_compare", "serial_count": 9, "serial_chunk_tokens": 50, "serial_total_tokens": 450, "serial_total_latency_s": 3.0,
         "serial_effective_tps": 150.0, "concat_tokens": 450, "concat_latency_s": 1.5, "concat_input_tps": 300.0, "speedup_vs_serial": 2.0},
        {**base, "kind": "quality", "sample_count": 3, "successful_samples": 2, "pii_total": 4, "pii_hit": 3, "recall": 0.75, "anchor_total": 2,
         "anchor_keep": 1, "anchor_keep_rate": 0.5, "latency_s": 0.8, "errors": [{"sample_id": "s3", "type": "T", "message": "late"}],
         "sample_scores": [score, {**score, "sample_id": "s2", "missed_pii": [], "changed_anchors": []}]},
        {**base, "kind": "model_error", "error_type": "OSError", "error": "left|right" + "x" * 300},
    ]


def folder(tmp_path, rows=None):
    (tmp_path / "run.jsonl").write_text("\n".join(json.dumps(r) for r in (rows or result_file())) + "\n\t\nnot json\n")
    (tmp_path / "config.json").write_text('{"kind": "speed", "run_id": "not a result"}')
    return str(tmp_path)


def test_nine_sections_with_values(spark, tmp_path):
    rows, rejects = read_results(spark, [folder(tmp_path)])
    assert [r.line for r in rejects.collect()] == ["not json"] and rows.count() == 7
    tabs = {k: t.collect() for k, t in report_tables(rows).items()}
    assert list(tabs) == ["runs", "warmup", "speed", "stage_breakdown", "scaling", "batch_compare", "quality", "quality_details", "errors"]
    run, = tabs["runs"]
    assert (run.hardware_label, run.power_watts, run.git) == ("arm", 42.5, "01234567 dirty")
    warm, = tabs["warmup"]
    assert (warm.load_s, warm.latency_s_p50, warm.forward_s, warm.windows) == (1.5, 0.9, 0.4, 3.0)
    speed = {r.bucket_tokens: r for r in tabs["speed"]}
    assert (speed[320].input_tps_per_watt, speed[320].prefill_tps_mean, speed[320].power_watts) == (2.5, 1000.0, 30.0)
    assert speed[640].input_tps_per_watt is None
    stage, = tabs["stage_breakdown"]
    assert abs(stage.latency_s - 0.6) < 1e-9 and abs(stage.other_s - 0.15) < 1e-9 and stage.opf_windows == 3.0
    assert all(abs(stage[k] - v) < 1e-9 for k, v in STAGES.items())
    fit, = tabs["scaling"]
    assert fit.points == 2 and abs(fit.per_token_ms - 1.25) < 1e-9 and abs(fit.fixed_overhead_s - 0.2) < 1e-9
    assert tabs["batch_compare"][0].speedup_vs_serial == 2.0
    quality, = tabs["quality"]
    assert (quality.recall, quality.latency_s, quality.errors, quality.anchor_keep) == (0.75, 0.8, 1, 1)
    detail, = tabs["quality_details"]
    assert (detail.sample_id, detail.missed_pii, detail.changed_anchors) == ("s1", ["a@b.c"], ["Zug"])
    assert tabs["errors"][0].error == ("left/right" + "x" * 300)[:180]


def test_flat_table_has_fifty_columns(spark, tmp_path):
    flat = flat_rows(read_results(spark, [folder(tmp_path)])[0])
    assert len(flat.columns) == 50 and flat.columns == sorted(flat.columns)
    row = flat.where("kind = 'speed' AND bucket_tokens = 320").first()
    assert (row.load_s, row.decode_tps_per_watt, row.opf_windows_mean, row.opf_window_tokens_mean) == (1.5, 0.25, 3.0, 80.0)
    assert abs(row.opf_redaction_s_mean - STAGES["opf_redaction_s"]) < 1e-9


def test_one_run_id_in_two_files_is_fitted_twice(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    paths = [folder(tmp_path / "a"), folder(tmp_path / "b")]
    assert report_tables(read_results(spark, paths)[0])["scaling"].count() == 2


def test_named_file_and_written_folder(spark, tmp_path):
    named = tmp_path / "results.txt"
    named.write_text(json.dumps(result_file()[2]))
    rows = read_results(spark, [str(named)])[0]
    assert rows.first().load.device == "mps"
    write_jsonl(rows.drop("_source"), str(tmp_path / "out"))
    again = read_results(spark, [str(tmp_path / "out")])[0].first()
    assert again.aggregate == rows.first().aggregate and again["_source"].endswith("/out") and len(again.measurements) == 2


def test_samples_reader_skips_and_rejects(spark, tmp_path):
    lines = ["\t# a note", " \t ", '{"id": 31, "text": "one"}', '{"id": "q"}', '{"text": "no id"}', "{broken", '{"id":"z","text":"two","pii":["p1","p2"],"tags":["t"]}']
    (tmp_path / "s.jsonl").write_text("\n".join(lines))
    samples, rejects = read_samples(spark, str(tmp_path))
    got = sorted((r.id, r.text, tuple(r.pii), tuple(r.anchors), tuple(r.tags)) for r in samples.collect())
    assert got == [("31", "one", (), (), ()), ("z", "two", ("p1", "p2"), (), ("t",))]
    assert sorted(r.reason for r in rejects.collect()) == ["malformed JSON", "no id", "no text"]
    assert samples.where(F.col("file").endswith("s.jsonl")).count() == 2


def test_written_keys_are_sorted_at_every_level(spark, tmp_path):
    df = spark.createDataFrame([(1, {"z": 1, "b": 2}, [{"y": 1, "a": None}], (2, "é"))],
                               "z int, m map<string,int>, l array<struct<y:int,a:int>>, c struct<q:int,d:string>")
    write_jsonl(df, str(tmp_path / "o"))
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == [
        '{"c":{"d":"é","q":2},"l":[{"a":null,"y":1}],"m":{"b":2,"z":1},"z":1}']


def test_unknown_numbers_are_rolled_up(spark, tmp_path):
    from veilspark.operators.metrics import aggregate_open
    from veilspark.operators.results import measurement_rows
    lines = ['{"kind": "measurement", "run_id": "a", "model": "m", "bucket_tokens": 8, "latency_s": %d, "mlx_new": %s, "mlx_on": true, "note": 3}' % (i, v)
             for i, v in enumerate(["1", "2.5", "null", "true", '"x"', "1e3"])]
    lines.append('{"kind": "speed", "run_id": "b", "model": "m", "bucket_tokens": 8, "measurements": [{"latency_s": 4, "mlx_new": 7}, {"opf_extra": 2, "opf_decoded_mismatch": 1}]}')
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    got = aggregate_open(measurement_rows(read_results(spark, [str(tmp_path)])[0])).collect()
    found = {(r.run_id, r.metric): (r.mean, r.p50, r.n) for r in got}
    assert found == {("a", "latency_s"): (2.5, 2.5, 6), ("a", "mlx_new"): (1003.5 / 3, 2.5, 3), ("b", "latency_s"): (4, 4, 1),
                     ("b", "mlx_new"): (7, 7, 1), ("b", "opf_extra"): (2, 2, 1)}


def test_sections_open_their_kind_only(spark, tmp_path):
    from veilspark.sources.jsonl import store_by_kind
    rows = store_by_kind(read_results(spark, [folder(tmp_path)])[0], str(tmp_path.parent / f"{tmp_path.name}-kinds"))
    tabs = report_tables(rows)
    for name, kind in (("runs", "run_metadata"), ("warmup", "warmup"), ("batch_compare", "batch_compare"), ("errors", "model_error")):
        plan = tabs[name]._jdf.queryExecution().executedPlan().toString()
        assert f"PartitionFilters: [isnotnull(kind" in plan and f"= {kind})" in plan, name
    direct = report_tables(read_results(spark, [str(tmp_path)])[0])
    assert all(tabs[n].count() == direct[n].count() for n in tabs)

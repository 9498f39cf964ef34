"""Result lines are parsed no more often than needed, and samples are scored once."""
import json

from veilspark.plans import q_io as Q
from veilspark.sources import jsonl as J


def test_lines_are_parsed_twice_and_escaped_keys_are_found(spark, tmp_path):
    lines = [json.dumps({"kind": "measurement", "latency_s": 2, "opf_x": 0.5, "note": "n", "flag": True}),
             '{"kind": "speed", "\\u006deasurements": [{"latency_s": 1.5, "mlx_y": 3}]}', "[1]", "7", "{bad"]
    path = str(tmp_path / "r.jsonl")
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    rows, rejects = J.read_results(spark, [path])
    assert "JsonToStructs" not in rows.select("metrics")._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in rows.select("metrics")._jdf.queryExecution().optimizedPlan().toString()
    got = {r.kind: r for r in rows.where("kind IS NOT NULL").collect()}
    assert got["measurement"].metrics == {"latency_s": 2.0, "opf_x": 0.5} and got["measurement"].listed is None
    assert got["speed"].listed == [{"latency_s": 1.5, "mlx_y": 3.0}]
    assert [r.line for r in rejects.collect()] == ["{bad"]


def test_quality_reads_stored_scores(spark):
    s = Q._stored_scores(spark, "/root/testdata/sf0.001")
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and s.columns == Q.scored(spark, "/root/testdata/sf0.001").columns

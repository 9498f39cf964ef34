from pyspark.sql import functions as F

import brute
from veilspark.operators.redact import apply_spans, redact_rules
from veilspark.plans.fixtures import RULE_CASES
from veilspark.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_common_pii_is_redacted(spark):
    text = "Write to k.ono@post.example or +44 (207) 946-0321; token sk-proj-zyxw98765432."
    r = redact_rules(spark.createDataFrame([(text,)], "text string")).first()
    assert "k.ono@post.example" not in r.redacted
    assert "+44 (207) 946-0321" not in r.redacted
    assert "sk-proj-zyxw98765432" not in r.redacted
    assert "[EMAIL_1]" in r.redacted


def test_rule_cases_match_python_semantics(spark):
    df = spark.createDataFrame([(c, t) for c, t in RULE_CASES], "case_id long, text string")
    for r in redact_rules(df).collect():
        assert (r.redacted, r.matches) == brute.redact(r.text), r.case_id


def test_order_effects(spark):
    df = spark.createDataFrame([("4111 1111 1111 1111",), ("2025-07-1",), ("api_key=abcd1234 sk-abcdefgh12345678",)],
                               "text string")
    out = [r.redacted for r in redact_rules(df).collect()]
    assert out[0] == "[PHONE_1]"
    assert out[1] == "[PHONE_1]-1"
    assert out[2] == "[SECRET_2] [SECRET_1]"


def test_whole_table_matches_brute_and_partitioning(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    expected = {r.doc_id: brute.redact(r.text) for r in docs.collect()}
    for n in (1, 4, 16):
        got = {r.doc_id: (r.redacted, r.matches) for r in redact_rules(docs.repartition(n)).collect()}
        assert got == expected


def test_redacting_twice_adds_no_email(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    once = redact_rules(docs)
    twice = redact_rules(once.select("doc_id", F.col("redacted").alias("text")), out_col="again")
    from veilspark.functions.rules import RULES
    from veilspark.operators.detect import rule_values
    assert twice.where(F.size(rule_values("again", RULES[2])) > 0).count() == 0


def test_apply_spans_counts_from_the_right(spark):
    spans = [("private_person", 0, 9), ("private_email", 11, 24)]
    df = spark.createDataFrame([("Mira Voss <mv@post.example>", spans)],
                               "text string, spans array<struct<label:string,start:int,end:int>>")
    assert df.select(apply_spans("text", "spans").alias("x")).first().x == "[PII_PRIVATE_PERSON_1] <[PII_PRIVATE_EMAIL_1]le>"
    two = [("a", 0, 1), ("a", 2, 3)]
    df2 = spark.createDataFrame([("x y z", two)], "text string, spans array<struct<label:string,start:int,end:int>>")
    assert df2.select(apply_spans("text", "spans").alias("x")).first().x == "[PII_A_2] [PII_A_1] z"


def test_detect_offsets_match_brute(spark):
    from veilspark.operators.detect import detect
    df = spark.createDataFrame([(c, t) for c, t in RULE_CASES], "doc_id long, text string")
    got = sorted((r.doc_id, r.rule, r.start, r.end, r.value) for r in detect(df).collect())
    exp = sorted((c, i, s, e, v) for c, t in RULE_CASES for i in range(1, 11) for s, e, v in brute.rule_matches(t, i))
    assert got == exp


def test_case_folding_beyond_ascii(spark):
    texts = ["\u0130stanbul@example.com", "\u212aelvin@ex\u212ample.org", "\u017fam@example.net", "AP\u0131_KEY=abcd1234", "x 12 Ba\u212aer \u017ftreet y"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [(r.redacted, r.matches) for r in redact_rules(df).collect()] == [brute.redact(t) for t in texts]
    assert redact_rules(df).first().redacted == "[EMAIL_1]"

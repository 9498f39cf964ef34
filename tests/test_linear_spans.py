"""Spans of texts with very many matches, and overlapping spans, against plain Python."""
import random
import time

import pytest
from pyspark.sql import functions as F

import brute
from veilspark.functions import text as T
from veilspark.functions.rules import RULES
from veilspark.operators import decode as X
from veilspark.operators.detect import detect, rule_spans
from veilspark.operators.redact import apply_spans

SPANS = "array<struct<label:string,start:int,end:int>>"


def sliced(text, spans):
    """Cut by cut on the growing text."""
    used = {}
    for label, start, end in sorted(spans, key=lambda s: -s[1]):
        used[label] = used.get(label, 0) + 1
        start, end = max(0, min(start, len(text))), max(0, min(end, len(text)))
        text = text[:start] + f"[PII_{label.upper()}_{used[label]}]" + text[end:]
    return text


def greedy(spans, by_label):
    kept = []
    for s in sorted(spans, key=lambda s: (s[1], s[1] - s[2])):
        if not any(k[1] < s[2] and s[1] < k[2] and (not by_label or k[0] == s[0]) for k in kept):
            kept.append(s)
    return kept


def random_spans(r, n, size, lengths):
    return [(r.choice(["a", "bb", "Ccc"]), s := r.randrange(size), s + r.choice(lengths)) for _ in range(n)]


def test_random_spans_equal_repeated_slicing(spark):
    r = random.Random(6)
    rows = []
    for k in range(150):
        text = "".join(r.choice("ab é😀") for _ in range(r.choice([0, 3, 30, 90])))
        rows.append((k, text, random_spans(r, r.randrange(9), len(text) + 1, [0, 1, 2, 5, 40, -2])))
    rows += [(1000, "abc", [("a", 7, 9), ("b", 5, 2), ("a", 1, 2)]), (1001, "abc", [("a", -5, 2), ("a", -1, 9)]), (1002, "long " * 1000, [("a", 1023, 1025), ("a", 2000, 4096)])]
    df = spark.createDataFrame(rows, f"k long, text string, spans {SPANS}")
    got = df.select("*", apply_spans("text", "spans").alias("x"), X.select_non_overlapping("spans").alias("one"),
                    X.discard_overlapping_by_label("spans").alias("own"), X.valid_spans("spans", "text").alias("valid")).collect()
    for g in got:
        spans = [tuple(s) for s in g.spans]
        assert g.x == sliced(g.text, spans), (g.text, spans)
        if all(s <= e for _, s, e in spans):
            assert [tuple(s) for s in g.one] == greedy(spans, False), spans
            assert [tuple(s) for s in g.own] == greedy(spans, True), spans
        assert [tuple(s) for s in g.valid] == [s for s in spans if 0 <= s[1] < s[2] <= len(g.text)]


def test_null_text_or_spans(spark):
    df = spark.createDataFrame([(None, [("a", 0, 1)]), ("abc", None), ("abc", [])], f"text string, spans {SPANS}")
    assert [r.x for r in df.select(apply_spans("text", "spans").alias("x")).collect()] == [None, None, "abc"]


def test_blocks_cut_like_slices(spark):
    text = "".join(random.Random(1).choice("aé日😀\n") for _ in range(5000))
    cuts = [(0, 0), (0, 1), (0, 1024), (1023, 1025), (1024, 2048), (1, 4999), (0, 5000), (3000, 3001), (4999, 5000)]
    df = spark.createDataFrame([(text, a, b) for a, b in cuts], "text string, a int, b int")
    for r in df.select("a", "b", T.cut(T.blocks("text"), F.col("a"), F.col("b")).alias("x")).collect():
        assert r.x == text[r.a:r.b]


@pytest.fixture(scope="module")
def many(spark):
    return spark.createDataFrame([(1, "".join(f"écrire à u{k}@h{k % 7}.example ou {k % 10} " for k in range(100_000)))], "doc_id long, text string")


def test_a_hundred_thousand_matches_in_seconds(spark, many):
    text = many.first().text
    began = time.time()
    got = many.select(F.explode(rule_spans("text", RULES[2])).alias("s")).select("s.start", "s.end", "s.value").collect()
    assert [tuple(r) for r in got] == brute.rule_matches(text, 3) and len(got) == 100_000
    spans = F.transform(rule_spans("text", RULES[2]), lambda s: F.struct(F.lit("mail").alias("label"), s["start"].alias("start"), (s["end"] + 3).alias("end")))
    out = many.select(apply_spans("text", X.select_non_overlapping(spans)).alias("x")).first().x
    took = time.time() - began
    ends = [0, *(e + 3 for _, e, _ in brute.rule_matches(text, 3))]
    gaps = [text[a:s] for a, (s, _, _) in zip(ends, brute.rule_matches(text, 3))]
    assert out == "".join(f"{g}[PII_MAIL_{100_000 - k}]" for k, g in enumerate(gaps)) + text[ends[-1]:]
    assert took < 60  # about 10 s on an idle machine; the folds took many minutes


def test_detection_needs_no_exchange(spark, many):
    plan = detect(many)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan

"""Tokens, labels and spans built in the row, against the long-table operators and plain Python."""
import random

from pyspark.sql import functions as F

import brute
from veilspark.functions.rules import PII_CATEGORIES
from veilspark.operators import decode as X
from veilspark.operators.tokens import overlaps, token_spans, token_table
from veilspark.plans.fixtures import BIOES_CASES, RULE_CASES


def test_offsets_without_an_exchange(spark):
    r = random.Random(3)
    texts = [t for _, t in RULE_CASES] + ["", "   ", "".join(r.choice("ab 日é😀_.\n") for _ in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = token_table(df)
    assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString()
    for row in df.select("text", token_spans("text").alias("t")).collect():
        assert [(t.tok_start, t.tok_end) for t in row.t] == brute.token_spans(row.text)
        assert all(row.text[t.tok_start:t.tok_end] == t.piece for t in row.t)


def test_overlaps(spark):
    toks = [(0, 2), (2, 5), (7, 8), (9, 30)]
    spans = [(0, 1), (1, 3), (5, 7), (6, 10), (0, 40), (30, 31)]
    df = spark.createDataFrame([(toks, spans)], "t array<struct<tok_start:int,tok_end:int>>, s array<struct<start:int,end:int>>")
    got = df.select(overlaps(F.col("t"), F.col("s")).alias("x")).first().x
    assert [tuple(x) for x in got] == [(i, j) for j, (a, b) in enumerate(spans) for i, (c, d) in enumerate(toks) if c < b and d > a]


def test_labels_follow_the_lowest_rule(spark):
    df = spark.createDataFrame([(c, t) for c, t in RULE_CASES], "doc_id long, text string")
    cats = {"SECRET": "secret", "ACCOUNT": "account_number", "EMAIL": "private_email", "PHONE": "private_phone", "ADDRESS": "private_address",
            "DATE": "private_date", "URL": "private_url"}
    from veilspark.functions.rules import RULES
    for row in df.select("text", X.labelled_tokens("text").alias("t")).collect():
        toks = brute.token_spans(row.text)
        owner = {}
        for i, (a, b) in enumerate(toks):
            hits = [(k, s) for k in range(1, 11) for s, e, _ in brute.rule_matches(row.text, k) if a < e and b > s]
            if hits:
                owner[i] = min(hits)
        want = []
        for i in range(len(toks)):
            if i not in owner:
                want.append("O")
                continue
            mine = [k for k, v in owner.items() if v == owner[i]]
            tag = "S" if len(mine) == 1 else "B" if i == min(mine) else "E" if i == max(mine) else "I"
            want.append(f"{tag}-{cats[RULES[owner[i][0] - 1].label]}")
        assert [t.label for t in row.t] == want


def test_row_spans_equal_the_long_table(spark):
    df = spark.createDataFrame([(cid, [(s, e, lab) for s, e, lab in items]) for cid, items in BIOES_CASES],
                               "doc_id long, t array<struct<tok_start:int,tok_end:int,label:string>>")
    allowed = [c for c in PII_CATEGORIES if c != "account_number"]
    for row in df.select("t", X.row_spans(F.col("t"), allowed).alias("s")).collect():
        assert [tuple(s) for s in row.s] == brute.bioes_spans([tuple(t) for t in row.t], set(allowed))

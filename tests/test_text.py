from pyspark.sql import functions as F

import brute
from veilspark.functions import text as T

CASES = ["高橋 q.r@mail.example zug", "Elm Oak Ash", "", "   ", "a😀b　c\x1cd", "x,y;z..", "한국어 テスト 中文"]


def test_token_count_cjk_and_words(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "text string")
    got = [r.n for r in df.select(T.token_count("text").alias("n")).collect()]
    assert got == [brute.token_count(t) for t in CASES]
    assert got[0] == 4


def test_truncate_and_sized_text(spark):
    df = spark.createDataFrame([("Elm Oak Ash",)], "text string")
    r = df.select(T.truncate_to_tokens("text", 2).alias("a"), T.truncate_to_tokens("text", 0).alias("b"),
                  T.truncate_to_tokens("text", 9).alias("c"),
                  T.sized_text(F.lit("Elm elm@tree.example"), 5).alias("s")).first()
    assert (r.a, r.b, r.c) == ("Elm Oak", "", "Elm Oak Ash")
    assert brute.token_count(r.s) == 5


def test_truncate_matches_brute(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "text string")
    for n in (1, 2, 3, 5):
        got = [r.t for r in df.select(T.truncate_to_tokens("text", n).alias("t")).collect()]
        assert got == [brute.truncate(t, n) for t in CASES]


def test_token_table_matches_brute(spark):
    from veilspark.operators.tokens import token_table
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "doc_id long, text string")
    rows = token_table(df).collect()
    for i, t in enumerate(CASES):
        got = sorted((r.tok_idx, r.tok_start, r.tok_end) for r in rows if r.doc_id == i)
        assert [(a, b) for _, a, b in got] == brute.token_spans(t)


def test_think_cleanup_and_budget(spark):
    df = spark.createDataFrame([("<think>plan</think> done </think> z 　",)], "g string")
    r = df.select(T.after_think("g").alias("c"), T.generation_budget(F.lit(0), F.lit(300)).alias("b")).first()
    assert r.c == "done </think> z"
    assert r.b == 390


def test_batch_shaped_inputs(spark):
    df = spark.createDataFrame([([[1, 1, 0]], [[[0, 2], [2], [3, 5, 9]]], [[7, 8], [9]])],
                               "mask array<array<long>>, offsets array<array<array<int>>>, ids array<array<long>>")
    r = df.select(T.attention_token_count("mask", F.lit(5), nested=True).alias("n"),
                  T.coerce_offsets("offsets", nested=True).alias("o"), T.coerce_ids("ids").alias("i")).first()
    assert r.n == 2 and [tuple(x) for x in r.o] == [(0, 2), (3, 5)] and r.i == [7, 8]
    none = spark.createDataFrame([(None, None, None)], df.schema)
    r = none.select(T.attention_token_count("mask", F.lit(5), nested=True).alias("n"),
                    T.coerce_offsets("offsets", nested=True).alias("o"), T.coerce_ids("ids").alias("i")).first()
    assert r.n == 5 and r.o == [] and r.i == []

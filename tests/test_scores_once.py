"""Scores and labels at size: bounded slices, one crossing of the exchange, no join of whole score tables."""
import pyarrow as pa

from pyspark.sql import functions as F

from veilspark.functions.arrays import running_sum
from veilspark.functions.rules import PII_CATEGORIES
from veilspark.operators import decode as X
from veilspark.plans import q_decode as Q

K = 3


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark, folder, texts):
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    turns = [(d, t % 3, x) for t, (d, x) in enumerate(texts) if d is not None and x is not None]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


TEXTS = [(1, "mail a@b.example or 415-555-0199 and a@b.example now"), (2, ""), (3, "no name"), (3, "mail c@d.example"), (4, None),
         (5, "card 4111 1111 1111 1111 at 2024-03-08 \u00e9\U0001F600 x@y.example"), (6, "mail c@d.example"), (6, "mail c@d.example")]


def test_slices_hold_a_bounded_number_of_scores():
    batch = pa.RecordBatch.from_arrays([pa.array([[0.0] * n for n in (5, 0, 3, 40, 1, 1, 1)])], names=["x"])
    parts = [[len(r) for r in b.column("x").to_pylist()] for b in X.slices([batch.slice(0, 2), batch.slice(2)], "x", 4)]
    assert parts == [[5], [0], [3], [40], [1, 1, 1]]


def test_viterbi_brings_its_scores_along(spark, tmp_path):
    d = tables(spark, tmp_path, TEXTS)
    q = Q.dec_4_viterbi(spark, d)
    assert "Join" not in plan(q)
    m = {(r.doc_id, r.tok_idx): r.score for r in Q.merged_scores(spark, d).collect()}
    for r in X.viterbi(Q.merged_scores(spark, d)).collect():
        assert r.score == m[r.doc_id, r.tok_idx][r.label_idx] and r.top == max(m[r.doc_id, r.tok_idx])
    assert q.count() == len({k[0] for k in m})


def test_tokens_of_two_windows_cross_the_exchange_once(spark):
    rows = [(1, w, 20 * w, [-1.0] * 40 * K) for w in range(3)]
    blocks = spark.createDataFrame(rows, "doc_id long, window_id long, first int, logprob array<double>").coalesce(1)
    merged = X.merge_blocks(blocks, K)
    below = plan(merged).split("Exchange hashpartitioning(doc_id")[1]
    assert "MapInArrow" in below and "counts" in below
    assert sorted(r.tok_idx for r in merged.collect()) == list(range(80))


def test_no_broadcast_of_tokens(spark, tmp_path):
    assert "Broadcast" not in plan(Q.dec_13_scores_offsets_join(spark, tables(spark, tmp_path, TEXTS)))


def test_running_sum_of_blocks(spark):
    rows = [(list(range(1, n + 1)),) for n in (0, 1, 2, 31, 32, 33, 64, 65, 1000)] + [([1, None, 2],), (None,)]
    for r in spark.createDataFrame(rows, "x array<int>").select("x", running_sum(F.col("x")).alias("s")).collect():
        want, total = None if r.x is None else [], 0
        for x in r.x or []:
            total = None if total is None or x is None else total + x
            want.append(total)
        assert r.s == want


def test_rows_equal_the_long_tables(spark, tmp_path):
    d = tables(spark, tmp_path, TEXTS)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    lab = X.token_labels(docs)
    want = sorted((r.doc_id, i, *s) for r in X.fallback_spans(lab.where("doc_id <> 3"), docs.where("doc_id <> 3"), list(PII_CATEGORIES)).collect() for i, s in enumerate(r.spans))
    got = sorted(tuple(r) for r in Q.dec_9_fallback_alignment(spark, d).where("doc_id <> 3").collect())
    assert got == want and len(got) > 4
    rebuilt = {r.doc_id: r for r in Q.dec_12_rebuild_text(spark, d).collect()}
    assert {k: (r.bad_offsets, r.decoded_mismatch) for k, r in rebuilt.items() if k in (1, 5)} == {1: (0, 0), 5: (0, 0)}
    assert 2 not in rebuilt and 4 not in rebuilt
    docs_of = {r.source: r.docs for r in Q.dec_10_fallback_when_empty(spark, d).collect()}
    assert docs_of["bioes"] == 2 and docs_of["fallback"] >= 1


def test_documents_of_their_own_id_are_not_gathered_by_token(spark, tmp_path):
    d = tables(spark, tmp_path, TEXTS)
    once, _ = X.by_key(spark.read.parquet(f"{d}/documents.parquet"))
    assert sorted((r.doc_id for r in once.collect())) == [1, 2, 4, 5]

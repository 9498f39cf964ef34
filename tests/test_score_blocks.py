"""Score blocks against the row-wise softmax and window merge."""
import numpy as np
from pyspark.sql import functions as F

from veilspark.operators import decode as X

K = 3


def blocks(spark):
    rng = np.random.default_rng(2)
    rows, long = [], []
    for doc, n in ((1, 1), (2, 70), (3, 129), (4, 300)):
        for w, first in enumerate(range(0, n, 20)):
            size = min(50, n - first)
            values = rng.normal(size=(size, K))
            values[rng.random((size, K)) < 0.1] = -np.inf
            values[:, 0] = np.where(np.isinf(values).all(axis=1), 0, values[:, 0])
            rows.append((doc, w, first, [float(x) for x in values.reshape(-1)]))
            long += [(doc, w, first + i, [float(x) for x in v]) for i, v in enumerate(values)]
    return (spark.createDataFrame(rows, "doc_id long, window_id long, first int, logits array<double>").repartition(5),
            spark.createDataFrame(long, "doc_id long, window_id long, tok_idx int, logits array<double>"))


def test_blocks_equal_rows(spark):
    packed, long = blocks(spark)
    want = {(r.doc_id, r.tok_idx): r.score for r in X.merge_windows(X.log_softmax(long)).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for rows in ("2", "10000"):  # segments that go on in the next batch, and all in one
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        for segment in (20, 64, 1000):
            got = {(r.doc_id, r.tok_idx): r.score for r in X.merge_blocks(X.log_softmax_blocks(packed, K), K, segment).collect()}
            assert got.keys() == want.keys()
            assert all(np.allclose(got[k], want[k]) for k in want)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_windows_of_a_row_equal_windows_of_tokens(spark):
    df = spark.createDataFrame([(d, list(range(n))) for d, n in ((1, 0), (2, 1), (3, 64), (4, 65), (5, 200))], "doc_id long, toks array<int>")
    w = df.select("doc_id", F.explode(X.token_windows(F.col("toks"), 50, 20)).alias("w"))
    got = {(r.doc_id, r.window_id, t) for r in w.select("doc_id", "w.window_id", "w.first", "w.toks").collect() for t in r.toks}
    long = df.select("doc_id", F.posexplode("toks").alias("tok_idx", "x"))
    assert got == {(r.doc_id, r.window_id, r.tok_idx) for r in X.windows(long, 50, 20).collect()}


def test_one_exchange(spark):
    packed, _ = blocks(spark)
    plan = X.merge_blocks(X.log_softmax_blocks(packed, K), K)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1

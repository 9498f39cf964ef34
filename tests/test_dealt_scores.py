"""Best paths without an exchange of scores: the texts are dealt out by document, and the score steps share one worker."""
import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from veilspark.operators import decode as X
from veilspark.plans import q_decode as Q

K = len(X.class_names())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark, folder):
    long = " ".join(("call 555 123 4567", "now_", "a@b.example", "12 777 8888", "no name")[i % 5] for i in range(700))
    turns = [(1, 0, "mail a@b.example or 415 555 0199 now_"), (1, 1, long), (1, 1, "call 555 777 8888"), (1, 1, long[:900]), (2, 0, ""), (2, 1, None),
             (0, 1002, "999 write user@host.example"), (1, 2, "x"), (3, 0, long[7:2000])]  # conversation 0's turn 1002 has the id of conversation 1's turn 2
    spark.createDataFrame(turns, "conv_id long, turn long, text string").repartition(3).write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([(i, "x") for i in range(4)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_no_exchange_of_scores(spark, tmp_path):
    p = plan(Q.dec_4_viterbi(spark, tables(spark, tmp_path)))
    assert p.count("Exchange hashpartitioning(") == p.count("Exchange") == 2  # the texts, and the sums of each document
    assert p.count("MapInArrow") == 1 and "Join" not in p


def test_equal_to_exchanged_scores(spark, tmp_path):
    d = tables(spark, tmp_path)
    want = {(r.doc_id, r.tok_idx): r for r in X.viterbi(Q.merged_scores(spark, d)).collect()}
    assert len(want) > 2000 and {k[0] for k in want} == {1000, 1001, 1002, 3000, -1, -2, -3, -4}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("1", "7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = X.viterbi(Q.merged_scores(spark, d, by_doc=True)).collect()
        assert len(got) == len(want)
        for r in got:
            w = want[r.doc_id, r.tok_idx]
            assert r.label_idx == w.label_idx and np.allclose([r.score, r.top], [w.score, w.top], rtol=0, atol=1e-12)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_rows_of_the_query(spark, tmp_path):
    d = tables(spark, tmp_path)
    v = X.viterbi(Q.merged_scores(spark, d))
    want = v.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"), F.round(F.sum("score") + F.lit(1e-9), 5).alias("best_score"),
                                   (F.count_if(F.col("score") < F.col("top")) > 0).alias("differs"))
    assert sorted(map(tuple, Q.dec_4_viterbi(spark, d).collect())) == sorted(map(tuple, want.collect()))


class Rows:
    """Stands for a DataFrame of score blocks."""
    def __init__(self, batches):
        self.batches = batches

    def mapInArrow(self, run, schema):
        return pa.Table.from_batches(run(iter(self.batches))).to_pylist()


def block_rows():
    """Windows of 8 tokens every 4, in order; document 2 comes three times, once shorter; and one that begins before the text."""
    rng, rows = np.random.default_rng(3), []
    for doc, n in ((1, 1), (2, 30), (2, 30), (2, 13), (3, 4), (5, 101), (6, 9)):
        rows += [(doc, w, first, rng.normal(size=(min(8, n - first), K)).reshape(-1).tolist()) for w, first in enumerate(range(0, n, 4))]
    rows += [(5, 99, -3, [0.0] * 2 * K), (6, 99, 4, []), (7, 0, 0, None)]
    return sorted(rows, key=lambda r: (r[0], r[2]))


def test_slices_of_any_size_give_the_same(monkeypatch):
    rows = block_rows()
    wide = {}
    for doc, _, first, x in rows:
        for i, s in enumerate(np.reshape(x, (-1, K)) if x and first >= 0 else ()):
            s = s - np.log(np.exp(s).sum())
            wide.setdefault((doc, first + i), []).append(s)
    want = {k: np.log(np.mean(np.exp(v), axis=0)) for k, v in wide.items()}
    kind = pa.schema([("doc_id", pa.int64()), ("window_id", pa.int64()), ("first", pa.int32()), ("logits", pa.list_(pa.float64()))])
    one = pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), kind)], schema=kind)
    paths = []
    for size, slice_ in ((1, 1), (1, 1 << 20), (5, 20 * K), (1000, 3 * K), (1000, 1 << 20)):
        monkeypatch.setattr(X, "SLICE", slice_)
        batches = [one.slice(i, size) for i in range(0, one.num_rows, size)]
        merged = X.merge_blocks(X.log_softmax_blocks(X.Dealt(Rows(batches)), K), K)
        got = merged.frame("")
        keys = [(r["doc_id"], r["tok_idx"]) for r in got]
        assert keys == sorted(want)  # each token once, in order
        assert all(np.allclose(r["score"], want[k]) for k, r in zip(keys, got))
        assert not (slice_ < 1 << 20) or len(list(_pieces(merged, batches))) > 5  # tokens are passed on before their document ends
        paths.append([(r["doc_id"], r["tok_idx"], r["label_idx"]) for r in X.viterbi(merged)])
    assert all(p == paths[0] for p in paths) and len(paths[0]) == len(want)


def _pieces(merged, batches):
    found = iter(batches)
    for step in merged.steps:
        found = step(found)
    return found


def test_kinds_of_moves_give_the_same_paths():
    rng = np.random.default_rng(6)
    names = X.class_names()
    start, move, end = X.legal_moves(names)
    scores = np.round(rng.normal(size=(60, K)), 1)  # with ties
    got = X.best_paths(scores, np.array([0, 25]), np.array([25, 35]), (start, move, end))
    for a, n in ((0, 25), (25, 35)):
        now, back = scores[a] + start, []
        for t in range(1, n):
            reach = now[:, None] + move
            back.append(reach.argmax(axis=0))
            now = reach.max(axis=0) + scores[a + t]
        path = [int((now + end).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert got[a:a + n].tolist() == path[::-1]

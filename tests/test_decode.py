import itertools

from pyspark.sql import functions as F

import brute
from veilspark.operators import decode as X
from veilspark.plans.fixtures import BIOES_CASES


def _labels_df(spark, cases):
    rows = [(cid, i, s, e, lab) for cid, items in cases for i, (s, e, lab) in enumerate(items)]
    return spark.createDataFrame(rows, "doc_id long, tok_idx int, tok_start int, tok_end int, label string")


def _decode(spark, cases, allowed=None):
    got = X.bioes_spans(_labels_df(spark, cases), allowed).collect()
    return {r.doc_id: [(s.label, s.start, s.end) for s in r.spans] for r in got}


def test_bioes_merge(spark):
    case = [(1, ((2, 4, "B-secret"), (5, 7, "I-secret"), (8, 12, "E-secret"), (20, 21, "S-private_url")))]
    assert _decode(spark, case)[1] == [("secret", 2, 12), ("private_url", 20, 21)]


def test_bioes_fixture_cases_match_sequential_rules(spark):
    allowed = ["secret", "private_person", "private_email", "private_phone", "private_date", "private_address", "private_url"]
    got = _decode(spark, BIOES_CASES, allowed)
    for cid, items in BIOES_CASES:
        assert got.get(cid, []) == brute.bioes_spans(items, set(allowed)), cid


def test_bioes_exhaustive_short_sequences(spark):
    labels = ["O", "B-a", "I-a", "E-a", "S-a", "B-b", "E-b", "I-b"]
    cases = []
    for n in (1, 2, 3):
        for seq in itertools.product(labels, repeat=n):
            cases.append((len(cases), tuple((i * 2, i * 2 + 1, lab) for i, lab in enumerate(seq))))
    got = _decode(spark, cases, ["a"])
    for cid, items in cases:
        assert got.get(cid, []) == brute.bioes_spans(items, {"a"}), items


def test_split_bioes(spark):
    df = spark.createDataFrame([("O",), ("b-x",), ("S-private_url",), ("private_url",), ("Q-z",)], "label string")
    got = [(r.s.tag, r.s.entity) for r in df.select(X.split_bioes("label").alias("s")).collect()]
    assert got == [(None, None), ("B", "x"), ("S", "private_url"), ("S", "private_url"), ("S", "Q-z")]


def test_fallback_alignment(spark):
    labels = spark.createDataFrame([(1, 0, "Mira", "B-private_person"), (1, 1, " Voss", "E-private_person"),
                                    (1, 2, " wrote", "O"), (1, 3, " mv@post.example", "S-private_email")],
                                   "doc_id long, tok_idx int, piece string, label string")
    text = "On Monday Mira Voss wrote: mv@post.example"
    r = X.fallback_spans(labels, spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s.label, text[s.start:s.end]) for s in r.spans] == [("private_person", "Mira Voss"), ("private_email", "mv@post.example")]


def test_window_merge_single_window_is_identity(spark):
    df = spark.createDataFrame([(1, 0, 0, [-0.5, -1.2])], "doc_id long, window_id long, tok_idx int, logprob array<double>")
    got = X.merge_windows(df).first().score
    assert abs(got[0] + 0.5) < 1e-12 and abs(got[1] + 1.2) < 1e-12


def test_window_merge_two_windows_log_mean_exp(spark):
    import math
    df = spark.createDataFrame([(1, 0, 3, [-1.0, -2.0]), (1, 1, 3, [-3.0, -2.0])],
                               "doc_id long, window_id long, tok_idx int, logprob array<double>")
    got = X.merge_windows(df).first().score
    assert abs(got[0] - math.log((math.exp(-1) + math.exp(-3)) / 2)) < 1e-12
    assert abs(got[1] + 2.0) < 1e-12


def test_log_softmax_and_argmax(spark):
    df = spark.createDataFrame([(1, 0, 0, [1.0, 3.0, 3.0])], "doc_id long, window_id long, tok_idx int, logits array<double>")
    lp = X.log_softmax(df)
    v = lp.first().logprob
    assert abs(sum(math_exp(x) for x in v) - 1.0) < 1e-12
    best = X.argmax_labels(lp.select("doc_id", "tok_idx", F.col("logprob").alias("score"))).first()
    assert best.label_idx == 1


def math_exp(x):
    import math
    return math.exp(x)


def test_viterbi_legal_path(spark):
    # arg-max would give I-x at token 0 (an illegal start); Viterbi must not
    names = X.class_names()
    rows = []
    for t in range(2):
        vec = []
        for n in names:
            if (t == 0 and n == "I-private_email") or (t == 1 and n == "E-private_email"):
                vec.append(0.0)
            elif t == 0 and n == "B-private_email":
                vec.append(-0.1)
            else:
                vec.append(-5.0)
        rows.append((1, t, vec))
    m = spark.createDataFrame(rows, "doc_id long, tok_idx int, score array<double>")
    path = [names[r.label_idx] for r in X.viterbi(m).orderBy("tok_idx").collect()]
    assert path == ["B-private_email", "E-private_email"]


def test_overlap_join_no_duplicates(spark):
    toks = spark.createDataFrame([(1, i, i * 10, i * 10 + 9) for i in range(30)], "doc_id long, tok_idx int, tok_start int, tok_end int")
    spans = spark.createDataFrame([(1, "s1", 1, "EMAIL", 5, 150)], "doc_id long, span_id string, rule int, label string, start int, end int")
    got = sorted(r.tok_idx for r in X.overlap_join(toks, spans).collect())
    assert got == list(range(0, 15))


def test_window_merge_mask_negative_position_and_minus_infinity(spark):
    low = float("-inf")
    df = spark.createDataFrame([(1, 0, 3, True, [low, -2.0]), (1, 1, 3, True, [low, -2.0]), (1, 2, 3, False, [0.0, 0.0]),
                                (1, 0, -1, True, [0.0, 0.0]), (1, 0, 4, None, [0.0, 0.0])],
                               "doc_id long, window_id long, tok_idx int, mask boolean, logprob array<double>")
    row, = X.merge_windows(df).collect()
    assert row.tok_idx == 3 and row.score[0] == low and abs(row.score[1] + 2.0) < 1e-12


def test_greedy_selection_equals_pairwise_definition(spark):
    import random
    rnd = random.Random(6)
    rows = [(d, [(rnd.choice("ab"), s, s + rnd.randint(0, 6)) for s in (rnd.randint(0, 20) for _ in range(rnd.randint(0, 9)))]) for d in range(200)]
    df = spark.createDataFrame(rows, f"doc_id long, spans {X.SPAN_T}")
    got = {r.doc_id: ([tuple(x) for x in r.a], [tuple(x) for x in r.b]) for r in df.select(
        "doc_id", X.select_non_overlapping(F.col("spans")).alias("a"), X.discard_overlapping_by_label(F.col("spans")).alias("b")).collect()}

    def keep(spans, by_label):
        out = []
        for s in sorted(spans, key=lambda s: (s[1], s[1] - s[2])):
            if not any(k[1] < s[2] and s[1] < k[2] and (not by_label or k[0] == s[0]) for k in out):
                out.append(s)
        return out

    assert got == {d: (keep(x, False), keep(x, True)) for d, x in rows}


def test_span_queries_shuffle_no_text(spark):
    from veilspark.sources.tables import table
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    plan = X.rule_spans_as_categories(docs).select("doc_id", X.select_non_overlapping(F.col("spans")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan

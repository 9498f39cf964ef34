"""Removed bytes against a dictionary of all windows."""
import hashlib
import random

import numpy as np
import pyarrow as pa

from veilspark.llm import bwt_merge as B
from veilspark.llm.words import Texts
from veilspark.session import scratch_folders


def brute(rows, length=50):
    least = {}
    raw = [(B.LAST if d is None else d, (t or "").encode()) for d, t in rows]
    for d, t in raw:
        for i in range(len(t) - length + 1):
            w = t[i:i + length]
            least[w] = min(least.get(w, B.LAST), d)
    out = []
    for (own, _), (d, t) in zip(rows, raw, strict=True):
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if least[t[i:i + length]] < d:
                gone[i:i + length] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((own, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "of", "ß", "über", "tion", "and", "x", "lorem", "日本"]) + rnd.choice(["", "a", "er", "ing"])
    passages = [" ".join(word() for _ in range(rnd.randint(8, 40))) for _ in range(8)]
    rows = []
    for d in range(n):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            p = rnd.choice(passages)
            kind = rnd.randint(0, 3)
            parts.append(p if kind == 0 else p[rnd.randint(0, 20):] if kind == 1 else " ".join(word() for _ in range(rnd.randint(1, 30))) if kind == 2 else "ab " * rnd.randint(1, 60))
        rows.append((d * 3, " ".join(parts)))
    rows += [(7, rows[3][1]), (7, rows[4][1]), (7, rows[4][1]), (None, rows[5][1]), (None, rows[6][1]), (200, None), (201, ""), (202, "short"), (203, "z" * 49), (204, "z" * 50), (205, "z" * 200)]
    return rows


def test_windows_of_merged_shards():
    rnd = random.Random(1)
    for _ in range(30):
        strings = ["".join(rnd.choices("ab", k=rnd.randint(1, 30))).encode() for _ in range(rnd.randint(1, 25))]
        docs = np.array([rnd.randint(0, 9) for _ in strings])
        least = {}
        for s, d in zip(strings, docs):
            for i in range(len(s) - 5):
                least[s[i:i + 6]] = min(least.get(s[i:i + 6], 99), d)
        for shards in (1, 3):
            string, offset, low = B.repeated_windows(strings, docs, 6, shards)
            got = {(s, o): x for s, o, x in zip(string.tolist(), offset.tolist(), low.tolist())}
            assert got == {(k, i): least[s[i:i + 6]] for k, s in enumerate(strings) for i in range(len(s) - 5)}


def test_stretches_do_not_depend_on_chunks():
    texts = Texts(pa.array([t for _, t in corpus(3, 120)]))
    whole = [x.tolist() for x in B.stretches(texts)]
    size = B.CHUNK
    try:
        for B.CHUNK in (1, 7, 333):
            assert [x.tolist() for x in B.stretches(texts)] == whole
    finally:
        B.CHUNK = size


def test_equal_to_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS h", "'c' AS gone")
        got = B.remove_repeats(df.repartition(4)).collect()
        assert sorted([tuple(r) for r in got], key=repr) == brute(rows)
        assert sum(r.n_removed for r in got) > 0


def test_empty(spark):
    assert B.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_move_once(spark):
    rows = corpus(4) + [(None, "copied passage that many rows without a number hold, more than fifty bytes of it")] * 30
    before = list(scratch_folders())
    out = B.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted([tuple(r) for r in out.collect()], key=repr) == brute(rows)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1  # the second join reads the texts that the first one moved
    assert scratch_folders() == before  # and nothing is written besides


def test_dealt_stretches_are_small():
    rnd = np.random.default_rng(5)
    for ids in (np.repeat(np.arange(700, 1100), 3), np.repeat(rnd.integers(-2**63, 2**63 - 1, 400), 3), np.array([5, 5, -2**63, B.LAST, 5])):
        n = len(ids)
        anchor, own = (rnd.integers(0, 2**64, n, dtype=np.uint64) for _ in range(2))
        at = np.cumsum(rnd.integers(1, 100, n))
        blob = B._dealt_blob(ids, anchor, own, at)
        got = B._from_dealt_blob(blob)
        want = (ids, anchor & np.uint64(2**32 - 1), own & np.uint64(2**48 - 1), at)
        assert all(g.tolist() == w.tolist() for g, w in zip(got, want, strict=True))
        assert n < 10 or len(blob) <= 4 + 18 * n  # 22 bytes each before
    number, mark = B._from_marks_blob(B._marks_blob(at, np.ones(n, dtype=np.uint8)))
    assert number.tolist() == at.tolist() and mark.tolist() == [1] * n

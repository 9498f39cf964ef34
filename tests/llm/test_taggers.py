"""The two chain taggers: forward-backward against all paths, held-out accuracy, odd rows."""
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import language_tags as L
from veilspark.llm import toxic_spans as T
from veilspark.llm import chain_crf
from veilspark.llm.chain_crf import ChainCRF


@pytest.mark.parametrize("segment", [128, 2, 3])
def test_marginals_against_all_paths(monkeypatch, segment):
    monkeypatch.setattr(chain_crf, "SEGMENT", segment)
    rng = np.random.default_rng(0)
    crf = ChainCRF(3, 1)
    crf.start, crf.move = rng.normal(size=3), rng.normal(size=(3, 3))
    lengths = np.array([4, 1, 6, 2])
    starts = np.cumsum(lengths) - lengths
    scores = rng.normal(size=(lengths.sum(), 3))
    post, _, pairs = crf.marginals(scores, starts, lengths, counts=True)
    want_pairs = np.zeros((3, 3))
    for s, n in zip(starts, lengths):
        total, own = 0.0, np.zeros((n, 3))
        own_pairs = np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(crf.start[path[0]] + sum(scores[s + i, p] for i, p in enumerate(path)) + sum(crf.move[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, p in enumerate(path):
                own[i, p] += w
            for a, b in zip(path, path[1:]):
                own_pairs[a, b] += w
        assert np.allclose(post[s:s + n], own / total)
        want_pairs += own_pairs / total
    assert np.allclose(pairs, want_pairs)


WORDS = {"en": ["the", "walking", "house", "thought", "ing"], "de": ["der", "straße", "schön", "nicht", "ung"], "fr": ["être", "maison", "quelle", "leçon", "eaux"]}


def language_rows():
    rnd = random.Random(1)
    rows = []
    for d in range(240):
        lang = ("en", "de", "fr")[d % 3]
        rows.append((d, " ".join("".join(rnd.choices(WORDS[lang], k=rnd.randint(1, 2))) for _ in range(rnd.randint(5, 30))) + ".", lang))
    return rows


def test_language(spark):
    odd = [(1000, None, "en"), (1001, "", None), (1002, "12 3 -- !", None), (None, "the house", "en"), (1003, "the house", None)]
    df = spark.createDataFrame(language_rows() + odd, "doc_id long, text string, lang string").selectExpr("*", "1 AS accepted", "'x' AS lang_pred").repartition(3)
    found = L.identify(df.select("doc_id", "text"), L.fit(df)).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == 245
    wrong = [d for d, _, lang in language_rows() if by[d].lang_pred != lang]
    assert len(wrong) <= 2
    assert all(by[d].lang_pred == L.UNKNOWN and by[d].score == 0 for d in (1000, 1001, 1002))
    assert all(0 <= r.score <= 1 for r in found)
    kept = L.accepted(df)
    assert kept.columns == df.columns and {1000, 1001, 1002}.isdisjoint({r.doc_id for r in kept.collect()})


def test_mixed_texts_are_accepted(spark):
    rnd = random.Random(9)
    rows = language_rows()
    langs = sorted({lang for _, _, lang in rows})
    mixed = []
    for d in range(2000, 2010):
        parts = [" ".join("".join(rnd.choices(WORDS[lang], k=2)) for _ in range(12)) + "." for lang in langs]
        mixed.append((d, " ".join(parts), None))
    df = spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string").repartition(3)
    found = {r.doc_id: r for r in L.identify(df, L.fit(df)).collect() if r.doc_id >= 2000}
    assert all(r.lang_pred != L.UNKNOWN for r in found.values()) and min(r.score for r in found.values()) < 0.5
    assert set(found) <= {r.doc_id for r in L.accepted(df).collect()}


def test_language_without_training_rows(spark):
    df = spark.createDataFrame([(2, "a b", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in L.identify(df, L.fit(df)).collect()] == [(2, L.UNKNOWN, 0.0)]
    assert L.identify(df.limit(0), L.fit(df.limit(0))).count() == 0


def toxic_rows():
    rnd = random.Random(2)
    rows = []
    for d in range(600):
        words = ["".join(rnd.choices(["ba", "do", "ki", "lu", "mer", "sta"], k=rnd.randint(1, 4))) for _ in range(rnd.randint(20, 80))]
        toxic = d % 5 == 0
        if toxic:
            for _ in range(4):
                words[rnd.randrange(len(words))] = rnd.choice(["vexo", "grumph"]) + rnd.choice(["", "lu", "mer", "ki!"])
        rows.append((d, " ".join(words), int(toxic)))
    return rows


def test_toxicity(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows] + [(5000, None), (5001, ""), (None, "bado"), (5002, "ba " * 20000)], "doc_id long, text string").selectExpr("*", "1 AS toxic", "2 AS score").repartition(3)
    labels = spark.createDataFrame([(d, x) for d, _, x in rows] + [(None, 1), (7, None), (9999, 1), (1, 0), (1, 0)], "doc_id long, toxic int")
    found = T.score_documents(docs, T.fit(docs, labels)).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == 604
    held = {r.doc_id for r in docs.where(T.held_out(F.col("doc_id"))).select("doc_id").collect()}
    mine = [(by[d].score >= T.THRESHOLD, bool(x)) for d, _, x in rows if d in held]
    assert len(mine) > 100 and sum(a == b for a, b in mine) / len(mine) >= 0.97
    assert all(0 <= r.score <= 1 for r in found) and all(by[d].score < T.THRESHOLD for d in (5000, 5001, 5002))
    text = {d: t for d, t, _ in rows}
    spans = [text[r.doc_id].encode()[s.start:s.stop].decode() for r in found if r.doc_id in held and r.doc_id % 5 == 0 for s in r.spans]
    assert spans and sum(("vexo" in s) or ("grumph" in s) for s in spans) / len(spans) > 0.9


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [tuple(r) for r in T.score_documents(docs, T.fit(docs, none)).collect()] == [(1, 0.0, [])]


def test_toxicity_fit_sees_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(T, "ToxicModel", lambda rows: rows)
    texts = ["bado " * 5000 + "vexo", "kilu " * 6000 + "mer"]
    rows = [(d, texts[d % 2], d % 2) for d in range(20)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([r[::2] for r in rows], "doc_id long, toxic int")
    seen = T.fit(docs, labels)
    assert {t for _, t in seen} == set(texts)


def test_long_chains_keep_their_state(monkeypatch):
    rng = np.random.default_rng(3)
    crf = ChainCRF(4, 1)
    crf.start, crf.move = rng.normal(size=4), 3 * rng.normal(size=(4, 4))
    lengths = np.array([1000, 1, 129, 128, 700, 257])
    starts = np.cumsum(lengths) - lengths
    scores = rng.normal(size=(lengths.sum(), 4))
    got = crf.marginals(scores, starts, lengths, counts=True)
    monkeypatch.setattr(chain_crf, "SEGMENT", 5000)
    for a, b in zip(got, crf.marginals(scores, starts, lengths, counts=True)):
        assert np.allclose(a, b)


def test_whole_words_are_features():
    long = "a" * 60
    assert T.word_features(long + "x")[1] != T.word_features(long + "y")[1]
    assert set(L.word_features(long + "xyz", {})) != set(L.word_features(long + "xyw", {}))


def test_training_reads_beyond_the_beginning_and_the_middle(spark):
    # the only German words stand at the end of long texts
    rows = [(d, "12 " * 4000 + "der nicht straße schön ung " * 20, "de") for d in range(30)]
    rows += [(100 + d, "the walking house thought ing " * 20, "en") for d in range(30)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), words=240_000)
    assert model.lexicon.get("straße") == "de" and model.lexicon.get("house") == "en"


def test_missing_ids_are_not_held_out(spark):
    df = spark.createDataFrame([(None,), (1,)], "doc_id long")
    assert df.select(T.held_out(F.col("doc_id")).alias("x"), L.training_rows(F.col("doc_id")).alias("y")).where("x IS NULL OR y IS NULL").count() == 0

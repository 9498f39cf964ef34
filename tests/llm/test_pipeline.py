"""The pipeline's stages against brute force, on a small documents table."""
import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as C
import test_ngram_join
import test_source_mixing
from veilspark.llm import source_mixing as M

WORDS = {"en": "the of and house tree walking because would there thing".split(), "de": "der die und ung schön straße ich nicht über werden".split()}


def documents():
    rnd = random.Random(11)
    rows = []
    for d in range(120):
        lang = "en" if d % 3 else "de"
        text = " ".join(rnd.choice(WORDS[lang]) + rnd.choice(["", "s", "e"]) for _ in range(rnd.randint(6, 60)))
        rows.append([d, text, lang, f"src{d % 5}", len(text)])
    rows[50][1] = rows[10][1] + "  "
    rows[50][2] = rows[10][2]
    rows[51][1], rows[51][2] = rows[10][1].replace(" ", "\n"), rows[10][2]
    long = " ".join(rnd.choice(WORDS["en"]) + str(k % 7) for k in range(200))
    rows[60][1], rows[61][1] = long, long.rsplit(" ", 1)[0] + " other"
    rows += [[200, None, "en", "src1", 0], [201, "", "en", "src1", 0], [202, "12 34 ...", None, None, 3], [203, "the house and the tree", None, None, 5]]
    return rows


def test_stages(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    by_id = {r[0]: r for r in rows}
    ids = lambda df: {r.doc_id for r in df.collect()}

    step = C.language(spark, docs, str(tmp_path))
    assert step.columns == docs.columns and ids(step) == set(by_id) - {200, 201, 202}
    step = C.written(step, "a")
    step2 = C.written(C.exact_copies(spark, step, str(tmp_path)), "b")
    first = {}
    for d in sorted(ids(step)):
        first.setdefault(" ".join(by_id[d][1].split(" ")).replace("\n", " ").replace("  ", " "), d)
    assert ids(step2) == set(first.values())
    step3 = C.written(C.near_copies(spark, step2, str(tmp_path)), "c")
    left = [(d, by_id[d][1]) for d in sorted(ids(step2))]
    assert ids(step3) == {d for d, c, _ in test_ngram_join.brute(left) if c == d} and 61 not in ids(step3)
    step4 = C.written(C.mixture(spark, step3, str(tmp_path)), "d")
    want, _ = test_source_mixing.brute([(d, by_id[d][3], by_id[d][2], by_id[d][1]) for d in sorted(ids(step3))], M.WEIGHTS, C.MIX_PERCENT, 1, M.SEED)
    assert ids(step4) == {w[0] for w in want} and step4.columns == docs.columns
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = {(d, hashlib.sha256(np.array(tok.encode(by_id[d][1], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for d in ids(step4)}
    assert {(r.doc_id, r.ids_sha256) for r in C.run(spark, str(tmp_path)).collect()} == expected


def test_copies_with_repeated_and_missing_ids(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"w{k % 97}x{k % 13}" for k in range(200))
    rows = [(d, f"the house {d} and {d * d} trees " * 3, "en", f"src{d % 3}", 5) for d in range(20)]
    rows += rows + [(None, "one text", "en", "src1", 8)] * 30 + [(7, "another text of seven", "en", "src1", 9)]
    rows += [(None, long + " a", "en", "src2", 1), (None, long + " b", "en", "src2", 1), (40, long + " c", "en", "src2", 1), (40, long + " d", "en", "src2", 1)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    step = C.written(C.exact_copies(spark, docs, ""), "a")
    assert sorted(map(tuple, step.collect()), key=repr) == sorted(set(rows), key=repr)
    near = C.written(C.near_copies(spark, step, ""), "b")
    left = [tuple(r) for r in near.collect()]
    assert len(left) == len(set(rows)) - 3 and sum(r[1].startswith(long) for r in left) == 1
    assert [r[0] for r in left if r[1].startswith(long)] == [40]
    # of two rows with one id the mix takes one if only that one's leaf has weight
    two = spark.createDataFrame([(1, "a b c", "en", "src0", 5), (1, "d e f", "de", "src0", 5)], schema)
    assert [r.text for r in M.chosen(two, percent=100, max_epochs=1, weights={"lang": {"en": 1, "de": 0}}).collect()] == ["a b c"]


def test_empty_table_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_key long, accepted string"
    empty = spark.createDataFrame([], schema)
    for name, stage in C.STAGES[:-1]:
        got = stage(spark, empty, "")
        assert got.count() == 0 and got.columns == empty.columns, name
    assert C.STAGES[-1][1](spark, empty, "").count() == 0
    rows = [(d, f"the house {d} and the {d * d} trees of words " * 4, "en", f"src{d % 3}", 5, 7, "no") for d in range(12)]
    docs = spark.createDataFrame(rows + [(50, rows[0][1], "en", "src0", 5, 8, "x")], schema)
    for name, stage in C.STAGES[:3]:
        docs = C.written(stage(spark, docs, ""), name)
        assert docs.columns == empty.columns
    assert sorted(map(tuple, docs.collect())) == sorted(rows)
    assert C.STAGES[3][1](spark, docs, "").columns == empty.columns

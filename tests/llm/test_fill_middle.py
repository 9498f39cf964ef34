"""Fill-in-the-middle against plain slicing, and an exact round trip."""
import hashlib
import random

import pyarrow as pa
from pyspark.sql import functions as F

from veilspark.llm import fill_middle as M


def brute(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def rows():
    r = random.Random(4)
    out = [(None, "no id"), (None, None), (-7, ""), (3, None), (9, "a"), (9, "a"), (10, "x<S>y"), (11, "<<P"), (12, "P><S<M"), (13, "😀" * 9)]
    out += [(k, "".join(r.choice("aé日😀 \n<>PSM\0") for _ in range(r.randrange(40)))) for k in range(100, 400)]
    return out + [(500, "añ日😀" * 250_000)]  # several segments


def test_equal_to_slicing_and_back(spark):
    given = rows()
    df = spark.createDataFrame(given, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("form", F.lit(1))
    out = M.fill_in_middle(df.repartition(3))
    got = out.withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    want = sorted((brute(*g) for g in given), key=repr)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr) == want
    assert sorted(r.back for r in got) == sorted(g[1] or "" for g in given)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_segments_of_a_long_text_are_cut_like_the_whole():
    text = "aé日😀b" * 41
    whole = pa.array([text], pa.large_string())
    for size in (4, 5, 17, 1000):
        for a, b in ((0, 0), (0, 205), (7, 7), (50, 101), (205, 205)):
            got = M._pieces(whole, pa.array([a]), pa.array([b]), size)
            assert [p[0].as_py() for p in got] == [text[:a], text[a:b], text[b:]]


def test_other_marks_and_empty_table(spark):
    marks = M.Sentinels("[pre]", "[suf]", "[mid]")
    df = spark.createDataFrame([(k, f"text <P> number {k}") for k in range(50)] + [(99, "a [mid] b")], "doc_id long, text string")
    out = M.fill_in_middle(df, seed=7, sentinels=marks, cut_percent=100, suffix_first_percent=50)
    got = out.withColumn("back", M.restored(F.col("output"), F.col("form"), marks)).collect()
    assert sorted(r.back for r in got) == sorted(r.text for r in df.collect())
    assert {r.form for r in got if r.doc_id != 99} == {"psm", "spm"} and {r.form for r in got if r.doc_id == 99} == {"plain"}
    assert M.fill_in_middle(df.limit(0)).count() == 0

"""Block naming against a plain dictionary of normalised texts."""
import hashlib
import re

from pyspark.sql import functions as F

from veilspark.llm import block_naming as B


def brute(rows):
    norm = {k: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for k, (_, t) in enumerate(rows)}
    groups = {}
    for k, (d, _) in enumerate(rows):
        groups.setdefault(norm[k], []).append(d)
    out = []
    for k, (d, _) in enumerate(rows):
        g = [x for x in groups[norm[k]] if x is not None]
        out.append((d, min(g) if g else None, len(groups[norm[k]]), hashlib.sha256(norm[k].encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, "a  b"), (2, "a b"), (3, None), (4, ""), (5, "x" * 100), (6, "x" * 100), (7, "x" * 99), (8, "x" * 96 + "yyyy"),
        (9, "é" * 50), (10, "é" * 50), (11, " \t\n"), (12, " "), (None, "a b"), (13, "ab" * 60), (14, "ab" * 60),
        (15, "ab" * 59 + "ba"), (16, "y" * 8 + "x" * 92), (0, "x" * 100)]


def run(spark, **k):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("name", F.lit("clash")).withColumn("h", F.lit(1))
    return B.copies(df.repartition(3), **k).collect()


def test_small_blocks_and_forced_hash_clashes(spark):
    for k in ({"block_bytes": 8}, {"block_bytes": 7, "hash_values": 3}, {"block_bytes": 8192}):
        got = run(spark, **k)
        assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == brute(ROWS), k
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got if r.doc_id is not None)


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert B.copies(empty).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "doc_id long, text string")
    got = B.copies(twice).collect()
    assert sum(r.kept for r in got) == 1 and {r.group_size for r in got} == {3}
    assert sorted(r.doc_id for r in B.drop_copies(twice).collect()) == [1, 1]

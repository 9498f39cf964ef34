from pyspark.sql import functions as F

from veilspark.operators.quality import contained_passages


def test_passages_of_every_length(spark):
    docs = [(1, "one two three four five six seven eight"), (2, "xone twox, three"), (3, "a"), (4, ""), (5, None), (6, "six seven eight nine one two three four")]
    found = ["one", "x", "e t", "two three", "one two three", "three four five six", "two three four five six seven", "ne two three four five six seven eig", "zebra", "", "a"]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    p = spark.createDataFrame(list(enumerate(found)) + [(99, None)], "item_id long, text string")
    out = contained_passages(d, p)
    got = sorted((r.doc_id, r.item_id) for r in out.collect())
    assert got == sorted((i, k) for i, t in docs if t is not None for k, x in enumerate(found) if x in t)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where(F.col("passage").isNull()).count() == 0

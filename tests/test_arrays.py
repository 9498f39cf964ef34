"""Running results over arrays against plain loops."""
import itertools
import random

from pyspark.sql import functions as F

from veilspark.functions import arrays as A

R = random.Random(2)
LISTS = [[], [5], [1, 2], [3, -1, 4], [R.randrange(-9, 9) for _ in range(31)], [R.randrange(-9, 9) for _ in range(64)], [R.randrange(99) for _ in range(65)]]


def test_running_results(spark):
    df = spark.createDataFrame([(v,) for v in LISTS], "v array<int>")
    rows = df.select("v", A.running_sum(F.col("v")).alias("s"), A.running(F.col("v"), lambda a, b: F.greatest(a, b)).alias("m"),
                     A.running_back(F.col("v"), lambda a, b: F.least(a, b)).alias("b")).collect()
    for r in rows:
        assert r.s == list(itertools.accumulate(r.v)) and r.m == list(itertools.accumulate(r.v, max))
        assert r.b == list(itertools.accumulate(r.v[::-1], min))[::-1]


def test_order_is_kept(spark):
    # a product that does not commute: functions x -> greatest(x + b, a)
    pairs = [[(R.randrange(-5, 5), R.randrange(-5, 5)) for _ in range(n)] for n in (1, 2, 7, 40)]
    df = spark.createDataFrame([(p,) for p in pairs], "v array<struct<a:int,b:int>>")

    def then(f, g):
        return F.struct(F.greatest(g["a"], f["a"] + g["b"]).alias("a"), (f["b"] + g["b"]).alias("b"))
    for r in df.select("v", A.running(F.col("v"), then).alias("s")).collect():
        x, want = 0, []
        for f in r.v:
            x = max(f.a, x + f.b)
            want.append(x)
        assert [max(f.a, f.b) for f in r.s] == want


def test_first_after(spark):
    rows = [(sorted(v), x) for v in LISTS for x in (-10, -1, 0, 4, 5, 200)]
    df = spark.createDataFrame(rows, "v array<int>, x int")
    for r in df.select("*", A.first_after(F.col("v"), F.col("x"), True).alias("a"), A.first_after(F.col("v"), F.col("x"), False).alias("b")).collect():
        assert r.a == next((i for i, y in enumerate(r.v) if y >= r.x), len(r.v))
        assert r.b == next((i for i, y in enumerate(r.v) if y > r.x), len(r.v))


def test_chains(spark):
    rows = []
    for n in (1, 2, 3, 17, 64, 100):
        following = [R.randrange(i + 1, n + 4) for i in range(n)]
        rows.append((following, sorted({0, R.randrange(n)})))
    df = spark.createDataFrame(rows, "f array<int>, s array<int>")
    for r in df.select("*", A.chain(F.col("f"), F.col("s")).alias("c")).collect():
        want = set()
        for i in r.s:
            while i < len(r.f):
                want.add(i)
                i = r.f[i]
        assert r.c == sorted(want)

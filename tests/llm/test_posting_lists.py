"""Search over posting lists against brute force."""
import numpy as np
from pyspark.sql import functions as F

from veilspark.llm import posting_lists as P


def brute(rows, k=20, step=20):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, dtype=np.float32).astype(np.float64)
    out = {}
    for q in good:
        if q % step == 0:
            near = sorted((-(good[q] * v).sum(), i) for i, v in good.items() if i != q)[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS list", "2 AS score", "3 AS id")


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for q, near in want.items():
        mine = sorted(found.get(q, []))
        assert [m[0] for m in mine] == list(range(1, len(near) + 1))
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        hit += len({m[1] for m in mine} & {i for i, _ in near})
        total += len(near)
    return hit / total


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(2500, 16)) * rng.uniform(0.2, 3, size=(2500, 1)) + rng.normal(size=(10, 16))[rng.integers(0, 10, 2500)] * 2
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    got = P.search(frame(spark, rows).repartition(3), F.col("vec_id") % 20 == 0, block_rows=100).collect()
    want = brute(rows)
    assert recall(got, want) >= 0.9
    exact = {i: np.array(v, dtype=np.float32).astype(np.float64) for i, v in rows}
    assert all(abs(r.score - exact[r.query_id] @ exact[r.vec_id]) < 1e-9 for r in got)


def test_copies_ties_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(120)] + [(i, [float(i % 7) - 3, 1.0, float(i % 3)]) for i in range(120, 200)]
    rows += [(200, None), (220, []), (240, [0.0, 0.0, 0.0]), (260, [nan, 1.0, 1.0]), (280, [inf, 1.0, 1.0]), (300, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    got = P.search(frame(spark, rows).repartition(3), F.col("vec_id") % 20 == 0, block_rows=30, recall=1.0).collect()
    want = brute(rows)
    mine = {q: [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] for q in want}
    assert mine == want and {r.query_id for r in got} == set(want)


def test_few_and_none(spark):
    assert P.search(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    got = P.search(frame(spark, [(0, [1.0]), (1, [2.0]), (2, [-1.0])]), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got)] == [(0, 1, 1, 2.0), (0, 2, 2, -1.0)]


def test_graph_walk_finds_all_centroids():
    index = P.Index(np.random.default_rng(0).normal(size=(1000, 8)), 5.0)
    ids, dist = index.nearest(index.aimed(np.random.default_rng(1).normal(size=(50, 8))), len(index.centres))
    assert (np.sort(ids, axis=1) == np.arange(len(index.centres))).all() and (np.diff(dist, axis=1) >= 0).all()


def test_every_query_reaches_enough_vectors():
    rng = np.random.default_rng(5)
    for n in range(2, 200):
        data = rng.normal(size=(n, 6)) * rng.choice([0.1, 1, 30], size=(n, 1))
        index = P.Index(data, np.linalg.norm(data, axis=1).max())
        row, lists = index.lists_of(data)
        homes = np.bincount(lists[:n], minlength=len(index.centres))
        asked, searched = index.probes(data, homes)
        for q in range(n):
            found = set(row[np.isin(lists, searched[asked == q])].tolist()) - {q}
            assert len(found) >= min(20, n - 1), (n, q)


def test_a_walk_leaves_centroids_out():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 12)) * 4
    data = centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 12))
    index = P.Index(data, np.linalg.norm(data, axis=1).max(), lists=512)
    queries = data[:200]
    ids, _ = index.nearest(index.aimed(queries), max(P.BEAM, 512 // P.BEAM_SHARE))
    assert (ids >= 0).sum(axis=1).max() <= 128
    row, lists = index.lists_of(data)
    homes = np.bincount(lists[:6000], minlength=512)
    asked, searched = index.probes(queries, homes)
    hit = 0
    for q in range(200):
        mine = np.unique(row[np.isin(lists, searched[asked == q])])
        score = data @ queries[q]
        score[q] = -np.inf
        hit += len(set(np.argsort(-score)[:20]) & set(mine.tolist()))
    assert hit / 4000 >= 0.9 and len(searched) < 200 * 256


def test_products_beyond_single_precision(spark):
    rows = [(i, [3e38 if i == 5 else float(i), 1.0]) for i in range(60)]
    got = P.search(frame(spark, [(i, [3e30 if i == 0 else v[0], 1.0]) for i, v in rows]), F.col("vec_id") % 20 == 0).where("query_id = 0 AND rank <= 2").collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 5), (2, 59)]


def test_all_neighbours_of_small_tables(spark):
    rng = np.random.default_rng(9)
    for n in (16, 21, 45):
        rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, 5)) * rng.choice([0.1, 5], size=(n, 1)))]
        got = P.search(frame(spark, rows), F.col("vec_id") % 20 == 0).groupBy("query_id").count().collect()
        assert {r.query_id: r["count"] for r in got} == {q: min(20, n - 1) for q in range(0, n, 20)}

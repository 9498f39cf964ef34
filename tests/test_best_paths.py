"""Best legal paths against all paths."""
import itertools

import numpy as np

from veilspark.operators import decode as X

NAMES = ["O", "B-a", "I-a", "E-a", "S-a", "B-b", "E-b"]


def test_against_all_paths():
    rng = np.random.default_rng(1)
    start, move, end = moves = X.legal_moves(NAMES)
    lengths = np.array([3, 1, 4, 2, 0, 4])
    starts = np.cumsum(lengths) - lengths
    scores = np.round(rng.normal(size=(lengths.sum(), len(NAMES))), 1)
    got = X.best_paths(scores, starts, lengths, moves)
    for s, n in zip(starts.tolist(), lengths.tolist()):
        best = max((sum(scores[s + i, p] for i, p in enumerate(path)) + start[path[0]] + end[path[-1]] + sum(move[a, b] for a, b in zip(path, path[1:]))
                    for path in itertools.product(range(len(NAMES)), repeat=n)), default=None) if n else None
        own = got[s:s + n].tolist()
        if n:
            assert np.isclose(sum(scores[s + i, p] for i, p in enumerate(own)), best)
            assert np.isfinite(start[own[0]] + end[own[-1]] + sum(move[a, b] for a, b in zip(own, own[1:])))


def test_no_legal_path_falls_back_to_the_largest_scores():
    moves = X.legal_moves(["B-a", "I-a"])
    scores = np.array([[0.0, 1.0], [2.0, 1.0]])
    assert X.best_paths(scores, np.array([0]), np.array([2]), moves).tolist() == [1, 0]


def test_documents_over_batch_borders(spark):
    rng = np.random.default_rng(4)
    rows = [(d, i, [float(x) for x in rng.normal(size=33)]) for d, n in ((1, 3), (2, 40), (3, 1), (4, 25)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, tok_idx int, score array<double>").repartition(3)
    found = []
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("1", "7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        found.append(sorted(tuple(r) for r in X.viterbi(df).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)

"""The similarity join against all pairs on small tables."""
import random

from veilspark.llm import ngram_join as J


def sh(text, n=5):
    w = (text or "").split()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, t=0.8):
    sets = [sh(x) for _, x in rows]
    link = [[i != j and bool(a and b) and len(a & b) >= t * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    out = []
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            k = todo.pop()
            for j, yes in enumerate(link[k]):
                if yes and j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((d, min(ids) if ids else None, sum(link[i])))
    return sorted(out, key=repr)


def corpus(seed=2, groups=10, size=8):
    rnd = random.Random(seed)
    rows, d = [], 0
    for _ in range(groups):
        base = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(12, 160))]
        for _ in range(size):
            own = list(base)
            for _ in range(rnd.randint(0, 4)):
                own[rnd.randrange(len(own))] = f"x{rnd.randint(0, 9)}"
            rows.append((d, " ".join(own)))
            d += 1
    rows += [(d, None), (d + 1, ""), (d + 2, "one two"), (d + 3, "one  two"), (d + 4, "a b c d"), (None, "a b c d"), (d + 5, "  \n"), (0, rows[0][1])]
    return rows


def test_bands():
    bands, rows = J.bands_for(0.8, 0.9999, 128)
    assert (bands, rows) == (24, 5) and 1 - (1 - 0.8 ** rows) ** bands >= 0.9999


def test_equal_to_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'c' AS label", "2 AS set_no")
    for block in (3, 256):
        got = J.join(df.repartition(3), block=block).collect()
        assert sorted([(r.doc_id, r.class_id, r.n_links) for r in got], key=repr) == brute(rows)


def test_one_large_group_of_near_copies(spark):
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for d in range(150):
        own = list(base)
        for _ in range(rnd.randint(0, 3)):
            own[rnd.randrange(90)] = f"x{d}"
        rows.append((d, " ".join(own)))
    got = J.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block=40).collect()
    assert sorted([(r.doc_id, r.class_id, r.n_links) for r in got], key=repr) == brute(rows)


def test_empty_and_kept(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert J.join(none).count() == 0 and J.drop_near_copies(none).count() == 0
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (2, "g h"), (4, None)]
    kept = J.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 4]

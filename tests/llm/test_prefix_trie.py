"""The conversation trie against plain dictionaries of prefixes."""
import hashlib
import random
import zlib

import numpy as np

from veilspark.llm import prefix_trie as P


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, len(text or ""), role or "", text or ""))
    convs = {c: [(r, t) for _, _, _, r, t in sorted(ts)] for c, ts in convs.items()}
    nodes = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        block = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        path = convs.get(block, [])[:h] + own[h:]
        for d in range(len(path) + 1):
            node = nodes.setdefault(tuple(path[:d]), {"members": [], "ends": [], "children": set()})
            node["members"].append(c)
            if d == len(path):
                node["ends"].append(c)
            if d:
                nodes[tuple(path[:d - 1])]["children"].add(tuple(path[:d]))

    def below(k):
        v = nodes[k]
        leaves, saved = (0, 0) if v["children"] else (1, 0)
        for child in v["children"]:
            more = below(child)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved + ((len(v["members"]) - 1) * len(k[-1][1]) if k else 0)
    return sorted((min(v["members"]), len(k), min(nodes[k[:-1]]["members"]) if k else -1, len(v["members"]), len(v["children"]), *below(k),
                   hashlib.sha256(",".join(map(str, sorted(v["ends"]))).encode()).hexdigest()) for k, v in nodes.items())


def check(spark, rows, partitions=4):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'clash' AS seq", "1 AS depth", "2 AS shard")
    got = P.conversation_trie(df.repartition(3)).collect()
    assert sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in got) == brute(rows)
    return got


def conversations(seed, convs, words, longest):
    r = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(r.randrange(1, longest)):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(words)))
    return rows


def test_equal_to_dictionaries_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(P, "FAN", 3)  # several merging rounds
    words = ["a", "bé", "c😀c", "", "long text " * 30]
    check(spark, conversations(1, range(220), words, 9), 20)
    check(spark, conversations(2, [100, 101, 102, 305, 306, 399, -3, -150], words[:2], 30), 11)


def test_hot_first_turn_copies_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 7)
    rows = [(c, t, "user", "the same") for c in range(120) for t in range(3)]
    rows += [(c, t, "user", "the same" if t == 0 else f"own {c} {t}") for c in range(120, 240) for t in range(4)]
    got = check(spark, rows, 9)
    assert max(r.n_convs for r in got if r.depth) >= 120


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(None, 1, "user", "lost"), (0, None, None, None), (0, 1, "user", "x"), (0, 1, "user", "x"), (0, 1, None, "longer"), (7, 3, "user", None),
            (207, 5, "user", "its block has no first conversation"), (5, None, None, None), (1000, 0, "", "")]
    check(spark, rows)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert P.conversation_trie(empty).count() == 0


def test_one_long_conversation(spark):
    check(spark, [(c, t, "user", f"turn {t % 3}") for c in (100, 101, 150) for t in range(300 + c)], 3)


def test_role_and_text_are_kept_apart(spark):
    got = check(spark, [(100, 0, "ab", "c"), (200, 0, "a", "bc"), (300, 0, "", "abc")])
    assert sum(r.depth == 1 for r in got) == 3


def test_double_array_holds_exactly_its_children():
    r, trie, states, want = random.Random(5), P.DoubleArray(50), [0], {}
    for _ in range(400):
        s = states.pop(r.randrange(len(states)))
        ids = sorted(r.sample(range(50), r.choice([1, 1, 2, 5, 30])))
        trie.add(s, ids)
        for i in ids:
            want[s, i] = int(trie.base[s] + i)
            states.append(want[s, i])
    assert len(set(want.values())) == len(want) and 0 not in want.values()
    for s in {s for s, _ in want}:
        got = trie.step(np.full(50, s), np.arange(50)).tolist()
        assert got == [want.get((s, i), -1) for i in range(50)]

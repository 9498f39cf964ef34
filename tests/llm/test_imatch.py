"""I-Match fingerprints against plain Python, runs of neighbours, and odd input."""
import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilspark.llm import imatch as I


def words(text):
    return list(dict.fromkeys(t for t in re.split(r"[^\w]+|_", text.lower()) if t))


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def brute_lexicon(texts):
    n = len(texts)
    counts = Counter(texts)
    texts = [t for t in texts if not (counts[t] > 1 and counts[t] * I.HEAVY > n)] + [t for t, c in counts.items() if c > 1 and c * I.HEAVY > n]
    df = Counter(w for t in texts for w in words(t))
    return {w for w, k in df.items() if k * I.RAREST >= len(texts) and (k * I.COMMONEST <= len(texts) or k == 1)}


def brute_print(text, lexicon):
    own = words(text)
    us = sorted(int(md5(w)[:15], 16) for w in own if w in lexicon)
    if not us:
        return "x" + md5(" ".join(sorted(own)) if own else text)
    levels = []
    for level in range(I.LEVELS):
        parts = [(lane, [u for u in us if u >> 55 == lane and u % 2 ** level == 0]) for lane in range(I.LANES)]
        levels.append(" ".join(f"{I._LANE_NAMES[lane]}{md5(','.join(map(str, part)))[:5]}" for lane, part in parts if part))
    return "|".join([md5(",".join(map(str, us))), *levels])


def brute_likeness(a, b):
    if a == b:
        return 1.0
    pairs = list(zip([x.split() for x in a.split("|")[1:]], [x.split() for x in b.split("|")[1:]]))
    if not pairs:
        return 0.0
    used = [len({m[0] for m in x + y}) for x, y in pairs]
    same = [len(set(x) & set(y)) for x, y in pairs]
    low = max((k for k in range(I.LEVELS) if used[k] >= I.ENOUGH), default=0)
    ks = [k for k in (low - 1, low) if k >= 0]
    return sum(same[k] for k in ks) / sum(used[k] for k in ks) if sum(used[k] for k in ks) else 0.0


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), reverse=True)
    lexicon = brute_lexicon([t for _, t in rows])
    out = []
    for k, (d, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        h = len(t) // 2
        edited = t[:len(t) - h] + nxt[:h]
        one, two, three = (brute_print(x, lexicon) for x in (t, edited, nxt))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), one, two, brute_likeness(one, two), brute_likeness(one, three)))
    return sorted(out)


def corpus(seed, ids):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgéñ日") for _ in range(r.randrange(1, 9))) for _ in range(3000)]
    return [(d, " ".join(r.choice(vocabulary) if r.random() < 0.7 else r.choice(["the", "of", "Le", "42"]) for _ in range(r.choice([0, 1, 3, 30, 400])))) for d in ids]


@pytest.mark.parametrize("run_rows", [3, 1000])
def test_equal_to_plain_python(spark, run_rows):
    rows = corpus(3, [-4, 0, *range(10, 90), 10 ** 12, 2 ** 52]) + [(5000, None), (5001, ""), (5002, "!!!"), (5003, "😀" * 31), (5004, "x " * 20_000)]
    rows += [(k, "copies of one text") for k in range(6000, 6030)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("run", F.lit("clash")).withColumn("u", F.lit(1))
    got = sorted(tuple(r) for r in I.fingerprints(df.repartition(3), run_rows=run_rows).collect())
    want = brute(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5:] for g in got] == [pytest.approx(w[5:]) for w in want]


def test_repeated_and_missing_ids(spark):
    rows = [(7, f"seven {k} of many words {k % 5}") for k in range(40)] + [(None, f"none {k}") for k in range(20)] + [(None, None)] * 3 + [(7, "same row")] * 5
    got = I.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), run_rows=4).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((d, len(t or "")) for d, t in rows)
    assert all(0 <= v <= 1 for r in got for v in (r.near_edited, r.near_next))


def test_one_row_and_empty_table(spark):
    one = I.fingerprints(spark.createDataFrame([(1, "a single text of five")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a single tea single t").hexdigest()
    assert I.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_likeness_follows_common_terms_at_every_length(spark):
    r = random.Random(8)
    near, far = [], []
    vocabulary = [f"w{k}" for k in range(40_000)]
    lexicon = set(vocabulary)
    for size in (20, 100, 1000, 8000):
        for _ in range(6):
            a, b = r.sample(vocabulary, size), r.sample(vocabulary, size)
            one = brute_print(" ".join(a), lexicon)
            near.append(brute_likeness(one, brute_print(" ".join(a[:size // 2] + b[size // 2:]), lexicon)))
            far.append(brute_likeness(one, brute_print(" ".join(b), lexicon)))
    assert min(near) > max(far) or sum(n > max(far) for n in near) >= len(near) - 1

"""Budgets and prefixes against a plain recursive computation."""
import hashlib
from fractions import Fraction

from veilspark.llm import source_mixing as M


def brute_split(budget, children):
    """children: name -> (weight, supply); water-filling by repeated passes."""
    out, left, rest = {}, dict(children), budget
    while left:
        total = sum(w for w, _ in left.values())
        short = {k for k, (w, s) in left.items() if not s or w and s * total <= rest * w}
        if not short:
            break
        for k in short:
            out[k] = left[k][1]
            rest -= left[k][1]
            del left[k]
    done = Fraction(0)
    total = sum(w for w, _ in left.values())
    for k in sorted(left):
        w = left[k][0]
        out[k] = min(int((done + w) * rest / total) - int(done * rest / total), left[k][1]) if total else 0
        done += w
    return out


def brute(rows, weights, percent, epochs, seed):
    leaves = {}
    for d, s, lang, t in rows:
        n = len((t or "").split())
        digits = (s or "").lstrip("abcdefghijklmnopqrstuvwxyz")
        leaf = (f"domain{int(digits) % 4}" if digits else M.NONE, lang or M.NONE, s or M.NONE)
        leaves.setdefault(leaf, []).append((d, n))
    supply = {k: epochs * sum(n for _, n in v) for k, v in leaves.items()}
    total = sum(supply.values()) // epochs
    amounts = {(): min(total * percent // 100, sum(supply.values()))}
    for depth, level in enumerate(M.LEAF):
        for parent in {k[:depth] for k in leaves}:
            kids = {k[depth] for k in leaves if k[:depth] == parent}
            got = brute_split(amounts[parent], {c: (weights.get(level, {}).get(c, 1), sum(v for k, v in supply.items() if k[:depth + 1] == parent + (c,))) for c in kids})
            amounts.update({parent + (c,): a for c, a in got.items()})
    out = []
    for leaf, docs in leaves.items():
        tokens = sum(n for _, n in docs)
        if not tokens:
            continue
        whole, rest = divmod(amounts[leaf], tokens)
        out += [(d, *leaf, e, n, n) for e in range(whole) for d, n in docs]
        docs = sorted(docs, key=lambda x: hashlib.md5(f"{seed}|{whole}|{'' if x[0] is None else x[0]}".encode()).hexdigest())
        done = 0
        for d, n in docs:
            if done < rest:
                out.append((d, *leaf, whole, n, min(n, rest - done)))
            done += n
    return sorted(out, key=repr), amounts


def rows():
    out = []
    for i in range(240):
        source = f"src{i % 7}" if i % 3 else "src0"
        out.append((i, source, ("en", "de", None)[i % 5 % 3], " ".join(["w"] * (i * 7 % 23))))
    return out + [(500, None, "en", "no source"), (501, "plain", "fr", " lead and  trail "), (502, "src9", "es", None), (503, "src9", "es", ""), (None, "src5", "en", "a b c")]


def test_equal_to_brute_force(spark):
    df = spark.createDataFrame(rows(), "doc_id long, source string, lang string, text string").selectExpr("*", "1 AS epoch", "2 AS supply", "3 AS amount")
    for percent, epochs, weights in ((60, 2, M.WEIGHTS), (150, 2, {"lang": {"en": 9}}), (400, 3, {}), (30, 1, {"domain": {"domain0": 0}})):
        want, amounts = brute(rows(), weights, percent, epochs, 5)
        got = M.mix(df.repartition(4), weights=weights, percent=percent, max_epochs=epochs, seed=5, bucket_rows=3)
        assert sorted([tuple(r) for r in got.collect()], key=repr) == want
        assert sum(t[-1] for t in want) == sum(a for k, a in amounts.items() if len(k) == 3)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, text string")
    assert M.mix(df).count() == 0 and M.chosen(df).count() == 0

"""Rule-based redaction and span application.

``redact_rules`` applies the ten detection rules one after another, each on
the output of the previous one, replacing every match with ``[LABEL_n]``; the
counter ``n`` runs left to right and continues across rules that share a
label. It is one JVM expression per row: no UDF, no shuffle, streaming-safe.

Each rule step is let-bound through a one-element ``transform`` so the text
of the previous step is referenced once. Written naively (ten ``withColumn``
steps each using the text twice) the optimised plan doubles per step as soon
as a filter sits on top of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, running, running_back
from ..functions.rules import BOUNDARY_RISK_JAVA, BOUNDARY_RISK_PREFILTER_JAVA, LABELS, RULES, Rule
from ..functions.text import blocks, cut, token_count

# Cheap literal tests that must hold for a rule to match at all. They skip the
# regex scan for most rows; each is implied by the pattern, so results are
# unchanged.
GUARDS = {
    1: lambda t: t.contains("sk-") | t.contains("AKIA") | t.contains("ASIA"),
    3: lambda t: t.contains("@"),
    4: lambda t: t.contains("://"),
    9: lambda t: t.contains("番") | t.contains("号") | t.contains("丁目"),
}


def _state_type_fields():
    return [F.lit(0).alias(lbl) for lbl in LABELS]


def boundary_risk(text) -> Column:
    """True when the text holds a character on which Java's and Python's word
    classes differ; only such rows pay for the exact look-around boundary."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(t.rlike(BOUNDARY_RISK_PREFILTER_JAVA) & t.rlike(BOUNDARY_RISK_JAVA), F.lit(False))


def split_rule(text: Column, rule: Rule, risk: Column) -> Column:
    """Pieces of ``text`` between the rule's matches (size = matches + 1)."""
    if not rule.has_boundary:
        return F.split(text, rule.java, -1)
    return F.when(risk, F.split(text, rule.java, -1)).otherwise(F.split(text, rule.java_fast, -1))


def _apply_rule(state: Column, rule: Rule) -> Column:
    """One substitution pass over ``state.t`` with counter continuation."""
    label = rule.label

    def rewrite(s: Column) -> Column:
        pieces = split_rule(s["t"], rule, s["risk"])
        bound = F.transform(F.array(F.struct(s.alias("s"), pieces.alias("w"))), lambda b: b)

        def emit(b: Column) -> Column:
            base = b["s"][label]
            text = F.array_join(
                F.transform(b["w"], lambda p, i: F.when(i == 0, p).otherwise(
                    F.concat(F.lit(f"[{label}_"), (base + i).cast("string"), F.lit("]"), p))),
                "")
            hits = F.size(b["w"]) - 1
            fields = [text.alias("t"), b["s"]["risk"].alias("risk")]
            for lbl in LABELS:
                v = b["s"][lbl]
                fields.append((v + hits).alias(lbl) if lbl == label else v.alias(lbl))
            fields.append((b["s"]["matches"] + hits).alias("matches"))
            return F.struct(*fields)

        return F.element_at(F.transform(bound, emit), 1)

    guard = GUARDS.get(rule.index)
    if guard is None:
        return F.element_at(F.transform(F.array(state), rewrite), 1)
    return F.element_at(F.transform(F.array(state), lambda s: F.when(guard(s["t"]), rewrite(s)).otherwise(s)), 1)


def redact_struct(text, rules=RULES) -> Column:
    """``struct<t, SECRET, EMAIL, ..., matches>`` after all rules."""
    t = F.col(text) if isinstance(text, str) else text
    state = F.struct(t.alias("t"), boundary_risk(t).alias("risk"), *_state_type_fields(),
                     F.lit(0).alias("matches"))
    for rule in rules:
        state = _apply_rule(state, rule)
    return state


def redact_rules(df: DataFrame, text_col: str = "text", out_col: str = "redacted",
                 keep_counts: bool = False, rules=RULES) -> DataFrame:
    """Add the redacted text and the per-document match count.

    ``matches`` is the sum over rules (a match that swallowed an earlier
    placeholder still counts). With ``keep_counts`` the per-label counters are
    kept as ``n_<label>`` columns.
    """
    res = df.withColumn("_red", redact_struct(text_col, rules))
    cols = [c for c in df.columns] + [F.col("_red.t").alias(out_col), F.col("_red.matches").alias("matches")]
    if keep_counts:
        cols += [F.col(f"_red.{lbl}").alias(f"n_{lbl.lower()}") for lbl in LABELS]
    return res.select(*cols)


def redaction_output(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Redacted text with input/output token counts and matches (the adapter's output record)."""
    out = redact_rules(df, text_col)
    return (out.withColumn("input_tokens", token_count(text_col))
               .withColumn("output_tokens", token_count("redacted")))


# ---------------------------------------------------------------------------
# Span application (spans given as array<struct<label,start,end>>)
# ---------------------------------------------------------------------------

SPAN_T = "array<struct<label:string,start:int,end:int>>"


def _counted_from_the_right(labels: Column) -> Column:
    """For each label how many equal ones there are up to it."""
    ranked = F.sort_array(F.transform(labels, lambda label, i: F.struct(label.alias("label"), i.alias("at"))))
    def ranks(r: Column) -> Column:
        begins = F.transform(r, lambda x, i: F.when((i > 0) & (x["label"] == F.get(r, i - 1)["label"]), 0).otherwise(i))
        return let(running(begins, lambda a, b: F.greatest(a, b)), lambda begin: F.transform(
            F.sort_array(F.transform(r, lambda x, i: F.struct(x["at"].alias("at"), (i - F.get(begin, i) + 1).alias("n")))), lambda x: x["n"]))
    return let(ranked, ranks)


def _spliced(text: Column, ordered: Column) -> Column:
    """The text with its spans (last first, within the text) replaced, in one pass over the spans.

    Behind the start of the span at hand the text is a stack of pieces, its
    right end at the bottom. A span that ends before the next start puts the
    gap between and its placeholder on the stack; one that ends behind it
    first takes the overlap off, placeholders included. The heights of the
    stack are a running result; a piece keeps what no later height undercuts.
    """
    def plan(b: Column) -> Column:
        marks = F.zip_with(b["o"], _counted_from_the_right(F.transform(b["o"], lambda s: s["label"])),
                           lambda s, n: F.concat(F.lit("[PII_"), F.upper(s["label"]), F.lit("_"), n.cast("string"), F.lit("]")))
        def moves(m: Column) -> Column:
            return F.transform(b["o"], lambda s, i: let(
                F.greatest(s["end"], F.lit(0)) - F.when(i == 0, b["n"]).otherwise(F.greatest(F.get(b["o"], i - 1)["start"], F.lit(0))),
                lambda over: F.struct(F.greatest(over, F.lit(0)).alias("off"), F.greatest(-over, F.lit(0)).alias("gap"),
                                      F.get(m, i).alias("mark"), F.length(F.get(m, i)).alias("size"),
                                      F.greatest(s["end"], F.lit(0)).alias("end"))))
        return let(marks, lambda m: let(moves(m), heights))

    def heights(moves: Column) -> Column:
        # x -> greatest(least, x + add); the height after each span, then the lowest one after each span
        steps = F.transform(moves, lambda v: F.struct((v["gap"] + v["size"]).alias("least"), (v["gap"] + v["size"] - v["off"]).alias("add")))
        after = running(steps, lambda f, g: F.struct(F.greatest(g["least"], f["least"] + g["add"]).alias("least"), (f["add"] + g["add"]).alias("add")))
        base = F.zip_with(after, moves, lambda h, v: F.greatest(h["least"], h["add"]) - v["gap"] - v["size"])
        return let(base, lambda low: let(running_back(low, lambda a, b: F.least(a, b)), lambda floor: F.transform(moves, lambda v, i: F.struct(
            v["mark"].alias("mark"), v["size"].alias("size"), v["gap"].alias("gap"), v["end"].alias("end"), F.get(low, i).alias("low"),
            (F.coalesce(F.get(floor, i + 1), F.lit(2 ** 31 - 1)) - F.get(low, i)).alias("room")))))

    def piece(parts: Column, v: Column) -> Column:
        gap = F.least(v["gap"], F.greatest(v["room"], F.lit(0)))
        kept = F.least(v["size"], F.greatest(v["room"] - v["gap"], F.lit(0)))
        return F.concat(F.substring(v["mark"], v["size"] - kept + 1, kept), cut(parts, v["end"] + v["gap"] - gap, v["end"] + v["gap"]))

    def joined(b: Column) -> Column:
        head = cut(b["p"], F.lit(0), F.greatest(F.element_at(b["o"], -1)["start"], F.lit(0)))
        return let(plan(b), lambda moves: F.concat(head, F.array_join(F.reverse(F.transform(moves, lambda v: piece(b["p"], v))), "")))

    return let(F.struct(blocks(text).alias("p"), ordered.alias("o"), F.length(text).alias("n")), joined)


def _repeated_cuts(text: Column, ordered: Column) -> Column:
    """The same, one cut of the whole text after the other: for spans that begin behind the end of their text."""
    init = F.struct(text.alias("t"), F.create_map().cast("map<string,int>").alias("n"))

    def step(acc, s):
        label = s["label"]
        n = F.coalesce(F.element_at(acc["n"], label), F.lit(0)) + 1
        ph = F.concat(F.lit("[PII_"), F.upper(label), F.lit("_"), n.cast("string"), F.lit("]"))
        cur = acc["t"]
        # Python slicing clamps; substring with the same clamps
        start = F.least(F.greatest(s["start"], F.lit(0)), F.length(cur))
        end = F.least(F.greatest(s["end"], F.lit(0)), F.length(cur))
        new_t = F.concat(F.substring(cur, F.lit(1), start), ph, F.substring(cur, end + 1, F.length(cur) + 1))
        counters = F.map_concat(F.map_filter(acc["n"], lambda k, v: k != label), F.create_map(label, n))
        return F.struct(new_t.alias("t"), counters.alias("n"))

    return F.aggregate(ordered, init, step, lambda acc: acc["t"])


def apply_spans(text, spans) -> Column:
    """Replace spans right to left with ``[PII_<LABEL>_n]``, n counting from the end.

    Spans are ordered by start descending; ties keep their input order.
    Overlaps are not resolved: every cut uses the original offsets on the
    partly rewritten text, exactly like repeated slicing. The work grows with
    the text and the spans, not with their product.
    """
    t = F.col(text) if isinstance(text, str) else text
    sp = F.col(spans) if isinstance(spans, str) else spans
    ordered = F.sort_array(F.transform(sp, lambda s, i: F.struct((-s["start"]).alias("key"), i.alias("ord"), s["label"].alias("label"),
                                                                 s["start"].alias("start"), s["end"].alias("end"))))

    def replaced(b: Column) -> Column:
        behind = F.get(b["o"], 0)["start"] > F.length(b["t"])
        return F.when(F.size(b["o"]) == 0, b["t"]).when(behind, _repeated_cuts(b["t"], b["o"])).otherwise(_spliced(b["t"], b["o"]))

    return let(F.struct(t.alias("t"), ordered.alias("o")), lambda b: F.when(b["o"].isNotNull() & b["t"].isNotNull(), replaced(b)))

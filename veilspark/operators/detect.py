"""Detection: each rule as an operator over a text column.

Every function is a per-row JVM expression (regex split / extract) followed by
``inline`` to the long form, so detection is a narrow, shuffle-free stage
that scales with the number of input partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, running_sum
from ..functions.rules import RULES, Rule
from .redact import GUARDS, boundary_risk, split_rule

_SPAN = "array<struct<rule:int,label:string,start:int,end:int,value:string>>"


def _extract(text: Column, rule: Rule, risk: Column) -> Column:
    if not rule.has_boundary:
        out = F.regexp_extract_all(text, F.lit(rule.java), 0)
    else:
        out = F.when(risk, F.regexp_extract_all(text, F.lit(rule.java), 0)) \
            .otherwise(F.regexp_extract_all(text, F.lit(rule.java_fast), 0))
    guard = GUARDS.get(rule.index)
    return out if guard is None else F.when(guard(text), out).otherwise(F.array().cast("array<string>"))


def rule_values(text, rule: Rule, risk: Column | None = None) -> Column:
    """Matched strings of one rule, left to right, on the unmodified text."""
    if risk is None:
        return _with_risk(text, lambda t, r: _extract(t, rule, r))
    t = F.col(text) if isinstance(text, str) else text
    return _extract(t, rule, risk)


def rule_spans(text, rule: Rule, risk: Column | None = None) -> Column:
    """``array<struct<rule,label,start,end,value>>`` of one rule's matches.

    A match ends where the gaps and matches up to it end: a running sum of
    their lengths, so the work grows with the matches, not with their square.
    """
    if risk is None:
        return _with_risk(text, lambda t2, r2: rule_spans(t2, rule, r2))
    t = F.col(text) if isinstance(text, str) else text
    values = _extract(t, rule, risk)

    def build(b: Column) -> Column:
        steps = F.zip_with(F.slice(b["g"], 1, F.size(b["v"])), b["v"], lambda g, v: F.length(g) + F.length(v))
        return let(running_sum(steps), lambda ends: F.transform(b["v"], lambda v, i: F.struct(
            F.lit(rule.index).alias("rule"), F.lit(rule.label).alias("label"), (F.get(ends, i) - F.length(v)).alias("start"),
            F.get(ends, i).alias("end"), v.alias("value"))))

    # a text is cut between its matches only if it has any
    return let(values, lambda v: F.when(F.size(v) > 0, let(F.struct(split_rule(t, rule, risk).alias("g"), v.alias("v")), build))
               .otherwise(F.array().cast(_SPAN)))


def _with_risk(text, fn) -> Column:
    """Evaluate ``fn(text, risk)`` with the risk flag computed once per row."""
    t = F.col(text) if isinstance(text, str) else text
    return let(F.struct(t.alias("t"), boundary_risk(t).alias("r")), lambda b: fn(b["t"], b["r"]))


def all_rule_spans(text, rules=RULES) -> Column:
    """Union of every rule's spans on the original text (rule order kept)."""
    return _with_risk(text, lambda t, r: F.concat(*[rule_spans(t, rule, r) for rule in rules]))


def detect(df: DataFrame, text_col: str = "text", keys=("doc_id",), rules=RULES) -> DataFrame:
    """Long span table ``(keys..., rule, label, start, end, value)``.

    Spans are built in the row that holds the text and laid out as rows there; nothing is shuffled.
    """
    spans = df.select(*keys, F.explode(all_rule_spans(text_col, rules)).alias("_s"))
    return spans.select(*keys, "_s.rule", "_s.label", "_s.start", "_s.end", "_s.value")


def detect_rule(df: DataFrame, rule_index: int, text_col: str = "text", keys=("doc_id",)) -> DataFrame:
    """Matches of one rule with their position ``match_idx`` (0-based) per row."""
    rule = RULES[rule_index - 1]
    return (df.select(*keys, F.posexplode(rule_spans(text_col, rule)).alias("match_idx", "_s"))
              .select(*keys, "match_idx", "_s.label", "_s.start", "_s.end", "_s.value"))

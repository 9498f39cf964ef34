"""Plain-Python statements of the semantics, used only as test oracles."""

from __future__ import annotations

import itertools
import re

from veilspark.functions.rules import RULES, TOKEN_PATTERN

_TOKEN = re.compile(TOKEN_PATTERN)
_RULES = [(r.label, re.compile(r.pattern, re.IGNORECASE if r.ignore_case else 0)) for r in RULES]


def token_spans(text):
    return [m.span() for m in _TOKEN.finditer(text)]


def token_count(text):
    return sum(1 for _ in _TOKEN.finditer(text))


def truncate(text, n):
    """Up to the end of the n-th token; all of a text with no more tokens than that."""
    ends = [end for _, end in token_spans(text)]
    keep = 0 if n < 1 else len(text) if len(ends) <= n else ends[n - 1]
    return text[:keep]


def redact(text):
    """(text, replacements): each rule cuts the text at its matches and numbers the gaps it fills."""
    used = dict.fromkeys((label for label, _ in _RULES), 0)
    for label, pattern in _RULES:
        matches = list(pattern.finditer(text))
        edges = [0, *itertools.chain.from_iterable(m.span() for m in matches), len(text)]
        kept = [text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
        marks = [f"[{label}_{used[label] + k}]" for k in range(1, len(matches) + 1)]
        used[label] += len(matches)
        text = "".join(itertools.chain.from_iterable(itertools.zip_longest(kept, marks, fillvalue="")))
    return text, sum(used.values())


def rule_matches(text, index):
    _, pattern = _RULES[index - 1]
    return [(*m.span(), m.group()) for m in pattern.finditer(text)]


def _tag(label):
    if label == "O":
        return "O", ""
    m = re.fullmatch("([BIESbies])-(.*)", label, re.S)
    return (m[1].upper(), m[2]) if m else ("S", label)


def bioes_spans(items, allowed=None):
    """Islands of labels: a token starts a new island unless it is I or E and the island before it is of its
    kind and still open; S islands and those that end in E are closed. An island is the span from its first
    start to its furthest end."""
    islands = []  # kind, open, start, end
    for start, end, label in items:
        if start >= end:
            continue
        tag, kind = _tag(label)
        last = islands[-1] if islands else None
        if tag in "IE" and last and last["open"] and last["kind"] == kind:
            last["end"] = max(last["end"], end)
            last["open"] = tag == "I"
        elif tag == "E" and last and last["open"]:
            # a stray end stands by itself and comes before the island it interrupts
            islands.insert(len(islands) - 1, {"kind": kind, "open": False, "start": start, "end": end})
        else:
            if last:
                last["open"] = False
            islands.append({"kind": kind, "open": tag in "BI", "start": start, "end": end})
    return [(i["kind"], i["start"], i["end"]) for i in islands if i["kind"] and (allowed is None or i["kind"] in allowed)]

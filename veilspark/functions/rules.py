"""Detection rules and the token pattern, plus their translation to Java regex.

The values under FIXED VALUES must equal the behaviour being reproduced, so
they are stated as written for Python's ``re`` dialect. Spark evaluates regexes
with ``java.util.regex``; :func:`to_java` rewrites the three escapes whose
meaning differs between the two dialects (``\\b``, ``\\s``, ``\\d``) into
explicit Unicode classes, so Spark finds exactly the matches Python would.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference behaviour exactly; Python re dialect)
# ---------------------------------------------------------------------------

# One token = one CJK/kana/hangul character, or a run of ASCII word-ish
# characters, or any other single non-space character.
TOKEN_PATTERN = (
    r"[\u3400-\u4dbf\u4e00-\u9fff\u3040-\u30ff\uac00-\ud7af]"
    r"|[A-Za-z0-9_@./:+-]+"
    r"|[^\s]"
)

# (label, pattern, ignore_case) in the order they are applied.
RULE_PATTERNS = (
    ("SECRET", r"\b(?:sk-[A-Za-z0-9_-]{8,}|sk-proj-[A-Za-z0-9_-]{8,}|(?:AKIA|ASIA)[A-Z0-9]{16})\b", False),
    ("SECRET", r"\b(?:api[_-]?key|access[_-]?token|auth[_-]?token|password|secret)\b\s*[:=]\s*[^\s\"']{4,}", True),
    ("EMAIL", r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", True),
    ("URL", r"\bhttps?://[^\s<>\"]+", True),
    ("PHONE", r"(?:\+\d{1,3}[\s.-]?)?(?:\(?\d{2,4}\)?[\s.-]?){2,5}\d{2,4}", False),
    ("ACCOUNT", r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b", False),
    ("ACCOUNT", r"\b\d[\d -]{11,}\d\b", False),
    ("DATE", r"\b\d{4}[-/年]\d{1,2}[-/月]\d{1,2}日?\b", False),
    ("ADDRESS", r"\d{1,4}(?:丁目|番地|番|号)", False),
    ("ADDRESS", r"\b\d{1,6}\s+[A-Za-z0-9 .'-]+(?:street|st|road|rd|avenue|ave|lane|ln|drive|dr|boulevard|blvd|way|court|ct)\b", True),
)

# The eight span categories of the token-classifier label space.
PII_CATEGORIES = (
    "secret",
    "account_number",
    "private_email",
    "private_phone",
    "private_person",
    "private_address",
    "private_date",
    "private_url",
)

# Prompt for generative redactors; {text} is the only placeholder filled in.
PROMPT_TEMPLATE = (
    "You are a privacy filter. Replace every PII occurrence in the text below "
    "with a labelled placeholder, keep everything else unchanged. Use:\n"
    "- person name -> [PERSON]\n"
    "- email -> [EMAIL]\n"
    "- phone -> [PHONE]\n"
    "- address -> [ADDRESS]\n"
    "- account/card/iban/id-number -> [ACCOUNT]\n"
    "- api key/token/password/secret -> [SECRET]\n"
    "- date -> [DATE]\n"
    "- url -> [URL]\n"
    "Do NOT paraphrase. Output ONLY the rewritten text.\n\n"
    "TEXT:\n{text}\n\nREWRITTEN:\n"
)

# ---------------------------------------------------------------------------
# Dialect translation
# ---------------------------------------------------------------------------

# Python's \w for str is "letter, number or underscore"; Java's own \w (even
# with UNICODE_CHARACTER_CLASS) adds combining marks and drops other numbers.
_WORD = r"[\p{L}\p{N}_]"
_BOUNDARY = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
# Python's \s is Unicode White_Space plus the four separators U+001C..U+001F.
_SPACE_IN_CLASS = r"\p{IsWhite_Space}\x{1c}-\x{1f}"
_DIGIT = r"\p{Nd}"
# Without case, Python's A-Z and a-z also take dotted capital I, dotless i, long s and the Kelvin sign;
# Java's ranges miss some of them.
_FOLDED = r"\x{130}\x{131}\x{17f}\x{212a}"


def to_java(pattern: str, ignore_case: bool = False, exact_boundary: bool = True) -> str:
    """Rewrite a Python-dialect pattern so java.util.regex matches the same text.

    With ``exact_boundary`` the word boundary is spelled out with look-arounds
    over Python's word class (exact on any text, but several times slower).
    Without it Java's Unicode ``\\b`` is kept; it agrees with Python on every
    text that has no character of :data:`BOUNDARY_RISK_JAVA`.
    """
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            esc = pattern[i + 1]
            if esc == "b" and not in_class:
                out.append(_BOUNDARY if exact_boundary else r"\b")
            elif esc == "s":
                out.append(_SPACE_IN_CLASS if in_class else f"[{_SPACE_IN_CLASS}]")
            elif esc == "d":
                out.append(_DIGIT)
            else:
                out.append(pattern[i:i + 2])
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
            out.append(ch)
            if ignore_case and pattern[i + 1:i + 2] != "^" and re.search("A-Z|a-z", pattern[i:pattern.index("]", i)]):
                out.append(_FOLDED)
            if pattern[i + 1:i + 2] == "^":  # negation belongs to the class head
                out.append("^")
                i += 1
            i += 1
            continue
        if ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    flags = ("i" if ignore_case else "") + ("u" if ignore_case else "") + ("" if exact_boundary else "U")
    return (f"(?{flags})" if flags else "") + "".join(out)


# Characters on which Java's Unicode word class (Alphabetic, marks, decimal
# digits, connector punctuation, joiners) and Python's (letters, numbers, '_')
# disagree. A text without any of them gets identical \b results from both.
_JAVA_WORD = r"[\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}]"
_PY_WORD = r"[\p{L}\p{N}_]"
# Cheap first test: every character of the risk class is >= U+0300 or one of
# the Latin-1 "other numbers" (superscripts 1-3, vulgar fractions).
BOUNDARY_RISK_PREFILTER_JAVA = r"[\x{b2}\x{b3}\x{b9}\x{bc}-\x{be}\x{300}-\x{10ffff}]"
BOUNDARY_RISK_JAVA = (rf"[{_JAVA_WORD}&&[^\p{{L}}\p{{N}}_]]"
                      rf"|[{_PY_WORD}&&[^\p{{IsAlphabetic}}\p{{M}}\p{{Nd}}\p{{Pc}}\x{{200c}}\x{{200d}}]]")


@dataclass(frozen=True)
class Rule:
    index: int          # 1-based position in the application order
    label: str
    pattern: str        # Python dialect (fixed value)
    ignore_case: bool

    @property
    def java(self) -> str:
        return to_java(self.pattern, self.ignore_case)

    @property
    def java_fast(self) -> str:
        return to_java(self.pattern, self.ignore_case, exact_boundary=False)

    @property
    def has_boundary(self) -> bool:
        return "\\b" in self.pattern


RULES = tuple(Rule(i + 1, label, pat, ic) for i, (label, pat, ic) in enumerate(RULE_PATTERNS))
TOKEN_JAVA = to_java(TOKEN_PATTERN)
LABELS = tuple(dict.fromkeys(r.label for r in RULES))  # distinct labels in first-use order

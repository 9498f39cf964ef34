"""Token unit and text sizing as Spark Column expressions (JVM-side, no UDF).

A token is one match of :data:`rules.TOKEN_PATTERN`. Every non-space
character belongs to exactly one token, so ``split(text, TOKEN)`` yields the
whitespace runs between tokens; that identity gives offsets and cut points
without any Python code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import PROMPT_TEMPLATE, TOKEN_JAVA


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def token_count(text) -> Column:
    """Number of tokens (0 for NULL text)."""
    return F.coalesce(F.regexp_count(_c(text), F.lit(TOKEN_JAVA)), F.lit(0)).cast("int")


def tokens(text) -> Column:
    """Token strings in text order."""
    return F.regexp_extract_all(_c(text), F.lit(TOKEN_JAVA), 0)


def gaps(text) -> Column:
    """Whitespace before each token; the last element is the trailing whitespace."""
    return F.split(_c(text), TOKEN_JAVA, -1)


_NON_SPACE = r"[^\p{IsWhite_Space}\x{1c}-\x{1f}]"


def truncate_to_tokens(text, n: int) -> Column:
    """First ``n`` tokens of the text, keeping the original characters up to the
    end of token ``n``; ``n <= 0`` gives '' and a shorter text is unchanged.

    ``split`` with limit n+1 stops after the n-th token and keeps the rest of
    the text as its last element, so the text is never scanned past token n
    plus one character: fewer than n+1 pieces means at most n-1 tokens; the
    text has more than n tokens exactly when the rest holds a non-space
    character (every non-space character belongs to a token).
    """
    t = _c(text)
    if n <= 0:
        return F.when(t.isNotNull(), F.lit(""))

    def cut(b: Column) -> Column:
        txt, parts = b["t"], b["p"]
        rest = F.element_at(parts, n + 1)
        return (F.when(F.size(parts) <= n, txt)
                 .when(rest.rlike(_NON_SPACE), F.substring(txt, F.lit(1), F.length(txt) - F.length(rest)))
                 .otherwise(txt))

    # let-bind the text and its pieces (the text may itself be an expression)
    bound = F.array(F.struct(t.alias("t"), F.split(t, TOKEN_JAVA, n + 1).alias("p")))
    return F.element_at(F.transform(bound, cut), 1)


def sized_text(seed, n: int) -> Column:
    """Text of exactly ``n`` tokens made by repeating ``seed`` with newlines.

    A newline never joins two tokens, so k copies hold k * count(seed) tokens
    and the loop of the definition collapses to one ``array_repeat``. A blank
    seed raises an error, like the definition.
    """
    s = _c(seed)
    per_copy = token_count(s)
    copies = F.greatest(F.lit(1), F.ceil(F.lit(n) / per_copy).cast("int"))
    joined = F.array_join(F.array_repeat(s, copies), "\n")
    return F.when(per_copy == 0, F.raise_error(F.lit("a seed without tokens cannot be repeated to a size")).cast("string")) \
        .otherwise(truncate_to_tokens(joined, n))


def char_length(text) -> Column:
    return F.length(_c(text))


def render_prompt(text) -> Column:
    """Fill the redaction prompt template with the text."""
    head, tail = PROMPT_TEMPLATE.split("{text}")
    return F.concat(F.lit(head), _c(text), F.lit(tail))


#: Characters of one block of a text that is cut at many places.
BLOCK = 1024


def blocks(text) -> Column:
    """The text in blocks of ``BLOCK`` characters, made in one pass.

    ``substring`` counts characters from the start of its text; on a block that is short, on a long text it is not.
    """
    return F.regexp_extract_all(_c(text), F.lit(f"(?s).{{1,{BLOCK}}}"), 0)


def cut(parts: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` to ``end`` (half-open, within the text) of a text given by its :func:`blocks`."""
    first, last = (F.floor(x / BLOCK).cast("int") for x in (start, end - 1))
    middle = F.array_join(F.slice(parts, first + 2, last - first - 1), "")
    return (F.when(end <= start, "")
            .when(first == last, F.substring(F.get(parts, first), (start % BLOCK + 1).cast("int"), (end - start).cast("int")))
            .otherwise(F.concat(F.substring(F.get(parts, first), (start % BLOCK + 1).cast("int"), F.lit(BLOCK)), middle,
                                F.substring(F.get(parts, last), F.lit(1), ((end - 1) % BLOCK + 1).cast("int")))))


# Python's str.strip() removes Unicode White_Space and U+001C..U+001F.
_STRIP = r"^[\p{IsWhite_Space}\x{1c}-\x{1f}]+|[\p{IsWhite_Space}\x{1c}-\x{1f}]+$"


def py_strip(text) -> Column:
    return F.regexp_replace(_c(text), _STRIP, "")


def after_think(text) -> Column:
    """Keep what follows the first ``</think>`` (if any), then strip."""
    return py_strip(F.regexp_replace(_c(text), r"(?s)^.*?</think>", ""))


def generation_budget(configured, input_tokens) -> Column:
    """Configured new-token budget, else max(256, int(1.3 * input tokens))."""
    fallback = F.greatest(F.lit(256), (F.lit(1.3) * _c(input_tokens)).cast("int"))
    return F.coalesce(F.nullif(_c(configured), F.lit(0)), fallback)


def first_row(nested) -> Column:
    """The first row of a batch-shaped array (``[[...]]``); NULL for NULL or empty."""
    n = _c(nested)
    return F.when(F.size(n) > 0, F.element_at(n, 1))


def attention_token_count(mask, fallback, nested: bool = False) -> Column:
    """Sum of an attention mask (of its first row if ``nested``), or the fallback when it is NULL or empty."""
    m = _c(mask)
    empty = m.isNull() | (F.size(m) == 0)
    row = first_row(m) if nested else m
    return F.when(empty, _c(fallback)).otherwise(F.aggregate(row, F.lit(0).cast("long"), lambda a, x: a + x))


def coerce_offsets(pairs, nested: bool = False) -> Column:
    """Well-formed ``[start, end, ...]`` pairs (of the first row if ``nested``) as ``struct<start,end>``; NULL as none."""
    rows = first_row(pairs) if nested else _c(pairs)
    rows = F.coalesce(rows, F.array().cast("array<array<int>>"))
    return F.transform(F.filter(rows, lambda x: F.size(x) >= 2),
                       lambda x: F.struct(x[0].cast("int").alias("start"), x[1].cast("int").alias("end")))


def coerce_ids(nested) -> Column:
    """The first row of a batch-shaped id array as ints; NULL as none."""
    return F.transform(F.coalesce(first_row(nested), F.array().cast("array<long>")), lambda x: x.cast("int"))

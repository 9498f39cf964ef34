"""Tokens with code-point offsets, built in the row that holds the text.

Tokens are found by numpy over the characters of many texts at once, an Arrow
batch at a time, so neither a token nor the text is shuffled.
"""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import first_after, let
from ..functions.rules import TOKEN_PATTERN

#: Bytes of text that numpy works on at once.
SLICE = 1 << 20
_SPACE, _RUN, _SINGLE = 0, 1, 2


@cache
def _kinds():
    """What each code point is for :data:`rules.TOKEN_PATTERN`: white space, part of a run, or a token by itself."""
    import numpy as np

    kinds = np.full(0x110000, _SINGLE, dtype=np.uint8)
    kinds[[c for c in range(0x110000) if chr(c).isspace()]] = _SPACE
    kinds[[c for c in range(128) if re.fullmatch(TOKEN_PATTERN, chr(c) * 2)]] = _RUN
    return kinds


def _spans_of(texts):
    """Token spans of an Arrow array of texts without NULLs."""
    import numpy as np

    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0]:bounds[-1]]
    byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # first byte of each character, and the end
    kind = _kinds()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)]
    row = np.searchsorted(byte, bounds - bounds[0])  # first character of each text, and the end
    run = kind == _RUN
    apart = np.ones(len(kind) + 1, dtype=bool)  # no run goes on from the character before to this one
    apart[1:-1] = ~(run[1:] & run[:-1])
    apart[row] = True
    first, stop = np.flatnonzero((kind != _SPACE) & apart[:-1]), np.flatnonzero((kind != _SPACE) & apart[1:]) + 1
    size = np.searchsorted(first, row)
    origin = np.repeat(row[:-1], np.diff(size))
    ends = np.concatenate([[0], np.cumsum(byte[stop] - byte[first])]).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(data[np.repeat(kind != _SPACE, np.diff(byte))]))
    spans = pa.StructArray.from_arrays([pa.array((first - origin).astype(np.int32)), pa.array((stop - origin).astype(np.int32)), pieces],
                                       names=["tok_start", "tok_end", "piece"])
    return size.astype(np.int32), spans


def _token_spans(texts):
    import numpy as np

    absent = texts.is_null().to_numpy(zero_copy_only=False)
    texts = texts.cast(pa.string()).fill_null("")
    held = np.cumsum(np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1])) if len(texts) else []
    sizes, parts, at, tokens = [np.zeros(1, dtype=np.int32)], [], 0, 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + SLICE, side="right")))
        size, spans = _spans_of(texts.slice(at, stop - at))
        sizes.append(size[1:] + tokens)
        parts.append(spans)
        tokens, at = tokens + len(spans), stop
    kind = pa.struct([("tok_start", pa.int32()), ("tok_end", pa.int32()), ("piece", pa.string())])
    values = pa.concat_arrays(parts) if parts else pa.array([], kind)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(sizes).astype(np.int32)), values, mask=pa.array(absent) if absent.any() else None)


def token_spans(text) -> Column:
    """``array<struct<tok_start,tok_end,piece>>`` in text order; NULL for NULL."""
    def spans(texts: pa.Array) -> pa.Array:
        return _token_spans(texts)

    return F.arrow_udf(spans, "array<struct<tok_start:int,tok_end:int,piece:string>>")(text)


def token_table(df: DataFrame, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, tok_idx, tok_start, tok_end, piece)`` for every token; nothing is shuffled."""
    z = df.select(key, F.posexplode(token_spans(text_col)).alias("tok_idx", "t"))
    return z.select(key, "tok_idx", "t.tok_start", "t.tok_end", "t.piece")


def overlaps(toks: Column, spans: Column) -> Column:
    """``array<struct<tok_idx,span_idx>>``: the tokens each span touches (half-open ranges), span by span.

    Tokens are disjoint and in order, so a span touches a stretch of them that
    two bisections find; the work grows with the result.
    """
    def stretch(b: Column, s: Column, j: Column) -> Column:
        first, stop = first_after(b["e"], s["start"], False), first_after(b["s"], s["end"], True)
        return let(F.struct(first.alias("a"), stop.alias("z")), lambda x: F.when(
            x["a"] < x["z"], F.transform(F.sequence(x["a"], x["z"] - 1), lambda t: F.struct(t.alias("tok_idx"), j.alias("span_idx"))))
            .otherwise(F.array().cast("array<struct<tok_idx:int,span_idx:int>>")))
    bound = F.struct(F.transform(toks, lambda t: t["tok_start"]).alias("s"), F.transform(toks, lambda t: t["tok_end"]).alias("e"))
    return let(bound, lambda b: F.flatten(F.transform(spans, lambda s, j: stretch(b, s, j))))

"""Fill-in-the-middle transformation of texts, as a pyarrow.compute pipeline.

The cut points of a text come from a hash of its id, so that they are the same
on every run and executor. In a task each Arrow batch is cut into units (code
points): list arrays over the text's own bytes are flattened with the index of
their parent, every unit gets its ordinal, units are filtered by role (prefix,
middle, suffix), rebuilt to lists and joined to pieces, which the sentinels
then join in the order that the row's form names. Nothing is shuffled.

Forms: ``plain`` leaves the text as it is; ``psm`` writes prefix, suffix,
middle; ``spm`` writes suffix, prefix, middle. A text is plain if it is empty,
if it holds a sentinel (so that ``restored`` is exact), or by the draw.

Defined results for odd input: a null text counts as empty and is plain; a
null ``doc_id`` draws as the empty string. Rows are independent, so repeated
rows give repeated results; an empty table gives an empty result. Very long
texts are cut into segments of ``SEGMENT_BYTES``, whose pieces are joined
again, so that the unit arrays stay small. Only ``doc_id`` and ``text`` are
read; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.tables import table
from .registry import query
from .words import SEGMENT_BYTES, slices


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def order(self, form: str) -> tuple[str, str, str]:
        return (self.prefix, self.suffix, self.middle) if form == "psm" else (self.suffix, self.prefix, self.middle)


SENTINELS = Sentinels()
#: Of a hundred texts so many are cut, and of a hundred cut texts so many are written suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
SEED = 1


def planned(docs: DataFrame, seed: int = SEED, sentinels: Sentinels = SENTINELS, cut_percent: int = CUT_PERCENT,
            suffix_first_percent: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """Per row: doc_id, text (null as empty), n, form, ``first`` and ``second`` (units before the cuts)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), digest.alias("digest"))
    rows = rows.select("doc_id", "text", F.char_length("text").cast("long").alias("n"),
                       *[F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)])
    one, two = (F.col(h) % (F.col("n") + 1) for h in ("h1", "h2"))
    marked = F.lit(False)
    for mark in sentinels.order("psm"):
        marked = marked | F.col("text").contains(mark)
    form = (F.when((F.col("n") == 0) | marked | (F.col("h3") % 100 >= cut_percent), "plain")
            .when(F.col("h4") % 100 < suffix_first_percent, "spm").otherwise("psm"))
    return rows.select("doc_id", "text", "n", form.alias("form"), F.least(one, two).alias("first"), F.greatest(one, two).alias("second"))


def units(texts: pa.LargeStringArray) -> pa.LargeListArray:
    """Each text (none null) as the list of its code points, over the same bytes."""
    _, bounds, data = texts.buffers()
    ends = pa.Array.from_buffers(pa.int64(), len(texts) + 1, [None, bounds], offset=texts.offset)
    low, high = ends[0].as_py(), ends[-1].as_py()
    raw = pa.Array.from_buffers(pa.uint8(), high - low, [None, data], offset=low) if high > low else pa.array([], pa.uint8())
    # every byte but the continuation bytes 0b10xxxxxx begins a code point
    heads = pc.not_equal(pc.bit_wise_and(raw, pa.scalar(0xC0, pa.uint8())), pa.scalar(0x80, pa.uint8()))
    starts = pc.indices_nonzero(heads).cast(pa.int64())
    edges = pa.concat_arrays([starts, pa.array([high - low], pa.int64())])
    flat = pa.LargeStringArray.from_buffers(len(starts), edges.buffers()[1], data.slice(low, high - low) if high > low else pa.py_buffer(b""))
    before = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(heads.cast(pa.int64()))])
    return pa.LargeListArray.from_arrays(pc.take(before, pc.subtract(ends, low)), flat)


def cut(texts: pa.LargeStringArray, base: pa.Array, first: pa.Array, second: pa.Array) -> tuple[list[pa.Array], pa.Array]:
    """The prefix, middle and suffix of each text, and its units.

    ``base`` counts the units before the text where it continues another.
    """
    lists = units(texts)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    ordinal = pc.add(pa.array(np.arange(len(flat))), pc.take(pc.subtract(base, lists.offsets.slice(0, len(lists))), parent))
    early, late = pc.less(ordinal, pc.take(first, parent)), pc.greater_equal(ordinal, pc.take(second, parent))
    pieces = []
    for role in (early, pc.invert(pc.or_(early, late)), pc.and_not(late, early)):
        # a running count of the role's units turns the old list bounds into those of the filtered lists
        counted = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(role.cast(pa.int64()))])
        rebuilt = pa.LargeListArray.from_arrays(pc.take(counted, lists.offsets), pc.filter(flat, role))
        pieces.append(pc.binary_join(rebuilt, pa.scalar("", pa.large_string())))
    return pieces, pc.list_value_length(lists)


def _segments(text: pa.LargeStringScalar, size: int) -> Iterator[pa.LargeStringArray]:
    """A long text in parts of at most ``size`` bytes, cut between code points."""
    raw = memoryview(text.as_buffer())
    at = 0
    while at < len(raw):
        stop = min(len(raw), at + size)
        while stop < len(raw) and raw[stop] & 0xC0 == 0x80:
            stop -= 1
        yield pa.array([bytes(raw[at:stop])], pa.large_binary()).cast(pa.large_string())
        at = stop


def _pieces(texts: pa.LargeStringArray, first: pa.Array, second: pa.Array, size: int) -> list[pa.Array]:
    if len(texts) != 1 or pc.binary_length(texts)[0].as_py() <= size:
        return cut(texts, pa.array([0] * len(texts), pa.int64()), first, second)[0]
    parts, base = [], 0
    for part in _segments(texts[0], size):
        pieces, n = cut(part, pa.array([base], pa.int64()), first, second)
        parts.append(pieces)
        base += n[0].as_py()
    bounds = pa.array([0, len(parts)], pa.int64())
    return [pc.binary_join(pa.LargeListArray.from_arrays(bounds, pa.concat_arrays([p[role] for p in parts])), pa.scalar("", pa.large_string()))
            for role in range(3)]


def transform(texts: pa.LargeStringArray, form: pa.Array, first: pa.Array, second: pa.Array, sentinels: Sentinels = SENTINELS,
              size: int = SEGMENT_BYTES) -> pa.Array:
    """The output text of each row."""
    prefix, middle, suffix = _pieces(texts, first, second, size)
    own = {sentinels.prefix: prefix, sentinels.suffix: suffix, sentinels.middle: middle}
    psm, spm = (pc.binary_join_element_wise(*[x for mark in sentinels.order(f) for x in (pa.scalar(mark, pa.large_string()), own[mark])],
                                            pa.scalar("", pa.large_string())) for f in ("psm", "spm"))
    return pc.if_else(pc.equal(form, "plain"), texts, pc.if_else(pc.equal(form, "psm"), psm, spm))


def fill_in_middle(docs: DataFrame, seed: int = SEED, sentinels: Sentinels = SENTINELS, cut_percent: int = CUT_PERCENT,
                   suffix_first_percent: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """Per row: doc_id, n, form, prefix_chars, middle_chars (null if plain) and ``output``."""
    rows = planned(docs, seed, sentinels, cut_percent, suffix_first_percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                out = transform(piece.column("text").cast(pa.large_string()), piece.column("form").cast(pa.string()),
                                piece.column("first"), piece.column("second"), sentinels)
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in ("doc_id", "n", "form", "first", "second")] + [out.cast(pa.string())],
                                                 names=["doc_id", "n", "form", "first", "second", "output"])

    kind = dict(docs.dtypes)["doc_id"]
    done = rows.mapInArrow(run, f"doc_id {kind}, n long, form string, first long, second long, output string")
    is_cut = F.col("form") != "plain"
    return done.select("doc_id", "n", "form", F.when(is_cut, F.col("first")).alias("prefix_chars"),
                       F.when(is_cut, F.col("second") - F.col("first")).alias("middle_chars"), "output")


def restored(output: Column, form: Column, sentinels: Sentinels = SENTINELS) -> Column:
    """The text that a transformed output came from; exact, as no cut text holds a sentinel."""
    def between(left: str, right: str | None) -> Column:
        rest = F.substring_index(output, left, -1)
        return F.substring_index(rest, right, 1) if right else rest

    psm = F.concat(between(sentinels.prefix, sentinels.suffix), between(sentinels.middle, None), between(sentinels.suffix, sentinels.middle))
    spm = F.concat(between(sentinels.prefix, sentinels.middle), between(sentinels.middle, None), between(sentinels.suffix, sentinels.prefix))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


@query("op13_fill_middle", sql="""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || doc_id::VARCHAR) AS d FROM documents),
h AS (SELECT doc_id, x, length(x) AS n, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
      ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM t),
p AS (SELECT doc_id, x, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain'
           WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT *, substr(x, 1, a) AS pre, substr(x, a + 1, b - a) AS mid, substr(x, b + 1) AS suf FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(x) AS restored_sha256
FROM c""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))

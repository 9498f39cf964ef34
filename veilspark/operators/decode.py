"""Token-label and token-score decoding into character spans.

Inputs are long tables keyed by ``doc_id``:

* token labels ``(doc_id, tok_idx, tok_start, tok_end, label)`` with BIOES
  strings (``O``, ``B-x``, ``I-x``, ``E-x``, ``S-x`` or a bare ``x``);
* token scores ``(doc_id, window_id, tok_idx, label_idx, logprob)``.

Sequence decoding folds over one document's tokens in ``tok_idx`` order
(``aggregate`` over a sorted ``collect_list``); the group is one document,
so its size is bounded by the document. Per-token work (window merge,
softmax, arg-max) is plain grouped aggregation with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import chain, first_after, let, running_sum
from ..functions.rules import PII_CATEGORIES, RULES
from ..functions.text import blocks, cut, py_strip
from .detect import all_rule_spans
from .redact import SPAN_T
from .tokens import overlaps, token_spans

# FIXED VALUES: detection label -> span category of the classifier label space.
DETECT_TO_CATEGORY = {
    "SECRET": "secret",
    "ACCOUNT": "account_number",
    "EMAIL": "private_email",
    "PHONE": "private_phone",
    "ADDRESS": "private_address",
    "DATE": "private_date",
    "URL": "private_url",
}
BUCKET_CHARS = 64


# ------------------------------------------------------------------ labels

def split_bioes(label) -> Column:
    """``struct<tag, entity>``: O -> (NULL, NULL); B/I/E/S-x (any case) -> (TAG, x); else ('S', label)."""
    lab = F.col(label) if isinstance(label, str) else label
    prefix = F.upper(F.substring_index(lab, "-", 1))
    has_sep = F.instr(lab, "-") > 0
    entity = F.substring(lab, F.instr(lab, "-") + 1, F.length(lab) + 1)
    is_tagged = has_sep & prefix.isin("B", "I", "E", "S")
    return (F.when(lab == "O", F.struct(F.lit(None).cast("string").alias("tag"), F.lit(None).cast("string").alias("entity")))
             .when(is_tagged, F.struct(prefix.alias("tag"), entity.alias("entity")))
             .otherwise(F.struct(F.lit("S").alias("tag"), lab.alias("entity"))))


def lookup_label(idx: Column) -> Column:
    """Label index to name, ``label_<i>`` outside the known range."""
    arr = F.array(*[F.lit(n) for n in PII_CATEGORIES])
    return F.when((idx >= 0) & (idx < len(PII_CATEGORIES)), F.element_at(arr, (idx + 1).cast("int"))) \
        .otherwise(F.concat(F.lit("label_"), idx.cast("string")))


def label_of(names: Column, idx: Column) -> Column:
    """The name that a label map (integer or text keys) has for an index; ``O`` if it has none or an empty one."""
    by_text = F.transform_keys(names, lambda k, v: k.cast("string"))
    return F.coalesce(F.nullif(F.try_element_at(by_text, idx.cast("string")), F.lit("")), F.lit("O"))


# ------------------------------------------------------------------ range join

def overlap_join(tokens: DataFrame, spans: DataFrame, key: str = "doc_id", bucket: int = BUCKET_CHARS) -> DataFrame:
    """Pairs (token, span) whose half-open char ranges overlap.

    An equi-join on (doc, bucket) plus the overlap filter: each range is
    exploded into the fixed-width buckets it touches, and a pair is kept
    only in the bucket where its overlap starts, so no pair is duplicated and
    no document is compared all-tokens-by-all-spans.
    """
    t = tokens.select("*", F.explode(F.sequence(F.floor(F.col("tok_start") / bucket),
                                                F.floor((F.greatest(F.col("tok_end"), F.col("tok_start") + 1) - 1) / bucket)))
                      .alias("_b"))
    s = spans.select(F.col(key), F.col("span_id"), F.col("rule"), F.col("label").alias("det_label"),
                     F.col("start").alias("s_start"), F.col("end").alias("s_end"),
                     F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))).alias("_b"))
    j = t.join(s, [key, "_b"])
    ov_start = F.greatest(F.col("tok_start"), F.col("s_start"))
    return j.where((F.col("tok_start") < F.col("s_end")) & (F.col("tok_end") > F.col("s_start"))
                   & (F.floor(ov_start / bucket) == F.col("_b"))).drop("_b")


def labelled_tokens(text) -> Column:
    """``array<struct<tok_start,tok_end,piece,label>>``: a text's tokens with BIOES labels from its detected spans.

    A token covered by several spans takes the span of the lowest rule index
    (then earliest start). Within its span the first token is B, the last E,
    the others I; a one-token span is S. Tokens and spans meet as sorted
    arrays in the row; nothing is shuffled.
    """
    cat = F.create_map(*[x for kv in DETECT_TO_CATEGORY.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])

    def best(b: Column) -> Column:
        """One (rule, start, token, category) for each covered token, by span."""
        def own(x: Column) -> Column:
            s = F.get(b["spans"], x["span_idx"])
            return F.struct(x["tok_idx"].alias("t"), s["rule"].alias("rule"), s["start"].alias("start"), s["label"].alias("label"))
        ranked = F.sort_array(F.transform(overlaps(b["toks"], b["spans"]), own))
        first = let(ranked, lambda r: F.filter(r, lambda x, i: (i == 0) | (x["t"] != F.get(r, i - 1)["t"])))
        return F.sort_array(F.transform(first, lambda x: F.struct(x["rule"].alias("rule"), x["start"].alias("start"), x["t"].alias("t"),
                                                                  F.element_at(cat, x["label"]).alias("category"))))

    def named(p: Column) -> Column:
        def label(x: Column, i: Column) -> Column:
            def apart(k: Column) -> Column:
                y = F.get(p, k)
                return F.coalesce((y["rule"] != x["rule"]) | (y["start"] != x["start"]), F.lit(True))
            begins, ends = (i == 0) | apart(i - 1), apart(i + 1)
            tag = F.when(begins & ends, "S").when(begins, "B").when(ends, "E").otherwise("I")
            return F.struct(x["t"].alias("t"), F.lit(0).alias("is_token"), F.concat(tag, F.lit("-"), x["category"]).alias("label"))
        return F.transform(p, label)

    def merged(toks: Column, labels: Column) -> Column:
        """Tokens and labels in one order: a token's label stands right before it."""
        both = F.sort_array(F.concat(labels, F.transform(toks, lambda t, i: F.struct(i.alias("t"), F.lit(1).alias("is_token"), F.lit("O").alias("label")))))
        found = let(both, lambda m: F.filter(F.transform(m, lambda x, i: F.struct(x["is_token"].alias("is_token"), F.when(
            (i > 0) & (F.get(m, i - 1)["t"] == x["t"]), F.get(m, i - 1)["label"]).otherwise(x["label"]).alias("label"))), lambda x: x["is_token"] == 1))
        return F.zip_with(toks, found, lambda t, x: token(t, x["label"]))

    def token(t: Column, label: Column) -> Column:
        return F.struct(t["tok_start"].alias("tok_start"), t["tok_end"].alias("tok_end"), t["piece"].alias("piece"), label.alias("label"))

    def build(b: Column) -> Column:
        plain = F.transform(b["toks"], lambda t: token(t, F.lit("O")))
        return F.when(F.size(b["spans"]) == 0, plain).otherwise(merged(b["toks"], let(best(b), named)))

    return let(F.struct(token_spans(text).alias("toks"), all_rule_spans(text).alias("spans")), build)


def token_labels(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same as a long table ``(doc_id, tok_idx, tok_start, tok_end, piece, label)``."""
    t = docs.select("doc_id", F.posexplode(labelled_tokens(text_col)).alias("tok_idx", "t"))
    return t.select("doc_id", "tok_idx", "t.tok_start", "t.tok_end", "t.piece", "t.label")


# ------------------------------------------------------------------ BIOES fold

def _fold_step(allowed: Column | None):
    """One step of the BIOES state machine over (start, end, tag, entity, closers).

    Only labelled tokens are folded; ``closers`` counts the positive-width O
    tokens seen so far, and a change in it means an O closed the open span
    in between.
    """
    def ok(entity):
        return F.lit(True) if allowed is None else F.array_contains(allowed, entity)

    def emit(out, label, start, end):
        return F.concat(out, F.array(F.struct(label.alias("label"), start.cast("int").alias("start"),
                                              end.cast("int").alias("end"))))

    def flush(acc):
        can = acc["cl"].isNotNull() & acc["cs"].isNotNull() & acc["ce"].isNotNull() & (acc["cs"] < acc["ce"]) & ok(acc["cl"])
        return F.when(can, emit(acc["out"], acc["cl"], acc["cs"], acc["ce"])).otherwise(acc["out"])

    def state(cl, cs, ce, out, k):
        return F.struct(cl.cast("string").alias("cl"), cs.cast("int").alias("cs"), ce.cast("int").alias("ce"),
                        out.alias("out"), k.cast("long").alias("k"))

    null_s, null_i = F.lit(None).cast("string"), F.lit(None).cast("int")

    def body(acc, x):
        s, e, tag, ent, k = x["tok_start"], x["tok_end"], x["tag"], x["entity"], x["closers"]
        same = (acc["cl"] == ent) & acc["cs"].isNotNull()
        ext_end = F.greatest(F.coalesce(acc["ce"], e), e)
        return (F.when(s >= e, acc)
                 .when(tag == "S", state(null_s, null_i, null_i,
                                         F.when(ok(ent), emit(flush(acc), ent, s, e)).otherwise(flush(acc)), k))
                 .when(tag == "B", state(ent, s, e, flush(acc), k))
                 .when(tag == "I", F.when(same, state(acc["cl"], acc["cs"], ext_end, acc["out"], k))
                       .otherwise(state(ent, s, e, flush(acc), k)))
                 .when(tag == "E", F.when(same, state(null_s, null_i, null_i,
                                                      flush(state(acc["cl"], acc["cs"], ext_end, acc["out"], k)), k))
                       .otherwise(state(acc["cl"], acc["cs"], acc["ce"],
                                        F.when(ok(ent), emit(acc["out"], ent, s, e)).otherwise(acc["out"]), k)))
                 .otherwise(state(null_s, null_i, null_i, flush(acc), k)))

    def step(acc, x):
        # an O between the previous labelled token and this one closed the span
        closed = F.when(x["closers"] != acc["k"], state(null_s, null_i, null_i, flush(acc), x["closers"])).otherwise(acc)
        return F.element_at(F.transform(F.array(closed), lambda a: body(a, x)), 1)

    return step, flush, state


def bioes_spans(labels: DataFrame, allowed: list[str] | None = None, key: str = "doc_id") -> DataFrame:
    """``(key, spans array<struct<label,start,end>>)`` per document, exact BIOES rules:
    zero-width tokens skipped; O closes; S closes and emits itself; B closes and
    opens; I extends the same open entity, else closes and opens; E extends and
    closes the same open entity, else emits itself and leaves the open span
    open; the allowed-label filter acts only when a span is emitted.

    Every document is returned (``[]`` when nothing is labelled), but only
    its labelled tokens are collected and folded.
    """
    allowed_col = None if allowed is None else F.array(*[F.lit(a) for a in allowed])
    step, flush, state = _fold_step(allowed_col)
    sb = split_bioes("label")
    w = Window.partitionBy(key).orderBy("tok_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    closing = (sb["entity"].isNull() & (F.col("tok_start") < F.col("tok_end"))).cast("long")
    t = labels.select(key, "tok_idx", "tok_start", "tok_end", sb["tag"].alias("tag"), sb["entity"].alias("entity"),
                      F.sum(closing).over(w).alias("closers"))
    item = F.when(F.col("entity").isNotNull(), F.struct("tok_idx", "tok_start", "tok_end", "tag", "entity", "closers"))
    g = t.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("ts"))
    init = state(F.lit(None), F.lit(None), F.lit(None), F.array().cast(SPAN_T), F.lit(0))
    return g.select(key, F.aggregate("ts", init, step, lambda acc: flush(acc)).alias("spans"))


def row_spans(toks: Column, allowed: list[str] | None = None) -> Column:
    """The same spans for one row's labelled tokens (``array<struct<tok_start,tok_end,label>>``, in order)."""
    step, flush, state = _fold_step(None if allowed is None else F.array(*[F.lit(a) for a in allowed]))
    init = state(F.lit(None), F.lit(None), F.lit(None), F.array().cast(SPAN_T), F.lit(0))

    def fold(ts: Column) -> Column:
        # closing tokens before a labelled one: all tokens before it but the labelled ones and those that close nothing
        labelled = F.filter(F.transform(ts, lambda t, i: F.struct(i.alias("i"), t["tok_start"].alias("tok_start"), t["tok_end"].alias("tok_end"),
                                                                  t["label"].alias("label"))), lambda x: x["label"] != "O")
        idle = F.filter(F.transform(ts, lambda t, i: F.when(t["label"].isNull() | ((t["label"] == "O") & ~F.coalesce(t["tok_start"] < t["tok_end"], F.lit(False))), i)),
                        lambda i: i.isNotNull())

        def items(b: Column) -> Column:
            def one(x: Column, j: Column) -> Column:
                closers = x["i"] - j - F.when(F.size(b["idle"]) > 0, first_after(b["idle"], x["i"], True)).otherwise(0)
                return let(split_bioes(x["label"]), lambda sb: F.struct(
                    x["tok_start"].alias("tok_start"), x["tok_end"].alias("tok_end"), sb["tag"].alias("tag"), sb["entity"].alias("entity"), closers.cast("long").alias("closers")))
            return F.transform(b["labelled"], one)
        return let(F.struct(labelled.alias("labelled"), idle.alias("idle")), lambda b: F.aggregate(items(b), init, step, lambda acc: flush(acc)))
    return let(toks, fold)


def row_index_spans(toks: Column, allowed: list[str] | None = None) -> Column:
    """Spans over token indices of one row's labelled tokens."""
    return row_spans(F.transform(toks, lambda t, i: F.struct(i.alias("tok_start"), (i + 1).alias("tok_end"), t["label"].alias("label"))), allowed)


def row_char_spans(index: Column, toks: Column) -> Column:
    """Token-index spans as character spans: start of the first token, end of the last."""
    return F.transform(index, lambda s: F.struct(s["label"].alias("label"), F.get(toks, s["start"])["tok_start"].alias("start"),
                                                 F.get(toks, s["end"] - 1)["tok_end"].alias("end")))


def decoded(pieces: Column) -> Column:
    """``struct<text,starts,ends>``: pieces put together again, with the character range of each in the result.

    The ranges are a running sum of the pieces' lengths, so they are right for
    a text that differs from the one the tokens came from.
    """
    def build(p: Column) -> Column:
        return let(running_sum(F.transform(p, lambda x: F.length(x))), lambda ends: F.struct(
            F.array_join(p, "").alias("text"), F.zip_with(ends, p, lambda e, x: e - F.length(x)).alias("starts"), ends.alias("ends")))
    return let(pieces, build)


def decoded_spans(index: Column, text: Column) -> Column:
    """Token-index spans as character spans of a :func:`decoded` text."""
    return F.transform(index, lambda s: F.struct(s["label"].alias("label"), F.get(text["starts"], s["start"]).alias("start"),
                                                 F.get(text["ends"], s["end"] - 1).alias("end")))


def index_spans(labels: DataFrame, allowed: list[str] | None = None, key: str = "doc_id") -> DataFrame:
    """Labels by token index -> token-index spans (DEC-2 rules on [i, i+1))."""
    lab = labels.select(key, "tok_idx", F.col("tok_idx").alias("tok_start"), (F.col("tok_idx") + 1).alias("tok_end"), "label")
    return bioes_spans(lab, allowed, key)


def token_to_char_spans(tok_spans: DataFrame, tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Token-index spans -> char spans: start of the first token, end of the last."""
    s = tok_spans.select(key, F.posexplode("spans").alias("span_ord", "s")).select(
        key, "span_ord", F.col("s.label").alias("label"), F.col("s.start").alias("t0"), (F.col("s.end") - 1).alias("t1"))
    a = tokens.select(key, F.col("tok_idx").alias("t0"), F.col("tok_start").alias("start"))
    b = tokens.select(key, F.col("tok_idx").alias("t1"), F.col("tok_end").alias("end"))
    return s.join(a, [key, "t0"]).join(b, [key, "t1"]).select(key, "span_ord", "label", "start", "end")


# ------------------------------------------------------------------ scores

def windows(labels: DataFrame, ctx: int, stride: int) -> DataFrame:
    """Assign each token to every window [w*stride, w*stride+ctx) that holds it."""
    lo = F.greatest(F.lit(0), F.ceil((F.col("tok_idx") - ctx + 1) / stride))
    hi = F.floor(F.col("tok_idx") / stride)
    return labels.select("*", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))).alias("window_id"))


def _logsumexp(arr: Column) -> Column:
    """max + log(sum(exp(x - max))), with the max let-bound (not recomputed per element)."""
    bound = F.array(F.struct(arr.alias("v"), F.array_max(arr).alias("m")))
    return F.element_at(F.transform(bound, lambda b: b["m"] + F.log(
        F.aggregate(b["v"], F.lit(0.0), lambda a, x: a + F.exp(x - b["m"])))), 1)


def log_softmax(scores: DataFrame) -> DataFrame:
    """logits - logsumexp(logits), per token occurrence, inside the row (no shuffle)."""
    # let-bind (logits, lse) so the normaliser is computed once per row, not per class
    pair = F.array(F.struct(F.col("logits").alias("v"), _logsumexp(F.col("logits")).alias("l")))
    bound = F.element_at(F.transform(pair, lambda b: F.transform(b["v"], lambda x: x - b["l"])), 1)
    return scores.select("doc_id", "window_id", "tok_idx", bound.alias("logprob"))


def merge_windows(scores: DataFrame) -> DataFrame:
    """Log-mean-exp of each class's log-prob over the windows that scored the token.

    One shuffle keyed by (doc, token); a token appears in at most
    ceil(ctx / stride) windows, so each group is tiny. The windows are folded
    pairwise with ``zip_with`` and log-add-exp (max(a, b) + log1p(exp(-|a - b|))),
    then ln(count) is subtracted. Two windows that both say -inf stay -inf.
    Rows whose ``mask`` (if that column is there) is not set and rows with a
    negative position take no part.
    """
    if "mask" in scores.columns:
        scores = scores.where(F.coalesce(F.col("mask").cast("boolean"), F.lit(False)))
    scores = scores.where(F.col("tok_idx") >= 0)
    g = scores.groupBy("doc_id", "tok_idx").agg(F.collect_list("logprob").alias("ws"))

    def logaddexp(a, b):
        top = F.greatest(a, b)
        return F.when(top == F.lit(float("-inf")), top).otherwise(top + F.log1p(F.exp(-F.abs(a - b))))

    folded = F.aggregate(F.slice("ws", 2, F.greatest(F.size("ws") - 1, F.lit(1))), F.col("ws")[0],
                         lambda acc, w: F.zip_with(acc, w, logaddexp))
    n = F.log(F.size("ws").cast("double"))
    merged = F.when(F.size("ws") == 1, F.col("ws")[0]).otherwise(folded)
    return g.select("doc_id", "tok_idx", F.transform(merged, lambda x: x - n).alias("score"))


# ------------------------------------------------------------------ score blocks

def token_windows(toks: Column, ctx: int, stride: int) -> Column:
    """``array<struct<window_id,first,toks>>``: a row's tokens cut into overlapping windows."""
    last = F.floor((F.size(toks) - 1) / stride).cast("int")
    cut_out = lambda w: F.struct(w.cast("long").alias("window_id"), (w * stride).alias("first"), F.slice(toks, w * stride + 1, ctx).alias("toks"))
    return F.when(F.size(toks) > 0, F.transform(F.sequence(F.lit(0), last), cut_out))


BLOCK_T = "doc_id long, window_id long, first int, logprob array<double>"


def _values(batch, name: str, classes: int):
    """The scores of a batch's blocks, a row per token, and each block's number of tokens."""
    import numpy as np

    column = batch.column(name)
    column = column.fill_null([]) if column.null_count else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, classes)
    return flat, np.diff(column.offsets.to_numpy()) // classes


#: Numbers of one slice of a batch: what numpy works on at once, whatever the size of Spark's Arrow batches.
SLICE = 1 << 20


def slices(batches, column: str, most: int):
    """The batches in slices of rows whose lists in ``column`` hold about ``most`` elements together (a row at least)."""
    import numpy as np

    for batch in batches:
        ends = np.cumsum(np.diff(batch.column(column).offsets.to_numpy()))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


class Dealt:
    """Rows of which those of a document lie in one partition, ordered by ``doc_id`` and ``first``, and steps over their
    Arrow batches. The steps run one after the other in one Python worker: what is between two of them, scores for
    the most part, is neither handed back to Spark nor shuffled, and is a slice at a time.
    """

    def __init__(self, rows: DataFrame, steps: tuple = ()):
        self.rows, self.steps = rows, steps

    def then(self, step) -> Dealt:
        return Dealt(self.rows, (*self.steps, step))

    def frame(self, schema: str) -> DataFrame:
        """What the last step yields."""
        steps = self.steps

        def run(batches):
            for step in steps:
                batches = step(batches)
            return batches

        return self.rows.mapInArrow(run, schema)


def log_softmax_blocks(blocks: DataFrame | Dealt, classes: int, scores: str = "logits") -> DataFrame | Dealt:
    """``logprob`` of each block: a window's scores, ``classes`` numbers per token from token ``first`` on.

    A block is one array, worked on by numpy for a slice of an Arrow batch at once; nothing is shuffled.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches, scores, SLICE):
            flat, n = _values(batch, scores, classes)
            top = flat.max(axis=1, keepdims=True, initial=-np.inf) if len(flat) else flat[:, :1]
            top = np.where(np.isfinite(top), top, 0.0)
            with np.errstate(divide="ignore"):
                out = flat - (top + np.log(np.exp(flat - top).sum(axis=1, keepdims=True)))
            bounds = np.concatenate([[0], np.cumsum(n) * classes]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "window_id", "first")),
                                              pa.ListArray.from_arrays(pa.array(bounds), pa.array(out.reshape(-1)))], names=["doc_id", "window_id", "first", "logprob"])

    if isinstance(blocks, Dealt):
        return blocks.then(run)
    return blocks.select("doc_id", "window_id", F.col("first").cast("int").alias("first"), scores).mapInArrow(run, BLOCK_T)


def _joined(owner, spot, flat, counts):
    """(owner, spot, sum, count) of each token: the log of the summed probabilities of its rows, and their windows."""
    import numpy as np

    order = np.lexsort((spot, owner))
    owner, spot, flat, counts = owner[order], spot[order], flat[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (spot[1:] != spot[:-1])]))
    return owner[new], spot[new], np.logaddexp.reduceat(flat, new, axis=0), np.add.reduceat(counts, new)


def merge_blocks(blocks: DataFrame | Dealt, classes: int, segment: int = 64) -> DataFrame | Dealt:
    """``(doc_id, tok_idx, score)``: log-mean-exp of each class over the windows that scored a token.

    Blocks that arrive together are merged before the exchange, so a token that
    several of them scored crosses it once: a document's windows lie one after
    the other. The result is cut where ``segment`` divides the token's position;
    the pieces of a (document, segment) meet in one exchange, a block of sums
    and the windows behind each token, and are merged by numpy over many
    segments at once. A long document is many segments.

    Blocks that are :class:`Dealt` need no exchange: a token is done once a block of its document begins behind it.
    """
    def spots(first, n):
        import numpy as np

        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first.astype(np.int64), n)

    def scored(owner, spot, total, counts):
        import numpy as np
        import pyarrow as pa

        score = total - np.log(counts)[:, None]
        bounds = np.arange(len(owner) + 1, dtype=np.int32) * classes
        return pa.RecordBatch.from_arrays([pa.array(owner), pa.array(spot.astype(np.int32)),
                                           pa.ListArray.from_arrays(pa.array(bounds), pa.array(score.reshape(-1)))], names=["doc_id", "tok_idx", "score"])

    def in_order(batches):
        import numpy as np
        import pyarrow.compute as pc

        held = None  # tokens of the last document that a later block may score as well
        for batch in slices((b.filter(pc.greater_equal(b.column("first"), 0)) for b in batches), "logprob", SLICE):
            flat, n = _values(batch, "logprob", classes)
            doc, first = (batch.column(c).to_numpy() for c in ("doc_id", "first"))
            tokens = (np.repeat(doc, n), spots(first, n), flat, np.ones(len(flat), dtype=np.int64))
            if held is not None:
                tokens = tuple(np.concatenate(x) for x in zip(held, tokens))
            if not len(tokens[0]):
                continue
            tokens = _joined(*tokens)
            still = (tokens[0] == doc[-1]) & (tokens[1] >= first[-1])
            if not still.all():
                yield scored(*(x[~still] for x in tokens))
            held = tuple(x[still] for x in tokens)
        if held is not None and len(held[0]):
            yield scored(*held)

    if isinstance(blocks, Dealt):
        return blocks.then(in_order)

    def combine(batches):
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches, "logprob", SLICE):
            flat, n = _values(batch, "logprob", classes)
            doc, first = (batch.column(c).to_numpy() for c in ("doc_id", "first"))
            if not n.sum():
                continue
            owner, spot, total, counts = _joined(np.repeat(doc, n), spots(first, n), flat, np.ones(len(flat), dtype=np.int64))
            # a piece is a stretch of neighbouring tokens of one document and segment
            new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (spot[1:] != spot[:-1] + 1) | (spot[1:] % segment == 0)]))
            ends = np.append(new, len(owner)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(owner[new]), pa.array(spot[new] // segment), pa.array(spot[new].astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(ends * np.int32(classes)), pa.array(total.reshape(-1))),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(counts.astype(np.int32)))], names=["doc_id", "segment", "first", "logprob", "counts"])

    rows = blocks.where("size(logprob) > 0 AND first >= 0").select("doc_id", "first", "logprob")
    pieces = rows.mapInArrow(combine, "doc_id long, segment long, first int, logprob array<double>, counts array<int>")
    dealt = pieces.repartition("doc_id", "segment").sortWithinPartitions("doc_id", "segment")

    def run(batches):
        import numpy as np

        def merged(parts):
            doc, segs, first, n, flat, windows = (np.concatenate([p[i] for p in parts]) for i in range(6))
            return scored(*_joined(np.repeat(doc, n), spots(first, n), flat, windows))

        held = []
        for batch in slices(batches, "logprob", SLICE):
            flat, n = _values(batch, "logprob", classes)
            windows = batch.column("counts").flatten().to_numpy()
            doc, segs, first = (batch.column(c).to_numpy() for c in ("doc_id", "segment", "first"))
            # the last segment may go on in the next slice
            go = np.flatnonzero((doc != doc[-1]) | (segs != segs[-1]))
            cut_at = int(go[-1]) + 1 if len(go) else 0
            at = int(n[:cut_at].sum())
            if cut_at or (held and (held[-1][0][-1], held[-1][1][-1]) != (doc[-1], segs[-1])):
                done = held + ([(doc[:cut_at], segs[:cut_at], first[:cut_at], n[:cut_at], flat[:at], windows[:at])] if cut_at else [])
                held = []
                yield merged(done)
            held.append((doc[cut_at:], segs[cut_at:], first[cut_at:], n[cut_at:], flat[at:], windows[at:]))
        if held:
            yield merged(held)

    return dealt.mapInArrow(run, "doc_id long, tok_idx int, score array<double>")


def argmax_labels(merged: DataFrame) -> DataFrame:
    """Best class per token; ties go to the lowest class index."""
    return merged.select("doc_id", "tok_idx",
                         (F.array_position("score", F.array_max("score")) - 1).cast("int").alias("label_idx"))


def class_names() -> list[str]:
    return ["O"] + [f"{t}-{c}" for c in PII_CATEGORIES for t in ("B", "I", "E", "S")]


def legal_moves(names: list[str]):
    """(start, move, end) scores of BIOES labels: 0 where legal, -inf elsewhere.

    O, E and S may be followed by O, B, S; B-x and I-x by I-x or E-x; a path
    begins with O, B or S and ends with O, E or S.
    """
    import numpy as np

    tag = [n.split("-", 1)[0] for n in names]
    entity = [n.split("-", 1)[1] if "-" in n else None for n in names]
    closed, opening = np.array([t in "OES" for t in tag]), np.array([t in "OBS" for t in tag])
    same = np.array([[a == b for b in entity] for a in entity])
    inside = np.array([t in "IE" for t in tag])
    legal = np.where(closed[:, None], opening[None, :], inside[None, :] & same)
    return tuple(np.where(x, 0.0, -np.inf) for x in (opening, legal, closed))


def best_paths(scores, starts, lengths, moves):
    """The best legal path of each sequence; the arg-max of each token where no path is legal.

    ``scores`` holds the tokens of all sequences one after the other. All
    sequences advance one token at a time together; of ties the lowest label wins.
    """
    import numpy as np

    start, move, end = moves
    path = scores.argmax(axis=1) if len(scores) else np.zeros(0, dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    first, size = starts[order], lengths[order]
    if not len(size) or not size[0]:
        return path
    alive = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right")  # sequences of more than t tokens
    back = np.zeros(scores.shape, dtype=np.int8 if scores.shape[1] < 128 else np.int32)
    now = scores[first[:alive[0]]] + start
    last = np.empty((len(size), scores.shape[1]))
    last[:alive[0]] = now
    kinds, kind = np.unique(move, axis=1, return_inverse=True)  # many labels may follow the same ones
    kinds, kind = np.ascontiguousarray(kinds.T), kind.reshape(-1)
    for t in range(1, len(alive)):
        n = alive[t]
        reach = now[:n, None, :] + kinds[None]
        came = reach.argmax(axis=2)
        at = first[:n] + t
        back[at] = came[:, kind]
        now = np.take_along_axis(reach, came[:, :, None], axis=2)[:, kind, 0] + scores[at]
        last[:n] = now
    last[size > 0] += end
    state = last.argmax(axis=1)
    legal = (size > 0) & np.isfinite(last[np.arange(len(size)), state])
    for t in range(len(alive) - 1, -1, -1):
        live = np.flatnonzero(legal[:alive[t]])
        at = first[live] + t
        path[at] = state[live]
        if t:
            state[live] = back[at, state[live]]
    return path


def viterbi(merged: DataFrame | Dealt) -> DataFrame:
    """Best legal BIOES path per document: each token's label, its ``score`` and the largest one (``top``).

    Scores are dealt out by document in token order (unless they are
    :class:`Dealt` already), and numpy works on all documents of some slices
    at once; a document is never split over tasks, and takes 33 bytes of back
    pointers a token.
    """
    moves = legal_moves(class_names())
    classes = len(class_names())

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def solved(parts):
            doc, tok, flat = (np.concatenate([p[i] for p in parts]) for i in range(3))
            first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            path = best_paths(flat, first, np.diff(np.append(first, len(doc))), moves)
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tok.astype(np.int32)), pa.array(path.astype(np.int32)),
                                               pa.array(flat[np.arange(len(doc)), path]), pa.array(flat.max(axis=1))],
                                              names=["doc_id", "tok_idx", "label_idx", "score", "top"])

        held = []
        for batch in slices(batches, "score", SLICE):
            flat, _ = _values(batch, "score", classes)
            doc, tok = (batch.column(c).to_numpy() for c in ("doc_id", "tok_idx"))
            go = np.flatnonzero(doc != doc[-1])
            at = int(go[-1]) + 1 if len(go) else 0
            if held and (at or held[-1][0][-1] != doc[-1]):
                yield solved(held + ([(doc[:at], tok[:at], flat[:at])] if at else []))
                held = []
            elif at:
                yield solved([(doc[:at], tok[:at], flat[:at])])
            held.append((doc[at:], tok[at:], flat[at:]))  # the last document may go on in the next slice
        if held:
            yield solved(held)

    paths = "doc_id long, tok_idx int, label_idx int, score double, top double"
    if isinstance(merged, Dealt):
        return merged.then(run).frame(paths)
    dealt = merged.select("doc_id", "tok_idx", "score").repartition("doc_id").sortWithinPartitions("doc_id", "tok_idx")
    return dealt.mapInArrow(run, paths)


def labels_from_index(pred: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(n) for n in class_names()])
    return pred.select("doc_id", "tok_idx", F.coalesce(F.element_at(names, F.col("label_idx") + 1), F.lit("O")).alias("label"))


# ------------------------------------------------------------------ fallback alignment

def fallback_spans(labels: DataFrame, texts: DataFrame, allowed: list[str] | None = None,
                   key: str = "doc_id") -> DataFrame:
    """Group consecutive tokens of one allowed entity (tags ignored), join and
    strip their pieces, and find that string in the text from the end of the
    previous hit, else from the start, else drop it."""
    ent = split_bioes("label")["entity"]
    ok = ent.isNotNull() if allowed is None else ent.isin(*allowed)
    t = labels.select(key, "tok_idx", "piece", F.when(ok, ent).alias("ent"))
    w = Window.partitionBy(key).orderBy("tok_idx")
    changed = (F.coalesce(F.lag("ent").over(w), F.lit("\u0000")) != F.coalesce(F.col("ent"), F.lit("\u0000"))).cast("int")
    isl = t.select("*", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("isl")).where(F.col("ent").isNotNull())
    groups = (isl.groupBy(key, "isl").agg(F.first("ent").alias("ent"),
                                          F.array_sort(F.collect_list(F.struct("tok_idx", "piece"))).alias("ps"))
                 .select(key, "isl", "ent",
                         F.regexp_replace(F.array_join(F.transform("ps", lambda p: p["piece"]), ""),
                                          r"^[\p{IsWhite_Space}\x{1c}-\x{1f}]+|[\p{IsWhite_Space}\x{1c}-\x{1f}]+$", "")
                         .alias("s")))
    per_doc = groups.where(F.col("s") != "").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("isl", "ent", "s"))).alias("gs"))
    j = per_doc.join(texts.select(key, "text"), key)
    init = F.struct(F.lit(0).alias("from"), F.array().cast(SPAN_T).alias("out"))

    def step(acc, g):
        at = F.call_function("locate", g["s"], F.col("text"), acc["from"] + 1)
        at2 = F.when(at > 0, at).otherwise(F.call_function("locate", g["s"], F.col("text"), F.lit(1)))
        start = at2 - 1
        end = start + F.length(g["s"])
        return F.when(at2 > 0, F.struct(end.cast("int").alias("from"),
                                        F.concat(acc["out"], F.array(F.struct(g["ent"].alias("label"), start.cast("int").alias("start"),
                                                                              end.cast("int").alias("end")))).alias("out"))) \
            .otherwise(acc)

    return j.select(key, F.aggregate("gs", init, step, lambda a: a["out"]).alias("spans"))


def row_fallback_spans(toks: Column, text: Column, allowed: list[str] | None = None) -> Column:
    """The same spans for one row's labelled tokens (``array<struct<piece,label>>``, in order) and text; ``[]`` if there are none."""
    def entity(t: Column) -> Column:
        ent = split_bioes(t["label"])["entity"]
        return ent if allowed is None else F.when(ent.isin(*allowed), ent)

    def grouped(items: Column) -> Column:
        """One (entity, string) for each run of neighbouring tokens of one entity."""
        def goes_on(x: Column, k: Column) -> Column:
            before = F.get(items, k - 1)
            return (k > 0) & (before["i"] == x["i"] - 1) & (before["ent"] == x["ent"])
        starts = F.filter(F.transform(items, lambda x, k: F.when(~goes_on(x, k), k)), lambda k: k.isNotNull())

        def group(b: Column, k: Column, j: Column) -> Column:
            own = F.slice(items, k + 1, F.coalesce(F.get(b, j + 1), F.size(items)) - k)
            return F.struct(F.get(items, k)["ent"].alias("ent"), py_strip(F.array_join(F.transform(own, lambda x: x["piece"]), "")).alias("s"))
        return let(starts, lambda b: F.filter(F.transform(b, lambda k, j: group(b, k, j)), lambda g: g["s"] != ""))

    def step(acc: Column, g: Column) -> Column:
        at = F.call_function("locate", g["s"], text, acc["from"] + 1)
        found = F.when(at > 0, at).otherwise(F.call_function("locate", g["s"], text, F.lit(1)))

        def placed(start: Column) -> Column:
            end = (start + F.length(g["s"])).cast("int")
            return F.struct(end.alias("from"), F.concat(acc["out"], F.array(F.struct(
                g["ent"].alias("label"), start.cast("int").alias("start"), end.alias("end")))).alias("out"))
        return let(found, lambda x: F.when(x > 0, placed(x - 1)).otherwise(acc))

    items = F.filter(F.transform(toks, lambda t, i: F.struct(i.alias("i"), F.when(t["label"] != "O", entity(t)).alias("ent"), t["piece"].alias("piece"))),
                     lambda x: x["ent"].isNotNull())
    init = F.struct(F.lit(0).alias("from"), F.array().cast(SPAN_T).alias("out"))
    return let(items, lambda b: F.when(F.size(b) == 0, F.array().cast(SPAN_T)).otherwise(F.aggregate(grouped(b), init, step, lambda a: a["out"])))


def by_key(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows whose key comes once, rows whose key comes again): what is keyed by document can be worked out in the row for the first."""
    n = docs.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    return n.where("_n = 1").drop("_n"), n.where("_n > 1").drop("_n")


# ------------------------------------------------------------------ span post-processing

def valid_spans(spans, text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    sp = F.col(spans) if isinstance(spans, str) else spans
    return let(F.struct(sp.alias("s"), F.length(t).alias("n")), lambda b: F.filter(
        b["s"], lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= b["n"])))


def allowed_spans(spans, categories=PII_CATEGORIES) -> Column:
    cats = F.array(*[F.lit(c) for c in categories])
    return F.filter(spans, lambda s: F.array_contains(cats, s["label"]))


_WS = r"[\p{IsWhite_Space}\x{1c}-\x{1f}]*"


def trim_spans(spans, text) -> Column:
    """Move span edges inward past whitespace (an all-space span becomes empty)."""
    t = F.col(text) if isinstance(text, str) else text
    sp = F.col(spans) if isinstance(spans, str) else spans

    def one(s, body):
        lead = F.length(F.regexp_extract(body, "^" + _WS, 0))
        trail = F.length(F.regexp_extract(body, _WS + "$", 0))
        new_start = s["start"] + lead
        new_end = F.greatest(new_start, s["end"] - trail)
        return F.struct(s["label"].alias("label"), new_start.cast("int").alias("start"), new_end.cast("int").alias("end"))

    def all_of(b):
        inside = lambda s: cut(b["p"], F.greatest(s["start"], F.lit(0)), F.least(s["end"], b["n"]))
        return F.transform(b["s"], lambda s: let(inside(s), lambda body: one(s, body)))

    return let(F.struct(sp.alias("s"), blocks(t).alias("p"), F.length(t).alias("n")), all_of)


def _greedy(spans, same_label_only: bool) -> Column:
    """Keep spans greedily by (start asc, length desc); drop any overlapping a kept one.

    Sorted by start, the span kept after a kept one is the first that begins
    at its end or later: the kept spans are a chain of such steps. An empty
    span stays unless it lies strictly inside a kept one.
    """
    sp = F.col(spans) if isinstance(spans, str) else spans
    group = (lambda s: s["label"]) if same_label_only else (lambda s: F.lit(""))
    keyed = F.transform(sp, lambda s, i: F.struct(group(s).alias("group"), s["start"].alias("start"), (s["start"] - s["end"]).alias("less"),
                                                  i.alias("ord"), s["end"].alias("end"), s["label"].alias("label")))

    def place(s, at: str):
        return F.struct(s["group"].alias("group"), s[at].alias("start"))

    def following(full):
        return let(F.transform(full, lambda s: place(s, "start")), lambda starts: F.transform(
            full, lambda s: first_after(starts, place(s, "end"), True)))

    def chosen(full):
        return F.when(F.size(full) == 0, full).otherwise(F.transform(chain(following(full), F.array(F.lit(0))), lambda i: F.get(full, i)))

    def with_empty(empty, kept):
        starts = F.transform(kept, lambda s: place(s, "start"))

        def inside(s, begins):
            return let(F.get(kept, first_after(begins, place(s, "end"), True) - 1),
                       lambda k: F.coalesce((k["group"] == s["group"]) & (k["start"] < s["end"]) & (s["start"] < k["end"]), F.lit(False)))
        return F.when(F.size(empty) == 0, kept).otherwise(let(starts, lambda begins: F.concat(
            kept, F.filter(empty, lambda s: (F.size(kept) == 0) | ~inside(s, begins)))))

    def in_order(found):
        ordered = F.sort_array(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["less"].alias("less"), s["ord"].alias("ord"),
                                                                     s["end"].alias("end"), s["label"].alias("label"))))
        return F.transform(ordered, lambda s: F.struct(s["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end")))

    def select(b):
        empty = F.filter(b, lambda s: s["less"] >= 0)
        kept = let(F.filter(b, lambda s: s["less"] < 0), chosen)
        return let(kept, lambda k: in_order(with_empty(empty, k)))

    return let(F.sort_array(keyed), select)


def discard_overlapping_by_label(spans) -> Column:
    return _greedy(spans, True)


def select_non_overlapping(spans) -> Column:
    return _greedy(spans, False)


def detected_records(spans, text, mode: str = "typed") -> Column:
    """``struct<label,start,end,text,placeholder>`` per span; ``masked`` maps every label to one."""
    t = F.col(text) if isinstance(text, str) else text
    sp = F.col(spans) if isinstance(spans, str) else spans

    def one(s, b):
        label = s["label"] if mode == "typed" else F.lit("pii")
        return F.struct(label.alias("label"), s["start"].alias("start"), s["end"].alias("end"),
                        cut(b["p"], F.greatest(s["start"], F.lit(0)), F.least(s["end"], b["n"])).alias("text"),
                        F.concat(F.lit("["), F.upper(label), F.lit("]")).alias("placeholder"))

    return let(F.struct(sp.alias("s"), blocks(t).alias("p"), F.length(t).alias("n")), lambda b: F.transform(b["s"], lambda s: one(s, b)))


def rule_spans_as_categories(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with ``spans``: its detected spans with category labels, NULL if it has none.

    Spans are built in the row that holds the text; nothing is shuffled.
    """
    cat = F.create_map(*[x for kv in DETECT_TO_CATEGORY.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    found = F.sort_array(F.transform(all_rule_spans(text_col, rules), lambda x: F.struct(x["start"], x["end"], x["rule"], x["label"])))
    bound = F.array(F.transform(found, lambda x: F.struct(F.element_at(cat, x["label"]).alias("label"), x["start"].alias("start"),
                                                          x["end"].alias("end"))))
    return docs.withColumn("spans", F.element_at(F.transform(bound, lambda b: F.when(F.size(b) > 0, b)), 1))

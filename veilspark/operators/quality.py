"""Quality scoring of a redactor against gold values (recall, anchor keep).

Per sample: missed gold values are those still contained in the output
(duplicates kept, order kept, an empty gold value always counts as missed);
changed anchors are those no longer contained; over-redaction means no gold
PII but a lost anchor. Totals per model give recall (1.0 when there is no
PII) and anchor keep rate (1.0 when there are no anchors); failed samples are
excluded from totals and listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens, truncate_to_tokens

# Independent gold extractors (deliberately not the redactor's own rules):
# plain ASCII shapes of e-mail, North-American phone and 4x4-digit card.
GOLD_PATTERNS = (
    r"[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+",
    r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    r"[0-9]{4}(?:[ -]?[0-9]{4}){3}",
)
SHINGLE = 4


def gold_pii(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.concat(*[F.regexp_extract_all(t, F.lit(p), 0) for p in GOLD_PATTERNS])


def _windows(token_array: Column, size: int) -> Column:
    """Hash of every run of ``size`` consecutive tokens (one per start token).

    The token array is let-bound through a one-element ``transform`` (used
    directly in the lambdas, Catalyst would inline the regex and re-run it);
    the runs come from zipping ``size`` shifted copies of the array, and the
    hash takes the tokens as separate arguments.
    """
    def per_doc(k: Column) -> Column:
        n = F.greatest(F.size(k) - size + 1, F.lit(0))
        if size == 1:
            return F.transform(k, lambda x: F.xxhash64(x))
        shifted = [F.slice(k, i + 1, n).alias(str(i)) for i in range(size)]
        return F.when(n > 0, F.transform(F.arrays_zip(*shifted),
                                         lambda z: F.xxhash64(*[z[str(i)] for i in range(size)]))) \
            .otherwise(F.array().cast("array<bigint>"))

    return F.element_at(F.transform(F.array(token_array), per_doc), 1)


def _key(tokens_arr: Column, first: int, size: int) -> Column:
    """Hash of ``size`` tokens starting at 1-based position ``first`` (same hash as :func:`_windows`)."""
    return F.xxhash64(*[F.element_at(tokens_arr, first + i) for i in range(size)])


GRAM = 3


def _char_grams(text, size: int) -> Column:
    """The different runs of ``size`` characters of a text."""
    t = F.col(text) if isinstance(text, str) else text
    n = F.length(t) - size + 1
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(t, i, F.lit(size)))
    return F.when(n > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def contained_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``(doc_id, item_id, passage)`` for every passage contained in a document.

    Testing every document against every passage would be a cross join.
    Instead: a passage's first token may be the tail of a longer token in the
    document and its last token the head of one, but every token in between
    is a whole token of the document too. So a passage of SHINGLE + 2 and more
    tokens is keyed by the hash of its tokens 2..SHINGLE+1, and a document by
    the different hashes of its SHINGLE-token windows. A shorter passage is
    keyed by the one of its GRAM-character runs that the fewest documents
    have (a passage of fewer characters by itself), and documents by their
    different runs. The equi-joins give candidates and ``contains`` confirms
    them (exact); an empty passage is contained in every document.
    """
    pt = tokens("text")
    pk = passages.where(F.col("text").isNotNull()).select("item_id", F.col("text").alias("passage"), F.size(pt).alias("n"),
                                                         _key(pt, 2, SHINGLE).alias("key4"))
    d = docs.select("doc_id", "text").where(F.col("text").isNotNull())

    # keys carry only (doc_id, key): the text is not copied into every window row
    long_p = pk.where(F.col("n") >= SHINGLE + 2).select("item_id", "passage", F.col("key4").alias("key"))
    dk = d.select("doc_id", F.explode(F.array_distinct(_windows(tokens("text"), SHINGLE))).alias("key"))
    cand = dk.join(long_p, "key").select("doc_id", "item_id", "passage")

    short_p = pk.where(F.col("n") < SHINGLE + 2).select("item_id", "passage", F.length("passage").alias("size"))
    sizes = [r["size"] for r in short_p.select(F.least("size", F.lit(GRAM)).alias("size")).distinct().collect()]
    for size in sorted(s for s in sizes if s > 0):
        own = short_p.where(F.least("size", F.lit(GRAM)) == size)
        runs = own.select("item_id", "passage", F.explode(_char_grams("passage", size)).alias("run"))
        have = d.select("doc_id", F.explode(_char_grams("text", size)).alias("run"))
        spread = have.join(runs.select("run").distinct(), "run").groupBy("run").agg(F.count(F.lit(1)).alias("docs"))
        # a run that no document has cannot be joined, and its passage is in none
        rarest = (runs.join(spread, "run", "left").groupBy("item_id", "passage")
                      .agg(F.min_by("run", F.struct(F.coalesce("docs", F.lit(0)), "run")).alias("run")))
        cand = cand.unionByName(have.join(rarest, "run").select("doc_id", "item_id", "passage"))
    if 0 in sizes:
        empty = [F.struct(F.lit(r.item_id).alias("item_id")) for r in short_p.where("size = 0").select("item_id").distinct().collect()]
        cand = cand.unionByName(d.select("doc_id", F.explode(F.array(*empty)).alias("e"))
                                 .select("doc_id", "e.item_id", F.lit("").alias("passage")))
    # candidates are few; the containment test needs the text once per (doc, passage)
    return cand.dropDuplicates(["doc_id", "item_id"]).join(d, "doc_id") \
        .where(F.col("text").contains(F.col("passage"))).select("doc_id", "item_id", "passage")


def gold_samples(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``Sample`` rows: id, text, pii, anchors, tags built from the raw tables.

    anchors = first five tokens of the text, then contained passages by item_id.
    """
    hits = contained_passages(docs, passages)
    per_doc = hits.groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("item_id", "passage"))), lambda x: x["passage"]).alias("found"))
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    s = base.join(per_doc, "doc_id", "left")
    head = truncate_to_tokens("text", 5)
    return s.select(
        "doc_id", "text", "lang", "n_chars",
        gold_pii("text").alias("pii"),
        F.concat(F.array(head), F.coalesce("found", F.array().cast("array<string>"))).alias("anchors"),
        F.array("lang", "source").alias("tags"),
    )


def score_samples(samples: DataFrame, outputs: DataFrame, output_col: str = "output") -> DataFrame:
    """Join gold samples to a redactor's outputs on doc_id and score each sample.

    ``outputs`` has ``doc_id, model, <output_col>, error`` (error NULL on success).
    """
    j = samples.join(outputs, "doc_id")
    out = F.col(output_col)
    missed = F.filter("pii", lambda v: out.contains(v))
    changed = F.filter("anchors", lambda v: ~out.contains(v))
    scored = j.select(
        "model", "doc_id", "lang", "tags", "error", *(["latency_s"] if "latency_s" in outputs.columns else []),
        F.size("pii").alias("pii_total"),
        (F.size("pii") - F.size(missed)).alias("pii_hit"),
        missed.alias("missed_pii"),
        F.size("anchors").alias("anchor_total"),
        (F.size("anchors") - F.size(changed)).alias("anchor_keep"),
        changed.alias("changed_anchors"),
    )
    return scored.withColumn("over_redaction",
                             (F.col("pii_total") == 0) & (F.col("anchor_keep") < F.col("anchor_total")))


def quality_totals(scored: DataFrame, keys=("model",)) -> DataFrame:
    """Per-model totals over successful samples; failed ones are only counted."""
    ok = F.col("error").isNull()

    def s(c):
        return F.sum(F.when(ok, F.col(c)).otherwise(0)).cast("long")

    agg = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count_if(ok).alias("successful_samples"),
        s("pii_total").alias("pii_total"), s("pii_hit").alias("pii_hit"),
        s("anchor_total").alias("anchor_total"), s("anchor_keep").alias("anchor_keep"),
        F.count_if(ok & F.col("over_redaction")).alias("over_redactions"),
        F.count_if(~ok).alias("errors"),
        *([F.coalesce(F.sum(F.when(ok, F.col("latency_s"))), F.lit(0.0)).alias("latency_s")] if "latency_s" in scored.columns else []),
    )
    return agg.select(
        "*",
        F.when(F.col("pii_total") > 0, F.col("pii_hit") / F.col("pii_total")).otherwise(F.lit(1.0)).alias("recall"),
        F.when(F.col("anchor_total") > 0, F.col("anchor_keep") / F.col("anchor_total")).otherwise(F.lit(1.0))
        .alias("anchor_keep_rate"),
    )


def quality_details(scored: DataFrame) -> DataFrame:
    """Long form of samples with a missed value or a changed anchor."""
    bad = scored.where(F.col("error").isNull() & ((F.size("missed_pii") > 0) | (F.size("changed_anchors") > 0)))
    missed = bad.select("model", "doc_id", F.lit("missed_pii").alias("kind"),
                        F.posexplode("missed_pii").alias("pos", "value"))
    changed = bad.select("model", "doc_id", F.lit("changed_anchor").alias("kind"),
                         F.posexplode("changed_anchors").alias("pos", "value"))
    return missed.unionByName(changed)


def exact_match_rate(a: DataFrame, b: DataFrame, col: str = "output") -> DataFrame:
    """Share of samples where two redactors produced identical text."""
    j = a.select("doc_id", F.col(col).alias("a")).join(b.select("doc_id", F.col(col).alias("b")), "doc_id")
    return j.agg(F.count(F.lit(1)).alias("samples"),
                 F.count_if(F.col("a") == F.col("b")).alias("exact"),
                 F.avg((F.col("a") == F.col("b")).cast("double")).alias("exact_rate"))

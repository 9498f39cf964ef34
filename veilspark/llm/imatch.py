"""I-Match fingerprints over several randomised lexicon subsets.

The lexicon holds the terms whose inverse document frequency lies in a chosen
band. It is cut at random (by a hash of the term) into ``LANES`` disjoint
subsets, and each of them again and again into a random half, which gives
``LEVELS`` levels of ever smaller subsets. The distinct lexicon terms of a text
are sorted, and those in one subset are hashed together: a subset agrees for
two texts if they use the very same of its terms. Small texts are compared by
their large subsets, long texts by their small ones, so the share of agreeing
subsets follows the share of common terms at every length.

Everything is DataFrame functions. Documents are dealt into runs of their
descending ids, with the first row of each run repeated at the end of the run
before it, so that the next document of each row lies in the same run; texts
cross the network once.

Size of the broadcast lexicon: a term in it stands in one of ``RAREST``
documents at least, so it has at most ``RAREST`` times the mean number of
distinct terms of a document, however many documents there are. Beyond
``BROADCAST_TERMS`` it is joined by a shuffle instead. A text that more than one
of ``HEAVY`` documents repeat counts once in the frequencies, else the terms of
a large group of copies would leave the lexicon.

Defined results for odd input: a null text counts as empty. A text without any
lexicon term is fingerprinted by all its terms, and without any term by its
characters: likeness 1 to equal ones and 0 to others. Rows of one ``doc_id``
follow each other in an order that their texts' hash settles, a null ``doc_id``
comes after all others; ids are taken to lie within 2**53 of zero. Of a single
row the next document is the row itself; an empty table gives an empty result.
Repeated rows have results of their own. A text of any length is one row. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.tables import table
from .registry import query
from .store import written

#: The band: a lexicon term stands in between one of RAREST and one of COMMONEST documents.
RAREST, COMMONEST = 2000, 20
HEAVY = 1000
BROADCAST_TERMS = 2_000_000
LANES, LEVELS = 32, 10
#: A level speaks for a pair of texts if they have terms in so many of its subsets.
ENOUGH = LANES // 4
#: Rows of a run of neighbouring documents, and the most runs.
RUN_ROWS, RUNS = 128, 1 << 16
_LANE_NAMES = "0123456789abcdefghijklmnopqrstuv"
_BEFORE_ALL = -1e19  # stands for a null id: below every 64-bit integer


def terms(text: Column) -> Column:
    """The distinct words of a text: runs of letters, marks and digits in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda t: t != ""))


def _bound(name: str, value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value.alias(name)), use), 1)


# --- the lexicon -------------------------------------------------------------------------

def lexicon(docs: DataFrame, rarest: int = RAREST, commonest: int = COMMONEST) -> DataFrame:
    """Terms within the band, with ``u``, 60 random bits of each (written: term, u)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("copy", F.xxhash64("text"))
    total = docs.count()
    copied = rows.groupBy("copy").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("only"))
    heavy = copied.where(F.col("n") * HEAVY > total).where("n > 1").select("copy", "only")  # fewer than HEAVY rows
    counted = rows.join(F.broadcast(heavy), "copy", "left").where(F.col("only").isNull() | (F.col("only") == F.col("doc_id")))
    held = written(counted.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    n = total - (copied.where(F.col("n") * HEAVY > total).where("n > 1").agg(F.sum(F.col("n") - 1)).first()[0] or 0)
    inside = (F.col("df") * rarest >= n) & ((F.col("df") * commonest <= n) | (F.col("df") == 1))
    return written(held.where(inside).select("term", F.conv(F.substring(F.md5("term"), 1, 15), 16, 10).cast("long").alias("u")), "lexicon")


# --- fingerprints ------------------------------------------------------------------------

def subset_marks(sorted_u: Column) -> Column:
    """Of each level one text: a mark (lane and hash) for each subset that holds any of the (ascending) lexicon terms."""
    def mark(a: Column) -> Column:
        return F.concat(F.substring(F.lit(_LANE_NAMES), a["lane"] + 1, F.lit(1)), F.substring(F.md5(a["text"]), 1, 5))

    def closed(a: Column) -> Column:
        return F.when(a["lane"] < 0, "").when(a["out"] == "", mark(a)).otherwise(F.concat(a["out"], F.lit(" "), mark(a)))

    def step(a: Column, u: Column) -> Column:
        lane = F.shiftright(u, 55).cast("int")  # ascending numbers are grouped by lane
        return F.when(a["lane"] == lane, F.struct(a["lane"].alias("lane"), F.concat(a["text"], F.lit(","), u.cast("string")).alias("text"), a["out"].alias("out"))) \
            .otherwise(F.struct(lane.alias("lane"), u.cast("string").alias("text"), closed(a).alias("out")))

    def next_level(a: Column, level: Column) -> Column:
        none = F.struct(F.lit(-1).alias("lane"), F.lit("").alias("text"), F.lit("").alias("out"))
        # the lowest bits of a term's number say down to which level it is drawn
        drawn = F.filter(a["us"], lambda u: F.call_function("shiftrightunsigned", u, level).bitwiseAND(F.lit(1)) == 0)
        return F.struct(drawn.alias("us"), F.concat(a["out"], F.array(F.aggregate(a["us"], none, step, closed))).alias("out"))

    start = F.struct(sorted_u.alias("us"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, next_level, lambda a: a["out"])


def fingerprint(sorted_u: Column, otherwise: Column) -> Column:
    """The hash of all lexicon terms, then the marks of each level's subsets; without a term ``x`` and the other hash."""
    marks = F.concat(F.md5(F.array_join(sorted_u.cast("array<string>"), ",")), F.lit("|"), F.array_join(subset_marks(sorted_u), "|"))
    return F.when(F.size(sorted_u) == 0, F.concat(F.lit("x"), otherwise)).otherwise(marks)


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing subsets (0 to 1) of two fingerprints.

    Of the levels on which the pair has terms in ``ENOUGH`` subsets, the one with
    the smallest subsets and the one above count; the top level if there is none.
    """
    def at_level(one: Column, two: Column) -> Column:
        return _bound("m", F.struct(*[F.filter(F.split(F.coalesce(x, F.lit("")), " "), lambda m: m != "").alias(k) for x, k in ((one, "a"), (two, "b"))]),
                      lambda m: F.struct(F.size(F.array_union(*[F.transform(m[k], lambda x: F.substring(x, 1, 1)) for k in "ab"])).alias("used"),
                                         F.size(F.array_intersect(m["a"], m["b"])).alias("same")))

    def share(levels: Column) -> Column:
        low = F.coalesce(F.array_max(F.filter(F.transform(levels, lambda v, i: F.when(v["used"] >= ENOUGH, i)), lambda i: i.isNotNull())), F.lit(0))
        def taken(low: Column) -> Column:
            return F.filter(levels, lambda v, i: (i == low) | (i == low - 1))
        return _bound("low", low, lambda low: _bound("taken", taken(low), lambda t: F.aggregate(
            t, F.struct(F.lit(0).alias("used"), F.lit(0).alias("same")),
            lambda s, v: F.struct((s["used"] + v["used"]).alias("used"), (s["same"] + v["same"]).alias("same")),
            lambda s: F.when(s["used"] == 0, 0.0).otherwise(s["same"] / s["used"]))))

    parts = F.zip_with(F.slice(F.split(a, r"\|"), 2, LEVELS), F.slice(F.split(b, r"\|"), 2, LEVELS), at_level)
    return F.when(a == b, 1.0).otherwise(_bound("levels", parts, share))


# --- neighbouring documents --------------------------------------------------------------

def _below(borders: Column, count: int, v: Column, equal: bool) -> Column:
    """How many of the ascending borders are less than ``v`` (or equal), by bisection."""
    def step(a: Column, _: Column) -> Column:
        mid = F.floor((a["low"] + a["high"]) / 2).cast("int")
        at = F.element_at(borders, F.least(mid + 1, F.lit(count)))
        less = at <= v if equal else at < v
        more = (a["low"] < a["high"]) & less
        return F.struct(F.when(more, mid + 1).otherwise(a["low"]).alias("low"),
                        F.when((a["low"] < a["high"]) & ~less, mid).otherwise(a["high"]).alias("high"))
    rounds = F.sequence(F.lit(1), F.lit(count.bit_length() + 1))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.lit(count).alias("high")), step, lambda a: a["low"])


def with_next(docs: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """Rows in runs of descending ids: run, place, extra, doc_id, text and ``next`` (the next document's text).

    The last row of each run (``extra``) repeats the first of the run that follows, for its neighbour's sake.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce(F.col("doc_id").cast("double"), F.lit(_BEFORE_ALL)).alias("v"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    total = docs.count()
    runs = min(RUNS, max(1, -(-total // run_rows)))
    run = F.lit(0)
    if runs > 1:
        cuts = rows.select("v").approxQuantile("v", [k / runs for k in range(1, runs)], 0.25 / runs)
        borders = F.split(F.lit(",".join(map(repr, cuts))), ",").cast("array<double>")
        low, high = (_below(borders, len(cuts), F.col("v"), equal) for equal in (False, True))
        # an id that stands on several borders has so many rows that they share several runs
        run = low + F.pmod(F.col("tie"), high - low + 1).cast("int")
    rows = rows.withColumn("run", run)
    first = rows.groupBy("run").agg(F.max(F.struct("v", "doc_id", "tie")).alias("top"))  # at most RUNS + 1 rows
    order = Window.orderBy("run")
    heads = written(first.select("top.doc_id", "top.tie", F.coalesce(F.lead("run").over(order), F.min("run").over(Window.partitionBy())).alias("to")), "run-heads")
    heads = heads.select(F.col("doc_id").alias("head_id"), F.col("tie").alias("head_tie"), "to")
    extra = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie")))
    both = rows.withColumn("extra", F.lit(0)).unionByName(extra.select("doc_id", "text", "v", "tie", F.col("to").alias("run"), F.lit(1).alias("extra")))
    w = Window.partitionBy("run").orderBy("extra", F.desc("v"), F.desc("doc_id"), F.desc("tie"))
    return both.select("run", F.row_number().over(w).alias("place"), "extra", "doc_id", "text", F.lead("text").over(w).alias("next"))


def fingerprints(docs: DataFrame, words: DataFrame | None = None, run_rows: int = RUN_ROWS) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half replaced by the beginning of the next document's text, in descending ids.
    ``words`` is a lexicon (term, u); without it, that of ``docs``.
    """
    words = lexicon(docs) if words is None else words
    words = F.broadcast(words) if words.count() <= BROADCAST_TERMS else words
    rows = with_next(docs, run_rows).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next", F.lit(1), half))

    def whole(words: Column, text: Column) -> Column:
        return F.md5(F.when(F.size(words) > 0, F.array_join(F.array_sort(words), " ")).otherwise(text))

    def both(e: Column) -> Column:
        return F.struct(terms(F.col("text")).alias("own"), F.coalesce(terms(e), F.array().cast("array<string>")).alias("new"), e.alias("edited"))

    def items(b: Column) -> Column:
        """One item of the row's own values, and one for each term of the text (0) and of the edited text (1)."""
        own = F.struct("doc_id", "extra", "n_chars", F.sha2(b["edited"], 256).alias("edited_sha256"),
                       whole(b["own"], F.col("text")).alias("other"), whole(b["new"], b["edited"]).alias("edited_other"))
        no_own = F.lit(None).cast("struct<doc_id:long,extra:int,n_chars:long,edited_sha256:string,other:string,edited_other:string>")

        def item(side: int, term: Column, value: Column) -> Column:
            return F.struct(F.lit(side).alias("side"), term.alias("term"), value.alias("own"))
        return F.concat(F.array(item(-1, F.lit(None).cast("string"), own)), F.transform(b["own"], lambda t: item(0, t, no_own)),
                        F.transform(b["new"], lambda t: item(1, t, no_own)))

    laid_out = _bound("edited", edited, lambda e: _bound("both", both(e), items))
    exploded = rows.select("run", "place", F.explode(laid_out).alias("i")).select("run", "place", "i.side", "i.term", "i.own")
    found = exploded.join(words, "term", "left").where("u IS NOT NULL OR side = -1")
    lists = found.groupBy("run", "place").agg(
        F.first("own", ignorenulls=True).alias("own"), F.array_sort(F.collect_list(F.when(F.col("side") == 0, F.col("u")))).alias("us"),
        F.array_sort(F.collect_list(F.when(F.col("side") == 1, F.col("u")))).alias("edited_us"))
    prints = lists.select("run", "place", "own.doc_id", "own.extra", "own.n_chars", "own.edited_sha256",
                          fingerprint(F.col("us"), F.col("own.other")).alias("fingerprint"),
                          fingerprint(F.col("edited_us"), F.col("own.edited_other")).alias("edited_fingerprint"))
    after = F.lead("fingerprint").over(Window.partitionBy("run").orderBy("place"))
    return prints.withColumn("after", after).where("extra = 0").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("after")).alias("near_next"))


def _levels_sql(a: str, b: str) -> str:
    """``likeness`` of two mark lists: (used, same) per level, then the two levels that count."""
    return f"""list_transform(range({LEVELS}), lambda k: {{
      'used': len(list_distinct(list_transform(list_filter(list_concat({a}, {b}), lambda m: m[1] = k::VARCHAR), lambda m: m[1:2]))),
      'same': len(list_filter(list_intersect({a}, {b}), lambda m: m[1] = k::VARCHAR)), 'k': k}})"""


def _likeness_sql(a: str, b: str, levels: str) -> str:
    low = f"coalesce(list_max(list_transform(list_filter({levels}, lambda v: v.used >= {ENOUGH}), lambda v: v.k)), 0)"
    part = [f"coalesce(list_sum(list_transform(list_filter({levels}, lambda v: v.k = {low} OR v.k = {low} - 1), lambda v: v.{f})), 0)::DOUBLE" for f in ("same", "used")]
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN {part[1]} = 0 THEN 0.0 ELSE {part[0]} / {part[1]} END"


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, '')) AS n,
                  coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS nx FROM documents),
e AS (SELECT doc_id, n, x, substr(x, 1, n - n // 2) || substr(nx, 1, n // 2) AS ed FROM d),
t AS (SELECT doc_id, side, s, list_distinct(regexp_extract_all(lower(s), '[\p{{L}}\p{{M}}\p{{N}}]+')) AS words
      FROM (SELECT doc_id, 0 AS side, x AS s FROM e UNION ALL SELECT doc_id, 1, ed FROM e)),
copied AS (SELECT x, count(*) AS c, min(doc_id) AS only_id FROM d GROUP BY x HAVING c > 1 AND c * {HEAVY} > (SELECT count(*) FROM d)),
n AS (SELECT (SELECT count(*) FROM d) - coalesce(sum(c - 1), 0) AS total FROM copied),
f AS (SELECT word, count(*) AS df FROM (SELECT unnest(words) AS word FROM t LEFT JOIN copied ON copied.x = t.s
      WHERE side = 0 AND (only_id IS NULL OR only_id = doc_id)) GROUP BY word),
lex AS (SELECT word, ('0x' || substr(md5(word), 1, 15))::BIGINT AS u FROM f, n WHERE df * {RAREST} >= total AND (df * {COMMONEST} <= total OR df = 1)),
h AS (SELECT doc_id, side, u FROM (SELECT doc_id, side, unnest(words) AS word FROM t) JOIN lex USING (word)),
w AS (SELECT doc_id, side, md5(string_agg(u::VARCHAR, ',' ORDER BY u)) AS whole FROM h GROUP BY 1, 2),
m AS (SELECT doc_id, side, k, u >> 55 AS lane, k::VARCHAR || substr('{_LANE_NAMES}', (u >> 55)::INT + 1, 1) || substr(md5(string_agg(u::VARCHAR, ',' ORDER BY u)), 1, 5) AS mark
      FROM h, range({LEVELS}) r(k) WHERE u & ((1::BIGINT << k::INT) - 1) = 0 GROUP BY doc_id, side, k, lane),
l AS (SELECT doc_id, side, list(mark ORDER BY k, lane) AS marks FROM m GROUP BY 1, 2),
fp AS (SELECT t.doc_id, t.side, coalesce(marks, []) AS marks, coalesce(whole || '|' || array_to_string(list_transform(range({LEVELS}),
                lambda k: array_to_string(list_transform(list_filter(marks, lambda m: m[1] = k::VARCHAR), lambda m: m[2:]), ' ')), '|'),
              'x' || md5(CASE WHEN len(words) > 0 THEN array_to_string(list_sort(words), ' ') ELSE s END)) AS fp
       FROM t LEFT JOIN w ON w.doc_id = t.doc_id AND w.side = t.side LEFT JOIN l ON l.doc_id = t.doc_id AND l.side = t.side),
a AS (SELECT e.doc_id, e.n AS n_chars, sha256(e.ed) AS edited_sha256, o.fp AS fp0, o.marks AS m0, c.fp AS fp1, c.marks AS m1,
             coalesce(lead(o.fp) OVER z, first_value(o.fp) OVER z) AS fp2, coalesce(lead(o.marks) OVER z, first_value(o.marks) OVER z) AS m2
      FROM e JOIN fp o ON o.doc_id = e.doc_id AND o.side = 0 JOIN fp c ON c.doc_id = e.doc_id AND c.side = 1 WINDOW z AS (ORDER BY e.doc_id DESC)),
b AS (SELECT *, {_levels_sql("m0", "m1")} AS v1, {_levels_sql("m0", "m2")} AS v2 FROM a)
SELECT doc_id, n_chars, edited_sha256, fp0 AS fingerprint, fp1 AS edited_fingerprint,
       {_likeness_sql("fp0", "fp1", "v1")} AS near_edited, {_likeness_sql("fp0", "fp2", "v2")} AS near_next FROM b"""


@query("op11_imatch", sql=SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))

"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source). A token budget flows down the tree:
every node splits its budget among its children by their weights; a child
whose subtree cannot supply its share (tokens times ``max_epochs``) gives all
it has, and the shortage goes to its siblings in proportion to their weights.
Only what a whole subtree cannot supply is passed to the siblings of its
parent. All amounts are whole tokens, and the children's amounts add up to the
node's. Within a leaf, whole epochs take every document; the last epoch takes
a token prefix of the leaf in a seeded order (MD5 of seed, epoch and doc_id),
so ``take_tokens`` of the document at the cut may be less than its length.

Prefix sums run over buckets of the seeded order: sums of buckets first, then
rows within a bucket, so no task sees a whole leaf. Everything is DataFrame
code.

Defined results for odd input: null ``lang``, ``source`` or domain count as
``(none)``; null texts have no tokens; documents without tokens are taken by
whole epochs, and by the last epoch if they come before the cut; a null
``doc_id`` orders as an empty string; repeated rows count each. Weight 0 means
nothing is taken. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.tables import table
from .registry import query
from .store import keyed, written

NONE = "(none)"
LEAF = ["domain", "lang", "source"]
#: Weights by name at each level; names not listed have DEFAULT_WEIGHT.
WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1},
           "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {}}
DEFAULT_WEIGHT = 1
SEED = 17
#: The budget as a share of all tokens, and how often a document may be used.
BUDGET_PERCENT, MAX_EPOCHS = 60, 2
#: Rows of a leaf that share one bucket of the seeded order, about.
BUCKET_ROWS = 4096


def domain_of(source: Column) -> Column:
    """The tables name no domain; sources are dealt to four by the number in their name."""
    number = F.regexp_extract(source, "([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("domain"), (number.cast("bigint") % 4).cast("string")))


def n_words(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    # only the first and last part can be empty
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int")
            - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")


def _weight(level: str, weights: dict) -> Column:
    known = weights.get(level) or {}
    if not known:
        return F.lit(DEFAULT_WEIGHT).cast("long")
    names = F.create_map(*[F.lit(x) for k, v in known.items() for x in (k, int(v))])
    return F.coalesce(F.try_element_at(names, F.col(level)), F.lit(DEFAULT_WEIGHT)).cast("long")


def _share(children: DataFrame, parents: list[str], level: str, weights: dict) -> DataFrame:
    """Split ``budget`` (the parent's, on every child row) among the children into ``amount``.

    Children with the least supply per weight are settled first: one is short
    if its supply is at most its share of what the settled ones leave over.
    """
    wide, key = "decimal(19,0)", [F.col(c) for c in parents]
    rows = children.withColumn("weight", _weight(level, weights))
    order = [F.expr("try_divide(CAST(supply AS DOUBLE), CAST(weight AS DOUBLE))").asc_nulls_last(), F.col(level)]
    group = Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))
    before = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = group.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    left = F.col("budget") - F.coalesce(F.sum("supply").over(before), F.lit(0))
    rows = rows.withColumn("short", (F.col("supply") == 0) | (F.col("weight") > 0) & (
        F.col("supply").cast(wide) * F.sum("weight").over(onward).cast(wide)
        <= F.greatest(left, F.lit(0)).cast(wide) * F.col("weight").cast(wide)))
    open_weight = F.when(F.col("short"), 0).otherwise(F.col("weight"))
    rows = rows.select("*", open_weight.alias("_w"),
                       (F.col("budget") - F.sum(F.when(F.col("short"), F.col("supply")).otherwise(0)).over(group)).alias("_rest"))
    upto = group.orderBy(F.col(level)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", F.sum("_w").over(upto).alias("_upto"), F.sum("_w").over(group).alias("_all"))
    # shares are differences of rounded running totals, so they add up exactly
    part = F.expr("CASE WHEN _all > 0 THEN CAST(_rest AS DECIMAL(19,0)) * CAST(_upto AS DECIMAL(19,0)) div CAST(_all AS DECIMAL(19,0))"
                  " - CAST(_rest AS DECIMAL(19,0)) * CAST(_upto - _w AS DECIMAL(19,0)) div CAST(_all AS DECIMAL(19,0)) ELSE 0 END")
    amount = F.when(F.col("short"), F.col("supply")).otherwise(F.least(part, F.col("supply"))).cast("long")
    return rows.withColumn("amount", amount).drop("_w", "_rest", "_upto", "_all", "weight", "short", "budget")


def budgets(leaves: DataFrame, total: Column, max_epochs: int, weights: dict) -> DataFrame:
    """Per leaf (``domain``, ``lang``, ``source``, ``tokens``): its ``amount`` of the ``total`` tokens."""
    out = leaves.withColumn("supply", F.col("tokens") * max_epochs)
    amounts = None
    for depth, level in enumerate(LEAF):
        keys, parents = LEAF[:depth + 1], LEAF[:depth]
        nodes = out.groupBy(*keys).agg(F.sum("supply").alias("supply"))
        if amounts is None:
            top = out.agg(F.least(total, F.coalesce(F.sum("supply"), F.lit(0))).alias("budget"))
            nodes = nodes.crossJoin(F.broadcast(top))  # one row: the root's budget
        else:
            nodes = nodes.join(amounts.select(*parents, F.col("amount").alias("budget")), parents)
        amounts = _share(nodes, parents, level, weights)
    return amounts.select(*LEAF, "amount").join(leaves, LEAF)


def mix(docs: DataFrame, weights: dict | None = None, percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS,
        seed: int = SEED, bucket_rows: int = BUCKET_ROWS, row: str | None = None) -> DataFrame:
    """One row per use of a document: doc_id, domain, lang, source, epoch, n_tokens, take_tokens.

    ``row`` names a column that numbers the rows, which then comes last.
    """
    own = [row] if row else []
    weights = WEIGHTS if weights is None else weights
    lengths = written(docs.select(
        "doc_id", F.coalesce(domain_of(F.col("source")), F.lit(NONE)).alias("domain"), F.coalesce("lang", F.lit(NONE)).alias("lang"),
        F.coalesce("source", F.lit(NONE)).alias("source"), n_words(F.col("text")).alias("n_tokens"), *own), "lengths")
    leaves = lengths.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    leaves = written(leaves, "leaves")
    totals = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.max("docs"), F.lit(0)).alias("docs")).first()
    plan = budgets(leaves, F.lit(totals.tokens * percent // 100), max_epochs, weights)
    plan = written(plan.select(*LEAF, F.expr("CASE WHEN tokens > 0 THEN amount div tokens ELSE 0 END").alias("whole"),
                               F.expr("CASE WHEN tokens > 0 THEN amount % tokens ELSE 0 END").alias("rest")), "plan")
    used = lengths.join(plan.where("whole > 0 OR rest > 0"), LEAF)
    columns = ["doc_id", *LEAF, "epoch", "n_tokens", "take_tokens", *own]
    full = (used.where("whole > 0").withColumn("epoch", F.explode(F.expr("sequence(0L, whole - 1)")))
            .withColumn("take_tokens", F.col("n_tokens")).select(columns))

    # the last epoch: a prefix of the seeded order, summed by bucket, then within the bucket
    digits, reach = 1, totals.docs // bucket_rows
    while reach >= 16:
        digits, reach = digits + 1, reach // 16
    last = (used.where("rest > 0").withColumn("epoch", F.col("whole"))
            .withColumn("_at", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"),
                                                 F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
            .withColumn("_bucket", F.substring("_at", 1, digits)))
    sums = last.groupBy(*LEAF, "_bucket").agg(F.sum("n_tokens").alias("_sum"))
    sums = sums.withColumn("_base", F.sum("_sum").over(Window.partitionBy(*LEAF).orderBy("_bucket")) - F.col("_sum")).drop("_sum")
    inside = Window.partitionBy(*LEAF, "_bucket").orderBy("_at", "doc_id", "n_tokens", *own).rowsBetween(Window.unboundedPreceding, -1)
    cut = (last.join(sums, [*LEAF, "_bucket"])
           .withColumn("_before", F.col("_base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
           .where(F.col("_before") < F.col("rest"))
           .withColumn("take_tokens", F.least("n_tokens", F.col("rest") - F.col("_before"))).select(columns))
    return full.unionByName(cut)


def chosen(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix uses at least once, whole texts, all columns; rows that share an id are told apart."""
    rows, key = keyed(docs, "rows")
    used = mix(rows, **options, row=key).select(key).distinct()
    return rows.join(used, key, "left_semi").select(docs.columns)


def _oracle() -> str:
    def weight(level: str) -> str:
        known = WEIGHTS[level]
        cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in known.items())
        return f"CASE {level} {cases} ELSE {DEFAULT_WEIGHT} END" if known else f"{DEFAULT_WEIGHT}"

    parts = [rf"""WITH lengths AS (SELECT doc_id,
  CASE WHEN regexp_extract(source, '([0-9]+)$', 1) <> '' THEN 'domain' || (regexp_extract(source, '([0-9]+)$', 1)::BIGINT % 4) ELSE '{NONE}' END AS domain,
  coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM lengths GROUP BY ALL),
a0 AS (SELECT least((sum(tokens) * {BUDGET_PERCENT}) // 100, sum(tokens) * {MAX_EPOCHS}) AS amount FROM leaves)"""]
    for depth, level in enumerate(LEAF):
        keys, parents = ", ".join(LEAF[:depth + 1]), LEAF[:depth]
        by = f"PARTITION BY {', '.join(parents)}" if parents else ""
        source = f"JOIN a{depth} USING ({', '.join(parents)})" if parents else f", a{depth}"
        parts.append(f"""n{depth} AS (SELECT x.*, {weight(level)} AS weight, a{depth}.amount AS budget
  FROM (SELECT {keys}, sum(tokens) * {MAX_EPOCHS} AS supply FROM leaves GROUP BY ALL) x {source}),
s{depth} AS (SELECT *, supply::HUGEINT * sum(weight) OVER ({by} ORDER BY supply::DOUBLE / weight NULLS LAST, {level}
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= greatest(budget - coalesce(sum(supply) OVER ({by}
    ORDER BY supply::DOUBLE / weight NULLS LAST, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::HUGEINT * weight AS short FROM n{depth}),
r{depth} AS (SELECT *, CASE WHEN short THEN 0 ELSE weight END AS w, budget - sum(CASE WHEN short THEN supply ELSE 0 END) OVER ({by}) AS rest FROM s{depth}),
t{depth} AS (SELECT *, sum(w) OVER ({by} ORDER BY {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(w) OVER ({by}) AS total FROM r{depth}),
a{depth + 1} AS (SELECT {keys}, CASE WHEN short THEN supply WHEN total > 0 THEN least(rest * upto // total - rest * (upto - w) // total, supply) ELSE 0 END AS amount FROM t{depth})""")
    parts.append(f"""plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN amount // tokens ELSE 0 END AS whole,
  CASE WHEN tokens > 0 THEN amount % tokens ELSE 0 END AS rest FROM a{len(LEAF)} JOIN leaves USING (domain, lang, source)),
used AS (SELECT * FROM lengths JOIN plan USING (domain, lang, source)),
cut AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('{SEED}|' || whole || '|' || coalesce(doc_id::VARCHAR, '')), doc_id, n_tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM used WHERE rest > 0)
SELECT doc_id, domain, lang, source, e::BIGINT AS epoch, n_tokens, n_tokens AS take_tokens
FROM (SELECT *, unnest(range(whole::BIGINT)) AS e FROM used WHERE whole > 0)
UNION ALL
SELECT doc_id, domain, lang, source, whole::BIGINT, n_tokens, least(n_tokens, rest - done)::BIGINT FROM cut WHERE done < rest""")
    return ",\n".join(parts)


@query("op7_source_mixing", sql=_oracle())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))

"""Registered queries: token unit (TOK), detection (DET), rule redaction (RED-1..3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import PROMPT_TEMPLATE, RULES
from ..operators import detect as D
from ..operators import redact as R
from ..operators.tokens import token_table
from ..sources.tables import spread, table, text_corpus
from . import oracle_sql as O
from .fixtures import RULE_CASES
from .registry import register

BUCKETS = (256, 1024, 4096)


def corpus_with_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame([(int(c), t) for c, t in RULE_CASES], "doc_id long, text string") \
        .selectExpr("'rule_cases' AS src", "doc_id", "text")
    return text_corpus(spark, sf_dir).unionByName(cases.coalesce(1))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), key="doc_id")


# --------------------------------------------------------------------------- TOK

@register("tok_1_token_spans", sql="""
WITH t AS (
  SELECT doc_id, regexp_extract_all(text, {tok}, 0) AS k, string_split_regex(text, {tok}) AS g FROM documents
), z AS (
  SELECT doc_id, i - 1 AS tok_idx, len(g[i]) + len(k[i]) AS step, len(k[i]) AS klen
  FROM t, range(1, len(k) + 1) r(i)
)
SELECT doc_id, CAST(tok_idx AS BIGINT) AS tok_idx,
       CAST(sum(step) OVER (PARTITION BY doc_id ORDER BY tok_idx ROWS UNBOUNDED PRECEDING) - klen AS BIGINT) AS tok_start,
       CAST(sum(step) OVER (PARTITION BY doc_id ORDER BY tok_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tok_end
FROM z
""".format(tok=O.q(O.TOKEN_RE2)))
def tok_1_token_spans(spark, sf_dir):
    tt = token_table(docs(spark, sf_dir))
    return tt.select("doc_id", F.col("tok_idx").cast("long"), F.col("tok_start").cast("long"),
                     F.col("tok_end").cast("long"))


@register("tok_2_token_count", sql=f"""
SELECT doc_id, lang, {O.token_count('text')} AS n_tokens FROM documents
""")
def tok_2_token_count(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "lang", T.token_count("text").cast("long").alias("n_tokens"))


def _truncate_sql(expr: str, n: str) -> str:
    """SQL for the first ``n`` tokens: sum the lengths of the first n (gap + token) units."""
    units = f"regexp_extract_all({expr}, {O.q('(?:[' + O.SP + ']*(?:' + O.TOKEN_RE2 + '))')}, 0)"
    end_n = f"list_sum(list_transform({units}[1:{n}], lambda x: len(x)))"
    return (f"CASE WHEN {n} <= 0 THEN '' WHEN {O.token_count(expr)} <= {n} THEN {expr} "
            f"ELSE substr({expr}, 1, CAST({end_n} AS BIGINT)) END")


@register("tok_3_truncate_to_tokens", sql=f"""
SELECT doc_id, CAST(b.n AS INTEGER) AS n, md5({_truncate_sql('text', 'b.n')}) AS cut_md5
FROM documents, (VALUES (0), (1), (7), (256)) b(n)
""")
def tok_3_truncate_to_tokens(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "text")
    parts = [d.select("doc_id", F.lit(n).cast("int").alias("n"), F.md5(T.truncate_to_tokens("text", n)).alias("cut_md5"))
             for n in (0, 1, 7, 256)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("tok_4_sized_text", sql=f"""
WITH seeds AS (
  SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS seed FROM conversations GROUP BY conv_id
), s AS (SELECT conv_id, seed, {O.token_count('seed')} AS per FROM seeds WHERE {O.token_count('seed')} > 0),
sized AS (
  SELECT conv_id, b.n AS bucket,
         array_to_string(list_transform(range(greatest(1, CAST(ceil(b.n / per) AS BIGINT))), lambda x: seed), chr(10)) AS joined
  FROM s, (VALUES {", ".join(f"({b})" for b in BUCKETS)}) b(n)
)
SELECT conv_id, CAST(bucket AS BIGINT) AS bucket,
       {O.token_count(_truncate_sql('joined', 'bucket'))} AS actual_tokens,
       CAST(len({_truncate_sql('joined', 'bucket')}) AS BIGINT) AS chars
FROM sized
""")
def tok_4_sized_text(spark, sf_dir):
    seeds = _seed_texts(spark, sf_dir).where(T.token_count("seed") > 0)
    parts = []
    for b in BUCKETS:
        sized = T.sized_text("seed", b)
        parts.append(seeds.select("conv_id", F.lit(b).cast("long").alias("bucket"), sized.alias("s")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("conv_id", "bucket", T.token_count("s").cast("long").alias("actual_tokens"),
                      F.length("s").cast("long").alias("chars"))


def _seed_texts(spark, sf_dir):
    """TOK-5: each conversation's turns joined by a blank line in turn order.

    The group is one conversation (bounded); order comes from sorting on the
    turn number carried inside the collected structs, never from shuffle order.
    """
    conv = spread(table(spark, sf_dir, "conversations"), key="conv_id")
    g = conv.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    return g.select("conv_id", F.array_join(F.transform("turns", lambda x: x["text"]), "\n\n").alias("seed"))


@register("tok_5_seed_text", sql="""
SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS seed_md5,
       CAST(len(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS BIGINT) AS seed_chars
FROM conversations GROUP BY conv_id
""")
def tok_5_seed_text(spark, sf_dir):
    s = _seed_texts(spark, sf_dir)
    return s.select("conv_id", F.md5("seed").alias("seed_md5"), F.length("seed").cast("long").alias("seed_chars"))


@register("tok_6_char_length", sql="""
SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(n_chars AS BIGINT) AS n_chars FROM documents
""")
def tok_6_char_length(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("chars"),
                                      F.col("n_chars").cast("long").alias("n_chars"))


@register("tok_7_prompt", sql="""
SELECT conv_id, turn, md5({head} || text || {tail}) AS prompt_md5 FROM conversations
""".format(head=O.q(PROMPT_TEMPLATE.split("{text}")[0]), tail=O.q(PROMPT_TEMPLATE.split("{text}")[1])))
def tok_7_prompt(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    return conv.select("conv_id", "turn", F.md5(T.render_prompt("text")).alias("prompt_md5"))


@register("tok_8_think_cleanup", sql=f"""
WITH g AS (
  SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN '<think>plan ' || CAST(turn AS VARCHAR) || '</think>' ELSE '' END
         || chr(10) || text || '  ' AS raw FROM conversations
)
SELECT conv_id, turn,
       md5(regexp_replace(regexp_replace(raw, '(?s)^.*?</think>', ''), '^[{O.SP}]+|[{O.SP}]+$', '', 'g')) AS clean_md5
FROM g
""")
def tok_8_think_cleanup(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    raw = F.concat(F.when(F.col("role") == "assistant",
                          F.concat(F.lit("<think>plan "), F.col("turn").cast("string"), F.lit("</think>"))).otherwise(F.lit("")),
                   F.lit("\n"), F.col("text"), F.lit("  "))
    return conv.select("conv_id", "turn", F.md5(T.after_think(raw)).alias("clean_md5"))


@register("tok_9_generation_budget", sql=f"""
SELECT doc_id,
       CAST(coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN 512 ELSE 0 END, 0),
                     greatest(256, CAST(trunc(1.3 * {O.token_count('text')}) AS BIGINT))) AS BIGINT) AS max_new_tokens
FROM documents
""")
def tok_9_generation_budget(spark, sf_dir):
    d = docs(spark, sf_dir)
    cfg = F.when(F.col("doc_id") % 3 == 0, F.lit(512)).otherwise(F.lit(0))
    return d.select("doc_id", T.generation_budget(cfg, T.token_count("text")).cast("long").alias("max_new_tokens"))


@register("tok_10_attention_count", sql=f"""
WITH m AS (
  SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN [] ELSE list_transform(regexp_extract_all(text, {O.q(O.TOKEN_RE2)}, 0),
         lambda x: CASE WHEN x = '.' THEN 0 ELSE 1 END) END AS mask,
         {O.token_count('text')} AS n FROM documents
)
SELECT doc_id, CAST(CASE WHEN len(mask) = 0 THEN n ELSE list_sum(mask) END AS BIGINT) AS input_tokens FROM m
""")
def tok_10_attention_count(spark, sf_dir):
    d = docs(spark, sf_dir)
    mask = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<int>")).otherwise(
        F.transform(T.tokens("text"), lambda x: F.when(x == ".", 0).otherwise(1)))
    return d.select("doc_id", T.attention_token_count(mask, T.token_count("text")).cast("long").alias("input_tokens"))


@register("tok_11_coerce_offsets", sql=f"""
WITH s AS (
  SELECT doc_id, regexp_extract_all(text, {O.q(O.TOKEN_RE2)}, 0) AS k FROM documents
), p AS (
  SELECT doc_id, list_transform(k, lambda x, i: CASE WHEN i % 7 = 0 THEN [i] ELSE [i, i + len(x)] END) AS pairs FROM s
)
SELECT doc_id, CAST(len(list_filter(pairs, lambda x: len(x) >= 2)) AS BIGINT) AS n_pairs,
       CAST(coalesce(list_sum(list_transform(list_filter(pairs, lambda x: len(x) >= 2), lambda x: x[2] - x[1])), 0) AS BIGINT) AS covered
FROM p
""")
def tok_11_coerce_offsets(spark, sf_dir):
    d = docs(spark, sf_dir)
    pairs = F.transform(T.tokens("text"), lambda x, i: F.when((i + 1) % 7 == 0, F.array(i + 1))
                        .otherwise(F.array(i + 1, i + 1 + F.length(x))))
    off = T.coerce_offsets(pairs)
    return d.select("doc_id", F.size(off).cast("long").alias("n_pairs"),
                    F.aggregate(off, F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"])).alias("covered"))


# --------------------------------------------------------------------------- DET

def _det_sql(i: int) -> str:
    return f"""
WITH {O.corpus_cte()}, m AS (
  SELECT src, doc_id, {O.rule_values('text', i)} AS v FROM corpus
)
SELECT src, doc_id, CAST(j - 1 AS BIGINT) AS match_idx, '{O.RE2_RULES[i - 1][0]}' AS label, v[j] AS value
FROM m, range(1, len(v) + 1) r(j)
"""


_DET_NAMES = {1: "secret_key", 2: "secret_assignment", 3: "email", 4: "url", 5: "phone", 6: "iban",
              7: "card", 8: "date", 9: "jp_address", 10: "street_address"}


def _make_det(i: int):
    def q(spark, sf_dir):
        c = corpus_with_cases(spark, sf_dir)
        out = D.detect_rule(c, i, keys=("src", "doc_id"))
        return out.select("src", "doc_id", F.col("match_idx").cast("long"), "label", "value")
    return q


for _i, _n in _DET_NAMES.items():
    register(f"det_{_i}_{_n}", sql=_det_sql(_i))(_make_det(_i))


@register("det_11_all_spans", sql=f"""
WITH {O.corpus_cte()}, m AS (
  SELECT src, doc_id, {", ".join(f"{O.rule_values('text', i)} AS v{i}" for i in range(1, 11))} FROM corpus
)
SELECT src, doc_id, rule, count(*) AS n, sum(len(value)) AS chars FROM (
  {" UNION ALL ".join(f"SELECT src, doc_id, CAST({i} AS BIGINT) AS rule, unnest(v{i}) AS value FROM m" for i in range(1, 11))}
) GROUP BY ALL
""")
def det_11_all_spans(spark, sf_dir):
    c = corpus_with_cases(spark, sf_dir)
    sp = D.detect(c, keys=("src", "doc_id"))
    return (sp.groupBy("src", "doc_id", F.col("rule").cast("long").alias("rule"))
              .agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).cast("long").alias("chars")))


# --------------------------------------------------------------------------- RED-1..3

@register("red_1_sequential_redact", sql=f"""
WITH {O.corpus_cte()},
{O.redact_steps('corpus', 'text', ['src', 'doc_id'])}
SELECT src, doc_id, md5(t) AS redacted_md5, CAST(length(t) AS BIGINT) AS redacted_chars,
       {", ".join(f"CAST(c_{lbl} AS BIGINT) AS n_{lbl.lower()}" for lbl in O.LABELS)}
FROM s10
""")
def red_1_sequential_redact(spark, sf_dir):
    c = corpus_with_cases(spark, sf_dir)
    r = R.redact_rules(c, keep_counts=True)
    return r.select("src", "doc_id", F.md5("redacted").alias("redacted_md5"),
                    F.length("redacted").cast("long").alias("redacted_chars"),
                    *[F.col(f"n_{lbl.lower()}").cast("long") for lbl in O.LABELS])


@register("red_2_match_count", sql=f"""
WITH {O.corpus_cte()},
{O.redact_steps('corpus', 'text', ['src', 'doc_id'])}
SELECT src, count(*) AS docs, CAST(sum(matches) AS BIGINT) AS matches,
       count(*) FILTER (WHERE matches > 0) AS docs_with_pii
FROM s10 GROUP BY src
""")
def red_2_match_count(spark, sf_dir):
    c = corpus_with_cases(spark, sf_dir)
    r = R.redact_rules(c)
    return r.groupBy("src").agg(F.count(F.lit(1)).alias("docs"), F.sum("matches").cast("long").alias("matches"),
                                F.count_if(F.col("matches") > 0).alias("docs_with_pii"))


@register("red_3_token_sizes", sql=f"""
WITH {O.redact_steps('documents', 'text', ['doc_id', 'lang', 'text'])}
SELECT doc_id, lang, {O.token_count('text')} AS input_tokens,
       {O.token_count('t')} AS output_tokens, CAST(matches AS BIGINT) AS matches
FROM s10
""")
def red_3_token_sizes(spark, sf_dir):
    r = R.redaction_output(docs(spark, sf_dir))
    return r.select("doc_id", "lang", F.col("input_tokens").cast("long"), F.col("output_tokens").cast("long"),
                    F.col("matches").cast("long"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum slice: per language, documents, e-mails found, tokens before/after redaction."""
    d = docs(spark, sf_dir)
    r = R.redaction_output(d).withColumn("emails", F.size(D.rule_values("text", RULES[2])))
    return (r.groupBy("lang")
             .agg(F.count(F.lit(1)).alias("docs"), F.sum("emails").cast("long").alias("emails"),
                  F.sum("matches").cast("long").alias("matches"),
                  F.sum("input_tokens").cast("long").alias("tokens_in"),
                  F.sum("output_tokens").cast("long").alias("tokens_out")))


register("flagship_redaction_by_lang", sql=f"""
WITH {O.redact_steps('documents', 'text', ['doc_id', 'lang', 'text'])}
SELECT lang, count(*) AS docs, CAST(sum(len({O.rule_values('text', 3)})) AS BIGINT) AS emails,
       CAST(sum(matches) AS BIGINT) AS matches,
       CAST(sum({O.token_count('text')}) AS BIGINT) AS tokens_in, CAST(sum({O.token_count('t')}) AS BIGINT) AS tokens_out
FROM s10 GROUP BY lang
""")(flagship)

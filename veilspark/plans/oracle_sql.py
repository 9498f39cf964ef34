"""DuckDB SQL twins of the registered queries (the correctness oracle).

DuckDB uses RE2, which has no look-around, so each rule is rewritten with
three groups: (boundary char before)(match)(boundary char after). Python's
``\\b`` next to a word character becomes "preceded/followed by a non-word
character or the text edge", with Python's word class ``[\\p{L}\\p{N}_]``.
This is exact except when two matches are separated by a single character
that both would need as their boundary, which the test data does not have.
"""

from __future__ import annotations

from .fixtures import RULE_CASES

NW = r"[^\p{L}\p{N}_]"
SP = r"\t-\r\x{1c}-\x{20}\x{85}\p{Z}"       # Python whitespace, inside a class
D = r"\p{Nd}"
LEAD = rf"(^|{NW})"
TRAIL = rf"({NW}|$)"

# (label, RE2 pattern with exactly three groups, flags) in application order.
RE2_RULES = (
    ("SECRET", LEAD + r"(sk-[A-Za-z0-9_-]{7,}[A-Za-z0-9_]|sk-proj-[A-Za-z0-9_-]{7,}[A-Za-z0-9_]|(?:AKIA|ASIA)[A-Z0-9]{16})" + TRAIL, "g"),
    ("SECRET", LEAD + rf"((?:api[_-]?key|access[_-]?token|auth[_-]?token|password|secret)[{SP}]*[:=][{SP}]*[^{SP}\"']{{4,}})()", "gi"),
    ("EMAIL", LEAD + r"([A-Z0-9][A-Z0-9._%+-]*@[A-Z0-9.-]+\.[A-Z]{2,})" + TRAIL, "gi"),
    ("URL", LEAD + rf"(https?://[^{SP}<>\"]+)()", "gi"),
    ("PHONE", rf"()((?:\+{D}{{1,3}}[{SP}.-]?)?(?:\(?{D}{{2,4}}\)?[{SP}.-]?){{2,5}}{D}{{2,4}})()", "g"),
    ("ACCOUNT", LEAD + rf"([A-Z]{{2}}{D}{{2}}[A-Z0-9]{{10,30}})" + TRAIL, "g"),
    ("ACCOUNT", LEAD + rf"({D}[{D} -]{{11,}}{D})" + TRAIL, "g"),
    ("DATE", LEAD + rf"({D}{{4}}[-/年]{D}{{1,2}}[-/月]{D}{{1,2}}日?)" + TRAIL, "g"),
    ("ADDRESS", rf"()({D}{{1,4}}(?:丁目|番地|番|号))()", "g"),
    ("ADDRESS", LEAD + rf"({D}{{1,6}}[{SP}]+[A-Za-z0-9 .'-]+(?:street|st|road|rd|avenue|ave|lane|ln|drive|dr|boulevard|blvd|way|court|ct))" + TRAIL, "gi"),
)

TOKEN_RE2 = (r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"
             rf"|[A-Za-z0-9_@./:+-]+|[^{SP}]")
LABELS = ("SECRET", "EMAIL", "URL", "PHONE", "ACCOUNT", "DATE", "ADDRESS")


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rule_cases_values() -> str:
    rows = ", ".join(f"({cid}, {q(txt)})" for cid, txt in RULE_CASES)
    return f"(VALUES {rows}) AS rc(case_id, text)"


def corpus_cte(with_cases: bool = True) -> str:
    parts = [
        "SELECT 'documents' AS src, doc_id, text FROM documents",
        "SELECT 'pages.url' AS src, page_id AS doc_id, url AS text FROM pages",
        "SELECT 'pages.html' AS src, page_id AS doc_id, html AS text FROM pages",
        "SELECT 'conversations' AS src, conv_id * 1000 + turn AS doc_id, text FROM conversations",
    ]
    if with_cases:
        parts.append(f"SELECT 'rule_cases' AS src, CAST(case_id AS BIGINT) AS doc_id, text FROM {rule_cases_values()}")
    return "corpus AS (" + " UNION ALL ".join(parts) + ")"


def token_count(expr: str) -> str:
    return f"CAST(len(regexp_extract_all(coalesce({expr}, ''), {q(TOKEN_RE2)}, 0)) AS BIGINT)"


def rule_values(expr: str, i: int) -> str:
    _label, pat, flags = RE2_RULES[i - 1]
    opt = ", 'i'" if "i" in flags else ""
    return f"regexp_extract_all({expr}, {q(pat)}, 2{opt})"


def redact_steps(src: str, text_col: str, keys: list[str], n_rules: int = 10, prefix: str = "") -> str:
    """CTE chain s0..s10 applying the rules in order with counters.

    Each step marks matches with chr(1) (keeping the boundary characters),
    splits on the mark and re-joins with numbered placeholders.
    """
    k = ", ".join(keys)
    zero = ", ".join(f"0 AS c_{lbl}" for lbl in LABELS)
    ctes = [f"s0 AS (SELECT {k}, {text_col} AS t, {zero}, 0 AS matches FROM {src})"]
    px = prefix
    for i, (label, pat, flags) in enumerate(RE2_RULES[:n_rules], start=1):
        marked = f"string_split(regexp_replace(t, {q(pat)}, '\\1' || chr(1) || '\\3', {q(flags)}), chr(1))"
        counters = ", ".join(
            (f"c_{lbl} + len(w) - 1 AS c_{lbl}" if lbl == label else f"c_{lbl}") for lbl in LABELS)
        ctes.append(
            f"p{i} AS (SELECT {k}, {marked} AS w, " + ", ".join(f"c_{lbl}" for lbl in LABELS)
            + f", matches FROM s{i - 1})")
        rebuilt = (f"w[1] || array_to_string(list_transform(w[2:], lambda p, j: "
                   f"'[{label}_' || CAST(c_{label} + j AS VARCHAR) || ']' || p), '')")
        ctes.append(f"s{i} AS (SELECT {k}, {rebuilt} AS t, {counters}, matches + len(w) - 1 AS matches FROM p{i})")
    if n_rules < len(RE2_RULES):
        ctes.append(f"s10 AS (SELECT * FROM s{n_rules})")
    out = ",\n".join(ctes)
    if px:
        import re
        out = re.sub(r"\b([sp])(\d+)\b", lambda m: f"{px}{m.group(1)}{m.group(2)}", out)
    return out


# FIXED VALUES: detection label -> span category (same map as operators.decode).
CATEGORY = {"SECRET": "secret", "ACCOUNT": "account_number", "EMAIL": "private_email", "PHONE": "private_phone",
            "ADDRESS": "private_address", "DATE": "private_date", "URL": "private_url"}


def spans_cte(src: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTE ``spans(doc_id, rule, det_label, label, start, end, value)``: every rule's
    matches on the original text with code-point offsets.

    Each match is marked as <lead> chr(1) <match> chr(2) <trail>; after
    splitting on chr(1), the k-th match starts after the (marker-free)
    lengths of the first k pieces.
    """
    parts = []
    for i, (label, pat, flags) in enumerate(RE2_RULES, start=1):
        parts.append(
            f"SELECT {key} AS doc_id, {i} AS rule, '{label}' AS det_label, "
            f"string_split(regexp_replace({text}, {q(pat)}, '\\1' || chr(1) || '\\2' || chr(2) || '\\3', {q(flags)}), chr(1)) AS w "
            f"FROM {src}")
    cat = "CASE det_label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY.items()) + " END"
    return (f"marked AS ({' UNION ALL '.join(parts)}),\n"
            f"spans AS (SELECT doc_id, rule, det_label, {cat} AS label,"
            f" CAST(list_sum(list_transform(w[1:k], lambda x: length(replace(x, chr(2), '')))) AS INTEGER) AS start,"
            f" CAST(list_sum(list_transform(w[1:k], lambda x: length(replace(x, chr(2), '')))) + length(split_part(w[k + 1], chr(2), 1)) AS INTEGER) AS \"end\","
            f" split_part(w[k + 1], chr(2), 1) AS value"
            f" FROM marked, range(1, len(w)) r(k))")


def tokens_cte(src: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTE ``toks(doc_id, tok_idx, piece, tok_start, tok_end)``."""
    return (f"tk0 AS (SELECT {key} AS doc_id, regexp_extract_all({text}, {q(TOKEN_RE2)}, 0) AS k, "
            f"string_split_regex({text}, {q(TOKEN_RE2)}) AS g FROM {src}),\n"
            f"tk1 AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS tok_idx, length(g[i]) + length(k[i]) AS step, "
            f"length(k[i]) AS klen, k[i] AS piece FROM tk0, range(1, len(k) + 1) r(i)),\n"
            f"toks AS (SELECT doc_id, tok_idx, piece, "
            f"CAST(sum(step) OVER (PARTITION BY doc_id ORDER BY tok_idx ROWS UNBOUNDED PRECEDING) - klen AS INTEGER) AS tok_start, "
            f"CAST(sum(step) OVER (PARTITION BY doc_id ORDER BY tok_idx ROWS UNBOUNDED PRECEDING) AS INTEGER) AS tok_end FROM tk1)")


def token_labels_cte() -> str:
    """CTE ``labels(doc_id, tok_idx, tok_start, tok_end, piece, label)`` (needs spans, toks)."""
    return ("pairs AS (SELECT t.doc_id, t.tok_idx, s.rule, s.start AS s_start, s.det_label, "
            "CAST(s.rule AS VARCHAR) || ':' || CAST(s.start AS VARCHAR) AS span_id "
            "FROM toks t JOIN spans s ON t.doc_id = s.doc_id AND t.tok_start < s.\"end\" AND t.tok_end > s.start),\n"
            "best AS (SELECT doc_id, tok_idx, arg_min(span_id, (rule, s_start)) AS span_id, "
            "arg_min(det_label, (rule, s_start)) AS det_label FROM pairs GROUP BY ALL),\n"
            "ends AS (SELECT doc_id, span_id, min(tok_idx) AS first, max(tok_idx) AS last FROM best GROUP BY ALL),\n"
            "lab AS (SELECT b.doc_id, b.tok_idx, CASE WHEN first = last THEN 'S' WHEN tok_idx = first THEN 'B' "
            "WHEN tok_idx = last THEN 'E' ELSE 'I' END || '-' || "
            "CASE det_label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY.items()) + " END AS label "
            "FROM best b JOIN ends e USING (doc_id, span_id)),\n"
            "labels AS (SELECT t.doc_id, t.tok_idx, t.tok_start, t.tok_end, t.piece, coalesce(l.label, 'O') AS label "
            "FROM toks t LEFT JOIN lab l USING (doc_id, tok_idx))")


def split_bioes_sql(label: str) -> tuple[str, str]:
    """(tag, entity) SQL for a BIOES label column."""
    head = f"upper(split_part({label}, '-', 1))"
    tagged = f"(position('-' IN {label}) > 0 AND {head} IN ('B', 'I', 'E', 'S'))"
    tag = f"CASE WHEN {label} = 'O' THEN NULL WHEN {tagged} THEN {head} ELSE 'S' END"
    ent = (f"CASE WHEN {label} = 'O' THEN NULL WHEN {tagged} THEN substr({label}, position('-' IN {label}) + 1) "
           f"ELSE {label} END")
    return tag, ent


_SPAN_LIST_T = "STRUCT(label VARCHAR, s INTEGER, e INTEGER)[]"


def bioes_fold_sql(items: str, allowed: list[str] | None) -> str:
    """Fold over a list of {s, e, tag, ent} (in token order) -> list of {label, s, e}."""
    def ok(ent):
        if allowed is None:
            return "true"
        return f"list_contains([{', '.join(q(a) for a in allowed)}], {ent})"

    def flush(cl, cs, ce, out):
        return (f"CASE WHEN {cl} IS NOT NULL AND {cs} IS NOT NULL AND {ce} IS NOT NULL AND {cs} < {ce} AND {ok(cl)} "
                f"THEN list_append({out}, {{'label': {cl}, 's': {cs}, 'e': {ce}}}) ELSE {out} END")

    def st(cl, cs, ce, out):
        return f"{{'cl': {cl}, 'cs': {cs}, 'ce': {ce}, 'out': {out}}}"

    n_s, n_i = "CAST(NULL AS VARCHAR)", "CAST(NULL AS INTEGER)"
    fa = flush("acc.cl", "acc.cs", "acc.ce", "acc.out")
    same = "(acc.cl = x.ent AND acc.cs IS NOT NULL)"
    ext = "greatest(coalesce(acc.ce, x.e), x.e)"
    emit_x = "{'label': x.ent, 's': x.s, 'e': x.e}"
    step = (
        "CASE WHEN x.s >= x.e THEN acc "
        f"WHEN x.ent IS NULL THEN {st(n_s, n_i, n_i, fa)} "
        f"WHEN x.tag = 'S' THEN {st(n_s, n_i, n_i, f'CASE WHEN {ok('x.ent')} THEN list_append({fa}, {emit_x}) ELSE {fa} END')} "
        f"WHEN x.tag = 'B' THEN {st('x.ent', 'x.s', 'x.e', fa)} "
        f"WHEN x.tag = 'I' THEN CASE WHEN {same} THEN {st('acc.cl', 'acc.cs', ext, 'acc.out')} "
        f"ELSE {st('x.ent', 'x.s', 'x.e', fa)} END "
        f"WHEN x.tag = 'E' THEN CASE WHEN {same} THEN {st(n_s, n_i, n_i, flush('acc.cl', 'acc.cs', ext, 'acc.out'))} "
        f"ELSE {st('acc.cl', 'acc.cs', 'acc.ce', f'CASE WHEN {ok('x.ent')} THEN list_append(acc.out, {emit_x}) ELSE acc.out END')} END "
        f"ELSE {st(n_s, n_i, n_i, fa)} END")
    init = st(n_s, n_i, n_i, f"CAST([] AS {_SPAN_LIST_T})")
    r = f"list_reduce({items}, lambda acc, x: {step}, {init})"
    return flush(f"{r}.cl", f"{r}.cs", f"{r}.ce", f"{r}.out")


def greedy_sql(spans: str, same_label_only: bool) -> str:
    """Keep spans (already ordered by start asc, length desc) that overlap no kept one."""
    cond = "k.s < x.e AND x.s < k.e" + (" AND k.label = x.label" if same_label_only else "")
    return (f"list_reduce({spans}, lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: {cond})) > 0 "
            f"THEN kept ELSE list_append(kept, x) END, CAST([] AS {_SPAN_LIST_T}))")


def doc_span_lists_cte(ordered_by_length: bool = True) -> str:
    """CTE ``dspans(doc_id, spans)``: each document's category spans ordered like
    the Spark side (start, end, rule, label), then greedily de-overlapped."""
    return ("dspans AS (SELECT doc_id, list({'label': label, 's': start, 'e': \"end\"} "
            "ORDER BY start, \"end\", rule, det_label) AS spans, "
            "list({'label': label, 's': start, 'e': \"end\"} ORDER BY start, (\"end\" - start) DESC, \"end\", rule, det_label) AS greedy_in "
            "FROM spans GROUP BY doc_id)")


def apply_spans_sql(text: str, spans: str) -> str:
    """Right-to-left replacement with [PII_<LABEL>_n], n counting from the end per label."""
    ordered = (f"list_transform(list_sort(list_transform({spans}, lambda x, i: {{'neg': -x.s, 'ord': i, 'label': x.label, "
               f"'s': x.s, 'e': x.e}})), lambda y: y)")
    numbered = (f"list_transform({ordered}, lambda y, i: {{'label': y.label, 's': y.s, 'e': y.e, "
                f"'n': len(list_filter({ordered}[1:i], lambda z: z.label = y.label))}})")
    step = ("{'t': substr(acc.t, 1, least(greatest(x.s, 0), length(acc.t))) || '[PII_' || upper(x.label) || '_' "
            "|| CAST(x.n AS VARCHAR) || ']' || substr(acc.t, least(greatest(x.e, 0), length(acc.t)) + 1)}")
    return f"list_reduce({numbered}, lambda acc, x: {step}, {{'t': {text}}}).t"

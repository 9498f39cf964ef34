"""Main text of web pages by nearest-URL page differencing.

A page is cut into text blocks ("lines"). Pages are ordered by host and URL
path; each page is paired with the neighbour of its host whose path shares the
longest prefix with its own (the earlier one of two equal ones). The lines of
the two pages are aligned by longest common subsequence, and lines common to
both are template and go. A neighbour that repeats the whole page says nothing
about the template; then the other neighbour is taken, if any.

Markup settles what a difference cannot: lines inside navigation, header,
footer, aside, form, advert, notice and comment elements go even if no
neighbour shares them (inside main text, a class or id must name nothing else), and if a page marks its ``article`` (or ``main``), the
lines inside it stay even if a copy of the article stands at the next URL, and
those outside go.

Only 64-bit line hashes travel to the neighbour page; a global rank over
(host, path, page) pairs the pages, so no task holds a host.

Defined results for odd input: a null or empty html gives an empty text; a page
without ``url`` pairs within the empty host; identical rows give identical
results; unclosed and misnested elements are closed by their parents' end.
White space is what ``str.split`` takes for it. Extra columns are ignored.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table
from .registry import query
from .store import written

_RAW = r"(?:script|style|noscript|template|iframe|textarea|title|svg|math|object|canvas|audio|video)(?=[\s/>])"
# a slash that ends an unquoted value closes nothing
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)
    |<{_RAW}(?:(?:[^>"']|"[^"]*"|'[^']*')*(?:(?<=[\s"'])|\s[^\s"'>/=]+))?/>
    |<(?P<raw>{_RAW})(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)
    |<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)>
    |<[!?/][^>]*>""", re.S | re.I | re.X)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text.
ASIDE = frozenset("nav footer aside form menu select button dialog head fieldset".split())
MAIN = frozenset(("article", "main"))
#: Words in class, id or role that mark what is not main text.
ASIDE_WORDS = frozenset("""ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies
    disqus footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo related replies respond search share
    sharing sidebar skip social sponsor sponsored subscribe toolbar widget complementary""".split())
#: Inside main text only blocks that are called one of these, alone or with NEUTRAL_WORDS, are set aside; an article only if called a comment.
INNER_WORDS = frozenset("ad ads advert adverts advertisement advertisements comment comments form forms notice notices".split())
COMMENT_WORDS = frozenset(("comment", "comments"))
NEUTRAL_WORDS = frozenset("area block body box container cookie div inner item list outer section slot thread unit wrap wrapper".split())
#: Roles that say what the elements of ASIDE say.
INNER_ROLES = frozenset("navigation contentinfo complementary search menu menubar toolbar dialog alertdialog form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WORD = re.compile(r"[a-z]+")


def _called(value: str, names: frozenset[str]) -> bool:
    """Whether one of the value's names consists of ``names`` and neutral words."""
    for name in value.split():
        words = set(_WORD.findall(name))
        if not words.isdisjoint(names) and words <= names | NEUTRAL_WORDS:
            return True
    return False


def _aside(name: str, attrs: str, inside_main: bool) -> bool:
    if name in ASIDE or (name == "header" and not inside_main):
        return True
    if not attrs:
        return False
    for kind, value in _ATTR.findall(attrs):
        kind, value = kind.lower(), value.strip("\"'").lower()
        if kind == "hidden" or (kind == "aria-hidden" and value == "true"):
            return True
        if kind not in ("class", "id", "role") or name in ("html", "body"):
            continue
        if name in MAIN:
            found = _called(value, COMMENT_WORDS)
        elif not inside_main:
            found = not ASIDE_WORDS.isdisjoint(_WORD.findall(value))
        elif kind == "role":
            found = not INNER_ROLES.isdisjoint(value.split())
        else:  # a heading's id is made of its words
            found = not (kind == "id" and name in HEADINGS) and _called(value, INNER_WORDS)
        if found:
            return True
    return False


def lines(page: str | None) -> list[tuple[str, bool, bool]]:
    """The text blocks of a page in order: (text, inside main text markup, inside an element set aside)."""
    page = page or ""
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, main, aside: as they hold inside the element
    text: list[str] = []
    main = aside = False

    def close() -> None:
        joined = " ".join(htmllib.unescape("".join(text)).split())
        text.clear()
        if joined:
            out.append((joined, main, aside))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE and (not m["attrs"] or not _aside(name, m["attrs"], main)) and not any(s[0] == name for s in stack[-1:]):
            continue
        if name == "br":
            text.append(" ")
            continue
        close()
        if m["end"]:
            if any(s[0] == name for s in stack):
                while stack.pop()[0] != name:
                    pass
        elif name not in VOID:
            if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == name:
                stack.pop()
                main, aside = stack[-1][1:] if stack else (False, False)
            own = aside or _aside(name, m["attrs"], main)
            stack.append((name, main or (name in MAIN and not own), own))
        main, aside = stack[-1][1:] if stack else (False, False)
    if at < len(page):
        text.append(page[at:])
    close()
    return out


def _hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode()) - (1 << 63)


def common(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b`` (bit-parallel rows)."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    head, tail = list(range(low)), list(range(len(a) - high, len(a)))
    return head + [low + i for i in _align(a[low:len(a) - high], b[low:len(b) - high])] + tail


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    place: dict[int, int] = {}
    for j, x in enumerate(b):
        place[x] = place.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & place.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _align(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > 1 << 28 and len(a) > 1:  # halve, so that memory stays linear
        half = len(a) // 2
        for v in _rows(a[:half], b):
            left = v
        for v in _rows(a[half:][::-1], b[::-1]):
            right = v
        up = [0]
        for j in range(len(b)):
            up.append(up[-1] + (not left >> j & 1))
        down = [0]
        for j in range(len(b)):
            down.append(down[-1] + (not right >> j & 1))
        cut = max(range(len(b) + 1), key=lambda j: up[j] + down[len(b) - j])
        return _align(a[:half], b[:cut]) + [half + i for i in _align(a[half:], b[cut:])]
    v = list(_rows(a, b))
    out, i, j = [], len(a), len(b)
    while i and j:
        if v[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if i and not v[i - 1] >> (j - 1) & 1:
                continue
            out.append(i)
            j -= 1
    return out[::-1]


def _path_key(url: str | None) -> tuple[str, str]:
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "", url or "")
    host, slash, path = rest.partition("/")
    return host.lower(), slash + path.partition("#")[0]


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _shared(own: list[int], path: str, others: list[tuple[str, list[int]]]) -> list[int]:
    """Positions of the lines shared with the nearest neighbour that is not the same page again."""
    for _, there in sorted(others, key=lambda o: -_prefix(path, o[0])):
        found = common(own, there)
        if len(found) < len(own) or len(own) == 0:
            return found
    return []


_KEY = ["page_id", "url", "page_key"]


def template_lines(pages: DataFrame) -> DataFrame:
    """Per different page: its key and ``shared``, the positions (among its lines outside main markup) that go."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("page_key", pa.int64()), ("host", pa.string()),
                        ("path", pa.string()), ("hashes", pa.list_(pa.int64()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = [_path_key(u) for u in batch.column("url").to_pylist()]
            hashes = [[_hash(t) for t, main, _ in lines(h.as_py()) if not main] for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in _KEY] + [
                pa.array([u[0] for u in urls], pa.string()), pa.array([u[1] for u in urls], pa.string()),
                pa.array(hashes, pa.list_(pa.int64()))], schema=schema)

    spark = pages.sparkSession
    rows = pages.select(*_KEY, "html").mapInArrow(cut, "page_id long, url string, page_key long, host string, path string, hashes array<long>")
    rows = written(rows.dropDuplicates(_KEY), "page-lines")
    order = ["host", "path", "page_id", "page_key"]
    ranked = written(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                     .withColumn("at", F.monotonically_increasing_id()), "page-order")
    part = F.shiftright("at", 33)
    sizes = sorted((r.part, r.n) for r in ranked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    bases, total = [], 0
    for k, n in sizes:  # one row per partition
        bases.append((k, total))
        total += n
    bases = spark.createDataFrame(bases, "part long, base long")
    ranked = ranked.join(F.broadcast(bases), part == F.col("part")).withColumn(
        "rank", F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1))
    own = F.struct(*_KEY, "host", "path", "hashes")
    sent = ranked.select(F.explode(F.array(*[F.struct((F.col("rank") + d).alias("rank"), F.lit(d).alias("role"), own.alias("page"))
                                             for d in (0, 1, -1)])).alias("s")).select("s.*")
    met = sent.groupBy("rank").agg(*[F.first(F.when(F.col("role") == d, F.col("page")), ignorenulls=True).alias(name)
                                     for name, d in (("own", 0), ("before", 1), ("after", -1))]).where("own IS NOT NULL")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for row in batch.to_pylist():
                page = row["own"]
                others = [(o["path"], o["hashes"]) for o in (row["before"], row["after"]) if o and o["host"] == page["host"]]
                for column, value in zip(out, (*(page[c] for c in _KEY), _shared(page["hashes"], page["path"], others)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()),
                                              pa.array(out[3], pa.list_(pa.int32()))], names=[*_KEY, "shared"])

    return met.mapInArrow(align, "page_id long, url string, page_key long, shared array<int>")


def main_text(page: str | None, shared: list[int] | None) -> str:
    found = lines(page)
    marked = any(main and not aside for _, main, aside in found)
    gone = set(shared or ())
    out, outside = [], 0
    for text, main, aside in found:
        if not main:
            outside += 1
        if not aside and (main if marked else outside - 1 not in gone):
            out.append(text)
    return " ".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), s.as_py()) for h, s in zip(batch.column("html"), batch.column("shared"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    keyed = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("page_key"))
    found = template_lines(keyed).select(F.col("page_key").alias("_k"), F.col("page_id").alias("_p"), F.col("url").alias("_u"), "shared")
    joined = keyed.join(found, (F.col("page_key") == F.col("_k")) & F.col("page_id").eqNullSafe(F.col("_p")) & F.col("url").eqNullSafe(F.col("_u")), "left")
    return joined.select("page_id", "url", "html", "shared").mapInArrow(run, "page_id long, url string, text string, n_chars long")


@query("op3_page_differencing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

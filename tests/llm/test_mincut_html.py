import itertools
import random

import pytest

from shopgrain.llm import mincut_html as m
from shopgrain.llm.maxflow import source_side

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><a href=x>Site</a><nav><ul><li><a href=a>Home</a></li></ul></nav></header>
<div class="cookie-notice">We use cookies here. Please accept all of them now.</div>
<article><h1>A title</h1><p>First   paragraph of the&nbsp;story, with words &amp; signs &#233;.<br>Next line.<p>Unclosed <b>second one
goes on.<div class="ad">Buy this fine thing now, it is great.</div><p>Third, after the advert, is here to be kept.</p>
<form><label>Mail</label><input><button>Send</button></form></article>
<aside>Related stories are many and they are long enough to count.</aside>
<section class="comments"><h3>Comments</h3><article class="comment"><p>I liked it a lot, really.</p></article></section>
<footer>&copy; Site</footer>"""


def test_article_without_the_rest():
    assert m.main_text(PAGE) == (
        "A title First paragraph of the story, with words & signs é. Next line. Unclosed second one goes on. "
        "Third, after the advert, is here to be kept."
    )


def test_pages_without_semantic_elements():
    page = ("<body><div class=menu><a href=1>One</a> <a href=2>Two</a></div><div><p>" + "A long text with many words, as articles have. " * 5
            + "</p><p>Short.</p><p>" + "Another long text that goes on and on, with commas. " * 4 + "</p></div><div id=footer>Imprint</div>")
    text = m.main_text(page)
    assert "Short." in text and "Imprint" not in text and "One" not in text and text.startswith("A long text")


LONG = "A long text with many words, as articles have, and it goes on. " * 4


@pytest.mark.parametrize("wrapper", [
    "<div class='layout has-sidebar'>", "<div class='no-sidebar'>", "<div class=with-comments>", "<div class=page-header>",
    "<section class='related'>", "<div id=sidebar>", "<div class=comments>", "<form id=page>",
])
def test_a_name_on_a_wrapper_does_not_drop_the_article(wrapper):
    article = f"<article><h1>The title of it</h1><p>{LONG}</p><p>{LONG}</p></article>"
    text = m.main_text(f"<html><body>{wrapper}{article}</div></section></form><footer>Imprint</footer></body></html>")
    assert text.count("A long text") == 8 and "Imprint" not in text


def test_the_cut_can_overrule_a_name():
    assert m.SAID[m.NAMED] + 2.5 + 4 * 0.8 > 0
    inside = "".join(f"<p>{LONG}</p>" for _ in range(2))
    text = m.main_text(f"<html><body><div><div><div><article>{inside}<div class=ad></div><p class=notice>{LONG}</p>{inside}</article></div></div></div>")
    assert text.count("A long text") == 20
    assert m.main_text(f"<article><p>{LONG}</p><div class=ad>Buy now.</div><p>{LONG}</p></article>").count("Buy") == 0


@pytest.mark.parametrize("wrapper", ["form id=aspnetForm", "div class=notice", "div id=widget", "form class=form"])
def test_a_name_around_the_whole_page_says_nothing(wrapper):
    paragraphs = "".join(f"<p>{LONG}</p>" for _ in range(40))
    page = f"<body><{wrapper}><nav><a href=1>Home</a></nav>{paragraphs}<div class=ad>Buy this now, it is great.</div></{wrapper.split()[0]}></body>"
    text = m.main_text(page)
    assert text.count("A long text") == 160 and "Home" not in text and "Buy" not in text


def test_teasers_beside_the_article_stay_out():
    teaser = "<article><h3>Ten tips for a better garden</h3><p>All that you need to know of it, in a few words. Read on.</p></article>"
    for name in ("related", "sidebar", "recommended", "promo"):
        page = f"<body><article><p>{LONG}</p><p>{LONG}</p></article><section class={name}>{teaser * 3}</section></body>"
        assert m.main_text(page) == " ".join((LONG * 2).split())
        longer = f"<body><article><p>{LONG}</p></article><section class={name}>{teaser * 30}</section></body>"
        assert m.main_text(longer) == " ".join(LONG.split())


def test_the_headline_in_an_article_s_header_stays():
    page = f"<body><header><p>The site of sites</p></header><article><header><h1>The headline</h1><nav><a href=1>Up</a></nav></header><p>{LONG}</p></article></body>"
    assert m.main_text(page) == "The headline " + " ".join(LONG.split())


def test_related_and_comments_outside_stay_out():
    article = f"<article><p>{LONG}</p></article>"
    aside = "<section class=related><article><a href=1>Other story</a></article></section><div class=comments><article><p>So nice.</p></article></div>"
    assert m.main_text(f"<body>{article}{aside}</body>") == " ".join(LONG.split())


def test_capitals_are_counted_over_the_whole_block():
    title = "WORDS IN CAPITALS " * 12
    short, long = (m.features_of(m.blocks_of(f"<p>{title}{'and small ones ' * k}</p>"))[0][4] for k in (0, 100))
    assert short > 0.8 and long < 0.15


def test_cut_is_minimal():
    draw = random.Random(2)
    for _ in range(300):
        n = draw.randrange(1, 9)
        terminals = [draw.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, draw.uniform(0, 1.5)) for i, j in itertools.combinations(range(n), 2) if draw.random() < 0.5]

        def cost(side):
            return sum(max(-t, 0) if s else max(t, 0) for t, s in zip(terminals, side)) + sum(
                w for i, j, w in edges if side[i] != side[j])

        least = min(cost(side) for side in itertools.product([False, True], repeat=n))
        assert cost(source_side(terminals, edges)) == pytest.approx(least)


def test_rows_and_edge_cases(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "", "x"), (3, "w", "<p>&lt;</p", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = m.extract(pages).collect()
    assert len(got) == 5 and got[0].text == got[1].text == m.main_text(PAGE)
    assert [r.text for r in got[2:4]] == ["", ""]
    assert m.extract(pages.limit(0)).count() == 0


def test_long_page_takes_time_in_proportion():
    page = "<article>" + "".join(f"<div class='{'ad' if i % 3 == 0 else 'x'}'><p>word word {i}, and so on.</p></div>" for i in range(8000))
    assert m.main_text(page).count("word word") == 8000 - 2667


def test_articles_of_the_pages(spark, smallest_dir):
    """Text of the article element, taken by plain patterns, on all given pages."""
    import html
    import re

    pages = spark.read.parquet(f"{smallest_dir}/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in m.extract(pages).collect():
        inside = re.search(r"<article>(.*?)(</article>|<footer|$)", raw[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[a-zA-Z/!][^>]*>", " ", inside)).split())

import html
import math
import re
import time
import tracemalloc

import pytest

from docketry.llm import html_text


def test_pages_equal_their_articles(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want[r["page_id"]] = re.sub(r"\s+", " ", html.unescape(re.sub(r"<(?:/?p|br|/?h1)>", " ", re.sub(r"</?b>", "", body)))).strip()
    assert {r["page_id"]: r["main_text"] for r in html_text.extract(pages).collect()} == want


LONG = "A paragraph of the article, with commas, that is long enough to count. It has two sentences."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<p>", ""),
        ("just text, no tags.", "just text, no tags."),
        (f"<nav><a href=/>Home</a></nav><div id=content><h2>Head</h2><p>{LONG}</p><ul><li>one point</ul></div><div class='site-footer'>(c) us</div>", f"Head {LONG} one point"),
        (f"<article><p>{LONG}<p>Second &amp; last&#33;<aside>see also</aside></article><section class=comments><p>{LONG} I liked it, a lot, really.</p></section>", f"{LONG} Second & last!"),
        (f"<main><p>{LONG}</p><div class=cookie-notice>We use cookies, sorry.</div><form>Name <input></form><script>var a='<p>no</p>';</script></main>", LONG),
        (f"<body class='has-sidebar'><div><p>{LONG}</p></div></body>", LONG),
        (f"<article><p>a<b>b</b>  c\n\td</p><p>{LONG}</p></article>", f"ab c d {LONG}"),
        (f"<article><p>{LONG}</p><!-- <p>gone</p> --></article><p>tail", LONG),
        (f"<article><h1>Title</h1><section><h2>Part</h2><p>{LONG} <a href=x>a link in it</a>.</p></section><ul class=x><li><a href=1>One more</a></li><li><a href=2>Two more</a></li></ul></article>", f"Title Part {LONG} a link in it."),
        (f"<div id='side-bar'><p>{LONG}</p></div><div class='postBody'>{LONG}<br><br>{LONG}</div><div class='reader-comments'><div><p>{LONG} {LONG}</p></div></div>", f"{LONG} {LONG}"),
        (f"<table><tr><td class=menu><a href=a>a</a><a href=b>b</a></td><td><p>{LONG}</p><p>Short.</p></td></tr></table>", f"{LONG} Short."),
        (f"<div role=navigation>x, y, z.</div><div><h1>Head</h1><blockquote><p>{LONG}</p></blockquote><pre>code &lt;b&gt;</pre></div><div class=ad>buy, now.</div>", f"Head {LONG} code <b>"),
        (f"<article><p>{LONG} 1 < 2 <3</p><p title=\"open>{LONG}</p></article>", f"{LONG} 1 < 2 <3 {LONG}"),
        (f"<ARTICLE><P>{LONG}<BR/>{LONG}</P><img alt='a > b' src=x></ARTICLE>", f"{LONG} {LONG}"),
        (f"<article><p hidden>secret</p><p>{LONG}</p></article>", LONG),
    ],
)
def test_cases(page, text):
    assert html_text.main_text(page) == text


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, None, "x"), (1, "u", "", "x"), (None, "u", "<article><p>" + LONG * 3000, "x")], "page_id long, url string, html string, main_text string")
    got = [r["main_text"] for r in html_text.extract(rows).collect()]
    assert got[:2] == ["", ""] and got[2] == LONG * 3000
    assert html_text.extract(rows.where("false")).count() == 0


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "layout-one-sidebar", "legal-analysis", "share-price", "social-policy", "search-methods", "widget"])
def test_class_words_dont_remove_an_article(name):
    page = f"<p>One more line.</p><div class='{name}'><p>{LONG}</p><p>{LONG}</p><div class=ad-slot>buy, now.</div></div>"
    assert html_text.main_text(page).endswith(f"{LONG} {LONG}")


@pytest.mark.parametrize("name", ["legal-analysis", "share-price", "social-policy", "search-methods"])
def test_class_words_dont_remove_a_section(name):
    assert html_text.main_text(f"<article><p>{LONG}</p><section class={name}><p>{LONG}</p></section><p>{LONG}</p></article>") == " ".join([LONG] * 3)


def test_a_page_of_named_parts_isnt_lost():
    parts = "".join(f"<div class=widget><p>{LONG}</p></div>" for _ in range(6))
    assert html_text.main_text(f"<div><p>One more line.</p></div>{parts}").endswith(" ".join([LONG] * 6))
    assert html_text.main_text(f"<div><p>{LONG}</p></div><div class=comments-area>{parts}</div>") == LONG


def test_short_containers_of_a_long_article_stay():
    page = f"<div class=lede>A short lede of the story.</div><div class=story>{f'<p>{LONG}</p>' * 40}<div>A pulled quote</div></div><div>Between</div><div>{f'<p>{LONG}</p>' * 40}</div><div>It ends here.</div>"
    assert html_text.main_text(page) == " ".join(["A short lede of the story.", *[LONG] * 40, "A pulled quote", "Between", *[LONG] * 40, "It ends here."])


def test_menus_beside_an_unmarked_article_go():
    menu = "<div><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></div>"
    assert html_text.main_text(f"{menu}<div><p>{LONG}</p></div>{menu}<div><p>{LONG}</p></div>{menu}") == f"{LONG} {LONG}"


def test_article_and_main_are_chosen_by_weight():
    cards = "<article><h3>A card</h3><p>Read on.</p></article>" * 3
    assert html_text.main_text(f"<main><div><p>{LONG}</p><p>{LONG}</p></div>{cards}</main><p>tail").startswith(f"{LONG} {LONG}")
    assert html_text.main_text(f"<main><article><p>{LONG}</p></article><p>Short.</p></main>") == LONG
    assert html_text.main_text(f"<main><p>{LONG}</p><article><p>{LONG}</p></article></main>") == f"{LONG} {LONG}"
    assert html_text.main_text(f"<div>{f'<p>{LONG}</p>' * 9}</div>{cards}").startswith(" ".join([LONG] * 9))


def test_linked_text_of_an_article_stays():
    sources = "<ul><li><a href=1>The first report on the matter</a></li><li><a href=2>Second source</a></li></ul>"
    mixed = "<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li>a plain item</li></ul>"
    linked = f"<p><a href=3>{LONG}</a></p>"
    want = f"{LONG} Sources One Two Then. The first report on the matter Second source One Two a plain item {LONG}"
    body = f"<p>{LONG}</p><h2>Sources</h2><ol><li><a href=1>One</a></li><li><a href=2>Two</a></li></ol><p>Then.</p>{sources}{mixed}{linked}"
    assert html_text.main_text(f"<article>{body}</article>") == want
    assert html_text.main_text(f"<div><p>{LONG}</p>{body}</div>") == f"{LONG} {want}"
    assert html_text.main_text(f"<article><nav>{sources}</nav>{body}</article>") == want


def plain_ratios(nodes, keys):
    """The ratios node by node: for each path all nodes are looked through again."""
    shown = [(k, x) for k, x in zip(keys, nodes, strict=True) if x[1].strip()]
    own = []
    for key, _ in shown:
        same = [x for k, x in shown if k == key]
        own.append((sum(len(x[1].strip()) for x in same) / len(same), sum(sum(c in '.,;:!?…。、！？；：()"“”«»¿¡' for c in x[1]) for x in same) / len(same)))
    out = {}
    for key in dict.fromkeys(k for k, _ in shown):
        smooth = [[(own[max(0, i - 1)][w] + 2 * own[i][w] + own[min(len(own) - 1, i + 1)][w]) / 4 for w in (0, 1)] for i, (k, _) in enumerate(shown) if k == key]
        same = [x for k, x in shown if k == key]
        links = sum(len(x[1].strip()) for x in same if x[2]) / sum(len(x[1].strip()) for x in same)
        t, c = (sum(s[w] for s in smooth) / len(smooth) for w in (0, 1))
        out[key] = math.log(1 + t) * math.log(2 + c) * (1 - links) * key[1]
    return out


def some_pages(spark, sf):
    return [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").limit(60).collect()]


def test_ratios_equal_a_plain_version(spark, sf):
    for page in [*some_pages(spark, sf), "<p>a<b>b.</b>", "text", f"<div class=ad>x, y</div><main><p>{LONG}</p><a>z</a></main>"]:
        nodes = html_text.text_nodes(page)
        keys = [(x[0], html_text.AGAINST if x[3] else 1.0) for x in nodes]
        got, want = html_text.path_ratios(nodes, keys), plain_ratios(nodes, keys)
        assert list(got) == list(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_paths_go_from_root_to_leaf():
    assert [x[0] for x in html_text.text_nodes("<html><body><div><p>a<b>c</b></p></div>")] == ["/html/body/div/p", "/html/body/div/p/b"]


def test_ratios_select_the_content(spark, sf, monkeypatch):
    pages = some_pages(spark, sf)
    before = [html_text.main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "content_paths", lambda nodes, keys: set(keys))
    assert sum(html_text.main_text(p) != b for p, b in zip(pages, before, strict=True)) >= 0.9 * len(pages)


def test_pages_of_neutral_divs():
    menu = "<div class=x1><div><a href=a>One</a></div><div><a href=b>Two</a></div><div><a href=c>Three</a></div></div>"
    story = "".join(f"<div>{LONG}</div>" for _ in range(5))
    assert html_text.main_text(f"<div>{menu}<div class=x2>{story}</div><div class=x3><span>A</span> <span>B</span></div></div>") == " ".join([LONG] * 5)


@pytest.mark.parametrize("name", ["comments", "related", "sidebar"])
@pytest.mark.parametrize("n", [1, 4, 60])
def test_plain_names_go_whatever_their_size(name, n):
    box = f"<div id={name}>{f'<p>{LONG} I like it.</p>' * n}</div>"
    assert html_text.main_text(f"<article><p>{LONG}</p></article>{box}") == LONG
    assert html_text.main_text(f"<article><p>{LONG}</p>{box}</article>") == LONG
    assert html_text.main_text(f"<div><p>{LONG}</p></div>{box}") == LONG


def test_a_form_around_the_page_isnt_lost():
    story = f"<p>{LONG}</p>" * 40
    want = " ".join([LONG] * 40)
    assert html_text.main_text(f"<form id=all>{story}</form>") == want
    assert html_text.main_text(f"<form><div>{story}</div><input><button>Go</button></form><div class=comments>{story * 3}</div>") == want
    assert want in html_text.main_text(f"<form>{story}</form><p>Copyright 2020 Example Ltd.</p>")
    assert html_text.main_text(f"<article>{story}<form><p>Your name, please.</p></form></article>") == want


def test_a_sidebar_that_holds_the_main_part_is_layout():
    assert html_text.main_text(f"<div class=content-sidebar><main><h1>Head</h1><p>{LONG}</p></main></div>") == f"Head {LONG}"


def test_linked_articles_and_nested_drawings():
    assert html_text.main_text(f"<article><p><a href=x>{LONG}</a></p></article>") == LONG
    assert html_text.main_text(f"<article><svg><svg><text>a</text></svg><text>leak</text></svg><p>{LONG}</p></article>") == LONG
    assert html_text.main_text(f"<article><svg><svg/><text>a</text></svg><p>{LONG}</p></article>") == LONG


@pytest.mark.parametrize("make", [
    lambda n: "<div>" * n + LONG,
    lambda n: "".join(f"<div>{k}, " for k in range(n)) + LONG,
    lambda n: f"<p>{LONG}" + "<i>" * n + "</b>" * n + "x",
    lambda n: f"<article><p>{LONG}</p>" + "<section class=widget>a" * n,
    lambda n: "<ul><li>" * n + LONG,
])
def test_depth_costs_no_square(make):
    def spent(n):
        start = time.process_time()
        html_text.main_text(make(n))
        return time.process_time() - start

    tracemalloc.start()
    html_text.main_text(make(8_000))
    assert tracemalloc.get_traced_memory()[1] < 40e6
    tracemalloc.stop()
    assert spent(32_000) < 10 * spent(8_000) + 1

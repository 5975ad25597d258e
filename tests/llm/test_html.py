"""Extraction of the main text: the given layout, other layouts, broken markup, and the scan against brute force."""

import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from twinlake.llm import html_extract as hx

from ..conftest import SF_SMALL

PROSE = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore"
OTHER = "vestibulum ante primis in faucibus orci luctus et ultrices posuere cubilia curae"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF_SMALL}/pages.parquet")


@pytest.fixture(scope="module")
def weights(pages):
    return hx.fit(pages)


def text_of(page, w):
    p = hx.parse(page)
    return hx.region_text(page, p, *hx.widened(p, *hx.best_region(p, w)[:2]))


def article(page):
    """What the markup of the given pages calls the article."""
    inner = re.search(r"<article>(.*)</article>", page, re.DOTALL).group(1).replace("<br>", " ")
    blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark, pages, weights):
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    rows = hx.op13(spark, SF_SMALL).collect()
    assert {r["page_id"]: r["text"] for r in rows} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    # the scan alone, without widening, agrees too
    for r in pages.collect():
        p = hx.parse(r["html"])
        assert hx.region_text(r["html"], p, *hx.best_region(p, weights)[:2]) == want[r["page_id"]]


def test_same_pages_without_the_label(pages, weights):
    """The weights, not the article tag, find the content."""
    for r in pages.collect():
        bare = r["html"].replace("<article>", "<section>").replace("</article>", "</section>")
        assert text_of(bare, weights) == article(r["html"])


LAYOUTS = [
    (f'<body class="has-sidebar"><header><h1>My Site</h1></header><div id="content"><h2>Head line</h2><p>{PROSE}.</p><p>{PROSE} <a href=x>link</a> more.'
     f'<div class=ad>buy it now</div><p>{PROSE}</div><div class="sidebar"><p>{OTHER}</p></div><div id="comments"><p>{OTHER}</p><p>{OTHER}</p></div></body>',
     f"Head line\n{PROSE}.\n{PROSE} link more.\n{PROSE}"),
    (f'<article><header><h1>Title here</h1></header><aside>{OTHER}</aside><p>{PROSE}</p><ul><li>one</li><li>two</ul><form><p>{OTHER}</p></form>'
     f'<section class="comments"><article class="comment"><p>{OTHER}</p></article></section><footer>{OTHER}</footer></article>', f"Title here\n{PROSE}\none\ntwo"),
    (f'<nav><a href=1>x y</a><a>z</a><h1>T &lt;b&gt; &#x41;&nbsp;&eacute;</h1><p>{PROSE}<script>var a="<p>";</script><p>a < b and c > d</p>'
     f'<div class="cookie-notice">{OTHER}</div>', f"T <b> A é\n{PROSE}\na < b and c > d"),
    (f'<div role=main><p>{PROSE}</div><div class="newsletter-signup"><p>{OTHER}</p></div>', PROSE),
    (f'<table><tr><td><a href=1>a</a><br><a href=2>b</a></td><td><h1>T</h1>{PROSE}<br>{PROSE}<td><a>x</a></table>', f"T\n{PROSE} {PROSE}"),
    (f"<main><article><h1>A</h1><p>{PROSE}</p></article><article class='related'><p>{OTHER}</p></article></main>", f"A\n{PROSE}"),
    (f"<p>{PROSE[:20]}<b>{PROSE[20:]}</b>\n\t x</p>", f"{PROSE} x"),
    ("plain text only", "plain text only"), ("", ""), ("<p></p>", ""), ("<!-- never closed <p>abc", ""), ("<p>abc <script> x", "abc"), (" \n ", ""),
    (f"<nav><a>{OTHER}</a></nav><footer>{OTHER}</footer>", ""),
]


@pytest.mark.parametrize("page,want", LAYOUTS)
def test_layouts(weights, page, want):
    assert text_of(page, weights) == want


def test_scan_equals_brute_force():
    rng = random.Random(6)
    w = hx.Weights({("p", False): 1.0, ("", False): 0.25}, {"p": 0.5, "div": 1.0}, 1.5)
    for _ in range(200):
        page = hx.Page()
        for k in range(rng.randint(0, 14)):
            if rng.random() < 0.5:
                page.runs.append((k, k + 1, rng.randint(1, 4), (rng.choice(["p", ""]), False), 0, k, rng.random() < 0.2, False))
                page.items.append((len(page.runs) - 1, False))
            else:
                page.items.append((rng.choice(["p", "div", ""]), False))
        score = [0.0 if isinstance(i, int) and page.runs[i][6] else page.runs[i][2] * w.word(page.runs[i][3]) if isinstance(i, int) else -w.cost(i) for i, _ in page.items]
        best = max([0.0, *(sum(score[a:b]) for a in range(len(score)) for b in range(a + 1, len(score) + 1))])
        first, last, found = hx.best_region(page, w)
        assert found == pytest.approx(best)
        if last >= first:
            at = {i: k for k, (i, _) in enumerate(page.items) if isinstance(i, int)}
            assert sum(score[at[first]: at[last] + 1]) == pytest.approx(best)


@pytest.mark.parametrize("unit,times", [("<div>", 40_000), ("<li>", 40_000), ('<a "', 40_000), ("<", 100_000), ("</div>", 40_000), ("<nav>", 30_000), ("<span class=ad>", 20_000),
                                        ("<!--", 40_000), ("&", 100_000), ("<ul><li><nav><span>", 10_000), ("<a b='", 40_000), ("word ", 200_000)])
def test_time_grows_with_the_page(weights, unit, times):
    begin = time.perf_counter()
    text_of(unit * times, weights)
    assert time.perf_counter() - begin < 5


def test_awkward_tables(spark, weights):
    rows = [(None, None, None), (1, "u", None), (1, "u", ""), (2, None, f"<p>{PROSE}</p>"), (2, None, f"<p>{PROSE}</p>"), (3, "v", f"<article>{'word ' * 100_000}</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    clash = df.select("*", *[F.lit(1).alias(c) for c in ("text", "start", "score", "row", "c0")])
    got = sorted(((r["page_id"] or 0, r["text"], r["n_blocks"], r["start"]) for r in hx.extract(clash, weights).collect()), key=repr)
    long = ("word " * 100_000).strip()
    assert got == sorted([(0, "", 0, None), (1, "", 0, None), (1, "", 0, None), (2, PROSE, 1, 3), (2, PROSE, 1, 3), (3, long, 1, 9)], key=repr)
    none = hx.extract(df.limit(0))
    assert none.collect() == [] and none.columns == ["page_id", "url", "text", "n_blocks", "start", "end", "score"]


def test_without_labelled_pages_the_published_weights_hold(spark):
    w = hx.fit(spark.createDataFrame([(f"<p>{PROSE}</p>",)], "html string"))
    assert not w.words and w.word(("p", False)) == 1.0 and w.cost("p") == 3.25

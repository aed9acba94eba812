"""Main text of hand-made pages, and of the given ones against their construction."""

import html as entities
import math
import random
import re
import statistics
import time

import pytest

from tagtrack.llm import webpages as W

SF = "/root/testdata/sf0.001"
LONG = "This is a long enough paragraph of the article, with several clauses, and it goes on for a while."
PAGES = {
    "plain": (f"<html><head><title>T</title></head><body><article><h1>Head</h1><p>{LONG}</p><p>Short.</p></article></body></html>", f"Head\n\n{LONG}\n\nShort."),
    "furniture": (
        f"<body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav><div class='cookie-notice'><p>We use cookies {LONG}</div>"
        f"<article><h1>Head</h1><p>{LONG}</p><div class=ad>Buy {LONG}</div><form><label>Mail<input></label></form><p>End &amp; out.</p>"
        f"<section id=comments><p>Me too. {LONG}</p></section></article><aside><p>Side {LONG}</p></aside><footer>&copy; me</footer></body>",
        f"Head\n\n{LONG}\n\nEnd & out.",
    ),
    "open tags": (f"<body><article><h1>A<p><b>One<br>two<p>{LONG}<p>Last</article><footer>x", f"A\n\nOne two\n\n{LONG}\n\nLast"),
    "entities": (f"<article><p>a&nbsp;&lt;b&gt; &#233;&#x1F600; {LONG}\n\t x </p></article>", f"a <b> é\U0001F600 {LONG} x"),
    "no article": (f"<body><div class=menu><a href=a>a</a></div><div><p>{LONG}</p><p>{LONG}</p></div><ul><li><a href=1>next page of things to see</a></ul></body>", f"{LONG}\n\n{LONG}"),
    "inline furniture": (f"<article><p>{LONG} Before <span class=share>Share it</span> after <b>all</b>.</p></article>", f"{LONG} Before after all."),
    "scripts": (f"<article><script>if (a<b) document.write('<p>no</p>')</script><style>p{{}}</style><p>{LONG}</p><!-- no --></article>", LONG),
    "header in article": (f"<article><header><h1>Title</h1></header><p>{LONG}</p></article>", f"Title\n\n{LONG}"),
    "loose class": (f"<body><main class='page with-sidebar'><p>{LONG}</p></main><div class='sidebar'>x {LONG}</div>", LONG),
    "bare text": ("just text", "just text"),
    "table": (f"<article><p>{LONG}</p><table><tr><td>one</td><td>two</td></tr></table></article>", f"{LONG}\n\none\n\ntwo"),
    "open head": (f"<html><head><title>T<body><article><p>{LONG}</article>", ""),
    "open nav": (f"<body><nav><a href=x>x</a><article><p>{LONG}</p></article>", LONG),
    "empty": ("", ""),
    "null": (None, ""),
    "only markup": ("<html><body><article></article></body></html>", ""),
    "cut": (f"<article><p>{LONG}</p><p>And &amp", f"{LONG}\n\nAnd &"),
}


@pytest.mark.parametrize("name", sorted(set(PAGES) - {"open head"}))
def test_page(name):
    page, want = PAGES[name]
    assert W.main_text(page) == want


KEPT = {
    "class of a post": f"<body><nav>x</nav><article class='post category-social'><p>{LONG}</p></article><footer>f</footer>",
    "comments open": f"<body><nav>x</nav><div class='post comments-open'><p>{LONG}</p></div>",
    "notice of meeting": f"<body><div id='notice-of-meeting'><p>{LONG}</p></div><div class=ad>a</div>",
    "search engine": f"<body><div class='research search-engine-history'><p>{LONG}</p></div>",
    "page in a form": f"<body><form runat=server><div class=menu>m</div><div><p>{LONG}</p></div></form>",
    "marked section": f"<body><article><![foo[x]]><p>{LONG}</p></article>",
    "all in one": f"<body><div class=notice><p>{LONG}</p></div>",
    "open quote": f"<body><article><a href=\"x>link</a><p>{LONG}</p></article>",
    "open comment": f"<body><article><p>{LONG}</p><!-- never ends",
}


@pytest.mark.parametrize("name", KEPT)
def test_declarations_do_not_empty_a_page(name):
    got = W.main_text(KEPT[name])
    assert LONG in got and "menu" not in got and got.replace(LONG, "").strip() in ("", "link")


def test_title_in_a_header_of_the_article():
    assert W.main_text(f"<body><div class='article-header'><h1>Title of it</h1></div><div><p>{LONG}</p></div>") == f"Title of it\n\n{LONG}"


@pytest.mark.parametrize("name", ["comments", "reader-comments", "comment-list", "sidebar-left", "ad-banner"])
def test_long_furniture_beside_an_article_goes(name):
    page = f"<body><article><h1>H</h1><p>{LONG}</p><div class='{name}'>" + f"<p>{LONG} x</p>" * 5 + "</div></article>"
    assert W.main_text(page) == f"H\n\n{LONG}"


@pytest.mark.parametrize("soup", ["<b>x</i>", '<a href="', "<p><div><b><hr>", "<!x", "<![foo[", "<article><b>x</i>", "</nav><nav>", "<li><b>", "<"])
def test_work_is_linear(soup):
    page = soup * (1_000_000 // len(soup))
    start = time.monotonic()
    W.main_text(page)
    assert time.monotonic() - start < 20  # some 2 s each alone


def plain_kept(lines):
    """The method once more, line by line: ratios, Gaussian, threshold, regions."""
    ratios = [len(t) / max(n, 1) for t, n, *_ in lines]
    smooth = []
    for i in range(len(ratios)):
        near = [(math.exp(-((j - i) ** 2) / 2), ratios[j]) for j in range(len(ratios)) if abs(j - i) <= 3]
        smooth.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
    cut = max(1.0, statistics.fmean(smooth) - statistics.pstdev(smooth) / 2)
    dense = [i for i, x in enumerate(smooth) if x >= cut - 1e-9] or list(range(len(lines)))
    regions = {lines[i][3] for i in dense if lines[i][3] >= 0}
    if regions:
        return [t for t, _, _, r in lines if r in regions]
    return [t for t, _, a, *_ in lines[min(dense) : max(dense) + 1] if 2 * a <= len(t)]


def test_against_plain_method():
    rng = random.Random(3)
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            words = " ".join("w" * rng.randrange(1, 9) for _ in range(rng.choice([1, 4, 30])))
            parts.append(rng.choice([f"<p>{words}</p>", f"<div><a href=x>{words}</a></div>", f"<article><p>{words}</p></article>", f"<p><b>{words}</b> <i>x</i></p>"]))
        page = "<body>" + "".join(parts)
        lines = [line[:4] for line in W.read_lines(page).lines]
        assert W.main_text(page) == "\n\n".join(plain_kept(lines))


def test_smoothing_keeps_constants():
    assert W.smoothed([3.0] * 9) == pytest.approx([3.0] * 9)
    assert W.smoothed([]) == []


def test_given_pages(spark):
    got = W.extracted(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    raw = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(got) == len(raw)
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", raw[r.page_id], re.S)[1]
        blocks = re.split(r"</?(?:h1|p)>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
        want = [re.sub(r"\s+", " ", entities.unescape(b)).strip() for b in blocks]
        assert r.text == "\n\n".join(b for b in want if b)


def test_frame(spark):
    rows = [(1, None, "u", "old"), (None, PAGES["plain"][0], None, None), (1, None, "u", "old"), (2, "<p>" + "word " * 100_000, "u", "old")]
    df = spark.createDataFrame(rows, "page_id long, html string, _html string, text string")
    got = W.extracted(df)
    assert got.columns == ["page_id", "_html", "text"]
    texts = {(r.page_id, len(r.text)) for r in got.collect()}
    assert texts == {(1, 0), (None, len(PAGES["plain"][1])), (2, 499_999)} and got.count() == 4
    assert W.extracted(df.limit(0)).count() == 0

"""Wrapper induction: pages without marks, misleading names, malformed and very deep pages, several layouts of a host."""

import random
import time

import pytest
from corpusloom.llm import wrappers


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    return {r["page_id"]: r["text"] for r in wrappers.extracted(df).collect()}


@pytest.mark.parametrize("name", ["content has-sidebar", "page-with-widget", "post notice-board", "related-work", "search-results", "content no-sidebar", "post alert-free", "reply-to-critics", "sidebar"])
def test_no_name_empties_a_page(name):
    page = wrappers.Page(f"<body><nav>menu</nav><div class='{name}'><h2>Head</h2><p>{'The text of the article. ' * 9}</p></div><div class='ad-slot'>buy</div><div class='comment-list'>first!</div></body>")
    assert [t for _, t in page.blocks] == ["Head", ("The text of the article. " * 9).strip()]


_TEXT = "The text of the article. " * 9
_WHOLE = [
    "<body><form id='aspnetForm'><div><h1>Head</h1><p>{0}</p></div></form></body>",
    "<body><form id='aspnetForm'><article><h1>Head</h1><p>{0}</p></article><form><p>Name</p></form></form></body>",
    "<body class='single comments'><article><h1>Head</h1><p>{0}</p></article></body>",
    "<html class='reply'><body id='comments'><h1>Head</h1><p>{0}</p></body></html>",
    "<body><article><h1>Head</h1><div class='profit-share'><p>{0}</p></div></article></body>",
    "<body><article><h1>Head</h1><section id='lunch-menu'><p>{0}</p></section></article></body>",
    "<body><article><h1>Head</h1><section class='product-banner'><p>{0}</p></section><div class='ad-slot'>buy</div><div class='share-buttons'>share</div></article></body>",
    "<body><p>Menu</p><form><p>Name</p><input></form><h1>Head</h1><p>{0}</p></body>",
]


@pytest.mark.parametrize("page", _WHOLE)
def test_forms_bodies_and_ends_of_names_cut_nothing(page):
    assert [t for _, t in wrappers.Page(page.format(_TEXT)).blocks if t != "Menu"] == ["Head", _TEXT.strip()]


def test_forms_bodies_and_ends_of_names_on_a_host(spark):
    """The same pages as a host's, each with its own words: alignment takes what is constant, whatever its name."""
    rows, want = [], {}
    for k, page in enumerate(_WHOLE):
        for i in range(5):
            own = f"Own text {k} {i}. " * 9
            rows.append((10 * k + i, f"http://h{k}.com/{i}", page.replace("<h1>Head", f"<h1>Head {i}").format(own) + "<div class='profit-share'>constant</div>"))
            want[10 * k + i] = f"Head {i}\n{own.strip()}"
    assert extracted(spark, rows) == want


def test_alignment_decides_without_names(spark):
    """The given pages without class, id and role, and without tags that say what they hold: what alignment finds of the boilerplate, against the result with them."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    bare = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", r"(?i)\s(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", ""), r"(?i)(</?)(?:nav|footer|aside|header|article|main|form|menu)\b", "$1div"))
    named = {r["page_id"]: r["text"] for r in wrappers.extracted(pages).collect()}
    blind = {r["page_id"]: r["text"] for r in wrappers.extracted(bare).collect()}
    whole = {r["page_id"]: "\n".join(t for _, t in wrappers.Page(r["html"] or "").blocks) for r in bare.collect()}
    count = lambda texts: sum(len([x for x in t.split("\n") if x]) for t in texts)
    kept = both = 0
    for i, t in named.items():
        a, b = t.split("\n") if t else [], blind[i].split("\n") if blind[i] else []
        kept += len(b)
        both += sum(min(a.count(x), b.count(x)) for x in set(a))
    recall, precision, gone = both / count(named.values()), both / kept, (count(whole.values()) - kept) / (count(whole.values()) - count(named.values()))
    print(f"boilerplate blocks found by alignment alone {gone:.3f}, article blocks kept {recall:.3f}, share of article in what is kept {precision:.3f}")
    assert recall > 0.9


def test_names_of_boilerplate():
    out = "main-nav,site-footer,cookie-banner,ad-300x250,share-buttons,related-posts,newsletter-signup,sidebarLeft,socialLinks".split(",")
    assert all(wrappers.called([w.lower() for w in wrappers._PARTS.findall(x)], wrappers._OUT_NAMES) for x in out)


def test_induction_decides_without_marks(spark):
    a = "<body><div id='top'><p>Our site</p></div><div id='post-{0}'><p>Own words {0} here</p><p>More of {0}</p></div><div><p>Read also</p></div></body>"
    b = "<body><table><tr><td>Other frame</td><td>Cell {0}</td></tr></table><ul><li>Frame end</li></ul></body>"
    rows = [(i, "http://a.com/x", a.format(i)) for i in range(8)] + [(20 + i, "http://a.com/y", b.format(i)) for i in range(6)] + [(40, "http://a.com/", None), (41, "http://a.com/z", "")]
    got = extracted(spark, rows)
    assert all(got[i] == f"Own words {i} here\nMore of {i}" for i in range(8))
    assert all(got[20 + i] == f"Cell {i}" for i in range(6)) and got[40] == got[41] == ""


def test_deep_and_malformed_pages(spark):
    rows = [(i, "http://d.com/", f"<p>Same line</p>{'<div>' * 5000}own {i}{'</div>' * 5000}") for i in range(5)]
    rows += [(10, "http://e.com/", '<a x="y ' * 60000), (11, "http://e.com/", '<a " > " ' * 60000 + "'"), (12, "http://e.com/", "<![CDATA[>" * 60000), (13, "http://e.com/", "<div>" * 60000 + "</q1>" * 60000 + "end")]
    rows += [(14, "http://e.com/", "".join(f"<div class='k{'ab'[i % 2]}'>x{i}</div>" for i in range(20000)))]
    start = time.time()
    got = extracted(spark, rows)
    assert time.time() - start < 120
    assert all(got[i] == f"own {i}" for i in range(5)) and got[13] == "end" and got[14].startswith("x0\nx1\nx2")


def brute(a, b):
    """Nodes in a largest matching that keeps parents and order."""
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute(x, y))
    return 1 + best[-1][-1]


def test_matching_is_largest():
    draw = random.Random(2)
    tree = lambda d: [draw.choice("ab"), [tree(d - 1) for _ in range(draw.randint(0, 3))] if d else []]
    for _ in range(300):
        a, b = ["r", [tree(3), tree(3)]], ["r", [tree(3), tree(2)]]
        got = wrappers.match(a, b)
        (x, below), (y, _) = wrappers._flat(a), wrappers._flat(b)
        assert len(got) == brute(a, b) and all(x[i] == y[j] for i, j in got.items()) and len(set(got.values())) == len(got)
        parent = {c: p for p, own in enumerate(below) for c in own}
        assert all(parent[i] in got for i in got if i)

import random

import duckdb
import pytest
from layerscan.llm import pages, urls
from layerscan.llm.html import DROPPED, MAIN, OTHER, blocks, common_lines

SCHEMA = "page_id long, url string, html string, host int, mark string, text string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "m", "t") for r in rows], SCHEMA).repartition(3)


def test_blocks_by_markup():
    page = (
        '<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>'
        '<header>Top<nav>menu</nav></header><div class="cookie-notice">cookies</div><aside>side</aside><!-- <p>no</p> -->'
        "<article><header><h1>T &amp; U</h1></header><p>a <b>b</b>\n c<br>d<p>e &lt;x&gt; &eacute;&#8364; 3 < 4</p>"
        '<div id="comments"><article class="comment"><p>reader</p></article></div><form>f <input> g</form>'
        '<ul><li>i</li><li>j</li></ul></article><div style="display: none">hidden</div><footer>foot</footer>'
    )
    found = blocks(page)
    assert [t for t, k in found if k == MAIN] == ["T & U", "a b c d", "e <x> é€ 3 < 4", "i", "j"]
    assert not [t for t, k in found if k == OTHER]
    assert [t for t, k in found if k == DROPPED] == ["Top", "menu", "cookies", "side", "reader", "f g", "hidden", "foot"]


@pytest.mark.parametrize("page", ["", "   ", "<", "<p", "plain", "<nav>x<article>y", "<script>x", "<article><p>a</article></article>b", "&amp", "<!-- x"])
def test_broken_pages(page):
    assert all(t.strip() for t, _ in blocks(page))
    assert ("y", MAIN) in blocks("<nav>x<article>y")
    assert blocks("<p>a &nbsp; b") == [("a b", OTHER)]


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_lines_are_longest(monkeypatch):
    rnd = random.Random(1)
    for _ in range(400):
        a, b = ([rnd.randint(0, 4) for _ in range(rnd.randint(0, 15))] for _ in range(2))
        places = common_lines(a, b)
        rest = iter(b)
        assert len(places) == longest(a, b) and all(a[i] in rest for i in places)


def plain(lines):
    return "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>"


def test_differencing_of_the_nearest_page(spark):
    site, shop = ["Site name", "Read more", "All rights reserved"], ["Shop", "Basket"]
    rows = [
        (1, "http://a.b/news/1", plain([site[0], "first story", site[1], "its end", site[2]])),
        (2, "http://a.b/news/2", plain([site[0], "second story", site[1], site[2]])),
        (3, "http://a.b/shop/1", plain([*shop, "a chair"])),
        (4, "http://a.b/shop/2", plain([*shop, "a table"])),
        (5, "http://lonely.b/", plain([site[0], "alone"])),
        (6, "http://copy.b/1", plain(["copied", "page"])),
        (7, "http://copy.b/2", plain(["copied", "page"])),
    ]
    texts = {r.page_id: r.text for r in pages.page_report(frame(spark, rows)).collect()}
    assert texts == {
        1: "first story\n\nits end", 2: "second story", 3: "a chair", 4: "a table", 5: "Site name\n\nalone",
        6: "copied\n\npage", 7: "copied\n\npage",
    }


def test_articles_of_copies_stay(spark):
    page = "<nav>n</nav><article><h1>h</h1><p>same</p></article><footer>f</footer>"
    rows = [(i, f"http://a.b/{i}", page) for i in range(20)] + [(None, None, page), (30, "no scheme", None), (31, "http://a.b/x", "")]
    rows += [(40, "http://a.b/40", page)] * 3
    got = pages.page_report(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all((r.text, r.n_chars) == (("h\n\nsame", 7) if r.page_id not in (30, 31) else ("", 0)) for r in got)
    assert pages.page_report(frame(spark, [])).collect() == []


def test_differencing_decides_on_pages_with_articles(spark):
    """Lines outside an article go where the nearest page has them; an article stays, though copied."""
    page = lambda own, text: f"<div>Site</div><article><p>{text}</p></article><div>{own}</div><div>All rights</div><footer>f</footer>"
    rows = [(i, f"http://a.b/news/{i}", page(f"own {i}", text)) for i, text in ((1, "same"), (2, "same"), (3, "third"))]
    rows += [(4, "http://c.d/x1", plain(["Site", "one"])), (5, "http://c.d/x1", plain(["Site", "one"])), (6, "http://c.d/x2", plain(["Site", "two"]))]
    pages_ = frame(spark, rows)
    texts = {r.page_id: r.text for r in pages.page_report(pages_).collect()}
    assert texts == {1: "same\n\nown 1", 2: "same\n\nown 2", 3: "third\n\nown 3", 4: "Site\n\none", 5: "one", 6: "two"}
    assert {r.page_id for r in pages.shared_lines(pages_).collect()} == {1, 2, 3, 5, 6}


def linked(*links):
    return "<html><head>" + "".join(links) + "</head>"


CASES = [
    (1, "http://a.example.net/x", None),
    (2, "http://a.example.com/plain", linked('<link rel="canonical" href="https://a.example.net/x">')),
    (3, "http://b.example.com/r", linked('<meta http-equiv="refresh" content="0; url=http://a.example.com/plain">')),
    (4, "http://c.example.org/fr/1", linked("<LINK HREF='http://a.example.net/x?q=1&amp;r' REL='canonical'>")),
    (5, "http://c.example.org/es/1", linked('<link rel="canonical" href="http://c.example.org/fr/1">')),
    (6, "http://d.example.org/es/2", linked('<link rel="stylesheet" href="http://a.example.net/x">')),
    (7, None, linked('<link rel="canonical" href="http://a.example.net/x">')),
    (8, "no scheme", "x"),
    (9, "HTTP://A.Example.NET/en/?q", None),
    (10, "https://example.net", None),
    (11, "https://xnet/", None),
    (12, "http://sub.example.com/de/1#f", None),
    (13, "http://q.example.com?x=/de/", None),
    (None, "http://b.example.com/r", None),
    (3, "http://b.example.com/r", None),
]


def test_rules_and_aliases(spark):
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(frame(spark, CASES)).collect()}
    assert got == {
        1: ("net/", "block"), 2: (None, "block"), 3: (None, "block"), 4: ("org/fr/", "allow"), 5: (None, "block"),
        6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: ("example.net/en/", "allow"), 10: (None, "allow"),
        11: (None, "allow"), 12: ("example.com/de/", "block"), 13: (None, "allow"), None: (None, "block"),
    }
    assert urls.judge_urls(frame(spark, [])).collect() == []


def test_relative_targets(spark):
    rows = [
        (1, "http://a.org/d/p", linked('<link rel=canonical href="/top">')),
        (2, "http://b.org/d/p", linked('<link rel=canonical href="q">')),
        (3, "https://c.org", linked('<link rel=canonical href="//other.net/z">')),
    ]
    found = {tuple(r) for r in urls.alias_edges(frame(spark, rows)).collect()}
    assert found == {("a.org/d/p", "a.org/top"), ("b.org/d/p", "b.org/d/q"), ("c.org", "other.net/z")}


def test_aliases_against_sql(spark):
    rnd = random.Random(3)
    hosts = ["a.example.net", "b.example.com", "c.example.org", "d.org", "e.com"]
    page = lambda: f"http://{rnd.choice(hosts)}/{rnd.choice(['en', 'de', 'fr', ''])}/{rnd.randint(0, 9)}"
    rows = [(i, page(), linked(f'<link rel="canonical" href="{page()}">') if i % 3 == 0 else None) for i in range(150)]
    got = sorted(map(tuple, urls.judge_urls(frame(spark, rows)).collect()))
    with duckdb.connect() as db:
        db.execute("create table pages (page_id bigint, url varchar, html varchar)")
        db.executemany("insert into pages values (?, ?, ?)", rows)
        assert got == sorted(db.execute(urls.ORACLE).fetchall())


def test_tags_over_several_lines_against_sql(spark):
    target = "http://a.example.net/x"
    rows = [
        (1, "http://a.example.com/1", linked(f'<link\n  href="{target}"\n  rel="canonical"\n>')),
        (2, "http://a.example.com/2", linked(f'<meta\r\n content="0; url={target}"\r\n http-equiv="refresh">')),
        (3, "http://a.example.com/3", linked(f'<link\n rel="stylesheet"\n href="{target}">')),
    ]
    got = sorted(map(tuple, urls.judge_urls(frame(spark, rows)).collect()))
    assert [r[4] for r in got] == ["block", "block", "allow"]
    with duckdb.connect() as db:
        db.execute("create table pages (page_id bigint, url varchar, html varchar)")
        db.executemany("insert into pages values (?, ?, ?)", rows)
        assert got == sorted(db.execute(urls.ORACLE).fetchall())


def test_more_edges_and_rules(spark):
    pages_ = frame(spark, CASES)
    edges = spark.createDataFrame([("e.com/1", "a.example.net/x"), ("e.com/1", None)], "a string, b string")
    more = frame(spark, [(1, "http://e.com/1", None)])
    assert urls.judge_urls(more, edges=edges).first().verdict == "block"
    assert urls.judge_urls(pages_, rules=()).where("verdict = 'block'").count() == 0
    with pytest.raises(ValueError):
        urls.judge_urls(pages_, rules=[("block", f"h{i}/") for i in range(urls.MOST_RULES + 1)])

import datetime as dt

import pytest

from lakewatch.sources import selectors

PAGE = """<!doctype html><html><body><nav><a class="t" href="/no">menu</a></nav>
<ul id="main" class="list big"><li class="row first"><h3>One <b>bold</b> &amp; more</h3><a href="a/1" rel="x">go</a><li class="row"><h3>Two</h3> <a href="javascript:void(0)">bad</a>
<li class=row><div><h3>Three<script>var h = "<h3>";</script></h3><p>unclosed <a data-k="v" href="https://other.org/3">deep</a></div></li><li class="row"><h3></h3><a href="/4">no title</a></li>
<li class="row"><h3>Five</h3></li></ul><img src="x"><table><tr class="row"><td>T1<td><a href="?q=1">l</a><tr class="row"><td>T2<td><a href="//cdn.org/2">l</a></table></body>"""
BASE = "https://site.org/dir/page.html"


def test_items_of_a_listing():
    want = [("Onebold& more", "https://site.org/dir/a/1"), ("Three", "https://other.org/3")]
    for item in ("li.row", "ul li", "#main > li", "ul.list.big > li.row", "body li[class]", "li[class~=row], ol"):
        assert selectors.listed(PAGE, item, "h3", "a@href", BASE) == want, item
    assert selectors.listed(PAGE, "tr", "td", "td a@href", BASE) == [("T1", "https://site.org/dir/page.html?q=1"), ("T2", "https://cdn.org/2")]
    assert selectors.listed(PAGE, "li", "h3", "a[data-k=v]@href", BASE) == want[1:]
    assert selectors.listed(PAGE, "li", "h3", "a[href^='https:'][href$='3']@href", BASE) == want[1:]
    assert selectors.listed(PAGE, "li.row.first", "h3", "a", "https://x.org/") == [("Onebold& more", "https://x.org/go")]
    assert selectors.listed(PAGE, "div > h3", "h3", "a@href", BASE) == [] == selectors.listed("", "li", "a", "a@href", BASE)
    nested = "<div class=i><a href=/1>out</a><div class=i><a href=/2>in</a></div></div>"
    assert selectors.listed(nested, "div.i", "a", "a@href", BASE) == [("out", "https://site.org/1"), ("in", "https://site.org/2")]
    assert selectors.listed(nested, ".i .i", "a", "a@href", BASE) == [("in", "https://site.org/2")]
    assert selectors.listed("<div class=i><b>x</i></b><a href=/1>y</a></p></div><a href=/2>z</a>" * 2, ".i", "b", "a@href", BASE) == [("x", "https://site.org/1")] * 2


@pytest.mark.parametrize("selector", ["", "li >", "> li", "li:hover", "a + b", "a[", "li > > a", "li,"])
def test_other_forms_are_refused(selector):
    with pytest.raises(ValueError):
        selectors.compiled(selector)


def test_pages_without_good_selectors_are_quarantined(spark):
    at = dt.datetime(2024, 1, 1)
    pages = spark.createDataFrame([("s", at, BASE, PAGE), ("s", at, BASE, None), ("t", at, BASE, PAGE), ("u", at, BASE, PAGE), ("v", at, BASE, PAGE)], "source_id string, fetched_at timestamp, url string, html string")
    chosen = spark.createDataFrame([("s", "li.row", "h3", "a@href"), ("t", "li:hover", "h3", "a"), ("u", "li", None, "a")], "source_id string, item string, titulo string, link string")
    items, bad = selectors.selected_items(pages, chosen)
    assert sorted(r.titulo for r in items.collect()) == ["Onebold& more", "Three"]
    assert sorted(r.source_id for r in bad.collect()) == ["t", "u", "v"]

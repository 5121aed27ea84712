"""Items of listing pages by selectors: a page is read once as a stream of tags and text, with the stack of its open elements, and
selectors are matched when an element opens, over that stack; no tree is built.

A selector is a list of alternatives (`,`) of compounds joined by descendant (space) or child (`>`) steps; a compound is a tag or
`*` with `#id`, `.class`, `[attr]`, `[attr=value]` and `[attr^=value]`, `$=`, `*=`, `~=`. `selector@attr` takes an attribute.
"""

from __future__ import annotations

import functools
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewatch.session import ship_package
from lakewatch.sources.payloads import raw_item

# Elements without content, elements whose text is none, and the elements that end an open one of the same row.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset(("script", "style", "template"))
ENDS = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: Elements that an implied end doesn't reach beyond, by what opens.
WITHIN = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}

_PART = re.compile(r"""(?P<tag>[a-zA-Z][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~^$*]?=)\s*(?:"(?P<q>[^"]*)"|'(?P<s>[^']*)'|(?P<v>[^\]\s]*))\s*)?\]""")
_TESTS = {"=": str.__eq__, "^=": str.startswith, "$=": str.endswith, "*=": str.__contains__, "~=": lambda have, want: want in have.split()}


@functools.lru_cache(maxsize=4096)
def compiled(selector: str) -> tuple:
    """Alternatives, each a tuple of (is a child step, tag, tests of attributes) from the innermost compound outwards; ValueError
    if the selector is none of these forms."""
    out = []
    for alternative in selector.split(","):
        steps, child = [], False
        for word in re.sub(r"(\[[^\]]*\])|\s*>\s*", lambda m: m[1] or " > ", alternative.strip()).split():
            if word == ">":
                if child or not steps:
                    raise ValueError(selector)
                child = True
                continue
            tag, tests, at = "*", [], 0
            for m in _PART.finditer(word):
                if m.start() != at or (m["tag"] and at):
                    raise ValueError(selector)
                at = m.end()
                if m["tag"]:
                    tag = m["tag"].lower()
                elif m["id"]:
                    tests.append(("id", "=", m["id"]))
                elif m["cls"]:
                    tests.append(("class", "~=", m["cls"]))
                else:
                    tests.append((m["attr"].lower(), m["op"], next((x for x in (m["q"], m["s"], m["v"]) if x is not None), "")))
            if at != len(word):
                raise ValueError(selector)
            steps.append((child, tag, tuple(tests)))
            child = False
        if child or not steps:
            raise ValueError(selector)
        out.append(tuple(reversed(steps)))
    return tuple(out)


def _fits(element: tuple[str, dict], step: tuple) -> bool:
    tag, attrs = element
    return step[1] in ("*", tag) and all(a in attrs and (op is None or bool(want or op == "=") and _TESTS[op](attrs[a], want)) for a, op, want in step[2])


def matches(stack: list[tuple[str, dict]], selector: tuple) -> bool:
    """Whether the innermost open element matches; ancestors may lie outside the element that is searched."""

    def upward(steps: tuple, k: int, at: int) -> bool:
        if k == len(steps):
            return True
        places = [at - 1] if steps[k - 1][0] else range(at - 1, -1, -1)
        return any(p >= 0 and _fits(stack[p], steps[k]) and upward(steps, k + 1, p) for p in places)

    top = len(stack) - 1
    return any(_fits(stack[top], steps[0]) and upward(steps, 1, top) for steps in selector)


class _Found:
    """An item's element, and the first element in it for its title and its link: their text, or an attribute."""

    def __init__(self, depth: int):
        self.depth, self.open, self.value = depth, {}, {}


class Listing(HTMLParser):
    """Collects the (title, link) of every element that matches `item`, in the order in which they open."""

    def __init__(self, item: str, title: str, link: str):
        super().__init__(convert_charrefs=True)
        self.item, self.stack, self.active, self.found = compiled(item), [], [], []
        self.fields = {}
        for name, told in (("title", title), ("link", link)):
            selector, _, attr = told.rpartition("@") if name == "link" and "@" in told else (told, "", "")
            self.fields[name] = compiled(selector), attr.lower()

    def handle_starttag(self, tag, attrs):
        ends, stop = ENDS.get(tag, ()), WITHIN.get(tag, ("div", "table", "ul", "ol", "td"))
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in stop:
                break
            if self.stack[k][0] in ends:
                self._close(k)
        self.stack.append((tag, {k: v or "" for k, v in reversed(attrs)}))
        for own in self.active:
            for name, (selector, attr) in self.fields.items():
                if name not in own.value and matches(self.stack, selector):
                    own.value[name] = self.stack[-1][1].get(attr, "") if attr else ""
                    if not attr:
                        own.open[name] = len(self.stack)
        if matches(self.stack, self.item):
            self.active.append(_Found(len(self.stack)))
            self.found.append(self.active[-1])
        if tag in VOID:
            self._close(len(self.stack) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash closes void elements only, which are closed there

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                return self._close(k)

    def handle_data(self, data):
        text = data.strip()
        if text and not any(t in SILENT for t, _ in self.stack):
            for own in self.active:
                for name in own.open:
                    own.value[name] += text

    def _close(self, depth: int) -> None:
        del self.stack[depth:]
        self.active = [own for own in self.active if own.depth <= depth]
        for own in self.active:
            own.open = {n: d for n, d in own.open.items() if d <= depth}


def listed(html: str, item: str, title: str, link: str, base: str) -> list[tuple[str, str]]:
    """(title, absolute address) of the items that have both, with http and https addresses only."""
    page, out = Listing(item, title, link), []
    page.feed(html)
    page.close()
    for own in page.found:
        name, target = own.value.get("title", ""), own.value.get("link", "").strip()
        if name and target:
            try:
                url = urljoin(base, target)
            except ValueError:
                continue
            if url.lower().startswith(("https://", "http://")):
                out.append((name, url))
    return out


def selected_items(pages: DataFrame, selectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages(source_id, fetched_at, url, html) and selectors(source_id, item, titulo, link) -> (items, quarantine). A page without
    its source's three selectors, or with one that can't be read, is quarantined; a null page has no items."""
    ship_package(pages.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for source, fetched, url, html, *own in zip(*(b.column(c).to_pylist() for c in ("source_id", "fetched_at", "url", "html", "item", "titulo", "link"))):
                try:
                    if not all(own):
                        raise ValueError("selectors are missing")
                    rows += [(source, fetched, title, link, None) for title, link in listed(html or "", *own, url or "")]
                except ValueError:
                    rows.append((source, fetched, None, url, "validation_error"))
            c = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), b.schema.field("fetched_at").type, pa.string(), pa.string(), pa.string())
            yield pa.record_batch([pa.array(x, k) for x, k in zip(c, kinds)], names=["source_id", "fetched_at", "titulo", "url", "reason"])

    j = pages.select("source_id", "fetched_at", "url", "html").join(selectors.select("source_id", "item", "titulo", "link"), "source_id", "left")
    rows = j.mapInArrow(run, "source_id string, fetched_at timestamp, titulo string, url string, reason string")
    items = rows.where("reason IS NULL").select(*raw_item(F.col("source_id"), F.col("titulo"), F.col("url"), F.lit(""), F.lit(None).cast("timestamp"), F.col("fetched_at")))
    return items, rows.where("reason IS NOT NULL").select("source_id", "reason", F.col("url").alias("payload"))

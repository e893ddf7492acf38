"""Complaint pages as rows: a small tree of a page's elements, read in Arrow batches, since nested elements are beyond patterns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How the pages mark their parts.
MARK = "data-ga-element"
END_OF_TEXT, CRUMB, SUPPORT, ANSWER, BODY = "Complaint_Content_End", "Breadcrumb_Link", "Engagement_Card_Upvote", "Complaint_Answer_Brand", "selection-share"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "use", "wbr"}
#: Elements whose start ends an open paragraph.
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
WRITTEN = re.compile(r"\d{1,2}\s+\w+(?:\s+\d{4})?\s+\d{1,2}:\d{2}")


@dataclass
class Element:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    inner: list = field(default_factory=list)
    parent: Element | None = None

    def walk(self) -> Iterator[Element]:
        """All elements inside, in order of the page."""
        stack = [x for x in reversed(self.inner) if isinstance(x, Element)]
        while stack:
            e = stack.pop()
            yield e
            stack += [x for x in reversed(e.inner) if isinstance(x, Element)]

    def first(self, tag: str | None = None, **attrs: str) -> Element | None:
        return next((e for e in self.walk() if (tag is None or e.tag == tag) and all(e.attrs.get(k.replace("_", "-")) == v for k, v in attrs.items())), None)

    def text(self) -> str:
        """The text inside with blanks squeezed."""
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack += reversed(x.inner)
        return " ".join(" ".join(out).split())

    def before(self) -> list[Element]:
        """The elements beside this one that stand before it, the nearest first."""
        beside = [x for x in self.parent.inner if isinstance(x, Element)] if self.parent else []
        at = next((i for i, x in enumerate(beside) if x is self), 0)
        return beside[:at][::-1]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = Element("")
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
            return
        if tag in BLOCKS:
            at = self.open
            while at.parent and at.tag not in BLOCKS:
                at = at.parent
            if at.tag == "p":
                self.open = at.parent
        e = Element(tag, {k: v or "" for k, v in attrs}, parent=self.open)
        self.open.inner.append(e)
        if tag not in VOID:
            self.open = e

    def handle_startendtag(self, tag, attrs):
        self.open.inner.append(Element(tag, {k: v or "" for k, v in attrs}, parent=self.open))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
            return
        at = self.open
        while at.parent and at.tag != tag:
            at = at.parent
        if at.parent:
            self.open = at.parent

    def handle_data(self, data):
        if not self.hidden:
            self.open.inner.append(data)


def tree(page: str) -> Element:
    b = _Builder()
    b.feed(page)
    b.close()
    return b.root


def _date(text: str) -> str | None:
    found = WRITTEN.search(text)
    return found[0] if found else text or None


def detail(page: str | None) -> dict:
    """The fields of a page. Missing ones are None or empty, never zero. Without its marks the text is the article's paragraphs, or else the page's."""
    out: dict = {"title": None, "paragraphs": [], "date_raw": None, "view_count": None, "support_count": None, "crumbs": [], "replies": []}
    root = tree(page or "")
    head = root.first("h1") or root.first("title")
    if head:
        out["title"] = (head.first("span") or head).text() or None
    article = root.first("article")
    end = article and article.first(data_ga_element=END_OF_TEXT)
    body = next((e for e in end.before() if e.tag == "div" and BODY in e.attrs.get("class", "").split()), None) if end else None
    part = body or article or root
    inside = [e for e in part.walk() if e.tag == "p"]
    out["paragraphs"] = [t for e in inside if (t := e.text())] if inside or not body else [t for t in [body.text()] if t]
    header = next((e for e in body.before() if e.tag == "div"), None) if body else None
    if header:
        out["date_raw"] = _date(header.text())
        seen = next((e for e in header.walk() if e.tag == "use" and "ic-view" in " ".join(e.attrs.values())), None)
        while seen and seen.tag != "span":
            seen = seen.parent
        if seen and (count := seen.first("span")):
            out["view_count"] = count.text() or None
    button = article and article.first(data_ga_element=SUPPORT)
    if button and (number := re.search(r"\d+", button.text())):
        out["support_count"] = number[0]
    out["crumbs"] = [e.text() for e in root.walk() if e.tag == "a" and e.attrs.get(MARK) == CRUMB]
    messages = root.first(id="messages")
    for e in messages.walk() if messages else ():
        if e.tag == "div" and e.attrs.get("id", "").startswith("message-"):
            said = e.first("p")
            when = next((x for x in e.walk() if x.tag == "div" and "min-w-0" in x.attrs.get("class", "").split()), None)
            links = [x.attrs["href"] for x in e.walk() if x.tag == "a" and "href" in x.attrs]
            out["replies"].append({"reply_order": len(out["replies"]) + 1, "by_brand": e.first(data_ga_element=ANSWER) is not None, "links": links, "reply_date_raw": _date(when.text()) if when else None, "reply_text": said.text() if said else ""})
    return out


_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())
REPLY = T.StructType().add("reply_order", T.IntegerType()).add("by_brand", T.BooleanType()).add("links", _TEXTS).add("reply_date_raw", _TEXT).add("reply_text", _TEXT)
DETAIL = T.StructType().add("title", _TEXT).add("paragraphs", _TEXTS).add("date_raw", _TEXT).add("view_count", _TEXT).add("support_count", _TEXT).add("crumbs", _TEXTS).add("replies", T.ArrayType(REPLY))


@F.udtf(returnType="reply_order int, by_brand boolean, links array<string>, reply_date_raw string, reply_text string")
class PageReplies:
    """The replies of a page as a table function: each leaves as a row, so a page with very many is never one nested value."""

    def eval(self, page: str):
        for reply in detail(page)["replies"]:
            yield tuple(reply[c] for c in ("reply_order", "by_brand", "links", "reply_date_raw", "reply_text"))


@F.pandas_udf(DETAIL)
def page_detail(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([detail(p) for p in pages], columns=DETAIL.names)

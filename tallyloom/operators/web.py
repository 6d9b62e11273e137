"""Page text and search-result links from HTML: the two places where only a parser gives the right result."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import BLANK, trim

# Elements without visible text, the class of a result's link.
HIDDEN = ("script", "style", "noscript", "svg", "template")
RESULT_CLASS = "result__a"
_BLANK = re.compile(r"\s+")
_REFERENCE = re.compile(r"&(#[0-9]+|#[xX][0-9A-Fa-f]+|[0-9A-Za-z]+)(;?)")


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in HIDDEN

    def handle_endtag(self, tag):
        self.depth -= tag in HIDDEN and self.depth > 0

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.href, self.title, self.found = None, [], []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "a" and RESULT_CLASS in (given.get("class") or "").split():
            self.href, self.title = given.get("href") or "", []

    def handle_data(self, data):
        if self.href is not None:
            self.title.append(data)

    def handle_endtag(self, tag):
        if tag == "a" and self.href is not None:
            title = _BLANK.sub(" ", "".join(self.title)).strip()
            if self.href and title:
                self.found.append({"title": title, "url": self.href})
            self.href = None


def _closed_references(html: str) -> str:
    """HTML in which an ampersand stands for itself unless a whole reference, semicolon included, follows."""
    return _REFERENCE.sub(lambda m: m[0] if m[2] and (m[1][0] == "#" or f"{m[1]};" in html5) else f"&amp;{m[0][1:]}", html)


def visible(html: str | None, limit: int | None = None, open_references: bool = True) -> str | None:
    """Text outside hidden elements, white space collapsed, cut to ``limit`` if there is one; null if there is none.

    Character references count without their semicolon too, as in browsers (``&amp`` is ``&``), but not with ``open_references`` False.
    """
    parser = _Visible()
    parser.feed(html or "" if open_references else _closed_references(html or ""))
    parser.close()
    return _BLANK.sub(" ", " ".join(parser.parts)).strip()[:limit] or None


def links(html: str | None) -> list[dict]:
    """Titles and addresses of result links."""
    parser = _Links()
    parser.feed(html or "")
    parser.close()
    return parser.found


def visible_text(html: Column, limit: int | None = None, open_references: bool = True) -> Column:
    """Visible text of whole pages, a batch at a time; a reader that has room for a prompt only gives a ``limit``."""
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: visible(page, limit, open_references))

    return F.pandas_udf(read, "string")(html)


def page_text(content_type: Column, body: Column, limit: int | None = None, open_references: bool = True) -> Column:
    """struct(text, error) of a page: visible text of HTML, squeezed plain text; other types and pages without text are errors."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    plain = trim(F.regexp_replace(body, rf"(?U)[{BLANK}]+", " "))
    read = F.when(kind == "text/html", visible_text(body, limit, open_references)).when(kind == "text/plain", F.nullif(F.substring(plain, 1, limit) if limit else plain, F.lit("")))
    error = F.when(~kind.isin("text/html", "text/plain"), "unsupported_content_type").when(read.isNull(), "no_text")
    return F.struct(F.when(error.isNull(), read).alias("text"), error.alias("error"))


def result_links(html: Column) -> Column:
    """Titles and addresses of the result links of whole pages."""
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(links)

    return F.pandas_udf(read, "array<struct<title:string,url:string>>")(html)


def decode_event_stream(body: Column) -> Column:
    """The text of a streamed chat answer: contents of ``data:`` lines joined until ``[DONE]``; null if empty."""
    lines = F.transform(F.split(body, r"\r?\n"), lambda x: F.regexp_extract(x, r"^data:\s*(.*)$", 1))
    done = F.array_position(lines, "[DONE]")
    used = F.filter(F.when(done > 0, F.slice(lines, F.lit(1), done.cast("int") - 1)).otherwise(lines), lambda x: x != "")
    return F.nullif(F.array_join(F.transform(used, lambda x: F.coalesce(F.get_json_object(x, "$.choices[0].delta.content"), F.lit(""))), ""), F.lit(""))

"""HTML to Markdown with ATX headings, on the standard library's parser.

Our own rendering: headings, paragraphs, lists, links, emphasis, code, quotes and table
rows; scripts and styles are dropped with all they hold.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DROPPED = {"script", "style"}
_BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "nav", "aside", "table", "ul", "ol", "blockquote", "pre", "figure", "form", "body", "html", "head", "title", "dl", "dd", "dt", "tr", "hr"}
_MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}


class _Markdown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.line: list[str] = []
        self.dropped: list[str] = []
        self.lists: list[list] = []
        self.links: list[str | None] = []
        self.verbatim = 0
        self.prefix = ""
        self.cells = 0

    def end_line(self, blank: bool = False) -> None:
        text = "".join(self.line)
        text = text.rstrip() if self.verbatim else re.sub(r"[ \t\r\n\f]+", " ", text).strip()
        if text:
            self.lines.append(self.prefix + text)
        self.prefix, self.line = "", []
        if blank and self.lines and self.lines[-1]:
            self.lines.append("")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.dropped or tag in _DROPPED:
            if tag in _DROPPED:
                self.dropped.append(tag)
            return
        if re.fullmatch("h[1-6]", tag):
            self.end_line(blank=True)
            self.prefix = "#" * int(tag[1]) + " "
        elif tag in ("ul", "ol"):
            self.end_line(blank=not self.lists)
            self.lists.append([tag, 0])
        elif tag == "li":
            self.end_line()
            depth = max(len(self.lists) - 1, 0)
            if self.lists:
                self.lists[-1][1] += 1
            mark = f"{self.lists[-1][1]}. " if self.lists and self.lists[-1][0] == "ol" else "* "
            self.prefix = "  " * depth + mark
        elif tag == "br":
            self.end_line()
        elif tag in ("td", "th"):
            self.line.append("| ")
            self.cells += 1
        elif tag == "a":
            self.links.append(dict(attrs).get("href"))
            self.line.append("[" if self.links[-1] else "")
        elif tag in _MARKS:
            self.line.append(_MARKS[tag])
        elif tag in _BLOCKS:
            self.end_line(blank=tag != "tr")
            self.verbatim += tag == "pre"
            self.cells = 0
            if tag == "blockquote":
                self.prefix = "> "

    def handle_endtag(self, tag: str) -> None:
        if self.dropped:
            if tag == self.dropped[-1]:
                self.dropped.pop()
            return
        if re.fullmatch("h[1-6]", tag):
            self.end_line(blank=True)
        elif tag in ("ul", "ol"):
            self.end_line(blank=len(self.lists) <= 1)
            if self.lists:
                self.lists.pop()
        elif tag in ("td", "th"):
            self.line.append(" ")
        elif tag == "tr":
            if self.cells:
                self.line.append("|")
            self.end_line()
            self.cells = 0
        elif tag == "a" and self.links:
            href = self.links.pop()
            self.line.append(f"]({href})" if href else "")
        elif tag in _MARKS:
            self.line.append(_MARKS[tag])
        elif tag in _BLOCKS:
            self.end_line(blank=True)
            self.verbatim -= tag == "pre" and self.verbatim > 0

    def handle_data(self, data: str) -> None:
        if self.dropped:
            return
        if self.verbatim:
            *whole, last = data.split("\n")
            for part in whole:
                self.line.append(part)
                self.end_line()
            self.line.append(last)
        else:
            self.line.append(data)


def to_markdown(html: str) -> str:
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    parser.end_line()
    return "\n".join(parser.lines).strip()


@F.pandas_udf(T.StringType())
def html_to_markdown(html: pd.Series) -> pd.Series:
    return html.map(lambda s: None if s is None else to_markdown(s))

"""HTML snapshots: visible text of pages, and the JSON index that a script assigns."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose content is no text, and elements that begin a line.
SILENT = {"script", "style", "nav", "template", "noscript", "svg", "iframe", "form", "button"}
BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "section", "article", "header", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}

#: Pages of a batch that are read at once: as Python strings they take several times their bytes.
AT_ONCE = 100


class Visible(HTMLParser):
    """Collects the title and the visible text, a line feed before and after each block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title: list[str] = []
        self.silent: list[str] = []
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent.append(tag)
        self.in_title |= tag == "title"
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in self.silent:
            while self.silent.pop() != tag:
                pass
        self.in_title &= tag != "title"
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.silent:
            self.parts.append(data)


def visible_text(html: str | None) -> tuple[str, str]:
    """(title, body): blanks collapsed, empty lines dropped. Null and broken markup give what can be read."""
    parser = Visible()
    parser.feed(html or "")
    parser.close()
    lines = (" ".join(x.split()) for x in "".join(parser.parts).split("\n"))
    return " ".join("".join(parser.title).split()), "\n".join(x for x in lines if x)


def page_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    """The other columns, title and body of every page."""
    keep = [c for c in pages.columns if c != html]

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(lo, AT_ONCE)
                found = [visible_text(x) for x in batch.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keep))), pa.array([t for t, _ in found], pa.string()), pa.array([b for _, b in found], pa.string())], names=[*keep, "title", "body"])

    return pages.select(*keep, html).mapInArrow(run, pages.select(*keep).schema.add("title", "string").add("body", "string"))


def script_object(html: str, name: str) -> dict | None:
    """The JSON object that a script assigns to ``name``, found by its braces outside strings; None if there is none."""
    for m in re.finditer(re.escape(name) + r"\s*=\s*(?=\{)", html):
        try:
            value, _ = json.JSONDecoder().raw_decode(html, m.end())
        except ValueError:
            continue
        return value
    return None


def index_cards(html: str, name: str = "window.INDEX") -> list[dict]:
    """Cards of a page's script-assigned index. Raises ValueError if there is no index, a card lacks its link or title, or links repeat."""
    value = script_object(html, name)
    cards = value.get("cards") if value else None
    if not isinstance(cards, list):
        raise ValueError("no index of cards")
    if any(not isinstance(c, dict) or not c.get("link") or not c.get("title") for c in cards):
        raise ValueError("a card without link or title")
    if len({c["link"] for c in cards}) != len(cards):
        raise ValueError("a link that two cards share")
    return cards

"""Words with boxes on a page, and the box of a chunk of its text. All as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import col, let

#: Fixed value: tokens of a chunk by which its place on the page is found.
PROBE = 4


def attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf'{name}="([\d.]+)"', 1).try_cast("double")


def page_size(html: str | Column) -> Column:
    """(width, height) of the first page tag; null without one or without its sizes."""
    tag = F.regexp_extract(col(html), r"<page\b[^>]*>", 0)
    w, h = attribute(tag, "width"), attribute(tag, "height")
    return F.when(w.isNotNull() & h.isNotNull(), F.struct(w.alias("width"), h.alias("height")))


def word_boxes(html: str | Column) -> Column:
    """Array of (x1, y1, x2, y2, text) of a box-layout page's words, in order; blank words are left out, missing sides are 0."""
    rule = F.lit(r"<word\b([^>]*)>([\s\S]*?)</word>")
    tags, texts = F.regexp_extract_all(col(html), rule, 1), F.regexp_extract_all(col(html), rule, 2)

    def word(tag: Column, text: Column) -> Column:
        for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
            text = F.replace(text, F.lit(a), F.lit(b))
        sides = {"x1": "xMin", "y1": "yMin", "x2": "xMax", "y2": "yMax"}
        return F.struct(*[F.coalesce(attribute(tag, n), F.lit(0.0)).alias(k) for k, n in sides.items()], text.alias("text"))

    return F.filter(F.zip_with(tags, texts, word), lambda w: F.trim(w["text"]) != "")


def chunk_box(boxes: Column, chunk: str | Column) -> Column:
    """The box (x1, y1, x2, y2) around a chunk's words among a page's ``boxes`` (``word_boxes``); null if they are not found.

    The first place where the chunk's first PROBE tokens stand, without regard to case; if there is none, where each holds or is
    held by a word. From there the run goes on as long as tokens and words are equal. Empty chunks and pages have no box.
    """
    tokens = F.filter(F.split(F.lower(col(chunk)), r"[\s\p{Z}]+"), lambda t: t != "")

    def place(s: Column) -> Column:
        """Where the probe stands on the page, or null. s: page, tokens, n (tokens of the probe), first (the probe)."""
        page, n, first = s["page"], s["n"], s["first"]
        starts = F.when((F.size(page) >= n) & (n > 0), F.sequence(F.lit(0), F.size(page) - n)).otherwise(F.array().cast("array<int>"))

        def same(i: Column) -> Column:
            return (F.get(page, i) == F.get(first, F.lit(0))) & (F.slice(page, i + 1, n) == first)

        def alike(i: Column) -> Column:
            return F.forall(F.zip_with(F.slice(page, i + 1, n), first, lambda a, b: F.contains(a, b) | F.contains(b, a)), lambda x: x)

        return F.coalesce(F.get(F.filter(starts, same), F.lit(0)), F.get(F.filter(starts, alike), F.lit(0)))

    def around(b: Column, s: Column, at: Column) -> Column:
        left = F.greatest(F.size(s["tokens"]) - s["n"], F.lit(0))
        rest = F.zip_with(F.slice(s["page"], at + s["n"] + 1, left), F.slice(s["tokens"], s["n"] + 1, left), lambda x, y: F.coalesce(x == y, F.lit(False)))
        run = let(rest, lambda r: F.when(F.array_contains(r, False), F.array_position(r, F.lit(False)).cast("int") - 1).otherwise(F.size(r)))

        def side(name: str, pick) -> Column:
            return pick(F.transform(F.slice(b, at + 1, s["n"] + run), lambda x: x[name])).alias(name)

        return F.when(at.isNotNull(), F.struct(side("x1", F.array_min), side("y1", F.array_min), side("x2", F.array_max), side("y2", F.array_max)))

    def known(b: Column) -> Column:
        found = F.struct(F.transform(b, lambda x: F.lower(x["text"])).alias("page"), tokens.alias("tokens"))
        probed = let(found, lambda f: F.struct(f["page"].alias("page"), f["tokens"].alias("tokens"), F.least(F.size(f["tokens"]), F.lit(PROBE)).alias("n"), F.slice(f["tokens"], 1, PROBE).alias("first")))
        return let(probed, lambda s: let(place(s), lambda at: around(b, s, at)))

    return let(boxes, known)

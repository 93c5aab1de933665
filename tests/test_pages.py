import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import pages
from lectern.operators.paging import decode_cursor, encode_cursor, keyset_page, offset_page
from lectern.sources import html


def test_chunks_break_at_paragraphs_lines_sentences():
    a = "x" * 600 + "\n\n" + "y" * 900
    assert pages.spans(a)[0][:2] == (0, 602)
    b = "x" * 700 + "\n" + "y" * 900
    assert pages.spans(b)[0][:2] == (0, 701)
    c = "x" * 400 + ". " + "y" * 1200
    assert pages.spans(c)[0][:2] == (0, 402)
    d = "x" * 2000
    assert [s[:2] for s in pages.spans(d)] == [(0, 1000), (800, 1800), (1600, 2000)]


def test_chunk_edges():
    assert pages.spans("") == [] and pages.spans(" \n ") == []
    assert pages.spans("short") == [(0, 5, "short")]
    tail = "x" * 990 + ". " + "y" * 30
    got = pages.spans(tail, pages.Chunking(1000, 0, 100))
    assert len(got) == 1 and got[0][2] == "x" * 990 + ". " + "\n" + "y" * 30 and got[0][1] == len(tail)
    for start, end, text in pages.spans("".join(f"Sentence number {k} is here. " for k in range(400)))[:-1]:
        assert end - start == len(text) <= 1000


def test_quality_gate(spark):
    good = "Это обычная страница русского текста, на которой рассказано о правилах игры и о том, как герои проходят испытания. " * 3
    broken = "3@7# %1$  9!8? *4^ &2( )6_ +5= " * 8
    english = "This page of plain English prose explains how the heroes travel from one town to the next and rest at night. " * 2
    mixed = "пр1вет ми2 сл0во те%ст к0т д0м ст0л " * 6
    texts = [(0, "ru", good), (1, "ru", broken), (2, "en", broken), (3, "ru", english), (4, "ru", "кратко"), (5, "ru", "12 34"), (6, "ru", "a\ue000\ufffd\x01б"), (7, "ru", mixed), (8, "ru", None), (9, None, broken), (10, "ru", "x = 1\n" * 30)]
    got = {r.k: r for r in pages.judged(spark.createDataFrame(texts, "k long, language string, text string").withColumn("status", F.lit("clash"))).collect()}
    assert got[0].status == "good" and got[0].enough and got[0].invalid_glyphs == 0 and got[0].reasons == ""
    assert got[1].status == "corrupt" and "long-non-text-garbage" in got[1].reasons and not got[1].enough
    assert [got[k].status for k in (2, 3, 4, 5, 8, 9, 10)] == ["good"] * 7 and not got[5].enough
    assert got[6].invalid_glyphs == 3 and got[8].visible == 0 and got[8].letter_ratio == 0
    assert got[7].reasons.split(",")[:2] == ["punctuation-or-digit-intrusion", "failed-word-shape"] or got[7].status == "good"
    assert got[10].structured and got[10].enough and not got[1].structured


def test_metrics_against_tokens(spark, sf):
    """The counted patterns against a plain walk over tokens."""
    import regex

    def plain(text):
        text = text or ""
        words = [t for t in regex.split(r"[\s\p{Z}\uFEFF]+", text) if regex.search(r"\p{L}", t)]
        cores = [regex.sub(r"^[^\p{L}]+|[^\p{L}]+$", "", t) for t in words]
        outer = [regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", t) for t in words]
        shaped = sum(len(c) >= 2 and regex.fullmatch(r"[\p{L}\p{M}]+(?:['’\-][\p{L}\p{M}]+)?", c) is not None for c in cores)
        dirty = sum(regex.search(r"[^\p{L}\p{M}'’\-]", c) is not None for c in outer)
        return shaped, (dirty / len(words) if words else 0.0), (shaped / len(words) if words else 0.0)

    odd = ["don't o'- -a-b- x--y ab’c a\u0301b \u0301", "а́б 12a3 (word) w0rd \u00a0x\ufeffyy", "", None, "'a' b' 'cd' 1-2 é-è"]
    rows = [(k, t) for k, t in enumerate(odd)] + [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.k: (r.well_shaped, r.intruded_ratio, r.well_shaped_ratio) for r in pages.judged(spark.createDataFrame(rows, "k long, text string").withColumn("language", F.lit("ru"))).collect()}
    assert got == {k: plain(t) for k, t in rows}


def test_structured_content():
    good = ["x = 1", "a = 1 b = 2", "f(x, y) = 2 ** -z\n(a + b) / c <= 4e3\nprose line", "[[1, 2], [3, 4]]", "[1 2; 3 x+1]", "[1, 2]\n[3, 4]", "1,2,3", "a|b\n1|2", "1 2 3\n4 5 6", "1.5%\t-2", "x=1 y=2"]
    bad = ["", None, "x =", "= 1", "a b", "x = (1", "f (x", "[[1, 2], [3]]", "[[1], [2]]", "1,2", "1 2\n3", "a|b\nc|d", "x == 1", "1 2 three", "x = 1\nprose\nmore", "a = f (b) = c", "x" * 70_000, "(" * 600 + "x" + ")" * 600 + " = 1"]
    assert [pages.is_structured(t) for t in good] == [t != "1.5%\t-2" for t in good] and not any(pages.is_structured(t) for t in bad)


def test_html():
    title, body = html.visible_text("<title>A &amp; B</title><script>x<y</script><p>One<br>two  <b>three</b></p><style>p{}</style><div>four")
    assert title == "A & B" and body == "One\ntwo three\nfour"
    assert html.visible_text(None) == ("", "")
    page = '<script>window.INDEX = {"cards": [{"link": "/a", "title": "x } y"}, {"link": "/b", "title": "z"}]};</script>'
    assert [c["link"] for c in html.index_cards(page)] == ["/a", "/b"]
    for bad in ("<p>", page.replace("/b", "/a"), page.replace('"title": "z"', '"t": 1')):
        with pytest.raises(ValueError):
            html.index_cards(bad)


def test_pages_and_cursors(spark):
    from pyspark.sql import functions as F

    df = spark.range(100).select((F.col("id") % 7).alias("a"), "id")
    got, after = [], None
    while True:
        page = keyset_page(df, ["a", "id"], after, 9).collect()
        got += [(r.a, r.id) for r in page]
        if not page or not page[0].has_more:
            break
        after = (page[-1].a, page[-1].id)
    assert got == sorted((k % 7, k) for k in range(100))
    p = offset_page(df, [F.asc("id")], 10, 95).collect()
    assert len(p) == 5 and all(r.total == 100 and not r.has_more for r in p)
    c = encode_cursor({"a": 1, "id": 3}, b"k", "user")
    assert decode_cursor(c, b"k", "user") == {"a": 1, "id": 3} and re.fullmatch(r"[\w-]+", c)
    for bad in ((c, b"k", "other"), (c[:-2], b"k", "user"), ("!!", None, ""), ("x" * 600, None, "")):
        with pytest.raises(ValueError):
            decode_cursor(*bad)

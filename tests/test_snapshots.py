"""Cards out of broken markup, and quotes against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators.guides import occurrences, quoted_blocks
from lectern.sources.cards import card_details, read_card


def card(inner, root="div", rest=""):
    return f'<html><body><p>before</p><{root} class="x card" data-id="spell:7" onclick="x">{inner}</{root}>{rest}</body></html>'


TITLE = '<h2 class="card-title" id="t">Fire <i>Ball</i></h2>'
CASES = [
    (card(TITLE + "<p>one<p>two<br>three"), ("Fire Ball", "Fire Ball\none\ntwo\nthree")),
    (card(TITLE + "<p>one</p>", rest='<div class="card" data-id="spell:7">second</div>'), ("Fire Ball", "Fire Ball\none")),
    (card('<h2 class="card-title">T <span data-copy=" Copy  me ">x</span></h2><ul><li>a<li>b</ul>end'), ("Copy me", "T x\na\nb\nend")),
    (card(TITLE + "<nav>n<p>m</nav><div class='comments'><div>deep</div>c</div><script>var a='</div>';</script>kept<img src=x><svg><p>s</p></svg>"), ("Fire Ball", "Fire Ball\nkept")),
    (card(TITLE + "<table><tr><td>1<td>2<tr><td>3</table>x"), ("Fire Ball", "Fire Ball\n12\n3\nx")),
    (card(TITLE + "a <b>bold <i>both</b> after</i> z &amp; &lt;p&gt;"), ("Fire Ball", "Fire Ball\na bold both after z & <p>")),
    (card(TITLE + "<p><b>x<p>y"), ("Fire Ball", "Fire Ball\nx\ny")),
    (card(TITLE + "text</div></div><p>outside"), ("Fire Ball", "Fire Ball\ntext")),
    (card(TITLE + "<div><section>a</section>b"), ("Fire Ball", "Fire Ball\na\nb")),
]


@pytest.mark.parametrize("html,wanted", CASES)
def test_cards(html, wanted):
    title, markup, text, problem = read_card(html, "spell", "7")
    assert (title, text) == wanted and problem is None and "onclick" not in markup and "script" not in markup


def test_open_references():
    """A reference that was cut before its semicolon is text, as in the SQL; closed ones are read, also by number; unknown ones stay."""
    assert read_card(card(TITLE + "<p>and&amp</p><p>&amp;&amp &lt;b&gt &#65;&#x42; &#66 &notit; a&b</p>"), "spell", "7")[2] == "Fire Ball\nand&amp\n&&amp <b&gt AB &#66 &notit; a&b"


def test_markup():
    inner = TITLE + '<a href="javascript:x" title="t">a</a><a href="/ok?a&amp;b" rel="x">b</a><a href="//evil">c</a><td colspan=2 style="x">d</td><custom x=1>e</custom>'
    _, markup, _, _ = read_card(card(inner), "spell", "7")
    assert markup == '<div><h2>Fire <i>Ball</i></h2><a title="t">a</a><a href="/ok?a&amp;b">b</a><a>c</a><td colspan="2">d</td>e</div>' or markup.startswith('<div><h2>Fire <i>Ball</i></h2><a title="t">a</a><a href="/ok?a&amp;b">b</a><a>c</a><td colspan="2">d')


@pytest.mark.parametrize(
    "html,category,number,problem",
    [
        (card("x"), "spell", "8", "no card"), (None, "spell", "7", "no card"), (card(TITLE, "p"), "spell", "7", "root not allowed"), (card("no title"), "spell", "7", "no content"), (card('<h2 class="card-title"> </h2>x'), "spell", "7", "no content"),
        (card("x"), "Spell", "7", "invalid id"), (card("x"), None, None, "invalid id"), ("<div class='card' data-id='spell:7'", "spell", "7", "no card"),
    ],
)
def test_card_problems(html, category, number, problem):
    assert read_card(html, category, number) == (None, None, None, problem)


def test_card_rows(spark):
    df = spark.createDataFrame([(1, card(TITLE + "x"), "spell", "7"), (2, None, None, None)], "k int, html string, category string, external_id string")
    got = {r.k: r for r in card_details(df).collect()}
    assert got[1].title == "Fire Ball" and got[2].problem == "invalid id" and card_details(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        card_details(df.withColumn("title", F.lit("x")))


def test_occurrences():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("aab😀") for _ in range(rng.randrange(30)))
        quotes = ["".join(rng.choice("aab😀") for _ in range(rng.randrange(4))) for _ in range(5)]
        plain = {q: (sum(text.startswith(q, k) for k in range(len(text))), text.find(q)) for q in quotes if q and q in text}
        assert occurrences(text, quotes) == plain


def test_guide_problems(spark):
    blocks = [("a", "one"), ("b", "o"), ("c", ""), ("c", "one"), ("d-1", "zero"), ("D", "one"), ("e", None), (None, "one")]
    rows = [(1, "one 😀 two", blocks), (2, None, [("a", "x")]), (3, "text", None)]
    df = spark.createDataFrame(rows, "guide_id int, text string, blocks array<struct<id:string,quote:string>>")
    got = sorted(((r.guide_id, r.block or "", r.start, r.end, r.problem) for r in quoted_blocks(df).collect()), key=str)
    assert got == sorted(
        [(1, "a", 0, 3, None), (1, "b", None, None, "ambiguous"), (1, "c", None, None, "repeated id"), (1, "c", None, None, "repeated id"), (1, "d-1", None, None, "not found"), (1, "D", None, None, "unstable id"), (1, "e", None, None, "blank quote"), (1, "", None, None, "unstable id"), (2, "a", None, None, "not found")],
        key=str,
    )


def test_guides_and_decisions(spark):
    from lectern.operators.extraction import decided
    from lectern.operators.guides import readable_guides

    guides = spark.createDataFrame([("a", "en", "open"), ("b", "en", "premium"), ("c", "ru", "open"), ("d", "en", None)], "slug string, locale string, access_tier string")
    readers = spark.createDataFrame([("u", "user", "en"), ("p", "premium", "en"), ("x", None, "ru"), ("n", "admin", None)], "reader string, role string, locale string")
    assert sorted((r.reader, r.slug) for r in readable_guides(guides, readers).collect()) == [("p", "a"), ("p", "b"), ("p", "d"), ("u", "a"), ("x", "c")]
    rows = [("approve", "new", True), ("approve", "missing", False), ("merge", "duplicate", True), ("merge", "missing", False), ("unpublish", "missing", True), ("unpublish", "new", False), ("reject", "invalid", True), ("reject", None, False)]
    got = decided(spark.createDataFrame(rows, "decision string, status string, want boolean")).collect()
    assert all(r.allowed == r.want for r in got)


def test_pages_are_read_in_slices():
    """Of a large batch only some pages are Python strings at a time, and all come out in order."""
    import pyarrow as pa

    from lectern.sources import html

    class Plan:
        columns = ["k", "html"]
        schema = type("S", (), {"add": lambda self, *a: self})()

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    batch = pa.RecordBatch.from_arrays([pa.array(range(1050)), pa.array([f"<title>t{k}</title><p>b{k}" for k in range(1050)])], names=["k", "html"])
    out = list(html.page_texts(Plan())(iter([batch])))
    assert max(b.num_rows for b in out) <= html.AT_ONCE
    assert [(r["k"], r["title"], r["body"]) for b in out for r in b.to_pylist()] == [(k, f"t{k}", f"b{k}") for k in range(1050)]

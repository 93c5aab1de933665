import pytest
from pyspark.sql import functions as F

from lectern.functions import evidence as E
from lectern.functions import text as T


@pytest.fixture
def of(spark):
    """Values of a Column function for given texts, in order."""

    def run(f, *texts):
        rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
        return [r[1] for r in rows.select("k", f(F.col("t")).alias("v")).orderBy("k").collect()]

    return run


def test_segments(of):
    text = "One. Two! 3.5 three\n| a | b. c |\n\n" + "x" * 601 + "\r\nEnd。 Next"
    assert of(E.segments, text, "", None, " \n ") == [["One.", "Two!", "3.5 three", "| a | b. c |", "End。", "Next"], [], None, []]
    assert of(lambda t: E.anchored(t, F.lit(" Red Dragon ")), "It burns.", "A red dragon burns.", None) == ["Red Dragon: It burns.", "A red dragon burns.", None]
    assert of(lambda t: E.anchored(F.lit("q"), t), "", None) == ["q", "q"]


def test_words(of):
    assert of(E.plain_words, "AC 15; Dragons class bus", "Хиты Красного дракона КД", None) == [["armor", "class", "15", "dragon", "class", "bus"], ["хит", "красн", "дракон", "класс", "доспех"], []]
    asked = of(lambda t: E.plain_words(t, True), "How fast does it move?", "It moves fast", "Как быстро двигается волк")
    assert asked == [["how", "speed", "does", "it"], ["it", "move", "fast"], ["как", "скорость", "волк"]]


def test_selections(of):
    many = '{"selections": [' + ", ".join(f'"C{k}:S1"' for k in range(1, 7)) + "]}"
    good = of(E.selected, '{"selections": ["C10:S1", "C2:S3", "C2:S3"]}', '```json\n{"selections": []}\n```', ' {"selections":["C1:S2"]} ')
    assert [(r.ids, r.normalized, r.rejected) for r in good] == [(["C2:S3", "C10:S1"], True, False), ([], False, False), (["C1:S2"], False, False)]
    for r in of(E.selected, "", "[]", None, '{"selections": ["C0:S1"]}', '{"selections": [], "x": 1}', '{"selections": "C1:S1"}', many):
        assert r.rejected and r.ids == [] and not r.normalized


def test_resolved_is_all_or_nothing(spark):
    offered = spark.createDataFrame([(1, "C1:S1", "t1", "q1", 7), (1, "C1:S2", "t2", "q2", 7), (2, "C1:S1", "u1", "v1", 9)], "question long, id string, text string, quote string, chunk long")
    answers = spark.createDataFrame([(1, ["C1:S1", "C1:S2"]), (2, ["C1:S1", "C1:S2"]), (3, [])], "question long, ids array<string>")
    got = {r.question: r.segments and [s.text for s in r.segments] for r in E.resolved(answers, offered).collect()}
    assert got == {1: ["t1", "t2"], 2: None, 3: []}


def test_answers_query(spark):
    def answers(question, texts, subjects=("Red Dragon", "Wolf")):
        one = spark.createDataFrame([(question, list(texts), list(subjects))], "q string, t array<string>, s array<string>")
        return one.select(E.answers_query(F.col("q"), F.col("t"), F.col("s"))).first()[0]

    assert answers("What is the armor class of a red dragon?", ["Red Dragon: AC 19"])
    assert not answers("What is the armor class of a red dragon?", ["Wolf: AC 13"])
    assert not answers("What is the armor class of a red dragon?", ["Red Dragon: AC 19", "Wolf: AC 13"])
    assert answers("Compare the armor class of red dragon and wolf", ["Red Dragon: AC 19", "Wolf: AC 13"])
    assert not answers("What is the?", ["the"]) and not answers("speed of the wolf", ["Wolf: AC 13"])
    assert answers("How fast does a wolf move?", ["Wolf: speed 40"]) and answers("Wolf", ["A wolf."])


def test_support(of):
    def supports(claim, text, language="en", section=None):
        forms = lambda t: F.transform(E.support_segments(t, section and F.lit(section)), lambda s: E.claim_form(s, language))
        return of(lambda t: F.exists(forms(t), lambda s: E.supported(E.claim_form(F.lit(claim), language, True), s, language)), text)[0]

    text = "Goblin. Armor Class 15, Hit Points 7. The speed is 30 feet; bite 2d6."
    assert supports("AC 15", text) and supports("speed 30 ft", text) and supports("15 AC", text) and supports("bite 2d6", text)
    assert not supports("AC 7", text) and not supports("speed 30 m", text) and not supports("", text) and not supports("bite 2d8", text)
    assert not supports("Goblin speed 30 feet", text) and supports("Goblin speed 30 feet", "Speed 30 feet.", section="Goblin")
    assert not supports("It bites.", "It bites.") and supports("The wolf and it bite", "the wolf, it bite")
    assert supports("Волка видит красный дракон", "волку видит красный дракон", "ru") is False
    assert supports("красного дракона", "Красный дракон", "ru") and not supports("красного дракона", "Красный дракон")
    long = " ".join(f"w{k}" for k in range(400))
    assert supports("w1 w2", long) and all(len(s) <= 800 for s in of(E.support_segments, long)[0]) and " ".join(of(E.support_segments, long)[0]) == long


def test_blocks(of):
    text = "😀 Fire Bolt\nCasting Time: 1 action\nRange: 120 feet\nComponents: V, S\nDuration: Instantaneous\nBody"
    b = E.typed_block(text)
    assert b["type"] == "spell" and all(text[a:z] == v for v, a, z in b["fields"].values())
    assert E.typed_block(text.replace("Range", "Rnge")) is None
    ru = "Волк\nКласс Доспеха 13\nХиты 11\nСкорость 40 фт.\nОпасность 1/4"
    assert E.typed_block(ru)["type"] == "creature" and E.typed_block(ru)["fields"]["challenge"][0] == "1/4"
    assert of(E.chunk_type, ru, "| Item | Cost |", "plain", None, "x\nRANGE\nсотворения", "A Feat.") == ["creature", "equipment", None, None, None, "feat"]
    rows = E.table_rows("Gear\n| Item | Cost |\n|---|---|\n| Rope | 1 gp |\n| x |\n| late | 2 gp |")
    assert rows == [{"Item": "Rope", "Cost": "1 gp"}]
    assert E.modifiers("Stealth +6, Sleight of Hand −1") == {"stealth": 6, "sleight of hand": -1}
    assert E.speeds("30 ft., fly 60 ft.") == [("walk", 30), ("fly", 60)]
    assert E.progression_gaps(list(range(1, 20)) + [19]) == [19, 20]


def test_report(spark):
    def report(pages, with_text, chunks, **faults):
        r = spark.range(1).select(*[c.alias(n) for c, n in zip(E.report(F.lit(pages), F.lit(with_text), F.lit(chunks), **{k: F.lit(v) for k, v in faults.items()}), "sg")]).first()
        return r.s, r.g

    assert report(10, 10, 5) == (100, "excellent") and report(0, 0, 5) == (0, "failed") and report(10, 10, 0) == (0, "failed")
    assert report(10, 4, 5, no_ocr=3, ocr_errors=1, embed_errors=9, skipped=1) == (15, "failed")
    assert report(10, 4, 5) == (70, "good") and report(10, 4, 5, ocr_errors=1, skipped=2) == (55, "acceptable") and report(10, 4, 5, no_ocr=1, ocr_errors=1) == (40, "poor")


def test_messages_and_quotes(of):
    assert E.messages(["a", "b", "c" * 10], 5) == ["a\nb", "ccccc", "ccccc"] and E.messages([]) == []
    assert of(lambda t: E.quote_matches(F.lit("Red dragons burn"), t), "the red dragon burn", "red", "dragon red", "", None) == [True, True, False, False, False]


def test_rows_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "ab", "x"), (2, None, "y")], "id long, t string, n string")
    got = E.rows(df, lambda t: [(len(t or ""),)], ["t"], "n bigint").collect()
    assert sorted((r.id, r.n) for r in got) == [(1, 2), (2, 0)]
    assert spark.range(1).select(T.let(F.lit(3), lambda x: x * x)).first()[0] == 9


def test_claims_meet_segments_anywhere(spark, tmp_path):
    """Behind other words, with another filler, blank or label form, and short; against every pair tested."""
    from lectern.plans.registry import QUERIES

    claims = ["The goblin has 7 hit points.", "AC 15.", "A red dragon breathes fire over the town.", "It is.", "", None]
    texts = [
        "In short, a goblin has hp 7. More.", "First. The Armor  Class is 15", "Then the red dragon breathes fire over a town! End", "dragon fire", "AC 14. 15 AC.",
        "a red\ndragon breathes fire over the town.", "", None,
    ]
    spark.createDataFrame(list(enumerate(claims)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in QUERIES["g_07_supported_claims"](spark, str(tmp_path)).collect()}
    assert got == {(0, 0), (1, 1), (2, 2)}


def test_cited_support(spark):
    from lectern.operators.support import claim_support

    chunks = spark.createDataFrame([(1, "Speed 30 ft. The elf has keen sight."), (2, "Speed 30 feet\nArmor Class 15"), (3, None)], "chunk_id int, text string")
    claims = [(1, "Speed 30 feet"), (2, "Speed 30 feet"), (3, "Speed 40 ft"), (4, "It has keen sight"), (5, ""), (6, "Speed 30 feet"), (7, None), (8, "15 armor class"), (9, "Speed 30 feet")]
    cites = [(1, 1), (1, 2), (2, 1), (2, 3), (3, 1), (3, 2), (4, 1), (5, 1), (8, 2), (8, 2), (9, 99)]
    got = claim_support(spark.createDataFrame(claims, "claim_id int, claim string"), spark.createDataFrame(cites, "claim_id int, chunk_id int"), chunks)
    assert {r.claim_id: (r.supported, r.unsupported) for r in got.collect()} == {
        1: (True, []), 2: (False, []), 3: (False, ["40"]), 4: (False, ["it"]), 5: (False, []), 6: (False, ["label-speed", "30", "unit-ft"]), 7: (False, []), 8: (True, []), 9: (False, ["label-speed", "30", "unit-ft"]),
    }


def test_fallback_answers(spark):
    from lectern.functions import evidence as E

    offered = spark.createDataFrame([(1, f"C{c}:S{s}", c, f"q{c}{s}", f"t{c}{s}") for c in range(1, 12) for s in (1, 2)], "question int, id string, chunk int, quote string, text string")
    segments = "segments array<struct<at:int,id:string,text:string,quote:string,chunk:int>>"
    kept = [(0, "C2:S1", "t21", "q21", 2), (1, "C2:S2", "t22", "q22", 2), (2, "C2:S1", "t21", "q21", 2)]
    rows = [(1, "en", None, kept), (1, "ru", "selection_normalized", kept), (1, "en", "no_selection", []), (1, "ru", "malformed_selection", None), (2, None, "insufficient_retrieval", None)]
    got = E.answered(spark.createDataFrame(rows, f"question int, language string, reason string, {segments}"), offered).collect()
    by = {(r.question, r.reason): (r.answer, [tuple(c) for c in r.cited], r.confident) for r in got}
    assert by[1, None] == ("t21\n\nt22\n\nt21", [(2, "q21"), (2, "q22")], True) and by[1, "selection_normalized"][2] is False
    assert by[1, "no_selection"] == (E.SAID_INSTEAD["en"]["no_selection"], [(1, "q11"), (2, "q21"), (3, "q31")], False)
    assert by[1, "malformed_selection"][0] == E.SAID_INSTEAD["ru"]["malformed_selection"] and by[2, "insufficient_retrieval"] == (E.SAID_INSTEAD["en"]["insufficient_retrieval"], [], False)


def test_cited_claims_end_as_in_sql(spark, tmp_path):
    """The last sentence of the first line, its end mark aside; only a line feed ends a line, also behind a mark."""
    import duckdb

    from lectern.plans.evidence import cited_claims

    texts = ["a. b.\nc", "a..", "", "x", "...", ".", "a. b", "a.\r\nb", "a. b.\r", "é. ü ", None, "\n. b", " a. b. ", "one. two.three"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.claim_id: r.claim for r in cited_claims(spark, str(tmp_path))[0].collect()}
    sql = rf"SELECT doc_id, regexp_extract(regexp_extract(text, '^([^\n]*)', 1), '([^.]*)\.?$', 1) FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')"
    assert got == dict(duckdb.sql(sql).fetchall()) and got[8] == "\r" and got[0] == " b"


def test_tokens_that_every_cited_chunk_lacks(spark):
    """Of several chunks, repeated tokens, chunks that aren't there, and none at all."""
    from lectern.operators.support import claim_support

    claims = [(1, "red fox jumps red"), (2, "red fox"), (3, "red wolf"), (4, "red fox"), (5, "red wolf"), (6, "")]
    cites = [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 9), (5, 1), (5, 1), (6, 1)]
    chunks = spark.createDataFrame([(1, "A red fox. It runs."), (2, "The fox jumps; blue.")], "chunk_id int, text string")
    got = claim_support(spark.createDataFrame(claims, "claim_id int, claim string"), spark.createDataFrame(cites, "claim_id int, chunk_id int"), chunks)
    assert {r.claim_id: (r.supported, r.unsupported) for r in got.collect()} == {1: (False, []), 2: (False, []), 3: (False, ["wolf"]), 4: (False, ["red", "fox"]), 5: (False, ["wolf"]), 6: (False, [])}

from pyspark.sql import functions as F

from lectern.functions import boxes as B
from lectern.functions import creatures as C


def test_shapes_of_odd_json(spark):
    odd = [None, "", "null", "[]", "{}", "[[", '"x"', "3"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k long, t string")
    got = {r.k: r for r in df.select("k", *[C.shape_ok(p, "t").alias(p) for p in C.SHAPES]).collect()}
    assert all(got[0][p] is None for p in C.SHAPES) and not any(got[k][p] for k in (1, 2, 5, 6, 7) for p in C.SHAPES)
    assert got[3].blocks and got[3].texts and not got[3].armor and got[4].modifiers and not got[4].hit_points
    one = spark.createDataFrame([(None, None, None), ("$.attributes.skills", None, "Skills"), (None, "3", "3")], "p string, v string, q string")
    assert [r[0] for r in one.select(C.evidence_supports("p", "v", "q")).collect()] == [False, False, True]


def test_boxes(spark):
    html = '<page width="10.0" height="20"><word xMin="1" yMin="2" xMax="3" yMax="4">Ann&amp;Bob</word><word xMin="5" yMin="2" xMax="7" yMax="5">went</word><word> </word><word xMin="8" yMin="1" xMax="9" yMax="4">home.</word></page>'
    df = spark.createDataFrame([(0, html, "ann&bob  WENT home."), (1, html, "went home"), (2, html, "nowhere"), (3, html, ""), (4, html, None), (5, "<p>", "x"), (6, None, "x"), (7, html, "ann&bob went away")], "k long, html string, chunk string")
    got = {r.k: r for r in df.select("k", B.page_size("html").alias("size"), F.size(B.word_boxes("html")).alias("n"), B.chunk_box(B.word_boxes("html"), "chunk").alias("box")).collect()}
    assert tuple(got[0].size) == (10.0, 20.0) and got[0].n == 3 and tuple(got[0].box) == (1.0, 1.0, 9.0, 5.0)
    assert tuple(got[1].box) == (5.0, 1.0, 9.0, 5.0)  # 'home' is held by 'home.'
    assert [got[k].box for k in (2, 3, 4, 5, 6)] == [None] * 5 and got[5].size is None and got[7].box is None


#: What evidence is, case by case: path, value, quote, whether it supports.
CASES = [
    ("$.attributes.challenge", "0.25", "Challenge 1/4 (50 XP)", True),
    ("$.attributes.name", '"Epee"', "The Épée of dawn", True),
    ("$.attributes.speeds[1]", '{"mode":"fly","distance":60,"unit":"ft"}', "Speed 30 ft., or fly 60 ft.", True),
    ("$.attributes.speeds[1]", '{"mode":"fly","distance":60,"unit":"ft","note":"hover"}', "Speed 30 ft., fly 60 ft. (hover)", True),
    ("$.attributes.speeds[1]", '{"mode":"fly","distance":60,"unit":"ft"}', "Speed 30 ft., fly 60 ft. (hover)", False),
    ("$.attributes.speeds[0]", '{"mode":"swim","distance":9,"unit":"m"}', "плавая 9 м", True),
    ("$.attributes.speeds[0]", '{"mode":"walk","distance":30,"unit":"ft"}', "swimming 30 ft.", False),
    ("$.attributes.armorClass", '{"value":15,"note":"natural  armor"}', "Armor Class 15 ( natural  armor )", True),
    ("$.attributes.armorClass", '{"value":15,"note":"natural armor, shield"}', "Armor Class: 15 (natural armor, shield)", True),
    ("$.attributes.armorClass", '{"value":15}', "About Armor Class 15", False),
    ("$.attributes.hitPoints", '{"average":7,"formula":"2d6 + 1"}', "Hit Points 7 (2d6  +  1)", True),
    ("$.attributes.languages", '["Common","Elvish"]', "Languages Common, Elvish", True),
    ("$.attributes.languages", '["Common","Orcish"]', "Languages Common, Elvish", False),
    ("$.attributes.senses", '{"darkvision":60,"kind":["deep","Dark"]}', "darkvision 60 ft., deep dark", True),
    ("$.attributes.senses", '{"darkvision":90}', "darkvision 60 ft.", False),
    ("$.attributes.challengeRating", '{"numerator":2,"denominator":8}', "cr = 1/4", True),
    ("$.attributes.challengeRating", '{"numerator":1,"denominator":1}', "Challenge 1/4", False),
    ("$.attributes.skills", '{"Sleight of Hand":-1,"Stealth":6}', "Skills Stealth +6, Sleight of Hand -1", True),
    ("$.attributes.saves", '{"dex":3}', "Saving Throws Dex +3, Con +1", False),
    ("$.attributes.alignment", "null", "Medium beast, unaligned", True),
    ("$.attributes.alignment", '"chaotic evil"', "Small humanoid (goblinoid), chaotic evil", True),
    ("$.attributes.actions[0]", '{"name":"Bite","text":"It bites. Hard."}', "Bite. It bites. Hard.", True),
    ("$.attributes.abilities.wis", "12", "МДР 12 (+1)", True),
    ("$.attributes.name", "null", "null", False),
    ("$.attributes.name", None, "x", False),
]


def test_evidence(spark):
    df = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(CASES)], "k int, p string, v string, q string")
    for r in df.select("k", C.evidence_supports("p", "v", "q").alias("ok")).collect():
        assert r.ok == CASES[r.k][3], CASES[r.k]

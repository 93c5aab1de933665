"""Stat blocks, lifecycle guards and boxes: rows made from parts and orders, of which many break a rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import boxes as B
from lectern.functions import creatures as C
from lectern.operators.changes import has_projection, revision_guard, version_guard
from lectern.plans.base import query
from lectern.sources.stores import dealt
from lectern.sources.views import entries, table

ABILITIES = '{"str": 10, "dex": 12, "con": 9, "int": 3, "wis": %s, "cha": 8}'
#: (JSON, whether it has the shape), by part.
CASES = {
    "armor": (('[{"value": 15}]', True), ('[{"value": 15, "note": "natural"}, {"value": 17.0}]', True), ("[]", False), ('[{"value": 0}]', False), ('[{"value": "15"}]', False), ('[{"value": 15, "x": 1}]', False), ('{"value": 15}', False), ('[{"value": 15, "note": " "}]', False), (None, None), ("[", False)),
    "speeds": (('[{"mode": "walk", "distance": 30, "unit": "ft"}]', True), ('[{"mode": "walk", "distance": 9, "unit": "m"}, {"mode": "fly", "distance": 18, "unit": "m", "note": "hover"}]', True), ('[{"mode": "walk", "distance": 9, "unit": "m"}, {"mode": "walk", "distance": 8, "unit": "m"}]', False), ('[{"mode": "run", "distance": 9, "unit": "m"}]', False), ('[{"mode": "fly", "distance": 9.5, "unit": "m"}]', False), ('[{"mode": "fly", "unit": "m"}]', False)),
    "hit_points": (('{"average": 7}', True), ('{"average": 7, "formula": "2d6"}', True), ('{"average": 7, "formula": "2D6 + 3"}', True), ('{"average": 0}', False), ('{"average": 7, "formula": "two dice"}', False), ('{"formula": "2d6"}', False), ("[7]", False)),
    "modifiers": (("{}", True), ('{"stealth": 6, "perception": -1}', True), ('{"stealth": 31}', False), ('{" ": 1}', False), ('{"stealth": "6"}', False), ("[1]", False)),
    "blocks": (("[]", True), ('[{"name": "Bite", "text": "It bites."}]', True), ('[{"name": "Bite"}]', False), ('[{"name": "", "text": "x"}]', False), ('[{"name": "Bite", "text": 3}]', False), ('[{"name": "a", "text": "b", "c": 1}]', False)),
    "texts": (("[]", True), ('["fire", "cold"]', True), ('["fire", ""]', False), ('["fire", null]', False), ("[3]", False)),
    "abilities": ((ABILITIES % 11, True), (ABILITIES % 31, False), (ABILITIES % 2.5, False), ('{"str": 10}', False), (ABILITIES % '11, "luck": 3', False)),
}


def sql(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"


def pick(cases, at: int, key: str = "p_partkey"):
    """The cases in turn, as a Column."""
    return F.element_at(F.array(*[F.lit(c[at]) for c in cases]), (F.col(key) % len(cases) + 1).cast("int"))


def turn(cases, at: int, key: str = "p_partkey") -> str:
    """The same in SQL."""
    return f"CASE {key} % {len(cases)} " + " ".join(f"WHEN {k} THEN {sql(c[at])}" for k, c in enumerate(cases)) + " END"


@query("v_05_stat_block_shapes", "SELECT p_partkey, " + ", ".join(f"{turn(c, 1)} AS {p}_ok" for p, c in CASES.items()) + " FROM part")
def v_05(spark, sf):
    """The seven parts of a stat block as JSON, sound and unsound ones in turn."""
    p = dealt(table(spark, sf, "part").select("p_partkey")).select("p_partkey", *[pick(c, 0).alias(k) for k, c in CASES.items()])
    return p.select("p_partkey", *[C.shape_ok(k, k).alias(f"{k}_ok") for k in CASES])


@query(
    "f_04_complete_creature",
    f"SELECT p_partkey, ({turn(CASES['armor'], 1)}) IS TRUE AND ({turn(CASES['hit_points'], 1)}) AND ({turn(CASES['abilities'], 1)}) AND (p_size <= 30 OR p_size % 2 = 1) AS complete FROM part",
)
def f_04_creature(spark, sf):
    """Creatures whose armour, hit points, abilities and challenge are all there and sound."""
    p = table(spark, sf, "part").select("p_partkey", "p_size", *[pick(CASES[k], 0).alias(k) for k in ("armor", "hit_points", "abilities")])
    odd = (F.col("p_size") > 30) & (F.col("p_size") % 2 == 1)
    rating = C.rating_ok(F.when(odd, 1).otherwise(F.col("p_size")), F.when(odd, 4).otherwise(1))
    ok = rating
    for k in ("armor", "hit_points", "abilities"):
        ok = ok & C.yes(C.shape_ok(k, k))
    return p.select("p_partkey", ok.alias("complete"))


@query("f_04_has_projection", "SELECT entry_id, CASE entry_type WHEN 'spell' THEN ritual WHEN 'feat' THEN level >= 3 WHEN 'item' THEN cost < 1000 ELSE false END AS projected FROM entries", ("entries",))
def f_04(spark, sf):
    """Whether a revision has a row in the projection of its type; glossary terms have no projection."""
    e = entries(spark, sf)
    kept = {"spell": e.where("ritual"), "feat": e.where("level >= 3"), "item": e.where("cost < 1000")}
    return has_projection(e.select("entry_id", "entry_type"), {k: d.select("entry_id") for k, d in kept.items()}, "entry_id", "entry_type").select("entry_id", "projected")


EVIDENCE = (
    ("$.attributes.armorClass", '{"value": 15, "note": "natural armor"}', "Armor Class 15 (natural armor)", True), ("$.attributes.armorClass", '{"value": 15}', "КД: 14", False), ("$.attributes.armorClass", '{"value": 15}', "Armor Class 15 (shield)", False),
    ("$.attributes.hitPoints", '{"average": 7, "formula": "2d6 + 1"}', "Hit Points 7 (2d6  + 1)", True), ("$.attributes.hitPoints", '{"average": 7}', "Хиты 8", False),
    ("$.attributes.challengeRating", '{"numerator": 1, "denominator": 4}', "Challenge 1/4 (50 XP)", True), ("$.attributes.challengeRating", '{"numerator": 2, "denominator": 8}', "cr = 1/4", True), ("$.attributes.challengeRating", '{"numerator": 1, "denominator": 2}', "Опасность 1/4", False),
    ("$.attributes.abilities.dex", "14", "STR 10 (+0) DEX 14 (+2)", True), ("$.attributes.abilities.dex", "10", "STR 10 (+0) DEX 14 (+2)", False), ("$.attributes.abilities.str", "10", "СИЛ 10", True),
    ("$.attributes.skills", '{"Stealth": 6, "Sleight of Hand": -1}', "Skills Stealth +6, Sleight of Hand -1", True), ("$.attributes.skills", '{"Stealth": 6}', "Skills Stealth +6, Perception +2", False), ("$.attributes.saves", '{"dex": 3}', "Saving Throws Dex +3", True),
    ("$.attributes.speeds[1]", '{"mode": "fly", "distance": 60, "unit": "ft", "note": "hover"}', "Speed 30 ft., fly 60 ft. (hover)", True), ("$.attributes.speeds[0]", '{"mode": "walk", "distance": 30, "unit": "ft"}', "Speed 30 ft., fly 60 ft.", True), ("$.attributes.speeds[0]", '{"mode": "swim", "distance": 9, "unit": "m"}', "плавая 9 м", True), ("$.attributes.speeds[0]", '{"mode": "swim", "distance": 30, "unit": "ft"}', "Speed 30 ft.", False), ("$.attributes.speeds[0]", '{"mode": "walk", "distance": 30, "unit": "ft"}', "It is 30 ft. long", False),
    ("$.attributes.passivePerception", "12", "Senses darkvision 60 ft., passive Perception 12", True), ("$.attributes.passivePerception", "60", "Senses darkvision 60 ft., passive Perception 12", False),
    ("$.attributes.alignment", '"chaotic evil"', "Small humanoid (goblinoid), chaotic evil", True), ("$.attributes.alignment", "null", "Medium beast, unaligned", True), ("$.attributes.alignment", '"lawful good"', "Medium beast", False),
    ("$.attributes.actions[0]", '{"name": "Bite", "text": "It bites."}', "Bite. It bites.", True), ("$.attributes.actions[0]", '{"name": "Bite", "text": "It stings."}', "Bite. It bites.", False),
    ("$.attributes.languages[0]", '"Common"', "Languages Common, Goblin", True), ("$.attributes.experience", "50", "Challenge 1/4 (50 XP)", True), ("$.attributes.experience", "4", "Challenge 1/4 (50 XP)", False), ("$.attributes.languages[0]", "not json", "Languages", False),
)


@query("x_07_creature_evidence", f"SELECT p_partkey, {turn(EVIDENCE, 3)} AS supported FROM part")
def x_07(spark, sf):
    """Fields of creatures against quotes that are evidence for them, or are not."""
    p = table(spark, sf, "part").select("p_partkey", *[pick(EVIDENCE, k).alias(n) for k, n in enumerate(("path", "value", "quote"))])
    return p.select("p_partkey", C.evidence_supports("path", "value", "quote").alias("supported"))


@query("x_15_merge_immutable", "SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'title' WHEN 2 THEN 'aliases,body' WHEN 3 THEN 'sha256' ELSE '' END AS changed FROM part")
def x_15(spark, sf):
    """Evidence fields that a merge changed; it may change the others (p_partkey % 5 = 4 does)."""
    k = F.col("p_partkey") % 5
    stored = F.to_json(F.struct(F.col("p_name").alias("title"), F.array("p_brand", "p_type").alias("aliases"), F.col("p_type").alias("body"), F.lit("00").alias("sha256"), F.lit(1).alias("note")))
    title = F.when(k == 1, F.lit("another")).otherwise(F.col("p_name"))
    aliases = F.when(k == 2, F.array("p_type", "p_brand")).otherwise(F.array("p_brand", "p_type"))
    body = F.when(k != 2, F.col("p_type"))
    merged = F.to_json(F.struct(F.when(k != 3, F.lit("00")).alias("sha256"), title.alias("title"), aliases.alias("aliases"), body.alias("body"), F.when(k == 4, 2).otherwise(1).alias("note")))
    fields = ("title", "aliases", "body", "sha256", "sourceUrl")
    return table(spark, sf, "part").select("p_partkey", F.array_join(C.merge_changes(stored, merged, fields), ",").alias("changed"))


STATES = "draft published retired".split()
GUARDED = """SELECT o_orderkey, ['draft', 'published', 'retired'][o_orderkey % 3 + 1] AS a, ['draft', 'published', 'retired'][o_custkey % 3 + 1] AS b, o_totalprice AS body, CASE WHEN o_custkey % 7 = 0 THEN -1 ELSE o_totalprice END AS body2, CASE WHEN o_custkey % 5 > 0 THEN o_orderdate END AS published,
   o_orderpriority AS src, CASE WHEN o_custkey % 11 = 0 THEN 'moved' ELSE o_orderpriority END AS src2, o_custkey % 2 = 0 AS has FROM orders"""


@query(
    "v_06_guards",
    f"""SELECT o_orderkey, CASE WHEN a = 'draft' AND b = 'published' AND published IS NOT NULL AND body = body2 THEN '' ELSE 'immutable' END AS revision,
        CASE WHEN (a = 'published' AND b = 'draft') OR (a = 'retired' AND b <> 'retired') THEN 'backwards' WHEN src <> src2 AND has THEN 'boundary' ELSE '' END AS version FROM ({GUARDED})""",
)
def v_06(spark, sf):
    """Updates of revisions (immutable but for their publication) and of versions (lifecycle forwards, source fixed once there is a revision)."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def state(x):
        return F.element_at(F.array(*map(F.lit, STATES)), (x % 3 + 1).cast("int"))

    o = table(spark, sf, "orders").select(
        "o_orderkey", state(k).alias("a"), state(c).alias("b"), F.col("o_totalprice").alias("body"), F.when(c % 7 == 0, -1).otherwise(F.col("o_totalprice")).alias("body2"), F.when(c % 5 > 0, F.col("o_orderdate")).alias("at"),
        F.col("o_orderpriority").alias("src"), F.when(c % 11 == 0, "moved").otherwise(F.col("o_orderpriority")).alias("src2"), (c % 2 == 0).alias("has"),
    )
    return o.select("o_orderkey", revision_guard("a", "b", "at", F.col("body").eqNullSafe(F.col("body2"))).alias("revision"), version_guard("a", "b", F.col("src").eqNullSafe(F.col("src2")), "has").alias("version"))


BOXED = """w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents), ok AS (SELECT doc_id, n, doc_id % 9 AS s FROM w WHERE n BETWEEN 20 AND 400)"""


def page_html(spark, sf):
    """Documents as box-layout pages, their words numbered: a word a box of 8 by 10 at (10 (i % 12), 20 (i // 12))."""
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w")
    d = dealt(table(spark, sf, "documents").select("doc_id", words).where((F.size("w") >= 20) & (F.size("w") <= 400)))
    d = d.withColumn("w", F.transform("w", lambda x, i: F.concat(F.regexp_replace(x, "[&<>\"']", ""), F.lit("-"), i)))

    def box(word, i):
        x, y = i % 12 * 10, F.floor(i / 12) * 20
        return F.format_string('<word xMin="%d.5" yMin="%d.0" xMax="%d.5" yMax="%d.0">%s</word>', x, y, x + 8, y + 10, word)

    html = F.concat(F.lit('<doc><page width="612.0" height="792.0">'), F.array_join(F.transform("w", box), "\n"), F.lit("<word xMin=\"0\"> </word></page></doc>"))
    return d.select("doc_id", "w", html.alias("html"))


@query("t_07_page_boxes", f"WITH {BOXED} SELECT doc_id, 612.0 AS width, 792.0 AS height, n AS words, 10.0 * ((n - 1) % 12) + 0.5 AS last_x, 20.0 * ((n - 1) // 12) AS last_y FROM ok")
def t_07(spark, sf):
    """Words with their boxes read from box-layout pages; blank words are left out."""
    p = page_html(spark, sf).select("doc_id", B.page_size("html").alias("size"), B.word_boxes("html").alias("b"))
    last = F.element_at("b", -1)
    return p.select("doc_id", "size.width", "size.height", F.size("b").cast("long").alias("words"), last["x1"].alias("last_x"), last["y1"].alias("last_y"))


@query(
    "t_08_chunk_boxes",
    f"""WITH {BOXED}, r AS (SELECT doc_id, s, CASE WHEN s = 8 THEN NULL ELSE s END AS a, CASE WHEN s = 7 THEN s + 3 ELSE s + 11 END AS b FROM ok)
    SELECT doc_id, min(10.0 * (i % 12) + 0.5) AS x1, min(20.0 * (i // 12)) AS y1, max(10.0 * (i % 12) + 8.5) AS x2, max(20.0 * (i // 12) + 10) AS y2 FROM (SELECT doc_id, unnest(range(a, b + 1)) AS i FROM r WHERE a IS NOT NULL) GROUP BY 1""",
)
def t_08(spark, sf):
    """Boxes of twelve-word chunks on their pages. Some chunks go off the page's words after four, some are not on it at all."""
    p, s = page_html(spark, sf), (F.col("doc_id") % 9).cast("int")
    piece = F.slice("w", s + 1, 12)
    text = F.when(s == 8, F.lit("no such-words here-at all")).when(s == 7, F.concat(F.array_join(F.slice("w", s + 1, 4), " "), F.lit(" and then others"))).otherwise(F.replace(F.array_join(piece, "  "), F.lit("e"), F.lit("E")))
    box = B.chunk_box(B.word_boxes("html"), F.when(s == 6, F.array_join(piece, " ")).otherwise(text))
    # a row for each box that is there: a filter would be moved below and every box be made twice
    return p.select("doc_id", F.inline(F.array_compact(F.array(box))))

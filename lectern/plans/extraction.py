"""Candidates out of chunks: made from parts in every form, and real chunks of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import pages, parsers
from lectern.operators import extraction as X
from lectern.plans.base import chunks_sql, query
from lectern.sources.stores import new_path
from lectern.sources.views import table

NL = "' || chr(10) || '"
SCHOOL = "CASE p_size % 9 WHEN 0 THEN 'abjuration' WHEN 1 THEN 'conjuration' WHEN 2 THEN 'Divination' WHEN 3 THEN 'enchantment' WHEN 4 THEN 'evocation' WHEN 5 THEN 'illusion' WHEN 6 THEN 'necromancy' WHEN 7 THEN 'transmutation' ELSE 'magic' END"
CR = "CASE p_size % 6 WHEN 0 THEN '1/4' WHEN 1 THEN '1/2' ELSE CAST(p_size AS STRING) END"
LADDER = NL.join(f"| {k} | +{2 + (k - 1) // 4} | Gain {k} |" for k in range(1, 20))
#: The text of a part's chunk by p_partkey % 14, as SQL that both engines run. Numbers and names come from the part, so some forms are broken: no such school, challenge 1/2 and so on.
TEXTS = (
    f"p_name || '{NL}Level ' || CAST(p_size AS STRING) || ' spell, ' || CAST(p_size % 10 AS STRING) || '-level ' || {SCHOOL} || CASE WHEN p_size % 3 = 0 THEN ' (ritual)' ELSE '' END || '{NL}Casting Time: ' || CAST(p_size AS STRING) || ' actions{NL}Range: 60 feet{NL}Components: V, S{NL}Duration: Concentration, 1 minute{NL}{NL}  ' || p_type || ' holds it.{NL}More of it. '",
    f"'Заклятие ' || p_name || '{NL}' || CAST(p_size % 10 AS STRING) || ' уровень, ' || CASE WHEN p_size % 2 = 0 THEN 'воплощение' ELSE 'вызов' END || '{NL}Время накладывания: 1 действие{NL}Дистанция: ' || CAST(p_size AS STRING) || ' футов{NL}Компоненты: В{NL}Длительность: мгновенная{NL}Свет.'",
    f"p_name || '{NL}3rd-level evocation{NL}Casting Time: 1 action{NL}Components: V{NL}Duration: 1 hour{NL}No range' || CASE WHEN p_size % 2 = 0 THEN '{NL}Range: self{NL}Late.' ELSE '' END",
    f"p_name || '{NL}' || CASE p_size % 4 WHEN 0 THEN 'Small' WHEN 1 THEN 'Huge' WHEN 2 THEN 'Round' ELSE 'Medium' END || ' ' || lower(p_brand) || CASE WHEN p_size % 5 = 0 THEN '' ELSE ', neutral evil' END || '{NL}Armor Class ' || CAST(10 + p_size % 10 AS STRING) || '{NL}Hit Points ' || CAST(p_size AS STRING) || ' (2d6){NL}Speed 30 ft.{NL}Challenge ' || {CR} || '{NL}It bites.{NL}Again.'",
    f"'Зверь ' || p_name || '{NL}Средний зверь, нейтральный{NL}Скорость 30 фт.{NL}Класс Доспеха 12{NL}Опасность 2{NL}Хиты ' || CAST(p_size AS STRING) || '{NL}Кусает.'",
    f"'Adventuring Gear{NL}| Name | Cost | Weight |{NL}|---|---|---|{NL}| ' || p_name || ' | ' || CAST(p_size AS STRING) || ' gp | 1 1/2 lb. |{NL}| Pin | 1/2 gp | - |{NL}|  | 1 cp | 1 lb. |{NL}| Coin | 1,250 cp | ' || CAST(p_size AS STRING) || ' lbs. |{NL}| broken |{NL}| late | 1 gp | 1 lb. |'",
    f"'Оружие простое{NL}| Название | Стоимость | Вес |{NL}| ' || p_name || ' | ' || CAST(p_size AS STRING) || ' зм | нет |' || CASE WHEN p_size % 4 = 0 THEN '' ELSE '{NL}| Нож | 2 см | 1 фнт |' END",
    f"p_name || '{NL}' || CASE WHEN p_size % 2 = 0 THEN 'Class' ELSE 'Subclass' END || '{NL}Hit Die: d' || CASE p_size % 5 WHEN 0 THEN '6' WHEN 1 THEN '8' WHEN 2 THEN '10' WHEN 3 THEN '12' ELSE '20' END || '{NL}Primary Ability: ' || p_brand || '{NL}Spellcasting Ability: none{NL}Parent Classes: ' || lower(p_brand) || ', other{NL}| Level | Bonus | Features |{NL}|---|---|---|{NL}{LADDER}' || CASE WHEN p_size % 7 = 0 THEN '' ELSE '{NL}| 20 | +6 | Gain 20 |' END || '{NL}The end'",
    f"p_name || '{NL}Species' || CASE WHEN p_size % 2 = 0 THEN ' Variant' ELSE '' END || '{NL}Size: ' || CASE WHEN p_size % 5 = 0 THEN 'vast' ELSE 'Large' END || '{NL}Speed: ' || CAST(p_size AS STRING) || ' feet{NL}Parent Species: ' || lower(p_brand) || '{NL}Trait: Far Sight | Sees Far | Sees to ' || CAST(p_size AS STRING) || ' miles | sight{NL}Trait: Calm | Calm of ' || p_brand",
    f"'Вид ' || p_name || '{NL}Вид{NL}Размер: средний{NL}Скорость: 30{NL}Черта: Зоркость | Зоркий глаз | Видит'",
    f"p_name || '{NL}' || CAST(p_size AS STRING) || 'th-Level Rogue Feature{NL}You strike ' || CAST(p_size AS STRING) || ' times.{NL}Twice.'",
    f"'Умение ' || p_name || '{NL}Умение плута ' || CAST(p_size AS STRING) || '-го уровня{NL}Удар.'",
    "p_name || ' is a ' || p_type",
    f"p_name || '{NL}Class{NL}Hit Die: d8{NL}no table'",
)
RUSSIAN = (1, 4, 6, 9, 11)
SEEDED = f"""SELECT 'p' || CAST(p_partkey AS STRING) AS chunk_id, CASE WHEN p_partkey % 14 IN {RUSSIAN} THEN 'ru' ELSE 'en' END AS language, p_partkey % 2000 + 1 AS page, p_brand AS heading,
 CASE p_partkey % 14 {' '.join(f'WHEN {k} THEN {t}' for k, t in enumerate(TEXTS))} END AS text FROM part"""


def chunks(spark, sf):
    """Chunks (chunk_id, language, page, heading, text): one of each part, and those of the documents."""
    seeded = spark.sql(SEEDED.replace("FROM part", "FROM {part}"), part=table(spark, sf, "part"))
    made = pages.chunked(table(spark, sf, "documents").select("doc_id", "text"))
    real = made.select(F.concat(F.lit("d"), "doc_id", F.lit(":"), "chunk_index").alias("chunk_id"), F.lit("en").alias("language"), (F.col("chunk_index") + 1).cast("int").alias("page"), F.lit("").alias("heading"), F.col("chunk").alias("text"))
    return seeded.unionByName(real)


def words_sql(table_: dict, column: str, whole: bool = False) -> str:
    """CASE of the first named word."""
    test = (lambda w: f"lower({column}) = '{w}'") if whole else (lambda w: f"contains(lower({column}), '{w}')")
    return "CASE " + " ".join(f"WHEN {' OR '.join(map(test, forms))} THEN '{k}'" for k, forms in table_.items()) + " END"


def line_sql(name: str, test: str) -> str:
    """The first line that passes."""
    return f"min(i) FILTER ({test}) AS {name}"


def label_sql(field: str, rest: str) -> str:
    en, ru = parsers.LABELS[field]
    return f"regexp_matches(x, CASE language WHEN 'ru' THEN '(?i)^(?:{ru})\\s*{rest}' ELSE '(?i)^(?:{en})\\s*{rest}' END)"


CASTING, CREATURE = ("castingTime", "range", "components", "duration"), {"armorClass": ":?[ \\t]*\\d", "hitPoints": ":?[ \\t]*\\d", "speed": ":?[ \\t]*.", "challengeRating": ":?[ \\t]*(?:1/[248]|\\d)"}
#: What each chunk's lines say, as SQL of its own: marks by line, then the first kind whose marks are all there.
PARSED = rf"""source AS MATERIALIZED ({SEEDED} UNION ALL SELECT 'd' || doc_id || ':' || k, 'en', CAST(k + 1 AS INTEGER), '', chunk FROM chunks WHERE NOT gone),
 lines AS MATERIALIZED (SELECT chunk_id, language, x, row_number() OVER (PARTITION BY chunk_id ORDER BY j) - 1 AS i FROM (SELECT chunk_id, language, trim(unnest(string_split(text, chr(10)))) AS x, unnest(range(len(string_split(text, chr(10))))) AS j FROM source) WHERE x <> ''),
 marks AS (SELECT chunk_id, any_value(language) AS language, count(*) AS n, list(x ORDER BY i) AS xs,
   {line_sql('d', "(" + words_sql(parsers.SCHOOLS, 'x') + ") IS NOT NULL AND (regexp_matches(x, '(?i)cantrip|заговор') OR regexp_matches(x, '(?i)[0-9](?:st|nd|rd|th|-й|-го)?(?:\\s*-?level|\\s+уров)'))")},
   {', '.join(line_sql('s_' + f, label_sql(f, ':\\s*.')) for f in CASTING)}, {', '.join(line_sql('c_' + f, label_sql(f, r)) for f, r in CREATURE.items())},
   {line_sql('h', "contains(x, '|') AND regexp_matches(x, CASE language WHEN 'ru' THEN '(?i)Стоимость' ELSE '(?i)Cost' END)")},
   {line_sql('k', "regexp_matches(x, '(?i)^(?:Class|Класс|Subclass|Подкласс)$')")}, {line_sql('t', "contains(x, '|') AND regexp_matches(x, '(?i)Level|Уровень') AND regexp_matches(x, '(?i)Features|Умения')")},
   {line_sql('die', "regexp_matches(x, '(?i)^Hit Die\\s*:\\s*.*d?(6|8|10|12)')")}, {line_sql('ability', "regexp_matches(x, '(?i)^Primary Ability\\s*:\\s*.')")},
   {line_sql('s', "regexp_matches(x, '(?i)^(?:Species|Вид|Раса)(?: Variant| Вариант)?$')")}, {line_sql('sized', f"regexp_matches(x, '(?i)^(?:Size|Размер)\\s*:') AND (" + words_sql(parsers.SIZES, "trim(regexp_replace(x, '^[^:]*:', ''))", True) + ") IS NOT NULL")},
   {line_sql('sped', "regexp_matches(x, '(?i)^(?:Speed|Скорость)\\s*:\\s*\\d')")},
   {line_sql('f', "regexp_matches(x, CASE language WHEN 'ru' THEN '(?i)Умение .+ \\d+(?:-го|-й) уровня' ELSE '(?i)\\d+(?:st|nd|rd|th)-Level .+ Feature' END)")} FROM lines GROUP BY chunk_id),
 rows_ AS (SELECT l.chunk_id, l.i, l.x, list_transform(string_split(regexp_replace(l.x, '^\||\|$', '', 'g'), '|'), lambda c: trim(c)) AS cells, list_transform(string_split(regexp_replace(m.xs[m.h + 1], '^\||\|$', '', 'g'), '|'), lambda c: trim(c)) AS head FROM lines l JOIN marks m USING (chunk_id) WHERE l.i > m.h AND NOT regexp_matches(l.x, '^\|?\s*:?-{{3}}')),
 goods AS (SELECT chunk_id, i, x, cells[list_position(head, CASE WHEN list_contains(head, 'Name') THEN 'Name' ELSE 'Название' END)] AS title, cells[list_position(head, CASE WHEN list_contains(head, 'Cost') THEN 'Cost' ELSE 'Стоимость' END)] AS cost FROM rows_ r
   WHERE len(cells) = len(head) AND (list_contains(head, 'Weight') OR list_contains(head, 'Вес')) AND i < coalesce((SELECT min(b.i) FROM rows_ b WHERE b.chunk_id = r.chunk_id AND len(b.cells) <> len(b.head)), 1000000)),
 ladder AS (SELECT l.chunk_id, list(try_cast(list_transform(string_split(regexp_replace(l.x, '^\||\|$', '', 'g'), '|'), lambda c: trim(c))[1] AS INTEGER) ORDER BY l.i) AS levels FROM lines l JOIN marks m USING (chunk_id) WHERE l.i > m.t AND contains(l.x, '|') AND NOT regexp_matches(l.x, '^\|?\s*:?-{{3}}') GROUP BY l.chunk_id),
 kinds AS MATERIALIZED (SELECT m.*, least(c_armorClass, c_hitPoints, c_speed, c_challengeRating) AS c0, CASE
   WHEN n >= 7 AND d >= 1 AND s_castingTime + s_range + s_components + s_duration IS NOT NULL AND greatest(d, s_castingTime, s_range, s_components, s_duration) < n - 1 THEN 'spell'
   WHEN n >= 7 AND c_armorClass + c_hitPoints + c_speed + c_challengeRating IS NOT NULL AND least(c_armorClass, c_hitPoints, c_speed, c_challengeRating) >= 2 AND greatest(c_armorClass, c_hitPoints, c_speed, c_challengeRating) < n - 1
     AND ({words_sql(parsers.SIZES, "regexp_extract(xs[least(c_armorClass, c_hitPoints, c_speed, c_challengeRating)], '^(\\p{L}+)\\s+[^,]+', 1)", True)}) IS NOT NULL THEN 'creature'
   WHEN EXISTS (SELECT 1 FROM goods g WHERE g.chunk_id = m.chunk_id AND g.title <> '') AND list_has_any(list_transform(xs[:h], lambda y: ({words_sql(parsers.CATEGORIES, 'y')}) IS NOT NULL), [true]) THEN 'equipment'
   WHEN k >= 1 AND die IS NOT NULL AND ability IS NOT NULL AND levels = range(1, 21) THEN 'class' WHEN s >= 1 AND sized IS NOT NULL AND sped IS NOT NULL THEN 'species'
   WHEN n >= 3 AND f >= 1 AND f < n - 1 AND CAST(regexp_extract(xs[f + 1], CASE language WHEN 'ru' THEN '(?i)(\d+)(?:-го|-й) уровня' ELSE '(?i)(\d+)(?:st|nd|rd|th)-Level' END, 1) AS INTEGER) BETWEEN 1 AND 20 THEN 'feature' END AS type
   FROM marks m LEFT JOIN ladder l USING (chunk_id))"""
HEAD = "WITH RECURSIVE " + chunks_sql("documents", "doc_id") + ", " + PARSED


@query(
    "x_02_dispatch",
    HEAD + """ SELECT chunk_id, type, CASE type WHEN 'spell' THEN 'spell-parser' WHEN 'creature' THEN 'stat-block-parser' WHEN 'class' THEN 'table-parser' ELSE 'section-parser' END AS method, 0 AS n,
     xs[CASE type WHEN 'spell' THEN d WHEN 'creature' THEN c0 - 1 WHEN 'class' THEN k WHEN 'species' THEN s ELSE f END] AS title FROM kinds WHERE type <> 'equipment'
     UNION ALL SELECT chunk_id, 'equipment', 'table-parser', CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY i) - 1 AS INTEGER), title FROM goods WHERE title <> '' AND chunk_id IN (SELECT chunk_id FROM kinds WHERE type = 'equipment')""",
)
def x_02(spark, sf):
    """What the first fitting parser makes of each chunk."""
    return X.extracted(chunks(spark, sf)).select("chunk_id", "type", "method", "n", "title")


@query(
    "x_05_progressions",
    HEAD + """ SELECT chunk_id, xs[k] AS title, lv.level, c.name AS "column", c.cell FROM kinds, (SELECT unnest(range(1, 21)) AS level) lv, LATERAL (SELECT unnest(['bonus', 'features']) AS name, unnest(
     list_transform(string_split(regexp_replace(list_filter(xs, lambda y: regexp_matches(y, '^\\|\\s*' || lv.level || '\\s*\\|'))[1], '^\\||\\|$', '', 'g'), '|'), lambda y: trim(y))[2:3]) AS cell) c WHERE type = 'class'""",
)
def x_05(spark, sf):
    """The levels of every class that has all twenty, cell by cell."""
    return X.progression_rows(X.extracted(chunks(spark, sf)))


@query(
    "x_05_traits",
    HEAD + r""" SELECT chunk_id, xs[s] AS title, CASE WHEN regexp_matches(xs[s + 1], '(?i)variant|вариант') THEN 'variant' ELSE 'species' END AS kind, coalesce(regexp_extract(list_filter(xs, lambda y: regexp_matches(y, '(?i)^Parent Species\s*:'))[1], ':\s*(.*)$', 1), '') AS parents,
     CASE p[1] WHEN 'Зоркость' THEN 'zorkost' ELSE regexp_replace(lower(p[1]), '[^a-z0-9]+', '-', 'g') END AS key, p[2] AS trait, p[4] AS overrides
     FROM (SELECT *, list_transform(string_split(regexp_replace(unnest(list_filter(xs, lambda y: regexp_matches(y, '(?i)^(?:Trait|Черта)\s*:'))), '(?i)^(?:Trait|Черта)\s*:\s*', ''), '|'), lambda y: trim(y)) AS p FROM kinds WHERE type = 'species')""",
)
def x_05_traits(spark, sf):
    """The traits of every species and variant, with parents and what they override."""
    return X.trait_rows(X.extracted(chunks(spark, sf)))


def broken(candidates):
    """Some candidates made worse: a title's span moved by one, the last citation dropped, a field that the schema doesn't know."""
    k = F.regexp_extract("chunk_id", "^p([0-9]+)$", 1).try_cast("int")
    moved = F.transform("citations", lambda c: F.when((k % 11 == 0) & (c["field"] == "$.title"), c.withField("start", c["start"] + 1).withField("stop", c["stop"] + 1)).otherwise(c))
    cited = F.when(k % 13 == 0, F.slice(moved, 1, F.size(moved) - 1)).otherwise(moved)
    more = F.when(k % 17 == 0, F.regexp_replace("attributes", r"\}$", ',"colour":"red"}')).otherwise(F.col("attributes"))
    return candidates.withColumns({"citations": cited, "attributes": more})


def judged(spark, sf):
    return X.judged(broken(X.extracted(chunks(spark, sf))))


LAST = "CASE type WHEN 'spell' THEN 'duration' WHEN 'creature' THEN 'challengeRating' WHEN 'equipment' THEN 'weightLb' WHEN 'feature' THEN 'featureKind' ELSE 'crossLinks' END"
#: Candidates with their faults, by rules over the parts: which challenges there are, which Russian words name no kind, which weights can't be read.
FAULTS = (
    PARSED
    + f""", cands AS (SELECT chunk_id, type, 0 AS n, xs[CASE type WHEN 'spell' THEN d WHEN 'creature' THEN c0 - 1 WHEN 'class' THEN k WHEN 'species' THEN s ELSE f END] AS title, '' AS row_ FROM kinds WHERE type <> 'equipment'
   UNION ALL SELECT chunk_id, 'equipment', CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY i) - 1 AS INTEGER), title, x FROM goods WHERE title <> '' AND chunk_id IN (SELECT chunk_id FROM kinds WHERE type = 'equipment')),
 known AS (SELECT c.*, language, page, heading, p_partkey, p_size, p_partkey % 14 AS form, p_brand FROM cands c JOIN source USING (chunk_id) LEFT JOIN part ON chunk_id = 'p' || p_partkey),
 schema_ AS (SELECT *, list_filter([CASE WHEN p_partkey % 17 = 0 THEN '$.attributes.colour additional' END, CASE WHEN type = 'creature' AND form = 3 AND p_size > 30 AND p_size % 6 > 1 THEN '$.attributes.challengeRating choice' END], lambda x: x IS NOT NULL) AS shape FROM known),
 faults AS MATERIALIZED (SELECT *, array_to_string(CASE WHEN len(shape) > 0 THEN list_sort(shape) ELSE list_sort(list_filter([CASE WHEN p_partkey % 11 = 0 THEN '$.title quote' END, CASE WHEN p_partkey % 13 = 0 THEN '$.attributes.' || {LAST} || ' uncited' END,
   CASE WHEN type = 'species' AND language = 'ru' THEN '$.attributes.kind unsupported' END, CASE WHEN type = 'species' AND language = 'ru' THEN '$.attributes.traits unsupported' END,
   CASE WHEN type = 'equipment' AND contains(row_, 'фнт') AND p_partkey % 13 <> 0 THEN '$.attributes.weightLb unsupported' END], lambda x: x IS NOT NULL)) END, ';') AS issues FROM schema_)"""
)
FAULTY = "WITH RECURSIVE " + chunks_sql("documents", "doc_id") + ", " + FAULTS


@query("x_06_candidate_faults", FAULTY + " SELECT chunk_id, n, type, title, issues FROM faults")
def x_06(spark, sf):
    """Every candidate with the paths and rules that it breaks: shape first, then evidence."""
    told = F.array_join(F.transform("issues", lambda i: F.concat_ws(" ", i["path"], i["rule"])), ";")
    return judged(spark, sf).select("chunk_id", "n", "type", "title", told.alias("issues"))


def staged(spark, sf):
    """Judged candidates with where they come from, and what may be done with them; a written table that all outputs are made from."""
    k = F.regexp_extract("chunk_id", "^p([0-9]+)$", 1).try_cast("int")
    origin = F.when(k % 10 == 7, "other").when(k % 10 == 8, "collector_snapshot").when(k % 10 == 9, "static_guide").otherwise("pdf_extraction")
    held = judged(spark, sf).withColumns(
        {
            "origin": origin,
            "generation_id": F.when(F.coalesce(k % 23, F.lit(1)) != 0, "g1"),
            "page": F.when(F.coalesce(k % 19, F.lit(1)) != 0, F.col("page")),
            "captured": F.md5("heading"),
            "reviewed": F.when(k % 3 == 0, F.md5("chunk_id")).otherwise(F.md5("heading")),
        }
    )
    path = new_path(spark, "candidates")
    X.capability(held).write.parquet(path)
    return spark.read.parquet(path)


STAGED = (
    FAULTS
    + """, origins AS (SELECT *, CASE p_partkey % 10 WHEN 7 THEN 'other' WHEN 8 THEN 'collector_snapshot' WHEN 9 THEN 'static_guide' ELSE 'pdf_extraction' END AS origin FROM faults),
 staged AS MATERIALIZED (SELECT *, CASE WHEN origin = 'other' THEN 'unsupported origin' WHEN origin = 'static_guide' THEN 'needs extraction from chunks' WHEN origin = 'pdf_extraction' AND p_partkey % 23 = 0 THEN 'no generation or chunk'
   WHEN issues <> '' THEN 'needs repair: ' || split_part(issues, ';', 1) WHEN origin = 'collector_snapshot' AND p_partkey % 3 = 0 THEN 'file changed since its review' WHEN origin = 'pdf_extraction' AND p_partkey % 19 = 0 THEN 'no source page' END AS block_reason FROM origins),
 keyed AS (SELECT *, trim(regexp_replace(lower(replace(replace(replace(replace(replace(title, 'Заклятие', 'zaklyatie'), 'Зверь', 'zver'), 'Вид', 'vid'), 'Умение', 'umenie'), 'Нож', 'nozh')), '[^a-z0-9]+', '-', 'g'), '-') AS key FROM staged WHERE block_reason IS NULL),
 one AS (SELECT type || '-' || key AS entry_id, unnest(arg_min(struct_pack(chunk_id, n, type, title, p_size, form, row_, page, heading), (chunk_id, n))) FROM keyed GROUP BY 1)"""
)
PUBLISHED = "WITH RECURSIVE " + chunks_sql("documents", "doc_id") + ", " + STAGED


@query("x_10_capability", PUBLISHED + " SELECT chunk_id, n, origin, CASE WHEN block_reason IS NULL THEN 'publishable' ELSE 'requires_extraction' END AS capability, block_reason FROM staged")
def x_10(spark, sf):
    """Whether each candidate may be published, and if not, why."""
    return staged(spark, sf).select("chunk_id", "n", "origin", "capability", "block_reason")


@query(
    "x_10_publication",
    PUBLISHED
    + """ SELECT entry_id, CASE type WHEN 'class' THEN 'classFeature' WHEN 'feature' THEN 'classFeature' WHEN 'creature' THEN 'monster' WHEN 'species' THEN 'other' ELSE type END AS entry_type, title AS name, chunk_id,
     regexp_replace(lower(trim(title)), '[-_\\s.,/:;!?()]+', '-', 'g') AS normalized, CASE type WHEN 'spell' THEN 8 WHEN 'creature' THEN CASE WHEN form = 3 AND p_size % 5 = 0 THEN 6 ELSE 7 END WHEN 'class' THEN 8 WHEN 'species' THEN 6 WHEN 'feature' THEN 2
       ELSE 3 - CASE WHEN regexp_matches(row_, '\\|\\s*(?:-|нет)\\s*\\|$') THEN 1 ELSE 0 END END AS n_fields,
     CASE type WHEN 'spell' THEN 12 WHEN 'creature' THEN 11 WHEN 'equipment' THEN 7 WHEN 'class' THEN 13 WHEN 'species' THEN 10 ELSE 6 END AS n_citations, heading || ' [chunk ' || chunk_id || ']' AS section, 'evidence-title-1' AS title_citation FROM one""",
)
def x_10_publication(spark, sf):
    """The tables that publishing makes, joined: revisions with their names, and how many typed fields and citations each has."""
    published = X.revisions(staged(spark, sf))
    fields = X.field_rows(published).groupBy("entry_id").agg(F.count(F.lit(1)).alias("n_fields"))
    cites = X.citation_rows(published).groupBy("entry_id").agg(F.count(F.lit(1)).alias("n_citations"), F.first("section").alias("section"), F.max(F.when(F.col("field") == "$.title", F.col("citation_id"))).alias("title_citation"))
    names = X.name_rows(published).select("entry_id", "name", "normalized")
    return published.select("entry_id", "entry_type", "chunk_id").join(names, "entry_id").join(fields, "entry_id").join(cites, "entry_id")


@query("x_10_fields", PUBLISHED + """ SELECT entry_id, 'level' AS key, 'number' AS kind, regexp_extract(title || ' ' || CASE form WHEN 2 THEN '3' ELSE CAST(CASE WHEN type = 'feature' THEN p_size ELSE p_size % 10 END AS VARCHAR) END, '([0-9]+)$', 1) AS value FROM one WHERE type IN ('spell', 'feature')
 UNION ALL SELECT entry_id, 'hit-points', 'number', CAST(p_size AS VARCHAR) FROM one WHERE type = 'creature' UNION ALL SELECT entry_id, 'progression-rows', 'list', '20' FROM one WHERE type = 'class'""")
def x_10_fields(spark, sf):
    """The typed fields of published entries that are called level, hit points or progression rows (of which the number is given)."""
    held = X.field_rows(X.revisions(staged(spark, sf))).where(F.col("key").isin("level", "hit-points", "progression-rows"))
    return held.select("entry_id", "key", "kind", F.when(F.col("kind") == "list", F.json_array_length("value").cast("string")).otherwise(F.col("value")).alias("value"))


@query("v_04_levels", FAULTY + """, seen AS (SELECT chunk_id, list(try_cast(regexp_extract(x, '^\\|\\s*([0-9]+)\\s*\\|', 1) AS INTEGER) ORDER BY i) AS found FROM lines WHERE regexp_matches(x, '^\\|\\s*[0-9]+\\s*\\| \\+') GROUP BY chunk_id)
 SELECT chunk_id, len(found) AS n_levels, array_to_string(list_filter(range(1, 21), lambda y: len(list_filter(found, lambda z: z = y)) <> 1), ',') AS gaps FROM seen""")
def v_04(spark, sf):
    """The ladders of level rows in all chunks: how many levels they name, and which of the twenty are missing or repeated."""
    rows = chunks(spark, sf).select("chunk_id", F.explode(parsers.lines_of("text")).alias("x")).where(F.rlike("x", F.lit(r"^\|\s*[0-9]+\s*\| \+")))
    levels = rows.select("chunk_id", F.regexp_extract("x", r"^\|\s*([0-9]+)\s*\|", 1).cast("int").alias("level")).groupBy("chunk_id", "level").agg(F.count(F.lit(1)).alias("n"))
    held = levels.groupBy("chunk_id").agg(F.sum("n").alias("n_levels"), F.collect_set(F.when(F.col("n") == 1, F.col("level"))).alias("once"))
    gaps = F.array_sort(F.array_except(F.sequence(F.lit(1), F.lit(parsers.LEVELS)), "once"))
    return held.select("chunk_id", "n_levels", F.array_join(gaps.cast("array<string>"), ",").alias("gaps"))

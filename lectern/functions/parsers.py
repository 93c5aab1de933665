"""Typed candidates out of chunks of text, as Columns: labelled blocks, tables and sections, tried in order.

A chunk is read as lines (trimmed, blank ones left out). Each parser gives an
array of candidates, or null if the chunk is not of its kind. A candidate has
type, method, title, body, attributes (JSON) and citations (field, quote):
every field is cited by words of the chunk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import col, fraction, let, stable_slug

CANDIDATE = "array<struct<type:string,method:string,title:string,body:string,attributes:string,citations:array<struct<field:string,quote:string>>>>"
#: Words of both languages for what a block can name.
SCHOOLS = {
    "abjuration": ("abjuration", "ограждение"), "conjuration": ("conjuration", "вызов"), "divination": ("divination", "прорицание"), "enchantment": ("enchantment", "очарование"),
    "evocation": ("evocation", "воплощение"), "illusion": ("illusion", "иллюзия"), "necromancy": ("necromancy", "некромантия"), "transmutation": ("transmutation", "преобразование"),
}
SIZES = {
    "tiny": ("tiny", "крошечный", "крошечное", "крошечная"), "small": ("small", "маленький", "маленькое", "маленькая"), "medium": ("medium", "средний", "среднее", "средняя"),
    "large": ("large", "большой", "большое", "большая"), "huge": ("huge", "огромный", "огромное", "огромная"), "gargantuan": ("gargantuan", "громадный", "громадное", "громадная"),
}
CATEGORIES = {
    "adventuring_gear": ("adventuring gear", "снаряжение"), "ammunition": ("ammunition", "боеприпасы"), "armor": ("armor", "доспехи"), "focus": ("focus", "фокусировка"), "mount": ("mount", "верховые животные"),
    "tool": ("tool", "инструменты"), "vehicle": ("vehicle", "транспорт"), "weapon": ("weapon", "оружие"), "other": ("other", "прочее"),
}
LABELS = {
    "castingTime": ("Casting Time", "Время накладывания|Время сотворения"), "range": ("Range", "Дистанция|Дальность"), "components": ("Components", "Компоненты"), "duration": ("Duration", "Длительность"),
    "armorClass": ("Armor Class", "Класс Доспеха"), "hitPoints": ("Hit Points", "Хиты"), "speed": ("Speed", "Скорость"), "challengeRating": ("Challenge", "Опасность|Показатель опасности"),
}
EITHER = {
    "hitDie": "Hit Die|Кость хитов", "primaryAbility": "Primary Ability|Основная характеристика", "spellcastingAbility": "Spellcasting Ability|Заклинательная характеристика",
    "parentClassIds": "Parent Classes|Родительские классы", "size": "Size|Размер", "speed": "Speed|Скорость", "parentSpeciesIds": "Parent Species|Родительский вид", "traits": "Trait|Черта",
}
COINS = {"cp": 1, "sp": 10, "gp": 100, "pp": 1000, "мм": 1, "см": 10, "зм": 100, "пм": 1000}
LEVELS = 20


def rule(pattern: str) -> Column:
    return F.lit(f"(?iu){pattern}")


def group(text: Column, pattern: str, n: int = 1) -> Column:
    """A group of the first match; null without a match."""
    return F.when(F.rlike(text, rule(pattern)), F.regexp_extract(text, f"(?iu){pattern}", n))


def lines_of(text: str | Column) -> Column:
    """Array of the trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(col(text), "\r?\n"), lambda x: F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), lambda x: x != "")


def place(lines: Column, pattern: str) -> Column:
    """Where the first line that matches stands, from 0; null if there is none."""
    return F.get(F.filter(F.transform(lines, lambda x, k: F.when(F.rlike(x, rule(pattern)), k)), lambda k: k.isNotNull()), F.lit(0))


def value_of(lines: Column, pattern: str) -> Column:
    """The trimmed first group of the first line that matches."""
    return F.trim(group(F.get(lines, place(lines, pattern)), pattern))


def named(text: Column, words: dict[str, tuple[str, ...]], whole: bool = False) -> Column:
    """The first of ``words`` whose form is in the text (or is it), without regard to case."""
    low = F.lower(text)
    tests = [(k, reduce(lambda a, b: a | b, [(low == w) if whole else F.contains(low, F.lit(w)) for w in forms])) for k, forms in words.items()]
    return reduce(lambda c, t: F.when(t[1], t[0]).otherwise(c), reversed(tests), F.lit(None).cast("string"))


def json_of(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def cited(title: Column, body: Column, kind: Column, fields: dict[str, Column]) -> Column:
    base = {"$.entryType": kind, "$.candidateKey": title, "$.title": title, "$.body": body}
    both = base | {f"$.attributes.{k}": q for k, q in fields.items()}
    return F.array(*[F.struct(F.lit(k).alias("field"), q.alias("quote")) for k, q in both.items()])


def candidate(kind: str, method: str, title: Column, body: Column, attributes: Column, citations: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(method).alias("method"), title.alias("title"), body.alias("body"), attributes.alias("attributes"), citations.alias("citations"))


def label(field: str, russian: Column, value: str) -> list[tuple[Column, str]]:
    """The two languages' rules of a labelled line with their conditions."""
    en, ru = LABELS[field]
    return [(russian, rf"^(?:{ru})\s*{value}"), (~russian, rf"^(?:{en})\s*{value}")]


def labelled(lines: Column, russian: Column, field: str, value: str) -> Column:
    """(at, line, value) of the first line with the field's label in the text's language; at is null without one."""

    def read(pattern: str) -> Column:
        return let(place(lines, pattern), lambda k: F.struct(k.alias("at"), F.get(lines, k).alias("line"), F.trim(group(F.get(lines, k), pattern)).alias("value")))

    (_, ru), (_, en) = label(field, russian, value)
    return F.when(russian, read(ru)).otherwise(read(en))


def level_of(line: Column) -> Column:
    """The level that a spell's descriptor states, 0 for a cantrip."""
    stated = group(line, r"([0-9])(?:st|nd|rd|th|-й|-го)?(?:\s*-?level|\s+уров)").cast("int")
    return F.when(F.rlike(line, rule("cantrip|заговор")), 0).otherwise(stated)


def spell(text: Column, lines: Column, russian: Column) -> Column:
    """A spell: a descriptor with school and level below the title, four labelled lines, a body after the last of them."""
    descriptors = F.filter(F.transform(lines, lambda x, k: F.when(named(x, SCHOOLS).isNotNull() & level_of(x).isNotNull(), k)), lambda k: k.isNotNull())
    fields = ("castingTime", "range", "components", "duration")
    found = F.struct(F.get(descriptors, F.lit(0)).alias("d"), *[labelled(lines, russian, f, r":\s*(.+)$").alias(f) for f in fields])

    def build(s: Column) -> Column:
        line, title = F.get(lines, s["d"]), F.get(lines, s["d"] - 1)
        last = F.greatest(s["d"], *[s[f]["at"] for f in fields])
        body = tail_of(text, lines, last + 1)
        ritual = F.rlike(line, rule("ritual|ритуал"))
        lasting = F.rlike(s["duration"]["value"], rule("concentration|концентрац"))
        attributes = json_of(
            level=level_of(line), school=named(line, SCHOOLS), castingTime=s["castingTime"]["value"], range=s["range"]["value"], duration=s["duration"]["value"],
            components=s["components"]["value"], concentration=lasting, ritual=ritual,
        )
        quotes = {"level": line, "school": line, "ritual": line, "concentration": s["duration"]["line"]} | {f: s[f]["line"] for f in fields}
        whole = (F.size(lines) >= 7) & (s["d"] >= 1) & (last + 1 < F.size(lines))
        for f in fields:
            whole = whole & s[f]["at"].isNotNull()
        return F.when(whole, F.array(candidate("spell", "spell-parser", title, body, attributes, cited(title, body, line, quotes))))

    return let(found, build)


def tail_of(text: Column, lines: Column, k: Column) -> Column:
    """The text from its line ``k`` (of those not blank) to the end of the last, blanks and all between them as they stand."""
    raw = F.split(text, "\n")
    held = F.filter(F.transform(raw, lambda x, i: F.when(F.rlike(x, F.lit(r"[^\s\p{Z}]")), i)), lambda i: i.isNotNull())
    joined = F.array_join(F.slice(raw, F.get(held, k) + 1, F.size(raw)), "\n")
    return F.when(k < F.size(lines), F.regexp_replace(joined, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def creature(text: Column, lines: Column, russian: Column) -> Column:
    """A stat block: title, a line of size, kind and alignment, then the labelled numbers in any order, then the body."""
    values = {"armorClass": r":?[ \t]*(\d+)", "hitPoints": r":?[ \t]*(\d+)", "speed": r":?[ \t]*(.+)$", "challengeRating": r":?[ \t]*(1/[248]|\d+)"}
    found = F.struct(*[labelled(lines, russian, f, v).alias(f) for f, v in values.items()])

    def build(s: Column) -> Column:
        first, last = F.least(*[s[f]["at"] for f in values]), F.greatest(*[s[f]["at"] for f in values])
        line, title = F.get(lines, first - 1), F.get(lines, first - 2)
        shape = r"^(\p{L}+)\s+([^,]+)(?:,\s*(.+))?$"
        size, body = named(group(line, shape), SIZES, whole=True), tail_of(text, lines, last + 1)
        alignment = F.trim(group(line, shape, 3))
        attributes = json_of(
            size=size, creatureType=F.trim(group(line, shape, 2)), alignment=F.when(alignment != "", alignment), armorClass=s["armorClass"]["value"].try_cast("bigint"),
            hitPoints=s["hitPoints"]["value"].try_cast("bigint"), challengeRating=fraction(s["challengeRating"]["value"]), speed=s["speed"]["value"],
        )
        quotes = {"size": line, "creatureType": line, "alignment": line} | {f: s[f]["line"] for f in values}
        whole = (F.size(lines) >= 7) & (first >= 2) & size.isNotNull() & (last + 1 < F.size(lines))
        for f in values:
            whole = whole & s[f]["at"].isNotNull()
        return F.when(whole, F.array(candidate("creature", "stat-block-parser", title, body, attributes, cited(title, body, line, quotes))))

    return let(found, build)


def cells(line: Column) -> Column:
    """The trimmed cells of a table row."""
    return F.transform(F.split(F.regexp_replace(line, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))


def leading(values: Column, ok) -> Column:
    """``values`` up to the first that is not ``ok``."""
    bad = F.array_position(F.transform(values, lambda v: F.coalesce(ok(v), F.lit(False))), F.lit(False)).cast("int")
    return F.when(bad > 0, F.slice(values, 1, bad - 1)).otherwise(values)


def copper(text: Column) -> Column:
    """The first amount of money in a text, in the smallest coin; null if there is none or it isn't whole."""
    shape = rf"((?:\d{{1,3}}(?:[ ,]\d{{3}})+|\d+)(?:[.,]\d+)?|\d+\s*/\s*\d+)\s*({'|'.join(COINS)})(?!\p{{L}})"
    written = F.regexp_replace(group(text, shape), r"\s*/\s*", "/")
    grouped = F.rlike(written, F.lit(r"^\d{1,3}([ ,]\d{3})+(\.\d+)?$"))
    flat = F.when(grouped, F.regexp_replace(written, "[ ,]", "")).otherwise(F.regexp_replace(written, ",", "."))
    top, bottom = F.regexp_extract(flat, r"^(\d+)/", 1).try_cast("double"), F.regexp_extract(flat, r"/(\d+)$", 1).try_cast("double")
    amount = F.when(F.contains(flat, F.lit("/")), F.try_divide(top, bottom)).otherwise(flat.try_cast("double"))
    coin = F.lower(group(text, shape, 2))
    worth = amount * reduce(lambda c, kv: F.when(coin == kv[0], float(kv[1])).otherwise(c), COINS.items(), F.lit(None).cast("double"))
    return F.when(worth == F.floor(worth), worth.cast("bigint"))


def pounds(text: Column) -> Column:
    """The first weight in a text; null if there is none or it is a dash."""
    shape = r"(?:(\d+)\s+)?(\d+\s*/\s*\d+|\d+(?:[.,]\d+)?)\s*(?:lb\.?|lbs\.?|фунт(?:а|ов)?|фт\.?)"
    part = F.regexp_replace(F.regexp_replace(group(text, shape, 2), r"\s*/\s*", "/"), ",", ".")
    top, bottom = F.regexp_extract(part, r"^(\d+)/", 1).try_cast("double"), F.regexp_extract(part, r"/(\d+)$", 1).try_cast("double")
    value = F.when(F.contains(part, F.lit("/")), F.try_divide(top, bottom)).otherwise(part.try_cast("double"))
    return value + F.coalesce(group(text, shape, 1).try_cast("double"), F.lit(0.0))


def equipment(text: Column, lines: Column, russian: Column) -> Column:
    """The rows of the first table with a cost, up to a row of another width; a line above it names the category."""
    cost = [r"\|.*Стоимость|Стоимость.*\|", r"\|.*Cost|Cost.*\|"]
    found = F.struct(F.when(russian, place(lines, cost[0])).otherwise(place(lines, cost[1])).alias("h"))

    def spot(header: Column, forms: str) -> Column:
        return F.get(F.filter(F.transform(header, lambda c, k: F.when(F.rlike(c, rule(f"^(?:{forms})$")), k)), lambda k: k.isNotNull()), F.lit(0))

    def build(s: Column) -> Column:
        header = cells(F.get(lines, s["h"]))
        above = F.filter(F.reverse(F.slice(lines, 1, F.coalesce(s["h"], F.lit(0)))), lambda x: named(x, CATEGORIES).isNotNull())
        below = F.slice(lines, F.coalesce(s["h"], F.lit(0)) + 2, F.size(lines))
        rows = leading(F.filter(below, lambda x: ~F.rlike(x, F.lit(r"^\|?\s*:?-{3}"))), lambda x: F.size(cells(x)) == F.size(header))
        at = F.struct(spot(header, "Name|Название|Предмет").alias("name"), spot(header, "Cost|Стоимость|Цена").alias("cost"), spot(header, "Weight|Вес").alias("weight"), F.get(above, F.lit(0)).alias("line"), rows.alias("rows"))

        def made(a: Column) -> Column:
            def row(line: Column) -> Column:
                c, kind = cells(line), named(a["line"], CATEGORIES)
                title = F.get(c, a["name"])
                attributes = json_of(category=kind, costCp=copper(F.get(c, a["cost"])), weightLb=F.when(~F.rlike(F.get(c, a["weight"]), rule("^(?:-|—|нет)$")), pounds(F.get(c, a["weight"]))))
                return candidate("equipment", "table-parser", title, line, attributes, cited(title, line, F.get(lines, s["h"]), {"category": a["line"], "costCp": line, "weightLb": line}))

            out = F.transform(F.filter(a["rows"], lambda x: F.get(cells(x), a["name"]) != ""), row)
            known = a["name"].isNotNull() & a["cost"].isNotNull() & a["weight"].isNotNull() & a["line"].isNotNull()
            return F.when(known & (F.size(out) > 0), out)

        return F.when(s["h"].isNotNull(), let(at, made))

    return let(found, build)


def progression(text: Column, lines: Column, russian: Column) -> Column:
    """A class or subclass: hit die, abilities, parents, and a table of exactly LEVELS levels in order."""
    found = F.struct(
        place(lines, "^(?:Class|Класс|Subclass|Подкласс)$").alias("k"),
        place(lines, r"^(?=.*\|)(?=.*(?:Level|Уровень))(?=.*(?:Features|Умения))").alias("h"),
        *[value_of(lines, rf"^(?:{EITHER[f]})\s*:\s*(.+)$").alias(f) for f in ("hitDie", "primaryAbility", "spellcastingAbility", "parentClassIds")],
    )

    def build(s: Column) -> Column:
        header = cells(F.get(lines, s["h"]))
        spot = F.get(F.filter(F.transform(header, lambda c, k: F.when(F.rlike(c, rule("^(?:Level|Уровень)$")), k)), lambda k: k.isNotNull()), F.lit(0))
        below = F.filter(F.slice(lines, F.coalesce(s["h"], F.lit(0)) + 2, F.size(lines)), lambda x: ~F.rlike(x, F.lit(r"^\|?\s*:?-{3}")))

        def made(a: Column) -> Column:
            def level(line: Column) -> Column:
                written = F.get(cells(line), a["spot"])
                return F.when(F.rlike(written, F.lit(r"^\d+$")), written.try_cast("int"))

            rows = leading(below, lambda x: F.contains(x, F.lit("|")) & level(x).between(1, LEVELS))
            heads = F.filter(F.transform(header, lambda c, k: F.when(k != a["spot"], c)), lambda c: c.isNotNull())

            def row(line: Column) -> Column:
                rest = F.filter(F.transform(cells(line), lambda c, k: F.when(k != a["spot"], c)), lambda c: c.isNotNull())
                return F.struct(level(line).alias("level"), F.map_from_arrays(F.transform(heads, lambda h: stable_slug(h)), F.transform(heads, lambda h, k: F.coalesce(F.get(rest, k), F.lit("")))).alias("cells"))

            sound = (F.size(F.array_distinct(F.transform(heads, lambda h: stable_slug(h)))) == F.size(heads)) & (F.transform(rows, level) == F.sequence(F.lit(1), F.lit(LEVELS)))
            die = group(s["hitDie"], r"d?(6|8|10|12)").try_cast("int")
            title, line = F.get(lines, s["k"] - 1), F.get(lines, s["k"])
            spellcasting = F.when(~F.rlike(s["spellcastingAbility"], rule("^(?:none|нет|-|—)$")), s["spellcastingAbility"])
            attributes = json_of(
                kind=F.when(F.rlike(line, rule("subclass|подкласс")), "subclass").otherwise("class"), hitDie=die, primaryAbility=s["primaryAbility"], spellcastingAbility=spellcasting,
                parentClassIds=parts_of(s["parentClassIds"]), progressionColumns=F.transform(heads, lambda h: F.struct(stable_slug(h).alias("key"), h.alias("heading"))), progressionRows=F.transform(rows, row), features=F.array().cast("array<string>"), crossLinks=F.array().cast("array<string>"),
            )
            fields = ("kind", "hitDie", "primaryAbility", "spellcastingAbility", "parentClassIds", "progressionColumns", "progressionRows", "features", "crossLinks")
            whole = sound & (s["k"] >= 1) & die.isNotNull() & s["primaryAbility"].isNotNull()
            return F.when(whole, F.array(candidate("class", "table-parser", title, text, attributes, cited(title, text, line, dict.fromkeys(fields, text)))))

        return F.when(s["k"].isNotNull() & s["h"].isNotNull(), let(F.struct(spot.alias("spot")), made))

    return let(found, build)


def parts_of(listed: Column) -> Column:
    """A comma-separated list; empty for null."""
    return F.coalesce(F.transform(F.split(listed, ","), lambda c: F.trim(c)), F.array().cast("array<string>"))


def species(text: Column, lines: Column, russian: Column) -> Column:
    """A species or variant: size, speed, parents, and trait lines 'key | title | body | what it overrides'."""
    found = F.struct(
        place(lines, "^(?:Species|Вид|Раса)(?: Variant| Вариант)?$").alias("k"),
        named(value_of(lines, rf"^(?:{EITHER['size']})\s*:\s*(.+)$"), SIZES, whole=True).alias("size"),
        value_of(lines, rf"^(?:{EITHER['speed']})\s*:\s*(\d+)").try_cast("bigint").alias("speed"),
        value_of(lines, rf"^(?:{EITHER['parentSpeciesIds']})\s*:\s*(.+)$").alias("parents"),
    )

    def trait(line: Column) -> Column:
        p = F.transform(F.split(F.regexp_replace(line, rf"(?iu)^(?:{EITHER['traits']})\s*:\s*", ""), r"\|"), lambda c: F.trim(c))

        def part(k: int) -> Column:
            return F.when(F.get(p, F.lit(k)) != "", F.get(p, F.lit(k)))

        title = F.coalesce(part(1), F.get(p, F.lit(0)))
        key = stable_slug(F.get(p, F.lit(0)))
        return F.struct(key.alias("key"), title.alias("title"), F.coalesce(part(2), part(1), title).alias("body"), key.alias("anchor"), stable_slug(part(3)).alias("overrides"))

    def build(s: Column) -> Column:
        title, line = F.get(lines, s["k"] - 1), F.get(lines, s["k"])
        traits = F.transform(F.filter(lines, lambda x: F.rlike(x, rule(rf"^(?:{EITHER['traits']})\s*:"))), trait)
        attributes = json_of(kind=F.when(F.rlike(line, rule("variant|вариант")), "variant").otherwise("species"), size=s["size"], speed=s["speed"], parentSpeciesIds=parts_of(s["parents"]), traits=traits, crossLinks=F.array().cast("array<string>"))
        attributes = F.replace(attributes, F.lit(',"overrides":null'), F.lit(""))  # a trait that overrides nothing doesn't name it
        whole = (s["k"] >= 1) & s["size"].isNotNull() & s["speed"].isNotNull()
        return F.when(whole, F.array(candidate("species", "section-parser", title, text, attributes, cited(title, text, line, dict.fromkeys(("kind", "size", "speed", "parentSpeciesIds", "traits", "crossLinks"), text)))))

    return let(found, build)


def feature(text: Column, lines: Column, russian: Column) -> Column:
    """A feature: a line that says at which level of what it is gained, the title above it, the body below."""
    rules = [r"Умение .+ (\d+)(?:-го|-й) уровня", r"(\d+)(?:st|nd|rd|th)-Level .+ Feature"]
    found = F.struct(F.when(russian, place(lines, rules[0])).otherwise(place(lines, rules[1])).alias("k"))

    def build(s: Column) -> Column:
        line, title = F.get(lines, s["k"]), F.get(lines, s["k"] - 1)
        level = F.when(russian, group(line, r"(\d+)(?:-го|-й) уровня")).otherwise(group(line, r"(\d+)(?:st|nd|rd|th)-Level")).try_cast("int")
        body = tail_of(text, lines, s["k"] + 1)
        whole = (F.size(lines) >= 3) & (s["k"] >= 1) & level.between(1, LEVELS) & (s["k"] + 1 < F.size(lines))
        return F.when(whole, F.array(candidate("feature", "section-parser", title, body, json_of(level=level, featureKind=line), cited(title, body, line, {"level": line, "featureKind": line}))))

    return let(found, build)


#: The parsers in the order in which they are tried, each with what a text has wherever the parser fits: cheap tests of the whole text, before its lines are looked at.
PARSERS = (
    (spell, [f"{LABELS[f][0]}|{LABELS[f][1]}" for f in ("castingTime", "range", "components", "duration")]),
    (creature, [f"{LABELS[f][0]}|{LABELS[f][1]}" for f in ("armorClass", "hitPoints", "speed", "challengeRating")]),
    (equipment, [r"\|", "Cost|Стоимость"]),
    (progression, [r"\|", "Class|Класс", "Level|Уровень", "Features|Умения"]),
    (species, ["Species|Вид|Раса", EITHER["size"], EITHER["speed"]]),
    (feature, [r"Умение .+ \d+(?:-го|-й) уровня|\d+(?:st|nd|rd|th)-Level .+ Feature"]),
)


def may_fit(text: Column, marks: list[str]) -> Column:
    """Whether a text has all the marks; where it lacks one, the parser of these marks gives null."""
    return reduce(lambda a, b: a & b, [F.rlike(text, rule(m)) for m in marks])


def candidates(text: str | Column, language: str | Column) -> Column:
    """What the first parser that fits makes of a chunk; an empty array if none does, and for null. Its lines are read once, if any parser may fit."""
    t, russian = F.coalesce(col(text), F.lit("")), F.coalesce(col(language) == "ru", F.lit(False))
    none = F.array().cast(CANDIDATE)

    def parsed(lines: Column) -> Column:
        return F.coalesce(*[F.when(may_fit(t, marks), p(t, lines, russian).cast(CANDIDATE)) for p, marks in PARSERS], none)

    return F.when(reduce(lambda a, b: a | b, [may_fit(t, marks) for _, marks in PARSERS]), let(lines_of(t), parsed)).otherwise(none)

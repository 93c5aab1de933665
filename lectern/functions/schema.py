"""Closed schemas of typed candidates over JSON, as Columns that say which path breaks which rule, and the evidence that citations give.

A check takes a variant and its path and gives an array of (path, rule).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import parsers as P
from lectern.functions.text import col, let, stable_slug

Check = Callable[[Column, Column], Column]
ISSUES = "array<struct<path:string,rule:string>>"
ANY = "map<string,variant>"


def none() -> Column:
    return F.array().cast(ISSUES)


def fault(path: Column, rule: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule"))).cast(ISSUES)


def unless(ok: Column, path: Column, rule: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), none()).otherwise(fault(path, rule))


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def text() -> Check:
    return lambda v, p: unless((kind(v) == "STRING") & (F.length(F.try_variant_get(v, "$", "string")) >= 1), p, "text")


def boolean() -> Check:
    return lambda v, p: unless(kind(v) == "BOOLEAN", p, "boolean")


def number(low: float, high: float, whole: bool = True) -> Check:
    def test(v: Column, p: Column) -> Column:
        n = F.try_variant_get(v, "$", "double")
        ok = F.rlike(kind(v), F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")) & n.between(low, high)
        return unless(ok & (n == F.floor(n)) if whole else ok, p, "number")

    return test


def one_of(*values) -> Check:
    if isinstance(values[0], str):
        return lambda v, p: unless((kind(v) == "STRING") & F.try_variant_get(v, "$", "string").isin(*values), p, "choice")
    return lambda v, p: unless(F.rlike(kind(v), F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")) & F.try_variant_get(v, "$", "double").isin(*map(float, values)), p, "choice")


def nullable(check: Check) -> Check:
    return lambda v, p: F.when(F.is_variant_null(v), none()).otherwise(check(v, p))


def listed(check: Check, low: int = 0, unique: bool = False) -> Check:
    """An array; ``unique`` compares its elements as strings."""

    def test(v: Column, p: Column) -> Column:
        a = F.try_variant_get(v, "$", "array<variant>")
        each = F.flatten(F.transform(a, lambda x, k: check(x, F.concat(p, F.lit("["), k, F.lit("]")))))
        texts = F.transform(a, lambda x: F.to_json(x))
        own = F.when(F.size(a) < low, fault(p, "length")).when(F.lit(unique) & (F.size(F.array_distinct(texts)) < F.size(a)), fault(p, "unique")).otherwise(none())
        return F.when(a.isNull(), fault(p, "list")).otherwise(F.concat(own, each))

    return test


def record(needed: dict[str, Check], optional: dict[str, Check] | None = None) -> Check:
    """An object with the needed fields, perhaps the optional ones, and no others."""
    optional = optional or {}

    def test(v: Column, p: Column) -> Column:
        def of(m: Column) -> Column:
            keys = F.map_keys(m)
            more = F.transform(F.array_except(keys, F.array(*map(F.lit, (*needed, *optional)))), lambda k: F.struct(F.concat_ws(".", p, k).alias("path"), F.lit("additional").alias("rule")))
            parts = [more.cast(ISSUES)]
            for k, check in (needed | optional).items():
                at = F.concat(p, F.lit(f".{k}"))
                parts.append(F.when(F.array_contains(keys, k), check(F.try_element_at(m, F.lit(k)), at)).otherwise(fault(at, "required") if k in needed else none()))
            return F.concat(*parts)

        m = F.try_variant_get(v, "$", ANY)
        return F.when(m.isNull(), fault(p, "object")).otherwise(let(m, of))

    return test


def mapped(check: Check) -> Check:
    """An object whose values all pass."""

    def test(v: Column, p: Column) -> Column:
        m = F.try_variant_get(v, "$", ANY)
        return F.when(m.isNull(), fault(p, "object")).otherwise(F.flatten(F.transform(F.map_entries(m), lambda e: check(e["value"], F.concat_ws(".", p, e["key"])))))

    return test


SIZE, BLOCKS, NAMES = one_of(*P.SIZES), listed(record({"name": text(), "text": text()})), listed(text(), unique=True)
ABILITIES = ("str", "dex", "con", "int", "wis", "cha")
LEGACY_CREATURE = record(
    {"size": SIZE, "creatureType": text(), "alignment": nullable(text()), "armorClass": number(1, 50), "hitPoints": number(1, 2**31 - 1), "challengeRating": one_of(0, 0.125, 0.25, 0.5, *range(1, 31)), "speed": text()}
)
FULL_CREATURE = record(
    {
        "size": SIZE, "creatureType": text(), "alignment": nullable(text()), "armorClass": listed(record({"value": number(1, 50)}, {"note": text()}), 1),
        "hitPoints": record({"average": number(1, 2**53)}, {"formula": text()}), "challengeRating": record({"numerator": number(0, 30), "denominator": one_of(1, 2, 4, 8)}),
        "speeds": listed(record({"mode": one_of("walk", "burrow", "climb", "fly", "swim"), "distance": number(1, 2**53), "unit": one_of("ft", "m")}, {"note": text()}), 1),
        "abilities": record({a: number(1, 30) for a in ABILITIES}), "saves": mapped(number(-30, 30)), "skills": mapped(number(-30, 30)), "damageResistances": NAMES, "damageImmunities": NAMES,
        "conditionImmunities": NAMES, "senses": NAMES, "passivePerception": number(0, 100), "languages": NAMES, "traits": BLOCKS, "actions": BLOCKS, "bonusActions": BLOCKS, "reactions": BLOCKS, "legendaryActions": BLOCKS,
    }
)


def creature(v: Column, p: Column) -> Column:
    """The short form has a text for its speed, the full one a list of speeds."""
    return F.when(F.try_variant_get(v, "$.speed", "string").isNotNull(), LEGACY_CREATURE(v, p)).otherwise(FULL_CREATURE(v, p))


#: The closed schema of each type's attributes.
ATTRIBUTES: dict[str, Check] = {
    "spell": record(
        {"level": number(0, 9), "school": one_of(*P.SCHOOLS), "castingTime": text(), "range": text(), "duration": text(), "components": text(), "concentration": boolean(), "ritual": boolean()},
        {"classes": NAMES},
    ),
    "creature": creature,
    "equipment": record({"category": one_of(*P.CATEGORIES)}, {"costCp": nullable(number(0, 2**31 - 1)), "weightLb": nullable(number(0, 9_999_999.999, whole=False))}),
    "feature": record({"level": number(1, 20), "featureKind": text()}),
    "item": record({"category": one_of("armor", "potion", "ring", "rod", "scroll", "staff", "wand", "weapon", "wondrous", "other"), "rarity": one_of("common", "uncommon", "rare", "very_rare", "legendary", "artifact", "varies"), "requiresAttunement": boolean()}),
    "class": record(
        {"hitDie": one_of(6, 8, 10, 12), "primaryAbility": text(), "spellcastingAbility": nullable(text())},
        {
            "kind": one_of("class", "subclass"), "parentClassIds": NAMES, "progressionColumns": listed(record({"key": text(), "heading": text()})),
            "progressionRows": listed(record({"level": number(1, 20), "cells": mapped(text())})),
            "features": listed(record({"canonicalId": text(), "title": text(), "body": text(), "level": number(1, 20), "anchor": text()})), "crossLinks": NAMES,
        },
    ),
    "species": record(
        {"size": SIZE, "speed": number(1, 2**53)},
        {"kind": one_of("species", "variant"), "parentSpeciesIds": NAMES, "traits": listed(record({"key": text(), "title": text(), "body": text(), "anchor": text()}, {"overrides": nullable(text())})), "crossLinks": NAMES},
    ),
    "background": record({"abilityScores": listed(text(), 1, True), "skillProficiencies": listed(text(), 1, True)}),
    "feat": record({"category": one_of("origin", "general", "fighting_style", "epic_boon"), "repeatable": boolean()}, {"prerequisiteLevel": nullable(number(1, 20)), "prerequisiteText": nullable(text())}),
    "glossary": record({"category": text(), "relatedTerms": NAMES}),
}

#: Words that a quote for a type or a field must have, and words that make it no evidence at all.
SIZE_WORDS = "tiny|small|medium|large|huge|gargantuan|крошечн|маленьк|средн|больш|огромн|громадн"
SCHOOL_WORDS = "|".join(w for forms in P.SCHOOLS.values() for w in forms)
TYPE_WORDS = {
    "spell": rf"cantrip|заговор|\b\d(?:st|nd|rd|th)?-?level\b|\b\d(?:-й|-го)? уровень\b|casting time|время (?:накладывания|сотворения)|{SCHOOL_WORDS}",
    "creature": f"armor class|hit points|challenge|класс доспеха|хиты|опасность|{SIZE_WORDS}", "equipment": "equipment|gear|cost|weight|снаряжение|стоимость|цена|вес", "feature": "feature|умение",
    "item": "item|предмет|rarity|редкост", "class": "class|класс|hit die|кость хитов", "species": "species|вид|раса", "background": "background|предыстори", "feat": "feat|черта", "glossary": "glossary|term|словар|термин",
}
FIELD_WORDS = {
    "level": "cantrip|заговор|level|уров|feature|умение", "castingTime": "casting time|время (?:накладывания|сотворения)", "range": "range|дистанция|дальность", "duration": "duration|длительность",
    "components": "components|компоненты", "concentration": "duration|длительность|concentration|концентрац", "ritual": f"cantrip|заговор|level|уров|ritual|ритуал|{SCHOOL_WORDS}", "creatureType": SIZE_WORDS,
    "alignment": SIZE_WORDS, "armorClass": "armor class|класс доспеха", "hitPoints": "hit points|хиты", "challengeRating": "challenge|опасность", "speed": "speed|скорость",
    "costCp": r"(?:cp|sp|gp|pp|мм|см|зм|пм)(?!\p{L})", "weightLb": r"lb|фунт|фт", "hitDie": "hit die|кость хитов", "primaryAbility": "primary ability|основная характеристика",
    "spellcastingAbility": "spellcasting ability|заклинательная характеристика", "abilityScores": "ability score|характеристик", "skillProficiencies": "skill proficien|владение навыками",
    "prerequisiteLevel": "prerequisite|требование|уров", "prerequisiteText": "prerequisite|требование", "repeatable": "repeatable|повторяем|yes|no|да|нет", "requiresAttunement": "attunement|настройк|yes|no|да|нет",
}
COMMANDS = r"ignore (?:the |all )?(?:system|previous)|system message|follow (?:these|my) instructions|claim .+ and cite|return only json"
NOTHING = r"(?:^|\s)(?:-|—|none|null|нет|отсутствует)(?:$|\s)"


def plain(c: Column) -> Column:
    """Lower-cased letters, digits and slashes, other runs as a blank, Latin letters without accents."""
    from lectern.functions.text import unaccented

    accents, letters = unaccented()
    return F.trim(F.regexp_replace(F.translate(F.lower(c), accents, letters), r"[^\p{L}\p{N}/]+", " "))


def numbers(quote: Column) -> Column:
    """The fractions and the other numbers of a text."""
    shape = F.lit(r"(?<![\d/])(-?\d+)\s*/\s*(\d+)(?![\d/])")
    parts = F.zip_with(F.regexp_extract_all(quote, shape, 1), F.regexp_extract_all(quote, shape, 2), lambda a, b: F.try_divide(a.try_cast("double"), b.try_cast("double")))
    rest = F.transform(F.regexp_extract_all(quote, F.lit(r"(?<![\d/])-?\d+(?:[.,]\d+)?(?![\d/])"), 0), lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double"))
    return F.concat(parts, rest)


def scalars(v: Column) -> Column:
    """The scalars of a JSON value of up to three levels, as variants."""

    def inner(x: Column) -> Column:
        return F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.map_values(F.try_variant_get(x, "$", ANY)), F.array(x))

    out = inner(v)
    for _ in range(3):
        out = F.flatten(F.transform(out, inner))
    return out


def says(pattern: str, quote: Column) -> Column:
    return F.rlike(quote, P.rule(pattern))


def holds(v: Column, field: Column, quote: Column, known: Column) -> Column:
    """Whether a quote has a scalar: its number, its words, for a boolean what states it, for null a word for nothing. ``known``: the quote's numbers and plain text."""
    words = F.try_variant_get(v, "$", "string")
    aliases = F.lit(False)
    for name, table in (("school", P.SCHOOLS), ("size", P.SIZES), ("category", P.CATEGORIES)):
        hit = reduce(lambda c, kv: F.when(words == kv[0], reduce(lambda a, b: a | b, [F.contains(known["text"], F.lit(w)) for w in kv[1]])).otherwise(c), table.items(), F.lit(False))
        aliases = F.when(field == name, hit).otherwise(aliases)
    spoken = (F.contains(known["text"], plain(words)) & (plain(words) != "")) | aliases
    n, yes = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "boolean")
    ritual, lasting = says(r"\b(?:ritual|ритуал)", known["text"]), says("concentration|концентрац", known["text"])
    truth = (
        F.when(field == "ritual", F.when(yes, ritual).otherwise(says(TYPE_WORDS["spell"], quote) & ~ritual))
        .when(field == "concentration", F.when(yes, lasting).otherwise(says("duration|длительность", known["text"]) & ~lasting))
        .when(yes, says(r"\byes\b|\btrue\b|да|требует|repeatable|повторяем", known["text"]))
        .otherwise(says(r"\bno\b|\bfalse\b|нет|не требует|not repeatable|неповторяем", known["text"]))
    )
    empty = says(NOTHING, F.trim(quote)) | ((field == "alignment") & ~F.contains(quote, F.lit(",")))
    numeric = F.exists(known["numbers"], lambda x: F.abs(x - n) < 1e-6) | ((field == "level") & (n == 0) & says("cantrip|заговор", quote))
    return F.when(F.is_variant_null(v), empty).when(kind(v) == "BOOLEAN", truth).when(kind(v) == "STRING", spoken).otherwise(numeric)


def supports(entry_type: Column, path: Column, v: Column, quote: Column) -> Column:
    """Whether a quote is evidence for what stands at ``path`` (a variant). Quotes with instructions are evidence for nothing."""
    field = F.regexp_extract(path, r"^\$\.attributes\.(\w+)", 1)
    context = reduce(lambda c, kv: F.when(field == kv[0], says(kv[1], quote)).otherwise(c), FIELD_WORDS.items(), F.lit(True))
    typed = reduce(lambda c, kv: F.when(entry_type == kv[0], says(kv[1], quote)).otherwise(c), TYPE_WORDS.items(), F.lit(False))
    keyed = F.exists(F.split(quote, "\r?\n"), lambda x: stable_slug(x) == F.try_variant_get(v, "$", "string"))
    money = P.copper(quote).cast("double") == F.try_variant_get(v, "$", "double")
    weight = F.abs(P.pounds(quote) - F.try_variant_get(v, "$", "double")) < 1e-6
    known = F.struct(numbers(quote).alias("numbers"), plain(quote).alias("text"))
    each = let(known, lambda k: F.forall(scalars(v), lambda x: F.coalesce(holds(x, field, quote, k), F.lit(False))))
    absent = F.is_variant_null(v) & ((field != "alignment") | context) & let(known, lambda k: holds(v, field, quote, k))
    ruled = F.when(path == "$.entryType", typed).when(path == "$.candidateKey", keyed).when(F.is_variant_null(v), absent).when(~context, F.lit(False)).when(field == "costCp", money).when(field == "weightLb", weight).otherwise(each)
    return F.coalesce(~says(COMMANDS, quote) & ruled, F.lit(False))


def issues(entry_type: str | Column, key: str | Column, title: str | Column, body: str | Column, attributes: str | Column, citations: str | Column, chunk: str | Column) -> Column:
    """Sorted array of (path, rule) that a candidate breaks; empty for a sound one.

    ``attributes`` is JSON; ``citations`` an array of (field, start, stop, quote), spans in code points of ``chunk``. The closed
    schema of the type comes first; a candidate that keeps it is checked for its evidence: every citation is of a field
    (unknown) and exact (quote), every field is cited (uncited) and some citation of it is evidence for its value (unsupported).
    """
    kinds, t = col(entry_type), F.coalesce(col(chunk), F.lit(""))
    root = F.try_parse_json(col(attributes))
    at = F.lit("$.attributes")
    shape = reduce(lambda c, kv: F.when(kinds == kv[0], kv[1](root, at)).otherwise(c), ATTRIBUTES.items(), fault(F.lit("$.entryType"), "choice"))
    base = F.concat(
        unless(F.rlike(col(key), F.lit("^[a-z0-9](?:[a-z0-9-]{0,126}[a-z0-9])?$")), F.lit("$.candidateKey"), "pattern"),
        unless(F.length(col(title)) >= 1, F.lit("$.title"), "text"),
        unless(F.length(col(body)) >= 1, F.lit("$.body"), "text"),
        unless(F.size(col(citations)) >= 1, F.lit("$.citations"), "length"),
        F.when(root.isNull(), fault(at, "object")).otherwise(shape),
    )
    own = {"$.entryType": kinds, "$.candidateKey": col(key), "$.title": col(title), "$.body": col(body)}
    fields = F.try_variant_get(root, "$", ANY)
    # one map of all that must be cited: path to value
    values = F.map_concat(
        F.map_from_arrays(F.array(*map(F.lit, own)), F.array(*[F.parse_json(F.to_json(F.struct(c.alias("v")))) for c in own.values()])),
        F.map_from_arrays(F.transform(F.map_keys(fields), lambda k: F.concat(F.lit("$.attributes."), k)), F.map_values(fields)),
    )

    def evidence(m: Column) -> Column:
        def judged(c: Column) -> Column:
            exact = (c["stop"] > c["start"]) & (c["stop"] <= F.length(t)) & (F.substring(t, c["start"] + 1, c["stop"] - c["start"]) == c["quote"])
            held = F.try_element_at(m, c["field"])
            v = F.when(c["field"].startswith("$.attributes."), held).otherwise(F.try_variant_get(held, "$.v", "variant"))
            known = F.array_contains(F.map_keys(m), c["field"])
            return F.struct(c["field"].alias("path"), known.alias("known"), F.coalesce(exact, F.lit(False)).alias("exact"), (known & supports(kinds, c["field"], v, c["quote"])).alias("good"))

        def told(js: Column) -> Column:
            unknown = F.transform(F.filter(js, lambda j: ~j["known"]), lambda j: F.struct(j["path"].alias("path"), F.lit("unknown").alias("rule")))
            wrong = F.transform(F.filter(js, lambda j: ~j["exact"]), lambda j: F.struct(j["path"].alias("path"), F.lit("quote").alias("rule")))
            uncited = F.array_except(F.map_keys(m), F.transform(js, lambda j: j["path"]))
            good = F.transform(F.filter(js, lambda j: j["good"]), lambda j: j["path"])
            weak = F.array_except(F.array_except(F.map_keys(m), good), uncited)
            return F.concat(unknown.cast(ISSUES), wrong.cast(ISSUES), F.transform(uncited, lambda k: F.struct(k.alias("path"), F.lit("uncited").alias("rule"))).cast(ISSUES), F.transform(weak, lambda k: F.struct(k.alias("path"), F.lit("unsupported").alias("rule"))).cast(ISSUES))

        return let(F.transform(col(citations), judged), told)

    return let(base, lambda b: F.array_sort(F.array_distinct(F.when(F.size(b) > 0, b).otherwise(let(values, evidence)))))

"""Collected details to typed candidates: a metadata object's loose fields become the closed attributes of its type, then links between candidates are resolved.

``details``: external_id, category, title, body, metadata (JSON), source_id,
edition, language. Each attribute has its names in the metadata and a reader;
what can't be read is null and breaks the type's schema, so the fault is reported by its path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import schema
from lectern.functions.text import canonical_id, let, stable_slug

#: The type of each category.
CATEGORIES = {"spells": "spell", "bestiary": "creature", "class": "class", "species": "species", "equipment": "equipment", "items": "item", "feats": "feat", "backgrounds": "background", "glossary": "glossary"}
PREFIXES = "^(?:class|species|feature)-"


def raw(m: Column, *names: str) -> Column:
    """The first of the named fields that is there and not null, as a variant."""
    found = [F.try_variant_get(m, f"$.{n}", "variant") for n in names]
    return F.coalesce(*[F.when(~F.is_variant_null(v), v) for v in found])


def snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


def text(name: str, lower: bool = False):
    def read(m: Column) -> Column:
        t = F.trim(F.try_variant_get(raw(m, name, snake(name)), "$", "string"))
        t = F.when(t != "", t)
        return F.lower(t) if lower else t

    return read


def number(name: str):
    return lambda m: F.try_variant_get(raw(m, name, snake(name)), "$", "double")


def whole(name: str):
    return lambda m: F.try_variant_get(raw(m, name, snake(name)), "$", "bigint")


def flag(name: str):
    return lambda m: F.coalesce(F.try_variant_get(raw(m, name, snake(name)), "$", "boolean"), F.lit(False))


def die(name: str):
    return lambda m: F.regexp_extract(F.try_variant_get(raw(m, name, snake(name)), "$", "string"), "(?i)d?(6|8|10|12)", 1).try_cast("int")


def listed(name: str):
    """An array as it stands; empty where there is none."""
    return lambda m: F.coalesce(F.try_variant_get(raw(m, name, snake(name)), "$", "array<variant>"), F.array().cast("array<variant>"))


def ids(name: str, kind: str | None):
    """A list of entry ids, also from a single one: qualified ids as they stand, others of ``kind``; without a kind an unqualified id stays and resolves to nothing."""

    def read(m: Column) -> Column:
        v = raw(m, name, snake(name))
        each = F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.when(v.isNotNull(), F.array(F.try_variant_get(v, "$", "string"))), F.array().cast("array<string>"))
        named = F.filter(F.transform(each, lambda x: F.trim(x)), lambda x: x != "")
        return F.transform(named, lambda x: x if kind is None else F.when(F.rlike(x, F.lit(PREFIXES)), x).otherwise(canonical_id(F.lit(kind), stable_slug(x))))

    return read


def kind_of(plain: str, derived: str, parents):
    """``derived`` where the metadata says so or there are parents."""
    return lambda m: F.when((text("kind")(m) == derived) | (F.size(parents(m)) > 0), derived).otherwise(plain)


CLASS_PARENTS, SPECIES_PARENTS = ids("parentClassIds", "class"), ids("parentSpeciesIds", "species")
#: The attributes of each type and how they are read.
READERS = {
    "spell": {"level": whole("level"), "school": text("school", True), **{n: text(n) for n in ("castingTime", "range", "duration", "components")}, "concentration": flag("concentration"), "ritual": flag("ritual")},
    "creature": {"size": text("size", True), "creatureType": text("creatureType"), "alignment": text("alignment"), "armorClass": whole("armorClass"), "hitPoints": whole("hitPoints"), "challengeRating": number("challengeRating"), "speed": text("speed")},
    "class": {
        "kind": kind_of("class", "subclass", CLASS_PARENTS), "hitDie": die("hitDie"), "primaryAbility": text("primaryAbility"), "spellcastingAbility": text("spellcastingAbility"), "parentClassIds": CLASS_PARENTS,
        "progressionColumns": listed("progressionColumns"), "progressionRows": listed("progressionRows"), "features": listed("features"), "crossLinks": ids("crossLinks", None),
    },
    "species": {"kind": kind_of("species", "variant", SPECIES_PARENTS), "size": lambda m: F.coalesce(text("size", True)(m), F.lit("medium")), "speed": whole("speed"), "parentSpeciesIds": SPECIES_PARENTS, "traits": listed("traits"), "crossLinks": ids("crossLinks", None)},
    "equipment": {"category": text("category", True), "costCp": whole("costCp"), "weightLb": number("weightLb")},
    "item": {"category": text("category", True), "rarity": text("rarity", True), "requiresAttunement": flag("requiresAttunement")},
    "feat": {"category": text("category", True), "prerequisiteLevel": whole("prerequisiteLevel"), "prerequisiteText": text("prerequisiteText"), "repeatable": flag("repeatable")},
    "background": {"abilityScores": listed("abilityScores"), "skillProficiencies": listed("skillProficiencies")},
    "glossary": {"category": text("category"), "relatedTerms": listed("relatedTerms")},
}


def typed(details: DataFrame) -> DataFrame:
    """One row a detail: entry_id, type, external_id, source_id, edition, language, title, body, attributes (JSON), evidence, issues.

    evidence is the metadata as 'key=value' lines, by which its fields are cited. type and attributes are null and issues says so
    where the category is unknown; metadata that is no JSON counts as an empty object.
    """
    kinds = reduce(lambda c, kv: F.when(F.col("category") == kv[0], kv[1]).otherwise(c), CATEGORIES.items(), F.lit(None).cast("string"))
    m = F.coalesce(F.try_parse_json("metadata"), F.parse_json(F.lit("{}")))

    def attributes(v: Column) -> Column:
        def of(readers: dict) -> Column:
            return F.to_json(F.struct(*[r(v).alias(k) for k, r in readers.items()]), {"ignoreNullFields": "false"})

        return reduce(lambda c, kv: F.when(F.col("type") == kv[0], of(kv[1])).otherwise(c), READERS.items(), F.lit(None).cast("string"))

    held = details.withColumn("type", kinds).withColumn("attributes", let(m, attributes))
    root = F.parse_json("attributes")
    shape = reduce(lambda c, kv: F.when(F.col("type") == kv[0], kv[1](root, F.lit("$.attributes"))).otherwise(c), schema.ATTRIBUTES.items(), schema.fault(F.lit("$.category"), "choice"))
    lacking = F.concat(schema.unless(F.length("title") > 0, F.lit("$.title"), "text"), schema.unless(F.length("body") > 0, F.lit("$.body"), "text"))
    lines = F.transform(F.map_entries(F.try_variant_get(root, "$", schema.ANY)), lambda e: F.concat(e["key"], F.lit("="), F.to_json(e["value"])))
    return held.select(
        F.when(F.col("type").isNotNull(), canonical_id("type", stable_slug("external_id"))).alias("entry_id"), "type", "external_id", "source_id", "edition", "language", "title", "body", "attributes",
        F.array_join(lines, "\n").alias("evidence"), F.array_sort(F.concat(shape, lacking)).alias("issues"),
    )


def features(candidates: DataFrame) -> DataFrame:
    """The features that classes list, as candidates of their own: entry_id, class_id, source_id, edition, language, title, body, level, anchor. Those without an id have no row."""
    shape = "features array<struct<canonicalId:string,title:string,body:string,level:double,anchor:string>>"
    held = candidates.where("type = 'class'").select(F.col("entry_id").alias("class_id"), "source_id", "edition", "language", F.explode(F.from_json("attributes", shape)["features"]).alias("f"))
    return held.where("f.canonicalId IS NOT NULL").select(F.col("f.canonicalId").alias("entry_id"), "class_id", "source_id", "edition", "language", "f.title", "f.body", F.col("f.level").cast("int").alias("level"), "f.anchor")


def links(candidates: DataFrame) -> DataFrame:
    """One row a link of a class or species: entry_id, relation (parent, feature, cross_link), target, position, state.

    A target counts in the same source, edition and language alone: resolved, ambiguous (several candidates), or unresolved.
    """
    place = ["source_id", "edition", "language"]
    shape = "parentClassIds array<string>, parentSpeciesIds array<string>, crossLinks array<string>, features array<struct<canonicalId:string>>"
    held = candidates.where("type IN ('class', 'species')").withColumn("a", F.from_json("attributes", shape))
    lists = {"parent": F.coalesce("a.parentClassIds", "a.parentSpeciesIds"), "feature": F.col("a.features.canonicalId"), "cross_link": F.col("a.crossLinks")}
    rows = [held.select("entry_id", *place, F.lit(k).alias("relation"), F.posexplode(v).alias("position", "target")) for k, v in lists.items()]
    wanted = reduce(DataFrame.unionByName, rows).where("target IS NOT NULL")
    known = candidates.where("entry_id IS NOT NULL").select(*place, F.col("entry_id").alias("target")).unionByName(features(candidates).select(*place, F.col("entry_id").alias("target")))
    counted = known.groupBy(*place, "target").agg(F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    return wanted.join(counted, [*place, "target"], "left").select("entry_id", *place, "relation", "target", "position", state.alias("state"))

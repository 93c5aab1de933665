"""Chunks to typed candidates, their faults, what may be published, and the tables that publishing makes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import parsers, schema
from lectern.functions.text import canonical_id, normalize_name, stable_slug
from lectern.sources.stores import dealt

#: What a candidate's type is called in a revision.
ENTRY_TYPES = {"class": "classFeature", "feature": "classFeature", "creature": "monster", "species": "other"}
#: Origins of a candidate.
ORIGINS = ("pdf_extraction", "collector_snapshot", "static_guide")


def extracted(chunks: DataFrame, text: str = "text", language: str = "language") -> DataFrame:
    """One row a candidate: ``chunks``' columns, n (from 0 in its chunk), type, method, key, title, body, attributes (JSON), citations (field, start, stop, quote).

    The first parser that fits a chunk gives its candidates; chunks that none fits have no row. The chunks are dealt out
    first: a small file holds many of them, and reading one takes long.
    """
    each = dealt(chunks).select("*", F.posexplode(parsers.candidates(text, language)).alias("n", "c")).select(*chunks.columns, "n", "c.*").withColumn("key", stable_slug("title"))

    def spanned(c: Column) -> Column:
        start = F.instr(F.col(text), c["quote"]) - 1
        return F.struct(c["field"].alias("field"), start.cast("int").alias("start"), (start + F.length(c["quote"])).cast("int").alias("stop"), c["quote"].alias("quote"))

    return each.withColumn("citations", F.transform("citations", spanned))


def judged(candidates: DataFrame, text: str = "text") -> DataFrame:
    """``candidates`` with issues: sorted (path, rule) pairs."""
    return candidates.withColumn("issues", schema.issues("type", "key", "title", "body", "attributes", "citations", text))


def progression_rows(candidates: DataFrame) -> DataFrame:
    """One row a level and column of each class candidate: chunk_id, title, level, column, cell."""
    held = candidates.where("type = 'class'").select("chunk_id", "title", F.from_json("attributes", "progressionRows array<struct<level:int,cells:map<string,string>>>").alias("a"))
    rows = held.select("chunk_id", "title", F.explode("a.progressionRows").alias("r"))
    return rows.select("chunk_id", "title", F.col("r.level").alias("level"), F.explode("r.cells").alias("column", "cell"))


def trait_rows(candidates: DataFrame) -> DataFrame:
    """One row a trait of each species candidate: chunk_id, title, kind, parents, key, trait, overrides."""
    held = candidates.where("type = 'species'").select("chunk_id", "title", F.from_json("attributes", "kind string, parentSpeciesIds array<string>, traits array<struct<key:string,title:string,overrides:string>>").alias("a"))
    return held.select("chunk_id", "title", "a.kind", F.array_join("a.parentSpeciesIds", ",").alias("parents"), F.explode("a.traits").alias("t")).select("chunk_id", "title", "kind", "parents", "t.key", F.col("t.title").alias("trait"), "t.overrides")


def capability(rows: DataFrame) -> DataFrame:
    """``rows`` (origin, issues, generation_id, chunk_id, page, captured, reviewed) with capability and block_reason.

    captured and reviewed are the file's hashes at capture and at review. The first reason that holds blocks; without one a candidate is publishable.
    """
    first = F.get("issues", F.lit(0))
    repair = F.concat(first["path"], F.lit(" "), first["rule"])
    snapshot, pdf = F.col("origin") == ORIGINS[1], F.col("origin") == ORIGINS[0]
    reason = (
        F.when(F.coalesce(~F.col("origin").isin(*ORIGINS), F.lit(True)), "unsupported origin")
        .when(F.col("origin") == ORIGINS[2], "needs extraction from chunks")
        .when(pdf & (F.col("generation_id").isNull() | F.col("chunk_id").isNull()), "no generation or chunk")
        .when(F.size("issues") > 0, F.concat(F.lit("needs repair: "), repair))
        .when(snapshot & ~F.coalesce(F.col("captured") == F.col("reviewed"), F.lit(False)), "file changed since its review")
        .when(pdf & F.col("page").isNull(), "no source page")
    )
    return rows.withColumn("block_reason", reason).withColumn("capability", F.when(F.col("block_reason").isNull(), "publishable").otherwise("requires_extraction"))


def revisions(rows: DataFrame) -> DataFrame:
    """One row an entry that may be published (``rows`` of ``capability``): entry_id, revision_id, entry_type, name, body and the candidate's columns.

    Of several candidates of one entry the one with the smallest chunk and place is taken.
    """
    kind = reduce(lambda c, kv: F.when(F.col("type") == kv[0], kv[1]).otherwise(c), ENTRY_TYPES.items(), F.col("type"))
    good = rows.where("capability = 'publishable'").withColumn("entry_type", kind).withColumn("entry_id", canonical_id("type", "key"))
    made = F.to_json(F.struct("entry_id", "title", "body", "attributes"))
    good = good.withColumn("revision_id", F.concat(F.lit("sha256:"), F.sha2(made, 256)))
    rest = [c for c in good.columns if c != "entry_id"]
    one = good.groupBy("entry_id").agg(F.min_by(F.struct(*rest), F.struct("chunk_id", "n")).alias("r"))
    return one.select("entry_id", "r.*")


def name_rows(published: DataFrame) -> DataFrame:
    """The names of entries: entry_id, revision_id, name, normalized."""
    return published.select("entry_id", "revision_id", F.col("title").alias("name"), normalize_name("title").alias("normalized"))


def field_rows(published: DataFrame) -> DataFrame:
    """The typed fields of entries: entry_id, revision_id, key (kebab case), kind, value (JSON), number. Null fields have no row."""
    held = published.select("entry_id", "revision_id", F.explode(F.map_entries(F.try_variant_get(F.parse_json("attributes"), "$", schema.ANY))).alias("e")).select("entry_id", "revision_id", F.col("e.key").alias("k"), F.col("e.value").alias("v"))
    shape = F.schema_of_variant("v")
    kind = F.when(shape == "STRING", "text").when(shape == "BOOLEAN", "boolean").when(F.rlike(shape, F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")), "number").when(F.startswith(shape, F.lit("ARRAY")), "list").otherwise("object")
    kebab = F.lower(F.regexp_replace("k", "([a-z0-9])([A-Z])", "$1-$2"))
    return held.where(~F.is_variant_null("v")).select("entry_id", "revision_id", kebab.alias("key"), kind.alias("kind"), F.to_json("v").alias("value"), F.when(kind == "number", F.try_variant_get("v", "$", "double")).alias("number"))


def citation_rows(published: DataFrame, heading: str = "heading") -> DataFrame:
    """The citations of entries: entry_id, revision_id, citation_id (its path and which of that path's it is), page, section, field, quote, start, stop."""
    c = published.select("entry_id", "revision_id", "chunk_id", "page", F.coalesce(F.when(F.trim(heading) != "", F.trim(heading)), F.col("title")).alias("h"), F.posexplode("citations").alias("k", "c"))
    again = F.row_number().over(Window.partitionBy("entry_id", "c.field").orderBy("k"))
    return c.select(
        "entry_id",
        "revision_id",
        F.concat_ws("-", F.lit("evidence"), stable_slug("c.field"), again.cast("string")).alias("citation_id"),
        "page",
        F.concat("h", F.lit(" [chunk "), "chunk_id", F.lit("]")).alias("section"),
        F.col("c.field").alias("field"),
        F.col("c.quote").alias("quote"),
        F.col("c.start").alias("start"),
        F.col("c.stop").alias("stop"),
    )


#: Statuses of a candidate that a decision is allowed on; other decisions are allowed on all.
DECISIONS = {"approve": ("new", "changed", "unchanged"), "merge": ("new", "changed", "unchanged", "duplicate", "invalid"), "unpublish": ("missing",)}


def decided(rows: DataFrame, status: str = "status", decision: str = "decision") -> DataFrame:
    """``rows`` with allowed: whether the decision may be made on the status; false for a null status."""
    ok = reduce(lambda c, kv: F.when(F.col(decision) == kv[0], F.col(status).isin(*kv[1])).otherwise(c), DECISIONS.items(), F.col(status).isNotNull())
    return rows.withColumn("allowed", F.coalesce(ok, F.lit(False)))

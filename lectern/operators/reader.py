"""Nine read methods over what a user may see, each a DataFrame; keyset pages carry whether there is more."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import tokens
from lectern.operators.paging import keyset_page

MAX_LIMIT = 200
SUMMARY = ("id", "entry_id", "entry_type", "name", "edition", "language", "category", "source_id")


@dataclass(frozen=True)
class Reader:
    """``entries`` (SUMMARY, aliases, text), already narrowed to the user; ``sources`` (source_id, ...), ``sections`` (id, section, start, stop),
    ``citations`` (id, citation, start, stop; offsets in code points, null for the whole entry), ``changes`` (id, entry_id, indexed_at, retired_at).

    An identifier is an id or an entry_id; nothing found is an empty frame. Ties break on entry_id, then id.
    """

    entries: DataFrame
    sources: DataFrame
    sections: DataFrame
    citations: DataFrame
    changes: DataFrame

    def selected(self, edition: str | None = None, language: str | None = None, category: str | None = None) -> DataFrame:
        """Entries of an edition, language and category, each optional."""
        wanted = {"edition": edition, "language": language, "category": category}
        return reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]), [(k, v) for k, v in wanted.items() if v is not None], self.entries)

    def list_entity_types(self, **selection) -> DataFrame:
        return self.selected(**selection).select("entry_type").distinct()

    def list_entries(self, after: tuple | None = None, limit: int = 50, entry_type: str | None = None, **selection) -> DataFrame:
        found = self.selected(**selection).select(*SUMMARY)
        found = found.where(F.col("entry_type") == entry_type) if entry_type else found
        return keyset_page(found, ["entry_id", "id"], after, bounded(limit), MAX_LIMIT)

    def get_entry(self, identifier: str, **selection) -> DataFrame:
        return self._one(self.selected(**selection), named(identifier))

    def resolve_alias(self, alias: str, **selection) -> DataFrame:
        return self._one(self.selected(**selection), F.exists("aliases", lambda a: F.lower(a) == alias.lower()))

    def search_entries(self, query: str, limit: int = 50, entry_type: str | None = None, **selection) -> DataFrame:
        """Entries that hold every word of the query, by how often they hold them for their length."""
        words = list(dict.fromkeys(query.lower().split()))
        found = self.selected(**selection)
        found = found.where(F.col("entry_type") == entry_type) if entry_type else found
        held = found.withColumn("_w", tokens(F.concat_ws(" ", F.array_join("aliases", " "), "name", "text")))
        hit = held.where(F.size(F.array_except(F.array(*map(F.lit, words)), "_w")) == 0) if words else held.limit(0)
        rank = F.round(F.size(F.filter("_w", lambda w: w.isin(*words) if words else F.lit(False))) / (1 + F.log(1 + F.size("_w"))), 9)
        return hit.select("id", "entry_id", "name", rank.alias("rank")).orderBy(F.desc("rank"), "entry_id", "id").limit(bounded(limit))

    def get_source(self, source_id: str, **selection) -> DataFrame:
        """A source's public columns, if the user may read an entry of it."""
        seen = self.selected(**selection).where(F.col("source_id") == source_id).select("source_id").distinct()
        return self.sources.join(seen, "source_id", "left_semi")

    def get_citations(self, identifier: str, **selection) -> DataFrame:
        return self.citations.join(self.get_entry(identifier, **selection).select("id"), "id")

    def read_section(self, identifier: str, section: str | int, **selection) -> DataFrame:
        """The section's text with the citations that overlap it, in order of their start."""
        one = self.get_entry(identifier, **selection).select("id", "text")
        at = self.sections.where(F.col("section") == section).join(one, "id")
        c = self.citations.select("id", "citation", F.col("start").alias("_from"), F.col("stop").alias("_to"))
        meets = F.col("_from").isNull() | F.col("_to").isNull() | ((F.col("_from") < F.col("stop")) & (F.col("_to") > F.col("start")))
        met = at.join(c, "id", "left").groupBy("id", "section", "start", "stop", "text").agg(F.array_sort(F.collect_list(F.when(meets, F.struct("_from", "citation")))).alias("l"))
        body = F.substring(F.col("text"), F.col("start") + 1, F.col("stop") - F.col("start"))
        return met.select("id", "section", body.alias("body"), F.transform("l", lambda x: x["citation"]).alias("citations"))

    def list_changed_entries(self, since: Column, limit: int = 50, **selection) -> DataFrame:
        """Entries indexed or retired after ``since``, oldest change first."""
        at = F.greatest("indexed_at", "retired_at")
        c = self.changes.withColumn("changed_at", at).where(F.col("changed_at") > since)
        c = c.join(self.selected(**selection).select("id"), "id", "left_semi")
        kind = F.when(F.col("retired_at").isNull(), "upserted").otherwise("deleted")
        return c.select("id", "entry_id", kind.alias("kind"), "changed_at").orderBy("changed_at", "entry_id", "id").limit(bounded(limit))

    @staticmethod
    def _one(found: DataFrame, which: Column) -> DataFrame:
        return found.where(which).orderBy("entry_id", "id").limit(1)


def bounded(limit: int) -> int:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be from 1 to {MAX_LIMIT}")
    return limit


def named(identifier: str) -> Column:
    return (F.col("entry_id") == identifier) | (F.col("id").cast("string") == identifier)

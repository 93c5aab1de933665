"""The nine read methods; documents stand as entries, their lines as sections, every hundred characters as a citation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.access import readable
from lectern.operators.reader import Reader
from lectern.plans.base import query
from lectern.sources.views import docs, passages, sources

SEEN = """seen AS (SELECT doc_id AS id, 'doc-' || doc_id AS entry_id, ['spell', 'feat', 'item', 'glossary'][doc_id % 4 + 1] AS entry_type, regexp_extract(text, '^\\S+') AS name, edition, language, category, source_id, text,
 ['D' || doc_id, 'twin-' || (doc_id // 2)] AS aliases FROM visible),
 cites AS (SELECT id, k AS citation, 100 * k AS start, 100 * k + 150 AS stop FROM (SELECT id, unnest(range(0, length(text) // 100 + 1)) AS k FROM seen)) """


def reader(spark, sf) -> Reader:
    d = readable(docs(spark, sf), "premium", "u3")
    k = F.col("doc_id")
    e = d.select(
        k.alias("id"), F.concat(F.lit("doc-"), k).alias("entry_id"), F.element_at(F.array(*map(F.lit, ("spell", "feat", "item", "glossary"))), (k % 4 + 1).cast("int")).alias("entry_type"),
        F.regexp_extract("text", r"^\S+", 0).alias("name"), "edition", "language", "category", "source_id", "text",
        F.array(F.concat(F.lit("D"), k), F.concat(F.lit("twin-"), F.floor(k / 2))).alias("aliases"),
    )
    n = F.col("citation")
    c = e.select("id", F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 100).cast("int"))).alias("citation")).select("id", "citation", (n * 100).alias("start"), (n * 100 + 150).alias("stop"))
    size = F.length("passage")
    from pyspark.sql import Window

    end = F.sum(size + 1).over(Window.partitionBy("doc_id").orderBy("idx"))
    s = passages(spark, sf).select(F.col("doc_id").alias("id"), F.col("idx").alias("section"), (end - size - 1).alias("start"), (end - 1).alias("stop"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)
    changes = e.select("id", "entry_id", at.alias("indexed_at"), F.when(F.col("id") % 7 == 3, at + F.expr("interval 1 day")).alias("retired_at"))
    return Reader(e, sources(spark, sf).select("source_id", "category", "edition", "language"), s, c, changes)


@query("f_08_list_entity_types", f"WITH {SEEN} SELECT DISTINCT entry_type FROM seen WHERE language = 'en'", ("visible",))
def types(spark, sf):
    return reader(spark, sf).list_entity_types(language="en")


@query("f_08_list_entries", f"WITH {SEEN}, hits AS (SELECT * FROM seen WHERE language = 'en' AND entry_type = 'feat' AND (entry_id, id) > ('doc-10', 10)) SELECT id, entry_id, entry_type, name, edition, language, category, source_id, (SELECT count(*) > 20 FROM hits) AS has_more FROM hits ORDER BY entry_id, id LIMIT 20", ("visible",))
def listed(spark, sf):
    return reader(spark, sf).list_entries(("doc-10", 10), 20, "feat", language="en")


@query("f_08_get_entry", f"WITH {SEEN} SELECT id, entry_id, name, md5(text) AS h FROM seen WHERE entry_id = 'doc-17' OR CAST(id AS VARCHAR) = 'doc-17' ORDER BY entry_id, id LIMIT 1", ("visible",))
def entry(spark, sf):
    return reader(spark, sf).get_entry("doc-17").select("id", "entry_id", "name", F.md5("text").alias("h"))


@query("f_08_resolve_alias", f"WITH {SEEN} SELECT id, entry_id, name FROM seen WHERE len(list_filter(aliases, lambda a: lower(a) = 'twin-6')) > 0 ORDER BY entry_id, id LIMIT 1", ("visible",))
def alias(spark, sf):
    return reader(spark, sf).resolve_alias("TWIN-6").select("id", "entry_id", "name")


@query(
    "f_08_search_entries",
    f"""WITH {SEEN}, w AS (SELECT id, entry_id, name, list_filter(regexp_split_to_array(lower(array_to_string(aliases, ' ') || ' ' || name || ' ' || text), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '') AS w FROM seen WHERE language = 'en')
    SELECT id, entry_id, name, round(len(list_filter(w, lambda x: x IN ('the', 'was'))) / (1 + ln(1 + len(w))), 9) AS rank FROM w WHERE list_contains(w, 'the') AND list_contains(w, 'was') ORDER BY rank DESC, entry_id, id LIMIT 30""",
    ("visible",),
)
def searched(spark, sf):
    return reader(spark, sf).search_entries("The was", 30, language="en")


@query("f_08_get_source", f"WITH {SEEN} SELECT DISTINCT source_id, category, edition, language FROM docs WHERE source_id = 'src1:en' AND source_id IN (SELECT source_id FROM seen)", ("visible",))
def source(spark, sf):
    return reader(spark, sf).get_source("src1:en")


@query("f_08_get_citations", f"WITH {SEEN} SELECT id, CAST(citation AS INTEGER) AS citation, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop FROM cites WHERE id = 17", ("visible",))
def cited(spark, sf):
    return reader(spark, sf).get_citations("17").select("id", "citation", "start", "stop")


@query(
    "f_08_read_section",
    f"""WITH {SEEN}, parts AS (SELECT id, string_split(text, chr(10)) AS p FROM seen WHERE id = 17), one AS (SELECT id, p[1] AS body, length(p[1]) AS stop FROM parts)
    SELECT a.id, 0 AS section, md5(body) AS body_md5, (SELECT string_agg(CAST(citation AS VARCHAR), ',' ORDER BY start, citation) FROM cites c WHERE c.id = a.id AND c.start < a.stop AND c.stop > 0) AS citations FROM one a""",
    ("visible",),
)
def section(spark, sf):
    return reader(spark, sf).read_section("doc-17", 0).select("id", "section", F.md5("body").alias("body_md5"), F.array_join(F.col("citations").cast("array<string>"), ",").alias("citations"))


@query(
    "f_08_list_changed_entries",
    f"""WITH {SEEN}, t AS (SELECT id, entry_id, language, id % 7 = 3 AS gone, 1700000000 + id * 60 + CASE WHEN id % 7 = 3 THEN 86400 ELSE 0 END AS s FROM seen)
    SELECT id, entry_id, CASE WHEN gone THEN 'deleted' ELSE 'upserted' END AS kind, s AS changed FROM t WHERE language = 'en' AND s > 1700003000 ORDER BY s, entry_id, id LIMIT 40""",
    ("visible",),
)
def changed(spark, sf):
    since = F.timestamp_seconds(F.lit(1_700_003_000))
    return reader(spark, sf).list_changed_entries(since, 40, language="en").select("id", "entry_id", "kind", F.unix_timestamp("changed_at").alias("changed"))

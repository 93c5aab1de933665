"""Typed browse: faceted lists over the best source of each entry, keyset pages, details."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators.paging import keyset_page
from lectern.operators.windows import best_of
from lectern.plans.base import query
from lectern.plans.relational import BEST, best_versions
from lectern.sources.views import entries, table, versions

VISIBLE = "access_tier IN ('open', 'premium')"
BEST_VISIBLE = f"SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY priority DESC, published_at DESC, version_id) AS rk FROM versions WHERE {VISIBLE}"


def shown(spark, sf):
    """Entries with their best visible version."""
    v = best_versions(spark, sf, ("entry_id",), VISIBLE)
    return entries(spark, sf).join(v.select("entry_id", "version_id", "source_no", "language", "priority"), "entry_id")


def listing(kind: str, where: str, key: str, after: str, more: str = "") -> str:
    return f"""WITH shown AS (SELECT e.*, v.version_id, v.source_no, v.language, v.priority FROM entries e JOIN ({BEST_VISIBLE}) v ON v.entry_id = e.entry_id AND rk = 1),
      hits AS (SELECT * FROM shown WHERE entry_type = '{kind}' AND {where} AND {after})
      SELECT {key}, version_id, (SELECT count(*) > 24 FROM hits) AS has_more FROM hits ORDER BY {key} LIMIT 24"""


@query("b_spells", listing("spell", "level IN (0, 1, 2, 3) AND ritual AND contains(title, 'e')", "title, entry_id", "(title, entry_id) > ('b', 0)"), ("entries", "versions"))
def spells(spark, sf):
    s = shown(spark, sf).where("entry_type = 'spell' and level in (0, 1, 2, 3) and ritual").where(F.contains("title", F.lit("e")))
    return keyset_page(s.select("title", "entry_id", "version_id"), ["title", "entry_id"], ("b", 0))


@query("b_items", listing("item", "cost BETWEEN 900 AND 1000 AND school = 'economy'", "cost, title, entry_id", "(cost, title, entry_id) > (0, '', 0)"), ("entries", "versions"))
def items(spark, sf):
    s = shown(spark, sf).where("entry_type = 'item' and cost between 900 and 1000 and school = 'economy'")
    return keyset_page(s.select("cost", "title", "entry_id", "version_id"), ["cost", "title", "entry_id"], (0.0, "", 0))


@query("b_type_counts", f"SELECT e.entry_type, count(*) AS n FROM entries e JOIN ({BEST_VISIBLE}) v ON v.entry_id = e.entry_id AND rk = 1 GROUP BY 1", ("entries", "versions"))
def type_counts(spark, sf):
    return shown(spark, sf).groupBy("entry_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b_detail",
    f"""SELECT e.entry_id, e.title, b.version_id, string_agg(v.version_id, ',' ORDER BY v.priority DESC, v.version_id) AS sources, count(*) AS n_sources FROM entries e JOIN ({BEST_VISIBLE}) b ON b.entry_id = e.entry_id AND rk = 1
        JOIN versions v ON v.entry_id = e.entry_id WHERE v.{VISIBLE} AND e.entry_id IN (17, 42, 99) GROUP BY 1, 2, 3""",
    ("entries", "versions"),
)
def detail(spark, sf):
    """An entry with its best version and all visible sources, as one nested row."""
    ids = F.col("entry_id").isin(17, 42, 99)
    v = versions(spark, sf).where(ids).where(VISIBLE)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "version_id")))
    all_ = v.groupBy("entry_id").agg(listed.alias("l"), F.count(F.lit(1)).alias("n_sources"))
    best = best_of(v, ["entry_id"], [F.desc("priority"), F.desc("published_at"), F.asc("version_id")]).select("entry_id", "version_id")
    out = entries(spark, sf).where(ids).join(best, "entry_id").join(all_, "entry_id")
    return out.select("entry_id", "title", "version_id", F.array_join(F.transform("l", lambda x: x["version_id"]), ",").alias("sources"), "n_sources")


@query("f_09_lookup", "SELECT alias, CASE WHEN count(*) = 1 THEN min(entry_id) END AS entry_id FROM (SELECT unnest(['A17', 'red widget', 'part-9', 'none']) AS alias) q LEFT JOIN (SELECT entry_id, alias AS name FROM entries UNION ALL SELECT entry_id, title FROM entries UNION ALL SELECT entry_id, canonical_key FROM entries) n ON n.name = q.alias GROUP BY 1", ("entries",))
def f_09(spark, sf):
    """By alias, title or key; a name that several entries carry is not found."""
    e = entries(spark, sf)
    names = e.select("entry_id", F.explode(F.array("alias", "title", "canonical_key")).alias("alias"))
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("A17", "red widget", "part-9", "none")])).alias("alias"))
    per = names.join(F.broadcast(wanted), "alias").groupBy("alias").agg(F.count(F.lit(1)).alias("n"), F.min("entry_id").alias("e"))
    return wanted.join(per, "alias", "left").select("alias", F.when(F.col("n") == 1, F.col("e")).otherwise(F.lit(None).cast("long")).alias("entry_id"))


@query("f_10_section", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (1, 2, 3, 7) AND l_quantity < 30 AND l_quantity + 5 > 10")
def f_10(spark, sf):
    """Citations [quantity, quantity + 5) that overlap the section [10, 30) of given documents."""
    l = table(spark, sf, "lineitem").where(F.col("l_orderkey").isin(1, 2, 3, 7))
    return l.where((F.col("l_quantity") < 30) & (F.col("l_quantity") + 5 > 10)).select("l_orderkey", "l_linenumber")


@query("f_11_alias_match", "SELECT entry_id FROM entries WHERE lower(alias) = lower('a17') OR lower(canonical_key) = lower('PART-9')", ("entries",))
def f_11(spark, sf):
    return entries(spark, sf).where((F.lower("alias") == F.lower(F.lit("a17"))) | (F.lower("canonical_key") == F.lower(F.lit("PART-9")))).select("entry_id")


@query("o_11_agent_list", "SELECT entry_id, canonical_key, entry_type, true AS has_more FROM entries WHERE entry_type IN ('feat', 'item') AND (canonical_key, entry_id) > ('part-10', 0) ORDER BY canonical_key, entry_id LIMIT 50", ("entries",))
def o_11(spark, sf):
    e = entries(spark, sf).where(F.col("entry_type").isin("feat", "item")).select("entry_id", "canonical_key", "entry_type")
    return keyset_page(e, ["canonical_key", "entry_id"], ("part-10", 0), 50, 200)


@query("list_sources", f"SELECT source_no, count(*) AS entries, max(priority) AS priority FROM ({BEST.format(keys='entry_id, language')}) WHERE rk = 1 GROUP BY 1", ("versions",))
def list_sources(spark, sf):
    return best_versions(spark, sf).groupBy("source_no").agg(F.count(F.lit(1)).alias("entries"), F.max("priority").alias("priority"))

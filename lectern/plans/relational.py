"""Predicates, projections, joins, aggregates, windows, sorts and set operations over the corpus model."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions.access import EDITIONS, ENTRY_TYPES, access_predicate, ordinal, readable
from lectern.operators.paging import keyset_page, offset_page
from lectern.operators.windows import best_by_shares, best_of, latest, places
from lectern.plans.base import query
from lectern.sources.stores import checkpoint_dir
from lectern.sources.views import docs, entries, passages, publications, sources, table, versions


def count():
    """Rows of a group."""
    return F.count(F.lit(1))


def typed(e):
    """Entries with their typed fields as an array of (key, value as JSON)."""
    fields = F.array(*[F.struct(F.lit(k).alias("key"), F.to_json(F.struct(F.col(c).alias("v"))).alias("value")) for k, c in (("level", "level"), ("school", "school"), ("cost", "cost"), ("ritual", "ritual"))])
    return e.withColumn("typed_fields", fields)


def field_value(key: str, path: str = "$.v"):
    """The first value of ``key`` in typed_fields, as text."""
    return F.get_json_object(F.try_element_at(F.filter("typed_fields", lambda f: f["key"] == key), F.lit(1))["value"], path)


# predicates


@query(
    "p_01_access",
    "SELECT doc_id, access_tier FROM docs WHERE access_tier = 'open' OR (access_tier = 'premium' AND is_shared) OR (access_tier = 'personal' AND owner_id = 'u3')",
    ("docs",),
)
def p_01(spark, sf):
    return docs(spark, sf).where(access_predicate("premium", "u3")).select("doc_id", "access_tier")


@query("p_01_access_user", "SELECT doc_id, access_tier FROM docs WHERE access_tier = 'open'", ("docs",))
def p_01_user(spark, sf):
    return docs(spark, sf).where(access_predicate("user")).select("doc_id", "access_tier")


@query("p_03_generation", "SELECT doc_id FROM visible WHERE edition = '5.5e' AND language = 'en'", ("visible",))
def p_03(spark, sf):
    return readable(docs(spark, sf), "premium", "u3", edition="5.5e", language="en").select("doc_id")


@query("p_04_contains", "SELECT entry_id, title FROM entries WHERE contains(lower(title), 'e w')", ("entries",))
def p_04(spark, sf):
    return entries(spark, sf).where(F.contains(F.lower("title"), F.lower(F.lit("E W")))).select("entry_id", "title")


@query("p_05_isin", "SELECT entry_id, level FROM entries WHERE level IN (1, 3, 5) AND school IN ('economy', 'promo')", ("entries",))
def p_05(spark, sf):
    return entries(spark, sf).where(F.col("level").isin(1, 3, 5) & F.col("school").isin("economy", "promo")).select("entry_id", "level")


@query("p_06_containment", "SELECT entry_id FROM entries WHERE level = 3 AND school = 'economy'", ("entries",))
def p_06(spark, sf):
    e = typed(entries(spark, sf))

    def has(key, value):
        return F.exists("typed_fields", lambda f: (f["key"] == key) & (f["value"] == value))

    return e.where(has("level", '{"v":3}') & has("school", '{"v":"economy"}')).select("entry_id")


@query("p_07_numeric_range", "SELECT entry_id, CAST(cost AS DOUBLE) AS cost FROM entries WHERE cost >= 910 AND cost <= 950.5", ("entries",))
def p_07(spark, sf):
    v = field_value("cost").cast("double")
    return typed(entries(spark, sf)).where((v >= 910) & (v <= 950.5)).select("entry_id", v.alias("cost"))


@query("p_08_array_text", "SELECT entry_id FROM entries WHERE lower(alias) = 'a17' OR lower(canonical_key) = 'a17'", ("entries",))
def p_08(spark, sf):
    e = entries(spark, sf).withColumn("aliases", F.array("alias", "canonical_key"))
    return e.where(F.exists("aliases", lambda a: F.lower(a) == "a17")).select("entry_id")


ENTITY_QUERY = "Compare the Red Widget, small-ring; and a large gear!"


@query(
    "p_09_name_in_query",
    r"""SELECT DISTINCT title FROM entries WHERE contains('-compare-the-red-widget-small-ring-and-a-large-gear-',
        '-' || trim(regexp_replace(lower(trim(title)), '[-_\s.,/:;!?()]+', '-', 'g'), '-') || '-')""",
    ("entries",),
)
def p_09(spark, sf):
    from lectern.functions.text import normalize_name

    q = F.concat(F.lit("-"), normalize_name(F.lit(ENTITY_QUERY)), F.lit("-"))
    return entries(spark, sf).where(F.contains(q, F.concat(F.lit("-"), normalize_name("title"), F.lit("-")))).select("title").distinct()


@query("p_10_scope", "SELECT v.version_id FROM versions v JOIN entries e USING (entry_id) WHERE v.language = 'ru' AND e.edition = '5e' AND v.source_no = 4", ("versions", "entries"))
def p_10(spark, sf):
    v = versions(spark, sf).where((F.col("language") == "ru") & (F.col("source_no") == 4))
    return v.join(entries(spark, sf).where("edition = '5e'"), "entry_id").select("version_id")


@query("p_11_null_safe", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE nullif(l_tax, 0) IS NOT DISTINCT FROM nullif(l_discount, 0)")
def p_11(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.where(F.nullif("l_tax", F.lit(0.0)).eqNullSafe(F.nullif("l_discount", F.lit(0.0)))).select("l_orderkey", "l_linenumber")


@query("p_12_row_value", "SELECT entry_id, title FROM entries WHERE (edition, title, entry_id) > ('5.5e', 'red widget', 500)", ("entries",))
def p_12(spark, sf):
    e = entries(spark, sf)
    return e.where(F.struct("edition", "title", "entry_id") > F.struct(F.lit("5.5e"), F.lit("red widget"), F.lit(500).cast("long"))).select("entry_id", "title")


@query("p_13_mixed_keyset", "SELECT entry_id, level FROM entries WHERE level < 5 OR (level = 5 AND (title, entry_id) > ('red widget', 100))", ("entries",))
def p_13(spark, sf):
    c = F.col
    after = F.struct("title", "entry_id") > F.struct(F.lit("red widget"), F.lit(100).cast("long"))
    return entries(spark, sf).where((c("level") < 5) | ((c("level") == 5) & after)).select("entry_id", "level")


@query(
    "p_14_kind",
    """SELECT doc_id, CASE WHEN regexp_matches(text, '^[^.!?]*\\|') THEN 'table' WHEN regexp_matches(text, '(^|[^\\p{L}])[\\p{Lu}][\\p{L}]*[?]') THEN 'question' WHEN regexp_matches(text, '^[\\p{Lu}][\\p{L}]*[.]') THEN 'heading' WHEN regexp_matches(text, '[0-9]') THEN 'numbers' ELSE 'prose' END AS kind FROM documents""",
)
def p_14(spark, sf):
    """Kinds of texts by pattern classes, the first that fits."""
    t = F.col("text")
    rules = (("table", r"^[^.!?]*\|"), ("question", r"(^|[^\p{L}])[\p{Lu}][\p{L}]*[?]"), ("heading", r"^[\p{Lu}][\p{L}]*[.]"), ("numbers", r"[0-9]"))
    kind = F.lit("prose")
    for name, rule in reversed(rules):
        kind = F.when(F.rlike(t, F.lit(rule)), name).otherwise(kind)
    return table(spark, sf, "documents").select("doc_id", kind.alias("kind"))


@query("p_14_option_kind", "SELECT entry_id, CASE WHEN ritual THEN 'ritual' WHEN level >= 5 THEN 'variant' ELSE 'base' END AS kind FROM entries", ("entries",))
def p_14_option(spark, sf):
    """Kinds of options by which attributes they have: the first that fits."""
    return entries(spark, sf).select("entry_id", F.when(F.col("ritual"), "ritual").when(F.col("level") >= 5, "variant").otherwise("base").alias("kind"))


@query("p_15_optional_filters", "SELECT source_id, access_tier FROM src WHERE category = 'homebrew' AND NOT is_deleted", ("src",))
def p_15(spark, sf):
    from lectern.functions.access import corpus_predicate

    return sources(spark, sf).where(corpus_predicate(category="homebrew", edition=None)).where(~F.col("is_deleted")).select("source_id", "access_tier")


@query("p_16_evidence_search", "SELECT doc_id, idx FROM passages WHERE contains(lower(passage), 'the') ORDER BY idx, doc_id LIMIT 100", ("passages",))
def p_16(spark, sf):
    hit = passages(spark, sf).where(F.contains(F.lower("passage"), F.lit("the")))
    return hit.orderBy(F.col("idx").asc_nulls_last(), "doc_id").limit(100).select("doc_id", "idx")


# projections


@query("pr_01_candidate_shape", "SELECT doc_id AS chunk_id, source_id, language, edition, category AS source_category, access_tier, length(text) AS n FROM docs", ("docs",))
def pr_01(spark, sf):
    return docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), "source_id", "language", "edition", F.col("category").alias("source_category"), "access_tier", F.length("text").cast("long").alias("n"))


@query("pr_02_eav_object", "SELECT entry_id, CAST(level AS VARCHAR) AS level, school FROM entries", ("entries",))
def pr_02(spark, sf):
    m = F.map_from_entries(F.transform("typed_fields", lambda f: F.struct(f["key"], F.get_json_object(f["value"], "$.v"))))
    return typed(entries(spark, sf)).withColumn("m", m).select("entry_id", F.col("m")["level"].alias("level"), F.col("m")["school"].alias("school"))


@query("pr_03_typed_validation", "SELECT entry_id, level, CASE WHEN level > 6 THEN 'level' END AS bad_level, CASE WHEN cost > 1000 THEN 'cost' END AS bad_cost FROM entries", ("entries",))
def pr_03(spark, sf):
    """Fields as JSON, back to a typed struct, with a column per broken rule."""
    raw = entries(spark, sf).select("entry_id", F.to_json(F.struct("level", "cost", "school")).alias("j"))
    t = raw.select("entry_id", F.from_json("j", "level int, cost double, school string").alias("t")).select("entry_id", "t.*")
    return t.select("entry_id", "level", F.when(F.col("level") > 6, "level").alias("bad_level"), F.when(F.col("cost") > 1000, "cost").alias("bad_cost"))


@query(
    "pr_04_typed_dispatch",
    "SELECT entry_id, entry_type, CASE entry_type WHEN 'spell' THEN 'level=' || level WHEN 'item' THEN 'brand=' || brand WHEN 'feat' THEN 'school=' || school END AS projection FROM entries",
    ("entries",),
)
def pr_04(spark, sf):
    shown = {"spell": "level", "item": "brand", "feat": "school"}
    out = F.lit(None).cast("string")
    for kind, c in shown.items():
        out = F.when(F.col("entry_type") == kind, F.concat(F.lit(f"{c}="), c)).otherwise(out)
    return entries(spark, sf).select("entry_id", "entry_type", out.alias("projection"))


@query("pr_05_defaults", "SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def pr_05(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(count().alias("n"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


# joins


@query("j_01_chunk_source", "SELECT d.doc_id, s.category, s.priority FROM docs d JOIN src s ON d.source_id = s.source_id AND d.language = s.language", ("src",))
def j_01(spark, sf):
    d = docs(spark, sf).select("doc_id", "source_id", "language")
    return d.join(sources(spark, sf), ["source_id", "language"]).select("doc_id", "category", "priority")


@query(
    "j_02_snowflake",
    """SELECT v.version_id, e.title, s.s_name, n.n_name, r.r_name FROM versions v JOIN entries e USING (entry_id) JOIN supplier s ON v.source_no = s.s_suppkey
       JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE e.edition = '5e'""",
    ("versions", "entries"),
)
def j_02(spark, sf):
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    v = versions(spark, sf).join(entries(spark, sf).where("edition = '5e'"), "entry_id").join(s, F.col("source_no") == F.col("s_suppkey"))
    v = v.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return v.select("version_id", "title", "s_name", "n_name", "r_name")


@query("j_03_composite_keys", "SELECT l.l_orderkey, l.l_linenumber, v.version_id FROM lineitem l JOIN versions v ON l.l_partkey = v.entry_id AND l.l_suppkey = v.source_no WHERE v.language = 'en' AND l.l_quantity > 45", ("versions",))
def j_03(spark, sf):
    l = table(spark, sf, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("entry_id"), F.col("l_suppkey").alias("source_no"))
    return l.join(versions(spark, sf).where("language = 'en'"), ["entry_id", "source_no"]).select("l_orderkey", "l_linenumber", "version_id")


@query("j_04_left", "SELECT d.doc_id, l.quality, e.label FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON d.doc_id = e.vec_id")
def j_04(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id", "left").select("doc_id", "quality", "label")


@query("j_05_semi", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def j_05(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_semi")


@query("j_06_anti", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def j_06(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf, "documents").select("doc_id").join(e, "doc_id", "left_anti")


@query(
    "j_07_evidence_gated_edges",
    """SELECT DISTINCT a.l_partkey AS from_id, b.l_partkey AS to_id FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber
       WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = a.l_suppkey AND s.s_suppkey % 4 IN (0, 1))""",
)
def j_07(spark, sf):
    """Edges between consecutive parts of an order, kept if the supplier that shows them is open."""
    l = table(spark, sf, "lineitem")
    seen = table(spark, sf, "supplier").where("s_suppkey % 4 in (0, 1)").select(F.col("s_suppkey").alias("l_suppkey"))
    a = l.select("l_orderkey", (F.col("l_linenumber") + 1).alias("line"), F.col("l_partkey").alias("from_id"), "l_suppkey").join(seen, "l_suppkey", "left_semi")
    b = l.select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("to_id"))
    return a.join(b, ["l_orderkey", "line"]).select("from_id", "to_id").distinct()


@query("j_08_self", "SELECT a.n_nationkey, count(*) AS siblings FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey GROUP BY 1")
def j_08(spark, sf):
    a = table(spark, sf, "nation").alias("a")
    b = table(spark, sf, "nation").alias("b")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") != F.col("b.n_nationkey"))
    return a.join(b, on).groupBy(F.col("a.n_nationkey").alias("n_nationkey")).agg(count().alias("siblings"))


@query("j_09_lateral_unnest", "SELECT doc_id, idx, length(passage) AS n FROM passages", ("passages",))
def j_09(spark, sf):
    return passages(spark, sf).select("doc_id", F.col("idx").cast("long").alias("idx"), F.length("passage").cast("long").alias("n"))


@query("j_09_lateral_top1", "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 1) AS last_order FROM customer")
def j_09_top1(spark, sf):
    o = best_of(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("last_order"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left")


@query(
    "j_10_theta",
    r"""SELECT DISTINCT c.conv_id, c.turn, n.title FROM conversations c JOIN (SELECT DISTINCT lower(text) AS t, item_id AS title FROM benchmark) n ON contains(lower(c.text), n.t)""",
)
def j_10(spark, sf):
    """Benchmark texts within turns: an equi-join on the benchmark text's first words, then the exact containment."""
    b = table(spark, sf, "benchmark").select(F.lower("text").alias("t"), F.col("item_id").alias("title")).distinct()
    b = b.withColumn("key", F.substring("t", 1, 16))
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.lower("text").alias("x"))
    short = b.where(F.length("t") < 16)
    starts = c.select("*", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("x") - 15))).alias("p")).withColumn("key", F.expr("substring(x, p, 16)"))
    long_hits = starts.join(b.where(F.length("t") >= 16), "key").where(F.contains("x", F.col("t")))
    short_hits = c.join(short, F.contains("x", F.col("t")))
    return long_hits.select("conv_id", "turn", "title").unionByName(short_hits.select("conv_id", "turn", "title")).distinct()


@query(
    "j_11_interval_overlap",
    """SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id
       AND a.ts < b.ts + INTERVAL 1 HOUR AND b.ts < a.ts + INTERVAL 1 HOUR""",
)
def j_11(spark, sf):
    """One-hour spans that begin at each event: overlaps within a user, met in hour bins."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    hour = 3_600_000_000
    a = e.select(F.col("event_id").alias("a_id"), "user_id", F.col("us").alias("a_us"), F.explode(F.array(*[F.floor(F.col("us") / hour) + k for k in (-1, 0, 1)])).alias("bin"))
    b = e.select(F.col("event_id").alias("b_id"), "user_id", F.col("us").alias("b_us"), F.floor(F.col("us") / hour).alias("bin"))
    return a.join(b, ["user_id", "bin"]).where("a_id < b_id and a_us < b_us + 3600000000 and b_us < a_us + 3600000000").select("a_id", "b_id")


@query(
    "j_12_self_overlap",
    """SELECT l_orderkey, count(*) AS clashes FROM (SELECT a.l_orderkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber
       AND a.l_shipdate < b.l_shipdate + INTERVAL 7 DAY AND b.l_shipdate < a.l_shipdate + INTERVAL 7 DAY AND a.l_returnflag <> b.l_returnflag) GROUP BY 1""",
)
def j_12(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag")
    a, b = l.alias("a"), l.alias("b")
    on = "a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber and a.l_shipdate < b.l_shipdate + interval 7 days and b.l_shipdate < a.l_shipdate + interval 7 days and a.l_returnflag <> b.l_returnflag"
    return a.join(b, F.expr(on)).groupBy(F.col("a.l_orderkey").alias("l_orderkey")).agg(count().alias("clashes"))


@query(
    "j_13_full_diff",
    """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'add' WHEN b.k IS NULL THEN 'remove' WHEN a.v <> b.v THEN 'update' ELSE 'same' END AS change
       FROM (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 7 <> 0) a FULL JOIN
            (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'X' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 11 <> 0) b ON a.k = b.k""",
)
def j_13(spark, sf):
    from lectern.operators.changes import keyed_diff

    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    new = c.where("k % 11 <> 0").withColumn("v", F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("v")))
    return keyed_diff(c.where("k % 7 <> 0"), new, ["k"], ["v"]).select("k", "change")


@query("j_14_recordset", "SELECT r.name, count(o.o_orderkey) AS n FROM (VALUES ('1-URGENT', 'first'), ('5-LOW', 'last'), ('0-NONE', 'never')) r(prio, name) LEFT JOIN orders o ON o.o_orderpriority = r.prio GROUP BY 1")
def j_14(spark, sf):
    given = '[{"prio":"1-URGENT","name":"first"},{"prio":"5-LOW","name":"last"},{"prio":"0-NONE","name":"never"}]'
    r = spark.range(1).select(F.inline(F.from_json(F.lit(given), "array<struct<prio:string,name:string>>")))
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("prio")).agg(count().alias("n"))
    return r.join(o, "prio", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


@query("j_15_given_ids", "SELECT k.k AS c_custkey, count(o.o_orderkey) AS n FROM (SELECT unnest([1, 2, 3, 999999]) AS k) k LEFT JOIN orders o ON o.o_custkey = k.k GROUP BY 1")
def j_15(spark, sf):
    k = spark.range(1).select(F.explode(F.array(*[F.lit(v).cast("long") for v in (1, 2, 3, 999_999)])).alias("c_custkey"))
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(count().alias("n"))
    return k.join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "j_16_superseded",
    """SELECT event_id FROM events e WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM events n WHERE n.user_id = e.user_id AND (n.ts, n.event_id) > (e.ts, e.event_id) AND n.event_type IN ('view', 'click'))""",
)
def j_16(spark, sf):
    """Jobs (views) of a file (user) that a newer live one follows: compared with the group's newest, no self join."""
    e = table(spark, sf, "events").where("event_type in ('view', 'click')").select("event_id", "user_id", "ts", "event_type")
    newest = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("top"))
    return e.where("event_type = 'view'").join(newest, "user_id").where(F.col("top") > F.struct("ts", "event_id")).select("event_id")


@query("j_17_dependency_gate", "SELECT n_nationkey FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name NOT IN ('ASIA', 'EUROPE')")
def j_17(spark, sf):
    failed = table(spark, sf, "region").where(F.col("r_name").isin("ASIA", "EUROPE")).select(F.col("r_regionkey").alias("n_regionkey"))
    return table(spark, sf, "nation").join(failed, "n_regionkey", "left_anti").select("n_nationkey")


@query("j_18_evidence_state", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus = 'O')")
def j_18(spark, sf):
    bad = table(spark, sf, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(bad, "o_orderkey", "left_anti")


# aggregates


@query("a_01_count", "SELECT count(*) AS total FROM visible WHERE language = 'en'", ("visible",))
def a_01(spark, sf):
    return readable(docs(spark, sf), "premium", "u3", language="en").agg(count().alias("total"))


def best_versions(spark, sf, keys=("entry_id", "language"), where="true"):
    """The version of the best source among those that meet ``where``: highest priority, then latest, then the smallest id.

    Taken from the publications at once: those of a source share its priority and id, so the best one is the latest of the best version.
    """
    order = [F.desc("priority"), F.desc("published_at"), F.asc("version_id")]
    return best_by_shares(publications(spark, sf).where(where), list(keys), order, "entry_id", "source_no", table(spark, sf, "lineitem").count())


BEST = "SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY priority DESC, published_at DESC, version_id) AS rk FROM versions"


@query("a_02_type_counts", f"SELECT e.entry_type, count(*) AS n FROM ({BEST.format(keys='entry_id, language')}) v JOIN entries e USING (entry_id) WHERE rk = 1 GROUP BY 1", ("versions", "entries"))
def a_02(spark, sf):
    return best_versions(spark, sf).select("entry_id").join(entries(spark, sf).select("entry_id", "entry_type"), "entry_id").groupBy("entry_type").agg(count().alias("n"))


@query("a_03_filtered_counts", "SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'purchase') AS done, count(*) - count(*) FILTER (WHERE event_type = 'error') AS ok FROM events GROUP BY 1")
def a_03(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(count().alias("total"), F.count_if(F.col("event_type") == "purchase").alias("done"), (count() - F.count_if(F.col("event_type") == "error")).alias("ok"))


@query("a_04_funnel", "SELECT count(DISTINCT user_id) FILTER (WHERE event_type = 'view') AS viewed, count(DISTINCT user_id) FILTER (WHERE event_type = 'click') AS clicked, count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS bought FROM events")
def a_04(spark, sf):
    """One row per (user, type) first, so that the three distinct counts share one narrow shuffle."""
    seen = table(spark, sf, "events").select("user_id", "event_type").where("user_id is not null").distinct()
    return seen.agg(*[F.count_if(F.col("event_type") == t).alias(n) for t, n in (("view", "viewed"), ("click", "clicked"), ("purchase", "bought"))])


@query("a_05_distinct", "SELECT DISTINCT entry_type, edition FROM entries", ("entries",))
def a_05(spark, sf):
    return entries(spark, sf).select("entry_type", "edition").distinct()


@query("a_06_ordered_list", "SELECT entry_type, level, string_agg(alias, ',' ORDER BY title, entry_id) AS aliases FROM entries GROUP BY 1, 2", ("entries",))
def a_06(spark, sf):
    listed = F.array_sort(F.collect_list(F.struct("title", "entry_id", "alias")))
    e = entries(spark, sf).groupBy("entry_type", "level").agg(listed.alias("l"))
    return e.select("entry_type", "level", F.array_join(F.transform("l", lambda x: x["alias"]), ",").alias("aliases"))


@query("a_07_nested_objects", "SELECT o_custkey, count(*) AS n, string_agg(o_orderkey || '@' || o_orderpriority, ';' ORDER BY o_orderdate, o_orderkey) AS orders FROM orders GROUP BY 1")
def a_07(spark, sf):
    nested = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderpriority")))
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(count().alias("n"), nested.alias("l"))
    shown = F.transform("l", lambda x: F.concat(x["o_orderkey"], F.lit("@"), x["o_orderpriority"]))
    return o.select("o_custkey", "n", F.array_join(shown, ";").alias("orders"))


@query(
    "a_08_source_stats",
    """SELECT d.source_id, count(*) AS pages, count(e.vec_id) AS embedded, count(*) - count(e.vec_id) AS missing, sum(length(d.text)) AS chars, max(d.doc_id) AS latest
       FROM docs d LEFT JOIN embeddings e ON d.doc_id = e.vec_id GROUP BY 1""",
    ("docs",),
)
def a_08(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("has"))
    d = docs(spark, sf).select("doc_id", "source_id", F.length("text").alias("n")).join(e, "doc_id", "left")
    return d.groupBy("source_id").agg(count().alias("pages"), F.count("has").alias("embedded"), (count() - F.count("has")).alias("missing"), F.sum("n").alias("chars"), F.max("doc_id").alias("latest"))


@query(
    "a_10_extraction_summary",
    "SELECT source_id, count(*) AS pages, sum(CASE WHEN length(trim(text)) >= 50 THEN 1 ELSE 0 END) AS with_text, sum(CASE WHEN length(trim(text)) < 50 THEN 1 ELSE 0 END) AS ocr FROM docs GROUP BY 1",
    ("docs",),
)
def a_10(spark, sf):
    enough = F.length(F.trim("text")) >= 50
    return docs(spark, sf).groupBy("source_id").agg(count().alias("pages"), F.count_if(enough).alias("with_text"), F.count_if(~enough).alias("ocr"))


@query("a_11_best_per_key", "SELECT l_partkey, max(l_extendedprice) AS best FROM lineitem GROUP BY 1")
def a_11(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.max("l_extendedprice").alias("best"))


@query(
    "a_13_evidence_coalesced",
    "SELECT l_orderkey, max(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.9 END) AS score, count(*) AS evidence FROM lineitem GROUP BY 1",
)
def a_13(spark, sf):
    s = F.max(F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.9))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(s.alias("score"), count().alias("evidence"))


@query("a_14_duplicates", "SELECT text_hash, count(*) AS n, 'ambiguous_duplicate' AS status FROM (SELECT md5(text) AS text_hash FROM documents) GROUP BY 1 HAVING count(*) > 1")
def a_14(spark, sf):
    return table(spark, sf, "documents").groupBy(F.md5("text").alias("text_hash")).agg(count().alias("n")).where("n > 1").withColumn("status", F.lit("ambiguous_duplicate"))


@query("a_16_fingerprint", "SELECT count(*) AS n, bit_xor(CAST(c_custkey * 2654435761 % 4294967296 AS BIGINT)) AS x1, bit_xor(CAST((c_custkey + c_nationkey) * 40503 % 65536 AS BIGINT)) AS x2, CAST(sum(c_custkey * 31 % 1000) AS BIGINT) AS s FROM customer")
def a_16(spark, sf):
    """Count, two xors and a sum of row hashes: the same in any row order."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, sf, "customer").agg(count().alias("n"), F.bit_xor(k * 2_654_435_761 % 4_294_967_296).alias("x1"), F.bit_xor((k + n) * 40_503 % 65_536).alias("x2"), F.sum(k * 31 % 1000).alias("s"))


@query("a_17_cardinality", "SELECT 'documents' AS metric, count(*) AS n FROM documents UNION ALL SELECT 'sources', count(DISTINCT source) FROM documents UNION ALL SELECT 'entries', count(*) FROM part")
def a_17(spark, sf):
    d = table(spark, sf, "documents")
    parts = [d.agg(count().alias("n")).select(F.lit("documents").alias("metric"), "n"), d.agg(F.countDistinct("source").alias("n")).select(F.lit("sources").alias("metric"), "n")]
    return parts[0].unionByName(parts[1]).unionByName(table(spark, sf, "part").agg(count().alias("n")).select(F.lit("entries").alias("metric"), "n"))


@query("a_18_mix", "SELECT count(DISTINCT source_id) AS sources, count(DISTINCT category) AS categories, count(*) FILTER (WHERE access_tier = 'open') AS open_docs FROM docs", ("docs",))
def a_18(spark, sf):
    return docs(spark, sf).agg(F.countDistinct("source_id").alias("sources"), F.countDistinct("category").alias("categories"), F.count_if(F.col("access_tier") == "open").alias("open_docs"))


@query("a_19_embedding_coverage", "SELECT language, count(*) AS total, count(vec_id) AS embedded, count(*) - count(vec_id) AS missing, round(count(vec_id) / count(*), 6) AS ratio FROM docs LEFT JOIN embeddings ON doc_id = vec_id GROUP BY 1", ("docs",))
def a_19(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("has"))
    d = docs(spark, sf).select("doc_id", "language").join(e, "doc_id", "left")
    return d.groupBy("language").agg(count().alias("total"), F.count("has").alias("embedded"), (count() - F.count("has")).alias("missing"), F.round(F.count("has") / count(), 6).alias("ratio"))


@query("a_20_page_grouping", "SELECT l_orderkey, string_agg(flag, chr(10) ORDER BY flag) AS slices FROM (SELECT DISTINCT l_orderkey, l_returnflag || l_linestatus AS flag FROM lineitem) GROUP BY 1")
def a_20(spark, sf):
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("s"))
    return l.select("l_orderkey", F.array_join("s", "\n").alias("slices"))


@query(
    "a_21_unique_best_class",
    "SELECT title, entry_id, level FROM (SELECT *, min(level) OVER (PARTITION BY title) AS lo, count(*) OVER (PARTITION BY title, level) AS n FROM entries) WHERE level = lo AND n = 1",
    ("entries",),
)
def a_21(spark, sf):
    """The entry of the lowest class per name, if it alone has that class: an aggregate, then one join."""
    e = entries(spark, sf).select("title", "entry_id", "level")
    per = e.groupBy("title", "level").agg(count().alias("n"), F.min("entry_id").alias("entry_id"))
    return per.groupBy("title").agg(F.min(F.struct("level", "n", "entry_id")).alias("b")).where("b.n = 1").select("title", F.col("b.entry_id").alias("entry_id"), F.col("b.level").alias("level"))


@query("a_22_next_number", "SELECT c_custkey, coalesce(max(n), 0) + 1 AS next_number FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey GROUP BY 1")
def a_22(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(count().alias("n"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left").groupBy("c_custkey").agg((F.coalesce(F.max("n"), F.lit(0)) + 1).alias("next_number"))


# windows


@query("w_01_best_source", f"SELECT entry_id, language, version_id FROM ({BEST.format(keys='entry_id, language')}) WHERE rk = 1", ("versions",))
def w_01(spark, sf):
    return best_versions(spark, sf).select("entry_id", "language", "version_id")


@query("w_02_best_any_language", f"SELECT entry_id, version_id FROM ({BEST.format(keys='entry_id')}) WHERE rk = 1", ("versions",))
def w_02(spark, sf):
    return best_versions(spark, sf, ("entry_id",)).select("entry_id", "version_id")


@query("w_03_best_by_tier", f"SELECT entry_id, language, access_tier, version_id FROM ({BEST.format(keys='entry_id, language, access_tier')}) WHERE rk = 1", ("versions",))
def w_03(spark, sf):
    return best_versions(spark, sf, ("entry_id", "language", "access_tier")).select("entry_id", "language", "access_tier", "version_id")


@query("w_04_best_exact", f"SELECT entry_id, nation, language, version_id FROM ({BEST.format(keys='entry_id, nation, language')}) WHERE rk = 1", ("versions",))
def w_04(spark, sf):
    return best_versions(spark, sf, ("entry_id", "nation", "language")).select("entry_id", "nation", "language", "version_id")


@query(
    "w_06_keep_one_job",
    "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, ts, event_id) = 1 THEN 'kept' ELSE 'cancelled' END AS state FROM events",
)
def w_06(spark, sf):
    e = best_of(table(spark, sf, "events"), ["user_id"], [(F.col("event_type") == "purchase").desc(), F.asc("ts"), F.asc("event_id")], "r")
    return e.select("event_id", F.when(F.col("r") == 1, "kept").otherwise("cancelled").alias("state"))


@query("w_07_latest", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def w_07(spark, sf):
    return latest(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("w_08_strategy_rank", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem")
def w_08(spark, sf):
    r = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r.alias("rank"))


@query("w_09_running_index", "SELECT doc_id, idx, row_number() OVER (PARTITION BY source_id ORDER BY doc_id, idx) - 1 AS chunk_index FROM passages", ("passages",))
def w_09(spark, sf):
    """Contiguous passage index within a source: counts per document, summed within runs of ids, then over the runs, so a large source is no one task."""
    d = docs(spark, sf).select("doc_id", "source_id", F.size(F.split("text", "\n")).alias("n"), F.floor(F.col("doc_id") / 4096).alias("run"))

    def before(keys, order, c):
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(c).over(w), F.lit(0))

    runs = d.groupBy("source_id", "run").agg(F.sum("n").alias("n")).select("source_id", "run", before(["source_id"], "run", "n").alias("run_base"))
    base = d.select("doc_id", "source_id", "run", before(["source_id", "run"], "doc_id", "n").alias("own"))
    base = base.join(runs, ["source_id", "run"]).select("doc_id", (F.col("own") + F.col("run_base")).alias("base"))
    return passages(spark, sf).select("doc_id", "idx").join(base, "doc_id").select("doc_id", F.col("idx").cast("long").alias("idx"), (F.col("base") + F.col("idx")).alias("chunk_index"))


@query("w_10_first_occurrence", "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1 THEN 'first' ELSE 'duplicate' END AS status FROM documents")
def w_10(spark, sf):
    """The smallest id per text hash by aggregate and join: copies of one text never meet in one window."""
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("first"))
    return d.join(first, d["h"].eqNullSafe(first["h"])).select("doc_id", F.when(F.col("doc_id") == F.col("first"), "first").otherwise("duplicate").alias("status"))


# sorts, limits, pages


@query("o_05_entity_order", "SELECT entry_type, entry_id, version_id, priority FROM versions JOIN entries USING (entry_id) ORDER BY entry_type, entry_id, priority DESC, language, version_id LIMIT 200", ("versions", "entries"))
def o_05(spark, sf):
    j = versions(spark, sf).join(entries(spark, sf).select("entry_id", "entry_type"), "entry_id")
    return j.orderBy("entry_type", "entry_id", F.desc("priority"), "language", "version_id").limit(200).select("entry_type", "entry_id", "version_id", "priority")


@query("o_06_offset_page", "SELECT doc_id, (SELECT count(*) FROM visible) AS total, 60 < (SELECT count(*) FROM visible) AS has_more FROM visible ORDER BY doc_id LIMIT 20 OFFSET 40", ("visible",))
def o_06(spark, sf):
    return offset_page(readable(docs(spark, sf), "premium", "u3").select("doc_id"), [F.asc("doc_id")], 20, 40)


@query("o_07_list", "SELECT title, entry_id, edition FROM entries ORDER BY title, entry_id, edition LIMIT 200 OFFSET 100", ("entries",))
def o_07(spark, sf):
    return entries(spark, sf).orderBy("title", "entry_id", "edition").offset(100).limit(200).select("title", "entry_id", "edition")


@query(
    "o_08_keyset_page",
    "SELECT name, entry_id, (SELECT count(*) > 24 FROM entries WHERE (lower(title), entry_id) > ('red widget', 50)) AS has_more FROM (SELECT lower(title) AS name, entry_id FROM entries) WHERE (name, entry_id) > ('red widget', 50) ORDER BY name, entry_id LIMIT 24",
    ("entries",),
)
def o_08(spark, sf):
    return keyset_page(entries(spark, sf).select(F.lower("title").alias("name"), "entry_id"), ["name", "entry_id"], ("red widget", 50))


@query(
    "o_09_enum_order",
    "SELECT edition, title, entry_id FROM entries ORDER BY CASE edition WHEN '5e' THEN 1 ELSE 2 END, title, entry_id LIMIT 50",
    ("entries",),
)
def o_09(spark, sf):
    return entries(spark, sf).orderBy(ordinal("edition", EDITIONS), "title", "entry_id").limit(50).select("edition", "title", "entry_id")


@query("o_10_numeric_keyset", "SELECT cost, title, entry_id, true AS has_more FROM entries WHERE (cost, title, entry_id) > (910.0, 'a', 0) ORDER BY cost, title, entry_id LIMIT 24", ("entries",))
def o_10(spark, sf):
    return keyset_page(entries(spark, sf).select("cost", "title", "entry_id"), ["cost", "title", "entry_id"], (910.0, "a", 0))


@query(
    "o_12_enum_groups",
    "SELECT entry_type, count(*) AS n, row_number() OVER (ORDER BY CASE entry_type WHEN 'spell' THEN 1 WHEN 'feat' THEN 2 WHEN 'item' THEN 3 ELSE 4 END) AS place FROM entries GROUP BY 1",
    ("entries",),
)
def o_12(spark, sf):
    g = entries(spark, sf).groupBy("entry_type").agg(count().alias("n"))
    return g.select("entry_type", "n", F.row_number().over(Window.orderBy(ordinal("entry_type", ENTRY_TYPES))).alias("place"))


@query("o_14_nulls_last", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) ORDER BY l.quality NULLS LAST, d.doc_id LIMIT 100")
def o_14(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.orderBy(F.col("quality").asc_nulls_last(), "doc_id").limit(100).select("doc_id", "quality")


@query("o_15_byte_order", "SELECT canonical_key, row_number() OVER (ORDER BY canonical_key) AS place FROM entries", ("entries",))
def o_15(spark, sf):
    """All entries in byte order, with their place in it; no task holds more than its share."""
    checkpoint_dir(spark)
    return places(entries(spark, sf).select("canonical_key"), "canonical_key", "place")


# set operations


@query("u_01_edges_both_ways", "SELECT n_regionkey AS a, n_nationkey AS b, 'out' AS direction FROM nation UNION ALL SELECT n_nationkey, n_regionkey, 'in' FROM nation")
def u_01(spark, sf):
    n = table(spark, sf, "nation")
    out = n.select(F.col("n_regionkey").alias("a"), F.col("n_nationkey").alias("b"), F.lit("out").alias("direction"))
    return out.unionByName(n.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b"), F.lit("in").alias("direction")))


@query("u_02_union_distinct", "SELECT doc_id FROM labels UNION SELECT vec_id FROM embeddings")
def u_02(spark, sf):
    return table(spark, sf, "labels").select("doc_id").union(table(spark, sf, "embeddings").select("vec_id")).distinct()


@query("u_04_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def u_04(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").exceptAll(table(spark, sf, "orders").select("o_custkey").distinct()).distinct()


@query("u_05_membership", "SELECT doc_id FROM labels INTERSECT SELECT vec_id FROM embeddings")
def u_05(spark, sf):
    return table(spark, sf, "labels").select("doc_id").intersect(table(spark, sf, "embeddings").select("vec_id"))


@query("u_06_first_wins", "SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2")
def u_06(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("o_orderkey"))

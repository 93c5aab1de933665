"""Change data, graphs and constraints over the corpus model."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import changes as cdc
from lectern.operators import graph
from lectern.operators.extraction import decided
from lectern.plans.base import query
from lectern.sources.stores import checkpoint_dir, export, new_path, write_jsonl
from lectern.sources.views import docs, entries, table, versions


def count():
    """Rows of a group."""
    return F.count(F.lit(1))


def two_runs(spark, sf):
    """Previous run: even documents by text hash; this run: all but those divisible by 6, some texts changed."""
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    new = d.where("doc_id % 6 <> 0").withColumn("h", F.when(F.col("doc_id") % 10 == 4, F.lit("changed")).otherwise(F.col("h")))
    return d.where("doc_id % 2 = 0"), new


RUNS = """WITH old AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 2 = 0),
 new AS (SELECT doc_id, CASE WHEN doc_id % 10 = 4 THEN 'changed' ELSE md5(text) END AS h FROM documents WHERE doc_id % 6 <> 0) """


@query(
    "cdc_01_sync_plan",
    RUNS + "SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'add' WHEN n.doc_id IS NULL THEN 'remove' WHEN o.h <> n.h THEN 'update' ELSE 'same' END AS change FROM old o FULL JOIN new n ON o.doc_id = n.doc_id",
)
def cdc_01(spark, sf):
    old, new = two_runs(spark, sf)
    return cdc.keyed_diff(old, new, ["doc_id"], ["h"])


CANDIDATES = """WITH prev AS (SELECT p_name || '/' || p_size AS k, min(p_type) AS content FROM part WHERE p_partkey % 3 = 0 GROUP BY 1),
 batch AS (SELECT p_name || '/' || p_size AS k, p_type AS content, p_partkey AS ix, CASE WHEN p_retailprice > 1090 THEN 'price' END AS invalid FROM part WHERE p_partkey % 3 <> 1),
 marked AS (SELECT *, min(ix) OVER (PARTITION BY k) AS first FROM batch)
 SELECT m.k, m.ix AS occurrence, CASE WHEN m.ix <> m.first THEN 'duplicate' WHEN m.invalid IS NOT NULL THEN 'invalid' WHEN p.k IS NULL THEN 'new' WHEN p.content = m.content THEN 'unchanged' ELSE 'changed' END AS status
 FROM marked m LEFT JOIN prev p ON m.k = p.k UNION ALL SELECT k, NULL, 'missing' FROM prev WHERE k NOT IN (SELECT k FROM batch)"""


def candidate_rows(spark, sf):
    p = table(spark, sf, "part").select(F.concat_ws("/", "p_name", "p_size").alias("k"), F.col("p_type").alias("content"), F.col("p_partkey").alias("ix"), "p_retailprice")
    prev = p.where("ix % 3 = 0").groupBy("k").agg(F.min("content").alias("content"))
    batch = p.where("ix % 3 <> 1").select("k", "content", "ix", F.when(F.col("p_retailprice") > 1090, "price").alias("invalid"))
    return cdc.candidate_statuses(prev, batch, "k", "content", "ix", "invalid")


@query("cdc_02_candidate_diff", CANDIDATES)
def cdc_02(spark, sf):
    return candidate_rows(spark, sf)


@query("a_15_run_counters", "SELECT status, count(*) AS n FROM (" + CANDIDATES + ") GROUP BY 1")
def a_15(spark, sf):
    return candidate_rows(spark, sf).groupBy("status").agg(count().alias("n"))


@query(
    "cdc_03_export_changes",
    RUNS
    + """SELECT coalesce(n.doc_id, o.doc_id) AS entry_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'updated' END AS kind, o.h AS previous, n.h AS current
      FROM old o FULL JOIN new n ON o.doc_id = n.doc_id WHERE o.h IS DISTINCT FROM n.h""",
)
def cdc_03(spark, sf):
    """Change records with the previous and current revision; removals are tombstones without a current one."""
    old, new = two_runs(spark, sf)
    j = old.withColumnRenamed("h", "previous").join(new.withColumnRenamed("h", "current"), "doc_id", "full_outer").where(~F.col("previous").eqNullSafe(F.col("current")))
    kind = F.when(F.col("previous").isNull(), "added").when(F.col("current").isNull(), "removed").otherwise("updated")
    return j.select(F.col("doc_id").alias("entry_id"), kind.alias("kind"), "previous", "current")


@query(
    "cdc_04_change_feed",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'upserted' END AS kind, CASE WHEN event_type = 'error' THEN ts + INTERVAL 1 HOUR ELSE ts END AS changed_at FROM events
       WHERE CASE WHEN event_type = 'error' THEN ts + INTERVAL 1 HOUR ELSE ts END > TIMESTAMP '2024-01-29 00:00:00' ORDER BY 3, 1 LIMIT 200""",
)
def cdc_04(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", F.when(F.col("event_type") == "error", F.expr("ts + interval 1 hour")).alias("retired"))
    feed = cdc.change_feed(e, F.lit("2024-01-29 00:00:00").cast("timestamp"), "ts", "retired", "event_id")
    return feed.limit(200).select("event_id", "kind", F.col("changed_at"))


@query(
    "cdc_06_reconcile",
    """SELECT s.s_suppkey AS k, CASE WHEN s.s_suppkey % 3 = 0 AND s.s_suppkey % 2 = 0 THEN 'collision' WHEN s.s_suppkey % 3 = 0 THEN 'keep' ELSE 'delete' END AS action FROM supplier s WHERE s.s_suppkey % 3 = 0 OR s.s_suppkey % 5 = 0""",
)
def cdc_06(spark, sf):
    """Managed rows not wanted any more are deleted; a wanted key held by an unmanaged row is a collision."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    wanted = s.where("k % 3 = 0").withColumn("wanted", F.lit(True))
    held = s.where("k % 3 = 0 or k % 5 = 0").withColumn("managed", F.col("k") % 2 == 1)
    j = held.join(wanted, "k", "left")
    action = F.when(F.col("wanted") & ~F.col("managed"), "collision").when(F.col("wanted"), "keep").otherwise("delete")
    return j.select("k", action.alias("action"))


GENERATIONS = "SELECT user_id AS file, event_id AS g, ts, CASE event_type WHEN 'purchase' THEN 'staged' WHEN 'signup' THEN 'active' ELSE 'archived' END AS status FROM events"


@query(
    "cdc_07_activate",
    f"""SELECT file, g, CASE WHEN status = 'staged' AND rk = 1 THEN 'active' WHEN status = 'staged' THEN 'refused' WHEN status = 'active' AND n > 0 THEN 'archived' ELSE status END AS status
        FROM (SELECT *, row_number() OVER (PARTITION BY file, status ORDER BY ts DESC, g DESC) AS rk, count(*) FILTER (WHERE status = 'staged') OVER (PARTITION BY file) AS n FROM ({GENERATIONS}))""",
)
def cdc_07(spark, sf):
    e = table(spark, sf, "events")
    status = F.when(F.col("event_type") == "purchase", "staged").when(F.col("event_type") == "signup", "active").otherwise("archived")
    return cdc.activate(e.select(F.col("user_id").alias("file"), F.col("event_id").alias("g"), "ts", status.alias("status")), "file", "g", "ts", "status")


@query("cdc_08_stale_staged", "SELECT event_id FROM events s WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM events f WHERE f.user_id = s.user_id AND f.event_type = 'error')")
def cdc_08(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return e.where("event_type = 'purchase'").join(e.where("event_type = 'error'").select("user_id"), "user_id", "left_semi").select("event_id")


FOLDED = """WITH last AS (SELECT k, arg_max(CASE WHEN kind = 'error' THEN '' ELSE kind END, g) AS v FROM (SELECT user_id % 200 AS k, event_id AS g, event_type AS kind, event_id % 4 AS contract FROM events) WHERE contract = 1 GROUP BY 1)
       SELECT k, v FROM (SELECT coalesce(l.k, b.k) AS k, CASE WHEN l.k IS NULL THEN b.v ELSE nullif(l.v, '') END AS v FROM (SELECT c_custkey AS k, c_mktsegment AS v FROM customer) b FULL JOIN last l ON b.k = l.k) WHERE v IS NOT NULL"""


def folded(spark, sf, base):
    e = table(spark, sf, "events")
    value = F.when(F.col("event_type") != "error", F.col("event_type"))
    deltas = e.select((F.col("user_id") % 200).alias("k"), F.col("event_id").alias("g"), value.alias("v"), (F.col("event_id") % 4).alias("contract"))
    return cdc.fold_deltas(base.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v")), deltas, "k", "g", "v", "contract")


@query("cdc_09_fold_deltas", FOLDED)
def cdc_09(spark, sf):
    return folded(spark, sf, table(spark, sf, "customer"))


MISSING = "SELECT doc_id FROM visible v WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = v.doc_id)"


def without_vector(spark, sf):
    from lectern.functions.access import readable

    d = readable(docs(spark, sf), "premium", "u3").select("doc_id")
    return d.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("cdc_10_backfill", MISSING, ("visible",))
def cdc_10(spark, sf):
    """All batches: every row without a vector."""
    return without_vector(spark, sf)


@query("cdc_11_resume", RUNS + "SELECT n.doc_id, CASE WHEN o.doc_id IS NULL THEN 'stage' WHEN o.h = n.h THEN 'skip' ELSE 'mismatch' END AS action FROM new n LEFT JOIN old o ON o.doc_id = n.doc_id")
def cdc_11(spark, sf):
    old, new = two_runs(spark, sf)
    j = new.join(old.select("doc_id", F.col("h").alias("done")), "doc_id", "left")
    return j.select("doc_id", F.when(F.col("done").isNull(), "stage").when(F.col("done") == F.col("h"), "skip").otherwise("mismatch").alias("action"))


@query("cdc_13_latest_pointer", "SELECT user_id, max(event_id) AS generation FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1")
def cdc_13(spark, sf):
    return table(spark, sf, "events").where("event_type in ('view', 'purchase')").groupBy("user_id").agg(F.max("event_id").alias("generation"))


@query("snk_01_upsert", "SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'NEW' ELSE c_mktsegment END AS v FROM customer")
def snk_01(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return cdc.upsert(c, c.where("k % 5 = 0").withColumn("v", F.lit("NEW")), ["k"])


@query("snk_04_insert_missing", "SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE 'new' END AS v FROM customer")
def snk_04(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return cdc.insert_missing(c.where("k % 2 = 0").withColumn("v", F.lit("old")), c.withColumn("v", F.lit("new")), ["k"])


@query("snk_02_jsonl", "SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer")
def snk_02(spark, sf):
    """Customers written as JSON lines of bounded size, and read back."""
    path = new_path(spark, "jsonl")
    write_jsonl(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), path, 1 << 40)
    back = spark.read.text(path).select(F.from_json("value", "c_custkey long, c_name string, c_acctbal double").alias("r"))
    return back.select("r.c_custkey", "r.c_name", F.round("r.c_acctbal", 2).alias("c_acctbal"))


@query("snk_03_export", "SELECT doc_id, md5(text) AS h, count(*) OVER () AS n_rows, true AS same_checksum FROM documents")
def snk_03(spark, sf):
    """Documents exported in byte order with a manifest; the export of the same rows in another order of reading has the same checksum, and its rows are read back."""
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    path = new_path(spark, "export")
    manifest = export(d, path, "doc_id")
    again = export(d.repartition(3, "h"), new_path(spark, "export"), "doc_id").select(F.col("checksum").alias("other"))
    back = spark.read.text(f"{path}/entries").select(F.from_json("value", "doc_id long, h string").alias("r")).select("r.*")
    one = manifest.crossJoin(again).select(F.col("rows").alias("n_rows"), (F.col("checksum") == F.col("other")).alias("same_checksum"))  # one row
    return back.crossJoin(F.broadcast(one))


@query("snk_05_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def snk_05(spark, sf):
    """Nations written as CSV with a header, and read back."""
    path, n = new_path(spark, "csv"), table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    n.write.csv(path, header=True)
    return spark.read.schema(n.schema).csv(path, header=True)


@query("snk_06_report_json", "SELECT count(*) AS n, sum(CASE WHEN length(text) >= 50 THEN 1 ELSE 0 END) AS with_text FROM documents")
def snk_06(spark, sf):
    r = table(spark, sf, "documents").agg(count().alias("n"), F.count_if(F.length("text") >= 50).alias("with_text")).select(F.to_json(F.struct("n", "with_text")).alias("j"))
    return r.select(F.from_json("j", "n long, with_text long").alias("r")).select("r.*")


# graphs: nations under regions, and parts that follow each other in an order


def parent_edges(spark, sf):
    """A forest over all parts: a part's parent is half its key; the smallest keys are a chain that ends in a loop."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("child"))
    return p.select("child", F.when(F.col("child") == 1, F.lit(4).cast("long")).otherwise(F.floor(F.col("child") / 2)).alias("parent")).where("child > 0")


EDGES = "edges AS (SELECT p_partkey AS child, CASE WHEN p_partkey = 1 THEN 4 ELSE p_partkey // 2 END AS parent FROM part WHERE p_partkey > 0)"
# a walk ends where it would come to a node again
WALK = f"""WITH RECURSIVE {EDGES},
 walk(node, ancestor, depth, path) AS (SELECT child, parent, 1, [parent] FROM edges UNION ALL
   SELECT w.node, e.parent, w.depth + 1, list_append(w.path, e.parent) FROM walk w JOIN edges e ON w.ancestor = e.child WHERE NOT list_contains(w.path, e.parent)) """


@query("h_01_cycles", WALK + "SELECT DISTINCT node FROM walk WHERE node = ancestor")
def h_01(spark, sf):
    checkpoint_dir(spark)
    return graph.cycles(parent_edges(spark, sf))


@query("h_02_ancestors", WALK + "SELECT node, ancestor, min(depth) AS depth FROM walk GROUP BY 1, 2")
def h_02(spark, sf):
    checkpoint_dir(spark)
    return graph.closure(parent_edges(spark, sf))


@query("u_03_recursive_union", WALK + "SELECT ancestor, count(DISTINCT node) AS below FROM walk GROUP BY 1")
def u_03(spark, sf):
    checkpoint_dir(spark)
    return graph.closure(parent_edges(spark, sf)).groupBy("ancestor").agg(F.count("node").alias("below"))  # a pair has one row


@query("h_03_resolution", "SELECT v.version_id, w.version_id AS target, w.version_id IS NULL AS missing FROM versions v LEFT JOIN versions w ON w.entry_id = v.entry_id // 2 AND w.source_no = v.source_no AND w.language = v.language", ("versions",))
def h_03(spark, sf):
    """Relations of all versions to their target in the same source and language, or missing."""
    v = versions(spark, sf).select("entry_id", "source_no", "language", "version_id")
    w = v.withColumnRenamed("version_id", "target")
    a = v.withColumn("entry_id", F.floor(F.col("entry_id") / 2))
    return a.join(w, ["entry_id", "source_no", "language"], "left").select("version_id", "target", F.col("target").isNull().alias("missing"))


@query("h_04_affected", f"WITH RECURSIVE {EDGES}, hit(node) AS (SELECT 37 UNION SELECT e.child FROM hit h JOIN edges e ON e.parent = h.node) SELECT CAST(node AS BIGINT) AS node FROM hit")
def h_04(spark, sf):
    """Everything that a change of one entry reaches: its dependents, to a fixed point."""
    checkpoint_dir(spark)
    e = parent_edges(spark, sf).select(F.col("parent").alias("a"), F.col("child").alias("b"))
    return graph.reach(spark.range(37, 38).select(F.col("id").alias("node")), e)


@query("h_05_resolved_only", "SELECT e.entry_id, e.entry_id // 2 AS target FROM entries e WHERE e.entry_id // 2 IN (SELECT entry_id FROM entries WHERE edition = '5e')", ("entries",))
def h_05(spark, sf):
    e = entries(spark, sf)
    return e.select("entry_id", F.floor(F.col("entry_id") / 2).alias("target")).join(e.where("edition = '5e'").select(F.col("entry_id").alias("target")), "target", "left_semi").select("entry_id", "target")


# constraints as queries for what breaks them


@query(
    "v_01_access_shape",
    "SELECT source_id FROM src WHERE NOT ((access_tier = 'open' AND owner_id IS NULL) OR (access_tier = 'premium' AND is_shared AND owner_id IS NULL) OR (access_tier = 'personal' AND NOT is_shared AND owner_id IS NOT NULL))",
    ("src",),
)
def v_01(spark, sf):
    from lectern.sources.views import sources

    t, shared, owner = F.col("access_tier"), F.col("is_shared"), F.col("owner_id")
    ok = ((t == "open") & owner.isNull()) | ((t == "premium") & shared & owner.isNull()) | ((t == "personal") & ~shared & owner.isNotNull())
    return sources(spark, sf).where(~ok).select("source_id")


@query(
    "v_02_exact_quote",
    """SELECT doc_id, fault FROM (SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN 'outside' WHEN 2 THEN CASE WHEN contains(q, 'e') THEN 'altered' END WHEN 1 THEN CASE WHEN lower(c) = lower(q) AND c <> q THEN 'altered' WHEN c <> q THEN 'shifted' END END AS fault
       FROM (SELECT doc_id, substr(text, 11, 20) AS q, substr(text, 12, 20) AS c FROM documents WHERE length(text) >= 31)) WHERE fault IS NOT NULL""",
)
def v_02(spark, sf):
    """Citations (span in code points, quote) that break the exact-quote rule. Of every five documents one cites a shifted span, one an altered quote, one a span past its end."""
    k, n = F.col("doc_id") % 5, F.length("text")
    d = table(spark, sf, "documents").where(n >= 31)
    start = F.when(k == 1, 11).when(k == 3, n).otherwise(10)
    quote = F.substring("text", 11, 20)
    c = d.select("doc_id", "text", start.alias("start"), (start + 20).alias("stop"), F.when(k == 2, F.replace(quote, F.lit("e"), F.lit("E"))).otherwise(quote).alias("quote"))
    cited = F.substring(F.col("text"), F.col("start") + 1, F.col("stop") - F.col("start"))
    fault = F.when(F.col("stop") > F.length("text"), "outside").when(cited != F.col("quote"), F.when(F.lower(cited) == F.lower("quote"), "altered").otherwise("shifted"))
    return c.select("doc_id", fault.alias("fault")).where("fault is not null")


@query("v_03_one_active", f"SELECT file, count(*) AS n FROM ({GENERATIONS}) WHERE status = 'active' GROUP BY 1 HAVING count(*) > 1")
def v_03(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'signup'")
    return e.groupBy(F.col("user_id").alias("file")).agg(count().alias("n")).where("n > 1")


@query("v_04_progression", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) <> max(l_linenumber) OR min(l_linenumber) <> 1")
def v_04(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_linenumber").alias("n"), F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))
    return g.where("n <> hi or lo <> 1").select("l_orderkey")


@query(
    "v_09_transitions",
    """SELECT event_id, before, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
       WHERE before IS NOT NULL AND NOT ((before = 'view' AND event_type IN ('click', 'error')) OR (before = 'click' AND event_type IN ('purchase', 'view')))""",
)
def v_09(spark, sf):
    rules = {"view": ("click", "error"), "click": ("purchase", "view")}
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return cdc.check_transitions(e, "user_id", ["ts", "event_id"], "event_type", rules).select("event_id", "before", "event_type")


@query("v_07_review_shape", "SELECT doc_id FROM labels WHERE NOT ((quality = 1 AND toxic IN (0, 1)) OR (quality = 0 AND toxic = 0))")
def v_07(spark, sf):
    ok = ((F.col("quality") == 1) & F.col("toxic").isin(0, 1)) | ((F.col("quality") == 0) & (F.col("toxic") == 0))
    return table(spark, sf, "labels").where(~ok).select("doc_id")


@query("x_11_decision_rules", "SELECT status, decision, CASE decision WHEN 'approve' THEN status IN ('new', 'changed', 'unchanged') WHEN 'merge' THEN status <> 'missing' WHEN 'unpublish' THEN status = 'missing' ELSE true END AS allowed FROM (SELECT unnest(['new', 'changed', 'unchanged', 'missing', 'duplicate', 'invalid']) AS status), (SELECT unnest(['approve', 'merge', 'unpublish', 'reject']) AS decision)")
def x_11(spark, sf):
    one = spark.range(1)
    statuses = one.select(F.explode(F.array(*[F.lit(x) for x in ("new", "changed", "unchanged", "missing", "duplicate", "invalid")])).alias("status"))
    both = statuses.select("status", F.explode(F.array(*[F.lit(x) for x in ("approve", "merge", "unpublish", "reject")])).alias("decision"))
    d, s = F.col("decision"), F.col("status")
    allowed = F.when(d == "approve", s.isin("new", "changed", "unchanged")).when(d == "merge", s != "missing").when(d == "unpublish", s == "missing").otherwise(True)
    return both.select("status", "decision", allowed.alias("allowed"))


@query(
    "x_11_decisions",
    "SELECT k, occurrence, status, decision, CASE decision WHEN 'approve' THEN status IN ('new', 'changed', 'unchanged') WHEN 'merge' THEN status <> 'missing' WHEN 'unpublish' THEN status = 'missing' ELSE true END AS allowed FROM (SELECT *, ['approve', 'merge', 'unpublish', 'reject'][length(k) % 4 + 1] AS decision FROM (" + CANDIDATES + "))",
)
def x_11_decisions(spark, sf):
    """A decision on each candidate of the diff, and whether its status allows it."""
    decision = F.element_at(F.array(*map(F.lit, ("approve", "merge", "unpublish", "reject"))), F.length("k") % 4 + 1)
    return decided(candidate_rows(spark, sf).withColumn("decision", decision)).select("k", "occurrence", "status", "decision", "allowed")


@query("x_16_card_fingerprint", """SELECT p_partkey, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '"}') = sha256('{"brand":"' || CASE WHEN p_partkey % 9 = 0 THEN 'other' ELSE p_brand END || '","name":"' || p_name || '"}') AS intact FROM part""")
def x_16(spark, sf):
    """Recorded fingerprints of cards (every ninth recorded wrongly) against the hash of their canonical JSON."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_name").alias("name"))
    recorded = F.when(F.col("p_partkey") % 9 == 0, "other").otherwise(F.col("brand"))

    def card(brand):
        return F.sha2(F.to_json(F.struct(brand.alias("brand"), F.col("name"))), 256)

    return p.select("p_partkey", (card(F.col("brand")) == card(recorded)).alias("intact"))


@query(
    "v_08_sections_cover",
    """SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'gap' WHEN 2 THEN 'overlap' ELSE 'short' END AS fault FROM (SELECT doc_id, text, len(string_split(text, chr(10))) AS n, length(text) AS size FROM documents)
       WHERE (doc_id % 4 IN (1, 2) AND n >= 3) OR (doc_id % 4 = 3 AND n >= 2)""",
)
def v_08(spark, sf):
    """Revisions whose sections don't cover their text without gaps or overlaps. Sections are lines; some documents lack their second or last one, or have it begin too early."""
    from lectern.sources.views import passages

    p = passages(spark, sf).select("doc_id", "idx", F.length("passage").alias("n"))
    w = Window.partitionBy("doc_id").orderBy("idx")
    end = F.sum(F.col("n") + 1).over(w)
    s = p.select("doc_id", "idx", (end - F.col("n") - 1).alias("start"), end.alias("stop"), F.max("idx").over(Window.partitionBy("doc_id")).alias("last"))
    k, inner = F.col("doc_id") % 4, F.col("last") >= 2
    s = s.where(~((k == 1) & inner & (F.col("idx") == 1)) & ~((k == 3) & (F.col("last") >= 1) & (F.col("idx") == F.col("last"))))
    s = s.withColumn("start", F.when((k == 2) & inner & (F.col("idx") == 1), F.col("start") - 1).otherwise(F.col("start")))
    before = F.lag("stop").over(w)
    step = s.select("doc_id", "stop", F.when(before.isNull() & (F.col("start") > 0), 1).when(F.col("start") > before, 1).alias("gap"), F.when(F.col("start") < before, 1).alias("overlap"))
    g = step.groupBy("doc_id").agg(F.max("stop").alias("stop"), F.count("gap").alias("gaps"), F.count("overlap").alias("overlaps"))
    d = docs(spark, sf).select("doc_id", F.length("text").alias("size"))
    fault = F.when(F.col("gaps") > 0, "gap").when(F.col("overlaps") > 0, "overlap").when(F.col("stop") - 1 < F.col("size"), "short")
    return g.join(d, "doc_id").select("doc_id", fault.alias("fault")).where("fault is not null")


@query(
    "v_10_file_hashes",
    """SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 13 = 1 AND strlen(substr(text, 1, 1)) = 1 THEN 'hash' ELSE 'size' END AS fault FROM documents WHERE doc_id % 13 IN (0, 1, 2) AND text IS NOT NULL""",
)
def v_10(spark, sf):
    """Files against a manifest of an earlier state: some have gone from it, some had other bytes of the same length, some another length."""
    k, d = F.col("doc_id") % 13, table(spark, sf, "documents").where("text is not null")
    earlier = F.when(k == 1, F.concat(F.lit("\x01"), F.expr("substring(text, 2)"))).when(k == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    manifest = d.where(k != 0).select("doc_id", F.sha2(earlier, 256).alias("hash"), F.octet_length(earlier).alias("size"))
    found = d.select("doc_id", F.sha2("text", 256).alias("found"), F.octet_length("text").alias("bytes"))
    fault = F.when(F.col("hash").isNull(), "missing").when((F.col("hash") != F.col("found")) & (F.col("size") != F.col("bytes")), "size").when(F.col("hash") != F.col("found"), "hash")
    return found.join(manifest, "doc_id", "left").select("doc_id", fault.alias("fault")).where("fault is not null")


@query(
    "cdc_12_export_recheck",
    RUNS
    + """SELECT problem, count(*) AS n FROM (
       SELECT CASE WHEN k % 11 = 0 THEN 'lost' WHEN k % 11 = 1 THEN 'hash' ELSE 'kind' END AS problem FROM (SELECT coalesce(o.doc_id, n.doc_id) AS k, o.doc_id IS NULL AS added FROM old o FULL JOIN new n ON o.doc_id = n.doc_id WHERE o.h IS DISTINCT FROM n.h) WHERE k % 11 < 2 OR (k % 11 = 2 AND added)
       UNION ALL SELECT 'invented' FROM old o JOIN new n ON o.doc_id = n.doc_id WHERE o.h = n.h AND o.doc_id % 11 = 3) GROUP BY 1""",
)
def cdc_12(spark, sf):
    """An export's change records checked against its two catalogs. The records have faults: some are lost, some invented, some with a wrong hash or kind."""
    old, new = two_runs(spark, sf)
    k = F.col("entry_id") % 11
    stored = cdc_03(spark, sf).where(k != 0).withColumn("kind", F.when((k == 2) & (F.col("kind") == "added"), "updated").otherwise(F.col("kind")))
    stored = stored.withColumn("previous", F.when(k == 1, F.lit("wrong")).otherwise(F.col("previous")))
    same = old.join(new.withColumnRenamed("h", "h2"), "doc_id").where("h = h2 and doc_id % 11 = 3")
    stored = stored.unionByName(same.select(F.col("doc_id").alias("entry_id"), F.lit("updated").alias("kind"), F.col("h").alias("previous"), F.col("h2").alias("current")))
    return cdc.export_problems(stored, old, new, "doc_id", "h").groupBy("problem").agg(count().alias("n"))


@query(
    "x_12_unpublish_capability",
    """SELECT p.doc_id FROM (SELECT doc_id, source, md5(text) AS h FROM documents WHERE doc_id % 2 = 0) p JOIN labels l ON l.doc_id = p.doc_id AND l.quality = 1
       WHERE p.doc_id % 6 = 0""",
)
def x_12(spark, sf):
    """Missing rows that may be unpublished: in the previous run, gone from this one, with an approved (quality 1) publication of the same row."""
    old, new = two_runs(spark, sf)
    approved = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return old.join(new.select("doc_id"), "doc_id", "left_anti").join(approved, "doc_id", "left_semi").select("doc_id")

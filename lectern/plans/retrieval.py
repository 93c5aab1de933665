"""Retrieval queries; documents stand as chunks, their first words as headings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.access import readable
from lectern.operators import retrieval as R
from lectern.operators.postings import index_search, read_index, write_index
from lectern.plans.base import query
from lectern.sources.stores import new_path
from lectern.sources.views import docs, entries, table

QUESTION = 'the that OR "und der" -was'
NAMED = "About the in and of: The Of"
PROBE_IDS = (3, 8)


def chunks(spark, sf):
    d = readable(docs(spark, sf), "premium", "u3")
    return d.select(F.col("doc_id").alias("chunk_id"), "text", F.substring("text", 1, 40).alias("heading"), "category")


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def probes(spark, sf):
    """Query vectors: those of two given ids."""
    rows = table(spark, sf, "embeddings").where(F.col("vec_id").isin(*PROBE_IDS)).orderBy("vec_id").collect()
    return [list(r.embedding) for r in rows]


def names(spark, sf):
    """Name list of the entity strategy: part names, and two short words that headings hold."""
    one = spark.range(1).select(F.explode(F.array(F.lit("in and of"), F.lit("the of"))).alias("name"))
    return entries(spark, sf).select(F.col("title").alias("name")).unionByName(one)


TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> '')"
CHUNKS = "c AS (SELECT doc_id AS chunk_id, text, substr(text, 1, 40) AS heading, category FROM visible)"
KEYWORD = f"""t AS (SELECT chunk_id, {TOKENS} AS w FROM c),
 kw0 AS (SELECT chunk_id, round(len(list_filter(w, lambda x: x IN ('the', 'that', 'und', 'der'))) / (1 + ln(1 + len(w))), 9) AS score FROM t
   WHERE (list_contains(w, 'the') AND list_contains(w, 'that')) OR (contains(' ' || array_to_string(w, ' ') || ' ', ' und der ') AND NOT list_contains(w, 'was'))),
 kw AS (SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM (SELECT * FROM kw0 ORDER BY score DESC, chunk_id LIMIT 50))"""
SIMILARITY = "round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) * list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 6)"
VECTOR = f"""vall AS (SELECT q.vec_id AS qid, e.vec_id AS chunk_id, {SIMILARITY} AS score FROM embeddings e JOIN c ON c.chunk_id = e.vec_id, embeddings q WHERE q.vec_id IN (3, 8)),
 vtop AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS r FROM vall),
 vbest AS (SELECT chunk_id, max(score) AS score FROM vtop WHERE r <= 50 GROUP BY 1),
 vec AS (SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM vbest)"""
NORM = r"'-' || trim(regexp_replace(lower(trim({})), '[-_\s.,/:;!?()]+', '-', 'g'), '-') || '-'"
ENTITY = f"""ent0 AS (SELECT chunk_id, CASE WHEN contains({NORM.format('heading')}, '-in-and-of-') OR contains({NORM.format('heading')}, '-the-of-') THEN 1.0
   WHEN contains({NORM.format('text')}, '-in-and-of-') OR contains({NORM.format('text')}, '-the-of-') THEN 0.9 END AS score FROM c),
 ent AS (SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM (SELECT * FROM ent0 WHERE score IS NOT NULL ORDER BY score DESC, chunk_id LIMIT 200))"""
WITH = "WITH "


@query("r_01_snapshot", "SELECT DISTINCT source_id || '#' || generation AS generation_id FROM visible", ("visible",))
def r_01(spark, sf):
    """Generations that a request of this user may read."""
    return readable(docs(spark, sf), "premium", "u3").select(F.concat_ws("#", "source_id", "generation").alias("generation_id")).distinct()


@query("r_02_keyword_search", WITH + f"{CHUNKS}, {KEYWORD} SELECT chunk_id, score, rank FROM kw", ("visible",))
def r_02(spark, sf):
    return R.keyword_search(chunks(spark, sf), QUESTION)


def found_sql(n: int, terms: str, condition: str) -> str:
    """Question ``n``: the best 50 of ``t`` that meet ``condition``, by occurrences of ``terms``."""
    return f"""SELECT {n} AS question, chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM (SELECT chunk_id, round(len(list_filter(w, lambda x: x IN ({terms}))) / (1 + ln(1 + len(w))), 9) AS score
   FROM t WHERE {condition} ORDER BY score DESC, chunk_id LIMIT 50)"""


SPACED = "' ' || array_to_string(w, ' ') || ' '"
QUESTIONS = (QUESTION, '"of the" -und', "was OR der und")
INDEXED = " UNION ALL ".join([
    found_sql(0, "'the', 'that', 'und', 'der'", f"(list_contains(w, 'the') AND list_contains(w, 'that')) OR (contains({SPACED}, ' und der ') AND NOT list_contains(w, 'was'))"),
    found_sql(1, "'of', 'the'", f"contains({SPACED}, ' of the ') AND NOT list_contains(w, 'und')"),
    found_sql(2, "'was', 'der', 'und'", "list_contains(w, 'was') OR (list_contains(w, 'der') AND list_contains(w, 'und'))"),
])


@query("r_02_index_search", WITH + f"{CHUNKS}, t AS (SELECT chunk_id, {TOKENS} AS w FROM c) {INDEXED}", ("visible",))
def r_02_index(spark, sf):
    """Postings of all documents are written, then three questions are put to them by a user who may see some."""
    path = new_path(spark, "postings")
    write_index(docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), "text"), path)
    index, seen = read_index(spark, path), chunks(spark, sf)
    return reduce(DataFrame.unionByName, [index_search(index, q, readable=seen).select(F.lit(n).alias("question"), "chunk_id", "score", "rank") for n, q in enumerate(QUESTIONS)])


@query("r_03_basic_search", WITH + f"{CHUNKS}, t AS (SELECT chunk_id, {TOKENS} AS w FROM c) SELECT chunk_id, count(*) OVER () AS total FROM t WHERE list_contains(w, 'the') AND list_contains(w, 'was') AND list_contains(w, 'of') ORDER BY chunk_id LIMIT 20", ("visible",))
def r_03(spark, sf):
    from lectern.operators.paging import offset_page

    return offset_page(R.plain_search(chunks(spark, sf), "the was OF").select("chunk_id"), [F.asc("chunk_id")], 20).select("chunk_id", "total")


@query("r_04_entry_search")
def r_04(spark, sf):
    """The best entries for a question, with a snippet of at most two fragments of 35 words; snippets are cut for the page alone."""
    from lectern.functions.evidence import rows
    from lectern.functions.text import snippet

    c = chunks(spark, sf)
    top = R.keyword_search(c, "the that", 20)
    words = R.parse_query("the that").terms
    page = F.broadcast(top).join(c.select("chunk_id", "text"), "chunk_id")  # 20 rows
    return rows(page, lambda t: [(snippet(t, words),)], ["text"], "snippet string")


@query("r_05_vector_search", WITH + f"{CHUNKS}, {VECTOR} SELECT chunk_id, score, rank FROM vec", ("visible",))
def r_05(spark, sf):
    return R.vector_search(chunks(spark, sf), vectors(spark, sf), probes(spark, sf))


@query("o_02_nearest", f"SELECT e.vec_id AS chunk_id, {SIMILARITY} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 3 ORDER BY 2 DESC, 1 LIMIT 10")
def o_02(spark, sf):
    v = vectors(spark, sf)
    return R.vector_search(v.select("chunk_id"), v, probes(spark, sf)[:1], 10).select("chunk_id", "score")


@query("r_09_entities", WITH + f"{CHUNKS}, {ENTITY} SELECT chunk_id, CAST(score AS DOUBLE) AS score, rank FROM ent", ("visible",))
def r_09(spark, sf):
    return R.entity_search(chunks(spark, sf), names(spark, sf), NAMED + " in and of")


@query("r_06_expansion", "SELECT * FROM (VALUES ('cast fireball at AC', 1.0), ('armor class', 0.8), ('огненный шар', 0.7)) t(text, weight)")
def r_06(spark, sf):
    found = R.expand_query("cast fireball at AC", [("ac", ["armor class", "Cast Fireball at AC"]), ("hp", ["hit points"])], [("fireball", ["огненный шар"])])
    rows = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(w).alias("weight")) for t, w in found])
    return spark.range(1).select(F.inline(rows))


@query(
    "r_06_expanded",
    r"""WITH q AS (SELECT conv_id * 1000 + turn AS query_id, text, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda t: t <> '') AS said FROM conversations WHERE role = 'user'),
     words AS (SELECT item_id, list_filter(string_split_regex(text, '[^\p{L}\p{N}_]+'), lambda t: t <> '') AS w FROM benchmark),
     glossary AS (SELECT w[1] AS term, w[3] AS other, 0.8 AS weight FROM words WHERE len(w) > 2 UNION ALL SELECT w[2] || ' ' || w[3], w[1], 0.7 FROM words WHERE len(w) > 2),
     met AS (SELECT query_id, lower(other) AS low, max(weight) AS weight, min(other) AS text FROM q JOIN glossary ON contains(' ' || array_to_string(said, ' ') || ' ', ' ' || lower(term) || ' ') WHERE lower(q.text) <> lower(other) GROUP BY 1, 2)
     SELECT query_id, text, weight, row_number() OVER (PARTITION BY query_id ORDER BY k, weight DESC, text) - 1 AS place FROM (SELECT query_id, text, 1.0 AS weight, 0 AS k FROM q UNION ALL SELECT query_id, text, weight, 1 FROM met)""",
)
def r_06_expanded(spark, sf):
    """What users asked, expanded by a glossary made from the benchmark's first words: a word's alias at 0.8, a phrase's at 0.7."""
    asked = table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    w = table(spark, sf, "benchmark").select(F.filter(F.split("text", r"[^\p{L}\p{N}_]+"), lambda t: t != "").alias("w")).where("size(w) > 2")
    one = w.select(F.get("w", F.lit(0)).alias("term"), F.get("w", F.lit(2)).alias("other"), F.lit(0.8).alias("weight"))
    two = w.select(F.concat_ws(" ", F.get("w", F.lit(1)), F.get("w", F.lit(2))).alias("term"), F.get("w", F.lit(0)).alias("other"), F.lit(0.7).alias("weight"))
    return R.expanded(asked, one.unionByName(two))


FUSED = """f AS (SELECT chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score, arg_min(strategy, ix) AS strategy FROM
   (SELECT chunk_id, rank, 'entity' AS strategy, 0 AS ix FROM ent UNION ALL SELECT chunk_id, rank, 'keyword', 1 FROM kw UNION ALL SELECT chunk_id, rank, 'vector', 2 FROM vec) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 60)"""


@query("r_11_fusion", WITH + f"{CHUNKS}, {ENTITY}, {KEYWORD}, {VECTOR}, {FUSED} SELECT chunk_id, CAST(score AS DOUBLE) AS score, strategy FROM f", ("visible",))
def r_11(spark, sf):
    c = chunks(spark, sf)
    lists = [("entity", R.entity_search(c, names(spark, sf), NAMED + " in and of")), ("keyword", R.keyword_search(c, QUESTION)), ("vector", R.vector_search(c, vectors(spark, sf), probes(spark, sf)))]
    return R.fuse(lists, limit=60)


@query(
    "a_12_rrf_sum",
    "SELECT l_partkey, round(sum(1.0 / (60 + r)), 9) AS score FROM (SELECT l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) GROUP BY 1",
)
def a_12(spark, sf):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber"))
    return table(spark, sf, "lineitem").select("l_partkey", r.alias("r")).groupBy("l_partkey").agg(F.round(F.sum(1.0 / (60 + F.col("r"))), 9).alias("score"))


@query(
    "r_12_rerank",
    """SELECT doc_id AS chunk_id, round(0.01 * CASE category WHEN 'core_rules' THEN 1.0 WHEN 'official_supplement' THEN 0.9 WHEN 'homebrew' THEN 0.7 ELSE 0.8 END + CASE WHEN doc_id % 3 = 0 THEN 0.05 ELSE 0 END
       + 0.1 * (CASE WHEN contains(lower(substr(text, 1, 40)), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(substr(text, 1, 40)), 'und') THEN 1 ELSE 0 END) / 2, 9) AS score FROM docs""",
    ("docs",),
)
def r_12(spark, sf):
    d = docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), F.lit(0.01).alias("score"), F.when(F.col("doc_id") % 3 == 0, "entity").otherwise("keyword").alias("strategy"), "category", F.substring("text", 1, 40).alias("heading"))
    return R.rerank(d, "The of und").select("chunk_id", "score")


HYBRID_QUESTION = "the that of"
GLOSSARY = [("that", ["and was", "The That Of"]), ("armor", ["ac"])]
HYBRID_KEYWORD = f"""t AS (SELECT chunk_id, {TOKENS} AS w FROM c),
 kw0 AS (SELECT chunk_id, round(len(list_filter(w, lambda x: x IN ('the', 'that', 'of', 'and', 'was'))) / (1 + ln(1 + len(w))), 9) AS score FROM t
   WHERE (list_contains(w, 'the') AND list_contains(w, 'that') AND list_contains(w, 'of')) OR (list_contains(w, 'and') AND list_contains(w, 'was')) OR contains(' ' || array_to_string(w, ' ') || ' ', ' that of ')),
 kw AS (SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM (SELECT * FROM kw0 ORDER BY score DESC, chunk_id LIMIT 50))"""
HYBRID_ENTITY = f"""ent0 AS (SELECT chunk_id, CASE WHEN contains({NORM.format('heading')}, '-that-of-') THEN 1.0 WHEN contains({NORM.format('text')}, '-that-of-') THEN 0.9 END AS score FROM c),
 ent AS (SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM (SELECT * FROM ent0 WHERE score IS NOT NULL ORDER BY score DESC, chunk_id LIMIT 200))"""


@query(
    "r_13_hybrid_search",
    WITH
    + f"""{CHUNKS}, {HYBRID_ENTITY}, {HYBRID_KEYWORD}, {VECTOR}, {FUSED} SELECT f.chunk_id, f.strategy, c.category, round(f.score * CASE category WHEN 'core_rules' THEN 1.0 WHEN 'official_supplement' THEN 0.9 WHEN 'homebrew' THEN 0.7 ELSE 0.8 END
      + CASE WHEN strategy = 'entity' THEN 0.05 ELSE 0 END + 0.1 * (CASE WHEN contains(lower(heading), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(heading), 'that') THEN 1 ELSE 0 END) / 2, 9) AS score,
      (SELECT count(*) FROM f) AS total, (SELECT count(*) > 20 FROM f) AS has_more FROM f JOIN c USING (chunk_id) ORDER BY score DESC, chunk_id LIMIT 20""",
    ("visible",),
)
def r_13(spark, sf):
    """The flagship: what may this user see that answers the question best? The question's expansion and the entity it names go into the keyword query; the vectors of two given ids stand for an embedding model."""
    known = entries(spark, sf).select(F.col("title").alias("name")).unionByName(spark.range(1).select(F.lit("That of").alias("name")))
    vs = probes(spark, sf)
    found = R.hybrid_search(chunks(spark, sf), vectors(spark, sf), known, HYBRID_QUESTION, lambda texts: vs[: len(texts)], glossary=GLOSSARY)
    return found.select("chunk_id", "strategy", "category", "score", "total", "has_more")

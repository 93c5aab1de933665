"""Index projection of canonical revisions that are derived from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import projection as P
from lectern.plans.base import chunks_sql, query
from lectern.sources.stores import checkpoint_dir, dealt
from lectern.sources.views import docs

REPOSITORY = "corpus"


def revisions(spark, sf):
    """A revision a document: sections of 2,500 characters, a citation every 600, of which many overlap.

    Some cite the whole text as well, some two files, some a file that wasn't
    captured, some overlap across pages, some have sections that overlap.
    """
    d = docs(spark, sf).withColumn("n", F.length("text")).withColumn("revision_id", F.concat(F.lit("rev-"), F.col("doc_id"), F.lit("-"), F.substring(F.md5("text"), 1, 8)))
    k = F.col("doc_id")

    def sections(i):
        wide = F.when((k % 40 == 11) & (i == 0), 2600).otherwise(2500)
        return F.struct(F.concat(F.lit("s"), i).alias("section_id"), F.concat(F.lit("Part "), i).alias("heading"), (i * 2500).alias("start"), F.least(F.col("n"), i * 2500 + wide).alias("end"))

    def citation(j):
        start = F.least(F.col("n"), j * 600 + (k * 37 + j * 811) % 500)
        page = F.when(k % 25 == 3, 1 + F.floor(start / 3000)).otherwise(1 + k % 9)
        return F.struct(
            F.concat(F.lit("c"), j).alias("citation_id"),
            F.when((k % 50 == 7) & (j == 0), "other.pdf").when(k % 50 == 9, "lost.pdf").otherwise(F.concat("source_id", F.lit(".pdf"))).alias("file_id"),
            page.cast("long").alias("page"),
            F.concat(F.lit("Section "), page.cast("long")).alias("section"),
            start.cast("long").alias("start"),
            F.least(F.col("n"), start + 40 + (k * 13 + j * 97) % 900).cast("long").alias("end"),
        )

    whole = F.struct(F.lit("whole").alias("citation_id"), F.when(k % 50 == 9, "lost.pdf").otherwise(F.concat("source_id", F.lit(".pdf"))).alias("file_id"), F.lit(None).cast("long").alias("page"), F.lit("Whole").alias("section"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    spans = F.transform(F.sequence(F.lit(0), F.floor(F.col("n") / 600).cast("int")), citation)
    return d.select(
        F.concat(F.lit("entry-"), F.lpad(k.cast("string"), 9, "0")).alias("entry_id"),
        "revision_id",
        "source_id",
        "text",
        F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / 2500).cast("int")), sections).alias("sections"),
        F.when(k % 50 == 13, F.array().cast(spans_type())).when(k % 5 == 0, F.concat(spans, F.array(whole))).otherwise(spans).alias("citations"),
    )


def spans_type() -> str:
    return "array<struct<citation_id:string,file_id:string,page:bigint,section:string,start:bigint,end:bigint>>"


def files(spark, sf):
    """The file of each source, with the size of its texts."""
    return docs(spark, sf).groupBy("source_id").agg(F.sum(F.octet_length("text")).cast("long").alias("byte_size")).withColumn("file_id", F.concat("source_id", F.lit(".pdf")))


def uuid_sql(namespace: str, *parts: str) -> str:
    h = f"sha256({' || chr(0) || '.join([repr(namespace), *parts])})"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', ('0x' || substr({h}, 17, 1))::INTEGER % 4 + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"


REVISIONS = """base AS (SELECT * EXCLUDE (n), length(text) AS n, 'entry-' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS entry_id, 'rev-' || doc_id || '-' || substr(md5(text), 1, 8) AS revision_id FROM docs),
 sections AS (SELECT revision_id, i, 's' || i AS section_id, 'Part ' || i AS heading, i * 2500 AS s, least(n, i * 2500 + CASE WHEN doc_id % 40 = 11 AND i = 0 THEN 2600 ELSE 2500 END) AS e FROM (SELECT *, unnest(range(0, greatest(n - 1, 0) // 2500 + 1)) AS i FROM base)),
 spans AS (SELECT revision_id, j, 'c' || j AS citation_id, CASE WHEN doc_id % 50 = 7 AND j = 0 THEN 'other.pdf' WHEN doc_id % 50 = 9 THEN 'lost.pdf' ELSE source_id || '.pdf' END AS file_id, doc_id, n, least(n, j * 600 + (doc_id * 37 + j * 811) % 500) AS s
   FROM (SELECT *, unnest(range(0, n // 600 + 1)) AS j FROM base WHERE doc_id % 50 <> 13)),
 citations AS (SELECT revision_id, j, citation_id, file_id, page, 'Section ' || page AS section, s, e FROM (SELECT *, CASE WHEN doc_id % 25 = 3 THEN 1 + s // 3000 ELSE 1 + doc_id % 9 END AS page, least(n, s + 40 + (doc_id * 13 + j * 97) % 900) AS e FROM spans)
   UNION ALL SELECT revision_id, n // 600 + 1, 'whole', CASE WHEN doc_id % 50 = 9 THEN 'lost.pdf' ELSE source_id || '.pdf' END, NULL, 'Whole', NULL, NULL FROM base WHERE doc_id % 50 <> 13 AND doc_id % 5 = 0),
 captured AS (SELECT source_id, source_id || '.pdf' AS file_id, CAST(sum(strlen(text)) AS BIGINT) AS byte_size FROM docs GROUP BY source_id),
 cited AS (SELECT revision_id, count(DISTINCT file_id) AS n_files, min(file_id) AS file_id FROM citations GROUP BY revision_id),
 mixed AS (SELECT DISTINCT a.revision_id FROM citations a JOIN citations b ON a.revision_id = b.revision_id AND a.j < b.j AND a.s < b.e AND b.s < a.e AND a.s < a.e AND b.s < b.e WHERE a.page <> b.page),
 crowded AS (SELECT DISTINCT a.revision_id FROM sections a JOIN sections b ON a.revision_id = b.revision_id AND a.i < b.i AND a.s < b.e AND b.s < a.e),
 checked AS MATERIALIZED (SELECT b.*, c.file_id, f.byte_size, CASE WHEN c.revision_id IS NULL THEN 'no citation' WHEN n_files <> 1 THEN 'several files' WHEN f.byte_size IS NULL THEN 'file not captured' WHEN x.revision_id IS NOT NULL THEN 'overlapping sections' WHEN m.revision_id IS NOT NULL THEN 'ambiguous provenance' END AS problem
   FROM base b LEFT JOIN cited c USING (revision_id) LEFT JOIN captured f ON f.source_id = b.source_id AND f.file_id = c.file_id LEFT JOIN crowded x ON x.revision_id = b.revision_id LEFT JOIN mixed m ON m.revision_id = b.revision_id)"""
GENERATIONS = f"""generations AS (SELECT source_id, file_id, {uuid_sql('index-generation', repr(P.VERSION), repr(REPOSITORY), 'source_id', 'file_id', 'CAST(n AS VARCHAR)', 'CAST(mark AS VARCHAR)')} AS generation_id
   FROM (SELECT source_id, file_id, count(*) AS n, sum(('0x' || substr(sha256(revision_id), 1, 15))::BIGINT) AS mark FROM checked WHERE problem IS NULL GROUP BY ALL))"""


@query("cdc_05_index_entries", "WITH " + REVISIONS + ", " + GENERATIONS + f""" SELECT entry_id, revision_id, problem, c.source_id, c.file_id, CASE WHEN problem IS NULL THEN byte_size END AS byte_size, generation_id,
 CASE WHEN problem IS NULL THEN {uuid_sql('index-entry', repr(REPOSITORY), 'entry_id')} END AS id, CASE WHEN problem IS NULL THEN {uuid_sql('index-source', repr(REPOSITORY), 'c.source_id')} END AS source_uuid,
 CASE WHEN problem IS NULL THEN {uuid_sql('index-file', repr(REPOSITORY), 'c.source_id', 'c.file_id')} END AS file_uuid, CASE WHEN problem IS NULL THEN {uuid_sql('index-document', repr(REPOSITORY), 'generation_id', 'entry_id', 'revision_id')} END AS document_id
 FROM (SELECT * REPLACE (CASE WHEN problem IS NULL THEN file_id END AS file_id) FROM checked) c LEFT JOIN generations g ON g.source_id = c.source_id AND g.file_id = c.file_id AND problem IS NULL""", ("docs",))
def cdc_05_entries(spark, sf):
    """Every revision: its ids, or why it isn't projected."""
    checkpoint_dir(spark)
    checked = P.examined(dealt(revisions(spark, sf)), files(spark, sf)).drop("text", "sections", "citations", "pieces").checkpoint()  # judged once
    made = P.index_entries(checked, REPOSITORY)
    refused = checked.where("problem IS NOT NULL").select("entry_id", "revision_id", "problem", "source_id")
    return made.withColumn("problem", F.lit(None).cast("string")).unionByName(refused, allowMissingColumns=True)


@query("cdc_05_index_pages", "WITH " + REVISIONS + """ SELECT revision_id, page, array_to_string(list_distinct_ordered, chr(10)) AS text, array_to_string(ids, ',') AS citations FROM (
 SELECT revision_id, page, list(citation_id ORDER BY j) AS ids, list(t ORDER BY j) FILTER (first) AS list_distinct_ordered FROM (
   SELECT c.revision_id, c.page, c.citation_id, c.j, substr(k.text, c.s + 1, c.e - c.s) AS t, row_number() OVER (PARTITION BY c.revision_id, c.page, substr(k.text, c.s + 1, c.e - c.s) ORDER BY c.j) = 1 AS first
   FROM citations c JOIN checked k USING (revision_id) WHERE problem IS NULL AND page IS NOT NULL AND s IS NOT NULL) GROUP BY revision_id, page)""", ("docs",))
def cdc_05_pages(spark, sf):
    """The cited pages of every projected revision."""
    return P.index_pages(P.examined(revisions(spark, sf), files(spark, sf))).withColumn("citations", F.array_join("citations", ","))


@query("cdc_05_index_chunks", "WITH RECURSIVE " + REVISIONS + ", " + GENERATIONS + """,
 marks AS (SELECT s.revision_id, s.i, s.section_id, s.heading, unnest([s.s, s.e]) AS pos FROM sections s JOIN checked k USING (revision_id) WHERE problem IS NULL
   UNION SELECT s.revision_id, s.i, s.section_id, s.heading, unnest([greatest(s.s, c.s), least(s.e, c.e)]) FROM sections s JOIN checked k USING (revision_id) JOIN citations c ON c.revision_id = s.revision_id AND c.s < s.e AND c.e > s.s WHERE problem IS NULL),
 parts AS (SELECT * FROM (SELECT *, lead(pos) OVER (PARTITION BY revision_id, i ORDER BY pos) AS stop FROM marks) WHERE stop > pos),
 placed AS (SELECT p.*, row_number() OVER (ORDER BY p.revision_id, p.pos) AS pid, substr(k.text, pos + 1, stop - pos) AS text, k.source_id, k.file_id, k.entry_id FROM parts p JOIN checked k USING (revision_id)),
 held AS (SELECT pid, list(citation_id ORDER BY j) AS ids, arg_min(page, j) FILTER (true) AS page0, min(j) AS j0 FROM placed p JOIN citations c ON c.revision_id = p.revision_id AND (c.s IS NULL OR (c.s <= p.pos AND c.e >= p.stop)) GROUP BY pid),
 """ + chunks_sql("placed", "pid") + f""",
 numbered AS (SELECT p.*, c.k, c.s, c.e, c.chunk, row_number() OVER (PARTITION BY p.source_id, p.file_id ORDER BY p.entry_id, p.revision_id, p.pos, c.k) - 1 AS chunk_index FROM chunks c JOIN placed p USING (pid) WHERE NOT gone)
 SELECT {uuid_sql('index-chunk', repr(REPOSITORY), 'generation_id', 'n.revision_id', 'section_id', 'CAST(chunk_index AS VARCHAR)')} AS id, n.revision_id, section_id, chunk_index, n.pos + n.s AS span_start, n.pos + n.e AS span_end, md5(chunk) AS chunk_md5,
 md5(regexp_replace(regexp_replace(regexp_replace(replace(chunk, chr(13) || chr(10), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS quote_md5, z.page, coalesce(z.section, n.heading) AS heading, coalesce(array_to_string(ids, ','), '') AS citations
 FROM numbered n JOIN generations g ON g.source_id = n.source_id AND g.file_id = n.file_id LEFT JOIN held h USING (pid) LEFT JOIN citations z ON z.revision_id = n.revision_id AND z.j = h.j0""", ("docs",))
def cdc_05_chunks(spark, sf):
    """The chunks of every projected revision, cut where the set of covering citations changes."""
    checkpoint_dir(spark)
    made = P.index_chunks(P.examined(dealt(revisions(spark, sf)), files(spark, sf)).checkpoint(), REPOSITORY)  # swept once
    return made.withColumns({"chunk_md5": F.md5("chunk"), "quote_md5": F.md5("quote"), "citations": F.array_join("citations", ",")}).drop("chunk", "quote")

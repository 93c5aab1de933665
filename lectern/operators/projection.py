"""Canonical revisions to index rows: entries, pages and chunks with their citations.

A revision is a row: text, sections (section_id, heading, start, end) and
citations (citation_id, file_id, page, section, start, end; both ends null where
the whole text is cited). Spans are in code points. A sweep over the sorted
ends of its sections and citations cuts the text into pieces in which the same
citations hold; the pieces are chunked, and chunks are numbered through all revisions of their file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import pages
from lectern.functions.text import clean_quote, col, deterministic_uuid, let
from lectern.operators.windows import running_before

#: Version of this projection: part of every generation's id.
VERSION = "5"
#: Why a revision is not projected, in the order in which they are looked for.
PROBLEMS = ("no citation", "several files", "file not captured", "overlapping sections", "ambiguous provenance")
EVENTS = "array<struct<pos:int,close:int,kind:int,ord:int>>"
SWEPT = "struct<at:int,sections:array<int>,active:array<int>,out:array<struct<start:int,end:int,section:int,crowded:boolean,active:array<int>>>>"


def swept(sections: str | Column, citations: str | Column) -> Column:
    """Array of pieces (start, end, section, crowded, active): runs of the text inside of a section in which the same citations hold.

    section and active are places in the two lists, from 0; active is in list
    order and has citations without a span; crowded says that more than one
    section holds. One pass over the sorted ends, with the set of open spans as its state.
    """
    s, c = F.transform(col(sections), lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"))), F.transform(col(citations), lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end")))

    def ends(spans: Column, kind: int) -> list[Column]:
        def event(side: str, close: int):
            return F.filter(
                F.transform(spans, lambda x, k: F.struct(x[side].alias("pos"), F.lit(close).alias("close"), F.lit(kind).alias("kind"), F.when(x["start"].isNotNull() & x["end"].isNotNull(), k).alias("ord"))),
                lambda e: e["ord"].isNotNull(),
            )

        return [event("start", 0), event("end", 1)]

    events = F.array_sort(F.concat(*[x.cast(EVENTS) for x in [*ends(s, 0), *ends(c, 1)]]))
    whole = F.filter(F.transform(c, lambda x, k: F.when(x["start"].isNull() | x["end"].isNull(), k)), lambda k: k.isNotNull())

    def moved(open_: Column, e: Column, kind: int) -> Column:
        return F.when(e["kind"] != kind, open_).when(e["close"] == 1, F.array_remove(open_, e["ord"])).otherwise(F.array_append(open_, e["ord"]))

    def step(held: Column, e: Column) -> Column:
        piece = F.struct(held["at"].alias("start"), e["pos"].alias("end"), F.get(held["sections"], F.lit(0)).alias("section"), (F.size(held["sections"]) > 1).alias("crowded"), held["active"].alias("active"))
        grown = F.when((held["at"] < e["pos"]) & (F.size(held["sections"]) > 0), F.array_append(held["out"], piece)).otherwise(held["out"])
        return F.struct(e["pos"].alias("at"), moved(held["sections"], e, 0).alias("sections"), moved(held["active"], e, 1).alias("active"), grown.alias("out")).cast(SWEPT)

    empty = F.struct(F.lit(0).alias("at"), F.array().alias("sections"), F.array().alias("active"), F.array().alias("out")).cast(SWEPT)
    pieces = F.aggregate(events, empty, step, lambda held: held["out"])
    return let(whole, lambda w: F.transform(pieces, lambda p: p.withField("active", F.array_sort(F.concat(w, p["active"])))))


def at_places(values: Column, places: Column) -> Column:
    return F.transform(places, lambda k: F.get(values, k))


def examined(revisions: DataFrame, files: DataFrame) -> DataFrame:
    """``revisions`` (revision_id, entry_id, source_id, text, sections, citations) with file_id, byte_size, pieces and problem (null where it can be projected).

    ``files`` are those captured: source_id, file_id, byte_size. Null lists count as empty, null text as ''.
    """
    r = revisions.withColumns({"text": F.coalesce("text", F.lit("")), "sections": F.coalesce("sections", F.array()), "citations": F.coalesce("citations", F.array())})
    cited = F.array_distinct(F.transform("citations", lambda c: c["file_id"]))
    r = r.withColumn("_files", F.size(cited)).withColumn("file_id", F.when(F.size(cited) == 1, F.get(cited, F.lit(0))))
    r = r.join(files.select("source_id", "file_id", "byte_size"), ["source_id", "file_id"], "left").withColumn("pieces", swept("sections", "citations"))

    def doubtful(p: Column) -> Column:
        """Citations with a span that meet here name more than one page or section."""
        held = F.filter(at_places(F.col("citations"), p["active"]), lambda c: c["start"].isNotNull() & c["end"].isNotNull())
        return F.size(F.array_distinct(F.transform(held, lambda c: F.struct(c["page"], c["section"])))) > 1

    found = (
        F.when(F.size("citations") == 0, PROBLEMS[0])
        .when(F.col("_files") != 1, PROBLEMS[1])
        .when(F.col("byte_size").isNull(), PROBLEMS[2])
        .when(F.exists("pieces", lambda p: p["crowded"]), PROBLEMS[3])
        .when(F.exists("pieces", doubtful), PROBLEMS[4])
    )
    return r.withColumn("problem", found).drop("_files")


def generations(entries: DataFrame, repository: str) -> DataFrame:
    """(source_id, file_id, generation_id): an id that depends on the set of a file's revisions, not on their order, from sums of hashes."""
    part = F.conv(F.substring(F.sha2("revision_id", 256), 1, 15), 16, 10).cast("decimal(20,0)")
    held = entries.groupBy("source_id", "file_id").agg(F.count(F.lit(1)).alias("n"), F.sum(part).alias("mark"))
    return held.select("source_id", "file_id", deterministic_uuid("index-generation", F.lit(VERSION), F.lit(repository), "source_id", "file_id", F.col("n").cast("string"), F.col("mark").cast("string")).alias("generation_id"))


def index_entries(checked: DataFrame, repository: str) -> DataFrame:
    """One row a projected revision: ids of entry, source, file, generation and document. ``checked`` comes from ``examined``."""
    good = checked.where("problem IS NULL").select("entry_id", "revision_id", "source_id", "file_id", "byte_size")
    held = good.join(generations(good, repository), ["source_id", "file_id"])
    return held.select(
        "entry_id",
        "revision_id",
        "source_id",
        "file_id",
        "byte_size",
        "generation_id",
        deterministic_uuid("index-entry", F.lit(repository), "entry_id").alias("id"),
        deterministic_uuid("index-source", F.lit(repository), "source_id").alias("source_uuid"),
        deterministic_uuid("index-file", F.lit(repository), "source_id", "file_id").alias("file_uuid"),
        deterministic_uuid("index-document", F.lit(repository), "generation_id", "entry_id", "revision_id").alias("document_id"),
    )


def index_pages(checked: DataFrame) -> DataFrame:
    """One row a cited page of a projected revision: its distinct cited texts in citation order, a line each, and the ids of the citations."""
    c = checked.where("problem IS NULL").select("revision_id", "text", F.posexplode("citations").alias("ord", "c")).where("c.page IS NOT NULL AND c.start IS NOT NULL AND c.end IS NOT NULL")
    cut = c.select("revision_id", F.col("c.page").alias("page"), F.struct("ord", F.expr("substring(text, int(c.start) + 1, int(c.end - c.start))").alias("text"), F.col("c.citation_id").alias("id")).alias("c"))
    held = cut.groupBy("revision_id", "page").agg(F.array_sort(F.collect_list("c")).alias("c"))  # the citations of a page of one text
    return held.select("revision_id", "page", F.array_join(F.array_distinct("c.text"), "\n").alias("text"), F.col("c.id").alias("citations"))


def index_chunks(checked: DataFrame, repository: str, how: pages.Chunking = pages.Chunking()) -> DataFrame:
    """One row a chunk: id, revision_id, section_id, chunk_index, span_start, span_end, chunk, quote, page, heading, citations.

    chunk_index runs through a file's revisions in the order of entry_id. page
    and heading are the first covering citation's; without one, null and the section's.
    """
    good = checked.where("problem IS NULL")
    p = good.select("revision_id", "entry_id", "source_id", "file_id", "text", "sections", "citations", F.posexplode("pieces").alias("piece", "p"))
    first = F.get(at_places(F.col("citations"), F.col("p.active")), F.lit(0))
    section = F.get("sections", F.col("p.section"))
    cut = p.select(
        "revision_id",
        "entry_id",
        "source_id",
        "file_id",
        "piece",
        F.col("p.start").alias("piece_start"),
        section["section_id"].alias("section_id"),
        first["page"].alias("page"),
        F.coalesce(first["section"], section["heading"]).alias("heading"),
        at_places(F.col("citations.citation_id"), F.col("p.active")).alias("citations"),
        F.expr("substring(text, p.start + 1, p.end - p.start)").alias("text"),
    )
    made = pages.chunked(cut, how=how)
    counts = made.groupBy("source_id", "file_id", "entry_id", "revision_id").agg(F.count(F.lit(1)).alias("n"))
    base = running_before(counts, ["source_id", "file_id"], ["entry_id", "revision_id"], "n", "base").select("revision_id", "base")
    own = F.row_number().over(Window.partitionBy("revision_id").orderBy("piece", "chunk_index")) - 1
    made = made.withColumn("_own", own).join(base, "revision_id").join(generations(good, repository), ["source_id", "file_id"])
    made = made.withColumn("chunk_index", F.col("base") + F.col("_own"))
    return made.select(
        deterministic_uuid("index-chunk", F.lit(repository), "generation_id", "revision_id", "section_id", F.col("chunk_index").cast("string")).alias("id"),
        "revision_id",
        "section_id",
        "chunk_index",
        (F.col("piece_start") + F.col("span_start")).alias("span_start"),
        (F.col("piece_start") + F.col("span_end")).alias("span_end"),
        "chunk",
        clean_quote("chunk").alias("quote"),
        "page",
        "heading",
        "citations",
    )

"""Ranked lexical search by TPUT over postings partitioned by term.

The index holds a posting (term, document, impact) for each term of the
queries, dealt by ranges of (term, impact descending): a list lies in one
partition or in consecutive ones, its head first. A posting's contribution to
a query is the term's weight times its impact. Three phases, for all queries at once:

1. The heads of all lists, as long as the result, name documents whose exact
   scores are looked up; the last one that a result of that length would take is a lower bound.
2. One threshold holds for all lists of a query: the highest at which a
   document below it in all of them stays below SHARE of the bound, where a
   list counts with its largest contribution if that is less. All postings at
   or above it are fetched and dealt by document, once for all queries;
   partial sums and what the unseen lists could add give an upper bound for each document.
3. The exact scores of documents whose upper bound reaches the lower one are looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import terms
from lectern.llm.shared import discard, extended, join_labels, materialise, partitions_for, sieved

#: Distinct query terms up to which tasks get them as a list, and joins as a broadcast (some MB); with more, a join leaves the same postings.
LISTED = 200_000
#: Part of the lower bound that the threshold leaves to unseen lists: with all of it every fetched document would stay, with less more is fetched and less stays.
SHARE = 8
POSTINGS = "doc bigint, n bigint, term string, tf bigint"


def query_terms(batches) -> Iterator[pa.RecordBatch]:
    """Rows (q, text) to distinct (q, term)."""
    for batch in batches:
        for lo, hi in terms.slices(batch.column(1)):
            rows, codes, _, names = terms.counted(batch.column(1).slice(lo, hi - lo), terms.WORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(rows)), names.take(pa.array(codes))], names=["q", "term"])


def postings_of(wanted: list[str] | None):
    """Rows (doc_id, doc, text) to postings of ``wanted`` terms (of all, if None), and for each slice of texts a row without a term: n documents with terms, tf terms in them."""
    held = None if wanted is None else pa.array(wanted, pa.string())

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, docs, texts = batch.columns
            for lo, hi in terms.slices(texts):
                rows, codes, times, names = terms.counted(texts.slice(lo, hi - lo), terms.WORDS)
                n = np.bincount(rows, times, hi - lo).astype(np.int64)
                if held is not None and len(rows):
                    keep = np.asarray(pc.is_in(names, value_set=held))[codes]
                    rows, codes, times = rows[keep], codes[keep], times[keep]
                at = pa.array(rows + lo)
                columns = [ids.take(at), docs.take(at), pa.array(n[rows]), names.take(pa.array(codes)), pa.array(times.astype(np.int64))]
                total = [pa.nulls(1, ids.type), pa.nulls(1, docs.type), pa.array([int((n > 0).sum())]), pa.nulls(1, pa.string()), pa.array([int(n.sum())])]
                for part in (columns, total):
                    yield pa.RecordBatch.from_arrays(part, names=["doc_id", "doc", "n", "term", "tf"])

    return run


def on_terms(rows: DataFrame, listed: DataFrame, count: int, total: int) -> DataFrame:
    """``rows`` (``total``) joined by term with ``listed`` (unique terms, ``count`` of them; n is a term's postings): broadcast up to LISTED terms, else only the frequent ones."""
    if count <= LISTED:
        return rows.join(F.broadcast(listed.drop("n")), "term")
    return join_labels(rows, listed, ["term"], total)


def top(rows: DataFrame, by: str, order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each ``by``, with their rank; map tasks pass on ``k`` of each at most."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def thresholds(lists: DataFrame) -> DataFrame:
    """``lists`` (q, term, n, w, most, m, bound) to (q, term, n, w, least, cap): the impact from which a list is fetched, and what it adds at most to a document that it isn't fetched for.

    level is the largest number with sum(min(level, largest contribution)) below
    1 / SHARE of the bound: lists in ascending order of that contribution, and the first from which on the rest, shared evenly, is no more than it.
    """
    w = Window.partitionBy("q").orderBy("largest", "term")  # the terms of one query
    placed = lists.withColumn("largest", F.col("w") * F.col("most")).withColumn("place", F.row_number().over(w) - 1).withColumn("below", F.sum("largest").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("largest"))
    share = placed.withColumn("share", F.expr(f"greatest(0L, bound div {SHARE} - 1 - below) div (m - place)"))
    level = share.where("share <= largest").groupBy("q").agg(F.min_by("share", "place").alias("level"))
    return share.join(level, "q").selectExpr("q", "term", "n", "w", "bound", "level div w + 1 AS least", "least(level, largest) AS cap")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (item id, rank, document id, score): the ``k`` documents with the highest scores above 0 for each item.

    Terms: runs of ASCII letters (A-Z lower-cased), digits and characters past
    ASCII, in whole texts; null text has none. Weights and scores as the
    queries define them, in 64-bit integers. Ties by id, nulls first. Every row
    of ``docs`` is a document and every row of ``items`` an item, repeated ids
    or not; items without a scored document have no rows, nor have empty tables. Other columns are not read.
    """
    spark = docs.sparkSession
    asked = materialise(items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("q")))
    wanted = materialise(asked.select("q", "text").mapInArrow(query_terms, "q bigint, term string"))
    distinct = wanted.select("term").distinct()
    listed = [r.term for r in distinct.limit(LISTED + 1).collect()]  # LISTED + 1 at most
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = narrow.mapInArrow(postings_of(listed if len(listed) <= LISTED else None), extended(narrow.select("doc_id").schema, POSTINGS))
    if len(listed) > LISTED:
        found = found.where("term IS NULL").unionByName(found.where("term IS NOT NULL").join(distinct, "term", "left_semi"))
    raw = materialise(found)
    n_docs, n_terms = raw.where("term IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("tf"), F.lit(0))).first()
    norm = f"(10L + (90L * n * {n_docs}L) div {max(n_terms, 1)}L)"
    scored = raw.where("term IS NOT NULL").selectExpr("term", "doc", "doc_id", f"(1000000000L * tf) div (1000L * tf + 8L * {norm}) AS impact")
    total = raw.count()
    order = [F.asc("term"), F.desc("impact"), F.asc_nulls_first("doc_id"), F.asc("doc")]
    index = materialise(scored.repartitionByRange(partitions_for(spark, total, 1_000_000), *order).sortWithinPartitions(*order))
    discard(raw)

    # the lists of each query: weight, number of lists, largest contribution
    lists = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.max("impact").alias("most"))
    weight = f"cast(floor(1000 * ln((2 * cast({n_docs} AS double) + 2) / (2 * cast(n AS double) + 1))) AS bigint)"
    weighed = wanted.join(lists.withColumn("w", F.expr(weight)).where("w > 0 AND most > 0"), "term")
    lists = materialise(weighed.join(weighed.groupBy("q").agg(F.count(F.lit(1)).alias("m")), "q"))
    discard(wanted)
    count = lists.select("term").distinct().count()
    by_term = lists.groupBy("term").agg(F.first("n").alias("n"))

    def exact(pairs: DataFrame) -> DataFrame:
        """``pairs`` (q, doc) with score and doc_id, from the postings of these documents alone."""
        held = sieved(index, pairs.select("doc").distinct(), "doc", pairs.count(), "met").where("met").drop("met")
        looked = pairs.join(lists.select("q", "term", "w"), "q").join(held, ["doc", "term"])
        return looked.groupBy("q", "doc").agg(F.sum(F.col("w") * F.col("impact")).alias("score"), F.first("doc_id").alias("doc_id"))

    heads = top(on_terms(index, by_term, count, total), "term", order[1:], k)
    first = materialise(heads.select("term", "doc").join(lists.select("q", "term"), "term").select("q", "doc").distinct())
    bound = top(exact(first), "q", [F.desc("score")], k).where(F.col("rank") == k).select("q", F.col("score").alias("bound"))
    bounds = materialise(thresholds(lists.join(bound, "q", "left").withColumn("bound", F.coalesce("bound", F.lit(0)))))
    discard(first)

    reach = bounds.groupBy("term").agg(F.first("n").alias("n"), F.min("least").alias("reach"))
    fetched = on_terms(index, reach, count, total).where("impact >= reach").select("term", "doc", "impact").repartition(partitions_for(spark, total, 1_000_000), "doc")
    each = bounds.select("q", "term", "w", "least", "cap")
    seen = fetched.join(F.broadcast(each) if lists.count() <= LISTED else each, "term").where("impact >= least")
    sums = seen.groupBy("q", "doc").agg(F.sum(F.col("w") * F.col("impact")).alias("partial"), F.sum("cap").alias("caps"))
    whole = bounds.groupBy("q").agg(F.sum("cap").alias("all_caps"), F.first("bound").alias("bound"))  # a row a query
    candidates = materialise(sums.join(F.broadcast(whole) if lists.count() <= LISTED else whole, "q").where("partial + all_caps - caps >= bound").select("q", "doc"))
    best = top(exact(candidates).where("score > 0"), "q", [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("doc")], k)
    result = materialise(best.join(asked.select("q", "item_id"), "q").select(F.col("item_id").alias(item_id), "rank", F.col("doc_id").alias(id_col), "score"))
    for used in (candidates, bounds, lists, index, asked):
        discard(used)
    return result

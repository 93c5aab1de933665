"""An inverted index of chunks: written once, so that a search reads the postings of its own terms instead of every text.

A posting is (term, chunk_id, places of the term among the chunk's tokens, the
chunk's number of tokens). The index consists of segments, files that hold all
postings of a share of the chunks in the order of (term, chunk_id): a term's
filter is pushed to the row groups and pages that hold it, and a term that every
chunk has is spread over all segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import tokens
from lectern.operators.retrieval import MAX_STRATEGY, Query, parse_query, ranked
from lectern.sources.stores import dealt


#: Tokens that a task groups at a time, whole texts.
GROUPED = 1_000_000


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, chunk_id, places, size) of batches of (chunk_id, list of tokens): runs in the order of (term, chunk_id), which a later sort merges."""
    for whole in batches:
        whole = whole.take(pc.sort_indices(whole.column(0)))
        held = np.cumsum(whole.column(1).value_lengths().fill_null(0).to_numpy(), dtype=np.int64)
        cuts = np.flatnonzero(np.diff(held // GROUPED, prepend=-1, append=-1))
        for b in (whole.slice(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])):
            size = b.column(1).value_lengths().fill_null(0).to_numpy()
            coded = b.column(1).flatten().dictionary_encode()
            by_term = pc.sort_indices(coded.dictionary).to_numpy()
            rank = np.empty(len(by_term), np.int64)
            rank[by_term] = np.arange(len(by_term))
            row = np.repeat(np.arange(len(size)), size)
            key = rank[coded.indices.to_numpy()] * len(size) + row
            order = np.argsort(key, kind="stable")  # equal terms of a text stay in the order of their places
            place = (order - (np.cumsum(size) - size)[row[order]]).astype(np.int32)
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            at = order[first]
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(place))
            found = [coded.take(pa.array(at)).dictionary_decode(), b.column(0).take(pa.array(row[at])), places, pa.array(size[row[at]])]
            yield pa.RecordBatch.from_arrays(found, names=["term", "chunk_id", "places", "size"])


def postings(chunks: DataFrame, body: str = "text") -> DataFrame:
    """(term, chunk_id, places, size) of ``chunks`` (unique chunk_id, text). Null and empty texts have none; other columns are left alone.

    Tokens are Spark's; they are grouped in Arrow batches, as lambdas over lists take several times as long for each token.
    """
    held = chunks.select("chunk_id", tokens(body).alias("_w"))
    schema = f"term string, chunk_id {held.schema['chunk_id'].dataType.simpleString()}, places array<int>, size int"
    return held.mapInArrow(grouped, schema)


def write_index(chunks: DataFrame, path: str, body: str = "text") -> None:
    """Writes the postings of ``chunks`` under ``path`` (which must not exist yet), a segment for each share of the chunks.

    Only texts are shuffled: their postings are several times as many rows, and ranges of them would need a sample, for which every text is read and grouped once more.
    """
    postings(dealt(chunks.select("chunk_id", body)), body).sortWithinPartitions("term", "chunk_id").write.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def met(query: Query, held: Column) -> Column:
    """Whether a chunk matches; ``held``: its places by term, for the terms of ``query``."""

    def phrase(words: tuple[str, ...]) -> Column:
        follow = [lambda p, w=w, k=k: F.array_contains(held[w], p + k) for k, w in enumerate(words) if k]
        return F.coalesce(F.exists(held[words[0]], lambda p: reduce(lambda a, b: a & F.coalesce(b(p), F.lit(False)), follow, F.lit(True))), F.lit(False))

    def clause(c) -> Column:
        wanted, phrases, excluded = c
        tests = [F.map_contains_key(held, w) for w in wanted] + [phrase(p) for p in phrases] + [~F.map_contains_key(held, w) for w in excluded]
        return reduce(lambda a, b: a & b, tests)

    return reduce(lambda a, b: a | b, [clause(c) for c in query.clauses], F.lit(False))


def index_search(index: DataFrame, text: str, limit: int = 50, readable: DataFrame | None = None) -> DataFrame:
    """What ``keyword_search`` gives for ``text``, from ``index``: the best ``limit`` chunks (chunk_id, score, rank), ties by chunk_id.

    ``readable``: the chunks (chunk_id) that the user may see; all, if not given. A chunk must hold a wanted term, also where an
    alternative only excludes; a blank query finds nothing. One shuffle, of the postings of the query's terms; a chunk has a row a term.
    """
    query = parse_query(text)
    limit = max(1, min(MAX_STRATEGY, limit))
    asked = list(dict.fromkeys([*query.terms, *(w for _, _, out in query.clauses for w in out)]))
    hits = index.where(F.col("term").isin(asked)) if asked else index.limit(0)
    by_chunk = hits.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("held"), F.max("size").alias("size"))
    tf = reduce(lambda a, b: a + b, [F.coalesce(F.size(F.col("held")[t]), F.lit(0)) for t in query.terms], F.lit(0))
    found = by_chunk.withColumn("tf", tf).where(F.col("tf") > 0).where(met(query, F.col("held")))
    if readable is not None:
        found = found.join(readable.select("chunk_id"), "chunk_id", "left_semi")
    scored = found.select("chunk_id", F.round(F.col("tf") / (1 + F.log(1 + F.col("size"))), 9).alias("score"))
    return ranked(scored.orderBy(F.desc("score"), "chunk_id").limit(limit))

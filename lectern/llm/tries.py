"""Divergence of sources by radix tries that tasks fill and merge.

A task counts terms in one byte trie per language: a leaf has the number of
documents with its term and a counter for each source. Tries past LEAVES
leaves are given out and begun anew, so memory is bounded. What is given out is
the traversal in byte order; ranges of prefixes (Spark's range partitioning of
language and term) bring equal prefixes together, and a task merges its range
as a stream. Kept terms leave as blocks of up to BLOCK leaves in byte order. A
traversal of the blocks with the totals at hand gives sums for pairs of
sources and each source's best terms of the block, ties by byte order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import terms
from lectern.llm.shared import discard, join_labels, materialise, partitions_for

#: Leaves of a task's tries before they are given out.
LEAVES = 200_000
#: Terms of a block, and values of one matrix made from it (terms x sources).
BLOCK, CELLS = 4096, 1 << 21
#: Probabilities are whole numbers of 1 / UNIT.
UNIT = 1_000_000_000
LEAST, BEST = 10, 10
PARTIAL = "lang string, term string, df bigint, sources array<string>, counts array<bigint>"
BLOCKS = "lang string, terms array<string>, ends array<int>, sources array<string>, counts array<bigint>"
FOUND = "lang string, source string, part string, item string, value bigint"


class Node:
    """A node of a radix trie: the bytes on its edge, its children by their first byte, its leaf if a term ends here."""

    __slots__ = ("edge", "below", "leaf")

    def __init__(self, edge: bytes):
        self.edge, self.below, self.leaf = edge, {}, None


class Trie:
    """A radix trie over bytes; a leaf is [documents, {source: count}]."""

    def __init__(self):
        self.root, self.size = Node(b""), 0

    def leaf(self, term: bytes) -> list:
        """The leaf of ``term``, made if it isn't there."""
        node, at = self.root, 0
        while at < len(term):
            child = node.below.get(term[at])
            if child is None:
                child = node.below[term[at]] = Node(term[at:])
                node, at = child, len(term)
            elif term.startswith(child.edge, at):
                node, at = child, at + len(child.edge)
            else:  # split the edge where the term leaves it
                edge, shared = child.edge, 1
                while at + shared < len(term) and edge[shared] == term[at + shared]:
                    shared += 1
                upper = node.below[term[at]] = Node(edge[:shared])
                child.edge = edge[shared:]
                upper.below[child.edge[0]] = child
                node, at = upper, at + shared
        if node.leaf is None:
            node.leaf = [0, {}]
            self.size += 1
        return node.leaf

    def walk(self) -> Iterator[tuple[bytes, list]]:
        """Terms and leaves in byte order."""
        held = [(b"", self.root)]
        while held:
            path, node = held.pop()
            path += node.edge
            if node.leaf is not None:
                yield path, node.leaf
            for byte in sorted(node.below, reverse=True):
                held.append((path, node.below[byte]))


def lists(ends: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)


def given_out(lang: str, trie: Trie) -> Iterator[pa.RecordBatch]:
    """The traversal of a trie as rows."""
    names, dfs, sources, counts, ends = [], [], [], [], []

    def batch():
        columns = [pa.array([lang] * len(names)), pa.array(names, pa.binary()).cast(pa.string()), pa.array(dfs, pa.int64()), lists(ends, pa.array(sources, pa.string())), lists(ends, pa.array(counts, pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "term", "df", "sources", "counts"])

    for term, (df, held) in trie.walk():
        names.append(term)
        dfs.append(df)
        sources.extend(held)
        counts.extend(held.values())
        ends.append(len(counts))
        if len(names) == 20_000:
            yield batch()
            names, dfs, sources, counts, ends = [], [], [], [], []
    if names:
        yield batch()


def count_terms(batches) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text) to the traversals of this task's tries."""
    held: dict[str, Trie] = {}
    for batch in batches:
        texts = batch.column(2)
        for lo, hi in terms.slices(texts):
            rows, codes, times, names = terms.counted(texts.slice(lo, hi - lo), terms.LETTERS)
            if not len(rows):
                continue
            langs, sources = (batch.column(k).slice(lo, hi - lo).dictionary_encode() for k in (0, 1))
            lang, source = (np.asarray(x.indices).astype(np.int64) for x in (langs, sources))
            wide, many = len(names), len(sources.dictionary)
            # by language, term and source: one entry each, in order
            keys, at = np.unique((lang[rows] * wide + codes) * many + source[rows], return_inverse=True)
            count = np.bincount(at, times, len(keys)).astype(np.int64).tolist()
            docs = np.bincount(at, minlength=len(keys)).tolist()
            names, sources = names.cast(pa.binary()).to_pylist(), sources.dictionary.to_pylist()
            langs = langs.dictionary.to_pylist()
            last, leaf = -1, None
            for key, s, n, d in zip((keys // many).tolist(), (keys % many).tolist(), count, docs):
                if key != last:
                    last = key
                    lang_name = langs[key // wide]
                    trie = held.get(lang_name)
                    if trie is None:
                        trie = held[lang_name] = Trie()
                    leaf = trie.leaf(names[key % wide])
                leaf[0] += d
                s = sources[s]
                leaf[1][s] = leaf[1].get(s, 0) + n
            if sum(t.size for t in held.values()) >= LEAVES:
                for lang_name, trie in held.items():
                    yield from given_out(lang_name, trie)
                held = {}
    for lang_name, trie in held.items():
        yield from given_out(lang_name, trie)


def merged(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Rows of equal (lang, term), which follow each other, as one: documents and counts summed. The positions where they begin are given too."""
    table = table.combine_chunks()
    n = table.num_rows
    column = {c: table[c].chunk(0) for c in table.column_names}
    new = np.ones(n, bool)
    for c in ("lang", "term"):
        held = column[c]
        change = np.asarray(pc.not_equal(held.slice(1), held.slice(0, n - 1)))
        new[1:] = change if c == "lang" else new[1:] | change
    heads = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    lengths = np.asarray(pc.list_value_length(column["counts"])).astype(np.int64)
    flat, names = np.asarray(column["counts"].flatten()), column["sources"].flatten().dictionary_encode()
    wide = max(len(names.dictionary), 1)
    keys, at = np.unique(np.repeat(group, lengths) * wide + np.asarray(names.indices), return_inverse=True)
    count = np.zeros(len(keys), np.int64)
    np.add.at(count, at, flat)
    ends = np.searchsorted(keys // wide, np.arange(len(heads)), "right")
    df = np.add.reduceat(np.asarray(column["df"]), heads)
    out = [column["lang"].take(pa.array(heads)), column["term"].take(pa.array(heads)), pa.array(df), lists(ends, names.dictionary.take(pa.array(keys % wide))), lists(ends, pa.array(count))]
    return pa.table(out, names=table.column_names), heads


def merge_range(least: int):
    """Sorted partial rows of a prefix range to blocks of the terms in ``least`` documents or more."""

    def blocks(rest: pa.Table) -> Iterator[pa.RecordBatch]:
        rest = rest.filter(pc.greater_equal(rest["df"], least)).combine_chunks()
        langs = rest["lang"].to_numpy(zero_copy_only=False) if rest.num_rows else []
        cuts = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1).tolist(), len(langs)] if len(langs) else []
        for lo, hi in zip(cuts, cuts[1:]):
            for at in range(lo, hi, BLOCK):
                part = rest.slice(at, min(BLOCK, hi - at)).combine_chunks()
                ends = np.cumsum(np.asarray(pc.list_value_length(part["counts"].chunk(0))))
                one = np.array([part.num_rows])
                inner = np.array([ends[-1]])
                columns = [pa.array([langs[at]]), lists(one, part["term"].chunk(0)), lists(one, pa.array(ends.astype(np.int32))), lists(inner, part["sources"].chunk(0).flatten()), lists(inner, part["counts"].chunk(0).flatten())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "terms", "ends", "sources", "counts"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        open_row, waiting, size = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table, _ = merged(table if open_row is None else pa.concat_tables([open_row, table]))
            open_row = table.slice(table.num_rows - 1)  # goes on in the next batch, perhaps
            waiting.append(table.slice(0, table.num_rows - 1).filter(pc.greater_equal(table["df"].slice(0, table.num_rows - 1), least)))
            size += waiting[-1].num_rows
            if size >= BLOCK:
                yield from blocks(pa.concat_tables(waiting))
                waiting, size = [], 0
        if open_row is not None:
            yield from blocks(pa.concat_tables([*waiting, open_row]))

    return run


def scaled(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + count * UNIT div total, for count <= total: a long division in base 1000, so that no product passes 63 bits."""
    quotient = np.zeros(np.broadcast(count, total).shape, np.int64)
    rest = np.broadcast_to(count, quotient.shape).copy()
    quotient, rest = rest // total, rest % total
    for _ in range(3):
        rest = rest * 1000
        quotient = quotient * 1000 + rest // total
        rest %= total
    return quotient + 1


def traverse(best: int):
    """Blocks with their language's totals (names, totals, v) to sums for pairs of sources and the best terms of each block."""

    def rows(lang: str, part: str, source: list, item: list, value: np.ndarray) -> pa.RecordBatch:
        n = len(source)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(source, pa.string()), pa.array([part] * n, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])

    def pairs(lang: str, names: list, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(len(names) - 1):
            yield rows(lang, "pair", [names[a]] * (len(names) - 1 - a), names[a + 1 :], sums[a, a + 1 :])

    def run(batches) -> Iterator[pa.RecordBatch]:
        lang, sums, names = None, None, []
        for batch in batches:
            for row in range(batch.num_rows):
                at = {c: batch.column(k)[row] for k, c in enumerate(batch.schema.names)}
                if at["lang"].as_py() != lang:
                    if sums is not None:
                        yield from pairs(lang, names, sums)
                    lang, names = at["lang"].as_py(), at["names"].as_py()
                    sums = np.zeros((len(names), len(names)), np.int64)
                    totals, place = np.asarray(at["totals"].values), pa.array(names, pa.string())
                v = at["v"].as_py()
                ends, count = np.asarray(at["ends"].values).astype(np.int64), np.asarray(at["counts"].values)
                column = np.asarray(pc.index_in(at["sources"].values, place)).astype(np.int64)
                spelt, step = at["terms"].values, max(1, CELLS // len(names))
                tops: dict[int, list] = {}
                for lo in range(0, len(ends), step):
                    hi = min(lo + step, len(ends))
                    begin, end = int(ends[lo - 1]) if lo else 0, int(ends[hi - 1])
                    lengths = np.diff(ends[lo:hi], prepend=begin)
                    dense = np.zeros((hi - lo, len(names)), np.int64)
                    dense[np.repeat(np.arange(hi - lo), lengths), column[begin:end]] = count[begin:end]
                    p = scaled(dense + 2, totals[None, :] + 2 * v)
                    q = scaled(dense.sum(1) + 2, np.int64(totals.sum() + 2 * v))
                    for a in range(len(names)):
                        gap = p[:, a : a + 1] - p[:, a + 1 :]
                        sums[a, a + 1 :] += (gap * gap // (p[:, a : a + 1] + p[:, a + 1 :])).sum(0)
                        over = np.flatnonzero((dense[:, a] > 0) & (p[:, a] > q))
                        gap = p[over, a] - q[over]
                        value = gap * gap // (p[over, a] + q[over])
                        first = np.lexsort((over, -value))[:best]  # terms are in byte order, so ties are too
                        tops.setdefault(a, []).extend(zip((-value[first]).tolist(), (over[first] + lo).tolist()))
                found = [(a, *pair) for a, held in tops.items() for pair in sorted(held)[:best]]
                if found:
                    yield rows(lang, "term", [names[a] for a, _, _ in found], spelt.take(pa.array([k for _, _, k in found])).to_pylist(), np.array([-x for _, x, _ in found]))
        if sums is not None:
            yield from pairs(lang, names, sums)

    return run


def divergence_audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, best: int = BEST) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): how far each source's terms are from those of each other source of its language ('pair'), and the terms it has more of than its language, to rank ``best`` ('term').

    Terms are runs of ASCII letters (A-Z lower-cased) and characters past
    ASCII; a language keeps those in ``least`` of its documents or more. Null
    text, lang and source count as ''. A (lang, source) without terms has its
    pairs; a language without kept terms has pairs of value 0. Repeated rows
    are documents of their own; ids and other columns are not read; an empty
    table gives no rows. A task holds LEAVES leaves, or one block and the sums of one language's pairs, as many as the result has rows.
    """
    spark = docs.sparkSession
    narrow = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    partial = materialise(narrow.mapInArrow(count_terms, PARTIAL))
    ranges = partial.repartitionByRange(partitions_for(spark, partial.count(), 500_000), "lang", "term").sortWithinPartitions("lang", "term")
    blocks = materialise(ranges.mapInArrow(merge_range(least), BLOCKS))
    discard(partial)
    each = blocks.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("total"))
    sizes = blocks.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"), F.count(F.lit(1)).alias("n"))
    groups = narrow.select("lang", "source").distinct().join(each, ["lang", "source"], "left")
    langs = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("held"))
    langs = langs.join(sizes, "lang", "left").select("lang", F.col("held.source").alias("names"), F.col("held.total").alias("totals"), "v", F.coalesce("n", F.lit(0)).alias("n"))
    langs = materialise(langs)
    met = join_labels(blocks, langs, ["lang"], blocks.count())
    found = materialise(met.mapInArrow(traverse(best), FOUND))
    discard(blocks)
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = langs.select("lang", F.explode("names").alias("a"), "names").select("lang", "a", F.explode("names").alias("b")).where("a <> b")
    both = both.select("lang", F.col("a"), F.col("b"), F.least("a", "b").alias("source"), F.greatest("a", "b").alias("item")).join(sums, ["lang", "source", "item"], "left")
    pair = both.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), F.coalesce("value", F.lit(0)).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pair.withColumn("rank", F.row_number().over(order))
    term = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return pair.unionByName(term)

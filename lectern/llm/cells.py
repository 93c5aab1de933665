"""Pairs within cells, compared in bounded blocks; what leaves a block is a spanning forest, never all pairs.

Rows that share a ``cell`` are candidates of each other. A cell of more than
``cell_rows`` rows is dealt into chunks by a hash of the node, and every pair
of chunks becomes a block of its own, so no task holds a cell whole however
many rows one cell gets, and every pair is still compared in some block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import materialise, partitions_for

#: Rows, or bytes, that are compared at a time; a block is never cut.
BATCH_ROWS = 40_000
BATCH_BYTES = 64 << 20


def blocks(rows: DataFrame, cell_rows: int, copies: int) -> DataFrame:
    """Adds block columns ci, cj, chunk to ``rows`` (cell, node, ...), partitioned and sorted by block.

    ``copies``: the number of rows of ``rows``, known to the caller, for the number of tasks. ``cell_rows`` 0: no cell is
    large, as the caller knows; ``rows`` is then read once instead of twice.
    """
    n = partitions_for(rows.sparkSession, copies)
    if not cell_rows:
        whole = rows.withColumns({c: F.lit(0) for c in ("chunk", "ci", "cj")})
        return whole.repartition(n, "cell").sortWithinPartitions("cell")
    hot = rows.groupBy("cell").count().where(F.col("count") > cell_rows).select("cell", F.ceil(F.col("count") / cell_rows).cast("int").alias("m"))
    hot = materialise(hot)  # a table of known size: where it is small, the rows need no shuffle to meet it
    dealt = rows.join(hot, "cell", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(7)), F.col("m")).cast("int"))
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = dealt.withColumn("ci", F.least("chunk", "k")).withColumn("cj", F.greatest("chunk", "k")).drop("k", "m")
    return dealt.repartition(n, "cell", "ci", "cj").sortWithinPartitions("cell", "ci", "cj")


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole blocks, of about BATCH_ROWS rows or BATCH_BYTES."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        size += batch.nbytes
        if rows < BATCH_ROWS and size < BATCH_BYTES:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        start = run_starts(table)[-1]
        if start:
            yield table.slice(0, start)
            rest = table.slice(start)
            held, rows, size = rest.to_batches(), rest.num_rows, rest.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def run_starts(table: pa.Table) -> np.ndarray:
    """Positions at which a block begins."""
    change = np.ones(table.num_rows, dtype=bool)
    same = np.ones(table.num_rows - 1, dtype=bool)
    for name in ("cell", "ci", "cj"):
        x = table.column(name).to_numpy()
        same &= x[1:] == x[:-1]
    change[1:] = ~same
    return np.flatnonzero(change)


def block_pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, of rows of one block: all within a chunk's own block, else those across its two chunks."""
    starts = run_starts(table)
    n = table.num_rows
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    chunk, cross = table.column("chunk").to_numpy(), table.column("ci").to_numpy() != table.column("cj").to_numpy()
    i, shift = np.arange(n), 1
    while True:
        i = i[i + shift < ends[i]]
        if not len(i):
            return
        j = i + shift
        ok = ~cross[i] | (chunk[i] != chunk[j])
        yield (i, j) if ok.all() else (i[ok], j[ok])
        shift += 1


class Forest:
    """Union-find over row positions; ``add`` keeps what joins two trees, in the order given."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.kept: list[tuple[int, int, int]] = []

    def add(self, i: np.ndarray, j: np.ndarray, d: np.ndarray, step: int = 2048) -> None:
        root = self.root
        for at in range(0, len(i), step):
            a, b, c = i[at : at + step], j[at : at + step], d[at : at + step]
            while (up := root[root] != root).any():  # flatten
                root[up] = root[root[up]]
            open_ = root[a] != root[b]
            for x, y, z in zip(a[open_].tolist(), b[open_].tolist(), c[open_].tolist()):
                p, q = int(root[x]), int(root[y])
                while root[p] != p:
                    p = int(root[p])
                while root[q] != q:
                    q = int(root[q])
                if p != q:
                    root[max(p, q)] = min(p, q)
                    self.kept.append((x, y, z))


def nearest_first(n: int, found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], held: int = 2_000_000) -> list[tuple[int, int, int]]:
    """A minimum spanning forest of the linked pairs (i, j, distance); at most about ``held`` pairs are kept at once.

    When more have gathered they are reduced to their own minimum forest, which loses no edge of the final one.
    """
    parts: list[tuple[np.ndarray, ...]] = []
    count = 0

    def reduce():
        if not parts:
            return []
        i, j, d = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(d, kind="stable")
        forest = Forest(n)
        forest.add(i[order], j[order], d[order])
        return forest.kept

    for i, j, d in found:
        if len(i):
            parts.append((i, j, d))
            count += len(i)
            if count > held:
                kept = np.array(reduce(), dtype=np.int64).reshape(-1, 3)
                parts[:] = [(kept[:, 0], kept[:, 1], kept[:, 2])]
                count = len(kept)
    return reduce()


def words_of(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A column of fixed-width binaries as rows of ``width`` unsigned 64-bit words."""
    flat = b"".join(column.to_pylist())
    return np.frombuffer(flat, dtype=np.uint64).reshape(-1, width)


def tree_of(n: int, kept: list[tuple[int, int, int]]) -> np.ndarray:
    """The row position that stands for each row's tree."""
    forest = Forest(n)
    i, j, d = np.array(kept, dtype=np.int64).T
    forest.add(i, j, d)
    root = forest.root
    while (up := root[root] != root).any():
        root[up] = root[root[up]]
    return root


def least_of(tree: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The smallest node of each row's tree."""
    least = np.full(len(tree), np.iinfo(np.int64).max)
    np.minimum.at(least, tree, node)
    return least[tree]


def forest_edges(rows: DataFrame, cell_rows: int, copies: int, link: Callable, node_type: str, trees: bool = False) -> DataFrame:
    """Edges (a, b, d) of a spanning forest in each block. ``link(table)`` gives a function (i, j) -> (keep mask, distance).

    With ``trees`` also the edge's tree as (cell, ci, cj, top): the block and the tree's smallest node.
    """
    block = ("cell", "ci", "cj")

    def run(batches):
        for table in whole_blocks(batches):
            test = link(table)

            def found(table=table, test=test):
                for i, j in block_pairs(table):
                    yield test(i, j)

            kept = nearest_first(table.num_rows, found())
            node = table.column("node").combine_chunks()
            if kept:
                i, j, d = np.array(kept, dtype=np.int64).T
                cols, names = [_one(node.take(pa.array(i))), _one(node.take(pa.array(j))), pa.array(d)], ["a", "b", "d"]
                if trees:
                    cols += [_one(table.column(c).take(pa.array(i))) for c in block] + [pa.array(least_of(tree_of(table.num_rows, kept), node.to_numpy())[i])]
                    names += [*block, "top"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    more = f", cell long, ci int, cj int, top {node_type}" if trees else ""
    return blocks(rows, cell_rows, copies).mapInArrow(run, f"a {node_type}, b {node_type}, d long{more}")


def _one(x):
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x

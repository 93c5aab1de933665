"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Iterative quantisation (Gong and Lazebnik 2011): vectors of a bounded sample
are rotated so that their signs, the binary code, lose least. A code is cut
into substrings, each the key of one table; vectors that share a key and a
label are candidates, and original vectors in double precision decide. More
rotations give more tables when longer substrings are needed, which is when
there are more vectors, so cells stay small; the number of tables is set so
that a pair at the threshold shares a key with probability ``RECALL``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.cells import Forest, blocks, run_starts, whole_blocks
from lectern.llm.shared import components, join_labels, materialise

#: Vectors that the rotations are learnt from, at most.
SAMPLE = 20_000
RECALL = 0.9995
#: A cell of more rows is compared in chunks of this size; substrings are as long as makes cells of CELL_GOAL rows.
CELL_ROWS = 1024
CELL_GOAL = 64


def learn_rotation(sample: np.ndarray, bits: int, seed: int, rounds: int = 30) -> np.ndarray:
    """A dims x bits projection: principal directions (uncentred, so that signs follow angles), then the learnt rotation."""
    if not len(sample):
        return np.random.default_rng(seed).normal(size=(sample.shape[1], bits))
    _, _, directions = np.linalg.svd(sample.T @ sample)
    projection = directions[:bits].T
    low = sample @ projection
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    for _ in range(rounds):
        signs = np.where(low @ rotation >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(signs.T @ low)
        rotation = (u @ vt).T
    return projection @ rotation


def table_plan(largest: int, dims: int, threshold: float) -> tuple[int, int]:
    """(bits of a substring, number of tables) for ``largest`` vectors of one label."""
    bits = int(min(30, max(1, dims), max(6, math.ceil(math.log2(max(largest, 2) / CELL_GOAL)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(4, math.ceil(math.log(1 - RECALL) / math.log(1 - agree)))


def substrings(unit: np.ndarray, rotations: list[np.ndarray], bits: int, tables: int) -> np.ndarray:
    """rows x tables keys of ``bits`` bits."""
    out = []
    weights = 1 << np.arange(bits)
    for r in rotations:
        signs = (unit @ r) >= 0
        for lo in range(0, signs.shape[1] - bits + 1, bits):
            out.append(signs[:, lo : lo + bits] @ weights)
    return np.stack(out[:tables], axis=1).astype(np.int32)


def usable(column: str):
    """Whether a vector is neither null, empty nor zero and has only finite components."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(column, lambda x: x != 0), F.lit(False))


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", recall_plan: tuple[int, int] | None = None
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null and their cosine is
    ``threshold`` or more. Null, empty, zero and non-finite vectors link with
    nothing and keep their own id as component. Equal vectors of a label are
    one node, whose copies count as links of each other. Repeated ids keep a
    row each; a null id's component is its group's smallest id, and it is
    never kept; vectors of unequal lengths never link; empty input: no rows.
    """
    base = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    base = base.withColumn("ok", usable("v") & F.col("label").isNotNull())
    good = base.where("ok").groupBy("label", "v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = materialise(good.withColumn("node", F.monotonically_increasing_id()))
    sizes = nodes.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    if not sizes:
        rest = base.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
        return rest
    dims = int(sizes[0][0])
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0]
    count, total = nodes.agg(F.count(F.lit(1)), F.sum("copies")).first()
    bits, tables = recall_plan or table_plan(largest, dims, threshold)
    drawn = nodes.where(F.size("v") == dims).select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(SAMPLE).select("v").toArrow()
    sample = np.stack([np.array(x, dtype=np.float64) for x in drawn.column("v").to_pylist()])
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    per_rotation = dims // bits
    rotations = [learn_rotation(sample, per_rotation * bits, 100 + k) for k in range(-(-tables // per_rotation))]
    shared = nodes.sparkSession.sparkContext.broadcast(rotations)

    def keyed(batches: Iterator[pa.RecordBatch]):
        rotations = shared.value
        for batch in batches:
            lengths = np.array([len(x) for x in batch.column("v").to_pylist()])
            for n in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == n)
                rows = batch.take(pa.array(at))
                x = np.array(rows.column("v").to_pylist(), dtype=np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                # vectors of other lengths meet in one table with one cell a label
                keys = substrings(x, rotations, bits, tables) if n == dims else np.zeros((len(at), 1), dtype=np.int32)
                flat, codes = [r.tobytes() for r in x], [r.tobytes() for r in keys]
                for t in range(keys.shape[1]):
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("label"), rows.column("node"), rows.column("copies"), pa.array(np.full(len(at), n), pa.int32()), pa.array(np.full(len(at), t), pa.int32()), pa.array(keys[:, t], pa.int32()), pa.array(codes, pa.binary()), pa.array(flat, pa.binary())],
                        names=["label", "node", "copies", "dims", "t", "key", "codes", "x"],
                    )

    label_type = nodes.schema["label"].dataType.simpleString()
    rows = nodes.select("label", "node", "copies", "v").mapInArrow(keyed, f"label {label_type}, node long, copies long, dims int, t int, key int, codes binary, x binary")
    rows = rows.withColumn("cell", F.xxhash64("label", "dims", "t", "key"))

    def compare(batches):
        for table in whole_blocks(batches):
            starts = run_starts(table)
            ends = np.append(starts[1:], table.num_rows)
            wide = ends - starts > 1
            label_of, node = table.column("label").to_pylist(), table.column("node").to_numpy()
            copies, t, dim = table.column("copies").to_numpy(), table.column("t").to_numpy(), table.column("dims").to_numpy()
            codes, x = table.column("codes").to_pylist(), table.column("x").to_pylist()
            chunk, ci, cj = (table.column(c).to_numpy() for c in ("chunk", "ci", "cj"))
            label_ids = np.unique(np.array([str(v) for v in label_of]), return_inverse=True)[1]
            links = np.zeros(table.num_rows, dtype=np.int64)
            forest = Forest(table.num_rows)
            for lo, hi in zip(starts[wide].tolist(), ends[wide].tolist()):
                # a cell is a hash: rows of other labels, tables or lengths that fell into it are kept apart
                group = label_ids[lo:hi] * 1_000_003 + t[lo:hi] * 8_191 + dim[lo:hi]
                for g in np.unique(group):
                    at = lo + np.flatnonzero(group == g)
                    m = np.frombuffer(b"".join(x[k] for k in at), dtype=np.float64).reshape(len(at), -1)
                    near = np.triu(m @ m.T >= threshold, 1)
                    if ci[lo] != cj[lo]:
                        near &= chunk[at][:, None] != chunk[at][None, :]
                    i, j = np.nonzero(near)
                    if not len(i):
                        continue
                    forest.add(at[i], at[j], np.zeros(len(i), dtype=np.int64))
                    # a pair counts in the first table in which it meets
                    mine = int(t[at[0]])
                    if mine:
                        c = np.frombuffer(b"".join(codes[k] for k in at), dtype=np.int32).reshape(len(at), -1)[:, :mine]
                        first = ~(c[i] == c[j]).any(axis=1)
                        i, j = i[first], j[first]
                    links += np.bincount(at[i], weights=copies[at[j]], minlength=table.num_rows).astype(np.int64)
                    links += np.bincount(at[j], weights=copies[at[i]], minlength=table.num_rows).astype(np.int64)
            some = np.flatnonzero(links)
            edges = np.array([(a, b) for a, b, _ in forest.kept], dtype=np.int64).reshape(-1, 2)
            a = np.concatenate([node[some], node[edges[:, 0]]])
            b = pa.array(np.concatenate([np.zeros(len(some), dtype=np.int64), node[edges[:, 1]]]), mask=np.arange(len(a)) < len(some))
            yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate([links[some], np.zeros(len(edges), dtype=np.int64)]))], names=["a", "b", "n"])

    met = materialise(blocks(rows, CELL_ROWS, count * tables).mapInArrow(compare, "a long, b long, n long"))
    links = met.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(met.where("b is not null").select("a", "b"))
    placed = nodes.join(roots, "node", "left").join(links, "node", "left")
    placed = placed.select("label", "v", "least", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("n", F.lit(0)).alias("n"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.join(least, "root").select("label", "v", "component_id", (F.col("n") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n"))
    linked = join_labels(base.where("ok"), materialise(placed), ["label", "v"], total).select("id", "n_links", "component_id")
    rest = base.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(rest).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )

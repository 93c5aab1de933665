"""SimHash near-duplicates by pivot distance tables.

A fingerprint's row of the pivot table holds its Hamming distances to fixed
reference fingerprints. By the triangle inequality two fingerprints within
radius r have rows that differ by at most r in every coordinate, so a pair
whose maximum coordinate difference is larger is discarded unseen, and only
survivors are compared bit by bit.

Retrieval goes by the same table. Its references are a base and, for each of
r + k blocks of bits, some that differ from the base in about half of that
block's bits. The base's distance less such a reference's depends on the block
alone, and r differing bits touch r blocks at most, so any pair within the
radius has equal differences in all coordinates of k blocks. Each choice of k
blocks gives a grid cell: the tuple of those coordinate differences. That loses
no pair; what else meets in a cell is discarded by further references spread
over all bits. k grows with the logarithm of the count of distinct
fingerprints.

The same operator by similarity (``keep_one``) takes wide fingerprints of
shingle sets. At a similarity of 0.8 their radius is about a quarter of all
bits, beyond what coordinates of unrelated fingerprints differ by, so that no
reference discards a pair there; pairs meet in cells of sampled bits instead
and are checked on their shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.cells import blocks, forest_edges, run_starts, whole_blocks, words_of
from lectern.llm.shared import components, discard, join_labels, materialise, pick_unused, release, sieved

SEED = 42
#: Reference fingerprints of the pivot table.
PIVOTS = 24
#: A cell of more rows is compared in chunks of this size.
CELL_ROWS = 4096
#: The same where rows carry their shingle sets.
SET_ROWS = 1024
#: Shingles of a zone that one task checks whole; with SET_ROWS the bound on its memory.
ZONE_SHINGLES = 4_000_000
#: Sets of so many shingles or fewer are linked without fingerprints, whose bits few shingles decide.
FEW = 64
#: Deviations past the expected distance at the threshold up to which a pair is a candidate.
SPREAD = 3.5


def shingle_hashes(text: str | None, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of ``words`` words of the A-Z lower-cased text, repeats included.

    Fewer words: the whole sequence is the one shingle; none, or null: no hashes.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(b" ".join(tokens), seed)], dtype=np.uint64)
    runs = zip(*(tokens[k:] if k else tokens for k in range(words)))
    return np.array([digest(s, seed) for s in map(b" ".join, runs)], dtype=np.uint64)


def majority(hashes: np.ndarray, width: int = 1, block: int = 8192) -> np.ndarray:
    """The fingerprint of 64 * ``width`` bits: a bit is 1 if set in over half the hashes; no hashes: zero.

    Words after the first are of hashes derived from the first by an odd multiplier and a shift.
    """
    out = np.zeros(width, dtype=np.uint64)
    if len(hashes):
        counts = np.zeros((width, 64), dtype=np.int64)
        for at in range(0, len(hashes), block):
            part = hashes[at : at + block]
            for w in range(width):
                if w:
                    part = (part ^ (part >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
                    part ^= part >> np.uint64(32)
                bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                counts[w] += bits.sum(axis=0, dtype=np.int32)
        for w in range(width):
            ones = np.flatnonzero(counts[w] * 2 > len(hashes)).astype(np.uint64)
            out[w] = np.bitwise_or.reduce(np.uint64(1) << ones) if len(ones) else 0
    return out


def fingerprints(docs: DataFrame, words: int = 3, width: int = 1, text: str = "text", column: str = "fingerprint") -> DataFrame:
    """``docs`` without its text, with ``column``: the fingerprint as binary of 8 * ``width`` bytes (little-endian words).

    Every whole text is read; null texts count as empty (fingerprint zero).
    """
    keep = [c for c in docs.columns if c != text]

    def run(batches):
        for batch in batches:
            prints = [majority(shingle_hashes(x, words), width).tobytes() for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(prints, pa.binary())], names=[*keep, column])

    schema = docs.select(*keep).schema.add(column, "binary")
    return docs.select(*keep, F.col(text).alias(pick_unused(docs, "_text"))).mapInArrow(run, schema)


def pivots(width: int, count: int = PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints over all bits, far apart with high probability."""
    return np.random.default_rng(20_240_601).integers(0, 2**64, size=(count, width), dtype=np.uint64)


def block_references(radius: int, k: int, bits: int = 64) -> tuple[int, list[list[int]]]:
    """(base, references by block): for each of radius + k near-equal blocks of bits, the base with about half of the block's bits turned, in several ways."""
    draw = np.random.default_rng(20_240_602)
    base = int(draw.integers(0, 2**64, dtype=np.uint64))
    edges = [round(b * bits / (radius + k)) for b in range(radius + k + 1)]
    out = []
    for lo, hi in zip(edges, edges[1:]):
        turned = [draw.choice(np.arange(lo, hi), size=(hi - lo + 1) // 2, replace=False) for _ in range((hi - lo) // 2 + 2)]
        out.append([base ^ sum(1 << int(b) for b in t) for t in turned])
    return base, out


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def pivot_link(width: int, radius: int):
    """The link test of one block: pivot table, maximum coordinate difference, then the bits of the survivors.

    References are left out where the radius is past three deviations of the difference of unrelated coordinates: they would discard nothing.
    """
    refs = pivots(width) if radius < 3 * math.sqrt(32 * width) else pivots(width, 0)

    def link(table):
        prints = words_of(table.column("print"), width)
        rows = np.empty((len(prints), len(refs)), dtype=np.int16)
        for k, ref in enumerate(refs):
            rows[:, k] = np.bitwise_count(prints ^ ref).sum(axis=1)

        def test(i, j):
            for k in range(0, len(refs), 4):
                near = (np.abs(rows[i, k : k + 4] - rows[j, k : k + 4]) <= radius).all(axis=1)
                if not near.all():
                    i, j = i[near], j[near]
                if not len(i):
                    break
            d = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1).astype(np.int64)
            ok = d <= radius
            return i[ok], j[ok], d[ok]

        return test

    return link


def grid_cells(prints: DataFrame, radius: int, k: int) -> DataFrame:
    """(node, cell, print) of ``prints`` (node: the fingerprint as a long, print): a cell for each choice of k blocks' coordinates of the pivot table."""
    base, by_block = block_references(radius, k)
    near = F.bit_count(F.col("node").bitwiseXOR(F.lit(signed(base))))
    coordinates = [F.array(*[near - F.bit_count(F.col("node").bitwiseXOR(F.lit(signed(r)))) for r in refs]).alias(f"c{b}") for b, refs in enumerate(by_block)]
    cells = [F.xxhash64(F.lit(n), *[F.col(f"c{b}") for b in choice]) for n, choice in enumerate(combinations(range(radius + k), k))]
    return prints.select("node", "print", *coordinates).select("node", F.explode(F.array(*cells)).alias("cell"), "print")


def links_within(prints: DataFrame, count: int, radius: int = 3) -> DataFrame:
    """Edges (a, b, d) that connect exactly what pairs of 64-bit ``prints`` (column node, distinct) within ``radius`` connect."""
    k = 2
    while 2.0 ** (64 * k / (radius + k)) < count / 4:
        k += 1
    return forest_edges(grid_cells(prints, radius, k), CELL_ROWS, count * math.comb(radius + k, k), pivot_link(1, radius), "long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """One row per document: id, fingerprint (binary), component_id.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is
    the smallest id reachable over links, itself included. Equal fingerprints
    are one node, so groups of copies of any size cost one comparison. Null
    ids get the component's smallest id that is not null (null if there is
    none); repeated ids and rows each keep their row; empty input: no rows.
    """
    prints = materialise(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), words))
    nodes = prints.groupBy("fingerprint").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    node = F.conv(hex_digits("fingerprint"), 16, -10).cast("long")
    nodes = materialise(nodes.select(node.alias("node"), F.col("fingerprint").alias("print"), "least", "n"))
    count, total = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    edges = materialise(links_within(nodes.select("node", "print"), count, radius).select("a", "b"))
    roots = components(edges)
    discard(edges)
    rooted = nodes.join(roots, "node", "left").select("print", "least", "n", F.coalesce("root", "node").alias("root"))
    comp = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = materialise(rooted.join(comp, "root").select(F.col("print").alias("fingerprint"), "component_id", "n"))
    discard(nodes)
    discard(roots)
    out = join_labels(prints, labelled, ["fingerprint"], total)
    return out.select(F.col("id").alias(id_col), "fingerprint", "component_id")


def hex_digits(column: str):
    """The 16 lowercase hex digits of a fingerprint of one word."""
    h = F.lower(F.hex(column))
    return F.concat(*[F.substring(h, 15 - 2 * k, 2) for k in range(8)])


#: Bits of the fingerprints that estimate similarity, as 64-bit words.
WIDE = 4
#: Chance that a pair at the similarity threshold shares a cell.
RECALL = 0.998


def flip_rate(similarity: float) -> float:
    """Expected share of differing bits of two sets of that Jaccard similarity: the angle of their indicator vectors over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def sampled_masks(count: int, similarity: float, width: int = WIDE) -> list[list[int]]:
    """Bit masks (a word each) of the tables: bits a table grow with log2 of ``count``, the number of tables follows from RECALL."""
    bits = max(12, math.ceil(math.log2(max(count, 1) / 64 + 1)))
    agree = (1 - flip_rate(similarity)) ** bits
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - agree))
    draw, out = np.random.default_rng(77), []
    for _ in range(tables):
        words = [0] * width
        for bit in draw.choice(64 * width, size=bits, replace=False).tolist():
            words[bit // 64] |= 1 << (bit % 64)
        out.append([signed(w) for w in words])
    return out


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(shingle_hashes(text, words))


def described(texts: DataFrame, words: int, reach: int) -> DataFrame:
    """(id, row, print, key, size, few) of ``texts`` (id, row, text): a wide fingerprint of the shingle set, a key equal for equal sets only,
    the set's size, and the set itself where it has at most ``reach`` shingles."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(x, words) for x in batch.column(2).to_pylist()]
            prints = [majority(x, WIDE).tobytes() for x in sets]
            keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
            few = [x.tobytes() if 0 < len(x) <= reach else None for x in sets]
            cols = [batch.column(0), batch.column(1), pa.array(prints, pa.binary()), pa.array(keys, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array(few, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "row", "print", "key", "size", "few"])

    schema = texts.select("id", "row").schema.add("print", "binary").add("key", "binary").add("size", "long").add("few", "binary")
    return texts.select("id", "row", "text").mapInArrow(run, schema)


def verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) whose nodes' shingle sets (node, hashes, n) have a Jaccard similarity of ``similarity`` or more."""
    met = edges.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"), F.col("n").alias("n_x")), "a")
    met = met.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"), F.col("n").alias("n_y")), "b")

    def run(batches):
        for batch in batches:
            ok = []
            for x, y, m, n in zip(batch.column("x"), batch.column("y"), batch.column("n_x").to_pylist(), batch.column("n_y").to_pylist()):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(both >= similarity * (m + n - both) - 1e-9)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return met.select("a", "b", "x", "y", "n_x", "n_y").mapInArrow(run, "a long, b long")


def wide_radius(similarity: float) -> int:
    """Differing bits up to which a pair is a candidate."""
    rate, bits = flip_rate(similarity), 64 * WIDE
    return math.ceil(bits * rate + SPREAD * math.sqrt(bits * rate * (1 - rate)))


def similar_links(nodes: DataFrame, count: int, similarity: float) -> DataFrame:
    """Candidate edges (a, b, tree, top: the tree's smallest node) of nodes (node, print): minimum forests, by Hamming distance, of each cell's pairs within the radius.

    A pair within the radius that is no edge joins two nodes of one tree, so it adds nothing only if all edges of that
    tree pass the exact check; ``unsettled`` has the other trees. Equal tree numbers may also be a hash's accident, which only makes a tree larger.
    """
    masks = sampled_masks(count, similarity)
    hexed = F.hex("print")
    words = nodes.select(
        "node", "print", *[F.conv(F.concat(*[F.substring(hexed, 16 * w + 15 - 2 * k, 2) for k in range(8)]), 16, -10).cast("long").alias(f"w{w}") for w in range(WIDE)]
    )
    keys = [F.xxhash64(F.lit(n), *[F.col(f"w{w}").bitwiseAND(F.lit(m).cast("long")) for w, m in enumerate(mask)]) for n, mask in enumerate(masks)]
    rows = words.select("node", "print", F.explode(F.array(*keys)).alias("cell"))
    found = forest_edges(rows, CELL_ROWS, count * len(masks), pivot_link(WIDE, wide_radius(similarity)), "long", trees=True)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.xxhash64("cell", "ci", "cj", "top").alias("tree"), "top")


def unsettled(edges: DataFrame, ok: DataFrame) -> DataFrame:
    """(node, root): zones of nodes joined by trees of ``edges`` of which an edge is not in ``ok`` and which have more than that one edge."""
    seen = edges.join(ok.withColumn("ok", F.lit(1)), ["a", "b"], "left")
    trees = seen.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.count("ok").alias("good")).where("n > 1 and good < n").select("tree")
    return components(edges.join(trees, "tree", "left_semi").select("a", "b"))


def exact_links(rows: DataFrame, count: int, similarity: float, radius: int, words: int = 0) -> DataFrame:
    """Edges (a, b) that connect what the pairs in a cell of ``rows`` (cell, node, linked, print, n, hashes) of that similarity connect.

    Pairs within ``radius`` whose nodes are not connected yet (by equal ``linked`` or an earlier edge of the block) are
    all checked on their sets; a pair that fails connects nothing. With ``words`` rows have the text instead of hashes,
    which is the shorter thing to shuffle, and no cell has more than SET_ROWS rows.
    """

    def links(nodes, linked, prints, chunk, cross, sets, sizes):
        root = np.unique(linked, return_inverse=True)[1]
        lengths = np.array([len(x) for x in sets])
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        parts = np.split(ids, np.cumsum(lengths)[:-1])
        marked = np.zeros(int(ids.max()) + 1 if len(ids) else 0, dtype=np.int64)
        for i in range(len(nodes) - 1):
            j = np.flatnonzero((root[i + 1 :] != root[i]) & (lengths[i + 1 :] > 0)) + i + 1
            if cross:
                j = j[chunk[j] != chunk[i]]
            j = j[np.minimum(sizes[j], sizes[i]) >= similarity * np.maximum(sizes[j], sizes[i]) - 1e-9]
            j = j[np.bitwise_count(prints[j] ^ prints[i]).sum(axis=1) <= radius]
            if not len(j):
                continue
            marked[parts[i]] = 1
            both = np.add.reduceat(marked[np.concatenate([parts[k] for k in j.tolist()])], np.cumsum(lengths[j]) - lengths[j])
            marked[parts[i]] = 0
            for k in j[both >= similarity * (sizes[i] + sizes[j] - both) - 1e-9].tolist():
                if root[k] != root[i]:
                    root[root == root[k]] = root[i]
                    yield int(nodes[i]), int(nodes[k])

    def run(batches):
        for table in whole_blocks(batches):
            starts = run_starts(table).tolist()
            found = []
            for lo, hi in zip(starts, [*starts[1:], table.num_rows]):
                part = table.slice(lo, hi - lo)
                nodes, linked, chunk, sizes = (part.column(c).to_numpy() for c in ("node", "linked", "chunk", "n"))
                if words:
                    sets = [shingle_set(x, words) for x in part.column("text").to_pylist()]
                else:
                    sets = [np.frombuffer(x, dtype=np.uint64) for x in part.column("hashes").to_pylist()]
                cross = part.column("ci")[0] != part.column("cj")[0]
                found += links(nodes, linked, words_of(part.column("print"), WIDE), chunk, cross, sets, sizes)
            a, b = np.array(found, dtype=np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return blocks(rows, 0 if words else SET_ROWS, count).mapInArrow(run, "a long, b long")


def few_links(few: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that connect what the pairs of that similarity among ``few`` (node, print, few) connect: exact, by prefixes.

    Of two sets of that similarity, each shares all but n - ceil(similarity * n) of its n shingles with the other, so
    in any fixed order (here that of the hashes) their first n - ceil(similarity * n) + 1 have one in common.
    """

    def run(batches):
        for batch in batches:
            at, cells = [], []
            for k, x in enumerate(batch.column(1).to_pylist()):
                s = np.frombuffer(x, dtype=np.int64)
                cells.append(s[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1])
                at += [k] * len(cells[-1])
            cell = pa.array(np.concatenate(cells) if cells else [], pa.int64())
            yield pa.RecordBatch.from_arrays([cell, batch.column(0).take(pa.array(at, pa.int64()))], names=["cell", "node"])

    prefixes = materialise(few.select("node", "few").mapInArrow(run, "cell long, node long"))
    met = prefixes.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("cell")
    shared = materialise(prefixes.join(met, "cell", "left_semi"))
    sets = few.select("node", F.col("node").alias("linked"), "print", F.col("few").alias("hashes"), (F.length("few") / 8).cast("long").alias("n"))
    out = materialise(exact_links(shared.join(sets, "node"), shared.count(), similarity, 64 * WIDE).distinct())
    discard(prefixes)
    discard(shared)
    return out


def hashed(texts: DataFrame, words: int) -> DataFrame:
    """(node, hashes, n) of ``texts`` (node, text): the shingle sets."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(x, words) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64())], names=["node", "hashes", "n"])

    return texts.select("node", "text").mapInArrow(run, "node long, hashes binary, n long")


def links_of_large_zones(edges: DataFrame, sets: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that connect what pairs of that similarity connect in candidate zones too large for one task.

    The edges of the cells' forests are checked first. One that fails may have stood for pairs that hold: all pairs of
    its trees' zone are checked then, but for those connected by now.
    """
    ok = materialise(verified(edges.select("a", "b").distinct(), sets, similarity))
    roots = components(ok)
    zones = unsettled(edges, ok).select("node", F.col("root").alias("cell")).join(roots, "node", "left").select("cell", "node", F.coalesce("root", "node").alias("linked"))
    zones = materialise(zones)
    split = zones.groupBy("cell").agg(F.min("linked").alias("lo"), F.max("linked").alias("hi")).where("lo < hi").select("cell")
    rows = zones.join(split, "cell", "left_semi").join(nodes.select("node", "print"), "node").join(sets, "node")
    more = materialise(exact_links(rows, zones.count(), similarity, wide_radius(similarity)))
    discard(zones)
    discard(roots)
    return ok.unionByName(more)


def similar_pairs(nodes: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """Edges (a, b) that connect what pairs of ``nodes`` (node, print, size, row) of that similarity connect; ``rows`` (row, text) has a text for each.

    Candidates that hang together are a zone. A zone of bounded size goes to one task with its texts, and all its pairs are checked.
    """
    wide = nodes.where(F.col("size") > FEW).select("node", "print")
    edges = materialise(similar_links(wide, wide.count(), similarity))  # a pair once for each tree that has it
    release(nodes.sparkSession)
    # each node with its trees' smallest ones connects the same and repeats itself from cell to cell
    zones = components(edges.select("top", F.explode(F.array("a", "b")).alias("b")).select(F.col("top").alias("a"), "b"))
    members = materialise(zones.join(nodes, "node").select("node", "root", "print", "size", "row"))
    discard(zones)
    count = members.count()
    rows = sieved(rows, members.select("row"), "row", count, "_met").where("_met").drop("_met")
    per_zone = members.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("s"))
    large = materialise(per_zone.where((F.col("m") > SET_ROWS) | (F.col("s") > ZONE_SHINGLES)).select("root"))
    within = members.join(large, "root", "left_anti")
    texts = within.select("row", F.col("root").alias("cell"), "node", F.col("node").alias("linked"), "print", F.col("size").alias("n")).join(rows, "row").drop("row")
    out = materialise(exact_links(texts, 8 * count, similarity, wide_radius(similarity), words))
    release(nodes.sparkSession)
    if not large.isEmpty():
        inside = materialise(members.join(large, "root", "left_semi"))
        sets = materialise(hashed(inside.select("row", "node").join(rows, "row"), words))
        kept = materialise(edges.join(inside.select(F.col("node").alias("a")), "a", "left_semi").select("a", "b", "tree"))
        out = out.unionByName(links_of_large_zones(kept, sets, inside, similarity))
        for used in (inside, sets, kept):
            discard(used)
    for used in (edges, members, large):
        discard(used)
    return out


def row_key(id_col: str, text: str):
    """128 bits that tell rows apart by id and text; a null id is one of its own, a null text is the empty one."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.md5(F.col(id_col).cast("string").cast("binary")), F.lit("-" * 32)), F.coalesce(F.col(text), F.lit(""))).cast("binary")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest id (nulls last).

    Groups are the components of links between documents whose sets of ``words``-word shingles have a Jaccard similarity
    of ``similarity`` or more, checked on the sets; candidates come from wide fingerprints of those sets, for sets of FEW
    shingles or fewer from shared shingles. Texts without words (nulls too) form one group. Of rows equal in id and text
    any one is kept. Empty input: no rows. ``docs`` is read again for the texts of candidates and for
    the result; only keys and fingerprints of it are stored, and only rows that a bounded bitmap of keys lets through are shuffled.
    """
    names, key = docs.columns, pick_unused(docs, "_row")
    keyed = docs.withColumn(key, row_key(id_col, text))
    reach = math.ceil(FEW / similarity)  # the largest set that one of FEW can be similar to
    held = materialise(described(keyed.select(F.col(id_col).alias("id"), F.col(key).alias("row"), F.col(text).alias("text")), words, reach))
    repeats = materialise(held.groupBy("row").count().where("count > 1").select(F.col("row").alias(key)))
    if not repeats.isEmpty():
        one = keyed.join(repeats, key, "left_semi").groupBy(key).agg(F.first(F.struct(*names)).alias("one"))
        keyed = keyed.join(repeats, key, "left_anti").select(*names, key).unionByName(one.select(*[F.col(f"one.`{c}`").alias(c) for c in names], key))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))).alias("first")
    nodes = held.groupBy("print", "key").agg(first, F.max("size").alias("size"), F.first("few").alias("few"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("row", F.col("first.row")))
    short = few_links(nodes.where("few is not null"), similarity)
    pairs = similar_pairs(nodes.select("node", "print", "size", "row"), keyed.select(F.col(key).alias("row"), F.col(text).alias("text")), words, similarity)
    roots = components(short.unionByName(pairs))
    kept = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    gone = materialise(held.select("row").join(kept, "row", "left_anti").select(F.col("row").alias(key)))
    for used in (held, nodes, short, pairs, roots):
        discard(used)
    release(docs.sparkSession)
    maybe = pick_unused(keyed, "_maybe")
    marked = sieved(keyed, gone, key, gone.count(), maybe)
    return marked.where(~F.col(maybe)).select(*names).unionByName(marked.where(maybe).join(gone, key, "left_anti").select(*names))

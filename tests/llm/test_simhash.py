import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import simhash
from lectern.llm.queries import op1_simhash
from lectern.llm.shared import components


def brute_print(text, words=3):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(tokens[k : k + words]) for k in range(len(tokens) - words + 1)] if len(tokens) >= words else ([" ".join(tokens)] if tokens else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def brute_components(ids, prints, radius=3):
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        r = find(k)
        least[r] = i if least.get(r) is None else (least[r] if i is None else min(least[r], i))
    return [least[find(k)] for k in range(len(ids))]


def check(rows, got):
    prints = [brute_print(t) for _, t in rows]
    wanted = Counter(zip([i for i, _ in rows], [f"{p:016x}" for p in prints], brute_components([i for i, _ in rows], prints)))
    assert Counter(got) == wanted


def test_documents(spark, sf, documents):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in op1_simhash(spark, sf).collect()]
    check([(r.doc_id, r.text) for r in documents.collect()], got)


def test_odd_rows(clashing, empty):
    out = simhash.near_duplicates(clashing).select("doc_id", simhash.hex_digits("fingerprint").alias("f"), "component_id")
    check([(r.doc_id, r.text) for r in clashing.collect()], [tuple(r) for r in out.collect()])
    assert simhash.near_duplicates(empty).count() == 0


def test_links_of_random_prints_with_a_hot_cell(spark, monkeypatch):
    """Small chunks: hot cells are split and every link is still found."""
    monkeypatch.setattr(simhash, "CELL_ROWS", 16)
    draw = np.random.default_rng(5)
    base = int(draw.integers(0, 2**63))
    prints = {base} | {base ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in draw.integers(0, 63, (200, 3))}
    prints |= {int(x) for x in draw.integers(0, 2**63, 200)}
    prints = sorted(prints)
    nodes = spark.createDataFrame([(p, p.to_bytes(8, "little")) for p in prints], "node long, print binary")
    roots = dict(map(tuple, components(simhash.links_within(nodes, len(prints)).select("a", "b")).collect()))
    wanted = brute_components(prints, prints)
    assert [roots.get(p, p) for p in prints] == wanted


def test_grid_cells_lose_no_pair_and_references_discard_the_others(spark):
    """Every pair within the radius shares a cell of pivot coordinates; of unrelated pairs in a cell nearly all are discarded before their bits are read."""
    draw = np.random.default_rng(1)
    prints = []
    for x in draw.integers(0, 2**63, 150).tolist():
        prints += [x, x ^ sum(1 << int(b) for b in set(draw.integers(0, 63, 3).tolist()))]
    prints = sorted(set(prints))
    nodes = spark.createDataFrame([(p, p.to_bytes(8, "little")) for p in prints], "node long, print binary")
    cells = {}
    for r in simhash.grid_cells(nodes, 3, 2).collect():
        cells.setdefault(r.cell, set()).add(r.node)
    met = {(a, b) for c in cells.values() for a in c for b in c if a < b}
    assert {(a, b) for k, a in enumerate(prints) for b in prints[k + 1 :] if bin(a ^ b).count("1") <= 3} <= met
    refs = simhash.pivots(1)[:, 0]
    x = draw.integers(0, 2**63, 4000).astype(np.uint64)
    y = x ^ (draw.integers(0, 2**38, 4000).astype(np.uint64) << np.uint64(26))  # two of five blocks agree
    near = np.bitwise_count(x ^ y) <= 3
    table = [np.abs(np.bitwise_count(v[:, None] ^ refs[None, :]).astype(int)) for v in (x, y)]
    survive = np.abs(table[0] - table[1]).max(1) <= 3
    assert survive[near].all() and survive.mean() < 0.02


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(8, 60)] + [(5, 5), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[k] for k in range(100, 141)} == {100} and {got[k] for k in range(7, 60)} == {7} and 5 not in got and 3 not in got


def jaccard(a, b, words=5):
    x, y = (set(simhash.shingle_set(t, words).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_keep_one(spark, sf, documents):
    rows = documents.collect()
    kept = {r.doc_id for r in simhash.keep_one(documents).collect()}
    ids, texts = [r.doc_id for r in rows], [r.text for r in rows]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if jaccard(texts[a], texts[b]) >= 0.8:
                p, q = sorted((find(ids[a]), find(ids[b])))
                root[q] = p
    assert kept == {i for i in ids if find(i) == i}


def test_keep_one_odd(clashing, empty):
    kept = simhash.keep_one(clashing.withColumn("row", F.lit(1)).withColumn("key", F.lit(2)))
    assert kept.columns[: len(clashing.columns)] == clashing.columns and kept.columns[-2:] == ["row", "key"]
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == [-1, 1, 3, 6, 7, 8, 8, 9]
    assert simhash.keep_one(empty).count() == 0


def below_and_above(groups, texts, links):
    """``groups`` of ``texts`` texts at 0.784 of each other; in each, ``links`` pairs of 0.820."""
    draw, rows = np.random.default_rng(3), []
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(200)]
        for t in range(texts):
            tail = [f"g{g}t{t}x{k}" for k in range(27)]
            if t < 2 * links:
                tail[:5] = [f"g{g}pair{t // 2}x{k}" for k in range(5)]
            rows.append((g * texts + t, " ".join(base + tail)))
    draw.shuffle(rows)
    return [(int(i), str(t)) for i, t in rows]


@pytest.mark.parametrize("rows_a_cell", [100, 1024])
def test_links_within_a_large_group_just_below_the_threshold(spark, monkeypatch, rows_a_cell):
    """Edges below the threshold join the group's nodes; the true links among them are still found, in one task and over chunks."""
    monkeypatch.setattr(simhash, "SET_ROWS", rows_a_cell)
    rows = below_and_above(1, 300, 60)
    assert jaccard(rows[0][1], rows[1][1]) < 0.8
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(300)) - set(range(1, 120, 2))


def test_short_texts_that_differ_by_a_word(spark):
    """Four shingles and the same with a fifth: 0.8 exactly; and pairs on both sides of FEW."""
    rows, gone = [], set()
    for k in range(400):
        text = [f"t{k}w{i}" for i in range(8)]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join([*text, "more"]))]
        gone.add(2 * k + 1)
    for k in range(400, 500):
        text = [f"t{k}w{i}" for i in range(66)]  # 62 shingles, then 77
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join([*text, *(f"t{k}v{i}" for i in range(15))]))]
        gone.add(2 * k + 1)
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i for i, _ in rows} - gone

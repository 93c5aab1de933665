import numpy as np

from lectern.llm import vectors
from lectern.llm.queries import op9_vectors


def brute(rows, threshold=0.98):
    """{position: (links, component)}; rows: (id, vector, label)."""

    def ok(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    unit = [np.array(v, dtype=float) / np.abs(v).max() if ok(v, l) else None for _, v, l in rows]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    links, root = [0] * n, list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(n):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k in range(n):
        if rows[k][0] is not None:
            r = find(k)
            least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    return sorted(((rows[k][0] is not None, rows[k][0] or 0, links[k], least.get(find(k))) for k in range(n)), key=str)


def same(got, rows):
    assert sorted(((r[0] is not None, r[0] or 0, r[1], r[2]) for r in got), key=str) == brute(rows)
    assert all(r[3] == (r[0] is not None and r[0] == r[2]) for r in got)


def planted(n=400, dims=64, seed=0):
    draw = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        base = draw.normal(size=dims)
        rows.append((len(rows), base.tolist(), int(k % 3)))
        for _ in range(k % 4):
            rows.append((len(rows), (base + draw.normal(size=dims) * draw.uniform(0.02, 0.19) * np.linalg.norm(base) / 8).tolist(), int(k % 3)))
    return rows


def test_recall_and_precision(spark):
    rows = planted()
    got = vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    wanted, mine = brute(rows), sorted(((True, r[0], r[1], r[2]) for r in got), key=str)
    total, found = sum(w[2] for w in wanted), sum(m[2] for m in mine)
    assert total > 300 and 0.99 * total <= found <= total


def test_hot_group_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 20)
    draw = np.random.default_rng(1)
    base = draw.normal(size=16)
    rows = [(k, (base + draw.normal(size=16) * 0.01).tolist(), 1) for k in range(150)] + [(200 + k, base.tolist(), 1) for k in range(30)] + [(300 + k, base.tolist(), 2) for k in range(3)]
    same(vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect(), rows)


def test_query(spark, sf):
    got = op9_vectors(spark, sf).collect()
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    same(got, [(r.vec_id, r.embedding, r.label) for r in table.collect()])


def test_odd(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1),
        (9, [], 1), (None, [1.0, 0.001], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1e200, 0.0], 1), (13, [-1.0, 0.0], 1), (14, [1.0, 0.0], 2),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    same(vectors.near_duplicate_vectors(table).collect(), rows)
    from pyspark.sql import functions as F

    extra = table.withColumn("node", F.lit("x")).withColumn("v", F.lit("y")).withColumn("cell", F.lit(1))
    same(vectors.near_duplicate_vectors(extra).collect(), rows)
    assert vectors.near_duplicate_vectors(table.limit(0)).count() == 0
    assert vectors.near_duplicate_vectors(table.where("vec_id = 4")).collect()[0][:] == (4, 0, 4, True)

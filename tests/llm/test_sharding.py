import zlib
from collections import Counter

from lectern.llm import sharding


def feistel(x, rows, seed=42):
    a, b = sharding.grid(rows)

    def value(v, key, side):
        return ((v % sharding.PRIME * key[0] + key[1]) % sharding.PRIME % sharding.FOLD * key[1] + key[0]) % sharding.PRIME % side

    while True:
        left, right = divmod(x, b)
        for n, key in enumerate(sharding.round_keys(seed)):
            if n % 2 == 0:
                left = (left + value(right, key, a)) % a
            else:
                right = (right + value(left, key, b)) % b
        x = left * b + right
        if x < rows:
            return x


def check(docs, shards=16):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    ordered = sorted(((i is not None, i or 0, len(t) + 1, zlib.crc32(t)) for i, t in rows))
    wanted = Counter()
    for k, (some, i, size, crc) in enumerate(ordered):
        p = feistel(k, len(rows))
        wanted[(i if some else None, size, crc, "rows", p % shards, p // shards, None)] += 1
    got = sharding.shard(docs, shards).collect()
    if len(set(ordered)) == len(ordered):
        assert Counter(map(tuple, got)) == wanted
    else:  # equal rows are interchangeable
        assert Counter(tuple(r)[:3] for r in got) == Counter({k[:3]: 0 for k in wanted}) + sum((Counter({k[:3]: n}) for k, n in wanted.items()), Counter())
    slots = Counter((r.shard, r.slot) for r in got)
    sizes = Counter(r.shard for r in got)
    assert max(slots.values(), default=1) == 1
    assert all({r.slot for r in got if r.shard == s} == set(range(n)) for s, n in sizes.items())
    assert not sizes or max(sizes.values()) - min([sizes.get(s, 0) for s in range(shards)]) <= 1


def test_documents(documents):
    check(documents)


def test_odd(clashing, empty):
    check(clashing)
    assert sharding.shard(empty).count() == 0


def test_one_row(documents):
    check(documents.limit(1))


def test_permutation_and_partitioning(spark, documents):
    for rows in (1, 2, 3, 10, 97, 1000):
        got = spark.range(rows).select(sharding.walked("id", rows, 9).alias("p")).collect()
        assert [r.p for r in got] == [feistel(k, rows, 9) for k in range(rows)]
        assert sorted(r.p for r in got) == list(range(rows))
    one = Counter(map(tuple, sharding.shard(documents).collect()))
    assert one == Counter(map(tuple, sharding.shard(documents.repartition(7)).collect()))


def test_no_python_in_the_plan(documents):
    plan = sharding.shard(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

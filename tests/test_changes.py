from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import changes as cdc
from lectern.operators import graph
from lectern.operators.windows import places
from lectern.streaming import queues


def test_diff_and_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, None), (4, "w")], "k int, v string")
    assert {r.k: r.change for r in cdc.keyed_diff(a, b, ["k"], ["v"]).collect()} == {1: "update", 2: "same", 3: "remove", 4: "add"}


def test_candidates(spark):
    prev = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, content string")
    batch = spark.createDataFrame([("a", "1", 0, None), ("a", "9", 1, None), ("b", "8", 2, None), ("d", "4", 3, None), ("e", "5", 4, "bad")], "k string, content string, ix int, invalid string")
    got = {(r.k, r.occurrence): r.status for r in cdc.candidate_statuses(prev, batch, "k", "content", "ix", "invalid").collect()}
    assert got == {("a", 0): "unchanged", ("a", 1): "duplicate", ("b", 2): "changed", ("d", 3): "new", ("e", 4): "invalid", ("c", None): "missing"}


def test_fold(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    deltas = spark.createDataFrame([(1, 1, "x", 1), (1, 2, None, 1), (2, 5, "no", 2), (3, 1, "new", 1), (None, 9, "y", 1)], "k int, g int, v string, c int")
    assert {r.k: r.v for r in cdc.fold_deltas(base, deltas, "k", "g", "v", "c").collect()} == {2: "b", 3: "new"}


def test_activation(spark):
    g = spark.createDataFrame([("f", 1, 1, "active"), ("f", 2, 2, "staged"), ("f", 3, 3, "staged"), ("h", 4, 1, "active")], "file string, g int, q int, status string")
    assert {r.g: r.status for r in cdc.activate(g, "file", "g", "q", "status").collect()} == {1: "archived", 2: "refused", 3: "active", 4: "active"}


def test_upserts(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    assert sorted((r.k, r.v) for r in cdc.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d"), (3, "e")]
    assert sorted((r.k, r.v) for r in cdc.insert_missing(old, new, ["k"]).collect()) == [(1, "a"), (2, "b"), (3, "d")]


def test_graphs(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (5, None)], "child int, parent int")
    assert {r.node for r in graph.cycles(e).collect()} == {1, 2, 3}
    got = {(r.node, r.ancestor): r.depth for r in graph.closure(e).collect()}
    assert got[(4, 1)] == 2 and got[(1, 1)] == 3 and len(got) == 12


def test_text_functions(spark):
    rows = [("1,000 gp", "1 1/2 lb.", "1/4"), ("1/2 gp", "x", "12"), ("3 зм", "2 lbs", "x"), ("no", None, None), ("1/3 cp", "1/0 lb", "0")]
    df = spark.createDataFrame(rows, "m string, w string, c string")
    q, shown = T.rational("c")
    got = df.select(T.money("m"), T.weight("w"), q, shown).collect()
    assert [tuple(r) for r in got] == [(100_000, 1.5, 0.25, "1/4"), (50, None, 12.0, "12"), (300, 2.0, None, None), (None, None, None, None), (None, None, 0.0, "0")]
    one = spark.createDataFrame([("  --Red Dragon's / (Old)! ", "a\r\n\n\n\nb \t c ")], "n string, q string")
    r = one.select(T.normalize_name("n").alias("n"), T.clean_quote("q").alias("q"), T.first_sentence(F.lit("Hi 3.5 a. B")).alias("s"), T.truncated(F.lit("abcdef"), 4).alias("t"), T.redacted(F.lit("http://u:p@h/ token=abc x")).alias("r")).first()
    assert r.n == "red-dragon's-old" and r.q == "a\n\nb c" and r.s == "Hi 3.5 a." and r.t == "abc…" and r.r == "http://[redacted]@h/ token=[redacted] x"


def test_rate_limit(spark):
    e = spark.sql("select * from values (1, timestamp'2024-01-01 00:00:00', 1), (1, timestamp'2024-01-01 00:30:00', 2), (1, timestamp'2024-01-01 00:59:59', 3), (1, timestamp'2024-01-01 01:00:00', 4), (2, timestamp'2024-01-01 00:00:01', 5) t(k, ts, i)")
    e = e.select(F.col("k").cast("long").alias("k"), "ts", F.col("i").cast("long").alias("i"))
    assert {r.i: r.allowed for r in queues.rate_limited(e, "k", "ts", "i", 2, 3600).collect()} == {1: True, 2: True, 3: False, 4: True, 5: True}


def test_stable_key_of_long_texts(monkeypatch):
    """The same as letter by letter, and each letter is worked out once."""
    import re
    import unicodedata

    def plain(name):
        table = dict(zip(T.CYRILLIC, T.LATIN))
        letters = "".join(table[c] if c in table else "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in unicodedata.normalize("NFC", name).lower())
        return re.sub(r"[^a-z0-9]+", "-", letters.lower()).strip("-")[:128].rstrip("-")

    odd = ["", "ß ΑΣ Σ", "I\u0307İ ①②ﬁ", "й и\u0306 Щъэ", "e\u0301\u0323 \u212b", "\U0001d400 \ud7ff \ue000", "- a -", "".join(chr(n) for n in range(1, 0x3000))]
    assert [T.stable_key(x) for x in odd] == [plain(x) for x in odd]
    calls, normal = [], unicodedata.normalize
    monkeypatch.setattr(unicodedata, "normalize", lambda form, x: calls.append(form) or normal(form, x))
    T.stable_key("héllo wörld " * 500)
    assert len(calls) <= 20


def test_keys_and_snippets():
    assert T.stable_key("Огненный Шар!") == "ognennyi-shar" and T.stable_key("Déjà  Vu №1") == "deja-vu-no1" and T.stable_key("Ёж") == "ezh" and T.stable_key("—") == ""
    text = " ".join(f"w{k}" for k in range(100)) + " fire bolt " + " ".join(f"v{k}" for k in range(100)) + " fire"
    s = T.snippet(text, ["fire", "bolt"])
    assert s.count("[[fire]] [[bolt]]") == 1 and s.count("[[fire]]") == 2 and " ... " in s and all(len(f.split()) <= 35 for f in s.split(" ... "))
    assert T.snippet("a b", ["x"]) == "a b" and T.snippet("", ["x"]) == ""


def test_closures_go_on_to_the_end(spark, tmp_path):
    """A chain of 40 steps, and loops that are found whatever hangs on them."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    e = spark.createDataFrame([(k, k + 1) for k in range(40)], "child long, parent long")
    got = {(r.node, r.ancestor): r.depth for r in graph.closure(e).collect()}
    assert got == {(a, b): b - a for a in range(40) for b in range(a + 1, 41)}
    steps = e.select(F.col("child").alias("a"), F.col("parent").alias("b"))
    assert {r.node for r in graph.reach(spark.createDataFrame([(0,)], "node long"), steps).collect()} == set(range(41))
    loops = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(30, 28), (40, 41), (41, 40), (50, 50), (None, 1)], "child long, parent long")
    assert {r.node for r in graph.cycles(loops).collect()} == {28, 29, 30, 40, 41, 50} and graph.cycles(e).count() == 0


def test_whole_tables(spark, tmp_path):
    """Parts, entries and customers past the cuts of the SQL are there."""
    from lectern.plans.registry import QUERIES

    spark.sparkContext.setCheckpointDir(str(tmp_path / "c"))
    n, sf = 5000, str(tmp_path)
    spark.range(1, n + 1).select(F.col("id").alias("p_partkey"), *[F.lit("x").alias(c) for c in ("p_name", "p_type", "p_brand")], F.lit(1).alias("p_size"), F.lit(1.0).alias("p_retailprice")).write.parquet(f"{sf}/part.parquet")
    spark.range(n).select(F.col("id").alias("c_custkey"), F.lit("s").alias("c_mktsegment")).write.parquet(f"{sf}/customer.parquet")
    spark.createDataFrame([(7, 1, "view")], "user_id long, event_id long, event_type string").write.parquet(f"{sf}/events.parquet")
    up = {k: 4 if k == 1 else k // 2 for k in range(1, n + 1)}
    depths = {}
    for k in up:
        at, d = k, 0
        while at in up and (k, up[at]) not in depths:
            at, d = up[at], d + 1
            depths[(k, at)] = d
    got = {(r.node, r.ancestor): r.depth for r in QUERIES["h_02_ancestors"](spark, sf).collect()}
    assert got == depths
    assert {r.node for r in QUERIES["h_01_cycles"](spark, sf).collect()} == {k for k in up if (k, k) in depths}
    below = {}
    for k, a in depths:
        below[a] = below.get(a, 0) + 1
    assert {r.ancestor: r.below for r in QUERIES["u_03_recursive_union"](spark, sf).collect()} == below
    assert {r.node for r in QUERIES["h_04_affected"](spark, sf).collect()} == {37} | {k for k, a in depths if a == 37}
    assert {r.k: r.v for r in QUERIES["cdc_09_fold_deltas"](spark, sf).collect()} == {k: "view" if k == 7 else "s" for k in range(n)}
    got = {r.canonical_key: r.place for r in QUERIES["o_15_byte_order"](spark, sf).collect()}
    assert got == {k: i for i, k in enumerate(sorted(f"part-{k}" for k in range(1, n + 1)), 1)}


def test_places_of_equal_and_missing_keys(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    keys = ["b", "a", None, "b", "c"]
    got = places(spark.createDataFrame([(k,) for k in keys], "k string"), "k", "place").collect()
    assert sorted((r.place, r.k) for r in got) == [(1, None), (2, "a"), (3, "b"), (4, "b"), (5, "c")]
    assert places(spark.createDataFrame([], "k string"), "k", "place").count() == 0

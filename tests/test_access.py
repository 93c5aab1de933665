from itertools import product

from pyspark.sql import functions as F

from lectern.functions.access import access_predicate, corpus_predicate, may_see, ordinal

ROWS = [("open", False, None), ("premium", True, None), ("premium", False, None), ("personal", False, "u1"), ("personal", False, "u2"), (None, None, None)]


def test_matrix(spark):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(ROWS)], "k int, access_tier string, is_shared boolean, owner_id string")
    for role, user in product(("admin", "premium", "user", "other"), ("u1", "u3", None)):
        got = {r.k for r in df.where(access_predicate(role, user)).collect()}
        wanted = {k for k, r in enumerate(ROWS) if role == "admin" or (r[0] is not None and may_see(role, user, *r))}
        assert got == wanted, (role, user)


def test_selection_only_narrows(spark):
    df = spark.createDataFrame([("5e", "en", "homebrew"), ("5.5e", "ru", "homebrew")], "edition string, language string, category string")
    assert df.where(corpus_predicate()).count() == 2
    assert df.where(corpus_predicate(edition="5e", category="homebrew")).count() == 1


def test_enum_order(spark):
    df = spark.createDataFrame([("5.5e",), ("5e",), ("x",)], "e string")
    assert [r.e for r in df.orderBy(ordinal("e", ("5e", "5.5e"))).collect()] == ["x", "5e", "5.5e"]


def test_filters_reach_the_scan(spark, sf):
    from lectern.functions.access import readable
    from lectern.sources.views import docs

    plan = readable(docs(spark, sf), "premium", "u3", language="en").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "text" not in plan.split("ReadSchema")[1]
    assert F is not None

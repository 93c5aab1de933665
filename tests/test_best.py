import datetime

import pytest
from pyspark.sql import functions as F

from lectern.operators.windows import SHARES, best_by_shares, best_of
from lectern.plans import registry
from lectern.plans.relational import best_versions
from lectern.sources.views import publications, versions

KEYS = [("entry_id",), ("entry_id", "language"), ("entry_id", "language", "access_tier"), ("entry_id", "nation", "language")]


def order():
    return [F.desc("priority"), F.desc("published_at"), F.asc("version_id")]


def day(n):
    return None if n is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Sources of equal and of no priority, equal and missing dates, ids whose order as text differs, an entry that a third of the lines name, and lines without an entry or with an unknown source."""
    lines = [(n % 7 if n % 3 else 3, (n * 5) % 23, day(n % 4)) for n in range(1500)]
    lines += [(99, s, None) for s in (2, 10, 11)] + [(98, 2, None), (98, 10, day(0)), (None, 10, day(1)), (None, 2, day(1)), (3, 5000, day(9))]
    suppliers = [(s, None if s % 11 == 1 else 10.0 * (s % 3), s % 5) for s in range(23)]
    path = str(tmp_path_factory.mktemp("best"))
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_shipdate timestamp").repartition(3).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_acctbal double, s_nationkey int").write.parquet(f"{path}/supplier.parquet")
    return path


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("keys", KEYS)
@pytest.mark.parametrize("where", ["true", "access_tier IN ('open', 'premium')"])
def test_as_by_versions(spark, folder, keys, where):
    want = best_of(versions(spark, folder).where(where), list(keys), order())
    got = best_versions(spark, folder, keys, where)
    assert rows(got.select(*want.columns)) == rows(want)


def test_list_sources(spark, folder):
    """The sources of the best versions, without a table of (entry, source) pairs below."""
    best = best_of(versions(spark, folder), ["entry_id", "language"], order())
    want = best.groupBy("source_no").agg(F.count(F.lit(1)).alias("entries"), F.max("priority").alias("priority"))
    got = registry.QUERIES["list_sources"](spark, folder)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == rows(want) and plan.count("Aggregate(") == 2  # by source alone, in two steps


def test_nothing(spark, folder):
    assert best_versions(spark, folder, where="false").count() == 0


@pytest.mark.parametrize("keys", KEYS)
def test_no_table_of_all_pairs(spark, folder, keys):
    """Memory of a task: no aggregate holds (entry, source) pairs, and nothing but the two dealings by number of rows is shuffled."""
    plan = best_versions(spark, folder, keys)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan
    assert plan.count("Exchange hashpartitioning(") == plan.count("REPARTITION_BY_NUM") == 2


def test_tasks_grow_with_rows(spark, folder):
    p = publications(spark, folder)
    best = best_by_shares(p, ["entry_id"], order(), "entry_id", "source_no", rows=100, per_task=4)
    assert best._jdf.queryExecution().executedPlan().toString().count(", 25), REPARTITION_BY_NUM") == 2
    assert rows(best) == rows(best_of(p, ["entry_id"], order()))


def test_a_frequent_key_is_shared(spark):
    """A key of most rows: its shares are about equal, and the best of them is the best."""
    df = spark.range(5000).select(F.when(F.col("id") < 4500, 1).otherwise(F.col("id")).alias("k"), "id", (F.col("id") % 10).alias("v"))
    by = [F.desc("v"), F.asc("id")]
    best = best_by_shares(df, ["k"], by, "k", "id", rows=5000, per_task=250)
    assert rows(best) == rows(best_of(df, ["k"], by)) and best.count() == 501
    assert "hashpartitioning(k" in (plan := best._jdf.queryExecution().executedPlan().toString()) and "_share" in plan
    shares = df.where("k = 1").groupBy(F.pmod(F.hash("id"), F.lit(SHARES))).count().collect()
    assert len(shares) == SHARES and max(r["count"] for r in shares) < 4500 / SHARES * 1.5

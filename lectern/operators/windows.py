"""Best-of and first-of selections by window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_of(df: DataFrame, keys: list[str], order: list[Column], mark: str | None = None) -> DataFrame:
    """The first row of each group in ``order`` (which should be total); with ``mark``, all rows and a rank column."""
    ranked = df.withColumn(mark or "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if mark else ranked.where("_rank = 1").drop("_rank")


#: Shares in which the rows of one key are first reduced.
SHARES = 16


def best_by_shares(df: DataFrame, keys: list[str], order: list[Column], key: str, spread: str, rows: int, per_task: int = 2_000_000) -> DataFrame:
    """``best_of`` for many rows (``rows``, roughly), dealt by ``key``, one of ``keys``, over as many tasks as keep each at ``per_task`` rows or so.

    First the best of each key's SHARES shares, made by ``spread``, then the best of these: a frequent key's rows lie in several tasks.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))
    shares = df.withColumn("_share", F.pmod(F.hash(spread), F.lit(SHARES))).repartition(n, key, "_share")
    tops = best_of(shares, [*keys, "_share"], order).drop("_share")
    return best_of(tops.repartition(n, key), keys, order)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` values of each group, by a partial aggregate instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(picked.alias("_best")).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def places(df: DataFrame, key: str, place: str) -> DataFrame:
    """``df`` with the row number in the order of ``key``, over ranges of keys that are numbered apart and moved by the rows before them."""
    dealt = df.repartitionByRange(key).withColumn("_part", F.spark_partition_id()).checkpoint()
    before, rows = 0, []
    for part, n in sorted(map(tuple, dealt.groupBy("_part").count().collect())):  # a row for each partition
        rows.append((part, before))
        before += n
    moved = dealt.join(F.broadcast(df.sparkSession.createDataFrame(rows, "_part int, _before long")), "_part")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return moved.withColumn(place, own + F.col("_before")).drop("_part", "_before")


def running_before(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each in ``order`` (total) within ``keys``, 0 for the first.

    Ranges of (keys, order) are summed apart and moved by the sums of the ranges before them, so the rows of one key may lie in many tasks.
    """
    dealt = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    own = F.coalesce(F.sum(value).over(Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_own", own).join(bases, [*keys, "_part"]).withColumn(out, F.col("_own") + F.col("_base")).drop("_own", "_base", "_part")

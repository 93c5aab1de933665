"""Change data: keyed diffs, candidate statuses, delta folding, feeds, upserts, activation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per key: add, remove, update (any of ``values`` differs, nulls equal to nulls) or same. One full outer join."""
    a = old.select(*keys, F.struct(*values).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(*keys, F.struct(*values).alias("_new"), F.lit(True).alias("_in_new"))
    same = F.col("_old").eqNullSafe(F.col("_new"))
    change = F.when(F.col("_in_old").isNull(), "add").when(F.col("_in_new").isNull(), "remove").when(~same, "update").otherwise("same")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change"))


def candidate_statuses(previous: DataFrame, batch: DataFrame, key: str, content: str, order: str, invalid: str) -> DataFrame:
    """Status of each candidate of ``batch`` against ``previous``, plus rows for what is missing.

    The first occurrence of a key decides (invalid, new, changed, unchanged);
    later ones are duplicates. A key of ``previous`` with no valid or invalid
    candidate is missing.
    """
    first = batch.groupBy(key).agg(F.min(order).alias("_first"))
    marked = batch.join(first, key)
    joined = marked.join(previous.select(key, F.col(content).alias("_before")), key, "left")
    status = (
        F.when(F.col(order) != F.col("_first"), "duplicate")
        .when(F.col(invalid).isNotNull(), "invalid")
        .when(F.col("_before").isNull(), "new")
        .when(F.col("_before") == F.col(content), "unchanged")
        .otherwise("changed")
    )
    seen = joined.select(key, F.col(order).alias("occurrence"), status.alias("status"))
    gone = previous.join(batch.select(key), key, "left_anti").select(key, F.lit(None).cast(batch.schema[order].dataType).alias("occurrence"), F.lit("missing").alias("status"))
    return seen.unionByName(gone)


def fold_deltas(base: DataFrame, deltas: DataFrame, key: str, generation: str, value: str, version: str, contract: int = 1) -> DataFrame:
    """Base (key, value) folded with deltas: the highest generation per key wins, a null value deletes, other contracts and keyless deltas are inert."""
    usable = deltas.where((F.col(version) == contract) & F.col(key).isNotNull() & F.col(generation).isNotNull())
    last = usable.groupBy(key).agg(F.max_by(F.struct(F.col(value).alias("v")), generation).alias("_d"))
    out = base.select(key, value).join(last, key, "full_outer")
    return out.select(key, F.when(F.col("_d").isNotNull(), F.col("_d.v")).otherwise(F.col(value)).alias(value)).where(F.col(value).isNotNull())


def change_feed(rows: DataFrame, since: Column, indexed: str, retired: str, key: str) -> DataFrame:
    """Rows whose later of indexed and retired is after ``since``, with the kind of change, in cursor order."""
    at = F.greatest(F.col(indexed), F.coalesce(F.col(retired), F.lit(None).cast("timestamp")))
    return rows.withColumn("changed_at", at).where(F.col("changed_at") > since).withColumn("kind", F.when(F.col(retired).isNotNull(), "deleted").otherwise("upserted")).orderBy("changed_at", key)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` rows replace ``old`` ones of the same keys; the rest of ``old`` stays."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` rows whose keys ``old`` lacks are added (one per key: the smallest row); others are ignored."""
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return old.unionByName(one.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def activate(generations: DataFrame, file: str, generation: str, queued: str, status: str) -> DataFrame:
    """The newest staged generation of each file becomes active, its predecessors are archived; older staged ones are refused."""
    staged = generations.where(F.col(status) == "staged").groupBy(file).agg(F.max(F.struct(queued, generation)).alias("_top"))
    g = generations.join(staged, file, "left")
    top = F.struct(queued, generation) == F.col("_top")
    new = (
        F.when((F.col(status) == "staged") & top, "active")
        .when(F.col(status) == "staged", "refused")
        .when((F.col(status) == "active") & F.col("_top").isNotNull(), "archived")
        .otherwise(F.col(status))
    )
    return g.select(file, generation, new.alias(status))


def check_transitions(history: DataFrame, key: str, order: list[str], state: str, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """Consecutive states of a key that the transition rules don't allow."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    ok = reduce(lambda a, b: a | b, [(F.col("before") == k) & F.col(state).isin(*v) for k, v in allowed.items() if v], F.lit(False))
    return history.withColumn("before", before).where(F.col("before").isNotNull() & ~ok)


def export_problems(records: DataFrame, old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(entry_id, problem) of change ``records`` (entry_id, kind, previous, current) against the catalogs ``old`` and ``new`` (key, value).

    lost: a change without a record; invented: a record without a change; kind, hash: a record that says otherwise than the catalogs.
    """
    a, b = old.select(F.col(key).alias("entry_id"), F.col(value).alias("was")), new.select(F.col(key).alias("entry_id"), F.col(value).alias("now"))
    both = a.join(b, "entry_id", "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("updated")
    met = both.withColumn("really", kind).join(records, "entry_id", "full_outer")
    problem = (
        F.when(F.col("kind").isNull(), "lost")
        .when(F.col("really").isNull(), "invented")
        .when(F.col("kind") != F.col("really"), "kind")
        .when(~(F.col("previous").eqNullSafe(F.col("was")) & F.col("current").eqNullSafe(F.col("now"))), "hash")
    )
    return met.select("entry_id", problem.alias("problem")).where("problem is not null")


def has_projection(revisions: DataFrame, projections: dict[str, DataFrame], key: str, kind: str) -> DataFrame:
    """``revisions`` (key, kind) with ``projected``: whether the projection of its kind has its key. Kinds without a projection have none."""
    tagged = [d.select(key, F.lit(k).alias(kind), F.lit(True).alias("_has")).distinct() for k, d in projections.items()]
    return revisions.join(reduce(DataFrame.unionByName, tagged), [key, kind], "left").withColumn("projected", F.coalesce("_has", F.lit(False))).drop("_has")


def revision_guard(before: str, after: str, published_at: str, same: Column) -> Column:
    """'immutable' for an update of a revision that may not be; '' for the publication of a draft that changes nothing else (``same``)."""
    ok = (F.col(before) == "draft") & (F.col(after) == "published") & F.col(published_at).isNotNull() & same
    return F.when(F.coalesce(ok, F.lit(False)), "").otherwise("immutable")


def version_guard(before: str, after: str, same_boundary: Column, has_revision: str) -> Column:
    """What an update of a version breaks: 'backwards' (lifecycle), 'boundary' (source and corpus, once it has a revision), or ''."""
    a, b = F.col(before), F.col(after)
    back = ((a == "published") & (b == "draft")) | ((a == "retired") & (b != "retired"))
    return F.when(back, "backwards").when(~same_boundary & F.col(has_revision), "boundary").otherwise("")

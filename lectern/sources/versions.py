"""Stored tables that are replaced bucket by bucket, and revision files checked against what a manifest and its deltas say.

A stored table is a folder of bucket directories and of pointers. A pointer is
a small file that names the directory of each bucket; the one with the highest
number holds. A write makes new directories for the buckets that it touches
and then the next pointer, in one step that fails if another writer was first;
until then readers see the old state, and what an interrupted write leaves is in no pointer.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.changes import insert_missing, upsert
from lectern.sources.stores import _files

#: Buckets of a stored table, and so the entries of a pointer.
BUCKETS = 32


def pointer(spark: SparkSession, root: str) -> tuple[int, dict]:
    """(number, pointer) of the present state: {"buckets": n, "keys": [...], "schema": DDL, "paths": {bucket: directory}}; (0, {}) where nothing is stored."""
    files, at = _files(spark, f"{root}/pointers")
    if not files.exists(at):
        return 0, {}
    number = max((int(s.getPath().getName()) for s in files.listStatus(at) if s.getPath().getName().isdigit()), default=0)
    return (number, json.loads("\n".join(r.value for r in spark.read.text(f"{root}/pointers/{number}", wholetext=True).collect()))) if number else (0, {})


def point(spark: SparkSession, root: str, number: int, value: dict) -> None:
    """Makes ``value`` the pointer with ``number``: written beside it and renamed; raises FileExistsError where that number is taken."""
    files, staged = _files(spark, f"{root}/pointers/.{uuid.uuid4().hex}")
    _, wanted = _files(spark, f"{root}/pointers/{number}")
    out = files.create(staged, False)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    if files.exists(wanted) or not files.rename(staged, wanted):
        files.delete(staged, False)
        raise FileExistsError(f"pointer {number} of {root}")


def bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def stored(spark: SparkSession, root: str) -> DataFrame | None:
    """The rows of a stored table; None where nothing is stored."""
    _, now = pointer(spark, root)
    if not now:
        return None
    paths = sorted(now["paths"].values())
    return spark.read.schema(now["schema"]).parquet(*[f"{root}/{p}" for p in paths]) if paths else spark.createDataFrame([], now["schema"])


def replace_rows(root: str, batch: DataFrame, keys: list[str], missing_only: bool = False, buckets: int = BUCKETS) -> int:
    """Stores ``batch`` (unique ``keys``): its rows replace those of the same keys, or with ``missing_only`` only those with new keys are added. Gives the pointer's number.

    Reads and writes the buckets that hold a key of the batch; the others stay as they are. The number of buckets and the keys are those of the first write.
    """
    spark = batch.sparkSession
    number, now = pointer(spark, root)
    now = now or {"buckets": buckets, "keys": keys, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields), "paths": {}}
    if now["keys"] != keys:
        raise ValueError(f"stored by {now['keys']}, not by {keys}")
    touched = sorted(r.b for r in batch.select(bucket(keys, now["buckets"]).alias("b")).distinct().collect())  # at most the number of buckets
    old = [now["paths"][str(b)] for b in touched if str(b) in now["paths"]]
    held = spark.read.schema(now["schema"]).parquet(*[f"{root}/{p}" for p in old]) if old else spark.createDataFrame([], now["schema"])
    merged = insert_missing(held, batch.select(*held.columns), keys) if missing_only else upsert(held, batch.select(*held.columns), keys)
    folder = f"data/{uuid.uuid4().hex}"
    merged.withColumn("_bucket", bucket(keys, now["buckets"])).write.partitionBy("_bucket").parquet(f"{root}/{folder}")
    now["paths"] |= {str(b): f"{folder}/_bucket={b}" for b in touched}
    point(spark, root, number + 1, now)
    return number + 1


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(revision_id, sha256) of the files under ``path``, each in a folder 'revision_id=...'; contents are hashed where they are read."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return read.select(F.url_decode(F.regexp_extract("path", "revision_id=([^/]+)/", 1)).alias("revision_id"), F.sha2("content", 256).alias("sha256"))


def write_revisions(rows: DataFrame, path: str) -> None:
    """Stores revisions (revision_id, content binary) byte for byte under ``path``, many to a file: with a file for each, a store of any size is all listing, opening and renaming."""
    rows.select("revision_id", "content").write.parquet(path)


def stored_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(revision_id, sha256) of what ``write_revisions`` stored; contents are hashed where they are read."""
    return spark.read.schema("revision_id string, content binary").parquet(path).select("revision_id", F.sha2("content", 256).alias("sha256"))


def resolved_revisions(base: DataFrame, deltas: DataFrame, files: DataFrame) -> DataFrame:
    """(revision_id, entry_id, state) of every revision that a manifest, its deltas or the files name.

    ``base``: entry_id, revision_id, sha256; ``deltas``: entry_id, generation, revision_id (null: removed), sha256; the highest
    generation of an entry holds. States: 'active' (the entry's, and its file has the hash), 'missing' and 'altered' (the
    entry's, but no file or another hash), 'superseded' (named, but not the entry's), 'unlisted' (a file that nothing names; entry_id is null).
    """
    named = base.withColumn("generation", F.lit(-1).cast("long")).unionByName(deltas.withColumn("generation", F.col("generation").cast("long")))
    last = named.groupBy("entry_id").agg(F.max_by("revision_id", "generation").alias("now"))
    listed = named.where("revision_id IS NOT NULL").groupBy("entry_id", "revision_id").agg(F.max_by("sha256", "generation").alias("wanted"))
    listed = listed.join(last, "entry_id").withColumn("current", F.coalesce(F.col("revision_id") == F.col("now"), F.lit(False)))
    found = files.withColumnRenamed("sha256", "found").withColumn("there", F.lit(True))
    state = (
        F.when(F.col("entry_id").isNull(), "unlisted")
        .when(~F.col("current"), "superseded")
        .when(F.col("there").isNull(), "missing")
        .when(F.col("found") == F.col("wanted"), "active")
        .otherwise("altered")
    )
    return listed.join(found, "revision_id", "full_outer").select("revision_id", "entry_id", state.alias("state"))

"""What several operators need: shared tables, text helpers, connected components."""

from __future__ import annotations

import gc
import os
import sys
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one of our own only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))  # one machine: every task sees it
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of ``materialise``, or of ``components``, that no later plan reads."""
    path = getattr(df, "_lectern_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Has the JVM drop what nothing refers to, so that Spark deletes the shuffle files of jobs that are done.

    Between the phases of a long job: on its own the driver may not collect for half an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Jobs that run inside hand Python at most ``rows`` rows at once, or fewer if the session says so: what a batch of wide rows takes in both."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(was)) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Jobs that run inside have these settings of the session."""
    was = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in was.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def join_labels(rows: DataFrame, labels: DataFrame, keys: list[str], total: int, share: int = 1000) -> DataFrame:
    """``rows`` joined with ``labels`` (unique ``keys``, n: the rows of each key, of ``total``) where a key may hold a large part of all rows.

    Keys of more than total / ``share`` rows, of which there are fewer than ``share``, are broadcast; the others meet in a shuffle.
    """
    hot = F.col("n") > F.lit(max(1.0, total / share))
    few = F.broadcast(labels.where(hot).drop("n"))
    many = labels.where(~hot).drop("n")
    return rows.join(few, keys).unionByName(rows.join(few, keys, "left_anti").join(many, keys))


def tokenizer_file(name: str) -> str:
    """Where a tokenizer's file is on this machine: ``name`` itself if it is a path, else the installed file of that name."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


#: Most bits of a ``sieved`` bitmap: 16 MB, whatever the number of keys.
SIEVE_BITS = 1 << 27
BUCKET = 32_768  # bits of one bitmap aggregate


def sieved(rows: DataFrame, keys: DataFrame, key: str, count: int, column: str) -> DataFrame:
    """``rows`` with ``column``: false where ``key`` is surely none of ``keys`` (of ``count`` rows), so that only the others need to meet them in a shuffle.

    A bitmap of hashed keys, 16 bits a key up to SIEVE_BITS, in buckets that are broadcast: its size is bounded. With more keys it
    lets more through and changes no result.
    """
    bits = min(SIEVE_BITS, max(BUCKET, 1 << (16 * count).bit_length()))
    at, bucket, held = f"{column}_at", f"{column}_bucket", f"{column}_map"
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    maps = keys.select(place.alias(at)).groupBy(F.expr(f"`{at}` div {BUCKET}").alias(bucket)).agg(F.bitmap_construct_agg(F.col(at) % BUCKET).alias(held))
    met = rows.withColumn(at, place).withColumn(bucket, F.expr(f"`{at}` div {BUCKET}")).join(F.broadcast(maps), bucket, "left")
    byte = F.expr(f"cast(conv(hex(substring(`{held}`, cast(`{at}` % {BUCKET} div 8 as int) + 1, 1)), 16, 10) as bigint)")
    hit = F.getbit(byte, (F.col(at) % 8).cast("int")) == 1
    return met.withColumn(column, F.coalesce(hit, F.lit(False))).select(*rows.columns, column)


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, whichever way the code got there."""
    return sys.__dict__.setdefault("_lectern_worker_cache", {})


class Memo:
    """Values of keys that came up before, in two generations of ``size``; a key is kept from its second time on.

    Words that occur once, most of a large vocabulary, so don't push out those
    that return. Readers use ``young.get`` first, then ``get``; forgetting only costs time.
    """

    SLOTS = 1 << 23

    def __init__(self, size: int):
        self.size = size
        self.young: dict = {}
        self.old: dict = {}
        self.seen, self.marks = bytearray(self.SLOTS), 0

    def get(self, key):
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.young[key] = got
        return got

    def put(self, key, value) -> None:
        slot = hash(key) & (self.SLOTS - 1)
        if self.seen[slot]:
            self.young[key] = value
            return
        self.seen[slot] = 1
        self.marks += 1
        if self.marks > self.SLOTS // 4:
            self.seen, self.marks = bytearray(self.SLOTS), 0

    def trim(self) -> None:
        """Starts a new generation when the young one is full; between texts, so that a text's own lookups hold."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}


def crc32_of_id(col: str = "doc_id"):
    """crc32 of an id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def pick_unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    """``schema`` with further fields."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def partitions_for(spark: SparkSession, rows: int, per_task: int = 50_000) -> int:
    """Shuffle partitions for ``rows`` rows: the session's number, more if tasks would grow past ``per_task`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def local_stars(edges: DataFrame, count: int, per_task: int = 50_000) -> DataFrame:
    """Edges (u, v) that connect what ``edges`` (integers u > v, ``count`` rows) connect: each task takes about ``per_task`` of them, dealt
    at random, and joins each node to the smallest one it reaches by these. A group with many times more edges than nodes shrinks to about its nodes."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        ends = np.concatenate([np.concatenate([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in held])
        sizes = [b.num_rows for b in held]
        nodes, at = np.unique(ends, return_inverse=True)  # sorted, so the smallest position is the smallest node
        root = list(range(len(nodes)))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        lo = 0
        for n in sizes:
            for a, b in zip(at[lo : lo + n].tolist(), at[lo + n : lo + 2 * n].tolist()):
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
            lo += 2 * n
        tops = np.array([find(k) for k in range(len(nodes))])
        far = tops != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[tops[far]])], names=["u", "v"])

    return edges.repartition(max(1, -(-count // per_task))).mapInArrow(run, edges.schema).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, root) per node that has an edge to another.

    root is the smallest node reachable. Alternating large-star and small-star
    rounds (Kiveris et al. 2014): each is an aggregation with map-side combine
    and an inner equi-join, so a hub's rows can be split by the skew-join rule.
    Before the rounds tasks reduce what they read (``local_stars``). Each
    round's edges are a table in the shared folder. Null ends and loops
    are ignored; an empty input gives an empty result. Raises if it has not
    converged after ``max_rounds`` rounds (never returns partial components).
    """
    held = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )

    def mark(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last = mark(held)
    if last[0]:
        stars = materialise(local_stars(held, last[0]))
        discard(held)
        held, last = stars, mark(stars)
    for _ in range(max_rounds):
        if not last[0]:
            break
        both = held.select("u", "v").unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        new = materialise(small)
        now = mark(new)
        discard(held)
        held = new
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components: not converged after {max_rounds} rounds")
    out = held.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        held.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
    out._lectern_path = held._lectern_path
    return out

"""Where intermediate tables go, and how files come in and go out."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.windows import places


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; one of our own only where that is unset, on one machine. Raises on a cluster without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():  # named for this session alone
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{checkpoint_dir(spark)}/lectern-{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt over the session's shuffle partitions, for work that takes long by row: splits are made by bytes, so a small file's many rows would stay in a task or two."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def json_line(df: DataFrame) -> Column:
    """A row as JSON, its keys in order."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))


def write_jsonl(df: DataFrame, path: str, max_bytes: int | None = None) -> None:
    """JSON lines under ``path``. Raises, and leaves nothing there, if their UTF-8 bytes exceed ``max_bytes``. The plan runs once: lines are written beside it, measured, and renamed."""
    spark, staged = df.sparkSession, f"{path}.partial-{uuid.uuid4().hex}"
    df.select(json_line(df).alias("value")).write.text(staged)
    files, at = _files(spark, staged)
    if max_bytes is not None:
        size = spark.read.text(staged).agg(F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0))).first()[0]
        if size > max_bytes:
            files.delete(at, True)
            raise ValueError(f"{size} bytes of JSON lines; {max_bytes} are allowed")
    if not files.rename(at, _files(spark, path)[1]):
        files.delete(at, True)
        raise FileExistsError(path)


def export(df: DataFrame, path: str, key: str) -> DataFrame:
    """Canonical JSON lines in byte order of ``key`` (unique) under ``path``/entries, and the manifest: name, rows, checksum.

    The checksum is the sum of the hashes of (a row's SHA-256, its place): it depends on every row and on their order, not on how
    they lie in files.
    """
    lines = df.select(F.col(key).cast("string").alias("_k"), json_line(df).alias("value"))
    lines.orderBy("_k").select("value").write.text(f"{path}/entries")
    placed = places(lines.select("_k", F.sha2("value", 256).alias("h")), "_k", "place")
    return placed.agg(F.lit("entries").alias("name"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64("h", "place").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum"))


def read_verified(spark: SparkSession, path: str, hashes: DataFrame, id_col: str) -> DataFrame:
    """JSON rows under ``path`` whose SHA-256 equals that of ``hashes`` (id, sha256), with ``ok``; a row without a hash is not ok."""
    rows = spark.read.text(path).select(F.get_json_object("value", f"$.{id_col}").alias(id_col), F.sha2("value", 256).alias("_found"), "value")
    return rows.join(hashes, id_col, "left").select(id_col, "value", F.coalesce(F.col("_found") == F.col("sha256"), F.lit(False)).alias("ok"))

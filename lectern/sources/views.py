"""The corpus model over the given tables: projections, so that filters and pruning reach the scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their source's access, edition, category and generation."""
    d = table(spark, sf_dir, "documents")
    n = F.substring("source", 4, 10).cast("int")
    d = d.select("doc_id", "text", F.col("lang").alias("language"), F.concat_ws(":", "source", "lang").alias("source_id"), n.alias("n"))
    k = F.col("n") % 4
    return d.select(
        "*",
        F.when(k == 2, "premium").when(k == 3, "personal").otherwise("open").alias("access_tier"),
        (k == 2).alias("is_shared"),
        F.when(k == 3, F.concat(F.lit("u"), F.col("n"))).alias("owner_id"),
        F.when(F.floor(F.col("n") / 4) % 2 == 0, "5.5e").otherwise("5e").alias("edition"),
        F.when(F.col("n") % 3 == 0, "core_rules").when(F.col("n") % 3 == 1, "official_supplement").otherwise("homebrew").alias("category"),
        (10 * F.col("n")).alias("priority"),
        F.when(F.col("doc_id") % 10 == 9, "archived").otherwise("active").alias("generation"),
        (F.col("n") == 19).alias("is_deleted"),
    )


SOURCE_COLUMNS = ["source_id", "n", "language", "access_tier", "is_shared", "owner_id", "edition", "category", "priority", "is_deleted"]


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(*SOURCE_COLUMNS).distinct()


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("entry_id"),
        F.concat(F.lit("part-"), k).alias("canonical_key"),
        F.col("p_name").alias("title"),
        F.when(k % 4 == 0, "spell").when(k % 4 == 1, "feat").when(k % 4 == 2, "item").otherwise("glossary").alias("entry_type"),
        F.when(k % 5 == 4, "5e").otherwise("5.5e").alias("edition"),
        (F.col("p_size") % 10).alias("level"),
        F.lower("p_type").alias("school"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("cost"),
        (F.col("p_size") % 2 == 0).alias("ritual"),
        F.concat(F.lit("A"), k).alias("alias"),
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("entry_id"), F.col("l_suppkey").alias("source_no"))
        .agg(F.max("l_shipdate").alias("published_at"), F.count(F.lit(1)).alias("n_lines"))
    )


def of_sources(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """``rows`` (entry_id, source_no, published_at) as versions, with their supplier's priority, language and tier."""
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("source_no"),
        F.floor(F.col("s_acctbal") / 10).cast("int").alias("priority"),
        F.when(F.col("s_nationkey") % 2 == 0, "en").otherwise("ru").alias("language"),
        F.when(F.col("s_suppkey") % 4 == 2, "premium").when(F.col("s_suppkey") % 4 == 3, "personal").otherwise("open").alias("access_tier"),
        F.col("s_nationkey").alias("nation"),
    )
    return rows.join(s, "source_no").select(
        "entry_id", "source_no", F.concat_ws(":", "entry_id", "source_no").alias("version_id"), "published_at", "priority", "language", "access_tier", "nation"
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version per (entry, source): offers as versions."""
    return of_sources(spark, sf_dir, offers(spark, sf_dir))


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each line of an offer, as a version published then: a version's own published_at is the latest of its rows."""
    return of_sources(spark, sf_dir, table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entry_id"), F.col("l_suppkey").alias("source_no"), F.col("l_shipdate").alias("published_at")))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line of a document."""
    d = docs(spark, sf_dir)
    return d.select("*", F.posexplode(F.split("text", "\n")).alias("idx", "passage")).select(
        "doc_id", "idx", "passage", "source_id", "access_tier", "language", "edition", "category", "generation"
    )

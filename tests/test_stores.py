import os

import pytest
from pyspark.sql import functions as F

from lectern.sources import stores


def test_jsonl_is_bounded_and_whole(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "b long, a string")
    stores.write_jsonl(df, str(tmp_path / "out"), 100)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"a":"é","b":1}', '{"b":2}']
    with pytest.raises(ValueError):
        stores.write_jsonl(df, str(tmp_path / "small"), 10)
    assert sorted(os.listdir(tmp_path)) == ["out"]
    stores.write_jsonl(df.limit(0), str(tmp_path / "none"), 0)
    assert spark.read.text(str(tmp_path / "none")).count() == 0


def test_export_checksum(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "c"))
    df = spark.range(50).select("id", F.md5(F.col("id").cast("string")).alias("h"))

    def manifest(d, name):
        return tuple(stores.export(d, str(tmp_path / name), "id").first())

    first = manifest(df, "a")
    assert first[:2] == ("entries", 50) and manifest(df.repartition(7, "h"), "b") == first
    swapped = df.withColumn("h", F.when(F.col("id") == 3, F.md5(F.lit("4"))).when(F.col("id") == 4, F.md5(F.lit("3"))).otherwise(F.col("h")))
    assert manifest(swapped, "c") != first
    rows = [r.value for r in spark.read.text(str(tmp_path / "a/entries")).collect()]
    assert len(rows) == 50 and manifest(df.limit(0), "d")[1:] == (0, "0")

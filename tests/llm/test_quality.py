import zlib

from lectern.llm import quality
from lectern.llm.queries import op7_quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = op7_quality(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) >= 0.9 * len(held)
    good = [p for p, y in held if y == 1]
    assert sum(good) >= 0.95 * len(good)


def test_held_out_labels_do_not_matter(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.quality_scores(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_odd(spark, clashing, empty):
    some = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (6, 1), (None, 1), (7, None)], "doc_id long, quality int")
    none = some.limit(0)
    for labels in (some, none, some.where("quality = 1")):
        got = quality.quality_scores(clashing, labels).collect()
        assert len(got) == clashing.count() and all(0 <= r.score <= 1 for r in got)
        assert quality.quality_scores(empty, labels).count() == 0
    kept = quality.keep_good(clashing, some)
    assert kept.columns == clashing.columns

"""Stored tables: replacement by bucket, interrupted and competing writes; links of snapshots."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import snapshots as S
from lectern.sources import versions as V
from lectern.sources.stores import new_path

ROW = "k long, v string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_replace(spark):
    root = new_path(spark, "stored-test")
    assert V.stored(spark, root) is None and V.pointer(spark, root) == (0, {})
    assert V.replace_rows(root, spark.createDataFrame([(k, "a") for k in range(100)], ROW), ["k"], buckets=8) == 1
    before = V.pointer(spark, root)[1]["paths"]
    V.replace_rows(root, spark.createDataFrame([(3, "b"), (200, "b")], ROW), ["k"])
    after = V.pointer(spark, root)[1]["paths"]
    assert rows(V.stored(spark, root)) == sorted([*((k, "a") for k in range(100) if k != 3), (3, "b"), (200, "b")])
    assert 1 <= sum(before.get(b) != p for b, p in after.items()) <= 2  # the other buckets are the same directories
    V.replace_rows(root, spark.createDataFrame([(3, "c"), (300, "c")], ROW), ["k"], missing_only=True)
    got = dict(rows(V.stored(spark, root)))
    assert got[3] == "b" and got[300] == "c" and len(got) == 102
    with pytest.raises(ValueError):
        V.replace_rows(root, spark.createDataFrame([(3, "c")], ROW), ["v"])


def test_interrupted_and_competing(spark, monkeypatch):
    root = new_path(spark, "stored-test")
    V.replace_rows(root, spark.createDataFrame([(1, "a"), (2, "a")], ROW), ["k"])

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(V, "point", fail)
        with pytest.raises(RuntimeError):
            V.replace_rows(root, spark.createDataFrame([(1, "b")], ROW), ["k"])
    assert rows(V.stored(spark, root)) == [(1, "a"), (2, "a")]
    number, now = V.pointer(spark, root)
    with pytest.raises(FileExistsError):
        V.point(spark, root, number, now)
    V.replace_rows(root, spark.createDataFrame([], ROW), ["k"])
    assert rows(V.stored(spark, root)) == [(1, "a"), (2, "a")]


def test_resolved(spark):
    base = spark.createDataFrame([("e1", "r1", "h1"), ("e2", "r2", "h2")], "entry_id string, revision_id string, sha256 string")
    deltas = spark.createDataFrame([("e1", 1, "r3", "h3"), ("e1", 2, "r1", "h1"), ("e2", 1, None, None), ("e3", 1, "r4", "h4")], "entry_id string, generation int, revision_id string, sha256 string")
    files = spark.createDataFrame([("r1", "h1"), ("r2", "h2"), ("r4", "hx"), ("r9", "h")], "revision_id string, sha256 string")
    got = {r.revision_id: r.state for r in V.resolved_revisions(base, deltas, files).collect()}
    assert got["r1"] == "active" and got["r3"] == "superseded" and got["r4"] == "altered" and got["r9"] == "unlisted"
    assert got["r2"] == "superseded"  # its entry was removed


def test_stored_revisions(spark, tmp_path):
    """Stored together, revisions have the hashes of files of their own, and their number doesn't make the number of files."""
    rows_ = spark.range(300).select(F.concat(F.lit("r /"), "id").alias("revision_id"), F.concat(F.lit("тело "), "id").alias("value")).coalesce(4)
    V.write_revisions(rows_.select("revision_id", F.encode(F.concat("value", F.lit("\n")), "UTF-8").alias("content")), f"{tmp_path}/store")
    assert len(list((tmp_path / "store").glob("part-*"))) <= 4
    rows_.limit(5).write.partitionBy("revision_id").text(f"{tmp_path}/single")
    stored = {r.revision_id: r.sha256 for r in V.stored_hashes(spark, f"{tmp_path}/store").collect()}
    single = {r.revision_id: r.sha256 for r in V.file_hashes(spark, f"{tmp_path}/single").collect()}
    assert len(stored) == 300 and len(single) == 5 and single.items() <= stored.items()


def test_snapshot_links(spark):
    meta = json.dumps({"hitDie": 8, "primaryAbility": "Str", "parentClassIds": "Fighter Base", "features": [{"canonicalId": "feature-a", "title": "A", "body": "B", "level": 1, "anchor": "a"}], "crossLinks": ["species-1", "loose"]})
    rows_ = [
        ("7", "class", "T", "b", meta, "s", "5e", "en"), ("fighter base", "class", "F", "b", '{"hit_die":"d10","primary_ability":"Str"}', "s", "5e", "en"), ("1", "species", "S", "b", '{"speed":30}', "s", "5e", "ru"),
        ("9", "species", "V", "", '{"speed":30,"kind":"variant"}', "s", "5e", "en"), ("9", "species", "W", "b", '{"speed":"x"}', "s", "5e", "en"), ("3", "maps", "M", "b", None, "s", "5e", "en"), (None, "spells", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows_, "external_id string, category string, title string, body string, metadata string, source_id string, edition string, language string")
    held = S.typed(df)
    got = {r.title: ([f"{i.path} {i.rule}" for i in r.issues], r.entry_id) for r in held.collect()}
    assert got["T"] == ([], "class-7") and got["F"] == ([], "class-fighter-base") and got["V"][0] == ["$.body text"] and got["W"][0] == ["$.attributes.speed number"] and got["M"] == (["$.category choice"], None)
    assert "$.title text" in got[None][0] and "$.attributes.level number" in got[None][0]
    state = {(r.entry_id, r.relation, r.target): r.state for r in S.links(held).collect()}
    assert state == {("class-7", "parent", "class-fighter-base"): "resolved", ("class-7", "feature", "feature-a"): "resolved", ("class-7", "cross_link", "species-1"): "unresolved", ("class-7", "cross_link", "loose"): "unresolved"}
    assert [(r.entry_id, r.class_id, r.level) for r in S.features(held).collect()] == [("feature-a", "class-7", 1)]

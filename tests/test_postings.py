import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lectern.operators import postings as P
from lectern.operators import retrieval as R
from lectern.sources.stores import new_path

ROWS = [
    (1, "Fire burns the red dragon", "a"), (2, "the dragon sleeps; the DRAGON wakes", "b"), (3, "cold water", "a"), (4, "red dragon and red fire fire", "b"),
    (5, "", "a"), (6, None, None), (7, "--- !!", "a"), (8, "dragon red", "a"), (9, "red red dragon", "b"),
]


@pytest.fixture(scope="module")
def stored(spark):
    """More rows of few words, so that all grammar is met; a column named like an output is left alone."""
    rnd = random.Random(4)
    rows = ROWS + [(100 + n, " ".join(rnd.choice("red dragon fire cold water the of und".split()) for _ in range(rnd.randrange(40))), "x") for n in range(300)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string, size string").repartition(3)
    path = new_path(spark, "postings")
    P.write_index(chunks, path)
    return chunks, P.read_index(spark, path)


QUESTIONS = ["red dragon", "dragon -red", '"red dragon" OR water', "dragon OR cold -water", '"red red dragon"', '"fire fire" -the', "red", '"the red" "of the"', "nothing", "  ", '""', "DRAGON OR dragon", '"dragon dragon dragon" OR "of und the"']


@pytest.mark.parametrize("question", QUESTIONS)
def test_as_the_scan(stored, question):
    chunks, index = stored
    assert P.index_search(index, question, 200).collect() == R.keyword_search(chunks, question, 200).collect()
    assert P.index_search(index, question, 3).collect() == R.keyword_search(chunks, question, 3).collect()


def test_postings(spark):
    got = {(r.chunk_id, r.term): (r.places, r.size) for r in P.postings(spark.createDataFrame(ROWS, "chunk_id long, text string, size string")).collect()}
    want = {}
    for k, text, _ in ROWS:
        words = [w for w in (text or "").lower().replace(";", " ").split() if w.isalpha()]
        for w in words:
            want[k, w] = ([i for i, x in enumerate(words) if x == w], len(words))
    assert got == want


def test_written_in_segments(spark, tmp_path):
    """Each file holds all postings of its chunks, in order; only texts are dealt out, and they are read and cut into tokens once."""
    rows = [(n, " ".join(f"w{(n * k) % 97}" for k in range(60))) for n in range(400)] + [(500, None), (501, ""), (502, "?!")]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    path = str(tmp_path / "index")
    P.write_index(spark.createDataFrame(rows, "chunk_id long, text string").mapInArrow(counted, "chunk_id long, text string"), path)
    assert read.value == len(rows)
    files: dict = {}
    for f in (tmp_path / "index").glob("*.parquet"):
        t = pq.read_table(f).to_pylist()
        keys = [(r["term"].encode(), r["chunk_id"]) for r in t]
        assert keys == sorted(keys)
        for r in t:
            files.setdefault(r["chunk_id"], set()).add(f.name)
    assert set(files) == set(range(400)) and all(len(f) == 1 for f in files.values())
    assert len(set.union(*files.values())) > 1


def test_groups_of_texts(monkeypatch):
    """The same postings wherever batches are cut; a text is never cut."""
    batch = pa.RecordBatch.from_pydict({"chunk_id": pa.array([3, 1, 2, 4, 5], pa.int64()), "w": pa.array([["b", "a", "b"], ["c"] * 7, None, [], ["a", "é", "z"]], pa.list_(pa.string()))})
    want = {(3, "b", (0, 2), 3), (3, "a", (1,), 3), (1, "c", tuple(range(7)), 7), (5, "a", (0,), 3), (5, "é", (1,), 3), (5, "z", (2,), 3)}
    for n in (1, 2, 5, 1000):
        monkeypatch.setattr(P, "GROUPED", n)
        got = [(r["chunk_id"], r["term"], tuple(r["places"]), r["size"]) for b in P.grouped(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
        assert len(got) == len(want) and set(got) == want


def test_readable_and_limits(stored, spark):
    _, index = stored
    seen = spark.createDataFrame([(4,), (9,), (None,)], "chunk_id long")
    assert sorted(r.chunk_id for r in P.index_search(index, "red", readable=seen).collect()) == [4, 9]
    assert P.index_search(index, "red", readable=seen.limit(0)).count() == 0
    assert P.index_search(index.limit(0), "red").count() == 0


def test_filter_reaches_the_files(stored):
    _, index = stored
    plan = P.index_search(index, "red -dragon")._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [dragon,red])" in plan and plan.count("FileScan") == 1


def test_long_text(spark):
    """A text of 200,000 tokens of which one makes up half: grouping is by one sort."""
    text = " ".join(w for n in range(100_000) for w in ("the", f"w{n % 5_000}"))
    one = P.postings(spark.createDataFrame([(1, text)], "chunk_id long, text string")).where("term = 'the'").collect()
    assert len(one) == 1 and one[0].places == list(range(0, 200_000, 2)) and one[0].size == 200_000

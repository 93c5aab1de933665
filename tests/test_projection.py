"""Index projection: the sweep against a plain version, refusals, numbering through files."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import projection as P
from lectern.operators.windows import running_before

SECTIONS = "sections array<struct<section_id:string,heading:string,start:bigint,end:bigint>>"
CITATIONS = "citations array<struct<citation_id:string,file_id:string,page:bigint,section:string,start:bigint,end:bigint>>"
REVISION = f"entry_id string, revision_id string, source_id string, text string, {SECTIONS}, {CITATIONS}"


def plain(sections, citations):
    """Pieces by looking at every citation for every piece."""
    out = []
    for k, (*_, s, e) in enumerate(sections):
        spans = [(a, b) for *_, a, b in citations if a is not None and b is not None and a < e and b > s]
        cuts = sorted({s, e, *(max(s, a) for a, _ in spans), *(min(e, b) for _, b in spans)})
        for a, b in zip(cuts, cuts[1:]):
            out.append((a, b, k, [j for j, (*_, x, y) in enumerate(citations) if x is None or y is None or (x <= a and y >= b)]))
    return out


def cite(j, a, b, page=1, file="f"):
    return (f"c{j}", file, page, f"p{page}", a, b)


def made(seed):
    rng = random.Random(seed)
    ends = sorted(rng.sample(range(1, 400), rng.randrange(1, 5)))
    sections = [(f"s{k}", f"h{k}", a, b) for k, (a, b) in enumerate(zip([0, *ends], ends))]
    spans = [sorted(rng.choices(range(0, 400), k=2)) for _ in range(rng.randrange(12))]
    return sections, [cite(j, *(s if rng.random() < 0.9 else (None, None))) for j, s in enumerate(spans)]


def test_sweep(spark):
    cases = [made(k) for k in range(150)] + [([("s", "h", 0, 10)], [cite(0, 3, 3), cite(1, 0, 10), cite(2, 5, 30), cite(3, 10, 12)]), ([("s", "h", 4, 4)], []), ([], [cite(0, 1, 2)])]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], f"k int, {SECTIONS}, {CITATIONS}")
    for r in df.select("k", P.swept("sections", "citations").alias("p")).collect():
        assert [(p.start, p.end, p.section, p.active) for p in r.p] == plain(*cases[r.k]), cases[r.k]
        assert not any(p.crowded for p in r.p)


def test_problems_and_numbers(spark):
    one = [("s0", "First", 0, 6), ("s1", "Second", 6, 11)]
    rows = [
        ("e1", "r1", "src", "hello world", one, [cite(0, 0, 5), cite(1, 0, 5)]),
        ("e0", "r0", "src", "other words", one, [cite(0, None, None)]),
        ("e2", "r2", "src", "hello world", one, []),
        ("e3", "r3", "src", "hello world", one, [cite(0, 0, 3), cite(1, 4, 6, file="g")]),
        ("e4", "r4", "src", "hello world", one, [cite(0, 0, 3, file="lost")]),
        ("e5", "r5", "src", "hello world", [*one, ("s2", "Third", 5, 9)], [cite(0, 0, 3)]),
        ("e6", "r6", "src", "hello world", one, [cite(0, 0, 3), cite(1, 2, 6, page=2)]),
        ("e7", "r7", "src", "hello world", one, [cite(0, 0, 3), cite(1, 3, 6, page=2)]),  # they touch, that is no overlap
        ("e8", "r8", "src", None, None, None),
    ]
    files = spark.createDataFrame([("src", "f", 10), ("src", "g", 10)], "source_id string, file_id string, byte_size long")
    checked = P.examined(spark.createDataFrame(rows, REVISION), files).cache()
    assert {r.revision_id: r.problem for r in checked.collect()} == {"r0": None, "r1": None, "r2": "no citation", "r3": "several files", "r4": "file not captured", "r5": "overlapping sections", "r6": "ambiguous provenance", "r7": None, "r8": "no citation"}
    chunks = sorted(P.index_chunks(checked, "repo").collect(), key=lambda r: r.chunk_index)
    assert [(r.chunk_index, r.revision_id, r.section_id, r.chunk, r.page, r.heading, r.citations) for r in chunks[:5]] == [
        (0, "r0", "s0", "other ", 1, "p1", ["c0"]),
        (1, "r0", "s1", "words", 1, "p1", ["c0"]),
        (2, "r1", "s0", "hello", 1, "p1", ["c0", "c1"]),
        (3, "r1", "s1", "world", None, "Second", []),  # the blank between them is no chunk
        (4, "r7", "s0", "hel", 1, "p1", ["c0"]),
    ]
    assert len({r.id for r in chunks}) == len(chunks) and all(rows[[x[1] for x in rows].index(r.revision_id)][3][r.span_start : r.span_end] == r.chunk for r in chunks)
    entries = {r.revision_id: r for r in P.index_entries(checked, "repo").collect()}
    assert set(entries) == {"r0", "r1", "r7"} and len({r.generation_id for r in entries.values()}) == 1
    again = P.index_entries(P.examined(spark.createDataFrame(rows[:1] + rows[7:8], REVISION), files), "repo").first()
    assert again.generation_id != entries["r1"].generation_id and again.id == entries["r1"].id
    pages = {(r.revision_id, r.page): (r.text, r.citations) for r in P.index_pages(checked).collect()}
    assert pages == {("r1", 1): ("hello", ["c0", "c1"]), ("r7", 1): ("hel", ["c0"]), ("r7", 2): ("lo ", ["c1"])}


@pytest.mark.parametrize("parts", [1, 7])
def test_running_before(spark, parts):
    rng = random.Random(4)
    rows = [(rng.choice("aaab"), k, rng.randrange(9)) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, n long").repartition(parts)
    spark.sparkContext.setCheckpointDir("/tmp/lectern-tests") if not spark.sparkContext.getCheckpointDir() else None
    for r in running_before(df, ["g"], ["k"], "n", "before").collect():
        assert r.before == sum(n for g, k, n in rows if g == r.g and k < r.k)
    assert running_before(df.where(F.lit(False)), ["g"], ["k"], "n", "before").count() == 0

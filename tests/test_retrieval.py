import pytest

from lectern.operators import retrieval as R


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (1, "Fire burns the red dragon", "Red Dragon", "core_rules"), (2, "the dragon sleeps", "Sleep", "homebrew"), (3, "cold water", "Water", "other"),
        (4, "red dragon and red fire fire", None, "official_supplement"), (5, "", "Empty", "core_rules"), (6, None, None, None),
    ]
    return spark.createDataFrame(rows, "chunk_id long, text string, heading string, category string").repartition(2)


def ids(df):
    return [r.chunk_id for r in df.orderBy("rank").collect()]


def test_grammar(chunks):
    assert sorted(ids(R.keyword_search(chunks, "red dragon"))) == [1, 4]
    assert sorted(ids(R.keyword_search(chunks, "dragon -red"))) == [2]
    assert sorted(ids(R.keyword_search(chunks, '"red dragon" OR water'))) == [1, 3, 4]
    assert sorted(ids(R.keyword_search(chunks, "dragon OR cold -water"))) == [1, 2, 4]
    assert ids(R.keyword_search(chunks, "  ")) == [] and ids(R.keyword_search(chunks, '""')) == []
    assert [r.chunk_id for r in R.plain_search(chunks, "RED fire").collect()] and R.plain_search(chunks, "").count() == 0


def test_rank_and_ties(chunks):
    assert ids(R.keyword_search(chunks, "fire"))[0] == 4
    assert ids(R.keyword_search(chunks, "dragon", limit=1000))[-1] in (1, 4)


def test_fusion_and_reranking(spark, chunks):
    def listed(*k):
        return R.ranked(spark.createDataFrame([(i, 1.0 / (n + 1)) for n, i in enumerate(k)], "chunk_id long, score double"))

    fused = {r.chunk_id: r for r in R.fuse([("entity", listed(3)), ("keyword", listed(1, 3)), ("vector", listed(2, 1))]).collect()}
    assert fused[3].strategy == "entity" and fused[1].strategy == "keyword"
    assert fused[1].score == pytest.approx(1 / 61 + 1 / 62) and fused[3].score == pytest.approx(1 / 61 + 1 / 62)
    df = spark.createDataFrame([(1, 0.5, "entity", "core_rules", "Red Dragon"), (2, 0.5, "keyword", "homebrew", None), (3, 0.5, "keyword", "x", "red")], "chunk_id long, score double, strategy string, category string, heading string")
    got = {r.chunk_id: r.score for r in R.rerank(df, "a red dragon").collect()}
    assert got == pytest.approx({1: 0.65, 2: 0.35, 3: 0.45})


def test_vectors(spark, chunks):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "chunk_id long, embedding array<float>")
    got = {r.chunk_id: r.score for r in R.vector_search(chunks, v, [[2.0, 0.0], [0.0, 1.0]], 2).collect()}
    assert got == pytest.approx({1: 1.0, 2: 1.0, 3: 0.707107})
    assert R.vector_search(chunks, v, []).count() == 0


def test_entities(spark, chunks):
    names = spark.createDataFrame([("Red-Dragon",), ("dragon sleeps",), ("",)], "name string")
    got = {r.chunk_id: r.score for r in R.entity_search(chunks, names, "Tell me of the red dragon!").collect()}
    assert got == {1: 1.0, 4: 0.9}
    assert R.entity_search(chunks, names, "nothing").count() == 0


def test_expansion():
    got = R.expand_query("AC of ACE", [("ac", ["armor class", "AC of ace"]), ("e", ["no"])])
    assert got == [("AC of ACE", 1.0), ("armor class", 0.8)] and R.combined(got) == "AC of ACE OR armor class"


def test_expanded(spark):
    from lectern.operators import retrieval as R

    q = spark.createDataFrame([(1, "cast Fireball at AC"), (2, "an AC-DC cable"), (3, None), (4, "")], "query_id int, text string")
    rows = [("ac", "armor class", 0.8), ("ac", "Cast fireball at ac", 0.8), ("cast fireball", "огненный шар", 0.7), ("Fireball", "Armor Class", 0.7), ("fire", "flame", 0.8), (None, "x", 0.8), ("--", "y", 0.8), ("ac", None, 0.8)]
    got = R.expanded(q, spark.createDataFrame(rows, "term string, other string, weight double"))
    assert sorted((r.query_id, r.place, r.text, r.weight) for r in got.collect()) == [
        (1, 0, "cast Fireball at AC", 1.0), (1, 1, "Armor Class", 0.8), (1, 2, "огненный шар", 0.7), (2, 0, "an AC-DC cable", 1.0), (2, 1, "Cast fireball at ac", 0.8), (2, 2, "armor class", 0.8), (4, 0, "", 1.0),
    ]

import math
import random
import re
from collections import Counter

import pytest

from lectern.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k=10):
    """All scores of all documents (id, text), plainly."""
    held = [(i, Counter(w.translate(LOWER) for w in TERM.findall(t or ""))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    many, total = len(held), sum(n for *_, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    weight = {w: math.floor(1000 * math.log((2 * many + 2) / (2 * d + 1))) for w, d in df.items()}
    out = []
    for item, text in items:
        wanted = {w.translate(LOWER) for w in TERM.findall(text or "")}
        scores = []
        for i, c, n in held:
            m = 10 + 90 * n * many // total
            s = sum(weight[w] * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in wanted & c.keys())
            if s > 0:
                scores.append((-s, i is not None, i or 0))
        out += [(item, n, i if some else None, -s) for n, (s, some, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(docs, items, k=10):
    return sorted((tuple(r) for r in search.ranked_search(docs, items, k).collect()), key=str)


@pytest.fixture(scope="module")
def items(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet")


def test_documents(documents, items):
    assert found(documents, items) == brute([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in items.collect()])


@pytest.mark.parametrize("k", [1, 3, 50])
def test_made_up(spark, k):
    """Copies with equal scores, frequent and rare terms, queries without hits, more results asked than there are."""
    rng = random.Random(k)
    words = [f"w{n}" for n in range(60)]
    docs = [(n, " ".join(rng.choices(words, [1 / (1 + j) for j in range(60)], k=rng.randrange(1, 40)))) for n in range(300)]
    docs += [(1000 + n, docs[7][1]) for n in range(40)] + [(2000, "w3 " * 5000), (2001, None), (2002, "")]
    items = [(n, " ".join(rng.sample(words, rng.randrange(1, 12)))) for n in range(12)] + [(50, "nowhere"), (51, None), (52, ""), (53, docs[7][1])]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    assert found(d, q, k) == brute(docs, items, k)


def test_odd(spark, odd, clashing, empty):
    asked = [(1, "The quick fox"), (1, "same id TWICE"), (None, "null naïve 日本語"), (4, "null naïve 日本語")]
    q = spark.createDataFrame(asked, "item_id long, text string")
    assert found(clashing, q) == brute([(r.doc_id, r.text) for r in odd.collect()], asked)
    assert found(empty, q) == [] and found(odd, q.limit(0)) == []


def test_many_terms_join_instead(documents, items, monkeypatch):
    some = items.limit(5)
    before = found(documents, some)
    monkeypatch.setattr(search, "LISTED", 3)
    assert found(documents, some) == before


def test_threshold_discards(spark, documents, items):
    """The second phase leaves most documents that share a term with an item behind; the last look-up is that of the candidates."""
    kept = []
    real = search.sieved

    def spy(index, docs, key, count, column):
        kept.append(count)
        return real(index, docs, key, count, column)

    search.sieved = spy
    try:
        found(documents, items)
    finally:
        search.sieved = real
    asked = [{w.translate(LOWER) for w in TERM.findall(r.text)} for r in items.collect()]
    texts = [{w.translate(LOWER) for w in TERM.findall(r.text)} for r in documents.collect()]
    assert kept[-1] < 0.5 * sum(bool(a & t) for a in asked for t in texts)

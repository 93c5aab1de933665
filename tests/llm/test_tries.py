import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import terms, tries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=10, best=10):
    """Rows of the audit of (lang, source, text), with whole numbers of any size."""
    docs = [((a or ""), (b or ""), [w.translate(LOWER) for w in TERM.findall(t or "")]) for a, b, t in rows]
    df, count, groups = Counter(), defaultdict(Counter), set()
    for lang, source, found in docs:
        groups.add((lang, source))
        df.update((lang, w) for w in set(found))
        count[lang, source].update(found)
    out = []
    for lang, source in sorted(groups):
        kept = [w for (g, w), n in df.items() if g == lang and n >= least]
        others = sorted(s for g, s in groups if g == lang)
        per = {s: [count[lang, s][w] for w in kept] for s in others}
        per[None] = [sum(per[s][k] for s in others) for k in range(len(kept))]
        p = {s: [1 + 1_000_000_000 * (c + 2) // (sum(cs) + 2 * len(kept)) for c in cs] for s, cs in per.items()}

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        pairs = [(-sum(map(f, p[source], p[s])), s.encode(), s) for s in others if s != source]
        top = [(-f(a, q), w.encode(), w) for a, q, w, c in zip(p[source], p[None], kept, per[source]) if c and a > q]
        for part, held, k in (("pair", pairs, None), ("term", top, best)):
            out += [(lang, source, part, item, -v, n) for n, (v, _, item) in enumerate(sorted(held)[:k], 1)]
    return sorted(out)


def audit(df, **kw):
    got = tries.divergence_audit(df, **kw)
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got.collect())


def rows_of(df):
    return [tuple(r) for r in df.select("lang", "source", "text").collect()]


def test_documents(documents):
    assert audit(documents) == brute(rows_of(documents))


def test_odd(spark, odd, clashing, empty):
    assert audit(odd, least=1) == brute(rows_of(odd), 1)
    assert audit(odd) == brute(rows_of(odd))  # languages without kept terms: pairs of value 0
    assert audit(clashing, least=2) == brute(rows_of(odd), 2)
    assert audit(empty) == []


@pytest.fixture
def small(monkeypatch):
    for name, value in (("LEAVES", 40), ("BLOCK", 7), ("CELLS", 12)):
        monkeypatch.setattr(tries, name, value)
    monkeypatch.setattr(terms, "SLICE_BYTES", 300)


def test_bounds_change_nothing(small):
    """Tries given out early, ranges merged from many batches, blocks and matrices of a few terms: the functions that tasks run, in one process."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abéß") for _ in range(rng.randrange(1, 6))) for _ in range(120)]
    rows = sorted(("xy"[k % 2], f"s{rng.randrange(6)}", " ".join(rng.choices(words, k=rng.randrange(30)))) for k in range(200))
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["lang", "source", "text"])
    partial = pa.Table.from_batches(list(tries.count_terms([batch])))
    rank = sorted(range(partial.num_rows), key=lambda k: (partial["lang"][k].as_py().encode(), partial["term"][k].as_py().encode()))
    partial = partial.take(pa.array(rank))
    blocks = pa.Table.from_batches(list(tries.merge_range(3)(partial.to_batches(max_chunksize=11))))
    got, order = defaultdict(Counter), []
    for b in blocks.to_pylist():
        assert len(b["terms"]) <= 7
        order += [(b["lang"], t.encode()) for t in b["terms"]]
        lo = 0
        for t, hi in zip(b["terms"], b["ends"]):
            got[b["lang"], t].update(dict(zip(b["sources"][lo:hi], b["counts"][lo:hi])))
            lo = hi
    df, want = Counter(), defaultdict(Counter)
    for lang, source, text in rows:
        df.update((lang, w) for w in set(text.split()))
        for w in text.split():
            want[lang, w][source] += 1
    assert order == sorted(order) and got == {k: c for k, c in want.items() if df[k] >= 3}


def test_trie():
    rng = random.Random(1)
    trie, plain = tries.Trie(), Counter()
    for _ in range(3000):
        term = bytes(rng.choice(b"ab\xc3\xff") for _ in range(rng.randrange(1, 9)))
        trie.leaf(term)[0] += 1
        plain[term] += 1
    assert [(t, leaf[0]) for t, leaf in trie.walk()] == sorted(plain.items()) and trie.size == len(plain)


def test_scaled_is_exact():
    rng = random.Random(2)
    for _ in range(500):
        b = rng.randrange(1, 9 * 10**15)
        a = rng.randrange(0, b + 1)
        assert int(tries.scaled(np.array([a]), np.array([b]))[0]) == 1 + 1_000_000_000 * a // b


def test_cut_terms():
    texts = ["Ab c1d", "", "É-x", "  ", "zz", "a\x00b\x7f日本"]
    for table, pattern in ((terms.LETTERS, TERM), (terms.WORDS, re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))):
        for array in (pa.array(texts), pa.array(["zzz", *texts, "q"]).slice(1, len(texts))):
            rows, codes, names = terms.cut(array, table)
            assert list(zip(rows.tolist(), names.take(pa.array(codes)).to_pylist())) == [(k, w.translate(LOWER)) for k, t in enumerate(texts) for w in pattern.findall(t)]

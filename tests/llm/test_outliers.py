import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import outliers

BREAK = " \t\n\x0b\x0c\r"


def words_of(text):
    out, held = [], ""
    for c in text:
        if c in BREAK:
            out += [held] if held else []
            held = ""
        else:
            held += c
    return out + ([held] if held else [])


def counts(text):
    """The five counts, lines with a word and distinct words, plainly."""
    text = text or ""
    words = words_of(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines), len(set(words)))


def vector(c):
    n_words, chars, symbols, dup, repeat, lines, distinct = c
    plain = (math.log(n_words), math.log(chars / n_words), math.sqrt(symbols / chars), math.sqrt(dup / lines), math.sqrt(repeat / n_words), math.log(distinct))
    return tuple(math.floor(x * outliers.SCALE + 0.5) for x in plain)


def floors():
    return np.diag([(sd * outliers.SCALE) ** 2 for _, sd in outliers.STATISTICS])


def robust(x):
    """The estimate of a cell's distinct vectors: concentration from two starts, the smaller determinant, reweighting."""

    def away(mean, cov):
        gap = x - mean
        return np.einsum("ij,ij->i", gap, np.linalg.solve(cov, gap.T).T)

    def fit(part, share):
        return part.mean(0), outliers.consistency(share) * np.cov(part.T, bias=True) + floors()

    q = np.percentile(x, [25, 50, 75], axis=0)
    ends = []
    for mean, cov in ((q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2) + floors()), (x.mean(0), np.cov(x.T, bias=True) + floors())):
        for _ in range(outliers.STEPS):
            bins = np.floor(np.log(away(mean, cov) + 0.001) * 16)
            below = np.array([(bins < b).sum() for b in bins])
            mean, cov = fit(x[below < outliers.HALF * len(x)], outliers.HALF)
        ends.append((np.linalg.det(cov), mean, cov))
    _, mean, cov = min(ends, key=lambda e: e[0])
    mean, cov = fit(x[away(mean, cov) <= outliers.chi2_quantile(outliers.REWEIGHT, outliers.P)], outliers.REWEIGHT)
    return lambda v: float((np.array(v) - mean) @ np.linalg.solve(cov, np.array(v) - mean))


def brute(rows):
    """(counts, base_failed, kept, distance) of each (lang, source, text)."""
    held = [(lang or "", source or "", counts(text)) for lang, source, text in rows]
    failed = [c[0] < 10 or 100 * c[4] > 20 * c[0] for *_, c in held]
    own = {}
    for (lang, source, c), bad in zip(held, failed):
        if not bad:
            own.setdefault((lang, source), set()).add(vector(c))
    pool = Counter()
    for (lang, _), vs in own.items():
        pool[lang] += len(vs) if len(vs) < outliers.LEAST else 0

    def cell(key):
        return key if len(own[key]) >= outliers.LEAST else key[0] if pool[key[0]] >= outliers.LEAST else None

    cells = {}
    for key, vs in own.items():
        cells.setdefault(cell(key), set()).update(vs)
    fits = {k: robust(np.array(sorted(v), float)) for k, v in cells.items() if len(v) >= outliers.LEAST}
    out = []
    for (lang, source, c), bad in zip(held, failed):
        far = None if bad or cell((lang, source)) not in fits else fits[cell((lang, source))](vector(c))
        out.append((c[:5], bad, not bad and (far is None or far <= outliers.chi2_quantile(outliers.KEEP, outliers.P)), far))
    return out


def test_counts(spark, odd):
    rng = random.Random(5)
    texts = [r.text for r in odd.collect()] + ["a b c d e a b c d e", "a a a a a a", "x\nx\n\n \nx y\nx", "# <b> | 5% && $é*", " \x0b lead and trail \x0c"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(60)] + ["\n".join(rng.choice(["one line", "two", " ", "three words here"]) for _ in range(12)) for _ in range(10)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    for r in outliers.text_counts(df).collect():
        assert tuple(r)[1:] == counts(texts[r.k])[:5] + counts(texts[r.k])[5:], texts[r.k]
    with pytest.raises(ValueError):
        outliers.text_counts(df.withColumn("N_Words", F.lit(1)))


def made(seed, n, source):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" * (1 + k % 3) for k in range(400)]
    for _ in range(n):
        yield ("en", source, " ".join(rng.choice(vocabulary) for _ in range(int(rng.lognormvariate(4.5, 0.5)) + 12)))


def test_estimates_against_numpy(spark):
    rows = [*made(1, 150, "a"), *made(2, 90, "b"), *made(3, 40, "c"), *made(4, 35, "d")]  # c and d are pooled
    rows += [("en", "a", "#$% &&& ** " * 30 + "w1 " * 3)] * 70  # copies, one vector, don't move the estimate
    rows += [("en", "a", "same word " * 40 + " ".join(f"v{k}" for k in range(3))), (None, None, "alone in its language but a text of twelve words as these are"), ("en", None, None)]
    df = spark.createDataFrame([(k, *r[:2], r[2]) for k, r in enumerate(rows)], "doc_id long, lang string, source string, text string").repartition(5)
    got = {r.doc_id: r for r in outliers.quality_report(df).collect()}
    assert len(got) == len(rows)
    for k, (c, bad, kept, far) in enumerate(brute(rows)):
        r = got[k]
        assert (tuple(r[n] for n in outliers.COUNTS), r.base_failed, r.kept) == (c, bad, kept), rows[k]
        assert r.distance is None if far is None else abs(r.distance - far) < 1e-6 * max(1, far)
    assert sum(not got[k].kept for k in range(315)) <= 3 and not any(got[k].kept for k in range(315, 385))


def test_documents_against_numpy(spark, documents):
    rows = documents.select("doc_id", "lang", "source", "text").collect()
    wanted = {r.doc_id: w for r, w in zip(rows, brute([tuple(r)[1:] for r in rows]))}
    for r in outliers.quality_report(documents).collect():
        c, bad, kept, _ = wanted[r.doc_id]
        assert (tuple(r[n] for n in outliers.COUNTS), r.base_failed, r.kept) == (c, bad, kept)


def test_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    met = outliers.quality_report(docs).join(labels, "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    share = {r.quality: r.kept for r in met.collect()}
    assert share[1] >= 0.99 and share[0] <= 0.1


def test_odd(clashing, empty):
    got = outliers.quality_report(clashing)
    assert got.count() == clashing.count() and got.columns == ["doc_id", *outliers.COUNTS, "base_failed", "kept", "distance"]
    assert outliers.quality_report(empty).count() == 0


def test_quantiles():
    assert abs(outliers.chi2_quantile(0.975, 6) - 14.449375) < 1e-5 and abs(outliers.chi2_cdf(7.840804, 6) - 0.75) < 1e-6


def test_no_python_in_the_plan(documents):
    plan = outliers.quality_report(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

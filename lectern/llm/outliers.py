"""Quality rules with robust multivariate outliers, with DataFrame and SQL functions only.

Fixed rules reject a text by its word and repetition counts. Of the texts that
pass, six transformed statistics make a vector; a minimum-covariance-determinant
estimate per language and source says which vectors are far from the bulk of
their cell in Mahalanobis distance.

* The statistics, in steps of 1 / 256, are integers, so sums and products are
  exact and results don't depend on the order of rows.
* A cell's estimate counts each distinct vector once: copies, however many,
  can't make it degenerate.
* Concentration steps: distances under the present estimate fall into bins of
  about 6 %; whole bins from the nearest on, until three quarters of the
  vectors are in, give the next estimate. Moments are summed by bin, so a step
  is one aggregation with map-side combine, whatever the size of a cell. Two
  starts (medians with quartile ranges, and all vectors); the smaller
  determinant wins. One reweighting step follows.
* Each variance has a floor, what differences in that statistic are of no account.
* Sources with fewer than LEAST distinct vectors are pooled by language,
  languages with fewer in that pool over all; a pool that is still smaller
  rejects nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import discard, join_labels, materialise

SCALE = 256
#: Transformed statistics, as SQL of the counts (n_words and word_chars positive), and the standard deviation below which a difference is of no account.
STATISTICS = (
    ("ln(n_words)", 0.1),
    ("ln(word_chars / CAST(n_words AS DOUBLE))", 0.05),
    ("sqrt(n_symbols / CAST(word_chars AS DOUBLE))", 0.05),
    ("sqrt(n_dup_lines / CAST(n_lines AS DOUBLE))", 0.1),
    ("sqrt(n_repeat_words / CAST(n_words AS DOUBLE))", 0.1),
    ("ln(n_distinct)", 0.1),
)
P = len(STATISTICS)
X = [f"x{k}" for k in range(P)]
#: Pairs i >= j of a lower triangle, row by row.
LOWER = [(i, j) for i in range(P) for j in range(i + 1)]
MOMENTS = [f"s{k}" for k in range(P)] + [f"s{i}_{j}" for i, j in LOWER]
ESTIMATE = [f"m{k}" for k in range(P)] + [f"a{i}_{j}" for i, j in LOWER]
#: Distinct vectors that a cell needs for an estimate of its own.
LEAST = 60
STEPS = 5
#: Share of the vectors that a concentration step takes, at least; of the reweighting step; and of normal vectors that are kept.
HALF, REWEIGHT, KEEP = 0.75, 0.975, 1 - 1e-9
WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "[^#*$%&|<>]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def chi2_cdf(x: float, dof: int) -> float:
    """The chi-squared distribution of even degrees of freedom."""
    term = total = 1.0
    for k in range(1, dof // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(q: float, dof: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, dof) < q else (lo, mid)
    return round(lo, 6)


def consistency(share: float) -> float:
    """What the covariance of the nearest ``share`` of normal vectors is multiplied by to be that of all."""
    return round(share / chi2_cdf(chi2_quantile(share, P), P + 2), 6)


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (as in the queries), n_lines (lines with a word) and n_distinct (words).

    Repeated five-word windows are found within the text by sorted 64-bit
    hashes, only in texts where a hash occurs twice. Null text: all 0. Raises where ``docs`` has a column of these names.
    """
    made = [*COUNTS, "n_lines", "n_distinct", "_body", "_words", "_hashes", "_grams", "_sorted", "_places", "_lines"]
    if taken := {c.lower() for c in docs.columns if c != text} & set(made):
        raise ValueError(f"text_counts makes columns that are there: {sorted(taken)}")
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text]
    held = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("_body"))
    held = held.select(*kept, "_body", F.expr(rf"array_remove(split(_body, r'{WORD_BREAK}'), '')").alias("_words"), F.expr(rf"filter(split(_body, '\n'), s -> regexp_like(s, r'[^\x20\x09-\x0D]'))").alias("_lines"))
    held = held.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.expr(rf"cast(length(regexp_replace(_body, r'{WORD_BREAK}', '')) as bigint)").alias("word_chars"),
        F.expr(f"cast(length(regexp_replace(_body, '{SYMBOLS}', '')) as bigint)").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.expr("cast(size(_lines) - size(array_distinct(_lines)) as bigint)").alias("n_dup_lines"),
        F.expr("cast(size(array_distinct(_words)) as bigint)").alias("n_distinct"),
        F.expr("transform(_words, w -> xxhash64(w))").alias("_hashes"),
    )
    window = ", ".join(f"_hashes[i + {k}]" for k in range(5))
    held = held.withColumn("_grams", F.expr(f"CASE WHEN size(_hashes) > 5 THEN transform(sequence(0, size(_hashes) - 5), i -> xxhash64({window})) END")).drop("_hashes")
    held = held.withColumn("_sorted", F.expr("CASE WHEN size(array_distinct(_grams)) < size(_grams) THEN sort_array(transform(_grams, (h, i) -> struct(h, i))) END")).drop("_grams")
    twice = "filter(_sorted, (p, k) -> (k > 0 AND _sorted[k - 1].h = p.h) OR (k + 1 < size(_sorted) AND _sorted[k + 1].h = p.h))"
    held = held.withColumn("_places", F.expr(f"sort_array(transform({twice}, p -> p.i))")).drop("_sorted")
    covered = "aggregate(transform(_places, (p, k) -> CASE WHEN k + 1 = size(_places) THEN 5 ELSE least(5, _places[k + 1] - p) END), 0L, (a, n) -> a + n)"
    return held.select(*kept, *COUNTS[:4], F.expr(f"coalesce({covered}, 0L)").alias("n_repeat_words"), "n_lines", "n_distinct")


BASE_FAILED = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"


def steps_of(expression: str) -> str:
    """A statistic as an integer number of steps."""
    return f"CAST(floor(({expression}) * {SCALE} + 0.5) AS BIGINT)"


def sums() -> str:
    return ", ".join(["count(*) AS n", *[f"sum(x{k}) AS s{k}" for k in range(P)], *[f"sum(x{i} * x{j}) AS s{i}_{j}" for i, j in LOWER]])


def solve(source: str, keys: str, factor: float, n: str = "n") -> str:
    """SQL: ``source`` (keys, n and moments) to means, inverse Cholesky factor of factor * covariance + floors, and det, the product of the factor's diagonal.

    Each of the nested selections is one row of the factor.
    """
    inner = ", ".join(f"s{k} / CAST(n AS DOUBLE) AS m{k}" for k in range(P))
    sql = f"SELECT {keys}, n, {', '.join(MOMENTS)}, {inner} FROM {source}"
    cov = ", ".join(f"{factor} * (s{i}_{j} / CAST(n AS DOUBLE) - m{i} * m{j})" + (f" + {(STATISTICS[i][1] * SCALE) ** 2:.4f}" if i == j else "") + f" AS c{i}_{j}" for i, j in LOWER)
    means = ", ".join(f"m{k}" for k in range(P))
    sql = f"SELECT {keys}, n, {means}, {cov} FROM ({sql}) t"
    return factored(sql, keys)


def factored(sql: str, keys: str) -> str:
    """SQL: rows (keys, n, m.., c..) with the covariance c turned into a = inverse of its Cholesky factor, and det."""
    means = ", ".join(f"m{k}" for k in range(P))
    for j in range(P):  # column j of the factor: first its diagonal, then what lies below
        diagonal = f"sqrt(c{j}_{j}{''.join(f' - l{j}_{k} * l{j}_{k}' for k in range(j))}) AS l{j}_{j}"
        sql = f"SELECT *, {diagonal} FROM ({sql}) d{j}"
        below = [f"(c{i}_{j}{''.join(f' - l{i}_{k} * l{j}_{k}' for k in range(j))}) / l{j}_{j} AS l{i}_{j}" for i in range(j + 1, P)]
        if below:
            sql = f"SELECT *, {', '.join(below)} FROM ({sql}) b{j}"
    sql = f"SELECT *, {', '.join(f'1 / l{k}_{k} AS a{k}_{k}' for k in range(P))} FROM ({sql}) i0"
    for gap in range(1, P):
        row = [f"-({' + '.join(f'l{i}_{k} * a{k}_{i - gap}' for k in range(i - gap, i))}) / l{i}_{i} AS a{i}_{i - gap}" for i in range(gap, P)]
        sql = f"SELECT *, {', '.join(row)} FROM ({sql}) i{gap}"
    return f"SELECT {keys}, n, {means}, {', '.join(f'a{i}_{j}' for i, j in LOWER)}, {' * '.join(f'l{k}_{k}' for k in range(P))} AS det FROM ({sql}) f"


def distance() -> str:
    """SQL: the squared Mahalanobis distance of (x0, ..) under (m.., a..)."""
    rows = [" + ".join(f"a{i}_{j} * (x{j} - m{j})" for j in range(i + 1)) for i in range(P)]
    return " + ".join(f"({r}) * ({r})" for r in rows)


def binned(source: str) -> str:
    """SQL: the moments of ``source`` (cell, start, x.., d2) by bin of distance."""
    return f"SELECT cell, start, CAST(floor(ln(d2 + 0.001) * 16) AS INT) AS bin, {sums()} FROM {source} GROUP BY cell, start, CAST(floor(ln(d2 + 0.001) * 16) AS INT)"


def nearest(source: str) -> str:
    """SQL: the moments of the nearest whole bins of ``source`` that hold HALF of the vectors."""
    add = ", ".join(f"sum({m}) AS {m}" for m in ["n", *MOMENTS])
    placed = f"SELECT *, sum(n) OVER (PARTITION BY cell, start ORDER BY bin) - n AS before_n, sum(n) OVER (PARTITION BY cell, start) AS total_n FROM ({source}) q"
    return f"SELECT cell, start, max(total_n) AS size, {add} FROM ({placed}) r WHERE before_n < CAST({HALF} AS DOUBLE) * total_n GROUP BY cell, start"


def first_sql(source: str) -> str:
    """SQL: per cell and start the first estimate; start 0 from quartiles, 1 from all vectors."""
    both = f"SELECT cell, {sums()}, {', '.join(f'{{quartiles_{k}}} AS q{k}' for k in range(P))} FROM {source} GROUP BY cell"
    spread = ", ".join(
        (f"((q{i}[{{third}}] - q{i}[{{first}}]) / 1.349) * ((q{i}[{{third}}] - q{i}[{{first}}]) / 1.349) + {(STATISTICS[i][1] * SCALE) ** 2:.4f}" if i == j else "CAST(0 AS DOUBLE)") + f" AS c{i}_{j}" for i, j in LOWER
    )
    medians = ", ".join(f"q{k}[{{second}}] AS m{k}" for k in range(P))
    by_quartiles = factored(f"SELECT cell, 0 AS start, n, {medians}, {spread} FROM ({both}) u", "cell, start")
    by_all = solve(f"(SELECT *, 1 AS start FROM ({both}) w)", "cell, start", 1.0)
    return f"{by_quartiles} UNION ALL {by_all}"


def _spark_first() -> str:
    quartiles = {f"quartiles_{k}": f"percentile(x{k}, array(0.25, 0.5, 0.75))" for k in range(P)}
    return first_sql("{vectors}").replace("{vectors}", "__v").format(first="0", second="1", third="2", **quartiles).replace("__v", "{vectors}")


def estimates(vectors: DataFrame, total: int) -> DataFrame:
    """Per cell of ``vectors`` (cell, x0..; distinct; of ``total`` rows at most) with LEAST vectors or more: cell, means and inverse factor. A written table."""
    spark = vectors.sparkSession
    sizes = vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= LEAST)

    def kept(rows: DataFrame) -> DataFrame:
        """A row a cell: its size and the estimates of both starts. A written table."""
        return materialise(rows.groupBy("cell").agg(F.max("size").alias("size"), F.collect_list(F.struct("start", *ESTIMATE, "det")).alias("held")))

    def met(held: DataFrame) -> DataFrame:
        """Vectors with the estimates of their cell and the distances under them."""
        rows = join_labels(vectors, held.withColumn("n", F.col("size")), ["cell"], total)
        return rows.select("cell", "size", *X, F.explode("held").alias("e")).select("cell", "size", *X, "e.*").selectExpr("cell", "start", "size", *X, f"{distance()} AS d2")

    held = kept(spark.sql(_spark_first(), vectors=vectors).select("cell", "start", *ESTIMATE, "det").join(sizes, "cell"))
    for _ in range(STEPS):
        new = kept(spark.sql(solve(f"({nearest(binned('{near}'))}) g", "cell, start, size", consistency(HALF)), near=met(held)))
        discard(held)
        held = new
    best = held.withColumn("held", F.expr("slice(array_sort(held, (a, b) -> CASE WHEN a.det < b.det OR (a.det = b.det AND a.start < b.start) THEN -1 ELSE 1 END), 1, 1)"))
    inner = met(best).where(F.col("d2") <= chi2_quantile(REWEIGHT, P))
    out = materialise(spark.sql(solve(f"(SELECT cell, {sums()} FROM {{inner}} GROUP BY cell) g", "cell", consistency(REWEIGHT)), inner=inner).select("cell", *ESTIMATE))
    discard(held)
    return out


def quality_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance (squared; null where none is measured).

    kept is false where the base rules fail or the distance passes the KEEP
    quantile. Null text counts as empty (base_failed); null lang or source as
    ''. Repeated ids and rows each give a row; other columns are ignored; an empty table gives none.
    """
    narrow = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(lang), F.lit("")).alias("_lang"), F.coalesce(F.col(source), F.lit("")).alias("_source"), F.col(text).alias("_text"))
    counted = text_counts(narrow, "_text").withColumn("base_failed", F.expr(BASE_FAILED))
    counted = materialise(counted.selectExpr("*", *[f"CASE WHEN NOT base_failed THEN {steps_of(e)} END AS x{k}" for k, (e, _) in enumerate(STATISTICS)]))
    passed = counted.where(~F.col("base_failed"))
    apart = materialise(passed.groupBy("_lang", "_source", *X).agg(F.count(F.lit(1)).alias("copies")))
    own = apart.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("size"), F.sum("copies").alias("n"))
    cells = materialise(celled(own))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    vectors = materialise(join_labels(apart, cells, ["_lang", "_source"], total).select("cell", *X).distinct())
    discard(apart)
    places = cells.join(estimates(vectors, total), "cell", "left").drop("cell", "size")
    discard(vectors)
    near = join_labels(passed, places, ["_lang", "_source"], total).withColumn("distance", F.expr(distance()))
    near = near.withColumn("kept", F.coalesce(F.col("distance") <= chi2_quantile(KEEP, P), F.lit(True)))
    failed = counted.where("base_failed").selectExpr("*", "false AS kept", "cast(null as double) AS distance")
    out = [F.col("_id").alias(id_col), *COUNTS, "base_failed", "kept", "distance"]
    return near.select(*out).unionByName(failed.select(*out))


def celled(own: DataFrame) -> DataFrame:
    """``own`` (_lang, _source, size, ..) with its cell: the source, or the pool of its language's small sources, or that of small pools."""
    pools = own.where(F.col("size") < LEAST).groupBy("_lang").agg((F.sum("size") < LEAST).alias("_small"))
    one = F.concat(F.lit("s"), F.length("_lang"), F.lit(":"), "_lang", "_source")
    cell = F.when(F.col("size") >= LEAST, one).when(~F.col("_small"), F.concat(F.lit("l"), "_lang")).otherwise("all")
    return own.join(pools, "_lang", "left").withColumn("cell", cell).drop("_small")

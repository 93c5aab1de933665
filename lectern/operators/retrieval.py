"""Retrieval: keyword, vector and entity candidates, fusion by reciprocal ranks, heuristic reranking.

Each strategy ends in a top-k (at most 200 rows), so everything from fusion on
is small; the scans before it are pruned by the access predicate and carry
only the columns that the score needs.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import normalize_name, tokens

#: The fusion constant, category weights and bonuses of the reranker.
RRF_K = 60
CATEGORY_WEIGHTS = {"core_rules": 1.0, "official_supplement": 0.9, "homebrew": 0.7}
OTHER_WEIGHT = 0.8
ENTITY_BONUS = 0.05
HEADING_BONUS = 0.1
MAX_STRATEGY = 200


@dataclass(frozen=True)
class Query:
    """A web-style query: alternatives of clauses; a clause is (words, phrases, excluded words)."""

    clauses: tuple[tuple[tuple[str, ...], tuple[tuple[str, ...], ...], tuple[str, ...]], ...]

    @property
    def terms(self) -> list[str]:
        """Distinct wanted words, in order."""
        out: list[str] = []
        for words, phrases, _ in self.clauses:
            out += [*words, *(w for p in phrases for w in p)]
        return list(dict.fromkeys(out))


WORD = re.compile(r"[^\W]+", re.UNICODE)


def parse_query(text: str) -> Query:
    """Quotes make phrases, a leading hyphen excludes, OR separates alternatives and binds less than the implied AND."""
    clauses, words, phrases, out = [], [], [], []

    def close():
        if words or phrases or out:
            clauses.append((tuple(words), tuple(phrases), tuple(out)))
        words.clear(), phrases.clear(), out.clear()

    for quoted, minus, plain in re.findall(r'"([^"]*)"|(-?)([^\s"]+)', text):
        if quoted:
            found = WORD.findall(quoted.lower())
            if found:
                phrases.append(tuple(found))
        elif plain == "OR" and not minus:
            close()
        else:
            found = WORD.findall(plain.lower())
            (out if minus else words).extend(found)
    close()
    return Query(tuple(clauses))


def matches(query: Query, words: Column, padded: Column) -> Column:
    """Whether a text matches. ``words``: its tokens; ``padded``: the tokens joined and surrounded by blanks."""

    def clause(c):
        wanted, phrases, excluded = c
        tests = [F.array_contains(words, w) for w in wanted]
        tests += [F.contains(padded, F.lit(f" {' '.join(p)} ")) for p in phrases]
        tests += [~F.array_contains(words, w) for w in excluded]
        return reduce(lambda a, b: a & b, tests)

    return reduce(lambda a, b: a | b, [clause(c) for c in query.clauses], F.lit(False))


def keyword_search(chunks: DataFrame, text: str, limit: int = 50, body: str = "text") -> DataFrame:
    """The best ``limit`` chunks (chunk_id, score, rank) that match. Score: occurrences of wanted terms over 1 + ln(1 + tokens). Ties by chunk_id; a blank query finds nothing."""
    query = parse_query(text)
    limit = max(1, min(MAX_STRATEGY, limit))
    # a scan-side test that needs no tokens: some wanted term occurs at all
    low = F.lower(body)
    some = reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in query.terms], F.lit(False))
    held = chunks.where(some).select("chunk_id", tokens(body).alias("w"))
    hits = held.where(matches(query, F.col("w"), F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))))
    tf = F.size(F.filter("w", lambda w: w.isin(query.terms) if query.terms else F.lit(False)))
    scored = hits.select("chunk_id", F.round(tf / (1 + F.log(1 + F.size("w"))), 9).alias("score"))
    return ranked(scored.orderBy(F.desc("score"), "chunk_id").limit(limit))


def plain_search(chunks: DataFrame, text: str, body: str = "text") -> DataFrame:
    """Chunks that hold every word of ``text``."""
    words = list(dict.fromkeys(WORD.findall(text.lower())))
    if not words:
        return chunks.limit(0)
    low = F.lower(body)
    pre = reduce(lambda a, b: a & b, [F.contains(low, F.lit(w)) for w in words])
    return chunks.where(pre).where(F.size(F.array_except(F.array(*[F.lit(w) for w in words]), tokens(body))) == 0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_search(chunks: DataFrame, vectors: DataFrame, queries: list[list[float]], limit: int = 50) -> DataFrame:
    """The best chunks by cosine to any of ``queries``: the top ``limit`` of each query, the best score per chunk; the union is not cut again.

    One reading of the vectors whatever the number of queries: each task keeps its own best of every query before the few meet.
    """
    limit = max(1, min(MAX_STRATEGY, limit))
    if not queries:
        return ranked(chunks.select("chunk_id", F.lit(0.0).alias("score")).limit(0))
    held = chunks.select("chunk_id").join(vectors, "chunk_id")
    scores = [F.round(cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in q])), 6) for q in queries]
    if len(queries) == 1:
        return ranked(held.select("chunk_id", scores[0].alias("score")).orderBy(F.desc("score"), "chunk_id").limit(limit))
    each = held.select("chunk_id", F.posexplode(F.array(*scores)).alias("probe", "score"))
    best = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "chunk_id"))
    tops = each.withColumn("_r", best).where(F.col("_r") <= limit)
    return ranked(tops.groupBy("chunk_id").agg(F.max("score").alias("score")))


def names_within(names: DataFrame, text: str) -> list[str]:
    """The normalised names of ``names`` (name) that stand in a query as whole words, sorted.

    They are runs of the query's words, so a query of m words has m * (m + 1) / 2 at most.
    """
    words = F.split(normalize_name(F.lit(text)), "-")
    n = F.size(words)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.array_join(F.slice(words, i, j - i + 1), "-"))))
    named = names.select(normalize_name("name").alias("name")).where((F.col("name") != "") & F.array_contains(runs, F.col("name")))
    return sorted(r.name for r in named.distinct().collect())


def entity_search(chunks: DataFrame, names: DataFrame, text: str, limit: int = 200) -> DataFrame:
    """Chunks whose heading carries, as whole words, a name that the query holds: (chunk_id, score, rank), field evidence 1, block evidence 0.9."""
    found = names_within(names, text)
    if not found:
        return ranked(chunks.select("chunk_id", F.lit(1.0).alias("score")).limit(0))
    heading = F.concat(F.lit("-"), normalize_name("heading"), F.lit("-"))
    body = F.concat(F.lit("-"), normalize_name("text"), F.lit("-"))
    in_heading, in_body = (reduce(lambda a, b: a | b, [F.contains(where, F.lit(f"-{n}-")) for n in found]) for where in (heading, body))
    hits = chunks.select("chunk_id", F.when(in_heading, 1.0).when(in_body, 0.9).alias("score")).where("score is not null")
    return ranked(hits.orderBy(F.desc("score"), "chunk_id").limit(limit))


def ranked(top: DataFrame) -> DataFrame:
    """(chunk_id, score, rank from 1) of a list that a limit has already bounded."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))


def fuse(lists: list[tuple[str, DataFrame]], k: int = RRF_K, limit: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of bounded lists: (chunk_id, strategy of the first list that holds it, score)."""
    tagged = [d.select("chunk_id", "rank", F.lit(n).alias("strategy"), F.lit(i).alias("ix")) for i, (n, d) in enumerate(lists)]
    both = reduce(DataFrame.unionByName, tagged).groupBy("chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.min_by("strategy", "ix").alias("strategy"))
    return both.orderBy(F.desc("score"), "chunk_id").limit(limit)


def rerank(fused: DataFrame, text: str, weights: dict[str, float] | None = None) -> DataFrame:
    """Fused candidates (score, strategy, category, heading) by adjusted score: category weight, entity bonus, share of query words in the heading."""
    weights = CATEGORY_WEIGHTS if weights is None else weights
    factor = F.lit(OTHER_WEIGHT)
    for category, w in weights.items():
        factor = F.when(F.col("category") == category, w).otherwise(factor)
    words = [w for w in text.lower().split() if len(w) > 2]
    score = F.col("score") * factor + F.when(F.col("strategy") == "entity", ENTITY_BONUS).otherwise(0.0)
    if words:
        low = F.lower("heading")
        hits = reduce(lambda a, b: a + b, [F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words])
        score = score + F.coalesce(HEADING_BONUS * hits / len(words), F.lit(0.0))
    return fused.withColumn("score", F.round(score, 9))


def expand_query(text: str, glossary: list[tuple[str, list[str]]], bilingual: list[tuple[str, list[str]]] = ()) -> list[tuple[str, float]]:
    """(text, weight): the query at 1, its glossary aliases at 0.8, translations at 0.7; whole words, repeats dropped without regard to case."""
    out: list[tuple[str, float]] = [(text, 1.0)]
    seen = {text.lower()}
    for table, weight in ((glossary, 0.8), (bilingual, 0.7)):
        for term, others in table:
            if re.search(rf"(?<!\w){re.escape(term)}(?!\w)", text, re.IGNORECASE):
                for o in others:
                    if o.lower() not in seen:
                        seen.add(o.lower())
                        out.append((o, weight))
    return out


def expanded(queries: DataFrame, glossary: DataFrame) -> DataFrame:
    """(query_id, text, weight, place): each of ``queries`` (query_id, text) at weight 1 and what ``glossary`` (term, other, weight) adds to it, best first.

    A term counts where its tokens stand in the query in a row, without regard to case. A text comes once a query, at its highest
    weight and in the spelling that is first in byte order; the query's own text is not repeated. Terms meet queries by their
    first token, so the join grows with the queries' tokens; terms without tokens and nulls add nothing.
    """

    def spaced(c: str):
        return F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" "))

    q = queries.where("text IS NOT NULL").select("query_id", F.col("text").alias("own"), spaced("text").alias("said"))
    g = glossary.where("term IS NOT NULL AND other IS NOT NULL").select(F.get(tokens("term"), F.lit(0)).alias("token"), spaced("term").alias("term"), "other", "weight").where("token IS NOT NULL")
    met = q.select("query_id", "own", "said", F.explode(F.array_distinct(tokens("own"))).alias("token")).join(g, "token").where(F.contains("said", "term"))
    found = met.where(F.lower("own") != F.lower("other")).groupBy("query_id", F.lower("other").alias("low")).agg(F.max("weight").alias("weight"), F.min("other").alias("text"))
    rows = q.select("query_id", F.col("own").alias("text"), F.lit(1.0).alias("weight"), F.lit(0).alias("_k")).unionByName(found.select("query_id", "text", F.col("weight").cast("double").alias("weight"), F.lit(1).alias("_k")))
    order = Window.partitionBy("query_id").orderBy("_k", F.desc("weight"), "text")
    return rows.withColumn("place", F.row_number().over(order) - 1).drop("_k")


def combined(expansions: list[tuple[str, float]], named: list[str] = ()) -> str:
    """Alternatives joined by OR, then quoted entity names."""
    return " OR ".join([*(t for t, _ in expansions), *(f'"{n.replace(chr(34), "")}"' for n in named)])


@dataclass(frozen=True)
class Rewrite:
    """A query's variants; without a model, the query alone."""

    original: str
    canonical: str
    bilingual: tuple[str, ...] = ()
    expanded: tuple[str, ...] = ()

    @property
    def variants(self) -> tuple[str, ...]:
        return (self.original, self.canonical, *self.bilingual, *self.expanded)


def identity(text: str) -> Rewrite:
    return Rewrite(text.strip(), text.strip())


def name_key(name: str) -> str:
    """``normalize_name`` of one name, on the driver."""
    return re.sub(r"[-_\s.,/:;!?()]+", "-", name.strip().lower()).strip("-")


def enriched(rewrite: Rewrite, named: list[str]) -> Rewrite:
    """With the entity names that no variant has yet, by normalised name."""
    known = {name_key(x) for x in rewrite.variants}
    fresh = {name_key(n): n for n in reversed(named) if name_key(n) and name_key(n) not in known}
    return Rewrite(rewrite.original, rewrite.canonical, rewrite.bilingual, (*rewrite.expanded, *reversed(fresh.values())))


def vector_texts(rewrite: Rewrite) -> list[str]:
    """The distinct variants to embed, in order, without regard to case."""
    out: dict[str, str] = {}
    for x in rewrite.variants:
        if x.strip():
            out.setdefault(x.strip().lower(), x.strip())
    return list(out.values())


def hybrid_search(
    chunks: DataFrame,
    vectors: DataFrame,
    names: DataFrame,
    text: str,
    embed: Callable[[list[str]], list[list[float]]],
    limit: int = 20,
    strategy_limit: int = 50,
    glossary: list[tuple[str, list[str]]] = (),
    bilingual: list[tuple[str, list[str]]] = (),
    rewrite: Callable[[str], Rewrite] | None = identity,
    keyword: Callable | None = None,
    vector: Callable | None = None,
) -> DataFrame:
    """The final page, with total (merged candidates) and has_more on each row.

    Entities named in the query are resolved first. The keyword query is the query, its expansions and the quoted entity
    names, joined by OR; the vector queries are the variants that ``rewrite`` gives (None: the query alone), with entity
    names added, as ``embed`` embeds them. The three lists are fused (entity, keyword, vector), cut to three times ``limit``
    (1..100), reranked and cut. ``chunks`` must already be narrowed to what the user may see: (chunk_id, text, heading,
    category). A blank query finds nothing. ``rewrite``, ``embed``, ``keyword`` and ``vector`` can be replaced.
    """
    limit = max(1, min(100, limit))
    if not text.strip():
        empty = chunks.limit(0).select("chunk_id", F.lit(0.0).alias("score"), F.lit("").alias("strategy"), "heading", "category")
        return empty.select("*", F.lit(0).cast("long").alias("total"), F.lit(False).alias("has_more"))
    named = [n.replace("-", " ") for n in names_within(names, text)]
    wanted = [text] if rewrite is None else vector_texts(enriched(rewrite(text), named))
    lists = [
        ("entity", entity_search(chunks, names, text)),
        ("keyword", (keyword or keyword_search)(chunks, combined(expand_query(text, glossary, bilingual), named), strategy_limit)),
        ("vector", (vector or vector_search)(chunks, vectors, embed(wanted), strategy_limit)),
    ]
    merged = fuse(lists, limit=3 * limit)
    shaped = F.broadcast(merged).join(chunks.select("chunk_id", "heading", "category"), "chunk_id")  # 300 rows at most
    counted = rerank(shaped, text).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy()))
    return counted.withColumn("has_more", F.col("total") > limit).orderBy(F.desc("score"), "chunk_id").limit(limit)

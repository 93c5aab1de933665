"""Queries of the operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, brown, licenses, media, outliers, packing, quality, search, secrets, sharding, simhash, tries, vectors

#: Files of the installed tokenizers, found where they are read.
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of all documents: 3-word shingles, 3 or fewer differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=3)
    return found.select("doc_id", simhash.hex_digits("fingerprint").alias("fingerprint"), "component_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048."""
    packed = packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 by a permutation of row numbers."""
    return sharding.shard(table(spark, sf_dir, "documents"), 16)


def op4_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-based n-gram scores of all documents."""
    return brown.brown_scores(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.joined(F.col("spans"), 3), 256).alias("base_sha256"),
        secrets.joined(F.col("spans"), len(secrets.KINDS)).alias("spans"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and the decoded text of all documents."""
    done = bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), WORD_BPE)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License places and labels of all documents."""
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and kept vectors of all embeddings."""
    return vectors.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), 0.98)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored payloads and spectral-peak features of all documents."""
    return media.media_digest(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources of each language, and their most typical terms."""
    return tries.divergence_audit(table(spark, sf_dir, "documents"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each item of benchmark."""
    return search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op13_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and repetition counts of all documents, and whether the rules and their cell's estimate keep them."""
    return outliers.quality_report(table(spark, sf_dir, "documents")).drop("distance")


QUERIES = {f.__name__: f for f in (op1_simhash, op2_packing, op3_sharding, op4_brown, op5_secrets, op6_bpe, op7_quality, op8_licenses, op9_vectors, op10_media, op11_divergence, op12_search, op13_outliers)}


def sharding_sql(seed: int = 42, shards: int = 16) -> str:
    """``op3_sharding`` in SQL: crc32 as a fold over bytes, the network round by round, cycle walking by recursion."""
    left, right = "x // b", "x % b"
    for n, (mul, add) in enumerate(sharding.round_keys(seed)):
        moved, other, side = (left, right, "a") if n % 2 == 0 else (right, left, "b")
        value = f"((({other}) % {sharding.PRIME} * {mul} + {add}) % {sharding.PRIME} % {sharding.FOLD} * {add} + {mul}) % {sharding.PRIME} % {side}"
        moved = f"(({moved}) + {value}) % {side}"
        left, right = (moved, right) if n % 2 == 0 else (left, moved)
    step = f"({left}) * b + {right}"
    return f"""WITH RECURSIVE
 crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
 narrow AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
   lambda c, byte: xor(c // 256, t[xor(c % 256, byte) + 1]))) AS text_crc32 FROM documents, crc_table),
 numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS x, count(*) OVER () AS n FROM narrow),
 start AS (SELECT *, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a, (n + CAST(floor(sqrt(n - 1)) AS BIGINT)) // (CAST(floor(sqrt(n - 1)) AS BIGINT) + 1) AS b FROM numbered),
 walk AS (SELECT doc_id, size, text_crc32, n, a, b, x, 0 AS passes FROM start UNION ALL SELECT doc_id, size, text_crc32, n, a, b, {step}, passes + 1 FROM walk WHERE passes = 0 OR x >= n)
 SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(x % {shards} AS INTEGER) AS shard, CAST(x // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
 FROM walk WHERE passes > 0 AND x < n"""


def outliers_sql() -> str:
    """``op13_outliers`` in SQL: counts by unnesting, the estimate's steps one after another."""
    o = outliers
    quartiles = {f"quartiles_{k}": f"quantile_cont(x{k}, [0.25, 0.5, 0.75])" for k in range(o.P)}
    first = o.first_sql("sized").format(first=1, second=2, third=3, **quartiles)
    moved, held = [], "p0"
    for k in range(1, o.STEPS + 1):
        near = f"(SELECT v.cell, p.start, {', '.join('v.' + x for x in o.X)}, {o.distance()} AS d2 FROM sized v JOIN {held} p USING (cell))"
        moved.append(f"p{k} AS MATERIALIZED ({o.solve('(' + o.nearest(o.binned(near)) + ') g', 'cell, start', o.consistency(o.HALF))})")
        held = f"p{k}"
    inner = f"(SELECT cell, {o.sums()} FROM (SELECT v.*, {o.distance()} AS d2 FROM sized v JOIN best p USING (cell)) WHERE d2 <= {o.chi2_quantile(o.REWEIGHT, o.P)} GROUP BY cell) g"
    xs = ", ".join(o.X)
    return rf"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS l, coalesce(source, '') AS s, coalesce(text, '') AS t FROM documents),
 cut AS (SELECT *, list_filter(regexp_split_to_array(t, '{o.WORD_BREAK}'), lambda x: x <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines FROM docs),
 grams AS (SELECT rid, i, list_slice(words, i, i + 4) AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM cut)),
 twice AS (SELECT rid, unnest(list(i)) AS i FROM grams GROUP BY rid, g HAVING count(*) > 1),
 covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(5) r(k) GROUP BY rid),
 counted AS (SELECT rid, doc_id, l, s, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{o.WORD_BREAK}', '', 'g')) AS BIGINT) AS word_chars,
   CAST(length(regexp_replace(t, '{o.SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
   len(lines) AS n_lines, len(list_distinct(words)) AS n_distinct FROM cut LEFT JOIN covered USING (rid)),
 judged AS (SELECT *, {o.BASE_FAILED} AS base_failed FROM counted),
 passed AS MATERIALIZED (SELECT *, {', '.join(f"{o.steps_of(e)} AS x{k}" for k, (e, _) in enumerate(o.STATISTICS))} FROM judged WHERE NOT base_failed),
 own AS (SELECT l, s, count(*) AS size FROM (SELECT DISTINCT l, s, {xs} FROM passed) GROUP BY l, s),
 pools AS (SELECT l, sum(size) < {o.LEAST} AS small FROM own WHERE size < {o.LEAST} GROUP BY l),
 cells AS (SELECT l, s, CASE WHEN size >= {o.LEAST} THEN 's' || length(l) || ':' || l || s WHEN NOT small THEN 'l' || l ELSE 'all' END AS cell FROM own LEFT JOIN pools USING (l)),
 vectors AS MATERIALIZED (SELECT DISTINCT cell, {xs} FROM passed JOIN cells USING (l, s)),
 sized AS MATERIALIZED (SELECT * FROM vectors WHERE cell IN (SELECT cell FROM vectors GROUP BY cell HAVING count(*) >= {o.LEAST})),
 p0 AS MATERIALIZED ({first}),
 {", ".join(moved)},
 best AS MATERIALIZED (SELECT * FROM {held} QUALIFY row_number() OVER (PARTITION BY cell ORDER BY det, start) = 1),
 last AS MATERIALIZED ({o.solve(inner, 'cell', o.consistency(o.REWEIGHT))}),
 kept AS (SELECT rid, coalesce({o.distance()} <= {o.chi2_quantile(o.KEEP, o.P)}, true) AS near FROM passed JOIN cells USING (l, s) LEFT JOIN last USING (cell))
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(near, false) AS kept FROM judged LEFT JOIN kept USING (rid)"""


DIVERGENCE_SQL = r"""WITH docs AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents),
 words AS (SELECT rid, lang, source, unnest(found) AS term FROM docs),
 kept AS MATERIALIZED (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
 vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
 groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM docs),
 counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
 filled AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 p AS MATERIALIZED (SELECT lang, source, term, c, 1 + (1000000000 * (c + 2)) // (sum(c) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM filled JOIN vocabulary USING (lang)),
 q AS (SELECT lang, term, 1 + (1000000000 * (c + 2)) // (sum(c) OVER (PARTITION BY lang) + 2 * v) AS q FROM (SELECT lang, term, sum(c) AS c FROM filled GROUP BY ALL) JOIN vocabulary USING (lang)),
 sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
   LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
 tops AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
 SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM tops)
 QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 10"""


SEARCH_SQL = r"""WITH found AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS f FROM documents),
 docs AS MATERIALIZED (SELECT doc_id, rid, f, len(f) AS n FROM found WHERE len(f) > 0),
 total AS (SELECT count(*) AS nd, sum(n) AS l FROM docs),
 postings AS MATERIALIZED (SELECT doc_id, rid, n, term, count(*) AS tf FROM (SELECT doc_id, rid, n, unnest(f) AS term FROM docs) GROUP BY ALL),
 lists AS (SELECT term, CAST(floor(1000 * ln((2 * CAST(nd AS DOUBLE) + 2) / (2 * CAST(df AS DOUBLE) + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), total),
 items AS (SELECT DISTINCT item_id, q, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT *, row_number() OVER () AS q FROM benchmark)),
 scores AS (SELECT item_id, q, doc_id, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l)))) AS score FROM items JOIN lists USING (term) JOIN postings USING (term), total GROUP BY ALL)
 SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST, rid) AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM scores WHERE score > 0
 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST, rid) <= 10"""


ORACLES: dict[str, str] = {"op3_sharding": sharding_sql(), "op11_divergence": DIVERGENCE_SQL, "op12_search": SEARCH_SQL, "op13_outliers": outliers_sql()}

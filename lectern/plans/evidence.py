"""Evidence queries: segments, selections and answers, support of claims, extraction, ingestion reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import evidence as E
from lectern.functions.text import first_sentence
from lectern.operators.support import claim_support
from lectern.plans.base import query
from lectern.sources.stores import checkpoint_dir, dealt
from lectern.sources.views import docs, table

# the same forms in a standard SQL engine

EDGES = r"'^[\s\x0B\p{Z}]+|[\s\x0B\p{Z}]+$'"


def lines_sql(x: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({x}, '\r?\n'), lambda l: regexp_replace(l, {EDGES}, '', 'g')), lambda l: l <> '')"


def segments_sql(x: str) -> str:
    units = rf"flatten(list_transform({lines_sql(x)}, lambda l: CASE WHEN contains(l, '|') THEN [l] ELSE string_split(regexp_replace(l, '([.!?。！？])[\s\x0B\p{{Z}}]+', '\1' || chr(1), 'g'), chr(1)) END))"
    return f"list_filter(list_transform({units}, lambda u: regexp_replace(u, {EDGES}, '', 'g')), lambda u: u <> '' AND length(u) <= {E.SEGMENT_CHARS})"


def words_sql(x: str) -> str:
    short = " ".join(f"WHEN w = '{k}' THEN {list(v)}" for k, v in E.ALIASES.items())
    return rf"""flatten(list_transform(regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}]+'), lambda w: CASE {short}
      WHEN regexp_matches(w, '^[а-яё]+$') THEN [regexp_replace(w, '^(.{{3,}}?)(?:{'|'.join(E.ENDINGS)})$', '\1')] WHEN length(w) > 4 AND w LIKE '%s' AND w <> 'class' THEN [substr(w, 1, length(w) - 1)] ELSE [w] END))"""


def shown_sql(quote: str, anchor: str) -> str:
    return f"CASE WHEN {anchor} <> '' AND len(list_filter({words_sql(anchor)}, lambda a: NOT list_contains({words_sql(quote)}, a))) > 0 THEN {anchor} || ': ' || {quote} ELSE {quote} END"


def form_sql(x: str, claim: bool = False) -> str:
    token = E.TOKEN.replace("'", "''")
    out = rf"array_to_string(list_transform(regexp_extract_all(regexp_replace(lower(coalesce({x}, '')), '([+-])\s+(\d)', '\1\2', 'g'), '{token}'), lambda t: ' ' || regexp_replace(t, '[''’]s$', '') || ' '), '')"
    for name, forms in E.LABELS.items():
        out = f"regexp_replace({out}, ' (?:{'|'.join(f.replace(' ', '  ') for f in forms)}) ', ' label-{name} ', 'g')"
    for name, forms in E.UNITS.items():
        out = f"regexp_replace({out}, ' (?:{'|'.join(forms)}) ', ' unit-{name} ', 'g')"
    if claim:
        out = rf"regexp_replace({out}, '( label-[a-z]+  {E.NUMBER} )|( {E.NUMBER} )( label-[a-z]+ )', '\1\3\2', 'g')"
    return f"regexp_replace({out}, ' (?:{'|'.join(E.EMPTY_WORDS['en'])}) ', '', 'g')"


@query("g_01_segments", f"SELECT doc_id, 'C1:S' || k AS segment, length(quote) AS n, md5({shown_sql('quote', 'source')}) AS shown_md5 FROM (SELECT doc_id, source, unnest(s) AS quote, unnest(range(1, len(s) + 1)) AS k FROM (SELECT doc_id, source, {segments_sql('text')} AS s FROM documents))")
def g_01(spark, sf):
    """Segments of every document as a model sees them: numbered, each behind its source where it doesn't name it."""
    s = table(spark, sf, "documents").select("doc_id", "source", F.posexplode(E.segments("text")).alias("k", "quote"))
    return s.select("doc_id", F.concat(F.lit("C1:S"), F.col("k") + 1).alias("segment"), F.length("quote").alias("n"), F.md5(E.anchored("quote", "source")).alias("shown_md5"))


@query("g_05_normalized_words", f"SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct, md5(array_to_string(w, ' ')) AS words_md5 FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents)")
def g_05(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", E.plain_words("text").alias("w"))
    return d.select("doc_id", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"), F.md5(F.array_join("w", " ")).alias("words_md5"))


# a conversation's assistant turns are the evidence that a model may select from; its answer is one of seven kinds

ANSWERS = ('{"selections": []}', "I am not sure", '{"selections": ["C1:S1"]}', '{"selections": ["C1:S1", "C99:S1"]}', '```json\n{"selections": ["C1:S1", "C1:S1"]}\n```',
           '{"selections": ["C1:S1", "C1:S2", "C1:S3", "C2:S1", "C2:S2", "C2:S3"]}', '{"selections": ["C1:S1"], "note": "C1:S1"}')


def offered(spark, sf):
    """(question, id, chunk, quote, text): segments of a conversation's assistant turns."""
    t = table(spark, sf, "conversations").where("role = 'assistant'")
    t = t.withColumn("c", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    s = t.select(F.col("conv_id").alias("question"), "c", F.col("turn").alias("chunk"), F.posexplode(E.segments("text")).alias("k", "quote"))
    head = F.concat(F.lit("Talk "), "question")
    return s.select("question", F.concat(F.lit("C"), "c", F.lit(":S"), F.col("k") + 1).alias("id"), "chunk", "quote", E.anchored("quote", head).alias("text"))


def asked(spark, sf):
    """(question, words, raw): what was asked and what a model answered. A third asks for its own first segment's words by subject, a third without."""
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("question")).agg(F.min_by("text", "turn").alias("text"))
    first = offered(spark, sf).where("id = 'C1:S1'").select("question", F.regexp_extract("quote", r"^\S+", 0).alias("word"))
    q, third = F.col("question"), F.col("question") % 3
    words = F.when(third == 0, F.concat(F.lit("What is Talk "), q, F.lit(" "), "word")).when(third == 1, F.col("text")).otherwise(F.concat(F.lit("About "), "word"))
    return c.join(first, "question").select("question", words.alias("words"), F.element_at(F.array(*map(F.lit, ANSWERS)), (q % len(ANSWERS) + 1).cast("int")).alias("raw"))


def resolution(spark, sf):
    a = asked(spark, sf).withColumn("s", E.selected("raw")).select("question", "words", "s.*")
    return E.resolved(a, offered(spark, sf).withColumnRenamed("question", "question"), "question")


OFFERED = f"""turns AS (SELECT conv_id AS question, turn AS chunk, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS c FROM conversations WHERE role = 'assistant'),
 cut AS (SELECT question, chunk, c, unnest(s) AS quote, unnest(range(1, len(s) + 1)) AS k FROM (SELECT *, {segments_sql('text')} AS s FROM turns)),
 offered AS (SELECT question, 'C' || c || ':S' || k AS id, chunk, quote, {shown_sql('quote', "('Talk ' || question)")} AS text FROM cut),
 kind AS (SELECT conv_id AS question, arg_min(text, turn) AS first, conv_id % 7 AS k FROM conversations GROUP BY 1),
 asked AS (SELECT k.question, k.k, CASE k.question % 3 WHEN 0 THEN 'What is Talk ' || k.question || ' ' || regexp_extract(o.quote, '^\\S+') WHEN 1 THEN k.first ELSE 'About ' || regexp_extract(o.quote, '^\\S+') END AS words,
   CASE WHEN k.k IN (2, 4) THEN ['C1:S1'] WHEN k.k = 3 THEN ['C1:S1', 'C99:S1'] ELSE CAST([] AS VARCHAR[]) END AS ids, k.k IN (1, 5, 6) AS rejected, k.k = 4 AS normalized
   FROM kind k JOIN offered o ON o.question = k.question AND o.id = 'C1:S1')"""


@query("g_02_selections", f"WITH {OFFERED} SELECT question, array_to_string(ids, ',') AS ids, normalized, rejected FROM asked")
def g_02(spark, sf):
    """Closed answers of a model read: ids in order, whether that changed them, whether the answer is refused."""
    return asked(spark, sf).withColumn("s", E.selected("raw")).select("question", F.array_join("s.ids", ",").alias("ids"), "s.normalized", "s.rejected")


@query("g_03_resolved", f"WITH {OFFERED} SELECT a.question, CASE WHEN k IN (2, 4) THEN md5(o.text) WHEN k = 3 THEN NULL ELSE md5('') END AS texts FROM asked a JOIN offered o ON o.question = a.question AND o.id = 'C1:S1'")
def g_03(spark, sf):
    """Selected segments looked up all or none; null where an id was not offered to this question."""
    return resolution(spark, sf).select("question", F.md5(F.array_join(F.transform("segments", lambda s: s["text"]), "\n")).alias("texts"))


RELEVANT = f"""shown AS (SELECT a.*, o.text, {words_sql('o.text')} AS have, list_distinct(list_filter({words_sql('a.words')}, lambda w: NOT list_contains({list(E.GLUE)}, w))) AS wanted, ['talk', CAST(a.question AS VARCHAR)] AS subject
   FROM asked a JOIN offered o ON o.question = a.question AND o.id = 'C1:S1'),
 judged AS (SELECT *, len(list_filter(subject, lambda s: NOT list_contains(wanted, s))) = 0 AS named FROM shown),
 rest AS (SELECT *, CASE WHEN named THEN list_filter(wanted, lambda w: NOT list_contains(subject, w)) ELSE wanted END AS others FROM judged),
 relevant AS (SELECT *, len(wanted) > 0 AND (NOT named OR len(list_filter(subject, lambda s: NOT list_contains(have, s))) = 0) AND len(list_filter(others, lambda w: NOT list_contains(have, w))) = 0
   AND len(list_filter(CASE WHEN len(others) > 0 THEN others WHEN named THEN subject ELSE CAST([] AS VARCHAR[]) END, lambda w: list_contains(have, w))) > 0 AS answers FROM rest)"""


def relevance(spark, sf):
    r = resolution(spark, sf)
    texts = F.transform("segments", lambda s: s["text"])
    return r.withColumn("answers", E.answers_query(F.col("words"), texts, F.array(F.concat(F.lit("Talk "), "question"))))


@query("g_04_answers_query", f"WITH {OFFERED}, {RELEVANT} SELECT question, answers FROM relevant WHERE k IN (2, 4)")
def g_04(spark, sf):
    """Whether selected segments answer what was asked."""
    return relevance(spark, sf).where("size(ids) > 0 and segments is not null").select("question", "answers")


@query(
    "g_06_grounded",
    f"""WITH {OFFERED}, {RELEVANT}, firsts AS (SELECT question, min(chunk) AS c1, count(*) AS n FROM (SELECT question, chunk FROM offered GROUP BY ALL) GROUP BY 1),
    reasons AS (SELECT r.*, CASE WHEN rejected OR k = 3 THEN 'malformed_selection' WHEN k = 0 THEN 'no_selection' WHEN NOT answers THEN 'irrelevant_selection' WHEN normalized THEN 'selection_normalized' END AS reason FROM relevant r)
    SELECT question, reason, reason IS NULL AS confident, CASE WHEN reason IS NULL OR reason = 'selection_normalized' THEN md5(text) END AS answer_md5,
      CASE WHEN reason IS NULL OR reason = 'selection_normalized' THEN 1 ELSE least(3, n) END AS citations FROM reasons JOIN firsts USING (question)""",
)
def g_06(spark, sf):
    """Grounded answers: the selected segments where they hold, else the first segments of at most three chunks, with the reason."""
    chunks = offered(spark, sf).groupBy("question", "chunk").agg(F.lit(1).alias("one")).groupBy("question").agg(F.count("one").alias("n"))
    r = relevance(spark, sf).join(chunks, "question", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    reason = E.grounded(F.col("rejected"), F.col("ids"), F.col("segments"), F.coalesce("answers", F.lit(False)), F.col("normalized"), F.col("n"))
    r = r.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull() | (F.col("reason") == "selection_normalized"))
    answer = F.array_join(F.transform("segments", lambda s: s["text"]), "\n\n")
    cited = F.when(F.col("kept"), F.size(F.array_distinct(F.transform("segments", lambda s: F.struct(s["chunk"], s["quote"]))))).otherwise(F.least(F.lit(E.CITATIONS), F.col("n")))
    return r.select("question", "reason", F.col("reason").isNull().alias("confident"), F.when(F.col("kept"), F.md5(answer)).alias("answer_md5"), cited.alias("citations"))


SAID = "CASE reason " + " ".join(f"WHEN '{k}' THEN CASE WHEN question % 2 = 0 THEN '{E.SAID_INSTEAD['en'][k]}' ELSE '{v}' END" for k, v in E.SAID_INSTEAD["ru"].items()) + " END"


@query(
    "g_06_answers",
    f"""WITH {OFFERED}, {RELEVANT}, firsts AS (SELECT question, list(chunk || ':' || md5(quote) ORDER BY chunk)[:3] AS cited FROM (SELECT question, chunk, quote FROM offered WHERE regexp_matches(id, ':S1$')) GROUP BY 1),
    reasons AS (SELECT r.*, CASE WHEN rejected OR k = 3 THEN 'malformed_selection' WHEN k = 0 THEN 'no_selection' WHEN NOT answers THEN 'irrelevant_selection' WHEN normalized THEN 'selection_normalized' END AS reason FROM relevant r)
    SELECT question, reason, CASE WHEN reason IS NULL OR reason = 'selection_normalized' THEN text ELSE {SAID} END AS answer, CASE WHEN reason IS NULL OR reason = 'selection_normalized' THEN (SELECT o.chunk || ':' || md5(o.quote) FROM offered o WHERE o.question = r.question AND o.id = 'C1:S1') ELSE array_to_string(cited, ',') END AS cited
    FROM reasons r JOIN firsts USING (question)""",
)
def g_06_answers(spark, sf):
    """The answer that each question gets, whatever the model said, and what it cites: its segments, or the first ones of the chunks."""
    o = offered(spark, sf)
    n = o.groupBy("question").agg(F.count_distinct("chunk").alias("n"))
    r = relevance(spark, sf).join(n, "question", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    reason = E.grounded(F.col("rejected"), F.col("ids"), F.col("segments"), F.coalesce("answers", F.lit(False)), F.col("normalized"), F.col("n"))
    r = r.withColumn("reason", reason).withColumn("language", F.when(F.col("question") % 2 == 0, "en").otherwise("ru"))
    cited = F.array_join(F.transform("cited", lambda c: F.concat(c["chunk"], F.lit(":"), F.md5(c["quote"]))), ",")
    return E.answered(r, o).select("question", "reason", "answer", cited.alias("cited"))


N = E.SUPPORT_CHARS
PARTS = rf"""flatten(list_transform(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r?\n'), lambda l: regexp_replace(regexp_replace(l, '[\s\x0B\p{{Z}}]+', ' ', 'g'), {EDGES}, '', 'g')), lambda l: l <> ''),
   lambda l: CASE WHEN contains(l, '|') THEN [l] ELSE string_split(regexp_replace(l, '([.!?;]) ', '\1' || chr(1), 'g'), chr(1)) END))"""
CLAIM = f"""claims AS (SELECT item_id, {form_sql("regexp_extract(text, '^((?s:.*?)[.!?])\\s', 1) || CASE WHEN regexp_matches(text, '[.!?]\\s') THEN '' ELSE text END", True)} AS claim FROM benchmark)"""


@query(
    "g_07_supported_claims",
    rf"""WITH {CLAIM}, parts AS (SELECT doc_id, unnest({PARTS}) AS p FROM documents),
     cut AS (SELECT doc_id, unnest(CASE WHEN length(p) <= {N} THEN [p] ELSE regexp_extract_all(p, '(?s)\s*(.{{1,{N}}}$|.{{{N // 2},{N}}} |.{{{N}}})', 1) END) AS s FROM parts),
     forms AS (SELECT doc_id, {form_sql('s')} AS form FROM cut)
     SELECT DISTINCT item_id, doc_id FROM claims JOIN forms ON contains(form, claim) WHERE claim <> '' AND NOT regexp_matches(claim, '^(?: (?:label-[a-z]+|unit-[a-z]+|{E.NUMBER}) )* (?:{'|'.join(E.PRONOUNS['en'])}) ')""",
)
def supported(spark, sf):
    """Claims (first sentences of benchmark texts) that one segment of a document carries whole.

    A claim meets the segments that hold its rarest token, which any supporting one has: an equi-join that loses nothing.
    Segments are known by document and place, so only numbers and tokens are shuffled, and forms of those that meet.
    """
    claims = table(spark, sf, "benchmark").select("item_id", E.claim_form(first_sentence("text", 1_000_000), claim=True).alias("claim")).where(E.bound(F.col("claim"))).distinct()
    checkpoint_dir(spark)
    cut = dealt(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(E.support_segments("text")).alias("at", "s"))
    forms = cut.select("doc_id", "at", E.claim_form("s").alias("form")).checkpoint()  # made once, read three times

    def tokens(c):
        return F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(" ([^ ]+) "), 1))).alias("token")

    of_claims = claims.select("item_id", "claim", tokens("claim"))
    held = forms.select("doc_id", "at", tokens("form")).join(of_claims.select("token").distinct(), "token", "left_semi")
    times = held.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    # a claim with a token that no segment holds has no supporting segment
    rarest = of_claims.join(times, "token", "left").groupBy("item_id", "claim").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    met = held.join(rarest, "token").select("doc_id", "at", "item_id", "claim")
    return met.join(forms, ["doc_id", "at"]).where(F.contains("form", "claim")).select("item_id", "doc_id").distinct()


@query("g_09_messages")
def g_09(spark, sf):
    """Turns of a conversation as messages of bounded size."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    joined = turns.select("conv_id", F.to_json(F.transform("t", lambda x: x["text"])).alias("parts"))

    def page(parts):
        import json

        return [(k, len(m)) for k, m in enumerate(E.messages(json.loads(parts)))]

    return E.rows(joined, page, ["parts"], "message int, n int")


def cited_claims(spark, sf):
    """(claims, cites): the last sentence of each document's first line as a claim. It cites its document; every third the next one too, every fifth only that, every seventh nothing."""
    line = F.substring_index("text", "\n", 1)  # no regex: that looks from each character for the line's end
    ended = F.when(F.endswith(line, F.lit(".")), F.left(line, F.length(line) - 1)).otherwise(line)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("claim_id"), F.substring_index(ended, ".", -1).alias("claim"))
    k = F.col("claim_id")
    chunks = F.when(k % 7 == 0, F.array().cast("array<bigint>")).when(k % 5 == 0, F.array(k + 1)).when(k % 3 == 0, F.array(k, k + 1)).otherwise(F.array(k))
    return d, d.select("claim_id", F.explode(chunks).alias("chunk_id"))


@query(
    "g_07_cited_support",
    rf"""WITH made AS (SELECT doc_id, regexp_extract(regexp_extract(text, '^([^\n]*)', 1), '([^.]*)\.?$', 1) AS claim FROM documents), claims AS (SELECT doc_id AS claim_id, {form_sql('claim', True)} AS form FROM made),
     cites AS (SELECT claim_id, unnest(CASE WHEN claim_id % 7 = 0 THEN CAST([] AS BIGINT[]) WHEN claim_id % 5 = 0 THEN [claim_id + 1] WHEN claim_id % 3 = 0 THEN [claim_id, claim_id + 1] ELSE [claim_id] END) AS chunk_id FROM claims),
     parts AS (SELECT doc_id, unnest({PARTS}) AS p FROM documents),
     cut AS (SELECT doc_id, unnest(CASE WHEN length(p) <= {N} THEN [p] ELSE regexp_extract_all(p, '(?s)\s*(.{{1,{N}}}$|.{{{N // 2},{N}}} |.{{{N}}})', 1) END) AS s FROM parts),
     forms AS MATERIALIZED (SELECT doc_id AS chunk_id, {form_sql('s')} AS f FROM cut),
     kinds AS (SELECT *, form <> '' AND NOT regexp_matches(form, '^(?: (?:label-[a-z]+|unit-[a-z]+|{E.NUMBER}) )* (?:{'|'.join(E.PRONOUNS['en'])}) ') AS bound FROM claims),
     each_ AS (SELECT c.claim_id, c.chunk_id, coalesce(bool_or(contains(f.f, k.form)), false) AS ok FROM cites c JOIN kinds k USING (claim_id) LEFT JOIN forms f USING (chunk_id) WHERE bound GROUP BY ALL),
     division AS (SELECT claim_id, bool_and(ok) AS ok FROM each_ GROUP BY 1),
     judged AS (SELECT k.*, coalesce(ok, false) AS supported, list_filter(string_split(form, ' '), lambda t: t <> '') AS tokens FROM kinds k LEFT JOIN division USING (claim_id)),
     evidence AS (SELECT claim_id, list(DISTINCT t) AS have FROM (SELECT c.claim_id, unnest(string_split(f.f, ' ')) AS t FROM cites c JOIN forms f USING (chunk_id)) GROUP BY 1)
     SELECT j.claim_id, supported, array_to_string(CASE WHEN supported THEN CAST([] AS VARCHAR[]) WHEN NOT bound THEN list_filter(tokens, lambda t: list_contains({list(E.PRONOUNS['en'])}, t)) ELSE list_filter(tokens, lambda t: NOT coalesce(list_contains(have, t), false)) END, ' ') AS unsupported FROM judged j LEFT JOIN evidence e USING (claim_id)""",
)
def g_07_cited(spark, sf):
    """Claims against every chunk that they cite, with the tokens that none of these has."""
    claims, cites = cited_claims(spark, sf)
    got = claim_support(claims, cites, table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))
    return got.withColumn("unsupported", F.array_join("unsupported", " "))


KINDS = (
    ("spell", "\nCasting Time: 1 action"), ("creature", "\nКласс Доспеха: 13\nХиты 11"), ("equipment", "\n| Item | Cost |"), ("class", "\n| Level | Features |\nHit Die: d8"),
    ("species", "\nРаса\nРазмер: средний"), ("equipment", "\nequipment of little cost"), ("feature", "\n3rd-Level Rogue Feature"), ("feat", "\na feat of strength"),
    ("background", "\nпредыстория героя"), ("item", "\nRarity: rare"), ("glossary", "\nRules term"), (None, "\ndefeats a levelled cost"),
)


@query("x_01_chunk_type", "SELECT p_partkey, CASE p_partkey % 12 " + " ".join(f"WHEN {k} THEN {chr(39) + t + chr(39) if t else 'NULL'}" for k, (t, _) in enumerate(KINDS)) + " END AS entry_type FROM part UNION ALL SELECT -1 - doc_id, NULL FROM documents")
def x_01(spark, sf):
    """Types of chunks made from parts, one of each kind in turn, and of the documents, whose invented words name none."""
    body = F.element_at(F.array(*[F.lit(b) for _, b in KINDS]), (F.col("p_partkey") % len(KINDS) + 1).cast("int"))
    made = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("The "), "p_name", body).alias("text"))
    both = made.unionByName(table(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("p_partkey"), "text"))
    return both.select("p_partkey", E.chunk_type("text").alias("entry_type"))


@query("x_03_blocks", "SELECT p_partkey, 'Spell of ' || p_name AS title, p_size || ' actions' AS casting_time, length('Spell of ' || p_name) + 15 AS value_start FROM part")
def x_03(spark, sf):
    """Typed blocks made from parts, parsed back to fields with their spans."""
    text = F.concat(F.lit("Spell of "), "p_name", F.lit("\nCasting Time: "), "p_size", F.lit(" actions\nRange: 60 feet\nComponents: V, S\nDuration: 1 hour"))

    def parse(t):
        b = E.typed_block(t)
        return [(b["title"], b["fields"]["casting_time"][0], b["fields"]["casting_time"][1])] if b else []

    return E.rows(table(spark, sf, "part").select("p_partkey", text.alias("t")), parse, ["t"], "title string, casting_time string, value_start bigint")


@query("x_04_table_rows", "SELECT p_partkey, 'Rope' AS item, p_size || ' gp' AS cost FROM part UNION ALL SELECT p_partkey, p_name, '1/2 gp' FROM part")
def x_04(spark, sf):
    text = F.concat(F.lit("Gear\n| Item | Cost |\n|---|---|\n| Rope | "), "p_size", F.lit(" gp |\n| "), "p_name", F.lit(" | 1/2 gp |\n| broken |\n| late | 1 gp |"))
    return E.rows(table(spark, sf, "part").select("p_partkey", text.alias("t")), lambda t: [(r["Item"], r["Cost"]) for r in E.table_rows(t)], ["t"], "item string, cost string")


@query("x_14_modifiers", "SELECT p_partkey, 'stealth' AS name, p_size AS value FROM part UNION ALL SELECT p_partkey, 'sleight of hand', -1 FROM part")
def x_14(spark, sf):
    text = F.concat(F.lit("Stealth +"), "p_size", F.lit(", Sleight of Hand -1"))
    return E.rows(table(spark, sf, "part").select("p_partkey", text.alias("t")), lambda t: list(E.modifiers(t).items()), ["t"], "name string, value int")


# candidates with one citation a field; of seven kinds of them one is sound, the others break a rule each


@query(
    "x_06_field_citations",
    """SELECT p_partkey, CASE p_partkey % 7 WHEN 1 THEN 'uncited:range' WHEN 2 THEN 'quote:casting_time' WHEN 3 THEN 'unknown:colour' WHEN 4 THEN 'unsupported:range' WHEN 5 THEN 'quote:casting_time,quote:range'
       WHEN 6 THEN 'quote:range,uncited:casting_time' ELSE '' END AS issues FROM part""",
)
def x_06(spark, sf):
    """What is wrong with a candidate's citations: fields not cited, unknown fields, quotes that are not the slice of their span, quotes that don't hold the value."""
    k = F.col("p_partkey") % 7
    head = F.concat(F.lit("Ünïcode 😀 "), "p_name", F.lit("\nCasting Time: "))
    text = F.concat(head, F.col("p_size"), F.lit(" actions\nRange: 60 feet"))
    cast, reach = F.concat("p_size", F.lit(" actions")), F.lit("60 feet")
    at = F.length(head)
    far = at + F.length(cast) + F.length(F.lit("\nRange: "))

    def cite(field, start, quote):
        return F.struct(F.lit(field).alias("field"), start.cast("int").alias("start"), (start + F.length(quote)).cast("int").alias("stop"), quote.alias("quote"))

    casting = F.when(k == 6, None).otherwise(cite("casting_time", F.when(k.isin(2, 5), at + 1).otherwise(at), cast))
    range_ = F.when(k != 1, cite("range", F.when(k.isin(5, 6), far - 1).otherwise(far), reach))
    more = F.when(k == 3, cite("colour", at, cast))
    fields = F.create_map(F.lit("casting_time"), cast, F.lit("range"), F.when(k == 4, F.lit("90 feet")).otherwise(reach))
    p = table(spark, sf, "part").select("p_partkey", text.alias("text"), fields.alias("fields"), F.array_compact(F.array(casting, range_, more)).alias("citations"))
    return p.select("p_partkey", F.array_join(E.citation_issues("text", "fields", "citations"), ",").alias("issues"))


@query(
    "a_09_ingestion_report",
    """SELECT *, CASE WHEN pages = 0 THEN 'failed' WHEN score >= 90 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'acceptable' WHEN score >= 25 THEN 'poor' ELSE 'failed' END AS grade FROM
       (SELECT source_id, pages, with_text, CASE WHEN pages = 0 THEN 0 ELSE greatest(0, 100 - CASE WHEN with_text / pages < 0.5 THEN 30 WHEN with_text / pages < 0.9 THEN 10 ELSE 0 END - least(20, 5 * missing) - CASE WHEN thin > 0 THEN 20 ELSE 0 END - CASE WHEN odd > 0 THEN 5 ELSE 0 END) END AS score
       FROM (SELECT source_id, count(*) AS pages, count(*) FILTER (WHERE length(trim(text)) >= 50) AS with_text, count(*) - count(vec_id) AS missing, count(*) FILTER (WHERE length(trim(text)) < 5) AS thin, count(*) FILTER (WHERE doc_id % 100 = 7) AS odd
             FROM docs LEFT JOIN embeddings ON doc_id = vec_id GROUP BY 1))""",
    ("docs",),
)
def a_09(spark, sf):
    """Ingestion reports by source: coverage, missing vectors, pages that need recognition, skipped pages (every hundredth)."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("has"))
    n, size = F.count(F.lit(1)), F.length(F.trim("text"))
    d = docs(spark, sf).select("doc_id", "source_id", (size >= 50).alias("ok"), (size < 5).alias("thin")).join(e, "doc_id", "left")
    g = d.groupBy("source_id").agg(
        n.alias("pages"), F.count_if("ok").alias("with_text"), (n - F.count("has")).alias("missing"), F.count_if("thin").alias("thin"), F.count_if(F.col("doc_id") % 100 == 7).alias("odd")
    )
    score, grade = E.report(F.col("pages"), F.col("with_text"), F.col("pages"), no_ocr=F.col("thin"), embed_errors=F.col("missing"), skipped=F.col("odd"))
    return g.select("source_id", "pages", "with_text", score.alias("score"), grade.alias("grade"))

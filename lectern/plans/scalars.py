"""Text functions over driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import pages
from lectern.functions import text as T
from lectern.plans.base import chunks_sql, query
from lectern.sources.stores import dealt
from lectern.sources.views import docs, entries, table


@query("t_01_chunks", "WITH RECURSIVE " + chunks_sql("documents", "doc_id") + " SELECT doc_id, source || ':' || lang AS source_id, k AS chunk_index, s AS span_start, e AS span_end, md5(chunk) AS chunk_md5 FROM chunks JOIN documents USING (doc_id) WHERE NOT gone")
def t_01(spark, sf):
    """Chunks of every document; sequential within a document, parallel across documents."""
    return pages.chunked(docs(spark, sf).select("doc_id", "source_id", "text")).select("doc_id", "source_id", "chunk_index", "span_start", "span_end", F.md5("chunk").alias("chunk_md5"))


@query("t_02_clean_quote", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS quote_md5 FROM documents")
def t_02(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.clean_quote("text")).alias("quote_md5"))


SPACE = r"\s\x0B\p{Z}\x{FEFF}"
QUALITY = rf"""tok AS (SELECT doc_id, text, regexp_replace(text, '[{SPACE}]+', '', 'g') AS flat, list_filter(regexp_split_to_array(text, '[{SPACE}]+'), lambda t: regexp_matches(t, '\p{{L}}')) AS words FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
 cores AS (SELECT *, list_transform(words, lambda t: regexp_replace(t, '^[^\p{{L}}]+|[^\p{{L}}]+$', '', 'g')) AS c, list_transform(words, lambda t: regexp_replace(t, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')) AS d FROM tok),
 n AS (SELECT doc_id, text, length(flat) AS visible, len(regexp_extract_all(flat, '\p{{Cyrillic}}')) AS cyr, len(regexp_extract_all(flat, '\p{{Latin}}')) AS lat, len(words) AS w,
   len(regexp_extract_all(flat, '[\x{{0}}-\x{{8}}\x{{B}}\x{{C}}\x{{E}}-\x{{1F}}\x{{7F}}-\x{{9F}}\x{{E000}}-\x{{F8FF}}\x{{FFFD}}]')) AS invalid_glyphs,
   len(list_filter(c, lambda t: length(t) >= 2 AND regexp_matches(t, '^[\p{{L}}\p{{M}}]+(?:[''’\-][\p{{L}}\p{{M}}]+)?$'))) AS well_shaped, len(list_filter(d, lambda t: regexp_matches(t, '[^\p{{L}}\p{{M}}''’\-]'))) AS intruded,
   len(list_filter(words, lambda t: regexp_matches(t, '\p{{Cyrillic}}'))) AS cw, len(list_filter(c, lambda t: length(t) >= 2 AND regexp_matches(t, '^[\p{{Cyrillic}}\p{{M}}]+(?:[''’\-][\p{{Cyrillic}}\p{{M}}]+)?$') AND regexp_matches(t, '[аеёиоуыэюяАЕЁИОУЫЭЮЯ]'))) AS rw FROM cores),
 m AS (SELECT *, cyr + lat AS letters, CASE WHEN visible = 0 THEN 0.0 ELSE (cyr + lat) / visible END AS letter_ratio, well_shaped / greatest(1, ceil(visible / 40)) AS word_evidence, CASE WHEN visible = 0 THEN 0.0 ELSE cyr / visible END AS cyrillic_ratio,
   CASE WHEN w = 0 THEN 0.0 ELSE intruded / w END AS intruded_ratio, CASE WHEN w = 0 THEN 0.0 ELSE well_shaped / w END AS well_shaped_ratio, CASE WHEN cw = 0 THEN 0.0 ELSE rw / cw END AS russian_ratio FROM n),
 r AS (SELECT *, visible >= 120 AND w < 8 AND letter_ratio < 0.12 AS garbage, list_filter([CASE WHEN cyrillic_ratio < 0.22 THEN '{pages.REASONS[0]}' END, CASE WHEN letter_ratio < 0.12 THEN '{pages.REASONS[1]}' END, CASE WHEN intruded_ratio >= 0.25 THEN '{pages.REASONS[2]}' END,
   CASE WHEN well_shaped_ratio < 0.5 THEN '{pages.REASONS[3]}' END, CASE WHEN cw >= 4 AND russian_ratio < 0.45 THEN '{pages.REASONS[4]}' END, CASE WHEN invalid_glyphs > 0 THEN '{pages.REASONS[5]}' END, CASE WHEN visible >= 120 AND w < 8 AND letter_ratio < 0.12 THEN '{pages.REASONS[6]}' END], lambda x: x IS NOT NULL) AS found,
   (lat >= 30 AND lat >= 0.75 * letters AND well_shaped_ratio >= 0.65 AND intruded_ratio < 0.2) OR (cyr < 5 AND lat >= 15 AND regexp_matches(text, '[{{}}\[\];]|=>|===|::|</?[a-zA-Z]')) AS exempt FROM m),
 judged AS (SELECT *, visible >= 80 AND NOT exempt AND (garbage OR len(found) >= 3 OR (invalid_glyphs > 0 AND len(found) >= 2)) AS corrupt FROM r)"""


@query(
    "t_03_page_quality",
    f"WITH {QUALITY} SELECT doc_id, {', '.join(pages.METRICS)}, false AS structured, CASE WHEN corrupt THEN 'corrupt' ELSE 'good' END AS status, CASE WHEN corrupt THEN array_to_string(found, ',') ELSE '' END AS reasons, letters >= greatest(12, ceil(visible * 0.12)) AND well_shaped >= greatest(2, ceil(visible / 500)) AS enough FROM judged",
)
def t_03(spark, sf):
    """Every document judged as a Russian page, so that each of the gate's rules is reached. No document is structured content; ``t_05`` has that."""
    d = dealt(table(spark, sf, "documents").select("doc_id", "text")).withColumn("language", F.lit("ru"))
    return pages.judged(d).drop("language")


@query(
    "t_04_quality_failures",
    f"""WITH {QUALITY}, after AS (SELECT doc_id, corrupt, found, letters >= greatest(12, ceil(visible * 0.12)) AND well_shaped >= greatest(2, ceil(visible / 500)) AS enough FROM judged)
     SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'forced OCR is unavailable' || CASE WHEN doc_id % 8 = 0 THEN ': no tool' ELSE '' END WHEN doc_id % 4 = 1 THEN 'forced OCR produced no replacement text that can be quality-scored'
       WHEN corrupt THEN 'OCR text remains corrupt: ' || array_to_string(found, ', ') || CASE WHEN enough THEN '' ELSE '; forced OCR output has insufficient letter or word evidence' END ELSE 'forced OCR output has insufficient letter or word evidence' END AS reason
     FROM after WHERE doc_id % 4 < 2 OR corrupt OR NOT enough""",
)
def t_04(spark, sf):
    """Why recognition has not mended a page: all documents count as corrupt before; of every four, one was not recognised, one gave no text."""
    d = dealt(table(spark, sf, "documents").select("doc_id", "text")).withColumn("language", F.lit("ru"))
    k = F.col("doc_id")
    after = pages.judged(d).select(
        "doc_id", "status", "reasons", "enough", F.lit(True).alias("was_corrupt"), (k % 4 != 0).alias("available"), (k % 4 > 1).alias("replaced"), F.when(k % 8 == 0, "no tool").alias("note")
    )
    return pages.quality_failures(after).select("doc_id", "reason")


@query("t_05_structured", "SELECT p_partkey, p_partkey % 8 IN (0, 1, 2, 5, 6) AS structured FROM part")
def t_05(spark, sf):
    """Equations, matrices and tables of numbers made from parts, and texts that only look like them."""
    shapes = ("x = {}\ny = f(x, 2) ** 2 + 1", "[[1, 2], [3, {}]]", "name,value\n1,2\n3,{}", "A widget costs {} = much", "x = (1 + {}\ny = [", "1 2 3\n4 5 {}", "a = 1 b = {}", "[[1, 2], [{}]]")
    text = F.element_at(F.array(*[F.lit(s) for s in shapes]), (F.col("p_partkey") % len(shapes) + 1).cast("int"))
    p = table(spark, sf, "part").select("p_partkey", F.replace(text, F.lit("{}"), F.col("p_size").cast("string")).alias("text"))
    return pages.with_structured(p.select("p_partkey", F.when(pages.maybe_structured("text"), F.col("text")).alias("text")), "text", "structured")


@query(
    "t_06_ocr_merge",
    f"WITH {QUALITY} SELECT j.doc_id, CASE WHEN corrupt OR length(d.text) > length(j.text) THEN 'ocr' ELSE 'page' END AS chosen, corrupt AS forced FROM judged j JOIN documents d ON d.doc_id = j.doc_id + 1",
)
def t_06(spark, sf):
    """Recognised text (that of the next document) replaces a page's own if the page is corrupt or the recognised text is longer."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    ru = dealt(d).withColumns({"language": F.lit("ru"), "own": F.length(F.coalesce("text", F.lit("")))})
    forced = pages.judged(ru).select("doc_id", "own", (F.col("status") == "corrupt").alias("forced"))
    other = d.select((F.col("doc_id") - 1).alias("doc_id"), F.length("text").alias("other"))
    chosen = F.when(F.col("forced") | (F.col("other") > F.col("own")), "ocr").otherwise("page")
    return forced.join(other, "doc_id").select("doc_id", chosen.alias("chosen"), "forced")


@query("t_09_normalized_name", r"SELECT entry_id, trim(regexp_replace(lower(trim(title || ' / ' || brand)), '[-_\s.,/:;!?()]+', '-', 'g'), '-') AS name FROM entries", ("entries",))
def t_09(spark, sf):
    return entries(spark, sf).select("entry_id", T.normalize_name(F.concat_ws(" / ", "title", "brand")).alias("name"))


@query("t_10_stable_key", "SELECT doc_id, rtrim(substr(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 128), '-') AS stable_key FROM documents")
def t_10(spark, sf):
    """Latin slugs of whole texts."""
    from lectern.functions.evidence import rows

    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("name"))
    return rows(d, lambda n: [(T.stable_key(n or ""),)], ["name"], "stable_key string")


@query("t_11_canonical_id", "SELECT doc_id, CASE WHEN length('doc-' || text) <= 128 THEN 'doc-' || text ELSE substr('doc-' || text, 1, 111) || '-' || substr(sha256('doc-' || text), 1, 16) END AS canonical_id FROM documents")
def t_11(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.canonical_id(F.lit("doc"), "text").alias("canonical_id"))


@query("t_12_first_sentence", r"SELECT doc_id, substr(regexp_extract(text, '^((?s:.*?)[.!?])\s', 1) || CASE WHEN regexp_matches(text, '[.!?]\s') THEN '' ELSE text END, 1, 240) AS sentence FROM documents")
def t_12(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.first_sentence("text").alias("sentence"))


@query("t_13_money", "SELECT p_partkey, (p_size * 100 + 50) AS worth, p_size + 0.5 AS pounds FROM part")
def t_13(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.col("p_size"), F.lit(" 1/2 gp")).alias("m"), F.concat(F.col("p_size"), F.lit(" 1/2 lb.")).alias("w"))
    return p.select("p_partkey", T.money("m").alias("worth"), T.weight("w").alias("pounds"))


@query("t_14_challenge", "SELECT p_partkey, round(p_size / 8.0, 6) AS quotient, p_size || '/8' AS shown FROM part")
def t_14(spark, sf):
    quotient, shown = T.rational(F.concat(F.col("p_size"), F.lit("/8")))
    return table(spark, sf, "part").select("p_partkey", F.round(quotient, 6).alias("quotient"), shown.alias("shown"))


@query(
    "t_15_deterministic_uuid",
    """SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
       FROM (SELECT p_partkey, sha256('entry' || chr(0) || p_partkey || chr(0) || p_brand) AS h FROM part)""",
)
def t_15(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.deterministic_uuid("entry", "p_partkey", "p_brand").alias("id"))


@query("t_16_content_hash", """SELECT n_nationkey, 'sha256:' || sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS h FROM nation""")
def t_16(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", T.content_hash("n_nationkey", "n_name", "n_regionkey").alias("h"))


@query("t_17_normalisers", "SELECT page_id, lower(trim('  ' || url || ' ')) AS url, regexp_extract(lower(url), '^https?://([^/?#]+)', 1) AS host FROM pages")
def t_17(spark, sf):
    u = F.lower(F.trim(F.concat(F.lit("  "), "url", F.lit(" "))))
    return table(spark, sf, "pages").select("page_id", u.alias("url"), F.regexp_extract(u, r"^https?://([^/?#]+)", 1).alias("host"))


@query(
    "t_18_escape_truncate",
    """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped,
       CASE WHEN length(url) <= 30 THEN url ELSE rtrim(substr(url, 1, 29)) || '…' END AS short FROM pages""",
)
def t_18(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.escape_html("html")).alias("escaped"), T.truncated("url", 30).alias("short"))


@query("t_19_redact", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '([a-zA-Z][a-zA-Z0-9+.-]*://)[^/@\s]+@', '\1[redacted]@', 'g'), '(?i)\b(password|secret|token|api_?key)(\s*[=:]\s*)[^\s,;&]+', '\1\2[redacted]', 'g')) AS h FROM documents")
def t_19(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.redacted("text")).alias("h"))


@query("t_20_zero_pad", "SELECT event_id, lpad(CAST(event_id AS VARCHAR), 32, '0') AS generation FROM events")
def t_20(spark, sf):
    return table(spark, sf, "events").select("event_id", T.zero_padded("event_id").alias("generation"))


@query("t_21_href", "SELECT doc_id, '/sources/' || replace(source_id, ':', '%3A') || CASE WHEN doc_id % 2 = 0 THEN '?page=' || doc_id ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN '&' ELSE '?' END || 'chunk=' || n ELSE '' END AS href FROM docs", ("docs",))
def t_21(spark, sf):
    page, chunk = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")), F.when(F.col("doc_id") % 3 == 0, F.col("n"))
    return docs(spark, sf).select("doc_id", T.citation_href(F.col("source_id"), page, chunk).alias("href"))


@query("t_22_crop", "SELECT p_partkey, CAST(l AS BIGINT) AS l, CAST(t AS BIGINT) AS t, CAST(least(2000, greatest(1, ceil((p_size * 3 + 100) * 200 / 72.0 + 12) - l)) AS BIGINT) AS w, CAST(least(2000, greatest(1, ceil((p_size + 40) * 200 / 72.0 + 12) - t)) AS BIGINT) AS h FROM (SELECT *, greatest(0, floor(p_size * 200 / 72.0 - 12)) AS l, greatest(0, floor(p_size * 2 * 200 / 72.0 - 12)) AS t FROM part)")
def t_22(spark, sf):
    s = F.col("p_size")
    l, t, w, h = T.crop_box(s, s * 2, s * 3 + 100, s + 40)
    return table(spark, sf, "part").select("p_partkey", *[x.cast("long").alias(n) for x, n in ((l, "l"), (t, "t"), (w, "w"), (h, "h"))])


@query("f_02_normalized_aliases", r"SELECT entry_id, trim(regexp_replace(lower(alias), '[-_\s.,/:;!?()]+', '-', 'g'), '-') || ',' || trim(regexp_replace(lower(canonical_key), '[-_\s.,/:;!?()]+', '-', 'g'), '-') AS aliases FROM entries", ("entries",))
def f_02(spark, sf):
    names = F.transform(F.array("alias", "canonical_key"), lambda a: T.normalize_name(a))
    return entries(spark, sf).select("entry_id", F.array_join(names, ",").alias("aliases"))


@query("f_03_typed_number", """SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events""")
def f_03(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"))


@query("src_05_page_text")
def src_05(spark, sf):
    """Visible text of each page: scripts and styles dropped, blocks on lines of their own, blanks collapsed."""
    from lectern.sources.html import page_texts

    return page_texts(table(spark, sf, "pages")).select("page_id", "title", F.length("body").alias("n"), F.md5("body").alias("body_md5"))


@query("src_08_bounded", "SELECT doc_id FROM documents WHERE strlen(text) <= 2000")
def src_08(spark, sf):
    return table(spark, sf, "documents").where(F.octet_length("text") <= 2000).select("doc_id")


@query(
    "src_09_snapshot_gate",
    "SELECT lang, CASE WHEN count(*) = count(l.doc_id) THEN 'complete' WHEN count(l.doc_id) > 0 THEN 'partial' ELSE 'failed' END AS status FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1",
)
def src_09(spark, sf):
    n, have = F.count(F.lit(1)), F.count("has")
    j = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    return j.groupBy("lang").agg(F.when(n == have, "complete").when(have > 0, "partial").otherwise("failed").alias("status"))


@query("src_10_failures", "SELECT user_id, CASE WHEN value < 10 THEN 'fetch' ELSE 'parse' END AS phase, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2")
def src_10(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'error'")
    return e.groupBy("user_id", F.when(F.col("value") < 10, "fetch").otherwise("parse").alias("phase")).agg(F.count(F.lit(1)).alias("n"))

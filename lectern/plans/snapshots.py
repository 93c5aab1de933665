"""Collected pages: their cards, and guides that quote texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import guides as G
from lectern.operators import snapshots as S
from lectern.plans.base import query
from lectern.sources import cards
from lectern.sources.stores import checkpoint_dir
from lectern.sources.views import docs, table


def carded(spark, sf):
    """Pages whose article is made a card: with a title, boilerplate and unsafe parts; of ten one has another id, one no title, one a root that isn't allowed."""
    k = F.col("page_id")
    other = F.when(k % 10 == 3, "lore:0").otherwise(F.concat(F.lit("lore:"), k))
    head = F.concat(
        F.when(k % 10 == 6, '<p class="card" data-id="').otherwise('<div class="wide card" data-id="'), other, F.lit('" onclick="x()"><nav><p>menu</p></nav><h2 class="card-title">'),
        F.when(k % 10 == 7, F.lit(" ")).otherwise(F.concat(F.lit("Page <i>n</i> "), k)), F.lit('</h2><div class="comments"><p>first!</p></div><custom>in <b>custom</b></custom><a href="javascript:x()">bad</a> <a href="/ok?a=1&amp;b" style="x">good</a><script>var t="</p>";</script>'),
    )
    body = F.replace(F.replace("html", F.lit("<article>"), head), F.lit("</article>"), F.when(k % 10 == 6, "</p>").otherwise("</div><p>after</p>"))
    return table(spark, sf, "pages").select("page_id", body.alias("html"), F.lit("lore").alias("category"), k.cast("string").alias("external_id"))


@query(
    "src_05_details",
    r"""WITH inner_ AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS body FROM pages),
     spaced AS (SELECT page_id, regexp_replace(regexp_replace(body, '<br>|</?p>|</h1>', chr(10), 'g'), '</?b>|<h1>', '', 'g') AS t FROM inner_),
     plain AS (SELECT page_id, 'Page n ' || page_id || chr(10) || 'in custombad good' || replace(replace(t, '&quot;', '"'), '&amp;', '&') AS t FROM spaced),
     lines AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x <> '') AS l FROM plain)
     SELECT page_id, CASE page_id % 10 WHEN 3 THEN 'no card' WHEN 6 THEN 'root not allowed' WHEN 7 THEN 'no content' END AS problem, CASE WHEN page_id % 10 NOT IN (3, 6, 7) THEN 'Page n ' || page_id END AS title, CASE WHEN page_id % 10 NOT IN (3, 6, 7) THEN md5(array_to_string(l, chr(10))) END AS text_md5 FROM lines""",
)
def src_05_details(spark, sf):
    """The wanted card of every page: its title and text, or why there is none."""
    return cards.card_details(carded(spark, sf)).select("page_id", "problem", "title", F.md5("text").alias("text_md5"))


@query(
    "x_09_guide_blocks",
    """WITH told AS (SELECT doc_id, text, unnest([{'id': 'middle', 'quote': substr(text, length(text) // 3 + 1, 60)}, {'id': 'end', 'quote': substr(text, greatest(length(text) - 19, 1))}, {'id': 'word', 'quote': regexp_extract(text, '[^ ]+')}, {'id': 'twice', 'quote': substr(text, 1, 30)},
      {'id': 'twice', 'quote': 'a'}, {'id': 'Bad id', 'quote': 'a'}, {'id': 'blank', 'quote': '  '}, {'id': 'absent', 'quote': '~' || doc_id || '~'}]) AS b FROM documents),
     seen AS (SELECT doc_id, b.id AS block, b.quote AS quote, strpos(text, b.quote) AS first, text FROM told)
     SELECT doc_id AS guide_id, block, md5(quote) AS quote_md5, CASE WHEN problem IS NULL THEN CAST(first - 1 AS BIGINT) END AS start, CASE WHEN problem IS NULL THEN CAST(first - 1 + length(quote) AS BIGINT) END AS "end", problem FROM (SELECT *, CASE WHEN block = 'Bad id' THEN 'unstable id' WHEN block = 'twice' THEN 'repeated id' WHEN trim(quote) = '' THEN 'blank quote'
       WHEN first = 0 THEN 'not found' WHEN strpos(substr(text, first + 1), quote) > 0 THEN 'ambiguous' END AS problem FROM seen)""",
)
def x_09(spark, sf):
    """Blocks that quote every document, of which some are not there, or more than once."""
    def block(name, quote):
        return F.struct(F.lit(name).alias("id"), quote.alias("quote"))

    made = F.array(
        block("middle", F.expr("substring(text, int(length(text) div 3) + 1, 60)")), block("end", F.expr("substring(text, int(greatest(length(text) - 19, 1)))")), block("word", F.regexp_extract("text", "[^ ]+", 0)), block("twice", F.substring("text", 1, 30)),
        block("twice", F.lit("a")), block("Bad id", F.lit("a")), block("blank", F.lit("  ")), block("absent", F.concat(F.lit("~"), "doc_id", F.lit("~"))),
    )
    guides = table(spark, sf, "documents").select(F.col("doc_id").alias("guide_id"), "text", made.alias("blocks"))
    return G.quoted_blocks(guides).withColumn("quote_md5", F.md5("quote")).drop("quote")


#: A page's metadata by page_id % 6, as SQL that both engines run.
METADATA = """CASE page_id % 6
 WHEN 0 THEN '{"hit_die":"d' || CASE page_id % 5 WHEN 0 THEN '6' WHEN 1 THEN '8' WHEN 2 THEN '10' WHEN 3 THEN '12' ELSE '20' END || '","primary_ability":" Dex ","parent_class_ids":' || CASE WHEN page_id % 4 = 0 THEN 'null' ELSE '["' || CAST(page_id - 6 AS STRING) || '"]' END
   || ',"features":[{"canonicalId":"feature-' || CAST(page_id AS STRING) || '","title":"Gain","body":"More","level":' || CAST(page_id % 25 AS STRING) || ',"anchor":"gain"}],"cross_links":["species-' || CAST(page_id + 1 AS STRING) || '","7"]}'
 WHEN 1 THEN '{"size":"Large","speed":' || CAST(page_id % 40 AS STRING) || ',"parentSpeciesIds":' || CASE WHEN page_id % 4 = 1 THEN '[]' ELSE '"species-' || CAST(page_id - 12 AS STRING) || '"' END || ',"crossLinks":["class-' || CAST(page_id - 1 AS STRING) || '"],"traits":[]}'
 WHEN 2 THEN '{"level":' || CAST(page_id % 12 AS STRING) || ',"school":"Evocation","casting_time":"1 action","range":" ","duration":"1 hour","components":"V","ritual":true}'
 WHEN 3 THEN '{"size":"tiny","creature_type":"beast","armor_class":' || CAST(page_id % 60 AS STRING) || ',"hit_points":9,"challenge_rating":0.25,"speed":"30 ft."}'
 WHEN 4 THEN '{"category":"Weapon","cost_cp":' || CAST(page_id AS STRING) || ',"colour":"red"}' ELSE 'no json' END"""


def details(spark, sf):
    """Pages as collected details; their language is that of the address, of which all are one source."""
    p = table(spark, sf, "pages")
    kinds = F.element_at(F.array(*[F.lit(c) for c in ("class", "species", "spells", "bestiary", "equipment", "maps")]), (F.col("page_id") % 6 + 1).cast("int"))
    return p.select(
        F.col("page_id").cast("string").alias("external_id"), kinds.alias("category"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.lit("text").alias("body"), F.expr(METADATA).alias("metadata"),
        F.lit("snapshot").alias("source_id"), F.lit("5.5e").alias("edition"), F.regexp_extract("url", "//[^/]*/([a-z]+)", 1).alias("language"),
    )


DETAILS = f"""meta AS (SELECT page_id AS k, page_id % 6 AS form, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '//[^/]*/([a-z]+)', 1) AS language, {METADATA} AS metadata FROM pages),
 kinds AS (SELECT *, ['class', 'species', 'spell', 'creature', 'equipment', NULL][form + 1] AS type, CASE WHEN form < 5 THEN json(metadata) END AS m FROM meta)"""


@query(
    "x_08_typed",
    f"""WITH {DETAILS} SELECT type || '-' || k AS entry_id, type, CAST(k AS VARCHAR) AS external_id, language, array_to_string(list_sort(list_filter([CASE WHEN title = '' THEN '$.title text' END, CASE WHEN type IS NULL THEN '$.category choice' END,
     CASE WHEN form = 0 AND NOT regexp_matches(m->>'hit_die', '(6|8|10|12)') THEN '$.attributes.hitDie choice' END, CASE WHEN form = 0 AND CAST(m->'features'->0->>'level' AS INTEGER) NOT BETWEEN 1 AND 20 THEN '$.attributes.features[0].level number' END,
     CASE WHEN form = 1 AND CAST(m->>'speed' AS INTEGER) < 1 THEN '$.attributes.speed number' END, CASE WHEN form = 2 AND CAST(m->>'level' AS INTEGER) > 9 THEN '$.attributes.level number' END, CASE WHEN form = 2 AND trim(m->>'range') = '' THEN '$.attributes.range text' END,
     CASE WHEN form = 3 AND CAST(m->>'armor_class' AS INTEGER) NOT BETWEEN 1 AND 50 THEN '$.attributes.armorClass number' END], lambda x: x IS NOT NULL)), ';') AS issues,
     CASE form WHEN 0 THEN CASE WHEN m->>'parent_class_ids' IS NULL THEN 'class' ELSE 'subclass' END WHEN 1 THEN CASE WHEN m->>'parentSpeciesIds' = '[]' THEN 'species' ELSE 'variant' END END AS kind FROM kinds""",
)
def x_08_typed(spark, sf):
    """Typed candidates of all details, with the paths that break their schema."""
    told = F.array_join(F.transform("issues", lambda i: F.concat_ws(" ", i["path"], i["rule"])), ";")
    return S.typed(details(spark, sf)).select("entry_id", "type", "external_id", "language", told.alias("issues"), F.get_json_object("attributes", "$.kind").alias("kind"))


@query(
    "x_08_links",
    f"""WITH {DETAILS}, wanted AS (SELECT type || '-' || k AS entry_id, language, 'parent' AS relation, CASE form WHEN 0 THEN 'class-' || (m->'parent_class_ids'->>0) ELSE m->>'parentSpeciesIds' END AS target, 0 AS position FROM kinds WHERE (form = 0 AND m->>'parent_class_ids' IS NOT NULL) OR (form = 1 AND m->>'parentSpeciesIds' <> '[]')
     UNION ALL SELECT type || '-' || k, language, 'feature', m->'features'->0->>'canonicalId', 0 FROM kinds WHERE form = 0 UNION ALL SELECT type || '-' || k, language, 'cross_link', m->'cross_links'->>0, 0 FROM kinds WHERE form = 0
     UNION ALL SELECT type || '-' || k, language, 'cross_link', m->'cross_links'->>1, 1 FROM kinds WHERE form = 0 UNION ALL SELECT type || '-' || k, language, 'cross_link', m->'crossLinks'->>0, 0 FROM kinds WHERE form = 1),
     known AS (SELECT language, type || '-' || k AS target FROM kinds WHERE type IS NOT NULL UNION ALL SELECT language, m->'features'->0->>'canonicalId' FROM kinds WHERE form = 0)
     SELECT w.entry_id, w.language, relation, w.target, position, CASE WHEN k.target IS NULL THEN 'unresolved' ELSE 'resolved' END AS state FROM wanted w LEFT JOIN (SELECT DISTINCT * FROM known) k ON k.language = w.language AND k.target = w.target""",
)
def x_08_links(spark, sf):
    """Links of classes and species to parents, features and others of their source, edition and language."""
    checkpoint_dir(spark)
    return S.links(S.typed(details(spark, sf)).checkpoint()).select("entry_id", "language", "relation", "target", "position", "state")


@query(
    "f_12_readable_guides",
    "SELECT 'doc-' || doc_id AS slug, language AS locale, reader FROM docs JOIN (SELECT l.lang, r.role || '-' || l.lang AS reader, r.role FROM (SELECT unnest(['user', 'premium', 'admin']) AS role) r, (SELECT unnest(['en', 'de']) AS lang) l) ON lang = language WHERE access_tier = 'open' OR role IN ('premium', 'admin')",
    ("docs",),
)
def f_12(spark, sf):
    """The documents as guides, by who may read them: three roles in two locales."""
    readers = spark.createDataFrame([(f"{r}-{lang}", r, lang) for r in ("user", "premium", "admin") for lang in ("en", "de")], "reader string, role string, locale string")
    guides = docs(spark, sf).select(F.concat(F.lit("doc-"), "doc_id").alias("slug"), F.col("language").alias("locale"), "access_tier")
    return G.readable_guides(guides, readers).select("slug", "locale", "reader")

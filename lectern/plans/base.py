"""Registration of queries, and the shared views as SQL for their counterparts."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: The derived views of ``lectern.sources.views``, as common table expressions of a standard SQL engine.
VIEWS = {
    "docs": """SELECT doc_id, text, lang AS language, source || ':' || lang AS source_id, CAST(substr(source, 4) AS INTEGER) AS n,
        CASE CAST(substr(source, 4) AS INTEGER) % 4 WHEN 2 THEN 'premium' WHEN 3 THEN 'personal' ELSE 'open' END AS access_tier,
        CAST(substr(source, 4) AS INTEGER) % 4 = 2 AS is_shared,
        CASE WHEN CAST(substr(source, 4) AS INTEGER) % 4 = 3 THEN 'u' || CAST(substr(source, 4) AS INTEGER) END AS owner_id,
        CASE WHEN (CAST(substr(source, 4) AS INTEGER) // 4) % 2 = 0 THEN '5.5e' ELSE '5e' END AS edition,
        CASE CAST(substr(source, 4) AS INTEGER) % 3 WHEN 0 THEN 'core_rules' WHEN 1 THEN 'official_supplement' ELSE 'homebrew' END AS category,
        10 * CAST(substr(source, 4) AS INTEGER) AS priority,
        CASE WHEN doc_id % 10 = 9 THEN 'archived' ELSE 'active' END AS generation,
        CAST(substr(source, 4) AS INTEGER) = 19 AS is_deleted FROM documents""",
    "src": """SELECT DISTINCT source_id, n, language, access_tier, is_shared, owner_id, edition, category, priority, is_deleted FROM docs""",
    "visible": """SELECT * FROM docs WHERE generation = 'active' AND NOT is_deleted
        AND (access_tier = 'open' OR (access_tier = 'premium' AND is_shared) OR (access_tier = 'personal' AND owner_id = 'u3'))""",
    "entries": """SELECT p_partkey AS entry_id, 'part-' || p_partkey AS canonical_key, p_name AS title,
        CASE p_partkey % 4 WHEN 0 THEN 'spell' WHEN 1 THEN 'feat' WHEN 2 THEN 'item' ELSE 'glossary' END AS entry_type,
        CASE WHEN p_partkey % 5 = 4 THEN '5e' ELSE '5.5e' END AS edition, p_size % 10 AS level, lower(p_type) AS school, p_brand AS brand,
        p_retailprice AS cost, p_size % 2 = 0 AS ritual, 'A' || p_partkey AS alias FROM part""",
    "offers": """SELECT l_partkey AS entry_id, l_suppkey AS source_no, max(l_shipdate) AS published_at, count(*) AS n_lines FROM lineitem GROUP BY 1, 2""",
    "versions": """SELECT o.entry_id, o.source_no, o.entry_id || ':' || o.source_no AS version_id, o.published_at, CAST(floor(s.s_acctbal / 10) AS INTEGER) AS priority,
        CASE WHEN s.s_nationkey % 2 = 0 THEN 'en' ELSE 'ru' END AS language, CASE s.s_suppkey % 4 WHEN 2 THEN 'premium' WHEN 3 THEN 'personal' ELSE 'open' END AS access_tier,
        s.s_nationkey AS nation FROM offers o JOIN supplier s ON o.source_no = s.s_suppkey""",
    "passages": """SELECT doc_id, i - 1 AS idx, p AS passage, source_id, access_tier, language, edition, category, generation FROM
        (SELECT *, unnest(parts) AS p, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS parts FROM docs))""",
}
NEEDS = {"src": ["docs"], "visible": ["docs"], "versions": ["offers"], "passages": ["docs"]}


def with_views(*names: str) -> str:
    """``WITH`` of the named views and of those they are made from."""
    order: list[str] = []
    for name in names:
        for n in [*NEEDS.get(name, []), name]:
            if n not in order:
                order.append(n)
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in order) + " "


def chunks_sql(source: str, key: str) -> str:
    """Recursive CTEs ``walk`` and ``chunks`` (key, k, s, e, chunk): the chunks of ``source`` (unique key, text) by the rules of ``pages.spans``; rows with gone are no chunks."""
    window = "substr(text, place + 1, 1000)"

    def last(mark: str, size: int) -> str:
        """Place of the last ``mark`` in the window of 1,000, -1 if there is none."""
        return f"(CASE WHEN strpos(reverse({window}), {mark}) = 0 THEN -1 ELSE 1000 - strpos(reverse({window}), {mark}) - {size - 1} END)"

    blank, line, stop = last("chr(10) || chr(10)", 2), last("chr(10)", 1), last("' .'", 2)
    size = f"CASE WHEN {blank} >= 500 THEN {blank} + 2 WHEN {line} >= 500 THEN {line} + 1 WHEN {stop} >= 300 THEN {stop} + 2 ELSE 1000 END"
    stripped = r"regexp_replace(piece, '^\s+|\s+$', '', 'g')"
    return rf"""walk AS (SELECT {key}, text, length(text) AS n, 0 AS place, 0 AS step, CASE WHEN length(text) <= 1000 THEN NULL ELSE {size.replace('place + 1', '1')} END AS size FROM {source} WHERE regexp_matches(text, '\S')
   UNION ALL SELECT {key}, text, n, place, step, CASE WHEN place + 1000 >= n THEN NULL ELSE {size} END FROM (SELECT {key}, text, n, place + greatest(size - 200, 1) AS place, step + 1 AS step FROM walk WHERE size IS NOT NULL) WHERE place < n),
 pieces AS (SELECT {key}, n, step, place AS s, coalesce(place + size, n) AS e, size IS NULL AS tail, substr(text, place + 1, coalesce(size, n - place)) AS piece FROM walk),
 told AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY step) - 1 AS k, count(*) OVER (PARTITION BY {key}) AS held, tail AND length({stripped}) < 100 AS short FROM pieces WHERE regexp_matches(piece, '\S')),
 chunks AS (SELECT {key}, k, s, CASE WHEN lead(short) OVER w THEN n ELSE e END AS e, CASE WHEN lead(short) OVER w THEN piece || chr(10) || lead(piece) OVER w ELSE piece END AS chunk, short AND held > 1 AS gone FROM told WINDOW w AS (PARTITION BY {key} ORDER BY step))"""


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Registers a query under ``name`` and, where given, its SQL over ``views``."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            text = sql.strip()
            if views:
                head = with_views(*views)
                text = head.rstrip() + ", " + text[5:] if text.upper().startswith("WITH ") else head + text
                if text.upper().count("RECURSIVE") and not text.upper().startswith("WITH RECURSIVE"):
                    text = text.replace("WITH ", "WITH RECURSIVE ", 1).replace(", RECURSIVE ", ", ")
            ORACLES[name] = text
        return f

    return keep

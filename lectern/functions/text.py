"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, also where ``f`` uses it inside of other lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def normalize_name(c: str | Column) -> Column:
    """Trimmed, lower-cased, runs of separators as one hyphen, none at the ends. Callers compose NFC where input may be decomposed."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(c))), r"[-_\s.,/:;!?()]+", "-"), r"^-+|-+$", "")


def clean_quote(c: str | Column) -> Column:
    """CRLF to LF, three or more line feeds to two, runs of blanks and tabs to one blank, trimmed."""
    x = F.regexp_replace(col(c), "\r\n", "\n")
    x = F.regexp_replace(x, "\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), r"^\s+|\s+$", "")


def first_sentence(c: str | Column, limit: int = 240) -> Column:
    """Up to the first sentence mark that white space follows, cut to ``limit`` characters."""
    return F.substring(F.regexp_extract(col(c), r"^([\s\S]*?[.!?](?=\s)|[\s\S]*)", 1), 1, limit)


def tokens(c: str | Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(col(c)), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def fraction(c: str | Column) -> Column:
    """'3', '1,000', '1/2' or '1 1/2' as a double; null for anything else."""
    x = F.regexp_replace(F.trim(col(c)), ",", "")
    whole = F.regexp_extract(x, r"^(\d+)(?:\s+\d+/\d+)?$", 1)
    top, bottom = F.regexp_extract(x, r"^(?:\d+\s+)?(\d+)/(\d+)$", 1), F.regexp_extract(x, r"^(?:\d+\s+)?(\d+)/(\d+)$", 2)
    part = F.when((top != "") & (bottom.cast("double") != 0), top.cast("double") / bottom.cast("double"))
    return F.when(F.rlike(x, F.lit(r"^\d+$")), x.cast("double")).when(
        F.rlike(x, F.lit(r"^(\d+\s+)?\d+/\d+$")), F.coalesce(F.when(whole != "", whole.cast("double")), F.lit(0.0)) + part
    )


#: Worth of each coin in the smallest one.
COINS = {"cp": 1, "sp": 10, "gp": 100, "pp": 1000, "мм": 1, "см": 10, "зм": 100, "пм": 1000}


def money(c: str | Column) -> Column:
    """An amount with its coin, as a number of the smallest coin (long); null if unreadable or not whole."""
    x = F.lower(F.trim(col(c)))
    amount = fraction(F.regexp_extract(x, r"^([\d,]+(?:\s+\d+/\d+)?|\d+/\d+)\s*\p{L}+\.?$", 1))
    coin = F.regexp_extract(x, r"(\p{L}+)\.?$", 1)
    worth = F.lit(None).cast("double")
    for k, v in COINS.items():
        worth = F.when(coin == k, float(v)).otherwise(worth)
    value = amount * worth
    return F.when(value == F.floor(value), value.cast("long"))


def weight(c: str | Column) -> Column:
    """Pounds of '1 1/2 lb.' and the like; null if unreadable."""
    return fraction(F.regexp_extract(F.lower(F.trim(col(c))), r"^([\d,]+(?:\s+\d+/\d+)?|\d+/\d+)\s*(?:lbs?|pounds?|фнт)\.?$", 1))


def rational(c: str | Column) -> tuple[Column, Column]:
    """(quotient, display 'n/d' or 'n') of a challenge such as '1/4' or '12'."""
    x = F.trim(col(c))
    return fraction(x), F.when(F.rlike(x, F.lit(r"^\d+(/\d+)?$")), F.regexp_replace(x, "/1$", ""))


def deterministic_uuid(namespace: str, *parts: str | Column) -> Column:
    """A version-5-shaped id from SHA-256 of the NUL-joined namespace and parts."""
    h = F.sha2(F.concat_ws("\x00", F.lit(namespace), *[col(p).cast("string") for p in parts]).cast("binary"), 256)
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def content_hash(*columns: str) -> Column:
    """'sha256:' and the hash of the row as JSON with its keys in sorted order; nulls stay as null."""
    body = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return F.concat(F.lit("sha256:"), F.sha2(body, 256))


def canonical_id(entry_type: str | Column, key: str | Column, limit: int = 128) -> Column:
    """'type-key'; past ``limit`` characters, cut and ended by a hash of the whole."""
    whole = F.concat_ws("-", col(entry_type), col(key))
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(F.substring(whole, 1, limit - 17), F.lit("-"), F.substring(F.sha2(whole, 256), 1, 16)))


def escape_html(c: str | Column) -> Column:
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def truncated(c: str | Column, limit: int) -> Column:
    """At most ``limit`` characters, the last an ellipsis if anything was cut."""
    return F.when(F.length(col(c)) <= limit, col(c)).otherwise(F.concat(F.rtrim(F.substring(col(c), 1, limit - 1)), F.lit("…")))


def redacted(c: str | Column) -> Column:
    """URL credentials and values of sensitive keys replaced."""
    x = F.regexp_replace(col(c), r"([a-zA-Z][a-zA-Z0-9+.-]*://)[^/@\s]+@", "$1[redacted]@")
    return F.regexp_replace(x, r"(?i)\b(password|secret|token|api_?key)(\s*[=:]\s*)[^\s,;&]+", "$1$2[redacted]")


def zero_padded(c: str | Column, width: int = 32) -> Column:
    return F.lpad(col(c).cast("string"), width, "0")


def citation_href(source: str | Column, page: str | Column, chunk: str | Column) -> Column:
    """/sources/<id> with page and chunk as query arguments where given."""
    args = F.concat_ws("&", F.when(col(page).isNotNull(), F.concat(F.lit("page="), col(page))), F.when(col(chunk).isNotNull(), F.concat(F.lit("chunk="), col(chunk))))
    path = F.concat(F.lit("/sources/"), F.url_encode(col(source)))
    return F.when(args != "", F.concat(path, F.lit("?"), args)).otherwise(path)


def crop_box(x1, y1, x2, y2, padding: int = 12, scale: float = 200 / 72, limit: int = 2000):
    """(left, top, width, height) in pixels of a padded box in points: widths clamped to 1..limit."""
    left, top = F.greatest(F.lit(0), F.floor(x1 * scale - padding)), F.greatest(F.lit(0), F.floor(y1 * scale - padding))
    wide, high = F.ceil(x2 * scale + padding) - left, F.ceil(y2 * scale + padding) - top
    return left, top, F.least(F.lit(limit), F.greatest(F.lit(1), wide)), F.least(F.lit(limit), F.greatest(F.lit(1), high))


#: Latin letters for the Cyrillic alphabet, in its order.
CYRILLIC = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
LATIN = "a b v g d e e zh z i i k l m n o p r s t u f kh ts ch sh shch  y  e yu ya".split(" ")


class _Plain(dict):
    """What each character becomes in a key, by code point; worked out once for each that is met."""

    def __missing__(self, n: int) -> str:
        import unicodedata

        self[n] = "".join(x for x in unicodedata.normalize("NFKD", chr(n)) if not unicodedata.combining(x))
        return self[n]


PLAIN = _Plain((ord(a), b) for a, b in zip(CYRILLIC, LATIN))


def stable_key(name: str, limit: int = 128) -> str:
    """A slug of Latin letters and digits: compatibility decomposition without marks, lower case, Cyrillic transliterated, other runs as hyphens."""
    import re
    import unicodedata

    letters = unicodedata.normalize("NFC", name).lower().translate(PLAIN)
    return re.sub(r"[^a-z0-9]+", "-", letters.lower()).strip("-")[:limit].rstrip("-")


def unaccented() -> tuple[str, str]:
    """Composed Latin letters and the plain letter that each decomposes to, by Unicode's tables."""
    import unicodedata

    pairs = [(chr(n), unicodedata.normalize("NFKD", chr(n))) for n in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    plain = [(c, "".join(x for x in d if not unicodedata.combining(x))) for c, d in pairs]
    held = [(c, d.lower()) for c, d in plain if len(d) == 1 and d.isascii() and c != d]
    return "".join(c for c, _ in held), "".join(d for _, d in held)


def stable_slug(c: str | Column, limit: int = 128) -> Column:
    """``stable_key`` of composed text in Latin and Cyrillic letters, without Python."""
    x = F.lower(col(c))
    for a, b in zip(CYRILLIC, LATIN):
        if len(b) > 1:
            x = F.replace(x, F.lit(a), F.lit(b))
    single = [(a, b) for a, b in zip(CYRILLIC, LATIN) if len(b) == 1]
    accents, letters = unaccented()
    x = F.translate(x, "".join(a for a, _ in single) + accents, "".join(b for _, b in single) + letters)
    silent = "".join(a for a, b in zip(CYRILLIC, LATIN) if not b)
    x = F.regexp_replace(F.translate(x, silent, ""), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(x, "^-+|-+$", ""), 1, limit), "-+$", "")


def snippet(text: str, words: list[str], fragments: int = 2, width: int = 35) -> str:
    """Up to ``fragments`` runs of at most ``width`` words that hold the most wanted words, in text order, wanted words in [[ ]]; the beginning if none is held."""
    import re

    spans = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"\w+", text)]
    wanted = set(words)
    hits = [k for k, s in enumerate(spans) if s[2] in wanted]
    chosen: list[tuple[int, int]] = []
    free = list(hits)
    while free and len(chosen) < fragments:
        start = max(free, key=lambda k: (sum(k <= h < k + width for h in free), -k))
        chosen.append((start, min(start + width, len(spans))))
        free = [h for h in free if not start <= h < start + width and not start - width < h < start]
    if not chosen and spans:
        chosen = [(0, min(width, len(spans)))]
    out = []
    for a, b in sorted(chosen):
        at, piece = spans[a][0], ""
        for s, e, w in spans[a:b]:
            piece += text[at:s] + (f"[[{text[s:e]}]]" if w in wanted else text[s:e])
            at = e
        out.append(piece)
    return " ... ".join(out)

"""Evidence as Columns: segments, words, selections, answers, support of claims. Typed blocks of text as row functions, and their Arrow form ``rows``.

Texts are taken as composed (NFC); callers compose where input may not be.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import col, let

#: Longest selectable segment, longest segment of a support check, most selections, most citations, message size.
SEGMENT_CHARS = 600
SUPPORT_CHARS = 800
SELECTIONS = 5
CITATIONS = 3
MESSAGE_CHARS = 3996
NUMBER = r"[-+]?\d+(?:[.,]\d+)?(?:/\d+)?"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def lines(c: str | Column) -> Column:
    """The lines of a text that are not blank, trimmed."""
    return F.filter(F.transform(F.split(col(c), r"\r?\n"), stripped), lambda x: x != "")


def segments(c: str | Column, limit: int = SEGMENT_CHARS) -> Column:
    """Array of the selectable pieces of a text: table rows whole, other lines by sentence. Pieces past ``limit`` are left out, never cut."""
    units = F.flatten(F.transform(lines(c), lambda x: F.when(F.contains(x, F.lit("|")), F.array(x)).otherwise(F.split(x, r"(?<=[.!?。！？])[\s\p{Z}]+"))))
    return F.filter(F.transform(units, stripped), lambda x: (x != "") & (F.length(x) <= limit))


#: Words that stand for others, words of a question that ask for nothing, and Russian endings, longest first.
ALIASES = {"ac": ("armor", "class"), "hp": ("hit", "point"), "кд": ("класс", "доспех")}
GLUE = tuple(
    """a about an and are can do does for have how i in is many me much number of on or please s show tell the to value what when where which who why with you your compare
    а в где для есть и из известно как какой какая какие когда кто мне значение ли на о об покажи по про расскажи сколько сравни сравнить у что это или""".split()
)
SPEED_ASKED = r"(?:^| )(?:how|как) (?:fast|quickly|быстро|быстрее)(?: |$)"
SPEED_WORDS = {"fast": "speed", "quickly": "speed", "быстро": "скорость", "быстрее": "скорость"}
SPEED_FRAME = ("move", "moves", "moving", "movement", "двигается", "двигаться", "движение", "движения")
ENDINGS = "иями ями ами ого его ему ому ая яя ую юю ах ях ов ев ом ем ый ий ой ей а я у ю ы и".split()


def plain_words(c: str | Column, question: bool = False) -> Column:
    """Array of lower-cased runs of letters and digits, abbreviations spelt out, plural s and Russian endings dropped.

    Of a ``question`` that asks how fast, the words for it become those for speed and its words for moving go.
    """
    found = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)

    def form(w: Column) -> Column:
        english = F.when((F.length(w) > 4) & F.endswith(w, F.lit("s")) & (w != "class"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
        russian = F.regexp_replace(w, rf"^(.{{3,}}?)(?:{'|'.join(ENDINGS)})$", "$1")
        out = F.array(F.when(F.rlike(w, F.lit("^[а-яё]+$")), russian).otherwise(english))
        for short, full in ALIASES.items():
            out = F.when(w == short, F.array(*map(F.lit, full))).otherwise(out)
        return out

    plain = F.flatten(F.transform(found, form))
    if not question:
        return plain

    def speed(w: Column) -> Column:
        out = F.when(w.isin(*SPEED_FRAME), F.array().cast("array<string>")).otherwise(form(w))
        for asked, said in SPEED_WORDS.items():
            out = F.when(w == asked, F.array(F.lit(said))).otherwise(out)
        return out

    return F.when(F.rlike(F.array_join(found, " "), F.lit(SPEED_ASKED)), F.flatten(F.transform(found, speed))).otherwise(plain)


def anchored(quote: str | Column, anchor: str | Column) -> Column:
    """A segment as shown: behind its anchor where the anchor's words are not all in it."""
    q, a = col(quote), stripped(col(anchor))
    apart = F.size(F.array_except(plain_words(a), plain_words(q))) > 0
    return F.when(F.coalesce((a != "") & apart, F.lit(False)), F.concat(a, F.lit(": "), q)).otherwise(q)


def selected(raw: str | Column) -> Column:
    """A model's answer {"selections": [...]} as (ids in order without repeats, normalized: whether that changed them, rejected).

    Closed: no other fields, SELECTIONS ids of the form C1:S1 at most. A code fence around it is tolerated. Null is rejected.
    """
    trimmed = F.regexp_replace(F.coalesce(col(raw), F.lit("")), r"^\s+|\s+$", "")
    body = F.regexp_replace(trimmed, r"(?is)^```(?:json)?\s*\n(.*?)\n```$", "$1")
    one = r'"C[1-9]\d*:S[1-9]\d*"'
    closed = F.rlike(body, F.lit(rf'^\s*\{{\s*"selections"\s*:\s*\[\s*(?:{one}(?:\s*,\s*{one})*)?\s*\]\s*\}}\s*$'))
    ids = F.regexp_extract_all(body, F.lit(r"C[1-9]\d*:S[1-9]\d*"), 0)
    keyed = F.transform(F.array_distinct(ids), lambda i: F.struct(F.regexp_extract(i, r"C(\d+)", 1).cast("decimal(38,0)").alias("c"), F.regexp_extract(i, r"S(\d+)", 1).cast("decimal(38,0)").alias("s"), i.alias("id")))
    ordered = F.transform(F.array_sort(keyed), lambda x: x["id"])
    ok = closed & (F.size(ids) <= SELECTIONS)
    return F.struct(F.when(ok, ordered).otherwise(F.array().cast("array<string>")).alias("ids"), (ok & (ordered != ids)).alias("normalized"), (~ok).alias("rejected"))


def resolved(answers: DataFrame, offered: DataFrame, key: str = "question") -> DataFrame:
    """``answers`` (key, ids) with ``segments``: the offered segments of the ids in order; null if one of them was not offered to that question.

    ``offered``: (key, id, text, quote, chunk). An equi-join on question and id; an answer has at most SELECTIONS ids.
    """
    asked = answers.select(key, F.posexplode("ids").alias("at", "id"))
    met = asked.join(offered, [key, "id"], "left")
    found = met.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("at", "id", "text", "quote", "chunk"))).alias("segments"), (F.count(F.lit(1)) == F.count("chunk")).alias("whole")
    )
    joined = answers.join(found, key, "left")
    empty = F.size("ids") == 0
    return joined.withColumn("segments", F.when(empty, F.array().cast(found.schema["segments"].dataType)).when(F.col("whole"), F.col("segments"))).drop("whole")


def answers_query(question: Column, texts: Column, subjects: Column) -> Column:
    """Whether selected ``texts`` answer a ``question``, given all offered ``subjects`` (arrays of strings).

    Every subject named in the question is named in some text and every text names one; the texts together hold all its
    other words but GLUE, and each holds one of those (of the subjects' words if there are no others).
    """
    def holds(have: Column, ws: Column) -> Column:
        return F.forall(ws, lambda w: F.array_contains(have, w))

    def judged(words: Column, named: Column, sets: Column) -> Column:
        of_subjects, union = F.flatten(named), F.flatten(sets)

        def told(wanted: Column) -> Column:
            on_subject = F.forall(sets, lambda s: F.exists(named, lambda ws: holds(s, ws))) & let(union, lambda u: F.forall(named, lambda ws: holds(u, ws)))
            telling = F.when(F.size(wanted) > 0, wanted).otherwise(of_subjects)
            relevant = let(telling, lambda t: F.forall(sets, lambda s: F.exists(t, lambda w: F.array_contains(s, w))))
            return (F.size(words) > 0) & ((F.size(named) == 0) | on_subject) & let(union, lambda u: holds(u, wanted)) & relevant

        return let(F.array_except(words, of_subjects), told)

    def with_words(words: Column) -> Column:
        named = F.filter(F.transform(F.array_distinct(subjects), lambda s: plain_words(s)), lambda ws: (F.size(ws) > 0) & holds(words, ws))
        return let(named, lambda n: let(F.transform(texts, lambda t: plain_words(t)), lambda sets: judged(words, n, sets)))

    return let(F.array_distinct(F.filter(plain_words(question, True), lambda w: ~w.isin(*GLUE))), with_words)


def grounded(rejected: Column, ids: Column, segments_: Column, answers: Column, normalized: Column, chunks: Column) -> Column:
    """The reason why an answer is not taken as it is; null for a confident one."""
    return (
        F.when(chunks == 0, "insufficient_retrieval")
        .when(rejected, "malformed_selection")
        .when(F.size(ids) == 0, "no_selection")
        .when(segments_.isNull(), "malformed_selection")
        .when(~answers, "irrelevant_selection")
        .when(normalized, "selection_normalized")
    )


#: What is said in place of an answer, by reason.
SAID_INSTEAD = {
    "en": {
        "insufficient_retrieval": "I could not find relevant information in the available sources for your query.",
        "provider_not_configured": "AI answer generation is not configured. Review the retrieved source excerpts below.",
        "provider_config_error": "AI answer generation is misconfigured. Review the retrieved source excerpts below.",
        "provider_unavailable": "The AI provider is unavailable. Review the retrieved source excerpts below.",
        "malformed_selection": "The AI response could not be safely validated. Review the retrieved source excerpts below.",
        "partial_response": "The AI response was incomplete. Review the retrieved source excerpts below.",
        "no_selection": "No directly supporting segment was selected. Review the retrieved source excerpts below.",
        "irrelevant_selection": "The selected source text does not answer this question. Review the retrieved source excerpts below.",
    },
    "ru": {
        "insufficient_retrieval": "Не удалось найти релевантную информацию в доступных источниках по вашему запросу.",
        "provider_not_configured": "Генерация ответа ИИ не настроена. Ниже приведены найденные фрагменты источников.",
        "provider_config_error": "Генерация ответа ИИ настроена неверно. Ниже приведены найденные фрагменты источников.",
        "provider_unavailable": "Провайдер ИИ недоступен. Ниже приведены найденные фрагменты источников.",
        "malformed_selection": "Ответ ИИ не прошёл безопасную проверку. Ниже приведены найденные фрагменты источников.",
        "partial_response": "Ответ ИИ был получен не полностью. Ниже приведены найденные фрагменты источников.",
        "no_selection": "Подходящий подтверждающий фрагмент не выбран. Ниже приведены найденные фрагменты источников.",
        "irrelevant_selection": "Выбранный фрагмент источника не отвечает на этот вопрос. Ниже приведены найденные фрагменты источников.",
    },
}


def first_segments(offered: DataFrame, key: str = "question", limit: int = CITATIONS) -> DataFrame:
    """(key, excerpts): the first segment of each chunk in order, ``limit`` at most, as (chunk, quote). ``offered``: key, id (C1:S1), chunk, quote."""
    number = F.regexp_extract("id", r"^C(\d+):S1$", 1)
    firsts = offered.where(number != "").select(key, F.struct(number.cast("long").alias("c"), "chunk", "quote").alias("x"))
    ranked = firsts.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("x.c"))).where(F.col("_n") <= limit)
    held = ranked.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return held.select(key, F.transform("x", lambda e: F.struct(e["chunk"].alias("chunk"), e["quote"].alias("quote"))).alias("excerpts"))


def answered(resolved_: DataFrame, offered: DataFrame, key: str = "question", language: str = "language") -> DataFrame:
    """``resolved_`` (key, language, segments, reason, ..) with answer, cited (distinct (chunk, quote) in order) and confident.

    Without a reason, or one that only says that the ids were put in order, the answer is the segments' texts and they are cited;
    else it is what the reason has said in the language (English where that isn't known), and the first segments of at most CITATIONS chunks are cited.
    """
    told = F.lit(None).cast("string")
    for lang, texts in SAID_INSTEAD.items():
        for reason, text in texts.items():
            told = F.when((F.col("reason") == reason) & ((F.col(language) == lang) if lang != "en" else (F.coalesce(F.col(language), F.lit("")) != "ru")), text).otherwise(told)
    kept = F.col("reason").isNull() | (F.col("reason") == "selection_normalized")
    r = resolved_.join(first_segments(offered, key), key, "left")
    own = F.array_distinct(F.transform("segments", lambda s: F.struct(s["chunk"].alias("chunk"), s["quote"].alias("quote"))))
    none = F.slice(F.array(F.struct(F.lit(None).cast(offered.schema["chunk"].dataType).alias("chunk"), F.lit("").alias("quote"))), 1, 0)
    return r.select(
        *resolved_.columns,
        F.when(kept, F.array_join(F.transform("segments", lambda s: s["text"]), "\n\n")).otherwise(told).alias("answer"),
        F.when(kept, own).otherwise(F.coalesce("excerpts", none)).alias("cited"),
        F.col("reason").isNull().alias("confident"),
    )


#: Word forms that stand for one label or unit, words that carry no claim, pronouns, Russian endings of the support check.
LABELS = {
    "ac": ("armor class", "ac", "класс доспеха", "кд"), "hp": ("hit points", "hp", "хиты", "пункты хитов"), "speed": ("speed", "скорость"),
    "challenge": ("challenge rating", "cr", "опасность"), "str": ("strength", "str", "сила", "сил"), "dex": ("dexterity", "dex", "ловкость", "лов"),
    "con": ("constitution", "con", "телосложение", "тел"), "int": ("intelligence", "int", "интеллект", "инт"), "wis": ("wisdom", "wis", "мудрость", "мдр"),
    "cha": ("charisma", "cha", "харизма", "хар"),
}
UNITS = {
    "ft": ("ft", "foot", "feet", "фут", "фута", "футов"), "m": ("m", "meter", "meters", "metre", "metres", "м", "метр", "метра", "метров"),
    "lb": ("lb", "lbs", "pound", "pounds", "фунт", "фунта", "фунтов"), "round": ("round", "rounds", "раунд", "раунда", "раундов"),
}
NAMED = sorted({f.split()[0] for forms in (*LABELS.values(), *UNITS.values()) for f in forms})  # first words
EMPTY_WORDS = {"en": "a an and are has had have is the was were".split(), "ru": ["и"]}
PRONOUNS = {
    "en": "he her hers him his it its she that their theirs them these they this those".split(),
    "ru": "его ее ему ей им их она они оно он этим эти это эта этот".split(),
}
SUPPORT_ENDINGS = "ого его ому ему ой ей ую юю ом ем ым им ая яя ое ее ый ий а я у ю е".split()
TOKEN = rf"[-+]?\d+d\d+|{NUMBER}|[<>≤≥]|[\p{{L}}\p{{N}}]+(?:['’][\p{{L}}\p{{N}}]+)?"


def claim_form(c: str | Column, language: str = "en", claim: bool = False) -> Column:
    """A text as its meaningful tokens, each between blanks of its own: labels, units, numbers and words in one form each.

    With such blanks a token, or a run of them, is in another text exactly when its form is a substring of the other's.
    Of a ``claim``, a number that stands before its label goes behind it.
    """
    low = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"([+-])\s+(?=\d)", "$1")

    def named(plain: Column) -> Column:
        for name, forms in LABELS.items():
            plain = F.regexp_replace(plain, f" (?:{'|'.join(f.replace(' ', '  ') for f in forms)}) ", f" label-{name} ")
        for name, forms in UNITS.items():
            plain = F.regexp_replace(plain, f" (?:{'|'.join(forms)}) ", f" unit-{name} ")
        return plain

    def formed(tokens: Column) -> Column:
        found = F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" "))
        # few texts have possessive endings, or any word of a name; the others are looked at once instead of once a name
        ends = (found == "  ") | F.contains(found, F.lit("'s ")) | F.contains(found, F.lit("’s "))
        plain = F.when(ends, F.regexp_replace(found, "^  $|['’]s(?= )", "")).otherwise(found)
        return let(plain, lambda x: F.when(ends | F.arrays_overlap(tokens, F.array(*map(F.lit, NAMED))), named(x)).otherwise(x))

    # the blanks that are left where there is no token are taken away
    out = let(F.regexp_extract_all(low, F.lit(TOKEN), 0), formed)
    if claim:
        out = F.regexp_replace(out, rf"(?<!label-[a-z]{{1,9}} ) ({NUMBER})  (label-[a-z]+) ", " $2  $1 ")
    out = F.regexp_replace(out, f" (?:{'|'.join(EMPTY_WORDS[language])}) ", "")
    if language == "ru":
        out = F.regexp_replace(out, rf" ([\p{{L}}]{{5,}}?)(?:{'|'.join(SUPPORT_ENDINGS)}) ", " $1 ")
    return out


def bound(claim: Column, language: str = "en") -> Column:
    """Whether no pronoun of a claim's form comes before a word that can be its subject; false for a claim without tokens."""
    free = rf"^(?: (?:label-[a-z]+|unit-[a-z]+|{NUMBER}) )*+ (?:{'|'.join(PRONOUNS[language])}) "
    return (claim != "") & ~F.rlike(claim, F.lit(free))


def support_segments(c: str | Column, section: str | Column | None = None) -> Column:
    """Array of the segments of a text that may carry a claim: table rows whole, other lines by sentence and semicolon, each behind
    its ``section`` unless it names it; those past SUPPORT_CHARS are cut at blanks. Null sections count as none."""
    parts = F.flatten(
        F.transform(
            F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), r"\r?\n"), lambda x: F.struct(F.contains(x, F.lit("|")).alias("row"), stripped(F.regexp_replace(x, r"[\s\p{Z}]+", " ")).alias("x"))), lambda s: s["x"] != ""),
            lambda s: F.when(s["row"], F.array(s["x"])).otherwise(F.split(s["x"], r"(?<=[.!?;]) ")),
        )
    )
    n = SUPPORT_CHARS
    cut = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= n, F.array(p)).otherwise(F.regexp_extract_all(p, F.lit(rf"(?s)\s*(.{{1,{n}}}$|.{{{n // 2},{n}}}(?= )|.{{{n}}})"), 1))))
    if section is None:
        return cut
    name = stripped(F.regexp_replace(F.coalesce(col(section), F.lit("")), r"[\s\p{Z}]+", " "))

    def tokens(x):
        return F.array_join(F.transform(F.regexp_extract_all(F.lower(x), F.lit(TOKEN), 0), lambda t: F.concat(F.lit(" "), t, F.lit(" "))), "")

    return F.transform(cut, lambda p: F.when((name == "") | F.contains(tokens(p), tokens(name)), p).otherwise(F.substring(F.concat(name, F.lit(": "), p), 1, n)))


def supported(claim: Column, segment: Column, language: str = "en") -> Column:
    """Whether a segment carries a claim whole; both as ``claim_form`` makes them.

    The claim's tokens stand in it in a run. A run has the claim's labels with their values, numbers with their units and
    comparison signs in the same places, so these need no check of their own.
    """
    return bound(claim, language) & F.contains(segment, claim)


def quote_matches(quote: str | Column, evidence: str | Column) -> Column:
    """Whether either's words stand consecutively in the other's; not if one has none."""

    def padded(c):
        return F.array_join(F.transform(plain_words(c), lambda w: F.concat(F.lit(" "), w, F.lit(" "))), "")

    q, e = padded(quote), padded(evidence)
    return (q != "") & (e != "") & (F.contains(q, e) | F.contains(e, q))


def messages(parts: list[str], limit: int = MESSAGE_CHARS) -> list[str]:
    """Parts joined by line feeds into messages of at most ``limit`` characters; a longer part is cut."""
    out: list[str] = []
    for part in parts:
        for piece in [part[k : k + limit] for k in range(0, len(part), limit)] or [""]:
            if out and len(out[-1]) + 1 + len(piece) <= limit:
                out[-1] += "\n" + piece
            else:
                out.append(piece)
    return out


#: The words that tell a chunk's type, in both languages.
MARKS = {
    "casting": ("Casting Time", "Время накладывания", "Время сотворения"), "armor": ("Armor Class", "Класс Доспеха"), "hits": ("Hit Points", "Хиты"),
    "cost": ("Cost", "Стоимость"), "price": ("cost", "стоимость", "цена"), "level": ("Level", "Уровень"), "features": ("Features", "Умения"),
    "die": ("Hit Die", "Кость хитов"), "size": ("Size", "Размер"), "gear": ("equipment", "снаряжение"), "feat": (r"\bfeat\b", "черта"),
    "background": (r"\bbackground\b", "предыстори"), "item": ("magic item", "магический предмет", r"rarity\s*:", r"редкость\s*:"),
    "glossary": ("glossary", "rules term", "словар", "термин правил"), "gained": (r"\d+(?:st|nd|rd|th)-Level .* Feature", r"Умение .* \d+(?:-го|-й) уровня"),
    "kind": ("Species(?: Variant)?", "Вид(?: Вариант)?", "Раса(?: Вариант)?"),
}


def any_of(mark: str) -> str:
    return f"(?:{'|'.join(MARKS[mark])})"


def on_line(mark: str, rest: str) -> str:
    """A line that begins with the mark and goes on with ``rest``."""
    return f"(?im)^{any_of(mark)}{rest}"


def in_row(*marks: str) -> str:
    """A table row that holds the marks in this order."""
    return r"(?i)\|" + "".join(rf"[^\n]*{any_of(m)}" for m in marks) + r"[^\n]*\|"


#: Types in the order in which they are tried, with what a chunk of the type has.
TYPES = (
    ("spell", [on_line("casting", r"\s*:")]),
    ("creature", [on_line("armor", r"\s*:?[ \t]*\d"), on_line("hits", r"\s*:?[ \t]*\d")]),
    ("equipment", [in_row("cost")]),
    ("class", [in_row("level", "features"), "(?i)" + any_of("die") + r"\s*:"]),
    ("species", [on_line("kind", r"\s*$"), on_line("size", r"\s*:")]),
    ("equipment", ["(?i)" + any_of("gear"), "(?i)" + any_of("price")]),
    *((name, ["(?i)" + any_of(mark)]) for name, mark in (("feature", "gained"), ("feat", "feat"), ("background", "background"), ("item", "item"), ("glossary", "glossary"))),
)


def chunk_type(c: str | Column) -> Column:
    """The first type of TYPES whose every mark is in a text; null if none fits, and for null."""
    out = F.lit(None).cast("string")
    for name, rules in reversed(TYPES):
        hit = F.lit(True)
        for r in rules:
            hit = hit & F.rlike(col(c), F.lit("(?u)" + r))
        out = F.when(hit, name).otherwise(out)
    return out


def labelled(text: str, labels: dict[str, tuple[str, ...]]) -> dict[str, tuple[str, int, int]]:
    """{field: (value, start, end)} of 'Label: value' lines, longest label first; spans of the value in code points."""
    out: dict[str, tuple[str, int, int]] = {}
    for name, forms in labels.items():
        rule = "|".join(re.escape(f) for f in sorted(forms, key=len, reverse=True))
        m = re.search(rf"(?im)^(?:{rule})[ \t]*:?[ \t]*(\S.*?)[ \t]*$", text)
        if m:
            out[name] = (m[1], m.start(1), m.end(1))
    return out


#: The labels of the typed blocks.
SPELL = {"casting_time": ("Casting Time", "Время накладывания", "Время сотворения"), "range": ("Range", "Дистанция", "Дальность"), "components": ("Components", "Компоненты"), "duration": ("Duration", "Длительность")}
CREATURE = {"armor_class": ("Armor Class", "Класс Доспеха"), "hit_points": ("Hit Points", "Хиты"), "speed": ("Speed", "Скорость"), "challenge": ("Challenge", "Challenge Rating", "Опасность", "Показатель опасности")}


def typed_block(text: str) -> dict | None:
    """A spell or creature block as {type, title, fields: {name: (value, start, end)}}; None if a field is missing. Each value equals its slice."""
    for kind, labels in (("spell", SPELL), ("creature", CREATURE)):
        found = labelled(text, labels)
        if len(found) == len(labels):
            title = next((x.strip() for x in text.split("\n") if x.strip()), "")
            return {"type": kind, "title": title, "fields": found}
    return None


def table_rows(text: str) -> list[dict[str, str]]:
    """Rows of the first pipe table, by its header; reading stops at a row of another width."""
    out: list[dict[str, str]] = []
    header: list[str] | None = None
    for line in text.split("\n"):
        cells = [c.strip() for c in line.strip().strip("|").split("|")]
        if "|" not in line:
            if header:
                break
        elif header is None:
            header = cells
        elif all(re.fullmatch(r":?-+:?", c) for c in cells):
            continue
        elif len(cells) != len(header):
            break
        else:
            out.append(dict(zip(header, cells)))
    return out


def modifiers(text: str) -> dict[str, int]:
    """'Stealth +6, Perception -1' as a map."""
    return {m[1].strip().lower(): int(m[2].replace("−", "-").replace(" ", "")) for m in re.finditer(r"([^\d,;+−-]+?)\s*([+−-]\s*\d+)", text)}


def speeds(text: str) -> list[tuple[str, int]]:
    """'30 ft., fly 60 ft. (hover)' as (mode, distance); the first without a mode is walking."""
    return [(m[1] or "walk", int(m[2])) for m in re.finditer(r"(?:^|[,;])\s*([^\W\d]+)?\s*(\d+)", text)]


def progression_gaps(levels: list[int]) -> list[int]:
    """Levels of 1..20 that are missing or repeated."""
    return [n for n in range(1, 21) if levels.count(n) != 1]


def citation_issues(text: str | Column, fields: str | Column, citations: str | Column) -> Column:
    """Sorted array of 'rule:field' that a candidate's citations break; empty for a sound one.

    ``fields``: map of field to value; ``citations``: array of (field, start, stop, quote), spans in code points. Each field
    is cited (uncited), each citation is of a field (unknown), its quote is the slice of its span (quote) and, where it is,
    holds the field's value (unsupported).
    """
    t, known, cited = col(text), col(fields), col(citations)
    names, cited_names = F.map_keys(known), F.transform(cited, lambda c: c["field"])

    def one(c: Column) -> Column:
        exact = F.substring(t, c["start"] + 1, c["stop"] - c["start"]) == c["quote"]
        rule = (
            F.when(~F.array_contains(names, c["field"]), "unknown:")
            .when(~F.coalesce(exact, F.lit(False)), "quote:")
            .when(~F.coalesce(F.contains(F.lower(c["quote"]), F.lower(F.element_at(known, c["field"]))), F.lit(False)), "unsupported:")
        )
        return F.concat(rule, c["field"])

    missing = F.transform(F.array_except(names, cited_names), lambda n: F.concat(F.lit("uncited:"), n))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.transform(cited, one), missing))))


#: Grades of the ingestion report.
GRADES = ((90, "excellent"), (70, "good"), (50, "acceptable"), (25, "poor"))


def report(pages: Column, with_text: Column, chunks: Column, **faults: Column) -> tuple[Column, Column]:
    """(score, grade) of an ingestion: 100 less its penalties; without pages or chunks it failed with 0.

    ``faults``, each optional: no_ocr (pages need recognition and there is none), ocr_errors, embed_errors, skipped (counts).
    """
    none = F.lit(0)
    n = {k: faults.get(k, none).cast("long") for k in ("no_ocr", "ocr_errors", "embed_errors", "skipped")}
    thin = F.try_divide(with_text, pages)
    penalties = (
        F.when(thin < 0.5, 30).when(thin < 0.9, 10).otherwise(0),
        F.when(n["no_ocr"] > 0, 20).otherwise(0),
        F.when(n["ocr_errors"] > 0, 10).otherwise(0),
        F.least(F.lit(20), 5 * n["embed_errors"]),
        F.when(n["skipped"] > 0, 5).otherwise(0),
    )
    score = F.lit(100)
    for p in penalties:
        score = score - p
    failed = (pages == 0) | (chunks == 0)
    score = F.when(failed, 0).otherwise(F.greatest(F.lit(0), score))
    grade = F.when(failed, "failed")
    for least, name in GRADES:
        grade = grade.when(score >= least, name)
    return score.cast("int"), grade.otherwise("failed")


def rows(df: DataFrame, f: Callable[..., list[tuple]], inputs: list[str], ddl: str) -> DataFrame:
    """The other columns and, for each row, the rows that ``f`` makes of its ``inputs`` (1 to N, in Arrow batches).

    An input column called like a made one gives way to it.
    """
    from pyspark.sql import types as T

    made = T.StructType.fromDDL(ddl)
    keep = [c for c in df.columns if c not in inputs and c not in made.names]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
    types = [kinds[x.dataType.simpleString()] for x in made.fields]
    names = [x.name for x in made.fields]

    def run(batches):
        for batch in batches:
            given = [batch.column(len(keep) + k).to_pylist() for k in range(len(inputs))]
            at, out = [], []
            for k, args in enumerate(zip(*given)):
                for row in f(*args):
                    at.append(k)
                    out.append(row)
            cols = list(zip(*out)) if out else [()] * len(types)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(len(keep))), *(pa.array(c, t) for c, t in zip(cols, types))], names=[*keep, *names])

    schema = T.StructType([*df.select(*keep).schema.fields, *made.fields])
    return df.select(*keep, *inputs).mapInArrow(run, schema)

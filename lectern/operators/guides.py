"""Guides of quoted blocks: a quote counts where its text has it exactly once, and its span follows from that."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a block's id and a guide's slug look like.
SLUG = "^[a-z0-9]+(?:-[a-z0-9]+)*$"


def occurrences(text: str, quotes: list[str]) -> dict[str, tuple[int, int]]:
    """{quote: (how often it occurs, where it begins first)} of the quotes that are not empty, by one pass over the text; they may overlap."""
    automaton = ahocorasick.Automaton()
    for q in quotes:
        if q:
            automaton.add_word(q, q)
    if not len(automaton):
        return {}
    automaton.make_automaton()
    found: dict[str, tuple[int, int]] = {}
    for end, q in automaton.iter(text):
        n, first = found.get(q, (0, end - len(q) + 1))
        found[q] = (n + 1, first)
    return found


def quoted_blocks(guides: DataFrame) -> DataFrame:
    """One row a block of ``guides`` (guide_id, text, blocks: array of (id, quote)): guide_id, block, quote, start, end, problem.

    start and end are code points, null where there is a problem: 'unstable id', 'repeated id', 'blank quote', 'not found' or
    'ambiguous' (found more than once). A text is scanned once for all of its quotes. Null texts count as empty, null lists have no rows.
    """
    rows = guides.select("guide_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("blocks", F.array().cast(guides.schema["blocks"].dataType)).alias("blocks"))

    def run(batches):
        for batch in batches:
            take, out = [], []
            for k, (text, blocks) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                hits = occurrences(text, [b["quote"] or "" for b in blocks])
                for b in blocks:
                    n, at = hits.get(b["quote"], (0, 0))
                    take.append(k)
                    out.append((b["id"], b["quote"], n, at))
            ids, quotes, counts, starts = zip(*out) if out else ((), (), (), ())
            arrays = [batch.column(0).take(pa.array(take, pa.int64())), pa.array(ids, pa.string()), pa.array(quotes, pa.string()), pa.array(counts, pa.int64()), pa.array(starts, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["guide_id", "block", "quote", "n", "at"])

    schema = rows.select("guide_id").schema.add("block", "string").add("quote", "string").add("n", "long").add("at", "long")
    twice = F.transform("blocks", lambda b: b["id"])
    repeated = rows.select("guide_id", F.explode(twice).alias("block")).groupBy("guide_id", "block").agg((F.count(F.lit(1)) > 1).alias("again"))
    found = rows.mapInArrow(run, schema).join(repeated, ["guide_id", "block"], "left")
    problem = (
        F.when(~F.coalesce(F.rlike("block", F.lit(SLUG)), F.lit(False)), "unstable id")
        .when(F.coalesce("again", F.lit(False)), "repeated id")
        .when(F.coalesce(F.trim("quote"), F.lit("")) == "", "blank quote")
        .when(F.col("n") == 0, "not found")
        .when(F.col("n") > 1, "ambiguous")
    )
    found = found.withColumn("problem", problem)
    sound = F.col("problem").isNull()
    return found.select("guide_id", "block", "quote", F.when(sound, F.col("at")).alias("start"), F.when(sound, F.col("at") + F.length("quote")).alias("end"), "problem")


#: Fixed value: roles that read guides of every tier.
FULL_ROLES = ("premium", "admin")


def readable_guides(guides: DataFrame, readers: DataFrame) -> DataFrame:
    """``guides`` (slug, locale, access_tier, ..) that each of ``readers`` (reader, role, locale) may read: those of its locale that are open, or all of that locale for a full role.

    An equi-join on the locale; unknown roles and null tiers read and are read as the least.
    """
    met = guides.join(readers, "locale")
    return met.where(F.coalesce(F.col("access_tier") == "open", F.lit(False)) | F.coalesce(F.col("role").isin(*FULL_ROLES), F.lit(False)))

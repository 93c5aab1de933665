"""Sharding by a Feistel permutation of global row numbers, with DataFrame functions only.

Row numbers run over all rows in the order of (id, size, crc32 of the text),
nulls first. A generalised Feistel network permutes Z_a x Z_b, the smallest
near-square grid that holds all numbers; a number that leaves 0..n-1 is
permuted again until it is back (cycle walking). Position p then gives shard
p mod shards and slot p div shards: shard sizes differ by one row at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import partitions_for, shared_dir

ROUNDS = 6
#: The modulus of the round function; a product of two residues fits 63 bits.
PRIME = 2_147_483_647
#: What the round function reduces to between its two maps.
FOLD = 1_048_583
#: Walks after which the plan raises. A cycle leaves 0..n-1 for at most the grid's surplus, which is below its side a:
#: never too few for n up to WALKS squared, and by chance too few with probability n ** (-WALKS / 2) for more.
WALKS = 64


def round_keys(seed: int) -> list[tuple[int, int]]:
    """(multiplier, increment) of each round."""
    out, x = [], seed % PRIME
    for _ in range(ROUNDS):
        x = (x * 48_271 + 11) % PRIME
        y = (x * 69_621 + 7) % PRIME
        out.append((x % (PRIME - 2) + 1, y))
        x = y
    return out


def grid(rows: int) -> tuple[int, int]:
    """Sides (a, b) of the permuted grid: a * b >= rows, by less than a."""
    a = max(1, math.isqrt(max(rows - 1, 0)) + 1)
    return a, max(1, -(-rows // a))


def round_value(x: str, key: tuple[int, int], side: int) -> str:
    """The round function, as SQL: two affine maps modulo a prime with a reduction to FOLD between, reduced to ``side``."""
    return f"((({x} % {PRIME}L * {key[0]}L + {key[1]}L) % {PRIME}L % {FOLD}L * {key[1]}L + {key[0]}L) % {PRIME}L % {side}L)"


def permuted(x: str, rows: int, seed: int) -> str:
    """One pass of the network over the grid, as SQL: in even rounds the a-side moves by a function of the b-side, else the other way round."""
    a, b = grid(rows)
    left, right = f"({x} div {b}L)", f"({x} % {b}L)"
    for n, key in enumerate(round_keys(seed)):
        if n % 2 == 0:
            left = f"(({left} + {round_value(right, key, a)}) % {a}L)"
        else:
            right = f"(({right} + {round_value(left, key, b)}) % {b}L)"
    return f"({left} * {b}L + {right})"


def walked(x: str, rows: int, seed: int) -> Column:
    """``permuted`` column ``x`` until the value is below ``rows``; raises after WALKS passes rather than give a wrong place."""
    again = f"aggregate(sequence(1, {WALKS}), {permuted(x, rows, seed)}, (v, k) -> CASE WHEN v < {rows}L THEN v ELSE {permuted('v', rows, seed)} END)"
    end = F.expr(again)
    return F.when(end < rows, end).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def numbered(narrow: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``narrow`` with _row, its rank in the total order of ``order`` (nulls first; equal rows in any order), and the row count.

    A range partitioning (a last tie-breaker splits runs of equal rows), local
    positions and the cumulative sizes of the partitions; no task holds all rows.
    """
    spark = narrow.sparkSession
    shared_dir(spark)
    tied = narrow.withColumn("_tie", F.monotonically_increasing_id())
    n = partitions_for(spark, 0)
    held = tied.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in [*order, "_tie"]])
    held = held.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in [*order, "_tie"]]).drop("_tie").checkpoint()
    at = F.monotonically_increasing_id()
    placed = held.withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33)).withColumn("_local", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    rows = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))  # a row per partition
    out = placed.join(F.broadcast(offsets), "_part").withColumn("_row", F.col("_before") + F.col("_local"))
    return out.drop("_at", "_part", "_local", "_before"), int(rows)


def shard(docs: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    size: UTF-8 bytes of the text plus 1 (null text: 1, crc32 of nothing). The
    law: shard row counts at most one apart. Null and repeated ids and equal
    rows each get a place of their own; empty input: no rows.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"))
    ranked, rows = numbered(narrow, ["doc_id", "size", "text_crc32"])
    place = ranked.withColumn("_place", walked("_row", max(rows, 1), seed))
    return place.select(
        F.col("doc_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.expr(f"_place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

"""Packing of documents into training windows: non-negative least squares over length combinations.

1. Each document becomes ids plus one end id; it is cut locally into whole
   windows and a rest (a rest of half a window or more gives up its first
   half), so pieces are known as soon as a document is read.
2. The histogram of piece lengths (at most ``window`` bins, however large the
   corpus) goes to the driver. Combinations of up to three lengths that fill a
   window are enumerated, non-negative repeat counts are solved by least
   squares against the histogram, rounded up to whole repeats as far as the
   histogram can pay for them, and the residual lengths are packed greedily, the
   best-fitting open windows first, counts at a time.
3. The plan says for each length which ranks go to which sequences. Ranks come
   from a window over (length, salt), salted so that no group exceeds a bound,
   plus the salts' cumulative counts.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.bpe import byte_characters
from lectern.llm.shared import materialise, Memo, partitions_for, pick_unused, tokenizer_file, worker_cache

WINDOW = 2048
END_ID = 1
#: Rows that one (length, salt) group holds on average, at most: so many, or a thousandth of all.
RANK_GROUP = 1_000
#: Chunks a worker remembers in each of two generations.
MEMO = 250_000
#: Fixed value: the split rule of byte-level pre-tokenisation.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN_END = "\u0250"
OTHER_BLANK = re.compile(r"[^\S \n]")
#: A blank or line feed with a character that is not white space on both sides.
CUT = re.compile(r"(?<=\S)[ \n](?=\S)")


class ChunkEncoder:
    """ids of whole texts as little-endian 32-bit bytes, remembering those of chunks between blanks.

    A blank or line feed between two characters that are not white space
    begins a chunk that byte-level pre-tokenisation never joins to its
    predecessor, so a text's ids are those of its chunks in order. Texts with
    runs of white space are cut only where that holds. The memo is bounded.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        path = tokenizer_file(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        # the same vocabulary in the quicker library, for chunks of Latin letters without a special token's string
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.quick = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.memo = Memo(MEMO)

    def _ids(self, text: str, plain: bool) -> bytes:
        if plain and (text.isascii() or max(text) < LATIN_END):
            return array("I", self.quick(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        plain = not any(s in text for s in self.special)
        head, chunks = self.chunks(text)
        memo = self.memo
        parts = list(map(memo.young.get, chunks))
        if None in parts:
            for k, x in enumerate(chunks):
                if parts[k] is None:
                    got = memo.get(x)
                    if got is None:
                        got = self._ids(x if x[0] == "\n" else " " + x, plain)
                        memo.put(x, got)
                    parts[k] = got
            memo.trim()
        return (self._ids(head, plain) if head else b"") + b"".join(parts)

    @staticmethod
    def chunks(text: str) -> tuple[str, list[str]]:
        """(first chunk, the other ones); of those a chunk that begins with a line feed is meant so, any other without its blank before it."""
        if text[0].isspace() or text[-1].isspace() or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or OTHER_BLANK.search(text):
            cuts = [0, *(m.start() for m in CUT.finditer(text)), len(text)]
            parts = [text[a:b] for a, b in zip(cuts, cuts[1:])]
            return parts[0], [p if p[0] == "\n" else p[1:] for p in parts[1:]]
        head, *rest = text.replace("\n", " \n").split(" ")
        return head, rest


def cut(total: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole windows, then the rest; a rest past half a window gives up its first half."""
    out = [(s, window) for s in range(0, total - window + 1, window)]
    at = len(out) * window
    rest = total - at
    half = window // 2
    if rest > half and window >= 4:
        out.append((at, half))
        at, rest = at + half, rest - half
    if rest:
        out.append((at, rest))
    return out


def cut_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """One row per piece: the other columns of ``docs``, start, length, ids (binary, little-endian 32-bit), doc_tokens.

    Null texts count as empty: such a document is its end id alone.
    """
    keep = [c for c in docs.columns if c != text]

    def run(batches):
        cache = worker_cache()
        if ("pack", tokenizer) not in cache:
            cache["pack", tokenizer] = ChunkEncoder(tokenizer)
        encoder, end = cache["pack", tokenizer], np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            texts = batch.column(len(keep))
            for lo in range(0, batch.num_rows, 256):
                rows, starts, lengths, ids, totals = [], [], [], [], []
                for k, x in enumerate(texts.slice(lo, 256).to_pylist(), lo):
                    flat = encoder.encode(x or "") + end
                    total = len(flat) // 4
                    for s, n in cut(total, window):
                        rows.append(k)
                        starts.append(s)
                        lengths.append(n)
                        ids.append(flat[4 * s : 4 * (s + n)])
                        totals.append(total)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(take) for c in keep] + [pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), pa.array(totals, pa.int64())],
                    names=[*keep, "start", "length", "ids", "doc_tokens"],
                )

    schema = docs.select(*keep).schema.add("start", "long").add("length", "long").add("ids", "binary").add("doc_tokens", "long")
    return docs.select(*keep, F.col(text).alias(pick_unused(docs, "_text"))).mapInArrow(run, schema)


def combinations_of(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of one, two or three of ``lengths`` (0: none) that fill ``window`` exactly."""
    present = np.zeros(window + 1, dtype=bool)
    present[lengths] = True
    out = [np.array([[window, 0, 0]])] if present[window] else []
    for a in lengths[lengths < window]:
        b = lengths[(lengths >= a) & (lengths <= window - a)]
        c = window - a - b
        ok = ((c == 0) | (c >= b)) & np.where(c > 0, present[c], True)
        b, c = b[ok], c[ok]
        if len(b):
            out.append(np.stack([np.full(len(b), a), b, c], axis=1))
    return np.concatenate(out) if out else np.empty((0, 3), dtype=np.int64)


def solve_nnls(combos: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 with least squares of (uses of each length) - counts: accelerated projected gradient."""
    if not len(combos):
        return np.zeros(0)
    size = len(counts)
    cols = [combos[:, k] for k in range(3)]
    weight = [(c > 0).astype(float) for c in cols]
    use = lambda x: sum(np.bincount(c, weights=x * w, minlength=size) for c, w in zip(cols, weight))
    back = lambda r: sum(r[c] * w for c, w in zip(cols, weight))
    # the largest eigenvalue, by power iteration
    v = np.ones(len(combos))
    for _ in range(12):
        v = back(use(v))
        top = np.linalg.norm(v)
        v /= top
    h = counts.astype(float)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - back(use(y) - h) / (1.05 * top))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan_windows(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of one sequence, repeats)] that uses every piece of the histogram exactly once."""
    left = np.zeros(window + 1, dtype=np.int64)
    for n, c in histogram.items():
        left[n] = c
    lengths = np.flatnonzero(left)
    plan: list[tuple[tuple[int, ...], int]] = []
    combos = combinations_of(lengths, window)
    x = solve_nnls(combos, left)
    for k in np.argsort(-x, kind="stable"):
        want = int(np.ceil(x[k] - 1e-9)) if x[k] >= 0.05 else 0
        if not want:
            break
        combo = [int(n) for n in combos[k] if n]
        times = min(want, *(int(left[n]) // combo.count(n) for n in combo))
        if times > 0:
            plan.append((tuple(combo), times))
            for n in combo:
                left[n] -= times
    # residual, longest first into the open windows with the least room that fits
    rooms: list[dict[tuple[int, ...], int]] = [{} for _ in range(window + 1)]
    for n in np.flatnonzero(left)[::-1].tolist():
        todo = int(left[n])
        while todo:
            room = next((r for r in range(n, window) if rooms[r]), None)
            if room is None:
                fit = window // n
                full, rest = divmod(todo, fit)
                if full:
                    _put(rooms, (n,) * fit, window - fit * n, full)
                if rest:
                    _put(rooms, (n,) * rest, window - rest * n, 1)
                todo = 0
            else:
                shape, have = rooms[room].popitem()
                times = min(have, todo)
                if have > times:
                    rooms[room][shape] = have - times
                _put(rooms, (*shape, n), room - n, times)
                todo -= times
    for shapes in rooms:
        plan += shapes.items()
    return plan


def _put(rooms, shape, room, times):
    rooms[room][shape] = rooms[room].get(shape, 0) + times


def segments(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: (first rank, first sequence, offset) of its runs of ranks; a rank's sequence is first sequence + rank - first rank."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for shape, times in plan:
        at = 0
        for n in shape:
            rank = used.get(n, 0)
            runs.setdefault(n, []).append((rank, sequence, at))
            used[n] = rank + times
            at += n
        sequence += times
    return {n: tuple(np.array(x, dtype=np.int64) for x in zip(*v)) for n, v in runs.items()}


def place(pieces: DataFrame, window: int = WINDOW, order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (which has length and the ``order`` columns). ``pieces`` is read twice: hand in a table."""
    spark = pieces.sparkSession
    histogram = {int(n): int(c) for n, c in pieces.groupBy("length").count().collect()}  # at most ``window`` rows
    runs = segments(plan_windows(histogram, window))
    total = sum(histogram.values())
    group = max(RANK_GROUP, total // 1000)
    salts = F.element_at(F.lit([1] + [max(1, -(-histogram.get(n, 0) // group)) for n in range(1, window + 1)]), F.col("length").cast("int") + 1)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), salts).cast("int"))
    sizes = salted.groupBy("length", "_salt").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    n = partitions_for(spark, total)
    ranked = (
        salted.repartition(n, "length", "_salt")
        .withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1)
        .join(sizes, ["length", "_salt"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
        .drop("_salt", "_before")
    )
    keep = [c for c in ranked.columns if c != "_rank"]

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            for x in np.unique(length):
                mine = length == x
                first, seq, off = runs[int(x)]
                at = np.searchsorted(first, rank[mine], side="right") - 1
                sequence[mine], offset[mine] = seq[at] + rank[mine] - first[at], off[at]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    schema = ranked.select(*keep).schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their place: id, start, length, ids (``with_ids``), ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document lies in exactly one piece; a sequence's pieces
    lie in it without gaps from offset 0 and fill at most ``window`` ids.
    Null ids and repeated rows are packed like any other; empty input: no rows.
    """
    cuts = cut_pieces(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), tokenizer, window)
    cuts = cuts.withColumn("ids_crc32", F.crc32("ids"))
    cuts = materialise(cuts if with_ids else cuts.drop("ids"))
    placed = place(cuts, window, ("doc_id", "start", "length", "ids_crc32"))
    order = ["doc_id", "start", "length", *(["ids"] if with_ids else []), "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return placed.select(*order).withColumnRenamed("doc_id", id_col)

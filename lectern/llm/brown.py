"""Brown class-based n-grams: exchange clustering, class transitions, word emissions.

1. Counts of all training tokens: tasks count what they read, one aggregation
   adds up.
2. Every word with at least LEAST occurrences is clustered, however many there
   are. Words of one of every 2 ** 22 tokens are known to all tasks, which code
   each text by them once. The rarer ones are holes of the coded text: they go
   out with the tokens beside them and meet their numbers and counts in an
   equi-join. The bigrams of both kinds (words that are not clustered are one
   symbol, the end of a text another) become a table with each word's
   neighbours in a row.
3. Exchange clustering by sweeps over that table: each word's best class is
   that which raises the likelihood of the class bigram model most, given all
   other words' classes; half of the words may move in a sweep, the other half
   in the next. Sweeps go on until both halves move no word, or gain less than
   GAIN a bigram; of a sweep that lowers it, the moves that gain most are made.
   Between tasks and driver go one byte a clustered word, a sweep's moves and a
   table of class bigrams.
4. p(w | v) = p(class w | class v) * p(w | class w), transitions smoothed with
   the class unigram, emissions by add-delta over the class. The words that are
   too rare to be clustered share the open class, each with its own count, and
   with one more, unseen word.

Coded texts are scored by what all tasks know, their holes by what they have
met. Numbers of words are ranks by count, so that classes and scores are the
same for any head and any partitions.
"""

from __future__ import annotations

from collections import Counter
from itertools import batched, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import arrow_rows, crc32_of_id, discard, extended, materialise, pick_unused, settings

#: A word of at least one in so many tokens is known to all tasks, at most so many words; rarer ones meet what is known of them in joins.
HEAD = 1 << 22
#: A word of so many occurrences is clustered.
LEAST = 5
CLASSES = 48
#: Sweeps end when a pair of them raises the log-likelihood by less than this for each bigram.
GAIN = 1e-2
#: A task's count table is handed on when it reaches so many words, or word pairs; pairs are counted when there are so many of them.
TABLE = 500_000
PAIRS = 4_000_000
COUNTED = 500_000
#: Rows of an Arrow batch to Python, which is held there and in the JVM: texts, and words with all their neighbours. Rows of one from Python.
TEXTS = 1_000
WORDS = 200
HANDED = 50_000
#: Tasks that count a class table, at most: each gives the driver one row of CLASSES squared numbers.
ADDERS = 256
#: So many cuts of a sweep's moves are tried in one job.
CUTS = 5
#: What keeps disk low: a job's shuffle files go when it ends, tables are packed well.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
DELTA = 0.1
#: Weight of the class unigram in a transition, in occurrences.
BACKOFF = 20.0
END = b"\n"  # no token holds white space
#: Codes besides the numbers of words: a word that tasks don't know, the end of a text, a word of the open class. Arrays of words end with values for them.
HOLE, STOP, OPEN = -1, -2, -3


def tokens(text: bytes | None) -> list[bytes]:
    """Words of the A-Z lower-cased text in UTF-8, without the end."""
    return (text or b"").lower().split()


def token_counts(train: DataFrame, text: str = "text") -> DataFrame:
    """(token binary, c): how often each token stands in the training texts, ends included."""

    def run(batches):
        table: Counter = Counter()
        for batch in batches:
            for x in batch.column(0).cast(pa.binary()).to_pylist():
                table.update(tokens(x))
                table[END] += 1
                if len(table) > TABLE:
                    yield from out(table)
                    table = Counter()
        yield from out(table)

    def out(table):
        for part in batched(table.items(), HANDED):
            token, n = zip(*part)
            yield pa.RecordBatch.from_arrays([pa.array(token, pa.binary()), pa.array(n, pa.int64())], names=["token", "n"])

    return train.select(text).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


def frequent(counts: DataFrame, least: int) -> list[tuple[bytes, int]]:
    """(token, count) of all words with ``least`` occurrences or more, most frequent first. The caller's ``least`` bounds their number."""
    got = counts.where((F.col("token") != F.lit(END)) & (F.col("c") >= least)).select("token", "c").toArrow()
    return sorted(zip(got.column("token").to_pylist(), got.column("c").to_pylist()), key=lambda x: (-x[1], x[0]))


def coding(ids):
    """A Column function of texts: ``codes`` (a text's words as 32-bit numbers by the broadcast dict ``ids``, HOLE for others), ``holes`` (these words
    with the codes beside them) and ``twins`` (holes that follow each other)."""

    @F.arrow_udf("codes binary, holes array<struct<token:binary,before:int,after:int>>, twins array<struct<a:binary,b:binary>>")
    def code(texts: pa.Array) -> pa.Array:
        get = ids.value.get
        parts, rare = [], []
        for x in texts.cast(pa.binary()).to_pylist():
            words = tokens(x)
            part = np.fromiter(map(get, words, repeat(HOLE)), np.int32, len(words))
            parts.append(part)
            rare += [words[k] for k in np.flatnonzero(part == HOLE).tolist()]
        codes = pa.array([x.tobytes() for x in parts], pa.binary())
        flat, stops = stopped(parts)
        at = np.flatnonzero(flat == HOLE)
        first = np.flatnonzero(flat[at + 1] == HOLE)
        rare = pa.array(rare, pa.binary())
        holes = pa.StructArray.from_arrays([rare, pa.array(flat[at - 1]), pa.array(flat[at + 1])], names=["token", "before", "after"])
        twins = pa.StructArray.from_arrays([rare.take(pa.array(first)), rare.take(pa.array(first + 1))], names=["a", "b"])
        lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(where, stops).astype(np.int32)), x) for where, x in ((at, holes), (at[first], twins))]
        return pa.StructArray.from_arrays([codes, *lists], names=["codes", "holes", "twins"])

    return code


def stopped(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of texts in one array with a STOP before, between and behind them, and where these are."""
    ends = np.cumsum([0, *map(len, parts)])
    return np.insert(np.concatenate([np.empty(0, np.int32), *parts]), ends, STOP), ends + np.arange(len(ends))


def coded(docs: DataFrame, ids: dict[bytes, int], keep: list[str], text: str = "text") -> DataFrame:
    """A table of ``keep`` columns with _row (unique) and _codes, _holes, _twins of ``coding``."""
    shared = docs.sparkSession.sparkContext.broadcast(ids)  # HEAD words at most
    x = pick_unused(docs.select(*keep), "_coded")
    read = docs.select(*keep, coding(shared)(text).alias(x)).select(*keep, F.monotonically_increasing_id().alias("_row"), *(F.col(x)[c].alias("_" + c) for c in ("codes", "holes", "twins")))
    with arrow_rows(docs.sparkSession, TEXTS):
        held = materialise(read)
    shared.destroy()
    return held


def numbered(counts: DataFrame, known: int, head: int, bar: int) -> tuple[DataFrame, int]:
    """((token, c, id) of all words, how many have a number). id: HOLE for words of ``head`` occurrences or more, of which there are ``known``, and for
    the end; OPEN for those of less than ``bar``; for those between their ranks by count from ``known`` on."""
    end = F.col("token") == F.lit(END)
    if bar >= head:
        return counts.select("token", "c", F.when(end | (F.col("c") >= head), HOLE).otherwise(OPEN).cast("int").alias("id")), 0
    between = counts.where(~end & (F.col("c") < head) & (F.col("c") >= bar))
    # as each part of the sorted words is numbered from 0, the parts before it are added
    ranked = materialise(between.orderBy(F.desc("c"), "token").select("token", "c", F.monotonically_increasing_id().alias("m")))
    part = F.shiftright("m", 33).cast("int")
    sizes = {r[0]: r[1] for r in ranked.groupBy(part).count().collect()}  # a row for each part
    starts = np.cumsum([known, *(sizes.get(k, 0) for k in range(max(sizes, default=0) + 1))]).tolist()
    own = (F.get(F.lit(starts), part) + F.col("m").bitwiseAND((1 << 33) - 1)).cast("int")
    rest = counts.where(end | (F.col("c") >= head) | (F.col("c") < bar))
    out = ranked.select("token", "c", own.alias("id")).unionByName(rest.select("token", "c", F.when(end | (F.col("c") >= head), HOLE).otherwise(OPEN).cast("int").alias("id")))
    out._lectern_path = ranked._lectern_path
    return out, starts[-1] - known


def met(held: DataFrame, counts: DataFrame, keep: list[str]) -> DataFrame:
    """A table of the holes of ``coded`` texts: ``keep`` columns, before, at, after (codes, where ``before`` or ``after`` is a HOLE another row has that bigram) and c,
    how often the word was learnt; for bigrams of two holes c is null, as rows of their own have their words."""
    words = counts.where(F.col("id") != HOLE)

    def number(id_, c="c"):
        return F.coalesce(id_, F.lit(OPEN)).alias("at"), F.coalesce(c, F.lit(0)).alias("c")

    ones = held.select(*keep, F.explode("_holes").alias("t")).select(*keep, "t.*").join(words, "token", "left").select(*keep, "before", *number("id"), "after")
    first = words.select(F.col("token").alias("a"), F.col("id").alias("first"))
    twos = held.select(*keep, F.explode("_twins").alias("t")).select(*keep, "t.*").join(first, "a", "left").join(words.withColumnRenamed("token", "b"), "b", "left")
    twos = twos.select(*keep, F.coalesce("first", F.lit(OPEN)).alias("before"), number("id")[0], F.lit(None).cast("long").alias("c"), F.lit(HOLE).alias("after"))
    return materialise(ones.unionByName(twos))


def merged(runs: list[tuple[np.ndarray, np.ndarray]]):
    """(keys, counts) of all ``runs`` of sorted keys with counts, each key once, in order and in parts of some HANDED keys, so that no second copy is held."""
    ends = np.sort(np.concatenate([key[HANDED // len(runs) :: max(1, HANDED // len(runs))] for key, _ in runs])) if runs else []
    at = [0] * len(runs)
    for end in [*ends[:: max(1, len(runs))], None]:
        to = [len(key) if end is None else int(np.searchsorted(key, end)) for key, _ in runs]
        keys = np.concatenate([key[a:b] for (key, _), a, b in zip(runs, at, to)]) if runs else np.empty(0, np.int64)
        if len(keys):
            counts = np.concatenate([n[a:b] for (_, n), a, b in zip(runs, at, to)])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            yield keys[first], np.add.reduceat(counts[order], first)
        at = to


def neighbours(train: DataFrame, ids: dict[bytes, int] | None, size: int, text: str = "text", rare: DataFrame | None = None) -> DataFrame:
    """A table with a row for each symbol: word, right, right_n, left, left_n (its neighbours and how often), which are made from PACKED columns where they are read.

    Symbols: words below ``size``, then ``size`` for all other words and size + 1 for the end, which also begins each text. Texts are coded by
    ``ids``; without it they are, as _codes of ``coded``, and the bigrams of their holes are those of ``rare``, as ``met`` has them.
    A row has at most 2 * (size + 2) neighbours.
    """
    other, end, wide = size, size + 1, size + 2
    known = ids is not None  # all words that have a number
    shared = train.sparkSession.sparkContext.broadcast(ids) if known else None
    codes = (coding(shared)(text)["codes"] if known else F.col("_codes")).alias("codes")

    def count(batches):
        held, n_held, runs, n_runs = [], 0, [], 0
        for batch in batches:
            flat, _ = stopped([np.frombuffer(x, np.int32) for x in batch.column(0).to_pylist()])
            for lo in range(0, len(flat) - 1, COUNTED):
                seq = flat[lo : lo + COUNTED + 1].astype(np.int64)
                stop, whole = seq == STOP, (seq != HOLE) | known
                seq[(seq < 0) | (seq >= size)] = other
                seq[stop] = end
                held.append((seq[:-1] * wide + seq[1:])[whole[:-1] & whole[1:]])
                n_held += len(held[-1])
                if n_held > COUNTED:
                    runs.append(np.unique(np.concatenate(held), return_counts=True))
                    n_runs += len(runs[-1][0])
                    held, n_held = [], 0
                    if n_runs > PAIRS:
                        parts = list(merged(runs))
                        n_runs = sum(len(key) for key, _ in parts)
                        runs = [tuple(np.concatenate(x) for x in zip(*parts))]
                        if n_runs > PAIRS // 2:
                            yield from out(runs)
                            runs, n_runs = [], 0
        if held:
            runs.append(np.unique(np.concatenate(held), return_counts=True))
        yield from out(runs)

    def out(runs):
        for key, n in merged(runs):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["pair", "n"])

    def rows(batches):
        rest, n_rest = [], 0  # rows of a word stay together
        for batch in batches:
            if not batch.num_rows:
                continue
            rest.append(batch)
            n_rest += batch.num_rows
            last = batch.column(0)[-1].as_py() // (2 * wide) * (2 * wide)
            if n_rest < 10_000 or rest[0].column(0)[0].as_py() >= last:
                continue
            part = pa.Table.from_batches(rest)
            cut = int(np.searchsorted(part.column("key").to_numpy(), last))
            yield pack(part.slice(0, cut))
            rest, n_rest = part.slice(cut).to_batches(), n_rest - cut
        if rest:
            yield pack(pa.Table.from_batches(rest))

    def pack(part):
        key, n = part.column("key").to_numpy(), part.column("n").to_numpy()
        side, beside = np.divmod(key, wide)
        word, side = side // 2, side % 2
        start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        columns = []
        for which in (0, 1):
            mine = side == which
            at = np.r_[0, np.cumsum(np.add.reduceat(mine, start))]
            columns += [blobs(beside[mine].astype(np.int32), at), blobs(n[mine], at)]
        return pa.RecordBatch.from_arrays([pa.array(word[start].astype(np.int32)), *columns], names=["word", *PACKED])

    # summed by pair first: a frequent word's pairs come from every task, and only then by word
    spark = train.sparkSession
    pairs = train.select(codes).mapInArrow(count, "pair long, n long")
    if rare is not None:
        before, at, after = (F.when(F.col(c) == STOP, end).when((F.col(c) < 0) | (F.col(c) >= size), other).otherwise(F.col(c)).cast("long") for c in ("before", "at", "after"))
        two = F.array(F.when(F.col("before") != HOLE, before * wide + at), F.when(F.col("after") != HOLE, at * wide + after))
        pairs = pairs.unionByName(rare.select(F.explode(F.array_compact(two)).alias("pair"), F.lit(1).cast("long").alias("n")))
    # a task hardly gives a pair twice, so pairs are dealt before any sum
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), wide // 50_000)
    pairs = pairs.repartition(n, "pair").groupBy("pair").agg(F.sum("n").alias("n"))
    a, b = F.expr(f"pair div {wide}"), F.expr(f"pair % {wide}")
    # (word, side, neighbour) as one number, by which they are sorted fast
    right, left = a * (2 * wide) + b, (b * 2 + 1) * wide + a
    each = pairs.select(F.explode(F.when(b < size, F.array(right, left)).otherwise(F.array(right))).alias("key"), "n")
    each = each.repartition(n, F.expr(f"key div {2 * wide}")).sortWithinPartitions("key")
    with arrow_rows(spark, TEXTS):
        near = materialise(each.mapInArrow(rows, "word int, " + ", ".join(f"{c} binary" for c in PACKED)))
    if known:
        shared.destroy()
    seen = near.select("word", *(unpacked(kind)(c).alias(name) for c, name, kind in zip(PACKED, ("right", "right_n", "left", "left_n"), ("int", "bigint") * 2)), *PACKED)
    seen._lectern_path = near._lectern_path
    return seen


#: Neighbours as bytes: numbers of 32 bits of the words after a word, of 64 bits of how often, and the same for those before it.
PACKED = ("after", "after_n", "before", "before_n")


def blobs(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary values: the bytes of ``values`` cut at ``at``."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(values, at) of ``blobs``."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view(kind), (at - at[0]) // np.dtype(kind).itemsize


def unpacked(kind: str):
    """A Column function: a binary column of ``blobs`` as arrays of int or bigint."""

    @F.arrow_udf(f"array<{kind}>")
    def lists(x: pa.Array) -> pa.Array:
        values, at = flat(x, np.int32 if kind == "int" else np.int64)
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))

    return lists


def _xlogx(x):
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(table: np.ndarray) -> float:
    """The part of the class bigram log-likelihood that depends on the classes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(1)).sum() - _xlogx(table.sum(0)).sum())


def best_class(table: np.ndarray, rows: np.ndarray, cols: np.ndarray, right: np.ndarray, left: np.ndarray, loop: float, old: int, classes: int) -> tuple[int, float]:
    """``best_classes`` of one word."""
    new, gain = best_classes(table, rows, cols, right[None], left[None], np.array([loop]), np.array([old]), classes)
    return int(new[0]), float(gain[0])


def best_classes(table: np.ndarray, rows: np.ndarray, cols: np.ndarray, right: np.ndarray, left: np.ndarray, loop: np.ndarray, old: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(the class, of the first ``classes``, that each word of class ``old`` fits best, by how much ``likelihood`` grows); (``old``, 0) where none is better.

    ``right``, ``left``: rows of how often classes stand beside a word, without its ``loop`` occurrences beside itself; ``rows``, ``cols``: sums of
    ``table``. Only classes that stand beside a word change what its own class adds, so a rare word's few are looked at alone.
    """
    each, c = np.arange(len(old)), np.arange(classes)
    gain = np.zeros((len(old), classes))
    for t, mine, others in ((table.T, right, left), (table, left, right)):
        w, k = np.nonzero(mine)
        if not len(w):
            continue
        n, own, e = mine[w, k], old[w], np.arange(len(w))
        # a row's entries are those of the word's class pairs, without the word where they have it
        held = t[k, :classes]
        was = _xlogx(t[:, :classes])[k]
        self_ = k == own
        held[self_] -= others[w[self_], :classes]
        held[e, own] -= n + self_ * loop[w]
        was[self_] = _xlogx(held[self_])
        was[e, own] = _xlogx(held[e, own])
        grown = _xlogx(held + n[:, None]) - was
        inner = k < classes
        grown[e[inner], k[inner]] = 0  # the corner is below
        starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        gain[w[starts]] += np.add.reduceat(grown, starts)
    corner = np.tile(table[c, c], (len(old), 1))
    corner[each, old] -= right[each, old] + left[each, old] + loop
    gain += _xlogx(corner + right[:, :classes] + left[:, :classes] + loop[:, None]) - _xlogx(corner)
    for sums, n in ((rows, right.sum(1) + loop), (cols, left.sum(1) + loop)):
        held = np.tile(sums[:classes], (len(old), 1))
        held[each, old] -= n
        gain -= _xlogx(held + n[:, None]) - _xlogx(held)
    new = gain.argmax(1)
    grows = gain[each, new] - gain[each, old]
    better = grows > 1e-9
    return np.where(better, new, old), np.where(better, grows, 0.0)


def class_table(near: DataFrame, of: np.ndarray, total: int) -> np.ndarray:
    """Bigrams of classes, from the table of ``neighbours``; one table for each row of classes where ``of`` has several.

    A task gives one row, the sums of what it reads: rows grow with tasks alone.
    """
    many = np.atleast_2d(of)
    shared = near.sparkSession.sparkContext.broadcast(many)  # a byte a clustered word, a few times

    def run(batches):
        many = shared.value
        out = np.zeros((len(many), total * total))
        for batch in batches:
            if not batch.num_rows:
                continue
            word = batch.column("word").to_numpy()
            (beside, at), (n, _) = flat(batch.column("after"), np.int32), flat(batch.column("after_n"), np.int64)
            for k, of in enumerate(many):
                out[k] += np.bincount(np.repeat(of[word].astype(np.int64) * total, np.diff(at)) + of[beside], weights=n, minlength=total * total)
        yield pa.RecordBatch.from_arrays([pa.array([out.ravel().astype(np.int64)], pa.list_(pa.int64()))], names=["n"])

    parts = near.select("word", "after", "after_n").coalesce(ADDERS).mapInArrow(run, "n array<bigint>")
    with arrow_rows(near.sparkSession, WORDS):
        got = parts.toArrow().column("n").combine_chunks()  # classes squared, ADDERS times at most
    shared.destroy()
    tables = got.flatten().to_numpy().reshape(-1, len(many), total, total).sum(0).astype(float)
    return tables if of.ndim > 1 else tables[0]


def moves(near: DataFrame, of: np.ndarray, table: np.ndarray, classes: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, new classes) of the clustered words of one half that another class fits better, all else as it is; those that gain most first."""
    size, total = len(of) - 2, len(table)
    shared = near.sparkSession.sparkContext.broadcast((of, table))

    def run(batches):
        of, table = shared.value
        rows, cols = table.sum(1), table.sum(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            word = batch.column("word").to_numpy()
            beside = []
            for side in ("after", "before"):
                (other, cut), (n, _) = flat(batch.column(side), np.int32), flat(batch.column(side + "_n"), np.int64)
                at = np.repeat(np.arange(len(word)), np.diff(cut))
                beside.append(np.bincount(at * total + of[other], weights=n, minlength=len(word) * total).reshape(-1, total))
                if side == "after":
                    self_ = other == word[at]
                    loops = np.bincount(at[self_], weights=n[self_], minlength=len(word))
            old = of[word].astype(np.int64)
            each = np.arange(len(word))
            for x in beside:
                x[each, old] -= loops
            best, gain = best_classes(table, rows, cols, *beside, loops, old, classes)
            moved = best != old
            yield pa.RecordBatch.from_arrays([pa.array(word[moved], pa.int32()), pa.array(best[moved].astype(np.int8)), pa.array(gain[moved].astype(np.float32))], names=["word", "new", "gain"])

    mine = near.select("word", *PACKED).where((F.col("word") < size) & (F.pmod(F.xxhash64("word"), F.lit(2)) == half))
    with arrow_rows(near.sparkSession, WORDS):
        got = mine.mapInArrow(run, "word int, new tinyint, gain float").toArrow()  # nine bytes a moved word
    shared.destroy()
    order = np.lexsort((got.column("word").to_numpy(), -got.column("gain").to_numpy()))
    return got.column("word").to_numpy()[order], got.column("new").to_numpy()[order]


def exchange(near: DataFrame, size: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of each symbol, bigrams of classes): sweeps over ``neighbours`` until no word moves or the likelihood stands still.

    The last two symbols keep classes of their own. The most frequent words begin in classes of their own, the others are
    dealt out. Moves of a sweep are chosen by the same state; if together they lower the likelihood, only the quarter
    that gains most is made, and so on, so that it never falls and the sweeps come to an end.
    """
    classes = max(1, min(classes, size)) if size else 0
    total = classes + 2
    of = np.concatenate([np.arange(size) % max(classes, 1), [classes, classes + 1]]).astype(np.uint8)
    table = class_table(near, of, total)
    now, still = likelihood(table), 0
    before = now
    half = 0
    while still < 2 and classes > 1:
        words, new = moves(near, of, table, classes, half)
        n_moves = len(words)
        # all moves, or else the most of those that gain most: cuts are tried CUTS at once
        while len(words):
            cuts = [len(words)] if len(words) == n_moves else [n for n in (len(words) // 4**k for k in range(CUTS)) if n]
            tried = np.tile(of, (len(cuts), 1))
            for row, n in zip(tried, cuts):
                row[words[:n]] = new[:n]
            changed = class_table(near, tried, total)
            best = next((k for k in range(len(cuts)) if likelihood(changed[k]) > now), None)
            if best is not None:
                of, table, now = tried[best], changed[best], likelihood(changed[best])
                break
            words, new = words[: cuts[-1] // 4], new[: cuts[-1] // 4]
        still = 0 if len(words) else still + 1
        if half and now - before < GAIN * table.sum():
            break
        if half:
            before = now
        half = 1 - half
    return of.astype(np.int64), table


def fit(train: DataFrame, text: str = "text", head: int = HEAD, clustered: int | None = None, least: int = LEAST, classes: int = CLASSES, *, learn: str = "true", keep: list[str] | None = None) -> tuple[dict, DataFrame]:
    """(model, counts): what the driver holds is ``head`` words at most and a byte a clustered word; counts (token, c, id) is a table of all training tokens.

    Words of ``least`` occurrences are clustered; of those, with ``clustered``, only words of one in so many tokens. With ``keep``, ``train`` may
    have rows for which ``learn`` is false, which are not learnt from, and the model holds ``coded`` and ``met``, the tables that ``score`` reads, of all its rows, and those of counts as ``done``.
    """
    only = train.where(learn)
    with arrow_rows(train.sparkSession, TEXTS):
        counted = materialise(token_counts(only, text))
    totals = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("token") == F.lit(END), F.col("c"))), F.lit(0))).first()
    n_tokens, vocabulary, ends = (int(x) for x in totals)
    head_bar, bar = max(1, -(-n_tokens // head)), max(least, -(-n_tokens // clustered) if clustered else 1)
    top = frequent(counted, head_bar)
    words = [t for t, _ in top]
    freq = np.array([c for _, c in top], dtype=np.float64)
    counts, rarer = numbered(counted, len(words), head_bar, bar)
    size = int((freq >= bar).sum()) + rarer
    ids = {w: k for k, w in enumerate(words)}
    learnt = pick_unused(train, "_learnt")
    held = coded(train.withColumn(learnt, F.expr(learn)) if keep else only.withColumn(learnt, F.lit(True)), ids, [*(keep or []), learnt], text)
    rare = met(held, counts, ["_row", learnt])
    near = neighbours(held.where(learnt), None, size, rare=rare.where(learnt))
    of, table = exchange(near, size, classes)
    discard(near)
    total = len(table)
    open_class = total - 2
    word_class = np.full(len(words), open_class, dtype=np.int64)
    word_class[: min(size, len(words))] = of[: min(size, len(words))]
    # every token is the second of one bigram; the open class also has one unseen word
    mass, members = table.sum(0), np.bincount(of[:size], minlength=total).astype(float)
    members[open_class] += max(vocabulary - size - (1 if ends else 0), 0) + 1
    denom = mass + DELTA * members
    emit = np.log10((freq + DELTA) / denom[word_class]) if len(words) else np.zeros(0)
    column = table.sum(0)
    start = (column + 0.5) / (column.sum() + 0.5 * total)
    step = np.log10((table + BACKOFF * start) / (table.sum(1, keepdims=True) + BACKOFF))
    model = {
        "ids": ids, "class_of": np.concatenate([word_class, [open_class, total - 1]]), "step": step, "emit": np.append(emit, [0.0, 0.0]), "of": of[:size].astype(np.uint8),
        "head_count": np.append(freq, [0.0, float(ends)]), "denom": denom, "n_tokens": n_tokens, "vocabulary": vocabulary,
    }
    if keep:
        return model | {"coded": held, "met": rare, "done": (counted, counts)}, counts
    discard(held)
    discard(rare)
    return model, counts


def score(docs: DataFrame, model: dict, counts: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with n_tokens, n_known, base_score and score of every whole text.

    base_score: add-0.1 unigram; score: log10 probability under the class model; both cover the end. Null texts are empty. A model that holds
    these rows ``coded`` is used once: the table is deleted.
    """
    held = model["coded"] if "coded" in model else coded(docs, model["ids"], keep, text)
    rare = model["met"] if "met" in model else met(held, counts, ["_row"])
    spark = held.sparkSession
    big_n, v = model["n_tokens"], model["vocabulary"]
    step, denom, open_class = model["step"], model["denom"], len(model["step"]) - 2
    # as of words and then of OPEN, STOP, HOLE
    counts = np.append(model["head_count"], 0.0)
    emit, base = np.append(model["emit"], 0.0), np.log10((counts + DELTA) / (big_n + DELTA * (v + 1)))
    base[[OPEN, HOLE]] = 0.0
    known = (counts > 0).astype(np.int64)
    class_of = np.append(model["class_of"], open_class + 2)
    wide = np.pad(step, (0, 1))  # nothing beside a hole
    shared = spark.sparkContext.broadcast((class_of, wide, emit, base, known))  # HEAD words and CLASSES squared numbers at most

    def run(batches):
        class_of, wide, emit, base, known = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                flat, stops = stopped([np.frombuffer(x, np.int32) for x in part.column(len(keep) + 1).to_pylist()])
                c, to = class_of[flat], flat[1:]
                sums = [np.add.reduceat(x, stops[:-1]) for x in (known[to], base[to], wide[c[:-1], c[1:]] + emit[to])]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep) + 1)), pa.array(np.diff(stops)), *map(pa.array, sums)], names=[*keep, "_row", "n_tokens", "n_known", "base_score", "score"])

    schema = extended(held.select(*keep, "_row").schema, "n_tokens long, n_known long, base_score double, score double")
    with arrow_rows(spark, TEXTS):
        read = materialise(held.select(*keep, "_row", "_codes").mapInArrow(run, schema))
    shared.destroy()
    discard(held)
    last = np.append(model["of"], [open_class] * max(0, len(model["ids"]) - len(model["of"])) + [open_class, open_class + 1, open_class + 2]).astype(np.uint8)
    classes = spark.sparkContext.broadcast((last, wide, denom))  # a byte a clustered word

    @F.arrow_udf("double")
    def told(before: pa.Array, at: pa.Array, after: pa.Array, c: pa.Array) -> pa.Array:
        of, wide, denom = classes.value
        before, at, after = (of[x.to_numpy()] for x in (before, at, after))
        n = c.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nan for null
        return pa.array(wide[before, at] + wide[at, after] + np.where(np.isnan(n), 0.0, np.log10((n + DELTA) / denom[at])))

    sums = rare.select("_row", "c", told("before", "at", "after", "c").alias("s")).groupBy("_row").agg(
        F.sum(F.when(F.col("c") > 0, 1).otherwise(0)).alias("k"),
        F.sum(F.log10((F.col("c") + DELTA) / F.lit(big_n + DELTA * (v + 1)))).alias("b"),
        F.sum("s").alias("s"),
    )
    return read.join(sums, "_row", "left").select(
        *keep,
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        (F.col("base_score") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )


def brown_scores(docs: DataFrame, id_col: str = "doc_id", text: str = "text", held_out_of: int = 10) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learns from the documents whose crc32(id as text) mod ``held_out_of`` is
    not 0 and scores all. Null ids count as the empty text there; repeated
    rows are learnt and scored each; with no training rows every word is
    unseen and scores stay finite; empty input: no rows.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    docs = docs.withColumn("held_out", crc32_of_id("doc_id") % held_out_of == 0)
    with settings(docs.sparkSession, LEAN):
        model, counts = fit(docs, learn="not held_out", keep=["doc_id", "held_out"])
        for x in model["done"]:
            discard(x)
        out = score(docs, model, counts, ["doc_id", "held_out"])
    return out.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model["n_tokens"]).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))

"""Secret spans: three literal kinds, and strings that a battery of randomness tests takes for random.

Candidates are maximal runs of one encoding's alphabet, 20 characters or
more. The encoding is inferred as the smallest alphabet that holds the run
(decimal digits alone are no candidate). Three tests per run, each against
"uniform and independent over the alphabet":

* chi-squared of symbol counts (in equal groups, so that short runs have
  expected counts near 4 or more): natural text gives far too large a value;
* Wald-Wolfowitz runs above and below the alphabet's middle;
* lag-1 serial correlation of symbol values.

Fisher's method combines their p-values to one statistic: -2 times the sum of
their logarithms, chi-squared with 6 degrees of freedom for a random run
whatever its length, and growing with the length for word-like text. So the
logarithm of the statistic per symbol is what is judged: for word-like text it
is near normal, with a mean and a deviation that are fitted to all runs of the
corpus, per encoding and length class (a cell), beside a share of random runs
whose distribution is known. A prior stands for ``PRIOR_RUNS`` word-like runs,
so that a cell with few of them has a fit too.

The false-discovery p-value of a run is the chance that word-like text of its
cell looks this random: long runs can give small ones and short runs
cannot. Benjamini-Hochberg at level ``FDR`` runs within each length class over
all runs of the corpus, in fixed bins, so that many short candidates don't set
the bar for the few long ones. A run that is implausible as random is never taken.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import extended, materialise, pick_unused

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
KINDS = ("assign", "access", "hex", "random")
#: (name, alphabet in order), smallest first.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: A run with a combined p-value below this is not random.
CONSISTENT = 1e-3
#: The combined statistic's value there: the upper 0.001 of chi-squared with 6 degrees of freedom.
FAR = 22.458
#: Level of the false-discovery control within a length class.
FDR = 0.01
#: Upper ends of the length classes (the last is open).
LENGTHS = (24, 32, 48, 64, 128)
CLASSES = len(LENGTHS) + 1
#: The statistic's logarithm per symbol is counted in bins of STEP from LOW on.
LOW, STEP, BINS = -8.0, 0.05, 280
#: Mean (by length class) and deviation of word-like runs before any are seen, and how many runs that is worth.
PRIOR_MEANS = (-0.5, -0.5, -0.4, -0.2, 0.0, 0.5)
PRIOR_SD = 0.45
PRIOR_RUNS = 50
#: The upper tenth of chi-squared with 6 degrees of freedom.
UPPER_TENTH = 10.645
#: Steps in which the share of random runs is found.
EXPECTATIONS = 40
#: A p-value that counts as zero.
TINY = 1e-300


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


_tails = np.vectorize(_normal_tail, otypes=[float])


def _upper_chi2(x: float, df: int) -> float:
    """P(chi-squared >= x), by the Wilson-Hilferty cube root."""
    return _normal_tail(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def infer_encoding(run: str) -> tuple[str, str] | None:
    """(name, alphabet) of the smallest alphabet that holds ``run``; None for digits alone and for mixed alphabets."""
    seen = set(run)
    if len(seen & set("0123456789")) == len(seen):
        return None
    return next((x for x in ALPHABETS if seen <= set(x[1])), None)


def battery(run: str, alphabet: str) -> tuple[float, float, float] | None:
    """P-values of the three tests against uniform and independent symbols of ``alphabet``; None for letters alone of a large one.

    A run on one side of its alphabet's middle has no count of runs to test: its value is the chance of that, as for equal symbols throughout.
    """
    n, size = len(run), len(alphabet)
    if size > 32 and not any(c.isdigit() for c in run):
        return None  # letters alone: names and words of mixed case
    values = np.array([alphabet.index(c) for c in run])
    groups = max(4, min(size, n // 4))
    counts = np.bincount(values * groups // size, minlength=groups)
    share = np.bincount(np.arange(size) * groups // size, minlength=groups) / size
    uniform = _upper_chi2(float(((counts - n * share) ** 2 / (n * share)).sum()), groups - 1)
    high = values * 2 >= size
    a, b = int(high.sum()), int(n - high.sum())
    order = serial = 2.0 ** (1 - n)
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        order = 2 * _normal_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    centred = values - values.mean()
    spread = float((centred**2).sum())
    if spread:
        serial = 2 * _normal_tail(abs(float((centred[1:] * centred[:-1]).sum()) / spread + 1 / n) * math.sqrt(n))
    return uniform, order, serial


def combined(ps: tuple[float, ...]) -> float:
    """Fisher's statistic of p-values."""
    return -2 * sum(math.log(max(p, TINY)) for p in ps)


def measured(run: str) -> tuple[int, int, bool] | None:
    """(cell, bin, whether the run may be random); None if it has no encoding."""
    encoding = infer_encoding(run)
    ps = battery(run, encoding[1]) if encoding else None
    if ps is None:
        return None
    value, n = combined(ps), len(run)
    at = math.ceil((math.log(max(value, TINY) / n) - LOW) / STEP)
    return ALPHABETS.index(encoding) * CLASSES + length_class(n), min(max(at, 0), BINS), value <= FAR


def length_class(n: int) -> int:
    return sum(n > x for x in LENGTHS)


def upper_end(at):
    """The largest logarithm per symbol of a bin."""
    return LOW + STEP * at


def random_shares(k: int) -> np.ndarray:
    """The share of each bin among random runs of length class ``k``, every length of the class alike (the open one up to twice its lowest)."""
    shortest = LENGTHS[k - 1] + 1 if k else 20
    longest = LENGTHS[k] if k < len(LENGTHS) else 2 * shortest
    half = np.exp(upper_end(np.arange(BINS + 1)))[:, None] * np.arange(shortest, longest + 1) / 2
    below = (1 - np.exp(-half) * (1 + half + half**2 / 2)).mean(axis=1)
    return np.diff(below, prepend=0.0)


def word_like(counts: np.ndarray, k: int) -> tuple[float, float]:
    """Mean and deviation of word-like runs of length class ``k`` in one encoding, where ``counts`` (runs in each bin) mixes them with random ones.

    The best of a grid of normals, then of a finer one around it, each normal with its own best share of random runs (by expectation steps);
    the divergence from the prior counts PRIOR_RUNS times against it. No mean lies below the upper tenth of random runs: there the two could
    not be told apart.
    """
    middle = math.sqrt((LENGTHS[k - 1] + 1 if k else 20) * (LENGTHS[k] if k < len(LENGTHS) else 2 * LENGTHS[-1]))
    lowest = math.log(UPPER_TENTH / middle)
    bins = np.flatnonzero(counts)
    known = np.maximum(random_shares(k)[bins], TINY)

    def best(means: np.ndarray, sds: np.ndarray) -> tuple[float, float]:
        mean, sd = (x.ravel()[:, None] for x in np.meshgrid(np.maximum(means, lowest), np.maximum(sds, 0.1), indexing="ij"))
        fit = -PRIOR_RUNS * (np.log(sd / PRIOR_SD) + (PRIOR_SD**2 + (PRIOR_MEANS[k] - mean) ** 2) / (2 * sd**2) - 0.5)
        if len(bins):
            held = counts[bins] / counts[bins].sum()
            inside = np.maximum(_tails((upper_end(bins - 1) - mean) / sd) - _tails((upper_end(bins) - mean) / sd), TINY)
            share = np.full_like(mean, 0.5)
            for _ in range(EXPECTATIONS):
                share = (share * known / (share * known + (1 - share) * inside) * held).sum(axis=1, keepdims=True)
            fit = fit + (np.log(share * known + (1 - share) * inside) * counts[bins]).sum(axis=1, keepdims=True)
        at = int(fit.argmax())
        return float(mean[at, 0]), float(sd[at, 0])

    mean, sd = best(np.arange(-2.5, 3.0, 0.1), np.arange(0.1, 1.3, 0.1))
    around = np.arange(-4, 5) * 0.025
    return best(mean + around, sd + around)


def literal_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three literal kinds, leftmost and non-overlapping within a kind."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "key" in low or "K" in text or "ſ" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of ``docs``, literal (spans) and runs (start, end, cell, bin, whether it may be random)."""
    keep = [c for c in docs.columns if c != text]
    span = "array<struct<start:bigint,kind:int,stop:bigint>>"
    run_type = "array<struct<start:bigint,stop:bigint,cell:int,bin:int,near:boolean>>"

    def run(batches):
        for batch in batches:
            literal, found = [], []
            for x in batch.column(len(keep)).to_pylist():
                x = x or ""
                literal.append([{"start": a, "kind": k, "stop": b} for a, k, b in sorted(literal_spans(x))])
                mine = []
                for m in RUN.finditer(x):
                    got = measured(m[0])
                    if got:
                        mine.append({"start": m.start(), "stop": m.end(), "cell": got[0], "bin": got[1], "near": got[2]})
                found.append(mine)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in keep),
                    pa.array(literal, pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())]))),
                    pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("cell", pa.int32()), ("bin", pa.int32()), ("near", pa.bool_())]))),
                ],
                names=[*keep, "literal", "runs"],
            )

    schema = extended(docs.select(*keep).schema, f"literal {span}, runs {run_type}")
    return docs.select(*keep, F.col(text).alias(pick_unused(docs, "_text"))).mapInArrow(run, schema)


def thresholds(counts: dict[tuple[int, int], int], fdr: float = FDR) -> list[int]:
    """For each cell the largest bin that Benjamini-Hochberg within its length class accepts (-1: none), of ``counts`` of (cell, bin): all runs, also those that can't be random."""
    out = [-1] * (len(ALPHABETS) * CLASSES)
    for k in range(CLASSES):
        tested = []  # (p-value, runs, cell, bin)
        for cell in range(k, len(out), CLASSES):
            bins = np.zeros(BINS + 1, dtype=np.int64)
            for (c, b), n in counts.items():
                if c == cell:
                    bins[b] += n
            held = np.flatnonzero(bins)
            if len(held):
                mean, sd = word_like(bins, k)
                # all of a bin's p-values are at most that of its upper end
                tested += zip(_tails((mean - upper_end(held)) / sd).tolist(), bins[held].tolist(), [cell] * len(held), held.tolist())
        total = sum(n for _, n, _, _ in tested)
        level, before = 0.0, 0
        for p, n, _, _ in sorted(tested):
            before += n
            if p <= fdr * before / total:
                level = p
        for p, _, cell, b in tested:
            if p <= level:
                out[cell] = max(out[cell], b)
    return out


def find_secrets(docs: DataFrame, text: str = "text", fdr: float = FDR) -> DataFrame:
    """The other columns of ``docs`` and ``spans``: array of (start, kind, stop) by start, then kind, in code points, stop exclusive.

    kind: index into KINDS. Null texts have no spans; overlaps between kinds
    stay. Two readings of what the first pass kept, none of the texts.
    """
    held = materialise(candidates(docs, text))
    bins = held.select(F.explode("runs").alias("r")).groupBy("r.cell", "r.bin").count().collect()  # cells x bins at most
    most = thresholds({(r[0], r[1]): r[2] for r in bins}, fdr)
    passed = F.filter("runs", lambda r: r["near"] & (r["bin"] <= F.element_at(F.lit(most), r["cell"] + 1)))
    extra = F.transform(passed, lambda r: F.struct(r["start"].alias("start"), F.lit(KINDS.index("random")).cast("int").alias("kind"), r["stop"].alias("stop")))
    return held.withColumn("spans", F.array_sort(F.concat("literal", extra))).drop("literal", "runs")


def joined(spans, kinds: int):
    """kind:start:end of the spans of the first ``kinds`` kinds, comma-joined."""
    named = F.filter(spans, lambda s: s["kind"] < kinds)
    text = F.transform(named, lambda s: F.concat_ws(":", F.element_at(F.lit(list(KINDS)), s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(text, ",")


def most_bins(docs: DataFrame, text: str = "text", fdr: float = FDR) -> list[int]:
    """``thresholds`` of all runs of all texts; the reading keeps nothing but counts of bins."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                for m in RUN.finditer(x or ""):
                    got = measured(m[0])
                    if got:
                        counts[got[:2]] += 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([b for _, b in keys], pa.int32()), pa.array(counts.values(), pa.int64())], names=["k", "bin", "n"])

    bins = docs.select(text).mapInArrow(run, "k int, bin int, n long").groupBy("k", "bin").agg(F.sum("n")).collect()  # cells x bins at most
    return thresholds({(r[0], r[1]): r[2] for r in bins}, fdr)


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]", fdr: float = FDR) -> DataFrame:
    """``docs`` with each found span (overlapping ones as one) in ``text`` replaced by ``mark``; other columns as they are.

    Documents without spans keep their text; null texts stay null; extra columns may have any names. Two readings of
    ``docs``: one for the level of the corpus, one that finds and replaces; nothing is stored between them.
    """
    most, names = most_bins(docs, text, fdr), docs.columns
    at = names.index(text)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for k, x in enumerate(texts):
                if not x:
                    continue
                spans = [(start, stop) for start, _, stop in literal_spans(x)]
                for m in RUN.finditer(x):
                    got = measured(m[0])
                    if got and got[2] and got[1] <= most[got[0]]:
                        spans.append(m.span())
                if spans:
                    texts[k] = cut_out(x, spans, mark)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def cut_out(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """``text`` with the union of ``spans`` replaced by ``mark``."""
    out, at = [], 0
    for start, stop in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, stop)
    return "".join([*out, text[at:]])



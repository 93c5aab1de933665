"""Quality classifier by compression.

Two zstandard dictionaries are built from whole good and whole bad labelled
texts. A text's inputs are the normalised difference of its compressed sizes
under the two, (bad - good) / bytes, and its plain compressed size / bytes (a
text of repetitions compresses to little under any dictionary). A logistic
curve fitted on labelled texts that no dictionary has seen makes them a score.
Labels, lang, source and ids never enter a score.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import crc32_of_id, discard, extended, materialise, pick_unused, worker_cache

#: Labelled texts taken for each dictionary, and for the curve. The fit is on this bounded sample.
DICTIONARY_TEXTS = 3_000
CURVE_TEXTS = 4_000
#: Labelled texts above this many characters are not sampled (all texts are scored whole).
SAMPLE_CHARS = 50_000
DICTIONARY_BYTES = 400_000
LEVEL = 3
THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, float, float]
    key: str


class Sizes:
    """A text's inputs under a pair of dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        def compressor(content):
            if not content:
                return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=d, write_content_size=False)

        self.good, self.bad, self.plain = compressor(good), compressor(bad), compressor(b"")

    def inputs(self, text: str | None) -> tuple[float, float]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw:
            return 0.0, 0.0
        n = len(raw)
        return (len(self.bad.compress(raw)) - len(self.good.compress(raw))) / n, len(self.plain.compress(raw)) / n


def logistic(inputs: np.ndarray, wanted: np.ndarray, rounds: int = 40, ridge: float = 1e-3) -> tuple[float, ...]:
    """Weights of a logistic curve, the constant last, by Newton's method."""
    x = np.c_[inputs, np.ones(len(inputs))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - wanted) + ridge * w
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
    return tuple(float(v) for v in w)


def fitting(sizes: list[int], limit: int = DICTIONARY_BYTES) -> list[int]:
    """Positions of the texts, of so many bytes each, that fill ``limit`` bytes in the given order; one that no longer fits is passed over."""
    out, held = [], 0
    for k, n in enumerate(sizes):
        if n and held + n <= limit:
            out.append(k)
            held += n + 1
    return out


def fit(docs: DataFrame, labels: DataFrame, held_out_of: int = 5, id_col: str = "doc_id", text: str = "text") -> QualityModel:
    """Learns from a bounded sample of rows whose crc32(id as text) mod ``held_out_of`` is not 0.

    Samples follow a hash order of the ids: dictionary rows from one half,
    curve rows from the other. A label with both values counts as 0. With no
    usable row of one class, or none at all, scores are the share of good
    labels seen (0.5 for none).
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isin(0, 1)).groupBy(id_col).agg(F.min("quality").alias("quality"))
    known = known.where(crc32_of_id(id_col) % held_out_of != 0).withColumn("_h", F.xxhash64(F.col(id_col), F.lit(5)))
    half = F.pmod(F.col("_h"), F.lit(2))
    parts = [
        known.where((half == 0) & (F.col("quality") == q)).orderBy("_h").limit(DICTIONARY_TEXTS).withColumn("_use", F.lit(q)) for q in (0, 1)
    ] + [known.where(half == 1).orderBy("_h").limit(CURVE_TEXTS).withColumn("_use", F.lit(2))]
    chosen = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # at most 2 * DICTIONARY_TEXTS + CURVE_TEXTS ids, so broadcast: the texts are read in place
    met = docs.select(F.col(id_col), F.col(text).alias("_text")).where(F.length("_text") <= SAMPLE_CHARS).join(F.broadcast(chosen), id_col)
    sample = materialise(met.groupBy("_use", "quality", "_h").agg(F.min("_text").alias("_text")))
    # the driver sees sizes of the sample, the texts that fill the dictionaries, and two numbers for each text of the curve
    known = sorted((r[1], r[0], r[2]) for r in sample.where("_use < 2").select("_use", "_h", F.octet_length("_text")).collect())
    taken = []
    for q in (0, 1):
        mine = [(h, n) for h, use, n in known if use == q]
        taken += [(q, mine[k][0]) for k in fitting([n for _, n in mine])]
    texts = {}
    if taken:
        wanted = sample.where("_use < 2").where(F.col("_h").isin([h for _, h in taken])).select("_use", "_h", "_text").toArrow().to_pylist()
        texts = {(r["_use"], r["_h"]): r["_text"].encode("utf-8", "surrogatepass") for r in wanted}
    bad, good = (b"\n".join(texts[q, h] for use, h in taken if use == q) for q in (0, 1))
    key = hashlib.sha256(good + b"|" + bad).hexdigest()
    curve = sample.where("_use = 2") if not sample.where("_use = 2").isEmpty() else sample
    rows = measured(curve.select("quality", "_h", "_text"), QualityModel(good, bad, (0.0, 0.0, 0.0), key)).orderBy("_h").collect()  # at most 2 * DICTIONARY_TEXTS + CURVE_TEXTS
    discard(sample)
    labels_ = np.array([r["quality"] for r in rows], dtype=float)
    if len(set(labels_.tolist())) < 2:
        share = (labels_.sum() + 1) / (len(labels_) + 2)
        weights = (0.0, 0.0, math.log(share / (1 - share)))
    else:
        weights = logistic(np.array([(r["u"], r["v"]) for r in rows]), labels_)
    return QualityModel(good, bad, weights, key)


def sizes_of(model: QualityModel) -> Sizes:
    """The compressors of a model, made once in a worker."""
    cache = worker_cache()
    if cache.get("quality key") != model.key:
        cache["quality key"], cache["quality"] = model.key, Sizes(model.good, model.bad)
    return cache["quality"]


def measured(rows: DataFrame, model: QualityModel) -> DataFrame:
    """(quality, _h, u, v) of ``rows`` (quality, _h, _text): the inputs of each text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES

    def run(batches):
        sizes = sizes_of(shared.value)
        for batch in batches:
            inputs = [sizes.inputs(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([u for u, _ in inputs], pa.float64()), pa.array([v for _, v in inputs], pa.float64())], names=["quality", "_h", "u", "v"])

    return rows.mapInArrow(run, rows.select("quality", "_h").schema.add("u", "double").add("v", "double"))


def score(docs: DataFrame, model: QualityModel, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with ``column``: the probability of label 1, of every whole text; null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES
    names = docs.columns
    scan = pick_unused(docs, "_scan")

    def run(batches):
        sizes, (a, b, c) = sizes_of(shared.value), shared.value.weights
        for batch in batches:
            out = []
            for x in batch.column(scan).to_pylist():
                u, v = sizes.inputs(x)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, a * u + b * v + c)))))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(out, pa.float64())], names=[*names, column])

    schema = extended(docs.schema, f"{column} double")
    return docs.select(*names, F.col(text).alias(scan)).mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", held_out_of: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, held_out, score, predicted (1 if score >= ``threshold``).

    Repeated rows are scored each; null ids count as the empty text for
    held_out; null texts score as empty; empty input: no rows.
    """
    model = fit(docs, labels, held_out_of, id_col, text)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    out = score(narrow, model).drop("text")
    return out.select(
        F.col("doc_id").alias(id_col),
        (crc32_of_id("doc_id") % held_out_of == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, all columns as they are."""
    column = pick_unused(docs, "_quality")
    scored = score(docs, fit(docs, labels, 5, id_col, text), text, column)
    return scored.where(F.col(column) >= threshold).drop(column)

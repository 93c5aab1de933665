"""Media columns: texts as 8-bit WAV samples, short-time spectra, spectral-peak pair fingerprints.

A payload becomes a mono 8-bit WAV file; the wave module reads its samples
back. Frames of FRAME samples, HOP apart, are windowed and transformed; each
frame keeps its PEAKS strongest local maxima. Two peaks of a frame, and a peak
and the strongest one of each of the next REACH frames, make a pair
(f1, f2, dt), stored as a 32-bit code in an array beside the array of frame
numbers, both in time order. The least payload has two frames, and a frame of
samples that differ has two peaks, so only constant samples have no pair.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import extended, pick_unused

UNIT = 192
FRAME = 128
HOP = 64
RATE = 8_000
#: Peaks of a frame.
PEAKS = 2
#: Frames ahead that a peak is paired with.
REACH = 4
#: Frames transformed at a time.
BLOCK = 4_096


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes of the text, blanks appended to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def frame_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frequency bins, strengths) of the PEAKS strongest local maxima of each frame, strongest first; largest other bins where there are fewer."""
    n_frames = max(1, (len(samples) - FRAME) // HOP + 1)
    if len(samples) < FRAME:
        samples = np.concatenate([samples, np.full(FRAME - len(samples), 128, dtype=samples.dtype)])
    view = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n_frames]
    window = np.hamming(FRAME).astype(np.float32)  # no sample weighs nothing
    bins, strengths = np.empty((n_frames, PEAKS), dtype=np.int64), np.empty((n_frames, PEAKS), dtype=np.float32)
    for lo in range(0, n_frames, BLOCK):
        part = view[lo : lo + BLOCK].astype(np.float32)
        part -= part.mean(axis=1, keepdims=True)
        part *= window
        spectrum = np.fft.rfft(part, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        power[:, :2] = 0  # what the window leaks of the mean
        inner = power[:, 1:-1].copy()
        local = (inner >= power[:, :-2]) & (inner > power[:, 2:])
        rank = np.where(local, inner + power.max(axis=1, keepdims=True), inner)  # local maxima before the others
        rows = np.arange(len(part))
        for k in range(PEAKS):
            best = rank.argmax(axis=1)
            bins[lo : lo + BLOCK, k] = best + 1
            strengths[lo : lo + BLOCK, k] = inner[rows, best]
            rank[rows, best] = -1
    return bins, strengths


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frequency bin, strength) of the strongest local maximum of each frame; a frame without one has its largest bin."""
    bins, strengths = frame_peaks(samples)
    return bins[:, 0], strengths[:, 0]


def peak_pairs(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, code) of all peak pairs in time order, a frame's strongest first; code: f1 << 16 | f2 << 4 | dt."""
    bins, strengths = frame_peaks(samples)
    n, found = len(bins), []
    zone = [(k, 0, dt) for k in range(PEAKS) for dt in range(1, REACH + 1)] + [(k, m, 0) for k in range(PEAKS) for m in range(k + 1, PEAKS)]
    for order, (k, m, dt) in enumerate(sorted(zone)):
        at = np.flatnonzero((strengths[: max(n - dt, 0), k] > 0) & (strengths[dt:, m] > 0))
        found.append((at, np.full(len(at), order), bins[at, k] << 16 | bins[at + dt, m] << 4 | dt))
    frame, order, code = (np.concatenate(x) for x in zip(*found))
    by_time = np.lexsort((order, frame))
    return frame[by_time], code[by_time]


def media_columns(docs: DataFrame, text: str = "text", with_media: bool = True) -> DataFrame:
    """The other columns of ``docs`` and n_bytes, payload_bytes, payload_sha256, tail_crc32, media (``with_media``), media_bytes, media_sha256, frames, codes.

    Every whole text is stored (null: empty); equal texts give equal values.
    """
    keep = [c for c in docs.columns if c != text]
    kinds = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]
    kinds += [("media", pa.binary())] * with_media
    kinds += [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("frames", pa.list_(pa.int32())), ("codes", pa.list_(pa.int32()))]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                rows = []
                for x in batch.column(len(keep)).slice(lo, 128).to_pylist():
                    media = to_wav(payload_of(x))
                    payload = from_wav(media)
                    frame, code = peak_pairs(np.frombuffer(payload, dtype=np.uint8))
                    rows.append(
                        (len((x or "").encode("utf-8", "surrogatepass")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
                        + ((media,) if with_media else ())
                        + (len(media), hashlib.sha256(media).hexdigest(), frame.astype(np.int32), code.astype(np.int32))
                    )
                cols = [pa.array(list(c), k) for c, (_, k) in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, 128) for c in keep), *cols], names=[*keep, *(n for n, _ in kinds)])

    stored = "media binary, " if with_media else ""
    ddl = f"n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, {stored}media_bytes long, media_sha256 string, frames array<int>, codes array<int>"
    schema = extended(docs.select(*keep).schema, ddl)
    return docs.select(*keep, F.col(text).alias(pick_unused(docs, "_text"))).mapInArrow(run, schema)


def media_digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id and the digest columns; feature: frame:code of all peak pairs, in base 16, comma-joined.

    Constant samples (a null, empty or blank text) have no pair and an empty feature. Null ids and
    repeated rows keep a row each; empty input: no rows.
    """
    held = media_columns(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), with_media=False)
    pairs = F.zip_with("frames", "codes", lambda t, c: F.lower(F.concat_ws(":", F.hex(t.cast("long")), F.hex(c.cast("long")))))
    return held.select(F.col("doc_id").alias(id_col), *held.columns[1:-2], F.array_join(pairs, ",").alias("feature"))

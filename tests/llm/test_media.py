import hashlib
import zlib

import numpy as np

from lectern.llm import media
from lectern.llm.queries import op10_media


def check(rows, got):
    wanted = []
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        wanted.append((str(i), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(wanted)


def test_documents(spark, sf, documents):
    got = op10_media(spark, sf).collect()
    check([(r.doc_id, r.text) for r in documents.collect()], got)
    by_payload = {}
    for r in got:
        assert by_payload.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
        assert r.media_bytes == r.payload_bytes + 44


def test_stored_media_round_trip(clashing, empty):
    for r in media.media_columns(clashing.select("doc_id", "text", clashing.text.alias("t"))).collect():
        payload = media.from_wav(bytes(r.media))
        assert payload == media.payload_of(r.t) and hashlib.sha256(bytes(r.media)).hexdigest() == r.media_sha256
        assert len(r.frames) == len(r.codes) and r.frames == sorted(r.frames)
    check([(r.doc_id, r.text) for r in clashing.collect()], media.media_digest(clashing).collect())
    assert media.media_digest(empty).count() == 0


def test_peaks_find_tones():
    """A tone of bin 20, then one of bin 50."""
    t = np.arange(media.FRAME * 8)
    wave = np.where(t < media.FRAME * 4, np.sin(2 * np.pi * 20 * t / media.FRAME), np.sin(2 * np.pi * 50 * t / media.FRAME))
    bins, _ = media.peaks((128 + 100 * wave).astype(np.uint8))
    assert set(bins[:6]) == {20} and set(bins[-6:]) == {50}
    frames, codes = media.peak_pairs((128 + 100 * wave).astype(np.uint8))
    assert frames[0] == 0 and codes[0] == 20 << 16 | 20 << 4 | 1


def test_blocks_do_not_change_peaks(monkeypatch):
    samples = np.random.default_rng(0).integers(0, 256, 192 * 50).astype(np.uint8)
    whole = media.peak_pairs(samples)
    monkeypatch.setattr(media, "BLOCK", 7)
    assert all((a == b).all() for a, b in zip(whole, media.peak_pairs(samples)))


def test_every_text_of_differing_samples_has_pairs():
    """Down to one letter at either end of the least payload."""
    texts = ["a", "one", "two words", "x" * 191, " " * 191 + "b", "ab" * 96, "word " * 30, "é", "the quick brown fox"]
    assert all(len(media.peak_pairs(np.frombuffer(media.payload_of(t), dtype=np.uint8))[1]) for t in texts)
    for constant in (None, "", "  ", "x" * 192):
        assert not len(media.peak_pairs(np.frombuffer(media.payload_of(constant), dtype=np.uint8))[0])


def test_pairs_within_and_across_frames():
    """Two tones at once pair with each other in each frame and with the strongest in the next ones."""
    t = np.arange(media.FRAME * 4)
    wave = np.sin(2 * np.pi * 12 * t / media.FRAME) + 0.5 * np.sin(2 * np.pi * 40 * t / media.FRAME)
    _, codes = media.peak_pairs((128 + 60 * wave).astype(np.uint8))
    for f1, f2, dt in ((12, 40, 0), (12, 12, 1), (40, 12, 1), (12, 12, media.REACH), (40, 12, media.REACH)):
        assert (f1 << 16 | f2 << 4 | dt) in codes

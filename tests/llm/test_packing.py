import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lectern.llm import packing
from lectern.llm.queries import BYTE_BPE
from lectern.llm.shared import tokenizer_file

PATH = tokenizer_file(BYTE_BPE)


def check(rows, pieces, window):
    tokenizer = Tokenizer.from_file(PATH)
    wanted = defaultdict(list)
    for i, t in rows:
        wanted[i].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
        assert p.ids_crc32 == zlib.crc32(bytes(p.ids)) and len(p.ids) == 4 * p.length
    for i, texts in wanted.items():
        flat = sorted((p.start, p.length, bytes(p.ids)) for p in by_doc[i])
        expected = sorted((s, n, np.array(ids[s : s + n], dtype="<u4").tobytes()) for ids in texts for s, n in packing.cut(len(ids), window))
        assert flat == expected
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return sum(p.length for p in pieces), len(by_sequence)


@pytest.mark.parametrize("window", [2048, 64])
def test_whole_documents(documents, window):
    pieces = packing.pack(documents, PATH, window=window).collect()
    total, sequences = check([(r.doc_id, r.text) for r in documents.collect()], pieces, window)
    assert sequences * window <= total * 1.02 + window


def test_odd(clashing, empty):
    check([(r.doc_id, r.text) for r in clashing.collect()], packing.pack(clashing, PATH).collect(), 2048)
    assert packing.pack(empty, PATH).count() == 0


def test_cut_covers():
    for total in range(1, 5000, 7):
        pieces = packing.cut(total, 2048)
        assert [s for s, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) == total


def test_plan_uses_every_piece():
    draw = np.random.default_rng(0)
    for window in (16, 64, 2048):
        histogram = {int(n): int(c) for n, c in zip(draw.integers(1, window + 1, 200), draw.integers(1, 400, 200))}
        used = defaultdict(int)
        for shape, times in packing.plan_windows(histogram, window):
            assert sum(shape) <= window and times > 0
            for n in shape:
                used[n] += times
        assert used == histogram
    assert packing.plan_windows({}, 8) == []


def test_hot_length():
    histogram = {700: 100_000, **{n: 40 for n in range(1, 1024)}}
    plan = packing.plan_windows(histogram, 2048)
    total = sum(n * c for n, c in histogram.items())
    assert sum(t for _, t in plan) * 2048 <= total * 1.5


def test_least_squares_matches_an_exact_mix():
    combos = packing.combinations_of(np.array([3, 5, 8]), 16)
    x = packing.solve_nnls(combos, np.bincount([8] * 20 + [3] * 10 + [5] * 10, minlength=17), 2000)
    use = np.zeros(17)
    for c, v in zip(combos, x):
        for n in c[c > 0]:
            use[n] += v
    assert np.allclose(use[[3, 5, 8]], [10, 10, 20], atol=0.2) and (x >= 0).all()


def test_chunks_equal_the_library():
    tokenizer, mine = Tokenizer.from_file(PATH), packing.ChunkEncoder(PATH)
    draw = np.random.default_rng(4)
    odd = ["a  b", " a", "a ", "a\nb", "a \nb", "\n\n", "a<|endoftext|>b c", "a b c", "\x1c a\x1c", "x\ty z"]
    odd += ["".join(draw.choice(list("ab c.'\n\té<|>1"), size=12)) for _ in range(500)]
    for t in odd:
        assert np.frombuffer(mine.encode(t), dtype="<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)

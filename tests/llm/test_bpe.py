import hashlib
import random

from tokenizers import Tokenizer

from lectern.llm import bpe
from lectern.llm.queries import WORD_BPE, op6_bpe
from lectern.llm.shared import tokenizer_file

PATH = tokenizer_file(WORD_BPE)
ODD = ["", "  ", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "don't we'll I'M", "İstanbul ΑΣ Σ ß ﬁ ª º µ ½ ²", "c\x85d\xa0e", "é é", "日本語 123", "\x00 a\tb\r\nc", "a" * 99, "😀x", "×÷"]


def compare(t, ids, decoded):
    tokenizer = Tokenizer.from_file(PATH)
    wanted = tokenizer.encode(t, add_special_tokens=False).ids
    assert ids == " ".join(map(str, wanted)), repr(t)
    assert decoded == tokenizer.decode(wanted, skip_special_tokens=False), repr(t)


def test_odd_texts_equal_the_library():
    mine = bpe.WordBpe(PATH)
    random.seed(3)
    texts = ODD + ["".join(random.choice("ab cdeèé'.!0\n<|>sStİ😀́ÿ") for _ in range(random.randint(1, 40))) for _ in range(1500)]
    texts += ["".join(random.choice("etaoinshr") for _ in range(random.randint(1, 30))) for _ in range(1500)]
    tokenizer = Tokenizer.from_file(PATH)
    for t in texts:
        n, ids, decoded = mine.encode(t)
        wanted = tokenizer.encode(t, add_special_tokens=False).ids
        assert ids == " ".join(map(str, wanted)) and n == len(wanted), repr(t)
        assert decoded == tokenizer.decode(wanted, skip_special_tokens=False), repr(t)


def test_documents(spark, sf, documents):
    tokenizer = Tokenizer.from_file(PATH)
    wanted = {}
    for r in documents.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        wanted[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op6_bpe(spark, sf).collect()} == wanted


def test_odd_rows(clashing, empty):
    out = bpe.encode_documents(clashing.select("doc_id", "text"), PATH).collect()
    assert len(out) == clashing.count() and [r.n_tokens for r in out if r.doc_id == 3] == [0]
    assert bpe.encode_documents(empty.select("doc_id", "text"), PATH).count() == 0


def test_pairs_agree_with_merging():
    """The border test against merging two tokens' symbols outright."""
    merges = [("a", "a"), ("a", "b"), ("aa", "a"), ("b", "c"), ("ab", "c"), ("aa", "b")]
    vocab = {t: k for k, t in enumerate(["a", "b", "c", *dict.fromkeys(a + b for a, b in merges)])}
    encoder = bpe.PrefixEncoder(vocab, merges, "")

    def merged(symbols):
        parts = list(symbols)
        while True:
            ranked = [(encoder.rank[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in encoder.rank]
            if not ranked:
                return parts
            _, k = min(ranked)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    random.seed(2)
    for _ in range(2000):
        word = "".join(random.choice("aabc") for _ in range(random.randint(1, 12)))
        assert encoder.encode(list(word)) == [vocab[t] for t in merged(word)], word

"""BPE encoding by dynamic programming over prefixes, and decoding.

The encoding of every prefix of a word has one last token. It is the token t
that is a suffix of the prefix and, with the last token s of the prefix before
t, forms a compatible pair: merging s and t's symbols together gives s, t
again. Suffix tokens of a prefix come from an automaton over the vocabulary
(tokens read from the end). Following the last tokens back from the whole word
gives its ids, equal to those of rank-ordered merging.

Word-final symbols carry the end-of-word mark, so tokens with the mark are
matched at the last prefix alone, tokens without it at the others.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import Memo, pick_unused, tokenizer_file, worker_cache

#: Chunks of up to CHUNK_CHARS characters are remembered, MEMO of them in each of two generations.
MEMO = 200_000
CHUNK_CHARS = 48

#: Chunks of these characters are split here instead of by the library: ASCII without blanks, and the letters of Latin-1.
LATIN = re.compile(r"[!-~\xC0-\xD6\xD8-\xF6\xF8-\xFF]+")
#: Fixed value: the vocabulary's split rule, restricted to those characters.
SPLIT_LATIN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]+|[0-9]|[^a-z0-9\xC0-\xD6\xD8-\xF6\xF8-\xFF]+"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class PrefixEncoder:
    """Encodes words (tuples of symbols) for one vocabulary and merge list."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.rank: dict[tuple[str, str], int] = {}
        self.made: dict[str, int] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        for r, (a, b) in enumerate(merges):
            self.rank[a, b] = r
            if a + b not in self.made:
                self.made[a + b] = r
                self.parts[a + b] = (a, b)
        self.spines: dict[tuple[str, bool], list[tuple[str, int, int]]] = {}
        self.compatible: dict[tuple[str, str], bool] = {}
        # the automaton: tokens from their last symbol to the first; a state is a dict of symbols, its token under None
        self.middle: dict = {}
        self.final: dict = {}
        singles = {t for t in vocab if self.symbols(t) is not None and len(self.symbols(t)) == 1}
        for t in singles | set(self.made):
            if t not in vocab or not self.reachable(t):
                continue
            ends = bool(suffix) and t.endswith(suffix)
            state = self.final if ends else self.middle
            for s in reversed(self.symbols(t)):
                state = state.setdefault(s, {})
            state[None] = t

    def symbols(self, token: str) -> list[str]:
        """The single symbols of a token; the end-of-word mark belongs to the last."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def reachable(self, token: str) -> bool:
        """Whether merging the token's own symbols by rank gives the token."""
        parts = self.symbols(token)
        while len(parts) > 1:
            ranked = [(self.rank.get(p, 1 << 60), k) for k, p in enumerate(zip(parts, parts[1:]))]
            r, k = min(ranked)
            if r == 1 << 60:
                return False
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return True

    def spine(self, token: str, right: bool) -> list[tuple[str, int, int]]:
        """(piece, rank that makes it, rank that uses it up) down the token's right or left edge."""
        key = (token, right)
        if key not in self.spines:
            out, piece, used = [], token, 1 << 60
            while True:
                made = self.made.get(piece, -1) if len(self.symbols(piece)) > 1 else -1
                out.append((piece, made, used))
                if made < 0:
                    break
                piece, used = self.parts[piece][right], made
            self.spines[key] = out
        return self.spines[key]

    def fits(self, s: str, t: str) -> bool:
        """Whether no merge crosses the border of s and t before their own merges use its two pieces up.

        Of equal ranks the leftmost merge goes first: the left piece must outlast the crossing merge, the right one may tie.
        """
        key = (s, t)
        if key not in self.compatible:
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            self.compatible[key] = not any(
                (r := self.rank.get((a, b))) is not None and a_made < r < a_used and b_made < r <= b_used
                for a, a_made, a_used in self.spine(s, True)
                for b, b_made, b_used in self.spine(t, False)
            )
        return self.compatible[key]

    def encode(self, symbols: list[str]) -> list[int]:
        """ids of one word, its symbols without the end-of-word mark. Raises on a symbol that is no token: a byte-level vocabulary has all of them."""
        n = len(symbols)
        if not n:
            return []
        last: list[str | None] = [None] * (n + 1)
        size = [0] * (n + 1)
        marked = symbols[-1] + self.suffix
        for end in range(1, n + 1):
            state = self.final if end == n and self.suffix else self.middle
            at, symbol = end, marked if end == n else symbols[end - 1]
            while (state := state.get(symbol)) is not None:
                at -= 1
                t = state.get(None)
                if t is not None and (at == 0 or (last[at] is not None and self.fits(last[at], t))):
                    last[end], size[end] = t, end - at
                    break
                if at == 0:
                    break
                symbol = symbols[at - 1]
        if last[n] is None:
            raise ValueError("a symbol is no token")
        out, at = [], n
        while at:
            out.append(self.vocab[last[at]])
            at -= size[at]
        return out[::-1]


class WordBpe:
    """A tokenizer file's normaliser and pre-tokeniser, the prefix encoder, and decoding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        path = tokenizer_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.encoder = PrefixEncoder(model["vocab"], merges, self.suffix)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.fast = re.compile(SPLIT_LATIN) if spec["pre_tokenizer"] and self.suffix else None
        self.byte_char = byte_characters()
        self.memo = Memo(MEMO)

    def plain_ids(self, chunk: str) -> list[int]:
        """ids of text without special tokens."""
        tok = self.tokenizer
        out: list[int] = []
        if self.fast and LATIN.fullmatch(chunk):
            for word in self.fast.findall(chunk.lower()):
                out += self.encoder.encode(list(word) if word.isascii() else [self.byte_char[b] for b in word.encode()])
            return out
        for word, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(chunk) if tok.normalizer else chunk):
            out += self.encoder.encode(list(word))
        return out

    def ids(self, chunk: str) -> list[int]:
        """ids of any text; special tokens' strings are cut out first, the leftmost first."""
        out: list[int] = []
        while chunk:
            hits = [(chunk.find(s), -len(s), s) for s in self.special if s in chunk]
            if not hits:
                return out + self.plain_ids(chunk)
            at, _, s = min(hits)
            out += self.plain_ids(chunk[:at]) if at else []
            out.append(self.special[s])
            chunk = chunk[at + len(s) :]
        return out

    def piece(self, chunk: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by blanks, decoded tokens joined by blanks) of a chunk, remembered."""
        got = self.memo.get(chunk)
        if got is None:
            ids = self.ids(chunk)
            got = (len(ids), " ".join(map(str, ids)), self.decode(ids))
            if len(chunk) <= CHUNK_CHARS:
                self.memo.put(chunk, got)
        return got

    def decode(self, ids: list[int]) -> str:
        """Tokens' strings joined by blanks, as a tokenizer without a decoder joins them."""
        return " ".join(self.text_of[i] for i in ids)

    def encode(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by blanks, decoded text). ASCII blanks end every token, so chunks between them are independent."""
        self.memo.trim()
        get = self.memo.young.get
        chunks = text.split(" ") if "\n" not in text else text.replace("\n", " ").split(" ")
        parts = [get(c) or self.piece(c) for c in chunks if c]
        return sum(p[0] for p in parts), " ".join([p[1] for p in parts if p[0]]), " ".join([p[2] for p in parts if p[0]])


def encode_documents(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """The other columns of ``docs``, n_tokens, ids (decimal, joined by blanks) and decoded, of every whole text (null: empty)."""
    keep = [c for c in docs.columns if c != text]

    def run(batches):
        cache = worker_cache()
        if ("word bpe", tokenizer) not in cache:
            cache["word bpe", tokenizer] = WordBpe(tokenizer)
        encode = cache["word bpe", tokenizer].encode
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                out = [encode(x or "") for x in batch.column(len(keep)).slice(lo, 128).to_pylist()]
                n, ids, decoded = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, 128) for c in keep), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    names=[*keep, "n_tokens", "ids", "decoded"],
                )

    schema = docs.select(*keep).schema.add("n_tokens", "long").add("ids", "string").add("decoded", "string")
    return docs.select(*keep, F.col(text).alias(pick_unused(docs, "_text"))).mapInArrow(run, schema)

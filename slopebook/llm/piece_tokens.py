"""SentencePiece BPE encoding by a prefix table, and decoding.

The encoder does not run merges over the text.  An Aho-Corasick automaton over
the pieces reports every piece that ends at a position; the one true last
token of the prefix is the match whose left neighbour (the last token of the
prefix before it) is *compatible*: merging the two tokens' characters alone
gives back exactly these two.  Merges act locally, so a row of pairwise
compatible tokens is the tokenizer's answer, and each prefix has exactly one
last token.  Ids are then read backwards from the end.

No piece holds the space mark after another character, so texts are cut before
each run of marks and distinct chunks are encoded once per worker.

Edge cases: null is the empty text; characters outside the vocabulary become
their byte pieces; repeated rows are encoded alike; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopebook.llm.common import field, utf8, with_text_columns

MARK = "▁"
#: Distinct chunks remembered by a worker, in two generations (when the newer is full it becomes the older),
#: and token pairs before it starts afresh.
MAX_CHUNKS = 350_000
MAX_PAIRS = 1_500_000
LONGEST_CACHED = 40
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class PieceEncoder:
    """Encoder and decoder for one model file (BPE with byte fallback, identity normalisation, a leading space)."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.eos = model.eos_id()
        self.size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(self.size)]
        self.rank: dict[str, float] = {}
        self.byte_id = {}
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.rank[piece] = -model.get_score(i)
        ids = {p: i for i, p in enumerate(self.pieces) if p in self.rank}
        #: Characters that occur in pieces but are none themselves: tokens of their own, written as bytes.
        for c in sorted({c for p in self.rank for c in p} - self.rank.keys()):
            ids[c] = len(self.pieces)
            self.pieces.append(c)
        #: What each id decodes to; control pieces to nothing, the unknown piece to its surface.
        self.as_bytes = [b"" if model.is_control(i) else b" \xe2\x81\x87 " if model.is_unknown(i)
                         else utf8(p.replace(MARK, " ")) for i, p in enumerate(self.pieces[:self.size])]
        for b, i in self.byte_id.items():
            self.as_bytes[i] = bytes([b])
        self.automaton = ahocorasick.Automaton()
        for piece, i in ids.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.chunks: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}

    def merge(self, text: str) -> list[str]:
        """Plain merging of a short string: lowest rank first, leftmost on ties."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            a, b = self.pieces[left], self.pieces[right]
            known = a + b not in self.rank and self.merge(a + b) == [a, b]
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def encode_chunk(self, text: str) -> list[int]:
        """Ids of a text whose marks are in place, by the prefix table."""
        n = len(text)
        last = [-1] * (n + 1)  # -1: the prefix ends in a character outside the vocabulary
        pairs = self.pairs
        for end, (length, token) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                start = end - length
                before = last[start]
                if before < 0:
                    last[end] = token
                else:
                    known = pairs.get(before << 20 | token)
                    if known or (known is None and self.compatible(before, token)):
                        last[end] = token
        out, at = [], n
        while at:
            token = last[at]
            if 0 <= token < self.size:
                out.append(token)
                at -= len(self.pieces[token])
            else:
                out += [self.byte_id[b] for b in reversed(utf8(text[at - 1]))]
                at -= 1
        out.reverse()
        return out

    def decode_pieces(self, ids: list[int]) -> str:
        """The text of a row of ids, the leading space kept."""
        return b"".join([self.as_bytes[i] for i in ids]).decode("utf-8", "replace")

    def _chunk(self, key: str) -> tuple[str, int, str]:
        got = self.older.get(key)
        if got is None:
            ids = self.encode_chunk(MARK + key)
            got = (" ".join(map(str, ids)), len(ids), self.decode_pieces(ids))
        if len(key) <= LONGEST_CACHED:
            if len(self.chunks) >= MAX_CHUNKS:
                self.older, self.chunks = self.chunks, {}
            self.chunks[key] = got
        return got

    def encode_decode(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids with the end id, ids joined by spaces, decoded text)."""
        if not text:
            return 1, str(self.eos), ""
        marked = text.replace(" ", MARK)
        keys = marked.split(MARK)
        if "" in keys:
            keys = [k[1:] for k in _CHUNK.findall(MARK + marked)]
        got = [self.chunks.get(k) or self._chunk(k) for k in keys]
        return (sum([g[1] for g in got]) + 1, " ".join([g[0] for g in got]) + f" {self.eos}", "".join([g[2] for g in got])[1:])

    def encode(self, text: str | None) -> list[int]:
        return list(map(int, self.encode_decode(text)[1].split()))

    def decode(self, ids: list[int]) -> str:
        text = self.decode_pieces(ids)
        return text[1:] if text.startswith(" ") else text


_LOADED: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder of a model file, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array<int>, the end id last) and decoded text of every row."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("__text"))

    def compute(texts):
        enc = encoder(path)
        for t in texts:
            _n, ids, decoded = enc.encode_decode(t)
            yield list(map(int, ids.split())), decoded

    return with_text_columns(slim, "__text", [field("ids", "ints"), field("decoded", "string")], compute).drop("__text")


def token_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; ids stay inside the task."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("__text"))

    def compute(texts):
        enc = encoder(path)
        for t in texts:
            n, ids, decoded = enc.encode_decode(t)
            yield n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(utf8(decoded)).hexdigest()

    fields = [field("n_tokens", "long"), field("ids_sha256", "string"), field("decoded_sha256", "string")]
    return with_text_columns(slim, "__text", fields, compute).drop("__text")

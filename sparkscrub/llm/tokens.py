"""Token counts without a tokenizer run: rank-synchronous merging in arrays.

A text is normalised and split as the vocabulary file says. The distinct pieces of a
batch lie one after the other in a flat array of symbol ids. In each round every piece
finds its pair of neighbours of lowest rank, and all pieces merge theirs at once. A
piece without a known pair is finished; the symbols that are left are its tokens. A piece
of very many symbols would need as many rounds: it merges the same pairs in the same order
from a heap, each pair when its turn comes.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkscrub.llm.common import map_texts

# Pieces whose count a task remembers; then it starts anew.
REMEMBERED = 500_000
# Long texts are normalised whole and split in parts that end at white space.
PART = 1 << 20
# A piece of more symbols is merged from a heap.
LONG_PIECE = 2_000
# Symbols in one round of merging, so that arrays stay small.
ROUND_BYTES = 1 << 20

# In front of pieces that are spelt in the letters for bytes; no other piece begins so.
MARK = "\uffff"
NO_RANK = np.iinfo(np.int64).max
# White space, letters and numbers below U+0100; the file's pattern has no other cases there.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0"
_LETTER = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBER = r"0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+"
)


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class RankMerger:
    """Counts the tokens of byte-level pieces by the merges of a vocabulary."""

    def __init__(self, model: dict):
        vocab: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.size = max(vocab.values()) + 1
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.results = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.table: dict[int, tuple[int, int]] = {}

    def count_long(self, piece: bytes) -> int:
        """Tokens of one long piece, in time n log n."""
        if not self.table:
            self.table = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.results.tolist())))
        table, size = self.table, self.size
        symbols = self.inner[np.frombuffer(piece, np.uint8)].tolist()
        symbols[-1] = int(self.last[piece[-1]])
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # (rank, place, pair): a pair that is no longer there when its turn comes is passed over.
        heap = []
        for i in range(n - 1):
            key = symbols[i] * size + symbols[i + 1]
            if key in table:
                heap.append((table[key][0], i, key))
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, key = heapq.heappop(heap)
            j = after[i]
            if j >= n or symbols[i] < 0 or symbols[i] * size + symbols[j] != key:
                continue
            symbols[i], symbols[j] = table[key][1], -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n:
                    made = symbols[a] * size + symbols[b]
                    if made in table:
                        heapq.heappush(heap, (table[made][0], a, made))
        return left

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each piece (none is empty)."""
        long = [i for i, p in enumerate(pieces) if len(p) > LONG_PIECE]
        if long:
            out = np.ones(len(pieces), np.int64)
            short = [i for i, p in enumerate(pieces) if len(p) <= LONG_PIECE]
            out[long] = [self.count_long(pieces[i]) for i in long]
            if short:
                out[short] = self.counts([pieces[i] for i in short])
            return out
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[flat[ends]]
        piece = np.repeat(np.arange(len(pieces)), lengths)
        out = np.ones(len(pieces), np.int64)
        while len(symbols):
            first = np.flatnonzero(np.diff(piece, prepend=-1))
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[at] == key) & (piece[1:] == piece[:-1])
            rank = np.full(len(symbols), NO_RANK)
            rank[:-1][known] = self.ranks[at[known]]
            lowest = np.minimum.reduceat(rank, first)
            size = np.diff(first, append=len(symbols))
            done = lowest == NO_RANK
            out[piece[first[done]]] = size[done]
            hit = (rank == np.repeat(lowest, size)) & (rank != NO_RANK)
            # Hits in a row overlap (one symbol repeated): every other one counts, from the left.
            index = np.arange(len(symbols))
            begins = hit & ~np.concatenate(([False], hit[:-1]))
            run = np.maximum.accumulate(np.where(begins, index, 0))
            taken = np.flatnonzero(hit & ((index - run) % 2 == 0))
            symbols[taken] = self.results[at[taken]]
            stay = np.repeat(~done, size)
            stay[taken + 1] = False
            symbols, piece = symbols[stay], piece[stay]
        return out


def parts(text: str) -> list[str]:
    """A text in parts that end at white space; no piece holds any."""
    if len(text) <= PART:
        return [text]
    out, start = [], 0
    gap = re.compile(r"[ \t\n\r]")
    while start < len(text):
        end = gap.search(text, min(start + PART, len(text)))
        stop = end.end() if end else len(text)
        out.append(text[start:stop])
        start = stop
    return out


class TokenCounter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.merger = RankMerger(spec["model"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, int] = {}
        self.to_byte = {c: b for b, c in byte_letters().items()}

    def pieces(self, text: str) -> list[str]:
        """Pieces of an ordinary text: as text below U+0100, else in the letters that stand for bytes."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            text = self.normalizer.normalize_str(text)
            found = []
            for part in parts(text):
                found += [MARK + p for p, _ in self.splitter.pre_tokenize_str(part)]
            return found
        text = text.lower()
        return [p for part in parts(text) for p in LATIN.findall(part)]

    def raw(self, piece: str) -> bytes:
        if piece[0] == MARK:
            return bytes(self.to_byte[c] for c in piece[1:])
        return piece.encode()

    def learn(self, found: set[str]) -> None:
        group: list[str] = []
        size = 0
        for piece in [*found, None]:
            if piece is None or size > ROUND_BYTES:
                if group:
                    raw = [self.raw(p) for p in group]
                    self.known.update(zip(group, self.merger.counts(raw).tolist()))
                group, size = [], 0
            if piece is not None:
                group.append(piece)
                size += len(piece)

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split, new = [], set()
        for text in texts:
            segments = self.special.split(text) if self.special else [text]
            found = [self.pieces(s) for s in segments]
            new.update(*(set(f).difference(self.known) for f in found))
            split.append(found)
        self.learn(new)
        known = self.known.__getitem__
        return [len(found) - 1 + sum(sum(map(known, f)) for f in found) for found in split]


@lru_cache(maxsize=4)
def counter(path: str | None) -> TokenCounter:
    """Once per worker process. Without a path: the file of the installed package on that machine."""
    import public_tokenizers

    return TokenCounter(path or public_tokenizers.path("word_bpe_49k.json"))


def count_tokens(
    df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, limit: int = 2048
) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for every row.

    ``path``: a vocabulary file (byte-level merges with word ends) that every machine
    can open. Counts equal the tokenizer library's without added special tokens;
    special strings inside a text count as one token each.

    A null text counts as empty: no bytes, no tokens. Null keys and repeated rows stay
    rows of their own. An empty table gives an empty result. Texts of any length are
    counted whole.
    """

    def make():
        own = counter(path)

        def compute(texts):
            counts = own.count(texts)
            return [(len(t.encode()), n, n > limit) for t, n in zip(texts, counts)]

        return compute

    fields = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())]
    return map_texts(df, make, fields, key, text)

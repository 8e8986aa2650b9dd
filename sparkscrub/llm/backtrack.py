"""Byte-level BPE encoding by backtracking over the longest tokens, decoding by an offset table.

An automaton gives the longest token at every byte of a piece. Tokens are taken from left
to right; a token may follow another one only if merging their bytes would leave the
boundary between them alone, which a table of merges tells. Where nothing fits, the last
token goes and the end of it is never tried again, so the work is linear in the piece.
The result is that of the merges in their order.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkscrub.llm.common import map_texts

# Bytes of pieces and ids that a worker remembers; longer pieces than MAX_KEPT are not kept.
MAX_MEMORY = 128_000_000
MAX_KEPT = 200
MAX_PAIRS = 500_000
# Below this code point all versions of Unicode agree on what is a letter, a number and white
# space; the library is asked about the characters beyond.
AGREED = 0x530


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it can be
    printed, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Merges:
    """Tokens numbered by birth: the bytes, then one token for each merge in order."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        import ahocorasick

        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        if missing := [c for c in letters if c not in vocabulary]:
            raise ValueError(f"no byte-level vocabulary: {len(missing)} bytes have no token")
        names = list(letters)
        number = {c: b for b, c in enumerate(letters)}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        whole = [True] * 256
        for merge in merges:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            if a + b in number:
                raise ValueError(f"two merges make the token {a + b!r}")
            left, right = number[a], number[b]
            # Do its own bytes merge to this token? Only earlier merges are known here, as they must be.
            whole.append(whole[left] and whole[right] and self._fit(left, right))
            number[a + b] = len(names)
            self.merged[left, right] = len(names)
            self.parts.append((left, right))
            names.append(a + b)
        self.ids = [vocabulary[n] for n in names]
        self.size = [len(n) for n in names]
        reached = {n: i for n, i in number.items() if whole[i]}
        # The longest token that is a proper beginning of each token.
        self.shorter = [next((reached[n[:k]] for k in range(len(n) - 1, 0, -1) if n[:k] in reached), -1) for n in names]
        # One letter for each byte, so that the automaton walks bytes.
        self.automaton = ahocorasick.Automaton()
        for n, i in reached.items():
            self.automaton.add_word("".join(chr(byte_of[c]) for c in n), i)
        self.automaton.make_automaton()
        self.bytes = [bytes(byte_of[c] for c in n) for n in names]
        self.single = {self.bytes[i]: [self.ids[i]] for i in reached.values()}

    def _fit(self, left: int, right: int) -> bool:
        """Merging the bytes of both tokens leaves the boundary between them.

        Merges are undone from the latest on; a merge across the boundary that comes
        before the one undone would have been made first. Of equal merges the left one is.
        """
        limit = len(self.parts) + 1
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, left = left, self.parts[left][1]
            elif right > 255:
                limit, right = right + 1, self.parts[right][0]
            if left < 256 and right < 256:
                return self.merged.get((left, right), limit) >= limit

    def fit(self, left: int, right: int) -> bool:
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= MAX_PAIRS:
                self._pairs.clear()
            known = self._pairs[left, right] = self._fit(left, right)
        return known

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        if piece in self.single:
            # The longest token at its first byte is the piece.
            return self.single[piece]
        size, shorter, fit = self.size, self.shorter, self.fit
        end = len(piece)
        longest = [0] * end
        # Matches come by their end, so the longest one at a byte comes last.
        for last, token in self.automaton.iter(piece.decode("latin-1")):
            longest[last + 1 - size[token]] = token
        open_end = bytearray(b"\1") * (end + 1)
        taken: list[int] = []
        at, token = 0, longest[0]
        while True:
            stop = at + size[token]
            if open_end[stop] and (not taken or fit(taken[-1], token)):
                taken.append(token)
                if stop == end:
                    return [self.ids[t] for t in taken]
                at, token = stop, longest[stop]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_end[at] = 0
                token = taken.pop()
                at -= size[token]


def _ranges(kind: str) -> str:
    import regex

    found = [c for c in range(AGREED) if regex.match(kind, chr(c))]
    return "".join(f"\\u{c:04x}" for c in found)


class Pieces:
    """Cuts a text by the library's pattern."""

    def __init__(self, pre_tokenizer):
        letter, number, space = (_ranges(k) for k in (r"\p{L}", r"\p{N}", r"\s"))
        self.pattern = re.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
            rf"|[{space}]+(?![^{space}])|[{space}]+"
        )
        self.beyond = re.compile(rf"[^\u0000-\u{AGREED - 1:04x}]")
        self.kinds = _Kinds(pre_tokenizer)

    def cut(self, text: str) -> list[str]:
        if text.isascii() or not self.beyond.search(text):
            return self.pattern.findall(text)
        # Characters beyond are replaced by one of their kind that the pattern knows.
        alike = text.translate(self.kinds)
        return [text[slice(*m.span())] for m in self.pattern.finditer(alike)]


class _Kinds(dict):
    """Code point -> a code point of the same kind below ``AGREED``, as the library sees it."""

    def __init__(self, pre_tokenizer):
        super().__init__()
        self.pre_tokenizer = pre_tokenizer

    def __missing__(self, code: int) -> int:
        kind = code
        if code >= AGREED:
            # Next to a letter, a number, another sign: the one that it joins is of its kind.
            cuts = {end for _, (_, end) in self.pre_tokenizer.pre_tokenize_str(f"a{chr(code)}1{chr(code)}!")}
            # A white space is apart from all; the last one belongs to none either.
            kind = 0xE9 if 1 not in cuts else 0xB2 if 3 not in cuts else 0xA7 if 4 not in cuts else 0xA0
        self[code] = kind
        return kind


class Remembered(dict):
    """Piece -> the bytes of its ids; forgets everything when it has grown too large."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges, self.held = merges, 0

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        ids = np.array(self.merges.encode(raw), "<u4").tobytes()
        if len(raw) <= MAX_KEPT:
            if self.held > MAX_MEMORY:
                self.clear()
                self.held = 0
            self[piece] = ids
            self.held += 200 + len(raw) + len(ids)
        return ids


class Codec:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        model, first = made["model"], made["pre_tokenizer"]
        plain = first["type"] == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"]
        added = made["added_tokens"]
        if not plain or made["normalizer"] or model["type"] != "BPE" or model["dropout"] or model["ignore_merges"]:
            raise ValueError(f"{path}: byte-level BPE without normalizer, prefix space and dropout is read")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError(f"{path}: an added token has conditions")
        self.merges = Merges(model["vocab"], model["merges"])
        self.pieces = Pieces(Tokenizer.from_file(path).pre_tokenizer)
        self.known = Remembered(self.merges)
        self.added = {t["content"]: t["id"] for t in added}
        names = sorted(self.added, key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(map(re.escape, names))})") if names else None

        content = dict(zip(self.merges.ids, self.merges.bytes)) | {i: c.encode() for c, i in self.added.items()}
        rows = [content.get(i, b"") for i in range(max(content) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        self.flat = np.frombuffer(b"".join(rows), np.uint8)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known = self.known
        if self.special is None or not (parts := self.special.split(text))[1:]:
            return b"".join([known[p] for p in self.pieces.cut(text)])
        out = []
        for n, part in enumerate(parts):
            if n % 2:
                out.append(np.array([self.added[part]], "<u4").tobytes())
            else:
                out += [known[p] for p in self.pieces.cut(part)]
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, unknown ids give nothing."""
        ids = ids[(ids >= 0) & (ids < len(self.offsets) - 1)]
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        # Byte k of the result stands at k plus the shift of its token.
        shift = np.repeat(start - (np.cumsum(size) - size), size)
        return self.flat[np.arange(len(shift)) + shift].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str | None = None) -> Codec:
    """Once per worker process. Without a path: the file of the installed package on that machine."""
    import public_tokenizers

    return Codec(path or public_tokenizers.path("byte_bpe_50k.json"))


def _numbers(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4").astype(np.int64)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, ids`` (array of int) for every row, as the tokenizers library encodes without special tokens.

    Strings of added tokens that stand in a text become these tokens. A null text is
    empty and has no ids. Null keys and repeated rows stay rows of their own; an empty
    table gives an empty result. Texts are encoded whole, whatever their length; a piece
    without a boundary takes time in proportion to its length.
    """

    def make():
        own = codec(path)
        return lambda texts: [(np.frombuffer(own.encode(t), "<u4").astype("<i4"),) for t in texts]

    return map_texts(df, make, [("ids", T.ArrayType(T.IntegerType()))], key, text)


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``key, decoded`` (string): the text of the ids, added tokens included; null ids give an empty text."""

    def make():
        own = codec(path)
        return lambda rows: [(own.decode(np.array(list(r), np.int64)),) for r in rows]

    return map_texts(df, make, [("decoded", T.StringType())], key, ids)


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` for every row.

    The hashes are those of the ids as little-endian unsigned 32-bit integers and of the
    decoded text in UTF-8. Nulls, repeated rows, empty and long texts as in ``encode_texts``.
    """

    def make():
        own = codec(path)

        def one(text):
            ids = own.encode(text)
            back = own.decode(_numbers(ids)).encode()
            return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()

        return lambda texts: [one(t) for t in texts]

    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return map_texts(df, make, fields, key, text)

"""Byte-level BPE encoding and decoding by the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkscrub.llm.common import map_texts

# Characters after which a long text is cut at the next safe boundary.
PART = 100_000
# White space beyond this length is one piece by rule and skips the pattern, whose
# look-ahead needs stack for each character.
LONG_SPACE = 2_000

_BOUNDARY = re.compile(r"(?<=\S)(?=\s)")
_SPACES = re.compile(r"\s{%d,}" % LONG_SPACE)


def safe_parts(text: str) -> Iterator[tuple[str, bool]]:
    """A text in parts with the same pieces as the whole; True: the part is one piece.

    Safe boundaries: between a character that is no white space and white space, since
    pieces hold white space only at their start or alone. In a run of white space, all
    but the last character are one piece if more text follows, else the whole run.
    """
    start = 0
    for run in [*_SPACES.finditer(text), None]:
        end = run.start() if run else len(text)
        while end - start > PART:
            cut = _BOUNDARY.search(text, start + PART, end)
            if cut is None:
                break
            yield text[start : cut.start()], False
            start = cut.start()
        if end > start:
            yield text[start:end], False
        if run:
            start = run.end() if run.end() == len(text) else run.end() - 1
            yield text[end:start], True


class Codec:
    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) <= LONG_SPACE:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for part, single in safe_parts(text):
            if single:
                ids += self.encoding._encode_single_piece(part.encode())
            else:
                ids += self.encoding.encode_ordinary(part)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


@lru_cache(maxsize=4)
def codec(path: str | None, pattern: str | None) -> Codec:
    """Once per worker process. Without a path: the file of the installed package on that machine."""
    import public_tokenizers

    return Codec(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)


def encode_texts(
    df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """``key, ids`` (array of int) for every row; a null text is empty and has no ids.

    Null keys and repeated rows stay rows of their own; an empty table gives an empty
    result. No special tokens. Texts are encoded whole, long ones part by part.
    """

    def make():
        own = codec(path, pattern)
        return lambda texts: [(np.array(own.encode(t), "<i4"),) for t in texts]

    return map_texts(df, make, [("ids", T.ArrayType(T.IntegerType()))], key, text)


def decode_ids(
    df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """``key, decoded`` (binary): the bytes of the ids; null ids give no bytes."""

    def make():
        own = codec(path, pattern)
        return lambda rows: [(own.decode(list(r)),) for r in rows]

    return map_texts(df, make, [("decoded", T.BinaryType())], key, ids)


def round_trip(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    pattern: str | None = None,
    keep: tuple[str, ...] = (),
    with_ids: bool = False,
) -> DataFrame:
    """``key``, kept columns, ``n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids``.

    Encodes and decodes each text in one pass. The hashes are those of the ids as
    little-endian unsigned 32-bit integers and of the decoded bytes. Nulls, empty and
    long texts, repeated rows and empty tables as in ``encode_texts``.
    """

    def make():
        own = codec(path, pattern)

        def one(text):
            ids = own.encode(text)
            packed = np.array(ids, "<u4")
            out = len(ids), hashlib.sha256(packed.tobytes()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()
            return (*out, packed.view("<i4")) if with_ids else out

        return lambda texts: [one(t) for t in texts]

    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(("ids", T.ArrayType(T.IntegerType())))
    return map_texts(df, make, fields, key, text, keep)

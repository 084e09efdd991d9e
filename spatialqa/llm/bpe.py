"""Byte-level BPE by forced boundaries.

Two neighbouring bytes that no vocabulary token holds side by side can never be merged, so a
cut between them is certain. Each piece that the pre-tokenizer finds is cut there; the
fragments are encoded independently, and their ids are concatenated.
"""
from __future__ import annotations

from functools import lru_cache
from typing import Callable

from pyspark.sql import DataFrame

from spatialqa.llm.common import add_columns, fields
from spatialqa.llm.tokens import BYTE_PIECES, CACHE, PLAIN, Cached, byte_letters, library, merger, packed

SPECIAL = "<|endoftext|>"


@lru_cache(2)
def vocabulary(path: str) -> tuple[list[bytes], bytes, dict[str, int]]:
    """The bytes of each id, the table of byte pairs that some token holds (1) or none does (0), bytes by letter."""
    tokenizer = library(path)
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    ordinary = tokenizer.get_vocab(with_added_tokens=False)
    everything = tokenizer.get_vocab(with_added_tokens=True)
    by_id = [b""] * (max(everything.values()) + 1)
    pairs = bytearray(1 << 16)
    for token, i in everything.items():
        by_id[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        if token in ordinary:
            for a, b in zip(by_id[i], by_id[i][1:]):
                pairs[a << 8 | b] = 1
    return by_id, bytes(pairs), byte_of


def forced_cuts(piece: bytes, pairs: bytes) -> list[bytes]:
    """The fragments of ``piece`` between its certain cuts."""
    parts, start = [], 0
    for i, (a, b) in enumerate(zip(piece, piece[1:]), 1):
        if not pairs[a << 8 | b]:
            parts.append(piece[start:i])
            start = i
    parts.append(piece[start:])
    return parts


class Encoder:
    """Text to ids (packed little-endian 32-bit integers), equal to the library's own."""

    def __init__(self, path: str) -> None:
        self.tokenizer = library(path)
        _, self.pairs, self.byte_of = vocabulary(path)
        merge = merger(path, False)
        self.special = packed([self.tokenizer.token_to_id(SPECIAL)]) if self.tokenizer.token_to_id(SPECIAL) is not None else None
        self.fragments = Cached(lambda x: packed(merge(x)), CACHE // 4)
        self.pieces = Cached(lambda x: self.encode_piece(x.encode()), CACHE // 2)
        self.letters = Cached(lambda x: self.encode_piece(bytes(self.byte_of[c] for c in x)), CACHE // 4)

    def encode_piece(self, piece: bytes) -> bytes:
        parts = forced_cuts(piece, self.pairs)
        return self.fragments.make(piece) if len(parts) == 1 else b"".join(map(self.fragments.__getitem__, parts))

    def ordinary(self, text: str) -> bytes:
        if text.isascii() or not PLAIN.search(text):
            return b"".join(map(self.pieces.__getitem__, BYTE_PIECES.findall(text)))
        return b"".join(self.letters[piece] for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))

    def __call__(self, text: str) -> bytes:
        if self.special is None or SPECIAL not in text:
            return self.ordinary(text)
        return self.special.join(self.ordinary(part) for part in text.split(SPECIAL))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with ``ids``: the ids of ``text`` as packed little-endian 32-bit integers.

    A null text counts as empty and gives no ids. Rows may repeat; each keeps its own ids.
    A column of the name ``ids`` is replaced.
    """
    def start() -> Callable:
        encoder = Encoder(path)
        return lambda value: (encoder(value or ""),)

    return add_columns(df, start, [text], fields(f"{ids} binary"))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with ``text``: what the packed ids stand for; bytes that are no UTF-8 become U+FFFD, null gives the empty text."""
    def start() -> Callable:
        from array import array
        by_id = vocabulary(path)[0]

        def one(value: bytes | None) -> tuple[str]:
            numbers = array("I", value or b"")
            return (b"".join(map(by_id.__getitem__, numbers)).decode("utf-8", "replace"),)
        return one

    return add_columns(df, start, [ids], fields(f"{text} string"))

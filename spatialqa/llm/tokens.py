"""Exact pre-tokens and ids of two public tokenizers, with bounded caches per task."""
from __future__ import annotations

import re
import sys
from array import array
from functools import lru_cache
from typing import Callable

#: White space, letters and numbers among the characters up to U+017F, as Unicode classes them (fixed values).
SPACE = "\\t-\\r \\x85\\xa0"
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMBER = "0-9²³¹¼-¾"
#: Only texts made of these take the short way; all others go through the library whole.
PLAIN = re.compile("[^\\x00-ſ]")
#: str.split() also parts at these, which the tokenizer doesn't take for white space.
CONTROL = re.compile("[\x1c-\x1f]")
SEPARATORS = {c: " " for c in (*range(9, 14), 0x20, 0x85, 0xA0)}
#: Entries of a cache before it starts anew, and the longest piece it takes.
CACHE, LONGEST = 600_000, 48

BYTE_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WORD_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")


@lru_cache(1)
def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


@lru_cache(4)
def library(path: str):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Cached(dict):
    """Values of ``make`` by key, started anew when full, so that a task's memory stays bounded."""

    def __init__(self, make: Callable, most: int = CACHE) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def packed(ids: list[int]) -> bytes:
    numbers = array("I", ids)
    if sys.byteorder != "little":
        numbers.byteswap()
    return numbers.tobytes()


@lru_cache(1)
def letter_table() -> dict[int, str]:
    return {b: c for b, c in enumerate(byte_letters()) if chr(b) != c}


def mapped(piece: bytes) -> str:
    """The letters that stand for the bytes."""
    return piece.decode("latin-1").translate(letter_table())


@lru_cache(4)
def merger(path: str, ended: bool) -> Callable[[bytes], list[int]]:
    """The ids of one piece of bytes by the vocabulary's merges, without pre-tokenizing.

    The ids of a vocabulary follow the order of its merges, so they serve as merge ranks.
    ``ended``: for a vocabulary of words with ends, over ASCII only; the last byte of a
    piece has 128 added, which stands for its end.
    """
    import tiktoken
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    ranks: dict[bytes, int] = {}
    for token, i in library(path).get_vocab(with_added_tokens=False).items():
        end = ended and token.endswith("</w>")
        value = bytes(byte_of[c] for c in (token[:-4] if end else token))
        if not ended:
            ranks[value] = i
        elif value.isascii():
            ranks[value[:-1] + bytes([value[-1] + 128]) if end else value] = i
    return tiktoken.Encoding("pieces", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})._encode_single_piece


class WordTokens:
    """Ids, as packed little-endian 32-bit integers, of the tokenizer of words with ends.

    White space parts all its pieces, so the cache holds whole words between white space.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = library(path)
        self.merge, self.tokenize = merger(path, True), self.tokenizer.model.tokenize
        self.words = Cached(self.word)

    def piece(self, piece: str) -> list[int]:
        if piece.isascii():
            return self.merge(piece[:-1].encode() + bytes([ord(piece[-1]) + 128]))
        return [t.id for t in self.tokenize(mapped(piece.encode()))]

    def word(self, word: str) -> bytes:
        if word.isalpha():
            return packed(self.piece(word))
        return packed([i for piece in WORD_PIECES.findall(word) for i in self.piece(piece)])

    def __call__(self, text: str) -> bytes:
        if "<|" in text or (not text.isascii() and PLAIN.search(text)):
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.words.__getitem__, text.lower().translate(SEPARATORS).split(" ") if CONTROL.search(text) else text.lower().split()))

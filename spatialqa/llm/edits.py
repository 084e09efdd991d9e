"""Edit-aware token counts.

A document is cut into blocks that end at line breaks; a block's pre-tokens never depend on
what follows the break's line. A segment tree keeps the tokens of each block. An edit
re-encodes the blocks it touches, with the block before and after as context, and updates
the sums on the way to the root.
"""
from __future__ import annotations

from bisect import bisect_right
from typing import Callable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

from spatialqa.llm.bpe import Encoder
from spatialqa.llm.common import fields, flat_map, text_of

#: Characters of a block, about; it ends before the next line break or space that follows a letter.
BLOCK = 512


def cut(text: str) -> list[str]:
    """Blocks of ``text``. A cut lies before white space that stands between two characters that are no white space.

    Of a letter, one space or break and a non-space, the tokenizer always parts the first
    from the rest, so blocks are encoded independently of each other.
    """
    out, start = [], 0
    while len(text) - start > BLOCK:
        at = start + BLOCK
        while at < len(text) - 1 and not (text[at] in " \n" and not text[at - 1].isspace() and not text[at + 1].isspace()):
            at += 1
        if at >= len(text) - 1:
            break
        out.append(text[start:at])
        start = at
    return [*out, text[start:]]


class Tree:
    """Blocks of a text with sums of characters and tokens in a segment tree."""

    def __init__(self, text: str, count: Callable[[str], int]) -> None:
        self.count, self.encoded = count, 0
        self.build(cut(text))

    def build(self, blocks: list[str], known: dict[int, int] | None = None) -> None:
        self.blocks = blocks
        self.size = 1 << max(0, len(blocks) - 1).bit_length()
        self.tokens, self.chars = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, block in enumerate(blocks):
            self.tokens[self.size + i] = known[i] if known and i in known else self.encode(block)
            self.chars[self.size + i] = len(block)
        for i in range(self.size - 1, 0, -1):
            self.tokens[i], self.chars[i] = self.tokens[2 * i] + self.tokens[2 * i + 1], self.chars[2 * i] + self.chars[2 * i + 1]

    def encode(self, block: str) -> int:
        self.encoded += len(block)
        return self.count(block)

    def find(self, char: int) -> tuple[int, int]:
        """The block that holds a character, and where it starts; the last block for the end."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if char >= start + self.chars[node] and start + self.chars[node] < self.chars[1]:
                start, node = start + self.chars[node], node + 1
        return node - self.size, start

    def set(self, i: int, block: str) -> None:
        self.blocks[i] = block
        node = self.size + i
        self.tokens[node], self.chars[node] = self.encode(block), len(block)
        while node := node // 2:
            self.tokens[node], self.chars[node] = self.tokens[2 * node] + self.tokens[2 * node + 1], self.chars[2 * node] + self.chars[2 * node + 1]

    def edit(self, at: int, deleted: int, text: str) -> None:
        """Replaces ``deleted`` characters from ``at``; both are held to the text."""
        at = max(0, min(at, self.chars[1]))
        end = max(at, min(at + deleted, self.chars[1]))
        (first, start), (last, _) = self.find(at), self.find(max(at, end - 1))
        low, high = max(0, first - 1), min(len(self.blocks) - 1, last + 1)  # the context on either side
        if low < first:
            start -= len(self.blocks[low])
        region = "".join(self.blocks[low:high + 1])
        parts = cut(region[:at - start] + text + region[end - start:])
        if len(parts) == high - low + 1:
            for i, part in enumerate(parts, low):
                if part != self.blocks[i]:
                    self.set(i, part)
            return
        tokens = self.tokens[self.size:self.size + len(self.blocks)]
        known = {i: t for i, t in enumerate(tokens[:low])} | {i + low + len(parts): t for i, t in enumerate(tokens[high + 1:])}
        self.build([*self.blocks[:low], *parts, *self.blocks[high + 1:]], known)

    @property
    def total(self) -> int:
        return self.tokens[1]


def count_edits(docs: DataFrame, path: str, edits: str = "edits") -> DataFrame:
    """doc_id, n_before, n_after, n_edits, chars_encoded and the edited text of each row.

    ``edits`` is an array of (at, deleted, text) in the order they are made, with places in
    characters of the text as it is then; the edits of a document travel in its row. Places
    beyond the text are held to it; a null text counts as empty, null edits as none, and
    null parts of an edit as 0 or empty. ``n_after`` always equals a count of the whole
    edited text. Rows may repeat; null ids are counted like others.
    """
    def start() -> Callable[..., Iterator[tuple]]:
        encoder = Encoder(path)

        def one(doc: int | None, text: str, made: list[dict] | None) -> Iterator[tuple]:
            tree = Tree(text, lambda block: len(encoder(block)) // 4)
            before, tree.encoded = tree.total, 0
            for e in made or []:
                if e is not None:
                    tree.edit(e["at"] or 0, e["deleted"] or 0, e["text"] or "")
            yield doc, before, tree.total, len(made or []), tree.encoded, "".join(tree.blocks)
        return one

    schema = fields("doc_id long,n_before long,n_after long,n_edits long,chars_encoded long,edited string")
    return flat_map(docs.select("doc_id", text_of().alias("text"), F.col(edits).alias("edits")), start, schema)


def revisions(n: int = 4) -> Column:
    """Edits of a document drawn from its own text: a piece of it, of up to 40 characters, replaces up to 20 elsewhere."""
    def one(i: Column) -> Column:
        h = lambda salt, most: F.pmod(F.xxhash64("doc_id", i, F.lit(salt)), most)
        length = F.greatest(F.length("text"), F.lit(1)).cast("long")
        return F.struct(h(1, length).alias("at"), h(2, F.lit(20)).alias("deleted"),
                        F.substring("text", (h(3, length) + 1).cast("int"), (h(4, F.lit(40)) + 1).cast("int")).alias("text"))

    return F.transform(F.sequence(F.lit(1), F.lit(n)), one)

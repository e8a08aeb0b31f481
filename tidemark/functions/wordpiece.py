"""Word pieces in full: the basic tokenizer, and longest matches in linear time.

Matching follows the published trie with failure links (Song et al., 2021): where
no longer piece fits, a link says which pieces are cut and where in the trie to
go on, so each character of a word is read once, however often a greedy search
would start again.
"""

from __future__ import annotations

import re
import unicodedata
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format.
PREFIX, UNKNOWN, OPENING, CLOSING = "##", "[UNK]", "[CLS]", "[SEP]"
LONGEST_WORD, MOST = 100, 512
#: Words whose pieces a worker remembers.
REMEMBERED = 100_000
# Blocks of characters that are words of their own.
CJK = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)]


_PLAIN = re.compile(r"[^ \t\n\r]+")


def _is_mark(c: str) -> bool:
    """Punctuation, and what ASCII has besides letters, digits and blanks."""
    return "!" <= c <= "/" or ":" <= c <= "@" or "[" <= c <= "`" or "{" <= c <= "~" or unicodedata.category(c).startswith("P")


def _kept(text: str) -> Iterator[str]:
    """``text`` between blanks, word by word as it is asked for: without control characters, CJK characters by themselves."""
    for part in _PLAIN.finditer(text):
        if part[0].isascii() and part[0].isprintable():
            yield part[0]
            continue
        kept = []
        for c in part[0]:
            if unicodedata.category(c) == "Zs":
                kept.append(" ")
            elif c in "\0�" or unicodedata.category(c).startswith("C"):
                continue
            elif any(a <= ord(c) <= b for a, b in CJK):
                kept.append(f" {c} ")
            else:
                kept.append(c)
        yield from "".join(kept).split(" ")


def basic_words(text: str) -> Iterator[str]:
    """Lower-case words without accents; marks and CJK characters are words of their own, control characters go."""
    for word in _kept(text):
        if word.isascii() and word.isalnum():
            yield word.lower()
            continue
        word = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(c) != "Mn")
        own: list[str] = []
        for c in word:
            if _is_mark(c):
                if own:
                    yield "".join(own)
                yield c
                own = []
            else:
                own.append(c)
        if own:
            yield "".join(own)


class WordPieces:
    """A vocabulary as a trie; nodes are numbers, 0 the start of a word and 1 that of a piece within."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        self.unknown = vocabulary[UNKNOWN]
        self.next: list[dict[str, int]] = [{}, {}]
        piece: list[int | None] = [None, None]
        for word, number in vocabulary.items():
            node, rest = (1, word[len(PREFIX) :]) if word.startswith(PREFIX) and len(word) > len(PREFIX) else (0, word)
            for c in rest:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    piece.append(None)
                node = self.next[node][c]
            if rest:
                piece[node] = number
        # what is cut if no longer piece fits, and where to go on; None: nothing can be cut
        self.link: list[int | None] = [None] * len(self.next)
        self.cut: list[tuple[int, ...]] = [()] * len(self.next)
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for c, child in self.next[node].items():
                queue.append(child)
                if piece[child] is not None:
                    self.link[child], self.cut[child] = 1, (piece[child],)
                    continue
                at, cut = self.link[node], list(self.cut[node])
                while at is not None and c not in self.next[at]:
                    cut += self.cut[at]
                    at = self.link[at]
                if at is not None:
                    self.link[child], self.cut[child] = self.next[at][c], tuple(cut)
        self.known: dict[str, tuple[int, ...]] = {}

    def pieces(self, word: str) -> tuple[int, ...]:
        """The longest pieces of a word from left to right, or the unknown one if they don't make it up."""
        if len(word) > LONGEST_WORD:
            return (self.unknown,)
        found = self.known.get(word)
        if found is None:
            found = self._matched(word)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = found
        return found

    def _matched(self, word: str) -> tuple[int, ...]:
        node, out = 0, []
        for c in word:
            while c not in self.next[node]:
                if self.link[node] is None:
                    return (self.unknown,)
                out += self.cut[node]
                node = self.link[node]
            node = self.next[node][c]
        while node != 1:
            if self.link[node] is None:
                return (self.unknown,)
            out += self.cut[node]
            node = self.link[node]
        return tuple(out)

    def encode(self, text: str | None, most: int = MOST) -> list[int]:
        """Ids between the marks, ``most`` at most with the closing mark kept; a null text is an empty one."""
        ids = [self.vocabulary[OPENING]]
        for word in basic_words(text or ""):
            ids += self.pieces(word)
            if len(ids) >= most:
                break
        return [*ids[: most - 1], self.vocabulary[CLOSING]]


def encoded(text: Column, vocabulary: dict[str, int], most: int = MOST) -> Column:
    """Ids of a text: an array of longs. The vocabulary is a table of bounded size that goes to each task."""

    @F.arrow_udf("array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = WordPieces(vocabulary)
        for batch in batches:
            yield pa.array([pieces.encode(x, most) for x in batch.to_pylist()], pa.list_(pa.int64()))

    return run(text)

"""Exact token counts of byte-pair encodings in linear time, without producing token ids.

The vocabulary is compiled into a matching automaton. For every prefix of a piece of text, exactly one token can end its
encoding: the longest match whose pairing with the last token of the remaining prefix is compatible, that is, no merge
across their boundary would have come first. Counting therefore needs one number and one token per position.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from pathlib import Path

import ahocorasick
import regex

#: Bound of the tables that remember pieces, pairs and splits; they are emptied when it is reached.
MEMORY = 400_000


class BpeCounter:
    """Counts tokens of texts under the ranks in a ``.tiktoken`` file and a pattern that cuts texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.rank_of = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.unsafe = re.compile(r"\s (?!\S)").search
        self.pieces = _Memory(self.count_piece)
        self.starts = _Memory(self.count_whole)
        self.words = _Memory(lambda word: self.count_whole(" " + word))

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made ``token``; None for a single byte."""
        if token not in self.splits:
            parts = [bytes([b]) for b in self.bytes_of[token]]
            while len(parts) > 2:
                ranks = [self.rank_of.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
                best = min(ranks)
                if best == 1 << 60:
                    break
                at = ranks.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.splits[token] = (self.rank_of[parts[0]], self.rank_of[parts[1]]) if len(parts) == 2 else None
        return self.splits[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of the joined bytes of two tokens is just these two tokens.

        Goes back through the merges on both sides of the boundary, the latest first; a merge across the boundary must
        not have a lower rank than the merge that ended the state in which it was possible.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        x, y, limit, result = left, right, 1 << 60, True
        while True:
            across = self.rank_of.get(self.bytes_of[x] + self.bytes_of[y])
            if across is not None and across < limit:
                result = False
                break
            if x > y:
                part = self.split(x)
                if part is not None:
                    limit, x = x, part[1]
                    continue
                part = self.split(y)
                if part is None:
                    break
                limit, y = y + 1, part[0]
            else:
                part = self.split(y)
                if part is not None:
                    limit, y = y + 1, part[0]
                    continue
                part = self.split(x)
                if part is None:
                    break
                limit, x = x, part[1]
        if len(self.pairs) >= MEMORY:
            self.pairs.clear()
        self.pairs[left, right] = result
        return result

    def count_piece(self, piece: str) -> int:
        """Tokens of one piece, by one pass of the automaton over its bytes."""
        data = piece.encode("utf-8", "surrogatepass")
        if data in self.rank_of:
            return 1
        n = len(data)
        last, number = [-1] * (n + 1), [0] * (n + 1)
        done = 0
        for end, (length, token) in self.automaton.iter(data.decode("latin-1")):  # of one end, the longest comes first
            stop = end + 1
            if stop == done:
                continue
            before = stop - length
            if before == 0 or (last[before] >= 0 and self.compatible(last[before], token)):
                last[stop], number[stop], done = token, number[before] + 1, stop
        return number[n]

    def count_whole(self, text: str) -> int:
        """Tokens of a text that is cut into pieces by the pattern."""
        return sum(map(self.pieces.__getitem__, self.find(text)))

    def count(self, text: str) -> int:
        """Tokens of a text.

        A cut before a space never divides a piece, unless white space stands on both sides of that space; so a text
        without such a place is counted word by word, and words that come again are looked up.
        """
        for memory in (self.pieces, self.starts, self.words):
            if len(memory) > MEMORY:
                memory.clear()
        if self.unsafe(text):
            return self.count_whole(text)
        first, *rest = text.split(" ")
        return self.starts[first] + sum(map(self.words.__getitem__, rest))


class _Memory(dict):
    """Remembers what a function gives for short strings."""

    def __init__(self, function: Callable[[str], int]):
        super().__init__()
        self.function = function

    def __missing__(self, key: str) -> int:
        value = self.function(key)
        if len(key) <= 64:
            self[key] = value
        return value


_loaded: dict[tuple[str, str], BpeCounter] = {}


def load(path: str, pattern: str) -> BpeCounter:
    """The counter of a ``.tiktoken`` file, made once in each Python process."""
    key = (path, pattern)
    if key not in _loaded:
        lines = Path(path).read_bytes().splitlines()
        _loaded[key] = BpeCounter({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}, pattern)
    return _loaded[key]

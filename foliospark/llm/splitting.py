"""Splitting of oversized texts at natural boundaries, by lexical cohesion.

Words on both sides of every sentence boundary are compared; deep valleys of their similarity mark a change of topic. Each
cut goes to the deepest valley inside the window that the size limit leaves, else to the best smaller boundary there.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import ship_package

#: The white space that a text is trimmed of.
BLANK = " \t\r\n\f"
#: Sentences in the block on each side of a boundary, and the least part of the limit that a piece fills.
BLOCK, FILL = 3, 0.5
_SENTENCE = regex.compile(r"(?:[.!?…]+[\"'»”’)\]]*(?=\s)|[。！？；]+|\n)\s*")
_CLAUSE = regex.compile(r"[,;:，、：][\s]*|\s[–—-]\s")
_SPACE = regex.compile(r"\s+")
_WORD = regex.compile(r"\p{L}{3,}|\p{Han}")


def _cosine(a: Counter, b: Counter) -> float:
    if len(a) > len(b):
        a, b = b, a
    dot = sum(n * b[w] for w, n in a.items() if w in b)
    size = math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))
    return dot / size if size else 0.0


def boundaries(text: str) -> list[tuple[int, float]]:
    """Sentence and line boundaries with their depths: how far cohesion rises again on both sides, more at paragraphs."""
    ends = [m for m in _SENTENCE.finditer(text) if 0 < m.end() < len(text)]
    if not ends:
        return []
    at = [m.end() for m in ends]
    edges = [0, *at, len(text)]
    bags = [Counter(_WORD.findall(text[a:b].lower())) for a, b in zip(edges, edges[1:], strict=False)]
    similar = []
    for k in range(1, len(bags)):
        left, right = Counter(), Counter()
        for b in bags[max(0, k - BLOCK) : k]:
            left.update(b)
        for b in bags[k : k + BLOCK]:
            right.update(b)
        similar.append(_cosine(left, right))
    out = []
    for k, here in enumerate(similar):
        left = right = here
        for j in range(k - 1, -1, -1):
            if similar[j] < left:
                break
            left = similar[j]
        for j in range(k + 1, len(similar)):
            if similar[j] < right:
                break
            right = similar[j]
        gap = ends[k].group()
        bonus = 0.5 if gap.count("\n") > 1 else 0.1 if "\n" in gap else 0.0
        out.append((at[k], (left - here) + (right - here) + bonus))
    return out


def _whole(text: str, at: int, low: int) -> int:
    """The nearest place not after ``at`` that divides no character from its combining marks."""
    k = at
    while k > low + 1 and k < len(text) and (unicodedata.combining(text[k]) or text[k] in "‍️" or text[k - 1] == "‍"):
        k -= 1
    return k if k > low + 1 or at == k else at


def _place(text: str, marks: list[tuple[int, float]], low: int, high: int) -> tuple[int, str] | None:
    """The deepest valley from ``low`` to ``high``, else the last end of a clause or a word there."""
    a, b = bisect_left(marks, (low, -math.inf)), bisect_right(marks, (high, math.inf))
    if a < b:
        return max(marks[a:b], key=lambda m: (m[1], m[0]))[0], "topic"
    for pattern, name in ((_CLAUSE, "clause"), (_SPACE, "word")):
        ends = [m.end() for m in pattern.finditer(text, low - 1, high) if m.end() >= low]
        if ends:
            return ends[-1], name
    return None


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Pieces of ``text`` as (start, end, kind of the boundary at the end), each of at most ``limit`` code points.

    A piece starts ``overlap`` characters before the end of the one before. Kinds: topic (sentence or line boundary),
    clause, word, character, end.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    n, pieces, start, done = len(text), [], 0, 0
    marks = boundaries(text) if n > limit else []
    while n - start > limit:
        high = start + limit
        least = min(max(done, start + overlap) + 1, high)
        cut, kind = _place(text, marks, min(max(least, start + int(limit * FILL)), high), high) or _place(text, marks, least, high) or (_whole(text, high, least - 1), "character")
        pieces.append((start, cut, kind))
        done, start = cut, cut - overlap
    pieces.append((start, n, "end"))
    return pieces


def oversized_pieces(chunks: DataFrame, configs: DataFrame) -> DataFrame:
    """Pieces of the chunks whose trimmed content is longer than their configuration allows.

    Columns: chunk_id, piece_no (from 0), char_start and char_end in the trimmed content, boundary, content. With
    trim_pieces the content of a piece has no white space at its ends (the offsets still count it). Null and blank
    contents, chunks within their limit and chunks without a configuration yield nothing. Repeated rows count once; a
    null chunk_id is ignored. Where the limit is below 1, or the overlap negative or not below the limit, the chunk stays whole in
    one row whose boundary is ``error``; a null overlap is 0.
    """
    ship_package(chunks.sparkSession)
    conf = configs.groupBy("config_id").agg(F.max(F.struct("max_characters", "overlap", "trim_pieces")).alias("c")).select("config_id", "c.*")
    text = chunks.select(chunks["chunk_id"], chunks["config_id"], F.expr("trim(BOTH ' \t\r\n\f' FROM content)").alias("text"))
    large = text.join(conf, "config_id").where((F.length("text") > F.col("max_characters")) & F.col("chunk_id").isNotNull())
    large = large.dropDuplicates(["chunk_id"]).select("chunk_id", "text", "max_characters", "overlap", "trim_pieces")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for chunk, content, limit, overlap, trim in batch.itertuples(index=False):
                limit, overlap = int(limit), 0 if pd.isna(overlap) else int(overlap)
                if limit < 1 or not 0 <= overlap < limit:
                    rows.append((chunk, 0, 0, len(content), "error", content))
                    continue
                for no, (a, b, kind) in enumerate(split(content, limit, overlap)):
                    rows.append((chunk, no, a, b, kind, content[a:b].strip(BLANK) if trim else content[a:b]))
            yield pd.DataFrame(rows, columns=["chunk_id", "piece_no", "char_start", "char_end", "boundary", "content"])

    return large.mapInPandas(run, "chunk_id bigint, piece_no int, char_start bigint, char_end bigint, boundary string, content string")


def found(chunks: DataFrame, configs: DataFrame) -> DataFrame:
    """chunk_id of every chunk that had to be split."""
    return oversized_pieces(chunks, configs).where("piece_no = 1 OR boundary = 'error'").select("chunk_id").distinct()

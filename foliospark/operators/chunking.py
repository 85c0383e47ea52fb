"""Chunks of texts: fixed windows, semantic and structured splitting, their offsets, pages and headings."""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.classify import chunk_type
from foliospark.session import ship_package


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in characters, or in words where ``sizing`` is ``words``. ``kind``: text, markdown, yaml, or fixed."""

    max_characters: int = 1000
    overlap: int = 200
    trim: bool = True
    kind: str = "text"
    prepend_headings: bool = False
    sizing: str = "characters"

    def __post_init__(self) -> None:
        if self.max_characters < 1 or self.overlap < 0 or self.overlap >= self.max_characters:
            raise ValueError("overlap must be at least 0 and less than max_characters")


#: Size, overlap and dimensions of the named presets.
PRESETS = {"fast": (512, 50, 384), "balanced": (1024, 100, 768), "quality": (2000, 200, 1024), "multilingual": (1024, 100, 768)}


def preset(name: str) -> ChunkConfig:
    """The sizes of a preset."""
    size, overlap, _ = PRESETS[name]
    return ChunkConfig(size, overlap)


def fixed_windows(df: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Windows of ``size`` characters that share ``overlap``: id, chunk_index, content. Null and empty texts have none."""
    ChunkConfig(size, overlap)
    step = size - overlap
    text = df[text_col]
    last = F.greatest(F.lit(0), F.ceil((F.length("t") - overlap) / step).cast("int") - 1)
    rows = df.select(df[id_col].alias("id"), text.alias("t")).where(F.length("t") > 0)
    rows = rows.select("id", "t", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    return rows.select("id", "chunk_index", F.substring("t", F.col("chunk_index") * step + 1, F.lit(size)).alias("content"))


_LEVELS = [re.compile(p) for p in (r"\n{2,}", r"\n", r"(?<=[.!?。！？])\s+", r"\s+")]
_MARKDOWN = [re.compile(r"(?m)(?=^#{1,6}\s)"), re.compile(r"(?m)(?<=^```)\s*\n"), *_LEVELS]


def _pieces(text: str, start: int, limit: int, levels: list[re.Pattern]) -> Iterator[tuple[int, int]]:
    """Parts of a text that fit, cut at the widest boundaries that do it."""
    if len(text) <= limit:
        if text:
            yield start, start + len(text)
        return
    if not levels:
        for k in range(0, len(text), limit):
            yield start + k, start + min(len(text), k + limit)
        return
    at = 0
    for m in [*levels[0].finditer(text), None]:
        end = len(text) if m is None else m.end()
        if end > at:
            yield from _pieces(text[at:end], start + at, limit, levels[1:])
            at = end


def _word_slices(text: str, config: ChunkConfig, levels: list[re.Pattern]) -> list[tuple[int, int]]:
    """Slices of at most max_characters words, cut at the widest boundary within the second half where there is one."""
    words = [m.span() for m in re.finditer(r"\S+", text)]
    limit, overlap, out, k = config.max_characters, config.overlap, [], 0
    marks = [[m.end() for m in level.finditer(text)] for level in levels]
    while k < len(words):
        j = min(len(words), k + limit)
        if j < len(words):
            for ends in marks:
                at = bisect.bisect_right(ends, words[j][0]) - 1
                if at >= 0 and ends[at] > words[k + limit // 2][0]:
                    j = bisect.bisect_left(words, (ends[at], 0))
                    break
        out.append((words[k][0], words[j - 1][1]))
        k = j if j == len(words) else max(k + 1, j - overlap)
    return out


def semantic_slices(text: str, config: ChunkConfig) -> list[tuple[int, int]]:
    """Slices of at most max_characters that end at paragraph, line, sentence or word boundaries where there are any."""
    levels = _MARKDOWN if config.kind == "markdown" else _LEVELS
    if config.sizing == "words":
        return _word_slices(text, config, levels)
    parts = list(_pieces(text, 0, config.max_characters - config.overlap or 1, levels))
    out: list[tuple[int, int]] = []
    k = 0
    while k < len(parts):
        start = parts[k][0]
        if out and config.overlap:
            start = max(0, start - config.overlap)
            space = text.find(" ", start, parts[k][0])
            start = space + 1 if 0 <= space < parts[k][0] - 1 else start
        end, j = parts[k][1], k + 1
        while j < len(parts) and parts[j][1] - start <= config.max_characters:
            end, j = parts[j][1], j + 1
        out.append((start, end))
        k = j
    if config.trim:
        trimmed = []
        for a, b in out:
            s = text[a:b]
            a2 = a + len(s) - len(s.lstrip())
            b2 = b - (len(s) - len(s.rstrip()))
            if b2 > a2:
                trimmed.append((a2, b2))
        out = trimmed
    return out


def heading_map(text: str) -> list[tuple[int, int, str]]:
    """(byte offset, level, text) of the ATX headings outside code fences."""
    out, at, fenced = [], 0, False
    for line in text.split("\n"):
        if line.startswith("```"):
            fenced = not fenced
        m = re.match(r"(#{1,6})\s+(.+?)\s*#*\s*$", line)
        if m and not fenced:
            out.append((at, len(m[1]), m[2]))
        at += len(line.encode()) + 1
    return out


def heading_context(headings: list[tuple[int, int, str]], byte_start: int) -> list[tuple[int, str]]:
    """The stack of headings that are open at an offset."""
    stack: list[tuple[int, str]] = []
    for offset, level, text in headings:
        if offset > byte_start:
            break
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, text))
    return stack


def data_sections(text: str, limit: int) -> list[str] | None:
    """Sections of a JSON or YAML mapping, breadth first: ``# a > b`` and the value of each leaf; None for anything else."""
    try:
        if text.lstrip()[:1] in ("{", "["):
            data = json.loads(text)
        else:
            import yaml

            data = yaml.safe_load(text)
    except Exception:
        return None
    if not isinstance(data, dict):
        return None
    out, queue = [], [([], data)]
    while queue:
        path, value = queue.pop(0)
        if isinstance(value, dict) and value:
            queue += [([*path, str(k)], v) for k, v in value.items()]
            continue
        body = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, indent=2, default=str)
        head = f"# {' > '.join(path)}\n\n"
        room = max(1, limit - len(head))
        out += [head + body[k : k + room] for k in range(0, max(1, len(body)), room)]
    return out


CHUNK_SCHEMA = (
    "id bigint, chunk_index int, total_chunks int, content string, byte_start bigint, byte_end bigint, "
    "headings array<struct<level: int, text: string>>"
)


def chunk(df: DataFrame, id_col: str, text_col: str, config: ChunkConfig | None = None, data_format: Column | None = None) -> DataFrame:
    """Chunks of every text with dense index, byte offsets, open headings and kind.

    Rows whose ``data_format`` is yaml or json are cut as mappings under kind ``text`` too.
    Null and blank texts have no chunks. Texts that are no mapping are split as text also under kind ``yaml``, whose
    sections have the offsets 0.
    """
    ship_package(df.sparkSession)
    config = config or ChunkConfig()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, is_data in zip(batch["id"], batch["text"], batch["is_data"], strict=True):
                sections = data_sections(text, config.max_characters) if config.kind == "yaml" or is_data and config.kind == "text" else None
                if sections is not None:
                    rows += [(doc, k, len(sections), s, 0, 0, []) for k, s in enumerate(sections)]
                    continue
                slices = semantic_slices(text, config)
                headings = heading_map(text) if config.kind == "markdown" else []
                at = place = 0
                for k, (a, b) in enumerate(slices):
                    place = place + len(text[at:a].encode()) if a >= at else place - len(text[a:at].encode())
                    at = a
                    context = heading_context(headings, place)
                    content = text[a:b]
                    if config.prepend_headings and context:
                        content = " > ".join(h for _, h in context) + "\n\n" + content
                    rows.append((doc, k, len(slices), content, place, place + len(text[a:b].encode()), [{"level": lv, "text": h} for lv, h in context]))
            yield pd.DataFrame(rows, columns=["id", "chunk_index", "total_chunks", "content", "byte_start", "byte_end", "headings"])

    is_data = F.lit(False) if data_format is None else F.coalesce(F.lower(data_format).isin("yaml", "json"), F.lit(False))
    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"), is_data.alias("is_data")).where(F.length(F.trim("text")) > 0)
    out = source.mapInPandas(run, CHUNK_SCHEMA)
    return out.withColumn("chunk_type", chunk_type(F.col("content"), F.transform("headings", lambda h: h["text"])))


def page_range(byte_start: Column, byte_end: Column, pages: Column) -> Column:
    """Struct of the first and last page that a chunk overlaps; pages: array of (byte_start, byte_end, page_number)."""
    hit = F.filter(pages, lambda p: (p["byte_start"] < byte_end) & (p["byte_end"] > byte_start))
    numbers = F.transform(hit, lambda p: p["page_number"])
    return F.struct(F.array_min(numbers).alias("first_page"), F.array_max(numbers).alias("last_page"))


def chunk_pages(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Chunks with the pages they overlap, as a join by document: id, chunk_index, first_page, last_page.

    Joined on the document only, never all with all; chunks that overlap no page have nulls.
    """
    p = pages.select("id", F.col("byte_start").alias("p_start"), F.col("byte_end").alias("p_end"), "page_number")
    hit = (F.col("byte_start") < F.col("p_end")) & (F.col("byte_end") > F.col("p_start"))
    rows = chunks.select("id", "chunk_index", "byte_start", "byte_end").join(p, "id", "left")
    number = F.when(hit, F.col("page_number"))
    return rows.groupBy("id", "chunk_index").agg(F.min(number).alias("first_page"), F.max(number).alias("last_page"))


def valid_boundaries(pages: Column) -> Column:
    """Whether page boundaries are ordered, do not overlap and do not end before they start."""
    inside = F.forall(pages, lambda p: p["byte_start"] <= p["byte_end"])
    pairs = F.zip_with(F.slice(pages, 1, F.greatest(F.size(pages) - 1, F.lit(0))), F.slice(pages, 2, F.greatest(F.size(pages), F.lit(1))), lambda a, b: a["byte_end"] <= b["byte_start"])
    return inside & F.forall(pairs, lambda x: F.coalesce(x, F.lit(True)))


def recompute_boundaries(content: str, pages: list[str]) -> list[tuple[int, int, int]]:
    """(byte_start, byte_end, number) of each page's text in the content, searched from the end of the one before.

    A page that does not stand there is searched by its first line that is not blank, else left out.
    """
    data, at, out = content.encode(), 0, []
    for number, page in enumerate(pages, 1):
        text = page.strip().encode()
        if not text:
            continue
        found = data.find(text, at)
        size = len(text)
        if found < 0:
            line = next(x for x in text.split(b"\n") if x.strip())
            found, size = data.find(line, at), len(text)
            if found < 0:
                continue
        end = min(len(data), found + size)
        out.append((found, end, number))
        at = end
    return out

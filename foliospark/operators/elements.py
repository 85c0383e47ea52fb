"""Elements of plain and Markdown texts: list items, paragraphs, headings, their tree, page markers and spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.session import ship_package

# Bullets and the marker between pages.
_BULLET = r"^\s*[-*•](\s|$)"
_NUMBER = r"^\s*\d{1,2}\. "
_LETTER = r"^\s*[A-Za-z]\. "
PAGE_MARKER = "\n\n<!-- PAGE {page_num} -->\n\n"


def list_kind(line: Column) -> Column:
    """bullet, numbered, lettered or indented; null for a line that is no list item."""
    return (
        F.when(line.rlike(_BULLET), "bullet").when(line.rlike(_NUMBER), "numbered").when(line.rlike(_LETTER), "lettered")
        .when(line.rlike(r"^ {4}\s*\S"), "indented")
    )


def list_items(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """List items of every text: id, line_no (from 0), list_type, indent_level, text. Null texts have none."""
    rows = df.select(df[id_col].alias("id"), F.posexplode(F.split(df[text_col], "\n")).alias("line_no", "line"))
    kind = list_kind(F.col("line"))
    indent = F.length(F.regexp_extract("line", r"^( *)", 1))
    return rows.select("id", "line_no", kind.alias("list_type"), F.floor(indent / 2).cast("int").alias("indent_level"), F.col("line").alias("text")).where("list_type IS NOT NULL")


def element_id(kind: str, text: str, page: int | None, index: int) -> str:
    """Stable id of an element: three polynomial hashes over its kind, text and place, combined in 64 bits."""
    mask = 2**64 - 1

    def poly(data: bytes) -> int:
        h = 0
        for b in data:
            h = (h * 31 + b) & mask
        return h

    h = poly(kind.encode())
    for part in (poly(text.encode()), poly(f"{page or 0}:{index}".encode())):
        h = (h * 65599 + part) & mask
    return f"elem-{h:x}"


_ITEM = re.compile(r"\s*(?:[-*•](?:\s|$)|\d{1,2}\. |[A-Za-z]\. )")


def split_elements(text: str) -> list[tuple[str, int, str]]:
    """(kind, level, text) of headings, list items, code blocks, page breaks and paragraphs, in their order."""
    out: list[tuple[str, int, str]] = []
    paragraph: list[str] = []
    code: list[str] | None = None

    def flush() -> None:
        body = "\n".join(paragraph).strip()
        if body:
            out.append(("paragraph", 0, body))
        paragraph.clear()

    for line in text.split("\n"):
        if code is not None:
            if line.startswith("```"):
                out.append(("code", 0, "\n".join(code)))
                code = None
            else:
                code.append(line)
        elif line.startswith("```"):
            flush()
            code = []
        elif m := re.match(r"(#{1,6})\s+(.*)", line):
            flush()
            out.append(("heading", len(m[1]), m[2].strip()))
        elif _ITEM.match(line):
            flush()
            out.append(("list_item", (len(line) - len(line.lstrip(" "))) // 2, _ITEM.sub("", line, count=1).strip()))
        elif "\f" in line:
            flush()
            out.append(("page_break", 0, ""))
        elif not line.strip():
            flush()
        else:
            paragraph.append(line)
    if code is not None:
        paragraph[:0] = ["```", *code]
    flush()
    return out


def parents(elements: list[tuple[str, int, str]]) -> list[int | None]:
    """For each element the number of the heading it stands under: the latest one of a lower level; None at the root."""
    stack: list[tuple[int, int]] = []
    out: list[int | None] = []
    for k, (kind, level, _) in enumerate(elements):
        if kind == "heading":
            while stack and stack[-1][0] >= level:
                stack.pop()
        out.append(stack[-1][1] if stack else None)
        if kind == "heading":
            stack.append((level, k))
    return out


def elements(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Elements of every text as a tree: id, element_no, element_id, kind, level, text, parent_no. Null and empty texts have none."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                found = split_elements(text)
                page = 1
                for k, ((kind, level, body), parent) in enumerate(zip(found, parents(found), strict=True)):
                    page += kind == "page_break"
                    rows.append((doc, k, element_id(kind, body, page, k), kind, level, body, page, parent))
            frame = pd.DataFrame(rows, columns=["id", "element_no", "element_id", "kind", "level", "text", "page_number", "parent_no"])
            yield frame.astype({"parent_no": "Int64"})

    source = df.select(df[id_col].alias("id"), df[text_col].alias("text")).where(F.length("text") > 0)
    return source.mapInPandas(run, "id bigint, element_no int, element_id string, kind string, level int, text string, page_number int, parent_no bigint")


def with_page_markers(pages: Column, marker: str = PAGE_MARKER) -> Column:
    """Pages joined to one text with a marker before every page, the first included."""
    before, after = marker.split("{page_num}")
    return F.array_join(F.transform(pages, lambda p, k: F.concat(F.lit(before), (k + 1).cast("string"), F.lit(after), F.coalesce(p, F.lit("")))), "")


def shift_spans(spans: Column, cut: Column, length: Column) -> Column:
    """Spans (start, end) of a text after ``cut`` characters at its front and all beyond ``length`` are gone; empty ones go."""
    moved = F.transform(
        spans, lambda s: F.struct(F.greatest(s["start"] - cut, F.lit(0)).alias("start"), F.least(s["end"] - cut, length).alias("end"))
    )
    return F.filter(moved, lambda s: s["end"] > s["start"])


def document_pages(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pages between form feeds with their byte ranges: id, page_number, byte_start, byte_end, text."""
    t = df[text_col]
    pages = F.split(t, "\f")
    starts = F.transform(F.sequence(F.lit(0), F.size(pages) - 1), lambda k: F.aggregate(F.slice(pages, F.lit(1), k), F.lit(0), lambda a, p: a + F.octet_length(p) + 1))
    rows = df.select(df[id_col].alias("id"), F.posexplode(F.arrays_zip(pages.alias("text"), starts.alias("byte_start"))).alias("k", "p")).where(F.col("p").isNotNull())
    return rows.select("id", (F.col("k") + 1).alias("page_number"), F.col("p.byte_start"), (F.col("p.byte_start") + F.octet_length("p.text")).alias("byte_end"), F.col("p.text"))


def heading_context(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The headings that are open at each line, as of join by windows: id, line_no (from 1), context (texts joined by `` > ``).

    A heading closes those of its level and below. Lines before the first heading, and lines of code fences that only look
    like headings, open none. Null texts have no lines; lines without an open heading are left out.
    """
    lines = df.select(df[id_col].alias("id"), F.posexplode(F.split(df[text_col], "\n")).alias("no", "line"))
    order = Window.partitionBy("id").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fence = F.col("line").startswith("```")
    lines = lines.withColumn("fences", F.sum(fence.cast("int")).over(order))
    level = F.when((F.col("fences") % 2 == 0) & ~fence, F.nullif(F.length(F.regexp_extract("line", r"^(#{1,6})[ \t]+[^ \t\r]", 1)), F.lit(0)))
    lines = lines.withColumn("level", level).withColumn("title", F.trim(F.regexp_replace("line", r"^#+[ \t]+|\r$", "")))
    for k in range(1, 7):
        lines = lines.withColumn(f"h{k}", F.last(F.when(F.col("level") == k, F.struct("no", "title")), ignorenulls=True).over(order))
    newest, parts = F.lit(-1), []
    for k in range(1, 7):
        parts.append(F.when(F.col(f"h{k}.no") > newest, F.col(f"h{k}.title")))
        newest = F.greatest(newest, F.coalesce(F.col(f"h{k}.no"), F.lit(-1)))
    context = F.array_join(F.array_compact(F.array(*parts)), " > ")
    return lines.select("id", (F.col("no") + 1).alias("line_no"), context.alias("context")).where("context != ''")

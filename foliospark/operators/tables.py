"""Tables of cells: rendering, CSV profiles, and grids rebuilt from placed words."""

from __future__ import annotations

import csv
import io
import re
import statistics
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.session import ship_package

# Delimiters in the order they are tried, and the patterns of dates.
DELIMITERS = [",", "\t", "|", ";"]
DATES = [r"^\d{4}-\d{2}-\d{2}", r"^\d{1,2}/\d{1,2}/\d{2,4}", r"^\d{1,2}\.\d{1,2}\.\d{2,4}"]


def table_markdown(cells: Column) -> Column:
    """Markdown with the width of the first row: further cells are cut, short rows padded; null and empty give ``""``."""
    width = F.size(cells[0])
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.slice(F.concat(F.transform(r, lambda x: F.coalesce(x, F.lit(""))), F.array_repeat(F.lit(""), width)), F.lit(1), width), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("------"), width), "|"), F.lit("|"))
    body = F.transform(F.slice(cells, 2, 1_000_000), row)
    out = F.concat(F.array_join(F.concat(F.array(row(cells[0]), rule), body), "\n"), F.lit("\n"))
    return F.when(cells.isNull() | (F.size(cells) == 0), "").otherwise(out)


def table_gfm(cells: Column) -> Column:
    """GFM table padded to the widest row, pipes escaped."""
    width = F.array_max(F.transform(cells, lambda r: F.size(r)))
    escape = lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("\\|"))
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.slice(F.concat(F.transform(r, escape), F.array_repeat(F.lit(""), width)), F.lit(1), width), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- "), width), "|"), F.lit("|"))
    out = F.array_join(F.concat(F.array(row(cells[0]), rule), F.transform(F.slice(cells, 2, 1_000_000), row)), "\n")
    return F.when(cells.isNull() | (F.size(cells) == 0) | (width == 0), "").otherwise(out)


def table_grid(cells: Column) -> Column:
    """Cells as an array of (row, column, text, is_header, row_span, column_span); the first row is the header."""
    row = lambda r, k: F.transform(
        r,
        lambda x, j: F.struct(k.alias("row"), j.alias("column"), F.coalesce(x, F.lit("")).alias("text"), (k == 0).alias("is_header"), F.lit(1).alias("row_span"), F.lit(1).alias("column_span")),
    )
    return F.flatten(F.transform(cells, row))


def table_tsv(cells: Column) -> Column:
    """Rows as lines, cells between tabs."""
    return F.coalesce(F.array_join(F.transform(cells, lambda r: F.array_join(r, "\t", "")), "\n"), F.lit(""))


def sniff_delimiter(text: str) -> str:
    """The delimiter whose counts agree best over the first ten lines; ties go to the earlier, none to the comma."""
    lines = [x for x in text.splitlines()[:10] if x.strip()]
    best, most = ",", 0
    for d in DELIMITERS:
        widths = [len(x.split(d)) for x in lines]
        if len(widths) >= 2 and widths[0] > 1:
            score = sum(w == widths[0] for w in widths) * widths[0]
            if score > most:
                best, most = d, score
    return best


def parse_csv(text: str, delimiter: str | None = None) -> list[list[str]]:
    """Rows of a CSV text, blank ones dropped."""
    rows = csv.reader(io.StringIO(text), delimiter=delimiter or sniff_delimiter(text))
    return [r for r in rows if any(c.strip() for c in r)]


def _numeric(cell: str) -> bool:
    try:
        float(cell.strip())
        return True
    except ValueError:
        return False


def has_header(rows: list[list[str]]) -> bool:
    """Whether the first of several rows has no numbers while one of the next five does."""
    if len(rows) < 2 or len(rows[0]) < 2 or any(_numeric(c) for c in rows[0] if c.strip()):
        return False
    return any(_numeric(c) for r in rows[1:6] for c in r if c.strip())


def column_types(rows: list[list[str]], header: bool) -> list[str]:
    """numeric, date or text of each column, by at least half of the filled cells of the first twenty rows."""
    width = max(map(len, rows), default=0)
    data = rows[header : header + 20]
    out = []
    for j in range(width):
        cells = [r[j].strip() for r in data if j < len(r) and r[j].strip()]
        numbers = sum(map(_numeric, cells))
        dates = sum(any(re.search(p, c) for p in DATES) for c in cells if not _numeric(c))
        out.append("text" if not cells else "numeric" if numbers * 2 >= len(cells) else "date" if dates * 2 >= len(cells) else "text")
    return out


def csv_profile(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Delimiter, header, shape and column types of CSV texts: id, delimiter, has_header, n_rows, n_columns, types. Null texts give nothing."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                d = sniff_delimiter(text)
                cells = parse_csv(text, d)
                header = has_header(cells)
                rows.append((doc, d, header, len(cells), max(map(len, cells), default=0), column_types(cells, header)))
            yield pd.DataFrame(rows, columns=["id", "delimiter", "has_header", "n_rows", "n_columns", "types"])

    source = df.select(df[id_col].alias("id"), df[text_col].alias("text")).where(F.col("text").isNotNull())
    return source.mapInPandas(run, "id bigint, delimiter string, has_header boolean, n_rows int, n_columns int, types array<string>")


def cell_types(df: DataFrame, id_col: str, cells_col: str) -> DataFrame:
    """Column types of tables by exploded cells: id, column_no, kind; the first row counts as header."""
    rows = df.select(df[id_col].alias("id"), F.posexplode(df[cells_col]).alias("row_no", "row")).where((F.col("row_no") >= 1) & (F.col("row_no") <= 20))
    cells = rows.select("id", F.posexplode("row").alias("column_no", "cell")).where(F.trim("cell") != "")
    number = F.trim("cell").rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    date = F.lit(False)
    for p in DATES:
        date = date | F.trim("cell").rlike(p)
    out = cells.groupBy("id", "column_no").agg(F.count("*").alias("n"), F.sum(number.cast("int")).alias("n_number"), F.sum((~number & date).cast("int")).alias("n_date"))
    kind = F.when(F.col("n_number") * 2 >= F.col("n"), "numeric").when(F.col("n_date") * 2 >= F.col("n"), "date").otherwise("text")
    return out.select("id", "column_no", kind.alias("kind"))


def words_of_tsv(tsv: Column) -> Column:
    """Words of an OCR result in twelve tab-separated columns: level 5, not empty, with their boxes and confidence."""
    rows = F.transform(F.split(tsv, "\n"), lambda x: F.split(x, "\t"))
    rows = F.filter(rows, lambda r: (F.size(r) >= 12) & (r[0] == "5") & (F.trim(r[11]) != ""))
    return F.transform(
        rows,
        lambda r: F.struct(
            F.trim(r[11]).alias("text"), r[6].cast("int").alias("left"), r[7].cast("int").alias("top"), r[8].cast("int").alias("width"), r[9].cast("int").alias("height"),
            r[10].cast("double").alias("confidence"),
        ),
    )


def column_bands(lefts: list[int], threshold: int) -> list[int]:
    """Places of columns: words whose left edges are near the first of a group; the upper median stands for it."""
    bands: list[list[int]] = []
    for x in lefts:
        for b in bands:
            if abs(x - b[0]) <= threshold:
                b.append(x)
                break
        else:
            bands.append([x])
    return sorted(sorted(b)[len(b) // 2] for b in bands)


def row_bands(words: list[tuple[int, int]], ratio: float) -> list[int]:
    """Centres of rows from (top, height): nearer than a part of the median height is one row."""
    if not words:
        return []
    threshold = int(statistics.median_high([h for _, h in words]) * ratio)
    bands: list[list[int]] = []
    for c in [t + h // 2 for t, h in words]:
        for b in bands:
            if abs(c - b[0]) <= threshold:
                b.append(c)
                break
        else:
            bands.append([c])
    return sorted(sorted(b)[len(b) // 2] for b in bands)


def rebuild_grid(words: list[dict], column_threshold: int = 50, row_ratio: float = 0.5) -> list[list[str]]:
    """Cells from placed words (text, left, top, width, height); empty rows and columns are dropped."""
    words = [w for w in words if (w.get("text") or "").strip()]
    if not words:
        return []
    columns = column_bands([w["left"] for w in words], column_threshold)
    rows = row_bands([(w["top"], w["height"]) for w in words], row_ratio)
    grid: dict[tuple[int, int], list[tuple[int, str]]] = {}
    for w in words:
        centre = w["top"] + w["height"] // 2
        r = min(range(len(rows)), key=lambda k: (abs(rows[k] - centre), k))
        c = min(range(len(columns)), key=lambda k: (abs(columns[k] - w["left"]), k))
        grid.setdefault((r, c), []).append((w["left"], w["text"].strip()))
    used_r, used_c = sorted({r for r, _ in grid}), sorted({c for _, c in grid})
    return [[" ".join(t for _, t in sorted(grid.get((r, c), []))) for c in used_c] for r in used_r]


def rebuild_tables(df: DataFrame, keys: list[str], words_col: str = "words") -> DataFrame:
    """Grid of each row's array of words: the keys and cells."""
    ship_package(df.sparkSession)

    @F.pandas_udf("array<array<string>>")
    def build(s: pd.Series) -> pd.Series:
        return s.map(lambda ws: [] if ws is None else rebuild_grid([dict(w) for w in ws]))

    return df.select(*keys, build(F.col(words_col)).alias("cells"))

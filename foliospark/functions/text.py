"""Text statistics, decoding repairs and normal forms as Column expressions.

All functions give null for null and treat the empty text as stated; none runs Python rows but ``nfc``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.session import ship_package

BLANK = r"[ \t\n\r\f\x0B]"


def bound(body: Callable[[Column], Column], **columns: Column) -> Column:
    """``body`` of a struct of the columns, each of which is evaluated once however often the body uses it."""
    return F.transform(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])), body)[0]


def trimmed(c: Column) -> Column:
    """Without ASCII white space at both ends."""
    return F.regexp_replace(F.regexp_replace(c, f"^{BLANK}+", ""), f"{BLANK}+$", "")


def word_count(c: Column) -> Column:
    """Number of words between runs of ASCII white space; blank gives 0."""
    return F.regexp_count(c, F.lit(r"[^ \t\n\r\f\x0B]+"))


def line_count(c: Column) -> Column:
    """Number of lines; a line end at the very end adds none, the empty text has none."""
    ends = F.regexp_count(c, F.lit(r"\n"))
    return F.when(F.octet_length(c) == 0, 0).when(c.endswith("\n"), ends).otherwise(ends + 1)


def text_statistics(c: Column) -> Column:
    """Struct of lines, words and bytes (which is what the character count means here)."""
    return F.struct(line_count(c).alias("lines"), word_count(c).alias("words"), F.octet_length(c).alias("bytes"))


def markdown_headers(c: Column) -> Column:
    """Texts of ATX headers outside code fences; the space after the signs is optional."""
    open_text = F.regexp_replace(c, r"(?ms)^```.*?^```[ \t]*\r?$", "")
    return F.regexp_extract_all(open_text, F.lit(r"(?m)^#{1,6}[ \t]*([^\n]+)$"), F.lit(1))


def markdown_links(c: Column) -> Column:
    """Array of (label, target) of inline links."""
    labels = F.regexp_extract_all(c, F.lit(r"\[([^\]]+)\]\(([^)]+)\)"), F.lit(1))
    targets = F.regexp_extract_all(c, F.lit(r"\[([^\]]+)\]\(([^)]+)\)"), F.lit(2))
    return F.transform(F.arrays_zip(labels.alias("label"), targets.alias("target")), lambda x: F.struct(x["label"].alias("label"), x["target"].alias("target")))


def code_blocks(c: Column) -> Column:
    """Array of (language, code) of closed code fences; a fence without a language has ``plain``."""
    pattern = r"(?ms)^```(\w*)[ \t]*\r?\n(.*?)^```[ \t]*\r?$"
    zipped = F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("l"), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("c"))
    return F.transform(zipped, lambda x: F.struct(F.when(x["l"] == "", "plain").otherwise(x["l"]).alias("language"), x["c"].alias("code")))


def _bytes_of(c: Column, pattern: str) -> Column:
    return F.aggregate(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.lit(0), lambda a, x: a + F.octet_length(x))


def text_confidence(c: Column) -> Column:
    """How readable a decoded text looks, from 0 to 1: ASCII share, less replacement runs, control and much Cyrillic."""
    size = F.octet_length(c).cast("double")
    readable = F.regexp_count(c, F.lit(r"[\x21-\x7E \t\n\r\f]"))
    broken = F.regexp_count(c, F.lit("�+"))
    control = F.regexp_count(c, F.lit(r"[\x00-\x08\x0E-\x1F\x7F]"))
    cyrillic = F.regexp_count(c, F.lit("[Ѐ-ӿ]{2,}"))
    penalty = F.when(cyrillic > size * 0.1, 0.3).otherwise(0.0)
    raw = readable / size - (broken + control * 2) / size - penalty
    return F.when(c.isNull(), None).when(size == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))


def fix_mojibake(c: Column) -> Column:
    """Without control characters, runs of U+FFFD and loose combining marks."""
    out = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.regexp_replace(F.regexp_replace(out, "�+", ""), "[̀-ͯ]", "")


def nfc(c: Column) -> Column:
    """Unicode normal form C; ASCII texts stay in the JVM."""
    ship_package()

    @F.pandas_udf("string")
    def normal(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))

    return F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(normal(c))


def normalize_spaces(c: Column) -> Column:
    """Blanks collapsed and lines trimmed within paragraphs; empty lines and paragraphs dropped."""
    line = lambda x: trimmed(F.regexp_replace(x, r"[ \t\f\r\x0B]+", " "))
    lines = lambda p: F.filter(F.transform(F.split(p, "\n"), line), lambda x: x != "")
    paragraphs = F.transform(F.split(c, "\n\n"), lambda p: F.array_join(lines(p), "\n"))
    return F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n\n")


def normalize_whitespace(c: Column) -> Column:
    """Runs of blanks to one, three and more line ends to two, no blanks after a line end."""
    out = F.regexp_replace(c, r"[ \t\f\r\x0B  -​　]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r"\n\s*\n\s*\n+", "\n\n"), r"\n +", "\n")


def is_blank_page(c: Column) -> Column:
    """Whether fewer than three characters are no white space."""
    return F.length(F.regexp_replace(c, BLANK, "")) < 3


def normalize_inline(c: Column) -> Column:
    """Runs of spaces and line ends to one space, control characters other than tab dropped."""
    return F.regexp_replace(F.regexp_replace(c, r"[ \n]+", " "), r"[\x00-\x08\x0A-\x1F]", "")


def has_cjk(c: Column) -> Column:
    """Whether a Han character stands in the text."""
    return c.rlike("[一-鿿]")


def valid_utf8(c: Column) -> Column:
    """Whether bytes (or a text's bytes) are well-formed UTF-8."""
    return F.is_valid_utf8(c.cast("string"))


def join_words(left: Column, right: Column) -> Column:
    """Two texts joined with a space, but without one where Han characters meet."""
    tight = left.rlike("[一-鿿]$") & right.rlike("^[一-鿿]")
    return F.when(tight, F.concat(left, right)).otherwise(F.concat_ws(" ", left, right))


def snake_to_camel(key: Column) -> Column:
    """mime_type to mimeType."""
    parts = F.split(key, "_")
    rest = F.transform(F.slice(parts, 2, 1000), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1000)))
    return F.concat(parts[0], F.array_join(rest, ""))


def camel_to_snake(key: Column) -> Column:
    """mimeType to mime_type."""
    return F.lower(F.regexp_replace(key, r"(?<=[a-z0-9])([A-Z])", "_$1"))


def char_entropy(c: Column) -> Column:
    """Entropy of the characters without case, in bits, at most 5; 0 for the empty text."""
    def bits(r: Column) -> Column:
        counts = F.transform(F.array_distinct(F.split(r["low"], "")), lambda x: r["n"] - F.length(F.replace(r["low"], x, F.lit(""))))
        total = F.aggregate(counts, F.lit(0.0), lambda a, k: a - (k / r["n"]) * F.log2(k / r["n"]))
        return F.when(r["n"] == 0, 0.0).otherwise(F.least(F.lit(5.0), total))

    return F.when(c.isNotNull(), bound(bits, low=F.lower(c), n=F.length(c)))


def doc_stats(df: DataFrame) -> DataFrame:
    """Documents, words, lines and bytes by language label."""
    t = F.col("text")
    return df.groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.sum(word_count(t)).alias("n_words"), F.sum(line_count(t)).alias("n_lines"), F.sum(F.octet_length(t)).alias("n_bytes")
    )

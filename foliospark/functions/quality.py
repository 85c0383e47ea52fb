"""Quality score of a text, its parts, and the cleaning of what lowers it. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import bound, normalize_whitespace, trimmed, word_count

# Weights, limits and patterns of the score.
WEIGHTS = {"ocr": 0.3, "script": 0.2, "navigation": 0.1, "structure": 0.2, "metadata": 0.1}
LEAST_BYTES, LARGE_BYTES = 10, 1000
SCATTERED = r"\b[a-zA-Z]\s{2,}[a-zA-Z]\s{2,}[a-zA-Z]\b"
REPEATED = r"[.]{3,}|[_]{3,}"
ISOLATED = r"\s[.,;:!?]\s"
MALFORMED = r"\b[a-zA-Z]+[0-9]+[a-zA-Z]+[a-zA-Z0-9]*\b"
WIDE = r"\s{3,}"
FUNCTION = r"(?i)function\s+\w+\s*\([^)]*\)\s*\{[^}]*\}"
RULES = r"(?i)\.[a-zA-Z][\w-]*\s*\{[^}]*\}"
SCRIPT = r"(?is)<script[^>]*>.*?</script>"
STYLE = r"(?is)<style[^>]*>.*?</style>"
NAVIGATION = r"(?i)\b(?:Skip to main content|Back to top|Main navigation|Site navigation)\b"
BREADCRUMB = r"(?:Home\s*[>»]\s*|[>»]\s*){2,}"
PAGINATION = r"(?i)\b(?:Page \d+ of \d+|First page|Last page|Previous page|Next page|^\d+ of \d+$)\b"
SENTENCE = r"[.!?]\s+[A-Z]"
FIELDS = ["title", "author", "subject", "description", "keywords"]

_SEPARATOR = r"^\s*\|[|\-:\s]*\|\s*$|^\s*\|\s*$"


def _bytes(c: Column, *patterns: str) -> Column:
    """Bytes of all matches of the patterns, each searched on its own."""
    total = F.lit(0)
    for p in patterns:
        total = total + F.aggregate(F.regexp_extract_all(c, F.lit(p), F.lit(0)), F.lit(0), lambda a, x: a + F.octet_length(x))
    return total


def _share(c: Column, part: Column) -> Column:
    ratio = lambda r: F.when(r["n"] == 0, 0.0).otherwise(F.least(F.lit(1.0), r["part"] / r["n"]))
    return F.when(c.isNotNull(), bound(ratio, n=F.octet_length(c), part=part))


def dash_bytes(c: Column) -> Column:
    """Bytes of runs of three and more dashes, but for the separator rows of tables."""
    lines = F.filter(F.split(c, "\n"), lambda x: ~x.rlike(_SEPARATOR) & x.contains("---"))
    return F.aggregate(lines, F.lit(0), lambda a, x: a + _bytes(x, "-{3,}"))


def ocr_bytes(c: Column) -> Column:
    """Bytes of what looks like scanning errors; 0 for a text without two spaces and without three dots."""
    one = f"{SCATTERED}|{REPEATED}|{ISOLATED}|{MALFORMED}|{WIDE}"
    return F.when(c.isNull(), None).when(c.contains("  ") | c.contains("..."), _bytes(c, one) + dash_bytes(c)).otherwise(0)


def ocr_penalty(c: Column) -> Column:
    return _share(c, ocr_bytes(c))


def script_penalty(c: Column) -> Column:
    """Share of functions, style rules and script and style elements; 0 for a text that mentions none."""
    some = c.contains("function") | c.contains("<script") | c.contains("<style")
    return _share(c, F.when(some, _bytes(c, FUNCTION, RULES, SCRIPT, STYLE)).otherwise(0))


def navigation_penalty(c: Column) -> Column:
    return _share(c, _bytes(c, NAVIGATION, BREADCRUMB, PAGINATION))


def sentence_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(SENTENCE))


def paragraph_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("\n\n")) + 1


def structure_tenths(c: Column) -> Column:
    """Structure bonus in whole tenths: sentence length, paragraph length, several paragraphs, any sentence end."""

    def points(r: Column) -> Column:
        words, paragraphs = r["words"], r["paragraphs"]
        a, b = words / F.greatest(r["sentences"], F.lit(1)), words / paragraphs
        total = (
            F.when(a.between(10, 30), 3).otherwise(0) + F.when(b.between(50, 300), 3).otherwise(0)
            + F.when(paragraphs > 1, 2).otherwise(0) + F.when(r["ends"], 2).otherwise(0)
        )
        return F.when(words == 0, 0).otherwise(total)

    return F.when(c.isNotNull(), bound(points, words=word_count(c), sentences=sentence_count(c), paragraphs=paragraph_count(c), ends=c.rlike("[.!?]")))


def metadata_bonus(m: Column) -> Column:
    """Share of the five important fields that a map has; 0 for a null map."""
    keys = F.coalesce(F.map_keys(m), F.array().cast("array<string>"))
    return F.size(F.array_intersect(keys, F.array(*map(F.lit, FIELDS)))) / len(FIELDS)


def quality_score(c: Column, metadata: Column | None = None) -> Column:
    """Score from 0 to 1. Blank and null texts have 0, texts under ten bytes 0.1; script and navigation count in large texts only."""
    size = F.octet_length(c)
    score = 1.0 - WEIGHTS["ocr"] * ocr_penalty(c) + WEIGHTS["structure"] * structure_tenths(c) / 10
    large = F.when(size > LARGE_BYTES, WEIGHTS["script"] * script_penalty(c) + WEIGHTS["navigation"] * navigation_penalty(c)).otherwise(0.0)
    score = score - large
    if metadata is not None:
        score = score + WEIGHTS["metadata"] * metadata_bonus(metadata)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))
    return F.when(c.isNull() | (trimmed(c) == ""), 0.0).when(size < LEAST_BYTES, 0.1).otherwise(score)


def collapse_scattered(c: Column) -> Column:
    """``a  b  c`` to ``abc``: the blanks between three single letters go."""
    return F.regexp_replace(c, r"\b([a-zA-Z])\s{2,}([a-zA-Z])\s{2,}([a-zA-Z])\b", "$1$2$3")


def dashes_to_dots(c: Column) -> Column:
    """Runs of dashes to three dots, but for the separator rows of tables."""
    return F.array_join(F.transform(F.split(c, "\n"), lambda x: F.when(x.rlike(_SEPARATOR), x).otherwise(F.regexp_replace(x, "-{3,}", "..."))), "\n")


def collapse_punctuation(c: Column) -> Column:
    """A run of any of ``! ? . ,`` to its first character."""
    return F.regexp_replace(c, "([!?.,])[!?.,]+", "$1")


def clean_text(c: Column) -> Column:
    """Without scripts, scanning errors and navigation, white space normal; null stays null."""
    for p in (SCRIPT, STYLE, FUNCTION, RULES):
        c = F.regexp_replace(c, p, " ")
    c = dashes_to_dots(collapse_scattered(c))
    for p, to in ((REPEATED, "..."), (ISOLATED, " "), (MALFORMED, " "), (WIDE, " "), (NAVIGATION, " "), (BREADCRUMB, " "), (PAGINATION, " ")):
        c = F.regexp_replace(c, p, to)
    return trimmed(normalize_whitespace(c))

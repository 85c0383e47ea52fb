"""Normal forms of language labels and source names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ISO 639-1, ISO 639-3 (or 639-2) and English names, each with its ISO 639-3 code.
LANGUAGES = {
    "en": "eng", "eng": "eng", "english": "eng",
    "de": "deu", "deu": "deu", "ger": "deu", "german": "deu",
    "fr": "fra", "fra": "fra", "fre": "fra", "french": "fra",
    "es": "spa", "spa": "spa", "spanish": "spa",
    "it": "ita", "ita": "ita", "italian": "ita",
    "pt": "por", "por": "por", "portuguese": "por",
    "nl": "nld", "nld": "nld", "dut": "nld", "dutch": "nld",
    "pl": "pol", "pol": "pol", "polish": "pol",
    "ru": "rus", "rus": "rus", "russian": "rus",
    "zh": "zho", "zho": "zho", "chi": "zho", "chinese": "zho",
}
CODES = sorted(set(LANGUAGES.values()))


def language_code(label: Column) -> Column:
    """ISO 639-3 code that a label names, whatever its spelling; null for labels that name none of the languages."""
    base = F.split(F.lower(F.trim(label)), "[-_]")[0]
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, base)


def source_name(source: Column) -> Column:
    """Normal form of a source: trimmed, lower case, each run of other characters than letters and digits one ``_``."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[^\p{L}\p{N}]+", "_")

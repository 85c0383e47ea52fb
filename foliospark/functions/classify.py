"""Kinds of chunks, links and media types. Column expressions only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import bound, trimmed

# Signs and words by which a chunk is known.
MATH = "[∑∫√∂∏≤≥≠→←⊂⊃]"
LATEX = [r"\frac", r"\sum", r"\int", r"\sqrt", r"\alpha", r"\beta", r"\delta", "$$", r"\["]
SCHEDULE = ["schedule", "annex", "appendix", "exhibit"]
DEFINITION = ['" means ', '" shall mean ', '" has the meaning', "' means ", "' shall mean ", "means, for purposes", "is defined as", "shall be construed as"]
SIGNATURE = ["signature", "signed by", "witnessed by", "date:", "in witness whereof", "authorized signatory", "duly authorized", "____"]
OPERATIVE = [
    "shall ", "agree ", "agrees ", "transfer", "grant ", "grants ", "undertake", "obligat", "covenant", "warrant", "represent", "indemnif",
    "assign ", "assigns ", "license ", "licenses ", "purchase", "sell ", "sells ", "pay ", "pays ", "deliver",
]
ROLES = ["investor", "company", "borrower", "lender", "seller", "buyer", "party", "subscriber", "guarantor"]
#: Media type by file extension.
MIME_TYPES = {
    "txt": "text/plain", "md": "text/markdown", "markdown": "text/markdown", "html": "text/html", "htm": "text/html", "xml": "application/xml", "svg": "image/svg+xml",
    "json": "application/json", "jsonl": "application/x-ndjson", "ndjson": "application/x-ndjson", "yaml": "application/x-yaml", "yml": "application/x-yaml", "toml": "application/toml",
    "csv": "text/csv", "tsv": "text/tab-separated-values", "pdf": "application/pdf", "rtf": "application/rtf", "eml": "message/rfc822", "msg": "application/vnd.ms-outlook",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "odt": "application/vnd.oasis.opendocument.text", "ods": "application/vnd.oasis.opendocument.spreadsheet",
    "doc": "application/msword", "xls": "application/vnd.ms-excel", "ppt": "application/vnd.ms-powerpoint", "epub": "application/epub+zip", "fb2": "application/x-fictionbook+xml",
    "ipynb": "application/x-ipynb+json", "bib": "application/x-bibtex", "ris": "application/x-research-info-systems", "nbib": "application/x-pubmed", "opml": "text/x-opml", "tex": "application/x-latex",
    "rst": "text/x-rst", "org": "text/x-org", "zip": "application/zip", "tar": "application/x-tar", "gz": "application/gzip", "7z": "application/x-7z-compressed", "dbf": "application/x-dbf",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tiff": "image/tiff", "tif": "image/tiff", "webp": "image/webp",
}
#: First bytes of image files, in hexadecimal.
SIGNATURES = [("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("424D", "image/bmp"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"), ("0000000C6A502020", "image/jp2"), ("974A4232", "image/x-jbig2"), *[(f"50{n}0A", "image/x-portable-anymap") for n in range(31, 37)]]


def _any(c: Column, words: list[str]) -> Column:
    return reduce(or_, [c.contains(w) for w in words])


def _hits(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [c.contains(w).cast("int") for w in words])


def _lines(c: Column) -> Column:
    """Lines without their ends; a line end at the very end adds none."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(c, r"\r?\n$", ""), r"\r?\n"))


def chunk_type(content: Column, headings: Column | None = None) -> Column:
    """Kind of a chunk, by the first rule that holds: heading, code_block, table_like, formula, schedule, definitions,
    signature_block, operative_clause, party_list, unknown. ``headings``: the texts of the headings above it. Null stays null."""
    no_headings = F.array().cast("array<string>")
    columns = {"content": content, "text": trimmed(content), "headings": no_headings if headings is None else F.coalesce(headings, no_headings)}
    lines = {"raw": lambda r: _lines(r["content"]), "lines": lambda r: _lines(r["text"]), "low": lambda r: F.lower(r["text"])}
    inner = lambda r: bound(_kind, **{n: r[n] for n in columns}, **{n: f(r) for n, f in lines.items()})
    return F.when(content.isNotNull(), bound(inner, **columns))


def _kind(r: Column) -> Column:
    """The rules over content, text (trimmed), low (in lower case), lines, raw (lines of the content) and headings."""
    content, text, low, lines, raw = (r[n] for n in ("content", "text", "low", "lines", "raw"))
    underline = trimmed(F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")))
    heading = text.startswith("#") | underline.rlike("^(=+|-+)$")
    full = F.filter(raw, lambda x: trimmed(x) != "")
    code = content.startswith("```") | content.startswith("~~~") | ((F.size(raw) >= 2) & F.forall(full, lambda x: x.startswith("    ") | x.startswith("\t")))
    pipes = F.size(F.filter(lines, lambda x: x.contains("|")))
    rules = F.size(F.filter(lines, lambda x: trimmed(x).rlike(r"^[-+| ]{4,}$")))
    table = (F.size(lines) >= 2) & ((pipes >= 2) | (rules >= 3))
    formula = text.rlike(MATH) | _any(low, LATEX)
    first = F.lower(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")))
    schedule = reduce(or_, [first.startswith(k) for k in SCHEDULE])
    for k in SCHEDULE:  # the first mention, followed by a space and a letter or digit
        at = F.instr(low, k)
        schedule = schedule | ((at > 0) & F.substring(low, at + len(k), F.lit(64)).rlike(r"^[ ]\s*[\p{L}\p{N}]"))
    schedule = schedule | F.exists(r["headings"], lambda h: _any(F.lower(h), SCHEDULE))
    rows = F.filter(F.transform(lines, trimmed), lambda x: x != "")

    def party(x: Column) -> Column:
        return (F.octet_length(x) <= 120) & x.rlike(r"^\p{Lu}") & (x.rlike("[0-9]") | x.contains(",") | _any(F.lower(x), ROLES))

    parties = (F.size(rows) >= 3) & (F.size(F.filter(rows, party)) >= F.greatest(F.floor(F.size(rows) * 2 / 3), F.lit(2)))
    return (
        F.when(heading, "heading").when(code, "code_block").when(table, "table_like").when(formula, "formula").when(schedule, "schedule")
        .when(_any(low, DEFINITION), "definitions").when(_hits(low, SIGNATURE) >= 2, "signature_block").when(_hits(low, OPERATIVE) >= 3, "operative_clause")
        .when(parties, "party_list").otherwise("unknown")
    )


def uri_kind(uri: Column) -> Column:
    """email, anchor or hyperlink; null stays null."""
    return F.when(uri.isNull(), None).when(uri.startswith("mailto:"), "email").when(uri.startswith("#"), "anchor").otherwise("hyperlink")


def mime_of_path(path: Column) -> Column:
    """Media type of a file by its last extension, whatever its case; null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in MIME_TYPES.items() for x in kv])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)))


def image_format(content: Column) -> Column:
    """Media type of an image by its first bytes; null for anything else."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.startswith("52494646") & head.endswith("57454250"), "image/webp")
    for signature, mime in SIGNATURES:
        out = out.when(head.startswith(signature), mime)
    return out


def content_key(content: Column, mime: Column, config: str) -> Column:
    """Key of a cached result: hash of the content, and a short one of media type and configuration."""
    return F.concat_ws("_", F.sha2(content, 256), F.substring(F.sha2(F.concat(F.coalesce(mime, F.lit("")), F.lit(config)), 256), 1, 16))

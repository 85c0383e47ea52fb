"""Token budget: exact token counts of texts, totalled over a cube of source, domain, language and media type."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import bpe, labels
from foliospark.session import ship_package

#: Folder of the vocabulary files; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that cuts texts into pieces before the merges of the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MISSING = "(missing)"


def token_count(text: Column, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """Number of tokens of ``text``; null for null, 0 for the empty text. The vocabulary file of the driver is sent to every executor."""
    SparkSession.active().sparkContext.addFile(vocabulary)
    name = vocabulary.rstrip("/").rpartition("/")[2]

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = bpe.load(SparkFiles.get(name), pattern)
        for batch in batches:
            yield pd.Series([None if t is None else counter.count(t) for t in batch], dtype="Int64")

    return count(text)


def media_type(mime: Column) -> Column:
    """Media type without parameters, in lower case; null if nothing is left."""
    base = F.lower(F.trim(F.split(mime, ";")[0]))
    return F.when(base != "", base)


def record_tokens(extractions: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each extraction_id with its token count, language label and media type.

    Counts before it removes repeated rows, so that no text is shuffled. Null contents have 0 tokens; a null
    extraction_id is one record. Of rows that repeat an id, the one with the most tokens holds.
    """
    ship_package(extractions.sparkSession)
    e = extractions
    language = F.coalesce(labels.language_code(e["metadata"]["language"]), labels.language_code(F.try_element_at(e["detected_languages"], F.lit(1))))
    rows = e.select(
        e["extraction_id"], e["collection_id"], F.coalesce(token_count(e["content"], vocabulary), F.lit(0)).alias("n_tokens"),
        language.alias("language"), media_type(e["mime_type"]).alias("mime_type"),
    )
    best = F.max(F.struct("n_tokens", "collection_id", "language", "mime_type")).alias("r")
    return rows.groupBy("extraction_id").agg(best).select("extraction_id", "r.*")


def token_budget(extractions: DataFrame, collections: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Totals over the cube of source, domain, language and mime_type.

    A dimension that is totalled over is null and its bit in ``level`` is set; a missing value is the slice
    ``(missing)``. An empty input gives no rows. Repeated collection rows count once.
    """
    known = collections.groupBy("collection_id").agg(F.max(F.struct("source", "domain")).alias("c")).select("collection_id", "c.*")
    rows = record_tokens(extractions, vocabulary).join(known, "collection_id", "left")
    dims = [F.coalesce(F.col(c), F.lit(MISSING)).alias(c) for c in ("source", "domain", "language", "mime_type")]
    small = rows.groupBy(*dims).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"))  # the cube expands few rows
    return small.cube("source", "domain", "language", "mime_type").agg(
        F.grouping_id().alias("level"), F.sum("n").alias("n_records"), F.sum("t").alias("n_tokens")
    )

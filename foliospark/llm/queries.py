"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import languages, leakage, mixing, mojibake, neighbours, scans, shared_spans, splitting, sql, tokens
from foliospark.sources.tables import read_table as table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    """Name to query."""
    return {
        "p1_found": lambda s, d: languages.found(table(s, d, "extraction_results")),
        "p1_segments": lambda s, d: languages.language_segments(table(s, d, "extraction_results")),
        "p2_found": lambda s, d: splitting.found(table(s, d, "chunks"), table(s, d, "chunk_configs")),
        "p2_pieces": lambda s, d: splitting.oversized_pieces(table(s, d, "chunks"), table(s, d, "chunk_configs")),
        "p3_token_budget": lambda s, d: tokens.token_budget(table(s, d, "extraction_results"), table(s, d, "collections")),
        "p4_found": lambda s, d: scans.found(table(s, d, "extraction_results")),
        "p4_repaired": lambda s, d: scans.Scans(table(s, d, "extraction_results")).repaired(),
        "p5_found": lambda s, d: mojibake.found(table(s, d, "extraction_results")),
        "p5_repaired": lambda s, d: mojibake.Garbled(table(s, d, "extraction_results")).repaired(),
        "p7_found": lambda s, d: neighbours.found(table(s, d, "chunks")),
        "p7_most_similar": lambda s, d: neighbours.neighbours_of_every_20th(table(s, d, "chunks")),
        "p8_found": lambda s, d: leakage.found(table(s, d, "documents"), table(s, d, "eval_items")),
        "p8_removal_spans": lambda s, d: leakage.removal_spans(table(s, d, "documents"), table(s, d, "eval_items")),
        "p9_found": lambda s, d: mixing.found(table(s, d, "documents"), table(s, d, "mix_sources")),
        "p9_shares": lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_sources")).shares,
        "p10_found": lambda s, d: shared_spans.found(table(s, d, "documents")),
        "p10_spans": lambda s, d: shared_spans.SharedSpans(table(s, d, "documents")).spans().drop("class_id"),
        "p10_coverage": lambda s, d: shared_spans.SharedSpans(table(s, d, "documents")).coverage(),
        "p9_blocks": lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_sources")).blocks,
        "p9_planned_characters": lambda s, d: mixing.planned_in_characters(table(s, d, "documents"), table(s, d, "mix_sources")),
        "p9_chosen": lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_sources")).chosen,
    }


def oracle_sql() -> dict[str, str]:
    """Name to SQL."""
    return sql.oracle_sql()

"""The registered queries of the core."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.functions import classify, quality, reduction
from foliospark.functions import text as T
from foliospark.functions.stopwords import SHORT_CODES, stopwords
from foliospark.operators import chunking, elements, embeddings, evaluate, geometry, keywords, language, nested, render, tables
from foliospark.plans import pipeline
from foliospark.plans.sql import oracle_sql  # noqa: F401
from foliospark.sources import formats, html, structured
from foliospark.sources.tables import read_table, spread

Query = Callable[[SparkSession, str], DataFrame]


def _docs(s: SparkSession, d: str) -> DataFrame:
    return spread(read_table(s, d, "documents").select("doc_id", "text", "lang", "source", "mime_type", "n_chars"))


def _texts(s: SparkSession, d: str, **columns: Callable[[Column], Column]) -> DataFrame:
    """doc_id and expressions over the text of every document."""
    return _docs(s, d).select("doc_id", *[f(F.col("text")).alias(n) for n, f in columns.items()])


def _extractions(s: SparkSession, d: str) -> DataFrame:
    """Extractions, each id once."""
    e = read_table(s, d, "extraction_results")
    return e.groupBy("extraction_id").agg(F.max(F.struct("content", "file_path")).alias("e")).select("extraction_id", "e.*")  # one delivery, not parts of several


def _scanned(s: SparkSession, d: str) -> DataFrame:
    """Text of the scanned lines of each extraction, in reading order."""
    o = read_table(s, d, "ocr_elements")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("element_id", "text"))), lambda x: x["text"])
    return o.groupBy("extraction_id").agg(F.array_join(lines, "\n").alias("content"))


def _chunked(s: SparkSession, d: str) -> DataFrame:
    """The chunks of each extraction put together again, overlaps and all."""
    c = read_table(s, d, "chunks").select("extraction_id", "chunk_id", "content").distinct()
    lines = F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "content"))), lambda x: x["content"])
    return c.groupBy("extraction_id").agg(F.array_join(lines, "\n").alias("content"))


def _content_of_chunked(s: SparkSession, d: str) -> DataFrame:
    ids = read_table(s, d, "chunks").select("extraction_id").distinct()
    return _extractions(s, d).join(ids, "extraction_id", "left_semi")


def _tables(s: SparkSession, d: str) -> DataFrame:
    """The tables of the extractions, one row each."""
    e = read_table(s, d, "extraction_results").select("extraction_id", F.posexplode("tables").alias("no", "t"))
    return e.select(F.concat_ws("-", "extraction_id", "no").alias("table_id"), F.col("t.cells").alias("cells")).distinct()


def _pages(s: SparkSession, d: str) -> DataFrame:
    """Documents as HTML pages of three make-ups: quotes, order of attributes, case, references and tables differ."""
    kind = F.col("doc_id") % 3
    escape = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.concat(F.lit("<p>"), F.replace(escape(F.col("text")), F.lit("\n"), F.lit("</p>\n<p>")), F.lit("</p>"))
    lang, source, no = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")), F.col("doc_id").cast("string")
    page = F.when(
        kind == 0,
        F.concat(
            F.lit('<html lang="'), lang, F.lit('"><head><title>Document '), no, F.lit('</title><meta name="description" content="'), source, F.lit('"><script>var x = "<a href=no>";</script></head><body><nav><a href="/home">Home</a></nav><h1>Document</h1>'),
            body, F.lit('<ul><li>one<li>two</ul><p>See <a href="mailto:a@example.org">mail</a> and <a href="#top">top</a></body></html>'),
        ),
    ).when(
        kind == 1,
        F.concat(
            F.lit("<!DOCTYPE html>\n<HTML dir=ltr LANG='"), lang, F.lit("'><HEAD><META content='"), source, F.lit("' name='description'>\n<TITLE>R&amp;D &#8211; "), no, F.lit("</TITLE></HEAD><BODY><H2>Report</H2>"),
            body, F.lit("<p><a class=x href='/files/"), no, F.lit(".pdf?a=1&amp;b=2' title=\"a > b\">file</a></p></BODY></HTML>"),
        ),
    ).otherwise(
        F.concat(
            F.lit("<html><head><!-- <title>no</title> --><title>Table "), no, F.lit("</title></head><body><table><tr><th>key<th>value</tr><tr><td>source</td><td>"), escape(source), F.lit("</td></tr></table>"),
            body, F.lit("<a href=http://example.org/"), no, F.lit(">plain</a><a>none</a></body></html>"),
        ),
    )
    return _docs(s, d).select("doc_id", page.alias("html"))


def _parsed(s: SparkSession, d: str) -> DataFrame:
    return html.html_pages(_pages(s, d), "doc_id", "html")


def _page_heads(s: SparkSession, d: str) -> DataFrame:
    m = F.col("metadata")
    part = lambda k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(""))
    return _parsed(s, d).select(F.col("id").alias("doc_id"), part("title").alias("title"), part("description").alias("description"), part("language").alias("language"))


def _page_links(s: SparkSession, d: str) -> DataFrame:
    links = _parsed(s, d).select(F.col("id").alias("doc_id"), F.explode("links").alias("l"))
    return links.select("doc_id", "l.uri", "l.label", classify.uri_kind(F.col("l.uri")).alias("kind"))


def _page_tables(s: SparkSession, d: str) -> DataFrame:
    cells = _parsed(s, d).select(F.col("id").alias("doc_id"), F.explode("tables").alias("t")).select("doc_id", F.posexplode("t").alias("row_no", "row"))
    return cells.select("doc_id", "row_no", F.array_join("row", "|").alias("row"))


def _pooled(s: SparkSession, d: str) -> DataFrame:
    """Mean of the embeddings of every second chunk of each extraction."""
    c = read_table(s, d, "chunks").where("embedding IS NOT NULL").dropDuplicates(["chunk_id"]).select("extraction_id", "embedding", (F.col("chunk_id") % 2 == 0).cast("int").alias("m"))
    lists = c.groupBy("extraction_id").agg(F.collect_list(F.struct("embedding", "m")).alias("c"))
    pooled = embeddings.mean_pool(F.transform("c", lambda x: x["embedding"]), F.transform("c", lambda x: x["m"]))
    return lists.select("extraction_id", pooled.alias("v")).select("extraction_id", F.round(F.col("v")[0], 5).alias("first"), F.round(F.col("v")[63], 5).alias("last"))


def _pages_with_tables(s: SparkSession, d: str) -> DataFrame:
    t = read_table(s, d, "extraction_results").select(F.col("extraction_id").alias("id"), F.posexplode("tables").alias("no", "t"))
    items = t.select("id", F.col("t.page_number").alias("page_number"), F.col("no").alias("item")).distinct()
    pages = elements.document_pages(_extractions(s, d), "extraction_id", "content").select("id", "page_number")
    return geometry.attach_to_pages(pages, items).select("id", "page_number", F.size("items").alias("n_tables"))


def _json_texts(s: SparkSession, d: str) -> DataFrame:
    """Leaves and text fields of events as nested JSON."""
    v = F.struct("event_id", F.struct(F.col("event_type").alias("type"), F.col("value")).alias("info"), F.array(F.struct(F.col("user_id").cast("string").alias("label")), F.struct(F.lit(" ").alias("label"))).alias("users"))
    e = read_table(s, d, "events").select("event_id", F.to_json(v).alias("json"))
    return structured.json_texts(e, "event_id", "json")


def _scan_elements(s: SparkSession, d: str) -> DataFrame:
    """Scanned lines of each extraction as elements below a heading."""
    o = read_table(s, d, "ocr_elements").select("extraction_id", "element_id", "text").distinct()
    lines = F.transform(F.array_sort(F.collect_list(F.struct("element_id", "text"))), lambda x: F.struct(F.lit("paragraph").alias("kind"), F.lit(0).alias("level"), x["text"].alias("text")))
    head = F.struct(F.lit("heading").alias("kind"), F.lit(1).alias("level"), F.concat(F.lit("Scan "), F.col("extraction_id").cast("string")).alias("text"))
    return o.groupBy("extraction_id").agg(lines.alias("lines")).select("extraction_id", F.concat(F.array(head), "lines").alias("elements"))


def _boxes(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "ocr_elements").withColumn("box", geometry.box_of(F.col("geometry")))


def _tsv_words(s: SparkSession, d: str) -> DataFrame:
    """The scanned lines of each page written as OCR TSV and read again."""
    b = F.col("box")
    line = F.concat_ws("\t", F.lit("5"), "page_number", *[F.lit("1")] * 4, b["x0"].cast("int"), b["y0"].cast("int"), (b["x1"] - b["x0"]).cast("int"), (b["y1"] - b["y0"]).cast("int"), F.coalesce(F.col("confidence.recognition"), F.lit(-1.0)), F.regexp_replace("text", r"\s+", " "))
    pages = _boxes(s, d).where("box IS NOT NULL AND text IS NOT NULL").groupBy("extraction_id", "page_number").agg(F.array_join(F.sort_array(F.collect_set(line)), "\n").alias("tsv"))
    return pages.select("extraction_id", "page_number", F.explode(tables.words_of_tsv(F.col("tsv"))).alias("w")).select("extraction_id", "page_number", "w.*")


def _scan_grids(s: SparkSession, d: str) -> DataFrame:
    words = _tsv_words(s, d).groupBy("extraction_id", "page_number").agg(F.collect_list(F.struct("text", "left", "top", "width", "height")).alias("words"))
    return tables.rebuild_tables(words, ["extraction_id", "page_number"]).withColumn("cells", tables.table_gfm(F.col("cells")))


def _length_statistics(s: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    of = [F.round(F.percentile(n, F.lit(p)), 6).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)]
    return _docs(s, d).groupBy("mime_type").agg(F.count(n).alias("n"), *of, F.round(F.var_samp(n), 4).alias("variance"), F.round(F.stddev(n), 6).alias("deviation"))


def _lines_around(s: SparkSession, d: str) -> DataFrame:
    """Mean length of each scanned line with the two before and after it."""
    o = read_table(s, d, "ocr_elements").select("extraction_id", "element_id", "text").distinct()
    w = Window.partitionBy("extraction_id").orderBy("element_id").rowsBetween(-2, 2)
    return o.select("element_id", F.round(F.avg(F.length("text")).over(w), 6).alias("mean_length"), F.count("*").over(w).alias("n"))


def _inventory(s: SparkSession, d: str) -> DataFrame:
    """Texts of all tables in one."""
    of = {"documents": ("doc_id", "text"), "extraction_results": ("extraction_id", "content"), "chunks": ("chunk_id", "content"), "ocr_elements": ("element_id", "text"), "eval_items": ("item_id", "text")}
    parts = [read_table(s, d, t).select(F.lit(t).alias("kind"), F.col(i).alias("id"), F.col(c).alias("text")) for t, (i, c) in of.items()]
    return reduce(DataFrame.union, parts).distinct().groupBy("kind").agg(F.count("*").alias("n_rows"), F.sum(F.length("text")).alias("n_chars"))


def _unknown_collections(s: SparkSession, d: str) -> DataFrame:
    """Collections of documents and extractions alike (intersect) that are not listed (except)."""
    ids = lambda t: read_table(s, d, t).select("collection_id")
    return ids("documents").intersect(ids("extraction_results")).exceptAll(ids("collections").distinct())


def _stopword_ratio(s: SparkSession, d: str) -> DataFrame:
    """Share of English stop words among the words of each document."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    w = _docs(s, d).select("doc_id", F.explode(words).alias("w"))
    return w.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.round(F.avg(F.col("w").isin(stopwords("en")).cast("int")), 9).alias("ratio"))


def _chunk_pages(s: SparkSession, d: str) -> DataFrame:
    c = read_table(s, d, "chunks").select("chunk_id", F.col("extraction_id").alias("id"), "metadata.byte_start", "metadata.byte_end").distinct()
    p = elements.document_pages(_extractions(s, d), "extraction_id", "content")
    return chunking.chunk_pages(c.withColumnRenamed("chunk_id", "chunk_index"), p).withColumnRenamed("chunk_index", "chunk_id").withColumnRenamed("id", "extraction_id")


def _element_overlap(s: SparkSession, d: str) -> DataFrame:
    """How far each scanned line's box overlaps that of the line before on its page."""
    w = Window.partitionBy("extraction_id", "page_number").orderBy("element_id")
    rows = _boxes(s, d).select("element_id", "extraction_id", "page_number", "box").distinct().withColumn("before", F.lag("box").over(w)).where("before IS NOT NULL AND box IS NOT NULL")
    box, before = F.col("box"), F.col("before")
    return rows.select(
        "element_id", F.round(geometry.iou(box, before), 6).alias("iou"), F.round(geometry.weighted_distance(box, before), 6).alias("distance"), F.round(geometry.intersection_ratio(box, before), 6).alias("covered"),
        geometry.contains(before, box).alias("inside"), F.round(geometry.area(geometry.merged(box, before)), 6).alias("merged_area"),
    )


def _csv_texts(s: SparkSession, d: str) -> DataFrame:
    """Line items of each order as a CSV text."""
    li = read_table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    line = F.concat_ws(",", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "day")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("x")))), lambda x: x["x"])
    return li.groupBy("l_orderkey").agg(F.concat(F.lit("number,quantity,price,flag,day\n"), F.array_join(rows, "\n")).alias("text"))


def _language_accuracy(s: SparkSession, d: str) -> DataFrame:
    """How often the light detector names the language of the label, by label code; labels in other spellings have code null."""
    code = F.split(F.lower(F.trim("lang")), "[-_]")[0]
    names = F.create_map(*[F.lit(x) for long, short in SHORT_CODES.items() for x in (long, long, short, long)], *[F.lit(x) for x in ("rus", "rus", "ru", "rus", "zho", "zho", "zh", "zho")])
    found = _docs(s, d).select(F.try_element_at(names, code).alias("label"), F.try_element_at(language.detect_languages(F.col("text"), 0.8), F.lit(1)).alias("found"))
    return found.groupBy("label").agg(F.count("*").alias("n"), F.count("found").alias("n_detected"), F.sum((F.col("label") == F.col("found")).cast("int")).alias("n_right"))


#: key columns of the shredded tables
_KEYS = ["record_id", "parent_path", "item_no"]


def _shredded(s: SparkSession, d: str) -> nested.NestedTables:
    return nested.shred(read_table(s, d, "archive_records"))


def queries() -> dict[str, Query]:
    """Name to query."""
    full = pipeline.ExtractionConfig(language_detection=True, token_reduction="light", keywords=pipeline.KeywordConfig("rake"), chunking=chunking.ChunkConfig())
    return {
        "doc_stats": lambda s, d: T.doc_stats(_docs(s, d)),
        "text_stats": lambda s, d: _texts(s, d, n_lines=T.line_count, n_words=T.word_count, n_bytes=F.octet_length),
        "text_confidence": lambda s, d: _texts(s, d, confidence=lambda t: F.round(T.text_confidence(t), 6)),
        "fix_mojibake": lambda s, d: _texts(s, d, fixed=T.fix_mojibake),
        "normalize_spaces": lambda s, d: _texts(s, d, normal=T.normalize_spaces),
        "nfc_normalize": lambda s, d: _texts(s, d, normal=T.nfc),
        "blank_pages": lambda s, d: _texts(s, d, is_blank=T.is_blank_page).where("is_blank"),
        "char_entropy": lambda s, d: _texts(s, d, entropy=lambda t: F.round(T.char_entropy(t), 5)),
        "markdown_links": lambda s, d: _texts(s, d, n_headers=lambda t: F.size(T.markdown_headers(t)), n_links=lambda t: F.size(T.markdown_links(t)), n_code=lambda t: F.size(T.code_blocks(t))),
        "quality_components": lambda s, d: _texts(
            s, d, ocr_bytes=quality.ocr_bytes, navigation=lambda t: F.round(quality.navigation_penalty(t), 6), sentences=quality.sentence_count, paragraphs=quality.paragraph_count, structure=quality.structure_tenths
        ),
        "quality_score": lambda s, d: _texts(s, d, score=lambda t: F.round(quality.quality_score(t), 6)),
        "clean_text": lambda s, d: _texts(s, d, clean=quality.clean_text),
        "collapse_punctuation": lambda s, d: _texts(s, d, collapsed=quality.collapse_punctuation),
        "reduce_light": lambda s, d: _texts(s, d, reduced=reduction.light),
        "remove_stopwords": lambda s, d: _texts(s, d, reduced=reduction.remove_stopwords),
        "reduce_moderate": lambda s, d: _texts(s, d, reduced=lambda t: reduction.reduce_text(t, "moderate")),
        "reduce_aggressive": lambda s, d: _texts(s, d, reduced=lambda t: reduction.reduce_text(t, "aggressive")),
        "reduce_maximum": lambda s, d: _texts(s, d, reduced=lambda t: reduction.reduce_text(t, "maximum")),
        "mime_by_extension": lambda s, d: _extractions(s, d).select("extraction_id", classify.mime_of_path(F.col("file_path")).alias("mime")),
        "chunk_fixed_window": lambda s, d: chunking.fixed_windows(_docs(s, d), "doc_id", "text"),
        "chunk_semantic": lambda s, d: chunking.chunk(_docs(s, d), "doc_id", "text"),
        "chunk_markdown": lambda s, d: chunking.chunk(_docs(s, d), "doc_id", "text", chunking.ChunkConfig(kind="markdown")),
        "chunk_json_sections": lambda s, d: chunking.chunk(read_table(s, d, "events"), "event_id", "props", chunking.ChunkConfig(kind="yaml")).select("id", "chunk_index", "total_chunks", "content", "chunk_type"),
        "chunk_classify": lambda s, d: spread(read_table(s, d, "chunks").select("chunk_id", "content")).select("chunk_id", classify.chunk_type(F.col("content")).alias("kind")).distinct(),
        "chunk_page_overlap": _chunk_pages,
        "document_pages": lambda s, d: elements.document_pages(_extractions(s, d), "extraction_id", "content"),
        "keywords_rake": lambda s, d: keywords.rake_phrases(_docs(s, d), "doc_id", "text", F.col("lang")),
        "keywords_yake": lambda s, d: keywords.keywords(_docs(s, d), "doc_id", "text"),
        "language_detect": lambda s, d: _texts(s, d, language=lambda t: F.try_element_at(language.detect_languages(t), F.lit(1))),
        "language_accuracy": _language_accuracy,
        "list_items": lambda s, d: elements.list_items(_docs(s, d), "doc_id", "text"),
        "elements": lambda s, d: elements.elements(_docs(s, d), "doc_id", "text"),
        "html_title_meta": _page_heads,
        "html_links": _page_links,
        "html_tables": _page_tables,
        "html_elements": lambda s, d: html.html_elements(_pages(s, d), "doc_id", "html"),
        "html_to_markdown": lambda s, d: html.html_pages(_pages(s, d), "doc_id", "html").select("id", "markdown"),
        "json_text_fields": _json_texts,
        "table_markdown": lambda s, d: _tables(s, d).select("table_id", tables.table_markdown(F.col("cells")).alias("markdown")),
        "table_tsv": lambda s, d: _tables(s, d).select("table_id", tables.table_tsv(F.col("cells")).alias("tsv")),
        "cell_types": lambda s, d: tables.cell_types(_tables(s, d), "table_id", "cells"),
        "csv_profile": lambda s, d: tables.csv_profile(_csv_texts(s, d), "l_orderkey", "text").withColumn("types", F.array_join("types", " ")),
        "embedding_l2_normalize": lambda s, d: read_table(s, d, "embeddings").select(
            "vec_id", F.round(embeddings.l2_normalize(F.col("embedding"))[0], 5).alias("first"), F.round(embeddings.squared_norm(embeddings.l2_normalize(F.col("embedding"))), 5).alias("norm")
        ),
        "embedding_topk": lambda s, d: embeddings.top_k_of_queries(read_table(s, d, "embeddings"), "vec_id", "embedding"),
        "token_f1": lambda s, d: evaluate.token_f1(_chunked(s, d), _content_of_chunked(s, d), "extraction_id", "content").select(
            "id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "numeric_f1", "quality")]
        ),
        "token_difference": lambda s, d: evaluate.token_difference(_chunked(s, d), _content_of_chunked(s, d), "extraction_id", "content"),
        "pipeline_scores": lambda s, d: pipeline.run_pipeline(_docs(s, d), pipeline.ExtractionConfig(token_reduction="light")).select("id", "content", F.round("quality_score", 6).alias("score"), "reduced"),
        "pooled_embeddings": _pooled,
        "pages_with_tables": _pages_with_tables,
        "page_dpi": lambda s, d: _boxes(s, d).where("box IS NOT NULL").groupBy("extraction_id", "page_number").agg(geometry.dpi_for(F.max("box.x1"), F.max("box.y1")).alias("dpi")),
        "heading_context": lambda s, d: elements.heading_context(_extractions(s, d), "extraction_id", "content"),
        "nearest_band": lambda s, d: geometry.nearest_band(_boxes(s, d).select("extraction_id", "page_number", "element_id", "box").distinct(), ["extraction_id", "page_number"], "element_id", F.col("box.x0")),
        "box_suppression": lambda s, d: geometry.suppress_boxes(_boxes(s, d), ["extraction_id", "page_number"], "element_id", F.col("box"), F.col("confidence.recognition"), 0.3),
        "font_levels": lambda s, d: geometry.heading_levels_of(_boxes(s, d), "extraction_id", "element_id", F.col("box.y1") - F.col("box.y0"), F.col("text")),
        "extractor_choice": lambda s, d: formats.extractor_choice(read_table(s, d, "extraction_results"), "mime_type"),
        "length_statistics": _length_statistics,
        "lines_around": _lines_around,
        "text_inventory": _inventory,
        "unknown_collections": _unknown_collections,
        "stopword_ratio": _stopword_ratio,
        "whitespace_forms": lambda s, d: _texts(s, d, whitespace=T.normalize_whitespace, inline=T.normalize_inline, has_cjk=T.has_cjk, is_valid=T.valid_utf8),
        "key_case": lambda s, d: _docs(s, d).select("source").where("source IS NOT NULL").distinct().select("source", T.snake_to_camel(F.col("source")).alias("camel"), T.camel_to_snake(F.col("source")).alias("snake")),
        "table_gfm": lambda s, d: _tables(s, d).select("table_id", tables.table_gfm(F.col("cells")).alias("gfm")),
        "table_grid": lambda s, d: _tables(s, d).select("table_id", F.explode(tables.table_grid(F.col("cells"))).alias("c")).select("table_id", "c.row", "c.column", "c.text", "c.is_header"),
        "ocr_words": _tsv_words,
        "ocr_grids": _scan_grids,
        **{f"render_{f}": lambda s, d, f=f: _scan_elements(s, d).select("extraction_id", render.render(F.col("elements"), f).alias("text")) for f in ("plain", "markdown", "djot", "html", "json")},
        "exact_duplicates": lambda s, d: _docs(s, d).where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1"),
        "merge_paragraphs": lambda s, d: geometry.merge_paragraphs(read_table(s, d, "ocr_elements"), "extraction_id", "element_id", "text"),
        "element_overlap": _element_overlap,
        "corpus_cube": lambda s, d: _docs(s, d).cube("source", "mime_type").agg(F.grouping_id().alias("level"), F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars")),
        "pipeline_full": lambda s, d: pipeline.run_pipeline(_docs(s, d), full),
        "p6_found": lambda s, d: nested.found(spread(read_table(s, d, "archive_records").select("archive_id", "payload"))),
        "p6_variants": lambda s, d: nested.variant_counts(nested.shred(read_table(s, d, "archive_records"))),
        "p6_subtypes": lambda s, d: nested.shred(read_table(s, d, "archive_records")).subtypes(),
        "p6_results": lambda s, d: _shredded(s, d).results.select(
            *_KEYS, "content", "mime_type", "title", "language", "page_count", "page_unit", "format_type", F.array_join("authors", "; ").alias("authors"), "quality_score"
        ),
        "p6_entries": lambda s, d: _shredded(s, d).entries.select(*_KEYS, "path", "entry_path", "mime_type", "has_result"),
        "p6_chunks": lambda s, d: _shredded(s, d).chunks.select(
            *_KEYS, "content", "chunk_type", "byte_start", "byte_end", "token_count", "chunk_index", "total_chunks", F.array_join(F.transform("headings", lambda h: h["text"]), " > ").alias("headings")
        ),
        "p6_tables": lambda s, d: _shredded(s, d).tables.select(
            *_KEYS, F.array_join(F.transform("cells", lambda r: F.array_join(r, "|")), "/").alias("cells"), "markdown", "page_number", *[F.col(f"box.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")]
        ),
    }

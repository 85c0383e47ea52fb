from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.operators import chunking, elements, embeddings, evaluate, geometry, keywords, render, tables
from foliospark.operators.language import detect_languages


def docs(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \nc#é", max_size=300), st.integers(1, 60), st.integers(0, 59))
def test_semantic_slices_fit(text, size, overlap):
    if overlap >= size:
        return
    c = chunking.ChunkConfig(size, overlap, trim=False)
    slices = chunking.semantic_slices(text, c)
    assert all(0 < b - a <= size for a, b in slices)
    covered = set()
    for a, b in slices:
        covered |= set(range(a, b))
    assert covered == set(range(len(text)))


def test_chunks(spark):
    df = docs(spark, "# A\n\nOne sentence. Two sentences.\n\n## B\n\nMore text é here.", None, "", "   ")
    rows = chunking.chunk(df, "doc_id", "text", chunking.ChunkConfig(30, 0, kind="markdown")).collect()
    assert {r["id"] for r in rows} == {0} and [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert rows[-1]["headings"][-1]["text"] == "B" and all(r["byte_end"] > r["byte_start"] for r in rows)
    data = docs(spark, '{"oven": {"maker": "Brix", "watts": 940}, "shelf": {"label": "top"}}')
    assert [r["content"] for r in chunking.chunk(data, "doc_id", "text", chunking.ChunkConfig(kind="yaml")).collect()] == ["# oven > maker\n\nBrix", "# oven > watts\n\n940", "# shelf > label\n\ntop"]
    assert chunking.fixed_windows(docs(spark, "abcdefghij", ""), "doc_id", "text", 4, 2).orderBy("chunk_index").agg(F.collect_list("content")).first()[0] == ["abcd", "cdef", "efgh", "ghij"]
    try:
        chunking.ChunkConfig(10, 10)
        raise AssertionError
    except ValueError:
        pass


def test_pages(spark):
    df = docs(spark, "ab\fcdé\f")
    p = elements.document_pages(df, "doc_id", "text").orderBy("page_number").collect()
    assert [(r["byte_start"], r["byte_end"]) for r in p] == [(0, 2), (3, 7), (8, 8)]
    pages = F.array(*[F.struct(F.lit(a).alias("byte_start"), F.lit(b).alias("byte_end"), F.lit(n).alias("page_number")) for a, b, n in ((0, 11, 1), (11, 23, 2))])
    r = df.select(chunking.page_range(F.lit(5), F.lit(12), pages).alias("r"), chunking.valid_boundaries(pages).alias("ok"), elements.with_page_markers(F.array(F.lit("x"))).alias("m")).first()
    assert (r["r"]["first_page"], r["r"]["last_page"], r["ok"]) == (1, 2, True) and r["m"] == "\n\n<!-- PAGE 1 -->\n\nx"
    assert chunking.recompute_boundaries("one two three", ["one", "", "three", "gone"]) == [(0, 3, 1), (8, 13, 3)]


def test_keywords(spark):
    text = "Machine learning systems learn patterns from data. Deep machine learning needs much data. " * 2
    assert keywords.rake(text)[0][1] == 1.0
    got = keywords.yake(text)
    assert got[0][1] >= got[-1][1] and any("machine learning" in k for k, _ in got)
    p, r, f = keywords.relevance([k for k, _ in got], ["machine learning", "data"])
    assert p >= 0.3 and r >= 0.3 and f >= 0.3
    df = docs(spark, text, "too short", None)
    assert {x["id"] for x in keywords.rake_phrases(df, "doc_id", "text").collect()} == {0}
    assert {x["id"] for x in keywords.keywords(df, "doc_id", "text").collect()} == {0}


def test_language(spark):
    df = docs(spark, "The cat is on the table and it was not in the house.", "Der Hund ist nicht in dem Haus und er war auch nicht da.", "Это простой текст", None, "")
    assert [r[0] for r in df.orderBy("doc_id").select(detect_languages(F.col("text"))).collect()] == [["eng"], ["deu"], ["rus"], [], []]


def test_tables(spark):
    df = spark.createDataFrame([([["a", "b"], ["1", "2", "3"], ["4"]],), ([],), (None,)], "cells array<array<string>>")
    assert [r[0] for r in df.select(tables.table_markdown(F.col("cells"))).collect()] == ["| a | b |\n|------|------|\n| 1 | 2 |\n| 4 |  |\n", "", ""]
    assert df.select(tables.table_gfm(F.col("cells"))).first()[0].startswith("| a | b |  |\n| --- | --- | --- |")
    assert tables.sniff_delimiter("a;b\n1;2") == ";" and tables.parse_csv('a,b\n"x,y",2\n\n') == [["a", "b"], ["x,y", "2"]]
    rows = [["n", "d", "t"], ["1", "2024-01-02", "x"], ["2", "03/04/2024", "y"]]
    assert tables.has_header(rows) and tables.column_types(rows, True) == ["numeric", "date", "text"]
    words = [{"text": w, "left": x, "top": y, "width": 40, "height": 20} for w, x, y in (("A", 10, 10), ("B", 200, 12), ("1", 12, 50), ("2", 205, 52))]
    assert tables.rebuild_grid(words) == [["A", "B"], ["1", "2"]]
    tsv = spark.createDataFrame([("5\t1\t1\t1\t1\t1\t10\t20\t30\t40\t95.5\tlantern\n4\t1\t1\t1\t1\t0\t0\t0\t0\t0\t-1\t",)], "t string")
    assert tsv.select(tables.words_of_tsv(F.col("t"))).first()[0][0]["text"] == "lantern"


def test_evaluation(spark):
    a, b = docs(spark, "hello world foo", "", "x 007"), docs(spark, "hello world bar", None, "x 7")
    got = {r["id"]: r for r in evaluate.token_f1(a, b, "doc_id", "text").collect()}
    assert abs(got[0]["f1"] - 2 / 3) < 1e-9 and got[1]["f1"] == 1.0 and got[2]["quality"] == 1.0
    assert sorted((r["token"], r["side"]) for r in evaluate.token_difference(a, b, "doc_id", "text").collect()) == [("bar", "missing"), ("foo", "extra")]


def test_embeddings(spark):
    df = spark.createDataFrame([(0, [3.0, 4.0]), (20, [0.0, 0.0]), (1, [4.0, 3.0]), (2, None)], "id bigint, v array<float>")
    n = {r[0]: r[1] for r in df.select("id", embeddings.l2_normalize(F.col("v"))).collect()}
    assert abs(n[0][0] - 0.6) < 1e-6 and n[20] == [0.0, 0.0] and n[2] is None
    top = embeddings.top_k_of_queries(df, "id", "v").where("query_id = 0").orderBy("rank").collect()
    assert top[0]["neighbour_id"] == 1 and abs(top[0]["similarity"] - 0.96) < 1e-6
    assert len(df.select(embeddings.hash_embedding(F.lit("some words here"), 8)).first()[0]) == 8
    pooled = df.limit(1).select(embeddings.mean_pool(F.array(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(5.0), F.lit(5.0))), F.array(F.lit(1), F.lit(0)))).first()[0]
    assert pooled == [1.0, 3.0]


def test_geometry(spark):
    assert geometry.suppress([(0, 0, 10, 10), (1, 1, 10, 10), (50, 50, 60, 60)], [0.5, 0.9, 0.1]) == [1, 2]
    assert geometry.heading_levels([24, 12, 12, 18], [10, 500, 400, 20]) == [1, 0, 0, 2]
    assert geometry.column_breaks([0] * 12 + [300] * 12, [200] * 12 + [500] * 12, 600) == [250.0]
    df = spark.createDataFrame([(1, 1, "This is"), (1, 2, "one line."), (1, 3, "Next")], "d int, o int, t string")
    assert [r["text"] for r in geometry.merge_paragraphs(df, "d", "o", "t").orderBy("paragraph_no").collect()] == ["This is one line.", "Next"]


def test_elements_and_rendering(spark):
    text = "# A\n\npara one\n\n- x\n- y\n\n## B\n```\ncode\n```\nend"
    parts = elements.split_elements(text)
    assert [k for k, _, _ in parts] == ["heading", "paragraph", "list_item", "list_item", "heading", "code", "paragraph"]
    assert elements.parents(parts) == [None, 0, 0, 0, 0, 4, 4]
    assert render.markdown(parts) == "# A\n\npara one\n\n- x\n- y\n\n## B\n\n```\ncode\n```\n\nend\n"
    assert "<ul>\n<li>x</li>\n<li>y</li>\n</ul>" in render.to_html(parts) and '"title": "B"' in render.json_sections(parts)
    df = elements.elements(docs(spark, text, None, ""), "doc_id", "text")
    assert df.count() == 7 and df.where("element_id LIKE 'elem-%'").count() == 7
    assert elements.list_items(docs(spark, "- a\n12. b\nx. c\n    d\nplain"), "doc_id", "text").count() == 4
    assert render.annotate("bold it", [(0, 4, "bold"), (5, 7, "link:u")]) == "**bold** [it](u)"
    assert render.number_footnotes("a[^z] b[^q]\n[^q]: x\n[^z]: y") == "a[^1] b[^2]\n[^2]: x\n[^1]: y"
    assert render.toon({"a": 1, "rows": [{"x": 1, "y": "b"}, {"x": 2, "y": "c"}]}) == "a: 1\nrows[2]{x,y}:\n  1,b\n  2,c"


def test_rake_of_any_script(spark):
    df = spark.createDataFrame([(1, "Die geprüfte Meldung für den Bericht und die geprüfte Meldung ist gut", "de-AT"), (2, "важный отчёт, важный отчёт и новый список страниц для проверки всех таблиц", "rus"), (3, None, None)], "id bigint, text string, lang string")
    got = {(r["id"], r["keyword"]) for r in keywords.rake_phrases(df, "id", "text", F.col("lang")).collect()}
    assert (1, "geprüfte meldung") in got and (2, "важный отчёт") in got and not any("gepr" == k for _, k in got)


def test_exact_search_keeps_ties_and_small_ids(spark):
    rows = [(k, [1.0, 0.0]) for k in range(0, 9)] + [(20, [0.0, 1.0]), (21, [0.6, 0.8]), (22, None), (23, []), (None, [1.0, 0.0]), (24, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").repartition(3)
    got = {}
    for r in embeddings.top_k_of_queries(df, "id", "v", k=3).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["neighbour_id"], r["similarity"]))
    assert got == {0: [(1, 1.0), (2, 1.0), (3, 1.0)], 20: [(21, 0.8), (0, 0.0), (1, 0.0)]}
    assert embeddings.top_k_of_queries(df.limit(0), "id", "v").count() == 0


def test_boxes_suppression_and_levels(spark):
    kind = "struct<left: int, top: int, width: int, height: int, points: array<struct<x: int, y: int>>>"
    rows = [(1, 1, (0, 0, 10, 10, None), 0.9), (1, 2, (1, 1, 10, 10, None), 0.8), (1, 3, (None, None, None, None, [(20, 0), (30, 12), (25, -1), (22, 3)]), None), (1, 4, None, 1.0), (2, 5, (0, 0, 5, 5, None), 0.1)]
    df = spark.createDataFrame(rows, f"page int, id int, geometry {kind}, score double").withColumn("box", geometry.box_of(F.col("geometry")))
    assert tuple(df.where("id = 3").first()["box"]) == (20.0, -1.0, 30.0, 12.0)
    kept = geometry.suppress_boxes(df, ["page"], "id", F.col("box"), F.col("score"))
    assert sorted(r["id"] for r in kept.collect()) == [1, 3, 5]
    sizes = spark.createDataFrame([(1, 1, 24.0, "Head"), (1, 2, 10.0, "long text " * 9), (1, 3, 10.0, "more text"), (1, 4, None, "x"), (2, 1, 5.0, None)], "doc int, id int, size double, text string")
    levels = {(r["doc"], r["id"]): r["level"] for r in geometry.heading_levels_of(sizes, "doc", "id", F.col("size"), F.col("text")).collect()}
    assert levels == {(1, 1): 1, (1, 2): 0, (1, 3): 0, (2, 1): 0}
    bands = geometry.nearest_band(df, ["page"], "id", F.col("box.x0")).collect()
    assert {(r["id"], r["band"]) for r in bands} == {(1, 0.0), (2, 0.0), (3, 0.0), (5, 0.0)}


def test_chunks_by_words_and_data_format(spark):
    text = "One two three. Four five six seven. Eight nine ten eleven twelve."
    c = chunking.ChunkConfig(6, 1, sizing="words")
    got = [text[a:b] for a, b in chunking.semantic_slices(text, c)]
    assert all(len(g.split()) <= 6 for g in got) and got[0] == "One two three. Four five six" or got[0].endswith(".")
    words = {w for g in got for w in g.split()}
    assert words == set(text.split()) and chunking.semantic_slices("", c) == []
    df = spark.createDataFrame([(1, '{"a": {"b": 1}}', "JSON"), (2, '{"a": {"b": 1}}', None)], "id bigint, text string, f string")
    rows = {r["id"]: r["content"] for r in chunking.chunk(df, "id", "text", data_format=F.col("f")).collect()}
    assert rows == {1: "# a > b\n\n1", 2: '{"a": {"b": 1}}'}


def test_heading_context_closes_lower_levels(spark):
    text = "intro\n# A\nx\n## B\ny\n```\n# no\n```\n# C\nz\r\n#tag"
    got = {r["line_no"]: r["context"] for r in elements.heading_context(docs(spark, text, None, ""), "doc_id", "text").collect()}
    assert got == {2: "A", 3: "A", 4: "A > B", 5: "A > B", 6: "A > B", 7: "A > B", 8: "A > B", 9: "C", 10: "C", 11: "C"}

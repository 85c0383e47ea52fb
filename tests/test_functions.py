from pyspark.sql import functions as F

from foliospark.functions import classify, quality, reduction
from foliospark.functions import text as T


def values(spark, texts, **columns):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    out = df.select("k", *[c.alias(n) for n, c in columns.items()]).orderBy("k").collect()
    return [r[1] if len(columns) == 1 else tuple(r[1:]) for r in out]


def test_counts(spark):
    assert values(spark, [None, "", "a b\nc\n", " x "], lines=T.line_count(F.col("t")), words=T.word_count(F.col("t"))) == [(None, None), (0, 0), (2, 3), (1, 1)]


def test_repairs(spark):
    assert values(spark, ["a\x01b��c", None], x=T.fix_mojibake(F.col("t"))) == ["abc", None]
    assert values(spark, ["é", None, "abc"], x=T.nfc(F.col("t"))) == ["é", None, "abc"]
    assert values(spark, [" a  b \n\n\n c", None, ""], x=T.normalize_spaces(F.col("t"))) == ["a b\n\nc", None, ""]
    assert values(spark, ["a b", "ab", None], x=T.is_blank_page(F.col("t"))) == [True, True, None]
    assert values(spark, ["mime_type", "x"], x=T.snake_to_camel(F.col("t"))) == ["mimeType", "x"]
    assert values(spark, ["mimeType"], x=T.camel_to_snake(F.col("t"))) == ["mime_type"]


def test_markdown_parts(spark):
    text = "# A\n```py\n# no\n```\n##B\n[x](y)"
    assert values(spark, [text], x=T.markdown_headers(F.col("t"))) == [["A", "B"]]
    assert values(spark, [text], x=T.markdown_links(F.col("t")))[0][0].asDict() == {"label": "x", "target": "y"}
    assert values(spark, [text], x=T.code_blocks(F.col("t")))[0][0].asDict() == {"language": "py", "code": "# no\n"}


def test_quality(spark):
    script = "Text. " * 200 + "<script>var a;</script>"
    got = values(spark, ["", "short", None, "A good line of text here. Another one follows it.", script], x=quality.quality_score(F.col("t")))
    assert got[:3] == [0.0, 0.1, 0.0] and got[3] == 1.0
    assert values(spark, [script], x=quality.script_penalty(F.col("t")))[0] > 0
    assert values(spark, ["a  b  c", "x ---- y\n|---|\n"], x=quality.clean_text(F.col("t"))) == ["abc", "x ... y\n|---|"]
    m = F.create_map(F.lit("title"), F.lit("x"))
    assert values(spark, ["x"], x=quality.metadata_bonus(m)) == [0.2]


def test_chunk_kinds(spark):
    cases = {
        "# Title": "heading", "Title\n====": "heading", "```\ncode": "code_block", "    a\n    b": "code_block", "a | b\nc | d": "table_like", "x ≤ y": "formula",
        "Annex A: list": "schedule", '"Fee" means the sum': "definitions", "Signed by X\nDate: now": "signature_block",
        "The seller shall deliver and pay the fee": "operative_clause", "Acme, Inc\nBolt, Ltd\nCore 5": "party_list", "plain words": "unknown", "": "unknown",
    }
    assert values(spark, [*cases, None], x=classify.chunk_type(F.col("t"))) == [*cases.values(), None]
    assert values(spark, ["words"], x=classify.chunk_type(F.col("t"), F.array(F.lit("Schedule 2")))) == ["schedule"]


def test_types_of_files_and_links(spark):
    assert values(spark, ["a/b.TAR.Gz", "x", "a.unknown", None], x=classify.mime_of_path(F.col("t"))) == ["application/gzip", None, None, None]
    assert values(spark, ["mailto:a", "#b", "c", None], x=classify.uri_kind(F.col("t"))) == ["email", "anchor", "hyperlink", None]
    png = spark.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\n....."),), (bytearray(b"RIFF1234WEBP"),), (bytearray(b"no"),)], "c binary")
    assert [r[0] for r in png.select(classify.image_format(F.col("c"))).collect()] == ["image/png", "image/webp", None]


def test_reduction(spark):
    text = "The quick brown fox is jumping over the lazy dog with API v2"
    assert values(spark, [text, None, ""], x=reduction.reduce_text(F.col("t"), "moderate")) == ["quick brown fox jumping lazy dog API v2", None, ""]
    assert values(spark, ["Wait!!! <!-- x --> what??"], x=reduction.reduce_text(F.col("t"), "light")) == ["Wait! what?"]
    assert reduction.level_of("nonsense") == "moderate"
    assert values(spark, ["use `the code` of the thing"], x=reduction.reduce_text(F.col("t"), "moderate")) == ["use `the code` thing"]
    long = "One idea stands here. " * 3 + "The ANALYSIS of 42 models shows improvement. Nothing else matters much. " * 3
    for level in ("aggressive", "maximum"):
        out = values(spark, [long], x=reduction.reduce_text(F.col("t"), level))[0]
        assert 0 < len(out) < len(long)
    assert reduction.select_sentences("One. Two.") == "One. Two."
    assert reduction.tokens("中文字 ab") == ["中文", "字", "ab"]

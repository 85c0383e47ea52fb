import json

from hypothesis import given
from hypothesis import strategies as st

from foliospark.operators import nested

PAYLOAD = {
    "content": "root", "mimeType": "application/zip", "metadata": {"title": "T", "pages": {"totalCount": "7"}},
    "tables": {"cells": [["a", 1], ["b"]], "page_number": "3", "boundingBox": {"x0": "1.5"}},
    "chunks": [{"content": "c0", "metadata": {"byte_start": 0, "heading_context": {"headings": [{"level": 1, "text": "H"}]}}}, None, {"content": "c1"}],
    "children": [
        {"path": "a.txt", "mime_type": "text/plain", "result": None},
        {"path": "b.zip", "result": json.dumps({"content": "in", "children": {"path": "d", "result": {"chunks": [{"content": "deep"}]}}})},
        "no object",
    ],
}


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_found_and_typed_tables(spark):
    text = json.dumps(PAYLOAD)
    df = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (2, None, "z"), (3, text[:50], "z"), (4, "[1, 2]", "z"), (None, '{"tables": []}', "z"), (5, "", "z")], "archive_id bigint, payload string, kind string")
    got = rows(nested.found(df))
    assert got == [
        (1, "chunk", "", 0), (1, "chunk", "", 1), (1, "chunk", "1/0", 0), (1, "entry", "", 0), (1, "entry", "", 1), (1, "entry", "1", 0), (1, "table", "", 0),
    ]
    t = nested.shred(df, staged=True)
    assert t.results.where("record_id = 1 AND path = ''").first()["page_count"] == 7
    table = t.tables.first()
    assert table["cells"] == [["a", "1"], ["b"]] and table["page_number"] == 3 and table["box"]["x0"] == 1.5
    assert t.chunks.where("path = '0'").first()["headings"][0]["text"] == "H"
    assert [r["has_result"] for r in t.entries.orderBy("path").collect()] == [False, True, True]
    assert t.results.where("record_id IS NULL").count() == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "archive_id bigint, payload string, record_id string")
    assert nested.found(df).collect() == []


def test_automaton_ignores_missing_and_null_members():
    a = nested.object_state("chunk", {"content": "x", "metadata": None}, {})
    assert a == nested.object_state("chunk", {"content": "y"}, {}) == "chunk(content:s)"


def test_deep_nesting_does_not_crash():
    deep = {"content": "x"}
    for _ in range(200):
        deep = {"children": [{"result": deep}]}
    assert len(nested.shred_payload(json.dumps(deep))) == 401
    assert nested.shred_payload('{"a":' * 100_000) == []


def test_states_carry_those_of_children():
    """An entry with a bare result and one with a full result are different variants of one subtype."""
    bare = {"children": [{"path": "a", "result": {"metadata": {"title": "x"}}}]}
    full = {"children": [{"path": "a", "result": {"metadata": {"title": "x"}, "tables": [{}], "chunks": [{}], "children": [{}]}}]}
    one, other = ([r for r in nested.shred_payload(json.dumps(p)) if r["kind"] in ("entry", "result") and r["parent_path"] == ""] for p in (bare, full))
    assert [r["subtype"] for r in one] == [r["subtype"] for r in other]
    assert all(a["variant"] != b["variant"] for a, b in zip(one, other, strict=True))
    again = nested.shred_payload(json.dumps({"children": bare["children"][0] | {"mimeType": None}}))
    assert [r["variant"] for r in again if r["path"] == ""] == [r["variant"] for r in one if r["kind"] == "result"]


def brute_state(value):
    if isinstance(value, dict):
        return nested._short("{" + ",".join(f"{k}:{brute_state(v)}" for k, v in sorted(value.items()) if v is not None) + "}")
    if isinstance(value, list):
        return nested._short("[" + "|".join(sorted({brute_state(v) for v in value})) + "]")
    return {type(None): "0", bool: "b", int: "n", float: "n", str: "s"}[type(value)]


@given(st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.text(max_size=2)), lambda x: st.one_of(st.lists(x, max_size=4), st.dictionaries(st.sampled_from("abcd"), x, max_size=4)), max_leaves=30))
def test_inner_states(value):
    assert nested.inner_state(value) == brute_state(value)


def test_subtype_tables_and_extra_members(spark, tmp_path):
    payload = {
        "content": "c", "quality_score": "0.5", "detectedLanguages": ["eng"], "processing_warnings": [{"source": "s"}], "metadata": {"title": "t", "additional": {"k": 1}},
        "chunks": [{"content": "a", "embedding": [1, 2.5], "score": 7}, {"content": "b"}],
    }
    t = nested.shred(spark.createDataFrame([(1, json.dumps(payload))], "archive_id bigint, payload string"))
    root = t.results.first()
    assert root["quality_score"] == 0.5 and root["detected_languages"] == ["eng"] and root["extra"] == {"processingwarnings": '[{"source": "s"}]', "metadata.additional": '{"k": 1}'}
    kinds = {r["subtype"]: r["n_rows"] for r in t.subtypes().where("kind = 'chunk'").collect()}
    assert kinds == {"chunk(content:s,embedding:[n],score:n)": 1, "chunk(content:s)": 1}
    typed = t.subtype_table("chunk(content:s,embedding:[n],score:n)")
    assert typed.columns == [*nested.KEYS, "content", "embedding", "score"] and typed.first()["embedding"] == [1.0, 2.5] and typed.first()["score"] == "7"
    assert t.subtype_table("chunk(content:s)").columns == [*nested.KEYS, "content"]
    t.write(f"{tmp_path}/out")
    assert {r["table"] for r in t.subtypes().collect()} == {p.name.partition("=")[2] for p in tmp_path.glob("out/kind=*/table=*")}

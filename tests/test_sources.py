import io
import json
import tarfile
import zipfile

import pytest

from foliospark.sources import formats, html, structured


def read(data, mime):
    return formats.extract_bytes(data if isinstance(data, bytes) else data.encode(), mime)


def packed(**files):
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/"), text)
    return f.getvalue()


PAGE = """<html lang="en"><head><title>T &amp; x</title><meta name="description" content="d"><script>no()</script></head>
<body><nav>menu</nav><h1>Head</h1><p>One <b>two<p>Three<ul><li>a<li>b</ul><table><tr><th>x<th>y</tr><tr><td>1<td>2</table><a href="/l">link</a><img src="i.png" alt="pic"></body></html>"""


def test_html():
    p = html.parse(PAGE)
    assert p.meta == {"language": "en", "title": "T & x", "description": "d"} and p.links == [("/l", "link")] and p.images == [("i.png", "pic")]
    kinds = [k for k, _, _ in p.elements]
    assert kinds[:5] == ["heading", "paragraph", "paragraph", "list_item", "list_item"] and "no()" not in html.to_markdown(p) and "menu" not in html.to_markdown(p)
    assert "- a\n- b" in html.to_markdown(p)


def test_structured():
    lines, fields = structured.extract({"title": "T", "a": {"b": [1, {"name": "n"}]}, "z": None})
    assert lines == "title: T\na.b[0]: 1\na.b[1].name: n" and fields == [("title", "T"), ("a.b[1].name", "n")]
    assert structured.schema_sketch({"a": [1]})["properties"]["a"] == {"type": "array", "length": 1, "items": {"type": "number"}}
    with pytest.raises(ValueError, match="line 3"):
        structured.json_lines('{"a": 1}\n\nbad')
    outline, n, names = structured.xml_outline('<root xmlns="u"><item k="v">blue</item><item>green</item></root>')
    assert n == 3 and names == ["item", "root"] and outline == "root\n  item (k: v)\n    blue\n\n  item\n    green"
    meta, rest = structured.front_matter("---\ntitle: X\n---\nbody")
    assert meta == {"title": "X"} and rest == "body" and structured.title_of({}, "# H\n") == "H"


@pytest.mark.parametrize(
    ("mime", "data", "part"),
    [
        ("text/plain; charset=utf-8", "abc", "abc"), ("text/markdown", "---\ntitle: T\n---\n# H", "# H"), ("application/json", '{"title": "T"}', '"title": "T"'), ("application/x-yaml", "a: 1", "a: 1"),
        ("application/toml", 'a = "x"', "a: x"), ("text/csv", "Tree,Height\nelm,30", "Tree\tHeight"), ("application/xml", "<a>t</a>", "t"), ("application/rtf", r"{\rtf1{\fonttbl x}Hello\par W\'f6rld}", "Hello\nWörld"),
        ("application/x-latex", r"\title{T}\begin{document}\section{S}\textbf{b} \begin{tabular}{ll}a & b\\c & d\end{tabular}\end{document}", "# S"), ("text/x-org", "#+TITLE: T\n* H\ntext", "# H"),
        ("text/x-rst", "Title\n=====\n\nx", "# Title"), ("application/x-bibtex", "@book{k,\n author = {A B and C D},\n year = {1999}\n}", "author: A B; C D"),
        ("application/x-research-info-systems", "TY  - BOOK\nTI  - T\nER  - \n", "TI: T"), ("text/x-opml", "<opml><head><title>T</title></head><body><outline text='a'><outline text='b'/></outline></body></opml>", "- a\n  - b"),
        ("application/x-ipynb+json", json.dumps({"cells": [{"cell_type": "markdown", "source": ["# N"]}, {"cell_type": "code", "source": "1", "outputs": [{"text": "out"}]}]}), "out"),
        ("application/x-jats+xml", "<article><front><article-title>T</article-title></front><body><sec><title>S</title><p>P</p></sec></body></article>", "P"),
        ("text/x-typst", "= H\n#set page()\nx", "# H"), ("text/mdx", "import x\n# H\n<B a>t</B>", "# H"),
    ],
)
def test_text_formats(mime, data, part):
    assert part in read(data, mime).content


def test_packed_formats():
    w = 'xmlns:w="w"'
    data = packed(**{"word__document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>H</w:t></w:r></w:p><w:p><w:r><w:t>text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>', "docProps__core.xml": "<p><creator>Me</creator></p>"})
    out = read(data, "application/vnd.openxmlformats-officedocument.wordprocessingml.document")
    assert out.content == "# H\n\ntext\n\nc" and out.metadata["created_by"] == "Me" and out.tables == [[["c"]]]
    data = packed(**{"xl__workbook.xml": '<w><sheets><sheet name="S"/></sheets></w>', "xl__sharedStrings.xml": "<s><si><t>a</t></si></s>", "xl__worksheets__sheet1.xml": '<w><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></sheetData></w>'})
    assert read(data, "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet").tables == [[["a", "", "5"]]]
    data = packed(**{"ppt__slides__slide1.xml": '<p xmlns:a="a"><a:p><a:r><a:t>Hi</a:t></a:r></a:p></p>'})
    assert "Hi" in read(data, "application/vnd.openxmlformats-officedocument.presentationml.presentation").content
    data = packed(**{"content.xml": '<d xmlns:t="t"><t:h t:outline-level="2">H</t:h><t:p>x</t:p></d>'})
    assert read(data, "application/vnd.oasis.opendocument.text").content == "## H\n\nx"
    data = packed(**{"META-INF__container.xml": '<c><rootfile full-path="o/p.opf"/></c>', "o__p.opf": '<p><metadata><title>B</title></metadata><manifest><item id="i" href="a.html"/></manifest><spine><itemref idref="i"/></spine></p>', "o__a.html": "<p>page</p>"})
    assert read(data, "application/epub+zip").content == "page"
    f = io.BytesIO()
    with tarfile.open(fileobj=f, mode="w") as t:
        info = tarfile.TarInfo("x.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
    assert read(f.getvalue(), "application/x-tar").children == [("x.txt", b"hi")]
    with pytest.raises(formats.ExtractionError):
        read(b"no zip", "application/zip")
    with pytest.raises(formats.ExtractionError):
        read(packed(**{"big.txt": "0" * 20_000_000}), "application/zip")


def test_email_and_helpers():
    out = read("From: a@x\nTo: b@y\nSubject: Hi\nContent-Type: text/html\n\n<p>Body</p>", "message/rfc822")
    assert out.content == "From: a@x\nTo: b@y\nSubject: Hi\n\nBody" and out.metadata["subject"] == "Hi"
    assert formats.data_uri("data:text/plain;base64,aGk=") == ("text/plain", b"hi") and formats.data_uri("http://x") is None
    assert formats.resolve_path("/a/b/doc.md", "../i.png") == "/a/i.png"
    assert formats.decode("é".encode("cp1252")) == "é" and formats.decode(b"\xef\xbb\xbfx") == "x"
    with pytest.raises(formats.ExtractionError):
        formats.extractor_for("application/unknown")


def test_image_headers():
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (640).to_bytes(4) + (480).to_bytes(4) + b"\x08\x02"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x10\x00\x20\x03"
    tiff = b"II*\0\x08\0\0\0\x02\0" + b"\0\x01\x03\0\x01\0\0\0\x07\0\0\0" + b"\x01\x01\x04\0\x01\0\0\0\x09\0\0\0"
    cases = [(png, "png", "640", "480"), (b"GIF89a\x05\0\x06\0", "gif", "5", "6"), (jpeg, "jpeg", "32", "16"), (tiff, "tiff", "7", "9"), (b"P5 # note\n12 34\n255\n", "pnm", "12", "34"), (b"BM" + b"\0" * 16 + (3).to_bytes(4, "little") + (-4).to_bytes(4, "little", signed=True), "bmp", "3", "4")]
    for data, kind, w, h in cases:
        m = formats.extract_bytes(data, "image/png").metadata
        assert (m["format"], m["width"], m["height"]) == (kind, w, h)
    for bad in (b"", b"text", b"\xff\xd8", b"\x89PNG\r\n\x1a\n", b"II*\0\xff\xff\xff\x7f"):
        try:
            formats.extract_bytes(bad, "image/jpeg")
        except formats.ExtractionError:
            pass


def test_likeliest_encoding():
    texts = {"cp1251": "Проверка документа показала новые данные", "shift_jis": "これはテストです。日本語の文章", "cp1252": "Les données résumées à l'été, déjà vérifiées", "gb18030": "这是一个测试文件，内容完整", "euc-kr": "이것은 시험 문서입니다"}
    got = {name: formats.decode(t.encode(name)) for name, t in texts.items()}
    assert got["cp1251"] == texts["cp1251"] and got["cp1252"] == texts["cp1252"] and got["shift_jis"] == texts["shift_jis"]
    assert formats.decode(b"\xff\xfeh\0i\0") == "hi" and formats.decode("é".encode("latin-1"), "latin-1") == "é" and formats.decode(b"") == ""


def test_extractor_choice(spark):
    df = spark.createDataFrame([("text/csv; charset=x", 1), ("TEXT/unknown", 2), ("image/png", 3), ("video/mp4", 4), (None, 5)], "mime string, pattern int")
    got = {r["mime_type"]: r["pattern"] for r in formats.extractor_choice(df, "mime").collect()}
    assert got == {"text/csv": "text/csv", "text/unknown": "text/*", "image/png": "image/*", "video/mp4": None}


def test_json_texts(spark):
    df = spark.createDataFrame([(1, '{"title": "T", "n": [1, null, {"body": "x"}], "blank": " "}'), (2, "{bad"), (3, None)], "id bigint, json string")
    got = {r["id"]: (r["content"], r["fields"]) for r in structured.json_texts(df, "id", "json").collect()}
    assert got == {1: ("title: T\nn[0]: 1\nn[2].body: x", "title: T\nn[2].body: x"), 2: (None, None), 3: (None, None)}

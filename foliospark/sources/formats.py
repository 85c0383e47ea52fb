"""Extractors of file formats: bytes to text, tables and metadata, one function for each media type."""

from __future__ import annotations

import base64
import csv
import email
import email.policy
import gzip
import io
import json
import re
import struct
import tarfile
import unicodedata
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.sources import html as html_source
from foliospark.sources import structured

#: Limits against hostile archives: entries, unpacked bytes, ratio, depth.
MAX_ENTRIES, MAX_BYTES, MAX_RATIO, MAX_DEPTH = 10_000, 500_000_000, 100, 5


class ExtractionError(ValueError):
    """A file that cannot be read, or may not be."""


@dataclass
class Extracted:
    """What an extractor gives."""

    content: str
    metadata: dict[str, str] = field(default_factory=dict)
    tables: list[list[list[str]]] = field(default_factory=list)
    children: list[tuple[str, bytes]] = field(default_factory=list)


def decode(data: bytes, label: str | None = None) -> str:
    """Text of bytes: the stated encoding, a byte order mark, UTF-8, then the likeliest of FALLBACKS; BOM dropped."""
    for name in filter(None, (label, "utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else None, "utf-8-sig")):
        try:
            return data.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    scored = [(confidence(t), -k, t) for k, name in enumerate(FALLBACKS) if (t := _try(data, name)) is not None]
    good = [x for x in scored if x[0] > 0.5]
    return max(good)[2] if good else data.decode("cp1252", "replace")


#: Encodings that are tried in this order where bytes are no UTF-8; equal confidence goes to the earlier.
FALLBACKS = ["cp1252", "cp1250", "cp1251", "koi8-r", "shift_jis", "euc-kr", "gb18030", "big5"]
_SCRIPTS = [re.compile(p) for p in ("[A-Za-z\u00c0-\u024f]", "[\u0400-\u04ff]", "[\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7af\uff00-\uffef]")]
_ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f\ufffd]|[^\\W\\d_][\u00a1-\u00bf\u00d7\u00f7]+[^\\W\\d_]|[a-zа-я][A-ZА-Я]|(?i:[a-z][а-я]|[а-я][a-z])|[A-Za-z][\u4e00-\u9fff]")


_HEAPED = re.compile("[\u00c0-\u024f]{3,}")


def _try(data: bytes, name: str) -> str | None:
    try:
        return data.decode(name)
    except UnicodeDecodeError:
        return None


def confidence(text: str) -> float:
    """How well a decoded text holds together, 0 to 1: letters of one script beyond ASCII, few signs inside words."""
    beyond = [c for c in text if c > "\x7f"]
    if not beyond:
        return 1.0
    joined = "".join(beyond)
    most = max(len(p.findall(joined)) for p in _SCRIPTS) / len(beyond)
    heaped = sum(map(len, _HEAPED.findall(text)))  # Latin words are not made of accented letters
    return max(0.0, most - (len(_ODD.findall(text)) + heaped) / len(beyond))


def _text(data: bytes) -> Extracted:
    return Extracted(decode(data))


def _markdown(data: bytes) -> Extracted:
    meta, text = structured.front_matter(decode(data))
    title = structured.title_of(meta, text)
    flat = {k: v if isinstance(v, str) else json.dumps(v, default=str, ensure_ascii=False) for k, v in meta.items()}
    return Extracted(text, flat | ({"title": title} if title else {}))


def _html(data: bytes) -> Extracted:
    page = html_source.parse(decode(data))
    return Extracted(html_source.to_markdown(page), dict(page.meta), page.tables)


def _data(kind: str) -> Callable[[bytes], Extracted]:
    def run(data: bytes) -> Extracted:
        value = structured.parse_data(decode(data), kind)
        lines, fields = structured.extract(value)
        pretty = json.dumps(value, ensure_ascii=False, indent=2, default=str) if kind in ("json", "jsonl") else lines
        return Extracted(pretty, {k: v for k, v in fields})

    return run


def _csv(delimiter: str | None) -> Callable[[bytes], Extracted]:
    def run(data: bytes) -> Extracted:
        from foliospark.operators.tables import column_types, has_header, parse_csv, sniff_delimiter

        text = decode(data)
        d = delimiter or sniff_delimiter(text)
        rows = parse_csv(text, d)
        header = has_header(rows)
        return Extracted("\n".join("\t".join(r) for r in rows), {"delimiter": d, "row_count": str(len(rows)), "has_header": str(header).lower(), "column_types": ",".join(column_types(rows, header))}, [rows] if rows else [])

    return run


def _xml(data: bytes) -> Extracted:
    outline, n, names = structured.xml_outline(data)
    return Extracted(outline, {"element_count": str(n), "unique_elements": ",".join(names)})


def _svg(data: bytes) -> Extracted:
    return Extracted(structured.xml_outline(data, text_only=True)[0])


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _tree(data: bytes) -> ElementTree.Element:
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise ExtractionError(f"XML: {e}") from e


def _joined(e: ElementTree.Element) -> str:
    return " ".join("".join(e.itertext()).split())


def _document_xml(data: bytes) -> Extracted:
    """JATS, DocBook and FictionBook: titles as headings by depth, paragraphs, list items, tables, metadata."""
    out, meta, tables = [], {}, []

    def walk(e: ElementTree.Element, depth: int) -> None:
        name = _local(e.tag)
        if name in ("article-title", "book-title") or (name == "title" and depth <= 1):
            meta.setdefault("title", _joined(e))
        if name in ("title", "article-title"):
            out.append(f"{'#' * max(1, min(6, depth))} {_joined(e)}")
        elif name in ("p", "para", "simpara", "v"):
            out.append(_joined(e))
        elif name in ("listitem", "list-item"):
            out.append(f"- {_joined(e)}")
        elif name in ("programlisting", "code"):
            out.append(f"```\n{''.join(e.itertext())}\n```")
        elif name in ("table", "informaltable"):
            tables.append([[_joined(c) for c in r if _local(c.tag) in ("td", "th", "entry")] for r in e.iter() if _local(r.tag) in ("tr", "row")])
            out.append("\n".join("\t".join(r) for r in tables[-1]))
        elif name in ("binary", "ref-list"):
            return
        else:
            deeper = depth + (name in ("sec", "section", "chapter", "sect1", "sect2", "sect3", "sect4", "body", "article", "book"))
            for c in e:
                walk(c, deeper)

    walk(_tree(data), 0)
    return Extracted("\n\n".join(x for x in out if x), meta, tables)


def _bibtex(data: bytes) -> Extracted:
    text, lines, kinds, years = decode(data), [], {}, []
    for m in re.finditer(r"@(\w+)\s*\{\s*([^,\s]*)\s*,(.*?)\n\s*\}", text, re.DOTALL):
        kind, key, body = m[1].lower(), m[2], m[3] + "\n"
        if kind in ("comment", "string", "preamble"):
            continue
        kinds[kind] = kinds.get(kind, 0) + 1
        lines.append(f"[{kind}] {key}")
        for f in re.finditer(r"(\w+)\s*=\s*(?:\{((?:[^{}]|\{[^{}]*\})*)\}|\"([^\"]*)\"|(\w+))\s*,?", body):
            value = " ".join(next(v for v in f.groups()[1:] if v is not None).replace("{", "").replace("}", "").split())
            name = f[1].lower()
            if name == "author":
                value = "; ".join(a.strip() for a in value.split(" and "))
            if name == "year" and value.isdigit():
                years.append(int(value))
            lines.append(f"  {name}: {value}")
    meta = {"entry_count": str(sum(kinds.values())), "entry_types": json.dumps(kinds)}
    if years:
        meta |= {"year_min": str(min(years)), "year_max": str(max(years))}
    return Extracted("\n".join(lines), meta)


def _citations(data: bytes) -> Extracted:
    """RIS, PubMed and EndNote tags: one line for each tag, records between empty lines."""
    records, now = [], []
    for line in decode(data).splitlines():
        m = re.match(r"^([A-Z][A-Z0-9]{1,3}|%\w)\s*- ?(.*)$|^(%\w) (.*)$", line)
        if m:
            tag, value = (m[1] or m[3]).strip(), (m[2] if m[1] else m[4]) or ""
            if tag == "ER" or (tag == "PMID" and now):
                records.append(now)
                now = []
            if tag != "ER":
                now.append(f"{tag}: {value.strip()}")
        elif line.strip() and now and line[:1].isspace():
            now[-1] += " " + line.strip()
        elif not line.strip() and now and now[0].startswith("%"):
            records.append(now)
            now = []
    if now:
        records.append(now)
    return Extracted("\n\n".join("\n".join(r) for r in records), {"citation_count": str(len(records))})


def _rtf(data: bytes) -> Extracted:
    """Text of RTF: groups of fonts, colours, styles, pictures and info are dropped, escapes resolved."""
    text, out, stack, skip, k = decode(data, "cp1252"), [], [], False, 0
    hidden = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "footer", "generator", "themedata", "datastore", "listtable", "listoverridetable"}
    while k < len(text):
        c = text[k]
        if c == "{":
            stack.append(skip)
            k += 1
        elif c == "}":
            skip = stack.pop() if stack else False
            k += 1
        elif c == "\\":
            m = re.compile(r"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\(.)", re.DOTALL).match(text, k)
            if m is None:
                break
            k = m.end()
            if m[1]:
                if m[1] in hidden:
                    skip = True
                elif not skip and m[1] in ("par", "line", "row"):
                    out.append("\n")
                elif not skip and m[1] in ("tab", "cell"):
                    out.append("\t")
                elif not skip and m[1] == "u" and m[2]:
                    out.append(chr(int(m[2]) % 65536))
                    k += k < len(text) and text[k] == "?"
            elif m[3] and not skip:
                out.append(bytes.fromhex(m[3]).decode("cp1252", "replace"))
            elif m[4] == "*":
                skip = True
            elif m[4] and not skip and m[4] in "{}\\~_-":
                out.append({"~": " ", "_": "-", "-": ""}.get(m[4], m[4]))
        else:
            if not skip and c not in "\r\n":
                out.append(c)
            k += 1
    return Extracted("".join(out).strip())


def _latex(data: bytes) -> Extracted:
    text = re.sub(r"(?<!\\)%[^\n]*", "", decode(data))
    meta = {k: " ".join(m[1].split()) for k in ("title", "author", "date") if (m := re.search(rf"\\{k}\{{([^}}]*)\}}", text))}
    body = re.search(r"\\begin\{document\}(.*?)(?:\\end\{document\}|\Z)", text, re.DOTALL)
    body = body[1] if body else text
    tables = []

    def tabular(m):
        rows = [[" ".join(c.split()) for c in r.split("&")] for r in re.sub(r"\\hline|\\toprule|\\midrule|\\bottomrule", "", m[1]).split(r"\\") if r.strip()]
        tables.append(rows)
        return "\n" + "\n".join("\t".join(r) for r in rows) + "\n"

    body = re.sub(r"\\begin\{tabular\}\{[^}]*\}(.*?)\\end\{tabular\}", tabular, body, flags=re.DOTALL)
    for level, name in enumerate(("chapter", "section", "subsection", "subsubsection"), 1):
        body = re.sub(rf"\\{name}\*?\{{([^}}]*)\}}", lambda m, n=level: f"\n\n{'#' * n} {m[1]}\n\n", body)
    body = re.sub(r"\\item\s*", "\n- ", body)
    body = re.sub(r"\\(?:begin|end)\{[^}]*\}(?:\[[^\]]*\])?", "", body)
    for _ in range(4):
        body = re.sub(r"\\(?:textbf|textit|emph|texttt|underline|text|href\{[^}]*\})\{([^{}]*)\}", r"\1", body)
    body = re.sub(r"\\(?:label|ref|cite|maketitle|usepackage|documentclass)(?:\[[^\]]*\])?(?:\{[^}]*\})?", "", body)
    body = re.sub(r"\\([%&_#$])", r"\1", body)
    return Extracted(re.sub(r"\n{3,}", "\n\n", body).strip(), meta, tables)


def _notebook(data: bytes) -> Extracted:
    nb = json.loads(decode(data))
    out = []
    for cell in nb.get("cells", []):
        source = "".join(cell.get("source", []))
        if cell.get("cell_type") == "code":
            out.append(f"```{nb.get('metadata', {}).get('kernelspec', {}).get('language', '')}\n{source}\n```")
            for o in cell.get("outputs", []):
                text = o.get("text") or o.get("data", {}).get("text/plain")
                if text:
                    out.append("".join(text))
        elif source.strip():
            out.append(source)
    meta = {"cell_count": str(len(nb.get("cells", []))), "nbformat": str(nb.get("nbformat", ""))}
    return Extracted("\n\n".join(out), meta)


def _opml(data: bytes) -> Extracted:
    root, lines = _tree(data), []

    def walk(e, depth):
        for c in e:
            if _local(c.tag) == "outline":
                lines.append("  " * depth + "- " + (c.get("text") or c.get("title") or c.get("xmlUrl") or ""))
                walk(c, depth + 1)

    body = root.find("body")
    if body is not None:
        walk(body, 0)
    title = root.findtext("head/title")
    return Extracted("\n".join(lines), {"title": title} if title else {})


def _rst(data: bytes) -> Extracted:
    """reStructuredText: underlined titles as headings in the order of their signs, directives and roles reduced to their text."""
    lines, out, order, k = decode(data).splitlines(), [], [], 0
    while k < len(lines):
        line = lines[k]
        under = lines[k + 1] if k + 1 < len(lines) else ""
        if line.strip() and re.fullmatch(r"([=\-~^\"'`#*+:.])\1{2,}\s*", under) and len(under.rstrip()) >= len(line.rstrip()):
            sign = under[0]
            if sign not in order:
                order.append(sign)
            out.append(f"{'#' * min(6, order.index(sign) + 1)} {line.strip()}")
            k += 2
            continue
        if not re.fullmatch(r"([=\-~^\"'`#*+:.])\1{2,}\s*", line) and not line.startswith(".. "):
            out.append(re.sub(r":\w+:`([^`]*)`|``([^`]*)``", lambda m: m[1] or m[2], line))
        k += 1
    return Extracted("\n".join(out).strip())


def _org(data: bytes) -> Extracted:
    """Org mode: stars as headings, keyword lines as metadata, blocks fenced."""
    meta, out = {}, []
    for line in decode(data).splitlines():
        if m := re.match(r"#\+(title|author|date|language):\s*(.*)", line, re.IGNORECASE):
            meta[m[1].lower()] = m[2].strip()
        elif m := re.match(r"(\*+)\s+(?:TODO |DONE )?(.*)", line):
            out.append(f"{'#' * min(6, len(m[1]))} {m[2]}")
        elif re.match(r"#\+(begin|end)_(src|example)", line, re.IGNORECASE):
            out.append("```")
        elif not line.startswith(("#+", ":")):
            out.append(re.sub(r"\[\[([^\]]*)\]\[([^\]]*)\]\]", r"[\2](\1)", line))
    return Extracted("\n".join(out).strip(), meta)


def _djot(data: bytes) -> Extracted:
    """Djot and Typst markup near Markdown: attributes dropped, heading signs of Typst turned."""
    text = re.sub(r"(?m)^\{[^}\n]*\}\s*$\n?", "", decode(data))
    return Extracted(text.strip())


def _typst(data: bytes) -> Extracted:
    text = re.sub(r"(?m)^(=+)\s+", lambda m: "#" * len(m[1]) + " ", decode(data))
    return Extracted(re.sub(r"(?m)^#(?:set|show|import|let)\b[^\n]*\n?", "", text).strip())


def _mdx(data: bytes) -> Extracted:
    found = _markdown(data)
    text = re.sub(r"(?m)^(?:import|export)\s[^\n]*\n?", "", found.content)
    return Extracted(re.sub(r"</?[A-Z]\w*[^>]*>", "", text).strip(), found.metadata)


def _email(data: bytes) -> Extracted:
    m = email.message_from_bytes(data, policy=email.policy.default)
    body = m.get_body(("html", "plain"))
    text = body.get_content() if body is not None else ""
    if body is not None and body.get_content_type() == "text/html":
        text = html_source.to_markdown(html_source.parse(text))
    names = ("From", "To", "Cc", "Bcc", "Subject", "Date")
    head = [f"{n}: {m[n]}" for n in names if m[n]]
    children = [(a.get_filename() or f"attachment_{k}", a.get_payload(decode=True) or b"") for k, a in enumerate(m.iter_attachments())]
    meta = {n.lower(): str(m[n]) for n in names if m[n]} | ({"message_id": str(m["Message-ID"])} if m["Message-ID"] else {})
    if children:
        meta["attachments"] = ",".join(n for n, _ in children)
    return Extracted("\n".join(head) + "\n\n" + text.strip(), meta, [], children)


def _unzip(data: bytes) -> zipfile.ZipFile:
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ExtractionError(f"ZIP: {e}") from e
    size, packed = sum(i.file_size for i in z.infolist()), sum(i.compress_size for i in z.infolist())
    if len(z.infolist()) > MAX_ENTRIES or size > MAX_BYTES or size > MAX_RATIO * max(packed, 10_000):
        raise ExtractionError("the archive is too large unpacked")
    return z


def _office_meta(z: zipfile.ZipFile) -> dict[str, str]:
    """Core, application and custom properties, or those of OpenDocument."""
    out: dict[str, str] = {}
    for name in ("docProps/core.xml", "docProps/app.xml", "docProps/custom.xml", "meta.xml"):
        if name in z.namelist():
            for e in _tree(z.read(name)).iter():
                key = e.get("name") or _local(e.tag)
                text = _joined(e) if e.get("name") else (e.text or "").strip()
                if text and (e.get("name") or not len(e)):
                    out.setdefault({"creator": "created_by", "created": "created_at", "modified": "modified_at", "creation-date": "created_at"}.get(key, key), text)
    return out


def _docx(data: bytes) -> Extracted:
    z = _unzip(data)
    out, tables = [], []

    def cell(e):
        return " ".join("".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in e.iter() if _local(p.tag) == "p").strip()

    body = next(e for e in _tree(z.read("word/document.xml")).iter() if _local(e.tag) == "body")
    for e in body:
        if _local(e.tag) == "p":
            text, style, numbered = "", "", False
            for x in e.iter():
                name = _local(x.tag)
                if name == "t":
                    text += x.text or ""
                elif name == "tab":
                    text += "\t"
                elif name == "br":
                    text += "\f" if any(v == "page" for v in x.attrib.values()) else "\n"
                elif name == "pStyle":
                    style = next(iter(x.attrib.values()), "")
                elif name == "numPr":
                    numbered = True
            m = re.match(r"(?i)heading\s*(\d)", style)
            if text.strip():
                out.append(f"{'#' * min(6, int(m[1]))} {text.strip()}" if m else f"# {text.strip()}" if style.lower() == "title" else f"- {text.strip()}" if numbered else text.strip())
        elif _local(e.tag) == "tbl":
            tables.append([[cell(c) for c in r if _local(c.tag) == "tc"] for r in e if _local(r.tag) == "tr"])
            out.append("\n".join("\t".join(r) for r in tables[-1]))
    return Extracted("\n\n".join(out), _office_meta(z), tables)


def _pptx(data: bytes) -> Extracted:
    z, out = _unzip(data), []
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    for no, name in enumerate(slides, 1):
        lines = ["".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in _tree(z.read(name)).iter() if _local(p.tag) == "p"]
        out.append(f"<!-- Slide {no} -->\n" + "\n".join(x for x in lines if x.strip()))
    return Extracted("\n\n".join(out), _office_meta(z) | {"slide_count": str(len(slides))})


def _xlsx(data: bytes) -> Extracted:
    z = _unzip(data)
    shared = ["".join(t.text or "" for t in s.iter() if _local(t.tag) == "t") for s in _tree(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    names = [e.get("name", "") for e in _tree(z.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"]
    files = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    out, tables = [], []
    for title, name in zip(names, files, strict=False):
        rows = []
        for r in (e for e in _tree(z.read(name)).iter() if _local(e.tag) == "row"):
            cells: dict[int, str] = {}
            for k, c in enumerate(x for x in r if _local(x.tag) == "c"):
                letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
                at = k
                if letters:
                    at = 0
                    for ch in letters:
                        at = at * 26 + ord(ch) - 64
                    at -= 1
                value = "".join(t.text or "" for t in c.iter() if _local(t.tag) in ("v", "t"))
                cells[at] = shared[int(value)] if c.get("t") == "s" and value.isdigit() and int(value) < len(shared) else value
            rows.append([cells.get(j, "") for j in range(max(cells, default=-1) + 1)])
        tables.append(rows)
        out.append(f"## {title}\n" + "\n".join("\t".join(r) for r in rows))
    return Extracted("\n\n".join(out), _office_meta(z) | {"sheet_names": ",".join(names)}, tables)


def _opendocument(data: bytes) -> Extracted:
    z, out, tables = _unzip(data), [], []

    def walk(e):
        name = _local(e.tag)
        if name == "h":
            level = next((v for k, v in e.attrib.items() if k.endswith("outline-level")), "1")
            out.append(f"{'#' * min(6, int(level))} {_joined(e)}")
        elif name == "p":
            out.append(_joined(e))
        elif name == "list-item":
            out.append(f"- {_joined(e)}")
        elif name == "table":
            tables.append([[_joined(c) for c in r if _local(c.tag) == "table-cell"] for r in e.iter() if _local(r.tag) == "table-row"])
            out.append("\n".join("\t".join(r) for r in tables[-1]))
        else:
            for c in e:
                walk(c)

    walk(_tree(z.read("content.xml")))
    return Extracted("\n\n".join(x for x in out if x), _office_meta(z), tables)


def _epub(data: bytes) -> Extracted:
    z = _unzip(data)
    root = next((e.get("full-path") for e in _tree(z.read("META-INF/container.xml")).iter() if _local(e.tag) == "rootfile"), None)
    if root is None:
        raise ExtractionError("EPUB without a package file")
    package, base = _tree(z.read(root)), root.rpartition("/")[0]
    items = {e.get("id"): e.get("href") for e in package.iter() if _local(e.tag) == "item"}
    meta = {}
    for e in package.iter():
        if _local(e.tag) in ("title", "creator", "language", "publisher", "date", "identifier", "description") and e.text:
            meta.setdefault(_local(e.tag), e.text.strip())
    parts = []
    for e in package.iter():
        if _local(e.tag) == "itemref" and items.get(e.get("idref")):
            name = f"{base}/{items[e.get('idref')]}" if base else items[e.get("idref")]
            if name in z.namelist():
                parts.append(_html(z.read(name)).content)
    return Extracted("\n\n".join(p for p in parts if p), meta)


def _dbf(data: bytes) -> Extracted:
    if len(data) < 33:
        raise ExtractionError("DBF is cut off")
    n, head, width = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while at + 32 <= head and data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    rows = [[f for f, _ in fields]]
    for k in range(n):
        record = data[head + k * width : head + (k + 1) * width]
        if len(record) == width and record[:1] == b" ":
            row, p = [], 1
            for _, size in fields:
                row.append(record[p : p + size].decode("cp1252", "replace").strip())
                p += size
            rows.append(row)
    return Extracted("\n".join("\t".join(r) for r in rows), {"record_count": str(len(rows) - 1)}, [rows])


def _zip(data: bytes) -> Extracted:
    z = _unzip(data)
    children = [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
    return Extracted("\n".join(n for n, _ in children), {"file_count": str(len(children))}, [], children)


def _tar(data: bytes) -> Extracted:
    children, size = [], 0
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for m in t:
            if m.isfile():
                size += m.size
                if len(children) >= MAX_ENTRIES or size > MAX_BYTES:
                    raise ExtractionError("the archive is too large unpacked")
                children.append((m.name, t.extractfile(m).read()))
    return Extracted("\n".join(n for n, _ in children), {"file_count": str(len(children))}, [], children)


def _gzip(data: bytes) -> Extracted:
    with gzip.open(io.BytesIO(data)) as f:
        inner = f.read(MAX_BYTES + 1)
    if len(inner) > MAX_BYTES:
        raise ExtractionError("the archive is too large unpacked")
    if len(inner) > 512 and inner[257:262] == b"ustar":
        return _tar(inner)
    return Extracted("", {"file_count": "1"}, [], [("content", inner)])


def data_uri(uri: str) -> tuple[str, bytes] | None:
    """Media type and bytes of a data URI; None for anything else."""
    m = re.match(r"data:([\w/+.-]*)(;base64)?,(.*)", uri, re.DOTALL)
    if m is None:
        return None
    try:
        return m[1] or "text/plain", base64.b64decode(m[3], validate=False) if m[2] else m[3].encode()
    except ValueError:
        return None


def resolve_path(base: str, target: str) -> str:
    """A relative image path against its document's folder, staying below it."""
    if re.match(r"[a-zA-Z][\w+.-]*:|/", target):
        return target
    parts = [p for p in base.split("/")[:-1] if p]
    for p in target.split("/"):
        if p == "..":
            if parts:
                parts.pop()
        elif p not in ("", "."):
            parts.append(p)
    return ("/" if base.startswith("/") else "") + "/".join(parts)


#: Extractors by media type: function and priority; the highest priority wins, an exact type before ``type/*``.
REGISTRY: dict[str, list[tuple[int, Callable[[bytes], Extracted]]]] = {}


def register(mime: str, function: Callable[[bytes], Extracted], priority: int = 50) -> None:
    """Adds an extractor for a media type or a pattern like ``text/*``."""
    REGISTRY.setdefault(mime, []).append((priority, function))
    REGISTRY[mime].sort(key=lambda x: -x[0])


for _mimes, _function in (
    (("text/plain", "text/*", "text/troff", "text/x-mdoc", "text/x-pod", "text/x-dokuwiki"), _text), (("text/markdown", "text/x-markdown"), _markdown), (("text/html", "application/xhtml+xml"), _html),
    (("application/json", "application/csl+json"), _data("json")), (("application/x-ndjson", "application/jsonl"), _data("jsonl")), (("application/x-yaml", "text/yaml"), _data("yaml")), (("application/toml",), _data("toml")),
    (("application/xml", "text/xml", "application/x-endnote+xml"), _xml), (("image/svg+xml",), _svg), (("application/x-jats+xml", "application/docbook+xml", "application/x-fictionbook+xml"), _document_xml),
    (("application/x-bibtex",), _bibtex), (("application/rtf", "text/rtf"), _rtf), (("application/x-latex", "text/x-tex"), _latex), (("application/x-ipynb+json",), _notebook),
    (("text/x-rst",), _rst), (("text/x-org",), _org), (("text/x-djot",), _djot), (("text/x-typst", "application/x-typst"), _typst), (("text/mdx",), _mdx), (("message/rfc822",), _email),
    (("application/vnd.openxmlformats-officedocument.wordprocessingml.document",), _docx), (("application/vnd.openxmlformats-officedocument.presentationml.presentation",), _pptx),
    (("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",), _xlsx), (("application/vnd.oasis.opendocument.text", "application/vnd.oasis.opendocument.spreadsheet"), _opendocument),
    (("application/x-dbf",), _dbf), (("application/zip",), _zip), (("application/x-tar",), _tar), (("application/gzip",), _gzip),
):
    for _mime in _mimes:
        register(_mime, _function)
register("text/csv", _csv(None), 60)
register("text/tab-separated-values", _csv("\t"), 60)
for _mime in ("application/x-research-info-systems", "application/x-pubmed", "application/x-endnote-refer"):
    register(_mime, _citations, 60)
register("application/epub+zip", _epub, 60)
register("text/x-opml", _opml, 55)


def extractor_for(mime: str) -> Callable[[bytes], Extracted]:
    """The extractor of a media type (parameters and case do not matter)."""
    base = mime.split(";")[0].strip().lower()
    for key in (base, base.split("/")[0] + "/*"):
        if key in REGISTRY:
            return REGISTRY[key][0][1]
    raise ExtractionError(f"unsupported media type {base}")


def extract_bytes(data: bytes, mime: str) -> Extracted:
    """Text (in normal form C), tables and metadata of a file's bytes."""
    out = extractor_for(mime)(data)
    out.content = unicodedata.normalize("NFC", out.content)
    return out


def _image(data: bytes) -> Extracted:
    """Format and size of an image from its header; its text is a matter of a registered reader."""
    kind = size = None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        kind, size = "png", struct.unpack(">II", data[16:24])
    elif data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        kind, size = "gif", struct.unpack("<HH", data[6:10])
    elif data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        kind, size = "bmp", (w, abs(h))
    elif data[:2] == b"\xff\xd8":
        kind, at = "jpeg", 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            mark, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                size = struct.unpack(">HH", data[at + 5 : at + 9])[::-1]
                break
            at += 2 + length
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        kind = "webp"
        if data[12:16] == b"VP8X" and len(data) >= 30:
            size = tuple(int.from_bytes(data[k : k + 3], "little") + 1 for k in (24, 27))
        elif data[12:16] == b"VP8L" and len(data) >= 25:
            bits = int.from_bytes(data[21:25], "little")
            size = ((bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1)
        elif data[12:16] == b"VP8 " and len(data) >= 30:
            size = tuple(x & 0x3FFF for x in struct.unpack("<HH", data[26:30]))
    elif data[:4] in (b"II*\0", b"MM\0*"):
        kind, order = "tiff", "<" if data[:2] == b"II" else ">"
        (at,) = struct.unpack(f"{order}I", data[4:8])
        tags = {}
        for k in range(struct.unpack(f"{order}H", data[at : at + 2])[0] if at + 2 <= len(data) else 0):
            entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
            if len(entry) == 12:
                tag, form = struct.unpack(f"{order}HH", entry[:4])
                tags[tag] = struct.unpack(f"{order}H", entry[8:10])[0] if form == 3 else struct.unpack(f"{order}I", entry[8:12])[0]
        size = (tags[256], tags[257]) if 256 in tags and 257 in tags else None
    elif re.match(rb"P[1-6]\s", data):
        kind = "pnm"
        m = re.match(rb"P[1-6](?:\s|#[^\n]*\n)+(\d+)\s+(\d+)", data)
        size = (int(m[1]), int(m[2])) if m else None
    elif data[:12] == b"\0\0\0\x0cjP  \r\n\x87\n":
        kind, at = "jp2", data.find(b"ihdr")
        size = struct.unpack(">II", data[at + 4 : at + 12])[::-1] if at > 0 and at + 12 <= len(data) else None
    elif data[:8] == b"\x97JB2\r\n\x1a\n":
        kind = "jbig2"
    if kind is None:
        raise ExtractionError("no image")
    return Extracted("", {"format": kind} | ({"width": str(size[0]), "height": str(size[1])} if size else {}))


register("image/*", _image, 40)


def register_ocr(function: Callable[[bytes], str], priority: int = 60) -> None:
    """Adds a reader of images: its text goes with the size and format from the header."""

    def read(data: bytes) -> Extracted:
        head = _image(data)
        return Extracted(function(data), head.metadata)

    register("image/*", read, priority)


def write_csv(rows: list[list[str]]) -> str:
    """Rows as CSV text."""
    f = io.StringIO()
    csv.writer(f).writerows(rows)
    return f.getvalue()


def extractor_choice(df: DataFrame, mime_col: str) -> DataFrame:
    """Which entry of the registry serves each different media type: mime_type, pattern, priority (nulls where none does).

    An exact type goes before ``type/*``, then the higher priority. The registry is small and goes to all tasks.
    """
    spark = df.sparkSession
    entries = spark.createDataFrame([(m, p) for m, of in REGISTRY.items() for p, _ in of], "pattern string, priority int")
    types = df.select(F.lower(F.trim(F.split(df[mime_col], ";")[0])).alias("mime_type")).where("mime_type IS NOT NULL").distinct()
    wild = F.concat(F.split("mime_type", "/")[0], F.lit("/*"))
    asked = types.select("mime_type", F.explode(F.array_distinct(F.array(F.col("mime_type"), wild))).alias("pattern"))
    best = F.max_by(F.struct("pattern", "priority"), F.struct(F.col("pattern") == F.col("mime_type"), "priority"))
    served = asked.join(F.broadcast(entries), "pattern").groupBy("mime_type").agg(best.alias("b"))
    return types.join(served, "mime_type", "left").select("mime_type", "b.pattern", "b.priority")

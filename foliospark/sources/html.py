"""HTML: elements, Markdown, metadata, links and tables, by one tolerant pass of the standard parser."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import ship_package

# Elements by their role.
VOID = {"br", "hr", "img", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
SKIP = {"script", "style", "noscript", "template", "head", "svg"}
BLOCKS = {"p", "div", "section", "article", "main", "aside", "header", "footer", "nav", "ul", "ol", "table", "pre", "blockquote", "dl", "form", "figure", "body", "html"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class Page(HTMLParser):
    """Elements in reading order: (kind, level, text), with links, images, tables and metadata beside them."""

    def __init__(self, strip: frozenset[str] = frozenset({"nav"})):
        super().__init__(convert_charrefs=True)
        self.strip = strip
        self.elements: list[tuple[str, int, str]] = []
        self.links: list[tuple[str, str]] = []
        self.images: list[tuple[str, str]] = []
        self.tables: list[list[list[str]]] = []
        self.meta: dict[str, str] = {}
        self.json_ld: list[str] = []
        self.lists: list[list] = []
        self.kind, self.level, self.buffer = "paragraph", 0, []
        self.hidden: list[str] = []
        self.title: list[str] | None = None
        self.link: list | None = None
        self.cell: list[str] | None = None
        self.script_type = ""
        self.pre = 0

    def _flush(self) -> None:
        text = "".join(self.buffer)
        text = text.strip("\n") if self.kind == "code" else " ".join(text.split())
        if text:
            self.elements.append((self.kind, self.level, text))
        self.buffer, self.kind, self.level = [], "paragraph", 0

    def _end_cell(self) -> None:
        if self.cell is not None and self.tables:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
        self.cell = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "html" and a.get("lang"):
            self.meta.setdefault("language", a["lang"])
        if tag == "meta":
            name = (a.get("name") or a.get("property") or "").lower()
            if name and "content" in a:
                self.meta.setdefault(name, a["content"])
            return
        if tag == "link" and a.get("rel") == "canonical":
            self.meta.setdefault("canonical", a.get("href", ""))
        if tag == "title":
            self.title = []
            return
        if tag in SKIP or tag in self.strip:
            self.hidden.append(tag)
            self.script_type = a.get("type", "") if tag == "script" else ""
            return
        if self.hidden:
            if not (self.hidden[-1] == "head" and tag == "body"):
                return
            self.hidden.pop()
        if tag in HEADINGS:
            self._flush()
            self.kind, self.level = "heading", int(tag[1])
        elif tag in ("ul", "ol"):
            self._flush()
            self.lists.append([tag, 0])
        elif tag == "li":
            self._flush()
            self.kind, self.level = "list_item", max(1, len(self.lists))
            if self.lists:
                self.lists[-1][1] += 1
        elif tag == "pre":
            self._flush()
            self.kind, self.pre = "code", 1
        elif tag == "blockquote":
            self._flush()
            self.kind = "quote"
        elif tag in ("dt", "dd"):
            self._flush()
            self.kind = "definition"
        elif tag == "table":
            self._flush()
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self._end_cell()
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            self._end_cell()
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.cell = []
        elif tag == "a":
            self.link = [a.get("href", ""), []]
        elif tag == "img":
            self.images.append((a.get("src", ""), a.get("alt", "")))
            if a.get("alt"):
                self._flush()
                self.elements.append(("image", 0, a["alt"]))
        elif tag == "br":
            self.buffer.append("\n" if self.pre else " ")
        elif tag in BLOCKS and self.kind not in ("quote",):
            self._flush()

    def handle_endtag(self, tag: str) -> None:
        if tag == "title" and self.title is not None:
            self.meta.setdefault("title", " ".join("".join(self.title).split()))
            self.title = None
            return
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
            return
        if tag in HEADINGS or tag in ("li", "p", "dt", "dd", "blockquote"):
            self._flush()
        elif tag == "pre":
            self._flush()
            self.pre = 0
        elif tag in ("ul", "ol"):
            self._flush()
            if self.lists:
                self.lists.pop()
        elif tag in ("td", "th"):
            self._end_cell()
        elif tag == "table" and self.tables:
            self._end_cell()
            self.elements.append(("table", len(self.tables), "\n".join("\t".join(r) for r in self.tables[-1] if r)))
        elif tag == "a" and self.link is not None:
            if self.link[0]:
                self.links.append((self.link[0], " ".join("".join(self.link[1]).split())))
            self.link = None
        elif tag in BLOCKS:
            self._flush()

    def handle_data(self, data: str) -> None:
        if self.title is not None:
            self.title.append(data)
            return
        if self.hidden:
            if self.hidden[-1] == "script" and "ld+json" in self.script_type:
                try:
                    self.json_ld.append(json.dumps(json.loads(data), ensure_ascii=False))
                except ValueError:
                    pass
            return
        if self.link is not None:
            self.link[1].append(data)
        (self.cell if self.cell is not None else self.buffer).append(data)

    def finish(self) -> Page:
        self.close()
        self._end_cell()
        self._flush()
        return self


def parse(html: str, keep_headers: bool = True, keep_footers: bool = True) -> Page:
    """The parsed page; ``nav`` never counts, ``header`` and ``footer`` as asked."""
    strip = {"nav"} | ({"header"} if not keep_headers else set()) | ({"footer"} if not keep_footers else set())
    page = Page(frozenset(strip))
    page.feed(html)
    return page.finish()


def to_markdown(page: Page) -> str:
    """Markdown of the elements."""
    out: list[str] = []
    for kind, level, text in page.elements:
        if kind == "heading":
            out.append(f"{'#' * level} {text}")
        elif kind == "list_item":
            out.append(f"{'  ' * (level - 1)}- {text}")
        elif kind == "code":
            out.append(f"```\n{text}\n```")
        elif kind == "quote":
            out.append(f"> {text}")
        elif kind == "image":
            out.append(f"![{text}]()")
        elif kind == "table":
            rows = [r.split("\t") for r in text.split("\n") if r]
            width = max(map(len, rows), default=0)
            lines = ["| " + " | ".join(c.replace("|", "\\|") for c in [*r, *[""] * (width - len(r))]) + " |" for r in rows]
            out.append("\n".join([*lines[:1], "|" + " --- |" * width, *lines[1:]]) if lines else "")
        else:
            out.append(text)
    text = ""
    for k, (block, e) in enumerate(zip(out, page.elements, strict=True)):
        glue = "" if k == 0 else "\n" if e[0] == "list_item" and page.elements[k - 1][0] == "list_item" else "\n\n"
        text += glue + block
    return text


def html_elements(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Elements of every page: id, element_no, kind, level, text. Null and empty pages have none."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(doc, k, *e) for doc, h in zip(batch["id"], batch["html"], strict=True) for k, e in enumerate(parse(h).elements)]
            yield pd.DataFrame(rows, columns=["id", "element_no", "kind", "level", "text"])

    source = df.select(df[id_col].alias("id"), df[html_col].alias("html")).where(F.length("html") > 0)
    return source.mapInPandas(run, "id bigint, element_no int, kind string, level int, text string")


def html_pages(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Every page as Markdown with metadata, links, images and tables; null pages have none."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, h in zip(batch["id"], batch["html"], strict=True):
                p = parse(h)
                rows.append((doc, to_markdown(p), p.meta, [{"uri": u, "label": t} for u, t in p.links], [{"source": s, "alt": t} for s, t in p.images], p.tables, p.json_ld))
            yield pd.DataFrame(rows, columns=["id", "markdown", "metadata", "links", "images", "tables", "json_ld"])

    schema = "id bigint, markdown string, metadata map<string,string>, links array<struct<uri: string, label: string>>, images array<struct<source: string, alt: string>>, tables array<array<array<string>>>, json_ld array<string>"
    source = df.select(df[id_col].alias("id"), df[html_col].alias("html")).where(F.col("html").isNotNull())
    return source.mapInPandas(run, schema)

"""Rendering of element arrays: plain, Markdown, HTML, Djot, JSON sections; inline marks and footnotes."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.session import ship_package

Element = tuple[str, int, str]


def plain(elements: list[Element]) -> str:
    """Texts between empty lines, list items on lines of their own."""
    out = ""
    for k, (kind, level, text) in enumerate(elements):
        if not text:
            continue
        glue = "" if not out else "\n" if kind == "list_item" and elements[k - 1][0] == "list_item" else "\n\n"
        out += glue + ("  " * level + "- " + text if kind == "list_item" else text)
    return out


def markdown(elements: list[Element]) -> str:
    """Markdown."""
    out = ""
    for k, (kind, level, text) in enumerate(elements):
        if kind == "heading":
            block = f"{'#' * max(1, level)} {text}"
        elif kind == "list_item":
            block = f"{'  ' * level}- {text}"
        elif kind == "code":
            block = f"```\n{text}\n```"
        elif kind == "quote":
            block = block_quote(text)
        elif kind == "page_break":
            block = "---"
        else:
            block = text
        if block:
            out += ("" if not out else "\n" if kind == "list_item" and elements[k - 1][0] == "list_item" else "\n\n") + block
    return out + "\n" if out else ""


def djot(elements: list[Element]) -> str:
    """Djot: as Markdown, page breaks as its thematic break."""
    return markdown(elements).replace("\n---\n", "\n* * *\n")


def to_html(elements: list[Element]) -> str:
    """HTML; adjoining list items share a list."""
    out, in_list = [], False
    for kind, level, text in elements:
        if in_list and kind != "list_item":
            out.append("</ul>")
            in_list = False
        safe = html.escape(text, quote=False)
        if kind == "heading":
            out.append(f"<h{max(1, level)}>{safe}</h{max(1, level)}>")
        elif kind == "list_item":
            if not in_list:
                out.append("<ul>")
                in_list = True
            out.append(f"<li>{safe}</li>")
        elif kind == "code":
            out.append(f"<pre><code>{safe}</code></pre>")
        elif kind == "quote":
            out.append(f"<blockquote>{safe}</blockquote>")
        elif kind == "page_break":
            out.append("<hr />")
        else:
            out.append(f"<p>{safe}</p>")
    return "\n".join([*out, "</ul>"] if in_list else out)


def json_sections(elements: list[Element]) -> str:
    """Tree of sections: each heading holds what follows until one of its level or above."""
    root: dict = {"title": None, "level": 0, "content": [], "sections": []}
    stack = [root]
    for kind, level, text in elements:
        if kind == "heading":
            while len(stack) > 1 and stack[-1]["level"] >= level:
                stack.pop()
            section = {"title": text, "level": level, "content": [], "sections": []}
            stack[-1]["sections"].append(section)
            stack.append(section)
        elif text:
            stack[-1]["content"].append({"type": kind, "text": text})
    return json.dumps(root, ensure_ascii=False)


#: Renderers by format; more can be registered.
RENDERERS: dict[str, Callable[[list[Element]], str]] = {"plain": plain, "markdown": markdown, "djot": djot, "html": to_html, "json": json_sections}


def register(name: str, function: Callable[[list[Element]], str]) -> None:
    """Adds a renderer."""
    RENDERERS[name] = function


def render(elements: Column, output_format: str = "markdown") -> Column:
    """An array of (kind, level, text) in a format; null stays null."""
    if output_format not in RENDERERS:
        raise ValueError(f"unknown format {output_format}")
    ship_package()
    function = RENDERERS[output_format]

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda es: None if es is None else function([(e["kind"], int(e["level"] or 0), e["text"] or "") for e in es]))

    return run(elements)


def block_quote(text: str) -> str:
    return "\n".join(f"> {x}" if x else ">" for x in text.split("\n"))


def annotate(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Inline marks of spans (start, end, kind) as Markdown; kinds: bold, italic, code, strike, link:target."""
    marks = {"bold": ("**", "**"), "italic": ("*", "*"), "code": ("`", "`"), "strike": ("~~", "~~")}
    at: dict[int, str] = {}
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        left, right = ("[", f"]({kind[5:]})") if kind.startswith("link:") else marks.get(kind, ("", ""))
        at[a] = at.get(a, "") + left
        at[b] = right + at.get(b, "")
    return "".join(at.get(k, "") + c for k, c in enumerate(text)) + at.get(len(text), "")


def number_footnotes(text: str) -> str:
    """Footnotes numbered by their first mention; those that are never mentioned go last."""
    order: dict[str, int] = {}
    for m in re.finditer(r"\[\^([^\]]+)\](?!:)", text):
        order.setdefault(m[1], len(order) + 1)
    for m in re.finditer(r"(?m)^\[\^([^\]]+)\]:", text):
        order.setdefault(m[1], len(order) + 1)
    return re.sub(r"\[\^([^\]]+)\]", lambda m: f"[^{order[m[1]]}]", text)


def toon(value, depth: int = 0) -> str:
    """Token-saving notation of a JSON value: members by indentation, arrays of like objects as tables."""
    pad = "  " * depth
    if isinstance(value, dict):
        lines = []
        for k, v in value.items():
            if isinstance(v, list) and v and all(isinstance(x, dict) and list(x) == list(v[0]) and not any(isinstance(y, (dict, list)) for y in x.values()) for x in v):
                lines.append(f"{pad}{k}[{len(v)}]{{{','.join(v[0])}}}:")
                lines += [f"{pad}  {','.join(_scalar(y) for y in x.values())}" for x in v]
            elif isinstance(v, list) and not any(isinstance(x, (dict, list)) for x in v):
                lines.append(f"{pad}{k}[{len(v)}]: {','.join(map(_scalar, v))}")
            elif isinstance(v, (dict, list)):
                lines += [f"{pad}{k}:", toon(v, depth + 1)]
            else:
                lines.append(f"{pad}{k}: {_scalar(v)}")
        return "\n".join(x for x in lines if x)
    if isinstance(value, list):
        return "\n".join(f"{pad}- {toon(x, depth + 1).lstrip()}" for x in value)
    return pad + _scalar(value)


def _scalar(v) -> str:
    if v is None or isinstance(v, bool):
        return json.dumps(v)
    text = str(v)
    return json.dumps(text, ensure_ascii=False) if isinstance(v, str) and (text == "" or re.search(r'[,:\n"]|^\s|\s$', text)) else text

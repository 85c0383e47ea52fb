"""Structured texts: JSON, JSON lines, YAML, TOML, XML, front matter."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame

from foliospark.session import ship_package

# Names of fields that hold text.
TEXT_FIELDS = {
    "title", "name", "subject", "description", "content", "body", "text", "message", "payload", "data", "properties", "metadata", "value", "result",
    "summary", "label", "comment", "note", "info", "spec", "status", "kind", "type", "key", "id", "url", "path", "author", "email", "address",
    "version", "tag", "category", "caption", "heading", "abstract", "readme", "changelog", "license",
}
MAX_DEPTH, MAX_ITEMS = 20, 500


def leaves(value, path: str = ""):
    """(path, value) of every leaf that is not null; paths like ``a.b[0]``, items of a root array ``item_0``."""
    todo = [(path, value)]
    while todo:
        at, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{at}.{k}" if at else str(k), x) for k, x in reversed(list(v.items()))]
        elif isinstance(v, list):
            todo += [(f"{at}[{k}]" if at else f"item_{k}", x) for k, x in reversed(list(enumerate(v)))]
        elif v is not None:
            yield at, v


def is_text_field(path: str, more: tuple[str, ...] = ()) -> bool:
    leaf = path.rsplit(".", 1)[-1].split("[", 1)[0].lower()
    return leaf in TEXT_FIELDS or leaf in {m.lower() for m in more}


def extract(value) -> tuple[str, list[tuple[str, str]]]:
    """Lines ``path: value`` of all leaves, and the text fields with their values."""
    lines, fields = [], []
    for path, v in leaves(value):
        if isinstance(v, str):
            if not v.strip():
                continue
            if is_text_field(path):
                fields.append((path, v))
        lines.append(f"{path}: {json.dumps(v) if isinstance(v, bool) else v}")
    return "\n".join(lines), fields


def schema_sketch(value, depth: int = 0):
    """Types of a JSON value: objects by their members, arrays by their first item."""
    if depth >= MAX_DEPTH:
        return {"type": "max_depth"}
    if isinstance(value, dict):
        return {"type": "object", "properties": {k: schema_sketch(v, depth + 1) for k, v in value.items()}}
    if isinstance(value, list):
        out: dict = {"type": "array", "length": len(value)}
        if value and len(value) <= MAX_ITEMS:
            out["items"] = schema_sketch(value[0], depth + 1)
        return out
    return {"type": {str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}[type(value)]}


def json_lines(text: str) -> list:
    """Values of JSON lines, blank lines skipped; a bad line raises with its number from 1."""
    out = []
    for no, line in enumerate(text.splitlines(), 1):
        if line.strip():
            try:
                out.append(json.loads(line))
            except ValueError as e:
                raise ValueError(f"line {no}: {e}") from e
    return out


def parse_data(text: str, kind: str):
    """The value of a JSON, jsonl, YAML or TOML text."""
    if kind == "json":
        return json.loads(text)
    if kind == "jsonl":
        return json_lines(text)
    if kind == "toml":
        return tomllib.loads(text)
    import yaml

    return yaml.safe_load(text)


def xml_outline(data: str | bytes, text_only: bool = False) -> tuple[str, int, list[str]]:
    """Indented outline of an XML text, the number of its elements and their distinct names.

    A label is the name with its attributes but for name spaces; texts stand one level deeper, an empty line between the
    children of the root. Tags that do not close end the parse there.
    """
    lines: list[str] = []
    names: list[str] = []
    depth = 0

    def start(name, attrs):
        nonlocal depth
        names.append(name)
        if not text_only:
            shown = ", ".join(f"{k}: {v}" for k, v in attrs.items() if not k.startswith("xmlns"))
            if depth == 1 and len(names) > 2:
                lines.append("")
            lines.append("  " * depth + (f"{name} ({shown})" if shown else name))
        depth += 1

    def end(_):
        nonlocal depth
        depth -= 1

    def chars(text):
        if text.strip():
            lines.append(text.strip() if text_only else "  " * depth + " ".join(text.split()))

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, chars
    try:
        parser.Parse(data.encode() if isinstance(data, str) else data, True)
    except expat.ExpatError:
        pass
    return "\n".join(lines), len(names), sorted(set(names))


_FENCE = re.compile(r"\A---[ \t]*\r?\n(.*?)^(?:---|\.\.\.)[ \t]*\r?$\n?", re.DOTALL | re.MULTILINE)


def front_matter(text: str) -> tuple[dict, str]:
    """Metadata of a YAML block at the start, and the rest; an invalid block stays part of the text."""
    m = _FENCE.match(text)
    if m is None:
        return {}, text
    try:
        import yaml

        data = yaml.safe_load(m[1])
    except Exception:
        return {}, text
    return (data if isinstance(data, dict) else {}), text[m.end() :]


def title_of(metadata: dict, text: str) -> str | None:
    """The title in the metadata, else the first level-one heading."""
    if metadata.get("title"):
        return str(metadata["title"])
    m = re.search(r"(?m)^#\s+(.+)$", text)
    return m[1].strip() if m else None


def json_texts(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Lines ``path: value`` of every JSON text and its text fields: id, content, fields (path: value). Null and bad texts give nulls."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"], batch["json"], strict=True):
                try:
                    content, fields = extract(json.loads(text))
                except (TypeError, ValueError, RecursionError):
                    content, fields = None, []
                rows.append((doc, content, "\n".join(f"{k}: {v}" for k, v in fields) if content is not None else None))
            yield pd.DataFrame(rows, columns=["id", "content", "fields"])

    return df.select(df[id_col].alias("id"), df[json_col].alias("json")).mapInPandas(run, "id bigint, content string, fields string")

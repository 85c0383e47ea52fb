"""Shredding of deeply nested JSON records into flat related tables.

A payload is parsed once. A bottom-up tree automaton gives every object a state, its structural variant, from the
states of its members, nested results and children included; the slot that holds an object says its kind. Objects whose
variants differ only below their children are of one subtype. Each subtype is routed to a table of its own, with the
columns that it has; the tables of a kind have those of all its subtypes. All keep the common key columns and the link to
the parent, and members without a column of their own stand in the map ``extra``.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.session import ship_package, stage

_META = (
    "title: string, subject: string, authors: array<string>, keywords: array<string>, language: string, created_at: string, "
    "modified_at: string, created_by: string, page_count: bigint, page_unit: string, format_type: string"
)
NODE_SCHEMA = (
    "record_id bigint, kind string, parent_path string, item_no bigint, path string, variant string, subtype string, "
    "content string, mime_type string, entry_path string, has_result boolean, "
    f"result_meta struct<{_META}>, quality_score double, detected_languages array<string>, "
    "chunk_type string, chunk_meta struct<byte_start: bigint, byte_end: bigint, token_count: bigint, chunk_index: bigint, "
    "total_chunks: bigint, first_page: bigint, last_page: bigint, headings array<struct<level: bigint, text: string>>>, embedding array<double>, "
    "cells array<array<string>>, markdown string, page_number bigint, "
    "box struct<x0: double, y0: double, x1: double, y1: double>, extra map<string, string>"
)
SLOTS = {"children": "entry", "chunks": "chunk", "tables": "table"}


@lru_cache(maxsize=65_536)
def _plain(key: str) -> str:
    """Key without case and separators, so that mimeType, mime_type and MIME-TYPE are one key."""
    return re.sub(r"[^a-z0-9]", "", key.lower())


def _members(obj: dict) -> dict:
    """Members by plain key; where spellings of one key meet, the first value that is not null holds."""
    out: dict = {}
    for key, value in obj.items():
        k = _plain(key)
        if out.get(k) is None:
            out[k] = value
    return out


def _objects(value) -> list[dict]:
    """The objects of an array, or a bare object as an array of one; anything else holds none."""
    if isinstance(value, dict):
        return [value]
    return [v for v in value if isinstance(v, dict)] if isinstance(value, list) else []


def _as_result(value) -> dict | None:
    """An object, also where it stands as a string of JSON (even repeatedly)."""
    for _ in range(8):
        if isinstance(value, dict):
            return value
        if not isinstance(value, str):
            return None
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return None
    return None


def _int(value) -> int | None:
    if isinstance(value, bool) or value is None:
        return None
    try:
        number = int(value) if not isinstance(value, str) else int(value.strip() or "x")
    except (ValueError, OverflowError, TypeError):
        return None
    return number if -(2**63) <= number < 2**63 else None


def _float(value) -> float | None:
    if isinstance(value, bool) or value is None:
        return None
    try:
        return float(value)
    except (ValueError, TypeError, OverflowError):
        return None


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def _texts(value) -> list[str] | None:
    if value is None:
        return None
    return [_text(v) for v in (value if isinstance(value, list) else [value])]


def _short(state: str) -> str:
    """A long state by its hash, so that states do not grow with the depth of the tree."""
    return state if len(state) <= 120 else f"#{hashlib.md5(state.encode('utf-8', 'surrogatepass')).hexdigest()[:16]}"


def inner_state(value) -> str:
    """State of a value inside an object: leaves by type, arrays by the states that occur in them, objects by their members.

    A member that is null leads to the same state as a missing one. Worked out without recursion, from the leaves up.
    """
    states: list[str] = []  # of the finished values that wait for the one that holds them
    todo: list[tuple[object, bool]] = [(value, False)]
    while todo:
        v, done = todo.pop()
        if isinstance(v, dict):
            m = sorted(_members(v).items())
            if not done:
                todo.append((v, True))
                todo += [(x, False) for _, x in reversed(m)]
                continue
            own = states[len(states) - len(m) :] if m else []
            del states[len(states) - len(m) :]
            states.append(_short("{" + ",".join(f"{k}:{x}" for (k, _), x in zip(m, own, strict=True) if x != "0") + "}"))
        elif isinstance(v, list):
            if not done:
                todo.append((v, True))
                todo += [(x, False) for x in v]
                continue
            own = states[len(states) - len(v) :] if v else []
            del states[len(states) - len(v) :]
            states.append(_short("[" + "|".join(sorted(set(own))) + "]"))
        else:
            states.append("0" if v is None else "b" if isinstance(v, bool) else "n" if isinstance(v, (int, float)) else "s")
    return states[0]


def object_state(kind: str, members: dict, given: dict[str, str]) -> str:
    """Transition of the automaton: the kind and the states of the present members give the object's state.

    ``given`` has the states of members that are worked out elsewhere. Optional members that are missing and members that
    are null lead to the same state.
    """
    states = {k: given[k] if k in given else inner_state(members[k]) for k in sorted(members)}
    return f"{kind}({','.join(f'{k}:{x}' for k, x in states.items() if x != '0')})"


def state_name(kind: str, state: str) -> str:
    """Name under which the state of an object goes into that of the object which holds it."""
    return f"{kind}#{hashlib.md5(state.encode('utf-8', 'surrogatepass')).hexdigest()[:16]}"


def _result_meta(value) -> dict | None:
    if not isinstance(value, dict):
        return None
    m = _members(value)
    pages = m.get("pages")
    pages = _members(pages) if isinstance(pages, dict) else {}
    return {
        "title": _text(m.get("title")), "subject": _text(m.get("subject")), "authors": _texts(m.get("authors")),
        "keywords": _texts(m.get("keywords")), "language": _text(m.get("language")), "created_at": _text(m.get("createdat")),
        "modified_at": _text(m.get("modifiedat")), "created_by": _text(m.get("createdby")),
        "page_count": _int(pages.get("totalcount")), "page_unit": _text(pages.get("unittype")),
        "format_type": _text(m.get("formattype")),
    }


def _chunk_meta(value) -> dict | None:
    if not isinstance(value, dict):
        return None
    m = _members(value)
    context = m.get("headingcontext")
    headings = _objects(_members(context).get("headings")) if isinstance(context, dict) else []
    names = ("byte_start", "byte_end", "token_count", "chunk_index", "total_chunks", "first_page", "last_page")
    out: dict = {n: _int(m.get(_plain(n))) for n in names}
    out["headings"] = [{"level": _int(h.get("level")), "text": _text(h.get("text"))} for h in map(_members, headings)]
    return out


#: members that have columns, by kind
_KNOWN = {
    "result": {"content": ["content"], "mimetype": ["mime_type"], "metadata": [f"result_meta.{x.split(':')[0].strip()}" for x in _META.split(", ")], "qualityscore": ["quality_score"], "detectedlanguages": ["detected_languages"]},
    "entry": {"path": ["entry_path"], "mimetype": ["mime_type"], "result": ["has_result"]},
    "chunk": {"content": ["content"], "chunktype": ["chunk_type"], "metadata": ["chunk_meta.*"], "embedding": ["embedding"]},
    "table": {"cells": ["cells"], "markdown": ["markdown"], "pagenumber": ["page_number"], "boundingbox": ["box"]},
}
_META_KEYS = {
    "result": {"title", "subject", "authors", "keywords", "language", "createdat", "modifiedat", "createdby", "pages", "formattype"},
    "chunk": {"bytestart", "byteend", "tokencount", "chunkindex", "totalchunks", "firstpage", "lastpage", "headingcontext"},
}


def _extra(kind: str, members: dict) -> dict[str, str] | None:
    """Members without a column, as text or JSON; those of the metadata under ``metadata.``."""
    out = {k: _text(v) for k, v in members.items() if k not in _KNOWN[kind] and v is not None and not (kind == "result" and k in SLOTS)}
    meta = members.get("metadata")
    if kind in _META_KEYS and isinstance(meta, dict):
        out |= {f"metadata.{k}": _text(v) for k, v in _members(meta).items() if k not in _META_KEYS[kind] and v is not None}
    return out or None


def shred_payload(payload: str | None) -> list[dict]:
    """All objects of one payload as rows, the root result first; nothing for a payload that is no valid JSON object."""
    if payload is None:
        return []
    try:
        root = _as_result(json.loads(payload))
    except (ValueError, RecursionError):
        return []
    if root is None:
        return []
    rows: list[dict] = []
    #: result object, path of its entry, row that its state is for
    todo: list[tuple[dict, str]] = [(root, "")]
    pending: list[tuple[dict, dict, list[dict]]] = []
    while todo:
        result, path = todo.pop()
        members = _members(result)
        row = {
            "kind": "result", "parent_path": path, "item_no": 0, "path": path, "content": _text(members.get("content")),
            "mime_type": _text(members.get("mimetype")), "result_meta": _result_meta(members.get("metadata")),
            "quality_score": _float(members.get("qualityscore")), "detected_languages": _texts(members.get("detectedlanguages")), "extra": _extra("result", members),
        }
        rows.append(row)
        inner: list[dict] = []
        for slot, kind in SLOTS.items():
            for no, obj in enumerate(_objects(members.get(slot))):
                m = _members(obj)
                child = {"kind": kind, "parent_path": path, "item_no": no, "path": f"{path}/{no}" if path else str(no), "members": m, "extra": _extra(kind, m)}
                if kind == "entry":
                    below = _as_result(m.get("result"))
                    child |= {"entry_path": _text(m.get("path")), "mime_type": _text(m.get("mimetype")), "has_result": below is not None}
                    if below is not None:
                        todo.append((below, child["path"]))
                elif kind == "chunk":
                    child |= {"content": _text(m.get("content")), "chunk_type": _text(m.get("chunktype")), "chunk_meta": _chunk_meta(m.get("metadata"))}
                    vector = m.get("embedding")
                    child["embedding"] = [_float(x) for x in vector] if isinstance(vector, list) else None
                else:
                    cells, box = m.get("cells"), m.get("boundingbox")
                    b = _members(box) if isinstance(box, dict) else None
                    child |= {
                        "cells": [_texts(r) for r in cells] if isinstance(cells, list) else None, "markdown": _text(m.get("markdown")),
                        "page_number": _int(m.get("pagenumber")), "box": b and {k: _float(b.get(k)) for k in ("x0", "y0", "x1", "y1")},
                    }
                inner.append(child)
        rows.extend(inner)
        pending.append((row, members, inner))
    below: dict[str, str] = {}  # name of the state of the result at each path
    for row, members, inner in reversed(pending):  # children come after their parents, so this runs bottom-up
        states: dict[str, set[str]] = {kind: set() for kind in SLOTS.values()}
        for child in inner:
            kind, m = child["kind"], child.pop("members")
            given = {"result": below.get(child["path"], "0")} if kind == "entry" else {}
            child["variant"] = object_state(kind, m, given)
            child["subtype"] = object_state(kind, m, {"result": "result" if given["result"] != "0" else "0"}) if given else child["variant"]
            states[kind].add(state_name(kind, child["variant"]))
        slots = {slot: f"[{'|'.join(sorted(states[kind]))}]" if states[kind] else "0" for slot, kind in SLOTS.items()}
        row["variant"] = object_state("result", members, slots)
        row["subtype"] = object_state("result", members, {slot: f"[{kind}]" if states[kind] else "0" for slot, kind in SLOTS.items()})
        below[row["path"]] = state_name("result", row["variant"])
    return rows


_FIELDS = [
    "kind", "parent_path", "item_no", "path", "variant", "subtype", "content", "mime_type", "entry_path", "has_result", "result_meta", "quality_score",
    "detected_languages", "chunk_type", "chunk_meta", "embedding", "cells", "markdown", "page_number", "box", "extra",
]


def _shred_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows: list[list] = []
        for record, payload in zip(batch["record_id"], batch["payload"], strict=True):
            rows += [[record, *(r.get(f) for f in _FIELDS)] for r in shred_payload(payload)]
        frame = pd.DataFrame(rows, columns=["record_id", *_FIELDS], dtype=object)
        for c in ("item_no", "page_number", "record_id"):
            frame[c] = frame[c].astype("Int64")
        yield frame


KEYS = ["record_id", "parent_path", "item_no", "path", "variant", "subtype"]


@dataclass(frozen=True)
class NestedTables:
    """The node table and the tables of the kinds; every row has record_id, parent_path, item_no, path, variant and subtype."""

    nodes: DataFrame
    results: DataFrame
    entries: DataFrame
    chunks: DataFrame
    tables: DataFrame

    def subtypes(self) -> DataFrame:
        """The catalogue of the subtype tables: kind, subtype, table (its name), n_variants, n_rows."""
        n = self.nodes.groupBy("kind", "subtype").agg(F.count_distinct("variant").alias("n_variants"), F.count("*").alias("n_rows"))
        return n.select("kind", "subtype", _table_name().alias("table"), "n_variants", "n_rows")

    def subtype_table(self, subtype: str) -> DataFrame:
        """The rows of one subtype: the common keys and columns for the members that the subtype has."""
        kind, _, rest = subtype.partition("(")
        depth, member, names = 0, "", []
        for c in rest[:-1] + ",":  # the members of the outermost level
            depth += (c in "{[(") - (c in "}])")
            if c == "," and depth == 0:
                names.append(member.partition(":")[0])
                member = ""
            else:
                member += c
        columns = [x for n in names if n for x in _KNOWN[kind].get(n, [] if n in SLOTS else [f"extra.{n}"])]
        if "metadata" in names:
            columns.append("extra")
        own = [F.col("extra")[c[6:]].alias(c[6:]) if c.startswith("extra.") else F.col(c) for c in columns]
        return self.nodes.where((F.col("kind") == kind) & (F.col("subtype") == subtype)).select(*KEYS, *own)

    def write(self, folder: str) -> None:
        """Every subtype as a folder of Parquet files of its own, ``kind=…/table=…``, in one pass."""
        self.nodes.withColumn("table", _table_name()).write.partitionBy("kind", "table").parquet(folder)


def _table_name() -> Column:
    return F.concat_ws("_", "kind", F.substring(F.md5("subtype"), 1, 16))


def shred(df: DataFrame, id_col: str = "archive_id", payload_col: str = "payload", staged: bool = False, once: bool = True) -> NestedTables:
    """Flat related tables of the nested JSON in ``payload_col``.

    Null, cut off or otherwise invalid payloads yield no rows, as does JSON that is no object; an empty table gives empty
    tables. Repeated (id, payload) rows count once, unless ``once`` is false; other columns of ``df`` are ignored, whatever
    their names. A bare object counts as an array of one, elements that are no objects are skipped. A null id is kept as a
    null key. With ``staged`` the parsed nodes are written once to the shared folder and the tables read them from there.
    """
    ship_package(df.sparkSession)
    source = df.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(payload_col).cast("string").alias("payload")).where(F.col("payload").isNotNull())
    if once:
        source = source.dropDuplicates(["record_id", "payload"])
    nodes = source.mapInPandas(_shred_batches, NODE_SCHEMA)
    if staged:
        nodes = stage(nodes, "nested")
    of = lambda kind, *cols: nodes.where(F.col("kind") == kind).select(*KEYS, *cols, "extra")
    return NestedTables(
        nodes,
        of("result", "content", "mime_type", "result_meta.*", "quality_score", "detected_languages"),
        of("entry", "entry_path", "mime_type", "has_result"),
        of("chunk", "content", "chunk_type", "chunk_meta.*", "embedding"),
        of("table", "cells", "markdown", "page_number", "box"),
    )


def variant_counts(tables: NestedTables) -> DataFrame:
    """How many rows each structural variant has."""
    return tables.nodes.groupBy("kind", "subtype", "variant").agg(F.count("*").alias("n_rows"))


def found(df: DataFrame) -> DataFrame:
    """One row for each entry, chunk and table object: archive_id, kind, parent_path, item_no."""
    nodes = shred(df, once=False).nodes.where(F.col("kind") != "result")  # the rows are made distinct, so payloads need not be
    return nodes.select(F.col("record_id").alias("archive_id"), "kind", "parent_path", "item_no").distinct()

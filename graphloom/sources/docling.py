"""Structured-document JSON: a tree of text items to outline entries and blocks.

A document is read in three steps: every part of it under its reference, then the items that the body
names in reading order, then entries and blocks from the items.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: labels of items; words that begin a caption; forms of numbered headings
HEADINGS, FURNITURE = ("section_header", "title"), ("page_header", "page_footer")
_HEADING = re.compile(r"(?!\s*(?:图|表|figure|fig\.|table)\s*[\d一二三四五六七八九十]).{0,79}[^。；;：:，,]", re.I | re.S)
_NUMBERED = re.compile(r"\s*(\d+(?:\.\d+)*)[.、\s]")
_CHAPTER = re.compile(r"\s*第[\d一二三四五六七八九十百]+[章篇编]")
#: Headings of one level at least, and numbered texts at least, for numbering to tell the levels.
_FLAT, _TOLD = 10, 3

SCHEMA = (
    "path string, error string, outline array<struct<id: string, title: string, level: int, parent_id: string, sort_order: int, page_no: int>>, "
    "blocks array<struct<id: string, kind: string, text: string, outline_id: string, outline_path: array<string>, top_level_id: string, page_no: int, bbox: map<string, double>>>"
)


class Item(NamedTuple):
    """A part of the document with something to say, in reading order."""

    ref: str
    kind: str
    text: str
    level: int
    page: int | None
    box: dict[str, float] | None


def parts(value: object, at: str = "#") -> Iterator[tuple[str, object]]:
    """Everything inside a JSON value under its pointer: `~0` stands for a tilde in a name, `~1` for a slash."""
    yield at, value
    inside = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for name, part in inside:
        yield from parts(part, f"{at}/{str(name).replace('~', '~0').replace('/', '~1')}")


def pointer(document: object, ref: str) -> object | None:
    """What a pointer such as #/texts/3 names, or None."""
    return next((part for at, part in parts(document) if at == ref), None)


def _table(item: dict) -> str:
    """The cells of a table, rows by lines and columns by bars."""
    grid = (item.get("data") or {}).get("table_cells") or []
    placed = sorted((c.get("start_row_offset_idx", 0), c.get("start_col_offset_idx", 0), str(c.get("text") or "").strip()) for c in grid)
    return "\n".join(" | ".join(cell[2] for cell in row) for _, row in groupby(placed, key=lambda cell: cell[0]))


def items(document: dict) -> list[Item]:
    """The items that the body names, each once, furniture left out. References go by place (#/texts/3) or
    by an item's own self_ref; those that lead nowhere are passed over. Captions that a table or picture
    names come before it."""
    by_ref: dict[str, dict] = {}
    for group in ("groups", "texts", "tables", "pictures"):
        for i, item in enumerate(x for x in document.get(group) or []):
            if isinstance(item, dict):
                by_ref[f"#/{group}/{i}"] = item
                by_ref.setdefault(str(item.get("self_ref")), item)
    out: list[Item] = []
    seen: set[int] = set()
    refs = lambda holder, name: [c.get("$ref") for c in holder.get(name) or [] if isinstance(c, dict)]
    ahead = refs(document.get("body") or {}, "children")[::-1]
    while ahead:
        ref = ahead.pop()
        item = by_ref.get(ref)
        if item is None or id(item) in seen:
            continue
        captions = [c for c in refs(item, "captions") if c in by_ref and id(by_ref[c]) not in seen]
        if captions:
            ahead += [ref, *captions[::-1]]
            continue
        seen.add(id(item))
        ahead += refs(item, "children")[::-1]
        kind = str(item.get("label") or "")
        if kind in FURNITURE or item.get("content_layer") == "furniture":
            continue
        said = _table(item) if kind == "table" or "data" in item else str(item.get("text") or "").strip()
        if said:
            where = next((p for p in item.get("prov") or [] if isinstance(p, dict)), {})
            box = {k: float(v) for k, v in (where.get("bbox") or {}).items() if isinstance(v, (int, float))} or None
            out.append(Item(str(item.get("self_ref") or ref), kind, said, max(1, int(item.get("level") or 1)), where.get("page_no"), box))
    return out


def levels(read: list[Item]) -> list[int]:
    """The level of each item that is a heading, 0 for the others.

    A heading has a heading's label, at most 80 letters, is no caption and doesn't end in a mark that goes
    on. Its level is its own; but where ten headings or more all have one level and three texts or more
    are numbered, numbers tell: 1.2.3 is level 3, a chapter heading 1, any other one below the last.
    """
    heads = [bool(x.kind in HEADINGS and _HEADING.fullmatch(x.text)) for x in read]
    given = [x.level for x, head in zip(read, heads) if head]
    if len(given) < _FLAT or len(set(given)) > 1 or sum(bool(_NUMBERED.match(x.text)) for x in read) < _TOLD:
        return [x.level if head else 0 for x, head in zip(read, heads)]
    out, told = [], 0
    for x, head in zip(read, heads):
        number = _NUMBERED.match(x.text)
        depth = number[1].count(".") + 1 if number else 1 if _CHAPTER.match(x.text) else None
        told = depth if head and depth else told
        out.append((depth or told + 1) if head else 0)
    return out


def parse(document: dict) -> tuple[list[dict], list[dict]]:
    """(outline, blocks) of a document, in reading order. The root entry is the document itself; an entry's
    parent is the last one above its level, and its own level is one below that."""
    named = lambda kind, value: f"{kind}-{hashlib.sha1(value.encode()).hexdigest()[:12]}"
    root = {"id": "outline-root", "title": str(document.get("name") or ""), "level": 0, "parent_id": None, "sort_order": 0, "page_no": None}
    outline, blocks = [root], []
    open_: list[tuple[int, dict]] = [(0, root)]
    read = items(document)
    for item, level in zip(read, levels(read)):
        if level:
            open_ = [(at, e) for at, e in open_ if at < level]
            above = open_[-1][1]
            entry = {"id": named("outline", f"{item.ref}|{item.text}"), "title": item.text, "level": above["level"] + 1, "parent_id": above["id"], "sort_order": len(outline), "page_no": item.page}
            outline.append(entry)
            open_.append((level, entry))
        else:
            inside = [e for _, e in open_]
            blocks.append({"id": named("block", item.ref), "kind": item.kind or "text", "text": item.text, "outline_id": inside[-1]["id"], "outline_path": [e["title"] for e in inside[1:]], "top_level_id": inside[min(1, len(inside) - 1)]["id"], "page_no": item.page, "bbox": item.box})
    return outline, blocks


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, error, outline, blocks) of every JSON file; a file that is no such document has an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, text in zip(batch["path"], batch["text"]):
                try:
                    document = json.loads(text)
                    if not isinstance(document, dict) or "body" not in document:
                        raise ValueError("it has no body")
                    rows.append((name, None, *parse(document)))
                except (ValueError, TypeError, AttributeError) as failure:
                    rows.append((name, str(failure)[:300], None, None))
            yield pd.DataFrame(rows, columns=["path", "error", "outline", "blocks"])

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.mapInPandas(run, SCHEMA)


def outline_of(documents: DataFrame) -> DataFrame:
    return documents.select("path", F.explode("outline").alias("_o")).select("path", "_o.*")


def blocks_of(documents: DataFrame) -> DataFrame:
    return documents.select("path", F.posexplode("blocks").alias("block_no", "_b")).select("path", "block_no", "_b.*")

"""Text to chunks: recursive splitting, oversized blocks, section-aware packing, bounded batches."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: separators from the strongest to none, and the default sizes
SEPARATORS = ["\n\n", "\n", "。", "！", "？", ". ", "! ", "? ", " ", ""]
CHUNK_SIZE, CHUNK_OVERLAP = 2048, 256


def estimate(text: str) -> int:
    """Han characters one each, others one per four, rounded up; at least 1."""
    han = len(re.findall("[㐀-鿿]", text))
    return max(1, han + -(-(len(text) - han) // 4))


def recursive_split(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: list[str] | None = None) -> list[str]:
    """Pieces of at most size characters, cut at the strongest separator that serves.

    A text within size is one piece, an empty one none. Parts between separators are packed greedily;
    the next piece begins with the last parts of the one before, as far as `overlap` allows. Separators
    stay at the beginning of the part after them. A part beyond size is split by weaker separators.
    """
    if len(text) <= size:
        return [text] if text else []
    strong = SEPARATORS if separators is None else separators
    mark, weaker = "", []
    for i, s in enumerate(strong):
        if s == "" or s in text:
            mark, weaker = s, strong[i + 1 :]
            break
    raw = list(text) if mark == "" else [p for i, x in enumerate(text.split(mark)) if (p := x if i == 0 else mark + x)]
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held and (joined := "".join(held).strip()):
            out.append(joined)

    for part in raw:
        if len(part) > size and weaker:
            flush()
            held.clear()
            out.extend(recursive_split(part, size, overlap, weaker))
            continue
        if held and sum(map(len, held)) + len(part) > size:
            flush()
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(part) > size):
                held.pop(0)
        held.append(part)
    flush()
    return out


def split_texts(documents: DataFrame, key: str, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(key, chunk_no, chunk_text) of every document; null and empty texts have none.

    Each text is split where it is, in Arrow batches: nothing is shuffled.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, c) for k, t in zip(batch[key], batch[text]) if isinstance(t, str) for i, c in enumerate(recursive_split(t, size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "chunk_text"])

    return documents.select(key, text).mapInPandas(run, f"{key} {kind}, chunk_no int, chunk_text string")


def paragraphs(text: Column) -> Column:
    """Non-blank paragraphs, trimmed."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: F.length(p) > 0)


def halve(chunks: DataFrame, chunk_id: str, text: str) -> DataFrame:
    """Each chunk of two or more paragraphs as two rows, ids with -a and -b, cut at the middle paragraph.

    Chunks that can't be halved come out as they are; other columns are repeated.
    """
    parts, half = F.col("_parts"), F.floor(F.size("_parts") / 2).cast("int")
    rest = [c for c in chunks.columns if c not in (chunk_id, text)]
    whole = F.array(F.struct(F.lit("").alias("s"), F.col(text).alias("t")))
    two = F.array(
        F.struct(F.lit("-a").alias("s"), F.array_join(F.slice(parts, F.lit(1), half), "\n\n").alias("t")),
        F.struct(F.lit("-b").alias("s"), F.array_join(F.slice(parts, half + 1, F.size("_parts")), "\n\n").alias("t")),
    )
    out = chunks.withColumn("_parts", paragraphs(F.col(text)))
    out = out.select(*rest, F.col(chunk_id).alias("_id"), F.explode(F.when(F.size("_parts") >= 2, two).otherwise(whole)).alias("_x"))
    return out.select(F.concat(F.col("_id").cast("string"), F.col("_x.s")).alias(chunk_id), F.col("_x.t").alias(text), *rest)


_PARAGRAPH_END, _SENTENCE_END = re.compile(r"\n\s*\n"), re.compile(r"(?<=[。！？.!?])")


def _quarters(text: str) -> list[int]:
    """Running size of text in quarters of a token: four for a Han character, one for any other."""
    return list(accumulate((4 if "㐀" <= c <= "鿿" else 1 for c in text), initial=0))


def split_oversized(text: str, limit: int) -> list[str]:
    """Pieces of at most limit tokens: paragraphs packed greedily, or sentences where there is only one
    paragraph; a piece still too large is cut at the last character that fits. Sizes are running sums,
    so that a text is measured once."""
    if estimate(text) <= limit:
        return [text]
    room, gap = 4 * limit, "\n\n"
    for end in (_PARAGRAPH_END, _SENTENCE_END):
        units = [u for u in map(str.strip, end.split(text)) if u]
        if len(units) > 1:
            break
    out: list[str] = []
    open_, size = "", 0
    for unit in [*units, ""]:
        grown = _quarters(unit)[-1] + (size + len(gap) if open_ else 0)
        if unit and (grown <= room or not open_):
            open_, size = (f"{open_}{gap}{unit}" if open_ else unit), grown
            continue
        at, sums = 0, _quarters(open_)
        while at < len(open_):
            stop = max(at + 1, bisect_right(sums, sums[at] + room) - 1)
            out.append(open_[at:stop].strip())
            at = next((i for i in range(stop, len(open_)) if not open_[i].isspace()), len(open_))
        open_, size = unit, _quarters(unit)[-1]
    return out


def fold_sorted(rows: DataFrame, scope: list[str], order: list[str], schema: T.StructType | str, start: Callable[[], object]) -> DataFrame:
    """Rows of each scope, in order, through a folder of their own: a streaming fold.

    start() makes a folder with take(row) -> list of output tuples and end() -> list of output tuples.
    Scopes are hash-partitioned and sorted, and a task holds only what its folder holds, so a scope of
    any size passes through without being gathered.
    """
    fields = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder, current = None, None
        for batch in batches:
            made = []
            places = [batch.columns.get_loc(c) for c in scope]
            for row in batch.itertuples(index=False, name=None):
                here = tuple(None if row[p] != row[p] else row[p] for p in places)
                if folder is None or here != current:
                    if folder is not None:
                        made += folder.end()
                    folder, current = start(), here
                made += folder.take(dict(zip(fields, row)))
            if made:
                yield pd.DataFrame(made, columns=out_names)
        if folder is not None and (made := folder.end()):
            yield pd.DataFrame(made, columns=out_names)

    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    out_names = kind.names
    return rows.repartition(*scope).sortWithinPartitions(*scope, *order).mapInPandas(run, kind)


class _Packer:
    """Section-aware packing of one chapter's blocks."""

    def __init__(self, target: int, most: int) -> None:
        self.target, self.most = target, most
        self.rows: list[dict] = []
        self.text = ""

    def _flush(self) -> list[tuple]:
        if not self.rows:
            return []
        first, last = self.rows[0], self.rows[-1]
        covered = list(dict.fromkeys(r["outline_id"] for r in self.rows))
        out = (first["doc"], first["block_no"], last["outline_id"], first["chapter"], covered, [str(r["block_id"]) for r in self.rows], self.text, estimate(self.text))
        self.rows, self.text = [], ""
        return [out]

    def take(self, row: dict) -> list[tuple]:
        made = []
        pieces = split_oversized(row["text"], self.most) if isinstance(row["text"], str) else []
        for i, piece in enumerate(pieces):
            block = row | {"block_id": f"{row['block_id']}-{i:02d}" if len(pieces) > 1 else row["block_id"]}
            joined = f"{self.text}\n\n{piece}" if self.rows else piece
            section = bool(self.rows) and self.rows[-1]["outline_id"] != row["outline_id"]
            if self.rows and (estimate(joined) > self.most or section and estimate(self.text) >= self.target):
                made += self._flush()
                joined = piece
            self.rows.append(block)
            self.text = joined
        return made

    def end(self) -> list[tuple]:
        return self._flush()


def pack_blocks(blocks: DataFrame, target: int = 4000, most: int = 6000) -> DataFrame:
    """Blocks to chunks of at most `most` tokens.

    blocks: doc, chapter, block_no (their order in doc, chapters in one run each), block_id,
    outline_id, text. A chunk ends where a chapter ends, where the next block would exceed `most`, or
    at a section boundary once it has `target` tokens. Blocks beyond `most` are split first. As no
    chunk crosses a chapter, chapters are folded apart, so a long document is spread over tasks.
    Output: doc, first_block_no (which orders a document's chunks), outline_id (of the last block),
    chapter, covered_outline_ids, block_ids, text, token_count. Null texts are left out.
    """
    if not 0 < target <= most:
        raise ValueError("0 < target <= most must hold")
    kind = blocks.schema
    schema = (
        f"doc {kind['doc'].dataType.simpleString()}, first_block_no bigint, outline_id string, chapter {kind['chapter'].dataType.simpleString()}, "
        "covered_outline_ids array<string>, block_ids array<string>, text string, token_count int"
    )
    rows = blocks.select("doc", "chapter", "block_no", "block_id", "outline_id", "text").filter("text is not null")
    return fold_sorted(rows, ["doc", "chapter"], ["block_no"], schema, lambda: _Packer(target, most))


def batch_numbers(rows: DataFrame, scope: list[str], order: list[str], size: str, most_items: int, most_size: int) -> DataFrame:
    """rows with batch_no from 0 in each scope: a batch closes before the item that would make it
    exceed most_items or most_size; an item beyond most_size is a batch of its own."""

    class Batches:
        def __init__(self) -> None:
            self.no, self.items, self.total = 0, 0, 0

        def take(self, row: dict) -> list[tuple]:
            amount = 0 if row[size] != row[size] or row[size] is None else row[size]
            if self.items and (self.items >= most_items or self.total + amount > most_size):
                self.no, self.items, self.total = self.no + 1, 0, 0
            self.items, self.total = self.items + 1, self.total + amount
            return [(*row.values(), self.no)]

        def end(self) -> list[tuple]:
            return []

    schema = T.StructType([*rows.schema.fields, T.StructField("batch_no", T.LongType())])
    return fold_sorted(rows, scope, order, schema, Batches)


def pack_facts(facts: DataFrame, scope: list[str], order: list[str], text: str, size: int = CHUNK_SIZE, most: int = 10) -> DataFrame:
    """(scope…, pack_no, pack_text): facts numbered `[Fact i]: ` and joined by lines, a pack closing
    before size characters (with 12 for each number) or at `most` facts. Null facts are left out."""

    class Packs:
        def __init__(self) -> None:
            self.no, self.facts, self.total, self.scope = 0, [], 0, ()

        def take(self, row: dict) -> list[tuple]:
            self.scope = tuple(row[c] for c in scope)
            made = []
            cost = len(row[text]) + 12
            if self.facts and (self.total + cost > size or len(self.facts) >= most):
                made = self.end()
            self.facts.append(row[text])
            self.total += cost
            return made

        def end(self) -> list[tuple]:
            if not self.facts:
                return []
            body = "\n".join(f"[Fact {i}]: {f}" for i, f in enumerate(self.facts, 1))
            out = (*self.scope, self.no, body)
            self.no, self.facts, self.total = self.no + 1, [], 0
            return [out]

    kinds = ", ".join(f"{c} {facts.schema[c].dataType.simpleString()}" for c in scope)
    rows = facts.select(*dict.fromkeys([*scope, *order, text])).filter(F.col(text).isNotNull())
    return fold_sorted(rows, scope, order, f"{kinds}, pack_no bigint, pack_text string", Packs)


def table_text(cells: DataFrame, table: str, row: str, column: str, text: str) -> DataFrame:
    """(table, table_text): cells joined by ` | ` within rows, rows by lines."""
    lines = cells.groupBy(table, row).agg(F.array_sort(F.collect_list(F.struct(column, F.coalesce(text, F.lit("")).alias("_t")))).alias("_c"))
    lines = lines.select(table, row, F.array_join(F.transform("_c", lambda c: c["_t"]), " | ").alias("_line"))
    whole = lines.groupBy(table).agg(F.array_sort(F.collect_list(F.struct(row, "_line"))).alias("_l"))
    return whole.select(table, F.array_join(F.transform("_l", lambda x: x["_line"]), "\n").alias("table_text"))

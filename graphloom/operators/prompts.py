"""Context of a chunk for an extractor: outline, known terms and text within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import han_letters, token_estimate, tokens
from graphloom.session import cut_lineage

#: Terms that are handed on at most, the last ones.
LAST_TERMS = 24


def last_terms(terms: Column, n: int = LAST_TERMS) -> Column:
    """The last n distinct terms, in the order of their first occurrence."""
    kept = F.array_distinct(terms)
    return F.when(F.size(kept) > n, F.slice(kept, -n, n)).otherwise(kept)


def outline_entries(tree: DataFrame) -> DataFrame:
    """tree, a hierarchy with branches or paths and with scope, id, title and sort_order, with `level` and
    `chapter`: steps from the root, and the entry of level 1 that holds it (null for the root). An entry
    that reaches no root is a chapter of its own, so that none is lost."""
    level = F.when(F.col("status") == "ok", F.col("steps")).otherwise(F.lit(1))
    branch = F.col("branch") if "branch" in tree.columns else F.get("path", F.lit(1))
    chapter = F.when(F.col("status") != "ok", F.col("id")).otherwise(branch)
    return tree.select("scope", "id", "title", "sort_order", level.alias("level"), chapter.alias("chapter"))


#: What ends the current entry's line, and the key of a scope's full outline; a chapter's key is `c` and its id.
CURRENT, _FULL = " <CURRENT>", "f"


def _shown(entries: DataFrame) -> DataFrame:
    """The entries below the root with their line as _line."""
    indent = F.repeat(F.lit("  "), F.greatest(F.lit(0), F.col("level") - 1).cast("int"))
    line = F.concat(indent, F.lit("- ["), F.col("id"), F.lit("] "), F.coalesce("title", F.lit("")))
    return entries.filter("level > 0").select("scope", "id", "sort_order", "level", "chapter", line.alias("_line"))


def _weights(shown: DataFrame) -> DataFrame:
    """(scope, _key, _letters, _han, _part) of every chapter's compact outline and every scope's full one,
    counted line by line, so that no text is made for it. _part: letters of the longer of what is
    gathered for it, the lines of level 1 and those below them."""
    counted = shown.select("scope", "chapter", F.col("level") == 1, (F.length("_line") + 1).cast("long"), han_letters(F.col("_line")).cast("long")).toDF("scope", "chapter", "_top", "_l", "_h")
    some = lambda top, c: F.coalesce(F.sum(F.when(F.col("_top") == top, F.col(c))), F.lit(0))
    chapters = counted.groupBy("scope", "chapter").agg(*[some(top, c).alias(f"{c}{int(top)}") for top in (True, False) for c in ("_l", "_h")])
    scopes = chapters.groupBy("scope").agg(*[F.sum(c).alias(f"_all{c}") for c in ("_l0", "_h0", "_l1", "_h1")])
    compact = chapters.join(scopes, "scope").select("scope", F.concat(F.lit("c"), "chapter").alias("_key"), F.col("_all_l1") + F.col("_l0") - 1, F.col("_all_h1") + F.col("_h0"), F.greatest("_all_l1", "_l0"))
    full = scopes.select("scope", F.lit(_FULL), F.col("_all_l1") + F.col("_all_l0") - 1, F.col("_all_h1") + F.col("_all_h0"), F.col("_all_l1") + F.col("_all_l0"))
    return compact.union(full).toDF("scope", "_key", "_letters", "_han", "_part")


def _texts(shown: DataFrame, kept: DataFrame) -> DataFrame:
    """(scope, _key, _lines) of the outlines in kept (scope, _key): their entries in order, as structs."""
    lines = F.collect_list(F.struct("sort_order", "id", F.col("_line").alias("l")))
    key = F.concat(F.lit("c"), "chapter").alias("_key")
    chapters = kept.filter(F.col("_key") != _FULL)
    tops = shown.filter("level = 1").join(chapters.select("scope").distinct(), "scope", "left_semi").groupBy("scope").agg(lines.alias("_tops"))
    below = shown.filter("level > 1").select("scope", key, "sort_order", "id", "_line").join(chapters, ["scope", "_key"], "left_semi").groupBy("scope", "_key").agg(lines.alias("_own"))
    compact = chapters.join(below, ["scope", "_key"], "left").join(tops, "scope")
    # a chapter without entries below it has the lines of level 1 only
    compact = compact.select("scope", "_key", F.array_sort(F.when(F.col("_own").isNull(), F.col("_tops")).otherwise(F.concat("_tops", "_own"))).alias("_lines"))
    full = shown.join(kept.filter(F.col("_key") == _FULL), "scope", "left_semi").groupBy("scope").agg(F.array_sort(lines).alias("_lines"))
    return compact.unionByName(full.select("scope", F.lit(_FULL).alias("_key"), "_lines"))


def _outline(lines: Column, current: Column) -> Column:
    """The text of an outline, with the current entry's line marked."""
    return F.array_join(F.transform(lines, lambda x: F.when(x["id"] == current, F.concat(x["l"], F.lit(CURRENT))).otherwise(x["l"])), "\n")


def outline_contexts(entries: DataFrame, longest: int = 1_000_000) -> DataFrame:
    """(scope, id, full_outline, compact_outline) for each entry as the current one, from outline_entries().

    full_outline has all entries below the root, an indented line each; compact_outline those of level 1
    and the whole chapter of the current entry, which has its ancestors. The current line ends in
    ` <CURRENT>`. A full outline of more than `longest` letters is null, and a compact one that has more in
    level 1 or in its chapter: no window would hold it. The result is as large as the entries times
    their outlines; fit_outlines() makes one only for the chunks that show it.
    """
    shown = _shown(entries)
    texts = _texts(shown, _weights(shown).filter(F.col("_part") <= longest).select("scope", "_key"))
    full = texts.filter(F.col("_key") == _FULL).select("scope", F.col("_lines").alias("_full"))
    out = entries.select("scope", "id", F.concat(F.lit("c"), "chapter").alias("_key")).join(full, "scope", "left").join(texts, ["scope", "_key"], "left")
    return out.select("scope", "id", _outline(F.col("_full"), F.col("id")).alias("full_outline"), _outline(F.col("_lines"), F.col("id")).alias("compact_outline"))


def scope_lines(sections: Column, paths: Column) -> Column:
    """A line `- [id] a > b` per covered section."""
    return F.array_join(F.zip_with(sections, paths, lambda i, p: F.concat(F.lit("- ["), F.coalesce(i, F.lit("")), F.lit("] "), F.coalesce(F.nullif(F.array_join(p, " > "), F.lit("")), F.lit("(root)")))), "\n")


#: What stands before the outline, the terms and the text.
_HEADS = ("# Outline\n", "\n\n# Known terms\n", "\n\n# Text\n")


def _about(chunks: DataFrame) -> Column:
    """What is known of the document, as the first part of a context."""
    known = {"document": "Document: ", "scope_text": "Sections of the text:\n", "pages": "Pages: "}
    shown = [
        F.concat(F.lit(title), F.coalesce((F.array_join(F.array_sort(F.array_distinct(F.array_compact(c))), ", ") if c == "pages" else F.col(c)), F.lit("")), F.lit("\n"))
        for c, title in known.items()
        if c in chunks.columns
    ]
    return F.concat(F.lit("# Document\n"), *shown, F.lit("\n")) if shown else F.lit("")


def _terms() -> Column:
    """The last terms of a chunk as text."""
    return F.when(F.size("terms") > 0, F.array_join(last_terms(F.col("terms")), ", ")).otherwise("none")


def fit_context(chunks: DataFrame, window: int, reserved: int) -> DataFrame:
    """chunks with `context` and `context_level`: the fullest of three contexts that fits.

    chunks: text, terms (array), compact_outline, full_outline, and where they are known document, scope_text
    (see scope_lines) and pages (array), which go before the outline. An outline that is null has no room
    and fits nothing; without an outline at all it is empty text. Levels: `terms` with the compact
    outline and the last terms, `compact` without the terms, `full` with the full outline and no terms,
    as the last attempt; `none`, with a null context, where nothing fits the window less what is reserved.
    """
    about, terms, none = _about(chunks), _terms(), F.lit("none")
    head = lambda outline, terms: F.concat(about, F.lit(_HEADS[0]), outline, F.lit(_HEADS[1]), terms, F.lit(_HEADS[2]), F.coalesce("text", F.lit("")))
    levels = [("terms", head(F.col("compact_outline"), terms)), ("compact", head(F.col("compact_outline"), none)), ("full", head(F.col("full_outline"), none))]
    room = window - reserved
    fits = [(name, text, F.coalesce(token_estimate(text) <= room, F.lit(False))) for name, text in levels]
    level, context = F.lit("none"), F.lit(None).cast("string")
    for name, text, ok in reversed(fits):
        level, context = F.when(ok, name).otherwise(level), F.when(ok, text).otherwise(context)
    return chunks.withColumns({"context_level": level, "context": context})


def fit_outlines(chunks: DataFrame, entries: DataFrame, window: int, reserved: int) -> DataFrame:
    """chunks with the `context` and `context_level` of fit_context() under the outlines of outline_contexts().

    chunks: as in fit_context(), but with (scope, id) of their current entry in place of outlines; one that
    isn't in entries has an empty outline. Every level's size is told from letters counted by line, so
    an outline's text is made once for its scope or chapter, and meets only the chunks that show it.
    A full outline has all that a compact one has, so only a root's chunks, which have no chapter,
    can show it.
    """
    room = window - reserved
    shown = _shown(entries)
    # a row per chapter, which three joins read
    weights = cut_lineage(_weights(shown).drop("_part"))
    key = F.coalesce(F.concat(F.lit("c"), "chapter"), F.lit(_FULL)).alias("_key")
    sections = chunks.select("scope", "id").distinct().join(entries.select("scope", "id", key), ["scope", "id"])
    sections = sections.join(weights, ["scope", "_key"], "left")
    fitting = weights.filter(tokens(F.col("_letters"), F.col("_han")) <= room).select("scope", "_key")
    # full outlines are made only where a chunk asks for one
    roots = entries.filter("chapter is null").select("scope", "id").join(chunks.select("scope", "id"), ["scope", "id"], "left_semi")
    kept = fitting.filter(F.col("_key") != _FULL).union(fitting.filter(F.col("_key") == _FULL).join(roots, "scope", "left_semi"))

    text, none = F.coalesce("text", F.lit("")), F.lit("none")
    known, full = F.col("_key").isNotNull(), F.coalesce(F.col("_key") == _FULL, F.lit(False))
    rows = chunks.join(sections, ["scope", "id"], "left").withColumns({"_about": _about(chunks), "_terms": _terms()})
    rows = rows.withColumns({
        "_letters": F.when(known, F.col("_letters") + F.when(full, 0).otherwise(len(CURRENT))).otherwise(0) + sum(map(len, _HEADS)) + F.length("_about") + F.length(text),
        "_han": F.when(known, F.col("_han")).otherwise(0) + han_letters(F.col("_about")) + han_letters(text),
        "_terms_han": han_letters(F.col("_terms")),
    })
    with_terms = ~full & (tokens(F.col("_letters") + F.length("_terms"), F.col("_han") + F.col("_terms_han")) <= room)
    without = tokens(F.col("_letters") + len("none"), F.col("_han")) <= room
    rows = rows.withColumn("context_level", F.when(with_terms, "terms").when(without, F.when(full, "full").otherwise("compact")).otherwise("none"))
    # what stands before and after the outline is made first, so that chunks that fit nothing carry no text on
    fits = F.col("context_level") != "none"
    rows = rows.withColumns({
        "_key": F.when(fits & known, F.col("_key")).otherwise(""),
        "_head": F.when(fits, F.concat("_about", F.lit(_HEADS[0]))),
        "_tail": F.when(fits, F.concat(F.lit(_HEADS[1]), F.when(F.col("context_level") == "terms", F.col("_terms")).otherwise(none), F.lit(_HEADS[2]), text)),
    })
    rows = rows.join(_texts(shown, kept), ["scope", "_key"], "left")
    outline = F.when(F.col("_key") == "", "").otherwise(_outline(F.col("_lines"), F.col("id")))
    return rows.select(*chunks.columns, "context_level", F.concat("_head", outline, "_tail").alias("context"))

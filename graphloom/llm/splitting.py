"""Splitting oversized blocks at natural boundaries, wholly in JVM-side regular expressions.

A token is one character of U+3400–U+9FFF, or four other characters. So that a bounded quantifier can
count tokens, a shadow of the text is made in which each such character is followed by three fillers:
then a token is always four units, and .{1,4n} is "at most n tokens" exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CJK = "㐀-鿿"
_FILL = "﷐"
_SPACE = r"[\p{Z}\s﻿]"
#: A core, with the white space behind it, that ends where a stretch ends: at a line break, after 。！？, or
#: after . ! ? where white space follows.
_NATURAL = rf"(?s)(?:[。！？]{_SPACE}*|[.!?]{_SPACE}+|[\r\n]{_SPACE}*)\z"


def token_count(text: Column) -> Column:
    """Tokens of text: CJK characters one each, the others one per four, rounded up; at least 1."""
    wide = F.length(F.regexp_replace(text, f"[^{_CJK}]", ""))
    return F.greatest(F.lit(1), wide + F.ceil((F.length(text) - wide) / 4)).cast("int")


def _units(text: Column) -> Column:
    return F.length(text) + 3 * F.length(F.regexp_replace(text, f"[^{_CJK}]", ""))


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def _pattern(limit: Column, core: Column) -> Column:
    """Alternatives by strength: paragraph, line, sentence, with at least half of the limit used; then
    a line or sentence end anywhere within core, then within the whole limit; white space; characters.

    White space at a piece's ends isn't counted. Possessive runs of white space keep matching linear.
    """
    # rows that a filter drops may still be looked at, so the pattern has to be valid for any limit
    core, limit = F.greatest(F.coalesce(core, F.lit(1)), F.lit(1)), F.greatest(F.coalesce(limit, F.lit(1)), F.lit(1))
    half = F.ceil(core / 2).cast("string")
    core, limit = core.cast("string"), limit.cast("string")
    gap, sentence = r"(?=[\p{Z}\s]|\z)", r"(?<=[。！？])|(?<=[.!?])(?=[\p{Z}\s])"
    return F.concat(
        F.lit(rf"(?s){_SPACE}*+(?:"),
        F.lit(r".{"), half, F.lit(","), core, F.lit(r"}(?=(?:\r\n|\r|\n)[\p{Zs}\t]*(?:\r\n|\r|\n)|\s*\z)|"),
        F.lit(r".{"), half, F.lit(","), core, F.lit(r"}(?=[\r\n]|\s*\z)|"),
        F.lit(r".{"), half, F.lit(","), core, F.lit(rf"}}(?:{sentence})|"),
        F.lit(r".{1,"), core, F.lit(rf"}}(?:(?=[\r\n]|\s*\z)|{sentence})|"),
        F.lit(r".{1,"), limit, F.lit(rf"}}(?:(?=[\r\n]|\s*\z)|{sentence})|"),
        F.lit(r".{"), half, F.lit(","), core, F.lit(rf"}}{gap}|"),
        F.lit(r".{1,"), core, F.lit(rf"}}(?!{_FILL})|.{{1,"), core, F.lit(rf"}}){_SPACE}*+"),
    )


def _strip_fill(shadow: Column) -> Column:
    return F.regexp_replace(shadow, f"([{_CJK}]){_FILL}{{3}}", "$1")


def split_blocks(blocks: DataFrame, text: str, limit: Column, overlap: Column) -> DataFrame:
    """The blocks whose text has more tokens than limit, with cut_kind and an array of pieces.

    A piece is struct(start, text): text has at most limit tokens and no white space at its ends,
    start is its offset in code points. Pieces are in order; each ends at the strongest boundary that
    the limit allows, and begins `overlap` tokens before the place where the last one ended. Where a
    sentence fits the limit only without that overlap, the overlap gives way, not the sentence. All
    text but white space between pieces is in some piece.

    cut_kind is `hard` where some cut is inside a stretch, else `natural`. A core ends inside a stretch
    only where no stretch ends within the limit, so that is where a single stretch exceeds the limit and
    cutting it can't be avoided. Blocks with null, empty or blank text, or a null limit, are never
    oversized. A null overlap is 0; an overlap of the limit or more is one token less than the limit, as
    each piece has to bring something new. Private names are used; other columns of blocks pass through.
    """
    rows = (
        blocks.withColumns({"_limit": limit.cast("int"), "_size": token_count(F.col(text))})
        .filter((F.col("_size") > F.col("_limit")) & (F.col("_limit") > 0) & (F.length(_trim(F.col(text))) > 0))
        .withColumn(
            "_lap", F.least(F.greatest(F.coalesce(overlap.cast("int"), F.lit(0)), F.lit(0)), F.col("_limit") - 1)
        )
    )
    full, lap = 4 * F.col("_limit"), 4 * F.col("_lap")
    shadow = F.regexp_replace(F.col(text), f"([{_CJK}])", f"$1{_FILL}{_FILL}{_FILL}")
    rows = rows.withColumn("_shadow", shadow).withColumn(
        "_cores", F.regexp_extract_all("_shadow", _pattern(full, full - lap), F.lit(0))
    )
    # where each core begins, in the text and in its shadow, by a running sum over the array
    begin = F.struct(F.lit(0).alias("text"), F.lit(0).alias("shadow"))
    starts = F.aggregate(
        "_cores",
        F.array(begin),
        lambda acc, c: F.concat(
            acc,
            F.array(F.struct((F.element_at(acc, -1)["text"] + F.length(_strip_fill(c))).alias("text"), (F.element_at(acc, -1)["shadow"] + F.length(c)).alias("shadow"))),
        ),
    )
    rows = rows.withColumn("_starts", starts)

    def piece(core: Column, i: Column) -> Column:
        body = _trim(core)
        lead = F.regexp_extract(core, f"^{_SPACE}*", 0)
        at = F.get("_starts", i)
        # the lookback reaches over as many cores as the overlap takes
        place = at["shadow"] + F.length(lead)
        back = F.when(i == 0, 0).otherwise(F.least(lap, full - F.length(body), place))
        # a lookback that begins inside a character's fillers begins after them
        head = F.regexp_replace(F.substring(F.col("_shadow"), place - back + 1, back), f"^(?:{_FILL}|{_SPACE})+", "")
        start = at["text"] + F.length(lead) - F.length(_strip_fill(head))
        return F.struct(start.alias("start"), _strip_fill(F.concat(head, body)).alias("text"))

    inside = F.exists(F.slice("_cores", F.lit(1), F.greatest(F.size("_cores") - 1, F.lit(0))), lambda c: ~c.rlike(_NATURAL))
    rows = rows.withColumns(
        {
            "cut_kind": F.when(inside, "hard").otherwise("natural"),
            "pieces": F.filter(F.transform("_cores", piece), lambda p: F.length(p["text"]) > 0),
        }
    )
    return rows.drop("_limit", "_size", "_lap", "_shadow", "_cores", "_starts")


def explode_pieces(split: DataFrame, keep: list[str]) -> DataFrame:
    """One row per piece: keep, piece_no from 0, piece_start and piece_text."""
    return split.select(*keep, "cut_kind", F.posexplode("pieces").alias("piece_no", "_piece")).select(
        *keep,
        "cut_kind",
        "piece_no",
        F.col("_piece.start").alias("piece_start"),
        F.col("_piece.text").alias("piece_text"),
    )

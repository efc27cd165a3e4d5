import math
import re

import pytest
from pyspark.sql import functions as F

from graphloom.llm.splitting import explode_pieces, split_blocks, token_count

SPACE = " \n\r\t 　﻿"


def tokens(t):
    han = len(re.findall("[㐀-鿿]", t))
    return max(1, han + math.ceil((len(t) - han) / 4))


def stretches(t):
    return [s for x in re.split(r"(?<=[。！？])|(?<=[.!?])(?=\s)|[\r\n]", t) if (s := x.strip(SPACE))]


TEXTS = [
    "One sentence here. " * 30,
    "中文句子在这里，后面还有。" * 30,
    "Mixed 中文 text! With marks? " * 20 + "\r\n\r\n" + "x" * 500,
    "line\n" * 200,
    "a" * 900,
    "中" * 300 + "。尾。",
    "First paragraph with words.\n\nSecond one.\n \nThird 😀 one 😀 end. " * 9,
    "short",
    "",
    "   \n  ",
    None,
    "3.14 is no end. e.g. this " * 40,
]


@pytest.mark.parametrize("limit, lap", [(40, 4), (25, 0), (60, 59), (10, 3), (30, 20), (12, 90)])
def test_pieces_round_trip(spark, limit, lap):
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(TEXTS)], "block_id int, text string, pieces_note string")
    got = {r.block_id: r for r in split_blocks(df, "text", F.lit(limit), F.lit(lap)).collect()}
    assert set(got) == {i for i, t in enumerate(TEXTS) if t and t.strip(SPACE) and tokens(t) > limit}
    for i, r in got.items():
        t = TEXTS[i]
        assert r.pieces_note == "kept"
        assert r.cut_kind == ("hard" if any(tokens(s) > limit for s in stretches(t)) else "natural")
        end = 0
        for n, p in enumerate(r.pieces):
            assert t[p.start : p.start + len(p.text)] == p.text and tokens(p.text) <= limit and p.text == p.text.strip(SPACE)
            assert not t[end : p.start].strip(SPACE)
            if n:
                assert tokens(t[p.start : end]) <= min(lap, limit - 1) + 1 or p.start >= end
                # the overlap is whole but for white space at its beginning, or the piece is full
                got_lap = tokens(t[p.start : end]) if p.start < end else 0
                room = limit - tokens(t[end : p.start + len(p.text)])
                head = t[:end].rstrip(SPACE)
                cut = t[max(0, p.start - 8) : p.start]
                assert got_lap >= min(min(lap, limit - 1), room) - 1 or not cut.strip(SPACE) or p.start == 0 or head == "", (i, n, got_lap, lap, room)
            end = p.start + len(p.text)
            if r.cut_kind == "natural" and n < len(r.pieces) - 1:
                following = t[end : end + 1]
                assert p.text[-1] in "。！？" or following in "\r\n" or p.text[-1] in ".!?" and following.isspace()
        assert not t[end:].strip(SPACE)


def test_odd_limits_and_tokens(spark):
    df = spark.createDataFrame([(1, "some words here that go on", None, 2), (2, "other words here", 0, 2), (3, "more words here for it", 3, None)], "id int, text string, lim int, lap int")
    assert {r.id for r in split_blocks(df, "text", F.col("lim"), F.col("lap")).collect()} == {3}
    assert explode_pieces(split_blocks(df, "text", F.col("lim"), F.col("lap")), ["id"]).count() >= 2
    assert [r.n for r in df.select(token_count(F.col("text")).alias("n")).collect()] == [tokens(r.text) for r in df.collect()]
    assert split_blocks(df.limit(0), "text", F.lit(5), F.lit(1)).count() == 0

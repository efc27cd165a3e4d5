import random

import pytest

from graphloom.llm import leakage

WORDS = "valve pump seal rotor housing bearing oil filter cooling pressure signal sensor gauge flange shaft motor belt drive clutch brake".split()


def sentence(rng, n=14):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def case():
    rng = random.Random(3)
    items = [(900 + i, "Read the passage and answer.\n" + " ".join(sentence(rng) for _ in range(4))) for i in range(30)]
    zh = "判断是否成立。" + "".join("".join(rng.choice("气血阀门压力泵轴承密封冷却信号传感润滑") for _ in range(24)) + "。" for _ in range(4))
    return rng, [*items, (999, zh)]


def test_whole_partly_and_altered_passages(spark, case):
    rng, items = case
    part = {i: leakage._SENTENCE.split(t) for i, t in items}
    s = lambda i, *n: " ".join(part[i][k] for k in n)
    zh = [x for x in leakage._SENTENCE.split(items[-1][1]) if x]
    fill = lambda: " ".join(sentence(rng) for _ in range(6))
    wrapped = s(903, 1, 2).replace(" ", "\n", 9).upper()
    changed = s(904, 2, 3).split()
    changed[5] = "another"
    docs = [
        (1, fill() + " " + s(900, 1, 2, 3, 4) + " " + fill()),
        (2, fill() + " " + s(901, 2) + " " + fill()),
        (3, "Read the passage and answer. " + fill()),
        (4, fill() + wrapped),
        (5, " ".join(changed)),
        (6, fill() + s(905, 1) + " [12] (see overleaf) " + s(905, 2)),
        (7, s(906, 1) + " " + fill() + " " + s(906, 3)),
        (8, "前文很长。" + zh[2] + "\n" + zh[3] + "后文。"),
        (9, zh[1] + "别的内容在中间，而且很长很长很长很长。" * 9 + zh[3]),
        (10, s(907, 1, 2)[:-40]),
        (11, None),
        (12, ""),
        (1, fill()),
    ]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    e = spark.createDataFrame([*items, (998, None), (997, ""), items[0]], "item_id long, item_text string")
    got = {tuple(r) for r in leakage.leaks(d, e).collect()}
    assert got == {(1, 900), (4, 903), (5, 904), (6, 905), (8, 999)}
    assert leakage.leaks(d, e.limit(0)).count() == 0 and leakage.leaks(d.limit(0), e).count() == 0


def test_items_in_blocks_give_the_same(spark, case):
    _, items = case
    d = spark.createDataFrame([(i, t) for i, t in items], "doc_id long, text string")
    e = spark.createDataFrame(items, "item_id long, item_text string")
    whole = {tuple(r) for r in leakage.leaks(d, e).collect()}
    assert leakage.matchers(e, 7).count() > 1
    assert {tuple(r) for r in leakage.leaks(d, e, per_block=7).collect()} == whole == {(i, i) for i, _ in items}


def test_search_finds_every_occurrence(case):
    rng, items = case
    m = leakage.Matcher(items)
    codes = leakage.fold(" ".join(t for _, t in items))
    text = leakage._text(codes)
    for kind in (m.latin, m.han):
        start, rank = kind.search(codes)
        known = {leakage._text(row) for row in kind.codes}
        got = {(a, leakage._text(kind.codes[r])) for a, r in zip(start.tolist(), rank.tolist())}
        assert got == {(i, text[i : i + kind.m]) for i in range(len(text)) if text[i : i + kind.m] in known}


def test_ligatures_accents_and_composition_do_not_matter(case):
    import unicodedata

    de = "Lesen Sie den Text. Der fünfte Prüfling öffnete die äußere Schleuse über dem großen Kessel. Danach hörte der Wärter das Geräusch der schweren Flügeltür."
    en = "Read this. The first officer offered a firm confirmation of the final figures in the file. The staff then filed the affidavit with the chief auditor."
    m = leakage.Matcher([(1, de), (2, en)])
    spaced = en.replace("ffi", "\ufb03").replace("fi", "\ufb01").replace("ff", "\ufb00")
    docs = [unicodedata.normalize("NFD", de), unicodedata.normalize("NFC", de), de.replace("ß", "ss"), spaced, en.replace("e", "e\u200b")]
    assert list(m.documents(docs)) == [(0, 1), (1, 1), (2, 1), (3, 2), (4, 2)]
    assert leakage._text(leakage.fold("\ufb01rst \ufb03 Ｆｕｌｌ \U0001f600 Stra\u00dfe")) == "firstffifullstrasse"


def test_two_short_neighbours(case):
    m = leakage.Matcher([(1, "Say what you see. Cats sleep. Dogs bark. Birds fly."), (2, "读下文。猫睡。狗叫。鸟飞。"), (3, "Go. A b. C d.")])
    docs = ["At night cats  sleep -- dogs bark and all is well.", "At night cats sleep, and then the dogs bark.", "夜里猫睡，狗叫。", "夜里猫睡了狗也叫", "x dogs bark, birds fly", "a b c d", None, ""]
    assert list(m.documents(docs)) == [(0, 1), (2, 2), (4, 1), (5, 3)]

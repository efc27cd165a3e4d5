import pytest

from graphloom.llm.mixing import mix, source_key
from graphloom.llm.tokens import count_tokens

TARGETS = "source string, target_share double, max_repeats int"


@pytest.fixture
def tables(spark):
    d = [(i, "a", 10) for i in range(1000)] + [(2000 + i, "b", 7) for i in range(30)] + [(3000 + i, "other", 5) for i in range(9)] + [(4000, None, 5), (4001, "b", None)]
    t = [("a", 0.5, 1), ("b", 0.3, 4), ("empty", 0.2, 2), ("b", 0.3, 4)]
    return spark.createDataFrame(d, "doc_id long, source string, n_tokens int").repartition(5), spark.createDataFrame(t, TARGETS)


def test_default_total_fills_every_share(tables):
    uses, shares = mix(*tables)
    by = {r.source: r for r in shares.collect()}
    assert by["b"].used_tokens == 840 == by["b"].budget_tokens and by["a"].used_tokens == 1400 and by["empty"].used_tokens == 0
    rows = uses.collect()
    assert all(r.n_uses <= (1 if r.source == "a" else 4) for r in rows) and {r.source for r in rows} == {"a", "b"}
    assert len({r.doc_id for r in rows}) == len(rows)
    assert {(r.doc_id, r.n_uses) for r in rows} == {(r.doc_id, r.n_uses) for r in mix(*tables)[0].collect()}
    assert {r.doc_id for r in rows if r.source == "a"} != {r.doc_id for r in mix(*tables, seed=8)[0].collect() if r.source == "a"}


def test_larger_total_uses_what_there_is(tables):
    uses, shares = mix(*tables, total_tokens=3000)
    by = {r.source: r for r in shares.collect()}
    assert by["a"].used_tokens == 1500 and by["b"].used_tokens == 840 and by["b"].budget_tokens == 900
    assert abs(sum(r.actual_share for r in by.values()) - 1) < 1e-9
    assert sum(r.n_tokens * r.n_uses for r in uses.collect()) == 2340


def test_empty_tables(tables):
    d, t = tables
    assert mix(d.limit(0), t)[0].count() == 0 and {r.used_tokens for r in mix(d.limit(0), t)[1].collect()} == {0}
    assert mix(d, t.limit(0))[1].count() == 0


def test_source_names_and_tokens(spark):
    df = spark.createDataFrame([(" Annual report\t",), ("ANNUAL_REPORT",), ("annual-report",), (" ",), (None,)], "s string")
    assert [r.k for r in df.select(source_key(df.s).alias("k")).collect()] == ["annual_report"] * 3 + [None, None]
    texts = spark.createDataFrame([("",), (None,), ("hello world",), ("x" * 50_000,)], "t string")
    n = [r.n for r in texts.select(count_tokens(texts.t).alias("n")).collect()]
    assert n[:3] == [0, 0, 2] and n[3] > 1000

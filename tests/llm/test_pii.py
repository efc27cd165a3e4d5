import itertools
import os
import random

import pytest

from graphloom.llm import pii, train_pii

MODEL = pii.Model.load()


def found(text):
    return {(text[a:b], kind) for a, b, kind in pii.decode(MODEL, text)}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("For questions, write to Nuria Oakhurst at n.oak@quillpost.test or call +1 555 555 0174.", {("Nuria Oakhurst", "name"), ("n.oak@quillpost.test", "email"), ("+1 555 555 0174", "phone")}),
        ("Please keep SSN 666-36-7572 on file and confirm by mail to eldric.c [at] quillpost [dot] test.", {("666-36-7572", "id_number"), ("eldric.c [at] quillpost [dot] test", "email")}),
        ("Patient: Grelling, Thessaly, residing at Flat 5, 481 Swallowtail Drive, Veldhurst 00123, identity no. X84911205.", {("Grelling, Thessaly", "name"), ("Flat 5, 481 Swallowtail Drive, Veldhurst 00123", "street_address"), ("X84911205", "id_number")}),
        ("Frau E. Pemberlow wohnt in Mühlenallee 40, 98639 Neustedt.", {("E. Pemberlow", "name"), ("Mühlenallee 40, 98639 Neustedt", "street_address")}),
        ("联系人：顾若言，电话（0600）5572396，邮箱a.b@quillpost.test。", {("顾若言", "name"), ("（0600）5572396", "phone"), ("a.b@quillpost.test", "email")}),
        ("患者秦慕望，身份证号995364196111101496，现住南漪省松原市桐花巷267号4单元368室。", {("秦慕望", "name"), ("995364196111101496", "id_number"), ("南漪省松原市桐花巷267号4单元368室", "street_address")}),
        ("The Halmorsen 58 procedure and the Brenlund 31 scale are described below.", set()),
        ("Order no. 4500-118-40 was closed on 2024-03-15. Lot 202400340048 passed. Use @outline 42.", set()),
        ("样品编号202403226已归档。海默森20步法与布伦德30级量表见下文。", set()),
        ("", set()),
    ],
)
def test_mentions(text, expected):
    assert found(text) == expected


def test_redaction_keeps_all_other_text():
    text = "Signed: Kestra Oakhurst\n\nThe 😀 pump is shut; mobile 555.555.0186."
    spans = pii.decode(MODEL, text)
    out = pii.redact(text, spans)
    assert out == "Signed: [NAME]\n\nThe 😀 pump is shut; mobile [PHONE]."


def test_decoding_is_the_best_of_all_segmentations():
    rng = random.Random(2)
    text = "Signed: Nuria Oakhurst, Selka M. Grelling; call 555.555.0186 or 666-36-7572."
    spans = pii.candidates(MODEL, text)
    for _ in range(5):
        model = pii.Model({f: rng.uniform(-2, 2) for c in spans for f in c[3]}, MODEL.background, MODEL.first, MODEL.last, MODEL.given)
        best = 0.0
        small = sorted(spans)[:12]
        for r in range(4):
            for pick in itertools.combinations(small, r):
                if all(a[1] <= b[0] for a, b in itertools.pairwise(pick)):
                    best = max(best, sum(pii.score(model, c[3]) for c in pick))
        chosen = pii.decode(model, text)
        value = sum(max(pii.score(model, c[3]) for c in spans if c[:3] == s) for s in chosen)
        assert value >= best - 1e-9
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(chosen))


def test_gradient_against_differences():
    text = "Signed: Nuria Oakhurst, Selka Grelling and 555.555.0186"
    spans, near = train_pii._lattice(MODEL, text)
    rng = random.Random(1)
    names = sorted({f for s in spans for f in s[3]} | {f for n in near for _, f in n})
    weights = {f: rng.uniform(-0.4, 0.4) for f in names}
    gold = train_pii.silver(MODEL, text)

    def likelihood(w):
        own = [sum(w.get(f, 0) for f in s[3]) for s in spans]
        total = gold_score = 0.0
        import math

        for r in range(len(spans) + 1):
            for pick in itertools.combinations(range(len(spans)), r):
                if all(spans[a][1] <= spans[b][0] for a, b in itertools.pairwise(pick)):
                    v = sum(own[i] for i in pick) + sum(w.get(f, 0) for a, b in itertools.pairwise(pick) for j, f in near[b] if j == a)
                    total += math.exp(v)
                    if {spans[i][:3] for i in pick} == gold:
                        gold_score = v
            if r > 4:
                break
        return gold_score - math.log(total)

    if len(spans) <= 16:
        grad = train_pii.gradient(weights, spans, near, gold)
        for f in rng.sample(names, 6):
            up, down = dict(weights), dict(weights)
            up[f] += 1e-4
            down[f] -= 1e-4
            assert abs((likelihood(up) - likelihood(down)) / 2e-4 - grad.get(f, 0.0)) < 0.05, f


def test_tables(spark):
    df = spark.createDataFrame([(1, "Signed: Nuria Oakhurst", "x"), (1, "Signed: Nuria Oakhurst", "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, pii_type string")
    assert [tuple(r) for r in pii.mentions(df).collect()] == [(1, "name", 8, 22)]
    assert {(r.doc_id, r.text, r.n_mentions) for r in pii.redacted(df).collect()} == {(1, "Signed: [NAME]", 1), (2, None, 0), (3, "", 0)}
    assert pii.mentions(df.limit(0)).count() == 0


def test_a_very_long_text_is_labelled_whole():
    text = "The pump is shut and the valve is open. " * 5000 + "Signed: Nuria Oakhurst"
    assert found(text) == {("Nuria Oakhurst", "name")}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_agrees_with_narrow_rules_on_other_documents():
    import pyarrow.parquet as pq

    right = labelled = given = 0
    for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist():
        gold, got = train_pii.silver(MODEL, t), set(pii.decode(MODEL, t))
        right, labelled, given = right + len(gold & got), labelled + len(gold), given + len(got)
    assert right >= 0.97 * labelled and right >= 0.97 * given


def test_chinese_names_of_any_given_letters_and_compound_families():
    m = pii.Model.load()
    found = lambda t: [(t[a:b], k) for a, b, k in pii.decode(m, t)]
    assert found("患者诸葛明，电话13812345678。")[0] == ("诸葛明", "name")
    assert found("证人施耐庵陈述，事情如下。") == [("施耐庵", "name")]
    assert found("黄芪和陈皮的温度、张力与高效液相。") == []
    few = {c[:3] for c in pii.candidates(m, "证人施耐庵陈述", every=False)}
    assert few <= {c[:3] for c in pii.candidates(m, "证人施耐庵陈述")} and (2, 5, "name") in few

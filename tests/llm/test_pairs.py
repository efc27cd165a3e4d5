import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import pairs

EN, ZH = "Explain why the valve matters for the pump.", "请说明阀门为什么重要。"
LONG = "The valve keeps the pressure in the pump within its limits. It also protects the seals from wear."


@pytest.mark.parametrize("answer", [None, "", " \n", "N/A", "无", "{}", "```json\n```", '{"answer": ""}', '{"answer": null}', "<answer></answer>", "Answer:", "—", "​", "...", "[]"])
def test_empty(answer):
    assert pairs.defect(EN, None, answer) == "empty"


@pytest.mark.parametrize("answer", [EN, EN.upper(), f'{{"answer": "{EN}"}}', f"> {EN}", f"Question: {EN}", f"{EN}\n\n{EN}", EN[:-1], "“" + EN + "”", EN.replace("the valve", "valve")])
def test_copy(answer):
    assert pairs.defect(EN, None, answer) == "copy"


def test_question_with_an_answer_is_no_copy():
    assert pairs.defect(EN, None, f"{EN}\n\n{LONG}") is None


@pytest.mark.parametrize(
    "answer",
    ["I'm sorry, but I can't help with that request.", "**I must decline to answer. Please consult the course team instead.**", '{"error": "Lo siento, pero no puedo ayudar con esta petición.", "nodes": []}', "很抱歉，我无法回答这个问题。如有其他问题，欢迎继续提问。", "Leider darf ich diese Frage nicht beantworten.", "Je ne peux pas répondre à cette question."],
)
def test_refusal(answer):
    assert pairs.defect(EN, None, answer) == "refusal"


@pytest.mark.parametrize("answer", [f'One clause reads "I cannot accept the valve", and the commentary explains it. {LONG}', f"Sorry states of the valve are not unusual. {LONG}"])
def test_quoted_refusals_are_none(answer):
    assert pairs.defect(EN, None, answer) is None


@pytest.mark.parametrize(
    "answer",
    [LONG[:-20], LONG[:60] + "…", LONG[:60] + " [truncated]", "There are three points.\n1. The first is this.\n2. The second is that.", '{"nodes": [{"name": "A", "summary": "It is', "```json\n{\"a\": 1}", "The bearing of a pump wears, e.g."],
)
def test_truncated(answer):
    assert pairs.defect(EN, None, answer) == "truncated"


@pytest.mark.parametrize("answer", [LONG, "- Valve Seat Rule\n- Pump Seal Method", '{"nodes": [{"name": "Valve", "summary": "It is of use."}]}', "There are two points.\n1. The first is this.\n2. The second is that.", "He said it is over (and so it was)."])
def test_complete_answers(answer):
    assert pairs.defect(EN, None, answer) is None


def test_language_asked_for():
    de = "Das Ventil hält den Druck in der Pumpe und ist wichtig für die Dichtung."
    assert pairs.defect(EN, None, de) == "wrong_language"
    assert pairs.defect(EN, "Always answer in German.", de) is None
    assert pairs.defect("Translate the following text into German:\nThe valve is shut.", None, de) is None
    assert pairs.defect("请把下面的文字翻译成德文：\n阀门关闭。", None, de) is None
    assert pairs.defect(ZH, "你是助手，请用提问的语言作答。", LONG) == "wrong_language"
    assert pairs.defect(ZH, None, '{"nodes": [{"name": "阀门规则", "summary": "它控制压力。"}]}') is None


def test_language_asked_for_after_the_passage():
    passage = "The valve is a part of the pump, and it keeps the pressure in the limits. " * 9
    de = "Das Ventil hält den Druck in der Pumpe und ist wichtig für die Dichtung."
    assert pairs.defect(f"Summarise the passage:\n{passage}\nPlease answer in German.", None, de) is None
    assert pairs.defect(f"Summarise the passage:\n{passage}\nPlease answer in German.", None, LONG) == "wrong_language"
    assert pairs.defect(f"Summarise the passage:\n{passage}\nHe said “answer in German” to all.", None, LONG) is None
    assert pairs.defect(f"{'Consider the pump and its parts and all that belongs to them, ' * 8} and then answer in German: {passage}", None, de) is None
    assert pairs.defect("La valvola è una parte della pompa. Perché è importante?", None, "La valvola tiene la pressione nei limiti ed è importante per la tenuta della pompa.") is None
    assert pairs.defect("Pourquoi la vanne est-elle importante pour la pompe ?", None, "La valvola tiene la pressione nei limiti ed è importante anche per la tenuta.") == "wrong_language"


def test_announced_lists_anywhere():
    lead = "The pump has been looked at from all sides, and the valve as well, before this answer was written down for you. "
    short = "There are three points.\n1. The first is this.\n2. The second is that."
    assert pairs.defect(EN, None, lead + short) == "truncated"
    assert pairs.defect(EN, None, lead + short + "\n3. The third is it.") is None
    assert pairs.defect(EN, None, lead + "There are three points in it. They are not given here.\n1. A list of two.\n2. It is whole.") is None


def test_refusals_are_read_to_the_end():
    refusal, other = "I cannot answer this question. " * 200, "The valve is shut at night. " * 80
    assert pairs.defect(EN, None, refusal + other) == pairs.defect(EN, None, other + refusal) == "refusal"
    assert pairs.defect(EN, None, "Answering that would breach my policy, so no reply will be given.") == "refusal"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_lcs_against_the_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert pairs.lcs_length(a, b) == t[-1][-1]


def test_tables_with_nulls_repeats_and_missing_requests(spark):
    messages = "request_id string, messages array<struct<role string, content string>>"
    q = spark.createDataFrame([("a", [("user", "old"), ("assistant", "x"), ("user", EN)]), ("a", [("user", "old"), ("assistant", "x"), ("user", EN)]), ("b", []), (None, []), ("c", None)], messages)
    r = spark.createDataFrame([(1, "a", EN, "x"), (1, "a", EN, "x"), (2, "a", LONG, "x"), (3, "zz", None, "x"), (4, "b", None, "x"), (5, "c", LONG, "x"), (6, None, None, "x")], "response_id long, request_id string, final_text string, messages string")
    assert {tuple(x) for x in pairs.broken_pairs(q, r).collect()} == {(1, "copy"), (4, "empty")}
    assert pairs.broken_pairs(q.limit(0), r).count() == 0

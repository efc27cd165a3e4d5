"""Defects of prompt and response pairs: empty, copied, refused, truncated or in another language.

The prompt's and the answer's tokens are aligned by shingle containment and by the longest common
subsequence, for copies with each other and for refusals with templates. Only text statistics follow
for the other defects. Each pair is judged alone, in Arrow batches on the executors.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMPTY, COPY, REFUSAL, TRUNCATED, WRONG_LANGUAGE = "empty", "copy", "refusal", "truncated", "wrong_language"

# --- fixed values: words that stand where an answer is missing
NOTHING = {"n/a", "na", "none", "null", "nil", "nan", "undefined", "empty", "no answer", "no content", "answer", "response", "output", "tbd", "todo", "无", "暂无", "没有", "空", "答", "答案", "回答", "keine", "leer", "aucun", "aucune", "vide", "ninguno", "ninguna", "vacío", "antwort", "réponse", "respuesta"}

# --- fixed values: sentences that decline, and courtesies that come with them, by language
REFUSALS = [
    "I cannot answer this question", "I can't help with that request", "I am unable to comply with this instruction",
    "I must decline to answer", "I'm not able to process this passage", "I cannot provide an answer to this",
    "this is something I won't do", "that falls outside of what I can assist with", "it would not be appropriate for me to respond here",
    "I do not feel comfortable summarising this material", "I am not allowed to discuss this topic", "I have to refuse this request",
    "I can not do that", "I won't be able to answer that", "I will not answer this", "I am not in a position to answer",
    "Answering that would breach my policy", "no reply will be given", "this request goes against my guidelines", "I have been told not to answer questions of this kind",
    "I would rather not answer this", "no answer can be given to this request", "I must refrain from answering",
    "我无法回答这个问题", "我不能提供相关内容", "我不便对此作出回应", "这个请求超出了我的能力范围", "根据规定我必须拒绝处理该段落",
    "我不能协助完成这项请求", "我没有办法回答您的问题", "恕我不能回答", "我拒绝回答该问题",
    "Ich kann diese Frage nicht beantworten", "dabei kann ich nicht helfen", "Leider darf ich diese Frage nicht beantworten",
    "Ich muss die Bearbeitung dieses Abschnitts ablehnen", "Das kann ich leider nicht tun", "Ich bin nicht in der Lage zu antworten",
    "Je ne peux pas répondre à cette question", "Je dois refuser de traiter ce passage", "je ne suis pas en mesure d'aider ici",
    "Je ne peux pas vous aider avec cette demande", "Il m'est impossible de répondre",
    "No puedo responder a esta pregunta", "no puedo ayudar con esta petición", "Lamentablemente no me es posible responder",
    "Debo rechazar esta solicitud", "No estoy en condiciones de ayudar",
    "Non posso rispondere a questa domanda", "Mi dispiace ma non posso aiutare con questa richiesta", "Não posso responder a esta pergunta", "Ik kan deze vraag niet beantwoorden",
]
COURTESIES = [
    "I am sorry", "I'm sorry", "Sorry", "I apologise", "Unfortunately", "I'm afraid", "As an assistant", "Thank you for the question", "However",
    "My guidelines do not allow it", "Please consult the course team instead", "You may want to ask a qualified person",
    "Let me know if there is anything else you need", "Is there anything else I can help with",
    "抱歉", "很抱歉", "对不起", "感谢您的提问", "但是", "请咨询课程负责人", "如有其他问题 欢迎继续提问", "请换一个问题",
    "Es tut mir leid", "Leider", "Bitte wenden Sie sich an das Kursteam", "Vielen Dank für die Frage",
    "Désolé", "Je regrette", "Malheureusement", "Merci pour la question", "Veuillez consulter l'équipe du cours",
    "Lo siento", "Lamentablemente", "Gracias por la pregunta", "Por favor consulte al equipo del curso",
]

# --- fixed values: function words by language
STOPWORDS = {
    "en": "the a an of and to in is are was were that this it with for on as by at from or not only which when what where how its about be has have if no each both between before after over yet then because whether than most mostly few near under without there these those into will should".split(),
    "de": "der die das und ist ein eine einen einem einer den dem des nicht mit auch für auf im in zu zur zum von sich dass wie als was warum man wird wurde sind bei vor nach oder nur aus an es hier ohne wichtig steht gibt welche beim durch über".split(),
    "fr": "le la les l un une des de du d et est sont que qu qui dans pour avec en au aux ce cette il ne pas sans rien plus aussi on sur par ou où se cas entre deux comme chaque après avant être reste".split(),
    "it": "il lo la gli le un una uno di del della dei delle e è sono che non per con nel nella al alla da dal si più anche come questo questa ma su tra fra quando dove perché essere ogni senza".split(),
    "pt": "o a os as um uma de do da dos das e é são que não para com em no na nos nas ao à por se mais também como este esta mas sobre entre quando onde porque ser cada sem depois antes".split(),
    "nl": "de het een en van in is zijn dat die niet met ook voor op te bij aan om er wordt worden als maar uit naar door over deze dit tussen wanneer waar omdat elke zonder na".split(),
    "es": "el la los las un una unos y es son que en de del al se con por para no nada sin también más como este esta caso lo su entre cada antes después qué cuando sigue siendo dos sobre ser está están".split(),
}
_BY_WORD: dict[str, set[str]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in _words:
        _BY_WORD.setdefault(_w, set()).add(_lang)
#: A word that several languages share counts for each of them in part.
_STOP = {w: [(lang, 1.0 / len(by)) for lang in sorted(by)] for w, by in _BY_WORD.items()}

# --- fixed values: names of languages, as they are asked for
LANGUAGE_NAMES = {
    "en": "english|englisch|anglais|inglés|英文|英语|英語",
    "zh": "chinese|mandarin|chinesisch|chinois|chino|中文|汉语|中国话|漢語",
    "de": "german|deutsch|allemand|alemán|德文|德语|德語",
    "fr": "french|französisch|français|francés|法文|法语|法語",
    "es": "spanish|spanisch|espagnol|español|西班牙文|西班牙语|西班牙語|西语",
    "it": "italian|italienisch|italien|italiano|意大利文|意大利语",
    "pt": "portuguese|portugiesisch|portugais|portugués|português|葡萄牙文|葡萄牙语",
    "nl": "dutch|niederländisch|néerlandais|neerlandés|nederlands|荷兰文|荷兰语",
}
_ASKED = {lang: re.compile(rf"(?:\b(?:in|into|to|auf|ins|en|al|a|vers|use|using)\s+(?:the\s+)?|翻译成|翻译为|译成|译为|用|以|使用)\s*(?:{names})", re.I) for lang, names in LANGUAGE_NAMES.items()}

_HAN = "㐀-鿿"
_TOKEN = re.compile(rf"[{_HAN}]|[^\W_{_HAN}]+(?:['’][^\W_]+)*")
_INVISIBLE = re.compile(r"[​-‏⁠﻿­‪-‮]")
_FENCE = re.compile(r"^\s*```[\w+-]*[ \t]*\n?(.*?)\n?\s*(?:```\s*)?$", re.S)
_TAGS = re.compile(r"</?[A-Za-z][\w-]*\s*/?>")
_LABEL = re.compile(r"^\s*(?:>+\s*|(?:answer|response|output|question|q|a|frage|antwort|réponse|pregunta|respuesta|问题?|答案?|回答)\s*[:：]\s*)+", re.I)
_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"?(\s*:)?')


def tokens(text: str) -> list[str]:
    """Lower-case words, and Han characters one by one."""
    return _TOKEN.findall(unicodedata.normalize("NFKC", text).lower().replace("’", "'"))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over b's tokens."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        u = row & at.get(x, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def containment(part: list[str], whole: list[str], k: int = 5) -> float:
    """Share of part's k-token shingles that whole has; shorter texts use their own length."""
    k = min(k, len(part), len(whole))
    if k == 0:
        return 0.0
    there = {tuple(whole[i : i + k]) for i in range(len(whole) - k + 1)}
    mine = [tuple(part[i : i + k]) for i in range(len(part) - k + 1)]
    return sum(s in there for s in mine) / len(mine)


def json_strings(text: str) -> list[str] | None:
    """The string values (not keys) of text if it begins as JSON, whether complete or not."""
    t = text.strip()
    if t[:1] not in "{[" or not t:
        return None
    return [m[1] for m in _STRING.finditer(t) if m[2] is None]


def unfence(text: str) -> tuple[str, bool]:
    """text without a code fence around it, and whether a fence was opened but not closed."""
    t = text.strip()
    if not t.startswith("```"):
        return t, False
    found = _FENCE.match(t)
    return (found[1] if found else t).strip(), not (t.endswith("```") and len(t) > 5)


def bare(text: str | None) -> str:
    """What an answer says, without fences, tags, quoting marks, labels and JSON around it."""
    if text is None:
        return ""
    t = unfence(_INVISIBLE.sub("", text))[0]
    t = _TAGS.sub(" ", t).strip()
    values = json_strings(t)
    if values is not None:
        t = "\n".join(values)
    t = re.sub(r"(?m)^\s*>+\s?", "", t)
    return _LABEL.sub("", t).strip().strip("*_`\"“”„«»'‘’ \t\r\n")


def _says_nothing(text: str) -> bool:
    said = re.sub(r"[\W_]+", " ", unicodedata.normalize("NFKC", text).lower()).strip()
    return not said or said in NOTHING or said.replace(" ", "/") in NOTHING


def _leaves(value: object) -> Iterator[object]:
    if isinstance(value, dict):
        value = list(value.values())
    if isinstance(value, list):
        for x in value:
            yield from _leaves(x)
    elif value is not None:
        yield value


def is_empty(text: str | None, said: str | None = None) -> bool:
    """No content, whatever stands in its place. JSON has content if one of its values has; JSON that
    breaks off after a key has begun an answer. said is bare(text), where it is known."""
    said = bare(text) if said is None else said
    whole = unfence(_INVISIBLE.sub("", text or ""))[0]
    if whole[:1] in ("{", "["):
        try:
            return all(isinstance(x, str) and _says_nothing(x) for x in _leaves(json.loads(whole)))
        except ValueError:
            return _says_nothing(said) and not re.search(r'"\s*:', whole)
    return _says_nothing(said)


def is_copy(prompt: list[str], answer: list[str]) -> bool:
    """The answer is the prompt, or nearly all of it, once or several times, and nothing else."""
    if not prompt or not answer or len(answer) < 0.8 * len(prompt):
        return False
    rounds = max(1, round(len(answer) / len(prompt)))
    if len(answer) > 1.15 * rounds * len(prompt) + 2:
        return False
    # few common shingles, few common tokens in order: the alignment would fail as well. One word left
    # out of a short prompt breaks most of its shingles, so the alignment has the last word
    if len(answer) > 40 and containment(answer, prompt) < 0.2:
        return False
    common = lcs_length(prompt * rounds, answer)
    return common >= 0.85 * len(prompt) * rounds and common >= 0.9 * len(answer)


#: Of a template COVER has to be in a sentence, in order, and SHARE of the sentence in the template.
COVER, SHARE = 0.75, 0.5


class Templates:
    """Sentences that others are aligned with, indexed by their words."""

    def __init__(self, sentences: list[str]) -> None:
        self.all = [tokens(t) for t in sentences]
        self.longest = max(map(len, self.all))
        self.having: dict[str, list[tuple[int, int]]] = {}
        for i, words in enumerate(self.all):
            for w in set(words):
                self.having.setdefault(w, []).append((i, words.count(w)))

    def possible(self, words: set[str]) -> bool:
        """Whether some template could be aligned with a part of a text of these words."""
        common: dict[int, int] = {}
        for w in words:
            for i, n in self.having.get(w, ()):
                common[i] = common.get(i, 0) + n
        return any(n >= COVER * len(self.all[i]) for i, n in common.items())

    def align(self, sentence: list[str]) -> bool:
        """Whether the longest common subsequence with some template covers enough of both. Only templates
        that have enough words in common, in whatever order, are aligned."""
        if not sentence or SHARE * len(sentence) > self.longest:
            return False
        common: dict[int, int] = {}
        for w in set(sentence):
            for i, n in self.having.get(w, ()):
                common[i] = common.get(i, 0) + (min(n, sentence.count(w)) if n > 1 else 1)
        for i, n in common.items():
            words = self.all[i]
            if n >= COVER * len(words) and n >= SHARE * len(sentence):
                n = lcs_length(words, sentence)
                if n >= COVER * len(words) and n >= SHARE * len(sentence):
                    return True
        return False


_REFUSAL, _COURTESY = Templates(REFUSALS), Templates(COURTESIES)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
_CLAUSE = re.compile(r"[,;，；:：]\s*|(?<=[.!?])\s+|(?<=[。！？])|\n+")


def is_refusal(said: str, words: list[str] | None = None) -> bool:
    """Most of what is said, in all its sentences, aligns with refusal templates and courtesies, some of it
    with refusals. words are the tokens of said, where they are known."""
    if not _REFUSAL.possible(set(tokens(said) if words is None else words)):
        return False
    total = hit = core = 0
    for sentence in filter(None, map(str.strip, _SENTENCE.split(said))):
        own = tokens(sentence)
        total += len(own)
        if _REFUSAL.align(own):
            hit += len(own)
            core += 1
        elif _COURTESY.align(own):
            hit += len(own)
        else:
            clauses = [c for c in map(tokens, _CLAUSE.split(sentence)) if c]
            for clause in clauses if len(clauses) > 1 else ():
                if _REFUSAL.align(clause):
                    core += 1
                    hit += len(clause)
                elif _COURTESY.align(clause):
                    hit += len(clause)
    return core > 0 and hit >= 0.6 * total


# --- fixed values: numbers that announce how many points follow
_NUMBERS = {"two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "两": 2, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5}
_ANNOUNCED = re.compile(r"\b(\w+)\s+(?:points|reasons|steps|items|Punkte|Gründe|raisons|puntos|razones)\b|共?有([两二三四五六])点", re.I)
#: What may stand between an announcement and the list that it announces: the rest of its sentence.
_LEAD = re.compile(r"[^.!?。！？\n]*[.!?:。！？：]?[*_]*\s*")
_ITEM = re.compile(r"(?m)^\s*\d+[.)、]\s*\S")
_CUT_MARK = re.compile(r"(?:\[\s*(?:truncated|cut off|continued|to be continued|\.\.\.|…)\s*\]|\.\.\.|…|（待续）|\(continued\))\s*$", re.I)
_CLOSING = "\"'”’」』）)]*_`»"
_ABBREVIATION = re.compile(r"(?:\be\.g|\bi\.e|\bz\.\s?B|\bp\.\s?ex|\bcf|(?:^|\n)\s*\d+)\.$")
_BULLET = re.compile(r"^\s*(?:[-*•–]|\d+[.)、])\s+\S")


def _short_list(text: str) -> bool:
    """Whether a numbered list, anywhere in text, has fewer items than the sentence before it announces."""
    if not _ITEM.search(text):
        return False
    announced = [(m, due) for m in _ANNOUNCED.finditer(text) if (due := _NUMBERS.get((m[1] or m[2]).lower()))]
    items = [m.start() for m in _ITEM.finditer(text)] if announced else []
    for i, (m, due) in enumerate(announced):
        end = announced[i + 1][0].start() if i + 1 < len(announced) else len(text)
        own = [at for at in items if m.end() <= at < end]
        if own and len(own) < due and _LEAD.fullmatch(text, m.end(), own[0]):
            return True
    return False


def _ended(text: str) -> bool:
    """Whether text ends in a sentence mark, closing marks aside."""
    return text.rstrip(_CLOSING)[-1:] in tuple(".!?。！？")


def is_truncated(text: str) -> bool:
    """The answer ends before what it began is complete."""
    whole = _INVISIBLE.sub("", text).strip()
    t, open_fence = unfence(whole)
    if not t:
        return False
    if t[-1] in "]…）)" and _CUT_MARK.search(t) or t.endswith("..."):
        return True
    if t[0] in "{[":
        try:
            json.loads(t)
            return open_fence
        except ValueError:
            if t[0] == "{" or t[:2] in ('["', "[{", "[["):
                return True
    if open_fence:
        return True
    if _short_list(t):
        return True
    if t[-1] == "." and _ABBREVIATION.search("\n".join(t.rsplit("\n", 2)[-2:])):
        return True
    if _ended(t):
        return False
    lines = [x for x in t.split("\n") if x.strip()]
    # a bare list: its items end without a mark, the last like the others
    if len(lines) > 1 and _BULLET.match(lines[-1]) and re.search(r"\w$", t):
        others = [x for x in lines[:-1] if _BULLET.match(x)]
        if others and not any(_ended(x.strip()) for x in others):
            return False
    return len(tokens(t)) > 3


# --- fixed values: letters that tell a language
_LETTERS = [("de", frozenset("äöüß")), ("es", frozenset("ñíóú¿¡")), ("fr", frozenset("èêàçùûîôœ")), ("it", frozenset("òì")), ("pt", frozenset("ãõ"))]
_WORDS = re.compile(rf"[^\W\d_{_HAN}]+")
_HAN_LETTER = re.compile(f"[{_HAN}]")


def _language_weights(text: str) -> dict[str, float]:
    """Weight of each language in text, in about the number of words it says in it."""
    weights: dict[str, float] = {}
    for sentence in filter(None, _SENTENCE.split(text)):
        han = 0 if sentence.isascii() else len(_HAN_LETTER.findall(sentence))
        words = _WORDS.findall(sentence.lower())
        if han:
            weights["zh"] = weights.get("zh", 0.0) + han / 1.7
        if words:
            score: dict[str, float] = {}
            for w in words:
                if w in _STOP:
                    for lang, v in _STOP[w]:
                        score[lang] = score.get(lang, 0.0) + v
                if w.isascii():
                    continue
                for lang, letters in _LETTERS:
                    if not letters.isdisjoint(w):
                        score[lang] = score.get(lang, 0.0) + 0.6
            best = max(score, key=lambda k: (score[k], k == "en")) if score else "en"
            weights[best] = weights.get(best, 0.0) + len(words)
    return weights


def language(text: str) -> str | None:
    """The language most of text is in; names without any function word count as English."""
    weights = _language_weights(text)
    return max(sorted(weights), key=weights.__getitem__) if weights else None


# --- fixed values: verbs that ask for an answer
_ASKING = re.compile(r"\b(?:answer|respond|reply|write|translate|summari[sz]e|explain|antworte\w*|schreibe?n?|übersetze\w*|erkläre\w*|réponds|répond(?:re|ez)|rédige\w*|traduis\w*|explique\w*|respond[ea]\w*|escrib\w*|traduc\w*|resum\w*|rispond\w*|antwoord\w*)\b|回答|作答|答复|回复|翻译|译|写|总结|说明", re.I)
_QUOTED = re.compile(r"“[^”]*”|„[^“]*“|«[^»]*»|「[^」]*」|\"[^\"\n]*\"")


_NAMES = tuple(name for names in LANGUAGE_NAMES.values() for name in names.split("|"))


def _asked_in(part: str) -> str | None:
    """The language that part asks for first."""
    low = part.lower()
    if not any(name in low for name in _NAMES):
        return None
    found = [(m.start(), lang) for lang, pattern in _ASKED.items() for m in [pattern.search(part)] if m]
    return min(found)[1] if found else None


def asked_language(prompt: str, system: str | None) -> str | None:
    """The language the answer has to be in: as the prompt's opening asks (up to the first colon or line
    break), else as its last other sentence does that asks for an answer in some language, quotations
    aside, else as the system message asks, else the prompt's own."""
    parts = re.split(r"[:：\n]", prompt, maxsplit=1)
    if want := _asked_in(parts[0]):
        return want
    if len(parts) > 1 and _asked_in(parts[1]):
        for sentence in reversed(_SENTENCE.split(_QUOTED.sub(" ", parts[1]))):
            if sentence and _ASKING.search(sentence) and (want := _asked_in(sentence)):
                return want
    return _asked_in(system or "") or language(prompt)


def is_wrong_language(prompt: str, system: str | None, said: str) -> bool:
    want = asked_language(prompt, system)
    weights = _language_weights(said)
    total = sum(weights.values())
    if not want or total < 2:
        return False
    return weights.get(want, 0.0) < 0.5 * total


def defect(prompt: str | None, system: str | None, answer: str | None) -> str | None:
    """The one defect of a pair, or None; null prompts count as empty text."""
    said = bare(answer)
    if is_empty(answer, said):
        return EMPTY
    prompt = prompt or ""
    asked, words = tokens(prompt), tokens(said)
    if is_copy(asked, words) or "\\" in answer and is_copy(asked, tokens(bare(answer.replace("\\", "")))):
        return COPY
    if is_refusal(said, words):
        return REFUSAL
    if is_truncated(answer):
        return TRUNCATED
    if is_wrong_language(prompt, system, said):
        return WRONG_LANGUAGE
    return None


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        clean = [[x if isinstance(x, str) else None for x in batch[c]] for c in ("_prompt", "_system", "_answer")]
        out = pd.DataFrame({"response_id": batch["response_id"], "defect": [defect(*row) for row in zip(*clean)]})
        yield out[out["defect"].notna()]


def broken_pairs(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(response_id, defect) of each response whose request exists and whose answer is defective.

    requests: request_id, messages (array of role, content). responses: response_id, request_id,
    final_text. The prompt is the last user message. Repeated rows count once; a request without a
    user message has an empty prompt; a null final_text is an empty answer; responses without a
    request are left out. finish_reason isn't read: an answer is complete or not by its own text.
    """
    said = requests.filter(F.col("request_id").isNotNull()).groupBy("request_id").agg(F.first("messages").alias("m"))
    by_role = lambda role: F.element_at(F.filter("m", lambda x: F.lower(x["role"]) == role), -1)["content"]
    asked = said.select(
        "request_id",
        F.when(F.size(F.filter("m", lambda x: F.lower(x["role"]) == "user")) > 0, by_role("user")).alias("_prompt"),
        F.when(F.size(F.filter("m", lambda x: F.lower(x["role"]) == "system")) > 0, by_role("system")).alias("_system"),
    )
    given = responses.select("response_id", "request_id", F.col("final_text").alias("_answer")).dropDuplicates(["response_id"])
    return given.join(asked, "request_id").drop("request_id").mapInPandas(_judge, "response_id bigint, defect string")

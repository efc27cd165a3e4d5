"""Personal information in free text: a semi-Markov conditional random field over candidate spans.

A text is a sequence of segments: spans of one type, and single letters outside of any. Only spans
that some candidate rule proposes can have a type, so the lattice of a text is small: the candidates,
none longer than its rule allows, and the gaps between them. Features look at a whole span (its shape,
the classes of its words, its length) and at what stands before and after it; a further feature looks
at the type before and what separates the two. Dynamic programming over the candidates, in order of
their ends, chooses boundaries and types jointly. The weights and word lists are trained by
train_pii.py and kept in pii_model.json.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

NAME, EMAIL, PHONE, ID_NUMBER, ADDRESS = "name", "email", "phone", "id_number", "street_address"
TYPES = (NAME, EMAIL, PHONE, ID_NUMBER, ADDRESS)
PLACEHOLDERS = {NAME: "[NAME]", EMAIL: "[EMAIL]", PHONE: "[PHONE]", ID_NUMBER: "[ID_NUMBER]", ADDRESS: "[STREET_ADDRESS]"}

MODEL_PATH = Path(__file__).with_name("pii_model.json")

# --- fixed values: titles, frequent Chinese family names, street words and extension words
TITLES = {"frau", "herr", "herrn", "dr", "prof", "mr", "mrs", "ms", "miss", "mme", "mlle", "monsieur", "madame", "señor", "señora"}
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤柳温傅施常康翁柯辛管祝左涂祁时舒耿牟卜路詹关苗凌费纪盛童欧甄项游阳裴席卫"
COMPOUND = "欧阳 太史 上官 端木 司马 东方 独孤 南宫 万俟 闻人 夏侯 诸葛 尉迟 公羊 赫连 澹台 皇甫 宗政 濮阳 公冶 太叔 申屠 公孙 慕容 仲孙 钟离 长孙 宇文 司徒 鲜于 司空 闾丘 令狐 百里 呼延 东郭 南门 西门 第五".split()
STREET_EN = r"(?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Lane|Ln\.?|Close|Drive|Dr\.?|Court|Way|Place|Terrace|Crescent|Square|Boulevard|Blvd\.?|Row|Walk|Hill)"
STREET_DE = r"(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer)"
STREET_FR = r"(?:rue|avenue|av\.|impasse|boulevard|bd|allée|place|chemin|quai|cours|route|passage)"
EXTENSION = r"(?:ext|x|extension|Durchwahl|poste|转|分机)"

_CAP = r"[A-ZÀ-ÖØ-Þ]"
_WORD = re.compile(rf"{_CAP}[\w'’]*(?:-\w[\w'’]*)*")
_CHAIN_LINK = re.compile(r"(?:,?[ \t]+|,?[ \t]*\r?\n[ \t]*)(?=[A-ZÀ-ÖØ-Þ])")
_INITIAL = re.compile(r"[A-Z]\.(?:-?[A-Z]\.)*")

_LOCAL = r"[A-Za-z0-9À-ɏ][A-Za-z0-9À-ɏ._%+\-]*"
_AT = r"(?:@|＠|\s[@＠]\s|\s?[(\[{]\s?(?:at|AT|At)\s?[)\]}]\s?|\s(?:at|AT)\s(?=\S+\s(?:dot|DOT)\s))"
_DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|DOT|Dot)\s?[)\]}]\s?|\s(?:dot|DOT)\s)"
_EMAIL = re.compile(rf"{_LOCAL}{_AT}[A-Za-z0-9\-]+(?:{_DOT}[A-Za-z0-9\-]+)+")
_EMAIL_HINT = re.compile(r"[@＠]|[(\[{]\s?[aA][tT]\s?[)\]}]|\s(?:dot|DOT)\s")

_NUMBER = re.compile(
    r"(?<![A-Za-z0-9_.,/\-])(?:\+\s?)?(?:[(（]\+?\d{1,5}[)）][ \-]?)?\d(?:(?:[ \t]?[(（]\d{1,4}[)）][ \t]?|[ \t]?[\-–./][ \t]?|[ \t])?\d)+"
    rf"(?:[ \t]?,?[ \t]?{EXTENSION}\.?[ \t]?\d{{1,6}}\b)?[Xx]?(?![A-Za-z0-9_@])"
)
_CODED = re.compile(r"(?<![A-Za-z0-9_])[A-Z]{1,2}[ \-]?\d{2}(?:[ \-]?\d{2}){2,3}(?:[ \-]?[A-Z])?(?![A-Za-z0-9_])")

_EN_UNIT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|Room)\s\d+[A-Za-z]?"
_EN_TOWN = rf"(?:{_CAP}[\w'’]+(?:-(?:on|upon|under|by|in|ON|UPON|UNDER|BY|IN|{_CAP}\w*))*(?:-{_CAP}\w+)?)(?:\s\d{{4,6}})?"
_STREET_ANY = re.compile(
    rf"(?:{_EN_UNIT},\s)?(?<![\w\-])\d{{1,5}}[a-zA-Z]?\s(?:{_CAP}[\w'’\-]+\s){{1,3}}(?i:{STREET_EN})(?![\w])(?:,\s{_EN_UNIT}(?![\w]))?(?:,\s{_EN_TOWN})?"
    rf"|{_CAP}\w*(?i:{STREET_DE})\s\d{{1,4}}\s?[a-zA-Z]?(?![\w])(?:,\s\d{{5}}\s{_CAP}[\w\-]+)?"
    rf"|(?<![\w\-])\d{{1,4}}(?:\s(?:bis|ter))?,?\s(?i:{STREET_FR})\s(?:(?i:de la|de l['’]|des|du|de|d['’]|le|la|les)\s?)?(?:{_CAP}[\w'’\-]+)(?:\s{_CAP}[\w'’\-]+)*(?:,\s\d{{5}}\s{_CAP}[\w\-]+)?"
)
_STREET_HINT = re.compile(rf"\d[a-zA-Z]?\s(?:{_CAP}[\w'’\-]+\s)+(?i:{STREET_EN})(?![\w])|(?i:{STREET_DE})\s\d|\d,?\s(?i:{STREET_FR})\s")
_HAN = "㐀-鿿"
_ZH_ROAD = re.compile(
    rf"(?:[{_HAN}]{{1,4}}?(?:省|自治区))?(?:[{_HAN}]{{1,4}}?(?:市|州|县|区|镇|乡)){{0,4}}[{_HAN}]{{1,6}}?(?:路|街|大道|巷|弄|胡同|道)\s?\d{{1,5}}\s?号(?:\s?\d{{1,4}}\s?(?:单元|栋|幢|号楼|座|层|楼|室)){{0,4}}"
)
_ZH_HINT = re.compile(r"(?:路|街|大道|巷|弄|胡同|道)\s?\d{1,5}\s?号")


class Model:
    """Weights by feature, and the trained word lists."""

    def __init__(self, weights: dict[str, float], background: set[str], first: set[str], last: set[str], given: set[str]) -> None:
        self.weights, self.background, self.first, self.last, self.given = weights, background, first, last, given
        # the weights that a Chinese name can gain from a neighbouring span, at most
        self.most_link = max([0.0, *(v for k, v in weights.items() if ">" in k and k.split(">")[0] in TYPES)])

    def parts(self) -> tuple[dict[str, float], set[str], set[str], set[str], set[str]]:
        """What the model consists of: some 150 KB, to be sent to the executors."""
        return self.weights, self.background, self.first, self.last, self.given

    def save(self, path: Path = MODEL_PATH) -> None:
        path.write_text(
            json.dumps(
                {"weights": {k: round(v, 3) for k, v in sorted(self.weights.items()) if abs(v) >= 0.02}, "background": sorted(self.background), "first": sorted(self.first), "last": sorted(self.last), "given": sorted(self.given)},
                ensure_ascii=False,
                indent=0,
            )
        )

    @staticmethod
    @lru_cache(maxsize=2)
    def load(path: str = str(MODEL_PATH)) -> Model:
        kept = json.loads(Path(path).read_text())
        return Model(kept["weights"], set(kept["background"]), set(kept["first"]), set(kept["last"]), set(kept["given"]))

    def word_class(self, word: str) -> str:
        """F, L or B: part of a first, last or either name; K: a word of the background; I: initials; U: unknown."""
        low = word.lower()
        if low in TITLES:
            return "K"
        parts = [p for p in low.replace("’", "'").split("-") if p]
        base = [p[2:] if p.startswith("o'") else p for p in parts if p != "saint"]
        f, la = all(p in self.first for p in parts), bool(base) and all(p in self.last for p in base)
        if f or la:
            return "B" if f and la else "F" if f else "L"
        if low.removesuffix("'s") in self.background or all(p in self.background for p in parts):
            return "K"
        return "U"


def _left(text: str, start: int) -> str:
    """The last word or mark before start."""
    before = text[max(0, start - 24) : start].rstrip(" \t")
    if not before:
        return "^"
    m = re.search(rf"(?:[{_HAN}]{{1,2}}|[^\W{_HAN}]+[.:]?|[^\w\s]|\n)$", before)
    return m[0].lower() if m else before[-1]


def _right(text: str, end: int) -> str:
    after = text[end : end + 24].lstrip(" \t")
    if not after:
        return "$"
    m = re.match(rf"[{_HAN}]{{1,2}}|[^\W\d_{_HAN}]+|\d+|[^\w\s]|\n", after)
    word = m[0].lower() if m else after[0]
    return "9" if word[0].isdigit() else word


def _shape(span: str) -> str:
    return re.sub(r"\d", "9", re.sub(r"\s", " ", span))[:28]


Candidate = tuple[int, int, str, list[str]]


def _context(kind: str, text: str, start: int, end: int) -> list[str]:
    left, right = _left(text, start), _right(text, end)
    return [f"{kind}<{left}", f"{kind}>{right}", f"{kind}<>{left}_{right}"]


def _name_candidates(model: Model, text: str, out: list[Candidate]) -> None:
    background = model.background
    unknown = [m for m in _WORD.finditer(text) if len(m[0]) > 2 and m[0].lower() not in background and m[0].lower().removesuffix("'s") not in background]
    seen: set[tuple[int, int]] = set()
    for m in unknown:
        if model.word_class(m[0]) == "K":
            continue
        # the chain of capitalised words and initials around the unknown word, at most three to a side
        chain = [(m.start(), m.end())]
        at = m.start()
        for _ in range(3):
            before = re.search(r"(?:(?<=\s)|(?<=^)|(?<=[|\"“„'(*_>:：\-]))((?:[A-Z]\.(?:-?[A-Z]\.)*)|[A-ZÀ-ÖØ-Þ][\w'’]*(?:-\w[\w'’]*)*)(?:,?[ \t]+|,?[ \t]*\r?\n[ \t]*)$", text[max(0, at - 32) : at])
            if not before:
                break
            base = max(0, at - 32)
            chain.insert(0, (base + before.start(1), base + before.end(1)))
            at = chain[0][0]
        at = m.end()
        for _ in range(3):
            link = _CHAIN_LINK.match(text, at)
            if not link:
                break
            word = _INITIAL.match(text, link.end()) or _WORD.match(text, link.end())
            if not word:
                break
            chain.append((word.start(), word.end()))
            at = word.end()
        classes = ["I" if _INITIAL.fullmatch(text, a, b) else model.word_class(text[a:b]) for a, b in chain]
        for i in range(len(chain)):
            for j in range(i, min(i + 4, len(chain))):
                start, end = chain[i][0], chain[j][1]
                if not (start <= m.start() and m.end() <= end) or (start, end) in seen or end - start > 60:
                    continue
                seen.add((start, end))
                pattern = classes[i]
                for k in range(i + 1, j + 1):
                    pattern += ("," if "," in text[chain[k - 1][1] : chain[k][0]] else " ") + classes[k]
                beyond = ("," if j + 1 < len(chain) and "," in text[chain[j][1] : chain[j + 1][0]] else "") + (classes[j + 1] if j + 1 < len(chain) else "-")
                ahead = (classes[i - 1] if i else "-") + ("," if i and "," in text[chain[i - 1][1] : chain[i][0]] else "")
                opening = [f"nameI{text[chain[i][0] : chain[i][1]]}>{_right(text, end)}"] if classes[i] == "I" else []
                features = [f"name={pattern}", *opening, f"name]{pattern}|{beyond}", f"name[{ahead}|{pattern}", *_context("name", text, start, end)]
                out.append((start, end, NAME, features))


_ZH_NAME = re.compile(rf"(?=((?:{'|'.join(COMPOUND)})|[{SURNAMES}])[{_HAN}])")


def _zh_candidates(model: Model, text: str, out: list[Candidate], every: bool) -> None:
    """A family name, of one letter or two, with one or two Han letters after it, wherever it stands. The
    trained given-name letters are features, no condition. Unless `every`, candidates that no segmentation
    can choose, as their score with the best link stays below zero, are left out at once."""
    known, weights = model.given, model.weights
    for m in _ZH_NAME.finditer(text):
        start = m.start()
        for family in {1, len(m[1])}:
            if family == 1 and m[1][0] not in SURNAMES:
                continue
            before = text[max(0, start - 2) : start]
            for n in (family + 1, family + 2):
                end = start + n
                own = text[start + family : end]
                if len(own) < n - family or not ("㐀" <= own[-1] <= "鿿"):
                    break
                given = sum(c in known for c in own)
                following = text[end : end + 1]
                more = "more" if following and following in known and n - family < 2 else "end"
                size = n if family == 1 else f"{n}c"
                features = [f"zh={size}{given}", f"zh]{size}{given}{more}", f"zh<{before[-1:] or '^'}", f"zh<<{before}", f"zh>{following or '$'}", f"zh>>{text[end : end + 2]}", f"zh<>{before[-1:]}_{following}"]
                if every or sum(weights.get(f, 0.0) for f in features) + model.most_link > 0:
                    out.append((start, end, NAME, features))


def _number_candidates(text: str, out: list[Candidate]) -> None:
    for pattern in (_NUMBER, _CODED):
        for m in pattern.finditer(text):
            digits = sum(c.isdigit() for c in m[0])
            if digits < 6 or digits > 20 or len(m[0]) > 40:
                continue
            start, end, shape = m.start(), m.end(), _shape(m[0])
            head = re.sub(r"\D", "", m[0])[:3]
            lead = "666" if head == "666" else "9" if head[:1] == "9" else "o"
            context = _context("number", text, start, end)
            for kind in (PHONE, ID_NUMBER):
                features = [f"{kind}={shape}", f"{kind}#{digits}", f"{kind}^{digits}{lead}", *(f"{kind}{c[6:]}" for c in context)]
                out.append((start, end, kind, features))


def candidates(model: Model, text: str, every: bool = True) -> list[Candidate]:
    """The candidate spans of text, each with its type and features: all of them, or without `every` at
    least all that can be chosen."""
    out: list[Candidate] = []
    if _EMAIL_HINT.search(text):
        for m in _EMAIL.finditer(text):
            out.append((m.start(), m.end(), EMAIL, ["email=1", f"email@{_shape(re.sub('[A-Za-z0-9À-ɏ]+', 'a', m[0]))}"]))
    _number_candidates(text, out)
    _name_candidates(model, text, out)
    if _STREET_HINT.search(text):
        for m in _STREET_ANY.finditer(text):
            parts = m[0].split(", ")
            out.append((m.start(), m.end(), ADDRESS, ["address=1", f"address#{len(parts)}", *_context("address", text, m.start(), m.end())]))
            # the same without its last part, for where a name or clause follows
            if len(parts) > 1:
                end = m.end() - len(parts[-1]) - 2
                out.append((m.start(), end, ADDRESS, ["address=1", "address-short", f"address#{len(parts) - 1}", *_context("address", text, m.start(), end)]))
    if re.search(f"[{_HAN}]", text):
        _zh_candidates(model, text, out, every)
        if "号" in text:
            for hint in _ZH_HINT.finditer(text):
                # from the last mark or word that can't be in an address
                left = max(text.rfind(c, 0, hint.start()) for c in "。，、；：！？\n于往址住在到") + 1
                m = _ZH_ROAD.search(text, left)
                if m and m.start() <= hint.start() < m.end():
                    out.append((m.start(), m.end(), ADDRESS, ["address=1", "address-zh", f"address<{_left(text, m.start())}"]))
    return out


def between(gap: str) -> str:
    """What separates two neighbouring spans, as part of a transition feature."""
    return ":" + re.sub(r"\d", "9", re.sub(r"\s+", " ", gap))


def score(model: Model, features: list[str]) -> float:
    weights = model.weights
    return sum(weights.get(f, 0.0) for f in features)


#: Gap up to which the type before counts, in letters.
NEAR = 5


def decode(model: Model, text: str) -> list[tuple[int, int, str]]:
    """The best segmentation: (start, end, type) of its typed segments, in order."""
    spans = sorted(candidates(model, text, False), key=lambda c: (c[1], c[0]))
    if not spans:
        return []
    scores = [score(model, c[3]) for c in spans]
    ends = [c[1] for c in spans]
    best: list[float] = []
    back: list[int] = []
    # prefix[i]: the best of the first i candidates as last segment, -1 for none
    prefix: list[int] = [-1]
    for i, (start, _, kind, _) in enumerate(spans):
        far = bisect_right(ends, start - NEAR - 1, 0, i)
        link = prefix[far]
        value = best[link] if link >= 0 else 0.0
        for j in range(bisect_right(ends, start, 0, i) - 1, far - 1, -1):
            linked = best[j] + model.weights.get(f"{spans[j][2]}>{kind}{between(text[ends[j] : start])}", 0.0)
            if linked > value:
                value, link = linked, j
        best.append(value + scores[i])
        back.append(link)
        top = prefix[-1]
        prefix.append(i if best[i] > (best[top] if top >= 0 else 0.0) else top)
    chosen, at = [], prefix[-1]
    while at >= 0:
        chosen.append(spans[at][:3])
        at = back[at]
    return chosen[::-1]


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """text with each found span replaced by its type's placeholder."""
    parts, at = [], 0
    for start, end, kind in found:
        parts += [text[at:start], PLACEHOLDERS[kind]]
        at = end
    return "".join([*parts, text[at:]])


def mentions(documents: DataFrame, model_path: str = str(MODEL_PATH)) -> DataFrame:
    """(doc_id, pii_type, pii_start, pii_end) of every mention in documents (doc_id, text).

    Offsets count code points, the end is exclusive. Null and empty texts have none. Each text is
    labelled whole, in Arrow batches; nothing is shuffled but the result's own duplicates, where a
    document is given twice.
    """

    kept = documents.sparkSession.sparkContext.broadcast(Model.load(model_path).parts())

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(*kept.value)
        for batch in batches:
            rows = [(d, kind, a, b) for d, t in zip(batch["doc_id"], batch["text"]) if isinstance(t, str) for a, b, kind in decode(model, t)]
            yield pd.DataFrame(rows, columns=["doc_id", "pii_type", "pii_start", "pii_end"])

    found = documents.select("doc_id", "text").mapInPandas(label, "doc_id bigint, pii_type string, pii_start int, pii_end int")
    return found.distinct()


def redacted(documents: DataFrame, model_path: str = str(MODEL_PATH)) -> DataFrame:
    """(doc_id, text, n_mentions) with placeholders for all mentions and all other text unchanged.

    A null text stays null, with no mentions.
    """

    kept = documents.sparkSession.sparkContext.broadcast(Model.load(model_path).parts())

    def replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(*kept.value)
        for batch in batches:
            texts, counts = [], []
            for t in batch["text"]:
                found = decode(model, t) if isinstance(t, str) else []
                texts.append(redact(t, found) if isinstance(t, str) else None)
                counts.append(len(found))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": texts, "n_mentions": counts})

    return documents.select("doc_id", "text").mapInPandas(replace, "doc_id bigint, text string, n_mentions int")

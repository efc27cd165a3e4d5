"""Trains the model of pii.py on a bounded sample of documents.

    python -m graphloom.llm.train_pii /root/testdata/sf0.1/documents.parquet

The sample is the DOCUMENTS documents with the smallest ids. It is labelled by narrow rules: name
parts are learnt from places where only a name can stand (a contact record, a table cell beside an
e-mail address), then names are combinations of such parts; numbers are labelled by shape and the
words beside them. The field is trained to the greatest conditional likelihood of these labels, with
the word lists hidden in part of the documents, so that spans' contexts carry weight as well. A tenth
of the sample is held out and measured.
"""

from __future__ import annotations

import math
import random
import re
import sys
from bisect import bisect_right
from collections import Counter, defaultdict

from graphloom.llm import pii

DOCUMENTS = 10_000
EPOCHS, RATE, DECAY = 6, 0.25, 1e-4
HIDDEN = 0.25

_C = r"[A-ZÀ-ÖØ-Þ][\w'’]+(?:-[A-ZÀ-ÖØ-Þ][\w'’]+)*"
_PLACES = [
    re.compile(rf'"name": "({_C}) (?:[A-Z]\. )?({_C})"'),
    re.compile(rf"\| ({_C}) (?:[A-Z]\. )?({_C}) \| \S+\s?[@＠(\[]"),
    re.compile(rf"Signed: ({_C}) (?:[A-Z]\. )?({_C})"),
    re.compile(rf"Patient: ({_C}) (?:[A-Z]\. )?({_C}), residing"),
]
_ZH_PLACES = re.compile(rf"(?:联系人：|证人|患者)([{pii.SURNAMES}])([{pii._HAN}]{{1,2}})(?=，电话|陈述|，身份证)")


def word_lists(texts: list[str]) -> tuple[set[str], set[str], set[str], set[str]]:
    """background, first, last and given, from the places where only a name can stand."""
    lower, documents = Counter(), Counter()
    first, last, given = Counter(), Counter(), Counter()
    for t in texts:
        lower.update(set(re.findall(r"(?<![\w@.+\-])[a-zß-ÿ]{2,}(?![\w@+\-])(?!\.\w)", t)))
        documents.update({w.lower() for w in re.findall(r"[^\W\d_]{2,}", t)})
        for place in _PLACES:
            for a, b in place.findall(t):
                first.update(p.lower() for p in a.split("-"))
                last.update(p.lower().removeprefix("o'").removeprefix("o’") for p in b.split("-") if p != "Saint")
        for _, g in _ZH_PLACES.findall(t):
            given.update(g)
    keep = lambda c: {w for w, n in c.items() if n >= 3}
    firsts, lasts = keep(first), keep(last)
    # a word seen on both sides counts for the side where it is seen far more often
    firsts, lasts = {w for w in firsts if first[w] * 4 >= last[w]}, {w for w in lasts if last[w] * 4 >= first[w]}
    # then whatever stands beside a known part like its other half
    words = {w for w, n in lower.items() if n >= 5 and documents[w] >= 8} | {w for w, n in documents.items() if n > 0.02 * len(texts)}
    pair = re.compile(rf"(?=(?<![\w'’])({_C}) (?:[A-Z]\. )?({_C}))")
    for _ in range(2):
        beside: dict[str, Counter] = {"first": Counter(), "last": Counter()}
        for t in texts:
            for a, b in pair.findall(t):
                low_a, low_b = a.lower(), b.lower().removeprefix("o'").removeprefix("o’").removeprefix("saint-")
                if low_b in lasts and low_a not in words:
                    beside["first"].update(low_a.split("-"))
                if low_a in firsts and low_b not in words:
                    beside["last"][low_b] += 1
        firsts |= {w for w, n in beside["first"].items() if n >= 4 and w not in lasts and w not in pii.TITLES and w.isalpha()}
        lasts |= {w for w, n in beside["last"].items() if n >= 4 and w not in firsts and w not in pii.TITLES and w.isalpha()}
    background = {w for w, n in lower.items() if n >= 5 and documents[w] >= 8} | {w for w, n in documents.items() if n > 0.02 * len(texts)}
    return background - firsts - lasts, firsts, lasts, keep(given)


_ID_SHAPES = re.compile(r"(?:666|9\d\d)([\- ]?)\d\d\1\d{4}|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-Z]|[A-Z]\d{8}|99\d{15}[\dX]")
_PHONE_SHAPES = re.compile(
    r"(?:\+1 |\+1-)?\(?555\)?[ .\-]\d{3}[ .\-]\d{4}(?: ext\. \d+)?|00 1 555 \d{7}|\+44 20 7946 \d{4}|020 7946 \d{4}|\+49 \(0\)30 23125 \d{3}|030/23125\d{3}"
    r"|\+86[ \-]1\d\d ?\d{4} ?\d{4}|1\d{2}-\d{4}-\d{4}|1\d{10}|[（(]0\d{3}[）)]\d{7,8}|0\d{3}-\d{7,8}"
)
_NOT_BEFORE = re.compile(r"(?:编号|批次|型号|Lot|Batch|Part|Order no\.|No\.)\s*$")


def silver(model: pii.Model, text: str) -> set[tuple[int, int, str]]:
    """Spans by narrow rules."""
    spans: list[tuple[int, int, str]] = []
    for a, b, kind, features in pii.candidates(model, text):
        span = text[a:b]
        if kind == pii.EMAIL:
            spans.append((a, b, kind))
        elif kind == pii.ADDRESS and "address-short" not in features:
            spans.append((a, b, kind))
        elif kind == pii.ID_NUMBER and _ID_SHAPES.fullmatch(span) and not _NOT_BEFORE.search(text[max(0, a - 12) : a]):
            spans.append((a, b, kind))
        elif kind == pii.PHONE and _PHONE_SHAPES.fullmatch(span) and not _NOT_BEFORE.search(text[max(0, a - 12) : a]):
            spans.append((a, b, kind))
        elif kind == pii.NAME and features[0].startswith("name="):
            # before "habite", M. is the title
            title = span.startswith("M. ") and text[b : b + 7] == " habite"
            if re.fullmatch(r"name=(?:[FB] (?:I ){0,2}[LB]|(?:I ){1,2}[LB]|[LB],[FB](?: I)?)", features[0]) and not title:
                spans.append((a, b, kind))
            elif features[0] in ("name=L", "name=B") and text[max(0, a - 3) : a] == "M. " and text[b : b + 7] == " habite":
                spans.append((a, b, kind))
        elif kind == pii.NAME:
            if "c" in features[0]:
                continue
            n, g = features[0][3], features[0][4]
            if int(n) == int(g) + 1 and "more" not in features[1] and not re.search(r"[省市县区路]", text[b : b + 1]):
                spans.append((a, b, kind))
    # the longest of overlapping spans
    kept: list[tuple[int, int, str]] = []
    for s in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
        if all(s[1] <= k[0] or s[0] >= k[1] for k in kept):
            kept.append(s)
    return set(kept)


def _lattice(model: pii.Model, text: str) -> tuple[list[pii.Candidate], list[list[tuple[int, str]]]]:
    """Candidates by end, and for each the near candidates before it with their transition feature."""
    spans = sorted(pii.candidates(model, text), key=lambda c: (c[1], c[0]))
    near: list[list[tuple[int, str]]] = []
    for i, (start, _, kind, _) in enumerate(spans):
        own = []
        for j in range(i - 1, -1, -1):
            gap = start - spans[j][1]
            if gap > pii.NEAR:
                break
            if gap >= 0:
                own.append((j, f"{spans[j][2]}>{kind}{pii.between(text[spans[j][1] : start])}"))
        near.append(own)
    return spans, near


def _add(a: float, b: float) -> float:
    if a == -math.inf:
        return b
    if b == -math.inf:
        return a
    m = max(a, b)
    return m + math.log1p(math.exp(min(a, b) - m))


def gradient(weights: dict[str, float], spans: list[pii.Candidate], near: list[list[tuple[int, str]]], gold: set[tuple[int, int, str]]) -> dict[str, float]:
    """Features of the labels less their expectation, by forward and backward sums over the lattice."""
    n = len(spans)
    own = [sum(weights.get(f, 0.0) for f in s[3]) for s in spans]
    ends = [s[1] for s in spans]
    free = [bisect_right(ends, s[0], 0, i) for i, s in enumerate(spans)]
    # total[i]: log sum over segmentations of the first i candidates (by their last segment); forward[i]: ending in i
    total, forward = [0.0], []
    for i in range(n):
        value = total[free[i]]
        for j, f in near[i]:
            w = weights.get(f, 0.0)
            # the plain sum holds the way through j without its transition weight
            if w > 0:
                value = _add(value, forward[j] + math.log(math.expm1(w)))
            elif w < 0:
                value += math.log(max(1e-9, 1 + math.exp(min(0.0, forward[j] - value)) * math.expm1(w)))
        forward.append(value + own[i])
        total.append(_add(total[-1], forward[-1]))
    # backward by automatic differentiation of total[n]
    d_total, d_forward = [0.0] * (n + 1), [0.0] * n
    d_total[n] = 1.0
    grad: dict[str, float] = defaultdict(float)
    for i in range(n - 1, -1, -1):
        share = math.exp(forward[i] - total[i + 1]) if forward[i] > -math.inf else 0.0
        d_forward[i] += d_total[i + 1] * share
        d_total[i] += d_total[i + 1] * (1 - share)
        p = d_forward[i]
        if p <= 1e-9:
            continue
        for f in spans[i][3]:
            grad[f] -= p
        value = forward[i] - own[i]
        rest = 1.0  # share of the plain sum
        for j, f in near[i]:
            through = math.exp(min(0.0, forward[j] + weights.get(f, 0.0) - value))
            plain = math.exp(min(0.0, forward[j] - value))
            d_forward[j] += p * (through - plain)
            rest += plain - through
            grad[f] -= p * through
        d_total[free[i]] += p * max(0.0, rest)
    chosen = {k: i for i, s in enumerate(spans) if (k := s[:3]) in gold}
    for k, i in chosen.items():
        for f in spans[i][3]:
            grad[f] += 1.0
        for j, f in near[i]:
            if spans[j][:3] in gold:
                grad[f] += 1.0
    return grad


def train(texts: list[str], seed: int = 1) -> pii.Model:
    """A model of texts, printed with its measures on a held-out tenth."""
    random.seed(seed)
    background, first, last, given = word_lists(texts)
    model = pii.Model({}, background, first, last, given)
    # without the word lists names are unknown words, and only context tells
    blind = pii.Model({}, background, set(), set(), set())
    examples = []
    for k, text in enumerate(texts):
        if k % 10 == 0:
            continue
        gold = silver(model, text)
        for use in (model, blind) if random.random() < HIDDEN else (model,):
            spans, near = _lattice(use, text)
            if spans:
                examples.append((spans, near, gold))
    weights: dict[str, float] = defaultdict(float)
    squares: dict[str, float] = defaultdict(float)
    for epoch in range(EPOCHS):
        random.shuffle(examples)
        for spans, near, gold in examples:
            for f, g in gradient(weights, spans, near, gold).items():
                g -= DECAY * weights[f]
                squares[f] += g * g
                weights[f] += RATE * g / (1e-6 + math.sqrt(squares[f]) + 0.1)
        print("epoch", epoch, "features", len(weights), flush=True)
    model.weights = dict(weights)
    counts = Counter()
    for text in texts[::10]:
        gold, got = silver(model, text), set(pii.decode(model, text))
        for kind in pii.TYPES:
            g, h = {s for s in gold if s[2] == kind}, {s for s in got if s[2] == kind}
            counts[kind, "right"] += len(g & h)
            counts[kind, "labelled"] += len(g)
            counts[kind, "found"] += len(h)
    for kind in pii.TYPES:
        print(kind, {k: counts[kind, k] for k in ("right", "labelled", "found")})
    return model


if __name__ == "__main__":
    import pyarrow.parquet as pq

    table = pq.read_table(sys.argv[1], columns=["doc_id", "text"]).to_pylist()
    sample = [r["text"] for r in sorted(table, key=lambda r: r["doc_id"])[:DOCUMENTS] if r["text"]]
    train(sample).save()

"""Evaluation texts inside a corpus: multi-pattern search with block shifts, then alignment.

Texts are folded to letters and digits, so that layout, marks, width, case and punctuation don't
count, nor do accents and ligatures. Test strings of equal length m are cut from every test sentence. The search follows Wu and
Manber: the last block of each window is looked up in a shift table, which is zero only where some
test string ends in that block; windows with a shift above zero are skipped; for the others a hash of
the whole window selects the bucket of test strings, and direct comparison confirms. All windows of
an Arrow batch are shifted at once, as arrays. Sentences with confirmed test strings are then aligned
with the text around them, which allows for changed words and inserted marks.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Test strings have M letters (M_HAN in Han text) and end in a block of BLOCK (BLOCK_HAN).
M, BLOCK, M_HAN, BLOCK_HAN = 14, 8, 6, 5
#: A sentence is cut into ZONES, with the PER_ZONE rarest strings of each as test strings. Two consecutive
#: sentences are aligned where test strings of LEAST_ZONES zones of each, LEAST_TOTAL in all, occur at
#: about one origin, give or take SLACK letters.
ZONES, PER_ZONE, LEAST_ZONES, LEAST_TOTAL, SLACK = 8, 2, 2, 4, 40
#: A sentence is held where runs of at least RUN letters (RUN_HAN in Han text) cover so much of it.
HELD, RUN, RUN_HAN = 0.75, 4, 2
#: Sentences under SHORT letters (SHORT_HAN), which differ from others of their form by one word, need more.
SHORT, SHORT_HAN, HELD_SHORT = 45, 20, 0.9
#: Letters that may stand between two consecutive sentences (page marks, notes).
GAP = 60
#: Evaluation items in one matcher; more items make more matchers, and the corpus is read for each.
ITEMS_PER_BLOCK = 20_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE = 1 << 22
_HAN_TEXT = re.compile(r"[㐀-鿿]")
#: A full stop before a lower-case letter (e.g. this) ends no sentence.
_SENTENCE = re.compile(r"(?<=[。！？])|(?<=[.!?])\s+(?![a-zà-ÿ])|\n+")


_ALNUM: np.ndarray | None = None


def fold(text: str) -> np.ndarray:
    """Code points of the letters and digits of text in compatibility form, taken apart: ligatures and
    full-width letters become plain letters, accents go, composed or not, and case is folded away."""
    global _ALNUM
    if text.isascii():
        low = text.lower().encode("ascii")
        raw = np.frombuffer(low, dtype=np.uint8).astype(np.uint32)
    else:
        low = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
        raw = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if _ALNUM is None:
        _ALNUM = np.array([chr(c).isalnum() for c in range(0x10000)])
    keep = _ALNUM[np.minimum(raw, 0xFFFF)]
    for i in np.flatnonzero(raw > 0xFFFF).tolist():
        keep[i] = chr(int(raw[i])).isalnum()
    return raw[keep]


def _text(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _is_han(codes: np.ndarray) -> bool:
    return bool(codes.size) and bool((((codes >= 0x3400) & (codes <= 0x9FFF)).mean()) > 0.3)


def passage_sentences(item_text: str) -> list[str]:
    """The sentences of an item's passage: the item without its first sentence or line, the instruction."""
    parts = [p.strip() for p in _SENTENCE.split(item_text or "") if p.strip()]
    return parts[1:]


class _Class:
    """The test strings of one length, with shift table and buckets.

    strings maps each test string to its (sentence, zone, offset in the sentence).
    """

    def __init__(self, m: int, block: int) -> None:
        self.m, self.block = m, block
        self.strings: dict[str, list[tuple[int, int, int]]] = defaultdict(list)

    def close(self) -> None:
        order = sorted(self.strings)
        codes = np.array([[ord(c) for c in s] for s in order], dtype=np.uint32).reshape(-1, self.m)
        #: 0 where some test string ends in a block of this hash, else the least distance to the end of one
        self.shift = np.full(_TABLE, self.m - self.block + 1, dtype=np.uint8)
        for far in range(self.m - self.block, -1, -1):
            end = self.m - far
            places = self._place(self._mix(codes[:, end - self.block : end]))
            np.minimum.at(self.shift, places, np.uint8(far))
        keys = self._mix(codes)
        rank = np.argsort(keys, kind="stable")
        self.keys, self.codes = keys[rank], codes[rank]
        uses = [self.strings[order[i]] for i in rank.tolist()]
        self.first = np.cumsum([0, *map(len, uses)])
        self.uses = np.array([u for us in uses for u in us], dtype=np.int64).reshape(-1, 3)
        del self.strings

    @staticmethod
    def _mix(rows: np.ndarray) -> np.ndarray:
        """A hash of each row of code points."""
        h = np.zeros(rows.shape[0], dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(rows.shape[1]):
                h = h * _BASE + rows[:, k]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        return h

    @staticmethod
    def _place(h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(_TABLE - 1)).astype(np.int64)

    def search(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of each occurrence of a test string in codes, and that string's rank."""
        none = np.zeros(0, dtype=np.int64)
        if not self.keys.size or codes.size < self.m:
            return none, none
        blocks = np.lib.stride_tricks.sliding_window_view(codes, self.block)[self.m - self.block :]
        # windows whose last block has a shift above zero can't be an occurrence
        starts = np.flatnonzero(self.shift[self._place(self._mix(blocks))] == 0)
        windows = np.lib.stride_tricks.sliding_window_view(codes, self.m)[starts]
        keys = self._mix(windows)
        low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
        # a bucket of equal hashes nearly always holds one string; further ones are tried in turn
        out = []
        for step in range(int((high - low).max()) if starts.size else 0):
            try_ = np.flatnonzero(low + step < high)
            at = low[try_] + step
            same = (self.codes[at] == windows[try_]).all(axis=1)
            out.append((starts[try_][same], at[same]))
        if not out:
            return none, none
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


class Matcher:
    """A searcher for the passages of some evaluation items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.latin, self.han = _Class(M, BLOCK), _Class(M_HAN, BLOCK_HAN)
        self.sentences: list[str] = []
        self.item: list[int] = []
        for item_id, item_text in items:
            for sentence in passage_sentences(item_text):
                self.sentences.append(_text(fold(sentence)))
                self.item.append(item_id)
        kinds = [self.han if _is_han(np.array([ord(c) for c in s])) else self.latin for s in self.sentences]
        #: sentences too short for test strings in several zones: looked for where a neighbour is found
        self.weak: set[int] = set()
        # in how many sentences each string occurs: the rarest of each zone are the test strings
        seen: dict[str, int] = defaultdict(int)
        for s, kind in zip(self.sentences, kinds):
            for piece in {s[i : i + kind.m] for i in range(len(s) - kind.m + 1)}:
                seen[piece] += 1
        for index, (s, kind) in enumerate(zip(self.sentences, kinds)):
            count = len(s) - kind.m + 1
            zones = max(1, min(ZONES, count // 2))
            for zone in range(zones if count > 0 else 0):
                at = range(count * zone // zones, count * (zone + 1) // zones)
                for i in sorted(at, key=lambda i: (seen[s[i : i + kind.m]], i))[:PER_ZONE]:
                    kind.strings[s[i : i + kind.m]].append((index, zone, i))
            if zones < LEAST_ZONES or count <= 0:
                self.weak.add(index)
        self._join_weak(kinds)
        self.latin.close()
        self.han.close()
        self.follows = np.array([i + 1 < len(self.item) and self.item[i] == self.item[i + 1] for i in range(len(self.item))], dtype=bool)
        self.weak_next = np.array([i + 1 in self.weak for i in range(len(self.item))], dtype=bool)
        self.weak_before = np.array([i - 1 in self.weak for i in range(len(self.item))], dtype=bool)

    def _join_weak(self, kinds: list[_Class]) -> None:
        """Test strings of two neighbours that are both too short for ones of their own: strings of their
        joined letters, or these as a whole where they are shorter than a test string."""
        self.joined: list[_Class] = []
        by_size: dict[tuple[int, int], _Class] = {}
        for i in sorted(self.weak):
            if i + 1 not in self.weak or self.item[i] != self.item[i + 1]:
                continue
            both = self.sentences[i] + self.sentences[i + 1]
            if not self.sentences[i] or not self.sentences[i + 1]:
                continue
            m = min(kinds[i].m, len(both))
            kind = by_size.setdefault((m, min(m, kinds[i].block)), _Class(m, min(m, kinds[i].block)))
            for at in range(0, len(both) - m + 1):
                kind.strings[both[at : at + m]].append((i, 0, at))
        for kind in by_size.values():
            kind.close()
            self.joined.append(kind)

    def documents(self, texts: list[str | None]) -> Iterator[tuple[int, int]]:
        """(index of the text, item id) for each text that holds two consecutive sentences of an item."""
        if not self.sentences:
            return iter(())
        folded = [fold(t) if t else np.zeros(0, dtype=np.uint32) for t in texts]
        # texts are searched together, apart by more than a string's length of a mark no text has
        apart = np.zeros(M + GAP, dtype=np.uint32)
        codes = np.concatenate([x for f in folded for x in (f, apart)] or [apart])
        begin = np.cumsum([0, *(f.size + apart.size for f in folded)])
        rows = []
        for kind in (self.latin, self.han):
            start, rank = kind.search(codes)
            n = kind.first[rank + 1] - kind.first[rank]
            use = np.repeat(kind.first[rank] - np.cumsum(n) + n, n) + np.arange(n.sum())
            where = np.repeat(start, n)
            sentence, zone, offset = kind.uses[use].T if use.size else np.zeros((3, 0), dtype=np.int64)
            doc = np.searchsorted(begin, where, side="right") - 1
            rows.append(np.stack([doc, sentence, where - offset, zone]))
        doc, sentence, origin, zone = np.concatenate(rows, axis=1)
        # hits of one sentence at about one origin, in two ways of cutting, by the zones that they are in
        spans, width = int(begin[-1]) // SLACK + 4, len(self.item) + 2
        cells = []
        for half in (0, SLACK // 2):
            key = (doc * width + sentence + 1) * spans + (origin + half) // SLACK + 2
            key = np.unique(key * ZONES + zone) // ZONES
            # sorted, so the zones of one place are a run of equal keys
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if key.size else np.zeros(1, dtype=np.int64)
            count = np.diff(edge)
            enough = count >= LEAST_ZONES
            key = key[edge[:-1]][enough]
            cells.append(np.stack([key // spans, (key % spans - 2) * SLACK - half, count[enough]]))
        where, at, count = np.concatenate(cells, axis=1)
        # only sentences with hits on a neighbour too, or with a neighbour too short for hits
        s = where % width - 1
        known = np.unique(where)
        keep = (self.follows[s] & (np.isin(where + 1, known) | self.weak_next[s])) | (self.follows[s - 1] & (s > 0) & (np.isin(where - 1, known) | self.weak_before[s]))
        near: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for w, p, c in zip(where[keep].tolist(), at[keep].tolist(), count[keep].tolist()):
            d = w // width
            near[d, w % width - 1].append((p - int(begin[d]), c))
        text: dict[int, str] = {}
        found = set()

        def holds(d: int, s: int, at: int) -> bool:
            if d not in text:
                text[d] = _text(folded[d])
            return self._holds(self.sentences[s], text[d], at)

        for kind in self.joined:
            start, rank = kind.search(codes)
            hits = {(int(np.searchsorted(begin, at, side="right")) - 1, int(s), int(at - offset)) for at, r in zip(start.tolist(), rank.tolist()) for s, _, offset in kind.uses[kind.first[r] : kind.first[r + 1]].tolist()}
            for d, s, at in hits:
                own = at - int(begin[d])
                if (d, self.item[s]) not in found and holds(d, s, own) and holds(d, s + 1, own + len(self.sentences[s])):
                    found.add((d, self.item[s]))
        for (d, s), here in near.items():
            item = self.item[s]
            if (d, item) in found:
                continue
            for p, c in here:
                pairs = []
                if self.follows[s]:
                    n = len(self.sentences[s])
                    if s + 1 in self.weak:
                        pairs.append((s + 1, p + n, c))
                    pairs += [(s + 1, q, c + e) for q, e in near.get((d, s + 1), []) if -2 * SLACK < q - p - n < GAP + 2 * SLACK]
                if s and self.follows[s - 1] and s - 1 in self.weak:
                    pairs.append((s - 1, p - len(self.sentences[s - 1]), c))
                if any(total >= LEAST_TOTAL and holds(d, s, p) and holds(d, other, q) for other, q, total in pairs):
                    found.add((d, item))
                    break
        return iter(sorted(found))

    @staticmethod
    def _holds(sentence: str, text: str, at: int) -> bool:
        """Whether text holds the sentence from about letter `at` on: runs of letters in the same order
        cover HELD of it. Shorter runs, which any two texts share, don't count."""
        left = max(0, at - SLACK // 2)
        window = text[left : at + len(sentence) + 2 * SLACK]
        han = bool(_HAN_TEXT.search(sentence))
        run, need = RUN_HAN if han else RUN, HELD_SHORT if len(sentence) < (SHORT_HAN if han else SHORT) else HELD
        if sentence in window:
            return bool(sentence)
        blocks = SequenceMatcher(None, sentence, window, autojunk=False).get_matching_blocks()
        return sum(b.size for b in blocks if b.size >= run) >= need * len(sentence)


#: The last matcher that this worker has unpacked, by its name.
_UNPACKED: dict[str, Matcher] = {}


def _unpacked(name: str, tables: bytes) -> Matcher:
    if name not in _UNPACKED:
        _UNPACKED.clear()
        _UNPACKED[name] = pickle.loads(tables)
    return _UNPACKED[name]


def matchers(items: DataFrame, per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """(block, tables): the matchers of all items (item_id, item_text), some per_block items in each, built
    on the executors and packed. An item is in the block of its id's hash."""
    rows = items.select("item_id", "item_text").filter("item_text is not null").distinct()
    blocks = max(1, -(-rows.count() // per_block))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        made = Matcher(sorted(zip(group["item_id"].tolist(), group["item_text"].tolist())))
        return pd.DataFrame({"block": [int(group["block"].iloc[0])], "tables": [pickle.dumps(made, protocol=5)]})

    return rows.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(build, "block int, tables binary")


def leaks(documents: DataFrame, items: DataFrame, per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """(doc_id, item_id): the document holds at least two full consecutive sentences of the item.

    documents: doc_id, text. items: item_id, item_text; the first sentence or line of an item is its
    instruction and is no passage. Null or empty texts hold nothing; repeated rows come out once. The
    documents aren't shuffled: the items go to them in blocks of about per_block, each built once. The
    driver passes the blocks on one at a time, so it holds one, of some 100 MB, however many there are.
    """
    spark = documents.sparkSession
    made = None
    for row in matchers(items, per_block).toLocalIterator():
        block = spark.sparkContext.broadcast(bytes(row.tables))
        name = hashlib.sha256(row.tables).hexdigest()

        def search(batches: Iterator[pd.DataFrame], block=block, name=name) -> Iterator[pd.DataFrame]:
            matcher = _unpacked(name, block.value)
            for batch in batches:
                ids = batch["doc_id"].tolist()
                found = list(matcher.documents([t if isinstance(t, str) else None for t in batch["text"]]))
                yield pd.DataFrame({"doc_id": [ids[i] for i, _ in found], "item_id": [x for _, x in found]}, dtype="int64")

        part = documents.select("doc_id", "text").mapInPandas(search, "doc_id bigint, item_id bigint")
        made = part if made is None else made.unionByName(part)
    return made.distinct() if made is not None else spark.createDataFrame([], "doc_id bigint, item_id bigint")

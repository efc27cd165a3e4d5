"""Scalar text functions as JVM-side columns; Python only where a state machine is needed."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HAN = "㐀-鿿"
# --- fixed values: characters that no note's file name may have, and the greatest length of a name
ILLEGAL_IN_NAMES, NAME_LENGTH = r'[\\/:*?"<>|#^\[\]\r\n\t]', 120


def normal_name(name: Column) -> Column:
    """Lower case, with everything but digits, a-z and Han characters dropped; null stays null."""
    return F.regexp_replace(F.lower(name), f"[^0-9a-z{HAN}]+", "")


def title_key(title: Column) -> Column:
    """normal_name of a title without its leading numbering."""
    return normal_name(F.regexp_replace(title, r"^\s*\d+(?:\.\d+)*\s*", ""))


def han_letters(text: Column) -> Column:
    """The number of Han characters in text."""
    return F.regexp_count(text, F.lit(f"[{HAN}]"))


def tokens(letters: Column, han: Column, least: int = 1) -> Column:
    """token_estimate() of a text of which `han` of the `letters` are Han; both add up over parts. Null stays null."""
    count = han + F.ceil((letters - han) / 4).cast("int")
    return F.when(count.isNotNull(), F.greatest(F.lit(least), count))


def token_estimate(text: Column, least: int = 1) -> Column:
    """Han characters one each, others one per four, rounded up; at least `least`. Null stays null."""
    han = F.length(F.regexp_replace(text, f"[^{HAN}]", ""))
    return F.when(text.isNotNull(), F.greatest(F.lit(least), han + F.ceil((F.length(text) - han) / 4).cast("int")))


def file_stem(title: Column, fallback: str = "untitled") -> Column:
    """A title as a note's file name: illegal characters to spaces, spaces joined, dots at the ends cut."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(title, ILLEGAL_IN_NAMES, " "), r"\s+", " "))
    plain = F.regexp_replace(plain, r"^\.+|\.+$", "")
    return F.when(F.length(plain) > 0, F.trim(F.left(plain, F.lit(NAME_LENGTH)))).otherwise(F.lit(fallback))


def wikilink(stem: Column, display: Column) -> Column:
    """[[stem]], or [[stem|display]] where the display text is another, non-empty one."""
    other = (display != stem) & (F.length(display) > 0)
    return F.when(F.coalesce(other, F.lit(False)), F.concat(F.lit("[["), stem, F.lit("|"), display, F.lit("]]"))).otherwise(F.concat(F.lit("[["), stem, F.lit("]]")))


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor blank."""
    return F.coalesce(*[F.when(F.length(F.trim(c)) > 0, c) for c in columns])


def redact_secrets(text: Column) -> Column:
    """Bearer tokens, sk- keys and key=value secrets replaced; what stands around them is kept."""
    text = F.regexp_replace(text, r"(?i)\b(bearer|token|authorization)([\s:=]+)(?!bearer\b)[A-Za-z0-9._~+/\-]{8,}=*", "$1$2[REDACTED]")
    text = F.regexp_replace(text, r"\bsk-[A-Za-z0-9_\-]{8,}", "sk-[REDACTED]")
    return F.regexp_replace(text, r"(?i)\b(api[_-]?key|secret|password|access[_-]?token)\s*[=:]\s*[^\s,;&\"']+", "$1=[REDACTED]")


def strip_thinking(text: Column) -> Column:
    """text without <think>…</think> parts."""
    return F.trim(F.regexp_replace(text, r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", ""))


def common_suffix_length(a: Column, b: Column) -> Column:
    """Letters that a and b have in common at their ends."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b))))
    return F.aggregate(at, F.lit(0), lambda n, i: F.when((n == i - 1) & (F.right(a, i) == F.right(b, i)) & (F.length(a) >= i) & (F.length(b) >= i), i).otherwise(n))


def _gram(text: Column, n: int):
    # a function of one argument: Spark would hand a second one the index
    return lambda i: F.substring(text, i, F.lit(n))


def ngrams(text: Column, sizes: tuple[int, ...] = (2, 3, 4)) -> Column:
    """Distinct letter n-grams of text for the given sizes."""
    parts = []
    for n in sizes:
        starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
        parts.append(F.when(F.length(text) >= n, F.transform(starts, _gram(text, n))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*parts))


def yaml_scalar(value: Column) -> Column:
    """A string as a YAML scalar: quoted where plain style would be read as something else."""
    plain = value.rlike(r"^[\p{L}_][^:#\[\]{},&*!|>'\"%@`\r\n\t]*$") & ~value.rlike(r"\s$") & ~F.lower(value).isin("true", "false", "null", "yes", "no", "on", "off", "~")
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    return F.when(value.isNull(), F.lit("null")).when(plain, value).otherwise(quoted)


_THOUGHT, _FENCED = re.compile(r"(?is)<think(?:ing)?>.*?</think(?:ing)?>"), re.compile(r"(?s)```[\w-]*\s*\n?(.*?)```")
#: What a literal or number that breaks off may look like.
_BEGUN = re.compile(r"\s*(?:t(?:r(?:ue?)?)?|f(?:a(?:l(?:se?)?)?)?|n(?:u(?:ll?)?)?|-?\d*(?:\.\d*)?(?:[eE][+-]?\d*)?)\s*")


def first_json(text: str | None) -> tuple[str | None, str]:
    """The first JSON object or array in text and what came of it: ok, none, truncated or invalid.

    Thoughts are left out, and of a fenced text only the inside is read. JSON that fails at its very end,
    or inside a string or literal without an end, is truncated.
    """
    clean = _THOUGHT.sub("", text or "").strip()
    if fenced := _FENCED.search(clean):
        clean = fenced[1].strip()
    begin = min((at for c in "{[" if (at := clean.find(c)) >= 0), default=-1)
    if begin < 0:
        return None, "none"
    try:
        _, end = json.JSONDecoder().raw_decode(clean, begin)
        return clean[begin:end], "ok"
    except RecursionError:
        return None, "invalid"
    except json.JSONDecodeError as failure:
        open_string = failure.msg.startswith("Unterminated string")
        return None, "truncated" if open_string or _BEGUN.fullmatch(clean, failure.pos) else "invalid"


_JSON = T.StructType([T.StructField("value", T.StringType()), T.StructField("state", T.StringType())])


@F.pandas_udf(_JSON)
def extract_json(texts: pd.Series) -> pd.DataFrame:
    """struct(value, state) of the first balanced JSON value in each text."""
    return pd.DataFrame([first_json(t if isinstance(t, str) else None) for t in texts], columns=["value", "state"])


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the letters in matching blocks by the letters of both (Ratcliff and Obershelp)."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b)], dtype="float64")

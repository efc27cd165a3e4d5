"""Stable ids and key templates."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.text import normal_name


def node_id(name: Column) -> Column:
    """kp- and sixteen hex digits of the SHA-1 of the normalised name."""
    return F.concat(F.lit("kp-"), F.left(F.sha1(normal_name(name)), F.lit(16)))


def short_id(prefix: str, value: Column) -> Column:
    """The prefix and twelve hex digits of the SHA-1 of value."""
    return F.concat(F.lit(f"{prefix}-"), F.left(F.sha1(value), F.lit(12)))


def key_template(template: str, none_text: str | None = None) -> Column:
    """A key column from "{a}|{b}" or a plain field name.

    A missing value makes its part empty; with none_text it is written as that text instead.
    """
    if "{" not in template:
        return F.col(template).cast("string")
    parts = []
    for text, field in re.findall(r"([^{]*)(?:\{(\w+)\})?", template):
        if text:
            parts.append(F.lit(text))
        if field:
            parts.append(F.coalesce(F.col(field).cast("string"), F.lit(none_text or "")))
    return F.concat(*parts)


def edge_key(raw: Column, time: Column | None = None, place: Column | None = None) -> Column:
    """raw, then ` @ time` and ` at place` where those are known."""
    parts = [raw]
    if time is not None:
        parts.append(F.coalesce(F.concat(F.lit(" @ "), time), F.lit("")))
    if place is not None:
        parts.append(F.coalesce(F.concat(F.lit(" at "), place), F.lit("")))
    return F.concat(*parts)


def undirected(source: Column, target: Column) -> tuple[Column, Column]:
    """Both ends in order."""
    return F.least(source, target), F.greatest(source, target)


def fingerprint(value: object) -> str:
    """SHA-256 of a value as JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()

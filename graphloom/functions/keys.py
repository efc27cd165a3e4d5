"""Key normalisation as JVM-side column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at either end: the Unicode separators, control characters that are space, and marks of no width.
_ENDS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200C))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def strip_ends(text: Column) -> Column:
    """text without white space at its ends; null stays null."""
    return F.btrim(text, F.lit(_ENDS))


def clean_key(key: Column) -> Column:
    """A reference key: ends stripped, lower case; null where nothing is left."""
    value = F.lower(strip_ends(key.cast("string")))
    return F.when(F.length(value) > 0, value)


def null_mask(columns: list[Column]) -> Column:
    """Bit i is set where column i is null."""
    return reduce(
        lambda a, b: a + b,
        [F.when(c.isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(columns)],
    )

"""Bytes of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def swapped(raw: Column, width: int) -> Column:
    """The bytes of each word of ``width`` in the other order; a last word that is cut short stays as it is."""
    pairs = F.regexp_extract_all(F.hex(raw), F.lit(f".{{1,{2 * width}}}"), F.lit(0))
    turned = F.transform(pairs, lambda w: F.when(F.length(w) == 2 * width, F.concat(*(F.substr(w, F.lit(2 * i + 1), F.lit(2)) for i in reversed(range(width))))).otherwise(w))
    return F.unhex(F.array_join(turned, ""))

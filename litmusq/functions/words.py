"""Words of a text and the likeness of two texts, as Columns.

Words are maximal runs of letters and digits, case ignored.  The likeness of
two texts is the Jaccard similarity of their word sets, 0 where neither has a
word.  A null text has no words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(text: Column) -> Column:
    """The words of ``text`` in order, lower-cased, one space between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def word_hashes(norm: Column, tag: str = "") -> Column:
    """Sorted distinct 64-bit hashes of the words of a normalised text."""
    words = F.filter(F.array_distinct(F.split(norm, " ")), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(F.lit(tag), w))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values, 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))

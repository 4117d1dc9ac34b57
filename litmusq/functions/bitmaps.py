"""Bitmaps of bounded size that tell tasks which hashes are asked for.

A bitmap lets every asked hash through, and others by chance, so an exact join
follows; its size is fixed beforehand and does not grow with the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmap(keys: DataFrame, column: str, bits: int) -> bytes:
    """The bits of a column of hashes; ``bits`` is a power of two, and at most ``bits`` / 64 rows reach the driver."""
    place = F.pmod(F.col(column), F.lit(bits))
    words = keys.where(F.col(column).isNotNull()).select(F.shiftright(place, 6).cast("int").alias("i"), F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    found = words.groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found.column("i").to_numpy()] = found.column("b").to_numpy()
    return out.tobytes()


def asked(raw: bytes, keys: np.ndarray) -> np.ndarray:
    """Which of the hashes (uint64) may be in the bitmap."""
    words = np.frombuffer(raw, np.uint64)
    at = keys & np.uint64(len(words) * 64 - 1)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def run_hashes(text: str, width: int) -> np.ndarray:
    """Hashes (uint64) of every run of ``width`` characters of a text; none if it is shorter."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - width + 1
    h = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width if n > 0 else 0):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
        return h ^ (h >> np.uint64(32))

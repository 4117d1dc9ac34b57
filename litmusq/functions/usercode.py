"""Running trusted scorer code over texts.

The code comes from people who may run code on the cluster anyway: this is no
sandbox, and nothing here is wired to data tables.  ``unsafe`` is a lint that a
caller may put in front.  A scorer is a function ``scorer(text, anchor, params)``
that returns a number; what it raises becomes an error and the value 0.5.
"""

from __future__ import annotations

import collections
import math
import re
import statistics
import string
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmusq.functions.rowprobes import NAMES
from litmusq.operators.signals import UNSAFE

SCHEMA = "ok boolean, raw_value double, value double, out_of_range boolean, error string"


def unsafe(code: Column) -> Column:
    """Does the code match any pattern that trusted scorers don't need?"""
    out = F.lit(False)
    for p in UNSAFE:
        out = out | F.coalesce(code, F.lit("")).rlike(p)
    return out


def _clamp(x: object) -> float:
    try:
        v = float(x or 0)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return 0.0
    return 0.0 if math.isnan(v) else max(0.0, min(1.0, v))


def _compiled(code: str):
    """The function ``scorer`` of the code, or what went wrong; the code sees the probes and word lists by name."""
    space: dict = {m.__name__: m for m in (re, math, collections, string, statistics, unicodedata)} | NAMES | {"_clamp": _clamp}
    try:
        exec(code, space)  # trusted by contract
        return space["scorer"]
    except Exception as e:
        return e


def _call(scorer, text: str | None, anchor: str | None) -> tuple[bool, float | None, float, bool, str | None]:
    try:
        if isinstance(scorer, Exception):
            raise scorer
        raw = float(scorer(text, anchor, {}))
    except Exception as e:  # whatever a scorer raises is its error
        return False, None, 0.5, False, f"{type(e).__name__}: {e}"
    return True, raw, _clamp(raw), math.isnan(raw) or not -0.01 <= raw <= 1.01, None


def run_one(code: str | None, text: str | None, anchor: str | None) -> tuple[bool, float | None, float, bool, str | None]:
    return _call(_compiled(code or ""), text, anchor)


def run(rows: DataFrame, code: str = "code", text: str = "text", anchor: str = "anchor") -> DataFrame:
    """``rows`` with the columns of ``SCHEMA``; a code is compiled once a task."""
    names = rows.columns

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = lru_cache(maxsize=10_000)(_compiled)
        for batch in batches:
            results = [_call(compiled(c or ""), t, a) for c, t, a in zip(*(batch.column(x).to_pylist() for x in (code, text, anchor)))]
            cols = list(zip(*results)) if results else [()] * 5
            types = [pa.bool_(), pa.float64(), pa.float64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *[pa.array(c, t) for c, t in zip(cols, types)]], [*names, *[f.split()[0] for f in SCHEMA.split(", ")]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(call, f"{fields}, {SCHEMA}")


def smoke(results: DataFrame, *keys: str) -> DataFrame:
    """Per scorer: does it run on all texts, always give a number, and give at least two different ones?"""
    return results.groupBy(*keys).agg(
        F.bool_and("ok").alias("runs"),
        F.bool_and(F.col("ok") & F.col("raw_value").isNotNull()).alias("numeric"),
        (F.count_distinct(F.round("raw_value", 10)) >= 2).alias("nonconstant"),
    )

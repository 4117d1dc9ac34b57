"""Claims in a text that its anchor does not support.

``hard`` is the yes or no; ``violations`` lists them with type and evidence.
Word lists match inside words, as they are meant to (``iso`` in "isolated").
Invented names are looked for and never reported, so that detector is empty.
A null text has no claims; a null anchor supports none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litmusq.functions import lexicons as L
from litmusq.functions.probes import Text, low, plain

VIOLATION = "array<struct<violation_type:string,evidence:string,severity:string>>"


def _text(c: Text) -> Column:
    return F.coalesce(plain(c), F.lit(""))


def numbers(text: Text) -> Column:
    return F.array_distinct(F.regexp_extract_all(_text(text), F.lit(L.NUMBER), F.lit(0)))


def invented_numbers(text: Text, anchor: Text) -> Column:
    return F.array_except(numbers(text), numbers(anchor))


def _unsupported(text: Text, anchor: Text, words: list[str]) -> Column:
    lit = F.array(*[F.lit(w) for w in words])
    t, a = low(text), low(anchor)
    return F.filter(lit, lambda w: F.contains(t, w) & ~F.contains(a, w))


def _matches(text: Text, anchor: Text, patterns: list[str]) -> Column:
    none = F.array().cast("array<string>")
    return F.flatten(F.array(*[F.when(low(anchor).rlike(p), none).otherwise(F.regexp_extract_all(low(text), F.lit(p), F.lit(0))) for p in patterns]))


def _companies(text: Text, anchor: Text) -> Column:
    a = low(anchor)
    return F.filter(F.regexp_extract_all(_text(text), F.lit(L.COMPANY_NAME), F.lit(0)), lambda m: ~F.contains(a, F.lower(m)))


def _around(text: Column, lowered: Column, found: Column, reach: int) -> Column:
    """The text around the first place of ``found``, trimmed."""
    at = F.position(found, lowered)
    begin = F.greatest(F.lit(1), at - reach)
    return F.trim(F.substring(text, begin, F.length(found) + at + reach - begin))


def _listed(items: Column, kind: str, evidence) -> Column:
    return F.transform(items, lambda x: F.struct(F.lit(kind).alias("violation_type"), evidence(x).alias("evidence"), F.lit("hard").alias("severity")))


def violations(text: Text, anchor: Text) -> Column:
    """All violations with evidence, in the order of the detectors."""
    t, lo = _text(text), low(text)
    return F.concat(
        _listed(invented_numbers(text, anchor), "invented_numeric_digit", lambda x: _around(t, t, x, 15)),
        _listed(_unsupported(text, anchor, L.NUMERIC_WORDS), "invented_numeric_word", lambda x: _around(t, lo, x, 15)),
        _listed(_matches(text, anchor, L.TIME_QUANTITY), "invented_time_or_quantity_claim", lambda x: x),
        _listed(F.concat(_matches(text, anchor, L.CUSTOMER_CLAIMS), _companies(text, anchor)), "invented_customer_or_company_claim", lambda x: x),
        _listed(_unsupported(text, anchor, L.AWARDS), "invented_award_or_certification_claim", lambda x: _around(t, lo, x, 10)),
        _listed(_unsupported(text, anchor, L.GUARANTEES), "guarantee_claim", lambda x: _around(t, lo, x, 10)),
    )


def hard(text: Text, anchor: Text) -> Column:
    """Is any claim unsupported?  Stops at the first detector that says so."""
    found = F.size(invented_numbers(text, anchor)) > 0
    for words in (L.NUMERIC_WORDS, L.AWARDS, L.GUARANTEES):
        for w in words:
            found = found | (F.contains(low(text), F.lit(w)) & ~F.contains(low(anchor), F.lit(w)))
    for p in (*L.TIME_QUANTITY, *L.CUSTOMER_CLAIMS):
        found = found | (low(text).rlike(p) & ~low(anchor).rlike(p))
    return found | (F.size(_companies(text, anchor)) > 0)

"""Deterministic text probes: Column in, Column in [0, 1] out.

Everything stays in built-in expressions.  Markers are counted as different
markers present, not as occurrences, except where windows are looked at.
A null text counts as empty; probes that divide by words or sentences give null
on a null text, which scorers turn into an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmusq.functions import lexicons as L


def clamp(x: Column) -> Column:
    """Into [0, 1]; null and NaN give 0."""
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


@dataclass(frozen=True)
class Prepared:
    """A text with what the probes share of it already computed in columns."""

    text: Column
    low: Column
    toks: Column
    content: Column


Text = Column | Prepared


def prepared(df: DataFrame, text: str, prefix: str) -> tuple[DataFrame, Prepared]:
    """Adds the shared columns of a text under a prefix, once for all probes."""
    t = F.col(text)
    df = df.withColumn(f"{prefix}low", low(t)).withColumn(f"{prefix}toks", F.regexp_extract_all(F.col(f"{prefix}low"), F.lit("[a-zA-Z]{3,}"), F.lit(0)))
    df = df.withColumn(f"{prefix}content", F.array_except(F.array_distinct(f"{prefix}toks"), _words(L.STOP_WORDS)))
    return df, Prepared(t, F.col(f"{prefix}low"), F.col(f"{prefix}toks"), F.col(f"{prefix}content"))


def plain(text: Text) -> Column:
    return text.text if isinstance(text, Prepared) else text


def low(text: Text) -> Column:
    return text.low if isinstance(text, Prepared) else F.lower(F.coalesce(text, F.lit("")))


def _escaped(words: list[str]) -> str:
    special = set(".^$*+?()[]{}|\\")
    return "|".join("".join("\\" + c if c in special else c for c in w) for w in words)


def has_any(lowered: Column, markers: list[str]) -> Column:
    return lowered.rlike(f"(?:{_escaped(markers)})")


def count_present(lowered: Column, markers: list[str]) -> Column:
    """How many of the markers occur."""
    total = F.lit(0)
    for m in markers:
        total = total + F.contains(lowered, F.lit(m)).cast("int")
    return total


def tokens(text: Text) -> Column:
    """Runs of three ASCII letters or more, lower case, in order."""
    return text.toks if isinstance(text, Prepared) else F.regexp_extract_all(low(text), F.lit("[a-zA-Z]{3,}"), F.lit(0))


def content_tokens(text: Text) -> Column:
    """Different tokens without stop words."""
    return text.content if isinstance(text, Prepared) else F.array_except(F.array_distinct(tokens(text)), _words(L.STOP_WORDS))


def _words(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _hits(toks: Column, words: list[str]) -> Column:
    """Tokens that are in the list, repeats counted."""
    return F.size(F.filter(toks, lambda t: t.isin(words)))


def capitalised(text: Text) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(plain(text), F.lit("")), F.lit(L.CAPITALISED), F.lit(0)))


def word_count(text: Text) -> Column:
    """Words between white space of any kind, at least 1."""
    return F.greatest(F.lit(1), F.size(F.regexp_extract_all(plain(text), F.lit(r"[^\s ]+"), F.lit(0))))


def source_continuity(text: Text, anchor: Text) -> Column:
    a, t = content_tokens(anchor), content_tokens(text)

    def part(words: list[str]) -> Column:
        own = F.array_intersect(a, _words(words))
        return F.when(F.size(own) == 0, 0.5).otherwise(F.size(F.array_intersect(own, t)) / F.greatest(F.lit(1), F.size(own)))

    whole = F.size(F.array_intersect(a, t)) / F.greatest(F.lit(1), F.size(a))
    return F.when(F.size(a) == 0, F.lit(0.5)).otherwise(clamp(0.5 * whole + 0.25 * part(L.ACTION_WORDS) + 0.25 * part(L.DOMAIN_NOUNS)))


def argument_progression(text: Text) -> Column:
    x = low(text)
    p, m, r = has_any(x, L.PROBLEM_MARKERS), has_any(x, L.MECHANISM_MARKERS), has_any(x, L.RESULT_MARKERS)
    return F.when(p & m & r, 1.0).when(m & r, 0.7).when(p & r, 0.5).when(m, 0.4).otherwise(0.0)


def _windows(lowered: Column, marker: str, after: bool, width: int) -> Column:
    """The text from (or after) every occurrence of a marker, overlapping ones included."""
    pattern = f"(?s)(?={marker}(.{{0,{width}}}))" if after else f"(?s)(?=({marker}.{{0,{width - len(marker)}}}))"
    return F.regexp_extract_all(lowered, F.lit(pattern), F.lit(1))


def real_mechanism_quality(text: Text) -> Column:
    x = low(text)
    score = F.lit(0.0)
    for marker in L.WINDOW_MARKERS:

        def worth(w: Column) -> Column:
            return 0.15 * _hits(F.regexp_extract_all(w, F.lit("[a-zA-Z]{3,}"), F.lit(0)), L.CONCRETE_TERMS) - 0.4 * count_present(w, L.FAKE_MECHANISMS)

        score = score + F.aggregate(_windows(x, marker, False, 80), F.lit(0.0), lambda s, w: s + worth(w))
    return clamp(score)


def abstract_jargon_density(text: Text) -> Column:
    toks = tokens(text)
    return clamp(_hits(toks, L.JARGON) / F.greatest(F.lit(1.0), F.size(toks) / 10))


def specificity_without_invention(text: Text, hard: Column) -> Column:
    toks = tokens(text)
    return F.when(hard, 0.0).otherwise(clamp(capitalised(text) * 0.08 + _hits(toks, L.SPECIFIC_VERBS) * 0.15 - _hits(toks, L.JARGON) * 0.06))


def mechanism_result_alignment(text: Text) -> Column:
    x = low(text)

    def side(markers: list[str], first: list[str], second: list[str], gain: float, jargon_cost: float, missing: float) -> Column:
        clauses = F.flatten(F.array(*[_windows(x, m, True, 80) for m in markers]))
        # greedy matching of a whole-window look-ahead keeps up to the first stop
        clauses = F.transform(clauses, lambda c: F.regexp_extract(c, r"^[^.!?]*", 0))

        def worth(c: Column) -> Column:
            toks = F.regexp_extract_all(c, F.lit("[a-z]{3,}"), F.lit(0))
            a, b = F.exists(toks, lambda t: t.isin(first)), F.exists(toks, lambda t: t.isin(second))
            empty = (_hits(toks, L.CLAUSE_JARGON) > 2) & ~a & ~b
            return F.when(a, gain).otherwise(0.0) + F.when(b, gain).otherwise(0.0) - F.when(empty, jargon_cost).otherwise(0.0)

        return F.when(F.size(clauses) == 0, -missing).otherwise(F.aggregate(clauses, F.lit(0.0), lambda s, c: s + worth(c)))

    mechanism = side(L.CLAUSE_MECHANISMS, L.CLAUSE_ACTIONS, L.CLAUSE_OBJECTS, 0.2, 0.25, 0.3)
    result = side(L.CLAUSE_RESULTS, L.CLAUSE_CONSEQUENCES, L.CLAUSE_OPERATIONS, 0.15, 0.2, 0.2)
    return clamp(mechanism + result)


def causal_density(text: Text) -> Column:
    sentences = F.greatest(F.lit(1), F.size(F.split(F.regexp_replace(plain(text), r"^[\s ]+|[\s ]+$", ""), "[.!?]", -1)))
    return F.when(plain(text).isNotNull(), clamp(count_present(low(text), L.CAUSAL_MARKERS) / F.greatest(F.lit(1.0), sentences * 1.5)))


def specificity(text: Text) -> Column:
    toks = tokens(text)
    return clamp(capitalised(text) * 0.08 + _hits(toks, L.GENERAL_VERBS) * 0.15 - _hits(toks, L.ABSTRACT_WORDS) * 0.05)


def audience_relevance(text: Text) -> Column:
    second = F.size(F.regexp_extract_all(low(text), F.lit(r"\b(?:you|your)\b"), F.lit(0)))
    return F.when(plain(text).isNotNull(), clamp(count_present(low(text), L.BEFORE_STATE) * 0.3 + second / F.greatest(F.lit(1.0), word_count(text) / 8) * 0.5))


def persuasion_risk(text: Text) -> Column:
    return F.when(plain(text).isNotNull(), clamp(count_present(low(text), L.HYPE_FLAGS) / F.greatest(F.lit(1.0), word_count(text) / 15)))


def epistemic_calibration(text: Text) -> Column:
    hedges, best = count_present(low(text), L.HEDGES), count_present(low(text), L.SUPERLATIVES)
    density = best / F.greatest(F.lit(1.0), word_count(text) / 20)
    return F.when(plain(text).isNotNull(), F.when(density > 0.4, clamp(0.1 - density * 0.1)).otherwise(clamp(0.5 + hedges * 0.1 - best * 0.1)))

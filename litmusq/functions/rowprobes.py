"""The probes for one text in Python, for trusted scorer code that calls them by name.

Each is the formula of the Column probe of the same kind; tests hold the two
against each other.  Tables are never scored with these.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from litmusq.functions import lexicons as L

_TOKEN = re.compile("[a-zA-Z]{3,}")


def _low(text: str | None) -> str:
    return (text or "").lower()


def _clamp(x: float) -> float:
    return max(0.0, min(1.0, float(x)))


def _tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(_low(text))


def content(text: str | None) -> set[str]:
    return set(_tokens(text)) - set(L.STOP_WORDS)


def _present(low: str, markers: Iterable[str]) -> int:
    return sum(m in low for m in markers)


def _hits(toks: Iterable[str], words: Iterable[str]) -> int:
    known = set(words)
    return sum(t in known for t in toks)


def _capitalised(text: str | None) -> int:
    return len(re.findall(L.CAPITALISED, text or "", re.ASCII))


def _word_count(text: str) -> int:
    return max(1, len(text.split()))


def hard(text: str | None, anchor: str | None) -> bool:
    """Does the text make any claim that the anchor doesn't support?"""
    t, a, low, alow = text or "", anchor or "", _low(text), _low(anchor)
    if set(re.findall(L.NUMBER, t, re.ASCII)) - set(re.findall(L.NUMBER, a, re.ASCII)):
        return True
    if any(w in low and w not in alow for words in (L.NUMERIC_WORDS, L.AWARDS, L.GUARANTEES) for w in words):
        return True
    if any(re.search(p, low, re.ASCII) and not re.search(p, alow, re.ASCII) for p in (*L.TIME_QUANTITY, *L.CUSTOMER_CLAIMS)):
        return True
    return any(m.group().lower() not in alow for m in re.finditer(L.COMPANY_NAME, t, re.ASCII))


def source_continuity(text: str, anchor: str) -> float:
    a, t = content(anchor), content(text)
    if not a:
        return 0.5

    def kept(words: Iterable[str]) -> float:
        own = a & set(words)
        return len(own & t) / len(own) if own else 0.5

    return _clamp(0.5 * len(a & t) / len(a) + 0.25 * kept(L.ACTION_WORDS) + 0.25 * kept(L.DOMAIN_NOUNS))


def argument_progression(text: str) -> float:
    p, m, r = (_present(_low(text), x) > 0 for x in (L.PROBLEM_MARKERS, L.MECHANISM_MARKERS, L.RESULT_MARKERS))
    worth = [(p and m and r, 1.0), (m and r, 0.7), (p and r, 0.5), (m, 0.4)]
    return next((v for met, v in worth if met), 0.0)


def _places(low: str, marker: str) -> list[int]:
    return [m.start() for m in re.finditer(f"(?={re.escape(marker)})", low)]


def real_mechanism_quality(text: str) -> float:
    low = _low(text)
    windows = [low[i : i + 80] for marker in L.WINDOW_MARKERS for i in _places(low, marker)]
    return _clamp(sum(0.15 * _hits(_TOKEN.findall(w), L.CONCRETE_TERMS) - 0.4 * _present(w, L.FAKE_MECHANISMS) for w in windows))


def abstract_jargon_density(text: str) -> float:
    toks = _tokens(text)
    return _clamp(_hits(toks, L.JARGON) / max(1.0, len(toks) / 10))


def specificity_without_invention(text: str, anchor: str) -> float:
    toks = _tokens(text)
    return 0.0 if hard(text, anchor) else _clamp(_capitalised(text) * 0.08 + _hits(toks, L.SPECIFIC_VERBS) * 0.15 - _hits(toks, L.JARGON) * 0.06)


def mechanism_result_alignment(text: str) -> float:
    low = _low(text)

    def side(markers: list[str], first: list[str], second: list[str], gain: float, cost: float, missing: float) -> float:
        clauses = [re.split("[.!?]", low[i + len(m) : i + len(m) + 80])[0] for m in markers for i in _places(low, m)]
        total = 0.0 if clauses else -missing
        for clause in clauses:
            toks = re.findall("[a-z]{3,}", clause)
            a, b = _hits(toks, first) > 0, _hits(toks, second) > 0
            total += gain * a + gain * b - (cost if _hits(toks, L.CLAUSE_JARGON) > 2 and not a and not b else 0.0)
        return total

    return _clamp(side(L.CLAUSE_MECHANISMS, L.CLAUSE_ACTIONS, L.CLAUSE_OBJECTS, 0.2, 0.25, 0.3) + side(L.CLAUSE_RESULTS, L.CLAUSE_CONSEQUENCES, L.CLAUSE_OPERATIONS, 0.15, 0.2, 0.2))


def causal_density(text: str) -> float:
    sentences = len(re.split("[.!?]", text.strip()))
    return _clamp(_present(text.lower(), L.CAUSAL_MARKERS) / max(1.0, sentences * 1.5))


def specificity(text: str) -> float:
    toks = _tokens(text)
    return _clamp(_capitalised(text) * 0.08 + _hits(toks, L.GENERAL_VERBS) * 0.15 - _hits(toks, L.ABSTRACT_WORDS) * 0.05)


def audience_relevance(text: str) -> float:
    second = len(re.findall(r"\b(?:you|your)\b", text.lower(), re.ASCII))
    return _clamp(_present(text.lower(), L.BEFORE_STATE) * 0.3 + second / max(1.0, _word_count(text) / 8) * 0.5)


def persuasion_risk(text: str) -> float:
    return _clamp(_present(text.lower(), L.HYPE_FLAGS) / max(1.0, _word_count(text) / 15))


def epistemic_calibration(text: str) -> float:
    hedges, best = _present(text.lower(), L.HEDGES), _present(text.lower(), L.SUPERLATIVES)
    density = best / max(1.0, _word_count(text) / 20)
    return _clamp(0.1 - density * 0.1) if density > 0.4 else _clamp(0.5 + hedges * 0.1 - best * 0.1)


_PROBES: list[Callable[..., float]] = [
    source_continuity, argument_progression, real_mechanism_quality, abstract_jargon_density, specificity_without_invention, mechanism_result_alignment,
    causal_density, specificity, audience_relevance, persuasion_risk, epistemic_calibration,
]
#: What scorer code may name.
NAMES: dict[str, object] = {f"probe_{f.__name__}": f for f in _PROBES} | {
    "violates_hard_source_policy": hard,
    "_ctoks": content,
    "_action_words": lambda text: content(text) & set(L.ACTION_WORDS),
    "_domain_nouns": lambda text: content(text) & set(L.DOMAIN_NOUNS),
    "STOP": set(L.STOP_WORDS),
    "HYPE_WORDS": list(L.HYPE_FLAGS),
    "JARGON_WORDS": set(L.JARGON),
    "FAKE_MECH_PHRASES": list(L.FAKE_MECHANISMS),
}

"""Sentence units of texts in many languages and scripts.

The rules are the standard ones on the sentence-break property of characters
(terminators of every script, closers, spaces, continuing punctuation, letter
case), with three additions: words after which a full stop abbreviates, by
language; quotations and brackets, which are not cut inside and end a sentence
only where the text does not go on; and the layout (blank lines, headings,
bullets and numbered lines).  Thai has no terminators; white space between two
Thai letters parts its sentences.

Positions are code points, 0-based, the end exclusive, white space at the edges
left out.  A null, empty or blank text has no sentence.  Equal texts are cut
alike, whatever their language tag: the tag only chooses abbreviations, and an
unknown one allows those of every language.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Words after which a full stop never ends a sentence, by language.
TITLES: dict[str, frozenset[str]] = {
    "en": frozenset("mr mrs ms dr prof st rev gen col capt lt sgt hon messrs e.g i.e cf vs viz approx ca c incl excl resp".split()),
    "de": frozenset("dr prof hr hrn fr frl dipl ing z.b d.h u.a o.ä s.o s.u i.d.r bzw ca vgl ggf evtl inkl exkl zzgl bspw sog geb gest mind max vs einschl gem lt st".split()),
    "fr": frozenset("m mm mme mlle mmes dr pr me st ste p.ex c.-à-d c-à-d env cf vs av apr boul ex".split()),
    "es": frozenset("sr sra srta sres dr dra d dña prof lic ing ud uds p.ej ej aprox cf vs av avda c.c pág".split()),
    "hi": frozenset("डॉ पृ श्री प्रो सं क्र रु".split()),
    "ar": frozenset("د م أ ص ج ت هـ".split()),
}
#: Words after which a full stop before a number belongs to the reference.
REFERENCES: dict[str, frozenset[str]] = {
    "en": frozenset("no nos fig figs sec secs vol vols ch chap p pp par art eq tab app ver ex sect pt jan feb mar apr jun jul aug sep sept oct nov dec avg min max ed".split()),
    "de": frozenset("nr nrn abb abs art kap bd s seite tab anl ziff jan feb mär apr jun jul aug sep sept okt nov dez std min sek tel".split()),
    "fr": frozenset("no nos n fig figs vol chap p pp art tab ann janv févr avr juil sept oct nov déc éd".split()),
    "es": frozenset("núm núms no nº fig figs vol cap pág págs p pp art tab ene feb mar abr jun jul ago sep sept oct nov dic tel".split()),
}
#: German month names; words before a day or an ordinal number.
_MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jänner".split())
_BEFORE_ORDINAL = frozenset("am vom bis zum der die das den dem des im ab seit beim nach und jeder jede jedes jeden".split())
#: What follows a Japanese quotation that the sentence goes on after.
_QUOTING = "とってなのはがをにもで、，,"

_BREAK = r"(?>\r\n|[\n\r\x0b\x0c\x85  ])"
_BLANK = regex.compile(rf"{_BREAK}(?:[^\S\n\r\x0b\x0c\x85  ]*{_BREAK})+| ")
_LINE = regex.compile(_BREAK)
_MARK = regex.compile(r"[^\S\n\r]*(?:(?P<bullet>[-*+•‣▪●◦·–])|(?P<number>\(?\d{1,3}[.)])|(?P<heading>#{1,6}))[^\S\n\r]+\S")
_THAI = r"[\p{Thai}--[๐-๙฿]]"
_THAI_GAP = regex.compile(rf"(?<={_THAI})\s+(?={_THAI})", regex.V1)
_STOPS = regex.compile(r"(?:[\p{SB=STerm}\p{SB=ATerm}…]|(?<=[\p{SB=STerm}\p{SB=ATerm}])\s(?=[?!]))+")
_CLOSERS = regex.compile(r"(?:[\"'”’»›」』）】〉》\)\]\}*_`]|[   ](?=»)|“(?![\p{L}\p{N}]))*")
_NEXT = regex.compile(r"(?:\s|[\p{So}\p{Sk}‍️])*")
#: Quotations and brackets of any length; each class of characters ends at the next mark of its kind, so looking for them is linear.
_QUOTES = regex.compile(
    r'(?<![\p{L}\p{N}])"[^"]+"|“[^“”]+”|„[^„“”]+[“”]|«[^«»]+»|‹[^‹›]+›|「[^「」]+」|『[^『』]+』|\([^()]+\)|（[^（）]+）|\[[^\[\]]+\]'
)
_WORD_BEFORE = regex.compile(r"[\p{L}\p{M}\p{N}º°]+(?:[.\-’'][\p{L}\p{M}\p{N}\-]+)*$")
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}_]+")
_TOKEN_BEFORE = regex.compile(r"(?r)[\p{L}\p{M}\p{N}_]+")
_CAMEL = regex.compile(r"\p{Ll}+\p{Lu}[\p{L}\p{N}]*")
_OPENERS = "\"'“„«‹「『（([{¿¡—–*_`<"


def _known(table: dict[str, frozenset[str]], lang: str | None) -> frozenset[str]:
    base = (lang or "").lower().split("-")[0].split("_")[0]
    return table[base] if base in table else frozenset().union(*table.values())


class _Rules:
    def __init__(self, lang: str | None) -> None:
        self.titles = _known(TITLES, lang)
        self.references = _known(REFERENCES, lang)
        base = (lang or "").lower().split("-")[0].split("_")[0]
        self.german = base not in ("en", "fr", "es")

    def _abbreviates(self, text: str, at: int, gap: int) -> bool:
        """Does the full stop at ``at`` abbreviate?  gap: where the text goes on, behind space and signs."""
        m = _word_before(text, at)
        if not m:
            return False
        word = m.group()
        low = word.lower()
        nxt = text[gap]
        if low in self.titles or (low.rpartition(".")[2] in self.titles and "." in low and len(low.rpartition(".")[2]) > 1):
            return True
        if nxt.isnumeric() and (low in self.references or low.rpartition(".")[2] in self.references):
            return True
        last = word.rpartition(".")[2]
        token = _TOKEN.match(text, gap)
        t = token.group() if token else ""
        if len(last) == 1 and last.isalpha():
            # initials and letters in a row: D. Maelik, z. B., p. ex.
            if len(t) == 1 and text[gap + 1 : gap + 2] == ".":
                return True
            if last.isupper() and nxt.isupper() and word != "I":
                return True
            if not last.isupper() and "." not in word and nxt.isnumeric():
                return True
            if low in ("p", "z", "d", "u", "o", "c") and len(t) <= 3 and text[gap + len(t) : gap + len(t) + 1] == ".":
                return True
        if self.german and word.isdigit() and len(word) <= 2 and nxt.isupper():
            before = _TOKEN_BEFORE.search(text, 0, m.start())
            prior = before.group().lower() if before else ""
            if t.lower() in _MONTHS or prior in _BEFORE_ORDINAL:
                return True
        return False

    def breaks(self, text: str, begin: int, end: int) -> list[int]:
        """Where sentences of the running text [begin, end) end, but for its own end."""
        spans: list[tuple[int, int]] = []
        at = begin
        while m := _QUOTES.search(text, at, end):
            spans.append(m.span())
            at = m.end()
        starts = [s for s, _ in spans]
        out: list[int] = [m.start() for m in _THAI_GAP.finditer(text, begin, end) if not self._inside(spans, starts, m.start())]
        since = begin
        for m in _STOPS.finditer(text, begin, end):
            if out and m.start() < since:
                continue
            stop_end = m.end()
            held = self._inside(spans, starts, m.start())
            closed = _CLOSERS.match(text, stop_end, end).end()  # type: ignore[union-attr]
            quoted = None
            if held is not None:
                # inside a quotation only its last stop can end the sentence around it
                if closed < held[1]:
                    continue
                quoted = held
                closed = max(closed, held[1])
            if closed >= end:
                continue
            gap = _NEXT.match(text, closed, end).end()  # type: ignore[union-attr]
            if gap >= end:
                continue
            nxt = text[gap]
            spaced = gap > closed and any(c.isspace() for c in text[closed:gap])
            stop = m.group().strip()
            if self._ends(text, m.start(), since, stop, closed, gap, nxt, spaced, quoted, end):
                out.append(closed)
                since = closed
        return sorted(set(out))

    @staticmethod
    def _inside(spans: list[tuple[int, int]], starts: list[int], at: int) -> tuple[int, int] | None:
        i = bisect_right(starts, at) - 1
        return spans[i] if i >= 0 and spans[i][0] < at < spans[i][1] else None

    def _ends(self, text: str, at: int, since: int, stop: str, closed: int, gap: int, nxt: str, spaced: bool, quoted: tuple[int, int] | None, end: int) -> bool:
        wide = any(c in "。！？．｡" for c in stop)
        if nxt in ",;:،؛，、；：)]}" or (nxt in "—–-" and not text[gap + 1 : gap + 2].isspace() and quoted is None and _lower_after(text, gap)):
            return False
        if quoted is not None:
            bracket = text[quoted[0]] in "([（"
            opens = not _TOKEN.search(text, since, quoted[0])  # the sentence begins with the quotation
            if wide or _cjk(nxt):
                if bracket:
                    return opens
                if nxt in _QUOTING and text[quoted[1] - 1] in "」』":
                    return False
                return not opens or nxt in _OPENERS
            if not spaced:
                return nxt.isupper() and not opens
            if nxt.islower():
                return bool(_CAMEL.match(text, gap)) and bracket
            if bracket:
                return opens or nxt.isupper()
            if nxt.isupper() or nxt.isnumeric() or nxt in _OPENERS:
                return True
            return False  # scripts without case: the text goes on after a quotation
        if wide:
            return True
        if all(c in ".…" for c in stop):
            if stop == "." and self._abbreviates(text, at, gap):
                return False
            if not spaced:
                # a lost space: a word, a full stop and a capitalised word
                before = text[max(0, at - 3) : at]
                return stop == "." and len(before) == 3 and before[1:].isalpha() and before[1:].islower() and nxt.isupper() and text[gap + 1 : gap + 2].islower()
            if nxt.islower():
                return stop == "." and bool(_CAMEL.match(text, gap))
            return True
        if not spaced:
            return nxt.isupper() or nxt in "¿¡" or _cjk(nxt) or stop[-1] in "।॥" or (text[closed - 1] in "؟" and nxt.isalpha())
        if nxt.islower():
            return bool(_CAMEL.match(text, gap))
        return True


def _word_before(text: str, at: int) -> regex.Match | None:
    """The word, with its inner dots and hyphens, that ends at ``at``; looked for in a window that grows with it."""
    size = 32
    while True:
        begin = max(0, at - size)
        m = _WORD_BEFORE.search(text, begin, at)
        if not m or m.start() > begin or begin == 0:
            return m
        size *= 8


def _lower_after(text: str, at: int) -> bool:
    m = _TOKEN.search(text, at)
    return bool(m) and m.group()[0].islower()


def _cjk(c: str) -> bool:
    return bool(c) and ("぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿" or c in "「『（“《【")


def segment(text: str | None, lang: str | None = None, rules: _Rules | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit of a text."""
    if not text:
        return []
    rules = rules or _Rules(lang)
    out: list[tuple[int, int]] = []

    def add(a: int, b: int) -> None:
        part = text[a:b]
        lead = len(part) - len(part.lstrip())
        kept = part.strip()
        if kept:
            out.append((a + lead, a + lead + len(kept)))

    def run(a: int, b: int) -> None:
        at = a
        for cut in rules.breaks(text, a, b):
            add(at, cut)
            at = cut
        add(at, b)

    at = 0
    for blank in [*_BLANK.finditer(text), None]:
        a, b = at, blank.start() if blank else len(text)
        at = blank.end() if blank else b
        if not text[a:b].strip():
            continue
        lines, p = [], a
        for m in [*_LINE.finditer(text, a, b), None]:
            q = m.start() if m else b
            lines.append((p, q))
            p = m.end() if m else b
        running: int | None = None
        listed = False
        for i, (p, q) in enumerate(lines):
            mark = _MARK.match(text, p, q)
            own = False
            if mark:
                before = text[lines[i - 1][0] : lines[i - 1][1]].rstrip() if i else ""
                fresh = i == 0 or listed or before[-1:] in ":.!?。！？।：" or not before
                own = fresh if (mark["number"] or mark["bullet"]) else True
            if own:
                if running is not None:
                    run(running, p)
                    running = None
                add(p, q)
                listed = True
            else:
                if running is None:
                    running = p
                listed = False
        if running is not None:
            run(running, b)
    return out


def _segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str | None, _Rules] = {}
    for batch in batches:
        counts, spans = [], []
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            key = (lang or "").lower().split("-")[0][:8]
            if key not in known:
                known[key] = _Rules(key)
            found = segment(text, lang, known[key])
            counts.append(len(found))
            spans.extend(found)
        owner = pa.array(np.repeat(np.arange(batch.num_rows), counts))
        begin, end = zip(*spans) if spans else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(owner), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "start_pos", "end_pos"])


def sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos): one row per sentence of every document."""
    return documents.select("doc_id", "text", "lang").mapInArrow(_segment, "doc_id bigint, start_pos bigint, end_pos bigint")

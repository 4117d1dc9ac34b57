"""Defective responses to prompts, by ordered rules.

The rules look at the whole text and every triggered one is kept, in this order:

empty           null, blank, without a letter or digit, or only a placeholder
copy            the words of the anchor once or twice, up to one word, or behind a label
refusal         a phrase of declining, in one of the languages, outside of quotations; how long
                the response is doesn't matter, but a response that has already given an
                answer (the anchor's words, at the anchor's length) before it declines isn't one
wrong_language  mostly in another script or language than the anchor
truncated       an unclosed delimiter, even before a full stop, or an abrupt end: inside a word or
                sentence by the evidence of the corpus (``endings``); a mark put behind the end is
                taken off

A null anchor has no words, so nothing copies it and no language differs from
it.  Repeated rows of a pair_id count once; a null pair_id is dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmusq.llm.endings import LEAST_END, ends_closed, judge, tail_of, word_keys
from litmusq.llm.languages import QUOTED, differs
from litmusq.llm.truncation import bare
from litmusq.plans.lineage import materialise
from litmusq.sources.tables import latest

FIELDS = ("positive", "negative")
ORDER = ("empty", "copy", "refusal", "wrong_language", "truncated")
_WORD = re.compile(r"[^\W_]+")
#: What stands where an answer is missing.
_PLACEHOLDER = regex.compile(r"\W*(?:n\s*/?\s*a|none|null|nil|nan|empty|undefined|tbd|todo|(?:no|not?|missing) (?:answer|response|reply|output|text|data)(?: given)?|unanswered|missing|keine antwort|leer|sans réponse|pas de réponse|vide|aucune réponse|sin respuesta|vacío|ninguna)\W*", regex.I)
_LABEL = regex.compile(r"^[\s>#*_\-]*(?:[\p{L}\p{N}'’]+[ \t]*){1,4}:\s+")
_ACT = r"(?:help|assist|write|draft|answer|complete|continue|produce|improve|rewrite|provide|do (?:that|this|it)|fulfil|comply|generate|create|support|discuss|share|respond|reply|proceed|engage|offer|work on|fulfill|address|give|make|take (?:that|this) on)"
#: Phrases of declining by language, behind words of which a phrase of the language holds one.
_REFUSALS: list[tuple[tuple[str, ...], regex.Pattern]] = [
    (words, regex.compile("|".join(phrases), regex.I))
    for words, phrases in (
        (  # English
            ("not", "n't", "unable", "declin", "refuse", "pass on", "outside what", "beyond what", "against my", "possible", "blocked", "disabled", "unavailable", "off limits",),
            [
                rf"\bi(?:'m| am) (?:very |so |truly )?(?:sorry|afraid)\b[^.!?]{{0,30}}\b(?:can ?not|can't|won't|unable|not able)\b",
                rf"\bi (?:can ?not|can't|can not|could not|couldn't|won't be able to|will not be able to|won't|will not|am not able to|am unable to|am not allowed to|am not permitted to) (?:\w+ly )?{_ACT}\b",
                rf"\bi'm (?:not able|unable|not allowed|not permitted) to (?:\w+ly )?{_ACT}\b",
                r"\bi (?:must|have to|need to|'ll have to|will have to) (?:respectfully |politely )?(?:decline|refuse|pass on)\b",
                r"\b(?:outside|beyond) what i(?:'m| am) (?:permitted|allowed|able|meant|supposed)\b",
                r"\bnot be (?:appropriate|right|proper) for me to\b",
                r"\b(?:does|do|did|will) ?(?:not|n't) (?:allow|let|permit|enable) me to?\b",
                r"\bi (?:do not|don't|would not|wouldn't) feel comfortable\b",
                r"\bagainst my (?:guidelines|guideline|policy|policies|rules|principles|instructions|programming)\b",
                r"\bi (?:have been|was|am|'ve been) (?:set up|instructed|told|programmed|configured|designed|asked) not to\b",
                r"\bno \w+ is possible (?:here|for)\b|\b(?:is|are) (?:blocked|disabled|unavailable|not available|off limits) (?:for|to) (?:this|the) (?:model|assistant|system)\b",
            ],
        ),
        (  # German
            ("nicht", "ablehnen", "verzichten", "passen",),
            [
                r"\b(?:darf|kann|werde|möchte) ich (?:\P{P}+ )?(?:nicht|nichts)\b|\bich (?:darf|kann|werde) (?:\P{P}+ )?(?:nicht|nichts) (?:\P{P}+ )?(?:schreiben|helfen|beantworten|bearbeiten|weiterhelfen|verfassen|antworten|erledigen|ausführen|erstellen)\b",
                r"\b(?:muss|möchte) ich [^.!?]{0,80}(?:ablehnen|verzichten|passen)\b",
                r"\b(?:ist|bin) (?:es )?(?:mir|ich) (?:leider )?nicht (?:erlaubt|gestattet|möglich|befugt|berechtigt)\b|\bich bin (?:leider )?nicht (?:befugt|berechtigt|in der lage)\b",
            ],
        ),
        (  # French
            ("je ne", "il m", "je dois", "je suis", "je préfère", "je refuse", "je décline",),
            [
                r"\bje ne (?:peux|puis|pourrai|saurais|suis) (?:malheureusement )?(?:pas|rien) ?(?:autorisée?|habilitée?|en mesure|écrire|répondre|aider|vous aider|traiter|rédiger|continuer|donner|faire)?\b",
                r"\bil m['’]est (?:impossible|interdit)\b",
                r"\bje (?:dois|suis obligée? de|suis contrainte? de|préfère) (?:refuser|décliner|renoncer)\b|\bje (?:refuse|décline)\b",
            ],
        ),
        (  # Spanish
            ("no ", "rechazar", "declinar", "negarme", "rehusar",),
            [
                r"\bno (?:puedo|podré|podría) (?:ayudar|escribir|responder|atender|redactar|continuar|completar|contestar|hacer|tratar|seguir|ofrecer|dar)\w*\b",
                r"\bno (?:me )?(?:está|es|ha sido) (?:permitido|posible|autorizado)\b|\bno me (?:permiten|permite|dejan)\b|\bno estoy (?:autorizad|en condiciones|facultad)\w*\b",
                r"\b(?:debo|tengo que|he de|me veo obligad[oa] a) (?:rechazar|declinar|negarme|rehusar)\b",
            ],
        ),
        (  # Italian
            ("non ", "rifiutar", "declinar",),
            [
                r"\bnon (?:posso|potrei|potrò|sono in grado di|mi è (?:permesso|consentito|possibile)|sono autorizzat[oa] a) (?:aiutar|scriver|risponder|continuar|fornir|completar|assister|elaborar|proseguir|far)\w*",
                r"\b(?:devo|sono costrett[oa] a) (?:rifiutar|declinar)\w*",
            ],
        ),
        (  # Portuguese
            ("não", "recusar",),
            [
                r"\bnão (?:posso|poderei|consigo|me é (?:permitido|possível)|estou (?:autorizad[oa]|em condições)) (?:a |de )?(?:ajud|escrev|respond|continu|fornec|complet|auxili|atend|redig|prossegu)\w*",
                r"\b(?:devo|tenho (?:de|que)) recusar\b",
            ],
        ),
        (  # Dutch
            ("niet", "geen", "weigeren", "afwijzen",),
            [
                r"\b(?:ik kan|kan ik|ik mag|mag ik)\b[^.!?]{0,60}\b(?:niet|niets|geen)\b[^.!?]{0,60}\b(?:helpen|schrijven|beantwoorden|uitvoeren|assisteren|meewerken)\b",
                r"\bik moet [^.!?]{0,60}(?:weigeren|afwijzen)\b",
            ],
        ),
        (  # Russian
            ("я не",),
            [
                r"\bя не (?:могу|имею права|в состоянии|буду) (?:вам )?(?:помочь|написать|ответить|продолжить|выполнить|предоставить)",
            ],
        ),
        (  # Chinese, Japanese, Korean
            ("无法", "不能", "不可以", "没办法", "無法", "できません", "できかね", "いたしかね", "お断り", "수",),
            [
                r"(?:我|本助手)(?:很抱歉，?)?(?:无法|不能|不可以|没办法|無法)(?:为您|为你|帮您|帮你|協助|协助|帮助|幫助|回答|提供|完成|撰写|处理|继续)",
                r"(?:お手伝い|お答え|回答|対応|作成|提供|協力)(?:する(?:こと|の)は|は)?(?:できません|できかねます|いたしかねます)|お断り(?:します|いたします)",
                r"(?:도와\s?드릴|답변해?\s?드릴|도울|답할|작성할) 수 (?:가 )?없(?:습니다|어요)",
            ],
        ),
        (  # Arabic, Hindi, Thai
            ("لا ", "أعتذر", "أرفض", "नहीं", "ไม่สามารถ",),
            [
                r"لا (?:أستطيع|يمكنني|أقدر) (?:أن )?(?:المساعدة|مساعدت|أساعد|الإجابة|أجيب|كتابة|أكتب|تقديم)|(?:أعتذر|أرفض) عن",
                r"मैं [^।.!?]{0,60}(?:मदद|सहायता|उत्तर|जवाब) [^।.!?]{0,30}(?:नहीं (?:कर|दे) सकत)",
                r"(?:ผม|ฉัน|ดิฉัน|เรา)?ไม่สามารถ(?:ช่วย|ตอบ|เขียน|ให้ข้อมูล|ดำเนินการ)",
            ],
        ),
    )
]
#: Part of the anchor's different words that what stands before a declining phrase must hold to be an answer.
ANSWERED = 0.5


def is_empty(text: str | None) -> bool:
    return not text or not _WORD.search(text) or bool(_PLACEHOLDER.fullmatch(text))


def _one_apart(words: list[str], own: list[str]) -> bool:
    """At most one word added, left out or changed, whatever their order."""
    if abs(len(words) - len(own)) > 1:
        return False
    a, b = Counter(words), Counter(own)
    return (a - b).total() <= 1 and (b - a).total() <= 1


def is_copy(text: str, anchor: str) -> bool:
    own = _WORD.findall(anchor.lower())
    if not own:
        return False
    words = _WORD.findall(text.lower())
    if _one_apart(words, own) or _one_apart(words, own + own):
        return True
    label = _LABEL.match(text)
    if not label:
        return False
    words = _WORD.findall(text[label.end() :].lower())
    return bool(words) and (_one_apart(words, own) or _one_apart(words, own + own))


def is_refusal(text: str, anchor: str | None = None) -> bool:
    plain = QUOTED.sub(" ", text.replace("’", "'"))
    low = plain.lower()
    found = [m.start() for words, phrase in _REFUSALS if any(w in low for w in words) and (m := phrase.search(plain))]
    if not found:
        return False
    before, own = _WORD.findall(plain[: min(found)].lower()), _WORD.findall((anchor or "").lower())
    answered = bool(own) and len(before) >= len(own) and len(set(before) & set(own)) >= ANSWERED * len(set(own))
    return not answered


def unclosed(text: str) -> bool:
    """A quotation or bracket that is opened and never closed."""
    return bool(text.count('"') % 2 or text.count("(") > text.count(")") or text.count("“") > text.count("”") + text.count("„") or text.count("«") > text.count("»") or text.count("```") % 2)


def look(text: str | None, anchor: str | None) -> tuple[list[str], list[int], str | None]:
    """(defects seen in the text itself, runs at its end to ask the corpus about, last word)."""
    if is_empty(text):
        return ["empty"], [], None
    assert text is not None
    found = []
    if anchor and is_copy(text, anchor):
        found.append("copy")
    if is_refusal(text, anchor):
        found.append("refusal")
    if anchor and differs(text, anchor):
        found.append("wrong_language")
    kept, _ = bare(text)
    if unclosed(kept):
        return [*found, "truncated"], [], None
    if ends_closed(kept):
        return found, [], None
    runs, word = tail_of(kept)
    return found, runs, word


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = [look(t, a) for t, a in zip(batch.column("text").to_pylist(), batch.column("anchor").to_pylist())]
        found, runs, word = zip(*seen) if seen else ((), (), ())
        arrays = [batch.column("pair_id"), batch.column("field"), pa.array(found, pa.list_(pa.string())), pa.array(runs, pa.list_(pa.int64())), pa.array(word, pa.string()), word_keys(list(word))]
        yield pa.RecordBatch.from_arrays(arrays, ["pair_id", "field", "defects", "runs", "word", "word_key"])


def defects(pairs: DataFrame) -> DataFrame:
    """(pair_id, field, defects): every triggered defect of each response, in order; empty for sound ones."""
    one = materialise(latest(pairs, "pair_id", ["ingested_at", "ord"], ["pair_id", "anchor", *FIELDS]), "responses")
    texts = one.select("pair_id", "anchor", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS])).alias("x")).select("pair_id", "anchor", "x.field", "x.text")
    seen = materialise(texts.mapInArrow(_look, "pair_id string, field string, defects array<string>, runs array<bigint>, word string, word_key bigint"), "seen")
    corpus = one.select(F.explode(F.array("anchor", *FIELDS)).alias("text")).select("text", F.lit(False).alias("ends"))
    evidence = judge(seen.where(F.size("runs") > 0), corpus)
    unknown = (F.col("known") <= 1) & F.col("word").rlike(r"^\p{Ll}")
    cut = F.coalesce(F.col("stump") | (F.col("end_share") < LEAST_END) | (F.col("end_share").isNull() & unknown), F.lit(False))
    told = evidence.select("pair_id", "field", F.when(cut, F.concat("defects", F.array(F.lit("truncated")))).otherwise(F.col("defects")).alias("defects"))
    return seen.where(F.size("runs") == 0).select("pair_id", "field", "defects").unionByName(told)


def found_defects(pairs: DataFrame) -> DataFrame:
    """(pair_id, field, defect): the first defect in order of each defective response."""
    return defects(pairs).where(F.size("defects") > 0).select("pair_id", "field", F.get("defects", 0).alias("defect"))


def defect_report(pairs: DataFrame) -> DataFrame:
    """(field, defect, responses): how often each defect is triggered, alone or with others."""
    return defects(pairs).select("field", F.explode("defects").alias("defect")).groupBy("field", "defect").agg(F.count(F.lit(1)).alias("responses"))

"""Which language a text is mostly written in, from function words and scripts."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import regex

#: Frequent function words; a word may belong to several languages.
FUNCTION_WORDS: dict[str, frozenset[str]] = {
    "en": frozenset("the a an and of to is that it for with as on in by this are be from at or not have has had they which you we our their was were will can so if what when where who how its than then into before after every each only your between under without while during across lets let two one three first do does did been up out us use uses used help helps way".split()),
    "de": frozenset("der die das und den dem des ein eine einen einem einer ist nicht mit von zu zum zur im in auf für sich als auch wir sie ich wird werden sind hat haben bei nach aus oder wenn dass damit sodass jede jeden jeder durch ohne über unser unsere ihre ihrer am an noch kann können zwischen während vor zwei drei bis so um denn nutzen hilft wie nie".split()),
    "fr": frozenset("le la les des du de d l un une et en est que qu qui dans pour pas sur avec au aux à ce cette ces il elle ils nous vous je ne n plus par sont leur leurs son sa ses notre nos votre mais ou où afin sans chaque après avant puis chez lui être entre deux trois même car ainsi grâce permet fin".split()),
    "es": frozenset("el la los las de del un una y es en que por para con a al su sus lo como más pero este esta estos no se le les nos sin cada sobre entre cuando donde después antes nuestra nuestro porque hasta así está son junto dos tres gracias puede pueden permite fin sí".split()),
    "it": frozenset("il lo la gli i di dei della delle e è un una in che per con nel nella non si sono come più anche questo questa ma alla alle dal dalla senza ogni".split()),
    "nl": frozenset("het de een en in van niet met voor op aan dat die zijn wordt worden ook maar bij naar uit als dan zonder elke onze hun wij".split()),
    "sv": frozenset("och att det som en ett på är av för med den till inte har de om var ett men så kan från när vi hur ut efter varje utan mellan".split()),
    "pl": frozenset("i w na z do nie się to że jest od po dla przez o jak ale czy tak już oraz aby bez każdy między gdy który która które".split()),
    "tr": frozenset("ve bir bu için ile de da olarak daha her çok olan gibi kadar ama ne değil mi sonra önce göre tüm".split()),
    "pt": frozenset("o os a as de do da dos das um uma e é em que para com não se por mais como ao mas seu sua sem cada entre quando nosso nossa até".split()),
}
_SCRIPTS = {
    "zh": regex.compile(r"\p{Han}"), "ja": regex.compile(r"[\p{Hiragana}\p{Katakana}]"), "ko": regex.compile(r"\p{Hangul}"), "ar": regex.compile(r"\p{Arabic}"),
    "hi": regex.compile(r"\p{Devanagari}"), "th": regex.compile(r"\p{Thai}"), "ru": regex.compile(r"\p{Cyrillic}"), "el": regex.compile(r"\p{Greek}"), "he": regex.compile(r"\p{Hebrew}"),
}
_RANK = {lang: i for i, lang in enumerate(FUNCTION_WORDS)}
_WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*")
#: Quotations of any length; each class of characters ends at the next mark of its kind, so looking for them is linear.
QUOTED = regex.compile(r"\"[^\"]+\"|“[^“”]+”|„[^„“”]+[“”]|«[^«»]+»")


_OTHER = regex.compile(r"[^\p{Latin}\p{Common}\p{Inherited}]")
_BY_WORD: dict[str, list[str]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words:
        _BY_WORD.setdefault(_w, []).append(_lang)


def scores(text: str) -> Counter[str]:
    """Function words of each Latin-script language; letters over four, of each other script."""
    found: Counter[str] = Counter()
    for w in _WORD.findall(text.lower()):
        parts = {w, *w.replace("’", "'").split("'")} if "'" in w or "’" in w else (w,)
        for part in parts:
            for lang in _BY_WORD.get(part, ()):
                found[lang] += 1
    if _OTHER.search(text):
        for lang, script in _SCRIPTS.items():
            n = len(script.findall(text))
            if n:
                found[lang] += n // 4 + 1
    return found


@lru_cache(maxsize=50_000)
def language(text: str) -> str | None:
    """The language with most evidence, None without any."""
    got = scores(text)
    return max(got, key=lambda k: (got[k], -_RANK.get(k, 99))) if got else None


def differs(text: str, anchor: str) -> bool:
    """True if ``text`` is mostly in another language than ``anchor``; quotations don't count.

    It takes at least three signs of the other language, and more than one and
    a half times as many as of the anchor's.  An anchor without any sign is
    taken to be in Latin script if its letters are; another script differs.
    """
    own = language(anchor)
    plain = QUOTED.sub(" ", text)
    got = scores(plain if _WORD.search(plain) else text)
    if not got or (own is None and not _WORD.search(anchor)):
        return False
    best = max(got, key=lambda k: (got[k], k == own, -_RANK.get(k, 99)))
    if best == own or (own is None and best in FUNCTION_WORDS):
        return False
    return got[best] >= 3 and got[best] >= 1.5 * got[own] + 1

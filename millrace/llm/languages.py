"""Which language a short text is written in: scripts first, then function words and letters."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache

#: Function words by language, and letters that few other languages use.
FUNCTION_WORDS = {
    "en": "the is are was of and to in for with our your that this it at on by from has have does do what which who how when why until before after above near no not yes only about up an each there be will would can they you we their its these or if as so because while",
    "de": "der die das den dem des ein eine einen einem einer ist sind und oder für mit ohne nach vor über bei zu zum zur auf aus von im am nicht kein keine wie was wer wann warum wenn aber denn dass sich wird werden bis nur ja nein eine wirkt man es ich",
    "fr": "le la les l un une des du de est sont et ou pour avec sans dans sur sous par ne pas que qui quoi quand comment pourquoi si mais car donc au aux ce cette ces il elle on nous vous je à en une fois jusqu d qu n s avant après pendant oui non selon",
    "es": "el la los las un una unos unas de del es son y o para con sin por en sobre que qué quién cómo cuándo cuánto si pero porque al se su sus no sí lo le esto esta este hasta antes después durante según así cada donde más",
    "it": "il lo la i gli le un uno una di del della dello dei degli delle è sono e per con senza in nel nella sul sulla che chi come quando perché se ma al alla allo dopo prima fino non sì ogni da dal dalla questo questa volta alle",
    "nl": "de het een en van voor met zonder aan op in is zijn na bij naar niet geen wat wie hoe wanneer waarom als maar want dat die deze dit te tot uit over eens per om door wordt ook nog vóór boven aan",
    "pl": "i w we z ze na do od po przez dla bez nie tak jest są się że co kto jak kiedy dlaczego ale albo oraz lub przed nad pod przy o u za raz ten ta to te tego tej który która gdy jeśli tylko",
    "pt": "o a os as um uma de do da dos das é são e ou para com sem por em no na nos nas que quem como quando se mas porque ao à não sim isto esta este até antes depois durante cada após",
    "sv": "och att det som en ett den är på av för med till inte om i har de från vid efter utan men eller när hur vad var kan ska",
    "da": "og at det som en et den er på af for med til ikke om i har de fra ved efter uden men eller når hvordan hvad hvor kan skal",
    "cs": "a v ve z ze na do od po pro bez ne je jsou se že co kdo jak kdy proč ale nebo před nad pod při o u za jen když jednou",
    "ro": "și în cu fără de la pe un o este sunt nu da ce cine cum când dacă dar sau pentru după înainte din care",
    "tr": "ve bir bu için ile değil mi ne kim nasıl neden ama veya gibi çok daha sonra önce kadar her de da",
}
_LETTERS = {
    "de": "äöüß", "fr": "çèêùûîïœë", "es": "ñ¿¡áíóú", "pl": "łąężźśćńó", "it": "àèìòù", "pt": "ãõçâê",
    "sv": "åäö", "da": "æøå", "cs": "ěščřžýů", "ro": "șțăâî", "tr": "ğışçöü",
}
_SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARABIC", "HEBREW", "DEVANAGARI", "THAI", "HANGUL", "HIRAGANA", "KATAKANA", "CJK", "ARMENIAN", "GEORGIAN", "BENGALI", "TAMIL")
#: A word of letters; parts of names after a hyphen and codes with digits are none.
_WORD = re.compile(r"(?<![\w-])[^\W\d_]+(?!\w*\d)")
_LETTER = re.compile(r"[^\W\d_]")
#: Beyond the Latin letters of Europe.
_FAR = re.compile(r"[^\x00-\u024f]")
_MARKED = re.compile(r"[^\x00-\x7f]")


def _weights() -> dict[str, tuple[tuple[str, float], ...]]:
    lists = {lang: set(words.split()) for lang, words in FUNCTION_WORDS.items()}
    shared = Counter(w for words in lists.values() for w in words)
    by: dict[str, list[tuple[str, float]]] = defaultdict(list)
    for lang, words in lists.items():
        for w in words:
            by[w].append((lang, 1.0 / shared[w]))
    return {w: tuple(held) for w, held in by.items()}


_WEIGHTS = _weights()
_MARKS = {c: [lang for lang, cs in _LETTERS.items() if c in cs] for c in {c for cs in _LETTERS.values() for c in cs}}


@lru_cache(maxsize=65_536)
def _script_of(char: str) -> str:
    name = unicodedata.name(char, "")
    return next((s for s in _SCRIPTS if name.startswith(s)), "OTHER")


def script(text: str) -> str | None:
    """The script of most letters; null without letters."""
    if not _FAR.search(text):
        return "LATIN" if _LETTER.search(text) else None
    seen = Counter(_script_of(c) for c in text if c.isalpha())
    if not seen:
        return None
    top = seen.most_common(1)[0][0]
    return "CJK" if top in ("HIRAGANA", "KATAKANA") else top


def evidence(text: str, lexicon: dict[str, str] | None = None) -> dict[str, float]:
    """Per language the weight of its function words and letters, and of the words that a lexicon
    gives to it; words two languages share count for each by half, and so on."""
    score: dict[str, float] = defaultdict(float)
    low = text.lower()
    words = _WORD.findall(low)
    for held in filter(None, map(_WEIGHTS.get, words)):
        for lang, weight in held:
            score[lang] += weight
    if lexicon:
        for lang, n in Counter(filter(None, map(lexicon.get, words))).items():
            score[lang] += 0.5 * n
    if not low.isascii():
        for c in _MARKED.findall(low):
            for lang in _MARKS.get(c, ()):
                score[lang] += 0.6 / len(_MARKS[c])
    return score


#: A word of the lexicon comes in at least so many texts, and such a share of them in its language.
LEAST_TEXTS, LEAST_SHARE = 3, 0.9


def lexicon_words(text: str) -> tuple[str, set[str]]:
    """The language that a text's function words leave no doubt of, and its words in lower case, so
    that names stay out; no words where there is doubt."""
    ranked = sorted(evidence(text).items(), key=lambda kv: -kv[1])[:2]
    if ranked and ranked[0][1] >= 2 and (len(ranked) < 2 or ranked[0][1] >= 2 * ranked[1][1]):
        return ranked[0][0], {w for w in _WORD.findall(text) if len(w) > 2 and w.islower()}
    return "", set()


def lexicon_of(words: dict[str, str]) -> dict[str, str]:
    """A lexicon without the function words, which have weights of their own."""
    return {w: lang for w, lang in words.items() if w not in _WEIGHTS}


def learn_lexicon(texts: list[str], least: int = LEAST_TEXTS, share: float = LEAST_SHARE) -> dict[str, str]:
    """Words that come nearly always in texts of one language, learned from the texts whose
    function words leave no doubt."""
    seen: dict[str, Counter] = defaultdict(Counter)
    for t in texts:
        language, words = lexicon_words(t)
        for w in words:
            seen[w][language] += 1
    out = {}
    for w, by in seen.items():
        lang, n = by.most_common(1)[0]
        if n >= least and n >= share * sum(by.values()):
            out[w] = lang
    return lexicon_of(out)


def other_language(question: str, answer: str, lexicon: dict[str, str] | None = None, given: dict[str, float] | None = None) -> bool:
    """Whether the answer is written in another language than the question.

    Scripts that differ decide at once. Else the answer's strongest language must beat the
    question's clearly; texts with little evidence (numbers, names, a word) are in any language.
    ``given`` is the answer's evidence where it is known already.
    """
    a, b = script(question), script(answer)
    if a is None or b is None:
        return False
    if a != b:
        return True
    if given is None:
        given = evidence(answer, lexicon)
    best = max(given, key=lambda k: (given[k], k), default="")
    if given.get(best, 0.0) < 1.0:
        return False
    asked = evidence(question, lexicon)
    own = max(asked, key=lambda k: (asked[k], k), default="")
    if best == own or asked.get(own, 0.0) < 0.5 or len(_WORD.findall(answer)) < 3:
        return False
    return given[best] >= 1.6 * given.get(own, 0.0) + 0.4 and asked[own] > asked.get(best, 0.0)

"""Length, vocabulary, syntax and cohesion of texts, counted over whole batches of characters at once."""

from __future__ import annotations

import unicodedata

import numpy as np

_LETTER, _SPACE, _STOP, _BREAK, _COMMA, _DIGIT, _BRACKET, _KNOWN = (np.uint8(1 << k) for k in range(8))
_CLASS = np.zeros(0x110000, np.uint8)
_LOWER = np.arange(0x110000, dtype=np.uint32)
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F)
#: Characters that are counted at a time; a longer text is a chunk of its own.
CHUNK = 1_000_000

# Words that open a clause, and words that tie a sentence to the one before.
SUBORDINATORS = frozenset(
    "that which who whose whom because although though while when where whether if unless until since before after so as than dass weil obwohl während wenn wo ob bevor nachdem damit sodass falls der die das "
    "que qui dont parce quoique lorsque quand où si afin puisque avant après como porque aunque cuando donde cuyo cuya mientras pues antes después".split()
)
CONNECTIVES = frozenset(
    "however therefore thus moreover furthermore also then next finally first second instead meanwhile hence besides otherwise still jedoch daher deshalb außerdem zudem ferner auch dann zuerst schließlich trotzdem also hingegen "
    "cependant donc ainsi ensuite aussi puis enfin toutefois pourtant néanmoins embargo además también entonces luego finalmente primero tanto asimismo".split()
)
PRONOUNS = frozenset("he she it they him her them his its their this these those er sie es ihm ihn ihr ihnen dies diese dieser il elle ils elles lui leur ce cette ces él ella ellos ellas le les su sus este esta estos estas".split())

FEATURES = [
    "log_words", "sentence_mean", "sentence_q25", "sentence_median", "sentence_q75", "sentence_q90", "sentence_max", "sentence_spread",
    "letters_mean", "letters_spread", "share_to_3", "share_from_5", "share_from_9", "share_from_12", "richness", "once", "commonest",
    "commas", "brackets", "digits", "clauses", "capitals", "overlap", "connectives", "pronouns",
]


def _classify(codes: np.ndarray) -> None:
    """Fill the tables for characters that come for the first time."""
    for c in np.flatnonzero(np.bincount(codes, minlength=0x110000)[:0x110000]):
        if not _CLASS[c]:
            char, kind = chr(c), unicodedata.category(chr(c))
            bits = _KNOWN
            bits |= _LETTER if kind[0] == "L" else np.uint8(0)
            bits |= _SPACE if kind[0] == "Z" or c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 133) else np.uint8(0)
            bits |= _STOP if char in ".!?" else np.uint8(0)
            bits |= _BREAK if char in "\n\r" else np.uint8(0)
            bits |= _COMMA if char in ",;:" else np.uint8(0)
            bits |= _DIGIT if kind == "Nd" else np.uint8(0)
            bits |= _BRACKET if char in "()[]{}" else np.uint8(0)
            low = char.lower()
            _LOWER[c] = ord(low) if len(low) == 1 else c
            _CLASS[c] = bits


def _powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]), dtype=np.uint64) if n else np.zeros(0, np.uint64)


def _hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit number per word, the same for the same letters: differences of one running sum."""
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(low.astype(np.uint64) * _powers(len(low), _BASE), dtype=np.uint64)])
        h = (total[ends] - total[starts]) * _powers(len(low), pow(_BASE, -1, 1 << 64))[starts]
        h = (h ^ (h >> np.uint64(31))) * _MIX
        return h ^ (h >> np.uint64(29))


def _numbers(words: frozenset[str]) -> np.ndarray:
    out = []
    for w in sorted(words):
        low = np.array([ord(c) for c in w], np.uint32)
        out.append(_hashes(low, np.array([0]), np.array([len(low)]))[0])
    return np.array(out, np.uint64)


_LISTS = {"clauses": _numbers(SUBORDINATORS), "connectives": _numbers(CONNECTIVES), "pronouns": _numbers(PRONOUNS)}


def _quantiles(values: np.ndarray, groups: np.ndarray, n: int, shares: list[float]) -> list[np.ndarray]:
    """Per group the values at the given shares of its sorted values (0 for empty groups)."""
    order = np.lexsort((values, groups))
    sizes = np.bincount(groups, minlength=n)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    sorted_values = np.append(values[order], 0)
    return [np.where(sizes > 0, sorted_values[np.minimum(first + ((sizes - 1) * s).astype(int), len(values))], 0).astype(float) for s in shares]


def _chunk(texts: list[str]) -> dict[str, np.ndarray]:
    n = len(texts)
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    _classify(codes)
    kind = _CLASS[codes]
    edges = np.cumsum([len(t) + 1 for t in texts])  # a text ends before its line break
    letter = np.concatenate([[0], (kind & _LETTER).astype(np.int8), [0]])
    step = np.diff(letter)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    space = np.append((kind & _SPACE)[1:] != 0, True)
    ending = ((kind & _BREAK) != 0) | (((kind & _STOP) != 0) & space)
    sentence = (np.cumsum(ending) - ending)[starts]
    doc = np.searchsorted(edges, starts, side="right")
    size = (ends - starts).astype(float)
    words = np.bincount(doc, minlength=n)
    w = np.maximum(words, 1)

    def per_word(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc[mask], minlength=n) / w

    # sentences with a word, numbered over the chunk
    fresh = np.concatenate([[True], sentence[1:] != sentence[:-1]]) if len(sentence) else np.zeros(0, bool)
    place = np.cumsum(fresh) - 1
    in_sentence = np.bincount(place) if len(place) else np.zeros(0, int)
    sentence_doc = doc[fresh]
    sentences = np.bincount(sentence_doc, minlength=n)
    k = np.maximum(sentences, 1)
    mean = words / k
    squares = np.bincount(sentence_doc, in_sentence.astype(float) ** 2, n) / k
    q25, median, q75, q90, most = _quantiles(in_sentence.astype(float), sentence_doc, n, [0.25, 0.5, 0.75, 0.9, 1.0])

    low = _LOWER[codes]
    h = _hashes(low, starts, ends)
    with np.errstate(over="ignore"):
        by_doc = (h + doc.astype(np.uint64)) * _MIX
        key, at, count = np.unique(by_doc ^ (by_doc >> np.uint64(32)), return_index=True, return_counts=True)
        kinds = np.bincount(doc[at], minlength=n)
        once = np.bincount(doc[at[count == 1]], minlength=n)
        commonest = np.zeros(n)
        np.maximum.at(commonest, doc[at], count)
        # distinct longer words of each sentence, and whether the sentence before has them too
        content = size >= 4
        hs, ps = h[content], place[content].astype(np.uint64)
        mine = (hs + ps) * _MIX
        _, first = np.unique(mine, return_index=True)
        before = np.isin(mine[first], (hs + ps + np.uint64(1)) * _MIX)
    where = place[content][first]
    held, shared = np.bincount(where, minlength=len(in_sentence)), np.bincount(where, before, len(in_sentence))
    later = np.concatenate([[False], sentence_doc[1:] == sentence_doc[:-1]]) if len(sentence_doc) else np.zeros(0, bool)
    tied = np.where(held > 0, shared / np.maximum(held, 1), 0.0)
    overlap = np.bincount(sentence_doc[later], tied[later], n) / np.maximum(np.bincount(sentence_doc[later], minlength=n), 1)

    marks = lambda bit: np.bincount(np.searchsorted(edges, np.flatnonzero(kind & bit), side="right"), minlength=n)[:n] / k
    letters = np.bincount(doc, size, n) / w
    out = {
        "words": words, "sentences": sentences, "score": mean + 100.0 * np.bincount(doc[size > 6], minlength=n) / w,
        "log_words": np.log1p(words), "sentence_mean": mean, "sentence_q25": q25, "sentence_median": median, "sentence_q75": q75, "sentence_q90": q90, "sentence_max": most,
        "sentence_spread": np.sqrt(np.maximum(squares - mean * mean, 0)),
        "letters_mean": letters, "letters_spread": np.sqrt(np.maximum(np.bincount(doc, size * size, n) / w - letters * letters, 0)),
        "share_to_3": per_word(size <= 3), "share_from_5": per_word(size >= 5), "share_from_9": per_word(size >= 9), "share_from_12": per_word(size >= 12),
        "richness": np.log1p(kinds) / np.log1p(w), "once": once / w, "commonest": commonest / w,
        "commas": marks(_COMMA), "brackets": marks(_BRACKET), "digits": marks(_DIGIT), "capitals": per_word((codes[starts] != low[starts]) & ~fresh), "overlap": overlap,
    }
    for name, numbers in _LISTS.items():
        out[name] = np.bincount(doc[np.isin(h, numbers)], minlength=n) / k
    return out


def distributions(texts: list[str | None]) -> dict[str, np.ndarray]:
    """Counts, the score and every one of ``FEATURES`` for each text; 0 for null and blank texts.

    A word is a run of letters; a sentence ends at . ! ? before white space or the end of the text,
    or at a line break, and counts if it has a word. ``score`` is words / sentences + 100 x (words
    of over 6 letters) / words. Texts are measured whole.
    """
    whole = [t or "" for t in texts]
    parts, start, held = [], 0, 0
    for i, t in enumerate(whole):
        if held and held + len(t) > CHUNK:
            parts.append(_chunk(whole[start:i]))
            start, held = i, 0
        held += len(t) + 1
    parts.append(_chunk(whole[start:]))
    return {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}

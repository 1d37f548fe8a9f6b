"""Whether a text without a closing mark is finished: a logistic model of how sentences end."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np

from .languages import learn_lexicon

_WORD = re.compile(r"[^\W_]+|[^\w\s]")
_END = re.compile(r"[.!?…](?=\s|$)")
_SIZE = 1 << 17


_DIGITS = re.compile(r"\d+")


def _norm(token: str) -> str:
    """In lower case, numbers as 0."""
    return _DIGITS.sub("0", token.lower())


def _tail(text: str) -> list[str]:
    found = _WORD.findall(text[-120:])
    # the first may be cut by the slice
    return found[-4:] if len(text) <= 120 else found[1:][-4:]


def features(text: str, known: set[str]) -> list[int]:
    """Hashed features of the last words: the words in their order, endings of the last one, its
    shape, and whether it is a word of the vocabulary."""
    tail = _tail(text)
    if not tail:
        return [zlib.crc32(b"none") % _SIZE]
    w = [_norm(t) for t in tail]
    is_known = w[-1] in known
    shape = ("C" if tail[-1][:1].isupper() else "c") + ("#" if "0" in w[-1] else "") + str(min(len(w[-1]), 4)) + ("k" if is_known else "u")
    before = w[-2] if len(w) > 1 else "^"
    names = [f"1{w[-1]}", f"2{before} {w[-1]}", f"3{' '.join(w[-3:])}", f"4{' '.join(w[-4:])}", f"e{w[-1][-3:]}", f"f{w[-1][-2:]}", f"s{shape}", f"b{before}|{shape}", f"c{' '.join(w[-3:-1])}|{shape}", f"k{is_known}"]
    return [zlib.crc32(n.encode()) % _SIZE for n in names]


@dataclass
class EndingModel:
    weights: np.ndarray
    known: set[str]
    lexicon: dict[str, str] = field(default_factory=dict)

    def finished(self, text: str) -> float:
        """Probability that the text ends where a sentence may end."""
        return float(1 / (1 + np.exp(-self.weights[features(text, self.known)].sum())))


#: A word of the vocabulary comes in at least so many texts.
LEAST_TEXTS = 2


def vocabulary_words(text: str) -> set[str]:
    """The words of a text; without a closing mark all but the last, which may be cut."""
    found = _WORD.findall(_norm(text))
    return set(found if _END.search(text[-2:]) else found[:-1])


def train_endings(texts: list[str], epochs: int = 4, rate: float = 0.25, seed: int = 3, known: set[str] | None = None, lexicon: dict[str, str] | None = None) -> EndingModel:
    """Self-supervised: sentences without their closing mark are finished, the same sentences cut at
    a random place are not. ``texts`` is a bounded sample. The vocabulary and the lexicon are those
    of the whole corpus where given, else of ``texts``."""
    rng = np.random.default_rng(seed)
    if known is None:
        counts: dict[str, int] = {}
        for t in texts:
            for w in vocabulary_words(t):
                counts[w] = counts.get(w, 0) + 1
        known = {w for w, n in counts.items() if n >= LEAST_TEXTS}
    rows: list[list[int]] = []
    labels: list[int] = []
    for t in texts:
        start = 0
        for m in _END.finditer(t):
            sentence = t[start : m.start()]
            if len(sentence) > 8:
                rows.append(features(t[: m.start()], known))
                labels.append(1)
                for _ in range(2):
                    cut = start + int(rng.integers(len(sentence) // 4, len(sentence)))
                    head = t[:cut].rstrip()
                    if len(head) > start:
                        rows.append(features(head, known))
                        labels.append(0)
            start = m.end()
            while start < len(t) and t[start].isspace():
                start += 1
    weights, seen = np.zeros(_SIZE), np.full(_SIZE, 1e-6)
    width = max((len(r) for r in rows), default=1)
    x = np.array([r + [-1] * (width - len(r)) for r in rows], np.int64).reshape(-1, width)
    y = np.array(labels, float)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for s in range(0, len(x), 64):
            part = x[order[s : s + 64]]
            mask = part >= 0
            z = (weights[part] * mask).sum(1)
            g = (1 / (1 + np.exp(-z)) - y[order[s : s + 64]])[:, None] * mask
            np.add.at(seen, part[mask], g[mask] ** 2)
            np.add.at(weights, part[mask], -rate * g[mask] / np.sqrt(seen[part[mask]]))
    return EndingModel(weights.astype(np.float32), known, learn_lexicon(texts) if lexicon is None else lexicon)

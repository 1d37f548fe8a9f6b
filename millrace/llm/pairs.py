"""Problem 2: broken prompt and response pairs, each flagged with its kind of defect."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import SPACE
from .endings import LEAST_TEXTS, EndingModel, train_endings, vocabulary_words
from .languages import LEAST_SHARE, evidence, lexicon_of, lexicon_words, other_language
from .languages import LEAST_TEXTS as LEAST_LEXICON_TEXTS
from .refusals import is_refusal, likely_languages
from .structure import dangling, overlap_bound, tiles

#: Most texts that the model of endings is fitted on; drawn by a hash of the id.
MAX_TRAINING_TEXTS = 20_000
#: Most words of the vocabulary, and of the lexicon, that are broadcast; the most frequent ones.
MAX_WORDS = 500_000
#: Most counts that a task holds before it passes them on.
MAX_COUNTS = 200_000
#: A copy covers so much of its question, and its question so much of it.
COPY_OF_QUESTION, COPY_OF_ANSWER = 0.8, 0.75

#: What stands for no content, in lower case, without marks at its ends.
PLACEHOLDERS = frozenset((
    "none", "null", "nil", "nan", "n/a", "na", "n.a", "tbd", "tba", "tbc", "todo", "empty", "blank", "undefined", "missing", "no answer", "no response",
    "not available", "not applicable", "no content", "no data", "to be done", "to be determined", "answer", "response", "a", "k.a", "keine antwort",
    "keine angabe", "keine angaben", "leer", "antwort", "néant", "aucune", "aucun", "pas de réponse", "vide", "réponse", "sans objet", "s/o", "ninguna",
    "ninguno", "sin respuesta", "vacío", "respuesta", "nada", "no disponible", "nessuno", "vuoto", "leeg", "geen", "brak",
))
_FENCE = re.compile(r"(```+|~~~+)[^\S\n]*\w*[^\S\n]*(\n|$)")
_MARKED, _ALNUM = re.compile(r"[<&]|```|~~~"), re.compile(r"[^\W_]")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|&nbsp;|<!--.*?-->", re.S)
_WORDS = re.compile(r"[^\W_]+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_LEAD = re.compile(r"^\s*(>+|q\s*[:.)]|question\s*:|you asked\s*:|your question( was)?\s*:|frage\s*:|sie fragten\s*:|ihre frage\s*:|vous avez demandé\s*:|votre question\s*:|pregunta\s*:|usted preguntó\s*:|su pregunta\s*:|the question (is|was)\s*:)\s*", re.I)
_TAILMARK = re.compile(r"\s+[–—-]+\s*(ok|okay|done|thanks|end|fin|ende|danke|merci|gracias|vale|fertig)\s*$", re.I)
_CLOSED = re.compile(r"[.!?…。！？][\"'”“»’)\]*_`]*$")
#: Words that no phrase ends with.
OPEN_WORDS = frozenset("the a an of and or to in for with by from our your der die das den dem ein eine und oder mit für von le la les un une des du de et ou pour avec el los las una y o para con por sin".split())
_ITEM = re.compile(r"^\s*(?:\d{1,3}[.)]|[-*•+])\s+")
_ELLIPSIS = re.compile(r"\w\s*(\.\.\.|…)[\"'”»)]*$")


def is_empty(text: str | None) -> bool:
    """No letter or digit outside fences, tags and invisible characters, or a word for nothing."""
    if text is None:
        return True
    if len(text) > 60 and not _MARKED.search(text):
        return not _ALNUM.search(text)
    visible = "".join(c for c in text if unicodedata.category(c) not in ("Cf", "Cc") or c in "\n\t") if not text.isascii() else text
    if _EDGES.sub("", visible.lower()) in PLACEHOLDERS:
        return True
    bare = _EDGES.sub("", _TAG.sub(" ", _FENCE.sub("\n", visible)).lower())
    return not any(c.isalnum() for c in bare) or bare in PLACEHOLDERS


def _letter_pairs(words: list[str]) -> Counter:
    joined = "".join(words)
    return Counter(joined[i : i + 2] for i in range(len(joined) - 1))


def is_copy(question: str, answer: str) -> bool:
    """Gives back the question and nothing more: tiles cover nearly all of both. A question given
    back several times is tiled against itself as often. Slips inside words, which break tiles, are
    seen by pairs of letters."""
    asked = _WORDS.findall(question.lower())
    given = _WORDS.findall(_LEAD.sub("", answer).lower())
    if not asked or not given:
        return False
    size = sum(map(len, asked)), sum(map(len, given))
    if min(size) > 8 and max(size) <= 1.15 * min(size):
        a, b = _letter_pairs(asked), _letter_pairs(given)
        if 2 * sum((a & b).values()) >= 0.88 * (sum(a.values()) + sum(b.values())):
            return True
    times = max(1, round(len(given) / len(asked)))
    # a second time must be as good as the first: an answer after the question often says much of it again
    least = max(COPY_OF_QUESTION * len(asked), COPY_OF_ANSWER * len(given)) if times == 1 else 0.92 * max(times * len(asked), len(given))
    its = set(asked)
    if sum(w in its for w in given) < least:
        return False
    if times <= 4:
        asked = asked * times
        if overlap_bound(asked, given) < least:
            return False
        covered, count = tiles(asked, given)
    else:  # one time after the other: tiling grows with the square of what it tiles
        cuts = [len(given) * k // times for k in range(times + 1)]
        parts = [tiles(asked, given[a:b]) for a, b in zip(cuts, cuts[1:])]
        covered, count = (sum(x) for x in zip(*parts))
    return covered >= least and count <= 2 + 2 * times


def is_truncated(text: str, model: EndingModel) -> bool:
    """Breaks off: something is left open, or it stops where no sentence of the corpus stops."""
    body = text.strip()
    if dangling(body):
        return True
    if _ELLIPSIS.search(body):
        return True
    if _CLOSED.search(body):
        return False
    body = _TAILMARK.sub("", body)
    last = body[-1:]
    if last in ")]}”»\"`*>":
        return False
    if not last.isalnum() and last not in "%°€$£'’+":
        return True
    lines, words = body.splitlines(), _WORDS.findall(body.lower())
    if words[-1] in OPEN_WORDS:
        return True
    if len(words) <= 3 and len(lines) == 1:  # a fragment is an answer unless it stops in a word
        return not (last.isdigit() or words[-1] in model.known or body[:1].isupper() or body[:1].isdigit())
    items = [x.strip() for x in lines if _ITEM.match(x)]
    if len(items) > 2 and items[-1] == lines[-1].strip() and not any(_CLOSED.search(x) for x in items[:-1]):
        # items of a list that does without closing marks: only a stump is cut
        return not (words[-1] in model.known or _ITEM.sub("", items[-1]).split()[-1][:1].isupper() or last.isdigit() or words[-1] in _WORDS.findall("\n".join(lines[:-1]).lower()))
    return model.finished(lines[-1] if len(lines) > 1 else body) < 0.5


def defect(question: str | None, answer: str | None, model: EndingModel) -> str | None:
    """The answer's one defect, or null. Order: empty, copy, refusal, language, truncated."""
    if is_empty(answer):
        return "empty"
    asked = question or ""
    if asked.strip() and is_copy(asked, answer):
        return "copy"
    given = evidence(answer, model.lexicon)
    if is_refusal(answer, likely_languages(given)):
        return "refusal"
    if other_language(asked, answer, model.lexicon, given):
        return "refusal" if is_refusal(answer) else "language"
    return "truncated" if is_truncated(answer, model) else None


def corpus_words(triples: DataFrame) -> tuple[set[str], dict[str, str]]:
    """The vocabulary and the lexicon of all answers and follow-ups; texts are counted where they are
    read, words and counts travel."""
    texts = triples.select(F.explode(F.array("answer", "follow_up_a")).alias("text")).where("text is not null")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter] = defaultdict(Counter)
        frame = lambda: pd.DataFrame([(w, lang, n) for lang, words in seen.items() for w, n in words.items()], columns=["word", "language", "n"])
        for b in batches:
            for t in b["text"]:
                seen[""].update(vocabulary_words(t))
                language, words = lexicon_words(t)
                seen[language].update(words)
                if len(seen[""]) > MAX_COUNTS:
                    yield frame()
                    seen.clear()
        if seen:
            yield frame()

    counted = texts.mapInPandas(count, "word string, language string, n long").groupBy("word", "language").agg(F.sum("n").alias("n"))
    counted = durable(counted, "words")
    common = counted.where((F.col("language") == "") & (F.col("n") >= LEAST_TEXTS)).orderBy(F.desc("n"), "word").limit(MAX_WORDS)
    by_word = counted.where("language <> ''").groupBy("word").agg(F.max_by("language", "n").alias("language"), F.max("n").alias("n"), F.sum("n").alias("_all"))
    own = by_word.where((F.col("n") >= LEAST_LEXICON_TEXTS) & (F.col("n") >= LEAST_SHARE * F.col("_all"))).orderBy(F.desc("n"), "word").limit(MAX_WORDS)
    lexicon = own.select("word", "language").toPandas()
    return set(common.select("word").toPandas()["word"]), lexicon_of(dict(zip(lexicon["word"], lexicon["language"])))


def fit_endings(triples: DataFrame, max_texts: int = MAX_TRAINING_TEXTS, seed: int = 9) -> EndingModel:
    """The model of endings. Its weights are fitted on at most ``max_texts`` answers drawn by a hash of
    the triple's id; its vocabulary and lexicon are counted over all answers and follow-ups."""
    known, lexicon = corpus_words(triples)
    total = triples.count()
    draw = F.xxhash64("triple_id", F.lit(seed))
    share = min(1.0, 1.2 * max_texts / max(total, 1))
    some = triples.where(draw <= int(-(2**63) + share * (2**64 - 1))) if share < 1 else triples
    some = some.select(draw.alias("_d"), "triple_id", "answer").where("answer is not null").orderBy("_d", "triple_id", "answer").limit(max_texts)
    return train_endings(some.select("answer").toPandas()["answer"].tolist(), known=known, lexicon=lexicon)


def broken_pairs(triples: DataFrame, model: EndingModel) -> DataFrame:
    """``(triple_id, field, defect)`` of every pair with a defect; field ``answer`` or ``follow_up_a``.

    ``answer`` is judged against ``question``; ``follow_up_a`` against ``follow_up_q``, and only
    where that is not null or blank. A null question leaves the checks that need none. Each text is
    judged whole, where it is read; only verdicts are shuffled. Of deliveries repeating a triple the
    latest ``created_at`` counts (then the greatest verdict); rows without an id take no part.
    """
    cols = triples.select("triple_id", "created_at", "question", "answer", "follow_up_q", "follow_up_a").where("triple_id is not null")
    blank = F.coalesce(F.regexp_replace("follow_up_q", f"[{SPACE}]", ""), F.lit("")) == ""
    cols = cols.withColumn("_asked", ~blank)
    id_type = cols.schema["triple_id"].dataType.simpleString()
    at_type = cols.schema["created_at"].dataType.simpleString()
    shared = triples.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        text = lambda v: v if isinstance(v, str) else None
        for b in batches:
            first = [defect(text(q), text(a), m) for q, a in zip(b["question"], b["answer"])]
            second = [defect(text(q), text(a), m) if asked else None for q, a, asked in zip(b["follow_up_q"], b["follow_up_a"], b["_asked"])]
            yield pd.DataFrame({"triple_id": b["triple_id"], "created_at": b["created_at"], "answer": pd.Series(first, dtype=object), "follow_up_a": pd.Series(second, dtype=object)})

    judged = cols.mapInPandas(judge, f"triple_id {id_type}, created_at {at_type}, answer string, follow_up_a string")
    verdict = F.struct("created_at", "answer", "follow_up_a")
    best = judged.groupBy("triple_id").agg(F.max(verdict).alias("_v")).select("triple_id", "_v.answer", "_v.follow_up_a")
    long = best.select("triple_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("defect")) for f in ("answer", "follow_up_a")))).alias("_e"))
    return long.select("triple_id", "_e.field", "_e.defect").where("defect is not null")

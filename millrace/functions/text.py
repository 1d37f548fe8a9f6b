"""Scalar text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic in a question.
STOP_WORDS = (
    "what how why when where who which can could would should does the a an is are was were "
    "be been being have has had do did will shall may might must to of in for on with at by "
    "from about into through during before after above between and but or not no if then so that "
    "this it its you your me my we our they their tell explain describe hey please thanks "
    "difference mean work works know thing things"
).split()

# Phrases by which a question leans on its source text.
SOURCE_PHRASES = (
    "the text", "the passage", "the document", "the chunk", "mentioned in", "according to the",
    "based on the reading", "the article", "this section", "the paragraph",
)
SOURCE_PHRASES_MULTIHOP = ("passage a", "passage b", "the text", "the document", "the passage", "the chunk", "according to")

# Questions too vague to keep.
VAGUE_QUESTIONS = (
    "what is important?", "tell me more.", "can you explain?",
    "what else?", "anything else?", "what do you think?",
)

#: Word characters of any script; Java's own \w knows ASCII only.
WORD = r"[\p{L}\p{N}_]+"


def strip(c: Column) -> Column:
    """Without white space at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def split_sentences(text: Column, longer_than: int = 20) -> Column:
    """Sentences in order: split after . ! ? and white space or at blank lines, stripped, and only
    those of more than ``longer_than`` characters. Null text gives null."""
    parts = F.split(text, r"(?<=[.!?])\s+|\n\n+")
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) > longer_than)


def tokenise(text: Column) -> Column:
    """Lower-case word tokens in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def key_terms(text: Column) -> Column:
    """Tokens of more than two characters that are no stop words."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(tokenise(text), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))


def expand_query(text: Column) -> Column:
    """Query tokens followed by the key terms again, which doubles the weight of those terms."""
    plain = F.filter(key_terms(text), lambda t: t.rlike(r"^[\p{L}\p{N}]+$"))
    return F.concat(tokenise(text), plain)


def strip_fence(text: Column) -> Column:
    """Model output without a leading code fence (its whole first line, or three characters where
    there is no line break) and a trailing one."""
    t = strip(text)
    opened = F.when(F.instr(t, "\n") > 0, F.regexp_replace(t, r"^[^\n]*\n", "")).otherwise(F.substring(t, 4, 1 << 30))
    body = F.when(t.startswith("```"), opened).otherwise(t)
    return strip(F.when(t.startswith("```"), F.regexp_replace(body, r"```\s*$", "")).otherwise(body))


def long_enough(text: Column, least: int) -> Column:
    """Whether the stripped text has at least ``least`` characters; null counts as empty."""
    return F.coalesce(F.length(strip(text)), F.lit(0)) >= least


def leans_on_source(question: Column, multihop: bool = False) -> Column:
    phrases = SOURCE_PHRASES_MULTIHOP if multihop else SOURCE_PHRASES
    return F.lower(question).rlike("|".join(phrases))


def is_vague(question: Column) -> Column:
    return F.lower(strip(question)).isin(*VAGUE_QUESTIONS)


def normalise_terms(terms: Column, lower: bool = True) -> Column:
    """Trimmed (and lower-cased) terms, empty and null ones dropped."""
    clean = F.transform(terms, lambda t: F.lower(strip(t)) if lower else strip(t))
    return F.filter(clean, lambda t: t.isNotNull() & (t != ""))


def truncate(text: Column, size: int, ellipsis: str = "") -> Column:
    cut = F.substring(text, 1, size)
    return F.when(F.length(text) > size, F.concat(cut, F.lit(ellipsis))).otherwise(text) if ellipsis else cut


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays taken as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) <= 0) | (F.size(b) <= 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def word_set(text: Column) -> Column:
    """Distinct white-space separated words in lower case; empty for null."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"))
    return F.filter(words, lambda w: w != "")


def word_jaccard(a: Column, b: Column) -> Column:
    return jaccard(word_set(a), word_set(b))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def score_band(score: Column, good: float = 0.8, warn: float = 0.6) -> Column:
    return F.when(score >= good, "good").when(score >= warn, "warn").otherwise("bad")


def title_label(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def human_bytes(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(F.format_number(n / 1024, 1), F.lit(" KB")))
        .otherwise(F.concat(F.format_number(n / (1024 * 1024), 1), F.lit(" MB")))
    )


def source_context(entries: Column) -> Column:
    """``[Source: s]`` and text of each entry (struct with source_file, page_content), in order."""
    shown = F.transform(entries, lambda e: F.concat(F.lit("[Source: "), F.coalesce(e["source_file"], F.lit("unknown")), F.lit("]\n"), F.coalesce(e["page_content"], F.lit(""))))
    return F.array_join(shown, "\n\n---\n\n")


def prompt(template: str, **columns: Column) -> Column:
    """Fill ``{name}`` places of a template with columns; null reads as empty."""
    pieces, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [F.lit(head), F.coalesce(columns[name].cast("string"), F.lit(""))]
    return F.concat(*pieces, F.lit(rest))

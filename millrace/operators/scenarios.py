"""Scenarios: who asks, in what style, at what length, and what kind of question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the dimensions and shares of question types.
PERSONA_NAMES = ("beginner", "expert", "impatient", "curious_student", "non_native_speaker")
STYLE_NAMES = ("conversational", "web_search", "formal")
LENGTH_NAMES = ("short", "medium", "long")
TYPE_SHARES = {
    "factual": 0.25, "explanatory": 0.20, "procedural": 0.15, "comparative": 0.15, "inferential": 0.10, "scenario": 0.05, "multihop": 0.10,
}

#: What each name asks of a question writer.
PERSONAS = dict(zip(PERSONA_NAMES, ("somebody new to the subject, in plain words and unsure", "a specialist, exact and interested in edge cases", "somebody in a hurry, a few words and no courtesies", "a learner who wants to know why and how things hang together", "somebody writing in a second language, in short clear sentences")))
STYLES = dict(zip(STYLE_NAMES, ("as in a chat", "as keywords for a search engine", "as in a formal letter")))
LENGTHS = dict(zip(LENGTH_NAMES, ("under ten words", "ten to twenty words", "twenty to forty words with some background")))


def allowed(names: tuple[str, ...], wanted: list[str] | None) -> list[str]:
    """The wanted names that exist; all of them if none is wanted or none exists."""
    return [n for n in names if n in set(wanted or names)] or list(names)


def type_quota(n: Column) -> Column:
    """Copies of each type but multi-hop in a pool for ``n`` scenarios: its rounded share, at least
    one; halves go to the even number. An array of types, in order of the table of shares."""
    parts = [F.array_repeat(F.lit(t), F.greatest(F.lit(1), F.bround(n * share).cast("int"))) for t, share in TYPE_SHARES.items() if t != "multihop"]
    return F.concat(*parts)


def scenarios(items: DataFrame, order: str, personas: list[str] | None = None, styles: list[str] | None = None, lengths: list[str] | None = None, seed: int = 0, mixed_radix: bool = False) -> DataFrame:
    """One scenario per item, dealt in turn by the item's 0-based number ``order``.

    Persona, style and length are all picked by number modulo the length of their list, which locks
    those of equal length together; ``mixed_radix`` counts through all combinations instead. The
    type is the item's place in the pool of quotas after a seeded shuffle (an affine step through
    the pool, so no row has to be gathered); numbers past the pool start it again, never adding a
    multi-hop question.
    """
    p, s, q = allowed(PERSONA_NAMES, personas), allowed(STYLE_NAMES, styles), allowed(LENGTH_NAMES, lengths)
    i = F.col(order)
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (F.pmod(at, F.lit(len(names))) + 1).cast("int"))
    ps, ss, ls = (i, F.floor(i / len(p)), F.floor(i / (len(p) * len(s)))) if mixed_radix else (i, i, i)
    shares = [(t, round(1000 * share)) for t, share in TYPE_SHARES.items() if t != "multihop"]
    total = sum(n for _, n in shares)
    # a step prime to the total visits each of its places once a round
    step = next(k for k in range(379 + 2 * seed, 10**6) if _coprime(k, total))
    place = F.pmod(i * step + seed, F.lit(total))
    kind, upto = None, 0
    for t, n in shares:
        upto += n
        kind = F.when(place < upto, t) if kind is None else kind.when(place < upto, t)
    return items.withColumns({"persona": pick(p, ps), "query_style": pick(s, ss), "query_length": pick(q, ls), "target_type": kind})


def _coprime(a: int, b: int) -> bool:
    while b:
        a, b = b, a % b
    return a == 1


def instruction(persona: Column, style: Column, length: Column, kind: Column) -> Column:
    """Five lines that describe a scenario to a question writer."""
    look = lambda table, key: F.coalesce(*(F.when(key == name, text) for name, text in table.items()), F.lit(""))
    lines = (("Asked by: ", look(PERSONAS, persona)), ("Persona: ", persona), ("Style: ", look(STYLES, style)), ("Length: ", look(LENGTHS, length)), ("Kind: ", kind))
    return F.array_join(F.array(*(F.concat(F.lit(head), F.coalesce(text, F.lit(""))) for head, text in lines)), "\n")


def distribution_text(spark: SparkSession) -> DataFrame:
    """One row: the shares in whole per cent, without multi-hop and zero shares."""
    rows = [(k, t, s) for k, (t, s) in enumerate(TYPE_SHARES.items()) if t != "multihop" and s > 0]
    df = spark.createDataFrame(rows, "k int, question_type string, share double")
    line = F.concat(F.lit("- ~"), F.floor(F.round(F.col("share") * 100, 6)).cast("string"), F.lit("% "), F.col("question_type"))
    return df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


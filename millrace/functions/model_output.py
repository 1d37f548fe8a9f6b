"""Reading what a model returned: objects, arrays with bad items, score ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_fence

SCORES = "faithfulness double, relevance double, completeness double, tone double, follow_up_quality double"
SCORES_MULTIHOP = SCORES + ", multi_hop_validity double"
QUESTION = "question string, follow_up_q string, question_type string, difficulty string"


def parse_object(text: Column, schema: str) -> Column:
    """A struct from JSON text with or without a fence; null where it is no object of the schema."""
    body = strip_fence(text)
    return F.when(body.startswith("{"), F.from_json(body, schema, {"mode": "PERMISSIVE"}))


def parse_items(text: Column, schema: str) -> Column:
    """The good items of a JSON array: each is parsed by itself, so a bad one costs only itself.
    Text that is no array gives an empty array."""
    raw = F.from_json(strip_fence(text), "array<string>")
    items = F.filter(raw, lambda s: s.startswith("{"))
    parsed = F.filter(F.transform(items, lambda s: F.from_json(s, schema)), lambda x: x.isNotNull())
    return F.coalesce(parsed, F.from_json(F.lit("[]"), f"array<struct<{_colons(schema)}>>"))


def _colons(schema: str) -> str:
    return ", ".join(f"{name}:{kind}" for name, kind in (p.strip().split(" ", 1) for p in schema.split(",")))


def checked_scores(scores: Column, names: list[str]) -> Column:
    """The scores, or null where one of them is missing or outside [0, 1]."""
    fine = F.lit(True)
    for name in names:
        fine &= F.coalesce(scores[name].between(0, 1) & ~F.isnan(scores[name]), F.lit(False))
    return F.when(fine, scores)


def verdict_ratio(claims: Column, verdicts: Column, wanted: str) -> Column:
    """Share of verdicts equal to ``wanted``, 3 decimals; 1 without claims, 0 without verdicts."""
    hits = F.size(F.filter(verdicts, lambda v: F.lower(v) == wanted))
    n = F.size(verdicts)
    return F.when(F.coalesce(F.size(claims), F.lit(0)) <= 0, 1.0).when(F.coalesce(n, F.lit(0)) <= 0, 0.0).otherwise(F.round(hits / F.greatest(n, F.lit(1)), 3))


def share_true(flags: Column) -> Column:
    """Share of true flags, 3 decimals; 0 for none."""
    n = F.size(flags)
    return F.when(F.coalesce(n, F.lit(0)) <= 0, 0.0).otherwise(F.round(F.size(F.filter(flags, lambda f: f)) / F.greatest(n, F.lit(1)), 3))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 3 decimals; 0 where whole is 0 or null. Not clamped."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, 0.0).otherwise(F.round(F.coalesce(part, F.lit(0)) / F.nullif(whole, F.lit(0)), 3))

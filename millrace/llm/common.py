"""What several of the operators share: reading tables, key clean-up, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as Unicode has it; Java's own \s knows ASCII only.
SPACE = r"\s\p{Z}\x{1c}-\x{1f}\x{85}"
#: A token: a run of letters, digits and underscores, or any other single character but white space.
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^{SPACE}\p{{L}}\p{{N}}_]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def label(text: Column) -> Column:
    """Trimmed and in lower case; null or blank reads ``unknown``."""
    clean = F.lower(strip(text))
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit("unknown")).otherwise(clean)


def token_count(text: Column) -> Column:
    """Number of tokens; 0 for null or blank text."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def file_of(path: Column) -> Column:
    """What follows the last slash or backslash, trimmed and in lower case; null for a blank path."""
    return F.when(strip(path) != "", F.lower(strip(F.regexp_replace(path, r"^(?s:.*)[/\\]", ""))))


def usable(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score)

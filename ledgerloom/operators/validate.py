"""Checks and clean-up of wire records: vocabularies, clamps, local paths, paired fields, zero fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import bare_file
from ..functions.redact import clamp_bytes
from ..functions.text import string_leaves
from ..functions.tokens import CLASSES

#: Tool call states and the modelled event kinds.
TOOL_STATUS = ["success", "error", "denied", "cancelled", "unknown"]
MODELLED_KINDS = ["user_message", "assistant_message", "tool_call", "tool_result", "session_summary"]
FORMATS = ["text", "json"]


def flag_vocabulary(df: DataFrame, column: str, known: list[str] | DataFrame, flag: str) -> DataFrame:
    """df with whether the value is known (null: not); no row is dropped."""
    if isinstance(known, list):
        return df.withColumn(flag, F.coalesce(F.col(column).isin(known), F.lit(False)))
    words = known.select(F.col(known.columns[0]).alias("known_")).distinct().withColumn("hit_", F.lit(True))
    return df.join(words, F.col(column) == F.col("known_"), "left").withColumn(flag, F.coalesce("hit_", F.lit(False))).drop("known_", "hit_")


def clamped(df: DataFrame, limits: dict[str, int], array_limits: dict[str, int] | None = None) -> DataFrame:
    """df with texts cut to bytes and arrays to counts."""
    for c, most in limits.items():
        df = df.withColumn(c, clamp_bytes(F.col(c), most))
    for c, most in (array_limits or {}).items():
        df = df.withColumn(c, F.slice(c, 1, most))
    return df


def without_local_paths(df: DataFrame) -> DataFrame:
    """cwd null, tool_paths empty, source_file its last component; columns that are missing are skipped."""
    new = {"cwd": F.lit(None).cast("string"), "tool_paths": F.array().cast("array<string>")}
    if "source_file" in df.columns:
        new["source_file"] = bare_file(F.col("source_file"))
    return df.withColumns({k: v for k, v in new.items() if k in df.columns})


def path_leaves(values: Column) -> Column:
    """Distinct strings of an array, trimmed, in first-seen order that look like paths: a separator, no scheme,
    no blank."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v.rlike(r"[/\\]") & ~v.contains("://") & ~v.rlike(r"\s")))


def argument_paths(json: Column) -> Column:
    """The path-shaped strings of a call's arguments, at any depth and in arrays."""
    return path_leaves(string_leaves(json))


def split_paired(df: DataFrame, value: str, format_: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): value and format are both there or both not, and the format is known."""
    both = F.col(value).isNotNull() == F.col(format_).isNotNull()
    ok = both & F.coalesce(F.col(format_).isin(FORMATS), F.lit(True))
    return df.filter(ok), df.filter(~ok)


def zero_filled(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in CLASSES if c in df.columns})


def declined(df: DataFrame, kind: str, declined_kinds: DataFrame) -> DataFrame:
    """df without the record kinds that are knowingly ignored."""
    known = declined_kinds.select(F.col(declined_kinds.columns[0]).alias("kind_")).distinct()
    return df.join(known, F.col(kind) == F.col("kind_"), "left_anti")


def matches_text(columns: list[str], q: str) -> Column:
    """Whether any column holds the text, case ignored; null columns do not."""
    tests = [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(q.lower())), F.lit(False)) for c in columns]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def held(df: DataFrame, answer: str) -> tuple[DataFrame, DataFrame]:
    """(passed, held): a row without an answer is held, never passed on in weaker form."""
    return df.filter(F.col(answer).isNotNull()), df.filter(F.col(answer).isNull())

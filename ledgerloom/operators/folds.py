"""Folds of events, calls and files into a row a session, file or group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import tokens as tk


def segment_totals(segmented: DataFrame, session: str = "session_id", ts_ms: str = "ts_ms") -> DataFrame:
    """(session, segment): the five token sums, first and last stamp, and turns of rows with a ``segment``."""
    return segmented.groupBy(session, "segment").agg(*(F.sum(c).alias(c) for c in tk.CLASSES), F.min(ts_ms).alias("start_ms"), F.max(ts_ms).alias("end_ms"), F.count("*").alias("turns"))


def newest_ranked(df: DataFrame, keys: list[str], value: str, ts_ms: str) -> DataFrame:
    """(keys, value, last_ms, rank): each value of a group by when it was last seen, the newest first."""
    last = df.groupBy(*keys, value).agg(F.max(ts_ms).alias("last_ms"))
    return last.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("last_ms"), value)))


def tool_shares(calls: DataFrame, keys: list[str], tool: str, most: int = 8, longest: int = 120) -> DataFrame:
    """(keys, tool, n, confidence, rank): the most frequent tools; confidence is the share of all calls, two digits, from
    0.05 to 1.  Names over ``longest`` characters are left out after the shares are taken."""
    n = calls.groupBy(*keys, tool).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    share = F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.round(F.col("n") / F.sum("n").over(w), 2)))
    kept = n.withColumn("confidence", share).filter(F.length(tool) <= longest)
    return kept.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), tool))).filter(F.col("rank") <= most)


def tool_map(calls: DataFrame, keys: list[str], tool: str) -> DataFrame:
    """(keys, tools): a map of tool to number of calls, by name."""
    n = calls.filter(F.col(tool).isNotNull()).groupBy(*keys, tool).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(tool, "n")))).alias("tools"))


def components(files: DataFrame, keys: list[str], path: str, position: str, most: int = 8) -> DataFrame:
    """(keys, component, rank): the first distinct two-segment beginnings of paths, in the order they were seen."""
    first = files.select(*keys, paths.component(F.col(path)).alias("component"), position).groupBy(*keys, "component").agg(F.min(position).alias("at_"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("at_", "component"))).filter(F.col("rank") <= most).drop("at_")


def file_dedupe(files: DataFrame, keys: list[str], lines: str = "n", source: str = "source") -> DataFrame:
    """(keys, lines, source): a file's lines summed, with its strongest source."""
    return files.groupBy(*keys).agg(F.sum(lines).alias("lines"), F.max_by(source, tk.source_rank(F.col(source))).alias("source"))


def distinct_names(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct().orderBy(*cols)


def local_digest(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): rows by day, session and whatever else identifies what is compared with the store."""
    return events.groupBy(*keys).agg(F.count("*").alias("n"))


def spend_join(prs: DataFrame, spend: DataFrame, human: DataFrame, anchor: str) -> DataFrame:
    """prs with the sessions that ``spend`` (pr, sessions) counts for them, case ignored, and ``ai_assisted``: not
    anchored to a person (human: distinct values of ``anchor``).  A PR without spend has NULL."""
    key = F.lower("pr").alias("key_")
    counted = spend.groupBy(key).agg(F.sum("sessions").alias("sessions"))
    people = human.select(anchor).distinct().withColumn("human_", F.lit(True))
    out = prs.join(counted, F.lower(prs["pr"]) == F.col("key_"), "left").join(people, anchor, "left")
    return out.withColumn("ai_assisted", F.col("human_").isNull()).drop("key_", "human_")


def as_text(tools: Column) -> Column:
    """A map of counts as name=n, by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(tools)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")

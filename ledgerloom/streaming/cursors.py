"""Cursors and a spool that last: a pass reads from before its watermark, and moves on only after the sink's commit.

State of a source is one row (source, watermark_ms, attempts, last_ms).  A pass reads rows from ten minutes before the
watermark, as late rows may still come, and joins the spool's rows whose wait is over.  What the sink takes twice it must
take once, by key.  A pass that fails leaves the watermark where it was and counts the try; the next waits longer.  Rows
that the sink holds back go to the spool with a count of their own.  Each step is written whole, so a stop between two
steps makes the next pass send again what the sink already has, and nothing is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import backoff_over
from ..sources.files import current, replace

OVERLAP_MS = 10 * 60_000
STATE = "source string, watermark_ms bigint, attempts int, last_ms bigint"

#: sink(rows) commits rows by key and returns the keys that it holds back (None or no rows: it took all).
Sink = Callable[[DataFrame], DataFrame | None]


def cursor(spark: SparkSession, state: str, source: str) -> tuple[int | None, int, int]:
    """(watermark_ms, attempts, last_ms) of a source; None, 0, 0 before its first pass."""
    rows = current(spark, state)
    found = rows.filter(F.col("source") == source).first() if rows is not None else None
    return (found["watermark_ms"], found["attempts"], found["last_ms"]) if found else (None, 0, 0)


def set_cursor(spark: SparkSession, state: str, source: str, watermark_ms: int | None, attempts: int, last_ms: int) -> None:
    row = spark.createDataFrame([(source, watermark_ms, attempts, last_ms)], STATE)
    before = current(spark, state)
    replace(spark, (row if before is None else before.filter(F.col("source") != source).unionByName(row)).coalesce(1), state)


def advance(spark: SparkSession, source: str, rows: DataFrame, key: str, ts_ms: str, sink: Sink, state: str, spool: str, now_ms: int, overlap_ms: int = OVERLAP_MS) -> str:
    """One pass of a source: 'waiting', 'idle', 'failed' or 'sent'.

    rows: the source's rows, of which those from ``overlap_ms`` before the watermark are read (a filter on ``ts_ms``
    that reaches the scan).  Null stamps count as new.  Rows of equal keys are one.
    """
    watermark, attempts, last = cursor(spark, state, source)
    if attempts and not spark.range(1).select(backoff_over(F.lit(attempts), F.lit(last), F.lit(now_ms))).first()[0]:
        return "waiting"
    new = rows if watermark is None else rows.filter((F.col(ts_ms) >= watermark - overlap_ms) | F.col(ts_ms).isNull())
    cols, held = rows.columns, current(spark, spool)
    mine = held.filter(F.col("source_") == source) if held is not None else None
    batch = new
    if mine is not None:
        due = mine.filter(backoff_over(F.col("attempts_"), F.col("last_"), F.lit(now_ms)))
        #: A row that waits in the spool is not sent early because the overlap reads it again.
        batch = new.join(mine.select(key), key, "left_anti").select(*cols).unionByName(due.select(*cols))
    batch = batch.dropDuplicates([key])
    top = new.agg(F.max(ts_ms)).first()[0]
    if batch.isEmpty():
        return "idle"
    try:
        back = sink(batch)
    except Exception:
        set_cursor(spark, state, source, watermark, attempts + 1, now_ms)
        return "failed"
    refused = batch.join(back.select(key).distinct(), key, "left_semi").select(*cols) if back is not None else batch.limit(0)
    before = mine.select(key, "attempts_") if mine is not None else batch.limit(0).select(key, F.lit(0).alias("attempts_"))
    again = refused.join(before, key, "left").select(*cols, F.lit(source).alias("source_"), (F.coalesce("attempts_", F.lit(0)) + 1).cast("int").alias("attempts_"), F.lit(now_ms).cast("bigint").alias("last_"))
    if held is not None:
        sent = batch.select(key).withColumn("sent_", F.lit(True))
        kept = held.join(sent, key, "left").filter(F.col("sent_").isNull() | (F.col("source_") != source)).select(*again.columns)
        replace(spark, kept.unionByName(again), spool)
    elif not again.isEmpty():
        replace(spark, again, spool)
    set_cursor(spark, state, source, max(x for x in (watermark, top) if x is not None) if (watermark, top) != (None, None) else None, 0, now_ms)
    return "sent"

"""Sessions stored newest first: pages, live sessions and ready sessions read a few files instead of sorting all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .report import rows_of_first, session_page

#: Sessions of one file, about.
FILE_ROWS = 1 << 18


def write_newest_first(sessions: DataFrame, path: str, ready: Column | None = None, file_rows: int = FILE_ROWS) -> None:
    """Stores sessions (last_ms, session_id, any others) in files of ranges of (last_ms, session_id) that don't overlap, sorted inside,
    and the bounds of each file beside them: (file, oldest, newest, n, n_ready), one row a file.

    ``ready`` is stored as a column of that name (null counts as false; without it all are ready).  Sessions without a time are kept, after
    all others.
    """
    rows = sessions.withColumn("ready", F.coalesce(ready, F.lit(False)) if ready is not None else F.lit(True))
    files = max(1, -(-rows.count() // file_rows))
    order = [F.desc("last_ms"), F.desc("session_id")]
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/rows")
    stored = sessions.sparkSession.read.parquet(f"{path}/rows").select("last_ms", "ready", F.col("_metadata.file_name").alias("file"))
    timed = F.col("last_ms").isNotNull()
    bounds = stored.groupBy("file").agg(
        F.min("last_ms").alias("oldest"), F.max("last_ms").alias("newest"), F.count("last_ms").alias("n"), F.count_if(timed & F.col("ready")).alias("n_ready")
    )
    bounds.coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")


def newest_rows(spark: SparkSession, path: str, limit: int, cursor: tuple | None = None, only_ready: bool = False) -> DataFrame:
    """Stored sessions down to a time before which at least ``limit`` of them (ready ones) lie after the cursor; all if there are fewer.

    That time is found in the files' bounds: at most ``limit`` of their rows are looked at.
    """
    counted = "n_ready" if only_ready else "n"
    bounds = spark.read.parquet(f"{path}/bounds").filter(F.col(counted) > 0)
    if cursor:
        bounds = bounds.filter(F.col("newest") < cursor[0])
    near = bounds.orderBy(F.desc("oldest")).limit(limit)
    so_far = F.sum(counted).over(Window.orderBy(F.desc("oldest")).rowsBetween(Window.unboundedPreceding, 0))
    down_to = near.withColumn("so_far", so_far).filter(F.col("so_far") >= limit).agg(F.max("oldest")).first()[0]
    rows = spark.read.parquet(f"{path}/rows")
    if down_to is not None:
        rows = rows.filter(F.col("last_ms") >= down_to)
    return rows.filter("ready") if only_ready else rows


def stored_page(spark: SparkSession, path: str, limit: int, cursor: tuple | None = None) -> DataFrame:
    """``report.session_page`` over stored sessions."""
    return session_page(newest_rows(spark, path, limit, cursor), limit, cursor)


def stored_live(spark: SparkSession, path: str, within_ms: int = 15 * 60_000, most: int = 8) -> DataFrame:
    """``report.live_sessions`` over stored sessions."""
    newest = spark.read.parquet(f"{path}/bounds").agg(F.max("newest")).first()[0]
    rows = newest_rows(spark, path, most).filter(F.col("last_ms") >= (newest or 0) - within_ms)
    return rows.orderBy(F.desc("last_ms"), "session_id").limit(most).select("session_id", "last_ms")


def stored_ready_first(spark: SparkSession, path: str, events: DataFrame, ts_ms: str, most: int = 1000) -> DataFrame:
    """``report.ready_first`` by stored sessions, which have their number of events in ``events``: each has one at least, so
    ``most`` sessions are enough."""
    per = newest_rows(spark, path, most, only_ready=True).select("session_id", F.col("last_ms").alias("last_"), F.col("events").alias("n_"))
    return rows_of_first(events, per, "session_id", ts_ms, most)

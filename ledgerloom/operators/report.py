"""Dashboard queries: ranges, overview, explore, sessions, projects, insights, taxonomy filters."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import CLASSES

RANGES = ["today", "7d", "30d", "90d", "mtd", "ytd"]


def bounds(now: dt.datetime, range_: str | None = None, from_: dt.datetime | None = None, to: dt.datetime | None = None) -> tuple[dt.datetime, dt.datetime]:
    """[from, to) of a named range at ``now``; given bounds win over the name."""
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    start = {None: dt.datetime.min.replace(year=1970), "today": day, "7d": now - dt.timedelta(7), "30d": now - dt.timedelta(30), "90d": now - dt.timedelta(90), "mtd": day.replace(day=1), "ytd": day.replace(month=1, day=1)}
    if range_ not in start:
        raise ValueError(f"range must be one of {RANGES}")
    return from_ or start[range_], to or now


def in_range(ts: Column, span: tuple[dt.datetime, dt.datetime]) -> Column:
    return (ts >= F.lit(span[0])) & (ts < F.lit(span[1]))


def money(c: Column) -> Column:
    return c.cast("decimal(38,9)")


def overview(events: DataFrame) -> DataFrame:
    """One row: cost, list cost, savings, tokens, events, distinct sessions and repositories."""
    return events.agg(money(F.sum("cost")).alias("cost"), money(F.sum("list_cost")).alias("list_cost"), money(F.sum("list_cost") - F.sum("cost")).alias("savings"), F.sum("tokens").alias("tokens"), F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("repo").alias("repos"))


#: Metrics of explore and the column that each sums (events are counted, sessions counted once).
METRICS = {"cost": "cost", "list": "list_cost", "tokens": "tokens", "events": None, "sessions": "session_id", "tokens_input": "input", "tokens_output": "output", "tokens_cache_read": "cache_read", "tokens_cache_creation": "cache_creation", "tokens_reasoning": "reasoning"}


def filtered(events: DataFrame, filters: dict[str, list] | None) -> DataFrame:
    """events whose columns have one of the values given for each of them."""
    for column, values in (filters or {}).items():
        events = events.filter(F.col(column).isin(list(values)))
    return events


def explore(events: DataFrame, group_by: str, stack_by: str | None, metric: str, top: int = 50, filters: dict[str, list] | None = None) -> DataFrame:
    """(level, grp, stack, metric): the cells of the ``top`` groups by their total, those totals, and the total
    of the whole set.  Any column groups or stacks, a taxonomy node too; ties of groups go by name."""
    source = METRICS[metric]
    value = {"events": F.count("*"), "sessions": F.count_distinct("session_id")}.get(metric, F.sum(source) if source else None).alias(metric)
    events = filtered(events, filters)
    g, s = F.col(group_by).cast("string").alias("grp"), (F.col(stack_by) if stack_by else F.lit(None)).cast("string").alias("stack")
    rows = events.select(g, s, *([source] if source else []))
    sets = rows.groupingSets([[F.col("grp"), F.col("stack")], [F.col("grp")], []], F.col("grp"), F.col("stack")).agg(F.grouping_id().alias("gid_"), value)
    level = F.when(F.col("gid_") == 0, "cell").when(F.col("gid_") == 1, "group").otherwise("all")
    out = sets.withColumn("level", level).drop("gid_")
    return top_groups(out, metric, top)


def top_groups(out: DataFrame, metric: str, top: int) -> DataFrame:
    """Of rows (level, grp, stack, metric) the ``top`` groups with their cells, and the total of all."""
    ranked = out.filter("level = 'group'").orderBy(F.col(metric).desc_nulls_last(), "grp").limit(top).select(F.col("grp").alias("kept"))
    kept = out.filter("level <> 'all'").join(ranked, F.col("grp").eqNullSafe(F.col("kept")), "left_semi")
    return kept.unionByName(out.filter("level = 'all'")).select("level", "grp", "stack", metric)


def session_page(sessions: DataFrame, limit: int, cursor: tuple | None = None) -> DataFrame:
    """The most recent ``limit`` sessions after a cursor (last_ms, session_id)."""
    rows = sessions
    if cursor:
        rows = rows.filter((F.col("last_ms") < cursor[0]) | ((F.col("last_ms") == cursor[0]) & (F.col("session_id") < cursor[1])))
    return rows.orderBy(F.desc("last_ms"), F.desc("session_id")).limit(limit)


def live_sessions(events: DataFrame, ts_ms: str = "ts_ms", within_ms: int = 15 * 60_000, most: int = 8) -> DataFrame:
    """(session_id, last_ms): sessions within a time of the newest stamp of all, newest first."""
    last = events.groupBy("session_id").agg(F.max(ts_ms).alias("last_ms"))
    newest = events.agg(F.max(ts_ms).alias("newest"))
    return last.join(F.broadcast(newest), F.col("last_ms") >= F.col("newest") - within_ms).orderBy(F.desc("last_ms"), "session_id").limit(most).select("session_id", "last_ms")


def subtree(edges: DataFrame, ids: list) -> DataFrame:
    """(node): the ids and all their descendants, by a recursive query over (id, parent_id)."""
    view = f"taxonomy_{uuid.uuid4().hex}"  # a name of its own: calls at the same time have their own edges
    edges.createOrReplaceTempView(view)
    wanted = ", ".join(repr(str(i)) for i in ids)
    return edges.sparkSession.sql(f"""
        WITH RECURSIVE down(node) AS (
          SELECT CAST(id AS STRING) FROM {view} WHERE CAST(id AS STRING) IN ({wanted})
          UNION ALL
          SELECT CAST(e.id AS STRING) FROM {view} e JOIN down d ON CAST(e.parent_id AS STRING) = d.node)
        SELECT DISTINCT node FROM down""")


def taxonomy_filter(sessions: DataFrame, tags: DataFrame, edges: DataFrame, groups: list) -> DataFrame:
    """sessions that have, for every group, a tag in the subtree of one of its ids; a flat list is one group.

    tags: (session_id, node).
    """
    for ids in groups if groups and isinstance(groups[0], list) else [groups]:
        hit = tags.join(subtree(edges, ids), "node").select("session_id").distinct()
        sessions = sessions.join(hit, "session_id", "left_semi")
    return sessions


def with_override(rows: DataFrame, overrides: DataFrame, key: str, column: str) -> DataFrame:
    """rows with ``column`` replaced where an override (key, target) names the row."""
    return rows.join(overrides.select(key, F.col("target").alias("target_")), key, "left").withColumn(column, F.coalesce("target_", column)).drop("target_")


def missing_ids(requested: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return requested.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def insights(requested: DataFrame, events: DataFrame, segments: DataFrame) -> DataFrame:
    """A row for each requested session: tokens and their five classes, cost, segments, pending ones, and status
    ready, analyzing or not_ingested."""
    own = events.join(requested, "session_id", "left_semi").groupBy("session_id").agg(F.sum("tokens").alias("tokens"), *(F.sum(c).alias(c) for c in CLASSES), F.sum("cost").alias("cost"), F.array_sort(F.collect_set("node")).alias("nodes"))
    cut = segments.join(requested, "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("segment_count"), F.count(F.when(F.col("pending"), 1)).alias("segments_pending"))
    out = requested.select("session_id").distinct().join(own, "session_id", "left").join(cut, "session_id", "left")
    status = F.when(F.col("tokens").isNull(), "not_ingested").when(F.coalesce("segments_pending", F.lit(0)) > 0, "analyzing").otherwise("ready")
    return out.withColumn("segment_count", F.coalesce("segment_count", F.lit(0))).withColumn("segments_pending", F.coalesce("segments_pending", F.lit(0))).withColumn("status", status)


def find_named(rows: DataFrame, name: str, q: str, limit: int) -> DataFrame:
    """rows whose name holds ``q`` (case ignored), by name, at most ``limit``."""
    return rows.filter(F.contains(F.lower(F.col(name)), F.lit(q.lower()))).orderBy(name).limit(limit)


def ready_first(events: DataFrame, session: str, ts_ms: str, ready: Column, most: int = 1000) -> DataFrame:
    """Rows of ready sessions, the latest session first, until ``most`` rows are taken."""
    per = events.groupBy(session).agg(F.max(ts_ms).alias("last_"), F.count("*").alias("n_")).filter(ready)
    return rows_of_first(events, per, session, ts_ms, most)


def rows_of_first(events: DataFrame, per: DataFrame, session: str, ts_ms: str, most: int) -> DataFrame:
    """Rows of the sessions of ``per`` (session, last_, n_), the latest first, until ``most`` rows are taken."""
    before = F.coalesce(F.sum("n_").over(Window.orderBy(F.desc("last_"), session).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = per.orderBy(F.desc("last_"), session).limit(most).withColumn("before_", before).filter(F.col("before_") < most)
    rank = F.row_number().over(Window.partitionBy(session).orderBy(ts_ms)) + F.col("before_")
    return events.join(first, session).withColumn("rank_", rank).filter(F.col("rank_") <= most).drop("last_", "n_", "before_", "rank_")


def report_json(rows: DataFrame) -> DataFrame:
    """(value): each row as JSON with explicit nulls."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def top_kinds(df: DataFrame, kind: str, most: int = 20) -> DataFrame:
    return df.groupBy(kind).agg(F.count("*").alias("n")).orderBy(F.desc("n"), kind).limit(most)


def limited(rows: DataFrame, measure: str, name: str, sums: list[str], most: int) -> DataFrame:
    """The ``most`` rows of a rollup by a measure (nulls last, ties by name) and a row (total) over all of them."""
    top = rows.orderBy(F.col(measure).desc_nulls_last(), name).limit(most).select(F.lit("row").alias("level"), F.col(name).cast("string").alias(name), *sums)
    return top.unionByName(rows.agg(*(F.sum(c).alias(c) for c in sums)).select(F.lit("total").alias("level"), F.lit(None).cast("string").alias(name), *sums))

"""Daily rollups that add up: sums by day and dimensions, distinct sessions and repositories as bitmaps over dense ids."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .report import METRICS, filtered, money, top_groups

DIMENSIONS = ["provider", "model", "device", "repo", "kind"]
#: What is counted once, and the column that names it.
DISTINCT = {"sessions": "session_id", "repos": "repo"}
#: Columns that are summed; events are counted.
SUMMED = [c for m, c in METRICS.items() if c and m not in DISTINCT]
#: Values are dealt to so many slots by their hash and numbered in each, so no task numbers them all.  It must
#: never change under a stored cube: ids of a slot are this far apart.
SLOTS = 1024
#: Up to so many ids of a cell's bucket (of 32,768 ids) are kept as a list, more of them as the bucket's bitmap.
FEW = 1024
DAY_MS = 86_400_000


def occurring(events: DataFrame, dims: list[str]) -> DataFrame:
    """(day, dimensions, what, value), once each; a null value stays, so that its cell is known."""
    named = F.array(*(F.struct(F.lit(w).alias("what"), F.col(c).cast("string").alias("value")) for w, c in DISTINCT.items()))
    cells = events.select("day", *(F.col(d).cast("string").alias(d) for d in dims), F.explode(named).alias("x"))
    return cells.select("day", *dims, "x.what", "x.value").distinct()


def numbered(values: DataFrame, known: DataFrame) -> DataFrame:
    """(what, value, slot, rank, id) of the values (what, value) that ``known`` doesn't have: its ids go on."""
    fresh = values.filter("value IS NOT NULL").select("what", "value").distinct().join(known, ["what", "value"], "left_anti")
    fresh = fresh.withColumn("slot", F.pmod(F.xxhash64("value"), F.lit(SLOTS)))
    taken = known.groupBy("what", "slot").agg(F.max("rank").alias("taken"))
    place = F.row_number().over(Window.partitionBy("what", "slot").orderBy("value")).cast("bigint")
    ranked = fresh.withColumn("place", place).join(taken, ["what", "slot"], "left")
    ranked = ranked.withColumn("rank", F.col("place") + F.coalesce("taken", F.lit(0)))
    return ranked.select("what", "value", "slot", "rank", ((F.col("rank") - 1) * SLOTS + F.col("slot") + 1).alias("id"))


def daily_sums(events: DataFrame, dims: list[str], number: str = "bigint") -> DataFrame:
    """(day, dimensions, events, sums)."""
    keyed = events.select("day", *(F.col(d).cast("string").alias(d) for d in dims), *SUMMED)
    return keyed.groupBy("day", *dims).agg(F.count("*").alias("events"), *(F.sum(c).cast(number).alias(c) for c in SUMMED))


def daily_sets(events: DataFrame, ids: DataFrame, dims: list[str]) -> DataFrame:
    """(day, dimensions, what, bucket, few, bits): the ids of a cell as places in buckets of 32,768, as a list or a bitmap."""
    rows = occurring(events, dims).join(ids.select("what", "value", "id"), ["what", "value"], "left")
    rows = rows.withColumn("bucket", F.bitmap_bucket_number("id")).withColumn("bit", F.bitmap_bit_position("id"))
    keys = ["day", *dims, "what", "bucket"]
    cells = rows.groupBy(*keys).agg(F.collect_list("bit").alias("few"), F.bitmap_construct_agg("bit").alias("bits"))
    small = F.size("few") <= FEW
    return cells.select(*keys, F.when(small, F.array_sort("few")).alias("few"), F.when(~small, F.col("bits")).alias("bits"))


def merged(sets: DataFrame, level: str, keys: list[str], metric: str) -> DataFrame:
    """(keys, metric): distinct ids over all cells that ``level`` puts together; sets has level, keys, bucket, few, bits."""
    keys = [level, *keys]
    rows = sets.select(*keys, "bucket", "bits", F.explode_outer("few").alias("bit"))
    part = rows.groupBy(*keys, "bucket").agg(F.array(F.bitmap_construct_agg("bit"), F.bitmap_or_agg("bits")).alias("two"))
    # dealt by the same keys as before, so this second grouping moves nothing
    whole = part.select(*keys, "bucket", F.explode("two").alias("bits")).groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return whole.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(metric))


def explore_cube(sums: DataFrame, sets: DataFrame, group_by: str, stack_by: str | None, metric: str, top: int = 50, filters: dict[str, list] | None = None) -> DataFrame:
    """What ``report.explore`` gives over the events, from a cube's cells; only its dimensions and the day group or filter."""
    g = F.col(group_by).cast("string").alias("grp")
    s = (F.col(stack_by) if stack_by else F.lit(None)).cast("string").alias("stack")
    none = F.lit(None).cast("string")
    levels = F.array(
        F.struct(F.lit("cell").alias("level"), F.col("grp").alias("grp"), F.col("stack").alias("stack")),
        F.struct(F.lit("group").alias("level"), F.col("grp").alias("grp"), none.alias("stack")),
        F.struct(F.lit("all").alias("level"), none.alias("grp"), none.alias("stack")),
    )
    keys = ["level", "grp", "stack"]
    if metric in DISTINCT:
        cells = filtered(sets.filter(F.col("what") == metric), filters).select(g, s, "bucket", "few", "bits")
        out = merged(cells.select(F.inline(levels), "bucket", "few", "bits"), "level", keys[1:], metric)
    else:
        source = METRICS[metric] or "events"
        cells = filtered(sums, filters).select(g, s, F.col(source).alias("v")).groupBy("grp", "stack").agg(F.sum("v").alias("v"))
        out = cells.select(F.inline(levels), "v").groupBy(*keys).agg(F.sum("v").alias(metric))
    return top_groups(out, metric, top)


def overview_cube(sums: DataFrame, sets: DataFrame) -> DataFrame:
    """What ``report.overview`` gives over the events, from a cube's cells."""
    added = sums.agg(
        money(F.sum("cost")).alias("cost"), money(F.sum("list_cost")).alias("list_cost"), money(F.sum("list_cost") - F.sum("cost")).alias("savings"),
        F.sum("tokens").alias("tokens"), F.coalesce(F.sum("events"), F.lit(0)).alias("events"),
    )
    counted = merged(sets, "what", [], "n").agg(*(F.coalesce(F.max(F.when(F.col("what") == w, F.col("n"))), F.lit(0)).alias(w) for w in DISTINCT))
    names = [*added.columns, *DISTINCT]
    return added.unionByName(counted, allowMissingColumns=True).agg(*(F.max(c).alias(c) for c in names))


class DailyCube:
    """A stored cube under ``path``: ``ids`` (each value's number, given once and kept), ``sums`` and ``sets`` by day.

    events: ts_ms (epoch milliseconds), day (UTC, yyyy-MM-dd), the dimensions, session_id, repo and the summed columns, which are stored
    as ``number``.  One writer at a time.  An update that broke off is made whole by running it again with the same days.
    """

    def __init__(self, spark: SparkSession, path: str, dims: list[str] | None = None, number: str = "bigint"):
        self.spark, self.path, self.dims, self.number = spark, path.rstrip("/"), dims or DIMENSIONS, number
        named = "".join(f"{d} string, " for d in self.dims)
        self.schemas = {
            "ids": "what string, value string, slot bigint, rank bigint, id bigint",
            "sums": f"{named}events bigint, {', '.join(f'{c} {number}' for c in SUMMED)}, day string",
            "sets": f"{named}what string, bucket bigint, few array<bigint>, bits binary, day string",
        }
        for name, schema in self.schemas.items():
            empty = spark.createDataFrame([], schema).write.mode("ignore")
            (empty if name == "ids" else empty.partitionBy("day")).parquet(f"{self.path}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")

    def put(self, name: str, rows: DataFrame) -> None:
        """Replaces the days of rows and no others; a large day is several files."""
        rows = rows.select(self.read(name).columns).hint("rebalance", F.col("day"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.path}/{name}")

    def update(self, events: DataFrame, days: DataFrame | None = None) -> None:
        """Computes the given days (day) anew from all their events, without ``days`` all days that events have.

        A given day without events is left empty.  Rows without a day are in no range and so in no cube.
        """
        events = events.filter("day IS NOT NULL")
        if days is None:
            gone = None
        else:
            days = days.select(F.col("day").cast("string").alias("day")).filter("day IS NOT NULL").distinct()
            events = events.join(days, "day", "left_semi")
            gone = days.join(events.select("day"), "day", "left_anti")
        numbered(occurring(events, self.dims), self.read("ids")).write.mode("append").parquet(f"{self.path}/ids")
        for name, rows in (("sums", daily_sums(events, self.dims, self.number)), ("sets", daily_sets(events, self.read("ids"), self.dims))):
            # an emptied day gets one row of nulls in place of its old ones; readers pass it over
            self.put(name, rows if gone is None else rows.unionByName(gone, allowMissingColumns=True))

    def between(self, events: DataFrame, from_ms: int, to_ms: int) -> tuple[DataFrame, DataFrame]:
        """(sums, sets) of the events in [from, to): whole days from the store, the cut days at both ends from their events."""
        first, last = -(-from_ms // DAY_MS), to_ms // DAY_MS
        whole = F.lit(False)
        if first < last:
            name = [(dt.date(1970, 1, 1) + dt.timedelta(d)).isoformat() for d in (first, last)]
            whole = (F.col("day") >= name[0]) & (F.col("day") < name[1])
        sums = self.read("sums").filter(whole & F.col("events").isNotNull())
        sets = self.read("sets").filter(whole & F.col("what").isNotNull())
        if first < last and from_ms == first * DAY_MS and to_ms == last * DAY_MS:
            return sums, sets
        ts = F.col("ts_ms")
        edges = events.filter((ts >= from_ms) & (ts < to_ms))
        if first < last:
            edges = edges.filter((ts < first * DAY_MS) | (ts >= last * DAY_MS))
        known = self.read("ids")
        ids = known.unionByName(numbered(occurring(edges, self.dims), known))
        cut = daily_sums(edges, self.dims, self.number), daily_sets(edges, ids, self.dims)
        return sums.unionByName(cut[0].select(sums.columns)), sets.unionByName(cut[1].select(sets.columns))

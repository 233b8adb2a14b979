"""Window work on turns and stamps: activity, turn numbers, carried state, segments, sampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runs

IDLE_MS = 300_000
SITTING_GAP_MS = 90 * 60_000
SITTING_RAMP_MINUTES = 30
#: The five limits of a segment, and the largest topic distance a calibration may set.
LIMITS = {"gap_ms": 15 * 60_000, "turns": 100, "duration_ms": 30 * 60_000, "chars": 12_000, "topic": 0.35}
TOPIC_MOST = 2.0


def stamp_gap(keys: list[str], ts_ms: str) -> Column:
    return F.col(ts_ms) - F.lag(ts_ms).over(Window.partitionBy(*keys).orderBy(ts_ms))


def active_time(df: DataFrame, keys: list[str], ts_ms: str, idle_ms: int = IDLE_MS) -> DataFrame:
    """(keys, active_ms): the idle limit once, plus each gap up to it; null stamps are not counted."""
    rows = df.filter(F.col(ts_ms).isNotNull()).select(*keys, ts_ms).withColumn("gap_", stamp_gap(keys, ts_ms))
    return rows.groupBy(*keys).agg((F.coalesce(F.sum(F.when(F.col("gap_") > idle_ms, idle_ms).otherwise(F.col("gap_"))), F.lit(0)) + idle_ms).cast("bigint").alias("active_ms"))


def sittings(df: DataFrame, keys: list[str], ts_ms: str, gap_ms: int = SITTING_GAP_MS, ramp: int = SITTING_RAMP_MINUTES) -> DataFrame:
    """(keys, active_minutes): whole minutes of each run without a longer gap, plus a ramp each; NULL under two
    stamps."""
    order = Window.partitionBy(*keys).orderBy(ts_ms)
    rows = df.filter(F.col(ts_ms).isNotNull()).select(*keys, ts_ms).withColumn("new_", F.when(F.col(ts_ms) - F.lag(ts_ms).over(order) > gap_ms, 1).otherwise(0))
    rows = rows.withColumn("island_", F.sum("new_").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = rows.groupBy(*keys, "island_").agg(F.count("*").alias("n_"), F.expr(f"(max({ts_ms}) - min({ts_ms})) div 60000").alias("m_"))
    return islands.groupBy(*keys).agg(F.when(F.sum("n_") >= 2, F.sum("m_") + F.count("*") * ramp).cast("bigint").alias("active_minutes"))


def turn_index(keys: list[str], order: list[str], is_prompt: Column) -> Column:
    """Earlier prompts, with the first prompt and all before it at 0."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.greatest(F.sum(is_prompt.cast("int")).over(before) - 1, F.lit(0))


def carried(keys: list[str], order: list[str], value: Column) -> Column:
    """The last non-null value so far."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def drop_repeats(df: DataFrame, keys: list[str], order: list[str], counter: str) -> DataFrame:
    """df without rows whose counter equals the one before; a null counter never repeats."""
    prev = F.lag(counter).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("prev_", prev).filter(F.col(counter).isNull() | F.col("prev_").isNull() | (F.col(counter) != F.col("prev_"))).drop("prev_")


def attach_to_next(df: DataFrame, keys: list[str], order: list[str], is_reply: Column, aggs: list[Column]) -> DataFrame:
    """(keys, island, aggs): the rows up to and with each reply, summed; rows after the last reply are left out."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("reply_", is_reply.cast("int")).withColumn("island", F.coalesce(F.sum("reply_").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.groupBy(*keys, "island").agg(*aggs, F.max("reply_").alias("reply_")).filter("reply_ = 1").drop("reply_")


def ordinal(keys: list[str], order: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1


def corrections(df: DataFrame, keys: list[str], order: list[str], role: str) -> DataFrame:
    """(keys, corrections, frustration): user turns whose last user or assistant turn before is assistant."""
    before = F.last(F.when(F.col(role).isin("user", "assistant"), F.col(role)), ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    n = F.sum(F.when((F.col(role) == "user") & (F.col("before_") == "assistant"), 1).otherwise(0))
    return df.withColumn("before_", before).groupBy(*keys).agg(n.cast("bigint").alias("corrections")).withColumn("frustration", frustration(F.col("corrections"), F.lit(False)))


def frustration(corrections_: Column, mood_marker: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(corrections_ / 4, F.when(mood_marker, 0.8).otherwise(0.0))), 2)


def calibrated(given: dict[str, float]) -> dict[str, float]:
    """The limits with overrides kept between a tenth and ten times the default (topic at most 2)."""
    out = dict(LIMITS)
    for k, v in given.items():
        if k in out and isinstance(v, int | float) and v == v:
            most = TOPIC_MOST if k == "topic" else LIMITS[k] * 10
            out[k] = min(max(v, LIMITS[k] / 10), most)
    return out


def segments(df: DataFrame, session: str, ts_ms: str, order: list[str], chars: str | None = None, vector: str | None = None, limits: dict[str, float] | None = None, chunk_rows: int = 1 << 16) -> DataFrame:
    """df with ``segment``, from 0 in each session; a one-row segment joins the one before (the first stays).

    A boundary stands before a turn if the gap or the topic distance to the turn before is over its limit, or the run
    has reached its limit of turns, time or characters.  A null stamp makes no gap and ends no run by time; null
    and negative characters count as none.  Runs are cut by ``cut_runs``, so a long session is many tasks.
    """
    lim = {**LIMITS, **(limits or {})}
    has_vectors = vector is not None
    inputs = {"t": F.col(ts_ms).cast("bigint"), "c": (F.greatest(F.coalesce(F.col(chars), F.lit(0)), F.lit(0)) if chars else F.lit(0)).cast("bigint")}
    if vector:
        inputs["v"] = F.col(vector).cast("array<double>")

    def link(x: dict[str, pa.Array], ends: np.ndarray) -> np.ndarray:
        n, at = len(ends), np.arange(len(ends))
        t = x["t"].to_numpy(zero_copy_only=False).astype(np.float64)
        gap = np.diff(t, prepend=np.nan) >= lim["gap_ms"]
        if has_vectors:
            gap |= far_from_last(x["v"], lim["topic"])
        gap[np.concatenate([[True], ends[1:] != ends[:-1]])] = False
        breaks = np.append(np.flatnonzero(gap), n)
        out = np.minimum(np.minimum(breaks[np.searchsorted(breaks, at, side="right")], at + int(lim["turns"])), ends)
        before = np.cumsum(np.concatenate([[0], x["c"].to_numpy()]))[:-1]
        out = np.minimum(out, runs.first_at_least(before, before + max(lim["chars"], 1), ends))
        clock = runs.over_groups(t, ends)
        if clock is not None:
            return np.minimum(out, runs.first_at_least(clock, clock + lim["duration_ms"], ends))
        for k in range(int(lim["turns"]) - 1, 0, -1):  # stamps that go back or are missing: look at each row in reach
            late = np.zeros(n, bool)
            late[: n - k] = t[k:] - t[: n - k] >= lim["duration_ms"]
            out = np.where(late & (at + k < out), at + k, out)
        return out

    return runs.cut_runs(df, [session], order, inputs, link, int(lim["turns"]), "segment", absorb_single=True, chunk_rows=chunk_rows)


def far_from_last(v: pa.Array, most: float) -> np.ndarray:
    """Whether a vector's cosine distance to the one before, over their common length, is over ``most``; without one of
    them, no; a vector of zeros is at distance 1."""
    v = v.fill_null([])
    sizes, begin = np.diff(v.offsets.to_numpy()), v.offsets.to_numpy()[:-1] - v.offsets[0].as_py()
    flat = np.nan_to_num(v.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    common = np.minimum(sizes[1:], sizes[:-1]).astype(np.int64)
    pair = np.repeat(np.arange(len(common)), common)
    step = np.arange(int(common.sum())) - np.repeat(np.cumsum(common) - common, common)
    a, b = flat[begin[:-1][pair] + step], flat[begin[1:][pair] + step]
    dot, aa, bb = (np.bincount(pair, w, len(common)) for w in (a * b, a * a, b * b))
    norm = np.sqrt(aa) * np.sqrt(bb)
    far = np.where(norm > 0, 1 - dot / np.where(norm > 0, norm, 1), 1.0) > most
    return np.concatenate([[False], far & (common > 0)])


def sampled(df: DataFrame, keys: list[str], order: list[str], text: str, most: int = 200) -> DataFrame:
    """(keys, pos, excerpt): the first, last and quarter texts of a slice's non-blank ones."""
    w = Window.partitionBy(*keys)
    rows = df.filter(F.trim(F.col(text)) != "").withColumn("pos", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n_", F.count("*").over(w))
    at = [F.lit(0), F.col("n_") - 1, *(F.floor(F.col("n_") * q) for q in (0.25, 0.5, 0.75))]
    keep = at[0] == F.col("pos")
    for a in at[1:]:
        keep = keep | (a == F.col("pos"))
    return rows.filter(keep).select(*keys, F.col("pos").cast("bigint").alias("pos"), F.left(text, F.lit(most)).alias("excerpt"))


def evenly_spaced(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """df's rows at ``most`` or fewer evenly spaced positions of each group, always the first and the last."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("pos", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n_", F.count("*").over(w))
    if most == 1:
        return rows.filter("pos = 0").drop("n_")
    at = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (F.col("n_") - 1) / F.lit(most - 1) + 0.5).cast("int"))
    return rows.filter((F.col("n_") <= most) | F.array_contains(at, F.col("pos"))).drop("n_")


def value_islands(df: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """(keys, value, observed_since, last_seen, latest): unbroken runs of a value; latest marks the present one."""
    w = Window.partitionBy(*keys).orderBy(ts)
    rows = df.filter(F.col(value).isNotNull()).withColumn("new_", F.when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)).withColumn("island_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = rows.groupBy(*keys, "island_", value).agg(F.min(ts).alias("observed_since"), F.max(ts).alias("last_seen"))
    return islands.withColumn("latest", F.col("island_") == F.max("island_").over(Window.partitionBy(*keys))).drop("island_")


def packed_batches(df: DataFrame, keys: list[str], order: list[str], events: int = 1000, calls: str | None = None, most_calls: int = 20_000, chunk_rows: int = 1 << 16) -> DataFrame:
    """df with ``batch``: runs of at most ``events`` rows of each group in order and, with ``calls`` (a count a
    row), of at most ``most_calls`` calls; a single row of more calls is a batch of its own.  Null and negative counts are
    none.  With calls the limits restart at every batch, so runs are cut by ``cut_runs``: a long group is many tasks.
    """
    if calls is None:
        return runs.numbered(df, keys, order).withColumn("batch", F.floor(F.col("rn_") / events).cast("bigint")).drop("rn_")

    def link(x: dict[str, pa.Array], ends: np.ndarray) -> np.ndarray:
        at, through = np.arange(len(ends)), np.cumsum(x["c"].to_numpy())
        over = np.searchsorted(through, through - x["c"].to_numpy() + most_calls, side="right")  # the first row that passes the limit
        return np.minimum(np.minimum(np.maximum(over, at + 1), at + events), ends)

    return runs.cut_runs(df, keys, order, {"c": F.greatest(F.coalesce(F.col(calls), F.lit(0)), F.lit(0)).cast("bigint")}, link, events, "batch", chunk_rows=chunk_rows)


def windows_of(length: Column, size: int, overlap: int) -> Column:
    """[start, end) windows over a length, each starting ``size - overlap`` after the last; one at least."""
    step = size - overlap
    starts = F.filter(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s + overlap < length))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, length).alias("end")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus cosine over the common length; 1 if a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, e: s + e)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm == 0, 1.0).otherwise(1 - dot(x, y) / norm)


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))
    return F.when(norm == 0, F.transform(v, lambda e: e.cast("double"))).otherwise(F.transform(v, lambda e: e.cast("double") / norm))


def mean_pool(df: DataFrame, keys: list[str], vector: str, dims: int) -> DataFrame:
    """(keys, pooled): the mean of each group's vectors, unit length; one sum a dimension."""
    sums = [F.avg(F.col(vector)[i].cast("double")).alias(f"m{i}") for i in range(dims)]
    return df.groupBy(*keys).agg(*sums).select(*keys, normalised(F.array(*(F.col(f"m{i}") for i in range(dims)))).alias("pooled"))

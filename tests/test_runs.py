"""Runs cut by links give the rows of a plain walk, within chunks and across them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import sessions


def far(a, b, most):
    if not a or not b:
        return False
    n = min(len(a), len(b))
    x, y = np.array(a[:n]), np.array(b[:n])
    norm = np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())
    return (1 - x @ y / norm if norm else 1.0) > most


def walked(rows, lim):
    """rows: (t, c, v) of a session in order -> segment of each."""
    raw, number, start, turns, size, last = [], 0, None, 0, 0, None
    for i, (t, c, v) in enumerate(rows):
        over = lambda a, b, most: a is not None and b is not None and a - b >= most
        if i == 0:
            start = t
        elif over(t, last[0], lim["gap_ms"]) or far(last[1], v, lim["topic"]) or turns >= lim["turns"] or over(t, start, lim["duration_ms"]) or size >= lim["chars"]:
            number, start, turns, size = number + 1, t, 0, 0
        turns, size, last = turns + 1, size + max(c or 0, 0), (t, v)
        raw.append(number)
    out, segment = [], -1
    for i, r in enumerate(raw):
        if i == 0 or (r != raw[i - 1] and raw.count(r) > 1):
            segment += 1
        out.append(segment)
    return out


@pytest.mark.parametrize("chunk_rows", [8, 30, 1 << 16])
@pytest.mark.parametrize("backwards", [False, True])
def test_segments_of_random_sessions(spark, chunk_rows, backwards):
    rng = random.Random(chunk_rows)
    lim = {"gap_ms": 50, "turns": 7, "duration_ms": 90, "chars": 40, "topic": 0.6}
    given, want = [], {}
    for s in [None, *range(25)]:
        t, rows = 0, []
        for _ in range(rng.choice([1, 2, 8, 16, 31, 120])):
            t += rng.choice([0, 1, 5, 20, 60]) - (rng.choice([0, 30]) if backwards else 0)
            rows.append((None if backwards and rng.random() < 0.1 else t, rng.choice([None, 0, 3, 15, 45]), rng.choice([None, [], [1.0, 0.0], [1.0, 0.1, 5.0], [0.0, 1.0], [0.0, 0.0]])))
        given += [(s, i, *r) for i, r in enumerate(rows)]
        want[s] = walked(rows, lim)
    df = spark.createDataFrame(rng.sample(given, len(given)), "s int, i int, t bigint, c bigint, v array<float>").repartition(5)
    got = sessions.segments(df, "s", "t", ["i"], "c", "v", lim, chunk_rows=chunk_rows).collect()
    assert len(got) == len(given)
    assert {s: [r["segment"] for r in sorted((r for r in got if r["s"] == s), key=lambda r: r["i"])] for s in want} == want


@pytest.mark.parametrize("chunk_rows", [10, 1 << 16])
def test_batches_by_calls(spark, chunk_rows):
    rng = random.Random(3)
    given = [(f"d{k}", i, rng.choice([None, 0, 1, 4, 30])) for k in range(6) for i in range(rng.choice([1, 20, 25, 90]))]
    df = spark.createDataFrame(rng.sample(given, len(given)), "d string, i int, c int").repartition(4)
    got = {(r["d"], r["i"]): r["batch"] for r in sessions.packed_batches(df, ["d"], ["i"], 6, "c", 20, chunk_rows=chunk_rows).collect()}
    want, last = {}, None
    for d, i, c in sorted(given, key=lambda r: r[:2]):
        c = c or 0
        if d != last:
            last, number, rows, total = d, 0, 0, 0
        elif rows >= 6 or total + c > 20:
            number, rows, total = number + 1, 0, 0
        rows, total = rows + 1, total + c
        want[d, i] = number
    assert got == want


def test_a_long_session_is_many_tasks(spark):
    """One session without gaps: no task holds more than a few chunks of it, and the numbers are those of the walk."""
    n, lim = 40_000, {"gap_ms": 10_000, "turns": 9, "duration_ms": 200, "chars": 1 << 40, "topic": 0.9}
    df = spark.range(n).select(F.lit("one").alias("s"), F.col("id").alias("i"), (F.col("id") * 10 + F.pmod(F.xxhash64("id"), F.lit(9))).alias("t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    cut = sessions.segments(df, "s", "t", ["i"], limits=lim, chunk_rows=1000)
    got = cut.select("i", "segment", F.spark_partition_id().alias("p")).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(np.unique([r["p"] for r in got], return_counts=True)[1]) < n
    rows = [(r["t"], 0, None) for r in df.orderBy("i").collect()]
    start, number, turns, want = rows[0][0], 0, 0, []
    for t, _, _ in rows:
        if turns >= lim["turns"] or t - start >= lim["duration_ms"]:
            number, start, turns = number + 1, t, 0
        turns += 1
        want.append(number)
    assert [r["segment"] for r in sorted(got)] == want


def test_empty(spark):
    df = spark.createDataFrame([], "s string, i int, t bigint, c int")
    assert sessions.segments(df, "s", "t", ["i"], "c").collect() == []
    assert sessions.packed_batches(df, ["s"], ["i"], 5, "c", 9).collect() == [] and sessions.packed_batches(df, ["s"], ["i"], 5).collect() == []

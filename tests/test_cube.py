"""A cube gives what the events give, for any range and after any update."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import cube, report

SCHEMA = "ts_ms bigint, session_id string, provider string, model string, device string, repo string, kind string, tokens bigint, cost bigint, list_cost bigint, input bigint, output bigint, cache_read bigint, cache_creation bigint, reasoning bigint"
DAY = cube.DAY_MS


def made(spark, n, days, seed, sessions=40):
    rng = random.Random(seed)

    def one():
        pick = lambda *v: rng.choice([*v, None])
        return (rng.choice(days) * DAY + rng.choice([0, 1, DAY // 2, DAY - 1]), pick(*(f"s{i}" for i in range(sessions))), pick("p", "q"), pick("m", "n"), "d", pick("r", "t", "u"), pick("k", "l"), *(rng.choice([None, rng.randint(0, 99)]) for _ in range(8)))

    return with_day(spark.createDataFrame([one() for _ in range(n)], SCHEMA))


def with_day(df):
    return df.withColumn("day", F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd"))


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def same(stored, events, a, b, full=True):
    part = events.filter((F.col("ts_ms") >= a) & (F.col("ts_ms") < b))
    sums, sets = stored.between(events, a, b)
    assert rows(cube.overview_cube(sums, sets)) == rows(report.overview(part))
    asked = [("provider", "model", "sessions", 50, None), ("day", None, "sessions", 2, {"kind": ["k"]})]
    if full:
        asked += [("repo", "day", "events", 2, None), ("model", None, "cost", 1, {"repo": ["r", "t"]}), ("kind", "repo", "tokens_reasoning", 50, None)]
    for g, s, metric, top, filters in asked:
        assert rows(cube.explore_cube(sums, sets, g, s, metric, top, filters)) == rows(report.explore(part, g, s, metric, top, filters)), (g, s, metric)


def test_ranges_and_updates(spark, tmp_path):
    stored = cube.DailyCube(spark, str(tmp_path / "cube"))
    old = made(spark, 300, [100, 101, 102, 103], 1)
    stored.update(old)
    for a, b in ((100 * DAY, 104 * DAY), (100 * DAY + 1, 103 * DAY + DAY // 2), (101 * DAY + 5, 101 * DAY + DAY - 2), (0, 1)):
        same(stored, old, a, b, full=a == 100 * DAY + 1)
    ids = {(r.what, r.value): r.id for r in stored.read("ids").collect()}
    # day 101 loses all its rows, 103 gets other ones and sessions never seen, 102 is not touched
    new = old.filter("day NOT IN ('1970-04-12', '1970-04-14')").unionByName(made(spark, 100, [103], 2, sessions=80))
    new = new.filter("day <> '1970-04-11'").unionByName(old.filter("day = '1970-04-11'"))
    stored.update(new, spark.createDataFrame([("1970-04-12",), ("1970-04-14",), (None,)], "day string"))
    same(stored, new, 100 * DAY, 104 * DAY)
    after = {(r.what, r.value): r.id for r in stored.read("ids").collect()}
    assert len(after) > len(ids) and ids.items() <= after.items()
    assert all(len({i for (w, _), i in after.items() if w == what}) == sum(w == what for w, _ in after) for what in cube.DISTINCT)
    # an edge has sessions that no update has seen
    later = new.unionByName(made(spark, 60, [104], 3, sessions=200))
    same(stored, later, 102 * DAY, 104 * DAY + DAY - 1, full=False)


def test_only_touched_days_are_written(spark, tmp_path):
    stored = cube.DailyCube(spark, str(tmp_path / "cube"))
    events = made(spark, 100, [5, 6], 4)
    stored.update(events)
    files = lambda: {r.day: r.f for r in stored.read("sums").groupBy("day").agg(F.array_sort(F.collect_set("_metadata.file_name")).alias("f")).collect()}
    before = files()
    stored.update(events, spark.createDataFrame([("1970-01-07",)], "day string"))
    after = files()
    assert before["1970-01-06"] == after["1970-01-06"] and before["1970-01-07"] != after["1970-01-07"]
    plan = stored.between(events, 6 * DAY, 7 * DAY)[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "1970-01-07" in plan


@pytest.mark.parametrize("few", [0, 3])
def test_lists_and_bitmaps_mix(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(cube, "FEW", few)
    monkeypatch.setattr(cube, "SLOTS", 40_000)  # ids spread over several buckets
    events = made(spark, 200, [7, 8], 5, sessions=60)
    stored = cube.DailyCube(spark, str(tmp_path / "cube"))
    stored.update(events)
    sets = stored.read("sets")
    assert sets.filter("bits IS NOT NULL").count() and sets.select("bucket").distinct().count() > 2
    same(stored, events, 7 * DAY, 9 * DAY, full=False)


def test_empty(spark, tmp_path):
    stored = cube.DailyCube(spark, str(tmp_path / "cube"))
    none = made(spark, 1, [7], 5).limit(0)
    stored.update(none)
    same(stored, none, 7 * DAY, 9 * DAY)
    same(stored, none, 7 * DAY + 1, 9 * DAY, full=False)

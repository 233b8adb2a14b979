"""Pages of stored sessions are those of a full sort, from few files."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import pages, report


def files_read(df):
    return df.select(F.col("_metadata.file_name")).distinct().count()


def made(spark, n, stamps, nulls=0, seed=1):
    rng = random.Random(seed)
    rows = [(f"s{i:04d}", rng.randrange(stamps), rng.randint(1, 9)) for i in range(n)] + [(f"z{i}", None, 1) for i in range(nulls)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "session_id string, last_ms bigint, events bigint").repartition(3)


def walk(page, limit):
    got, cursor = [], None
    while True:
        rows = [(r.last_ms, r.session_id) for r in page(cursor).collect()]
        got += rows
        if len(rows) < limit or rows[-1][0] is None:
            return got
        cursor = rows[-1]


def test_all_pages(spark, tmp_path):
    for stamps, nulls in ((40, 0), (1, 0), (10_000, 3)):
        s, path = made(spark, 200, stamps, nulls), str(tmp_path / f"{stamps}")
        pages.write_newest_first(s, path, file_rows=20)
        got = walk(lambda c: pages.stored_page(spark, path, 37, c), 37)  # noqa: B023
        assert got == walk(lambda c: report.session_page(s, 37, c), 37) and len(got) == 200  # noqa: B023


def test_few_files_are_read(spark, tmp_path):
    path = str(tmp_path / "s")
    pages.write_newest_first(made(spark, 2_000, 10**9), path, file_rows=50)
    bounds = spark.read.parquet(f"{path}/bounds")
    assert bounds.count() > 30 and bounds.agg(F.sum("n")).first()[0] == 2_000
    cursor = (5 * 10**8, "s0100")
    near = pages.newest_rows(spark, path, 10, cursor).filter(F.col("last_ms") <= cursor[0])
    assert files_read(near) <= 3
    plan = pages.stored_page(spark, path, 10, cursor)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters: [") :]
    assert "GreaterThanOrEqual(last_ms," in pushed and "LessThan(last_ms,500000000)" in pushed


def test_live_and_ready(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"s{i % 60:02d}", rng.randrange(500), i) for i in range(700)]
    e = spark.createDataFrame(rows, "session_id string, ts_ms bigint, event_id bigint")
    s = e.groupBy("session_id").agg(F.max("ts_ms").alias("last_ms"), F.count("*").alias("events"))
    ready = F.col("session_id") > "s10"
    path = str(tmp_path / "s")
    pages.write_newest_first(s, path, ready, file_rows=5)
    for within, most in ((10, 8), (200, 30), (0, 1)):
        assert pages.stored_live(spark, path, within, most).collect() == report.live_sessions(e, "ts_ms", within, most).collect()
    for most in (1, 30, 200, 5_000):
        got = pages.stored_ready_first(spark, path, e, "ts_ms", most)
        sessions = lambda df: sorted((r.session_id, r.ts_ms) for r in df.collect())
        assert sessions(got) == sessions(report.ready_first(e, "session_id", "ts_ms", ready, most))


def test_empty(spark, tmp_path):
    path = str(tmp_path / "s")
    pages.write_newest_first(made(spark, 1, 5).limit(0), path)
    assert pages.stored_page(spark, path, 5).collect() == []
    assert pages.stored_live(spark, path).collect() == []

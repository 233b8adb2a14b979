"""Open messages: merged sightings, host-wide facts, final times, and the fast first result, in event time and by the clock."""

import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import messages

SCHEMA = "host string, message_id string, origin string, ms bigint, role string, text string, model string, conversation_id string, done boolean"


@pytest.fixture(autouse=True)
def store(spark):
    before = {k: spark.conf.get(k, None) for k in messages.STATE_STORE}
    for k, v in messages.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(spark, tmp_path, name, rows, eager=False):
    """rows in the order they come, a file each second of event time, and one far later that moves the watermark on."""
    path = tmp_path / name
    batches: dict[int, list] = {}
    for r in rows:  # stamps of the epoch's first moment would count as late
        batches.setdefault(r[3] // 1000, []).append((*r[:3], r[3] + 60_000, *r[4:]))
    for i, k in enumerate(sorted(batches)):
        spark.createDataFrame(batches[k], SCHEMA).coalesce(1).write.parquet(str(path / f"b={i:03}"))
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path)).withColumn("ts", F.timestamp_millis("ms"))
    told = messages.final_messages(s.filter("origin <> 'scalar'"), s.filter("origin = 'scalar'"), event_time=True, eager=eager)
    q = told.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return {r["message_id"]: (r["role"], r["text"], r["model"], r["conversation_id"], r["why"]) for r in spark.table(name).collect() if r["host"] != "end"}


END = [("end", "e", "dom", 900_000 + k, None, None, None, None, False) for k in (0, 2000)]


def test_final_messages(spark, tmp_path):
    rows = [
        ("h", "old", "network", 0, "assistant", "a", None, None, False),
        ("h", "m", "dom", 1000, "user", "part", None, None, False),
        ("h", "m", "network", 2000, "assistant", "whole", "g", None, True),
        ("h", None, "scalar", 2500, None, None, "late-model", "c1", None),
        ("x", "m2", "network", 2500, "assistant", "other host", "x", None, False),
        ("h", "n", "network", 29_000, "assistant", None, None, None, False),
        ("h", None, "scalar", 29_500, None, None, "last-model", None, None),
        *END,
    ]
    got = run(spark, tmp_path, "final", rows)
    assert got["m"] == ("user", "whole", "late-model", "c1", "quiet")  # the page's role stays; final before the second fact
    assert got["old"] == ("assistant", "a", "last-model", "c1", "age")  # open for 29.5 seconds, and told all the same
    assert got["m2"] == ("assistant", "other host", "x", None, "age") and got["n"] == ("assistant", None, "last-model", None, "age")


def test_eager_until_the_first_ship(spark, tmp_path):
    rows = [("h", "a", "network", 0, "assistant", "t", "g", None, True), ("h", "b", "network", 5000, "assistant", "u", "g", None, True), ("h", "c", "network", 9000, None, "v", None, None, False), *END]
    got = run(spark, tmp_path, "eager", rows, eager=True)
    assert {k: v[4] for k, v in got.items()} == {"a": "eager", "b": "age", "c": "age"}
    assert {k: v[4] for k, v in run(spark, tmp_path, "steady", rows).items()} == {"a": "age", "b": "age", "c": "age"}


def test_by_the_clock(spark, tmp_path):
    """An ended message that the page showed is final two seconds later, without another row."""
    path = str(tmp_path / "in")
    rows = [("h", "m", "dom", 0, "user", "t", None, None, False), ("h", "m", "network", 1, None, "whole", "g", None, True)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    s = spark.readStream.schema(SCHEMA).parquet(path).withColumn("ts", F.timestamp_millis("ms"))
    q = messages.final_messages(s).writeStream.format("memory").queryName("clock").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            if spark.table("clock").count():
                break
        assert [(r["message_id"], r["text"], r["why"]) for r in spark.table("clock").collect()] == [("m", "whole", "quiet")]
    finally:
        q.stop()

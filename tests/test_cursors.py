"""A sink that fails, holds rows back and is stopped half-way loses nothing and repeats nothing."""

from pyspark.sql import functions as F

from ledgerloom.sources import files
from ledgerloom.streaming import cursors

MINUTE = 60_000


class Sink:
    def __init__(self, spark, path):
        self.spark, self.path, self.fail, self.hold, self.seen = spark, path, False, set(), []

    def __call__(self, rows):
        ids = sorted(r["id"] for r in rows.select("id").collect())
        self.seen.append(ids)
        if self.fail:
            raise OSError("no way through")
        keep = [i for i in ids if i in self.hold]
        files.merge_into(self.spark, rows.filter(~F.col("id").isin(keep or [""])), self.path, "id")
        return self.spark.createDataFrame([(i,) for i in keep], "id string")


def table(spark, rows):
    return spark.createDataFrame(rows, "id string, ms bigint, v int")


def test_three_restarts(spark, tmp_path):
    sink = Sink(spark, str(tmp_path / "out"))
    state, spool = str(tmp_path / "state"), str(tmp_path / "spool")
    go = lambda rows, now: cursors.advance(spark, "s", table(spark, rows), "id", "ms", sink, state, spool, now)
    rows = [("a", 0, 1), ("b", 60 * MINUTE, 1), ("c", 61 * MINUTE, 1)]
    sink.fail = True
    assert go(rows, 0) == "failed" and cursors.cursor(spark, state, "s") == (None, 1, 0)
    assert go(rows, 29 * MINUTE) == "waiting" and go(rows, 30 * MINUTE) == "failed"
    assert go(rows, 80 * MINUTE) == "waiting"  # an hour after the second try
    sink.fail, sink.hold = False, {"b"}
    assert go(rows, 90 * MINUTE) == "sent" and cursors.cursor(spark, state, "s") == (61 * MINUTE, 0, 90 * MINUTE)
    assert {r["id"] for r in files.current(spark, sink.path).collect()} == {"a", "c"}
    # a late row inside the overlap comes, an older one does not; b waits in the spool although the overlap reads it
    rows += [("late", 52 * MINUTE, 1), ("older", 50 * MINUTE, 1), ("d", 70 * MINUTE, 1)]
    assert go(rows, 95 * MINUTE) == "sent" and sink.seen[-1] == ["c", "d", "late"]
    assert [(r["id"], r["attempts_"]) for r in files.current(spark, spool).collect()] == [("b", 1)]
    assert go([], 96 * MINUTE) == "idle"
    assert go(rows, 120 * MINUTE) == "sent" and "b" in sink.seen[-1]
    assert [(r["id"], r["attempts_"]) for r in files.current(spark, spool).collect()] == [("b", 2)]
    sink.hold = set()
    assert go(rows, 150 * MINUTE) == "sent" and "b" not in sink.seen[-1]  # two tries: an hour
    assert go(rows, 180 * MINUTE) == "sent" and "b" in sink.seen[-1] and files.current(spark, spool).isEmpty()
    got = [r["id"] for r in files.current(spark, sink.path).collect()]
    assert sorted(got) == ["a", "b", "c", "d", "late"]


def test_stopped_between_sink_and_state(spark, tmp_path, monkeypatch):
    sink = Sink(spark, str(tmp_path / "out"))
    state, spool, rows = str(tmp_path / "state"), str(tmp_path / "spool"), table(spark, [("a", 5, 1), (None, 6, 2), ("a", 5, 1), ("n", None, 3)])
    with monkeypatch.context() as m:
        m.setattr(cursors, "set_cursor", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        try:
            cursors.advance(spark, "s", rows.filter("id is not null"), "id", "ms", sink, state, spool, 10)
        except RuntimeError:
            pass
    assert cursors.cursor(spark, state, "s") == (None, 0, 0)
    assert cursors.advance(spark, "s", rows.filter("id is not null"), "id", "ms", sink, state, spool, 20) == "sent"
    assert sorted(r["id"] for r in files.current(spark, sink.path).collect()) == ["a", "n"]
    assert cursors.advance(spark, "t", rows.filter("id = 'a'"), "id", "ms", sink, state, spool, 30) == "sent"
    assert cursors.cursor(spark, state, "s") == (5, 0, 20) and cursors.cursor(spark, state, "t") == (5, 0, 30)

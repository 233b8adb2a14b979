"""Streams: replay dedupe, late data, session debounce, two-source message merge, live board, dead letters."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.report import live_sessions
from ..sources.files import current, merge_into, replace

DEBOUNCE = "7 seconds"
FORCE = 200
KEEP = "24 hours"
LATE = "10 minutes"
FINAL_AGE_MS, QUIET_MS = 30_000, 2_000


def deduped(stream: DataFrame, key: str = "source_event_id", ts: str = "ts", keep: str = KEEP) -> DataFrame:
    """Rows whose key was not seen within ``keep``; of a table, which has an end, one row a key."""
    if not stream.isStreaming:
        return stream.dropDuplicates([key])
    return stream.withWatermark(ts, keep).dropDuplicatesWithinWatermark([key])


def debounced(stream: DataFrame, session: str = "session_id", ts: str = "ts", gap: str = DEBOUNCE, late: str = LATE) -> DataFrame:
    """(session, started, ended, events) of bursts that have been quiet for ``gap``; rows up to ``late`` late count."""
    out = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), session).agg(F.count("*").alias("events"))
    return out.select(session, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "events")


def forced(stream: DataFrame, session: str = "session_id", event: str = "event_id", ts: str = "ts", gap_ms: int = 7_000, most: int = FORCE, late: str = LATE) -> DataFrame:
    """(session, events, why): a session is ready once it holds ``most`` events ('full') or is quiet for
    ``gap_ms`` of event time ('quiet').  gap_ms = 0 makes every batch ready, as on a first run."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n = state.get[0]
            state.remove()
            yield pd.DataFrame({"session": [key[0]], "events": [n], "why": ["quiet"]})
            return
        n, last = state.get if state.exists else (0, 0)
        full = 0
        for pdf in batches:
            n += len(pdf)
            last = max(last, int(pdf["ms"].max()))
        full, n = (n // most, n % most) if gap_ms else (0, n)
        out = [(key[0], most, "full")] * full + ([(key[0], n, "quiet")] if not gap_ms and n else [])
        if n and gap_ms:
            state.update((n, last))
            state.setTimeoutTimestamp(max(last + gap_ms, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["session", "events", "why"])

    rows = stream.withWatermark(ts, late).select(F.col(session).cast("string").alias("session"), ts, F.unix_millis(ts).alias("ms"))
    return rows.groupBy("session").applyInPandasWithState(step, "session string, events bigint, why string", "n bigint, last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def merged_messages(stream: DataFrame, late: str = "1 minute") -> DataFrame:
    """One row a (host, message_id) from network and page sightings: the newest non-null of each field, the
    network's first; final once the message has been quiet past the age limit of event time.

    stream: (host, message_id, origin 'network' or 'dom', ts, role, text, model, done).
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fields = ["role", "text", "model"]
        if state.hasTimedOut:
            held = state.get
            state.remove()
            yield pd.DataFrame([(*key, *held[:3])], columns=["host", "message_id", *fields])
            return
        held = list(state.get) if state.exists else [None, None, None, False, False, False, 0]
        ended = False
        for pdf in batches:
            for r in pdf.sort_values("ms", kind="stable").itertuples():
                net = r.origin == "network"
                for i, f in enumerate(fields):
                    v = getattr(r, f)
                    if v is not None and v == v and (net or not held[3 + i]):
                        held[i], held[3 + i] = v, held[3 + i] or net
                held[6] = max(held[6], int(r.ms))
                ended = ended or bool(r.done)
        state.update(tuple(held))
        state.setTimeoutTimestamp(max(held[6] + (QUIET_MS if ended else FINAL_AGE_MS), state.getCurrentWatermarkMs() + 1))
        return
        yield

    rows = stream.withWatermark("ts", late).select("host", "message_id", "origin", "ts", F.unix_millis("ts").alias("ms"), "role", "text", "model", "done")
    held = "role string, text string, model string, r boolean, t boolean, m boolean, last bigint"
    return rows.groupBy("host", "message_id").applyInPandasWithState(step, "host string, message_id string, role string, text string, model string", held, "append", GroupStateTimeout.EventTimeTimeout)


def with_scalars(messages: DataFrame, scalars: DataFrame, ts: str = "ts", late: str = "1 minute") -> DataFrame:
    """Open messages with a model seen for their host up to the time limit before or after them.

    messages: (host, message_id, ts, ..); scalars: (host, ts, value).  Both sides are kept as long as they can meet.
    """
    m = messages.withWatermark(ts, late).alias("m")
    s = scalars.select(F.col("host").alias("host_"), F.col(ts).alias("ts_"), "value").withWatermark("ts_", late).alias("s")
    return m.join(s, F.expr(f"host = host_ and ts_ between {ts} - interval 30 seconds and {ts} + interval 30 seconds"), "left").drop("host_", "ts_")


def ship(stream: DataFrame, path: str, key: str, checkpoint: str, valid=None, dead_path: str | None = None):
    """Starts a query that merges each micro-batch into a table by key; rows that ``valid`` refuses go to a
    dead-letter table, so that a bad row never blocks the stream; they have a folder for each checkpoint and
    batch, so a batch that runs again does not repeat them.  Returns the query."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        good = batch.filter(valid) if valid is not None else batch
        merge_into(batch.sparkSession, good, path, key)
        if valid is not None and dead_path:
            of = f"{zlib.crc32(checkpoint.encode()):08x}-{epoch}"
            batch.filter(~F.coalesce(valid, F.lit(False))).write.mode("overwrite").parquet(f"{dead_path}/batch={of}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_board(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that keeps the live sessions of a stream (session_id, ts_ms) in a small table, read by
    :func:`current`.

    The board after a batch is made of the board before and the batch alone: a session that fell off it comes back
    only by an event of its own.  So the stream keeps no state, and a batch that runs again changes nothing.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before, rows = current(spark, path), batch.select("session_id", "ts_ms")
        if before is not None:
            rows = rows.unionByName(before.select("session_id", F.col("last_ms").alias("ts_ms")))
        replace(spark, live_sessions(rows).coalesce(1), path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

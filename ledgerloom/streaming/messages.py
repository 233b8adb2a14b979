"""Open chat messages, a state map a host: sightings of two sources merged, host-wide facts, timers, a fast first result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: A message is final at this age, or, once its stream ended, this long after the page first showed it, or,
#: while nothing was shipped yet, this long after its last update.
FINAL_AGE_MS, PAGE_QUIET_MS, EAGER_QUIET_MS = 30_000, 2_000, 1_500
#: Map state, timers and their recovery need this store; set it before a query starts.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

SIGHTING = ["message_id", "origin", "ts", "role", "text", "model", "conversation_id", "done"]
FIELDS = ["role", "text", "model", "conversation_id"]
OUT = "host string, message_id string, role string, text string, model string, conversation_id string, first_ms bigint, last_ms bigint, why string"


class OpenMessages(StatefulProcessor):
    """State of a host: its open messages by id, and whether one was shipped.

    A host has one timer, for the message that is final next.  ``eager``: until the first message is shipped, one whose
    stream ended is final once it has been quiet for a short time; the first ship turns that off.
    """

    def __init__(self, event_time: bool, eager: bool):
        self.event_time, self.eager = event_time, eager

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "message_id string", "role string, text string, model string, conversation_id string, first bigint, last bigint, page bigint, ended boolean")
        self.shipped = handle.getValueState("shipped", "at bigint")

    def due(self, m: dict, fast: bool) -> tuple[int, str]:
        found = [(m["first"] + FINAL_AGE_MS, "age")]
        if m["ended"] and fast:
            found.append((m["last"] + EAGER_QUIET_MS, "eager"))
        elif m["ended"] and m["page"] is not None:
            found.append((m["page"] + PAGE_QUIET_MS, "quiet"))
        return min(found)

    def messages(self) -> dict[str, dict]:
        names = [*FIELDS, "first", "last", "page", "ended"]
        return {k[0]: dict(zip(names, v, strict=True)) for k, v in self.open.iterator()}

    def put(self, key: str, m: dict) -> None:
        self.open.updateValue((key,), tuple(m.values()))

    def set_timer(self, rest: dict[str, dict], fast: bool) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if rest:
            self.handle.registerTimer(min(self.due(m, fast)[0] for m in rest.values()))

    def is_fast(self) -> bool:
        return self.eager and not self.shipped.exists()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, fast = self.messages(), self.is_fast()
        for pdf in rows:
            for r in pdf.sort_values("ms", kind="stable").to_dict("records"):
                now = int(r["ms"]) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
                told = {f: r[f] for f in FIELDS if r[f] is not None and r[f] == r[f]}
                if r["origin"] == "scalar":  # a fact of the host: all its open messages take it, whatever their age
                    for k, m in held.items():
                        if self.due(m, fast)[0] <= now:  # final by now, though its timer has still to come
                            continue
                        m.update({f: v for f, v in told.items() if f in ("model", "conversation_id")})
                        self.put(k, m)
                    continue
                m = held.setdefault(r["message_id"], {**dict.fromkeys(FIELDS), "first": now, "last": now, "page": None, "ended": False})
                kept = {"role"} if r["origin"] == "network" and m["role"] is not None else set()
                m.update({f: v for f, v in told.items() if f not in kept})
                m["last"], m["ended"] = max(m["last"], now), bool(m["ended"] or (r["done"] is True))
                if r["origin"] == "dom" and m["page"] is None:
                    m["page"] = now
                self.put(r["message_id"], m)
        self.set_timer(held, fast)
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs())
        held, out = self.messages(), []
        while True:
            fast = self.is_fast()
            ready = sorted((*self.due(m, fast), k) for k, m in held.items() if self.due(m, fast)[0] <= now)
            if not ready:
                break
            _, why, k = ready[0]
            m = held.pop(k)
            self.open.removeKey((k,))
            out.append((key[0], k, *(m[f] for f in FIELDS), m["first"], m["last"], why))
            if not self.shipped.exists():
                self.shipped.update((now,))
        self.set_timer(held, self.is_fast())
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def final_messages(sightings: DataFrame, scalars: DataFrame | None = None, event_time: bool = False, eager: bool = False, late: str = "1 second") -> DataFrame:
    """(host, message_id, role, text, model, conversation_id, first_ms, last_ms, why): each message once, when it is final.

    sightings: (host, message_id, origin 'network' or 'dom', ts, role, text, model, conversation_id, done); the newest
    non-null of each field counts, the role once known only by the page.  scalars: (host, ts, model, conversation_id), facts
    that all open messages of the host take.  Time is the clock's, or with ``event_time`` the stamps' and their
    watermark's, as in tests and replays.  A query over this needs ``STATE_STORE`` in its session's settings.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    rows = sightings.select(text("host"), *(text(c) for c in ("message_id", "origin")), "ts", *(text(c) for c in FIELDS), F.col("done").cast("boolean").alias("done"))
    if scalars is not None:
        none = F.lit(None).cast("string")
        rows = rows.unionByName(scalars.select(text("host"), none.alias("message_id"), F.lit("scalar").alias("origin"), "ts", none.alias("role"), none.alias("text"), text("model"), text("conversation_id"), F.lit(None).cast("boolean").alias("done")))
    if event_time:
        rows = rows.withWatermark("ts", late)
    rows = rows.withColumn("ms", F.unix_millis("ts"))
    return rows.groupBy("host").transformWithStateInPandas(OpenMessages(event_time, eager), OUT, "Append", "EventTime" if event_time else "ProcessingTime")

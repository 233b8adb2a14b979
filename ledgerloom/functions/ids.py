"""Deterministic ids and argument hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def base36(n: int) -> str:
    out = ""
    while n:
        n, d = divmod(n, 36)
        out = DIGITS[d] + out
    return out or "0"


def djb2(texts: pd.Series) -> pd.Series:
    """base36 of djb2-64 (h * 33 xor unit from 5381) over UTF-16 units, a column of units at a time."""
    units = [np.frombuffer((t or "").encode("utf-16-le", "surrogatepass"), "<u2") for t in texts]
    h = np.full(len(units), 5381, np.uint64)
    sizes = np.array([len(u) for u in units], np.int64)
    every, starts = np.concatenate([*units, np.zeros(0, "<u2")]).astype(np.uint64), np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")  # the longest first: those left at a place are a prefix
    longer = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(int(sizes.max(initial=0))), "right")
    for i, n in enumerate(longer.tolist()):
        live = order[:n]
        h[live] = (h[live] * np.uint64(33)) ^ every[starts[live] + i]
    return pd.Series([base36(int(x)) if t is not None else None for x, t in zip(h, texts, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def djb2_base36(text: pd.Series) -> pd.Series:
    return djb2(text)


def _id(prefix: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(prefix), djb2_base36(F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))))


def file_event_id(device: Column, file: Column, offset: Column) -> Column:
    return _id("evt_", device, "::fs::", file, "::", offset)


def line_event_id(device: Column, line_uuid: Column) -> Column:
    return _id("evt_", device, "::uuid::", line_uuid)


def record_event_id(device: Column, session: Column, record: Column) -> Column:
    return _id("evt_", device, "::rec::", session, "::", record)


def web_event_id(device: Column, host: Column, conversation: Column, message: Column) -> Column:
    return _id("evt_", device, "::web::", host, "::", conversation, "::", message)


def turn_event_id(device: Column, conversation: Column, cumulative: list[Column]) -> Column:
    return _id("evt_", device, "::codex::", conversation, "::", F.concat_ws(":", *(c.cast("string") for c in cumulative)))


def stated_event_id(device: Column, stated: Column, record_type: Column, ordinal: Column) -> Column:
    return _id("evt_", device, "::codexrec::", stated, "::", record_type, "::", ordinal)


def segment_id(session: Column, start_ms: Column, end_ms: Column, event_ids: Column) -> Column:
    return _id("seg_", session, "|", start_ms, "|", end_ms, "|", F.array_join(F.array_sort(event_ids), ","))


def call_id(event_id: Column, index: Column) -> Column:
    return _id("tc_", event_id, "|", index)


def content_hash(*parts: Column) -> Column:
    """32 hexadecimal digits of SHA-256 over the parts joined by a unit separator (null: empty)."""
    return F.left(F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"), 256), F.lit(32))


def compact_json(json: Column) -> Column:
    """JSON without white space between its parts; strings and the order of keys stay."""
    return F.regexp_replace(json, r'("(?:[^"\\]++|\\.)*+")|\s+', "$1")


def argument_hashes(json: Column) -> dict[str, Column]:
    """Hash of the compact JSON, hash of its sorted top-level keys (or none), and its bytes; null has neither."""
    compact = F.nullif(compact_json(F.coalesce(json, F.lit("null"))), F.lit("null"))
    keys = F.array_join(F.array_sort(F.json_object_keys(json)), ",")
    return {
        "args_hash": F.coalesce(F.sha2(compact.cast("binary"), 256), F.lit("")),
        "signature_hash": F.when(F.coalesce(keys, F.lit("")) == "", "none").otherwise(F.sha2(keys.cast("binary"), 256)),
        "args_bytes": F.coalesce(F.octet_length(compact), F.lit(0)),
    }

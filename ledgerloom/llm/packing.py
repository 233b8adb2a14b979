"""Concatenate-and-cut packing: global token offsets by two-pass prefix sums, then fixed windows.

Pass one encodes every document once and writes its ids, with the running token sum inside its
partition.  The totals of the partitions, one row each, are summed up in partition order; that gives every
document its offset in the one long stream of tokens.  Pass two cuts the stream every ``window`` tokens and
returns a boundary record for each piece.  Only the last sequence can be short.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

END_ID = 1


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe(path: str | None = None, pattern: str | None = None):
    """The byte-level BPE encoder of a rank file.

    byte_bpe_50k.tiktoken holds the vocabulary of byte_bpe_50k.json as ranks: both give the same ids (the
    tests compare them), and this library encodes about four times as fast.  The added tokens, which rank
    files lack, are those of the .json file beside it; ``ids_of`` finds them inside texts.
    """
    import base64
    import json
    import os

    import public_tokenizers
    import tiktoken

    with open(path or vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    added, full = {}, os.path.splitext(path or vocabulary_path())[0] + ".json"
    if os.path.exists(full):
        with open(full, encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f).get("added_tokens") or []}
    return tiktoken.Encoding("ranks", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def ids_of(bpe, text: str) -> list[int]:
    """The ids of the text; an added token written out in it is that token."""
    return bpe.encode(text, allowed_special="all", disallowed_special=())


def encoded(df: DataFrame, id_col: str, text_col: str, path: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """(part, start, n, doc_id, ids): ids as little-endian unsigned 32-bit, start counted in the partition."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe, part, at = byte_bpe(path), TaskContext.get().partitionId(), 0
        for b in batches:
            for low in range(0, b.num_rows, 256):
                some = b.slice(low, 256)
                starts, ns, ids = [], [], []
                for text in some.column(1):
                    x = ids_of(bpe, text.as_py() or "")
                    if end_id is not None:
                        x.append(end_id)
                    starts.append(at)
                    ns.append(len(x))
                    ids.append(np.array(x, dtype="<u4").tobytes())
                    at += len(x)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ns), pa.int32()), pa.array(starts, pa.int64()), pa.array(ns, pa.int64()), some.column(0), pa.array(ids, pa.binary())], names=["part", "start", "n", "doc_id", "ids"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"part int, start bigint, n bigint, doc_id {kind}, ids binary")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, path: str | None = None, end_id: int | None = END_ID, with_ids: bool = False) -> DataFrame:
    """A boundary record for each piece of each document.

    Columns: id, start (the document's ids before the piece), length, ids_crc32 (of the piece's ids as
    little-endian unsigned 32-bit), doc_tokens, sequence_id, offset (in the sequence), and with
    ``with_ids`` the piece's ids.  Null text counts as empty, which is one piece of one id (none if
    ``end_id`` is None).  Rows are packed in the order of the partitions; repeated or null ids are
    documents like any other.  No row is dropped, and each id is in exactly one piece.  Other columns are
    not read.
    """
    scratch = Scratch(df.sparkSession)
    kept = scratch.save(encoded(df, id_col, text_col, path, end_id))
    #: One row a partition.
    totals = kept.groupBy("part").agg(F.max(F.col("start") + F.col("n")).alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    rows = kept.join(F.broadcast(offsets), "part").select((F.col("base") + F.col("start")).alias("at"), "n", "doc_id", "ids")
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            cols = [[] for _ in range(7)]
            rows_of, blobs = [], []
            ats, ns = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i in range(b.num_rows):
                at, n, ids = int(ats[i]), int(ns[i]), memoryview(b.column(3)[i].as_buffer()) if ns[i] else b""
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(n - start, window - offset)
                    piece = ids[4 * start : 4 * (start + length)]
                    for c, v in zip(cols, (start, length, zlib.crc32(piece), n, sequence, offset), strict=False):
                        c.append(v)
                    rows_of.append(i)
                    if with_ids:
                        blobs.append(np.frombuffer(piece, "<u4").astype(np.int32))
                    start += length
            out = [b.column(2).take(pa.array(rows_of, pa.int32())), *(pa.array(c, pa.int64()) for c in cols[:6])]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                out, names = [*out, pa.array(blobs, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema)

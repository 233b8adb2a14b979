"""Removal of repeated byte strings: suffixes sorted in buckets, long ties settled by the ranks of a difference cover.

Two strings of ``width`` bytes are equal only if they start suffixes that agree that far.  A difference cover D modulo v
has, for any two positions, one shift below v that brings both onto D.  So of any two equal strings of ``width`` bytes
some pair of places less than v bytes in are both on D, and from there at least m = width - v + 1 bytes agree.

1. The suffixes at cover places, some sqrt(v) of every v, are ranked by their first m bytes.  Ranks follow a hash and
   not the alphabet, as equal ones only have to stand together.  A rank that occurs once ends here.
2. Every other suffix is known by the bytes up to its next cover place, the rank there, and the bytes that are left
   to ``width``.  Suffixes with one rank are a bucket.  A bucket is sorted by the bytes before and by the bytes after
   the cover place, and neighbours' common lengths give the strings that occur again.  Buckets are dealt to tasks, and
   a task sorts some at a time, so what it holds is bounded by ``bucket_rows`` suffixes, whatever the corpus.
3. A bucket of more than ``bucket_rows`` (a passage that very many texts have) is never brought together.  Its range
   of shifts is cut into pieces; all strings of a piece share more bytes, which make a longer rank.  Ranks are counted, those
   that occur once end, the pieces that are small enough are sorted as in step 2, and the others are cut again, in
   the end to whole strings that are ranks of their own.

Texts are compared once however many copies they have: equal texts are one text with a count.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, freed_shuffles

#: Perfect difference sets by their modulus: every difference but zero occurs once.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 57: (0, 1, 6, 15, 22, 26, 45, 55), 183: (0, 12, 19, 20, 22, 43, 60, 71, 76, 85, 89, 115, 121, 168)}
#: Factor of the rolling hash and its inverse; each byte counts with a number of 64 bits.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
BYTES = np.array([xxhash.xxh64_intdigest(bytes([b]), seed=5) | 1 for b in range(256)], np.uint64)


def modulus(width: int) -> int:
    """The largest cover that leaves half of the width or more to the ranks."""
    return max((v for v in COVERS if v <= (width + 1) // 2), default=0)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def blocks_of(texts: DataFrame, block_bytes: int) -> DataFrame:
    """(block, docs): the rows (key, copies, body) in runs of about ``block_bytes``, compressed."""

    def run(batches):
        part, made, kept, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for b in kept:
                    w.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + made], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "docs"])

        for b in batches:
            sizes = pa.compute.binary_length(b.column(2)).to_numpy()
            low = 0
            while low < b.num_rows:
                fits = int(np.searchsorted(np.cumsum(sizes[low:], dtype=np.int64), block_bytes - size)) + 1
                kept.append(b.slice(low, fits))
                size += int(sizes[low : low + fits].sum())
                low += fits
                if size >= block_bytes:
                    yield flush()
                    made, kept, size = made + 1, [], 0
        if kept:
            yield flush()

    return texts.select("key", "copies", "body").mapInArrow(run, "block bigint, docs binary")


class Block:
    """The texts of a block end to end, and where each starts."""

    def __init__(self, docs: pa.Scalar):
        t = pa.ipc.open_stream(docs.as_buffer()).read_all()
        self.keys, self.copies = t["key"], t["copies"].to_numpy()
        bodies = [b.as_buffer() for b in t["body"]]
        self.sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = b"".join(memoryview(b) for b in bodies)

    def cover(self, v: int, m: int) -> np.ndarray:
        """The places of the cover that have m bytes of their text from there on; each text starts anew."""
        if not len(self.sizes):
            return np.zeros(0, np.int64)
        d = np.array(COVERS[v])
        base = (np.arange(-(-int(self.sizes.max()) // v))[:, None] * v + d).reshape(-1)
        fits = np.searchsorted(base, self.sizes - m, side="right")
        return np.concatenate([s + base[:k] for s, k in zip(self.starts, fits, strict=True)])

    def fingerprints(self, at: np.ndarray, m: int, most: int = 1 << 20) -> np.ndarray:
        """Of the m bytes from each place: a rolling hash from running sums, some ``most`` bytes at a time."""
        out, raw = np.zeros(len(at), np.uint64), np.frombuffer(self.raw, np.uint8)
        up, down = powers(FACTOR, most + m), powers(INVERSE, most)
        for low in range(0, len(raw), most):
            i, j = np.searchsorted(at, [low, low + most])
            if i < j:
                part = raw[low : low + most + m]
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[part] * up[: len(part)], dtype=np.uint64)])
                p = at[i:j] - low
                out[i:j] = (sums[p + m] - sums[p]) * down[p]
        return out

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1


def cover_rows(blocks: DataFrame, v: int, m: int) -> DataFrame:
    """(rank, block, at, c): each rank that a block's cover places have, where first, and how often there."""

    def run(batches):
        for b in batches:
            for block, docs in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = Block(docs)
                at = x.cover(v, m)
                rank, first, c = np.unique(x.fingerprints(at, m), return_index=True, return_counts=True)
                for low in range(0, len(rank), 100_000):
                    s = slice(low, low + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(rank[s].view(np.int64)), pa.array(np.full(len(rank[s]), block)), pa.array(at[first[s]].astype(np.int32)), pa.array(c[s].astype(np.int32))], names=["rank", "block", "at", "c"])

    return blocks.mapInArrow(run, "rank bigint, block bigint, at int, c int")


SUFFIX = "rank binary, block bigint, at int, before binary, after binary, low int, high int, n bigint"


def suffix_rows(blocks: DataFrame, live: DataFrame, v: int, m: int) -> DataFrame:
    """A row for each cover place whose rank occurs again: the rank (128 bits of the m bytes), the bytes before it (v - 1
    at most, as far as its text goes) and after, and how often the hash of step 1 occurs."""

    def run(batches):
        for b in batches:
            for block, docs, at_, n_ in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3), strict=True):
                x = Block(docs)
                at = x.cover(v, m)
                prints = x.fingerprints(at, m)
                first = at_.values.to_numpy().astype(np.int64)
                known = prints[np.searchsorted(at, first)]
                order = np.argsort(known)
                known, often = known[order], n_.values.to_numpy()[order]
                where = np.minimum(np.searchsorted(known, prints), len(known) - 1)
                keep = np.flatnonzero(known[where] == prints)
                for low in range(0, len(keep), 10_000):
                    some = keep[low : low + 10_000]
                    p = at[some]
                    text = x.text_of(p)
                    begin, end = x.starts[text], x.starts[text] + x.sizes[text]
                    before = [x.raw[i:j] for i, j in zip(np.maximum(begin, p - v + 1).tolist(), p.tolist(), strict=True)]
                    after = [x.raw[i:j] for i, j in zip((p + m).tolist(), np.minimum(end, p + m + v - 1).tolist(), strict=True)]
                    rank = [xxhash.xxh3_128_digest(x.raw[i : i + m]) for i in p.tolist()]
                    k = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rank, pa.binary()), pa.array(np.full(k, block)), pa.array(p.astype(np.int32)), pa.array(before, pa.binary()), pa.array(after, pa.binary()), pa.array(np.zeros(k, np.int32)), pa.array(np.full(k, v - 1, np.int32)), pa.array(often[where[some]])],
                        names=["rank", "block", "at", "before", "after", "low", "high", "n"],
                    )

    dealt = live.groupBy("block").agg(F.collect_list(F.struct("at", "n")).alias("x")).select("block", F.col("x.at").alias("at"), F.col("x.n").alias("n"))
    return blocks.join(dealt, "block").select("block", "docs", "at", "n").mapInArrow(run, SUFFIX)


def padded(column: pa.Array, width: int, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of ``width`` bytes, what is missing zero, and their lengths."""
    sizes = pa.compute.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    out = np.zeros((len(sizes), width), np.uint8)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.repeat(sizes, sizes) - 1 - place if reverse else place] = flat
    return out, sizes


def sorted_common(x: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows by bucket and bytes, and the common length of each with the one before (-1: another bucket)."""
    by_bytes = np.argsort(np.ascontiguousarray(x).view(f"S{x.shape[1]}").reshape(-1), kind="stable")
    order = by_bytes[np.argsort(bucket[by_bytes], kind="stable")]
    s, common = x[order], np.full(len(x), -1)
    differ = s[1:] != s[:-1]
    same = bucket[order][1:] == bucket[order][:-1]
    common[1:][same] = np.where(differ[same].any(1), differ[same].argmax(1), x.shape[1])
    return order, common


def sort_bucket(bucket: np.ndarray, before: pa.Array, after: pa.Array, low: np.ndarray, high: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, most): of each suffix the smallest and largest shift whose whole string another of its bucket has too;
    most is -1 where none has.  A shift s takes s bytes before the cover place and v - 1 - s after the rank."""
    n, w = len(bucket), v - 1
    left, n_left = padded(before, w, reverse=True)
    right, n_right = padded(after, w, reverse=False)
    least, most = np.full(n, v), np.full(n, -1)
    sizes = np.bincount(bucket)
    # Pairs need no sort: all shifts between the two common lengths.
    order = np.argsort(bucket, kind="stable")
    two = order[sizes[bucket[order]] == 2].reshape(-1, 2)
    if len(two):
        a, b = two.T
        run = lambda x, size: np.minimum(np.where((x[a] != x[b]).any(1), (x[a] != x[b]).argmax(1), w), np.minimum(size[a], size[b]))
        top, bottom = np.minimum(run(left, n_left), high[a]), np.maximum(w - run(right, n_right), low[a])
        hit = bottom <= top
        for side in (a[hit], b[hit]):
            least[side], most[side] = bottom[hit], top[hit]
    rest = np.flatnonzero(sizes[bucket] > 2)
    if len(rest):
        left, right, n_left, n_right = left[rest], right[rest], n_left[rest], n_right[rest]
        bucket, low, high = np.unique(bucket[rest], return_inverse=True)[1], low[rest], high[rest]
        by_left, common_left = sorted_common(left, bucket)
        by_right, common_right = sorted_common(right, bucket)
        least_, most_ = np.full(len(rest), v), np.full(len(rest), -1)

        def repeated(shift: int, some: np.ndarray) -> np.ndarray:
            """Those of ``some`` whose string at this shift occurs again."""
            ok = some & (n_left >= shift) & (n_right >= w - shift) & (low <= shift) & (shift <= high)
            group_left, group_right = np.empty(len(rest), np.int64), np.empty(len(rest), np.int64)
            group_left[by_left] = np.cumsum(common_left < shift)
            group_right[by_right] = np.cumsum(common_right < w - shift)
            at = np.flatnonzero(ok)
            key = group_left[at] * (len(rest) + 1) + group_right[at]
            o = np.argsort(key)
            same = key[o][1:] == key[o][:-1]
            hit = np.zeros(len(at), bool)
            hit[1:] |= same
            hit[:-1] |= same
            return at[o[hit]]

        # The ends first: a bucket whose members all have both is done.
        every = np.ones(len(rest), bool)
        for shift in (w, 0):
            hit = repeated(shift, every)
            least_[hit], most_[hit] = np.minimum(least_[hit], shift), np.maximum(most_[hit], shift)
        done = (least_ == 0) & (most_ == w)
        some = np.bincount(bucket, ~done)[bucket] > 0
        if some.any():
            for shift in range(int(low[some].min()), int(high[some].max()) + 1):
                hit = repeated(shift, some)
                least_[hit], most_[hit] = np.minimum(least_[hit], shift), np.maximum(most_[hit], shift)
        least[rest], most[rest] = least_, most_
    return least, most


def sorted_buckets(rows: DataFrame, v: int, run_rows: int) -> DataFrame:
    """(block, at, least, most) of the suffixes that share a string of full width with another of their bucket."""

    def whole_buckets(batches):
        """Runs of rows that hold their buckets whole; a bucket's rows stand together."""
        kept, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            rank = b.column(0)
            cut = int(np.flatnonzero(np.array(pa.compute.not_equal(rank.slice(1), rank.slice(0, b.num_rows - 1))))[-1] + 1) if b.num_rows > 1 and rank[0] != rank[-1] else 0
            if kept and kept[-1].column(0)[-1] != rank[0] and size >= run_rows:
                yield pa.Table.from_batches(kept)
                kept, size = [], 0
            if cut and size + cut >= run_rows:
                yield pa.Table.from_batches([*kept, b.slice(0, cut)])
                kept, size = [], 0
                b = b.slice(cut)
            kept.append(b)
            size += b.num_rows
        if kept:
            yield pa.Table.from_batches(kept)

    def run(batches):
        for t in whole_buckets(batches):
            t = t.combine_chunks()
            bucket = t["rank"].combine_chunks().dictionary_encode()
            bucket = (bucket.combine_chunks() if isinstance(bucket, pa.ChunkedArray) else bucket).indices.to_numpy()
            least, most = sort_bucket(bucket, t["before"].combine_chunks(), t["after"].combine_chunks(), t["low"].to_numpy(), t["high"].to_numpy(), v)
            hit = np.flatnonzero(most >= 0)
            yield pa.RecordBatch.from_arrays([t["block"].to_numpy()[hit], t["at"].to_numpy()[hit], least[hit].astype(np.int32), most[hit].astype(np.int32)], names=["block", "at", "least", "most"])

    dealt = rows.repartition("rank").sortWithinPartitions("rank")
    return dealt.select("rank", "block", "at", "before", "after", "low", "high").mapInArrow(run, "block bigint, at int, least int, most int")


def shift_rows(rows: DataFrame, v: int, width: int) -> DataFrame:
    """(rank, block, at, of_low, of_high, low, high) of the ends of each suffix's range of shifts (whole strings: low =
    high) and of the pieces of ``width`` shifts between them; the rank is given by all bytes that the strings of the
    piece have in common."""
    names = ["rank", "block", "at", "of_low", "of_high", "low", "high"]

    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                out = [[] for _ in names]
                for r in b.slice(start, 1000).to_pylist():
                    i, j, before, after = r["low"], r["high"], r["before"], r["after"]
                    for p, q in dict.fromkeys([(i, i), (j, j), *((p, min(p + width, j) - 1) for p in range(i + 1, j, width))]):
                        if len(before) >= p and len(after) >= v - 1 - q:
                            shared = b"%s|%d|%d|%s|%s" % (r["rank"], p, q, before[len(before) - p :], after[: v - 1 - q])
                            for c, x in zip(out, (xxhash.xxh3_128_digest(shared), r["block"], r["at"], i, j, p, q), strict=True):
                                c.append(x)
                kinds = (pa.binary(), pa.int64(), *[pa.int32()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return rows.select("rank", "block", "at", "before", "after", "low", "high").mapInArrow(run, "rank binary, block bigint, at int, of_low int, of_high int, low int, high int")


def repeated_shifts(blocks: DataFrame, live: DataFrame, v: int, m: int, bucket_rows: int, run_rows: int, scratch: Scratch) -> DataFrame:
    """(block, at, least, most), as ``sorted_buckets``; buckets of more than ``bucket_rows`` by pieces of their range.
    live: (block, at, n)."""
    found = [scratch.save(sorted_buckets(suffix_rows(blocks, live.filter(F.col("n") <= bucket_rows), v, m), v, run_rows))]
    large = live.filter(F.col("n") > bucket_rows)
    if not large.isEmpty():
        large = context = scratch.save(suffix_rows(blocks, large, v, m))
        for width in (max(2, v // 7), 5, 1):
            parts = shift_rows(large, v, width)
            again = scratch.save(parts.join(parts.groupBy("rank").agg(F.count("*").alias("n")).filter("n > 1"), "rank"))
            found.append(again.filter("low = high").select("block", "at", F.col("low").alias("least"), F.col("high").alias("most")))
            #: Only the smallest and the largest shift count: a range with both ends is done, and so is a piece of such ranges alone.
            key = ["block", "at", "of_low", "of_high"]
            done = again.filter("low = high and (low = of_low or low = of_high)").groupBy(*key).agg(F.count("*").alias("k")).filter("k = 2").select(*key)
            pieces = again.filter("low < high")
            pieces = pieces.join(pieces.join(done, key, "left_anti").select("rank").distinct(), "rank", "left_semi")
            open_ = scratch.save(pieces.select("rank", "block", "at", "low", "high", "n").join(context.select("block", "at", "before", "after"), ["block", "at"]))
            found.append(scratch.save(sorted_buckets(open_.filter(F.col("n") <= bucket_rows), v, run_rows)))
            large = open_.filter(F.col("n") > bucket_rows)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def cut_texts(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """(key, n_removed, n_spans, kept): of each text with spans to remove (block, low, high)."""

    def run(batches):
        for b in batches:
            for docs, lows, highs in zip(b.column(0), b.column(1), b.column(2), strict=True):
                x = Block(docs)
                low, high = lows.values.to_numpy().astype(np.int64), highs.values.to_numpy().astype(np.int64)
                text = x.text_of(low)
                order = np.lexsort((low, text))
                low, high, text = low[order], np.maximum.accumulate(high[order]), text[order]  # texts stand in order, so ends only grow
                first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (low[1:] > high[:-1])]))
                run_low, run_high, run_text = low[first], np.maximum.reduceat(high, first), text[first]
                keys, removed, spans_, kept = [], [], [], []
                for t in np.unique(run_text).tolist():
                    mine = slice(*np.searchsorted(run_text, [t, t + 1]))
                    digest, at = hashlib.sha256(), int(x.starts[t])
                    for i, j in zip(run_low[mine].tolist(), run_high[mine].tolist(), strict=True):
                        digest.update(x.raw[at:i])
                        at = j
                    digest.update(x.raw[at : int(x.starts[t] + x.sizes[t])])
                    keys.append(x.keys[t].as_py())
                    removed.append(int((run_high[mine] - run_low[mine]).sum()))
                    spans_.append(mine.stop - mine.start)
                    kept.append(digest.hexdigest())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(removed, pa.int64()), pa.array(spans_, pa.int64()), pa.array(kept, pa.string())], names=["key", "n_removed", "n_spans", "kept"])

    dealt = spans.groupBy("block").agg(F.collect_list(F.struct("low", "high")).alias("x")).select("block", F.col("x.low").alias("low"), F.col("x.high").alias("high"))
    return blocks.join(dealt, "block").select("docs", "low", "high").mapInArrow(run, "key string, n_removed bigint, n_spans bigint, kept string")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 400, block_bytes: int = 1 << 23, bucket_rows: int = 1 << 16, run_rows: int = 20_000) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``df``.

    Removed is every byte that a string of ``width`` bytes covers which starts anywhere else too, in its own text or
    another; overlapping strings count, and all are judged on the texts as they came.  n_spans: maximal removed
    runs; kept_sha256: of the remaining bytes end to end.

    Texts are UTF-8 bytes; null counts as empty.  Texts shorter than ``width`` lose nothing.  Repeated rows are copies of
    each other and lose all.  Null and repeated ids keep their rows; an empty table gives none.  Other columns
    are not read.
    """
    v = modulus(width)
    if not v:
        raise ValueError("width must be 5 or more")
    spark, m = df.sparkSession, width - v + 1
    scratch = Scratch(spark)
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    with freed_shuffles(spark):
        texts = df.select(body.alias("text")).filter(F.octet_length("text") >= width).groupBy("text").agg(F.count("*").alias("copies"))
        blocks = scratch.save(blocks_of(texts.select(F.sha2("text", 256).alias("key"), "copies", F.col("text").cast("binary").alias("body")), block_bytes))
        ranked = cover_rows(blocks, v, m).withColumn("n", F.sum("c").over(Window.partitionBy("rank"))).filter("n > 1")
        live = scratch.save(ranked.select("block", "at", "n"))
        shifts = repeated_shifts(blocks, live, v, m, bucket_rows, run_rows, scratch)
        spans = shifts.select("block", (F.col("at") - F.col("most")).alias("low"), (F.col("at") - F.col("least") + width).alias("high"))
        cut = scratch.save(cut_texts(blocks, spans))
        copied = scratch.save(copied_texts(blocks))
    gone = copied.select("key", F.col("size").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept"))
    result = cut.join(copied.select("key"), "key", "left_anti").unionByName(gone)
    rows = df.select(F.col(id_col).alias("id"), F.octet_length(body).cast("bigint").alias("n_bytes"), F.sha2(body, 256).alias("key"))
    return rows.join(result, "key", "left").select(F.col("id").alias(id_col), "n_bytes", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_removed", "n_spans")), F.coalesce("kept", "key").alias("kept_sha256"))


def copied_texts(blocks: DataFrame) -> DataFrame:
    """(key, size) of the texts that occur more than once."""

    def run(batches):
        for b in batches:
            for docs in b.column(0):
                x = Block(docs)
                some = np.flatnonzero(x.copies > 1)
                yield pa.RecordBatch.from_arrays([x.keys.take(pa.array(some)).combine_chunks(), pa.array(x.sizes[some])], names=["key", "size"])

    return blocks.select("docs").mapInArrow(run, "key string, size bigint")

"""Exact top-k by integer inner product over a pivot-distance index.

All vectors are lifted to one length: a coordinate sqrt(M^2 - |x|^2), M the largest length, is added to each
candidate and zero to each query, so that the largest inner product is the smallest distance,
d^2 = |q|^2 + M^2 - 2 q.x.  Each vector is keyed by its nearest pivot and its distance to it; the keys of a
pivot are cut into rings (annuli) of the sorted distances, and rings into slices of bounded size.

A query first scans the ring of its nearest pivot that is nearest in distance, which gives it k scores to
beat.  Then, by the triangle inequality, no vector of a ring [low, high] of pivot p is nearer to q than
max(low - d(q,p), d(q,p) - high, 0): the rings expand outwards from d(q,p), and those whose bound can't
reach the k-th score are never read.  The bound is loosened by a hair for rounding, so the result is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of each component; null ids, and vectors that are null or hold null
    or non-finite components, are left out; an empty vector stays, its products are 0."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("x")).filter("id is not null and x is not null")
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    return rows.filter(finite).select("id", F.transform("x", lambda e: F.floor(F.lit(float(scale)) * e.cast("double"))).alias("v"))


def matrix(lists: list, width: int) -> np.ndarray:
    """Rows of integers, padded with zeros; as float64 where every product sum is exact in it, else Python
    integers."""
    out = np.zeros((len(lists), width), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    most = float(np.abs(out.astype(np.float64)).max(initial=0))
    return out.astype(np.float64) if most * most * max(width, 1) < 2**52 else out.astype(object)


def exact_top_k(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, every: int = 50, scale: float = 256.0, pivots: int = 32, ring_width: float = 16.0, slice_rows: int = 1024, query_rows: int = 256, read: dict[str, int] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's own
    (by row, so a repeated id can find its twin).  Shorter vectors count as padded with zeros.  With fewer
    candidates than k all are returned; an empty table gives no rows.  ``read``, if given, gets the number of
    (query, slice) pairs that are scanned after the first ring, and the number of all.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = scratch.save(integer_vectors(df, id_col, vec_col, scale).withColumn("row", F.monotonically_increasing_id()))
    norm = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    most, width = rows.agg(F.max(norm), F.max(F.size("v"))).first()
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("row"), "row").limit(pivots).collect()]
    top2, width = float(most or 0.0), int(width or 1)
    shared = spark.sparkContext.broadcast((matrix(sample, width).astype(np.float64), top2)) if sample else None

    def lift(m: np.ndarray) -> np.ndarray:
        m = m.astype(np.float64)
        return np.concatenate([m, np.sqrt(np.maximum(top2 - (m * m).sum(1), 0))[:, None]], axis=1)

    def far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))

    def key(batches):
        centres = lift(shared.value[0]) if shared else None
        for b in batches:
            if b.num_rows:
                d = far(lift(matrix(b.column(2).to_pylist(), width)), centres)
                best = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.int32()), pa.array(d[np.arange(len(d)), best])], names=["row", "id", "v", "pivot", "dist"])

    index = scratch.save(rows.select("row", "id", "v").mapInArrow(key, "row bigint, id bigint, v array<bigint>, pivot int, dist double").withColumn("ring", F.floor(F.col("dist") / ring_width)))
    rings = scratch.save(index.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).withColumn("slices", F.ceil(F.col("n") / slice_rows)))
    sliced = index.join(rings.select("pivot", "ring", "slices"), ["pivot", "ring"])
    packed = sliced.withColumn("slice", F.pmod(F.xxhash64("row"), F.col("slices"))).groupBy("pivot", "ring", "slice").agg(F.collect_list(F.struct("row", "id", "v")).alias("x"))
    packed = scratch.save(packed.select("pivot", "ring", "slice", F.col("x.row").alias("rows"), F.col("x.id").alias("ids"), F.col("x.v").alias("vs")))

    def ask(batches):
        centres = lift(shared.value[0]) if shared else None
        for b in batches:
            if b.num_rows:
                q = matrix(b.column(2).to_pylist(), width).astype(np.float64)
                d = far(np.concatenate([q, np.zeros((len(q), 1))], axis=1), centres)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((q * q).sum(1)), pa.array(list(d), pa.list_(pa.float64()))], names=["q", "query_id", "qv", "q2", "ds"])

    asked = scratch.save(rows.filter(F.col("id") % every == 0).select(F.col("row").alias("q"), F.col("id").alias("query_id"), F.col("v").alias("qv")).mapInArrow(ask, "q bigint, query_id bigint, qv array<bigint>, q2 double, ds array<double>"))

    def scan(batches):
        for b in batches:
            out = [[] for _ in range(5)]
            for i in range(b.num_rows):
                qs, own = b.column(0)[i].as_py(), b.column(1)[i].values.to_numpy(zero_copy_only=False)
                ids = b.column(2)[i].values.to_numpy(zero_copy_only=False)
                q, x = matrix([r["qv"] for r in qs], width), matrix(b.column(3)[i].as_py(), width)
                if q.dtype != x.dtype:
                    q, x = q.astype(object), x.astype(object)
                scores = np.dot(q, x.T)
                for r, s in zip(qs, scores, strict=True):
                    s = s.astype(np.int64) if s.dtype != object else s
                    ok = (own != r["q"]) & (s >= r["least"])
                    at = np.flatnonzero(ok)
                    for j in sorted(at, key=lambda j: (-s[j], ids[j], own[j]))[:k] if len(at) <= 4 * k else _best(s, ids, own, at, k):
                        for c, v in zip(out, (r["q"], r["query_id"], int(ids[j]), int(s[j]), int(own[j])), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["q", "query_id", "vec_id", "score", "row"])

    def scanned(wanted: DataFrame) -> DataFrame:
        """wanted: (q, query_id, qv, least, pivot, ring, slice); queries of a slice go in bounded blocks."""
        sizes = wanted.groupBy("pivot", "ring", "slice").agg(F.ceil(F.count("*") / query_rows).alias("blocks"))
        blocks = wanted.join(sizes, ["pivot", "ring", "slice"]).withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks"))).groupBy("pivot", "ring", "slice", "block").agg(F.collect_list(F.struct("q", "query_id", "qv", "least")).alias("qs"))
        return blocks.join(packed, ["pivot", "ring", "slice"]).select("qs", "rows", "ids", "vs").mapInArrow(scan, "q bigint, query_id bigint, vec_id bigint, score bigint, row bigint")

    by = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "row")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)

    home = asked.withColumn("pivot", (F.array_position("ds", F.array_min("ds")) - 1).cast("int")).withColumn("d", F.array_min("ds"))
    gap = F.greatest(F.lit(0.0), F.col("low") - F.col("d"), F.col("d") - F.col("high"))
    seed = home.join(rings.filter(F.col("n") > k), "pivot").withColumn("gap", gap).groupBy("q").agg(F.min_by(F.struct("query_id", "qv", "pivot", "ring", "slices"), F.struct("gap", "ring")).alias("x")).select("q", "x.*")
    seed = seed.select("q", "query_id", "qv", F.lit(-(1 << 62)).alias("least"), "pivot", "ring", F.pmod("q", "slices").alias("slice"))
    kth = scratch.save(ranked(scanned(seed)).groupBy("q").agg(F.min("score").alias("kth"), F.count("*").alias("n")).filter(F.col("n") == k).select("q", "kth"))

    opened = asked.join(kth, "q", "left").select("q", "query_id", "qv", "q2", F.coalesce("kth", F.lit(-(1 << 62))).alias("least"), F.posexplode("ds").alias("pivot", "d"))
    bound = (F.col("q2") + F.lit(top2) - gap * gap) / 2
    reach = opened.join(rings, "pivot").filter(bound >= F.col("least") - 1e-6 * (F.abs(bound) + F.col("q2") + top2) - 1)
    wanted = scratch.save(reach.select("q", "query_id", "qv", "least", "pivot", "ring", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")))
    if read is not None:
        read["scanned"], read["all"] = wanted.count(), asked.count() * packed.count()
    return ranked(scanned(wanted)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _best(s: np.ndarray, ids: np.ndarray, own: np.ndarray, at: np.ndarray, k: int) -> list[int]:
    """The k best of the positions ``at``: score down, then id, then row."""
    least = np.partition(s[at], len(at) - k)[len(at) - k]
    above, equal = at[s[at] > least], at[s[at] == least]
    equal = equal[np.lexsort((own[equal], ids[equal]))][: k - len(above)]
    return [*above, *equal]

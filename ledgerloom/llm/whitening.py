"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its triangular factor.

Sums and scatters are gathered in Spark, a few rows a task and d x d numbers in all; d is the vectors' length, which
does not grow with the rows.  The scatter A of the centred vectors is factored on the driver as L L' with the largest
remaining diagonal entry as the pivot.  Columns of L are rotated in pairs until all are orthogonal.  A rotation from the
right leaves L L' as it is, so the squared lengths of the rotated columns are the eigenvalues of A and the columns,
normalised, its eigenvectors.  A is never squared or reduced to another form, so small eigenvalues keep their digits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Entries are held to this many units, so that sums of many rows stay whole numbers of 64 bits.
MOST = float(1 << 40)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L (d x rank) with a = L L', its rows in the order of ``a``; ends when what is left is rounding."""
    a, d = np.array(a, np.float64), len(a)
    left, factor, most = np.diag(a).copy(), np.zeros((d, d)), float(np.max(np.diag(a), initial=0.0))
    for k in range(d):
        p = int(left.argmax())
        if left[p] <= d * np.finfo(float).eps * most or left[p] <= 0:
            return factor[:, :k]
        column = (a[:, p] - factor[:, :k] @ factor[p, :k]) / np.sqrt(left[p])
        factor[:, k] = np.where(left < 0, 0.0, column)  # rows that were pivots have nothing left
        factor[p, k] = np.sqrt(left[p])
        left -= factor[:, k] ** 2
        left[p] = -1.0
        left[(left < 0) & (left > -1.0)] = 0.0
    return factor


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of factor factor': values falling, a vector a column, its largest entry positive.

    A sweep meets every pair of columns once, in rounds of pairs that have no column in common.
    """
    g = np.array(factor, np.float64)
    n = g.shape[1]
    if n:
        ring = np.arange(n + n % 2)  # with an odd number one column sits out
        for _ in range(sweeps):
            worst = 0.0
            for _ in range(len(ring) - 1):
                p, q = ring[: len(ring) // 2], ring[::-1][: len(ring) // 2]
                keep = (p < n) & (q < n)
                p, q = p[keep], q[keep]
                x, y = g[:, p], g[:, q]
                xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
                size = np.sqrt(xx * yy)
                off = np.abs(xy) > 1e-15 * size
                worst = max(worst, float(np.max(np.abs(xy[size > 0]) / size[size > 0], initial=0.0)))
                zeta = (yy - xx) / np.where(off, 2 * xy, 1.0)
                t = np.where(off, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0.0)
                c = 1 / np.sqrt(1 + t * t)
                g[:, p], g[:, q] = c * x - c * t * y, c * t * x + c * y
                ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
            if worst <= 1e-14:
                break
    values = (g * g).sum(0)
    order = np.argsort(-values, kind="stable")
    values, g = values[order], g[:, order] / np.sqrt(values[order])
    return values, g * np.where(np.take_along_axis(g, np.abs(g).argmax(0)[None], 0) < 0, -1.0, 1.0)


def matrix(column: pa.Array, width: int, fill: int = 0) -> np.ndarray:
    """Lists of whole numbers as rows of ``width``."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.full((len(sizes), width), fill, np.int64)
    out[np.arange(width)[None] < sizes[:, None]] = flat
    return out


def gathered(df: DataFrame, cells, exact: bool) -> list:
    """Sums over all rows of ``cells(column)``, an array a batch: added up in each task, then by place.  None without rows."""

    def run(batches):
        total = None
        for b in batches:
            for low in range(0, b.num_rows, 4096):
                part = cells(b.column(0).slice(low, 4096)).reshape(-1)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["place", "cell"])

    kind = "bigint" if exact else "double"
    summed = F.sum(F.col("cell").cast("decimal(38,0)")) if exact else F.sum("cell")
    got = df.mapInArrow(run, f"place bigint, cell {kind}").groupBy("place").agg(summed.alias("cell")).orderBy("place").toArrow()
    return got["cell"].to_pylist()


def covariance(df: DataFrame, rows_of, mean: np.ndarray, n: int) -> np.ndarray:
    """Of the rows ``rows_of(column)``, centred before they are multiplied, divisor n."""

    def scatter(col):
        y = rows_of(col) - mean
        return y.T @ y

    out = np.array(gathered(df, scatter, exact=False)).reshape(len(mean), len(mean)) / n
    return (out + out.T) / 2


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: float, shift: int) -> DataFrame:
    """(id, x): floor(scale * c) + shift of each entry; null vectors and those with null or non-finite entries are left out."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).filter("v is not null")
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    held = lambda e: F.least(F.greatest(F.lit(float(scale)) * e.cast("double"), F.lit(-MOST)), F.lit(MOST))
    return rows.filter(finite).select("id", F.transform("v", lambda e: F.floor(held(e)) + F.lit(shift)).alias("x"))


def whitened(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16, scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """A row for each vector and component: id, component, n, deviation, whitened, explained, identity_error.

    x = floor(scale * entry) + shift.  The fit list is each distinct x once: n vectors, sums S.  Components are unit
    eigenvectors of its covariance (divisor n), numbered from 1 by falling eigenvalue e, the largest entry positive.
    deviation is the exact sum of (n*x - S)^2, null where it needs over 64 bits; whitened is x - S/n on the component
    over sqrt(e); explained is e over the trace; identity_error is measured over the fit list with the components
    returned.

    Null vectors and those with null or non-finite entries give no rows.  Shorter vectors count as filled up with
    zero entries.  Entries beyond 2^40 units are held there.  Directions without variance are no components, so vectors
    of lower rank give fewer, and one distinct vector, or an empty table, no rows.  Repeated rows and null ids
    keep their rows.  Other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = scratch.save(whole_vectors(df, id_col, vec_col, scale, shift))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    width = int(rows.agg(F.max(F.size("x"))).first()[0] or 0)
    wide = F.concat("x", F.array_repeat(F.lit(shift).cast("bigint"), F.lit(width) - F.size("x")))
    fit = scratch.save(rows.select(wide.alias("x")).distinct())
    n = fit.count()
    values = np.zeros(0)
    if n > 1 and width:
        off = lambda col: matrix(col, width, shift) - shift
        offsets = [int(s) for s in gathered(fit, lambda col: off(col).sum(0), exact=True)]
        mean = np.array([s / n for s in offsets])
        cov = covariance(fit, off, mean, n)
        values, vectors = one_sided_jacobi(pivoted_cholesky(cov))
        values, vectors = values[:components], vectors[:, :components]
    if not len(values):
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    explained, turned = values / np.trace(cov), vectors / np.sqrt(values)
    onto = lambda col: (off(col) - mean) @ turned
    centre = np.array(gathered(fit, lambda col: onto(col).sum(0), exact=False)) / n
    error = float(np.abs(covariance(fit, onto, centre, n) - np.eye(len(values))).max())

    def deviations(x: np.ndarray) -> list:
        if float(n) * float(np.abs(x).max(initial=1)) + max(map(abs, offsets)) < 2.0**31 / np.sqrt(width):
            return ((n * x - np.array(offsets, np.int64)) ** 2).sum(1).tolist()
        exact = [sum((n * int(e) - s) ** 2 for e, s in zip(r, offsets, strict=True)) for r in x]
        return [e if e < 1 << 63 else None for e in exact]

    def run(batches):
        k = len(values)
        for b in batches:
            for low in range(0, b.num_rows, 4096):
                x = off(b.column(1).slice(low, 4096))
                m = len(x)
                at = pa.array(np.repeat(np.arange(m), k))
                columns = [b.column(0).slice(low, 4096).take(at), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n), pa.array(deviations(x), pa.int64()).take(at), ((x - mean) @ turned).reshape(-1), np.tile(explained, m), np.full(m * k, error)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)

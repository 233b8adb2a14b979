"""Shared pieces of the training-data operators: scratch tables and connected components."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import shared_dir

#: Words of the byte-wise contracts: runs of anything but space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.made = 0
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.base}/{self.made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes tables of this scratch that no later plan reads."""
        for t in tables:
            path = self.paths.pop(id(t), None) if t is not None else None
            if path:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files go when the query that made them ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores added while the table has such a column (case ignored)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_bucket(id_col: str, mod: int) -> F.Column:
    """crc32 of the id written as text, modulo ``mod`` (null id: null)."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(mod))


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for every node of ``edges`` (u, v: bigint); comp is the component's smallest node.

    Alternating large-star and small-star steps, each a grouped minimum joined back to the edges and
    written to the shared folder.  The number of rounds grows with the logarithm of the longest path.
    An empty edge table gives an empty result; loops and repeated edges are ignored.  Files of edges are much smaller than
    the edges in memory, so the joins are by sort and merge whatever the size of the files.
    """
    e = scratch.save(distinct_edges(edges))
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        new = scratch.save(distinct_edges(small))
        scratch.drop(e)
        e, (old, mark) = new, (mark, _mark(new))
        if mark == old:
            break
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


def _mark(e: DataFrame) -> tuple:
    x = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return x[0], x[1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def has_column(df: DataFrame, name: str) -> bool:
    return any(re.fullmatch(re.escape(name), c, re.IGNORECASE) for c in df.columns)


def string_or_empty(col: str) -> F.Column:
    return F.coalesce(F.col(col).cast(T.StringType()), F.lit(""))

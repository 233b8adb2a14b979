"""Runs whose limits restart at every cut, without a walk over the rows.

Where a run ends depends only on where it starts.  So each row gets a link to the start of the next run as if one
started there, found by searches in running sums.  Rows are numbered in their group and dealt in chunks of bounded size,
each with the rows after it that a link can reach; links are followed within all chunks at once.  A group of many
chunks, however long, is many tasks: for each place where a run can enter a chunk the chunk tells where it leaves and
how many runs it opens, and these small maps are put together by doubling, in joins that follow the logarithm of the
number of chunks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut_lineage

#: link(columns, ends) -> for each row the first row of the next run, if a run starts at the row; ends: one past
#: the last row of its group that is here.
Link = Callable[[dict[str, pa.Array], np.ndarray], np.ndarray]


def same(left: str, right: str, keys: list[str]) -> Column:
    """The keys of both sides are equal; nulls equal each other."""
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys))


def numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with ``rn_``, the place of each row in its group from 0: sorted by ranges, so a long group is many tasks."""
    by_range = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = cut_lineage(by_range.withColumn("part_", F.spark_partition_id()).withColumn("at_", F.monotonically_increasing_id()))
    sizes = placed.groupBy(*keys, "part_").agg(F.min("at_").alias("first_"), F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select(*keys, "part_", (before - F.col("first_")).alias("base_"))
    joined = placed.alias("a").join(base.alias("b"), same("a", "b", [*keys, "part_"]))
    return joined.select(*(F.col(f"a.{c}") for c in df.columns), (F.col("a.at_") + F.col("b.base_")).alias("rn_"))


def _starts(t) -> np.ndarray:
    """Whether a row is the first of its group here: its place does not grow, or its chunk is another."""
    slot, chunk = t.column("slot_").to_numpy(), t.column("chunk_").to_numpy()
    return np.concatenate([[True], (slot[1:] <= slot[:-1]) | (chunk[1:] != chunk[:-1])])


def _groups(batches, rows: int):
    """Tables of whole groups of some ``rows`` rows."""
    kept, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        new = _starts(b)
        if kept:
            end = kept[-1].slice(kept[-1].num_rows - 1)
            new[0] = b.column("slot_")[0].as_py() <= end.column("slot_")[0].as_py() or b.column("chunk_")[0] != end.column("chunk_")[0]
        starts = np.flatnonzero(new)
        if len(starts) and size + starts[-1] >= rows:
            yield pa.Table.from_batches([*kept, b.slice(0, starts[-1])])
            kept, size, b = [], 0, b.slice(starts[-1])
        kept.append(b)
        size += b.num_rows
    if kept:
        yield pa.Table.from_batches(kept)


def _chain(links: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Which rows the links reach from the entries; links beyond the last row end.  Doubling, no walk."""
    n = len(links)
    jump = np.concatenate([np.minimum(links, n), [n]])
    on = np.zeros(n + 1, bool)
    on[entry] = True
    while True:
        new = on.copy()
        new[jump[np.flatnonzero(on)]] = True
        if (jump == n).all():
            return new[:n]
        on, jump = new, jump[jump]


def cut_runs(df: DataFrame, keys: list[str], order: list[str], inputs: dict[str, Column], link: Link, reach: int, out: str, absorb_single: bool = False, chunk_rows: int = 1 << 16) -> DataFrame:
    """df with ``out``, the number of each row's run in its group, from 0.

    link gets the ``inputs`` of whole groups in order, and must cut after ``reach`` rows at most.  With
    ``absorb_single`` a run of one row counts to the run before it (the first stays).
    """
    cols, chunk_rows = df.columns, max(chunk_rows, reach + 1)
    rows = numbered(df.select(*cols, *(c.alias(f"in_{k}") for k, c in inputs.items())), keys, order)
    #: A row stands in its own chunk, in the one before if links of that reach it, and the last of a chunk leads the next.
    chunk, pos = F.expr(f"rn_ div {chunk_rows}"), F.col("rn_") % chunk_rows
    places = F.array(F.lit(0), F.when((pos < reach + 1) & (chunk > 0), F.lit(-1)), F.when(pos == chunk_rows - 1, F.lit(1)))
    dealt = rows.withColumn("to_", F.explode(F.array_compact(places))).withColumn("chunk_", F.col("to_") + chunk).drop("to_").withColumn("slot_", (F.col("rn_") - F.col("chunk_") * chunk_rows).cast("int"))
    names, wanted = [f"in_{k}" for k in inputs], list(inputs)

    def opened(t: pa.Table):
        """(own, group, first, end, links, opens): the chunk's own rows; each row's group; each group's first own row and
        end; links; what counts as a run if one starts there."""
        slot, new = t["slot_"].to_numpy(), _starts(t)
        start, group = np.flatnonzero(new), np.cumsum(new) - 1
        end = np.append(start[1:], len(slot))
        links = link({k: t[f"in_{k}"].combine_chunks() for k in wanted}, end[group])
        single = (links - np.arange(len(links)) == 1) & ~((slot == 0) & (t["chunk_"].to_numpy() == 0))
        own = (slot >= 0) & (slot < chunk_rows)
        return own, group, start + (slot[start] < 0), end, links, ~single if absorb_single else np.ones(len(links), bool)

    sizes = rows.groupBy(*keys).agg((F.max("rn_") + 1).alias("n_"))
    long = cut_lineage(sizes.filter(F.col("n_") > chunk_rows).select(*keys))
    entries = None
    if not long.isEmpty():
        key_types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

        def maps(batches):
            """For each place a run can enter at: where the chunk is left (a place in the next), and what it opens."""
            for t in _groups(batches, chunk_rows):
                own, _, first, end, links, opens = opened(t)
                for a, b in zip(first.tolist(), end.tolist(), strict=True):
                    size = int(own[a:b].sum())
                    hop = np.append(np.minimum(links[a : a + size] - a, size), size)
                    total, last = np.append(opens[a : a + size].astype(np.int64), 0), np.arange(size + 1)
                    while (hop[:size] < size).any():  # total: what the chain opens before hop; last: where its last run starts
                        inside = hop < size
                        total, last, hop = total + np.where(inside, total[hop], 0), np.where(inside, last[hop], last), hop[hop]
                    many = min(reach, size)
                    if many:
                        take = pa.array(np.full(many, a))
                        columns = [*(t[k].combine_chunks().take(take) for k in keys), t["chunk_"].combine_chunks().take(take), np.arange(many), links[a : a + size][last[:many]] - a - size, total[:many]]
                        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[*keys, "chunk_", "entry_", "exit_", "opens_"])

        wide = dealt.alias("a").join(long.alias("b"), same("a", "b", keys), "left_semi").select(*keys, "chunk_", "slot_", *names)
        steps = wide.repartition(*keys, "chunk_").sortWithinPartitions(*keys, "chunk_", "slot_").mapInArrow(maps, f"{key_types}, chunk_ bigint, entry_ bigint, exit_ bigint, opens_ bigint")
        entries = _entered(cut_lineage(steps), keys)

    def number(batches):
        for t in _groups(batches, chunk_rows):
            own, group, first, end, links, opens = opened(t)
            there = first < end  # else only the last row of the chunk before
            lead = np.minimum(first, t.num_rows - 1)
            entry, base = (t[c].to_numpy()[lead] for c in ("entry_", "base_"))
            at = first + entry
            on = _chain(np.where(links < end[group], links, t.num_rows), at[there & (at < end)])
            opens &= on & own
            running = np.cumsum(opens)
            numbers = running - (running[lead] - opens[lead] - base)[group] - 1
            result = t.select(cols).append_column(out, pa.array(numbers)).take(pa.array(np.flatnonzero(own)))
            yield from result.combine_chunks().to_batches(max_chunksize=20_000)

    if entries is None:
        ready = dealt.withColumn("entry_", F.lit(0).cast("bigint")).withColumn("base_", F.lit(0).cast("bigint"))
    else:
        joined = dealt.alias("a").join(entries.alias("b"), same("a", "b", [*keys, "chunk_"]), "left")
        ready = joined.select(*(F.col(f"a.{c}") for c in dealt.columns), F.coalesce("b.entry_", F.lit(0)).alias("entry_"), F.coalesce("b.base_", F.lit(0)).alias("base_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    done = ready.select(*cols, *names, "chunk_", "slot_", "entry_", "base_").repartition(*keys, "chunk_").sortWithinPartitions(*keys, "chunk_", "slot_")
    return done.mapInArrow(number, f"{schema}, `{out}` bigint")


def _entered(steps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk_, entry_, base_): where each chunk is entered from its group's first row on, and what was opened before.

    steps: (keys, chunk_, entry_, exit_, opens_), a map a chunk.  Every round joins the entries known so far to maps
    that reach twice as many chunks.
    """
    jumps = steps.select(*keys, "chunk_", "entry_", (F.col("chunk_") + 1).alias("to_"), F.col("exit_"), F.col("opens_"))
    known = cut_lineage(steps.filter("chunk_ = 0 and entry_ = 0").select(*keys, "chunk_", "entry_", F.lit(0).cast("bigint").alias("base_")))
    most = steps.agg(F.max("chunk_")).first()[0] or 0
    span = 1
    while span <= most:
        at = lambda x, y, c, e: same(x, y, keys) & (F.col(f"{x}.{c}") == F.col(f"{y}.chunk_")) & (F.col(f"{x}.{e}") == F.col(f"{y}.entry_"))
        moved = known.alias("a").join(jumps.alias("b"), at("a", "b", "chunk_", "entry_")).select(*(F.col(f"a.{k}") for k in keys), F.col("b.to_").alias("chunk_"), F.col("b.exit_").alias("entry_"), (F.col("a.base_") + F.col("b.opens_")).alias("base_"))
        known = cut_lineage(known.unionByName(moved).distinct())
        jumps = cut_lineage(jumps.alias("a").join(jumps.alias("b"), at("a", "b", "to_", "exit_")).select(*(F.col(f"a.{k}") for k in keys), F.col("a.chunk_"), F.col("a.entry_"), F.col("b.to_"), F.col("b.exit_"), (F.col("a.opens_") + F.col("b.opens_")).alias("opens_")))
        span *= 2
    return known


def first_at_least(sums: np.ndarray, wanted: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first row whose running sum is ``wanted`` or more, the group's end if none; sums never fall."""
    return np.minimum(np.searchsorted(sums, wanted, side="left"), ends)


def over_groups(values: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
    """values, which must not fall within a group, moved apart so that they do not fall over all; None if they fall."""
    first = np.concatenate([[True], ends[1:] != ends[:-1]])
    step = np.diff(values, prepend=values[:1])
    step[first] = 0
    if not (step >= 0).all():
        return None
    return np.cumsum(step)

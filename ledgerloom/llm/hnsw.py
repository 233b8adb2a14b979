"""Embedding near-duplicates by hierarchical navigable small-world graphs, one a shard.

Equal vectors are one node with a number of copies.  Nodes are dealt to shards by a hash; each shard gets a
graph, built in one task from a bounded number of vectors and kept as rows, one a node.  Then every two shards meet
once: a task reads one's graph row by row and then the other's nodes, which query it in blocks.
A search walks the layers from the top with a beam; the queries of a block walk together in numpy.  For each
block and shard a sample of the block is audited against all vectors of the shard, and the beam is doubled
until the audit's recall is reached; a query whose whole beam lies above the threshold may have more links
than the beam holds and is answered from all vectors of the shard.  Found pairs are verified by
cosine in double precision.  A task returns link counts and a spanning forest of its links, never all pairs;
the forests are united by connected components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, connected_components

FAR = np.float32(-2)
#: A layer has every THIN-th node of the one below.
THIN = 16
#: Entries of the beams of queries that walk together, and of the similarities that are computed at once.
BEAM_CELLS, SCAN_CELLS = 1 << 17, 1 << 21


class Graph:
    """Layers of neighbour lists over unit vectors; a layer has every ``thin``-th node of the one below."""

    def __init__(self, x: np.ndarray, m: int = 16, beam: int = 48, thin: int = THIN, seed: int = 11):
        self.x, self.m, self.beam = np.ascontiguousarray(x, np.float32), m, beam
        order = np.random.default_rng(seed).permutation(len(x))
        self.layers = [order]
        while len(self.layers[-1]) > 512:
            self.layers.append(self.layers[-1][::thin])
        self.links = [np.full((len(x), 2 * m), -1, np.int32) if j < len(self.layers) - 1 else None for j in range(len(self.layers))]
        for j in reversed(range(len(self.layers) - 1)):
            self._build(j)

    # -- building -----------------------------------------------------------------------------------

    def _build(self, j: int) -> None:
        todo = self.layers[j]
        at = min(256, len(todo))
        self._insert(j, todo[:at], np.zeros(0, np.int64))
        while at < len(todo):
            size = min(1024, at, len(todo) - at)
            self._insert(j, todo[at : at + size], todo[:at])
            at += size

    def _insert(self, j: int, new: np.ndarray, old: np.ndarray) -> None:
        q = self.x[new]
        inner = q @ q.T
        np.fill_diagonal(inner, FAR)
        width = min(self.beam, len(new) - 1)
        near = np.argpartition(-inner, width - 1, axis=1)[:, :width] if 0 < width else np.zeros((len(new), 0), int)
        ids = new[near]
        if len(old):
            found, _ = self._walk(j, q, self._entries(j, q, old), self.beam)
            ids = np.concatenate([found, ids], axis=1)
        chosen = self._select(new, ids, self.m)
        self.links[j][new, : self.m] = chosen
        u, v = np.repeat(new, self.m), chosen.reshape(-1)
        u, v = u[v >= 0], v[v >= 0]
        self._link_back(j, v, u)

    def _entries(self, j: int, q: np.ndarray, old: np.ndarray) -> np.ndarray:
        """Where a walk of layer j starts; while it is built, only at nodes that are in it."""
        top = self.layers[j + 1]
        top = top[np.isin(top, old)] if len(old) < len(self.layers[j]) else top
        top = top if len(top) else old[:64]
        top = top[:2048]
        k = min(4, len(top))
        return top[np.argpartition(-(q @ self.x[top].T), k - 1, axis=1)[:, :k]]

    def _select(self, base: np.ndarray, ids: np.ndarray, m: int) -> np.ndarray:
        """Up to m of each row's candidates: those nearer to the base than to any chosen one first, then
        the nearest of the others."""
        out = np.full((len(base), m), -1, np.int32)
        for low in range(0, len(base), 512):
            b, c = base[low : low + 512], ids[low : low + 512]
            c = np.where(c == b[:, None], -1, c)
            c = _first_only(c)
            s = np.where(c >= 0, np.einsum("nd,nkd->nk", self.x[b], self.x[c]), FAR)
            order = np.argsort(-s, axis=1, kind="stable")[:, : self.beam]
            c, s = np.take_along_axis(c, order, 1), np.take_along_axis(s, order, 1)
            y = self.x[c]
            pair = y @ y.transpose(0, 2, 1)
            closest = np.full(s.shape, FAR)
            kept = np.zeros(s.shape, bool)
            for k in range(s.shape[1]):
                kept[:, k] = (s[:, k] > closest[:, k]) & (s[:, k] > FAR) & (kept.sum(1) < m)
                closest = np.where(kept[:, k, None], np.maximum(closest, pair[:, k]), closest)
            rank = np.argsort(np.where(c < 0, 2, np.where(kept, 0, 1)), axis=1, kind="stable")[:, :m]
            out[low : low + 512, : rank.shape[1]] = np.take_along_axis(c, rank, 1)
        return out

    def _link_back(self, j: int, at: np.ndarray, new: np.ndarray) -> None:
        order = np.argsort(at, kind="stable")
        at, new = at[order], new[order]
        nodes, first, counts = np.unique(at, return_index=True, return_counts=True)
        width = min(int(counts.max(initial=0)), 256)
        more = np.full((len(nodes), width), -1, np.int64)
        place = np.arange(len(at)) - np.repeat(first, counts)
        row = np.repeat(np.arange(len(nodes)), counts)
        fits = place < width
        more[row[fits], place[fits]] = new[fits]
        links = self.links[j]
        for low in range(0, len(nodes), 512):
            n = nodes[low : low + 512]
            links[n] = self._select(n, np.concatenate([links[n].astype(np.int64), more[low : low + 512]], axis=1), 2 * self.m)

    # -- search -------------------------------------------------------------------------------------

    def _walk(self, j: int, q: np.ndarray, entry: np.ndarray, beam: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The beam's ids (-1: none) and similarities of each query after no unvisited member is left."""
        links = self.links[j]
        n = len(q)
        ids = np.full((n, beam), -1, np.int64)
        e = _first_only(entry)[:, :beam]
        ids[:, : e.shape[1]] = e
        sims = np.where(ids >= 0, np.einsum("nd,nkd->nk", q, self.x[ids]), FAR)
        done = ids < 0
        live = np.arange(n)
        while len(live):
            open_s = np.where(done[live], FAR, sims[live])
            pick = np.argpartition(-open_s, min(step, beam) - 1, axis=1)[:, :step]
            ok = np.take_along_axis(open_s, pick, 1) > FAR
            go = ok.any(1)
            live, pick, ok = live[go], pick[go], ok[go]
            if not len(live):
                break
            at = np.where(ok, np.take_along_axis(ids[live], pick, 1), -1)
            flags = done[live]
            np.put_along_axis(flags, pick, True, 1)
            near = np.where(at[:, :, None] >= 0, links[at], -1).reshape(len(live), -1)
            both = np.concatenate([ids[live], near], axis=1)
            both = _first_only(both)
            fresh = both[:, beam:]
            s = np.concatenate([sims[live], np.where(fresh >= 0, np.einsum("nd,nkd->nk", q[live], self.x[fresh]), FAR)], axis=1)
            flags = np.concatenate([flags, fresh < 0], axis=1)
            best = np.argpartition(-s, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live], done[live] = (np.take_along_axis(a, best, 1) for a in (both, s, flags))
        return ids, sims

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The found ids and similarities of each query, by slices of queries whose beams together stay bounded."""
        size = max(16, BEAM_CELLS // beam)
        if len(q) > size:
            parts = [self.search(q[low : low + size], beam) for low in range(0, len(q), size)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        top = self.layers[-1]
        k = min(8 if len(self.layers) > 1 else beam, len(top))
        sims = q @ self.x[top].T
        pick = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        ids = top[pick]
        if len(self.layers) == 1:
            return ids, np.take_along_axis(sims, pick, 1)
        for j in range(len(self.layers) - 2, 0, -1):
            ids, _ = self._walk(j, q, ids, 8)
        return self._walk(0, q, ids, min(beam, len(self.x)))

    # -- the graph as rows, one a node ----------------------------------------------------------------

    def dump(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(vectors, place of each node in the layers' order, how many layers link it, its links in those, lowest first)."""
        rank = np.empty(len(self.x), np.int32)
        rank[self.layers[0]] = np.arange(len(self.x))
        depth = np.zeros(len(self.x), np.int32)
        for layer in self.layers[:-1]:
            depth[layer] += 1
        links = np.empty((int(depth.sum()), 2 * self.m), np.int32)
        first = np.cumsum(depth) - depth
        for j, layer in enumerate(self.layers[:-1]):
            links[first[layer] + j] = self.links[j][layer]
        return self.x, rank, depth, links

    @classmethod
    def load(cls, raw: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], m: int = 16, beam: int = 48) -> Graph:
        g = cls.__new__(cls)
        g.x, rank, depth, links = raw
        g.m, g.beam, g.links = m, beam, []
        order, first = np.argsort(rank, kind="stable"), np.cumsum(depth) - depth
        for j in range(int(depth.max(initial=0))):
            on = np.flatnonzero(depth > j)
            g.links.append(np.full((len(g.x), 2 * m), -1, np.int32))
            g.links[j][on] = links[first[on] + j]
        g.layers = [order[depth[order] >= j] for j in range(len(g.links))]
        g.layers.append(g.layers[-1][::THIN] if g.links else order)
        g.links.append(None)
        return g


def _first_only(ids: np.ndarray) -> np.ndarray:
    """Each row's ids with all but the first of equal ones replaced by -1."""
    order = np.argsort(ids, axis=1, kind="stable")
    s = np.take_along_axis(ids, order, 1)
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = s[:, 1:] == s[:, :-1]
    out = ids.copy()
    flags = np.empty(ids.shape, bool)
    np.put_along_axis(flags, order, again, 1)
    out[flags] = -1
    return out


def planted_recall(g: Graph, least: float, beam: int, audit: int) -> float:
    """The part of ``audit`` queries, each a node turned to a cosine a tenth of the way from ``least`` to 1, that finds its node."""
    nodes = np.unique(np.linspace(0, len(g.x) - 1, audit).astype(int))
    x = g.x[nodes].astype(np.float64)
    turn = np.random.default_rng(11).normal(size=x.shape)
    turn -= (turn * x).sum(1, keepdims=True) * x
    size = np.linalg.norm(turn, axis=1, keepdims=True)
    cos = least + 0.1 * (1 - least)
    q = cos * x + np.sqrt(max(1 - cos * cos, 0.0)) * turn / np.where(size > 1e-9, size, 1)
    ids, _ = g.search(q.astype(np.float32), beam)
    return float((ids == nodes[:, None]).any(1).mean())


def neighbours(g: Graph, q: np.ndarray, least: float, beam: int = 64, audit: int = 256, recall: float = 0.98) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) positions of the pairs with a similarity of ``least`` or more (single precision).

    Audited are ``audit`` queries dealt evenly, and as many of those that the first search finds a link for.  The beam
    doubles until the mean, over the audited queries with links that are not answered from the whole shard, of the
    part found is ``recall``: queries with few links count as much as those with many.  Where no audited query has a
    link, ``audit`` queries with a known one are planted, nodes of the shard turned until their cosine is just above
    ``least``, and the beam doubles until that part of them finds its node.
    """
    n = len(g.x)
    scan = max(1, SCAN_CELLS // max(1, n))
    check, truth = np.unique(np.linspace(0, len(q) - 1, min(audit, len(q))).astype(int)), None
    exact = np.zeros(len(q), bool)
    while True:
        if 4 * beam >= n:
            exact[:] = True
            break
        ids, sims = g.search(q, beam)
        exact = (sims >= least).all(1)
        if truth is None:
            some = np.flatnonzero((sims >= least).any(1) & ~exact)
            check = np.union1d(check, some[np.linspace(0, len(some) - 1, min(audit, len(some))).astype(int)])
            truth = np.concatenate([(q[some] @ g.x.T >= least).sum(1) for some in np.split(check, range(scan, len(check), scan))])
        judged = ~exact[check] & (truth > 0)
        found = (sims[check] >= least).sum(1)
        if (found[judged] / truth[judged]).mean() >= recall if judged.any() else planted_recall(g, least, beam, audit) >= recall:
            break
        beam *= 2
    rows, nodes = [], []
    if not exact.all():
        r, c = np.nonzero((sims >= least) & ~exact[:, None])
        rows.append(r)
        nodes.append(ids[r, c])
    left = np.flatnonzero(exact)
    for low in range(0, len(left), scan):
        r, c = np.nonzero(q[left[low : low + scan]] @ g.x.T >= least)
        rows.append(left[low : low + scan][r])
        nodes.append(c)
    return (np.concatenate(rows), np.concatenate(nodes)) if rows else (np.zeros(0, int), np.zeros(0, int))


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) of the components of the edges (u, v)."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def graph_rows(t: pa.Table) -> pa.Table:
    """(dim, shard, rank, depth, rep, copies, vec, links): the graph over a shard's vectors, a row a node."""
    t = t.combine_chunks()
    _, rank, depth, links = Graph(unit(matrix(t["vec"].chunk(0)))).dump()
    offsets = np.concatenate([[0], np.cumsum(depth * links.shape[1])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(links.reshape(-1)))
    return t.select(["dim", "shard"]).append_column("node", pa.array(np.arange(len(rank), dtype=np.int32))).append_column("rank", pa.array(rank)).append_column("depth", pa.array(depth)).append_column("rep", t["rep"]).append_column("copies", t["copies"]).append_column("vec", t["vec"]).append_column("links", lists)


class Shard:
    """A shard's graph put together from its rows, and the answers to blocks of queries."""

    def __init__(self, parts: list[pa.RecordBatch]):
        column = lambda c: np.concatenate([b.column(c).to_numpy() for b in parts])
        self.reps, self.copies = column("rep"), column("copies")
        self.vecs = np.concatenate([matrix(b.column("vec")) for b in parts])
        links = np.concatenate([b.column("links").flatten().to_numpy() for b in parts]).reshape(-1, 32)
        self.graph = Graph.load((unit(self.vecs), column("rank"), column("depth"), links))

    def links_of(self, q: np.ndarray, threshold: float, beam: int, recall: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) positions of the found pairs with a cosine of ``threshold`` or more in double precision."""
        u, v = neighbours(self.graph, unit(q), threshold - 1e-4, beam, recall=recall)
        good = np.zeros(len(u), bool)
        for low in range(0, len(u), 1 << 16):
            a, c = q[u[low : low + (1 << 16)]].astype(np.float64), self.vecs[v[low : low + (1 << 16)]].astype(np.float64)
            good[low : low + (1 << 16)] = (a * c).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((c * c).sum(1))) >= threshold
        return u[good], v[good]


def pieces(b: pa.RecordBatch, keys: list[str]):
    """(key, rows) of a batch's stretches of rows with one key."""
    at = np.stack([b.column(c).to_numpy() for c in keys])
    cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        if high > low:
            yield tuple(at[:, low].tolist()), b.slice(low, high - low)


def embedding_near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, min_shards: int = 4, shard_rows: int = 1 << 16, block_rows: int = 2048, min_tasks: int = 48, beam: int = 64, recall: float = 0.98) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of ``df``.

    n_links: how many other rows have a cosine of ``threshold`` or more with it; component_id: the smallest
    id reachable over links, its own included; kept: whether that is its own.  Null vectors, zero vectors
    and those with null or non-finite components link with nothing; vectors of different sizes do not
    link.  Repeated ids are rows like others; a null id links, but takes the smallest id of its group
    (null if there is none) and is not kept.  Other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    finite = F.forall("vec", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    length = F.aggregate("vec", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    given = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    kind = "array<float>" if given.schema["vec"].dataType == T.ArrayType(T.FloatType(), given.schema["vec"].dataType.containsNull) else "array<double>"
    rows = given.withColumn("vec", F.col("vec").cast(kind)).withColumn("ok", F.coalesce(finite, F.lit(False)) & F.coalesce(length > 0, F.lit(False)))
    rows = scratch.save(rows)
    reps = rows.filter("ok").groupBy("vec").agg(F.count("*").alias("copies"), F.min("id").alias("label"))
    reps = scratch.save(reps.withColumn("rep", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")))
    #: Each pair of shards meets once, the one with the smaller number as the graph; so many tasks share a shard's queries.
    shards = reps.groupBy("dim").agg(F.greatest(F.lit(min_shards), F.ceil(F.count("*") / shard_rows)).cast("bigint").alias("shards"))
    shards = shards.withColumn("pairs", F.expr("shards * (shards + 1) div 2")).withColumn("subs", F.ceil(F.lit(min_tasks) / F.col("pairs")).cast("bigint"))
    shards = F.broadcast(scratch.save(shards))  # else all vectors of a length go to one task
    made, tasks = (n or 1 for n in shards.agg(F.sum("shards"), F.sum(F.col("pairs") * F.col("subs"))).first())
    dealt = reps.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("shards")))
    graphs = dealt.select("dim", "shard", "rep", "copies", "vec").repartition(min(2 * made, 10_000), "dim", "shard").groupBy("dim", "shard").applyInArrow(graph_rows, f"dim int, shard bigint, node int, rank int, depth int, rep bigint, copies bigint, vec {kind}, links array<int>")
    graphs = scratch.save(graphs)
    each = lambda low, high: F.explode(F.sequence(low, high - 1))
    nodes = graphs.join(shards, "dim").withColumn("home", each(F.col("shard"), F.col("shards"))).withColumn("sub", each(F.lit(0).cast("bigint"), F.col("subs")))
    asked = dealt.withColumn("home", F.col("shard")).withColumn("sub", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("subs"))).withColumn("shard", each(F.lit(0).cast("bigint"), F.col("home") + 1))
    meet, none = ["dim", "shard", "home", "sub"], F.lit(None)
    nodes = nodes.select(*meet, F.lit(0).alias("asks"), "node", "rank", "depth", "rep", "copies", "vec", "links")
    asked = asked.select(*meet, F.lit(1).alias("asks"), none.cast("int").alias("node"), none.cast("int").alias("rank"), none.cast("int").alias("depth"), "rep", "copies", "vec", none.cast("array<int>").alias("links"))
    #: A task reads the nodes of its shard and then the queries, row by row: no row is larger than a node.
    tables = nodes.unionByName(asked).repartition(min(2 * tasks, 10_000), *meet).sortWithinPartitions(*meet, "asks", "node")

    def answers(shard: Shard, queries: list[pa.RecordBatch], key: tuple) -> pa.RecordBatch:
        q_reps, q_copies = (np.concatenate([b.column(c).to_numpy() for b in queries]) for c in ("rep", "copies"))
        u, v = shard.links_of(np.concatenate([matrix(b.column("vec")) for b in queries]), threshold, beam, recall)
        other = q_reps[u] != shard.reps[v]
        u, v = u[other], v[other]
        n = np.bincount(u, weights=shard.copies[v], minlength=len(q_reps)).astype(np.int64)
        has = np.flatnonzero(n)
        ids, counts = [q_reps[has]], [n[has]]
        if key[1] != key[2]:  # the other side of the pair asks nowhere else
            back, at = np.unique(v, return_inverse=True)
            ids.append(shard.reps[back])
            counts.append(np.bincount(at, weights=q_copies[u], minlength=len(back)).astype(np.int64))
        a, c = forest(q_reps[u], shard.reps[v])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*ids, a])), pa.array(np.concatenate([*counts, np.zeros(len(a), np.int64)])), pa.array(np.concatenate([*ids, c]))], names=["u", "n", "v"])

    def ask(batches):
        key, shard, parts, waiting = None, None, [], []
        for b in batches:
            for (*at, asks), rows_ in pieces(b, [*meet, "asks"]):
                if at != key:
                    if waiting:
                        yield answers(shard, waiting, key)
                    key, shard, parts, waiting = at, None, [], []
                if not asks:
                    parts.append(rows_)
                    continue
                if shard is None and not parts:
                    continue  # no vector was dealt to that shard
                if shard is None:
                    shard, parts = Shard(parts), []
                while rows_.num_rows:
                    waiting.append(rows_.slice(0, block_rows - sum(w.num_rows for w in waiting)))
                    rows_ = rows_.slice(waiting[-1].num_rows)
                    if sum(w.num_rows for w in waiting) == block_rows:
                        yield answers(shard, waiting, key)
                        waiting = []
        if waiting:
            yield answers(shard, waiting, key)

    found = scratch.save(tables.mapInArrow(ask, "u bigint, n bigint, v bigint"))
    comps = connected_components(found.filter("u <> v").select("u", "v"), scratch)
    links = found.filter("u = v").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    full = reps.join(comps, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "rep")).join(links, "rep", "left")
    lowest = full.groupBy("comp").agg(F.min("label").alias("component_id"))
    full = full.join(lowest, "comp").select("vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = rows.filter("ok").join(full, "vec").select("id", "n_links", "component_id")
    alone = rows.filter("not ok").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", F.col("component_id").cast("bigint").alias("component_id"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))

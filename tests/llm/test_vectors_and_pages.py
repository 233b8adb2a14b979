"""Vector operators against brute force; WARC records; the pipeline."""

import gzip

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from ledgerloom.llm import hnsw, topk, warc


SF = "/root/testdata/sf0.001"


def vectors(spark, x, extra=()):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1)).withColumn("id", F.lit("clash"))


ODD = [(1001, None), (1002, [0.0] * 16), (1003, [float("nan")] + [1.0] * 15), (1004, []), (1005, [1.0, 2.0]), (1006, [float("inf")] * 16)]


def clusters(seed, n, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 10, dims))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dims)) * 0.18
    x[: n // 4] = x[0]  # a hot vector
    return np.round(x, 3).astype(np.float32)


@pytest.mark.parametrize("seed", [1, 2])
def test_links_against_all_pairs(spark, seed):
    x = clusters(seed, 1500)
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    link = y @ y.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    while True:
        new = np.where(link, label[None], len(x)).min(1, initial=len(x))
        new = np.minimum(new, label)
        if (new == label).all():
            break
        label = new
    got = hnsw.embedding_near_duplicates(vectors(spark, x, ODD), min_shards=2, block_rows=300).orderBy("vec_id").toPandas()
    odd = spark.createDataFrame(ODD, "vec_id bigint, embedding array<float>")
    own = hnsw.embedding_near_duplicates(vectors(spark, x), min_shards=2, block_rows=300).orderBy("vec_id").toPandas()
    assert own.n_links.sum() >= 0.97 * link.sum() and (own.n_links.to_numpy() <= link.sum(1)).all()
    assert (own.component_id.to_numpy() == label).mean() > 0.99 and (own.kept == (own.vec_id == own.component_id)).all()
    alone = hnsw.embedding_near_duplicates(odd).toPandas()
    assert alone.n_links.sum() == 0 and alone.kept.all() and len(alone) == len(ODD)
    assert len(got) == len(x) + len(ODD)


def test_graph_search_recall():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph.load(hnsw.Graph(x).dump())
    assert len(g.layers) > 1
    q = x[:200] + 0.05 * rng.normal(size=(200, 24)).astype(np.float32)
    ids, _ = g.search(q, 64)
    best = (q @ x.T).argmax(1)
    assert np.mean([b in row for b, row in zip(best, ids, strict=True)]) > 0.95


def test_wide_beams_walk_in_slices(monkeypatch):
    """Beams that had to double many times are held for some queries at a time, not for a whole block."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 8)).astype(np.float32)
    g, walked, walk = hnsw.Graph(x / np.linalg.norm(x, axis=1, keepdims=True)), [], hnsw.Graph._walk
    monkeypatch.setattr(hnsw.Graph, "_walk", lambda self, j, q, entry, beam, step=4: walked.append(len(q) * beam) or walk(self, j, q, entry, beam, step))
    ids, sims = g.search(g.x[:1500], 512)
    assert max(walked) <= 1 << 18 and ids.shape == sims.shape == (1500, 512)
    assert (ids == np.arange(1500)[:, None]).any(1).mean() > 0.98


def test_graphs_travel_a_row_a_node():
    """No row holds a shard: its graph is put together from rows, in pieces of any size."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1200, 8)).astype(np.float32)
    ids = np.arange(1200)
    t = pa.table({"dim": pa.array(ids * 0 + 8, pa.int32()), "shard": ids * 0, "rep": ids + 7, "copies": ids * 0 + 1, "vec": pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), 8).cast(pa.list_(pa.float32()))})
    rows = hnsw.graph_rows(t)
    assert rows.num_rows == 1200 and max(len(r) for r in rows["links"].to_pylist()) <= 64
    shard, whole = hnsw.Shard(rows.to_batches(max_chunksize=500)), hnsw.Graph(hnsw.unit(x))
    assert [len(a) for a in shard.graph.layers] == [len(a) for a in whole.layers] and (shard.reps == ids + 7).all()
    assert all((a == b).all() for a, b in zip(shard.graph.search(whole.x[:50], 64), whole.search(whole.x[:50], 64), strict=True))


def test_empty_vectors(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert hnsw.embedding_near_duplicates(none).count() == 0 and topk.exact_top_k(none).count() == 0


def brute_top(rows, k=5):
    v = [(i, np.floor(256.0 * np.array(e, np.float64)).astype(np.int64)) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    width = max(len(e) for _, e in v)
    m = np.zeros((len(v), width), np.int64)
    for j, (_, e) in enumerate(v):
        m[j, : len(e)] = e
    out = []
    for j, (i, _) in enumerate(v):
        if i % 50 == 0:
            s = m @ m[j]
            order = sorted((c for c in range(len(v)) if c != j), key=lambda c: (-s[c], v[c][0]))[:k]
            out += [(i, r + 1, v[c][0], int(s[c])) for r, c in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("seed", [3, 4])
def test_top_k_against_all_pairs(spark, seed):
    x = clusters(seed, 900)
    df = vectors(spark, x, [*ODD, (950, [0.5] * 16), (950, [0.5] * 16), (None, [1.0] * 16)])
    got = sorted(map(tuple, topk.exact_top_k(df, pivots=8, ring_width=32.0, slice_rows=64, query_rows=5).collect()))
    assert got == brute_top([(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_top_k_with_few_rows(spark):
    df = vectors(spark, np.eye(3, 16))
    got = sorted(map(tuple, topk.exact_top_k(df).collect()))
    assert got == [(0, 1, 1, 0), (0, 2, 2, 0)]


def test_rings_are_skipped(spark):
    """The bound leaves most slices unread when the vectors form groups."""
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(20, 16)) * 4, 100, axis=0) + rng.normal(size=(2000, 16)) * 0.01
    df = vectors(spark, x)
    read = {}
    assert sorted(map(tuple, topk.exact_top_k(df, read=read).collect())) == brute_top([(r["vec_id"], r["embedding"]) for r in df.collect()])
    assert read["scanned"] < 0.3 * read["all"]


def test_top_k_of_empty_vectors(spark):
    """An empty vector takes part as query and as candidate, with the score 0 to all."""
    df = spark.createDataFrame([(0, []), (1, [1.0, 2.0]), (50, [-1.0, 0.0]), (51, None)], "vec_id bigint, embedding array<float>")
    assert sorted(map(tuple, topk.exact_top_k(df).collect())) == [(0, 1, 1, 0), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 1, -65536)]
    none = topk.exact_top_k(df.filter("vec_id = 0").union(df.filter("vec_id = 0")))
    assert sorted(map(tuple, none.collect())) == [(0, 1, 0, 0), (0, 1, 0, 0)]


def test_warc_records(spark, tmp_path):
    html = "<html><title> A  b </title><script>x<y</script><p>One &amp; two</p><p>three<br>four</p></html>"
    df = spark.createDataFrame([(1, "http://a/", html), (2, None, None), (1, "http://a/", html)], "page_id bigint, url string, html string").withColumn("block", F.lit("clash"))
    rows = warc.derivatives(df).collect()
    meta, text = ([r for r in rows if r["record_type"] == k] for k in ("metadata", "conversion"))
    assert len(meta) == len(text) == 3
    one = next(r for r in text if r["page_id"] == 1)
    assert one["block"] == "A b\nOne & two\nthree\nfour" and one["content_length"] == len(one["block"])
    assert {r["refers_to"] for r in rows if r["page_id"] == 1} == {one["refers_to"]} and one["record_id"].startswith("<urn:uuid:")
    assert len({r["record_id"] for r in rows}) == 4
    assert next(r for r in text if r["page_id"] == 2)["block"] == ""
    warc.write_warc(warc.derivatives(df), str(tmp_path / "w"))
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz"))
    assert whole.count(b"WARC/1.1\r\n") == 6 and whole.count(b"WARC-Refers-To: <urn:uuid:") == 6
    assert warc.derivatives(df.limit(0)).count() == 0


def test_pipeline_stages(spark, edge):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert sorted(out.columns) == sorted(docs.columns), name
            docs = spark.createDataFrame(out.toPandas(), docs.schema)
            counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    assert sorted(map(tuple, out.collect())) and out.select("doc_id").distinct().count() == counts[-1]
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == counts[-1]
    plain = edge.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, plain, SF).count() > 0


def test_audit_counts_queries_with_few_links():
    """A hot cluster, answered exactly, does not hide that a narrow beam misses the links of the others."""
    hot, rare = np.eye(32, dtype=np.float32)[[0] * 1000], np.eye(32, dtype=np.float32)[[1, 2, 3, 4, 5] * 2]

    class Narrow:
        x = np.concatenate([hot, rare])

        def search(self, q, beam):
            sims = q @ self.x.T
            if beam < 128:
                sims[:, len(hot):] = -1
            ids = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            return ids, np.take_along_axis(sims, ids, 1)

    u, v = hnsw.neighbours(Narrow(), np.concatenate([hot[:100], rare[:5]]), 0.95)
    assert (v >= len(hot)).sum() == 10 and (v < len(hot)).sum() == 100 * len(hot)

"""Whitening against numpy's eigenvectors, spelling variants and repeated bytes against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import queries, repeats, spelling, toxicity, whitening
from ledgerloom.llm.common import Scratch

SF = "/root/testdata/sf0.001"

# Whitening


def brute_whitening(vectors, k=16):
    x = np.floor(64 * np.array(vectors, np.float64)) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    centred = fit - total / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, total, strict=True)) for r in x]
    return n, deviation, (x - total / n) @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def held_against(rows, ids, vectors, k=16, most_error=1e-9):
    n, deviation, white, explained = brute_whitening(vectors, k)
    got = defaultdict(dict)
    for r in rows:
        got[r["vec_id"]][r["component"]] = r
    assert len(rows) == len(ids) * white.shape[1]
    for i, key in enumerate(ids):
        mine = got[key]
        assert sorted(mine) == list(range(1, white.shape[1] + 1))
        assert {(r["n"], r["deviation"]) for r in mine.values()} == {(n, deviation[i])}
    ours = np.array([[got[key][c + 1]["whitened"] for c in range(white.shape[1])] for key in ids])
    signs = np.sign((ours * white).sum(0))
    assert np.abs(ours - signs * white).max() < 1e-6
    assert np.allclose([got[ids[0]][c + 1]["explained"] for c in range(white.shape[1])], explained, rtol=1e-9)
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < most_error


def test_whitening_query(spark):
    given = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = queries.op11_embedding_whitening(spark, SF).collect()
    held_against(rows, [r["vec_id"] for r in given], [r["embedding"] for r in given])


def test_whitening_of_uneven_variances(spark):
    """Eigenvalues over nine orders of magnitude, copies that must not count, and a large common offset."""
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(300, 6)) * [1e4, 1e3, 300, 20, 1, 0.3]) @ np.linalg.qr(rng.normal(size=(6, 6)))[0] + 1e6
    x = np.concatenate([x, np.repeat(x[:1], 200, axis=0)])
    df = spark.createDataFrame([(i, r.tolist(), "c") for i, r in enumerate(x)], "vec_id bigint, embedding array<double>, component string").repartition(5)
    held_against(whitening.whitened(df).collect(), list(range(len(x))), x, most_error=1e-6)


def test_whitening_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0]), (2, [3.0, -1.0]), (None, [0.5, 0.25]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (1, [1.0, 2.0]), (8, [2.0]), (9, [])]
    schema = "vec_id bigint, embedding array<float>"
    got = whitening.whitened(spark.createDataFrame(rows, schema)).collect()
    # shorter vectors are filled up with zeros
    n, deviation, white, _ = brute_whitening([[1, 2], [3, -1], [0.5, 0.25], [1, 2], [2, 0], [0, 0]], 2)
    assert len(got) == 12 and {r["n"] for r in got} == {n} == {5}
    assert {(r["vec_id"], r["deviation"]) for r in got} == set(zip([1, 2, None, 1, 8, 9], deviation, strict=True))
    assert abs(next(r for r in got if r["vec_id"] == 2 and r["component"] == 1)["whitened"]) == pytest.approx(abs(white[1, 0]), abs=1e-9)
    assert whitening.whitened(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, [1.0]), (2, [1.0]), (3, None)], schema)).collect() == []
    # no variance in one direction: no component there; entries that need over 64 bits: no deviation, no failure
    flat = whitening.whitened(spark.createDataFrame([(i, [float(i), 7.0, 2.0 * i]) for i in range(9)], schema)).collect()
    assert {r["component"] for r in flat} == {1} and flat[0]["explained"] == pytest.approx(1)
    huge = whitening.whitened(spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])], schema)).collect()
    assert len(huge) == 3 and any(r["deviation"] is None for r in huge)


def test_cholesky_and_jacobi():
    rng = np.random.default_rng(2)
    for d, rank in ((1, 1), (5, 3), (24, 24), (33, 20)):
        b = rng.normal(size=(d, rank)) * np.logspace(0, -5, rank)
        a = b @ b.T
        low = whitening.pivoted_cholesky(a)
        assert low.shape[1] <= d and np.abs(low @ low.T - a).max() < 1e-13 * max(1, np.abs(a).max())
        values, vectors = whitening.one_sided_jacobi(low)
        assert np.allclose(values[:rank], np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-5)
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-10
        assert np.abs(a @ vectors[:, :3] - vectors[:, :3] * values[:3]).max() < 1e-12
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)
    assert len(whitening.one_sided_jacobi(np.zeros((3, 0)))[0]) == 0


# Spelling variants


def brute_spelling(rows, mod=97, least_length=5, least_count=3):
    total = Counter()
    for key, text in rows:
        word = ""
        for ch in (text or "") + " ":
            if "A" <= ch <= "Z" or "a" <= ch <= "z" or "À" <= ch <= "ÿ":
                word += chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
            elif word:
                h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
                if h % mod == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                total[word] += 1
                word = ""
    n = {w: c for w, c in total.items() if len(w) >= least_length and c >= least_count}
    near, gapped = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w) if len(w) < 1000 else 0):  # a longer word is alone in these tests
            gapped[w[:i], w[i + 1 :]].add(w)
            less = w[:i] + w[i + 1 :]
            if less in n:
                near[w].add(less)
                near[less].add(w)
    for group in gapped.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def as_found(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_spelling_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute_spelling(rows)
    assert as_found(queries.op12_spelling_variants(spark, SF)) == want and len(want) > 1000 and any(f[0] for f in want.values())


def test_spelling_of_random_words(spark):
    """A small alphabet makes many near words, chains and ties; a small mod cuts many; long words cross the limit of halves."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abÀÿé×") for _ in range(rng.choice([5, 5, 6, 7, 8]))) for _ in range(400)]
    base = "".join(rng.choice("abcé") for _ in range(66))
    words += [base[:k] for k in range(60, 67)] + [base[:20] + "z" + base[20:k] for k in range(61, 66)] + [base[:k] + "q" + base[k + 1 :] for k in (0, 31, 32, 33, 65)]
    words += ["a" * k for k in range(60, 70)]
    rows = [(i if i % 9 else None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 80)))) for i in range(150)] + [(7, " ".join(words * 3))] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for mod in (97, 3):
        want = brute_spelling(rows, mod=mod)
        assert as_found(spelling.spelling_groups(df, mod=mod)) == want
        assert len({f[1] for f in want.values()}) < len(want)


def test_spelling_does_not_need_its_bitmap(spark):
    """A bitmap that the vocabulary outgrows, and so lets all through, finds the same pairs."""
    rng = random.Random(6)
    words = list({"".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)})
    df = spark.createDataFrame([(w, i + 3) for i, w in enumerate(words)], "word string, n bigint")
    pairs = [{(r["word"], r["near"]) for r in spelling.near_words(df, Scratch(spark), bits=bits).collect()} for bits in (15, 27)]
    assert pairs[0] == pairs[1] and len(pairs[0]) > 100


def test_spelling_sends_no_table_to_the_driver(spark):
    """However small its files are: neighbourhoods have many times the rows of the words they are sized by."""
    words = spark.createDataFrame([("abcde", 5), ("abcd", 3), ("x" * 70, 3)], "word string, n bigint")
    df = spark.createDataFrame([(1, "abcde abcde abcdf " * 3)], "doc_id bigint, text string")
    for found in (spelling.near_words(words, Scratch(spark)), spelling.spelling_groups(df)):
        found.collect()
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_spelling_edges(spark, edge, empty):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert as_found(spelling.spelling_groups(edge, least_count=1)) == brute_spelling(rows, least_count=1)
    assert spelling.spelling_groups(empty).collect() == []
    chain = [(i, " ".join(["abcdefgh"[: 8 - k] + "x" * k] * 3 * 2 ** (7 - k))) for i, k in enumerate(range(4))]
    got = as_found(spelling.spelling_groups(spark.createDataFrame(chain, "doc_id bigint, text string"), mod=1 << 40))
    assert got["abcdexxx"][:2] == ("abcdefxx", "abcdefgh") and got["abcdefxx"][:2] == ("abcdefgx", "abcdefgh") and got["abcdefgh"][:2] == (None, "abcdefgh")


def test_neighbourhood_is_whole():
    """Every reduced word one edit away has its key there."""
    words = [b"abcde", b"zzzzz", "éa×ÿb".encode("latin-1")]
    for word, keys in zip(words, spelling.neighbourhood(words), strict=True):
        edits = {word} | {word[:i] + word[i + 1 :] for i in range(5)}
        for ch in range(97, 123):
            edits |= {word[:i] + bytes([ch]) + word[i + 1 :] for i in range(5)} | {word[:i] + bytes([ch]) + word[i:] for i in range(6)}
        assert {int(spelling.reduced_keys([e])[0]) for e in edits} <= set(keys.tolist())
    assert len(set(spelling.REDUCED.tolist())) == spelling.SYMBOLS


# Repeated bytes


def brute_repeats(texts, width):
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize(("width", "bucket_rows"), [(5, 3), (8, 4), (8, 4096), (20, 3), (40, 5), (120, 6)])
def test_repeats_by_brute_force(spark, width, bucket_rows):
    """Passages cut, joined and repeated; buckets larger than a task takes, so that halving is used too."""
    rng = random.Random(width)
    passages = ["".join(rng.choice("abé") for _ in range(rng.randint(3, 3 * width))) for _ in range(8)]
    piece = lambda: rng.choice(passages)[rng.randint(0, 3) :] if rng.random() < 0.6 else "".join(rng.choice("abcde\0é") for _ in range(rng.randint(0, 30)))
    texts = ["".join(piece() for _ in range(rng.randint(0, 5))) for _ in range(120)] + ["", None, "a" * 300, "ab" * 200]
    texts += texts[5:7] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.remove_repeats(df, width=width, bucket_rows=bucket_rows, block_bytes=500, run_rows=20).collect()}
    want = brute_repeats([(t or "").encode() for t in texts], width)
    assert [got[i] for i in range(len(texts))] == want and any(w[2] > 1 for w in want)


def test_repeats_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_suffix_dedup(spark, SF).collect()}
    want = brute_repeats([(r["text"] or "").encode() for r in rows], 400)
    assert [got[r["doc_id"]] for r in rows] == want and sum(w[1] for w in want) > 0


def test_repeats_of_a_planted_passage(spark):
    """A passage of just the width goes from all texts, one byte less stays, wherever it stands."""
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    just, less = letters(400), letters(399)
    texts = [letters(rng.randint(0, 900)) + (just if i % 2 else "A" + less + "B") + letters(rng.randint(0, 900)) for i in range(60)]
    texts = [t if i % 2 else t.replace("A" + less, chr(65 + i % 26) + less, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.remove_repeats(df, bucket_rows=10).collect()}
    assert [got[i] for i in range(60)] == brute_repeats([t.encode() for t in texts], 400)
    assert all(got[i][1] >= 400 for i in range(1, 60, 2))


def test_repeats_edges(spark, edge, empty):
    rows = edge.collect()
    got = repeats.remove_repeats(edge, width=40).collect()
    want = brute_repeats([(r["text"] or "").encode() for r in rows], 40)
    assert sorted(map(repr, got)) == sorted(repr(type(got[0])(doc_id=r["doc_id"], n_bytes=w[0], n_removed=w[1], n_spans=w[2], kept_sha256=w[3])) for r, w in zip(rows, want, strict=True))
    assert repeats.remove_repeats(empty).collect() == []
    with pytest.raises(ValueError, match="width"):
        repeats.remove_repeats(edge, width=4)


def test_covers():
    for v, d in repeats.COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v)) and len(d) * (len(d) - 1) == v - 1 or v == 3
    assert repeats.modulus(400) == 183 and repeats.modulus(5) == 3


# Toxicity: the sample's bound


def test_repeated_ids_do_not_grow_the_sample(spark, monkeypatch):
    """One labelled id in very many rows is one row of the fit."""
    docs = spark.createDataFrame([(i, f"plain words number {i}") for i in range(200)], "doc_id bigint, text string")
    more = spark.range(50_000).select(F.lit(3).cast("bigint").alias("doc_id"), F.concat(F.lit("awful thing "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, toxic int")
    sizes, fit = [], toxicity.FactorizationMachine.fit

    def counted(self, flat, rows, y, **how):
        sizes.append(len(rows))
        return fit(self, flat, rows, y, **how)

    monkeypatch.setattr(toxicity.FactorizationMachine, "fit", counted)
    toxicity.train(docs.unionByName(more), labels)
    toxicity.train(docs.unionByName(more), labels, max_train=20)
    assert sizes[0] <= 200 and sizes[1] <= 20

"""Operators on documents against brute force, round trips and held-out rows."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import common, langid, mixing, packing, ppm, queries, simhash, tokencounts, toxicity

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"


def docs(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def duck(sql, sf=SF):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return [dict(zip(names, r, strict=True)) for r in got.fetchall()]


def same(df, rows):
    cols = sorted(df.columns)
    key = lambda r: repr([round(r[c], 6) if isinstance(r[c], float) else r[c] for c in cols])
    assert sorted(map(key, df.collect())) == sorted(map(key, rows))


@pytest.fixture(scope="module")
def bpe():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    same(queries.queries()[name](spark, SF), duck(queries.oracle_sql()[name]))


# -- mixing ------------------------------------------------------------------------------------------


def test_budgets(spark):
    rows = [("a", "x", 100), ("a", "y", 10), ("b", "x", 1000), ("b", "z", 1000)]
    leaves = spark.createDataFrame(rows, "d string, s string, supply bigint")
    got = {(r["d"], r["s"]): r["budget"] for r in mixing.leaf_budgets(leaves, ["d", "s"], F.lit(600), {"d": {"a": 1.0, "b": 1.0}}).collect()}
    # a can give 110 of its 300; the rest goes to b, whose sources share it.
    assert got == {("a", "x"): 100, ("a", "y"): 10, ("b", "x"): 245, ("b", "z"): 245}
    got = {(r["d"], r["s"]): r["budget"] for r in mixing.leaf_budgets(leaves, ["d", "s"], F.lit(180), {}).collect()}
    # y lacks tokens: its sibling x takes them before the other domain does.
    assert got == {("a", "x"): 80, ("a", "y"): 10, ("b", "x"): 45, ("b", "z"): 45}
    got = {(r["d"], r["s"]): r["budget"] for r in mixing.leaf_budgets(leaves, ["d", "s"], F.lit(10_000), {"d": {"b": 0.0}}).collect()}
    assert got == {("a", "x"): 100, ("a", "y"): 10}


@pytest.mark.parametrize("slice_rows", [1, 7, 4096])
def test_mix_takes_the_budget(spark, slice_rows):
    d = docs(spark).select("doc_id", "lang", "source", mixing.word_tokens("text").alias("n_tokens"))
    got = mixing.mix(d, ["lang", "source"], {}, 0.6, 2, 5, slice_rows=slice_rows)
    total = d.agg(F.sum("n_tokens")).first()[0]
    taken = got.agg(F.sum("taken_tokens")).first()[0]
    assert abs(taken - math.floor(total * 0.6)) <= d.select("lang", "source").distinct().count()
    assert got.groupBy("doc_id", "epoch").count().filter("count > 1").count() == 0
    if slice_rows == 1:
        pytest.other = sorted(map(tuple, got.collect()))
    elif hasattr(pytest, "other"):
        assert sorted(map(tuple, got.collect())) == pytest.other


def test_mix_edges(spark, edge, empty):
    d = edge.drop("n_tokens", "domain").withColumn("n_tokens", mixing.word_tokens("text"))
    got = mixing.mix(d, ["lang", "source"], {}, 1.0).collect()
    assert sum(r["taken_tokens"] for r in got) == d.agg(F.sum("n_tokens")).first()[0] and {r["lang"] for r in got} >= {mixing.NONE, "xx"}
    assert mixing.mix(empty.withColumn("n_tokens", F.lit(1)), ["lang"], {}, 0.5).count() == 0
    kept = mixing.mix_documents(edge.drop("domain"), ["domain", "lang"], {}, 1.0, level_cols={"domain": mixing.domain_of_source()})
    assert kept.columns == ["doc_id", *[c for c in edge.drop("domain").columns if c != "doc_id"]] and kept.filter("doc_id = 1").count() == 2


# -- near-duplicates ----------------------------------------------------------------------------------


def brute_fingerprint(text, n=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, links):
    of = {i: i for i in ids}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        of[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints_and_components(spark):
    rows = [(r["doc_id"], r["text"]) for r in docs(spark, SF2).collect()]
    base = " ".join(f"w{i}" for i in range(400))
    rows += [(100_000 + i, base.replace(f" w{i} ", " changed ", 1)) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    fp = {i: brute_fingerprint(t) for i, t in rows}
    ids = sorted(fp)
    expected = components(ids, [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 4])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(df).collect()}
    assert got == {i: (f"{fp[i]:016x}", expected[i]) for i in ids}


def test_simhash_edges(spark, edge, empty):
    got = simhash.simhash_components(edge).collect()
    assert len(got) == edge.count()
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert {(r["fingerprint"], r["component_id"]) for r in got if r["doc_id"] in (3, 4)} == {("0" * 16, 3)}
    assert simhash.simhash_components(empty).count() == 0
    kept = simhash.simhash_keep_one(edge)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 3, 5, 6, 7, 8] and kept.filter("doc_id is null").count() == 1
    assert kept.columns == edge.columns and simhash.simhash_keep_one(empty).count() == 0


def test_keep_one_finds_similar_shingles(spark):
    import random

    rng = random.Random(3)
    rows, want = [], {}
    for g in range(60):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(200)]
        rows.append((g * 10, " ".join(base)))
        for k in range(1, 4):
            near = list(base)
            for p in rng.sample(range(200), rng.choice([1, 2, 3])):
                near[p] = f"x{rng.randrange(10**6)}"
            rows.append((g * 10 + k, " ".join(near)))
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = components(sorted(sets), links)
    got = dict(map(tuple, simhash.simhash_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()))
    wrong = sum(got[i] != want[i] for i in want)
    assert wrong <= 0.02 * len(want)
    assert all(want[i] == want[got[i]] for i in got)  # no false link


def test_near_copies_below_the_threshold_are_not_all_compared(spark, monkeypatch):
    """Variants of one text that are near in bits but not in shingles, without shingles of their own: few meet, no link is lost."""
    import random

    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(160)]
    rows = []
    for i in range(400):
        near = list(base)
        for p in rng.sample(range(2, 160, 4), 1 if i < 5 else 7):
            near[p] = f"x{p}{rng.randrange(40)}"
        rows.append((i, " ".join(near)))
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    compared, verify = [], simhash.shingle_jaccard

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(simhash, "shingle_jaccard", counted)
    got = dict(map(tuple, simhash.simhash_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()))
    assert got == components(sorted(sets), links)
    assert compared[-1] <= 4 * len(rows)


def test_near_duplicates_hold_little_disk(spark, monkeypatch):
    """Shuffle files go with the query that made them, and the rows of the second look at the keys are dealt once."""
    rows = [(i, " ".join(f"w{i % 50}x{j}" for j in range(60 + i // 50))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    plans, overlap = [], simhash.shingle_overlap

    def seen(texts, *rest):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plans.append(texts.select("*")._jdf.queryExecution().executedPlan().toString())
        spark.conf.unset("spark.sql.adaptive.enabled")
        return overlap(texts, *rest)

    monkeypatch.setattr(simhash, "shingle_overlap", seen)
    shuffles = spark._jsc.sc().env().blockManager().diskBlockManager()
    held = lambda: {f.name() for b in [shuffles.getAllBlocks()] for f in (b.apply(i) for i in range(b.size())) if f.name().startswith("shuffle_")}
    before = held()
    found = simhash.simhash_near_duplicates(df)
    assert not held() - before
    assert plans[0].count("Generate explode") == 1
    assert {r["component_id"] for r in found.collect()} == set(range(50))


@pytest.mark.parametrize("kind", ["appended", "cut off", "replaced", "inserted", "scattered"])
def test_near_copies_just_above_the_threshold_meet(spark, kind):
    """Pairs at a similarity of 0.80 to 0.85, whatever the kind of edit; texts of 60 to 1,500 words."""
    import random

    rng = random.Random(kind)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows, pairs = [], 0
    while pairs < 150:
        n = rng.choice([60, 150, 400, 1500])
        a = [word() for _ in range(n)]
        k = {"appended": 0.22, "cut off": 0.18, "replaced": 0.1, "inserted": 0.22, "scattered": 0.021}[kind] * n * rng.uniform(0.75, 1)
        at, k = rng.randrange(int(n * 0.7)), max(1, int(k))
        b = {"appended": [*a, *(word() for _ in range(k))], "cut off": a[: n - k], "replaced": [*a[:at], *(word() for _ in range(k)), *a[at + k :]], "inserted": [*a[:at], *(word() for _ in range(k)), *a[at:]], "scattered": list(a)}[kind]
        if kind == "scattered":
            for i in rng.sample(range(n), k):
                b[i] = word()
        x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        if 0.8 <= len(x & y) / len(x | y) <= 0.85:
            rows += [(2 * pairs, " ".join(a)), (2 * pairs + 1, " ".join(b))]
            pairs += 1
    got = dict(map(tuple, simhash.simhash_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()))
    found = sum(got[2 * i + 1] == 2 * i for i in range(pairs)) / pairs
    print(kind, found)
    assert found >= (0.9 if kind == "scattered" else 0.97)


# -- tokens --------------------------------------------------------------------------------------------


def test_section_tokens(spark, bpe):
    rows = docs(spark).limit(60)
    got = tokencounts.section_tokens(rows, tokencounts.head_body_tail("text"), rule="start").collect()
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    counts = Counter()
    for r in got:
        counts[r["doc_id"]] += r["n_tokens"]
        text = texts[r["doc_id"]]
        offsets = bpe.encode(text, add_special_tokens=False).offsets
        assert r["doc_tokens"] == len(offsets)
        if r["section"] != tokencounts.UNASSIGNED and text.isascii():
            assert r["n_tokens"] == sum(r["start"] <= a < r["end"] for a, _ in offsets)
    assert all(counts[r["doc_id"]] == r["doc_tokens"] for r in got)


@pytest.mark.parametrize(("rule", "expected"), [("majority", [1, 1, 0]), ("start", [2, 0, 0]), ("split", [1.25, 0.75, 0])])
def test_crossing_rule(rule, expected):
    counts, crossing = tokencounts.attribute(np.array([3, 7]), [(0, 4), (4, 7)], rule)
    assert counts.tolist() == expected and crossing.tolist() == [1, 1, 0]


def test_section_edges(spark, edge, empty):
    got = tokencounts.section_tokens(edge, tokencounts.head_body_tail("text"))
    assert {r["doc_id"] for r in got.collect()} == {1, 2, 3, 4, None, 5, 6, 7, 8}
    assert tokencounts.section_tokens(empty, tokencounts.head_body_tail("text")).count() == 0
    odd = F.array(F.struct(F.lit("b").alias("name"), F.lit(3).alias("start"), F.lit(9_999_999).alias("end")), F.struct(F.lit("a").alias("name"), F.lit(0).alias("start"), F.lit(5).alias("end")), F.lit(None))
    per = {}
    for r in tokencounts.section_tokens(edge.filter("doc_id = 1").limit(1), odd).collect():
        per[r["section"]] = r["n_tokens"]
    assert set(per) == {"a", "b"} and sum(per.values()) == 13


def test_packing_round_trip(spark, bpe, edge, empty):
    for df in (docs(spark), edge):
        pieces = sorted(packing.pack(df, window=256, with_ids=True).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
        at = 0
        for r in pieces:
            assert (r["sequence_id"], r["offset"]) == divmod(at, 256) and r["offset"] + r["length"] <= 256 and len(r["ids"]) == r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            at += r["length"]
        stream, found = [i for r in pieces for i in r["ids"]], Counter()
        k = 0
        while k < len(pieces):
            r = pieces[k]
            assert r["start"] == 0
            ids, n = list(r["ids"]), r["doc_tokens"]
            while len(ids) < n:
                k += 1
                assert pieces[k]["start"] == len(ids) and pieces[k]["doc_id"] == r["doc_id"]
                ids += pieces[k]["ids"]
            found[(r["doc_id"], tuple(ids))] += 1
            k += 1
        assert found == Counter((r["doc_id"], (*bpe.encode(r["text"] or "", add_special_tokens=False).ids, 1)) for r in df.collect())
        assert len(stream) == at
    assert packing.pack(empty).count() == 0


def test_added_token_in_text(spark):
    """By the library's defaults a written-out added token is one token."""
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x <|endoftext|><|endoftext|>\n\n y  <|endoftext|>  ", "é<|endoftext|>日本 <|endoftext", "<|ENDOFTEXT|> it's", "a  \n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    want = {i: plain.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert want[0] == [64, 220, 50256, 275]
    assert {r["doc_id"]: list(r["ids"]) for r in packing.pack(df, with_ids=True).collect()} == {i: [*x, 1] for i, x in want.items()}
    counts = Counter()
    for r in tokencounts.section_tokens(df, tokencounts.head_body_tail("text")).collect():
        counts[r["doc_id"]] += r["n_tokens"]
        assert r["doc_tokens"] == len(want[r["doc_id"]])
    assert counts == {i: len(x) for i, x in want.items()}


# -- models --------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark, edge, empty):
    labels = spark.read.parquet(f"{SF2}/labels.parquet")
    t = toxicity.toxicity_scores(docs(spark, SF2), labels).join(labels, "doc_id").filter("held_out").toPandas()
    hot, clean = t[t.toxic == 1].score.to_numpy(), t[t.toxic == 0].score.to_numpy()
    assert (hot[:, None] > clean[None]).mean() > 0.9 and (clean >= 0.7).mean() < 0.02
    got = toxicity.toxicity_scores(edge, labels).collect()
    assert len(got) == edge.count() and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] in (3, 4)}) == 1
    assert {r["score"] for r in toxicity.toxicity_scores(edge, labels.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity_scores(empty, labels).count() == 0
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert toxicity.drop_toxic(edge, labels).columns == edge.columns


def test_toxicity_reads_whole_words(spark):
    """What tells the classes apart stands after 16 letters, behind punctuation, or in a script without spaces."""
    one = lambda t: set(toxicity.terms(t).tolist())
    assert one("donaudampfschifffahrtskapitaen") != one("donaudampfschifffahrtsgesellen")
    assert one("dreckskerl") <= one("guten,tag/dreckskerl") & one("see_you-dreckskerl!")
    assert one("笨蛋") <= one("今天天气很好我们一起去公园散步然后回家吃饭你这个笨蛋请走开")
    assert one("หมา") <= one("วันนี้อากาศดีมากเราไปเดินเล่นที่สวนกับหมาตัวใหญ่")
    assert one("किताब") == one("«किताब»") & one("किताब") and one("") == set()
    rows = [(i, "今天天气很好我们一起去公园散步然后" + chr(0x4E00 + i) + ("你这个笨蛋" if i % 2 else "你这个朋友"), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    got = toxicity.toxicity_scores(df, df.select("doc_id", "toxic")).filter("held_out").collect()
    assert got and all(r["predicted"] == r["doc_id"] % 2 for r in got)


def test_toxicity_learns_a_label_that_only_a_pair_tells(spark):
    """Both words are as frequent in clean as in toxic texts; only side by side they make a text toxic."""
    import random

    rng, rows = random.Random(5), []
    for i in range(1200):
        words = [f"w{rng.randrange(300)}" for _ in range(30)]
        kind = i % 4
        if kind in (0, 1):
            words[4] = "kratz"
        if kind in (0, 2):
            words[5] = "folk"
        rows.append((i, " ".join(words), int(kind in (0, 3))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    got = toxicity.toxicity_scores(df, df.select("doc_id", "toxic"), threshold=0.5).filter("held_out").collect()
    assert sum(r["predicted"] == rows[r["doc_id"]][2] for r in got) > 0.9 * len(got)


def test_toxicity_scores_by_brute_force(spark):
    """Document scores recomputed from the model, term by term and pair by pair."""
    labels = spark.read.parquet(f"{SF2}/labels.parquet")
    d = docs(spark, SF2)
    model = toxicity.train(d, labels)
    assert len(model.chosen) > 50
    place = {int(t): i for i, t in enumerate(model.chosen)}
    got = {r["doc_id"]: r["score"] for r in toxicity.with_score(d.limit(80), model).collect()}
    for r in d.limit(80).collect():
        at = sorted({place[t] for t in toxicity.terms(r["text"]).tolist() if t in place})
        raw = model.bias + sum(model.w[i] for i in at) + sum(float(model.v[i] @ model.v[j]) for k, i in enumerate(at) for j in at[k + 1 :])
        assert abs(got[r["doc_id"]] - 1 / (1 + math.exp(-max(-30.0, min(30.0, raw))))) < 1e-9


def test_pairs_matter():
    """An interaction that no additive model can learn: two terms that count only alone."""
    rng = np.random.default_rng(1)
    rows = [np.flatnonzero(rng.random(2) < 0.5).tolist() for _ in range(2000)]
    y = np.array([len(r) == 1 for r in rows])
    m = toxicity.FactorizationMachine(np.array([0, 1])).fit(np.array([i for r in rows for i in r]), np.array([len(r) for r in rows]), y, steps=600, l2=0.0)
    s = [m.bias + m.w[r].sum() + (m.v[0] @ m.v[1] if len(r) == 2 else 0) for r in rows]
    assert ((np.array(s) > 0) == y).mean() > 0.99


def brute_ppm(code_counts, order, context, symbol):
    """One probability by the escape chain, symbol by symbol."""
    p, excluded = 1.0, set()
    for j in range(order, -1, -1):
        c = context[len(context) - j :]
        seen = code_counts[j].get(c)
        if not seen:
            continue
        left = {s: n for s, n in seen.items() if s not in excluded}
        total = sum(left.values())
        if symbol in left:
            return p * (left[symbol] - 0.5) / total
        if left:
            p *= 0.5 * len(left) / total
        excluded |= set(seen)
    return p / (257 - len(excluded))


def contexts(texts, order):
    counts = [{} for _ in range(order + 1)]
    for t in texts:
        padded = b"\0" * order + t
        for i in range(order, len(padded) + 1):
            for j in range(order + 1):
                counts[j].setdefault(padded[i - j : i], Counter())[padded[i] if i < len(padded) else 256] += 1
    return counts


def brute_score(counts, order, text):
    padded = b"\0" * order + text
    return sum(math.log10(brute_ppm(counts, order, padded[i - order : i], padded[i] if i < len(padded) else 256)) for i in range(order, len(padded) + 1))


def test_ppm_by_hand(spark, tmp_path):
    """Document scores by the escape chain, symbol by symbol; a context's probabilities sum to one."""
    texts, order = ["abracadabra", "abc", "", None, "zzz", "cabÿ", "dabracada", "日本語のabra"] * 2, 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    bytes_of = [(t or "").encode() for t in texts]
    train = [t for i, t in enumerate(bytes_of) if zlib.crc32(str(i).encode()) % 2 != 1]
    counts = contexts(train, order)
    for block_bytes in (16, 1 << 24):
        got = {r["doc_id"]: r["score"] for r in ppm.lm_scores(df, mod=2, held=1, order=order, block_bytes=block_bytes).collect()}
        assert all(abs(got[i] - brute_score(counts, order, t)) < 1e-9 for i, t in enumerate(bytes_of)) and len(got) == len(texts)
    code, n = np.unique(np.concatenate([ppm.stream([t], order)[0] for t in train]), return_counts=True)
    known = dict(zip(code.tolist(), n.tolist(), strict=True))
    for context in (b"abr", b"xab", b"zzq"):
        every = {(int.from_bytes(context, "big") << 9) | s: 0 for s in range(257)}
        rows = spark.createDataFrame([(int(c), int(x)) for c, x in (every | known).items()], "code bigint, n bigint")
        logs = dict(map(tuple, ppm.code_logs(rows, order, common.Scratch(spark)).collect()))
        assert abs(sum(10.0 ** logs[c] for c in every) - 1) < 1e-9


def test_lm_does_not_depend_on_size(spark):
    """The depth stays: ten times the same training texts give each text the scores of ten times the counts."""
    base = [(i, r["text"]) for i, r in enumerate(docs(spark).limit(40).collect())]
    train = [t for i, t in base if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = contexts([t.encode() for t in train], 5)
    few = {r["doc_id"]: r["score"] for r in ppm.lm_scores(spark.createDataFrame(base, "doc_id bigint, text string")).collect()}
    short = sorted((i for i, t in base if len(t) < 3000), key=lambda i: (zlib.crc32(str(i).encode()) % 7 != 2, i))[:4]
    assert all(abs(few[i] - brute_score(counts, 5, dict(base)[i].encode())) < 1e-6 for i in short)
    many = spark.createDataFrame([*base, *((1000 * k + i, t) for k in range(1, 4) for i, t in base if zlib.crc32(str(i).encode()) % 7 != 2 and zlib.crc32(str(1000 * k + i).encode()) % 7 != 2)], "doc_id bigint, text string")
    again = {r["doc_id"]: r["score"] for r in ppm.lm_scores(many, block_bytes=1 << 14).collect()}
    assert all(again[i] > few[i] for i, t in base if zlib.crc32(str(i).encode()) % 7 != 2)


def test_lm_scores(spark, edge, empty):
    for df, frequent in ((docs(spark), 50), (edge, 1 << 16), (edge, 0)):
        rows = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [b"\n"]) for r in df.collect()]
        train = [w for i, w in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
        c = Counter(x for w in train for x in w)
        n, v = sum(c.values()), len(c)
        want = sorted((str(i), len(w), sum(x in c for x in w), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in rows)
        got = ppm.lm_scores(df, frequent=frequent, order=3).collect()
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
        assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 for r in got)
    assert ppm.lm_scores(empty).count() == 0


def test_lm_beats_words_on_held_out(spark):
    held = ppm.lm_scores(docs(spark, SF2)).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > 1.15 * held[1]


def test_language(spark, edge, empty):
    pages = spark.read.parquet(f"{SF2}/pages.parquet")
    t = langid.identify_pages(pages, docs(spark, SF2).select("text", "lang")).toPandas()
    assert len(t) == pages.count() and (t.lang == t.declared).mean() > 0.97 and t.accepted.mean() > 0.99
    odd = spark.createDataFrame([(1, None, None), (2, "not a url", "<p>the thing and the other of</p>"), (2, "http://h.example.de:80/x", "<html lang=de><body>%%%</body>"), (None, "http://h.example.de/", "")], "page_id bigint, url string, html string")
    got = langid.identify_pages(odd, docs(spark).select("text", "lang")).collect()
    assert len(got) == 4 and {r["host"] for r in got} == {None, "h.example.de"} and not [r for r in got if r["page_id"] == 1][0]["accepted"]
    assert {r["lang"] for r in langid.identify_pages(odd, empty.select("text", "lang")).collect()} == {None}
    kept = langid.keep_identified(edge)
    assert kept.columns == edge.columns and not {3, 4, 8} & {r["doc_id"] for r in kept.collect()} and kept.filter("doc_id in (1, 2)").count() == 3
    assert langid.keep_identified(empty).count() == 0


@pytest.mark.parametrize("block", [7, 32])
def test_every_declared_language_is_known(spark, block):
    """80 languages, the later the rarer."""
    words = lambda i: " ".join(chr(0x3400 + 50 * i + j) * 3 for j in range(20))
    labelled = spark.createDataFrame([(words(i), f"l{i:02d}") for i in range(80) for _ in range(1 + (i < 64))], "text string, lang string")
    pages = spark.createDataFrame([(i, None, f"<p>{words(i)}</p>") for i in range(80)], "page_id bigint, url string, html string")
    got = langid.identify_pages(pages, labelled, block=block).collect()
    assert {r["page_id"]: (r["text_lang"], r["lang"]) for r in got} == {i: (f"l{i:02d}",) * 2 for i in range(80)}


def test_host_prior_decides_without_text(spark):
    rows = [(i, "http://a.example.org/", "<p>der die das und nicht</p>") for i in range(30)] + [(99, "http://a.example.org/", "<p>zz</p>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["lang"] for r in langid.identify_pages(df, docs(spark).select("text", "lang"), text_weight=0.01).collect()}
    assert got[99] == "de"


def language_by_brute_force(rows, labelled, weight=0.25, pull=8.0):
    """{row: (text_lang, lang, confidence)} of (row, text, declared, host, domain, suffix), one row at a time."""
    langs = sorted({x for _, x in labelled if x is not None})
    model = {x: Counter() for x in langs}
    for text, x in labelled:
        if x is not None:
            model[x].update(langid.trigrams(text).tolist())
    log_p = {x: (lambda b, c=c, n=sum(c.values()): math.log((c[b] + 0.5) / (n + 0.5 * 65536))) for x, c in model.items()}
    logs, other, best = {}, {}, {}
    for row, text, *_ in rows:
        g = langid.trigrams(text).tolist()
        logs[row] = {x: weight * sum(map(log_p[x], g)) for x in langs}
        other[row] = -weight * len(g) * math.log(65536)
        top = max(langs, key=lambda x: logs[row][x])
        best[row] = top if g and other[row] <= logs[row][top] else None
    values = [len({r[i] for r in rows} - {None}) for i in (2, 5)]
    out = {}
    for row, _, *evidence in rows:
        rest = [(best[r[0]], *r[2:]) for r in rows if r[0] != row and best[r[0]]]
        all_n = Counter(b for b, *_ in rest)
        prior = {x: (all_n[x] + 1) / (len(rest) + len(langs) + 1) for x in langs}
        for i in (2, 1):
            if evidence[i] is not None:
                n = Counter(r[0] for r in rest if r[1 + i] == evidence[i])
                prior = {x: (n[x] + pull * prior[x]) / (sum(n.values()) + pull) for x in langs}
        fused = {x: logs[row][x] + math.log(prior[x]) for x in langs}
        left = other[row] - math.log(len(rest) + len(langs) + 1)
        for i, v in ((0, values[0]), (3, values[1])):
            if evidence[i] is not None:
                n = Counter(r[0] for r in rest if r[1 + i] == evidence[i])
                fused = {x: f + math.log((n[x] + 1) / (all_n[x] + v + 1)) for x, f in fused.items()}
                left -= math.log(v + 1)
        top = max(langs, key=lambda x: fused[x])
        out[row] = best[row], top, 1 / (sum(math.exp(f - fused[top]) for f in fused.values()) + math.exp(min(left - fused[top], 700)))
    return out


@pytest.mark.parametrize("weight", [0.25, 0.005])
def test_language_by_brute_force(spark, weight):
    """All evidence over pages, some with a declaration, an address or a text of their own taken away, or none of a known language."""
    some = spark.read.parquet(f"{SF}/pages.parquet").union(
        spark.createDataFrame([(901, "http://a.example.org/x", None), (902, None, "<p>qzx vqk jxw zzq</p>"), (903, "http://a.example.org/y", "<html lang=de>!!</html>")], "page_id bigint, url string, html string")
    )
    labelled = docs(spark).select("text", F.lower("lang").alias("lang"))
    rows = langid.page_evidence(some).withColumnRenamed("page_id", "row").cache()
    rows = rows.withColumn("declared", F.when(F.col("row") % 3 != 0, F.col("declared"))).withColumn("host", F.when(F.col("row") % 5 != 0, F.col("host")))
    got = langid.fuse(rows, langid.train_text(labelled, common.Scratch(spark)), common.Scratch(spark), text_weight=weight).collect()
    want = language_by_brute_force([(r["row"], r["text"], r["declared"], r["host"], r["domain"], r["suffix"]) for r in rows.collect()], [tuple(r) for r in labelled.collect()], weight)
    assert len(got) == len(want) == some.count()
    for r in got:
        text_lang, lang, sure = want[r["row"]]
        assert (r["text_lang"], r["lang"]) == (text_lang, lang) and abs(r["confidence"] - sure) < 2e-3, r


def test_language_is_told_without_the_declaration(spark):
    """Pages are judged by the text alone or with the host; what they declare is hidden and only compared."""
    pages = spark.read.parquet(f"{SF2}/pages.parquet")
    rows = langid.page_evidence(pages).withColumnRenamed("page_id", "row")
    models = langid.train_text(docs(spark, SF2).select("text", F.lower("lang").alias("lang")), common.Scratch(spark))
    hidden = rows.withColumns({c: F.lit(None).cast("string") for c in ("declared", "suffix")})
    for some in (hidden, hidden.withColumns({c: F.lit(None).cast("string") for c in ("host", "domain")})):
        t = langid.fuse(some, models, common.Scratch(spark)).join(rows.select("row", "declared"), "row").filter("declared is not null")
        right, n = t.agg(F.sum((F.col("lang") == F.col("declared")).cast("int")), F.count("*")).first()
        assert n > 0 and right / n > 0.9


def test_unknown_languages_and_random_letters_are_rejected(spark):
    rng = np.random.default_rng(2)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    noise = [" ".join("".join(rng.choice(letters, rng.integers(3, 9))) for _ in range(60)) for _ in range(20)]
    other = ["это совсем другой язык и здесь его никто не знает " * 3, "अन्य भाषा में लिखा गया एक पाठ " * 3]
    known = docs(spark, SF2)
    more = spark.createDataFrame([(10**9 + i, t, x, "src0", len(t)) for i, t in enumerate([*noise, *other]) for x in [None]], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = langid.keep_identified(known.select(*more.columns).union(more))
    assert kept.filter(f"doc_id >= {10**9}").count() == 0
    assert kept.count() == known.filter("text rlike '[A-Za-z]'").count()

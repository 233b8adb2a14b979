"""Toxicity by a factorization machine over hashed terms.

A text is the set of its distinct words, lower-cased, with punctuation stripped from both ends, of the pieces
between punctuation inside them, of one to four letters from each place in scripts without spaces, and of all
these words' first three to eight letters (which carry over to unseen inflections and compounds), each hashed
whole to one of ``dims`` terms.  The machine has a weight for each term and
a vector for each term whose inner products weigh pairs, so a pair can count for more or less than the sum of
its parts.

The machine is trained on the driver over at most ``max_train`` labelled rows (the first in the order of a hash
of the id).  It has every term that tells the classes apart in these rows, by counts that Spark sums over them:
a term that is more frequent in one class, and both words of a pair of near words that is, even if neither word
tells anything alone.  There is no cap on the number of terms; it follows the sample, not the corpus.  All
texts are then scored whole in the executors.
"""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import Scratch, crc_bucket, free_name

#: What is stripped from the ends of a word.
PUNCTUATION = ".,;:!?\"'()[]{}<>*#%$&-_~`|/\\+="
#: Lengths of the word beginnings that are terms too, and of the stretches of letters in scripts without spaces.
BEGINNINGS, GRAMS = range(3, 9), range(1, 5)
DIMS = 1 << 20
#: Thai, Lao, Tibetan, Burmese, Khmer, kana, Han; and pictures, which are strung together too.
UNSPACED = "\u0e00-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U0001f000-\U0001faff\U00020000-\U0003ffff"
#: Punctuation, mathematical, money and modifier signs of the basic plane; letters' marks are none of these.
BREAKS = "".join(re.escape(chr(c)) for c in range(0x10000) if unicodedata.category(chr(c)) in ("Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Sm", "Sc", "Sk"))
INNER, STRETCH = re.compile(f"[{BREAKS}{UNSPACED}]+"), re.compile(f"[{UNSPACED}]+")


def hashed(words: list[str], dims: int) -> np.ndarray:
    """A row of terms for each word: the whole word, then its beginnings; -1 where it is too short."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    most = BEGINNINGS[-1]
    letters = np.array(words, dtype=f"U{most}").view(np.uint32).reshape(len(words), most) if words else np.zeros((0, most), np.uint32)
    out = np.full((len(words), 1 + len(BEGINNINGS)), -1, np.int32)

    def term(h: np.ndarray, salt: int) -> np.ndarray:
        h = (h ^ np.uint32(salt)) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return ((h ^ (h >> np.uint32(16))) % np.uint32(dims)).astype(np.int32)

    h = np.full(len(words), 2166136261, np.uint32)
    for k in range(most):
        h = (h ^ letters[:, k]) * np.uint32(16777619)
        if k + 1 in BEGINNINGS:
            at = 1 + BEGINNINGS.index(k + 1)
            out[:, at] = np.where(size > k, term(h, k + 1), -1)
    whole = np.fromiter((xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass"), 99) for w in words), np.uint32, len(words))
    out[:, 0] = np.where(size > 0, whole % np.uint32(dims), -1)
    return out


def parts(word: str) -> list[str]:
    """What a run has inside: its pieces between punctuation, and 1 to 4 letters from each place of a stretch in an unspaced script."""
    out = [p for p in INNER.split(word) if p and p != word]
    for m in STRETCH.finditer(word):
        t = m[0]
        out += {t[i : i + n] for n in GRAMS for i in range(len(t) - n + 1)} - {word}
    return out


def found(runs: list[str], dims: int, most: int = 1 << 17):
    """(run, term) arrays: the terms of each run and of its parts, about ``most`` words at a time."""
    words, owner = [], []
    for i, run in enumerate(runs):
        word = run.strip(PUNCTUATION)
        words.append(word)
        owner.append(i)
        if INNER.search(word):
            more = parts(word)
            words += more
            owner += [i] * len(more)
        if len(words) >= most or i + 1 == len(runs):
            table = hashed(words, dims)
            row, col = np.nonzero(table >= 0)
            yield np.array(owner)[row], table[row, col]
            words, owner = [], []


def words_of(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def terms(text: str | None, dims: int = DIMS) -> np.ndarray:
    """The sorted distinct hashed terms of the whole text."""
    return np.unique(np.concatenate([np.zeros(0, np.int32), *(t for _, t in found(list(words_of(text)), dims))]))


def doc_terms(texts: list, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of the distinct terms of each text; each word of all of them is hashed once."""
    vocabulary: dict[str, int] = {}
    owners, words = [], []
    for i, t in enumerate(texts):
        at = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)]
        words += at
        owners += [i] * len(at)
    run, term = (np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0, np.int32)), *found(list(vocabulary), dims), strict=True))
    term, n = term[np.argsort(run, kind="stable")].astype(np.int64), np.bincount(run, minlength=len(vocabulary))
    first, word = np.cumsum(n) - n, np.array(words, np.int64)
    many = n[word]
    place = np.arange(int(many.sum())) + np.repeat(first[word] - (np.cumsum(many) - many), many)
    each = np.unique(np.repeat(np.array(owners, np.int64), many) * dims + term[place])
    return each // dims, each % dims


def doc_pairs(texts: list, dims: int, reach: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, low, high) of the distinct pairs of different words' terms up to ``reach`` words apart in each text.

    The order of the two words does not matter.
    """
    vocabulary: dict[str, int] = {}
    size, words = [], []
    for t in texts:
        at = [vocabulary.setdefault(w, len(vocabulary)) for w in (t or "").lower().split()]
        size.append(len(at))
        words += at
    term = hashed([w.strip(PUNCTUATION) for w in vocabulary], dims)[:, 0].astype(np.int64)[np.array(words, np.int64)]
    owner = np.repeat(np.arange(len(texts)), size)
    found_ = [np.zeros(0, np.int64)]
    for k in range(1, reach + 1):
        a, b = term[:-k], term[k:]
        keep = (owner[:-k] == owner[k:]) & (a != b) & (a >= 0) & (b >= 0)
        found_.append(np.unique((owner[k:][keep] * dims + np.minimum(a, b)[keep]) * dims + np.maximum(a, b)[keep]))
    each = np.unique(np.concatenate(found_))
    return each // dims // dims, each // dims % dims, each % dims


def pair_bucket(low: np.ndarray, high: np.ndarray, dims: int) -> np.ndarray:
    mixed = (low * 0x9E3779B1 + high * 0x85EBCA77) & 0x7FFFFFFFFFFF
    return (mixed ^ (mixed >> 21)) % dims


def apart(n0: str, n1: str, share: str, most: float) -> F.Column:
    """Whether the share of class 1 among n0 + n1 rows is more than ``most`` standard errors from ``share``."""
    n = f"({n0} + {n1})"
    return F.expr(f"pow({n1} - {n} * {share}, 2) > {most**2!r}D * greatest({n} * {share} * (1 - {share}), 0.5D)")


class FactorizationMachine:
    """score = sigmoid(bias + sum of weights + sum over pairs of inner products of factors)."""

    def __init__(self, chosen: np.ndarray, dims: int = DIMS, factors: int = 8):
        """chosen: the hashed terms that the model has."""
        self.chosen, self.dims, self.factors = np.sort(np.asarray(chosen, np.int32)), dims, factors
        self.bias, self.w, self.v = 0.0, np.zeros(len(chosen)), np.zeros((len(chosen), factors))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("slot", "seen", "hot")}

    def fit(self, flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, epochs: int = 12, steps: int = 600, batch: int = 256, rate: float = 0.02, l2: float = 1e-4, seed: int = 7) -> FactorizationMachine:
        """Adam on the log loss, over batches of rows in a seeded order, with a rate that falls to zero; with one
        class or no rows the score is the base rate.

        flat: positions in ``chosen``, one row's after the other's; sizes: how many each row has.  Few rows are
        gone over more often, for ``steps`` steps at least.
        """
        y = np.asarray(y, dtype=np.float64)
        ones, n, m = float(y.sum()), len(y), len(self.chosen)
        self.bias = math.log((ones + 0.5) / (n - ones + 0.5))
        if not 0 < ones < n or not m:
            return self
        col, sizes = np.asarray(flat, np.int64), np.asarray(sizes, np.int64)
        first, rng = np.cumsum(sizes) - sizes, np.random.default_rng(seed)
        #: The weight of each term, then its factors; the bias by itself.
        x = [np.array(self.bias), np.concatenate([np.zeros((m, 1)), rng.normal(0, 0.05, (m, self.factors))], axis=1)]
        m1, m2 = [np.zeros_like(p) for p in x], [np.zeros_like(p) for p in x]
        batches = -(-n // batch)
        steps = batches * max(epochs, -(-steps // batches))
        for step in range(steps):
            if step % batches == 0:
                order = rng.permutation(n)
            rows = order[step % batches * batch :][:batch]
            many = sizes[rows]
            doc = np.repeat(np.arange(len(rows)), many)
            at = col[np.arange(len(doc)) + np.repeat(first[rows] - (np.cumsum(many) - many), many)]
            each = x[1][at]
            s = np.stack([np.bincount(doc, each[:, f], len(rows)) for f in range(1 + self.factors)], axis=1)
            squares = np.bincount(doc, (each[:, 1:] ** 2).sum(1), len(rows))
            raw = x[0] + s[:, 0] + 0.5 * ((s[:, 1:] ** 2).sum(1) - squares)
            g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows]) / len(rows)
            s[:, 0] = 1
            pull = np.stack([np.bincount(at, (g * s[:, f])[doc], m) for f in range(1 + self.factors)], axis=1)
            pull[:, 1:] -= x[1][:, 1:] * pull[:, :1]
            for i, d in enumerate([g.sum(), pull + l2 * x[1]]):
                m1[i] = 0.9 * m1[i] + 0.1 * d
                m2[i] = 0.999 * m2[i] + 0.001 * d * d
                x[i] = x[i] - rate * (1 - step / steps) * (m1[i] / (1 - 0.9 ** (step + 1))) / (np.sqrt(m2[i] / (1 - 0.999 ** (step + 1))) + 1e-8)
        self.bias, self.w, self.v = float(x[0]), x[1][:, 0].copy(), x[1][:, 1:].copy()
        return self

    def active(self, texts: list) -> list[list[int]]:
        """Positions of the model's terms that each whole text has; each new word is hashed once."""
        if "slot" not in self.__dict__:
            self.slot = np.full(self.dims, -1, np.int32)
            self.slot[self.chosen] = np.arange(len(self.chosen), dtype=np.int32)
            self.seen, self.hot = set(), {}
        texts = [words_of(t) for t in texts]
        if len(self.seen) > 1 << 19:
            self.seen, self.hot = set(), {}
        new = list(set().union(*texts) - self.seen)
        for run, term in found(new, self.dims):
            at = self.slot[term]
            for i, a in zip(run[at >= 0].tolist(), at[at >= 0].tolist(), strict=True):
                self.hot.setdefault(new[i], set()).add(a)
        out = [sorted({s for w in words if w in self.hot for s in self.hot[w]}) for words in texts]
        for w in new:
            if len(w) <= 64:
                self.seen.add(w)
            else:  # rare and large: found again when met again
                self.hot.pop(w, None)
        return out

    def scores(self, texts: list) -> list[float]:
        out = []
        for at in self.active(texts):
            v = self.v[at]
            s = v.sum(0)
            raw = self.bias + self.w[at].sum() + 0.5 * float((s * s - (v * v).sum(0)).sum())
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, raw)))))
        return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = 20_000, mod: int = 3, held: int = 1, dims: int = DIMS, factors: int = 8, least_z: float = 2.5, least_pair_z: float = 5.5, least_pair_rows: int = 8) -> FactorizationMachine:
    """Fits on at most ``max_train`` labelled rows whose crc32 of the id as text, modulo ``mod``, is not
    ``held``.  Null ids or labels are not used; an id labelled twice counts once, by its larger label, and
    an id with several texts by its smallest text, so repeated rows never make the sample larger.

    Terms are chosen from ``least_z`` standard errors; pairs, of which there are many more, from
    ``least_pair_z`` in ``least_pair_rows`` rows or more, by what they tell beyond each of the words.
    """
    scratch = Scratch(docs.sparkSession)
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_bucket(id_col, mod) != held))
    sample = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_train)
    #: The sample has at most max_train rows of an id and a label.  Rows that share an id are one: that of the smallest text.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id").groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    rows = scratch.save(rows.select(F.xxhash64("id").alias("id"), (F.col("y") > 0).cast("int").alias("y"), "text"))

    def chunks(batches, most: int = 256):
        for b in batches:
            for low in range(0, b.num_rows, most):
                some = b.slice(low, most)
                yield some.column(1).to_numpy(zero_copy_only=False), some.column(2).to_pylist()

    def count(batches):
        n = np.zeros((2, 2 * dims + 1), np.int64)  # terms, then pairs by bucket, and the rows in the last place
        for y, texts in chunks(batches):
            doc, term = doc_terms(texts, dims)
            pair_doc, low, high = doc_pairs(texts, dims)
            bucket = dims + pair_bucket(low, high, dims)
            for k in (0, 1):
                n[k] += np.bincount(np.concatenate([term[y[doc] == k], bucket[y[pair_doc] == k]]), minlength=2 * dims + 1)
                n[k][2 * dims] += (y == k).sum()
        at = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[0][at]), pa.array(n[1][at])], names=["term", "n0", "n1"])

    counts = scratch.save(rows.mapInArrow(count, "term bigint, n0 bigint, n1 bigint").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    totals = counts.filter(f"term = {2 * dims}").first()
    share = (totals["n1"] / (totals["n0"] + totals["n1"])) if totals else 0.0
    if not 0 < share < 1:
        return FactorizationMachine(np.zeros(0, np.int32), dims, factors).fit(np.zeros(0), np.zeros(totals["n0"] + totals["n1"] if totals else 0, np.int64), np.full(totals["n0"] + totals["n1"] if totals else 0, share))
    numbers = lambda df: df.toArrow().column(0).to_numpy()
    chosen = numbers(counts.filter(f"term < {dims} and n0 + n1 >= 3").filter(apart("n0", "n1", f"{share!r}D", least_z)).select("term"))
    #: Buckets of pairs first, then the pairs themselves in those that may hold a telling one.
    open_ = np.zeros(dims, bool)
    open_[numbers(counts.filter(f"term >= {dims} and term < {2 * dims} and n0 + n1 >= {least_pair_rows}").filter(apart("n0", "n1", f"{share!r}D", least_z)).select("term")) - dims] = True

    def exact_pairs(batches):
        for y, texts in chunks(batches):
            doc, low, high = doc_pairs(texts, dims)
            keep = open_[pair_bucket(low, high, dims)]
            yield pa.RecordBatch.from_arrays([pa.array(y[doc[keep]].astype(np.int32)), pa.array(low[keep]), pa.array(high[keep])], names=["y", "low", "high"])

    if open_.any():
        pairs = rows.mapInArrow(exact_pairs, "y int, low bigint, high bigint").groupBy("low", "high").agg(F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1"))
        pairs = scratch.save(pairs.filter(f"n0 + n1 >= {least_pair_rows}").filter(apart("n0", "n1", f"{share!r}D", least_pair_z)))
        for word in ("low", "high"):  # more than either word tells by itself
            own = counts.select(F.col("term").alias(word), ((F.col("n1") + share) / (F.col("n0") + F.col("n1") + 1)).alias("own"))
            pairs = pairs.join(own, word).filter(apart("n0", "n1", "own", least_pair_z)).drop("own")
        chosen = np.union1d(chosen, numbers(pairs.select(F.explode(F.array("low", "high"))).distinct()))
    model = FactorizationMachine(chosen, dims, factors)

    def find(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.active(b.column(2).to_pylist()), pa.list_(pa.int32()))], names=["id", "y", "at"])

    got = rows.mapInArrow(find, "id bigint, y int, at array<int>").orderBy("id", "y").toArrow()
    scratch.drop(rows, counts)
    flat, sizes, y = pc.list_flatten(got["at"]).to_numpy(), pc.list_value_length(got["at"]).to_numpy(), got["y"].to_numpy()
    del got
    return model.fit(flat, sizes, y)


def with_score(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score of the whole text (null text: empty)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        out = []
        for low in range(0, len(text), 256):
            out += shared.value.scores(text.iloc[low : low + 256].tolist())
        return pd.Series(out, dtype="float64")

    return docs.withColumn(score_col, score(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, mod: int = 3, held: int = 1, **how) -> DataFrame:
    """A row for each row of ``docs``: id, held_out, score (0 to 1), predicted (1 from ``threshold``).

    Empty and null texts get the model's base rate.  A null id is not held out.  Repeated rows are scored
    each.  An empty label table gives 0.5 for all.  Only the id and the text of ``docs`` are read.
    """
    model = train(docs, labels, id_col, text_col, label_col, mod=mod, held=held, **how)
    rows = with_score(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text_")), model, "text_", "score")
    return rows.select(id_col, F.coalesce(crc_bucket(id_col, mod) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.7, **how) -> DataFrame:
    """docs without the rows that the model scores at ``threshold`` or more; columns stay as they are."""
    name = free_name(docs.columns, "toxicity")
    return with_score(docs, train(docs, labels, text_col=text_col, **how), text_col, name).filter(F.col(name) < threshold).drop(name)

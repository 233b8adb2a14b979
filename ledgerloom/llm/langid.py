"""Language ID by Bayesian fusion of text, declared language, address suffix and host.

The text's likelihood comes from counts of hashed byte trigrams for each language over all labelled
documents (a fixed table of 65,536 buckets a language; all languages count, a block of them at a time).  A
class "other", under which all buckets are equally likely, stands for what none of them explains: an unknown
language or random letters.  A first guess from the text alone (none, where other is likelier) is then counted
by group: for each declared language and each address suffix how often each language has it, and for each
host, its domain and the whole table how often each language occurs, the host smoothed by its domain and
the domain by the whole.  The four logs are added and normalised, other included.  A row's own first guess is
taken out of all these counts, so a row does not vouch for itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name

BUCKETS = 1 << 16
#: ASCII that is no letter says nothing about the language (numbers, keys, markup): each such byte is a space.
LETTERS_ONLY = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def trigrams(text: str | None) -> np.ndarray:
    """Hashed trigrams of the whole text's bytes, A-Z lower-cased, runs of ASCII other than letters as one space."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LETTERS_ONLY).lower().split()
    raw = np.frombuffer(b" " + b" ".join(words) + b" " if words else b"", dtype=np.uint8)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    a = raw.astype(np.int64)
    return (a[:-2] * 40503 + a[1:-1] * 2477 + a[2:] * 131) % BUCKETS


class TextModel:
    """log P(bucket | language) with half a count added to each bucket."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + 0.5
        self.logs = np.log(smooth / smooth.sum(1, keepdims=True)).T.astype(np.float32).copy() if langs else np.zeros((BUCKETS, 0), np.float32)

    def likelihood(self, g: np.ndarray, weight: float) -> np.ndarray:
        """Tempered log-likelihood of each language for a text's trigrams; zeros without any."""
        out = np.zeros(len(self.langs))
        for i in range(0, len(g), 1 << 16):
            out += self.logs[g[i : i + (1 << 16)]].sum(0, dtype=np.float64)
        return out * weight


def other_likelihood(trigrams_: int, weight: float) -> float:
    """The same of the class "other" for a number of trigrams."""
    return -trigrams_ * np.log(BUCKETS) * weight


class TextModels:
    """The text models of all languages.  Their counts (lang, bucket, n) are a table, of which ``block`` languages at a time are read."""

    def __init__(self, langs: list[str], counts: DataFrame, block: int):
        self.langs, self.counts, self.block = langs, counts, block

    def blocks(self):
        """The models of each block of languages, in their order; one without languages if there are none."""
        for low in range(0, max(len(self.langs), 1), self.block):
            some = self.langs[low : low + self.block]
            counts = np.zeros((len(some), BUCKETS))
            if some:
                place = F.array_position(F.array(*map(F.lit, some)), F.col("lang")).cast("int")
                got = self.counts.select(place.alias("at"), "bucket", "n").filter("at > 0").toArrow()
                counts[got["at"].to_numpy() - 1, got["bucket"].to_numpy()] = got["n"].to_numpy()
            yield TextModel(some, counts)


def train_text(labelled: DataFrame, scratch: Scratch, block: int = 32) -> TextModels:
    """labelled: (text, lang); null languages are not used.  All rows and all languages count, in partial sums of at
    most ``block`` languages a task."""

    def run(batches):
        sums = {}

        def flush():
            for lang, s in sums.items():
                at = np.flatnonzero(s)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(s[at], pa.int64())], names=["lang", "bucket", "n"])
            sums.clear()

        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                g = trigrams(text.as_py())
                if lang not in sums:
                    if len(sums) >= block:
                        yield from flush()
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                if len(g):
                    sums[lang] += np.bincount(g, minlength=BUCKETS)
        yield from flush()

    known = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null")
    langs = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    counts = scratch.save(known.mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    return TextModels(langs, counts, block)


def host_parts(url: F.Column) -> dict[str, F.Column]:
    """Host (lower case, no port), its domain (last two labels) and suffix (last label); null if not a URL."""
    host = F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))
    return {"host": host, "domain": F.regexp_extract(host, r"([^.]+\.[^.]+)$|([^.]+)$", 0), "suffix": F.regexp_extract(host, r"([^.]+)$", 1)}


def page_evidence(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with text, declared, host, domain and suffix columns (nulls stay null)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    text = F.regexp_replace(bare, r"&[#A-Za-z0-9]+;", " ")
    declared = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    return pages.select("page_id", text.alias("text"), F.nullif(declared, F.lit("")).alias("declared"), *(c.alias(n) for n, c in host_parts(F.col("url").cast("string")).items()))


def spread(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of the counts in lists of (best, n), zero where a list is null, and which lists are not null."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    pairs = column.flatten()
    out = np.zeros((len(column), k))
    out[np.repeat(np.arange(len(column)), sizes), pairs.field("best").to_numpy(zero_copy_only=False)] = pairs.field("n").to_numpy(zero_copy_only=False)
    return out, there


def fuse(rows: DataFrame, models: TextModels, scratch: Scratch, text_weight: float = 0.25, pull: float = 8.0) -> DataFrame:
    """rows (row, text, declared, host, domain, suffix) -> (row, text_lang, lang, confidence, letters).

    declared, host, domain and suffix may be null: then that evidence says nothing.  ``pull`` is the number
    of rows that a group's parent counts for.  With no known language, lang is null and confidence 0; lang is
    the likeliest known one otherwise, its confidence low if other is likelier.  The texts are read once for each block of languages.
    """
    langs = models.langs
    k = len(langs)
    kind = rows.schema["row"].dataType.simpleString()
    evidence = ["declared", "host", "domain", "suffix"]
    kinds = f"row {kind}, declared string, host string, domain string, suffix string, logs array<double>"

    def guess(shared, last: bool):
        def run(batches):
            m = shared.value
            for b in batches:
                logs, best, letters, other = [], [], [], []
                for t, before in zip(b.column(6), b.column(5), strict=True):
                    text = t.as_py() or ""
                    g = trigrams(text)
                    x = np.concatenate([before.values.to_numpy(), m.likelihood(g, text_weight)])
                    if last:
                        most = x.max(initial=-np.inf) if len(g) and len(x) else 0.0
                        x = x - most
                        other.append(other_likelihood(len(g), text_weight) - most)
                        best.append(int(x.argmax()) if len(g) and len(x) and other[-1] <= 0 else None)
                        letters.append(any(map(str.isalpha, text)))
                    logs.append(x)
                out = [*(b.column(i) for i in range(5)), pa.array(logs, pa.list_(pa.float64()))]
                out += [pa.array(best, pa.int32()), pa.array(letters, pa.bool_()), pa.array(other, pa.float64())] if last else [b.column(6)]
                yield pa.RecordBatch.from_arrays(out, names=["row", *evidence, "logs", *(["best", "letters", "other"] if last else ["text"])])

        return run

    first, saved = rows.select("row", *evidence, F.array().cast("array<double>").alias("logs"), "text"), None
    for low, model in zip(range(0, max(k, 1), models.block), models.blocks(), strict=True):
        last = low + models.block >= k
        shared = rows.sparkSession.sparkContext.broadcast(model)
        first = scratch.save(first.mapInArrow(guess(shared, last), kinds + (", best int, letters boolean, other double" if last else ", text string")))
        shared.unpersist()
        scratch.drop(saved)
        saved = first
    if not k:
        return first.select("row", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), "letters")

    everywhere = np.zeros(k)
    for r in first.filter("best is not null").groupBy("best").count().collect():
        everywhere[r["best"]] = r["count"]
    sizes = first.agg(F.count_distinct("declared"), F.count_distinct("suffix")).first()

    def counted(key: str) -> DataFrame:
        """(key, key_n): how often each language is the first guess of the key's rows, as a list of (best, n)."""
        each = first.filter(F.col(key).isNotNull()).groupBy(key, "best").agg(F.count("*").alias("n"))
        return each.groupBy(key).agg(F.collect_list(F.when(F.col("best").isNotNull(), F.struct("best", "n"))).alias(f"{key}_n"))

    full = first
    for key in evidence:
        full = full.join(counted(key), key, "left")

    def run(batches):
        for whole_batch in batches:
            step = max(1, (1 << 18) // k)
            for low in range(0, whole_batch.num_rows, step):
                b = whole_batch.slice(low, step)
                n = b.num_rows
                fused = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, k)
                best = b.column(2).fill_null(-1).to_numpy(zero_copy_only=False)
                own = np.zeros((n, k))
                own[np.flatnonzero(best >= 0), best[best >= 0]] = 1
                rest = everywhere - own
                prior = (rest + 1) / (rest.sum(1, keepdims=True) + k + 1)
                other = b.column(8).to_numpy(zero_copy_only=False) - np.log(rest.sum(1) + k + 1)
                for i in (6, 5):  # domain, then host
                    c, there = spread(b.column(i), k)
                    c -= own * there[:, None]
                    prior = (c + pull * prior) / (c.sum(1, keepdims=True) + pull)
                fused = fused + np.log(prior)
                for i, values in ((4, sizes[0]), (7, sizes[1])):  # log P(value | language), one count added for each of the values and an unseen one
                    c, there = spread(b.column(i), k)
                    c -= own * there[:, None]
                    fused += np.log((c + 1) / (rest + values + 1)) * there[:, None]
                    other -= np.log(values + 1) * there
                top = fused.argmax(1)
                names = np.array(langs, dtype=object)
                text_lang = [langs[x] if x >= 0 else None for x in best]
                with np.errstate(over="ignore"):
                    sure = 1 / (np.exp(fused - fused.max(1, keepdims=True)).sum(1) + np.exp(other - fused.max(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text_lang, pa.string()), pa.array(names[top], pa.string()), pa.array(sure), b.column(3)], names=["row", "text_lang", "lang", "confidence", "letters"])

    full = full.select("row", "logs", "best", "letters", "declared_n", "host_n", "domain_n", "suffix_n", "other")
    return full.mapInArrow(run, f"row {kind}, text_lang string, lang string, confidence double, letters boolean")


def identify_pages(pages: DataFrame, labelled: DataFrame, threshold: float = 0.5, block: int = 32, **how) -> DataFrame:
    """A row for each page: page_id, declared, host, suffix, text_lang, lang, confidence, accepted.

    The text model learns from ``labelled`` (text, lang).  Null url or html leaves out that evidence;
    repeated page ids keep a row each; a page without letters is not accepted.  Only the named columns are
    read.
    """
    scratch = Scratch(pages.sparkSession)
    rows = scratch.save(page_evidence(pages).withColumn("row", F.monotonically_increasing_id()))
    out = fuse(rows, train_text(labelled, scratch, block), scratch, **how)
    return rows.select("row", "page_id", "declared", "host", "suffix").join(out, "row").select("page_id", "declared", "host", "suffix", "text_lang", "lang", "confidence", (F.col("letters") & (F.col("confidence") >= threshold)).alias("accepted"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", threshold: float = 0.5, block: int = 32, **how) -> DataFrame:
    """docs without the rows whose language can't be told: no letters, or a fused confidence below ``threshold``, as in texts
    of a language that no row declares or of random letters.

    The declared language is ``lang_col``, the host ``source_col``; the text model learns from all rows with
    a declared language.  Rows that share an id, null ids too, are judged as one: they stay if one of them
    would.  Columns stay as they are.
    """
    scratch = Scratch(docs.sparkSession)
    text, lang = F.col(text_col).cast("string"), F.lower(F.col(lang_col).cast("string"))
    source = F.col(source_col).cast("string")
    rows = docs.select(F.col(id_col).alias("row"), text.alias("text"), lang.alias("declared"), source.alias("host"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("suffix"))
    out = fuse(rows, train_text(docs.select(text.alias("text"), lang.alias("lang")), scratch, block), scratch, **how)
    other = free_name(docs.columns, "row_id")
    good = F.coalesce(F.col("letters") & (F.col("confidence") >= threshold), F.lit(False))
    bad = out.groupBy("row").agg(F.max(good).alias("good")).filter("not good").select(F.col("row").alias(other))
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(other)), "left_anti")

"""Spelling variants: words one edit apart, found over a reduced alphabet and verified on the words themselves.

Every letter is hashed to one of ``SYMBOLS`` symbols, so a word becomes a shorter-alphabet word of the same length.
Words one edit apart have reduced words that are equal or one edit apart, so each word generates the full one-edit
neighbourhood of its reduced word (all deletions, replacements and insertions over the small alphabet) and looks it
up in the reduced vocabulary by an equality join.  What meets is verified on the original strings.

Neighbourhoods are keys of a polynomial hash, all made at once from prefix sums, some 2 x SYMBOLS x length a word.  A
bitmap of fixed size over the keys of the reduced vocabulary, sent to every task, leaves out those that no word has
before anything is shuffled; a vocabulary that outgrows it is let through more often, never less.

Spark takes the size of a neighbourhood for that of the stored words it is made of, and that of words for their compressed
files; so joins are by sort and merge on purpose, and no table of words or keys is ever sent to the driver.

Words of ``LONG`` code points or more meet by halves instead: of two such words one edit apart, either the first half
of the shorter or its last half stands unchanged in both, so four keys a word are enough at any length.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SYMBOLS, LONG = 16, 64
#: Odd factors of the polynomial hash and of the mix that picks a bit.
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: By byte of Latin-1: ASCII capitals lowered, the other letters of the runs as they are, all else a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: The symbol of a Latin-1 letter.
REDUCED = np.array([((b * 2654435761) >> 15) % SYMBOLS + 1 for b in range(256)], np.uint64)


def runs(text: str | None) -> list[bytes]:
    """The runs ``[A-Za-z\\u00C0-\\u00FF]+`` of the whole text, A-Z lower-cased, a byte a code point."""
    return (text or "").encode("latin-1", "replace").translate(FOLD).split()


def miswritten(word: bytes, before: int, mod: int) -> bytes:
    """The run, without one code point if ``mod`` divides its hash; ``before``: crc32 of the id and colon."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), before)
    if h % mod:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(df: DataFrame, id_col: str, text_col: str, mod: int, least_length: int, least_count: int, held: int = 300_000) -> DataFrame:
    """(word, n): the words of ``least_length`` code points and ``least_count`` occurrences or more."""

    def run(batches):
        total: Counter = Counter()

        def flush():
            words = [w for w in total if len(w) >= least_length]
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array([total[w] for w in words], pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for b in batches:
            for key, text in zip(b.column(0), b.column(1), strict=True):
                before = zlib.crc32(f"{key.as_py() or ''}:".encode())
                for w, n in Counter(runs(text.as_py())).items():
                    total[miswritten(w, before, mod)] += n
                if len(total) > held:
                    yield flush()
        yield flush()

    rows = df.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def reduced_keys(words: list[bytes]) -> np.ndarray:
    """The key of each reduced word; all of one length."""
    s = REDUCED[np.frombuffer(b"".join(words), np.uint8)].reshape(len(words), -1)
    return (s * powers(s.shape[1])[::-1]).sum(1, dtype=np.uint64)


def neighbourhood(words: list[bytes]) -> np.ndarray:
    """Keys, a row a word, of all one-edit neighbours of the reduced word and of itself; all words of one length."""
    s = REDUCED[np.frombuffer(b"".join(words), np.uint8)].reshape(len(words), -1)
    n, length = s.shape
    p = powers(length + 2)
    head, tail = np.zeros((n, length + 1), np.uint64), np.zeros((n, length + 1), np.uint64)
    for i in range(length):  # key of the first i symbols, and of what stands from i on
        head[:, i + 1] = head[:, i] * BASE + s[:, i]
        tail[:, length - 1 - i] = tail[:, length - i] + s[:, length - 1 - i] * p[i]
    after = p[:length][::-1]  # by position, the power that what stands before it is raised by
    symbols = np.arange(1, SYMBOLS + 1, dtype=np.uint64)
    gone = head[:, :-1] * after + tail[:, 1:]
    swapped = ((head[:, :-1] * BASE)[:, :, None] + symbols) * after[:, None] + tail[:, 1:, None]
    added = ((head * BASE)[:, :, None] + symbols) * p[: length + 1][::-1][:, None] + tail[:, :, None]
    return np.concatenate([gone, swapped.reshape(n, -1), added.reshape(n, -1)], axis=1)


def half_keys(word: bytes) -> list[int]:
    """Keys of the halves, for the word as the shorter and as the longer of two."""
    out = []
    for short in (len(word) - 1, len(word)):
        cut = short // 2
        for side, part in (("first", word[:cut]), ("last", word[len(word) - (short - cut) :])):
            out.append(xxhash.xxh64_intdigest(part, seed=2 * short + (side == "last")) - (1 << 63))
    return out


def by_length(words: list[bytes]):
    """(positions, words) of the words of each length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        for low in range(0, len(at), max(1, (1 << 21) // (2 * SYMBOLS * (size + 2)))):
            some = at[low : low + max(1, (1 << 21) // (2 * SYMBOLS * (size + 2)))]
            yield some, [words[i] for i in some]


def keyed(b: pa.RecordBatch, rows: np.ndarray, keys: np.ndarray):
    for low in range(0, len(rows), 50_000):
        at = pa.array(rows[low : low + 50_000])
        yield pa.RecordBatch.from_arrays([pa.array(keys[low : low + 50_000].view(np.int64)), b.column(0).take(at), b.column(1).take(at)], names=["key", "word", "n"])


def latin(b: pa.RecordBatch) -> list[bytes]:
    return [w.encode("latin-1") for w in b.column(0).to_pylist()]


def index_rows(words: DataFrame) -> DataFrame:
    """(key, word, n): the reduced vocabulary, a row a word of up to LONG code points."""

    def run(batches):
        for b in batches:
            for at, some in by_length(latin(b)):
                yield from keyed(b, at, reduced_keys(some))

    return words.filter(F.length("word") <= LONG).select("word", "n").mapInArrow(run, "key bigint, word string, n bigint")


def bits_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * MIX) >> np.uint64(64 - bits)).astype(np.int64)


def bitmap(index: DataFrame, bits: int) -> np.ndarray:
    """2^bits bits, those of the index's keys set: built in Spark, of the same size for any vocabulary."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(bits_of(b.column(0).to_numpy().view(np.uint64), bits)))], names=["bit"])

    page = 1 << 15
    made = index.select("key").mapInArrow(run, "bit bigint").groupBy(F.expr(f"bit div {page}").alias("page")).agg(F.bitmap_construct_agg(F.col("bit") % page).alias("bits")).toArrow()
    out = np.zeros((max(1, (1 << bits) // page), page // 8), np.uint8)
    for at, raw in zip(made["page"].to_pylist(), made["bits"], strict=True):
        out[at] = np.frombuffer(raw.as_buffer(), np.uint8)
    return out.reshape(-1)


def asked_rows(words: DataFrame, seen, bits: int) -> DataFrame:
    """(key, word, n): each word's neighbourhood, without the keys whose bit no reduced word has."""

    def run(batches):
        for b in batches:
            for at, some in by_length(latin(b)):
                keys = neighbourhood(some)
                bit = bits_of(keys, bits)
                row, col = np.nonzero((seen.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                found = np.unique(np.stack([row.astype(np.uint64), keys[row, col]], axis=1), axis=0)
                yield from keyed(b, at[found[:, 0].astype(np.int64)], found[:, 1])

    return words.filter(F.length("word") <= LONG).select("word", "n").mapInArrow(run, "key bigint, word string, n bigint")


def long_rows(words: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            keys = [half_keys(w) for w in latin(b)]
            yield from keyed(b, np.repeat(np.arange(len(keys)), 4), np.array(keys, np.int64).reshape(-1))

    return words.filter(F.length("word") >= LONG).select("word", "n").mapInArrow(run, "key bigint, word string, n bigint")


def near_words(words: DataFrame, scratch: Scratch, bits: int = 27) -> DataFrame:
    """(word, near, near_n): every pair of different words of the table (word, n) that one edit separates, both ways."""
    index = scratch.save(index_rows(words))
    seen = words.sparkSession.sparkContext.broadcast(bitmap(index, bits))
    long = long_rows(words)

    def verified(left: DataFrame, right: DataFrame, which: str) -> DataFrame:
        found = left.alias("x").hint("merge").join(right.alias("y"), F.expr(f"x.key = y.key AND x.word <> y.word AND ({which}) AND levenshtein(x.word, y.word, 1) = 1"))
        return found.select(F.col("x.word").alias("word"), F.col("y.word").alias("near"), F.col("y.n").alias("near_n"))

    short = verified(asked_rows(words, seen, bits), index, f"least(length(x.word), length(y.word)) < {LONG}")
    return short.unionByName(verified(long, long, "true").distinct())


def spelling_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 97, least_length: int = 5, least_count: int = 3, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a row for each word of the whole texts.

    Words are runs of Latin letters, A-Z lower-cased, of which one code point is left out where ``mod`` divides the
    crc32 of ``<id>:<run>``, with ``least_length`` code points and ``least_count`` occurrences or more.  Two words are
    near if one inserted, deleted or replaced code point separates them.  A word's form is its near word with the
    largest n (ties: the smallest), if that is ``ratio`` times the word's own n or more; its root is where its forms
    end, itself if it has none.  Forms grow in n, so there are no cycles.

    Null texts have no words; a null id counts as empty before the colon.  Repeated rows count each.  An empty table
    gives no rows.  Other columns are not read.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, else forms could go in a circle")
    scratch = Scratch(df.sparkSession)
    words = scratch.save(word_counts(df, id_col, text_col, mod, least_length, least_count))
    near = near_words(words, scratch)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    full = words.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(-F.col("best.less") >= ratio * F.col("n"), F.struct(F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("to"))
    full = scratch.save(full.select("word", "to.form", "n", "n_near", "to.form_n"))
    return full.join(roots(full.filter("form is not null").select("word", F.col("form").alias("root")), scratch).hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root): where each word's chain of links (word, root) ends.

    Every round doubles how far a link reaches, so the rounds follow the logarithm of the longest chain.
    """
    links, moved = scratch.save(links), True
    while moved:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = scratch.save(links.join(further.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(links)
        moved, links = not new.filter("moved").isEmpty(), new
    return links.select("word", "root")

"""Scores by prediction by partial matching (PPM) over bytes, and the word model it is compared with.

The trie of byte contexts is a Spark table of (code, n): a code is a context of ``order`` bytes and the symbol
after it.  ``order`` is fixed; it does not change with the size of the corpus, and all codes of all training
texts count.  The shorter contexts are sums over that table, so the trie is one table a level.

Escapes are estimated by method D (half a count of each distinct symbol of a context goes to what is new
there), and the symbols of a longer context are excluded from the next shorter one, so the probabilities in
each context sum to one.  The code length of a code needs its own level and what its suffix found one level
below: a join from each level to the next, whose fan-out is at most 256, and a window over a context, which
has at most 257 rows.  Neither has a hot key at any size of the corpus.

No task and not the driver holds the trie.  Texts are packed into blocks of about ``block_bytes``; each block
lists its distinct codes, gets their code lengths back by a join, and is scored from that list, which is
no longer than the block's own text.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, crc_bucket
from .simhash import text_words

#: Symbols: the 256 bytes and the end of the text; a code is a context's bytes and then 9 bits of symbol.
SYMBOLS, END, BITS = 257, 256, 9
#: Stands for the end of a text among words, which never hold white space.
END_WORD = "\n"


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def stream(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all symbols of the texts in their contexts of ``order`` bytes (zero bytes stand before a
    text), and where each text's symbols start."""
    pad = b"\0" * order
    raw = np.frombuffer(b"".join(pad + t for t in texts) + pad + b"\0", dtype=np.uint8)
    n = len(raw) - order
    code = np.zeros(n, np.int64)
    for k in range(order):
        code = (code << 8) | raw[k : k + n]
    symbol = raw[order:].astype(np.int64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes + order) - order
    symbol[ends] = END
    keep = np.ones(n, dtype=bool)
    for more in range(1, max(order, 1)):  # the other bytes that stand before the next text
        keep[ends + more] = False
    keep[int(ends[-1]) + 1 :] = False
    return ((code << BITS) | symbol)[keep], np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])


def chunks(texts: list[bytes], most: int = 1 << 20):
    """The texts in runs of about ``most`` bytes; a longer text is a run of its own."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def merge(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, count = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, count = code[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[first], np.add.reduceat(count, first)


def packed_blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """(block, docs): the rows (id, held_out, text) in runs of about ``block_bytes`` of text, compressed."""

    def run(batches):
        part, made, kept, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for b in kept:
                    w.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + made], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "docs"])

        for b in batches:
            sizes = np.array([len(t.as_buffer() or b"") for t in b.column(2)], dtype=np.int64)
            low = 0
            while low < b.num_rows:
                fits = int(np.searchsorted(np.cumsum(sizes[low:]), block_bytes - size)) + 1
                some = b.slice(low, fits)
                kept.append(some)
                size += int(sizes[low : low + some.num_rows].sum())
                low += some.num_rows
                if size >= block_bytes:
                    yield flush()
                    made, kept, size = made + 1, [], 0
        if kept:
            yield flush()

    return rows.select("id", "held_out", "text").mapInArrow(run, "block bigint, docs binary")


def unpacked(docs: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(docs.as_buffer()).read_all()


def block_codes(blocks: DataFrame, order: int) -> DataFrame:
    """(block, code, n) of all codes of each block; n counts its training texts only and can be 0."""

    def run(batches):
        for b in batches:
            for block, docs in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t, codes, counts = unpacked(docs), [], []
                for held in (False, True):
                    some = t.column("text").filter(t.column("held_out") if held else pa.compute.invert(t.column("held_out")))
                    for part in chunks([utf8(x.as_py()) for x in some]):
                        code, count = np.unique(stream(part, order)[0], return_counts=True)
                        codes.append(code)
                        counts.append(count * (not held))
                        if len(codes) >= 16:
                            code, count = merge(codes, counts)
                            codes, counts = [code], [count]
                code, count = merge(codes, counts)
                for i in range(0, len(code), 100_000):
                    c = code[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), block)), pa.array(c), pa.array(count[i : i + 100_000].astype(np.int64))], names=["block", "code", "n"])

    return blocks.mapInArrow(run, "block bigint, code bigint, n bigint")


def code_logs(counts: DataFrame, order: int, scratch: Scratch) -> DataFrame:
    """(code, log): log10 of each code's probability.

    counts (code, n): a row for each code of ``order`` bytes whose probability is wanted or that trains;
    codes with n = 0 are wanted only.  With no training at all the symbols are equally likely.
    """
    suffix = lambda j: F.col("code").bitwiseAND(F.lit((1 << (8 * j + BITS)) - 1))
    levels = {order: scratch.save(counts)}
    for j in reversed(range(order)):
        levels[j] = scratch.save(levels[j + 1].groupBy(suffix(j).alias("code")).agg(F.sum("n").alias("n")))
    context, known, done = Window.partitionBy("context"), F.col("n") > 0, None
    for j in range(order + 1):
        rows = levels[j].withColumn("context", F.shiftright("code", BITS))
        rows = rows.withColumn("total", F.sum("n").over(context)).withColumn("size", F.count(F.when(known, 1)).over(context))
        if done is None:  # below all contexts, what is new is one of the symbols that never occurred
            rows = rows.withColumn("next", -F.log10(F.greatest(F.lit(SYMBOLS) - F.col("size"), F.lit(1)))).withColumn("lower_log", F.col("next"))
        else:
            lower = done.select(F.col("code").alias("below"), *(F.col(c).alias(f"lower_{c}") for c in ("n", "total", "size", "next", "log")))
            rows = rows.withColumn("below", suffix(j - 1)).join(lower, "below")
            rows = rows.withColumn("left", F.col("lower_total") - F.coalesce(F.sum(F.when(known, F.col("lower_n"))).over(context), F.lit(0)))
            fresh = F.col("lower_size") - F.col("size")
            escape = F.when(fresh > 0, F.log10(fresh / 2 / F.col("left"))).otherwise(0.0)
            #: What follows on an escape from this context.
            rows = rows.withColumn("next", F.when(F.col("lower_n") > 0, F.log10(F.col("lower_n") - 0.5) - F.log10("left")).otherwise(escape + F.col("lower_next")))
        log = F.when(known, F.log10((F.col("n") - 0.5) / F.col("total"))).when(F.col("total") > 0, F.log10(F.col("size") / 2 / F.col("total")) + F.col("next")).otherwise(F.col("lower_log"))
        done = scratch.save(rows.select("code", "n", "total", "size", "next", log.alias("log")))
        scratch.drop(levels[j])
    return done.select("code", "log")


class Lookup:
    """Numbers by code, as a hash table in arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = 64 - max(4, int(2 * len(keys)).bit_length())
        self.slots = np.full(1 << (64 - self.shift), -1, np.int64)
        self.values = np.zeros(len(self.slots))
        at = self.slot(keys)
        while len(keys):
            free = self.slots[at] < 0
            self.slots[at[free]] = keys[free]  # of several keys for a slot the last one stays
            placed = self.slots[at] == keys
            self.values[at[placed]] = values[placed]
            keys, values, at = keys[~placed], values[~placed], (at[~placed] + 1) & (len(self.slots) - 1)

    def slot(self, code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def of(self, code: np.ndarray) -> np.ndarray:
        """The values of the codes, all of which the table has."""
        at = self.slot(code)
        todo = np.flatnonzero(self.slots[at] != code)
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
            there = self.slots[at[todo]]
            if (there < 0).any():
                raise KeyError("a code without a code length")
            todo = todo[there != code[todo]]
        return self.values[at]


def text_logs(texts: list[bytes], order: int, logs: Lookup) -> np.ndarray:
    out = []
    for part in chunks(texts):
        code, starts = stream(part, order)
        out.append(np.add.reduceat(logs.of(code), starts))
    return np.concatenate(out) if out else np.zeros(0)


def count_words(blocks: DataFrame) -> DataFrame:
    """(word, n, times) of all words of the texts and of their ends, of which each text has one: in training
    texts and in all."""

    def run(batches):
        for b in batches:
            for docs in b.column(1):
                t = unpacked(docs)
                train, held = Counter(), Counter()
                for text, out in zip(t.column("text"), t.column("held_out").to_pylist(), strict=True):
                    (held if out else train).update([*text_words(text.as_py()), END_WORD.encode()])
                for found, n in ((train, 1), (held, 0)):
                    times = pa.array(list(found.values()), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.binary()).cast(pa.string()), pa.compute.multiply(times, n), times], names=["word", "n", "times"])

    return blocks.mapInArrow(run, "word string, n bigint, times bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("times").alias("times"))


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 7, held: int = 2, frequent: int = 1 << 18, order: int = 5, block_bytes: int = 1 << 25) -> DataFrame:
    """A row for each row of ``df``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32 of the id as text, modulo ``mod``, is ``held`` are held out; all others train both
    models.  base_score is the add-one word model's log10 probability, score that of the byte model.  Null
    text counts as empty; a null id trains.  Repeated rows count each.  With no training rows both models
    are uniform.  Counts of the ``frequent`` most frequent words of all texts go to every task; all other
    words of a document are joined with the counts, so that no frequent word makes a hot key, and none is
    left out.  Other columns are not read.
    """
    if not 1 <= order <= 6:
        raise ValueError("order must be from 1 to 6")
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(crc_bucket(id_col, mod) == held, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    blocks = scratch.save(packed_blocks(rows, block_bytes))
    words = scratch.save(count_words(blocks))
    n_all, n_distinct = (int(x or 0) for x in words.filter("n > 0").agg(F.sum("n"), F.count("*")).first())
    top = words.orderBy(F.col("word") != END_WORD, F.desc("times"), "word").limit(frequent + 1).filter(F.length("word") <= 256).select("word", "n").toArrow()
    top = spark.sparkContext.broadcast({utf8(w): n for w, n in zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True)})
    codes = scratch.save(block_codes(blocks, order))
    logs = code_logs(codes.groupBy("code").agg(F.sum("n").alias("n")), order, scratch)
    wanted = codes.select("block", "code").join(logs, "code")
    kind = df.schema[id_col].dataType.simpleString()
    end = END_WORD.encode()

    def score(docs: pa.Table, found: pa.Table) -> pa.Table:
        of = top.value.get
        length_of = Lookup(found.column("code").to_numpy(), found.column("log").to_numpy())
        out = []
        for packed in docs.column("docs"):
            t = unpacked(packed)
            texts = [utf8(x.as_py()) for x in t.column("text")]
            tokens, hits, logs, rare, times = [], [], [], [], []
            for text in texts:
                split = text.lower().split()
                c = np.array([*(of(w, -1) for w in split), of(end, 0)], dtype=np.float64)
                others = Counter(w for w, x in zip(split, c, strict=False) if x < 0)
                tokens.append(len(split) + 1)
                hits.append(int((c > 0).sum()))
                logs.append(float(np.log10(np.maximum(c, 0) + 1).sum()))
                rare.append([w.decode("utf-8", "surrogatepass") for w in others])
                times.append(list(others.values()))
            out.append(pa.table({"id": t.column("id"), "held_out": t.column("held_out"), "n_tokens": pa.array(tokens, pa.int64()), "hits": pa.array(hits, pa.int64()), "logs": pa.array(logs, pa.float64()), "score": pa.array(text_logs(texts, order, length_of), pa.float64()), "rare": pa.array(rare, pa.list_(pa.string())), "times": pa.array(times, pa.list_(pa.int64()))}))
        return pa.concat_tables(out)

    scored = blocks.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(score, f"id {kind}, held_out boolean, n_tokens bigint, hits bigint, logs double, score double, rare array<string>, times array<bigint>")
    scored = scratch.save(scored.withColumn("row", F.monotonically_increasing_id()))
    scratch.drop(codes, blocks)
    each = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    found = each.join(words.filter("n > 0").select("word", "n"), "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("more_logs"))
    full = scored.drop("rare", "times").join(found, "row", "left")
    return full.select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("hits") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n_all + n_distinct + 1)))).alias("base_score"),
        "score",
    )

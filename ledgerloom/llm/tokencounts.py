"""Token counts by section: documents are encoded once and whole, and token spans are joined to sections.

A byte-level BPE's tokens, put together, are the text's bytes, so the running sum of the tokens' byte
lengths gives every token's span without another pass over the text.  Both the token spans and the section
spans of a document are sorted, so joining them is two binary searches a token.  A token that crosses a
boundary goes where the rule says:

- ``majority``: to the span that has most of its bytes, the earlier one in a tie;
- ``start``: to the span that has its first byte;
- ``split``: to each span by its part of the token's bytes (counts are then fractions).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import byte_bpe, ids_of

RULES = ("majority", "start", "split")
UNASSIGNED = "(unassigned)"


def head_body_tail(text_col: str) -> Column:
    """Sections of a text by characters: its first line, what is between, and its last line.

    A text of one line is a head only; line ends between sections belong to none.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size, first = F.length(text), F.instr(text, "\n")
    last = size - F.instr(F.reverse(text), "\n")  # the last line end, when there is one
    part = lambda name, a, b: F.struct(F.lit(name).alias("name"), a.cast("int").alias("start"), b.cast("int").alias("end"))
    return F.when(first == 0, F.array(part("head", F.lit(0), size))).otherwise(
        F.array(part("head", F.lit(0), first - 1), part("body", F.least(first, last), last), part("tail", last + 1, size))
    )


def attribute(ends: np.ndarray, spans: list[tuple[int, int]], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Token counts and numbers of crossing tokens of each span and, last, of what no span covers.

    ends: where each token ends, in bytes; spans: sorted, apart from each other, within the text.
    """
    k = len(spans)
    edges, owner = [0], []
    total = int(ends[-1]) if len(ends) else 0
    for i, (a, b) in enumerate(spans):
        if a > edges[-1]:
            edges.append(a)
            owner.append(k)
        if b > a:
            edges.append(b)
            owner.append(i)
    if total > edges[-1]:
        edges.append(total)
        owner.append(k)
    counts, crossing = np.zeros(k + 1), np.zeros(k + 1, np.int64)
    if not len(ends):
        return counts, crossing
    edge, own = np.array(edges), np.array(owner)
    starts = np.concatenate([[0], ends[:-1]])
    low, high = np.searchsorted(edge, starts, "right") - 1, np.searchsorted(edge, ends, "left") - 1
    one = (low == high) | (rule == "start")
    counts += np.bincount(own[low[one]], minlength=k + 1)
    for t in np.flatnonzero(low != high):
        parts = [(min(ends[t], edge[j + 1]) - max(starts[t], edge[j]), own[j]) for j in range(low[t], high[t] + 1)]
        for _, o in parts:
            crossing[o] += 1
        if rule == "majority":
            counts[max(parts, key=lambda p: p[0])[1]] += 1
        elif rule == "split":
            for size, o in parts:
                counts[o] += size / (ends[t] - starts[t])
    return counts, crossing


def section_tokens(df: DataFrame, sections: Column, id_col: str = "doc_id", text_col: str = "text", rule: str = "majority", path: str | None = None) -> DataFrame:
    """(id, section, start, end, n_tokens, n_crossing, doc_tokens): a row for each section of each row.

    sections: array of (name, start, end) in characters.  They are put in order; parts that overlap an
    earlier section go to the earlier one, ends beyond the text are cut, null sections are left out.
    Tokens outside all sections make a row "(unassigned)" with null bounds.  n_crossing counts the tokens
    with a part in the section and a part outside.  Null text counts as empty: its sections have no tokens.
    Repeated and null ids keep their rows; other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = byte_bpe(path)
        sizes = np.array([len(bpe.decode_single_token_bytes(i)) for i in range(bpe.n_vocab)], dtype=np.int64)
        for b in batches:
            for low in range(0, b.num_rows, 256):
                some = b.slice(low, 256)
                rows, cols = [], [[] for _ in range(6)]
                for i in range(some.num_rows):
                    text = some.column(1)[i].as_py() or ""
                    ids = ids_of(bpe, text)
                    ends = np.cumsum(sizes[ids]) if ids else np.zeros(0, np.int64)
                    at = None  # where each character starts, in bytes, if that differs
                    if not text.isascii():
                        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
                        at = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])
                    given, spans, done = [], [], 0
                    for s in sorted((s for s in some.column(2)[i].as_py() or [] if s and s["start"] is not None and s["end"] is not None), key=lambda s: (s["start"], s["end"])):
                        a, z = (max(0, min(len(text), s[x])) for x in ("start", "end"))
                        a, z = (a, z) if at is None else (int(at[a]), int(at[z]))
                        a = max(a, done)
                        z = max(a, z)
                        done = z
                        given.append(s)
                        spans.append((a, z))
                    counts, crossing = attribute(ends, spans, rule)
                    for s, n, x in zip([*given, None], counts, crossing, strict=True):
                        if s is None and n == 0:
                            continue
                        rows.append(i)
                        for c, v in zip(cols, (s["name"] if s else UNASSIGNED, s and s["start"], s and s["end"], float(n), int(x), len(ids)), strict=True):
                            c.append(v)
                types = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(rows, pa.int32())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[id_col, "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), sections.alias("sections"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, section string, start int, `end` int, n_tokens double, n_crossing bigint, doc_tokens bigint")

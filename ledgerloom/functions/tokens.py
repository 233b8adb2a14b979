"""Token arithmetic: five disjoint classes, input equivalents, rates, weights, estimates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = ["input", "output", "cache_creation", "cache_read", "reasoning"]
#: Input equivalents of a token of each class.
EQUIVALENTS = {"input": 1.0, "output": 5.0, "cache_creation": 1.25, "cache_read": 0.1, "reasoning": 5.0}
#: Confidence and rank of where a reference came from; any other source has the last ones.
SOURCE_CONFIDENCE = {"git": 1.0, "tool": 0.8, "content": 0.6, "git_guess": 0.5}
SOURCE_RANK = {"git": 4, "tool": 3, "content": 2, "git_guess": 1}
OTHER_CONFIDENCE, OTHER_RANK = 0.4, 0
DAY_MS = 86_400_000
MATCH_DAYS, FAR_PROXIMITY = 14, 0.3
#: Bytes a token of ASCII and of other text, by tokenizer family.
ESTIMATE = {"anthropic": (3.6, 3.2), "openai": (4.0, 3.6), "google": (3.8, 3.4)}


def raw_total(tokens: dict[str, Column]) -> Column:
    """Sum of the five classes; a missing class counts 0."""
    return sum((F.coalesce(tokens[c], F.lit(0)) for c in CLASSES if c in tokens), F.lit(0).cast("bigint"))


def equivalents(tokens: dict[str, Column]) -> Column:
    return sum((F.coalesce(tokens[c], F.lit(0)) * F.lit(EQUIVALENTS[c]) for c in CLASSES if c in tokens), F.lit(0.0))


def usd(equivalent: Column, rate: Column | float | None) -> Column:
    """Dollars at a rate a million equivalents; NULL without a rate; negative zero becomes zero."""
    if rate is None:
        return F.lit(None).cast("double")
    return equivalent / F.lit(1e6) * rate + F.lit(0.0)


def lookup(value: Column, table: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def source_confidence(source: Column) -> Column:
    return lookup(source, SOURCE_CONFIDENCE, OTHER_CONFIDENCE)


def source_rank(source: Column) -> Column:
    return lookup(source, SOURCE_RANK, OTHER_RANK)


def time_proximity(gap_ms: Column) -> Column:
    """1 up to a gap of 0, then exponential decay to 0.3 at 14 days; NULL for a NULL gap."""
    tau = MATCH_DAYS * DAY_MS / -math.log(FAR_PROXIMITY)
    return F.when(gap_ms <= 0, F.lit(1.0)).when(gap_ms > 0, F.exp(-gap_ms / F.lit(tau)))


def disjoint_usage(total_input: Column, cached: Column, total_output: Column, reasoning: Column) -> dict[str, Column]:
    """Usage whose input holds the cached part and whose output holds the reasoning, made disjoint.

    A missing input or output counter makes all classes NULL; a part larger than its whole leaves 0.
    """
    known = total_input.isNotNull() & total_output.isNotNull()
    zero = F.lit(0).cast("bigint")
    c, r = F.coalesce(cached, zero), F.coalesce(reasoning, zero)
    out = {"input": F.greatest(total_input - c, zero), "output": F.greatest(total_output - r, zero), "cache_creation": zero, "cache_read": c, "reasoning": r}
    return {k: F.when(known, v) for k, v in out.items()}


def estimate_tokens(text: Column, family: str = "anthropic") -> Column:
    """ceil(ascii/a + white space/6 + CJK/0.7 + other bytes/o); ASCII excludes white space."""
    a, o = ESTIMATE[family]
    space = F.length(F.regexp_replace(text, r"[^ \t\n\r\x0B\f]", ""))
    ascii_ = F.length(F.regexp_replace(text, r"[^\x21-\x7E\x00-\x08\x0E-\x1F\x7F]", ""))
    cjk_text = F.regexp_replace(text, r"[^\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]", "")
    other = F.octet_length(text) - ascii_ - space - F.octet_length(cjk_text)
    return F.ceil(ascii_ / F.lit(a) + space / F.lit(6.0) + F.length(cjk_text) / F.lit(0.7) + other / F.lit(o))


def compact_tokens(n: Column) -> Column:
    """950, 1.2k, 12k, 1.2M; below ten of a unit with one decimal."""
    def unit(div: float, suffix: str) -> Column:
        x = n / F.lit(div)
        return F.concat(F.when(x < 10, F.format_string("%.1f", F.floor(x * 10) / 10)).otherwise(F.floor(x).cast("string")), F.lit(suffix))

    return F.when(n >= 1_000_000, unit(1e6, "M")).when(n >= 1_000, unit(1e3, "k")).otherwise(n.cast("bigint").cast("string"))


def compact_cost(usd_: Column) -> Column:
    """Four decimals under a cent, else two; NULL if not positive."""
    return F.when(usd_ <= 0, None).when(usd_ < 0.01, F.format_string("$%.4f", usd_)).otherwise(F.format_string("$%.2f", usd_))


def largest_remainder(df, total: str, weight: str, keys: list[str], order: list[str], out: str):
    """Splits the integer ``total`` of each group by ``weight``: floors, then units to the largest fractions.

    Bad or non-positive weights count 0; all zero: equal parts.  Ties go by ``order``.  The parts of a
    group sum to its total.
    """
    from pyspark.sql import Window

    group = Window.partitionBy(*keys)
    w = F.when(F.col(weight).isNull() | F.isnan(F.col(weight).cast("double")) | (F.col(weight) <= 0), F.lit(0.0)).otherwise(F.col(weight).cast("double"))
    rows = df.withColumn("w_", w).withColumn("sum_", F.sum("w_").over(group))
    rows = rows.withColumn("w_", F.when(F.col("sum_") > 0, F.col("w_")).otherwise(1.0)).withColumn("sum_", F.sum("w_").over(group))
    rows = rows.withColumn("exact_", F.col(total) * (F.col("w_") / F.col("sum_"))).withColumn("floor_", F.floor("exact_"))
    rows = rows.withColumn("rest_", F.col(total) - F.sum("floor_").over(group)).withColumn("n_", F.count("*").over(group))
    rows = rows.withColumn("rn_", F.row_number().over(group.orderBy((F.col("exact_") - F.col("floor_")).desc(), *order)))
    extra = F.expr("rest_ div n_") + F.when(F.col("rn_") <= F.expr("rest_ % n_"), 1).otherwise(0)
    return rows.withColumn(out, (F.col("floor_") + extra).cast("bigint")).drop("w_", "sum_", "exact_", "floor_", "rest_", "n_", "rn_")


def split_arrays(df, totals: list[str], weights: str, out: dict[str, str]):
    """As ``largest_remainder`` for several totals at once, where the weights of a group are one array in the order that
    ties go by: df with an array of parts for each total, named by ``out``."""
    add = lambda a, x: a + x
    w = F.transform(weights, lambda x: F.when(x.isNull() | F.isnan(x.cast("double")) | (x <= 0), F.lit(0.0)).otherwise(x.cast("double")))
    rows = df.withColumn("w_", w).withColumn("w_", F.when(F.aggregate("w_", F.lit(0.0), add) > 0, F.col("w_")).otherwise(F.transform("w_", lambda x: F.lit(1.0))))
    rows = rows.withColumn("sum_", F.aggregate("w_", F.lit(0.0), add)).withColumn("n_", F.size("w_"))

    def exact(t: str):
        return F.transform("w_", lambda x: F.col(t) * (x / F.col("sum_")))

    rows = rows.withColumns({f"exact_{t}": exact(t) for t in totals})
    rows = rows.withColumns({f"floor_{t}": F.transform(f"exact_{t}", lambda e: F.floor(e)) for t in totals})
    order = lambda t: F.transform(F.array_sort(F.transform(f"exact_{t}", lambda e, i: F.struct((F.floor(e) - e).alias("less"), i.alias("i")))), lambda x: x["i"])
    rows = rows.withColumns({f"order_{t}": order(t) for t in totals} | {f"rest_{t}": F.col(t) - F.aggregate(f"floor_{t}", F.lit(0).cast("bigint"), add) for t in totals})
    part = lambda t: F.transform(f"floor_{t}", lambda f, i: (f + F.expr(f"rest_{t} div n_") + F.when(F.array_position(f"order_{t}", i) <= F.expr(f"rest_{t} % n_"), 1).otherwise(0)).cast("bigint"))
    rows = rows.withColumns({out[t]: part(t) for t in totals})
    return rows.drop("w_", "sum_", "n_", *(f"{x}_{t}" for x in ("exact", "floor", "order", "rest") for t in totals))

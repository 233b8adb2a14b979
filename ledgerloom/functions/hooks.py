"""Hooks for models: entity spans, text completion, embeddings, each with an answer cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,type:string>>"


def with_model(df: DataFrame, text: str, out: str, schema: str, answer: Callable[[list[str]], list]) -> DataFrame:
    """df with a model's answer to each row's text, in Arrow batches; None means it could not answer.

    A null text is not asked and has no answer.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            there = s.notna().to_numpy()
            out = np.full(len(s), None, dtype=object)
            for i, a in zip(np.flatnonzero(there), answer(s[there].tolist()) if there.any() else [], strict=True):
                out[i] = a
            yield pd.Series(out, dtype=object)

    return df.withColumn(out, F.pandas_udf(run, schema)(F.col(text)))


def cached_answers(texts: DataFrame, cache: DataFrame, fingerprint: str, model: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(answers for all texts, new rows for the cache): only misses are asked, and no null answer is kept.

    texts: (text); cache: (key, answer); model: DataFrame (text) -> (text, answer).
    """
    keyed = texts.select("text").distinct().withColumn("key", F.sha2(F.concat_ws("\x1f", F.lit(fingerprint), "text").cast("binary"), 256))
    known = keyed.join(cache, "key")
    asked = model(keyed.join(cache, "key", "left_anti").select("text")).join(keyed, "text").select("key", "text", "answer")
    return known.select("text", "answer").unionByName(asked.select("text", "answer")), asked.filter("answer is not null").select("key", "answer")


def evicted(cache: DataFrame, most_bytes: int) -> DataFrame:
    """The newest cache rows (key, answer, used_at) within a size, by running sums over days first."""
    from pyspark.sql import Window

    rows = cache.withColumn("n_", F.octet_length(F.to_json(F.struct("answer")))).withColumn("day_", F.to_date("used_at"))
    days = rows.groupBy("day_").agg(F.sum("n_").alias("s_")).withColumn("after_", F.coalesce(F.sum("s_").over(Window.orderBy(F.desc("day_")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum("n_").over(Window.partitionBy("day_").orderBy(F.desc("used_at"), "key"))
    return rows.join(days, "day_").withColumn("at_", F.col("after_") + inside).filter(F.col("at_") <= most_bytes).select(*cache.columns)

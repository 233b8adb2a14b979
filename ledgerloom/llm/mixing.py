"""Mixing sources to target weights by hierarchical budgets.

Leaves are the distinct values of the level columns (domain, language, source).  The token budget of a node
is dealt to its children in proportion to their weights; a child that has fewer tokens than its share gives
the rest back to its siblings, and only what no child of the node can take was never given to the node (a
node's budget is at most what its leaves have).  With children in the order of supply / weight, the level
that fills a budget B is the largest of (B - supply of the children before) / (weight of the others), so each
level of the tree is one window over its nodes; texts are not touched.  Each leaf then takes whole epochs and
a prefix of a last one, in the order of a seeded hash of the id.

The order inside a leaf is cut into slices of that hash of about ``slice_rows`` documents; prefix sums run
over the slices' totals first and inside the one slice that the budget ends in, so a leaf with most of the rows is
spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

NONE = "(none)"


def word_tokens(text_col: str) -> Column:
    """Words of the whole text; null text: 0."""
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def weight_of(level: str, weights: Mapping[str, float]) -> Column:
    """The weight of a node by its own value at its level; 1 where none is given."""
    out = F.lit(1.0)
    for value, w in weights.items():
        out = F.when(F.col(level) == value, F.lit(float(w))).otherwise(out)
    return out


def leaf_budgets(leaves: DataFrame, levels: list[str], budget: Column, weights: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """leaves (levels, supply bigint) with their budget: whole tokens, at most the supply.

    budget: the root's, over columns of ``leaves`` aggregated (supply is the total).  A weight of 0 gives
    a node nothing, whatever its siblings lack.
    """
    leaves = leaves.withColumn("root", F.lit(0))
    nodes = leaves.groupBy("root").agg(F.sum("supply").alias("supply")).select("root", F.least(budget.cast("double"), F.col("supply").cast("double")).alias("budget"))
    above = ["root"]
    for level in levels:
        here = [*above, level]
        child = leaves.groupBy(*here).agg(F.sum("supply").cast("double").alias("supply")).withColumn("weight", weight_of(level, weights.get(level, {})))
        child = child.filter("weight > 0").join(nodes, above)
        by = Window.partitionBy(*above).orderBy(F.col("supply") / F.col("weight"), level)
        before = F.coalesce(F.sum("supply").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        others = F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        child = child.withColumn("lift", (F.col("budget") - before) / others)
        child = child.withColumn("fill", F.max("lift").over(Window.partitionBy(*above)))
        nodes = child.select(*here, F.greatest(F.lit(0.0), F.least(F.col("supply"), F.col("weight") * F.col("fill"))).alias("budget"))
        above = here
    return nodes.select(*levels, F.floor(F.col("budget") + 1e-6).cast("bigint").alias("budget"))


def seeded(id_col: str, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def mix(docs: DataFrame, levels: list[str], weights: Mapping[str, Mapping[str, float]], share: float, epochs: int = 1, seed: int = 0, id_col: str = "doc_id", tokens_col: str = "n_tokens", slice_rows: int = 4096) -> DataFrame:
    """(id, levels, n_tokens, epoch, taken_tokens): the documents that the budgets take, an epoch a row.

    share: the root's budget as a part of all tokens; a leaf supplies its tokens up to ``epochs`` times.  In
    a leaf's last epoch the documents whose tokens begin before its budget ends are taken, the last of them
    in part (taken_tokens < n_tokens).  Documents without tokens are not taken.  A null level is the node
    "(none)".  Ties of the hash go by id, then size; equal rows are interchangeable.  An empty table
    gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), *(F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(f"level{i}") for i, c in enumerate(levels)), F.col(tokens_col).cast("bigint").alias("n")).filter("n > 0")
    rows = scratch.save(rows)
    keys = [f"level{i}" for i in range(len(levels))]
    named = {k: weights.get(c, {}) for k, c in zip(keys, levels, strict=True)}
    leaves = scratch.save(rows.groupBy(*keys).agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")))
    supply = leaves.withColumn("supply", F.col("tokens") * epochs)
    budgets = leaf_budgets(supply, keys, F.floor(F.col("supply") * (share / epochs)), named)
    plan = leaves.join(budgets, keys).select(*keys, "budget", F.expr("budget div tokens").alias("whole"), F.expr("budget % tokens").alias("rest"), F.greatest(F.lit(1), F.ceil(F.col("docs") / slice_rows)).alias("slices")).filter("budget > 0")
    plan = scratch.save(plan)
    full = rows.join(plan, keys)
    out = [*keys, "id", "n"]
    whole = full.filter("whole > 0").select(*out, F.explode(F.sequence(F.lit(0), (F.col("whole") - 1).cast("int"))).alias("epoch"), F.col("n").alias("taken"))
    last = full.filter("rest > 0").withColumn("epoch", F.col("whole").cast("int")).withColumn("h", seeded("id", F.col("epoch"), seed))
    last = last.withColumn("slice", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") * F.col("slices") / F.lit(float(1 << 32))))
    sums = last.groupBy(*keys, "slice").agg(F.sum("n").alias("size"), F.max("rest").alias("rest"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before).filter("before < rest").select(*keys, "slice", "before")
    inside = Window.partitionBy(*keys, "slice").orderBy("h", "id", "n").rowsBetween(Window.unboundedPreceding, -1)
    last = last.join(sums, [*keys, "slice"]).withColumn("start", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).filter("start < rest")
    last = last.select(*out, "epoch", F.least(F.col("n"), F.col("rest") - F.col("start")).alias("taken"))
    names = [F.col(k).alias(c) for k, c in zip(keys, levels, strict=True)]
    return whole.unionByName(last).select(F.col("id").alias(id_col), *names, F.col("n").alias("n_tokens"), "epoch", F.col("taken").alias("taken_tokens"))


def mix_documents(docs: DataFrame, levels: list[str], weights: Mapping[str, Mapping[str, float]], share: float, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", level_cols: Mapping[str, Column] | None = None) -> DataFrame:
    """docs, whole rows, of one epoch of :func:`mix` over the words of ``text_col``; columns stay as they are.

    Rows that share an id go together: they stay if one of them is taken.  Rows with a null id can't be
    named and are not taken.
    """
    extra = level_cols or {}
    counted = docs.select(F.col(id_col), *((extra[c] if c in extra else F.col(c)).alias(c) for c in levels), word_tokens(text_col).alias("n_tokens"))
    taken = mix(counted.filter(F.col(id_col).isNotNull()), levels, weights, share, 1, seed, id_col)
    return docs.join(taken.select(id_col).distinct(), id_col, "left_semi")


#: The production parameters of op1 and of the pipeline's stage: the hot source by itself, the numbered ones
#: in two groups by the parity of their number.
LEVELS = ["domain", "lang", "source"]
WEIGHTS = {"domain": {"main": 2.0, "even": 1.0, "odd": 1.0}, "lang": {"en": 4.0, "de": 2.0}}


def domain_of_source(source_col: str = "source") -> Column:
    """The domain of a source: src0 is main, others go by the parity of their number; else other."""
    number = F.nullif(F.regexp_extract(F.col(source_col).cast("string"), r"^src(\d{1,9})$", 1), F.lit("")).cast("bigint")
    return F.when(number == 0, "main").when(number % 2 == 0, "even").when(number % 2 == 1, "odd").otherwise("other")


def oracle_sql(share: float, epochs: int, seed: int) -> str:
    """DuckDB SQL for :func:`mix` over ``documents`` with LEVELS, WEIGHTS and words as tokens."""
    case = lambda c: "CASE " + " ".join(f"WHEN {c} = '{v}' THEN {float(w)!r}::DOUBLE" for v, w in WEIGHTS[c].items()) + " ELSE 1.0::DOUBLE END" if WEIGHTS.get(c) else "1.0::DOUBLE"
    number = r"try_cast(nullif(regexp_extract(source, '^src(\d{1,9})$', 1), '') AS BIGINT)"
    ctes = [
        rf"d AS (SELECT doc_id, CASE WHEN {number} = 0 THEN 'main' WHEN {number} % 2 = 0 THEN 'even' WHEN {number} % 2 = 1 THEN 'odd' ELSE 'other' END AS domain, coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents)",
        "t AS (SELECT * FROM d WHERE n > 0)",
        "l AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens FROM t GROUP BY ALL)",
        f"b0 AS (SELECT least(floor(sum(tokens * {epochs}) * {share / epochs!r}::DOUBLE), sum(tokens * {epochs}))::DOUBLE AS budget FROM l)",
    ]
    above: list[str] = []
    for i, level in enumerate(LEVELS, 1):
        here = [*above, level]
        keys, part = ", ".join(here), f"PARTITION BY {', '.join(above)}" if above else ""
        ctes.append(f"c{i} AS (SELECT *, {case(level)} AS weight FROM (SELECT {keys}, sum(tokens * {epochs})::DOUBLE AS supply FROM l GROUP BY ALL) {f'JOIN b{i - 1} USING ({", ".join(above)})' if above else f'JOIN b{i - 1} ON true'})")
        ctes.append(f"f{i} AS (SELECT *, (budget - coalesce(sum(supply) OVER ({part} ORDER BY supply / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER ({part} ORDER BY supply / weight, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lift FROM c{i} WHERE weight > 0)")
        ctes.append(f"b{i} AS (SELECT {keys}, greatest(0, least(supply, weight * max(lift) OVER ({part}))) AS budget FROM f{i})")
        above = here
    ctes += [
        "p AS (SELECT l.*, floor(b3.budget + 1e-6)::BIGINT AS budget FROM l JOIN b3 USING (domain, lang, source))",
        "j AS (SELECT t.*, budget // tokens AS whole, budget % tokens AS rest FROM t JOIN p USING (domain, lang, source) WHERE budget > 0)",
        f"o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws(':', '{seed}', whole::VARCHAR, coalesce(doc_id::VARCHAR, ''))), doc_id NULLS FIRST, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM j WHERE rest > 0)",
    ]
    return "WITH " + ",\n".join(ctes) + """
SELECT doc_id, domain, lang, source, n::BIGINT AS n_tokens, unnest(range(whole))::INTEGER AS epoch, n::BIGINT AS taken_tokens FROM j WHERE whole > 0
UNION ALL
SELECT doc_id, domain, lang, source, n::BIGINT, whole::INTEGER, least(n, rest - start)::BIGINT FROM o WHERE start < rest
"""

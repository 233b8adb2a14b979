"""Ledger views over the given tables: what each of them stands for, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"input": "view", "output": "click", "cache_creation": "signup", "cache_read": "purchase", "reasoning": "error"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ms(df: DataFrame, col: str) -> Column:
    """Epoch milliseconds of a timestamp with or without a zone (without: UTC)."""
    if dict(df.dtypes)[col] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col})")
    return F.unix_millis(col)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as turns: the user is the session, the type the kind and the token class, the value the amount."""
    e = table(spark, sf_dir, "events")
    amount = F.floor(F.col("value") * 100)
    e = e.withColumn("ts_ms", ms(e, "ts"))
    return e.select(
        "event_id", F.col("user_id").cast("string").alias("session_id"), "user_id", "ts", "ts_ms", F.col("event_type").alias("kind"), "props",
        amount.alias("tokens"), amount.alias("cost"), (amount + F.expr("floor(value * 100) div 4")).alias("list_cost"),
        *(F.when(F.col("event_type") == k, amount).otherwise(0).cast("bigint").alias(c) for c, k in KINDS.items()),
        F.concat(F.lit("p"), F.col("event_id") % 3).alias("provider"), F.concat(F.lit("m"), F.col("event_id") % 5).alias("model"),
        F.concat(F.lit("d"), F.col("user_id") % 10).alias("device"), F.concat(F.lit("r"), F.col("user_id") % 20).alias("repo"),
        F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd").alias("day"), F.expr("(ts_ms div 3600000) % 24").alias("hour"),
    )


EVENTS_SQL = (
    "ev AS (SELECT event_id, user_id::VARCHAR AS session_id, user_id, ts, (epoch_us(ts) // 1000) AS ts_ms, event_type AS kind, props, floor(value * 100)::BIGINT AS tokens, floor(value * 100)::BIGINT AS cost, "
    "floor(value * 100)::BIGINT + floor(value * 100)::BIGINT // 4 AS list_cost, "
    + ", ".join(f"CASE WHEN event_type = '{k}' THEN floor(value * 100)::BIGINT ELSE 0 END AS {c}" for c, k in KINDS.items())
    + ", 'p' || (event_id % 3) AS provider, 'm' || (event_id % 5) AS model, 'd' || (user_id % 10) AS device, 'r' || (user_id % 20) AS repo, strftime(ts, '%Y-%m-%d') AS day, ((epoch_us(ts) // 1000) // 3600000) % 24 AS hour FROM events)"
)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a commit log: the customer's nation is the repository, the priority shapes the subject."""
    o, c, n = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    o = o.withColumn("ts_ms", ms(o, "o_orderdate"))
    number = F.col("o_custkey").cast("string")
    p = F.left("o_orderpriority", F.lit(1))
    subject = F.when(p == "1", F.concat(F.lit("Merge pull request #"), number, F.lit(" from topic"))).when(p == "2", F.concat(F.lit("Speed up scan (#"), number, F.lit(")"))).when(p == "3", F.concat(F.lit("Fix bug reported in #"), number)).when(p == "4", F.concat(F.lit("Tidy, closes GH#"), number)).otherwise(F.concat(F.lit("Tidy "), number))
    undone = F.md5(F.concat(F.lit("sha"), (F.col("o_orderkey") - 1).cast("string")).cast("binary"))
    body = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Details\n\nCo-Authored-By: Claude <bot@example.com>"))).when(F.col("o_orderstatus") == "P", F.concat(F.lit("This reverts commit "), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.left(undone, F.lit(7)), F.lit("fffffff"))).otherwise(undone), F.lit("."))).otherwise("We talked about codex at length")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(
        F.concat(F.lit("team/"), F.lower("n_name")).alias("repo"), F.md5(F.concat(F.lit("sha"), F.col("o_orderkey").cast("string")).cast("binary")).alias("sha"), F.col("o_orderkey").alias("position"),
        "ts_ms", F.col("ts_ms").alias("committed_at"), subject.alias("subject"), body.alias("body"), F.col("o_custkey").alias("pr_key"),
    )


COMMITS_SQL = """cm AS (SELECT 'team/' || lower(n_name) AS repo, md5('sha' || o_orderkey) AS sha, o_orderkey AS position, (epoch_us(o_orderdate) // 1000) AS ts_ms, (epoch_us(o_orderdate) // 1000) AS committed_at,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'Merge pull request #' || o_custkey || ' from topic' WHEN '2' THEN 'Speed up scan (#' || o_custkey || ')' WHEN '3' THEN 'Fix bug reported in #' || o_custkey WHEN '4' THEN 'Tidy, closes GH#' || o_custkey ELSE 'Tidy ' || o_custkey END AS subject,
  CASE o_orderstatus WHEN 'F' THEN 'Details' || chr(10) || chr(10) || 'Co-Authored-By: Claude <bot@example.com>' WHEN 'P' THEN 'This reverts commit ' || CASE WHEN o_orderkey % 2 = 0 THEN left(md5('sha' || (o_orderkey - 1)), 7) || 'fffffff' ELSE md5('sha' || (o_orderkey - 1)) END || '.' ELSE 'We talked about codex at length' END AS body, o_custkey AS pr_key
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def work(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Sessions, merged PRs and their files: an order is a session (its lines the files and tokens), a supplier's
    month of shipping a PR, the nation the repository."""
    o, li, c, s = (table(spark, sf_dir, x) for x in ("orders", "lineitem", "customer", "supplier"))
    o, li = o.withColumn("start_ms", ms(o, "o_orderdate")), li.withColumn("ship_ms", ms(li, "l_shipdate")).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz"))
    classes = [F.sum(F.col("l_quantity").cast("bigint")).alias("input"), F.sum(F.floor("l_extendedprice")).alias("output"), F.sum(F.floor(F.col("l_discount") * 100)).alias("cache_creation"), F.sum(F.floor(F.col("l_tax") * 100)).alias("cache_read"), F.sum(F.col("l_linenumber").cast("bigint")).alias("reasoning")]
    lines = li.groupBy("l_orderkey").agg(*classes)
    sessions = o.join(lines, o.o_orderkey == lines.l_orderkey).join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("session_id"), F.col("c_nationkey").alias("repo"), "start_ms", (F.col("start_ms") + 40 * 86_400_000).alias("end_ms"), "input", "output", "cache_creation", "cache_read", "reasoning", F.floor("o_totalprice").alias("active_ms"))
    pr = F.concat(F.col("l_suppkey").cast("string"), F.lit("/"), F.date_format("l_shipdate", "yyyy-MM"))
    shipped = li.join(s, li.l_suppkey == s.s_suppkey).select(pr.alias("pr"), F.col("s_nationkey").alias("repo"), "ship_ms", F.col("l_partkey").alias("path"), "l_suppkey")
    prs = shipped.groupBy("pr", "repo", "l_suppkey").agg(F.max("ship_ms").alias("merged_ms"))
    mentions = li.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("session_id"), pr.alias("pr"), F.when(F.col("l_returnflag") == "A", "git").when(F.col("l_returnflag") == "N", "tool").otherwise("content").alias("source")).distinct()
    return {"sessions": sessions, "session_files": li.select(F.col("l_orderkey").alias("session_id"), (F.col("l_partkey") % 50).alias("path")), "prs": prs, "pr_files": shipped.select("pr", (F.col("path") % 50).alias("path")), "mentions": mentions}


WORK_SQL = """ln AS (SELECT l_orderkey, sum(l_quantity::BIGINT)::BIGINT AS input, sum(floor(l_extendedprice)::BIGINT)::BIGINT AS output, sum(floor(l_discount * 100)::BIGINT)::BIGINT AS cache_creation, sum(floor(l_tax * 100)::BIGINT)::BIGINT AS cache_read, sum(l_linenumber)::BIGINT AS reasoning FROM lineitem GROUP BY 1),
ss AS (SELECT o_orderkey AS session_id, c_nationkey AS repo, (epoch_us(o_orderdate) // 1000) AS start_ms, (epoch_us(o_orderdate) // 1000) + 3456000000 AS end_ms, input, output, cache_creation, cache_read, reasoning, floor(o_totalprice)::BIGINT AS active_ms FROM orders JOIN ln ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey),
sh AS (SELECT l_suppkey || '/' || strftime(l_shipdate, '%Y-%m') AS pr, s_nationkey AS repo, (epoch_us(l_shipdate) // 1000) AS ship_ms, l_partkey % 50 AS path, l_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
pr AS (SELECT pr, repo, l_suppkey, max(ship_ms) AS merged_ms FROM sh GROUP BY ALL),
mn AS (SELECT DISTINCT l_orderkey AS session_id, l_suppkey || '/' || strftime(l_shipdate, '%Y-%m') AS pr, CASE l_returnflag WHEN 'A' THEN 'git' WHEN 'N' THEN 'tool' ELSE 'content' END AS source FROM lineitem WHERE l_linenumber = 1),
sl AS (SELECT session_id, pr, ss.repo, greatest(merged_ms - end_ms, 0) AS gap_ms FROM ss JOIN pr ON ss.repo = pr.repo AND merged_ms BETWEEN start_ms AND end_ms + 1209600000),
fa AS (SELECT DISTINCT l_orderkey AS session_id, l_partkey % 50 AS path FROM lineitem),
fb AS (SELECT DISTINCT pr, path FROM sh),
ia AS (SELECT session_id, pr, count(*) AS inter FROM sl JOIN fa USING (session_id) JOIN fb USING (pr, path) GROUP BY ALL),
ov AS (SELECT sl.*, inter, inter::DOUBLE / (na + nb - inter) AS overlap FROM sl JOIN ia USING (session_id, pr) JOIN (SELECT session_id, count(*) AS na FROM fa GROUP BY 1) USING (session_id) JOIN (SELECT pr, count(*) AS nb FROM fb GROUP BY 1) USING (pr) WHERE inter::DOUBLE / (na + nb - inter) >= 0.15),
la AS (SELECT coalesce(ov.session_id, m.session_id) AS session_id, coalesce(ov.pr, m.pr) AS pr, overlap,
  CASE WHEN overlap IS NOT NULL AND weight IS NOT NULL THEN 1.0 WHEN overlap >= 0.5 THEN 0.9 WHEN overlap IS NOT NULL THEN 0.3::DOUBLE + 0.3::DOUBLE * (overlap / 0.5::DOUBLE) ELSE 0.3 END::DOUBLE AS confidence,
  CASE WHEN overlap IS NOT NULL THEN overlap * CASE WHEN gap_ms <= 0 THEN 1.0 ELSE exp(-gap_ms / (14 * 86400000.0::DOUBLE / -ln(0.3::DOUBLE))) END ELSE 0.15::DOUBLE * weight END AS score
  FROM ov FULL JOIN (SELECT session_id, pr, max(CASE source WHEN 'git' THEN 1.0 WHEN 'tool' THEN 0.8 ELSE 0.6 END)::DOUBLE AS weight FROM mn GROUP BY ALL) m ON ov.session_id = m.session_id AND ov.pr = m.pr)"""

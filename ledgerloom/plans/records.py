"""Registered queries over log lines, batches, frames and references that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import commands, hooks, paths, redact, refs, text, tokens
from ..operators import history, report, sessions, validate
from ..sources import files, logs
from .queries import CM, EV, query
from .views import commits, events, table, turns

# -- log readers: lines made of events and conversations ------------------------------------------------

#: Events in their session's order, with a line number.
LINES = f"{EV}, ln AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, event_id) AS seq FROM ev)"


def event_lines(spark, sf, value) -> DataFrame:
    """(file, seq, byte_offset, value): a line for each event, its session the file."""
    e = events(spark, sf).withColumn("seq", F.row_number().over(Window.partitionBy("session_id").orderBy("ts_ms", "event_id")).cast("bigint"))
    return e.select(F.concat(F.lit("/logs/"), "session_id", F.lit(".jsonl")).alias("file"), "seq", F.col("seq").alias("byte_offset"), value(e).alias("value"))


def as_json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))


def record(**fields: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in fields.items()))


@query("WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), y AS (SELECT doc_id, unnest(l) AS value, generate_subscripts(l, 1) AS seq FROM x) SELECT doc_id AS file, seq, coalesce(sum(strlen(value) + 1) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset, strlen(value)::INTEGER AS bytes FROM y")
def w8_line_sequence(spark, sf):
    """Numbers and byte offsets of all lines; each document is a file."""
    rows = logs.lines_of(table(spark, sf, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("value")))
    return rows.select("file", "seq", "byte_offset", F.octet_length("value").alias("bytes"))


@query(f"""{LINES}, k AS (SELECT *, CASE kind WHEN 'view' THEN 'user' WHEN 'click' THEN 'assistant' WHEN 'signup' THEN 'assistant' ELSE 'other' END AS role FROM ln), s AS (SELECT * FROM k WHERE role <> 'other')
SELECT session_id, seq, role || '_message' AS kind, model, turn_index, CASE WHEN role = 'assistant' THEN tokens END AS output, content, strlen(content)::INTEGER AS content_bytes FROM (
  SELECT session_id, seq, role, tokens, CASE WHEN role = 'user' THEN 'ask ' || event_id ELSE 'did ' || provider || chr(10) || chr(10) || 'and ' || event_id END AS content,
    coalesce(CASE WHEN role = 'assistant' THEN model END, last_value(CASE WHEN role = 'assistant' THEN model END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS model,
    greatest(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) - 1, 0)::BIGINT AS turn_index FROM s)""")
def s1_block_transcript(spark, sf):
    """Content-block lines of events: views ask, clicks and sign-ups answer in two blocks, the rest is skipped."""

    def line(e):
        role = F.when(F.col("kind") == "view", "user").when(F.col("kind").isin("click", "signup"), "assistant").otherwise("progress")
        block = lambda t: record(type=F.lit("text"), text=t)
        answer = F.to_json(F.array(block(F.concat(F.lit("did "), "provider")), block(F.concat(F.lit("and "), F.col("event_id").cast("string")))))
        content = F.when(role == "user", F.concat(F.lit("ask "), F.col("event_id").cast("string"))).otherwise(answer)
        usage = F.when(role == "assistant", record(output_tokens=F.col("tokens")))
        return as_json(type=role, uuid=F.col("event_id").cast("string"), sessionId=F.col("session_id"), timestamp=F.col("day"), message=record(role=role, model=F.when(role == "assistant", F.col("model")), content=content, usage=usage))

    e = logs.block_transcript(event_lines(spark, sf, line), "dev_1")["events"]
    return e.select("session_id", "seq", "kind", "model", F.col("turn_index").cast("bigint").alias("turn_index"), F.col("tokens.output").alias("output"), "content", "content_bytes")


@query(f"{LINES} SELECT session_id, sum(CASE WHEN kind IN ('view', 'click') THEN 1 ELSE 0 END)::BIGINT AS calls, sum(CASE WHEN kind = 'click' THEN 1 ELSE 0 END)::BIGINT AS results FROM ln GROUP BY 1 HAVING sum(CASE WHEN kind IN ('view', 'click') THEN 1 ELSE 0 END) > 0")
def s1_block_calls(spark, sf):
    """Tool calls and results inside the blocks of content-block lines."""

    def line(e):
        use = record(type=F.lit("tool_use"), id=F.col("event_id").cast("string"), name=F.lit("Bash"), input=F.col("props"))
        result = record(type=F.lit("tool_result"), tool_use_id=F.col("event_id").cast("string"), content=F.lit("ok"))
        content = F.when(F.col("kind") == "view", F.to_json(F.array(use))).when(F.col("kind") == "click", F.concat(F.lit("["), F.to_json(use), F.lit(","), F.to_json(result), F.lit("]"))).otherwise("plain")
        return as_json(type=F.lit("assistant"), sessionId=F.col("session_id"), message=record(role=F.lit("assistant"), content=content))

    found = logs.block_transcript(event_lines(spark, sf, line), "dev_1")
    both = found["calls"].select("file", F.lit(1).alias("c"), F.lit(0).alias("r")).unionByName(found["results"].select("file", F.lit(0).alias("c"), F.lit(1).alias("r")))
    return both.groupBy(F.regexp_extract("file", r"([^/]+)\.jsonl$", 1).alias("session_id")).agg(F.sum("c").alias("calls"), F.sum("r").alias("results"))


@query(f"""{LINES}, c AS (SELECT *, sum(tokens // 3) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS total FROM ln), t AS (SELECT * FROM c WHERE kind <> 'error'), d AS (SELECT *, lag(total) OVER (PARTITION BY session_id ORDER BY seq) AS before FROM t)
SELECT session_id, seq, greatest(tokens - tokens // 2, 0)::BIGINT AS input, (tokens // 2)::BIGINT AS cache_read, greatest(tokens // 3 - 1, 0)::BIGINT AS output, 1::BIGINT AS reasoning FROM d WHERE before IS NULL OR before <> total""")
def s2_rollout_tokens(spark, sf):
    """Token counts of rollout logs; a cumulative counter that did not move is the same count again."""

    def line(e):
        total = F.sum(F.expr("tokens div 3")).over(Window.partitionBy("session_id").orderBy("ts_ms", "event_id").rowsBetween(Window.unboundedPreceding, 0))
        last = record(input_tokens=F.col("tokens"), cached_input_tokens=F.expr("tokens div 2"), output_tokens=F.expr("tokens div 3"), reasoning_output_tokens=F.lit(1))
        info = record(last_token_usage=last, total_token_usage=record(input_tokens=total))
        return F.when(F.col("kind") == "error", "{broken").otherwise(as_json(timestamp=F.col("day"), type=F.lit("event_msg"), payload=record(type=F.lit("token_count"), info=info)))

    t = logs.rollout_log(event_lines(spark, sf, line), "dev_1")["tokens"]
    return t.select("session_id", "seq", "input", "cache_read", "output", "reasoning")


@query(f"{LINES}, x AS (SELECT *, last_value(CASE WHEN kind = 'signup' THEN model END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS m FROM ln) SELECT seq, m AS model, 'r' || provider AS role, tokens AS input, greatest(tokens - 4, 0)::BIGINT AS output, 4::BIGINT AS reasoning, split_part('/logs/' || session_id, '/', 3) AS of FROM x WHERE kind <> 'signup'")
def s3_tree_transcript(spark, sf):
    """Tree lines: sign-ups change the model, all other events are messages."""

    def line(e):
        change = F.col("kind") == "signup"
        usage = record(input=F.col("tokens"), output=F.col("tokens"), reasoningTokens=F.lit(4))
        return F.when(change, as_json(type=F.lit("model_change"), id=F.col("event_id").cast("string"), modelId=F.col("model"))).otherwise(as_json(type=F.lit("message"), id=F.col("event_id").cast("string"), message=record(role=F.concat(F.lit("r"), "provider"), usage=usage)))

    t = logs.tree_transcript(event_lines(spark, sf, line), "dev_1")
    return t.select("seq", "model", "role", "input", F.col("output").cast("bigint").alias("output"), "reasoning", F.regexp_extract("file", r"([^/]+)\.jsonl$", 1).alias("of"))


@query(f"{LINES} SELECT session_id, seq, epoch_us(ts) AS us, CASE WHEN event_id % 2 = 0 THEN 'event_' || kind ELSE 'payload_' || kind END AS kind, greatest(tokens - 3, 0)::BIGINT AS input, 3::BIGINT AS cache_read, greatest(tokens - 1, 0)::BIGINT AS output, 1::BIGINT AS reasoning FROM ln WHERE kind <> 'error'")
def s4_record_log(spark, sf):
    """Typed records: the kind from the nested event, else from the payload; the time in microseconds."""

    def line(e):
        usage = record(input_tokens=F.col("tokens"), output_tokens=F.col("tokens"), cached_tokens=F.lit(3), reasoning_tokens=F.lit(1))
        inner = F.when(F.col("event_id") % 2 == 0, record(kind=F.concat(F.lit("event_"), "kind")))
        at = F.unix_micros(F.col("ts").cast("timestamp")) if dict(e.dtypes)["ts"] == "timestamp" else F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
        ok = as_json(id=F.col("event_id").cast("string"), stream=record(id=F.col("session_id")), recorded_at=at, payload=record(kind=F.concat(F.lit("payload_"), "kind"), event=inner, usage=usage))
        return F.when(F.col("kind") == "error", "").otherwise(ok)

    r = logs.record_log(event_lines(spark, sf, line), "dev_1")
    return r.select("session_id", "seq", F.unix_micros("ts").alias("us"), "kind", "input", "cache_read", "output", "reasoning")


@query("WITH b AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations WHERE role IN ('user', 'assistant')) SELECT conv_id, role, n AS seq, greatest(sum(CASE WHEN role = 'user' AND trim(text) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) - 1, 0)::BIGINT AS turn_index FROM b")
def s5_chat_bubbles(spark, sf):
    """Bubbles by time and id; system turns are neither of the two types."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = turns(spark, sf).withColumn("at", F.lpad(at.cast("string"), 8, "0"))
    kind = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(9)
    b = rows.select(F.col("conv_id").alias("composer_id"), F.col("at").alias("bubble_id"), kind.alias("type"), "text", F.col("at").alias("created_at"))
    return logs.chat_bubbles(b).select(F.col("composer_id").alias("conv_id"), "role", F.col("seq").cast("bigint").alias("seq"), F.col("turn_index").cast("bigint").alias("turn_index"))


@query(f"{CM} SELECT position, sha, committed_at::VARCHAR AS committed_at, subject, CASE WHEN position % 3 = 0 THEN '' ELSE body END AS body FROM cm")
def s6_commit_log(spark, sf):
    c = commits(spark, sf)
    parts = ["sha", F.col("committed_at").cast("string"), "subject"]
    value = F.when(F.col("position") % 3 == 0, F.concat_ws(files.FIELD, *parts)).otherwise(F.concat(F.lit("\n"), F.concat_ws(files.FIELD, *parts, "body")))
    return files.commits_of(c.select(F.col("repo").alias("file"), "position", value.alias("value"))).select("position", "sha", "committed_at", "subject", "body")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag <> 'R' THEN l_quantity::BIGINT END AS added, CASE WHEN l_returnflag <> 'R' THEN l_suppkey END AS deleted, 'src/' || l_shipmode_ || '/f' || l_partkey || '.py' AS path FROM (SELECT *, l_linestatus AS l_shipmode_ FROM lineitem) WHERE l_linenumber < 6")
def s7_numstat(spark, sf):
    """Binary files have no counts; lines of two fields are malformed."""
    n = lambda c: F.when(F.col("l_returnflag") != "R", F.col(c).cast("bigint").cast("string")).otherwise("-")
    path = F.concat(F.lit("src/"), "l_linestatus", F.lit("/f"), F.col("l_partkey").cast("string"), F.lit(".py"))
    value = F.when(F.col("l_linenumber") < 6, F.concat_ws("\t", n("l_quantity"), n("l_suppkey"), path)).otherwise(F.concat_ws("\t", n("l_quantity"), path))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", value.alias("value"))
    return files.numstat(rows).select("l_orderkey", "l_linenumber", "l_partkey", "added", "deleted", "path")


@query(f"{EV} SELECT 'c' || event_id AS external_call_id, session_id, day AS ts, CASE WHEN kind = 'error' THEN 'error' ELSE 'success' END AS status FROM ev WHERE event_id % 2 = 0")
def s8_sdk_batches(spark, sf):
    """Batches of a device's day; every second event has a call, which gets its event's session and time."""
    e = events(spark, sf)
    event = record(source_event_id=F.col("event_id").cast("string"), session_id=F.col("session_id"), ts=F.col("day"), kind=F.col("kind"))
    call = F.when(F.col("event_id") % 2 == 0, record(external_call_id=F.concat(F.lit("c"), F.col("event_id").cast("string")), source_event_id=F.col("event_id").cast("string"), status=F.when(F.col("kind") == "error", "error").otherwise("success")))
    raw = e.groupBy("device", "day").agg(F.to_json(F.struct(F.collect_list(event).alias("events"), F.collect_list(call).alias("tool_calls"))).alias("value"))
    parsed = raw.select(F.from_json("value", schema.SDK_BATCH).alias("b")).select("b.*")
    return files.batches_of(parsed)[1].select("external_call_id", "session_id", "ts", "status")


@query("WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos FROM conversations) SELECT conv_id AS request_id, pos, role, length(text)::INTEGER AS chars, CASE WHEN conv_id % 2 = 0 THEN 'm' || turn END AS message_id FROM t")
def s9_web_frames(spark, sf):
    """S9 and X5: conversations as event streams cut into chunks of 100 characters, read by the first rule that
    their address matches."""
    t = turns(spark, sf)
    block = F.concat(F.lit("event: x\r\ndata: "), as_json(who=F.col("role"), body=F.col("text"), id=F.concat(F.lit("m"), F.col("turn").cast("string"))), F.lit("\r\n\r\n"))
    whole = t.groupBy("conv_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", block.alias("b")))), lambda x: x["b"]), ""), F.lit("data: [DONE]\r\n\r\ndata: no json\r\n\r\n")).alias("body"))
    url = F.concat(F.lit("https://chat.example/"), (F.col("conv_id") % 2).cast("string"))
    cuts = F.transform(F.sequence(F.lit(0), F.expr("(length(body) - 1) div 100")), lambda i: F.struct(i.alias("seq"), F.substring("body", i * 100 + 1, F.lit(100)).alias("body")))
    frames = whole.select(F.col("conv_id").alias("request_id"), url.alias("url"), F.explode(cuts).alias("x")).select("request_id", "url", "x.*")
    rules = spark.createDataFrame([(1, "/0$", "$.id", "$.who", "$.body", "$.none"), (2, "chat", "$.none", "$.who", "$.body", "$.none")], "rank int, url_pattern string, id_path string, role_path string, text_path string, model_path string")
    out = files.extracted(files.sse_messages(frames), rules)
    return out.select("request_id", F.col("pos").cast("bigint").alias("pos"), "role", F.length("text").alias("chars"), "message_id")


@query("SELECT CASE c_custkey % 3 WHEN 0 THEN 'installation' WHEN 1 THEN 'identity' ELSE 'handle' END AS kind, CASE WHEN c_custkey % 3 = 0 THEN 'agent-' || c_nationkey END AS agent, CASE WHEN c_custkey % 3 = 0 THEN 'path,bin' END AS via, CASE WHEN c_custkey % 3 = 1 THEN c_name END AS account, CASE WHEN c_custkey % 3 = 2 THEN lower(c_name) END AS handle, c_mktsegment AS seen_at FROM customer WHERE c_custkey % 7 <> 0")
def s10_inventory(spark, sf):
    """Reports of three kinds, a line a customer; a seventh of the lines is cut off."""
    c = table(spark, sf, "customer")
    kind = F.when(F.col("c_custkey") % 3 == 0, "installation").when(F.col("c_custkey") % 3 == 1, "identity").otherwise("handle")
    only = lambda k, x: F.when(F.col("c_custkey") % 3 == k, x)
    value = as_json(kind=kind, agent=only(0, F.concat(F.lit("agent-"), "c_nationkey")), detected_via=only(0, F.array(F.lit("path"), F.lit("bin"))), account=only(1, F.col("c_name")), handle=only(2, F.lower("c_name")), seen_at=F.col("c_mktsegment"), more=F.lit(1))
    lines = c.select(F.when(F.col("c_custkey") % 7 == 0, F.left(value, F.lit(9))).otherwise(value).alias("value"))
    return files.inventory_of(lines).select("kind", "agent", F.array_join("detected_via", ",").alias("via"), "account", "handle", "seen_at")


@query("WITH f AS (SELECT c_custkey AS path, c_nationkey AS len FROM customer) SELECT path FROM f WHERE path % 3 = 0 OR len % 2 = 1")
def s11_changed_files(spark, sf):
    """Customers as files; cursors know two of three, with an odd length one too long."""
    listing = table(spark, sf, "customer").select(F.col("c_custkey").alias("path"), F.col("c_nationkey").alias("length"), F.md5(F.col("c_name").cast("binary")).alias("tail_hash"))
    cursors = listing.filter("path % 3 > 0").withColumn("length", F.col("length") + F.col("length") % 2)
    return files.changed_files(listing, cursors).select("path")


@query(f"{LINES} SELECT event_id FROM ln WHERE user_id % 4 = 0 OR user_id % 4 = 3 OR seq * 100 >= 1000")
def s12_append_floor(spark, sf):
    """Cursors of a quarter of the files are missing, another quarter was cut and is sent whole."""
    e = events(spark, sf).withColumn("at", F.row_number().over(Window.partitionBy("session_id").orderBy("ts_ms", "event_id")) * 100)
    cursors = e.select(F.col("session_id").alias("path"), "user_id").distinct().filter("user_id % 4 > 0").select("path", F.lit(1000).alias("shipped"), F.when(F.col("user_id") % 4 == 3, 10).otherwise(5000).alias("length_now"))
    return files.past_floor(e.select("event_id", F.col("session_id").alias("source_file"), F.col("at").alias("source_byte_offset")), cursors).select("event_id")


@query("SELECT o_orderkey AS path, true AS more FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r <= 40")
def s13_newest_first(spark, sf):
    picked, more = files.newest_first(table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("mtime")), 40)
    return picked.crossJoin(F.broadcast(more)).select("path", F.col("more_pending").alias("more"))  # one row


# -- joins of calls, copies, issues and repositories ----------------------------------------------------


@query(f"{LINES}, k AS (SELECT session_id, user_id, event_id % 7 AS call_id, seq, kind FROM ln WHERE kind IN ('view', 'click', 'error')), n AS (SELECT *, lead(kind) OVER w AS nk, lead(seq) OVER w AS ns FROM k WINDOW w AS (PARTITION BY session_id, call_id ORDER BY seq)) SELECT session_id, call_id, seq AS line, CASE WHEN nk <> 'view' THEN ns END AS ended_line, CASE WHEN nk = 'error' THEN 'error' WHEN nk = 'click' THEN 'success' ELSE 'unknown' END AS status FROM n WHERE kind = 'view'")
def j1_paired_calls(spark, sf):
    """Views open calls; clicks and errors close the latest open one of their id."""
    e = events(spark, sf).withColumn("line", F.row_number().over(Window.partitionBy("session_id").orderBy("ts_ms", "event_id")).cast("bigint"))
    rows = e.select(F.col("session_id").alias("file"), (F.col("event_id") % 7).alias("call_id"), "line", "kind", (F.col("kind") == "error").alias("error"))
    return history.paired_calls(rows.filter("kind = 'view'"), rows.filter("kind in ('click', 'error')")).withColumnRenamed("file", "session_id")


@query("WITH l AS (SELECT l_orderkey % 50 AS f, CASE WHEN l_linenumber < 3 THEN l_orderkey % 50 ELSE l_suppkey END AS s, l_partkey AS u FROM lineitem), g AS (SELECT * FROM l WHERE s = f OR s NOT IN (SELECT f FROM l)) SELECT DISTINCT u AS uuid FROM g")
def j9_resume_copies(spark, sf):
    """Lines copied from a session that has a file of its own are dropped; a line counts once."""
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 50).alias("file_session"), F.when(F.col("l_linenumber") < 3, F.col("l_orderkey") % 50).otherwise(F.col("l_suppkey")).alias("session_id"), F.col("l_partkey").alias("uuid"))
    return history.resume_copies_dropped(rows).select("uuid")


@query("WITH x AS (SELECT c_nationkey AS session_id, c_custkey AS n FROM customer) SELECT session_id, p AS provider, n::VARCHAR AS key FROM x, (SELECT unnest(['github', 'linear']) AS p) WHERE NOT (p = 'github' AND n % 3 = 0)")
def j12_issues_that_are_prs(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("session_id"), F.col("c_custkey").alias("n"))
    issues = c.select("session_id", F.explode(F.array(F.lit("github"), F.lit("linear"))).alias("provider"), F.lit("Acme/Web").alias("slug"), F.col("n").cast("string").alias("key"))
    prs = c.filter("n % 3 = 0").select("session_id", F.lit("acme/web").alias("slug"), F.col("n").alias("number"))
    return refs.drop_issues_that_are_prs(issues, prs).select("session_id", "provider", "key")


@query("WITH x AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, p_size FROM part) SELECT p_partkey AS event_id, CASE WHEN p_size % 3 = 0 THEN 'deep' ELSE 'flat' END AS repo FROM x WHERE p_size % 5 > 0")
def j15_repository_of_event(spark, sf):
    """The longest root wins; a first candidate outside all roots leaves it to the second."""
    p = table(spark, sf, "part")
    a, b = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    inside = F.concat(F.lit("/w/"), F.when(F.col("p_size") % 3 == 0, "deep/sub/").otherwise("flat/"), a, F.lit("/"), b)
    rows = p.select(F.col("p_partkey").alias("event_id"), F.when(F.col("p_size") % 5 > 0, F.array(F.concat(F.lit("/tmp/"), a), inside)).otherwise(F.array(F.concat(F.lit("/etc/"), b))).alias("candidates"))
    roots = spark.createDataFrame([("/w/flat", "flat"), ("/w/deep", "outer"), ("/w/deep/sub", "deep")], "root string, repo string")
    return history.repository_of(rows, roots)


# -- redaction ----------------------------------------------------------------------------------------


@query(f"{EV} SELECT event_id, '[REDACTED:ticket] and ' || CASE WHEN kind = 'view' THEN '[REDACTED:ghost]' ELSE kind END AS redacted, (CASE WHEN kind = 'view' THEN 2 ELSE 1 END)::INTEGER AS hits FROM ev")
def f3_policy_rules(spark, sf):
    """Rules of a policy add to the floor; one with a bad pattern and one with a bad name are left out."""
    e = events(spark, sf).select("event_id", F.concat(F.lit("TCK-"), F.col("event_id").cast("string"), F.lit(" and "), "kind").alias("t"))
    rules = [("ticket", r"tck-[0-9]+", "i"), ("ghost", r"\bview\b"), ("broken", "(("), ("Bad Name", "and")]
    return redact.redact_floor(e, "t", "redacted", "hits", rules).select("event_id", "redacted", "hits")


@query("SELECT c_custkey, 'run [REDACTED:hash] now ' || CASE WHEN c_custkey % 2 = 0 THEN '[REDACTED:hash]' ELSE 'CUSTOMER_NAME_IN_CAPITALS_0123456789' END AS redacted, (CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END)::BIGINT AS n FROM customer")
def f4_entropy(spark, sf):
    """Hexadecimal runs are hashes; long names in capitals are not secrets."""
    h = lambda f: F.sha2(F.col("c_name").cast("binary"), f)
    t = F.concat(F.lit("run "), h(256), F.lit(" now "), F.when(F.col("c_custkey") % 2 == 0, h(224)).otherwise("CUSTOMER_NAME_IN_CAPITALS_0123456789"))
    x = table(spark, sf, "customer").select("c_custkey", redact.entropy_pass(t).alias("e"))
    return x.select("c_custkey", F.col("e.text").alias("redacted"), F.col("e.n").alias("n"))


@query("SELECT p_partkey, 'open ' || CASE p_size % 3 WHEN 0 THEN './' || p_brand || '.py' ELSE '[REDACTED:abs-path]' END || ' and /opt/x' AS redacted, (CASE p_size % 3 WHEN 0 THEN 0 ELSE 1 END)::INTEGER AS n FROM part")
def f6_home_paths(spark, sf):
    """Home paths of three systems; one inside the repository becomes relative and does not count."""
    where = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("/home/u/repo/"), "p_brand", F.lit(".py"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("/Users/me/"), "p_brand")).otherwise(F.concat(F.lit("C:\\Users\\me\\"), "p_brand"))
    x = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("open "), where, F.lit(" and /opt/x")).alias("t"))
    return redact.redact(x, "t", "redacted", "/home/u/repo").select("p_partkey", "redacted", F.col("paths_redacted").alias("n"))


@query("SELECT c_custkey, 'API_KEY=<REDACTED:env_secret> Bearer <REDACTED:bearer> postgres://<user>:<REDACTED:db_password>@h' AS redacted, 3 AS n FROM customer")
def f7_sdk_templates(spark, sf):
    """The SDK's replacements keep what stands around the secret."""
    key = F.sha2(F.col("c_name").cast("binary"), 256)
    t = F.concat(F.lit("API_KEY="), F.left(key, F.lit(14)), F.lit(" Bearer "), F.left(key, F.lit(24)), F.lit(" postgres://"), F.lower("c_mktsegment"), F.lit(":pw"), F.col("c_custkey").cast("string"), F.lit("@h"))
    return redact.redact_floor(table(spark, sf, "customer").select("c_custkey", t.alias("t")), "t", "redacted", "n", sdk=True).select("c_custkey", "redacted", "n")


F8_SQL = r"""WITH t AS (SELECT conv_id, turn, text, 3 + turn % 4 AS a, 12 + conv_id % 5 AS b FROM conversations WHERE length(text) > 20),
s AS (SELECT *, a - length(regexp_extract(left(text, a), '[\p{L}\p{N}]*$')) AS s1, a + 3 + length(regexp_extract(substr(text, a + 4), '^[\p{L}\p{N}]*')) AS e1,
 b - length(regexp_extract(left(text, b), '[\p{L}\p{N}]*$')) AS s2, b + 1 + length(regexp_extract(substr(text, b + 2), '^[\p{L}\p{N}]*')) AS e2 FROM t)
SELECT conv_id, turn, CASE WHEN s2 <= e1 THEN left(text, s1) || '[REDACTED:PER]' || substr(text, greatest(e1, e2) + 1)
 ELSE left(text, s1) || '[REDACTED:PER]' || substr(text, e1 + 1, s2 - e1) || '[REDACTED:ORG]' || substr(text, e2 + 1) END AS spliced,
 1::BIGINT AS people, CASE WHEN s2 <= e1 THEN 0 ELSE 1 END::BIGINT AS groups FROM s"""


def tagged(*tokens) -> F.Column:
    return F.array(*(F.struct(F.lit(e).alias("entity"), (w if w is not None else F.lit("x")).alias("word"), a.cast("int").alias("start"), b.cast("int").alias("end")) for e, w, a, b in tokens))


@query(F8_SQL)
def f8_entity_spans(spark, sf):
    """Tokens on parts of words, at places that follow the row: whole words go, and spans that meet are one."""
    t = turns(spark, sf).filter(F.length("text") > 20).withColumn("a", 3 + F.col("turn") % 4).withColumn("b", 12 + F.col("conv_id") % 5)
    a, b = F.col("a"), F.col("b")
    x = t.withColumn("x", redact.redact_entities(F.col("text"), tagged(("B-PER", None, a, a + 2), ("I-PER", None, a + 2, a + 3), ("S-org", None, b, b + 1), ("O", None, a, b))))
    count = lambda k: F.coalesce(F.col("x.counts")[k], F.lit(0)).cast("bigint")
    return x.select("conv_id", "turn", F.col("x.text").alias("spliced"), count("pf_per").alias("people"), count("pf_org").alias("groups"))


@query("SELECT c_custkey, '[REDACTED:PER], (' || c_mktsegment || 's) of [REDACTED:ORG] and [REDACTED:UNIT]-x' AS redacted, 1::BIGINT AS people, 1::BIGINT AS groups, 1::BIGINT AS units FROM customer WHERE length(c_name) >= 8")
def f8_entity_surfaces(spark, sf):
    """Tokens without places: word pieces are put together, longer names go first, pieces of longer words stay."""
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    text = F.concat(name, F.lit(", ("), segment, F.lit("s) of "), segment, F.lit(" desk and "), segment, F.lit("-x"))
    none = F.lit(None)
    words = [("B-PER", F.left(name, F.lit(4)), none, none), ("I-PER", F.concat(F.lit("##"), F.substring(name, F.lit(5), F.length(name))), none, none), ("B-UNIT", segment, none, none), ("B-ORG", segment, none, none), ("I-ORG", F.lit("desk"), none, none)]
    x = table(spark, sf, "customer").filter(F.length("c_name") >= 8).withColumn("x", redact.redact_entities(text, tagged(*words)))
    return x.select("c_custkey", F.col("x.text").alias("redacted"), *(F.col("x.counts")[k].alias(c) for k, c in (("pf_per", "people"), ("pf_org", "groups"), ("pf_unit", "units"))))


@query("SELECT c_custkey, 'key [REDACTED:llm] for ' || c_mktsegment || ' and [REDACTED:llm]' AS redacted, 2 AS n FROM customer WHERE length(c_name) >= 8")
def f10_candidates(spark, sf):
    """Candidates of a reply: quoted, short, safe and repeated lines; they are cut out, the longest first."""
    reply = F.concat(F.lit("\""), "c_name", F.lit("\"\nNONE\nshort\n"), "c_name", F.lit("\n"), "c_name", F.lit("-long\n"), "c_mktsegment")
    safe = ["automobile", "building", "furniture", "household", "machinery"]
    t = F.concat(F.lit("key "), "c_name", F.lit(" for "), "c_mktsegment", F.lit(" and "), "c_name", F.lit("-long"))
    x = table(spark, sf, "customer").filter(F.length("c_name") >= 8).select("c_custkey", redact.without_candidates(t, redact.reply_candidates(reply, safe)).alias("x"))
    return x.select("c_custkey", F.col("x.text").alias("redacted"), F.col("x.n").alias("n"))


@query(f"{EV}, x AS (SELECT session_id, kind, count(*) AS n FROM ev GROUP BY ALL) SELECT session_id, kind, n + CASE WHEN kind < 'f' THEN 2 * n ELSE 0 END AS n FROM x WHERE n > 0")
def a21_redaction_counts(spark, sf):
    """Counts of the floor and of the model's pf_ names added by name; zeros go."""
    n = events(spark, sf).groupBy("session_id", "kind").agg(F.count("*").alias("n"))
    maps = n.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("floor"), F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("pf_"), "kind"), F.when(F.col("kind") < "f", F.col("n") * 2).otherwise(0).cast("bigint")))).alias("model"))
    return maps.select("session_id", F.explode(redact.count_merge(F.col("floor"), F.col("model"))).alias("kind", "n"))


# -- references, commands, paths --------------------------------------------------------------------------


@query("SELECT c_custkey, 1 AS repos, 'Acme/Web' AS repo, (CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END) AS prs, (CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END) AS issues, CASE WHEN c_custkey % 2 = 0 THEN false END AS ambiguous FROM customer")
def f12_event_references(spark, sf):
    """Repositories, pull requests and issues of a text: another case is the same repository, a URL settles a
    shorthand, and an issue that is a pull request goes."""
    n, m = (F.col("c_custkey") + 1).cast("string"), (F.col("c_custkey") + 2).cast("string")
    t = F.concat(F.lit("https://github.com/Acme/Web/pull/"), n, F.lit(" https://github.com/acme/web/pull/"), n, F.lit(" acme/web#"), n, F.lit(" acme/web#"), m, F.lit(" https://linear.app/a/issue/ENG-7 "), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("https://github.com/acme/web/issues/"), m)).otherwise(F.concat(F.lit("https://github.com/ACME/web/pull/"), m)))
    e = table(spark, sf, "customer").select("c_custkey", refs.event_references(t).alias("e"))
    shorthand = F.try_element_at(F.filter("e.issues", lambda r: r["provider"] == "github"), F.lit(1))
    return e.select("c_custkey", F.size("e.repos").alias("repos"), F.col("e.repos")[0]["slug"].alias("repo"), F.size("e.pull_requests").alias("prs"), F.size("e.issues").alias("issues"), shorthand["ambiguous"].alias("ambiguous"))


@query("SELECT s_suppkey, 'team/' || s_name AS slug, CASE WHEN s_nationkey % 2 = 0 THEN 'git' ELSE 'git_guess' END AS source, (CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END) AS branches FROM supplier WHERE s_suppkey % 5 > 0")
def f14_repo_of_git(spark, sf):
    s = table(spark, sf, "supplier")
    repo = refs.repo_of_git(F.when(F.col("s_suppkey") % 5 > 0, F.concat(F.lit("team/"), "s_name")), F.when(F.col("s_suppkey") % 3 > 0, "main"), F.when(F.col("s_nationkey") % 2 == 0, "git_remote").otherwise("cwd"), F.lit(None).cast("string"))
    return s.select("s_suppkey", repo.alias("r")).filter("r is not null").select("s_suppkey", "r.slug", "r.source", F.size("r.branches").alias("branches"))


@query("SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'mcp' WHEN c_nationkey % 3 = 1 THEN 'shell' ELSE 'builtin' END AS surface, left(c_name, 8) AS input, length(c_name) > 8 AS input_truncated FROM customer")
def f23_tool_action(spark, sf):
    observed = F.when(F.col("c_nationkey") % 3 == 0, "mcp__web__get").otherwise("Bash")
    a = commands.tool_action(observed, F.when(F.col("c_nationkey") % 3 == 1, F.concat(F.lit("ls "), "c_name")), F.col("c_name"), 8)
    return table(spark, sf, "customer").select("c_custkey", a.alias("a")).select("c_custkey", "a.surface", "a.input", "a.input_truncated")


@query("SELECT l_orderkey, sum(CASE l_returnflag WHEN 'A' THEN 10 WHEN 'N' THEN 8 ELSE 6 END)::BIGINT AS confidence FROM lineitem GROUP BY 1")
def f30_source_weight(spark, sf):
    source = F.when(F.col("l_returnflag") == "A", "git").when(F.col("l_returnflag") == "N", "tool").otherwise("content")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round(tokens.source_confidence(source) * 10).cast("bigint")).alias("confidence"))


@query("SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN 'Prod' WHEN 1 THEN 'Staging' WHEN 2 THEN 'Dev' END AS environment FROM orders")
def f55_environment(spark, sf):
    """Exact names and directories only: releases-notes and devotion are none."""
    names = {0: ["main", "Release/1"], 1: ["staging", "STAGING/x"], 2: ["develop", "dev/y"], 3: ["releases-notes", "devotion"]}
    branch = F.lit(None).cast("string")
    for k, (a, b) in names.items():
        branch = F.when(F.col("o_custkey") % 4 == k, F.when(F.col("o_orderkey") % 2 == 0, a).otherwise(b)).otherwise(branch)
    return table(spark, sf, "orders").select("o_orderkey", paths.environment(branch).alias("environment"))


@query("SELECT p_partkey, unnest(['src/' || p_brand || '.py', 'deep/' || p_size]) AS path FROM part")
def p4_argument_paths(spark, sf):
    """Path-shaped strings at any depth and in arrays, once each."""
    deep = record(a=record(b=record(c=record(d=F.array(record(e=F.concat(F.lit(" deep/"), F.col("p_size").cast("string"))))))))
    args = as_json(file=F.concat(F.lit("src/"), "p_brand", F.lit(".py")), more=deep, again=F.array(F.concat(F.lit("src/"), "p_brand", F.lit(".py"))), url=F.lit("https://x/y"), cmd=F.lit("git -C a/b status"), n=F.col("p_size"))
    return table(spark, sf, "part").select("p_partkey", F.explode(validate.argument_paths(args)).alias("path"))


@query("SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN c_custkey % 2 = 1 WHEN 1 THEN c_custkey >= 1 WHEN 2 THEN length(c_name) <= 18 AND c_custkey >= 1 ELSE c_custkey > 3 END AS valid FROM customer")
def p9_valid_references(spark, sf):
    """A pull request without a repository is valid, an issue without a key and a repository without a slug are not."""
    k = F.col("c_nationkey") % 4
    kind = F.when(k == 0, "issue").when(k == 3, "repo").otherwise("pr")
    none = F.lit(None).cast("string")
    slug = F.when(k == 2, F.when(F.length("c_name") <= 18, "a/b").otherwise(F.repeat("c_name", 40))).when((k == 3) & (F.col("c_custkey") > 3), "a/b")
    url = F.when(k == 0, "u")
    return table(spark, sf, "customer").select("c_custkey", refs.valid_reference(kind, slug, F.col("c_custkey"), url, none, F.lit("jira"), F.when((k != 0) | (F.col("c_custkey") % 2 == 1), "K-1")).alias("valid"))


@query("SELECT s_suppkey, s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 AS verified FROM supplier")
def p10_verified_slug(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", paths.verified_slug(F.when(F.col("s_suppkey") % 2 == 0, "git_remote").otherwise("cwd"), F.when(F.col("s_suppkey") % 3 == 0, "https://h/a/b")).alias("verified"))


# -- text, time and usage -----------------------------------------------------------------------------------


@query(f"{EV} SELECT event_id, CASE WHEN kind <> 'error' THEN ts_ms // 1000 * 1000 - 19800000 END AS ms FROM ev")
def f36_instants(spark, sf):
    """Instants with an offset; without one a text is no instant."""
    t = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss")
    return events(spark, sf).select("event_id", text.instant_ms(F.concat(t, F.when(F.col("kind") != "error", "+05:30").otherwise(""))).alias("ms"))


@query("SELECT p_partkey, nullif(trim(p_name) || chr(10) || chr(10) || p_brand, '') AS content, p_type AS thinking FROM part")
def f40_content_text(spark, sf):
    block = lambda k, t, h: F.struct(F.lit(k).alias("type"), t.alias("text"), h.alias("thinking"))
    none = F.lit(None).cast("string")
    blocks = F.array(block("text", F.concat(F.lit("  "), "p_name"), none), block("thinking", none, F.col("p_type")), block("text", F.col("p_brand"), none))
    return table(spark, sf, "part").select("p_partkey", text.content_text(blocks, "text").alias("content"), text.content_text(blocks, "thinking").alias("thinking"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber > 3 THEN l_partkey ELSE l_suppkey END AS input, l_suppkey AS output, CASE WHEN l_linenumber < 6 THEN l_partkey END AS cache_read FROM lineitem")
def f42_usage_merge(spark, sf):
    """The newer value of each field, prompt and completion under their other names."""
    n = F.col("l_linenumber")
    merged = text.usage_merge({"prompt": F.col("l_suppkey"), "output": F.col("l_suppkey"), "cache_read": F.when(n < 6, F.col("l_partkey"))}, {"input": F.when(n > 3, F.col("l_partkey"))})
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(merged[c].alias(c) for c in ("input", "output", "cache_read")))


@query("SELECT c_custkey, unnest(['a', 'b', 'c']) AS key, unnest([c_name, c_mktsegment, 'config']) AS value FROM customer")
def f46_metadata_layers(spark, sf):
    """Of three layers the call wins over the ambient one, that over the configuration."""
    m = lambda **kv: F.create_map(*(x for k, v in kv.items() for x in (F.lit(k), v)))
    layers = text.capped_metadata(m(a=F.lit("x"), b=F.lit("y"), c=F.lit("config")), m(a=F.lit("z"), b=F.col("c_mktsegment")), m(a=F.col("c_name")))
    return table(spark, sf, "customer").select("c_custkey", F.explode(layers).alias("key", "value"))


@query("SELECT event_id, '{\"k\": ' || (props->>'k') || ', \"s\": \"}\"}' AS found FROM events")
def f48_first_json(spark, sf):
    """The first complete object after an open brace that is none; braces in texts don't end it."""
    t = F.concat(F.lit('so {not json, then {"k": '), F.get_json_object("props", "$.k"), F.lit(', "s": "}"} and {"z": 1}'))
    return table(spark, sf, "events").select("event_id", text.first_json_object(t).alias("found"))


@query(f"""{EV}, x AS (SELECT session_id, kind, count(*) AS n FROM ev GROUP BY ALL), t AS (SELECT session_id, sum(n) AS total FROM x GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, kind) AS rn FROM x)
SELECT session_id, 'tool_calls' AS root_key, kind AS name, greatest(0.05::DOUBLE, least(1.0::DOUBLE, round(n::DOUBLE / total, 2))) AS confidence, NULL::VARCHAR AS reason FROM r JOIN t USING (session_id) WHERE rn <= 8
UNION ALL SELECT session_id, 'agents', 'a1', 1.0, NULL FROM t UNION ALL SELECT session_id, 'projects', 'repo' || session_id, CASE WHEN session_id::BIGINT % 2 = 0 THEN 1.0 ELSE 0.5 END, CASE WHEN session_id::BIGINT % 2 = 0 THEN 'git_remote' ELSE 'cwd' END FROM t
UNION ALL SELECT session_id, 'mood', 'Curious', 0.7, NULL FROM t UNION ALL SELECT session_id, 'components', 'api', 0.6, NULL FROM t""")
def f54_segment_tags(spark, sf):
    """Tags with reason, mood and the tool mix; the model and the cadence are unknown."""
    n = events(spark, sf).groupBy("session_id", "kind").agg(F.count("*").alias("n")).groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("tools"))
    none, even = F.lit(None).cast("string"), F.col("session_id").cast("bigint") % 2 == 0
    tags = text.segment_tags(F.lit("a1"), none, none, F.concat(F.lit("repo"), "session_id"), even, F.array(F.lit("api")), none, none, F.when(even, "git_remote").otherwise("cwd"), F.array(F.lit("curious"), F.lit("calm")), F.array().cast("array<string>"), None, F.col("tools"))
    return n.select("session_id", F.explode(tags).alias("t")).select("session_id", "t.*")


# -- batches, limits, unions, caches --------------------------------------------------------------------------

W18_SQL = f"""WITH RECURSIVE {LINES.removeprefix("WITH ")}, d AS (SELECT event_id, device, tokens AS c, row_number() OVER (PARTITION BY device ORDER BY ts_ms, event_id) AS rn FROM ev),
w AS (SELECT device, event_id, rn, c AS total, 1 AS n, 0 AS batch FROM d WHERE rn = 1
  UNION ALL SELECT d.device, d.event_id, d.rn, CASE WHEN w.n >= 60 OR w.total + d.c > 2500 THEN d.c ELSE w.total + d.c END, CASE WHEN w.n >= 60 OR w.total + d.c > 2500 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n >= 60 OR w.total + d.c > 2500 THEN w.batch + 1 ELSE w.batch END FROM w JOIN d ON d.device = w.device AND d.rn = w.rn + 1)
SELECT event_id, batch::BIGINT AS batch FROM w"""


@query(W18_SQL)
def w18_batches_by_calls(spark, sf):
    """Batches end at 60 events or before 2,500 calls are passed; both limits restart with each."""
    e = events(spark, sf).select("event_id", "device", "ts_ms", "tokens")
    return sessions.packed_batches(e, ["device"], ["ts_ms", "event_id"], 60, "tokens", 2500).select("event_id", "batch")


@query(f"{EV}, g AS (SELECT session_id, sum(tokens)::BIGINT AS tokens, sum(cost)::BIGINT AS cost FROM ev GROUP BY 1) SELECT 'row' AS level, session_id, tokens, cost FROM (SELECT *, row_number() OVER (ORDER BY tokens DESC, session_id) AS r FROM g) WHERE r <= 12 UNION ALL SELECT 'total', NULL, sum(tokens)::BIGINT, sum(cost)::BIGINT FROM g")
def l3_limit_after_rollup(spark, sf):
    """Twelve rows and the total of all."""
    g = events(spark, sf).groupBy("session_id").agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))
    return report.limited(g, "tokens", "session_id", ["tokens", "cost"], 12)


@query("SELECT 0 AS channel, o_orderkey AS key, o_orderstatus AS source FROM orders UNION ALL SELECT 1, l_orderkey, NULL FROM lineitem")
def u1_channel_union(spark, sf):
    """Channels of different columns as one table with their rank."""
    one = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("source"))
    return refs.union_channels([one, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"))]).select("channel", "key", "source")


@query(f"{EV}, f AS (SELECT session_id, model, min(ts_ms * 1000000 + event_id) AS pos FROM ev GROUP BY ALL) SELECT session_id, string_agg(model, ',' ORDER BY pos) AS models FROM f GROUP BY 1")
def u2_ordered_distinct(spark, sf):
    """Distinct models in the order of first sight."""
    e = events(spark, sf).withColumn("seen", F.array("model"))
    return history.inventory(e, ["session_id"], ["ts_ms", "event_id"], [], "seen").select("session_id", F.array_join("seen", ",").alias("models"))


@query("WITH d AS (SELECT DISTINCT text FROM conversations) SELECT count(*) AS texts, sum(length(text))::BIGINT AS answers, sum(CASE WHEN length(text) % 2 = 1 THEN 1 ELSE 0 END)::BIGINT AS asked FROM d WHERE text IS NOT NULL")
def x4_answer_cache(spark, sf):
    """Only texts that the cache lacks are asked; here it has those of even length."""
    texts = turns(spark, sf).select("text").filter("text is not null").distinct()
    key = F.sha2(F.concat_ws("\x1f", F.lit("v1"), "text").cast("binary"), 256)
    cache = texts.filter(F.length("text") % 2 == 0).select(key.alias("key"), F.length("text").alias("answer"))
    answers, new = hooks.cached_answers(texts, cache, "v1", lambda t: t.select("text", F.length("text").alias("answer")))
    return answers.agg(F.count("*").alias("texts"), F.sum("answer").alias("answers")).crossJoin(new.agg(F.count("*").alias("asked")))  # one row each


@query("SELECT conv_id, turn, length(text)::BIGINT AS answer FROM conversations WHERE length(text) % 3 > 0")
def t8_held_answers(spark, sf):
    """X1 and T8: a model that could not answer holds its row; held rows are not passed on."""
    asked = hooks.with_model(turns(spark, sf), "text", "answer", "bigint", lambda ts: [len(t) if len(t) % 3 else None for t in ts])
    return validate.held(asked, "answer")[0].select("conv_id", "turn", "answer")


@query(f"{EV} SELECT DISTINCT event_id // 3 AS key FROM ev")
def t4_replay_dedupe(spark, sf):
    """A batch run of the stream's plan: of replayed rows one stays."""
    from ..streaming.flows import deduped

    e = events(spark, sf).select(F.expr("event_id div 3").alias("key"), F.timestamp_millis("ts_ms").alias("ts"))
    return deduped(e, "key", "ts", "3650 days").select("key")


@query(f"{EV}, l AS (SELECT event_id % 400 AS k, max(event_id) AS e FROM ev WHERE event_id % 2 = 0 GROUP BY 1), o AS (SELECT event_id % 400 AS k, max(event_id) AS e FROM ev WHERE event_id % 2 = 1 AND event_id % 400 > 100 GROUP BY 1) SELECT coalesce(l.k, o.k) AS k, coalesce(l.e, o.e) AS event_id FROM o FULL JOIN l ON o.k = l.k")
def k1_upsert(spark, sf):
    """The new rows in place of those with their key; all others stay."""
    e = events(spark, sf).withColumn("k", F.col("event_id") % 400)
    latest = lambda of: of.groupBy("k").agg(F.max("event_id").alias("event_id"))
    return history.upsert(latest(e.filter("event_id % 2 = 1 and k > 100")), latest(e.filter("event_id % 2 = 0")), "k")

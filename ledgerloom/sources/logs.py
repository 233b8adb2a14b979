"""Session-log sources: lines with their file, number and byte offset, and five readers over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.ids import file_event_id, line_event_id, record_event_id, stated_event_id, turn_event_id
from ..functions.text import content_text
from ..functions.tokens import disjoint_usage
from ..operators.sessions import carried, drop_repeats, ordinal, turn_index


def lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """(file, seq, byte_offset, value): all physical lines of the files, numbered from 1 in file order.

    A large file is read by byte ranges, each a task that starts at the first line that begins there; its lines are
    numbered and their bytes summed up in the range, and the ranges before it, of which a file has few, are added.  A
    line's offset counts the bytes before it and the line ends between.  An empty piece after the last line end is no
    line.  A stream cannot sum up over ranges, so there a file is one row while it is cut.
    """
    if streaming:
        return lines_of(spark.readStream.schema("value string").option("wholetext", "true").format("text").load(path).select(F.col("_metadata.file_path").alias("file"), "value"), True)
    own = Window.partitionBy("file", "range_").orderBy("at_")
    bytes_ = (F.octet_length("value") + 1).cast("bigint")
    rows = ranged(spark, path).withColumn("n_", F.row_number().over(own)).withColumn("before_", F.coalesce(F.sum(bytes_).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sizes = ranged(spark, path).groupBy("file", "range_").agg(F.count("*").alias("lines_"), F.sum(bytes_).alias("bytes_"))
    earlier = Window.partitionBy("file").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("file", "range_", F.coalesce(F.sum("lines_").over(earlier), F.lit(0)).alias("lines_"), F.coalesce(F.sum("bytes_").over(earlier), F.lit(0)).alias("bytes_"))
    return rows.join(base, ["file", "range_"]).select("file", (F.col("n_") + F.col("lines_")).cast("bigint").alias("seq"), (F.col("before_") + F.col("bytes_")).cast("bigint").alias("byte_offset"), "value")


def ranged(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, range_, at_, value): lines with the start of the byte range that read them, in order by at_."""
    raw = spark.read.option("lineSep", "\n").text(path)
    m = F.col("_metadata")
    return raw.select(m["file_path"].alias("file"), m["file_size"].alias("size"), m["file_block_start"].alias("range_"), F.monotonically_increasing_id().alias("at_"), "value")


TAIL_BYTES = 4096


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, tail_hash) of the files with a line: the size, and 16 hex digits of the SHA-1 of the last 4,096 bytes.

    Each byte range gives the end of what it read, at most 4,096 bytes, so the lines stay where they are.
    """
    size = F.col("size")
    part = ranged(spark, path).withColumn("bytes_", (F.octet_length("value") + 1).cast("bigint"))
    after = F.coalesce(F.sum("bytes_").over(Window.partitionBy("file", "range_").orderBy(F.desc("at_")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = part.withColumn("after_", after).filter(F.col("after_") < TAIL_BYTES)
    ends = last.groupBy("file", "size", "range_").agg(F.array_sort(F.collect_list(F.struct("at_", F.expr(f"substring(cast(value as binary), -{TAIL_BYTES})").alias("v")))).alias("x"))
    joined = F.aggregate("x", F.lit(b""), lambda a, x: F.concat(a, x["v"], F.lit(b"\n")))
    ends = ends.select("file", "size", "range_", joined.alias("end_"))
    total = part.groupBy("file").agg(F.sum("bytes_").alias("bytes_"))
    nth = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("range_")))
    few = ends.withColumn("nth_", nth).filter(f"nth_ <= {TAIL_BYTES}").groupBy("file", "size").agg(F.array_sort(F.collect_list(F.struct("range_", "end_"))).alias("x"))
    whole = F.aggregate("x", F.lit(b""), lambda a, x: F.concat(a, x["end_"]))
    #: A file without a line end at its end has a byte less than its lines.
    text = few.join(total, "file").withColumn("raw_", whole).withColumn("raw_", F.when(F.col("bytes_") > size, F.expr("substring(raw_, 1, octet_length(raw_) - 1)")).otherwise(F.col("raw_")))
    return text.select(F.col("file").alias("path"), size.alias("length"), F.left(F.sha1(F.expr(f"substring(raw_, -{TAIL_BYTES})")), F.lit(16)).alias("tail_hash"))


def lines_of(files: DataFrame, streaming: bool = False) -> DataFrame:
    """:func:`lines` of files (file, value) that are read already.

    Offsets are running sums of the lines' bytes: a window over a file's lines, linear in them.  A stream
    knows no such window; there a file's offsets are summed up inside its row.
    """
    cut = F.split("value", "\n")
    if streaming:
        sizes = F.transform(cut, lambda v: (F.octet_length(v) + 1).cast("bigint"))
        offset = lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0).cast("bigint"), lambda s, n: s + n)
        rows = files.select("file", F.explode(F.transform(cut, lambda v, i: F.struct((i + 1).cast("bigint").alias("seq"), offset(i).alias("byte_offset"), v.alias("value")))).alias("l"))
        return rows.select("file", "l.*")
    rows = files.select("file", F.posexplode(cut).alias("pos", "value"))
    before = F.sum((F.octet_length("value") + 1).cast("bigint")).over(Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("file", (F.col("pos") + 1).cast("bigint").alias("seq"), F.coalesce(before, F.lit(0).cast("bigint")).alias("byte_offset"), "value")


def parsed(rows: DataFrame, ddl: str) -> DataFrame:
    """rows with ``j``; null for blank lines and bad JSON, which are skipped and never fatal."""
    return rows.withColumn("j", F.when(F.trim("value").startswith("{"), F.from_json("value", ddl, {"mode": "PERMISSIVE"})))


def scan_stats(rows: DataFrame) -> DataFrame:
    """(file, raw_lines, skipped) over parsed lines; an empty last line is none."""
    return rows.filter("value <> ''").groupBy("file").agg(F.count("*").alias("raw_lines"), F.count(F.when(F.col("j.type").isNull(), 1)).alias("skipped"))


def block_transcript(rows: DataFrame, device: str) -> dict[str, DataFrame]:
    """Content-block transcripts: events (user and assistant lines), calls, results, and scan stats."""
    j = parsed(rows, schema.BLOCK_LINE)
    said = j.filter(F.col("j.type").isin("user", "assistant"))
    blocks = F.when(F.col("j.message.content").startswith("["), F.from_json("j.message.content", schema.BLOCKS))
    text = F.when(blocks.isNull(), F.nullif(F.trim("j.message.content"), F.lit(""))).otherwise(content_text(F.col("blocks"), "text"))
    said = said.withColumn("blocks", blocks).withColumn("content", text)
    prompt = (F.col("j.type") == "user") & F.col("content").isNotNull()
    u = F.col("j.message.usage")
    tokens = F.when(u.isNotNull(), F.struct(F.coalesce(u["input_tokens"], F.lit(0)).alias("input"), F.coalesce(u["output_tokens"], F.lit(0)).alias("output"), F.coalesce(u["cache_creation_input_tokens"], F.lit(0)).alias("cache_creation"), F.coalesce(u["cache_read_input_tokens"], F.lit(0)).alias("cache_read"), F.lit(0).cast("bigint").alias("reasoning")))
    at = (["file"], ["seq"])
    model = F.when(F.col("j.message.model") != "<synthetic>", F.col("j.message.model"))
    device_ = F.lit(device)
    events = said.select(
        F.when(F.col("j.uuid").isNotNull(), line_event_id(device_, F.col("j.uuid"))).otherwise(file_event_id(device_, F.col("file"), F.col("byte_offset"))).alias("source_event_id"),
        "file", "seq", "byte_offset", F.col("j.timestamp").alias("ts"), F.concat("j.type", F.lit("_message")).alias("kind"),
        carried(*at, F.col("j.sessionId")).alias("session_id"), F.col("j.agentId").alias("actor_id"), carried(*at, F.col("j.cwd")).alias("cwd"), carried(*at, F.col("j.gitBranch")).alias("branch"),
        F.coalesce(model, carried(*at, model)).alias("model"), turn_index(*at, prompt).alias("turn_index"), tokens.alias("tokens"), "content", F.octet_length("content").alias("content_bytes"),
    )
    each = said.select("file", "seq", "j.timestamp", F.posexplode("blocks").alias("index", "b"))
    calls = each.filter("b.type = 'tool_use'").select("file", F.col("b.id").alias("call_id"), F.col("seq").alias("line"), "index", "timestamp", F.col("b.name").alias("name"), F.col("b.input").alias("args"))
    results = each.filter("b.type = 'tool_result'").select("file", F.col("b.tool_use_id").alias("call_id"), F.col("seq").alias("line"), F.coalesce("b.is_error", F.lit(False)).alias("error"), F.octet_length("b.content").alias("result_bytes"))
    return {"events": events, "calls": calls, "results": results, "stats": scan_stats(j)}


def rollout_log(rows: DataFrame, device: str) -> dict[str, DataFrame]:
    """Rollout logs: token events (one a counter that moved), calls, results, messages.

    The file's name is the session; the declared id is the conversation, which keys the token events.
    """
    j = parsed(rows, schema.ROLLOUT_LINE)
    at = (["file"], ["seq"])
    p = F.col("j.payload")
    j = j.withColumn("conversation", carried(*at, F.when(F.col("j.type") == "session_meta", p["id"]))).withColumn("model", carried(*at, F.when(F.col("j.type") == "turn_context", p["model"]))).withColumn("cwd", carried(*at, p["cwd"]))
    session = F.regexp_extract("file", r"([^/]+?)(?:\.jsonl?)?$", 1)
    usage, total = p["info"]["last_token_usage"], p["info"]["total_token_usage"]
    counted = j.filter((F.col("j.type") == "event_msg") & (p["type"] == "token_count") & usage.isNotNull())
    cumulative = F.concat_ws(":", *(F.coalesce(total[c], F.lit(0)).cast("string") for c in ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")))
    counted = drop_repeats(counted.withColumn("counter", F.when(total.isNotNull(), cumulative)), ["file", "conversation"], ["seq"], "counter")
    classes = disjoint_usage(usage["input_tokens"], usage["cached_input_tokens"], usage["output_tokens"], usage["reasoning_output_tokens"])
    tokens = counted.select(
        F.when(F.col("counter").isNotNull(), turn_event_id(F.lit(device), F.col("conversation"), [F.col("counter")])).otherwise(file_event_id(F.lit(device), F.col("file"), F.col("byte_offset"))).alias("source_event_id"),
        "file", "seq", session.alias("session_id"), "conversation", "model", "cwd", F.col("j.timestamp").alias("ts"), *(v.alias(k) for k, v in classes.items()),
    )
    items = j.filter("j.type = 'response_item'")
    calls = items.filter(p["type"].isin("function_call", "custom_tool_call")).select("file", p["call_id"].alias("call_id"), F.col("seq").alias("line"), p["name"].alias("name"), p["arguments"].alias("args"))
    results = items.filter(p["type"].isin("function_call_output", "custom_tool_call_output")).select("file", p["call_id"].alias("call_id"), F.col("seq").alias("line"), F.lit(False).alias("error"), F.octet_length(p["output"]).alias("result_bytes"))
    stated = F.coalesce(p["call_id"], p["id"])
    records = items.filter(stated.isNotNull()).withColumn("stated", stated).withColumn("kind", p["type"]).withColumn("n", ordinal(["file", "stated", "kind"], ["seq"]))
    records = records.select(stated_event_id(F.lit(device), F.col("stated"), F.col("kind"), F.col("n")).alias("source_event_id"), "file", "seq", "kind")
    return {"tokens": tokens, "calls": calls, "results": results, "records": records, "stats": scan_stats(j)}


def tree_transcript(rows: DataFrame, device: str) -> DataFrame:
    """Tree transcripts: messages keyed by their record id inside the session."""
    j = parsed(rows, schema.TREE_LINE)
    at = (["file"], ["seq"])
    j = j.withColumn("session_id", carried(*at, F.when(F.col("j.type") == "session", F.col("j.id")))).withColumn("model", carried(*at, F.when(F.col("j.type") == "model_change", F.col("j.modelId")))).withColumn("cwd", carried(*at, F.col("j.cwd")))
    m, u = F.col("j.message"), F.col("j.message.usage")
    zero = F.lit(0).cast("bigint")
    return j.filter("j.type = 'message'").select(
        record_event_id(F.lit(device), F.col("session_id"), F.col("j.id")).alias("source_event_id"), "file", "seq", "session_id", "model", "cwd",
        F.col("j.timestamp").alias("ts"), m["role"].alias("role"), F.col("j.parentId").alias("parent_id"), m["toolCallId"].alias("call_id"), m["isError"].alias("is_error"),
        F.when(u.isNotNull(), u["input"]).alias("input"), F.when(u.isNotNull(), F.greatest(u["output"] - F.coalesce(u["reasoningTokens"], zero), zero)).alias("output"),
        F.coalesce(u["cacheWrite"], zero).alias("cache_creation"), F.coalesce(u["cacheRead"], zero).alias("cache_read"), F.coalesce(u["reasoningTokens"], zero).alias("reasoning"),
    )


def record_log(rows: DataFrame, device: str) -> DataFrame:
    """Typed-record logs: one row a record, its kind from the payload, its time from epoch microseconds."""
    j = parsed(rows, schema.RECORD_LINE)
    u, p = F.col("j.payload.usage"), F.col("j.payload")
    classes = disjoint_usage(u["input_tokens"], u["cached_tokens"], u["output_tokens"], u["reasoning_tokens"])
    kind = F.coalesce(p["event"]["kind"], p["kind"], F.col("j.payload_type"))
    return j.filter("j.id is not null").select(record_event_id(F.lit(device), F.col("j.stream.id"), F.col("j.id")).alias("source_event_id"), "file", "seq", F.col("j.stream.id").alias("session_id"), F.timestamp_micros("j.recorded_at").alias("ts"), kind.alias("kind"), F.coalesce(p["text"], p["event"]["text"]).alias("content"), *(v.alias(k) for k, v in classes.items()))


def chat_bubbles(bubbles: DataFrame, since_ms: int | None = None) -> DataFrame:
    """Chat bubbles (type 1 user, 2 assistant) as turns; old ones are dropped after numbering."""
    order = ["created_at", "bubble_id"]
    rows = bubbles.filter(F.col("type").isin(1, 2)).withColumn("role", F.when(F.col("type") == 1, "user").otherwise("assistant"))
    rows = rows.withColumn("turn_index", turn_index(["composer_id"], order, (F.col("role") == "user") & (F.trim("text") != ""))).withColumn("seq", F.row_number().over(Window.partitionBy("composer_id").orderBy(*order)))
    return rows if since_ms is None else rows.filter(F.unix_millis(F.try_to_timestamp("created_at")) >= since_ms)


def usage_drift(raw: Column, known: list[str]) -> Column:
    """Numeric counters of a usage object that no class maps."""
    from ..functions.text import numeric_leaves

    return F.map_filter(numeric_leaves(raw), lambda k, v: ~k.isin(known))

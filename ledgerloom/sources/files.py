"""Other sources and the sinks: commit logs, SDK batches, web frames, inventory, incremental picks, merges."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..operators.history import upsert

FIELD, RECORD = "\x1f", "\x1e"


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, sha, committed_at, subject, body) of exported logs; a body keeps its separators."""
    return commits_of(spark.read.option("lineSep", RECORD).text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("position"), "value"))


def commits_of(records: DataFrame) -> DataFrame:
    """:func:`commit_log` of records (file, position, value) that are read already."""
    raw = records.select("file", "position", F.split(F.trim(F.regexp_replace("value", r"^\s+", "")), FIELD, 4).alias("x"))
    return raw.filter(F.size("x") >= 3).select("file", "position", F.col("x")[0].alias("sha"), F.col("x")[1].alias("committed_at"), F.col("x")[2].alias("subject"), F.coalesce(F.get("x", F.lit(3)), F.lit("")).alias("body"))


def numstat(rows: DataFrame, value: str = "value") -> DataFrame:
    """rows with added, deleted (NULL for a binary file) and path; malformed lines are left out."""
    x = F.split(F.col(value), "\t", 3)
    ok = (F.size(x) == 3) & x[0].rlike(r"^([0-9]+|-)$") & x[1].rlike(r"^([0-9]+|-)$") & (x[2] != "")
    return rows.filter(ok).withColumn("added", F.split(F.col(value), "\t", 3)[0].try_cast("bigint")).withColumn("deleted", F.split(F.col(value), "\t", 3)[1].try_cast("bigint")).withColumn("path", F.split(F.col(value), "\t", 3)[2])


def sdk_batches(spark: SparkSession, path: str, streaming: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events, tool calls with their event) of SDK batches in JSON."""
    return batches_of((spark.readStream if streaming else spark.read).schema(schema.SDK_BATCH).json(path), streaming)


def batches_of(raw: DataFrame, streaming: bool = False) -> tuple[DataFrame, DataFrame]:
    """:func:`sdk_batches` of batches that are read already."""
    events = raw.select(F.explode("events").alias("e")).select("e.*")
    calls = raw.select(F.explode("tool_calls").alias("c")).select("c.*")
    if streaming:
        return events, calls
    return events, calls.join(events.select("source_event_id", "session_id", "ts"), "source_event_id", "left")


def sse_messages(frames: DataFrame) -> DataFrame:
    """(request_id, url, pos, data) of event-stream bodies cut into chunks (request_id, url, seq, body).

    Blocks end at a blank line; their data lines are joined; [DONE] and what is not JSON are left out.
    """
    whole = frames.groupBy("request_id", "url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "body"))), lambda x: x["body"]), "").alias("body"))
    blocks = whole.select("request_id", "url", F.posexplode(F.split(F.regexp_replace("body", "\r\n", "\n"), "\n\n")).alias("pos", "block"))
    data = F.array_join(F.transform(F.filter(F.split("block", "\n"), lambda x: x.startswith("data:")), lambda x: F.regexp_replace(x, r"^data: ?", "")), "\n")
    return blocks.select("request_id", "url", "pos", data.alias("data")).filter((F.col("data") != "[DONE]") & F.col("data").rlike(r"^\s*[{\[]") & F.try_parse_json("data").isNotNull())


def extracted(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """messages with id, role, text and model by the first rule whose pattern their address matches.

    rules: (rank, url_pattern, id_path, role_path, text_path, model_path), a small configured table.
    """
    hit = messages.join(F.broadcast(rules), F.expr("url rlike url_pattern"))
    first = hit.withColumn("rn_", F.row_number().over(Window.partitionBy("request_id", "pos").orderBy("rank"))).filter("rn_ = 1")
    value = lambda path: F.expr(f"get_json_object(data, {path})")
    return first.select("request_id", "url", "pos", value("id_path").alias("message_id"), value("role_path").alias("role"), value("text_path").alias("text"), value("model_path").alias("model"))


def inventory_reports(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows of what devices report (installations, identities, handles); a bad line is a row of nulls."""
    return spark.read.schema(schema.INVENTORY).json(path)


def inventory_of(lines: DataFrame, value: str = "value") -> DataFrame:
    """:func:`inventory_reports` of lines that are read already; bad lines are left out."""
    return lines.select(F.from_json(value, schema.INVENTORY).alias("j")).select("j.*").filter("kind is not null")


def changed_files(listing: DataFrame, cursors: DataFrame) -> DataFrame:
    """Files (path, length, tail_hash) whose length or tail hash differs from their cursor's, or that have none."""
    return listing.join(cursors, ["path", "length", "tail_hash"], "left_anti")


def past_floor(events: DataFrame, cursors: DataFrame, file: str = "source_file", offset: str = "source_byte_offset") -> DataFrame:
    """Events at or past their file's shipped offset; a file shorter than its cursor is sent whole.

    cursors: (path, shipped, length_now).
    """
    rows = events.join(cursors.withColumnRenamed("path", "path_"), F.col(file) == F.col("path_"), "left")
    floor = F.when(F.col("length_now") < F.col("shipped"), 0).otherwise(F.coalesce("shipped", F.lit(0)))
    return rows.filter(F.col(offset) >= floor).select(*events.columns)


def newest_first(listing: DataFrame, most: int) -> tuple[DataFrame, Column]:
    """The ``most`` newest files, and whether more are pending."""
    picked = listing.orderBy(F.desc("mtime"), "path").limit(most)
    return picked, listing.agg((F.count("*") > most).alias("more_pending"))


BUCKET = "bucket_"


def merge_into(spark: SparkSession, new: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Replaces rows of a parquet table by key; writing the same rows again changes nothing.

    Rows are dealt to ``buckets`` (fixed by the first write) by a hash of their key; only buckets that ``new`` has
    rows for are read and written again, so choose as many as one task can hold one of.  A manifest names the
    folder of each bucket; readers see a write once its manifest is whole, and the folders of the state before
    stay until the next write.  One writer at a time.  A null key is a key like others; of rows with equal keys in
    ``new`` one stays; a ``new`` without rows writes nothing.
    """
    kept = _manifest(spark, path)
    buckets = next(iter(kept.values()))[0] if kept else buckets
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets))
    touched = [r[0] for r in new.select(bucket.alias(BUCKET)).distinct().collect()]
    if not touched:
        return
    held = [f"{path}/{kept[b][1]}" for b in touched if b in kept]
    rows = upsert(_read(spark, held), new, key) if held else new.dropDuplicates([key])
    folder = f"data/{uuid.uuid4().hex}"
    rows.withColumn(BUCKET, bucket).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/{folder}")
    _commit(spark, path, kept | {b: (buckets, f"{folder}/{BUCKET}={b}") for b in touched})


def replace(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Makes ``rows`` the whole table, by the same manifests as :func:`merge_into`; ``rows`` may be made of the old state."""
    folder = f"data/{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{folder}")
    _commit(spark, path, {0: (1, folder)})


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that :func:`merge_into` or :func:`replace` last wrote; None before the first write."""
    kept = _manifest(spark, path)
    return _read(spark, [f"{path}/{folder}" for _, folder in kept.values()]) if kept else None


def _read(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(*folders)


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder that may be absent."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()) if fs.exists(at) else []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _whole_manifests(spark: SparkSession, path: str) -> list[str]:
    done = lambda n: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifests/{n}/_SUCCESS")
    conf = spark._jsc.hadoopConfiguration()
    return [n for n in _children(spark, f"{path}/_manifests") if done(n).getFileSystem(conf).exists(done(n))]


def _manifest(spark: SparkSession, path: str, back: int = 1) -> dict[int, tuple[int, str]]:
    """{bucket: (number of buckets, folder)} of the last state, or of one before it; empty if there is none."""
    names = _whole_manifests(spark, path)
    if len(names) < back:
        return {}
    rows = spark.read.csv(f"{path}/_manifests/{names[-back]}", schema="bucket bigint, buckets bigint, folder string").collect()
    return {r["bucket"]: (r["buckets"], r["folder"]) for r in rows}


def _commit(spark: SparkSession, path: str, parts: dict[int, tuple[int, str]]) -> None:
    """Writes the next manifest, then deletes what neither it nor the one before names."""
    names = _whole_manifests(spark, path)
    name = f"{int(names[-1]) + 1 if names else 1:012d}"
    rows = [(b, n, folder) for b, (n, folder) in sorted(parts.items())]
    spark.createDataFrame(rows, "bucket bigint, buckets bigint, folder string").coalesce(1).write.mode("overwrite").csv(f"{path}/_manifests/{name}")
    used = {folder for back in (1, 2) for _, folder in _manifest(spark, path, back).values()}
    for write in _children(spark, f"{path}/data"):
        if f"data/{write}" in used:
            continue
        inside = [f"data/{write}/{b}" for b in _children(spark, f"{path}/data/{write}")]
        gone = [f for f in inside if f not in used]
        for folder in gone if len(gone) < len(inside) else [f"data/{write}"]:
            _delete(spark, f"{path}/{folder}")
    for old in names[:-1]:
        _delete(spark, f"{path}/_manifests/{old}")

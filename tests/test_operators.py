"""Operators on hand-made rows: activity, segments, attribution, history, reports, sources, streams."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import attribution, history, report, sessions, validate
from ledgerloom.functions import hooks, tokens
from ledgerloom.sources import files, logs
from ledgerloom.streaming import flows

H = 3_600_000


def test_active_time(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0), ("b", 3 * H), ("c", None)], "s string, t bigint")
    assert {r["s"]: r["active_ms"] for r in sessions.active_time(df, ["s"], "t").collect()} == {"a": 300_000, "b": 600_000}
    fold = attribution.session_fold(df.select(F.col("s").alias("session_id"), F.col("t").alias("ts_ms"), *(F.lit(1).alias(c) for c in tokens.CLASSES)))
    assert {r["session_id"]: r["active_ms"] for r in fold.collect()} == {"a": 300_000, "b": 600_000, "c": 0}


def test_sittings(spark):
    df = spark.createDataFrame([("a", 0), ("a", 10 * 60_000), ("a", 5 * H), ("b", 0)], "s string, t bigint")
    assert {r["s"]: r["active_minutes"] for r in sessions.sittings(df, ["s"], "t").collect()} == {"a": 70, "b": None}


def segment_list(spark, stamps, chars=None, vectors=None, **limits):
    rows = [("s", i, t, (chars or [0] * len(stamps))[i], (vectors or [None] * len(stamps))[i]) for i, t in enumerate(stamps)]
    df = spark.createDataFrame(rows, "s string, i int, t bigint, c int, v array<float>")
    return [r["segment"] for r in sessions.segments(df, "s", "t", ["i"], "c", "v", limits).orderBy("i").collect()]


def test_segments(spark):
    m = 60_000
    assert segment_list(spark, [0, m, 20 * m, 21 * m]) == [0, 0, 1, 1]
    assert segment_list(spark, [0, m, 20 * m]) == [0, 0, 0]  # a single turn joins the one before
    assert segment_list(spark, [0, 20 * m, 21 * m]) == [0, 1, 1]  # the first slice stays
    assert segment_list(spark, list(range(6)), turns=2) == [0, 0, 1, 1, 2, 2]
    assert segment_list(spark, [0, 1, 2, 3], chars=[12_000, 0, 0, 0]) == [0, 1, 1, 1]
    assert segment_list(spark, [0, 1, 2, 3], vectors=[[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 1.0]]) == [0, 0, 1, 1]
    assert sessions.calibrated({"turns": 5, "topic": 9, "chars": 10**9, "nope": 1, "gap_ms": None}) == {**sessions.LIMITS, "turns": 10, "topic": 2.0, "chars": 120_000}


def test_shares_add_up(spark):
    s = spark.createDataFrame([(1, 101, 7, 3, 0, 5, 999), (2, 0, 0, 0, 0, 0, 10)], "session_id int, input bigint, output bigint, cache_creation bigint, cache_read bigint, reasoning bigint, active_ms bigint")
    m = spark.createDataFrame([(1, "a", 0.5, 0.3), (1, "b", 0.9, 0.2), (1, "c", 0.3, 0.1), (2, "a", 0.3, 0.0)], "session_id int, pr string, confidence double, score double")
    split = attribution.shares(m, s)
    for c in [*tokens.CLASSES, "active_ms"]:
        assert split.agg(F.sum(c)).first()[0] == s.agg(F.sum(c)).first()[0]
    spend = {r["pr"]: r for r in attribution.spend_per_pr(split).collect()}
    assert spend["a"]["sessions"] == 2 and set(spend) == {"a", "b", "c"}
    free = attribution.unattributed(s, m.filter("session_id = 1")).first()
    assert (free["active_ms"], free["sessions"], free["sessions_scanned"]) == (10, 1, 2)


def test_layers(spark):
    o = spark.createDataFrame([(1, "a", 0.2, 0), (1, "b", 0.6, 0), (1, "c", 0.25, 0)], "session_id int, pr string, overlap double, gap_ms bigint")
    m = spark.createDataFrame([(1, "a", "git"), (1, "d", "content")], "session_id int, pr string, source string")
    got = {r["pr"]: (round(r["confidence"], 3), round(r["score"], 3)) for r in attribution.layered(o, m).collect()}
    assert got == {"a": (1.0, 0.2), "b": (0.9, 0.6), "c": (0.45, 0.25), "d": (0.3, 0.09)}


def test_calls_and_results(spark):
    calls = spark.createDataFrame([("f", "x", 1), ("f", "x", 3), ("f", "y", 4)], "file string, call_id string, line bigint")
    results = spark.createDataFrame([("f", "x", 2, False), ("f", "x", 5, True), ("f", "z", 6, False)], "file string, call_id string, line bigint, error boolean")
    assert {(r["line"], r["ended_line"], r["status"]) for r in history.paired_calls(calls, results).collect()} == {(1, 2, "success"), (3, 5, "error"), (4, None, "unknown")}


def test_repository_of(spark):
    e = spark.createDataFrame([(1, ["/x/none", "/w/a/sub/f.py", "/w/b"]), (2, ["/q"])], "event_id int, candidates array<string>")
    roots = spark.createDataFrame([("/w/a", "A"), ("/w/a/sub", "S"), ("/w/b", "B")], "root string, repo string")
    assert [tuple(r) for r in history.repository_of(e, roots).collect()] == [(1, "S")]


def test_anchors(spark):
    rows = [("r", f"Merge pull request #{i} from x", "co-authored-by: codex" if i == 5 else "", i) for i in range(1, 7)]
    df = spark.createDataFrame(rows, "repo string, subject string, body string, committed_at int")
    assert sorted((r["number"], r["is_ai"]) for r in history.anchors(df, 2).collect()) == [(4, False), (5, True), (6, False)]


def test_explore_and_pages(spark):
    e = spark.createDataFrame([("a", "x", 1, 1), ("a", "y", 2, 1), ("b", "x", 5, 2), (None, "x", 1, 3)], "model string, kind string, tokens bigint, session_id int")
    got = {(r["level"], r["grp"], r["stack"]): r["tokens"] for r in report.explore(e, "model", "kind", "tokens", 1).collect()}
    assert got == {("cell", "b", "x"): 5, ("group", "b", None): 5, ("all", None, None): 9}
    assert json.loads(report.report_json(spark.sql("select 1 a, cast(null as int) b")).first()[0]) == {"a": 1, "b": None}


def test_validation(spark):
    df = spark.createDataFrame([("a", "text"), (None, None), ("b", None), ("c", "pdf")], "v string, f string")
    ok, bad = validate.split_paired(df, "v", "f")
    assert (ok.count(), bad.count()) == (2, 2)
    assert validate.flag_vocabulary(df, "v", ["a"], "known").filter("known").count() == 1
    leaf = spark.createDataFrame([('{"a":{"p":"x/y"},"b":"http://z/q","c":"d e/f","e":"C:\\\\w"}',)], "j string").select(validate.argument_paths(F.col("j")).alias("r")).first()["r"]
    assert sorted(leaf) == ["C:\\w", "x/y"]


def test_hooks(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("b",)], "text string")
    asked = []

    def model(df):
        asked.append(sorted(r["text"] for r in df.collect()))
        return df.withColumn("answer", F.when(F.col("text") != "a", F.upper("text")))

    empty = spark.createDataFrame([], "key string, answer string")
    answers, new = hooks.cached_answers(texts, empty, "m1", model)
    assert {(r["text"], r["answer"]) for r in answers.collect()} == {("a", None), ("b", "B")} and new.count() == 1
    again, _ = hooks.cached_answers(texts, new, "m1", model)
    assert asked[-1] == ["a"] and again.count() == 2
    spans = hooks.with_model(texts, "text", "n", "int", lambda ts: [len(t) if t != "a" else None for t in ts])
    assert sorted((r["text"], r["n"]) for r in spans.distinct().collect()) == [("a", None), ("b", 1)]


def test_block_transcript(spark, tmp_path):
    rows = [
        {"type": "user", "uuid": "u1", "sessionId": "s", "timestamp": "2024-01-01T00:00:00Z", "cwd": "/w", "message": {"role": "user", "content": "hello"}},
        {"type": "assistant", "uuid": "u2", "timestamp": "2024-01-01T00:00:05Z", "message": {"role": "assistant", "model": "m1", "usage": {"input_tokens": 3, "output_tokens": 4}, "content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "id": "c1", "name": "Bash", "input": {"command": "ls"}}]}},
        {"type": "user", "uuid": "u3", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c1", "is_error": True, "content": "no"}]}},
    ]
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps(rows[0]), "", "{bad", *map(json.dumps, rows[1:])]) + "\n")
    lines = logs.lines(spark, str(tmp_path))
    assert [(r["seq"], r["byte_offset"]) for r in lines.orderBy("seq").limit(3).collect()] == [(1, 0), (2, len(json.dumps(rows[0])) + 1), (3, len(json.dumps(rows[0])) + 2)]
    got = logs.block_transcript(lines, "dev")
    e = got["events"].orderBy("seq").collect()
    assert [(r["kind"], r["session_id"], r["cwd"], r["turn_index"], r["content"]) for r in e] == [("user_message", "s", "/w", 0, "hello"), ("assistant_message", "s", "/w", 0, "hi"), ("user_message", "s", "/w", 0, None)]
    assert e[1]["tokens"]["output"] == 4 and e[0]["tokens"] is None
    paired = history.paired_calls(got["calls"].select("file", "call_id", "line"), got["results"].select("file", "call_id", "line", "error")).collect()
    assert [(r["call_id"], r["status"]) for r in paired] == [("c1", "error")]
    assert tuple(got["stats"].select("raw_lines", "skipped").first()) == (4, 1)


def test_rollout_log(spark, tmp_path):
    def usage(i, total):
        u = {"input_tokens": i, "cached_input_tokens": 2, "output_tokens": 5, "reasoning_output_tokens": 1}
        return {"timestamp": "t", "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": u, "total_token_usage": {**u, "input_tokens": total}}}}

    rows = [{"type": "session_meta", "payload": {"id": "conv"}}, {"type": "turn_context", "payload": {"model": "m", "cwd": "/w"}}, usage(10, 10), usage(10, 10), usage(4, 14),
            {"type": "response_item", "payload": {"type": "function_call", "call_id": "c", "name": "shell", "arguments": "{}"}}, {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "c", "output": "ok"}}]
    (tmp_path / "rollout-1.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = logs.rollout_log(logs.lines(spark, str(tmp_path)), "dev")
    t = got["tokens"].orderBy("seq").collect()
    assert [(r["session_id"], r["conversation"], r["model"], r["input"], r["output"], r["cache_read"], r["reasoning"]) for r in t] == [("rollout-1", "conv", "m", 8, 4, 2, 1), ("rollout-1", "conv", "m", 2, 4, 2, 1)]
    assert got["calls"].count() == got["results"].count() == 1 and got["records"].count() == 2


def test_other_sources(spark, tmp_path):
    (tmp_path / "log").write_text("s1\x1f2024\x1fsubject\x1fbody\x1fmore\x1e\ns2\x1f2025\x1fother\x1f\x1e")
    assert [(r["sha"], r["body"]) for r in files.commit_log(spark, str(tmp_path / "log")).orderBy("sha").collect()] == [("s1", "body\x1fmore"), ("s2", "")]
    n = files.numstat(spark.createDataFrame([("1\t2\ta b.py",), ("-\t-\tx.png",), ("bad",), ("",)], "value string"))
    assert [(r["added"], r["path"]) for r in n.collect()] == [(1, "a b.py"), (None, "x.png")]
    frames = spark.createDataFrame([("r", "https://c/x", 1, 'data: {"id":"1",'), ("r", "https://c/x", 2, '"t":"hi"}\n\ndata: [DONE]\n\ndata: nope\n\n')], "request_id string, url string, seq int, body string")
    rules = spark.createDataFrame([(1, "c/x", "$.id", "$.role", "$.t", "$.m")], "rank int, url_pattern string, id_path string, role_path string, text_path string, model_path string")
    assert [(r["message_id"], r["text"], r["role"]) for r in files.extracted(files.sse_messages(frames), rules).collect()] == [("1", "hi", None)]
    b = spark.createDataFrame([("c", "b1", 1, "q", "2024-01-01T00:00:00Z"), ("c", "b2", 2, "a", "2024-01-02T00:00:00Z"), ("c", "b3", 1, "q2", "2024-01-03T00:00:00Z"), ("c", "b4", 9, "x", "2024-01-03T00:00:00Z")], "composer_id string, bubble_id string, type bigint, text string, created_at string")
    assert [(r["bubble_id"], r["turn_index"]) for r in logs.chat_bubbles(b, 1704153600000).orderBy("seq").collect()] == [("b2", 0), ("b3", 1)]
    (tmp_path / "sdk.json").write_text(json.dumps({"events": [{"source_event_id": "e1", "session_id": "s", "ts": "t"}], "tool_calls": [{"external_call_id": "c", "source_event_id": "e1", "name": "n"}, {"source_event_id": "e9"}]}))
    events, calls = files.sdk_batches(spark, str(tmp_path / "sdk.json"))
    assert events.count() == 1 and sorted((r["source_event_id"], r["session_id"]) for r in calls.collect()) == [("e1", "s"), ("e9", None)]


def test_incremental(spark, tmp_path):
    e = spark.createDataFrame([("f", 0), ("f", 50), ("g", 5), ("h", 1)], "source_file string, source_byte_offset bigint")
    c = spark.createDataFrame([("f", 40, 90), ("g", 10, 8)], "path string, shipped bigint, length_now bigint")
    assert sorted(tuple(r) for r in files.past_floor(e, c).collect()) == [("f", 50), ("g", 5), ("h", 1)]
    path = str(tmp_path / "t")
    for _ in range(2):
        files.merge_into(spark, spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int"), path, "id")
    files.merge_into(spark, spark.createDataFrame([("b", 3)], "id string, v int"), path, "id")
    assert sorted(tuple(r) for r in files.current(spark, path).collect()) == [("a", 1), ("b", 3)]


def test_merge_writes_touched_buckets_only(spark, tmp_path):
    """A write leaves other buckets' files alone; a reader of the state before can still read it; null keys merge."""
    path, ddl = str(tmp_path / "t"), "id bigint, v int"
    files.merge_into(spark, spark.createDataFrame([(i, 0) for i in range(200)] + [(None, 0)], ddl), path, "id", buckets=16)
    first = {b: f for b, (_, f) in files._manifest(spark, path).items()}
    before = files.current(spark, path)
    new = spark.createDataFrame([(7, 1), (7, 1), (None, 5)], ddl)
    for again in range(2):
        files.merge_into(spark, new, path, "id")
        got = {r["id"]: r["v"] for r in files.current(spark, path).collect()}
        assert len(got) == files.current(spark, path).count() == 201 and got[7] == 1 and got[None] == 5 and got[8] == 0
        assert again or before.agg(F.sum("v")).first()[0] == 0
    second = {b: f for b, (_, f) in files._manifest(spark, path).items()}
    assert len(first) == 16 and 1 <= sum(first[b] != second[b] for b in first) <= 2
    files.merge_into(spark, new.limit(0), path, "id")
    assert {b: f for b, (_, f) in files._manifest(spark, path).items()} == second
    files.merge_into(spark, spark.createDataFrame([(300, 1, "x")], ddl + ", more string"), path, "id")
    assert files.current(spark, path).filter("more is null").count() == 201
    assert len(files._whole_manifests(spark, path)) == 2 and len(list((tmp_path / "t" / "data").iterdir())) <= 4


def test_board_over_batches(spark, tmp_path):
    board, minute = str(tmp_path / "board"), 60_000
    for i, rows in enumerate([[("a", 0), ("b", 10 * minute)], [("c", 20 * minute)], [("a", 21 * minute), ("d", 1)]]):
        path = str(tmp_path / f"in{i}")
        spark.createDataFrame(rows, "session_id string, ts_ms bigint").write.parquet(path)
        flows.live_board(spark.readStream.schema("session_id string, ts_ms bigint").parquet(path), board, str(tmp_path / f"cp{i}")).awaitTermination(120)
    assert {r["session_id"]: r["last_ms"] for r in files.current(spark, board).collect()} == {"a": 21 * minute, "b": 10 * minute, "c": 20 * minute}


def stream_of(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return path


def drain(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_dedupe_stream(spark, tmp_path):
    path = stream_of(spark, tmp_path, [("e1", "2024-01-01 00:00:00"), ("e1", "2024-01-01 00:00:05"), ("e2", "2024-01-01 00:00:09")], "source_event_id string, t string")
    s = spark.readStream.schema("source_event_id string, t string").parquet(path).withColumn("ts", F.to_timestamp("t"))
    assert sorted(r["source_event_id"] for r in drain(flows.deduped(s), "dedup", tmp_path)) == ["e1", "e2"]


def test_debounce_stream(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:03"), ("a", "2024-01-01 01:00:00"), ("z", "2024-01-02 00:00:00")]
    path = stream_of(spark, tmp_path, rows, "session_id string, t string")
    s = spark.readStream.schema("session_id string, t string").parquet(path).withColumn("ts", F.to_timestamp("t"))
    got = drain(flows.debounced(s), "quiet", tmp_path)
    assert sorted((r["session_id"], r["events"]) for r in got) == [("a", 1), ("a", 2)]


def test_forced_stream(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:00:{i:02d}") for i in range(5)] + [("z", "2024-01-02 00:00:00")]
    path = stream_of(spark, tmp_path, rows, "session_id string, t string")
    s = spark.readStream.schema("session_id string, t string").parquet(path).withColumn("ts", F.to_timestamp("t"))
    got = drain(flows.forced(s, event="t", most=2), "forced", tmp_path)
    assert sorted((r["session"], r["events"], r["why"]) for r in got) == [("a", 1, "quiet"), ("a", 2, "full"), ("a", 2, "full")]


def test_message_merge(spark, tmp_path):
    rows = [("h", "m", "dom", "2024-01-01 00:00:00", "user", "part", None, False), ("h", "m", "network", "2024-01-01 00:00:01", None, "whole", "g", True), ("h", "m", "dom", "2024-01-01 00:00:02", None, "late", "x", False), ("h", "n", "dom", "2024-01-02 00:00:00", None, None, None, False)]
    schema = "host string, message_id string, origin string, t string, role string, text string, model string, done boolean"
    path = stream_of(spark, tmp_path, rows, schema)
    s = spark.readStream.schema(schema).parquet(path).withColumn("ts", F.to_timestamp("t"))
    got = drain(flows.merged_messages(s), "merged", tmp_path)
    assert [tuple(r) for r in got] == [("h", "m", "user", "whole", "g")]


def test_ship_and_board(spark, tmp_path):
    path = stream_of(spark, tmp_path, [("a", 1), ("b", -1)], "id string, v int")
    s = spark.readStream.schema("id string, v int").parquet(path)
    for run in range(2):
        flows.ship(s, str(tmp_path / "out"), "id", str(tmp_path / f"cp{run}"), F.col("v") > 0, str(tmp_path / "dead")).awaitTermination(120)
    assert [tuple(r) for r in files.current(spark, str(tmp_path / "out")).collect()] == [("a", 1)]
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 2
    board = spark.readStream.schema("id string, v int").parquet(path).select(F.col("id").alias("session_id"), F.col("v").cast("bigint").alias("ts_ms"))
    flows.live_board(board, str(tmp_path / "board"), str(tmp_path / "cpb")).awaitTermination(120)
    assert {r["session_id"] for r in files.current(spark, str(tmp_path / "board")).collect()} == {"a", "b"}


@pytest.mark.parametrize("rows", [[], [("s", None)]])
def test_empty_tables(spark, rows):
    df = spark.createDataFrame(rows, "session_id string, ts_ms bigint")
    assert sessions.active_time(df, ["session_id"], "ts_ms").count() == 0
    assert report.live_sessions(df).count() == 0
    assert isinstance(report.session_page(df.withColumnRenamed("ts_ms", "last_ms"), 5).toPandas(), pd.DataFrame)


def test_account_at(spark):
    """A session stays one row, with the account that its device had last before its oldest event."""
    s = spark.createDataFrame([(1, "d", "p", 100), (2, "d", "p", 5), (3, "e", "p", 100), (4, "d", None, 100), (5, "d", "p", None), (6, "d", "p", 50)], "session_id int, device string, provider string, oldest_ms bigint")
    a = spark.createDataFrame([("d", "p", 10, "first"), ("d", "p", 50, "b"), ("d", "p", 50, "a"), ("d", "p", 101, "late"), ("x", "p", 1, "other"), ("d", "p", None, "never")], "device string, provider string, observed_since bigint, account string")
    assert {r["session_id"]: r["account"] for r in history.account_at(s, a).collect()} == {1: "a", 2: None, 3: None, 4: None, 5: None, 6: "a"}


def test_reconcile(spark):
    """Short, changed, settled, unsettled, waiting and in-step sessions; the state carries on."""
    day, now = 86_400_000, 10 * 86_400_000 + 3_600_000  # 01:00 of the 11th: the 10th has not settled
    rows = lambda d, s, n, f="f": [(f"1970-01-{d:02}", s, f"{f}{i % 2}", f"{d}{s}{i}") for i in range(n)]
    local = [*rows(1, "short", 9), *rows(1, "few", 9), *rows(1, "same", 4), *rows(2, "other", 5, "g"), *rows(10, "fresh", 9), *rows(3, "wait", 9, "w"), *rows(4, "again", 9, "h")]
    stored = [r for r in local if not (r[1] in ("short", "wait", "again") and int(r[3][-1]) > 4) and not (r[1] == "few" and r[3][-1] in "78") and r[1] != "fresh"]
    stored = [(r[0], r[1], "", r[3] + "x") if r[1] == "other" and r[3][-1] == "0" else r for r in stored] + [("1970-01-05", "more", "", "z1")]
    schema = "day string, session_id string, file string, id string"
    a, b = spark.createDataFrame(local, schema), spark.createDataFrame(stored, schema).drop("file")
    tries = spark.createDataFrame([("1970-01-03", "wait", 3, now - 100 * 60_000), ("1970-01-04", "again", 2, now - 61 * 60_000), ("1970-01-01", "same", 1, 5)], "day string, session_id string, attempts int, last_ms bigint")
    due, files_, state = history.reconcile(a, b, tries, now, ["id"])
    assert {(r["session_id"], r["missing"]) for r in due.collect()} == {("short", 4), ("other", 0), ("again", 4)}
    assert {r["file"] for r in files_.collect()} == {"f0", "f1", "g0", "g1", "h0", "h1"}
    assert {(r["session_id"], r["attempts"], r["last_ms"]) for r in state.collect()} == {("short", 1, now), ("other", 1, now), ("again", 3, now), ("wait", 3, now - 100 * 60_000)}
    due, _, _ = history.reconcile(a, b, state, now + 90 * 60_000, ["id"])
    assert {r["session_id"] for r in due.collect()} == {"short", "other", "wait"}  # 90 minutes are over for all but the third try
    due, _, state = history.reconcile(a, a.drop("file"), state, now + day, ["id"])
    assert due.collect() == [] and state.collect() == []


def test_overlap_of_long_lists(spark):
    """Pairs with more files than a list holds are joined on paths, with the same result."""
    rng = __import__("random").Random(1)
    s = spark.createDataFrame([(i, f"p{rng.randint(0, 30)}") for i in range(12) for _ in range(rng.randint(1, 40))], "session_id int, path string")
    p = spark.createDataFrame([(f"r{i}", f"p{rng.randint(0, 30)}") for i in range(9) for _ in range(rng.randint(1, 40))], "pr string, path string")
    ss = s.select("session_id").distinct().selectExpr("session_id", "1 repo", "0L start_ms", "session_id * 86400000L end_ms")
    ps = p.select("pr").distinct().selectExpr("pr", "1 repo", "cast(substring(pr, 2) as bigint) * 86400000L * 2 merged_ms")
    got = [sorted(map(tuple, attribution.overlap(ss, ps, s, p, most_listed=n).collect())) for n in (0, 8, 4096)]
    assert got[0] == got[1] == got[2] and len(got[0]) > 20


def test_split_arrays_are_those_of_the_windows(spark):
    rng = __import__("random").Random(2)
    rows = [(k, i, rng.choice([None, float("nan"), -1.0, 0.0, 0.1, 0.3, 1.0, 7.0]), 10 ** (k % 7) + k, 5 - k % 6) for k in range(60) for i in range(k % 9 + 1)]
    df = spark.createDataFrame(rows, "k int, i int, w double, t bigint, u bigint")
    want = tokens.largest_remainder(tokens.largest_remainder(df, "t", "w", ["k"], ["i"], "a"), "u", "w", ["k"], ["i"], "b")
    lists = df.groupBy("k", "t", "u").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("x")).withColumn("w", F.col("x.w"))
    got = tokens.split_arrays(lists, ["t", "u"], "w", {"t": "a", "u": "b"}).select("k", F.explode(F.arrays_zip(F.col("x.i").alias("i"), "a", "b")).alias("x")).select("k", "x.*")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("k", "i", "a", "b").collect()))


def test_session_files_of_repeated_sessions(spark):
    """A next start is the next distinct one; a session with two windows gets a path once."""
    day = 86_400_000
    rows = [(1, 0, 0, 10), (2, 0, 0, 10), (3, 0, 2, 3), (3, 0, 5, 6), (4, 1, 0, 1), (5, None, 0, 9), (6, 0, None, 9)]
    sessions = spark.createDataFrame([(i, r, None if a is None else a * day, b * day) for i, r, a, b in rows], "session_id int, repo int, start_ms bigint, end_ms bigint")
    commits = spark.createDataFrame([(0, "a", 1 * day), (0, "b", 3 * day), (0, "c", 6 * day), (1, "d", 0)], "repo int, sha string, ts_ms bigint")
    files = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y"), ("c", "z"), ("d", "x")], "sha string, path string")
    df = history.session_files(sessions, commits, files)
    got = sorted(map(tuple, df.collect()))
    assert got == [(1, 0, "x"), (2, 0, "x"), (3, 0, "y"), (3, 0, "z"), (4, 1, "x")]
    #: A frame without an end is read anew for each row, the square of a repository's sessions.
    assert "unboundedfollowing" not in df._jdf.queryExecution().optimizedPlan().toString().lower()

"""Values that a rule names often are computed once, and pairs meet by what they share."""

from pyspark.sql import functions as F

from ledgerloom.functions import refs


def test_references_are_found_once(spark):
    df = spark.createDataFrame([("https://github.com/a/b/pull/1 A/b#1 a/b#2",)], "t string").select(refs.event_references(F.col("t")).alias("e"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("merge_requests") < 10
    e = df.first()["e"]
    assert ([r["slug"] for r in e["repos"]], [r["key"] for r in e["pull_requests"]], [r["key"] for r in e["issues"]]) == (["a/b"], ["1"], ["2"])


def work_tables(spark):
    day = 86_400_000
    sessions = spark.createDataFrame([(i, i % 2, (i // 4) * day, (i // 4) * day + day) for i in range(40)], "session_id int, repo int, start_ms long, end_ms long")
    prs = spark.createDataFrame([(f"p{i}", i % 2, (i // 3) * day) for i in range(60)], "pr string, repo int, merged_ms long")
    return sessions, prs


def rows_of(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_time_sums_meet_once_a_time(spark):
    from ledgerloom.functions import tokens
    from ledgerloom.operators import attribution

    sessions, prs = work_tables(spark)
    pairs = attribution.shortlist(sessions, prs)
    want = pairs.groupBy("pr").agg(F.count(F.when(F.col("gap_ms") <= 0, 1)).alias("at_once"), F.sum(tokens.time_proximity(F.col("gap_ms"))).alias("proximity"))
    assert rows_of(attribution.time_sums(sessions, prs)) == rows_of(want)


def test_matched_sessions(spark):
    from ledgerloom.operators import attribution

    sessions, prs = work_tables(spark)
    files = sessions.select("session_id", (F.col("session_id") % 5).alias("path"))
    pr_files = prs.select("pr", (F.substring("pr", 2, 9).cast("int") % 3).alias("path"))
    mentions = spark.createDataFrame([(3, "p1", "git"), (99, "p2", "tool")], "session_id int, pr string, source string")
    want = attribution.layered(attribution.overlap(sessions, prs, files, pr_files), mentions).select("session_id").distinct()
    got = attribution.matched_sessions(sessions, prs, files, pr_files, mentions)
    assert rows_of(got.distinct()) == rows_of(want) and 0 < want.count() < 41


def test_files_of_a_window_meet_once(spark):
    from ledgerloom.operators import history

    sessions, prs = work_tables(spark)
    commits = prs.select("repo", F.col("pr").alias("sha"), F.col("merged_ms").alias("ts_ms"))
    files = commits.select("sha", F.lit("a").alias("path")).unionByName(commits.select("sha", F.col("sha").alias("path")))
    got = history.session_files(sessions, commits, files)
    start, until = {}, {}
    for s in sessions.collect():
        later = [x["start_ms"] for x in sessions.collect() if x["repo"] == s["repo"] and x["start_ms"] > s["start_ms"]]
        start[s["session_id"]], until[s["session_id"]] = s, min([s["end_ms"] + 4 * 3_600_000, *later])
    want = {(k, s["repo"], p) for k, s in start.items() for c in commits.collect() if c["repo"] == s["repo"] and s["start_ms"] <= c["ts_ms"] <= until[k] for p in ("a", c["sha"])}
    assert sorted(want) == rows_of(got)


def test_trigrams_of_any_text(spark):
    from ledgerloom.operators import search

    texts = ["Aa\nBéß日", "ab", "", None, "x😀y😀x", "aaaa"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(search.grams_of(F.col("t"))).collect()]
    assert got == [list(dict.fromkeys(t.lower()[k : k + 3] for k in range(len(t) - 2))) if t else [] for t in texts]
    assert "regexp_extract_all" in df.select(search.grams_of(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_bits_of_files_lose_no_overlap(spark):
    from ledgerloom.operators import attribution

    day = 86_400_000
    sets = [[(i * 7 + k * k) % 300 for k in range(2 + i % 9)] for i in range(60)]
    sessions = spark.createDataFrame([(i, 0, 0, day) for i in range(60)], "session_id int, repo int, start_ms long, end_ms long")
    prs = spark.createDataFrame([(f"p{i}", 0, day) for i in range(60)], "pr string, repo int, merged_ms long")
    files = spark.createDataFrame([(i, p) for i, s in enumerate(sets) for p in s], "session_id int, path int")
    pr_files = files.select(F.concat(F.lit("p"), F.col("session_id").cast("string")).alias("pr"), F.col("path"))
    out = attribution.overlap(sessions, prs, files, pr_files)
    want = sorted((i, f"p{j}", len(a & b)) for i, a in enumerate(map(set, sets)) for j, b in enumerate(map(set, sets)) if a & b and len(a & b) / len(a | b) >= 0.15)
    assert rows_of(out.select("session_id", "pr", "inter")) == want
    assert "bit_or" in out._jdf.queryExecution().optimizedPlan().toString()


def test_events_are_dealt_before_their_prefixes(spark):
    from ledgerloom.operators import history

    events = spark.createDataFrame([(1, ["/x/y", "/w/a/b/c"]), (2, ["/w/z"]), (3, ["/q"]), (4, None)], "event_id int, candidates array<string>").coalesce(1)
    roots = spark.createDataFrame([("/w", "outer"), ("/w/a", "inner")], "root string, repo string")
    out = history.repository_of(events, roots)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 2 and "RepartitionByExpression [event_id" in plan
    assert rows_of(out) == [(1, "inner"), (2, "outer")]


def test_mentions_are_dealt_before_they_are_searched(spark, tmp_path):
    from ledgerloom.plans import queries

    spark.createDataFrame([(i, i % 2) for i in range(6)], "c_custkey int, c_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "NEW_LAND"), (1, "OLD")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    out = queries.a13_reference_dedupe(spark, str(tmp_path))
    assert "RepartitionByExpression [c_custkey" in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["key"] for r in out.filter("kind = 'pr'").collect()) == ["1", "2", "3", "4", "5"]


def test_names_are_cut_out_without_a_pattern_for_each(monkeypatch):
    import re

    from ledgerloom.functions import redact

    texts = ["Ann, Anna, ann_Ann (Ann)-Ann", "AnnAnn Ann", "ÄAnn Ann²Ann .Ann", "", "a.b a.b.a.b xa.b"]
    names = [("Ann", "PER"), ("a.b", "ORG"), ("", "X"), ("Ann", "ORG"), (" (Ann)", "UNIT")]

    def by_pattern(text, counts):
        for s, kind in ((" (Ann)", "UNIT"), ("Ann", "PER"), ("a.b", "ORG")):
            text, n = re.subn(rf"(?<![^\W_]){re.escape(s)}(?![^\W_])", lambda _, k=kind: f"[REDACTED:{k}]", text)
            counts |= {f"pf_{kind.lower()}": n} if n else {}
        return text, counts

    want = [by_pattern(t, {}) for t in texts]
    monkeypatch.setattr(redact.re, "subn", None)
    assert [redact.without_surfaces(t, names) for t in texts] == want

"""Commit history and stored state: anchors, spans, accounts, reconciliation, generations, replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import path_class
from ..functions.refs import ai_authored, pr_number

CLASSES = ["source", "test", "doc", "config", "generated"]


def change_features(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, files, added, deleted, churn and churn by path class) over (path, added, deleted); binary files have
    NULL counts and count as files only."""
    rows = files.withColumn("class_", path_class(F.col("path"))).withColumn("churn_", F.coalesce("added", F.lit(0)) + F.coalesce("deleted", F.lit(0)))
    by = [F.coalesce(F.sum(F.when(F.col("class_") == c, F.col("churn_"))), F.lit(0)).alias(f"churn_{c}") for c in CLASSES]
    return rows.groupBy(*keys).agg(F.count("*").alias("files"), F.coalesce(F.sum("added"), F.lit(0)).alias("added"), F.coalesce(F.sum("deleted"), F.lit(0)).alias("deleted"), F.sum("churn_").alias("churn"), *by)


def text_totals(files: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of text files only; binary rows count nowhere."""
    return files.filter("added is not null and deleted is not null").groupBy(*keys).agg(F.count("*").alias("files"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


def anchors(commits: DataFrame, most: int = 50) -> DataFrame:
    """(repo, number, merged_at, is_ai): merged PRs newest first until ``most`` human ones; AI ones in that
    window stay.  One row a PR, its newest merge."""
    rows = commits.withColumn("number", pr_number(F.col("subject"))).filter("number is not null").withColumn("is_ai", ai_authored(F.col("subject"), F.col("body")))
    rows = rows.groupBy("repo", "number").agg(F.max("committed_at").alias("merged_at"), F.bool_or("is_ai").alias("is_ai"))
    newest = Window.partitionBy("repo").orderBy(F.desc("merged_at"), F.desc("number")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("humans_", F.sum(F.when(F.col("is_ai"), 0).otherwise(1)).over(newest)).filter((F.col("humans_") < most) | ((F.col("humans_") == most) & ~F.col("is_ai"))).drop("humans_")


def branch_span(commits: DataFrame, merges: DataFrame) -> DataFrame:
    """merges (pr, merged_ms) with span_ms from the branch's first commit (NULL if unknown or negative) and the
    number of commits."""
    first = commits.groupBy("pr").agg(F.min("ts_ms").alias("first_"), F.count("*").alias("commits"))
    span = F.col("merged_ms") - F.col("first_")
    return merges.join(first, "pr", "left").withColumn("span_ms", F.when(span >= 0, span)).withColumn("commits", F.coalesce("commits", F.lit(0))).drop("first_")


def single_account(events: DataFrame, session: str, provider: str, ts_ms: str) -> DataFrame:
    """(session, provider, oldest_ms): sessions of one provider whose every stamp is readable."""
    return events.groupBy(session).agg(F.count_distinct(provider).alias("n_"), F.max(provider).alias(provider), F.bool_and(F.col(ts_ms).isNotNull()).alias("ok_"), F.min(ts_ms).alias("oldest_ms")).filter("n_ = 1 and ok_").drop("n_", "ok_")


def account_at(sessions: DataFrame, accounts: DataFrame, keys: tuple[str, ...] = ("device", "provider"), oldest: str = "oldest_ms") -> DataFrame:
    """sessions with the account of their device and provider that was observed at or before their oldest event.

    Of several the one observed last counts (ties: the smaller name), so a session stays one row.  The accounts of a
    device and provider, which are few, are one list.
    """
    known = accounts.filter(F.col("observed_since").isNotNull()).groupBy(*keys, "observed_since").agg(F.min("account").alias("a_"))
    lists = known.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("observed_since", "a_"))).alias("seen_"))
    before = F.filter("seen_", lambda x: x["observed_since"] <= F.col(oldest))
    return sessions.join(lists, list(keys), "left").withColumn("account", F.try_element_at(before, F.lit(-1))["a_"]).select(*sessions.columns, "account")


#: A day is compared when it is this old; first wait, and the longest, between two tries.
SETTLE_MS, RETRY_MS, RETRY_MOST_MS = 6 * 3_600_000, 30 * 60_000, 24 * 3_600_000


def digests(rows: DataFrame, levels: list[list[str]], identity: list[str]) -> list[DataFrame]:
    """Mergeable digests of the rows by each of ``levels``, the coarsest first: count and sum of row hashes.

    A level is the sum of the next finer one, so rows are read once.
    """
    finest = rows.withColumn("h_", F.xxhash64(*identity).cast("decimal(38,0)")).groupBy(*levels[-1]).agg(F.count("*").alias("rows"), F.sum("h_").alias("digest"))
    out = [finest]
    for keys in reversed(levels[:-1]):
        out.insert(0, out[0].groupBy(*keys).agg(F.sum("rows").alias("rows"), F.sum("digest").alias("digest")))
    return out


def differing(local: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, here, there): groups whose count or hash sum differs between two digests."""
    a = local.select(*keys, F.col("rows").alias("here"), F.col("digest").alias("digest_"))
    b = stored.select(*keys, F.col("rows").alias("there"), F.col("digest").alias("stored_"))
    both = a.join(b, keys, "full")
    return both.filter(~F.col("digest_").eqNullSafe(F.col("stored_")) | ~F.col("here").eqNullSafe(F.col("there"))).select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("here", "there")))


def reconcile(local: DataFrame, stored: DataFrame, tries: DataFrame, now_ms: int, identity: list[str], ignore: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(short, files, tries): what the store lacks of the local rows, found from the top of a digest tree.

    local: (day, session_id, file, and the identity's columns); stored: the same without file; tries: (day, session_id,
    attempts, last_ms) from the pass before.  Months are compared first, then the days of differing months,
    then the sessions of differing days, so the rows of what agrees are not compared again.  A day that ends within the
    last six hours waits.  A session is short by ``missing`` rows if that is over ``ignore``, or if it has as many
    rows as the store but others (``missing`` 0).  One that was sent before waits 30 minutes, doubled with each try, a
    day at most.  files: those that hold rows of the sessions that are due; the third table is the state to keep:
    due sessions with one try more, waiting ones as they were, sessions in step dropped.  A store that has more than is
    here lacks nothing: the device only adds.
    """
    month = F.substring("day", 1, 7).alias("month")
    levels = [["month"], ["month", "day"], ["month", "day", "session_id"]]
    here = digests(local.select(month, "day", "session_id", *[c for c in identity if c not in ("day", "session_id")]), levels, identity)
    there = digests(stored.select(month, "day", "session_id", *[c for c in identity if c not in ("day", "session_id")]), levels, identity)
    open_ = differing(here[0], there[0], levels[0]).select("month")
    for k in (1, 2):
        at = [x.join(open_, levels[k - 1], "left_semi") for x in (here[k], there[k])]
        open_ = differing(*at, levels[k]).select(*levels[k], "here", "there")
        open_ = open_ if k == 2 else open_.select(*levels[k])
    #: Days are compared when they are over: strictly older than the day of six hours ago.
    settled = open_.filter(F.col("day") < F.date_format(F.timestamp_millis(F.lit(now_ms - SETTLE_MS)), "yyyy-MM-dd"))
    missing = F.col("here") - F.col("there")
    short = settled.withColumn("missing", missing).filter((missing > ignore) | (missing == 0)).select("day", "session_id", "missing")
    known = short.join(tries.select("day", "session_id", "attempts", "last_ms"), ["day", "session_id"], "left")
    known = known.withColumn("due", backoff_over(F.col("attempts"), F.col("last_ms"), F.lit(now_ms), RETRY_MS, RETRY_MOST_MS))
    due = known.filter("due").select("day", "session_id", "missing")
    files = local.join(due, ["day", "session_id"], "left_semi").select("file").distinct()
    state = known.select("day", "session_id", F.when(F.col("due"), F.coalesce("attempts", F.lit(0)) + 1).otherwise(F.col("attempts")).cast("int").alias("attempts"), F.when(F.col("due"), F.lit(now_ms)).otherwise(F.col("last_ms")).cast("bigint").alias("last_ms"))
    return due, files, state


def shortfalls(local: DataFrame, stored: DataFrame, ignore: int = 2) -> DataFrame:
    """(day, session_id, missing): groups whose stored rows fall short of the local ones by more than ``ignore``."""
    a = local.groupBy("day", "session_id").agg(F.count("*").alias("here"))
    b = stored.groupBy("day", "session_id").agg(F.count("*").alias("there"))
    return a.join(b, ["day", "session_id"], "full").withColumn("missing", F.coalesce("here", F.lit(0)) - F.coalesce("there", F.lit(0))).filter(F.col("missing") > ignore).select("day", "session_id", "missing")


def backoff_over(attempts, last_ms, now_ms, base_ms: int = 30 * 60_000, most_ms: int = 24 * 3_600_000):
    """Whether a retry is due: base * 2^(attempts - 1), at most ``most_ms``, after the last try."""
    wait = F.least(F.lit(float(most_ms)), F.lit(float(base_ms)) * F.pow(F.lit(2.0), attempts - 1))
    return attempts.isNull() | (attempts <= 0) | (now_ms - last_ms >= wait)


def inventory(rows: DataFrame, keys: list[str], order: list[str], fill: list[str], union: str | None = None) -> DataFrame:
    """One row a key: the first non-null of each field by order, and the ordered union of a list column."""
    aggs = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in fill]
    if union:
        aggs.append(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.col(union).alias("u")))), lambda x: x["u"]))).alias(union))
    return rows.groupBy(*keys).agg(*aggs)


def superseded(segments: DataFrame, generations: DataFrame) -> DataFrame:
    """Segments that a later scan of their session replaces: they lie in its span and are not of it.

    generations: (session_id, scan_id, span_start, span_end); an append has a NULL span and replaces none.
    """
    g = generations.filter("span_start is not null").select(F.col("session_id").alias("s_"), F.col("scan_id").alias("scan_"), "span_start", "span_end")
    return segments.join(g, (F.col("session_id") == F.col("s_")) & (F.col("scan_id") < F.col("scan_")) & F.col("started_ms").between(F.col("span_start"), F.col("span_end")), "left_semi")


def owed_files(files: DataFrame, aspects: DataFrame) -> DataFrame:
    """Files to process again: an aspect's wanted version is newer than the file's, for its parser or for all.

    files: (file, parser, aspect, version); aspects: (aspect, parser or NULL, wanted).
    """
    return files.join(aspects.withColumnRenamed("parser", "of_"), "aspect").filter((F.col("version") < F.col("wanted")) & (F.col("of_").isNull() | (F.col("of_") == F.col("parser")))).select("file").distinct()


def resume_copies_dropped(lines: DataFrame) -> DataFrame:
    """Lines (file_session, session_id, uuid) without those copied from a session whose own file exists, one a uuid."""
    own = lines.select(F.col("file_session").alias("own_")).distinct()
    copied = lines.filter("session_id <> file_session").join(own, F.col("session_id") == F.col("own_"), "left_anti")
    return lines.filter("session_id = file_session or session_id is null").unionByName(copied).dropDuplicates(["uuid"])


def paired_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Tool calls with the result that closes them: a result closes the latest open call of its id in the file."""
    rows = calls.select("file", "call_id", "line", F.lit(0).alias("k_"), F.lit(None).cast("boolean").alias("error")).unionByName(results.select("file", "call_id", "line", F.lit(1).alias("k_"), "error"))
    w = Window.partitionBy("file", "call_id").orderBy("line", "k_")
    nxt = rows.withColumn("next_k", F.lead("k_").over(w)).withColumn("ended_line", F.when(F.col("next_k") == 1, F.lead("line").over(w))).withColumn("err", F.when(F.col("next_k") == 1, F.lead("error").over(w)))
    status = F.when(F.col("ended_line").isNull(), "unknown").when(F.col("err"), "error").otherwise("success")
    return nxt.filter("k_ = 0").select("file", "call_id", "line", "ended_line", status.alias("status"))


def repository_of(events: DataFrame, roots: DataFrame) -> DataFrame:
    """(event_id, repo): the first of an event's candidate paths that lies in a known root, by its longest root.

    events: (event_id, candidates array in order); roots: (root, repo).
    """
    each = events.repartition("event_id").select("event_id", F.posexplode("candidates").alias("rank", "path"))
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    hits = each.select("event_id", "rank", F.explode(prefixes).alias("root")).join(roots, "root")
    return hits.groupBy("event_id").agg(F.min_by("repo", F.struct("rank", -F.length("root"))).alias("repo"))


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """table with rows of ``new`` in place of those with their key (null is a key); a replay changes nothing."""
    other = new.select(F.col(key).alias("upsert_key_"))
    return table.join(other, F.col(key).eqNullSafe(F.col("upsert_key_")), "left_anti").unionByName(new.dropDuplicates([key]), allowMissingColumns=True)


def calls_to_segments(calls: DataFrame, segments: DataFrame) -> DataFrame:
    """calls with the segment that lists their event; the last segment to list it wins, none gives null."""
    listed = segments.select("segment_id", "started_ms", F.explode("source_event_ids").alias("source_event_id")).groupBy("source_event_id").agg(F.max_by("segment_id", F.struct("started_ms", "segment_id")).alias("segment_id"))
    return calls.drop("segment_id").join(listed, "source_event_id", "left")


def script_summaries(calls: DataFrame, scripts: DataFrame) -> DataFrame:
    """(external_call_id, summaries): of each script a call names, the content of its best candidate path.

    calls: (external_call_id, command, roots array); scripts: (path, summary).
    """
    from ..functions.commands import script_candidates, script_refs

    named = calls.select("external_call_id", "roots", F.posexplode(script_refs(F.col("command"))).alias("at", "script"))
    tried = named.select("external_call_id", "at", F.posexplode(script_candidates(F.col("script"), F.col("roots"))).alias("rank", "path"))
    best = tried.join(scripts, "path").groupBy("external_call_id", "at").agg(F.min_by("summary", "rank").alias("summary"))
    return best.groupBy("external_call_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "summary"))), lambda x: x["summary"]).alias("summaries"))


def session_files(sessions: DataFrame, commits: DataFrame, files: DataFrame, after_ms: int = 4 * 3_600_000) -> DataFrame:
    """(session_id, repo, path): files changed in a session's repository from its start until ``after_ms`` past its
    end, or until the next session there starts.

    sessions: (session_id, repo, start_ms, end_ms); commits: (repo, sha, ts_ms); files: (sha, path).  Sessions of one
    window see the same files, and commits of one time count as one: windows meet the distinct paths of a time, and the
    sessions get the distinct paths of their window.  The next start is looked up among the distinct starts of a repository.
    """
    following = Window.partitionBy("repo").orderBy("start_ms")
    starts = sessions.select("repo", "start_ms").distinct().withColumn("next_", F.lead("start_ms").over(following))
    later = sessions.join(starts, ["repo", "start_ms"]).withColumn("until_", F.least(F.col("end_ms") + after_ms, F.coalesce("next_", F.col("end_ms") + after_ms)))
    day = 86_400_000
    window = ["repo", "start_ms", "until_"]
    changed = commits.select("repo", "sha", "ts_ms").join(files, "sha").select("repo", "ts_ms", "path").distinct().withColumn("day", F.expr(f"ts_ms div {day}"))
    spread = later.select(*window).distinct().withColumn("day", F.explode(F.sequence(F.expr(f"start_ms div {day}"), F.expr(f"until_ div {day}"))))
    seen = spread.join(changed, ["repo", "day"]).filter("ts_ms between start_ms and until_").select(*window, "path").distinct()
    own = later.groupBy("session_id", "repo").agg(F.collect_set(F.struct("start_ms", "until_")).alias("windows"))
    own = own.select("session_id", "repo", F.size("windows").alias("n_"), F.explode("windows").alias("x")).select("session_id", "repo", "n_", "x.*").join(seen, window)
    #: Rows of a session with one window are distinct as they are.
    once, often = own.filter("n_ = 1"), own.filter("n_ > 1")
    return once.select("session_id", "repo", "path").unionByName(often.select("session_id", "repo", "path").distinct())


def session_span(events: DataFrame, segments: DataFrame) -> DataFrame:
    """(session_id, start_ms, end_ms) over events (ts_ms) and segments (started_ms, ended_ms)."""
    both = events.select("session_id", F.col("ts_ms").alias("a"), F.col("ts_ms").alias("b")).unionByName(segments.select("session_id", F.col("started_ms").alias("a"), F.col("ended_ms").alias("b")))
    return both.groupBy("session_id").agg(F.min("a").alias("start_ms"), F.max("b").alias("end_ms"))


def chat_rollup(messages: DataFrame, classes: list[str]) -> DataFrame:
    """One row a chat session: messages, class sums, first and last time, last model that is not null."""
    return messages.groupBy("session_id").agg(F.count("*").alias("message_count"), *(F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in classes), F.min("ts_ms").alias("started_ms"), F.max("ts_ms").alias("ended_ms"), F.max_by("model", F.when(F.col("model").isNotNull(), F.struct("ts_ms", "model"))).alias("model"))

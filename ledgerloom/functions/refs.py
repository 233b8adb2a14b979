"""References in text: repositories, pull requests, issues, tickets, authorship, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kind, provider, pattern, groups of the slug (joined by /), group of the number or key.
NAME = r"[0-9A-Za-z_.\-]+"
PATTERNS = [
    ("pr", "github", rf"(?i)https?://github\.com/({NAME})/({NAME})/pull/([0-9]+)", (1, 2), 3, "github.com"),
    ("pr", "gitlab", r"(?i)https?://gitlab\.com/([0-9A-Za-z_./\-]+?)/-/merge_requests/([0-9]+)", (1,), 2, "gitlab.com"),
    ("pr", "bitbucket", rf"(?i)https?://bitbucket\.org/({NAME})/({NAME})/pull-requests/([0-9]+)", (1, 2), 3, "bitbucket.org"),
    ("issue", "github", rf"(?i)https?://github\.com/({NAME})/({NAME})/issues/([0-9]+)", (1, 2), 3, "github.com"),
    ("issue", "gitlab", r"(?i)https?://gitlab\.com/([0-9A-Za-z_./\-]+?)/-/issues/([0-9]+)", (1,), 2, "gitlab.com"),
    ("issue", "linear", rf"(?i)https?://linear\.app/{NAME}/issue/([A-Z][A-Z0-9]*-[0-9]+)", (), 1, None),
    ("issue", "jira", rf"(?i)https?://{NAME}/browse/([A-Z][A-Z0-9]+-[0-9]+)", (), 1, None),
]
SHORTHAND = rf"(?:^|[\s(\[{{<])({NAME}/{NAME})#([0-9]+)(?![0-9A-Za-z_])"
TICKET = r"(?<![0-9A-Za-z_])([A-Z][A-Z0-9]{1,9}-[0-9]{1,6})(?![0-9A-Za-z_])"
VENDORS = "claude|codex|cursor|copilot|devin|aider"
PR_CONFIDENCE, ISSUE_CONFIDENCE = 0.9, 0.8
REF = "array<struct<kind:string,provider:string,host:string,slug:string,key:string,url:string,confidence:double,ambiguous:boolean>>"


def _once(value: Column, use) -> Column:
    """use(value) with the value computed once, however often ``use`` names it: it is a lambda's variable."""
    return F.transform(F.array(value), use)[0]


def _of_pattern(kind: str, provider: str, pattern: str, slug: tuple, key: int, host: str | None):
    def ref(url: Column) -> Column:
        name = F.concat_ws("/", *(F.regexp_extract(url, pattern, i) for i in slug)) if slug else F.lit(None).cast("string")
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(provider).alias("provider"), F.lit(host).cast("string").alias("host"), name.alias("slug"), F.regexp_extract(url, pattern, key).alias("key"), url.alias("url"),
            F.lit(PR_CONFIDENCE if kind == "pr" else ISSUE_CONFIDENCE).alias("confidence"), F.lit(False).alias("ambiguous"),
        )

    return ref


def detect(text: Column, model_text: bool = False) -> Column:
    """All references of a text, pattern by pattern in their order; an empty list for null."""
    found = [F.transform(F.regexp_extract_all(text, F.lit(p[2]), F.lit(0)), _of_pattern(*p)) for p in PATTERNS]
    short = F.regexp_extract_all(text, F.lit(SHORTHAND), F.lit(0))
    none = F.lit(None).cast("string")
    one = lambda provider, slug, key: F.struct(F.lit("issue").alias("kind"), F.lit(provider).alias("provider"), none.alias("host"), slug.alias("slug"), key.alias("key"), none.alias("url"), F.lit(ISSUE_CONFIDENCE).alias("confidence"), F.lit(True).alias("ambiguous"))
    found.append(F.transform(short, lambda u: one("github", F.regexp_extract(u, SHORTHAND, 1), F.regexp_extract(u, SHORTHAND, 2))))
    if model_text:
        found.append(F.transform(F.regexp_extract_all(text, F.lit(TICKET), F.lit(1)), lambda k: one("other", none, k)))
    return F.coalesce(F.flatten(F.array(*(x.cast(REF) for x in found))), F.array().cast(REF))


def branch_tickets(branch: Column) -> Column:
    return F.coalesce(F.array_distinct(F.regexp_extract_all(branch, F.lit(TICKET), F.lit(1))), F.array().cast("array<string>"))


def ai_authored(subject: Column, body: Column) -> Column:
    """A trailer line names a coding assistant, in the subject or the body."""
    pattern = rf"(?im)^(?:[^\n]*(?:co-authored-by:|generated with)[^\n]*(?<![A-Za-z0-9_])(?:{VENDORS})(?![A-Za-z0-9_])|(?:{VENDORS})-[a-z0-9._-]*:)"
    return F.coalesce(subject.rlike(pattern), F.lit(False)) | F.coalesce(body.rlike(pattern), F.lit(False))


def pr_number(subject: Column) -> Column:
    """The pull request of a merge subject, by its two structural forms only."""
    first = F.regexp_extract(subject, r"^Merge pull request #([0-9]+)", 1)
    last = F.regexp_extract(subject, r"\(#([0-9]+)\)\s*$", 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(last, F.lit(""))).try_cast("bigint")


def valid_reference(kind: Column, slug: Column, number: Column, url: Column, host: Column, provider: Column | None = None, key: Column | None = None) -> Column:
    """Length limits of the wire: host 80, slug 200, url 400, provider 40, key 1 to 80, number from 1.

    A repository needs a slug; a pull request or an issue does not.
    """
    within = lambda c, most: F.coalesce(F.length(c) <= most, F.lit(True))
    ok = within(host, 80) & within(url, 400) & within(slug, 200)
    issue = (within(provider, 40) if provider is not None else F.lit(True)) & (F.coalesce(F.length(key).between(1, 80), F.lit(False)) if key is not None else F.lit(True))
    return ok & F.when(kind == "repo", F.coalesce(slug != "", F.lit(False))).when(kind == "pr", F.coalesce(number >= 1, F.lit(False))).otherwise(issue)


def merge_commit_of(commits: DataFrame, prs: DataFrame) -> DataFrame:
    """prs (slug, number) with the first commit of the log (slug, position, sha, committed_at, subject) whose
    subject holds #number between other characters than digits, and whether a body says that it reverts the
    commit, by its first seven characters."""
    cited = commits.withColumn("number", F.explode(F.array_distinct(F.regexp_extract_all("subject", F.lit(r"(?<![0-9])#([0-9]+)"), F.lit(1))))).withColumn("number", F.col("number").try_cast("bigint"))
    first = cited.groupBy("slug", "number").agg(F.min_by(F.struct("sha", "committed_at", "subject"), "position").alias("m"))
    undone = commits.select("slug", F.explode(F.regexp_extract_all("body", F.lit(r"This reverts commit ([0-9A-Za-z]{7})"), F.lit(1))).alias("short")).distinct()
    out = prs.join(first, ["slug", "number"], "left").select("slug", "number", F.col("m.sha").alias("merge_sha"), F.col("m.committed_at").alias("merged_at"), F.col("m.subject").alias("subject"))
    hit = out.join(undone, (out.slug == undone.slug) & (F.left(out.merge_sha, F.lit(7)) == undone.short), "left_semi").select("slug", "number").distinct().withColumn("hit", F.lit(True))
    return out.join(hit, ["slug", "number"], "left").withColumn("merged", F.col("merge_sha").isNotNull()).withColumn("reverted", F.coalesce("hit", F.lit(False))).drop("hit")


def drop_issues_that_are_prs(issues: DataFrame, prs: DataFrame) -> DataFrame:
    """GitHub issues (session_id, provider, slug, key) without those that are a pull request of the session."""
    known = prs.select("session_id", F.lower("slug").alias("low"), F.col("number").cast("string").alias("n")).distinct()
    return issues.join(known, (issues.session_id == known.session_id) & (F.lower(issues.slug) == known.low) & (issues.key == known.n) & (issues.provider == "github"), "left_anti")


#: How many repositories, pull requests and issues a session keeps, branches a repository keeps.
MOST_REPOS, MOST_PRS, MOST_ISSUES, MOST_BRANCHES = 50, 100, 100, 50


def dedupe_references(refs: DataFrame, most: dict[str, int] | None = None) -> DataFrame:
    """One row for each natural key of a session: an ordered fold over its references.

    The keys, in lower case: a repository's slug, a pull request's slug and number, an issue's provider, slug and
    key.  Of two references the one of the larger rank * 2 + confidence wins, the earlier one in ties; fields it
    lacks come from the other; confidence is the larger; ambiguous only if both are.  A repository takes the
    name of the higher rank and unites the branches.  Issues on GitHub that are one of the session's pull
    requests go.  ``most``: rows kept of each kind, in the order of first sight.  Order: channel, ts, position.

    refs: (session_id, kind repo/pr/issue, slug, key, channel, ts, position, source, url, host, confidence,
    ambiguous [, provider, branches]).  Equal references are counted once before the fold, so that a
    reference that is met very often makes no large group.
    """
    from .tokens import source_rank

    limits = {"repo": MOST_REPOS, "pr": MOST_PRS, "issue": MOST_ISSUES, **(most or {})}
    missing = {"provider": F.lit(None).cast("string"), "branches": F.array().cast("array<string>")}
    rows = refs.withColumns({c: v for c, v in missing.items() if c not in refs.columns}).withColumn("branches", F.coalesce("branches", missing["branches"]))
    low = F.lower(F.coalesce("slug", F.lit("")))
    natural = F.when(F.col("kind") == "repo", low).when(F.col("kind") == "pr", F.concat(low, F.lit("#"), F.col("key"))).otherwise(F.concat(F.coalesce("provider", F.lit("")), F.lit(":"), low, F.lit("#"), F.lower("key")))
    fields = ["slug", "key", "provider", "source", "url", "host", "confidence", "ambiguous", "branches"]
    once = rows.withColumn("natural", natural).groupBy("session_id", "kind", "natural", *fields).agg(F.min(F.struct("channel", "ts", "position")).alias("at"))
    item = F.struct("at", source_rank(F.col("source")).alias("rank"), *fields)
    grouped = once.groupBy("session_id", "kind", "natural").agg(F.array_sort(F.collect_list(item)).alias("x"))
    score = lambda r: r["rank"] * 2 + r["confidence"]

    def merged(a: Column, b: Column) -> Column:
        repo = F.col("kind") == "repo"
        newer = F.when(repo, b["rank"] > a["rank"]).otherwise(score(b) > score(a))
        win = lambda c: F.when(newer, b[c]).otherwise(a[c]).alias(c)
        filled = lambda c: F.when(newer, F.coalesce(b[c], a[c])).otherwise(F.coalesce(a[c], b[c])).alias(c)
        branches = F.slice(F.array_union(a["branches"], b["branches"]), 1, MOST_BRANCHES).alias("branches")
        return F.struct(a["at"].alias("at"), win("rank"), filled("slug"), win("key"), win("provider"), win("source"), filled("url"), filled("host"), F.greatest(a["confidence"], b["confidence"]).alias("confidence"), (a["ambiguous"] & b["ambiguous"]).alias("ambiguous"), branches)

    fold = F.aggregate(F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(1))), F.element_at("x", 1), merged)
    found = grouped.withColumn("f", fold).select("session_id", "kind", "f.*").filter(valid_reference(F.col("kind"), F.col("slug"), F.col("key").try_cast("bigint"), F.col("url"), F.col("host"), F.col("provider"), F.col("key")))

    def first(kind: str, of: DataFrame) -> DataFrame:
        by = Window.partitionBy("session_id").orderBy("at")
        return of.filter(F.col("kind") == kind).withColumn("n_", F.row_number().over(by)).filter(F.col("n_") <= limits[kind]).drop("n_")

    prs = first("pr", found)
    known = prs.select("session_id", F.lower(F.coalesce("slug", F.lit(""))).alias("low_"), F.col("key").alias("number_"))
    issues = found.filter("kind = 'issue'").join(known.withColumnRenamed("session_id", "of_"), (F.col("session_id") == F.col("of_")) & (F.col("provider") == "github") & (F.lower(F.coalesce("slug", F.lit(""))) == F.col("low_")) & (F.col("key") == F.col("number_")), "left_anti")
    out = first("repo", found).unionByName(prs).unionByName(first("issue", issues))
    return out.select("session_id", "kind", "provider", "slug", "key", "source", "url", "host", "confidence", "ambiguous", "branches")


#: The text of an event that is read, in UTF-16 units, and the references of a kind it keeps.
MOST_UNITS, MOST_EACH = 64_000, 24


def event_references(text: Column, model_text: bool = False) -> Column:
    """(repos, pull_requests, issues) of an event's text, 24 of each at most; null if there are none.

    Each is folded by its natural key as in :func:`dedupe_references`; all have the same source and order, so the
    first of a key stays.  The text is cut to 64,000 UTF-16 units, an astral character counting two.
    """
    astral = F.length(F.regexp_replace(F.left(text, F.lit(MOST_UNITS)), r"[\x{0}-\x{FFFF}]", ""))
    low = lambda r: F.lower(F.coalesce(r["slug"], F.lit("")))
    pr_key = lambda r: F.concat(low(r), F.lit("#"), r["key"])
    issue_key = lambda r: F.concat(r["provider"], F.lit(":"), low(r), F.lit("#"), F.lower(r["key"]))
    valid = lambda rows: F.filter(rows, lambda r: valid_reference(r["kind"], r["slug"], r["key"].try_cast("bigint"), r["url"], r["host"], r["provider"], r["key"]))

    def firsts(rows: Column, key) -> Column:
        return _once(F.struct(rows.alias("rows"), F.transform(rows, key).alias("keys")), lambda x: F.filter(x["rows"], lambda r, i: F.array_position(x["keys"], key(r)) == i + 1))

    def kept(found: Column) -> Column:
        first = F.struct(valid(firsts(F.filter(found, lambda r: r["kind"] == "pr"), pr_key)).alias("prs"), F.filter(found, lambda r: r["kind"] == "issue").alias("issues"), found.alias("found"))
        keyed = lambda x: F.struct(x["prs"].alias("prs"), F.transform(x["prs"], pr_key).alias("pr_keys"), x["issues"].alias("issues"), F.transform(F.filter(x["issues"], lambda r: ~r["ambiguous"]), issue_key).alias("sure"), x["found"].alias("found"))

        def folded(x: Column) -> Column:
            issues = F.filter(firsts(x["issues"], issue_key), lambda r: ~((r["provider"] == "github") & F.array_contains(x["pr_keys"], pr_key(r))))
            issues = F.transform(issues, lambda r: r.withField("ambiguous", r["ambiguous"] & ~F.array_contains(x["sure"], issue_key(r))))
            repos = F.transform(firsts(F.filter(x["found"], lambda r: r["host"].isNotNull()), low), lambda r: F.struct(r["host"].alias("host"), r["slug"].alias("slug")))
            repos = F.filter(repos, lambda r: (r["slug"] != "") & (F.length(r["slug"]) <= 200))
            return F.struct(*(F.slice(rows, 1, MOST_EACH).alias(n) for rows, n in ((repos, "repos"), (x["prs"], "pull_requests"), (valid(issues), "issues"))))

        return _once(first, lambda x: _once(keyed(x), folded))

    some = lambda x: F.when(F.size(x["repos"]) + F.size(x["pull_requests"]) + F.size(x["issues"]) > 0, x)
    return _once(detect(F.left(text, F.lit(MOST_UNITS) - astral), model_text), lambda found: _once(kept(found), some))


def repo_of_git(slug: Column, branch: Column, slug_source: Column, remote_url: Column) -> Column:
    """(slug, branches, source) of a git context: git if the slug is verified, git_guess if not; null without one."""
    from .paths import verified_slug

    return F.when(slug.isNotNull(), F.struct(slug.alias("slug"), F.filter(F.array(branch), lambda b: b.isNotNull()).alias("branches"), F.when(verified_slug(slug_source, remote_url), "git").otherwise("git_guess").alias("source")))


def union_channels(channels: list[DataFrame]) -> DataFrame:
    """The channels (session_id, kind, slug, key, ts, position, source, ..) with their rank, as one table."""
    out = None
    for rank, df in enumerate(channels):
        df = df.withColumn("channel", F.lit(rank))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out

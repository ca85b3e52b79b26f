"""Run telemetry: gate counts, source outcomes, streaks, health, audits and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazelark.functions import text as X
from gazelark.shared import checkpointed as written


def gate_counts(items: DataFrame, gates: list[str]) -> DataFrame:
    """One row: how many items pass each gate and all before it (boolean columns, in order)."""
    passed, out = F.lit(True), []
    for g in gates:
        passed = passed & F.coalesce(F.col(g), F.lit(False))
        out.append(F.count_if(passed).alias(g))
    return items.agg(F.count("*").alias("fetched"), *out)


def parse_status(n_entries: Column, body: Column, error: Column) -> Column:
    """error, ok, empty (a feed without entries) or parse_fail (an HTML page, or nothing usable)."""
    head = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 400))
    return F.when(error.isNotNull(), "error").when(n_entries > 0, "ok").when(F.contains(head, F.lit("<rss")) | F.contains(head, F.lit("<feed")), "empty").otherwise("parse_fail")


def retry_decision(status: Column, attempt: Column, attempts: int = 3) -> Column:
    """ok, retry (no answer, 429 and 5xx, while attempts are left) or fail; other 4xx fail at once."""
    passing = status.isNull() | (status == 429) | (status >= 500)
    return F.when(~passing & (status < 400), "ok").when(passing & (attempt < attempts), "retry").otherwise("fail")


def source_outcomes(fetched: DataFrame, previous: DataFrame) -> DataFrame:
    """source_key, status, items_in_window, entries_in_feed, consecutive_empty, consecutive_parse_fail."""
    now = fetched.groupBy("source_key").agg(F.count_if("in_window").alias("items_in_window"), F.count_if(F.col("status") == "ok").alias("entries_in_feed"), F.max("status").alias("status"))
    streak = lambda old, hit: F.when(hit, F.coalesce(old, F.lit(0)) + 1).otherwise(0)
    old = previous.select("source_key", F.col("consecutive_empty").alias("_e"), F.col("consecutive_parse_fail").alias("_p"))
    return now.join(old, "source_key", "left").select(
        "source_key", "status", "items_in_window", "entries_in_feed",
        streak(F.col("_e"), F.col("entries_in_feed") == 0).alias("consecutive_empty"),
        streak(F.col("_p"), F.col("status") == "parse_fail").alias("consecutive_parse_fail"),
    )


def streaks(history: DataFrame, key: str, order: list[str], ok: Column) -> DataFrame:
    """key, streak: how many runs in a row, up to the last one, weren't ok.

    Not ok since the last ok one; one aggregation for both, without a sort.
    """
    at = F.struct(*order)
    last = history.groupBy(key).agg(F.max(F.when(ok, at)).alias("last_ok"))
    return history.join(last, key).groupBy(key).agg(F.count_if(F.col("last_ok").isNull() | (at > F.col("last_ok"))).alias("streak"))


def longest_streaks(history: DataFrame, key: str, order: list[str], ok: Column) -> DataFrame:
    """key, longest: the longest run of failures (gaps and islands).

    Runs are counted within ranges of (key, order), so that no task holds a key's whole history; a run
    that goes on in the next range has the same number of ok rows before it, and is put together by it.
    """
    # written, as the ranges must hold when a task is repeated
    ranged = written(history.select(key, *order, ok.alias("_gz_ok")).repartitionByRange(key, *order).withColumn("_gz_range", F.spark_partition_id()))
    so_far = F.count_if("_gz_ok").over(Window.partitionBy("_gz_range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    islands = ranged.withColumn("_gz_island", so_far).groupBy("_gz_range", key, "_gz_island").agg(F.count_if(~F.col("_gz_ok")).alias("n"))
    goods = ranged.groupBy("_gz_range", key).agg(F.count_if("_gz_ok").alias("_gz_good"))  # a row for each range of a key
    earlier = Window.partitionBy(key).orderBy("_gz_range").rowsBetween(Window.unboundedPreceding, -1)
    before = goods.select(F.col("_gz_range").alias("_gz_at"), F.col(key).alias("_gz_of"), F.coalesce(F.sum("_gz_good").over(earlier), F.lit(0)).alias("_gz_before"))
    numbered = islands.where("n > 0").join(before, (F.col("_gz_range") == F.col("_gz_at")) & F.col(key).eqNullSafe(F.col("_gz_of")))
    return numbered.groupBy(key, F.col("_gz_before") + F.col("_gz_island")).agg(F.sum("n").alias("n")).groupBy(key).agg(F.max("n").alias("longest"))


def counter_topk(rows: DataFrame, column: str, k: int = 12) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def recall_noise(routed: DataFrame) -> DataFrame:
    """label, items, routed, share, failed: of labelled rows (label, stream); noise fails above a quarter."""
    share = F.count_if(F.col("stream").isNotNull()) / F.count("*")
    return routed.groupBy("label").agg(F.count("*").alias("items"), F.count_if(F.col("stream").isNotNull()).alias("routed"), share.alias("share")).withColumn("failed", (F.col("label") == 0) & (F.col("share") > 0.25))


def archive_stats(archive: DataFrame) -> DataFrame:
    """items, editions, per_edition, first_year, last_year of archive(date, text)."""
    return archive.agg(
        F.count("*").alias("items"), F.count_distinct("date").alias("editions"), (F.count("*") / F.nullif(F.count_distinct("date"), F.lit(0))).alias("per_edition"),
        F.min(F.year("date")).alias("first_year"), F.max(F.year("date")).alias("last_year"),
    )


def audit_source(entries: DataFrame, sources: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """source_key, entries, kept, freshest_hours, verdict, against each source's stale_days."""
    age = X.hours_between(F.col("published"), now)
    found = entries.groupBy("source_key").agg(F.count("*").alias("entries"), F.count_if(F.col("accepted") & (F.col("published").isNull() | (age <= days * 24))).alias("kept"), F.count_if("accepted").alias("accepted"), F.min(age).alias("freshest_hours"))
    verdict = (
        F.when(F.coalesce("entries", F.lit(0)) == 0, "EMPTY")
        .when(F.col("accepted") == 0, "ALL DROPPED")
        .when(F.col("kept") == 0, "NOTHING RECENT")
        .when(F.col("freshest_hours") > F.col("stale_days") * 24, "STALE")
        .otherwise("ok")
    )
    return sources.select("source_key", F.coalesce("stale_days", F.lit(7)).alias("stale_days")).join(found, "source_key", "left").select("source_key", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("kept", F.lit(0)).alias("kept"), "freshest_hours", verdict.alias("verdict"))


def healthy_ratio(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count_if(F.col("verdict") == "ok").alias("healthy"), F.count("*").alias("total"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("verdict") != "ok", F.col("source_key")))), ",").alias("unhealthy"))


def quota_used(calls: DataFrame, at: str, cap: int = 40, days: int = 3) -> DataFrame:
    """day, used, left for the last `days` dates with calls."""
    return calls.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("used")).orderBy(F.desc("day")).limit(days).withColumn("left", F.greatest(F.lit(0), F.lit(cap) - F.col("used")))


def unhealthy_list(outcomes: DataFrame, sources: DataFrame, runs_a_day: int = 96, default_days: int = 2) -> DataFrame:
    """source_key of live sources whose streaks exceed their stale_days, once and sorted."""
    limit = F.coalesce("stale_days", F.lit(default_days)) * runs_a_day
    live = outcomes.join(sources.select("source_key", "stale_days"), "source_key")
    breach = lambda c: live.where(F.col(c) >= limit).select("source_key")
    return breach("consecutive_empty").unionByName(breach("consecutive_parse_fail")).distinct()


def fetch_summary(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count("*").alias("pages"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if("cached").alias("cache_hits"), F.count_if(F.col("confidence") == "high").alias("high_confidence"))


def run_health(status: DataFrame, now: Column, silent_hours: int = 18) -> DataFrame:
    """kind, severity, text of a run's status row: error, delivery, silence and quota."""
    quiet = X.hours_between(F.col("last_posted_at"), now)
    found = F.array_compact(
        F.array(
            F.when(F.col("error").isNotNull(), F.struct(F.lit("run_error").alias("kind"), F.lit("critical").alias("severity"), F.col("error").alias("text"))),
            F.when(~F.col("delivered"), F.struct(F.lit("delivery").alias("kind"), F.lit("critical").alias("severity"), F.lit("the last digest was not delivered").alias("text"))),
            F.when(quiet > silent_hours, F.struct(F.lit("silence").alias("kind"), F.lit("warning").alias("severity"), F.concat(F.lit("nothing posted for "), F.bround(quiet, 0).cast("bigint").cast("string"), F.lit(" hours")).alias("text"))),
            F.when(F.col("judge_blocked"), F.struct(F.lit("judge_quota").alias("kind"), F.lit("warning").alias("severity"), F.lit("screening has no calls left today").alias("text"))),
        )
    )
    return status.select(F.explode(found).alias("f")).select("f.*")


def health_text(findings: DataFrame, title: str, status_url: str | None = None) -> DataFrame:
    """text, exit_code of findings(kind, severity, text): a line each, critical ones first; 1 if one is critical."""
    mark = F.when(F.col("severity") == "critical", ":rotating_light:").otherwise(":warning:")
    lines = F.array_sort(F.collect_list(F.struct((F.col("severity") != "critical").alias("later"), "kind", F.concat(mark, F.lit(" "), "text").alias("line"))))
    tail = [F.lit(f"_status: {status_url}_")] if status_url else []
    whole = F.concat(F.array(F.lit(f"*{title}*")), F.transform(lines, lambda x: x["line"]), F.array(*tail).cast("array<string>"))
    return findings.agg(F.array_join(whole, "\n").alias("text"), F.coalesce(F.bool_or(F.col("severity") == "critical"), F.lit(False)).cast("int").alias("exit_code"))


def last_brief(log: DataFrame) -> DataFrame:
    """at: when the last briefing ran, by its entry in the log; null without one."""
    return log.agg(F.max(F.when(F.col("kind") == "brief", F.col("at"))).alias("at"))


def cooldown(findings: DataFrame, sent: DataFrame, now: Column, default_hours: int = 12) -> DataFrame:
    """findings(kind, hours) whose kind wasn't sent (kind, at) within its hours."""
    last = sent.groupBy("kind").agg(F.max("at").alias("_gz_at"))
    return findings.join(last, "kind", "left").where(F.col("_gz_at").isNull() | (X.hours_between(F.col("_gz_at"), now) >= F.coalesce("hours", F.lit(default_hours)))).drop("_gz_at")


def first_seen(history: DataFrame, key: str, at: str) -> DataFrame:
    return history.groupBy(key).agg(F.min(at).alias("first_seen"))


def stamped(rows: DataFrame, key: str, at: str) -> DataFrame:
    """rows with first_seen, the earliest `at` of their key."""
    first = rows.groupBy(F.col(key).alias("_gz_key")).agg(F.min(at).alias("first_seen"))
    return rows.join(first, F.col(key).eqNullSafe(F.col("_gz_key"))).drop("_gz_key")


def state_ttl(state: DataFrame, at: str, now: Column, hours: int) -> DataFrame:
    return state.where(X.hours_between(F.col(at), now) <= hours)


def queue_state(queue: DataFrame, now: Column, due: int, due_minutes: int, overdue_hours: int) -> DataFrame:
    """One row: queued, oldest, due (enough or old enough), overdue (rows past their time)."""
    age = X.hours_between(F.col("queued_at"), now)
    return queue.agg(F.count("*").alias("queued"), F.min("queued_at").alias("oldest"), F.coalesce((F.count("*") >= due) | (F.max(age) * 60 >= due_minutes), F.lit(False)).alias("due"), F.count_if(age >= overdue_hours).alias("overdue"))


def tight_windows(sources: DataFrame, minutes: int = 15) -> DataFrame:
    return sources.where(F.col("window_minutes") <= minutes)

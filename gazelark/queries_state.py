"""Registered queries of what runs keep: versioned state, ledger, delivery, sights, paged archives."""

from __future__ import annotations

import json
import uuid
from datetime import date

from pyspark.sql import functions as F

from gazelark import fixed
from gazelark.functions import text as X
from gazelark.operators import ledger, observe, rank, scoring
from gazelark.plans import delivery, pipelines
from gazelark.queries import ITEMS, now, register
from gazelark.shared import shared_folder
from gazelark.sources import archive, config, versioned
from gazelark.streaming.state import aged_from_sight


def _folder(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@register("r15_concurrent_commits", "SELECT user_id::VARCHAR AS key, min(ts) AS \"at\" FROM events GROUP BY user_id")
def _(t):
    """Two halves commit against the version before both; the second finds its number taken and merges."""
    table = versioned.Versioned(t.spark, _folder(t, "state"))
    rows = lambda part: t("events").where(part).select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"))
    base = table.commit(rows("event_id % 3 = 0"))
    table.commit(rows("event_id % 3 = 1"), base)
    table.commit(rows("event_id % 3 = 2"), base)
    return table.read()


@register("r15_compacted", "SELECT user_id::VARCHAR AS key, min(ts) AS \"at\" FROM events WHERE event_type <> 'view' GROUP BY user_id HAVING min(ts) >= TIMESTAMP '2024-01-01 06:00:00'")
def _(t):
    """A commit under a tag is taken back, the rest put together without what is too old."""
    table = versioned.Versioned(t.spark, _folder(t, "state"))
    for kind in ("click", "view", "other"):
        part = ~F.col("event_type").isin("click", "view") if kind == "other" else F.col("event_type") == kind
        table.commit(t("events").where(part).select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at")), tag=kind)
    table.withdraw("view")
    table.compact(F.col("at") >= F.lit("2024-01-01 06:00:00").cast("timestamp"))
    return table.read()


@register(
    "r06_undated_age",
    "WITH f AS (SELECT event_id, event_type, ts, CASE WHEN event_id % 3 = 0 THEN ts - to_minutes(event_id % 90) END AS published, min(ts) OVER (PARTITION BY event_type, user_id) AS first_seen FROM events) "
    "SELECT event_id, coalesce(published, first_seen) AS effective_date FROM f WHERE epoch(ts - coalesce(published, first_seen)) / 60 <= CASE WHEN published IS NOT NULL THEN CASE event_type WHEN 'click' THEN 20 ELSE 45 END ELSE greatest(CASE event_type WHEN 'click' THEN 20 ELSE 45 END, 30) END",
)
def _(t):
    published = F.when(F.col("event_id") % 3 == 0, F.col("ts") - F.make_interval(mins=(F.col("event_id") % 90).cast("int"))).alias("published")
    rows = t("events").select("event_id", "event_type", F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("url"), published, F.col("ts").alias("at"))
    return aged_from_sight(observe.stamped(rows, "url", "at"), "at", F.when(F.col("event_type") == "click", 20).otherwise(45)).select("event_id", "effective_date")


@register("r09_capped_queue", "SELECT url FROM (SELECT event_id::VARCHAR AS url, ts FROM events WHERE ts > TIMESTAMP '2024-01-30 06:00:00' AND ts <= TIMESTAMP '2024-01-30 12:00:00') ORDER BY ts DESC, url DESC LIMIT 60")
def _(t):
    """Without a verdict the queue keeps its latest 60."""
    at = F.lit("2024-01-30 12:00:00").cast("timestamp")
    queue = t("events").where(F.col("ts") <= at).select(F.col("event_id").cast("string").alias("url"), F.col("ts").cast("timestamp").alias("queued_at"))
    return pipelines.screened_queue(t.spark, queue.limit(0), queue, at, judge=lambda rows: None)[1].select("url")


@register("r12_ledger", "SELECT doc_id AS ord, CASE WHEN b < 20 AND b % 5 <> 3 THEN doc_id % 3 = 0 END AS kept FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 25 AS b FROM documents)")
def _(t):
    """Twenty calls a day, some of which give no verdict."""
    book = ledger.Ledger(t.spark, _folder(t, "ledger"), 20, lambda: date(2024, 1, 1))
    rows = rank.placed(t("documents").select(F.col("doc_id").alias("ord")), ["ord"]).withColumnRenamed("place", "nth")
    unanswered = lambda batch: (min(r["nth"] for r in batch) - 1) // 25 % 5 == 3
    return ledger.screened_within(rows, lambda batch: None if unanswered(batch) else {r["ord"] for r in batch if r["ord"] % 3 == 0}, book).select("ord", "kept")


@register("r12_calls_left", "SELECT greatest(0, 1000 - count(*)) AS calls_left FROM (SELECT DISTINCT (row_number() OVER (ORDER BY doc_id) - 1) // 25 AS b FROM documents) WHERE b < 1000 AND b % 5 <> 3")
def _(t):
    book = ledger.Ledger(t.spark, _folder(t, "ledger"), 1000, lambda: date(2024, 1, 1))
    rows = rank.placed(t("documents").select(F.col("doc_id").alias("ord")), ["ord"]).withColumnRenamed("place", "nth")
    ledger.screened_within(rows, lambda batch: None if (min(r["nth"] for r in batch) - 1) // 25 % 5 == 3 else set(), book)
    return book.table.read().agg((F.lit(1000) - F.sum("calls")).alias("calls_left"))


@register("k05_delivery", f"SELECT url, 's' || ord % 3 AS kind FROM ({ITEMS}) WHERE ord % 3 <> 1")
def _(t):
    """One bundle is refused; the others are logged."""
    stream = F.concat(F.lit("s"), (F.col("ord") % 3).cast("string"))
    items = t.items.withColumns(
        {"stream": stream, "category": F.lit(""), "score": F.lit(1), "axes": F.array().cast("array<string>"), "words": X.title_words(F.col("title")), "corroboration": F.lit(1), "kind": stream, "at": now()}
    )
    # a key of its own for each item, whatever its headline: only what is refused stays open
    items = items.withColumn("title", F.concat(F.lit("zebra headline number"), F.col("ord").cast("string"), F.lit(" walrus"), F.col("ord").cast("string")))
    log = delivery.posted_log(t.spark, _folder(t, "log"))

    def send(stream: str, text: str) -> None:
        if stream == "s1":
            raise RuntimeError("refused")

    box = delivery.Outbox(versioned.Versioned(t.spark, _folder(t, "claims")), send, log)
    box.deliver(items, lambda df: df.groupBy("stream").agg(F.count("*").cast("string").alias("text")), 0)
    return log.read().select("url", "kind")


LOG_SQL = f"SELECT source_key AS outlet, url, published, ord % 4 AS corroboration FROM ({ITEMS})"


@register("k06_saved_log", LOG_SQL)
def _(t):
    names = [c.strip().split(" ") for c in config.LOG.split(",")]
    rows = t.items.withColumns({"at": F.col("published"), "corroboration": (F.col("ord") % 4).cast("int")})
    path = _folder(t, "log")
    config.save(rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(kind).alias(n) for n, kind in names]), path)
    return config.saved(t.spark, path, config.LOG).select("outlet", "url", "published", F.col("corroboration").cast("long").alias("corroboration"))


@register("k06_saved_queue", f"SELECT title, url, source_key, published AS queued_at FROM ({ITEMS})")
def _(t):
    names = [c.strip().split(" ") for c in config.QUEUE.split(",")]
    rows = t.items.withColumns({"queued_at": F.col("published"), "score": F.lit(1)})
    path = _folder(t, "queue")
    config.save(rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(kind).alias(n) for n, kind in names]), path)
    return config.saved(t.spark, path, config.QUEUE).select("title", "url", "source_key", "queued_at")


def _archive_of(t, per_page: int) -> str:
    """The table of pages as the archive's answers, a file a page, written by Spark's tasks; where Spark runs on one machine."""
    folder = _folder(t, "archive").removeprefix("file:")
    numbered = rank.placed(t("pages").select("page_id", "url", "html"), ["page_id"]).withColumn("page", F.floor((F.col("place") - 1) / per_page))

    def write(frame):
        import os

        frame = frame.sort_values("place")
        os.makedirs(folder, exist_ok=True)
        posts = [{"id": int(i), "date": "2024-01-01", "link": u, "content": {"rendered": h}} for i, u, h in zip(frame["page_id"], frame["url"], frame["html"])]
        with open(f"{folder}/page-{int(frame['page'].iloc[0]) + 1}.json", "w", encoding="utf-8") as f:
            json.dump(posts, f)
        return frame[["page_id"]].head(1).assign(n=len(frame))

    total = numbered.groupBy("page").applyInPandas(write, "page_id long, n long").agg(F.sum("n").alias("n")).first()["n"]
    with open(f"{folder}/total.txt", "w", encoding="utf-8") as f:
        f.write(str(total))
    return folder


@register("s12_paged_archive", "SELECT page_id AS id, url AS link, length(html) AS n_chars, (row_number() OVER (ORDER BY page_id) - 1) // 20 + 1 AS page FROM pages")
def _(t):
    posts = archive.archive(t.spark, _archive_of(t, 20), per_page=20)
    return posts.select("id", "link", F.length("html").cast("long").alias("n_chars"), F.col("page").cast("long").alias("page"))


ANGLES = "['donor', 'recipient', 'both', 'unclear', 'none']"


@register(
    "c09_judged_bucket",
    f"SELECT doc_id AS ord, CASE WHEN doc_id % 11 = 0 THEN 'known donor' WHEN angle = 'donor' THEN 'Jewish donor, secular recipient' WHEN angle IN ('recipient', 'both') THEN 'explicitly Jewish' WHEN coalesce(angle, 'unclear') = 'unclear' THEN 'large secular gift — check donor' ELSE 'secular gift' END AS bucket "
    f"FROM (SELECT doc_id, ({ANGLES})[doc_id % 6 + 1] AS angle FROM documents)",
)
def _(t):
    angles = F.array(*[F.lit(a) for a in ("donor", "recipient", "both", "unclear", "none")])
    rows = t("documents").select(F.col("doc_id").alias("ord"), F.get(angles, (F.col("doc_id") % 6).cast("int")).alias("angle"))
    return rows.select("ord", scoring.judged_bucket(F.col("ord") % 11 == 0, F.col("angle")).alias("bucket"))


@register("t03_judged_rank", f"SELECT ord, row_number() OVER (ORDER BY list_position({fixed.JUDGED_BUCKETS!r}, bucket), n_chars DESC, ord) AS place FROM (SELECT doc_id AS ord, n_chars, ({fixed.JUDGED_BUCKETS!r})[doc_id % 5 + 1] AS bucket FROM documents)")
def _(t):
    names = F.array(*[F.lit(b) for b in fixed.JUDGED_BUCKETS])
    rows = t("documents").select(F.col("doc_id").alias("ord"), F.get(names, (F.col("doc_id") % 5).cast("int")).alias("bucket"), F.col("n_chars").alias("amount"))
    ordered = rank.gift_rank(rows, fixed.JUDGED_BUCKETS).select("ord", F.monotonically_increasing_id().alias("at"))
    return rank.placed(ordered, ["at"]).select("ord", "place")

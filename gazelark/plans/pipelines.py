"""Whole runs: items through the gates, the two-section pool, gifts and events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazelark import fixed
from gazelark.functions import predicates as P
from gazelark.functions import text as X
from gazelark.lexicon import Lexicon
from gazelark.operators import dedup, joins, rank, scoring, sets


def items(documents: DataFrame) -> DataFrame:
    """Documents as items: the source is the outlet, the first line the title, minutes by id."""
    return documents.select(
        F.col("doc_id").alias("ord"), F.col("source").alias("source_key"), F.col("source").alias("outlet"),
        F.substring_index("text", "\n", 1).alias("title"), F.concat(F.lit("https://"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("text").alias("body"), F.lit("").alias("author"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("doc_id").cast("int"))).alias("published"),
        F.lit(None).cast("timestamp").alias("effective_date"), F.lit(None).cast("int").alias("threshold"), F.lit("").alias("desk"), F.lit(False).alias("paywall"),
    )


@dataclass(frozen=True)
class Tick:
    """One run. Options stand for the command line: dry_run is for the caller, who doesn't send."""

    lexicon: Lexicon
    now: Column
    window_minutes: int = 24 * 60
    backfill: bool = False
    max_items: int = fixed.MAX_ITEMS

    def gates(self, fetched: DataFrame, seen: DataFrame, recent: DataFrame | None = None, shown: DataFrame | None = None) -> DataFrame:
        """fetched with a boolean for each gate: fresh, relevant, unseen, unique.

        A backfill leaves the claims alone and goes by shown(ord, outlet, words), remembered headlines:
        what is nearly the same as one of them was posted.
        """
        routed = scoring.route(fetched, self.lexicon)
        flagged = routed.withColumns(
            {
                "fresh": P.fresh(F.coalesce("effective_date", "published"), self.now, F.lit(self.window_minutes)),
                "relevant": F.col("stream").isNotNull() & ~P.url_path_veto(F.col("url"), self.lexicon.url_paths),
            }
        ).drop(*[s.name for s in self.lexicon.streams])
        # scored once: the gates below read the written rows several times
        flagged = dedup.written(flagged)
        passing = flagged.where("fresh AND relevant").select("ord", "url", "title", "outlet", F.coalesce("effective_date", "published").alias("effective_date"))
        new = dedup.written(self._unposted(passing, seen, shown))
        in_run = dedup.written(dedup.dedup_in_run(new).withColumnRenamed("kept", "unseen"))
        left = new.join(in_run.where("unseen").select("ord"), "ord", "left_semi")
        unique = dedup.dedup_cross_outlet(left, recent).withColumnRenamed("kept", "unique")
        out = flagged.join(in_run, "ord", "left").join(unique, "ord", "left")
        return out.withColumns({"unseen": F.coalesce("unseen", F.lit(False)), "unique": F.coalesce("unique", F.lit(False))})

    def _unposted(self, passing: DataFrame, seen: DataFrame, shown: DataFrame | None) -> DataFrame:
        if not self.backfill:
            return dedup.already_posted(passing, seen)
        if shown is None:
            return passing
        worded = passing.withColumn("words", X.title_words(F.col("title")))
        return joins.already_shown(worded, shown, fixed.BACKFILL_SIMILARITY).drop("words")

    def digest(self, gated: DataFrame) -> DataFrame:
        from gazelark.plans.render import digest

        return digest(gated.where("unique"), self.now, self.max_items)


def flagship(documents: DataFrame, lexicon: Lexicon, now: Column, most: int = 25) -> DataFrame:
    """Items routed, once by headline, capped by source, newest first."""
    # written narrow: a filter on the verdict would be pushed below it, and score everything twice
    routed = dedup.written(scoring.route(items(documents), lexicon).select("ord", "source_key", "title", "published", "effective_date", "stream")).where("stream IS NOT NULL")
    once = dedup.first_by(routed, X.norm_title(F.col("title")), "ord")
    return rank.digest_cap(once, now, most).select("ord", "source_key", "title", "stream", F.col("published"))


def pool(feed_items: DataFrame, own_items: DataFrame, now: Column) -> DataFrame:
    """The two-section pool of rows (ord, source, title, link, published raw, summary): others' items,
    once by headline, not published yet, through the pre-filter, and within 26 hours."""
    others = sets.except_self(feed_items, own_items)
    once = dedup.first_by(others, X.norm_title(F.col("title")), "ord")
    fresh = dedup.already_published(once, own_items).where(P.prefilter(F.col("title"), F.col("summary")))
    return fresh.withColumn("age_hours", X.age_hours(F.col("published"), now)).where(P.within_window(F.col("age_hours")))


def gifts(found: DataFrame, people: DataFrame) -> DataFrame:
    """Triage of rows (ord, title, link, source): amount, known people, hints and bucket, ranked."""
    once = dedup.first_by_count(found, X.norm_title(F.col("title"))).where(P.gift_triage(F.col("title")))
    named = scoring.known_people(once, people)
    hint, outlet = F.col("title").rlike(fixed.COMMUNITY_HINT), F.col("source").rlike(fixed.COMMUNITY_OUTLET)
    amount = X.max_amount(F.col("title"))
    full = named.withColumns({"amount": amount, "hint": hint, "outlet_hint": outlet, "bucket": scoring.gift_bucket(F.size("known_person") > 0, hint, outlet, amount)})
    return rank.gift_rank(full)


def events(pages: DataFrame, today: Column, sector: Column | None = None) -> DataFrame:
    """Events of pages(url, html): schema.org first, text dates only for pages without; within the
    horizon, scored, once by page and title and once overall."""
    from gazelark.sources import markup

    described = markup.jsonld_events(pages)
    rest = pages.join(described.select(F.col("page").alias("url")).distinct(), "url", "left_anti")
    found = described.unionByName(markup.dated_events(rest, today)).where(P.in_horizon(F.col("date"), today))
    scored = found.withColumns({"org": X.host_of(F.col("url")), "news_score": scoring.newsworthy(F.col("title"), sector if sector is not None else F.lit(""))})
    key = lambda n: F.concat_ws("|", F.col("date").cast("string"), X.event_title_key(F.col("title"), n))
    by_page = dedup.first_by(scored, F.concat_ws("|", "page", key(60)), F.desc("news_score"), "title")
    return dedup.first_by(by_page, key(50), "date", "org", "title")


def baseline(fetched: DataFrame) -> DataFrame:
    """key, at: claims for everything that is there on a first run, with nothing sent."""
    return fetched.select(F.explode(X.keys_for(F.col("url"), F.col("title"))).alias("key"), F.coalesce("published", F.current_timestamp()).alias("at")).groupBy("key").agg(F.min("at").alias("at"))


def screened_queue(spark: SparkSession, held: DataFrame, queue: DataFrame, now: Column, judge=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(released, queue left, dropped): held rows wait; once due, the judge's kept rows are released;
    rows past their time are dropped and to be claimed. Without a verdict the latest QUEUE_ENTRIES keep waiting."""
    from gazelark.operators.observe import queue_state
    from gazelark.operators.screen import screened

    waiting = dedup.written(joins.queue_add(queue, held))
    age = X.hours_between(F.col("queued_at"), now)
    dropped, left = waiting.where(age >= fixed.QUEUE_OVERDUE_HOURS), waiting.where(age < fixed.QUEUE_OVERDUE_HOURS)
    state = queue_state(left, now, fixed.QUEUE_DUE, fixed.QUEUE_DUE_MINUTES, fixed.QUEUE_OVERDUE_HOURS).first()  # one row
    if not state["due"] or judge is None:
        return left.where(F.lit(False)), rank.waiting_cap(left), dropped
    verdicts = dedup.written(screened(left, judge, id_column="url"))  # the judge is asked once for the three results
    return verdicts.where("kept").drop("kept"), rank.waiting_cap(verdicts.where("kept IS NULL").drop("kept")), dropped.unionByName(verdicts.where("NOT kept").drop("kept"))

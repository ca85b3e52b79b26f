"""Caps, orders, batches and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazelark import fixed
from gazelark.functions import predicates as P
from gazelark.functions import text as X
from gazelark.operators.scoring import bucket_rank
from gazelark.shared import checkpointed as written


def first_n(df: DataFrame, n: int, by: list[str], *order: Column | str) -> DataFrame:
    """The first n rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn("_gz_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_gz_rank") <= n).drop("_gz_rank")


def effective(now: Column) -> Column:
    return F.coalesce("effective_date", "published", now)


def per_source_cap(items: DataFrame, now: Column, most: int = fixed.MAX_PER_SOURCE) -> DataFrame:
    return first_n(items, most, ["source_key"], effective(now).desc(), "ord")


def first_n_entries(entries: DataFrame, most: int = fixed.PER_SOURCE_ENTRIES) -> DataFrame:
    return first_n(entries, most, ["source_key"], "ord")


def digest_order(items: DataFrame, now: Column) -> DataFrame:
    return items.orderBy(effective(now).desc(), "ord")


def digest_cap(items: DataFrame, now: Column, most: int = fixed.MAX_ITEMS) -> DataFrame:
    """The first `most` items after the cap per source; the rest is held and stays unclaimed."""
    return digest_order(per_source_cap(items, now), now).limit(most)


def bucket_quota(rows: DataFrame, order: list[str], most: int = 14) -> DataFrame:
    """`most` rows over all buckets, in the buckets' order."""
    return rows.withColumn("bucket_rank", bucket_rank(F.col("bucket"), order)).orderBy("bucket_rank", "ord").limit(most)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `place`, from 1, in the order of columns `order`.

    Places come from ranges: each range is numbered by itself and starts after those before it, so no
    task holds all rows. The ranges are written first, as the numbers must hold when a task is repeated.
    """
    ranged = written(rows.repartitionByRange(*order).withColumn("_gz_range", F.spark_partition_id()))
    counts = ranged.groupBy("_gz_range").agg(F.count("*").alias("n"))  # a row a range
    before = counts.select("_gz_range", F.coalesce(F.sum("n").over(Window.orderBy("_gz_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_gz_before"))
    within = F.row_number().over(Window.partitionBy("_gz_range").orderBy(*order))
    return ranged.join(before, "_gz_range").withColumn("place", (F.col("_gz_before") + within).cast("long")).drop("_gz_range", "_gz_before")


def batch_index(rows: DataFrame, size: int, order: list[str]) -> DataFrame:
    """rows with `batch`: `size` consecutive rows each, in the order of columns `order`."""
    return placed(rows, order).withColumn("batch", F.floor((F.col("place") - 1) / size)).drop("place")


def last_titles(titles: DataFrame, most: int = fixed.TITLES_KEPT) -> DataFrame:
    return titles.orderBy(F.desc("at"), F.desc("ord")).limit(most)


def neighbour_lines(lines: DataFrame, reach: int = 2) -> DataFrame:
    """lines(doc, pos, line) with `near`, the lines up to `reach` before and after, without the line."""
    w = Window.partitionBy("doc").orderBy("pos")
    near = F.concat(F.collect_list("line").over(w.rowsBetween(-reach, -1)), F.collect_list("line").over(w.rowsBetween(1, reach)))
    return lines.withColumn("near", near)


def gift_rank(gifts: DataFrame, order: list[str] = fixed.GIFT_BUCKETS) -> DataFrame:
    return gifts.orderBy(bucket_rank(F.col("bucket"), order), F.desc("amount"), "ord")


def event_rank(events: DataFrame, today: Column, most: int = 25) -> DataFrame:
    """Those that open today first, then by score."""
    return events.orderBy((F.col("date") != today).cast("int"), F.desc("news_score"), "title").limit(most)


def events_listing(events: DataFrame, today: Column, days: int = 60, least: int = 3, most: int = 40) -> DataFrame:
    return events.where(P.in_horizon(F.col("date"), today, days) & (F.col("news_score") >= least)).orderBy("date", F.desc("news_score"), "title").limit(most)


def pool_cap(items: DataFrame, most: int = fixed.POOL_LIMIT) -> DataFrame:
    return items.orderBy(F.col("published").desc_nulls_last(), "ord").limit(most)


def queue_cap(queue: DataFrame, most: int = fixed.QUEUE_ENTRIES) -> DataFrame:
    """The entries added last."""
    return queue.orderBy(F.desc("ord")).limit(most)


def waiting_cap(queue: DataFrame, most: int = fixed.QUEUE_ENTRIES) -> DataFrame:
    """The entries that were queued last, of a queue without numbers."""
    return queue.orderBy(F.desc("queued_at"), F.desc("url")).limit(most)


def log_cap(log: DataFrame, now: Column, days: int = fixed.LOG_DAYS, most: int = fixed.LOG_ENTRIES) -> DataFrame:
    """The entries added last, of the last days; those without a time stay."""
    recent = F.coalesce(F.col("at") >= now - F.make_dt_interval(F.lit(days)), F.lit(True))
    return log.where(recent).orderBy(F.desc("ord")).limit(most)


def org_query_batches(orgs: DataFrame, most: int = 120, size: int = 10) -> DataFrame:
    """batch, query: the largest organisations once by name, ten quoted names to a disjunction."""
    once = first_n(orgs.where("name <> ''").withColumn("_gz_low", F.lower("name")), 1, ["_gz_low"], F.desc("revenue"), "name").drop("_gz_low")
    top = once.orderBy(F.desc("revenue"), "name").limit(most)  # bounded: the list of a search job
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("revenue"), "name")))
    named = F.struct("rank", F.concat(F.lit('"'), "name", F.lit('"')).alias("q"))
    return ranked.groupBy(F.floor((F.col("rank") - 1) / size).alias("batch")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(named)), lambda x: x["q"]), " OR ").alias("query"))


def title_case(c: Column) -> Column:
    """Every run of letters in title case."""
    parts = F.split(F.lower(c), r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")


def clean_org_name(name: Column, aliases: dict[str, str] | None = None, acronyms: list[str] = fixed.ACRONYMS, generic: list[str] | None = None) -> Column:
    """A name that is worth a quoted search, or null.

    Without a legal suffix; an alias stands for its name; acronyms in capitals, other words in title
    case but for small ones; without a leading The; six words at most, none of them a small one at the
    end. Names under 8 letters, generic ones and those without a word in title case are null.
    """
    edge = lambda c, marks: F.regexp_replace(c, rf"^[{marks}]+|[{marks}]+$", "")
    plain = edge(F.regexp_replace(X.collapse(name), fixed.LEGAL_SUFFIX, ""), r" ,.\-")
    alias = F.lit(None).cast("string")
    for long, short in (aliases or {}).items():
        alias = F.when(F.trim(F.lower(plain)) == long.lower(), short).otherwise(alias)

    def cased(w: Column, i: Column) -> Column:
        bare = edge(w, r".,&\-")
        return F.when(F.upper(bare).isin(acronyms), F.upper(bare)).when((i > 0) & F.lower(bare).isin(fixed.SMALL_WORDS), F.lower(bare)).otherwise(title_case(w))

    whole = edge(F.regexp_replace(F.array_join(F.transform(F.split(plain, " "), cased), " "), "^The ", ""), r" ,.\-&")
    words = F.split(whole, " ")
    cut = F.when(F.size(words) > 6, edge(F.array_join(F.slice(words, 1, 6), " "), r" ,.\-&")).otherwise(whole)
    small = "|".join([*fixed.SMALL_ENDS, "&"])
    ended = F.trim(F.regexp_replace(cut, rf"(?i)\s+\b({small})$", ""))
    fit = ~ended.rlike(r"(?i)\b(of|the|and|for|&)$") & (F.length(ended) >= 8) & ended.rlike("[A-Z][a-z]+") & ~F.lower(ended).isin(list(generic or []) or [""])
    return F.coalesce(alias, F.when(fit, ended))


def standing_queries(recipients: DataFrame, templates: list[str]) -> DataFrame:
    """query: every recipient in every template (`{}`) of a job's list."""
    each = F.explode(F.array(*[F.lit(t) for t in templates]))
    return recipients.select("recipient", each.alias("template")).select(F.replace("template", F.lit("{}"), F.col("recipient")).alias("query"))


def build_query(sources: DataFrame, self_domains: list[str]) -> DataFrame:
    """key, query, accept: the search and the publishers accepted, of site and entity sources."""
    from gazelark.fixed import QUERY_EXCLUSIONS

    site = F.col("method") == "gnews"
    with_query = F.concat_ws(" ", F.concat(F.lit("site:"), "url"), F.nullif("query", F.lit("")))
    entity = F.concat_ws(" ", "query", F.lit(" ".join(f"-site:{d}" for d in self_domains)), F.lit(QUERY_EXCLUSIONS))
    named = F.when(F.size(F.coalesce("publisher", F.array().cast("array<string>"))) > 0, F.col("publisher")).otherwise(F.array("outlet"))
    accept = F.when(site, F.concat(named, F.array(F.replace("url", F.lit("www."), F.lit(""))))).otherwise(F.array().cast("array<string>"))
    return sources.select("key", F.when(site, with_query).otherwise(entity).alias("query"), accept.alias("accept"))


def search_url(query: Column, window_minutes: Column, base: str = "https://news.google.com/rss/search?hl=en-US&gl=US&ceid=US:en&q=") -> Column:
    """The search's address; its days cover the window, at least one."""
    days = F.greatest(F.lit(1), F.ceil(window_minutes / 1440))
    return F.concat(F.lit(base), F.url_encode(F.concat(query, F.lit(" when:"), days.cast("string"), F.lit("d"))))

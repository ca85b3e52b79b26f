"""Filters as boolean column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazelark import fixed
from gazelark.functions import text as X


def _any_in(c: Column, parts: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(c, p)) if parts else F.lit(False)


def fresh(published: Column, now: Column, window_minutes: Column) -> Column:
    """Undated or no older than the window."""
    return published.isNull() | (X.hours_between(published, now) * 60 <= window_minutes)


def fresh_undated(first_seen: Column, now: Column, window_minutes: Column) -> Column:
    """Undated items age from when they were first seen, for half an hour at least."""
    seen = F.coalesce(first_seen, now)
    return X.hours_between(seen, now) * 60 <= F.greatest(window_minutes, F.lit(fixed.UNDATED_MINUTES))


def within_window(age: Column, limit: float = fixed.AGE_LIMIT_HOURS) -> Column:
    return age.isNull() | (age <= limit)


def in_horizon(day: Column, today: Column, days: int = fixed.HORIZON_DAYS) -> Column:
    return day.between(today, F.date_add(today, days))


def opinion_category(categories: Column) -> Column:
    return F.arrays_overlap(categories, F.array(*[F.lit(c) for c in fixed.OPINION_CATEGORIES]))


def publisher_matches(publisher: Column, accept: Column) -> Column:
    """Not on the blocklist, and one of those accepted (contained either way), if any are named."""
    p = F.lower(publisher)
    named = F.transform(F.filter(accept, lambda a: a != ""), F.lower)
    return ~_any_in(p, fixed.PUBLISHER_BLOCKLIST) & ((F.size(accept) == 0) | F.exists(named, lambda a: F.contains(p, a) | F.contains(a, p)))


def looks_like_spam(title: Column) -> Column:
    token = F.regexp_extract(title, fixed.SPAM_TOKEN, 1)
    mixed = token.rlike("[a-z]") & token.rlike("[A-Z0-9]")
    return title.rlike(fixed.SPAM_TITLE) | title.rlike(fixed.STYLED_UNICODE) | title.rlike(fixed.SYMBOL_SOUP) | title.rlike(fixed.FIXTURE) | mixed


def self_domain(url: Column, domains: list[str]) -> Column:
    return _any_in(F.lower(url), domains)


def url_path_veto(url: Column, paths: list[str]) -> Column:
    return _any_in(F.lower(url), paths)


def short_title_veto(title: Column) -> Column:
    return F.length(X.strip(title)) < fixed.MIN_TITLE_CHARS


def question_veto(title: Column) -> Column:
    return X.strip(title).endswith("?")


def prefilter(title: Column, summary: Column) -> Column:
    """A convened event stays whatever else; crime, combat, sport and opinion go."""
    blob = F.concat_ws(" ", title, F.substring(F.coalesce(summary, F.lit("")), 1, 160))
    return blob.rlike(fixed.CONVENED) | ~(blob.rlike(fixed.HARD_DROP) | title.rlike(fixed.OPINION))


def gift_triage(title: Column, minimum: int = fixed.GIFT_MINIMUM) -> Column:
    """Reads like a gift in dollars, and not like business, politics or a campaign's total."""
    amount = X.max_amount(title)
    reads = title.rlike(fixed.GIFT_LANG) & ~title.rlike(fixed.NOT_GIFT) & ~title.rlike(fixed.FOREIGN) & ~title.rlike(fixed.POLITICAL) & ~title.rlike(fixed.CAMPAIGN_TOTAL)
    return reads & F.when(amount > 0, amount >= minimum).otherwise(title.rlike(fixed.COMMUNITY_HINT))


def online_only(title: Column, place: Column, score: Column) -> Column:
    """Held online, and not important enough to list all the same."""
    return F.concat_ws(" ", title, place).rlike(r"(?i)\b(zoom|webinar|virtual|online|livestream)\b") & (score < 6)


def dated_page(page: Column) -> Column:
    """A date within the first 20,000 characters."""
    return F.substring(page, 1, 20_000).rlike(r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2}\b|\b20\d\d-\d{2}-\d{2}\b")


def has_title_url(title: Column, url: Column) -> Column:
    return (F.coalesce(title, F.lit("")) != "") & (F.coalesce(url, F.lit("")) != "")

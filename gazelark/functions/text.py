"""Scalar text functions as column expressions."""

from __future__ import annotations

import html
import html.entities
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazelark import fixed

# The named entities of HTML 4, and the numbers that stand for Windows characters; a blank that doesn't break is a blank.
_ENTITIES = {name: chr(code) for name, code in html.entities.name2codepoint.items()} | {f"#{n}": html.unescape(f"&#{n};") for n in range(128, 160)} | {"apos": "'", "nbsp": " ", "#160": " "}
_ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body(c) with c computed once, however often it is used; expressions stay small."""
    return F.get(F.transform(F.array(c), body), 0)


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def unescape(c: Column) -> Column:
    """HTML entities, each once: the names of HTML 4 and all numbers; others, and those without a semicolon, stay."""
    known = F.create_map(*[F.lit(x) for pair in sorted(_ENTITIES.items()) for x in pair])

    def character(e: Column) -> Column:
        number = F.when(F.lower(e).startswith("#x"), F.conv(F.substring(e, 3, 6), 16, 10)).when(e.startswith("#"), F.substring(e, 2, 7)).cast("int")
        by_number = let(number, lambda n: F.when(n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).when(n.isNotNull(), "\ufffd"))
        return F.coalesce(F.try_element_at(known, e), by_number, F.concat(F.lit("&"), e, F.lit(";")))

    def whole(text: Column) -> Column:
        return F.array_join(F.zip_with(F.split(text, _ENTITY, -1), F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(1)), lambda p, e: F.concat(p, F.coalesce(character(e), F.lit("")))), "")

    return F.when(F.contains(c, F.lit("&")), let(c, whole)).otherwise(c)


def unescape_all(c: Column) -> Column:
    """Every HTML entity, in Arrow batches; only texts with an ampersand are worth it."""
    import pandas as pd

    @F.pandas_udf("string")
    def every(s: pd.Series) -> pd.Series:
        return s.map(html.unescape, na_action="ignore")

    return F.when(c.contains("&"), every(c)).otherwise(c)


def clean(c: Column) -> Column:
    """Tags to blanks, entities, stray Windows quotes, single blanks. Null is empty."""
    c = unescape(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "))
    return collapse(F.translate(c, "\u0092\u0093\u0094", "’“”"))


def strip_tags(c: Column) -> Column:
    """Tags to nothing, entities, single blanks."""
    return collapse(unescape(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", "")))


def clean_archive(c: Column) -> Column:
    """An archived paragraph as text: tags to nothing, entities, single blanks (one that doesn't break is one)."""
    return strip_tags(c)


def entry_date(published: Column, updated: Column) -> Column:
    """When a feed's entry was published, else changed."""
    return F.coalesce(feed_time(published), feed_time(updated))


def canonical_url(c: Column) -> Column:
    """Without fragment, query and closing slashes, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(?s)[#?].*$", ""), "/+$", ""))


def _without_tail(c: Column, tail: Column, named: Column) -> Column:
    return let(c, lambda x: F.when(named & F.lower(x).endswith(tail), strip(F.substring(x, F.lit(1), F.length(x) - F.length(tail)))).otherwise(x))


def strip_publisher(title: Column, publisher: Column) -> Column:
    """Without a leading date and up to three closing publishers; empty when little is left."""
    t = F.regexp_replace(strip(title), r"^\[\d{4}-\d{2}-\d{2}\]\s*", "")
    low = F.lower(F.coalesce(publisher, F.lit("")))
    for _ in range(3):
        for mark in (" - ", " | "):
            t = _without_tail(t, F.concat(F.lit(mark), low), low != "")
    t = strip(F.regexp_replace(t, r"\s+[-|]\s+[^-|]{3,40}$", ""))
    return let(t, lambda x: F.when(F.length(x) < 15, "").otherwise(x))


def publisher_from_title(title: Column, default: str = "Google News") -> Column:
    found = F.regexp_extract(title, r"\s-\s([^-]+)$", 1)
    return F.when(found != "", strip(found)).otherwise(F.lit(default))


def norm_title(c: Column) -> Column:
    """Headline key: the last dash segment goes, then all but a-z, 0-9 and blanks.

    The segment's dash needs no blank before it, so a late hyphenated word goes as well.
    """
    cut = F.regexp_replace(c, r"(?U)\s*[-–—|]\s*[^-–—|]{2,40}$", "")
    return F.trim(F.regexp_replace(F.lower(cut), "[^a-z0-9 ]", ""))


def event_title_key(c: Column, size: int) -> Column:
    return F.substring(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), 1, size)


def stem(w: Column) -> Column:
    out = None
    for suffix in fixed.SUFFIXES:
        hit = (F.length(w) > len(suffix) + 3) & w.endswith(suffix)
        cut = F.substring(w, F.lit(1), F.length(w) - len(suffix))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(w)


def title_words(c: Column) -> Column:
    """Sorted distinct stems of a headline's words that count."""
    words = F.regexp_extract_all(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("’"), F.lit("'")), F.lit("[a-z0-9']+"), F.lit(0))
    counting = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(fixed.STOPWORDS))
    return F.array_sort(F.array_distinct(F.transform(counting, stem)))


def overlap(a: Column, b: Column) -> Column:
    """Shared part of the shorter word array; 0 where either has fewer than three."""
    enough = (F.size(a) >= fixed.MIN_WORDS) & (F.size(b) >= fixed.MIN_WORDS)
    return F.when(enough, F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(0.0)


def _figures(c: Column, pattern: str) -> Column:
    """array of struct(value, unit); figures that are no number are null."""
    zipped = F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("u"))

    def figure(x: Column) -> Column:
        digits = F.replace(x["n"], F.lit(","), F.lit(""))
        # one point at most, and a digit
        ok = digits.rlike(r"^(\d+\.?\d*|\.\d+)$")
        return F.struct(F.when(ok, digits.try_cast("double")).alias("value"), F.lower(x["u"]).alias("unit"))

    return F.filter(F.transform(zipped, figure), lambda x: x["value"].isNotNull())


def money_amounts(c: Column, strict_units: bool = False) -> Column:
    """Sorted distinct dollar amounts, rounded half to even.

    Units need no word end unless strict_units: `$5 mailboxes` is five million.
    """
    factors = F.create_map(*[F.lit(x) for pair in fixed.UNITS.items() for x in pair])
    figures = _figures(F.coalesce(c, F.lit("")), fixed.MONEY_STRICT if strict_units else fixed.MONEY)
    return F.array_sort(F.array_distinct(F.transform(figures, lambda x: F.bround(x["value"] * F.coalesce(factors[x["unit"]], F.lit(1.0)), 0).cast("bigint"))))


def max_amount(c: Column) -> Column:
    """The largest dollar amount in a gift headline; figures below 1,000 without a unit don't count."""
    c = F.coalesce(c, F.lit(""))
    scale = lambda x: F.when(x["unit"].startswith("b"), x["value"] * 1e9).when(x["unit"].startswith("m"), x["value"] * 1e6)
    signed = F.transform(_figures(c, fixed.GIFT_AMOUNT), lambda x: F.coalesce(scale(x), F.when(x["value"] >= 1000, x["value"]), F.lit(0.0)))
    bare = F.transform(_figures(c, fixed.BARE_AMOUNT), lambda x: F.coalesce(scale(x), F.lit(0.0)))
    return F.coalesce(F.array_max(F.concat(signed, bare)), F.lit(0.0))


def proper_nouns(c: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?<![\p{L}\p{N}_])([A-Z][a-z]{3,})(?![\p{L}\p{N}_])"), F.lit(1))
    return F.array_sort(F.array_except(found, F.array(*[F.lit(w) for w in fixed.NOT_A_NAME])))


def signature(c: Column) -> Column:
    return F.struct(money_amounts(c).alias("money"), proper_nouns(c).alias("names"))


def key_hash(c: Column) -> Column:
    return F.substring(F.sha1(F.lower(strip(c)).cast("binary")), 1, 16)


def url_key(url: Column) -> Column:
    return F.concat(F.lit("u:"), key_hash(canonical_url(url)))


def title_key(title: Column) -> Column:
    """Null for a headline without words that count, so that such headlines don't collide."""
    words = title_words(title)
    return F.when(F.size(words) > 0, F.concat(F.lit("t:"), key_hash(F.array_join(words, " "))))


def keys_for(url: Column, title: Column) -> Column:
    return F.array_compact(F.array(url_key(url), title_key(title)))


def page_signature(page: Column) -> Column:
    return F.substring(F.sha1(page.cast("binary")), 1, 20)


def page_text(page: Column) -> Column:
    """Visible lines of more than two characters."""
    t = F.regexp_replace(F.coalesce(page, F.lit("")), r"(?is)<(script|style|noscript|svg)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?i)</?(p|div|li|br|h[1-6]|tr|td|section|article)[^>]*>", "\n")
    lines = F.transform(F.split(unescape(F.regexp_replace(t, "<[^>]+>", " ")), "\n"), collapse)
    return F.array_join(F.filter(lines, lambda x: F.length(x) > 2), "\n")


def page_title(page: Column, mastheads: list[str] | None = None) -> Column:
    """og:title or <title>, without a masthead and its separator at either end."""
    og = F.regexp_extract(page, r'(?i)property="og:title"\s+content="([^"]+)"', 1)
    title = clean(F.coalesce(F.nullif(og, F.lit("")), F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    for name in mastheads or []:
        name = name.strip(" |-–:")
        if name:
            title = F.regexp_replace(title, rf"(?i)^\s*\Q{name}\E\s*[|:\-–]\s*", "")
            title = F.regexp_replace(title, rf"(?i)\s*[|:\-–]\s*\Q{name}\E\s*$", "")
    return strip(title)


def page_date(page: Column) -> Column:
    """The page's metadata date, or the first `D Mon YYYY` at noon UTC."""
    meta = F.regexp_extract(page, r'(?:article:published_time|datePublished)"?\s*(?:content=|:)\s*"([^"]+)"', 1)
    text = F.regexp_extract(page, r"\b(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+20\d\d)\b", 1)
    short = F.regexp_replace(text, r"^(\d{1,2})\s+([A-Z][a-z]{2})[a-z]*\s+(\d{4})$", "$1 $2 $3 12")
    return F.coalesce(F.nullif(meta, F.lit("")).try_cast("timestamp"), F.try_to_timestamp(F.nullif(short, F.lit("")), F.lit("d MMM yyyy HH")))


def parse_date(raw: Column) -> Column:
    """The date that a text opens with, as YYYY-MM-DD or YYYYMMDD (with or without a time); else null."""
    raw = strip(raw)
    iso, plain = F.regexp_extract(raw, r"^(\d{4}-\d{2}-\d{2})", 1), F.regexp_extract(raw, r"^(\d{8})", 1)
    return F.coalesce(F.try_to_timestamp(F.nullif(iso, F.lit("")), F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.nullif(plain, F.lit("")), F.lit("yyyyMMdd"))).cast("date")


def feed_time(raw: Column) -> Column:
    """RFC 822 or ISO time as a timestamp; without a zone it is UTC."""
    plain = F.regexp_replace(strip(raw), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(
        F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss z")),
        F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss")),
        F.nullif(strip(raw), F.lit("")).try_cast("timestamp"),
    )


def hours_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(3_600_000_000.0)


def age_hours(raw: Column, now: Column) -> Column:
    return F.bround(hours_between(feed_time(raw), now), 1)


def format_age(published: Column, now: Column) -> Column:
    minutes = F.bround(hours_between(published, now) * 60, 0).cast("bigint")
    hours, rest = F.floor(minutes / 60), minutes % 60
    text = (
        F.when(published.isNull() | (minutes < 0), "")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when((hours < 24) & (rest > 0), F.concat(hours.cast("string"), F.lit("h "), rest.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
    )
    return text.otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d ago")))


def preview_for(title: Column, body: Column) -> Column:
    """The outlet's own summary as one sentence, or empty."""
    desc = clean(body)
    norm = lambda s: F.regexp_replace(F.lower(s), "[^a-z0-9 ]", "")
    opening = F.substring(norm(clean(title)), 1, 40)
    head = F.substring(desc, 1, 90)
    sentence = F.regexp_extract(desc, fixed.PREVIEW_SENTENCE, 1)
    unfit = (
        (F.length(desc) < 40)
        | ((opening != "") & F.startswith(norm(desc), opening))
        | desc.rlike(fixed.PREVIEW_BOILERPLATE)
        | head.rlike(fixed.PREVIEW_BYLINE)
        | head.rlike(fixed.PREVIEW_DATELINE)
        | head.rlike(fixed.PREVIEW_WIRE)
    )
    return F.when(~unfit & (F.length(sentence) <= fixed.PREVIEW_CHARS), sentence).otherwise("")


def escape_markup(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def is_english(c: Column) -> Column:
    """Half of the letters or more are ASCII; a text without letters passes."""
    letters = F.length(F.regexp_replace(c, r"\P{L}", ""))
    return (letters == 0) | (F.length(F.regexp_replace(c, "[^A-Za-z]", "")) / F.nullif(letters, F.lit(0)) >= 0.5)


def feed_categories(tags: Column) -> Column:
    return F.array_distinct(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(strip(F.coalesce(t, F.lit(""))))))


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")), "^www\\.", "")


def url_join(base: Column, link: Column) -> Column:
    """Absolute links as they are, rooted ones after the host, others in the page's folder."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    scheme = F.regexp_extract(base, "^(https?:)", 1)
    return (
        F.when(link.rlike("^https?://"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(folder, F.lit("/"), link))
    )


def truncate(c: Column, size: int) -> Column:
    return F.substring(c, 1, size)

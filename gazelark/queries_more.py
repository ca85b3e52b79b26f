"""More registered queries: sources, smaller rules, rendering. Registered beside those of queries.py.

Where SQL can't follow a pattern, `expected` columns of the inline rows state the results by hand.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from gazelark import fixed
from gazelark.functions import predicates as P
from gazelark.functions import text as X
from gazelark.lexicon import consuming_pattern, term_pattern
from gazelark.operators import dedup, joins, observe, rank, scoring, screen, sets
from gazelark.plans import pipelines, render
from gazelark.queries import EVENT_TITLES, ITEMS, KEYED, POOL, SCORED, TOY, Extended, Inline, now, register, sql_list, sql_words, tick_sql
from gazelark.shared import shared_folder
from gazelark.sources import config, markup

# --- sources ---------------------------------------------------------------------------------


def _feed(t):
    """documents as RSS bodies, one for each source and run of 1,000 documents."""
    item = F.concat(F.lit("<item><title>"), X.escape_markup(F.col("title")), F.lit("</title><link>"), "url", F.lit("</link><pubDate>"), F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</pubDate></item>"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("item")))), lambda x: x["item"])
    feed = F.concat_ws(".", "source_key", F.floor(F.col("ord") / 1000).cast("string")).alias("source_key")
    return t.items.groupBy(feed).agg(F.concat(F.lit("<rss><channel>"), F.array_join(items, ""), F.lit("</channel></rss>")).alias("body"))


FEED_SQL = f"SELECT source_key || '.' || ord // 1000 AS source_key, row_number() OVER (PARTITION BY source_key, ord // 1000 ORDER BY ord) - 1 AS ord, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, url AS link FROM ({ITEMS})"


@register("s05_feed_entries", f"SELECT * FROM ({FEED_SQL}) WHERE title <> ''")
def _(t):
    return markup.feed_entries(_feed(t)).select("source_key", F.col("ord").cast("long").alias("ord"), "title", "link")


@register("s01_feed_items", f"SELECT f.source_key, f.link FROM ({FEED_SQL}) f JOIN ({ITEMS}) i ON i.url = f.link WHERE f.title <> '' AND f.ord < 80 AND i.published >= TIMESTAMP '2024-01-01 04:00:00'")
def _(t):
    return markup.feed_items(_feed(t), F.lit("2024-01-01 04:00:00").cast("timestamp")).select("source_key", "link")


def _search_bodies(part, key):
    p = part.select(key.alias("source_key"), "p_partkey", F.when(F.col("p_partkey") % 7 == 0, "Reddit").otherwise("Gulf Herald").alias("publisher"))
    item = F.concat(F.lit("<item><title>Report of the harbour authority number "), F.col("p_partkey").cast("string"), F.lit(" - "), "publisher", F.lit("</title><link>https://x.org/"), F.col("p_partkey").cast("string"), F.lit('</link><source url="y">'), "publisher", F.lit("</source></item>"))
    bodies = p.groupBy("source_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("item")))), lambda x: x["item"]), "").alias("body"))
    odd = F.substring("source_key", 2, 1).cast("int") % 2 == 1
    sources = bodies.select("source_key", F.when(odd, "gnews_entity").otherwise("gnews").alias("method"), F.lit("Desk").alias("outlet"), F.when(odd, F.array().cast("array<string>")).otherwise(F.array(F.lit("herald"))).alias("accept"))
    return bodies, sources


@register("s02_s03_search_items", "SELECT 's' || p_partkey % 10 || '.' || p_partkey // 500 AS source_key, 'Report of the harbour authority number ' || p_partkey AS title, CASE WHEN p_partkey % 2 = 1 THEN 'Gulf Herald' ELSE 'Desk' END AS outlet FROM part WHERE p_partkey % 7 <> 0")
def _(t):
    key = F.concat(F.lit("s"), (F.col("p_partkey") % 10).cast("string"), F.lit("."), F.floor(F.col("p_partkey") / 500).cast("string"))
    bodies, sources = _search_bodies(t("part"), key)
    return markup.search_items(bodies, sources, F.lit("2000-01-01").cast("timestamp"), ["own.org"]).select("source_key", "title", "outlet")


@register("s04_listing_outcomes", "SELECT page_id AS source_key, CASE WHEN len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))) = 0 THEN 'parse_fail' ELSE 'ok' END AS status, len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)))::BIGINT AS links FROM pages")
def _(t):
    return markup.listing_outcomes(t("pages").select(F.col("page_id").alias("source_key"), F.col("html").alias("body")), r'href="([^"]+)"')


@register("s04_listing_links", "SELECT n_regionkey AS region, n - 1 AS ord, 'https://h.org/n/' || n_nationkey AS url FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n FROM nation) WHERE n <= 3")
def _(t):
    anchor = F.concat(F.lit('<a href="/n/'), F.col("n_nationkey").cast("string"), F.lit('">'))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", anchor.alias("a")))), lambda x: F.concat(x["a"], x["a"])), " ")
    listings = t("nation").groupBy(F.col("n_regionkey").alias("source_key")).agg(body.alias("body")).withColumn("base", F.lit("https://h.org/news"))
    return markup.listing_links(listings, r'href="(/n/\d+)"', 3).select(F.col("source_key").alias("region"), F.col("ord").cast("long").alias("ord"), "url")


def _calendars(orders, file):
    block = F.concat(F.lit("BEGIN:VEVENT\r\nSUMMARY:Order\\, number "), F.col("o_orderkey").cast("string"), F.lit("\r\nDTSTART;VALUE=DATE:"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("\r\nLOCATION:Hall "), F.col("o_custkey").cast("string"), F.lit("\r\nEND:VEVENT\r\n"))
    return orders.groupBy(file.cast("string").alias("url")).agg(F.array_join(F.collect_list(block), "").alias("body"))


@register("s09_ics_events", "SELECT o_orderdate::DATE AS date, 'Order, number ' || o_orderkey AS title, 'Hall ' || o_custkey AS place FROM orders")
def _(t):
    return markup.ics_events(_calendars(t("orders"), F.floor(F.col("o_orderkey") / 1000))).select("date", "title", "place")


def _concerts(part):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 200).cast("int"))
    html = F.concat(F.lit("<p>Concert of the old town band "), F.col("p_partkey").cast("string"), F.lit("</p><p>"), F.date_format(day, "MMMM d, yyyy"), F.lit("</p>"))
    return part.select(F.concat(F.lit("https://h.org/"), F.col("p_partkey").cast("string")).alias("url"), html.alias("html"))


@register("s10_dated_pages", "SELECT (DATE '2024-01-01' + (p_partkey % 200)::INTEGER) AS date, 'Concert of the old town band ' || p_partkey AS title FROM part WHERE p_partkey % 200 <= 120")
def _(t):
    return markup.dated_events(_concerts(t("part")), F.lit("2024-01-01").cast("date")).select("date", "title")


ARCHIVE = Extended(Inline("id long, html string, expected string", (
    (1, "<h2>What we watch</h2><p>" + "The council of the old town meets on Monday to talk about the harbour." + "</p><p>short</p><h2>Else</h2><p>" + "y" * 60 + "</p>", "The council of the old town meets on Monday to talk about the harbour."),
    (2, "<h3>Other</h3><p>" + "x" * 70 + "</p>", None), (3, "<h2>What we watch</h2><p>" + "The last section, which no other heading ends, isn't one of the archive's." + "</p>", None),
)),
    f"SELECT ord + 1000, NULL, CASE WHEN ord % 5 > 1 THEN 'Archived item ' || ord || ': ' || trim(regexp_replace(title, '\\s+', ' ', 'g')) END FROM ({ITEMS})",
    lambda t: t.items.select((F.col("ord") + 1000).alias("id"), F.concat(F.lit("<h2>Else</h2><p>"), F.lit("z" * 60), F.lit("</p><h3 class='x'> What we Watch </h3><p>"), F.when(F.col("ord") % 5 == 0, "Read more: ").when(F.col("ord") % 5 == 1, "Subscribe to ").otherwise("<b>Archived</b> item&nbsp;"), F.col("ord").cast("string"), F.lit(": "), X.escape_markup(F.col("title")), F.lit("</p><h2>Next</h2><p>"), F.lit("y" * 60), F.lit("</p>")).alias("html"), F.lit(None).cast("string").alias("expected")),
)


@register("s12_archive_sections", f"SELECT id, expected AS text FROM ({ARCHIVE.sql}) WHERE length(expected) > 55")
def _(t):
    posts = ARCHIVE.frame(t).select(F.col("id").alias("date"), F.lit("").alias("link"), "html")
    return markup.archive_sections(posts, "What we watch").select(F.col("date").alias("id"), "text")


@register("s14_scan_config", "SELECT n_name AS source_key FROM nation WHERE n_regionkey <> 1")
def _(t):
    rows = [{"key": r["n_name"], "outlet": r["n_name"], "method": "rss", "enabled": r["n_regionkey"] != 1} for r in t("nation").collect()]  # 25 rows of a catalogue
    return config.sources(t.spark, rows).select("source_key")


SOURCES = Inline("key string, method string, outlet string, url string, query string, expected string, accepted string", (
    ("a", "gnews", "Herald", "www.h.org", "harbour", "site:www.h.org harbour", "Herald,h.org"), ("b", "gnews", "Desk", "d.org", "", "site:d.org", "Desk,d.org"),
    ("c", "gnews_entity", "Any", "", "\"City Fund\"", "\"City Fund\" -site:own.org " + fixed.QUERY_EXCLUSIONS, ""),
))


@register("q01_build_query", f"SELECT key, expected AS query, accepted AS accept FROM ({SOURCES.sql})")
def _(t):
    rows = SOURCES.frame(t).withColumn("publisher", F.array().cast("array<string>"))
    return rank.build_query(rows, ["own.org"]).select("key", "query", F.array_join("accept", ",").alias("accept"))


ORGS = Inline("id long, name string, expected string", (
    (1, "THE HARBOUR FOUNDATION, INC.", "Harbour Foundation"), (2, "friends of the old town llc", "Friends of the Old Town"), (3, "Acme Co", None), (4, "university of the northern coast and islands of", "University of the Northern Coast"),
    (5, "JCC of the Harbour NY", "JCC of the Harbour NY"), (6, "o'brien-smith hospital corp.", "O'Brien-Smith Hospital"), (7, "HARBOUR HOME", None), (8, "long name of the harbour foundation for", "Long Name of the Harbour Foundation"),
    (9, "harbour committee of the old port against storms", "Harbour Committee"), (10, "  a   museum  of tides ", "A Museum of Tides"), (11, "UJA JDC NYC", None), (12, "1234 5678 90", None), (13, None, None),
))


@register("q05_clean_org_name", f"SELECT id, expected AS name FROM ({ORGS.sql})")
def _(t):
    name = rank.clean_org_name(F.col("name"), {"harbour committee of the old port against storms": "Harbour Committee"}, generic=["harbour home"])
    return ORGS.frame(t).select("id", name.alias("name"))


@register(
    "q05_clean_table",
    "SELECT p_partkey AS id, CASE WHEN length(n) >= 8 THEN n END AS name FROM (SELECT p_partkey, array_to_string(list_transform(string_split(p_name || ' guild', ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' of ' || upper(p_type[1]) || lower(p_type[2:]) AS n FROM part)",
)
def _(t):
    name = F.concat(F.lit("The "), F.upper("p_name"), F.lit(" GUILD OF "), "p_type", F.lit(" AND THE, Inc."))
    return t("part").select(F.col("p_partkey").alias("id"), rank.clean_org_name(F.regexp_replace(name, " AND THE, Inc", ", Inc")).alias("name"))


@register("q06_feed_catalogue", "SELECT c_name AS source, 'https://feeds.example/' || c_custkey AS url, c_custkey % 9 = 0 AS own, replace(lower(c_name), '#', '_') AS key FROM customer")
def _(t):
    feeds = t("customer").select(F.col("c_name").alias("source"), F.concat(F.lit("https://feeds.example/"), F.col("c_custkey").cast("string")).alias("url"), (F.col("c_custkey") % 9 == 0).alias("own"))
    return config.feed_catalogue(feeds)


@register(
    "s11_model_events",
    "SELECT 'https://h.org/' || p_partkey AS url, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'Concert ' || p_partkey END AS title, CASE WHEN p_partkey % 5 <> 0 THEN DATE '2024-01-01' + (p_partkey % 100)::INTEGER END AS day, "
    "CASE WHEN p_partkey % 5 <> 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 6 ELSE 0 END END AS score, CASE WHEN p_partkey % 5 <> 0 THEN CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'gala' END END AS kind FROM part",
)
def _(t):
    def extract(batch):
        out = []
        for i, page in enumerate(batch):
            key = int(page["text"])
            if key % 5:
                out.append({"source": i, "title": f"Concert {key}", "date": str(datetime.date(2024, 1, 1) + datetime.timedelta(days=key % 100)), "scale": "local", "kind": "gala" if key % 3 else "unheard of", "newsworthy": key % 2 == 0})
            out.append({"source": i + len(batch), "title": "of no page", "date": "2024-01-02"})
            out.append({"source": i, "title": "long ago", "date": "2020-01-02"})
        return out

    key = F.col("p_partkey").cast("string")
    pages = t("part").select(F.concat(F.lit("https://h.org/"), key).alias("url"), F.lit("Hall").alias("org"), F.lit("").alias("sector"), key.alias("text"), F.md5(key).alias("sig"))
    read = screen.model_events(pages, extract, F.lit("2024-01-01").cast("date")).where("read")
    return read.select("url", F.explode_outer("events").alias("e")).select("url", F.col("e.title").alias("title"), F.col("e.date").alias("day"), F.col("e.news_score").alias("score"), F.col("e.kind").alias("kind"))


# --- scalar functions and filters ------------------------------------------------------------

PAGE_DATES = Extended(Inline("id long, html string, expected string", (
    (1, '<meta property="article:published_time" content="2024-03-05T10:00:00Z">', "2024-03-05 10:00:00"), (2, "<p>Posted 5 March 2024</p>", "2024-03-05 12:00:00"), (3, "no date", None), (4, "31 Feb 2024", None),
    (5, '"datePublished": "2024-01-02"', "2024-01-02 00:00:00"),
)),
    "SELECT o_orderkey + 1000, NULL, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y-%m-%d 00:00:00') WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%Y-%m-%d 08:30:00') WHEN o_orderkey % 4 = 2 AND year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m-%d 12:00:00') END FROM orders",
    lambda t: t("orders").select(
        (F.col("o_orderkey") + 1000).alias("id"),
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit('<script>{"datePublished": "'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('"}</script>')))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit('<meta property="article:published_time" content="'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('T08:30:00Z"><p>4 May 2021</p>')))
        .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("<p>Order of "), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit(", paid later</p>"))).otherwise(F.lit("<p>of late</p>")).alias("html"),
        F.lit(None).cast("string").alias("expected"),
    ),
)


@register("f21_page_date", f"SELECT id, expected AS at_text FROM ({PAGE_DATES.sql})")
def _(t):
    return PAGE_DATES.frame(t).select("id", F.date_format(X.page_date(F.col("html")), "yyyy-MM-dd HH:mm:ss").alias("at_text"))


@register("f09_stem", f"SELECT DISTINCT unnest({sql_words('title')}) AS stem FROM ({ITEMS})")
def _(t):
    return t.items.select(F.explode(X.title_words(F.col("title"))).alias("stem")).distinct()


TAGS = Extended(
    Inline("id long, tags string", ((1, "News, Opinion "), (2, "Sport"), (3, ""), (4, "LETTERS TO THE EDITOR,x"), (5, "analysis"))),
    f"SELECT p_partkey + 1000, p_type || ' , ' || upper(([{sql_list(fixed.OPINION_CATEGORIES)}])[p_partkey % {2 * len(fixed.OPINION_CATEGORIES)} + 1]) || ',' || p_brand FROM part WHERE p_partkey % {2 * len(fixed.OPINION_CATEGORIES)} < {len(fixed.OPINION_CATEGORIES)} UNION ALL SELECT p_partkey + 1000, p_type || ',' || p_brand FROM part WHERE p_partkey % {2 * len(fixed.OPINION_CATEGORIES)} >= {len(fixed.OPINION_CATEGORIES)}",
    lambda t: t("part").select((F.col("p_partkey") + 1000).alias("id"), F.concat(F.col("p_type"), F.coalesce(F.concat(F.lit(" , "), F.upper(F.get(F.array(*[F.lit(c) for c in fixed.OPINION_CATEGORIES]), (F.col("p_partkey") % (2 * len(fixed.OPINION_CATEGORIES))).cast("int")))), F.lit("")), F.lit(","), "p_brand").alias("tags")),
)
TAG_SQL = "list_transform(string_split(tags, ','), lambda x: lower(trim(x)))"


@register("f29_feed_categories", f"SELECT id, array_to_string(list_sort({TAG_SQL}), '|') AS categories FROM ({TAGS.sql})")
def _(t):
    return TAGS.frame(t).select("id", F.array_join(F.array_sort(X.feed_categories(F.split("tags", ","))), "|").alias("categories"))


@register("p05_opinion_category", f"SELECT id FROM ({TAGS.sql}) WHERE list_has_any({TAG_SQL}, [{sql_list(fixed.OPINION_CATEGORIES)}])")
def _(t):
    return TAGS.frame(t).where(P.opinion_category(X.feed_categories(F.split("tags", ",")))).select("id")


LINKS = Extended(Inline("id long, base string, link string, expected string", (
    (1, "https://h.org/a/b", "/c", "https://h.org/c"), (2, "https://h.org/a/b", "c", "https://h.org/a/c"), (3, "https://h.org", "c", "https://h.org/c"), (4, "https://h.org/a/b", "https://o.org/x", "https://o.org/x"), (5, "https://h.org/a?x=1", "//cdn.org/y", "https://cdn.org/y"),
)),
    "SELECT c_custkey + 1000, NULL, NULL, CASE c_custkey % 3 WHEN 0 THEN 'https://h' || c_nationkey || '.org/c/' || c_custkey WHEN 1 THEN 'https://h' || c_nationkey || '.org/a/' || c_custkey ELSE 'https://o.org/' || c_custkey END FROM customer",
    lambda t: t("customer").select((F.col("c_custkey") + 1000).alias("id"), F.concat(F.lit("https://h"), F.col("c_nationkey").cast("string"), F.lit(".org/a/b?page=2")).alias("base"), F.concat(F.when(F.col("c_custkey") % 3 == 0, "/c/").when(F.col("c_custkey") % 3 == 1, "").otherwise("https://o.org/"), F.col("c_custkey").cast("string")).alias("link"), F.lit(None).cast("string").alias("expected")),
)


@register("f30_url_join", f"SELECT id, expected AS url FROM ({LINKS.sql})")
def _(t):
    return LINKS.frame(t).select("id", X.url_join(F.col("base"), F.col("link")).alias("url"))


@register("f31_truncate", f"SELECT ord, substr(body, 1, 800) AS body FROM ({ITEMS})")
def _(t):
    return t.items.select("ord", X.truncate(F.col("body"), 800).alias("body"))


@register("p10_noise_veto", f"SELECT ord FROM ({ITEMS}) WHERE regexp_matches(title, '{consuming_pattern(TOY.noise)}')")
def _(t):
    return t.items.where(F.col("title").rlike(term_pattern(TOY.noise))).select("ord")


PROMISES = Extended(Inline("id long, title string, vetoed boolean", ((1, "Trader pledges help for the city museum", True), (2, "Trader pledges $2 million for the museum", False), (3, "Trader pledges and donates to museum fund", False), (4, "Nothing given to the city museum today", False))),
    "SELECT c_custkey + 1000, NULL, c_custkey % 4 = 0 FROM customer",
    lambda t: t("customer").select((F.col("c_custkey") + 1000).alias("id"), F.concat("c_name", F.get(F.array(*[F.lit(x) for x in (" pledges help for the city museum", " pledges $3 million for the museum", " pledges and donates to the museum fund", " keeps away from the museum")]), (F.col("c_custkey") % 4).cast("int"))).alias("title"), F.lit(None).cast("boolean").alias("vetoed")),
)


@register("p13_promise_only", f"SELECT id, vetoed FROM ({PROMISES.sql})")
def _(t):
    from gazelark.lexicon import Lexicon

    own = Lexicon.from_config({"gift_axes": [{"name": "giving", "points": 3, "terms": ["donate", "pledge"]}], "gift_promise_terms": ["pledge"]}, (("major_gift", "gift"),))
    v = scoring.score_stream(own.streams[0], own, F.col("title"), F.lit(""), F.lit(""))
    return PROMISES.frame(t).select("id", v["vetoed"].isNotNull().alias("vetoed"))


ONLINE = Extended(Inline("id long, title string, place string, score long, expected boolean", ((1, "Talk on Zoom", "", 3, True), (2, "Talk", "Virtual", 3, True), (3, "Summit webinar", "", 7, False), (4, "Talk", "Hall", 1, False))),
    "SELECT p_partkey + 1000, NULL, NULL, NULL, p_partkey % 3 < 2 AND p_size < 10 FROM part",
    lambda t: t("part").select((F.col("p_partkey") + 1000).alias("id"), F.concat(F.lit("Talk on "), "p_name", F.when(F.col("p_partkey") % 3 == 0, " by Zoom").otherwise("")).alias("title"), F.when(F.col("p_partkey") % 3 == 1, "Virtual").otherwise("Hall").alias("place"), F.when(F.col("p_size") < 10, 1).otherwise(7).cast("long").alias("score"), F.lit(None).cast("boolean").alias("expected")),
)


@register("p17_online_only", f"SELECT id, expected AS online FROM ({ONLINE.sql})")
def _(t):
    return ONLINE.frame(t).select("id", P.online_only(F.col("title"), F.col("place"), F.col("score")).alias("online"))


@register("p18_dated_page", r"SELECT page_id, regexp_matches(substr(html, 1, 20000), '(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2}\b|\b20\d\d-\d{2}-\d{2}\b') AS dated FROM pages")
def _(t):
    return t("pages").select("page_id", P.dated_page(F.col("html")).alias("dated"))


@register("p20_has_title_url", f"SELECT ord FROM ({ITEMS}) WHERE title <> '' AND url <> ''")
def _(t):
    return t.items.where(P.has_title_url(F.col("title"), F.col("url"))).select("ord")


# --- scoring ---------------------------------------------------------------------------------


@register("c01_compiled_terms", " UNION ALL ".join(f"SELECT '{s.name}.{a.name}' AS axis, count(CASE WHEN regexp_matches(replace(title || ' ' || body, '’', ''''), '{consuming_pattern(a.terms)}') THEN 1 END) AS items FROM ({ITEMS})" for s in TOY.streams for a in s.axes))
def _(t):
    axes = [(f"{s.name}.{a.name}", a.pattern) for s in TOY.streams for a in s.axes]
    text = F.replace(F.concat_ws(" ", "title", "body"), F.lit("’"), F.lit("'"))
    counted = t.items.agg(*[F.count_if(text.rlike(p)).alias(n.replace(".", "_")) for n, p in axes])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("axis"), F.col(n.replace(".", "_")).alias("items")) for n, _ in axes])).alias("x")).select("x.*")


@register("c03_admits_gift", f"SELECT ord FROM ({SCORED}) WHERE stream = 'major_gift'")
def _(t):
    s = TOY.streams[0]
    return scoring.scored(t.items, TOY).where(scoring.admits_stream(s, F.col(s.name), F.col("threshold"))).select("ord")


BYLINES = Extended(Inline("id long, author string, expected string", ((1, "By Ana Field", "ana field"), (2, "ANA FIELDING", "ana field"), (3, "", None), (4, None, None), (5, "B. Stone", None))),
    "SELECT c_custkey + 1000, NULL, CASE WHEN c_custkey % 2 = 0 THEN 'ana field' END FROM customer",
    lambda t: t("customer").select((F.col("c_custkey") + 1000).alias("id"), F.concat(F.lit("By "), "c_name", F.when(F.col("c_custkey") % 2 == 0, " and Ana Field").otherwise(" and Anna Fields")).alias("author"), F.lit(None).cast("string").alias("expected")),
)


@register("c06_byline_bypass", f"SELECT id, expected AS byline FROM ({BYLINES.sql})")
def _(t):
    from gazelark.lexicon import Lexicon

    return BYLINES.frame(t).select("id", scoring.byline_bypass(F.col("author"), Lexicon([], bylines=["ana field"])).alias("byline"))


@register("c08_model_news_score", "SELECT doc_id, CASE WHEN quality = 1 THEN 6 ELSE 0 END::BIGINT AS score FROM labels")
def _(t):
    return t("labels").select("doc_id", scoring.model_news_score(F.col("quality") == 1).cast("long").alias("score"))


# --- sets, duplicates, state -----------------------------------------------------------------


@register("d08_union_streams", f"SELECT ord FROM ({ITEMS}) WHERE ord % 3 <> 0 UNION ALL SELECT ord FROM ({ITEMS}) WHERE ord % 2 = 0 OR ord % 3 = 0")
def _(t):
    return sets.union_streams(t.items.where("ord % 3 <> 0"), t.items.where("ord % 2 = 0 OR ord % 3 = 0").drop("body")).select("ord")


@register("d10_except_self", f"SELECT ord FROM ({ITEMS}) WHERE source_key NOT IN (SELECT source FROM documents WHERE doc_id % 100 = 1)")
def _(t):
    return sets.except_self(t.items, t.items.where("ord % 100 = 1"), "source_key").select("ord")


@register("d11_array_sets", f"WITH w AS (SELECT ord, {sql_words('title')} AS words FROM ({ITEMS})) SELECT a.ord, array_to_string(list_sort(list_intersect(a.words, b.words)), ' ') AS shared, array_to_string(list_sort(list_distinct(list_concat(a.words, b.words))), ' ') AS both, array_to_string(list_filter(a.words, lambda x: NOT list_contains(b.words, x)), ' ') AS own FROM w a JOIN w b ON b.ord = a.ord + 1")
def _(t):
    a = t.items.select("ord", X.title_words(F.col("title")).alias("words"))
    b = a.select((F.col("ord") - 1).alias("ord"), F.col("words").alias("next"))
    join = lambda c: F.array_join(F.array_sort(c), " ")
    return a.join(b, "ord").select("ord", join(F.array_intersect("words", "next")).alias("shared"), join(F.array_union("words", "next")).alias("both"), join(F.array_except("words", "next")).alias("own"))


@register("d06_merge_titles", f"SELECT ord FROM ({ITEMS}) ORDER BY published DESC LIMIT 150")
def _(t):
    titles = t.items.select("ord", F.col("published").alias("at"), X.title_words(F.col("title")).alias("words"))
    return dedup.merge_titles(titles.where("ord % 2 = 0"), titles.where("ord % 3 > 0 OR ord % 2 = 1")).select("ord")


@register("r03_forget_titles", f"WITH k AS ({KEYED}) SELECT ord FROM k WHERE ord % 2 = 0 AND ord % 10 <> 0")
def _(t):
    remembered = t.items.where("ord % 2 = 0").select("ord", "url")
    return joins.queue_remove(remembered, t.items.where("ord % 10 = 0").select("url")).select("ord")


#: Headlines of every fourth document were shown; a backfill leaves out what is nearly the same.
SHOWN_SQL = (
    "wx AS (SELECT ord, unnest(words) AS word, len(words) AS n FROM wd), hit AS (SELECT a.ord FROM wx a JOIN wx b ON a.word = b.word AND a.ord <> b.ord AND b.ord % 4 = 0 "
    "GROUP BY a.ord, b.ord, a.n, b.n HAVING count(*) / least(a.n, b.n) >= 0.8 AND least(a.n, b.n) >= 3)"
)


@register("r08_not_shown", f"WITH wd AS (SELECT ord, {sql_words('title')} AS words FROM ({ITEMS})), {SHOWN_SQL} SELECT ord FROM wd WHERE ord NOT IN (SELECT ord FROM hit)")
def _(t):
    worded = t.items.select("ord", "outlet", "url", "title", X.title_words(F.col("title")).alias("words"))
    return pipelines.Tick(TOY, now(), backfill=True)._unposted(worded.drop("words"), None, worded.where("ord % 4 = 0").select("ord", "outlet", "words")).select("ord")


@register("r08_backfill", tick_sql(f"wd AS (SELECT ord, words FROM y), {SHOWN_SQL}", "ord NOT IN (SELECT ord FROM hit)").replace(", g.fresh, g.relevant", ""))
def _(t):
    shown = t.items.where("ord % 4 = 0").select("ord", "outlet", X.title_words(F.col("title")).alias("words"))
    return pipelines.Tick(TOY, now(), backfill=True).gates(t.items, pipelines.baseline(t.items), shown=shown).select("ord", "stream", "unseen", "unique")


@register("r09_pending_queue", "SELECT event_id AS id, CASE WHEN epoch(TIMESTAMP '2024-01-30 12:00:00' - ts) / 3600.0 >= 6 THEN 'dropped' WHEN event_id % 2 = 0 THEN 'released' ELSE 'dropped' END AS outcome FROM events")
def _(t):
    queue = t("events").select(F.col("event_id").cast("string").alias("url"), F.col("ts").cast("timestamp").alias("queued_at"))
    released, left, dropped = pipelines.screened_queue(t.spark, queue.limit(0), queue, F.lit("2024-01-30 12:00:00").cast("timestamp"), judge=lambda rows: {r["url"] for r in rows if int(r["url"]) % 2 == 0})
    mark = lambda df, name: df.select(F.col("url").cast("long").alias("id"), F.lit(name).alias("outcome"))
    return mark(released, "released").unionByName(mark(left, "left")).unionByName(mark(dropped, "dropped"))


@register("r10_fail_closed", "SELECT doc_id AS ord, CASE WHEN lang = 'en' OR source <> 'src0' THEN 'passing' ELSE 'held' END AS outcome FROM documents")
def _(t):
    rows = t("documents").select(F.col("doc_id").alias("ord"), F.array("lang").alias("axes"), F.when(F.col("source") == "src0", "major_gift").otherwise("watching").alias("stream"))
    passing, held = joins.fail_closed(rows, "en", screened=True)
    return passing.select("ord", F.lit("passing").alias("outcome")).unionByName(held.select("ord", F.lit("held").alias("outcome")))


@register("r11_screened", "SELECT doc_id AS ord, doc_id % 3 = 0 AS kept FROM documents")
def _(t):
    return screen.screened(t("documents").select(F.col("doc_id").alias("ord")), lambda batch: {r["ord"] for r in batch if r["ord"] % 3 == 0}).select("ord", "kept")


# --- ranks -----------------------------------------------------------------------------------


@register("t03_gift_rank", "SELECT doc_id AS ord, row_number() OVER (ORDER BY CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, n_chars DESC, doc_id) AS place FROM documents")
def _(t):
    rows = t("documents").select(F.col("doc_id").alias("ord"), F.col("lang").alias("bucket"), F.col("n_chars").alias("amount"))
    # numbered as the operator's rows come: its ranges one after the other, and in each as it sorted them
    ordered = rank.gift_rank(rows, ["fr", "en"]).select("ord", F.monotonically_increasing_id().alias("at"))
    return rank.placed(ordered, ["at"]).select("ord", "place")


ORDERED = "SELECT o_orderdate::DATE AS date, o_orderkey % 7 AS news_score, o_orderpriority || ' ' || o_orderkey AS title FROM orders"


def _ordered(t):
    return t("orders").select(F.to_date("o_orderdate").alias("date"), (F.col("o_orderkey") % 7).alias("news_score"), F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("title"))


@register("t04_event_rank", f"SELECT title FROM ({ORDERED}) ORDER BY (date <> DATE '1996-01-15')::INTEGER, news_score DESC, title LIMIT 25")
def _(t):
    return rank.event_rank(_ordered(t), F.lit("1996-01-15").cast("date")).select("title")


@register("t10_events_listing", f"SELECT title FROM ({ORDERED}) WHERE date BETWEEN DATE '1996-01-15' AND DATE '1996-03-15' AND news_score >= 3 ORDER BY date, news_score DESC, title LIMIT 40")
def _(t):
    return rank.events_listing(_ordered(t), F.lit("1996-01-15").cast("date")).select("title")


@register("t07_queue_cap", f"SELECT ord FROM ({ITEMS}) ORDER BY ord DESC LIMIT 60")
def _(t):
    return rank.queue_cap(t.items).select("ord")


@register("t07_log_cap", f"SELECT ord FROM ({ITEMS}) WHERE published >= TIMESTAMP '2024-01-15 01:00:00' - INTERVAL 14 DAY ORDER BY ord DESC LIMIT 3000")
def _(t):
    return rank.log_cap(t.items.withColumn("at", F.col("published")), F.lit("2024-01-15 01:00:00").cast("timestamp")).select("ord")


# --- telemetry and rendering -----------------------------------------------------------------


@register("a09_healthy_ratio", "SELECT count(CASE WHEN ok THEN 1 END) AS healthy, count(*) AS total, string_agg(CASE WHEN NOT ok THEN n_name END, ',' ORDER BY n_name) AS unhealthy FROM (SELECT n_name, n_regionkey <> 2 AS ok FROM nation)")
def _(t):
    return observe.healthy_ratio(t("nation").select(F.col("n_name").alias("source_key"), F.when(F.col("n_regionkey") != 2, "ok").otherwise("STALE").alias("verdict")))


HEALTH = Inline("id long, error string, delivered boolean, last_posted string, judge_blocked boolean, expected string", (
    (1, None, True, "2024-01-01 20:00:00", False, ""), (2, "boom", True, "2024-01-01 20:00:00", False, "critical:run_error"), (3, None, False, "2024-01-01 00:00:00", False, "critical:delivery,warning:silence"), (4, None, True, "2024-01-01 20:00:00", True, "warning:judge_quota"),
))


@register("k08_health", f"SELECT id, expected AS findings FROM ({HEALTH.sql}) WHERE expected <> ''")
def _(t):
    rows = HEALTH.frame(t).withColumn("last_posted_at", F.col("last_posted").cast("timestamp"))
    out = None
    for i in range(1, 5):
        own = observe.run_health(rows.where(F.col("id") == i), now()).select(F.lit(i).cast("long").alias("id"), F.concat_ws(":", "severity", "kind").alias("f"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("f")), ",").alias("findings"))


@register("k02_gifts_digest", "SELECT '*b one*\n• <l1|A &amp; B>\n• <l3|C>\n*b two*\n• <l2|D>' AS text")
def _(t):
    rows = t.spark.createDataFrame([(1, "b one", "l1", "A & B"), (2, "b two", "l2", "D"), (3, "b one", "l3", "C")], "ord long, bucket string, link string, title string")
    return render.gifts_digest(rows, ["b one", "b two"])


@register("k03_events_digest", "SELECT '• Opens today: <u2|Gala>, Hall\n• Continues today: <u1|Fair>' AS text")
def _(t):
    rows = t.spark.createDataFrame([("2024-01-01", "2024-01-05", "Fair", "u1", "", 5), ("2024-01-03", None, "Gala", "u2", "Hall", 2), ("2024-01-09", None, "Late", "u3", "", 9)], "date string, end_date string, title string, url string, place string, news_score int")
    return render.events_digest(rows.withColumns({"date": F.col("date").cast("date"), "end_date": F.col("end_date").cast("date")}), F.lit("2024-01-03").cast("date"))


@register("k04_section_render", "SELECT * FROM (VALUES ('major_gift', '_Chosen by rules; no model was available._\n• one\n• two (?)'), ('watching', '_Chosen by rules; no model was available._\n• three')) AS t(section, text)")
def _(t):
    rows = t.spark.createDataFrame([(1, "major_gift", "one", "high"), (2, "major_gift", "two", "low"), (3, "watching", "three", "high")], "ord long, section string, line string, confidence string")
    return render.section_render(rows, degraded=True)


@register(
    "k07_status_document",
    f"""SELECT '{{"items":{{"fetched":' || count(*) || ',"fresh":' || count(CASE WHEN ord % 2 = 0 THEN 1 END) || '}},"sources":{{' || (SELECT string_agg('"' || n_name || '":{{"status":"ok","items_in_window":1,"entries_in_feed":2}}', ',' ORDER BY n_name) FROM nation) || '}}}}' AS json FROM ({ITEMS})""",
)
def _(t):
    counts = observe.gate_counts(t.items.select((F.col("ord") % 2 == 0).alias("fresh")), ["fresh"])
    outcomes = t("nation").select(F.col("n_name").alias("source_key"), F.lit("ok").alias("status"), F.lit(1).alias("items_in_window"), F.lit(2).alias("entries_in_feed"))
    return render.status_document(counts, outcomes)


@register("k10_fixture_builder", f"SELECT DISTINCT title FROM ({POOL.sql}) WHERE NOT regexp_matches(title, '{fixed.CONVENED}') UNION SELECT title FROM ({EVENT_TITLES.sql}) WHERE NOT regexp_matches(title, '{fixed.CONVENED}')")
def _(t):
    titles = POOL.frame(t).select("title").unionByName(EVENT_TITLES.frame(t).select("title"))
    return titles.where(~F.col("title").rlike(fixed.CONVENED)).dropDuplicates(["title"])


# --- documents of a run ----------------------------------------------------------------------


@register("k06_saved_state", "SELECT user_id::VARCHAR AS key, min(ts) AS \"at\" FROM events GROUP BY user_id")
def _(t):
    path = f"{shared_folder(t.spark)}/state-{uuid.uuid4().hex}"
    state = lambda part: t("events").where(part).groupBy(F.col("user_id").cast("string").alias("key")).agg(F.min("ts").cast("timestamp").alias("at"))
    config.save(state("event_id % 2 = 0"), path)
    config.save(dedup.merge_state(config.saved(t.spark, path, config.STATE), state("event_id % 2 = 1")), path)
    return config.saved(t.spark, path, config.STATE)


@register("w08_last_brief", "SELECT max(ts) AS \"at\" FROM events WHERE event_type = 'click'")
def _(t):
    return observe.last_brief(t("events").select(F.when(F.col("event_type") == "click", "brief").otherwise("post").alias("kind"), F.col("ts").alias("at")))


@register(
    "k09_health_text",
    "SELECT '*Run health*' || chr(10) || string_agg(CASE WHEN crit THEN ':rotating_light:' ELSE ':warning:' END || ' ' || n_name || ' is unwell', chr(10) ORDER BY NOT crit, n_name) || chr(10) || '_status: https://h.org/status_' AS text, CASE WHEN bool_or(crit) THEN 1 ELSE 0 END AS exit_code "
    "FROM (SELECT n_name, n_regionkey = 2 AS crit FROM nation)",
)
def _(t):
    findings = t("nation").select(F.col("n_name").alias("kind"), F.when(F.col("n_regionkey") == 2, "critical").otherwise("warning").alias("severity"), F.concat("n_name", F.lit(" is unwell")).alias("text"))
    return observe.health_text(findings, "Run health", "https://h.org/status")


@register(
    "k07_summary",
    "SELECT 'last run   2024-01-01 → 2024-01-02' || chr(10) || 'duration   9s' || chr(10) || 'items      ' || (SELECT count(*) FROM documents) || chr(10) || 'posted     3  delivered=true' || chr(10) || 'last post  never' || chr(10) || 'stale      a, b' || chr(10) || 'unhealthy sources:' || chr(10) "
    "|| string_agg('  ' || rpad(n_name, 22, ' ') || ' empty: none', chr(10) ORDER BY n_name) AS text FROM nation WHERE n_regionkey = 1",
)
def _(t):
    status = t("documents").agg(F.count("*").alias("items")).select(
        F.lit("2024-01-01").alias("started_at"), F.lit("2024-01-02").alias("finished_at"), F.lit(9).alias("seconds"), "items", F.lit(3).alias("posted"), F.lit(True).alias("delivered"), F.lit(None).cast("string").alias("last_posted_at"), F.array(F.lit("a"), F.lit("b")).alias("stale"), F.lit(None).cast("string").alias("error"),
    )
    outcomes = t("nation").select(F.col("n_name").alias("source_key"), F.when(F.col("n_regionkey") == 1, "empty").otherwise("ok").alias("status"), F.lit("none").alias("detail"))
    return render.summarize(status, outcomes)

"""Folds, merges, scoring rules, sources, rendering and streams on small rows."""

import datetime as dt
import json
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gazelark import fixed, lexicon
from gazelark.functions import predicates as P
from gazelark.functions import text as X
from gazelark.operators import dedup, joins, rank, scoring, screen
from gazelark.plans import pipelines, render
from gazelark.sources import config, feeds, markup
from gazelark.streaming import jobs

few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def items(spark, rows):
    """rows of (ord, url, title, outlet)."""
    return spark.createDataFrame(rows, "ord long, url string, title string, outlet string")


def test_in_run_dedup_counts_kept_rows_only(spark):
    rows = [(1, "u1", "harbour opens third terminal", "A"), (2, "u1", "minister visits northern dam", "B"), (3, "u2", "minister visits northern dam", "C")]
    got = {r["ord"]: r["kept"] for r in dedup.dedup_in_run(items(spark, rows)).collect()}
    assert got == {1: True, 2: False, 3: True}


@few
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=1, max_size=12))
def test_in_run_dedup_is_the_greedy_fold(spark, keys):
    rows = [(i, f"https://x/{u}", f"unusual headline number{t} zebra{t}", "A") for i, (u, t) in enumerate(keys)]
    used, expected = set(), {}
    for i, (u, t) in enumerate(keys):
        own = {("u", u), ("t", t)}
        expected[i] = not own & used
        if expected[i]:
            used |= own
    assert {r["ord"]: r["kept"] for r in dedup.dedup_in_run(items(spark, rows)).collect()} == expected


@few
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=20))
def test_greedy_fold_of_random_edges(spark, pairs):
    edges = {(min(a, b), max(a, b)) for a, b in pairs if a != b}
    expected: dict = {}
    for b in range(10):
        expected[b] = not any(expected[a] for a, x in edges if x == b)
    frame = spark.createDataFrame(list(edges), "a long, b long") if edges else spark.range(0).selectExpr("id AS a", "id AS b")
    assert {r["ord"]: r["kept"] for r in dedup.greedy_fold(spark.range(10).withColumnRenamed("id", "ord"), frame).collect()} == expected


def test_greedy_fold_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(21), 50, 51, 99]], "ord long")
    assert {r["ord"]: r["kept"] for r in dedup.greedy_fold(nodes, edges).collect()} == {**{i: i % 2 == 0 for i in range(21)}, 50: True, 51: False, 99: True}


def test_similar_pairs_of_a_frequent_word(spark):
    """A word of every headline meets none by itself; pairs are those of all comparisons."""
    rows = [(i, f"o{i % 3}", ["common", "often"][: 1 + i % 2] + [f"w{i % 7}", f"x{i % 5}", f"y{i}"]) for i in range(60)]
    df = spark.createDataFrame(rows, "ord long, outlet string, words array<string>")
    got = {(r["l_ord"], r["r_ord"]): r["overlap"] for r in dedup.similar_pairs(df, df).collect()}
    brute = {(a[0], b[0]): len(set(a[2]) & set(b[2])) / min(len(a[2]), len(b[2])) for a in rows for b in rows if a[1] != b[1]}
    assert got == {k: v for k, v in brute.items() if v >= 0.5}
    met = dedup.similar_pairs(df.limit(0), df)
    assert met.isEmpty()


def test_cross_outlet_fold(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [
        (1, "A", "ADNOC awards $1bn+ offshore EPCI contract to McDermott", t0), (2, "B", "McDermott wins $1 billion ADNOC offshore contract", t0 + dt.timedelta(hours=1)),
        (3, "A", "McDermott wins $1 billion ADNOC offshore contract again", t0 + dt.timedelta(hours=2)), (4, "C", "US revokes Iran oil waivers", t0),
        (5, "D", "U.S. strikes Iran after attacks on vessels in Strait of Hormuz", t0), (6, "A", "Robert Kraftson says singer asked him to match $2M", t0), (7, "B", "Patriots owner Kraftson pledges $2 million", t0 + dt.timedelta(hours=1)),
    ]
    df = spark.createDataFrame(rows, "ord long, outlet string, title string, effective_date timestamp")
    got = {r["ord"]: r["kept"] for r in dedup.dedup_cross_outlet(df).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: True, 6: True, 7: False}


@pytest.mark.parametrize(("a", "b", "expected"), [
    ("ADNOC awards $1bn+ offshore EPCI contract to McDermott", "McDermott wins $1 billion ADNOC offshore contract", 0.67),
    ("UAE-Egypt activate $500mln five-year wheat supply agreement", "UAE company begins wheat supplies to Egypt in $500m deal", 0.38),
    ("Dubai's DXB Posts 31% Fall In H1 Passenger Traffic", "War cuts Dubai airport passenger traffic by nearly a third", 0.33),
    ("US revokes Iran oil waivers", "U.S. strikes Iran after attacks on vessels in Strait of Hormuz", 0.25),
])
def test_overlap_examples(spark, a, b, expected):
    row = spark.range(1).select(X.overlap(X.title_words(F.lit(a)), X.title_words(F.lit(b))).alias("o"), X.overlap(X.title_words(F.lit(b)), X.title_words(F.lit(a))).alias("p")).first()
    assert round(row["o"], 2) == expected and row["o"] == row["p"]


@few
@given(*[st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 50), max_size=6) for _ in range(3)])
def test_state_merge_commutes_and_associates(spark, a, b, c):
    frame = lambda d: spark.createDataFrame([(k, dt.datetime(2024, 1, 1, 0, v)) for k, v in d.items()], config.STATE)
    rows = lambda df: {r["key"]: r["at"] for r in df.collect()}
    left = rows(dedup.merge_state(dedup.merge_state(frame(a), frame(b)), frame(c)))
    assert left == rows(dedup.merge_state(frame(c), dedup.merge_state(frame(b), frame(a))))
    assert {k: v.minute for k, v in left.items()} == {k: min(d[k] for d in (a, b, c) if k in d) for k in a | b | c}


def test_titles_are_capped(spark):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), [f"w{i}"]) for i in range(200)]
    a = spark.createDataFrame(rows[:150], "at timestamp, words array<string>")
    b = spark.createDataFrame(rows[50:], "at timestamp, words array<string>")
    out = dedup.merge_titles(a, b).collect()
    assert len(out) == fixed.TITLES_KEPT and min(r["at"] for r in out) == rows[50][0]


SCORED = lexicon.Lexicon.from_config({
    "gift_axes": [{"name": "giving", "points": 3, "terms": ["donate", "pledge"]}, {"name": "recipient", "points": 2, "terms": ["museum"]}],
    "gift_threshold": 4, "gift_require_anchor": ["giving"], "gift_require_companion": ["money", "recipient"], "gift_min_title_axes": 1,
    "watching_axes": [{"name": "convening", "points": 4, "terms": ["gala", "summit"]}, {"name": "local", "points": 1, "terms": ["neighbour"]}],
    "watching_threshold": 4, "watching_require_anchor": ["convening"], "watching_relevance_axis": "local", "watching_threshold_off_axis": 5,
    "noise": ["lottery"], "gift_promise_terms": ["pledge"], "byline_bypass": ["ana field"],
})


@pytest.mark.parametrize(("title", "body", "author", "threshold", "stream"), [
    ("Trader donates to the city museum", "", "", None, "major_gift"),
    ("Trader donated to the city museum", "", "", None, "major_gift"),
    ("Trader donates to the city museum lottery", "", "", None, None),
    ("Donates museum", "", "", None, None),
    ("Will the trader donate to the museum?", "", "", None, None),
    ("Trader pledges help for the museum", "", "", None, None),
    ("Trader pledges $2 million for the museum", "", "", None, "major_gift"),
    ("Trader visits the city museum today", "he donates", "", None, None),
    ("Summit of the region opens on Monday", "", "", None, None),
    ("Summit of the region opens on Monday", "for every neighbour", "", None, "watching"),
    ("Gala: trader donates to the city museum", "neighbour", "", None, "major_gift"),
    ("Nothing of interest happens here today", "", "By Ana Field", None, "major_gift"),
    ("Trader donates to the city museum", "", "", 9, None),
])
def test_routing_rules(spark, title, body, author, threshold, stream):
    df = spark.createDataFrame([(1, title, body, author, threshold)], "ord long, title string, body string, author string, threshold int")
    assert scoring.route(df, SCORED).first()["stream"] == stream


def test_prefilter_and_publishers(spark):
    row = spark.range(1).select(
        P.publisher_matches(F.lit("Gulf Herald"), F.array(F.lit("herald"))).alias("a"), P.publisher_matches(F.lit("Reddit"), F.array().cast("array<string>")).alias("b"),
        P.dated_page(F.lit("on March 4 we meet")).alias("c"), X.title_key(F.lit("the and of")).alias("d"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["d"]) == (True, False, True, None)


RSS = """<rss><channel><item><title><![CDATA[A &amp; B open harbour]]></title><link>https://x.org/1</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><description>&lt;p&gt;Text&lt;/p&gt;</description></item>
<item><title>Old</title><link>https://x.org/2</link><pubDate>Mon, 01 Jan 2020 10:00:00 +0000</pubDate></item><item><title>View</title><link>https://x.org/3</link><category>Opinion</category></item><item><title>No link</title></item></channel></rss>"""
ATOM = '<feed><entry><title>Entry</title><link rel="x" href="https://y.org/1"/><updated>2024-01-01T09:00:00Z</updated></entry></feed>'


def test_feed_scan(spark, tmp_path):
    (tmp_path / "one.xml").write_text(RSS)
    (tmp_path / "two.xml").write_text(ATOM)
    since = F.lit("2023-12-31").cast("timestamp")
    bodies = feeds.scan_bodies(spark, str(tmp_path))
    got = {(r["source_key"], r["title"], r["link"]) for r in markup.feed_items(bodies, since).collect()}
    assert got == {("one", "A & B open harbour", "https://x.org/1"), ("two", "Entry", "https://y.org/1")}
    fetched = feeds.fetch(spark, [("one", str(tmp_path / "one.xml")), ("gone", str(tmp_path / "none.xml"))])
    assert {(r["source_key"], r["status"], r["error"] is None) for r in fetched.collect()} == {("one", 200, True), ("gone", None, False)}
    assert fetched.where("source_key = 'one'").count() == 1


def test_retries_only_what_can_heal():
    answers = iter([(503, ""), (200, "ok")])
    assert feeds.fetch_with_retries("u", lambda u: next(answers), wait=0)[1] == "ok"
    calls = []
    assert feeds.fetch_with_retries("u", lambda u: calls.append(1) or (404, ""), wait=0)[2] == "HTTP 404" and len(calls) == 1


def test_page_extractors(spark):
    ld = json.dumps({"@graph": [{"@type": "Event", "name": "Gala", "startDate": "2024-05-01T18:00", "location": "Hall", "url": "/g"}, {"@type": "Place", "name": "x"}]})
    html = f'<title>Harbour | Gulf Herald</title><script type="application/ld+json">{ld}</script><a href="/events/">Our events</a><a href="/about">About</a><a href="x.ics">cal</a><p>Spring concert of the town</p><p>March 4, 2024</p><p>Feb 30</p>'
    pages = spark.createDataFrame([("https://h.org/p", html)], "url string, html string")
    assert [(r["date"].isoformat(), r["title"], r["url"]) for r in markup.jsonld_events(pages).collect()] == [("2024-05-01", "Gala", "https://h.org/g")]
    dated = markup.dated_events(pages, F.lit("2024-01-10").cast("date")).collect()
    assert [(r["date"].isoformat(), r["title"]) for r in dated] == [("2024-03-04", "Spring concert of the town")]
    assert [r["link"] for r in markup.calendar_links(pages).collect()] == ["https://h.org/events"]
    assert [r["file"] for r in markup.calendar_files(pages).collect()] == ["https://h.org/x.ics"]
    assert pages.select(X.page_title(F.col("html"), ["Gulf Herald"]).alias("t")).first()["t"] == "Harbour"
    ics = "BEGIN:VEVENT\r\nSUMMARY:Fair\\, big\r\nDTSTART;TZID=X:20240501T100000\r\nLOCATION:Park\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:None\r\nEND:VEVENT"
    got = markup.ics_events(spark.createDataFrame([("u", ics)], "url string, body string")).collect()
    assert [(r["date"].isoformat(), r["title"], r["place"]) for r in got] == [("2024-05-01", "Fair, big", "Park")]
    found = pipelines.events(pages, F.lit("2024-01-10").cast("date")).collect()
    assert [r["title"] for r in found] == ["Gala"]


def test_listing_scan(spark):
    listing = spark.createDataFrame([("s", "https://h.org/news", '<a href="/n/1"><a href="/n/2"><a href="/n/1">')], "source_key string, base string, body string")
    links = markup.listing_links(listing, r'href="(/n/\d+)"')
    assert [(r["ord"], r["url"]) for r in links.orderBy("ord").collect()] == [(0, "https://h.org/n/1"), (1, "https://h.org/n/2")]
    pages = spark.createDataFrame([("https://h.org/n/1", "<title>New bridge opens</title> 3 January 2024"), ("https://h.org/n/2", "<title>Old bridge</title> 3 January 2020")], "url string, html string")
    assert [r["title"] for r in markup.listing_items(links, pages, F.lit("2024-01-04").cast("timestamp"), []).collect()] == ["New bridge opens"]


def test_digest_holds_the_rest(spark):
    rows = [(i, f"s{i % 8}", f"Headline number {i} of the day", f"https://x/{i}", "major_gift", dt.datetime(2024, 1, 1, 0, i)) for i in range(40)]
    df = spark.createDataFrame(rows, "ord long, source_key string, title string, url string, stream string, published timestamp")
    df = df.withColumns({"outlet": F.col("source_key"), "body": F.lit(""), "desk": F.lit(""), "paywall": F.lit(True), "effective_date": F.lit(None).cast("timestamp")})
    out = render.digest(df, F.lit("2024-01-01 01:00:00").cast("timestamp")).first()
    assert len(out["included"]) == fixed.MAX_ITEMS and out["held"] == 8 * 4 - fixed.MAX_ITEMS and out["included"][0] == "https://x/39"
    assert out["text"].splitlines()[0] == "• *<https://x/39|Headline number 39 of the day>*: s7 (paywall) —  · 21m ago"
    sent = []
    assert render.send(spark.createDataFrame([("a", "x"), ("b", "y")], "stream string, text string"), lambda s, text: sent.append(s) if s == "a" else 1 / 0) == {"a": True, "b": False}


def test_patterns_are_matched_once_a_row_whatever_is_asked(spark):
    rows = [(i, "Museum endowment pledge of $2 million", f"body {i}", "") for i in range(4)]
    df = spark.createDataFrame(rows, "ord long, title string, body string, author string").withColumn("threshold", F.lit(None).cast("int"))
    routed = scoring.route(df, SCORED)
    plan = routed.where("stream IS NOT NULL").groupBy("stream").count()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("million") == 1 and "regexp_extract_all" not in routed.select("ord", "watching.score")._jdf.queryExecution().optimizedPlan().toString().split("inline(")[0]


def test_digest_makes_its_items_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def stream(s):
        made.add(1)
        return s

    rows = [(i, f"s{i % 8}", f"Headline number {i} of the day", f"https://x/{i}", "major_gift", dt.datetime(2024, 1, 1, 0, i)) for i in range(40)]
    df = spark.createDataFrame(rows, "ord long, source_key string, title string, url string, stream string, published timestamp")
    df = df.withColumns({"stream": stream("stream"), "outlet": F.col("source_key"), "body": F.lit(""), "desk": F.lit(""), "paywall": F.lit(False), "effective_date": F.lit(None).cast("timestamp")})
    out = render.digest(df, F.lit("2024-01-01 01:00:00").cast("timestamp")).collect()
    assert len(out[0]["included"]) == fixed.MAX_ITEMS and out[0]["held"] == 8 * 4 - fixed.MAX_ITEMS and made.value == 40


def test_queue_and_screening(spark):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    at = lambda m: dt.datetime(2024, 1, 1, 12) - dt.timedelta(minutes=m)
    queue = spark.createDataFrame([("u1", at(65)), ("u2", at(420))], "url string, queued_at timestamp")
    held = spark.createDataFrame([("u1", at(0)), ("u3", at(0))], "url string, queued_at timestamp")
    urls = lambda df: sorted(r["url"] for r in df.collect())
    released, left, dropped = pipelines.screened_queue(spark, held, queue, now, judge=None)
    assert (urls(released), urls(left), urls(dropped)) == ([], ["u1", "u3"], ["u2"])
    released, left, dropped = pipelines.screened_queue(spark, held, queue, now, judge=lambda batch: {"u3"})
    assert (urls(released), urls(left), urls(dropped)) == (["u3"], [], ["u1", "u2"])
    released, left, dropped = pipelines.screened_queue(spark, held, queue, now, judge=lambda batch: None)
    assert (urls(released), urls(left), urls(dropped)) == ([], ["u1", "u3"], ["u2"])
    with pytest.raises(NotImplementedError):
        screen.no_judge([])
    q = screen.Quota(2, "2024-01-01", used=9, ledger_date="2023-12-31")
    assert [q.spend(lambda: 1), q.spend(lambda: 1), q.spend(lambda: 1), q.left] == [1, 1, None, 0]


def test_gifts_and_pool(spark):
    now = F.lit("2024-01-02").cast("timestamp")
    rows = [(1, "Elena Marchetti gives $7 million to museum", "l1", "A"), (2, "Trader gives $9 million to hospital", "l2", "A"), (3, "Fund invests $9 million", "l3", "A"), (4, "Trader gives $9 million to hospital - Herald", "l4", "B")]
    people = spark.createDataFrame([("Elena Marchetti", 3)], "name string, n int")
    got = pipelines.gifts(spark.createDataFrame(rows, "ord long, title string, link string, source string"), people).collect()
    assert [(r["ord"], r["bucket"], r["queries"]) for r in got] == [(1, "known donor", 1), (2, "large secular gift — check donor", 2)]
    assert "*known donor*" in render.gifts_digest(pipelines.gifts(spark.createDataFrame(rows, "ord long, title string, link string, source string"), people)).first()["text"]
    feed = [(1, "A", "City votes on water", "", "2024-01-01T12:00:00Z", ""), (2, "A", "City votes on water!", "", "", ""), (3, "own", "Own story of today", "", "", ""), (4, "B", "Own story of today", "", "", ""), (5, "B", "Man arrested", "", "", ""), (6, "B", "Late news", "", "2023-12-01T00:00:00Z", "")]
    df = spark.createDataFrame(feed, "ord long, source string, title string, link string, published string, summary string")
    assert [(r["ord"], r["age_hours"]) for r in pipelines.pool(df, df.where("source = 'own'"), now).collect()] == [(1, 12.0)]


def test_config_and_saved_documents(spark, tmp_path):
    rows = [{"key": "a", "outlet": "A", "method": "rss", "publisher": "P"}, {"key": "b", "method": "gnews", "url": "www.b.org", "outlet": "B", "enabled": False}, {"key": "c", "method": "gnews", "url": "www.c.org", "outlet": "C"}]
    df = config.sources(spark, rows)
    assert sorted(r["source_key"] for r in df.collect()) == ["a", "c"]
    with pytest.raises(ValueError, match="unknown"):
        config.sources(spark, rows, ["zzz"])
    q = rank.build_query(df.where("source_key = 'c'").withColumnRenamed("source_key", "key"), ["own.org"]).first()
    assert q["query"] == "site:www.c.org" and q["accept"] == ["C", "c.org"]
    (tmp_path / "state").mkdir()
    (tmp_path / "state" / "x.json").write_text('{"key": "k", "at": "2024-01-01T00:00:00Z"}\nbroken\n')
    assert [r["key"] for r in config.saved(spark, str(tmp_path / "state"), config.STATE).collect()] == ["k"]
    assert config.saved(spark, str(tmp_path / "none"), config.STATE).count() == 0


def test_people_are_found_anywhere(spark):
    df = spark.createDataFrame([(1, "joann lee speaks"), (2, None), (3, "Nobody")], "ord long, title string")
    people = spark.createDataFrame([("Ann Lee",), ("Zed Who",)], "name string")
    assert {r["ord"]: r["known_person"] for r in scoring.known_people(df, people).collect()} == {1: ["ann lee"], 2: [], 3: []}


def test_fail_closed(spark):
    df = spark.createDataFrame([(1, "major_gift", ["local"]), (2, "major_gift", []), (3, "watching", [])], "ord int, stream string, axes array<string>")
    passing, held = joins.fail_closed(df, "local", screened=True)
    assert sorted(r["ord"] for r in passing.collect()) == [1, 3] and [r["ord"] for r in held.collect()] == [2]
    assert joins.fail_closed(df, "local", screened=False)[1].count() == 0


def test_stream_claims_once_and_rolls_back(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(i, f"https://x/{i % 3}", f"Unusual headline number{i % 3} zebra{i % 3}") for i in range(6)]
    spark.createDataFrame(rows, "ord long, url string, title string").coalesce(1).write.parquet(str(src))
    claims = jobs.Claims(spark, str(tmp_path / "claims"))
    sent = []

    def run(checkpoint, send):
        stream = spark.readStream.schema("ord long, url string, title string").parquet(str(src))
        return jobs.run_stream(stream, claims, lambda b: b.join(dedup.dedup_in_run(b).where("kept").select("ord"), "ord", "left_semi"), send, str(tmp_path / checkpoint))

    def refuse(df, batch):
        raise RuntimeError("no delivery")

    query = run("c1", refuse)
    with pytest.raises(Exception, match="no delivery"):
        query.awaitTermination(60)
    assert claims.read().count() == 0
    run("c2", lambda df, b: sent.extend(r["ord"] for r in df.collect())).awaitTermination(60)
    assert sorted(sent) == [0, 1, 2] and claims.read().count() == 6
    run("c3", lambda df, b: sent.extend(r["ord"] for r in df.collect())).awaitTermination(60)


def test_stateful_streams(spark, tmp_path):
    rows = [("a", True, dt.datetime(2024, 1, 1, 0, 1)), ("a", False, dt.datetime(2024, 1, 1, 0, 2)), ("a", False, dt.datetime(2024, 1, 1, 0, 3)), ("b", True, dt.datetime(2024, 1, 1, 0, 1))]
    spark.createDataFrame(rows, "source string, ok boolean, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("source string, ok boolean, at timestamp").parquet(str(tmp_path / "in"))
    q = jobs.streak_stream(read(), "source", "ok").writeStream.format("memory").queryName("streaks").outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["source"], r["streak"]) for r in spark.table("streaks").collect()} == {("a", 2), ("b", 0)}
    q = jobs.first_seen_stream(read(), "source", "at").writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["source"] for r in spark.table("seen").collect()) == ["a", "b"]


def test_plans_push_down_and_never_multiply(spark):
    from gazelark.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    plan = lambda name: QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan("f16_key_hash")
    for name in ("j03_similar_pairs", "j01_already_posted", "c10_known_people", "d01_first_by_title"):
        p = plan(name)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_saved_documents_survive_a_lost_run(spark, tmp_path):
    path = str(tmp_path / "state")
    at = dt.datetime(2024, 1, 2, 3, 4, 5, 678901)
    first = spark.createDataFrame([("a", at)], config.STATE)
    config.save(first, path)
    config.save(config.saved(spark, path, config.STATE).unionByName(spark.createDataFrame([("b", None)], config.STATE)), path)
    assert {r["key"]: r["at"] for r in config.saved(spark, path, config.STATE).collect()} == {"a": at, "b": None}
    # lost after the new rows were whole, before they were moved
    first.write.json(f"{path}.next")
    config.recover(spark, path)
    assert [r["key"] for r in config.saved(spark, path, config.STATE).collect()] == ["a"]
    # lost while they were written
    (tmp_path / "state.next").mkdir()
    config.recover(spark, path)
    config.save(first.limit(0), path)
    assert config.saved(spark, path, config.STATE).isEmpty()


def test_model_events_without_a_verdict_and_beyond_the_calls(spark):
    pages = spark.createDataFrame([(f"https://h.org/{i:02d}", "Hall", "", f"text {i}", f"s{i}") for i in range(25)], "url string, org string, sector string, text string, sig string")

    def extract(batch):
        if batch[0]["url"].endswith("10"):
            return None
        return [{"source": i, "title": "t" * 300, "date": "2024-01-05", "kind": "gala", "scale": "moon"} for i in range(len(batch))] + [{"source": 0, "date": "2024-01-05"}, {"source": "0", "title": "x", "date": "2024-01-05"}, {"title": "x"}]

    today = F.lit("2024-01-01").cast("date")
    rows = {r["url"][-2:]: r for r in screen.model_events(pages, extract, today, calls=2).collect()}
    assert len(rows) == 25 and all(r["read"] == (int(i) < 10) for i, r in rows.items())
    assert all(len(r["events"]) == (1 if r["read"] else 0) for r in rows.values())
    event = rows["03"]["events"][0]
    assert (event["kind"], event["scale"], event["news_score"], len(event["title"])) == ("gala", "", 0, 180)
    assert all(r["read"] for i, r in ((r["url"][-2:], r) for r in screen.model_events(pages, extract, today).collect()) if not 10 <= int(i) < 20)
    assert screen.model_events(pages.limit(0), extract, today).isEmpty()


def test_catalogues_refuse_what_they_cannot_mean(spark):
    table = lambda rows: config.feed_catalogue(spark.createDataFrame(rows, "source string, url string, own boolean"))
    for rows in ([("a", "https://x", None), ("b", "https://x", None)], [("a", "https://x", None), ("a", "https://y", None)]):
        with pytest.raises(Exception, match="stand twice"):
            table(rows).collect()
    assert [tuple(r) for r in table([("A b!", "https://x", None)]).collect()] == [("A b!", "https://x", False, "a_b")]
    feeds.register(spark)
    with pytest.raises(Exception, match="no web address"):
        spark.read.format("gazelark_feeds").option("catalogue", "one\t/etc/hosts").load().collect()


def test_places_in_ranges(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 501).alias("x"), F.lit("clash").alias("range"))
    got = sorted((r["x"], r["place"]) for r in rank.placed(rows, ["x"]).collect())
    assert [p for _, p in got] == list(range(1, 501))


def test_the_judge_is_asked_once(spark, tmp_path):
    queue = spark.createDataFrame([(f"u{i}", dt.datetime(2024, 1, 1, 10)) for i in range(10)], "url string, queued_at timestamp").repartition(1)
    log = tmp_path / "calls"

    def judge(rows):
        with log.open("a") as f:
            f.write("x")
        return {r["url"] for r in rows[:4]}

    parts = pipelines.screened_queue(spark, queue.limit(0), queue, F.lit("2024-01-01 12:00:00").cast("timestamp"), judge)
    assert [p.count() for p in parts] == [4, 0, 6] and log.read_text() == "x"


def test_entities_as_the_standard_library_has_them(spark):
    import html

    rows = ["&copy; 2024 &middot; a &amp;copy; b", "&#169;&#xA9;&#XA9; &#8217; &#150; &eacute;&Eacute;", "no & entity; here &; &#; &#x; &unheard;", "&#128512; &#x1F600;", "plain", None, "", "&&amp;&lt;b&gt;&&", "&frac12;&euro;&apos;&quot;"]
    got = [r["u"] for r in spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", X.unescape(F.col("t")).alias("u")).orderBy("i").collect()]
    assert got == [None if t is None else html.unescape(t) for t in rows]
    odd = spark.range(1).select(X.unescape(F.lit("&#55296;|&#9999999;|&#0;|a&nbsp;b&#160;c")).alias("u")).first()["u"]
    assert odd == "\ufffd|\ufffd|\ufffd|a b c"


def test_copies_meet_as_a_class(spark):
    """20,000 rows of the same words: pair by pair there would be 400 million."""
    rows = spark.range(20_000).select(F.col("id").alias("ord"), F.concat(F.lit("o"), (F.col("id") % 3).cast("string")).alias("outlet"), F.array(*[F.lit(w) for w in ("harbour", "north", "opens")]).alias("words"), F.col("id").alias("at"))
    began = time.time()
    got = dedup.cross_outlet_match(rows, rows).groupBy("match_ord").count().collect()
    assert {r["match_ord"]: r["count"] for r in got} == {19_999: 13_333, 19_998: 6_667}
    assert joins.already_shown(rows, rows).count() == 0
    items = rows.select("ord", "outlet", F.lit("harbour north opens").alias("title"), F.lit(None).cast("timestamp").alias("effective_date"))
    assert dedup.dedup_cross_outlet(items).where("kept").count() == 6_667
    assert time.time() - began < 300


def test_latest_match_by_brute_force(spark):
    """Rows that are on both sides, under the same or another outlet, don't meet themselves."""
    import random

    rng = random.Random(7)
    side = lambda n, first: [(first + i, f"O{rng.randrange(4)}", sorted(rng.sample("abcdefghij", rng.randrange(2, 8))), rng.randrange(50)) for i in range(n)]
    left, right = side(120, 0), side(120, 60)
    frame = lambda rows: spark.createDataFrame(rows, "ord long, outlet string, words array<string>, at long")
    for threshold, other in ((0.5, True), (0.8, False)):
        near = {}
        for o, outlet, words, _ in left:
            for p, out, more, at in right:
                fewer = min(len(words), len(more))
                if o != p and (outlet != out or not other) and fewer >= 3 and len(set(words) & set(more)) / fewer >= threshold:
                    near.setdefault(o, []).append((at, p, len(set(words) & set(more)) / fewer))
        pairs = dedup.similar_pairs(frame(left), frame(right), threshold, other).collect()
        assert sorted((r["l_ord"], r["r_ord"], r["overlap"]) for r in pairs) == sorted((o, p, v) for o, found in near.items() for _, p, v in found)
        latest = dedup.latest_match(frame(left), frame(right), threshold, other).collect()
        assert {r["ord"]: (r["match_ord"], r["overlap"]) for r in latest} == {o: max(found)[1:] for o, found in near.items()}
    shown = joins.already_shown(frame(left), frame(right), threshold).select("ord").collect()
    assert {r["ord"] for r in shown} == {r[0] for r in left} - set(near)


def test_pages_of_one_address_are_apart(spark):
    page = lambda i: ("https://h.org/p", f'<a href="/event/{i}">Calendar</a><div>Evening of chamber music number {i}</div><div>January {i + 10}, 2024</div>')
    pages = spark.createDataFrame([page(i) for i in range(6)], "url string, html string")
    links = markup.calendar_links(pages).collect()
    assert sorted((r["link"], r["rank"]) for r in links) == [(f"https://h.org/event/{i}", 1) for i in range(6)]
    dated = markup.dated_events(pages, F.lit("2024-01-01").cast("date")).collect()
    assert sorted((str(r["date"]), r["title"]) for r in dated) == [(f"2024-01-{i + 10}", f"Evening of chamber music number {i}") for i in range(6)]


def test_known_people_of_any_length_without_broadcasts(spark):
    """Names may be many, and so stay off the driver; each is met by a run of its own length."""
    names = ["Ana", "Boris", "Celine", "Customer#000000017", "Customer#000000018", "Maximiliana von der Heide-Lindenau", "Xy"]
    people = spark.createDataFrame([(n,) for n in names], "name string")
    titles = [(1, "Banana customer#000000018 opens"), (2, "maximiliana VON der heide-lindenau"), (3, "Xy gives"), (4, None), (5, "An")]
    found = scoring.known_people(spark.createDataFrame(titles, "ord int, title string"), people)
    assert {r["ord"]: r["known_person"] for r in found.collect()} == {1: ["ana", "customer#000000018"], 2: ["ana", "maximiliana von der heide-lindenau"], 3: [], 4: [], 5: []}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert scoring.known_people(found.drop("known_person"), people.limit(0)).where(F.size("known_person") > 0).isEmpty()


def test_ranges_give_what_all_pairs_give(spark, monkeypatch):
    """With small ranges, and with words met in tasks, latest matches and folds are those of plain comparisons."""
    import random

    monkeypatch.setattr(dedup, "FIRST", 12)
    monkeypatch.setattr(dedup, "RARE", 3)
    rng = random.Random(5)
    rows = [(i, f"o{rng.randrange(4)}", " ".join(rng.sample(["harbour", "north", "opens", "bridge", "school", "museum", "river", "market", "tower", "garden"] + [f"word{k}x" for k in range(30)], rng.randrange(3, 9)))) for i in range(90)]
    df = spark.createDataFrame(rows, "ord long, outlet string, title string")
    worded = df.select("ord", "outlet", X.title_words(F.col("title")).alias("words"), F.col("ord").alias("at"))
    words = {r["ord"]: set(r["words"]) for r in worded.collect()}
    outlet = {o: out for o, out, _ in rows}
    alike = lambda a, b: outlet[a] != outlet[b] and min(len(words[a]), len(words[b])) >= 3 and len(words[a] & words[b]) / min(len(words[a]), len(words[b])) >= 0.5
    found = {a: max((b for b in words if alike(a, b)), default=None) for a in words}
    assert {r["ord"]: r["match_ord"] for r in dedup.cross_outlet_match(worded, worded).collect()} == {a: b for a, b in found.items() if b is not None}
    kept = []
    for a in sorted(words):
        if not any(alike(a, b) for b in kept):
            kept.append(a)
    got = dedup.dedup_cross_outlet(df.withColumn("effective_date", F.lit(None).cast("timestamp"))).where("kept").collect()
    assert sorted(r["ord"] for r in got) == kept and len(kept) < 80

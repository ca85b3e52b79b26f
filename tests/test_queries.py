"""Each registered query of the news operators against its SQL on the smallest tables."""

import datetime

import duckdb
import pytest

from gazelark import queries, queries_more, queries_sources, queries_state  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows):
    def value(x):
        if isinstance(x, float):
            return round(x, 6) + 0.0
        return x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else x

    return sorted((tuple(value(x) for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    ours = queries.QUERIES[name](spark, SF)
    columns = sorted(ours.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    theirs = duck.sql(f"SELECT {quoted} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert canonical(ours.select(*columns).collect()) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, name):
    queries.QUERIES[name](spark, SF).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["ord", "source_key", "title", "stream", "published"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name, table, rows", [
    ("c10_known_people", "orders", "count(*)"), ("d08_union_streams", "documents", "count(CASE WHEN doc_id % 3 <> 0 THEN 1 END) + count(CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN 1 END)"), ("j09_queue", "documents", "count(CASE WHEN doc_id % 5 <> 1 THEN 1 END)"),
    ("r11_screened", "documents", "count(*)"), ("s02_s03_search_items", "part", "count(CASE WHEN p_partkey % 7 <> 0 THEN 1 END)"), ("s09_ics_events", "orders", "count(*)"), ("s10_dated_pages", "part", "count(CASE WHEN p_partkey % 200 <= 120 THEN 1 END)"),
    ("t01_digest_order", "documents", "count(*)"), ("w03_neighbour_lines", "documents", "sum(len(string_split(text, chr(10))))"),
])
def test_every_row_reaches_the_operator(spark, duck, name, table, rows):
    assert queries.QUERIES[name](spark, SF).count() == duck.sql(f"SELECT {rows} FROM {table}").fetchall()[0][0]


def test_known_people_that_begin_alike(spark):
    from gazelark.operators import scoring

    names = [f"Customer {i:03d}" for i in range(200)] + ["Ana", "An", "Customer"]
    titles = [(i, f"Order of customer {i:03d} and CUSTOMER {(i * 7) % 200:03d} by Ana") for i in range(200)] + [(200, None), (201, "")]
    got = {r["ord"]: r["known_person"] for r in scoring.known_people(spark.createDataFrame(titles, "ord long, title string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {i: sorted(n.lower() for n in names if len(n) >= 3 and n.lower() in (title or "").lower())[:3] for i, title in titles}


def test_escape_keeps_whole_pages(spark):
    import html

    got = {r["page_id"]: r["escaped"] for r in queries.QUERIES["f27_escape"](spark, SF).collect()}
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert got == {i: None if p is None else html.escape(p, quote=False) for i, p in pages.items()} and max(map(len, pages.values())) > 300


def test_caps_of_queue_and_log(spark):
    from gazelark.operators import rank

    at = lambda day: datetime.datetime(2024, 1, day)
    log = spark.createDataFrame([(0, at(1)), (1, at(2)), (2, None), (3, at(16)), (4, at(15))], "ord long, at timestamp")
    now = queries.F.lit("2024-01-16").cast("timestamp")
    kept = lambda df: {r["ord"] for r in df.collect()}
    assert kept(rank.log_cap(log, now)) == {1, 2, 3, 4} and kept(rank.log_cap(log, now, most=2)) == {3, 4}
    assert kept(rank.queue_cap(log, 2)) == {3, 4} and kept(rank.queue_cap(spark.range(100).withColumnRenamed("id", "ord"))) == set(range(40, 100))


def test_runs_of_failures_across_ranges(spark):
    from itertools import groupby

    from gazelark.operators import observe

    rows = [(k, i, (i * i + i // 37) % 11 < (2 if k == "a" else 9) if k != "c" else False) for k in ("a", "b", "c", None) for i in range(600)] + [("d", 1, True), ("e", 1, None), ("e", 2, False)]
    got = {r["key"]: r["longest"] for r in observe.longest_streaks(spark.createDataFrame(rows, "key string, at long, ok boolean").repartition(5), "key", ["at"], queries.F.col("ok")).collect()}
    longest = lambda k: max(sum(1 for _ in g) for good, g in groupby(ok for key, _, ok in rows if key == k) if good is False)
    assert got == {k: longest(k) for k in ("a", "b", "c", None, "e")}


def test_full_calls_across_frames(spark):
    from gazelark.operators import screen

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(103).withColumnRenamed("id", "ord").coalesce(1)
        got = screen.screened(rows, lambda batch: None if len(batch) < 25 else {min(r["ord"] for r in batch)}).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["ord"]: r["kept"] for r in got} == {i: None if i >= 100 else i % 25 == 0 for i in range(103)}


def test_sets_of_rows(spark):
    from gazelark.operators import sets

    a = spark.createDataFrame([("x", 1, 3), ("x", 2, 1), ("y", 1, 2), ("x", 1, 9), (None, 5, 4)], "source string, v long, at long")
    assert {r["source"]: r["values"] for r in sets.ordered_distinct(a, "source", "v", "at").collect()} == {"x": [2, 1], "y": [1], None: [5]}
    assert sorted(r["at"] for r in sets.except_self(a, a.where("source = 'x' OR source IS NULL")).collect()) == [2, 4]
    assert sorted((r["v"], r["at"]) for r in sets.union_streams(a.select("v", "at"), a.where("v = 5").select("v")).where("v = 5").collect() if r["at"] is None) == [(5, None)]


def test_people_from_documents(spark, tmp_path):
    from gazelark.sources import config

    (tmp_path / "whole.json").write_text('{\n "Ana": 2,\n "Bo": 1\n}')
    (tmp_path / "lines.json").write_text('{"Ana": 2}\nnot one\n[1]\n{"Ana": 3, "Bo": 1}\n')
    read = lambda name, **more: {r["name"]: r["n"] for r in config.people(spark, str(tmp_path / name), **more).collect()}
    assert read("whole.json", lines=False) == {"Ana": 2, "Bo": 1} and read("lines.json") == {"Ana": 5, "Bo": 1} and read("none.json") == {}


@pytest.mark.parametrize("name", ["f20_page_title", "s04_listing_items"])
def test_titles_with_other_entities_as_in_sql(spark, tmp_path, name):
    titles = ["Gala &quot;ball&quot; opens", "Fish &amp; chips &lt;now&gt;", "A &amp;quot; B &#39;c&#39; &copy; today", "Harbour & sea &nbsp;trip &; &amp;amp;", "Plain words of one title"]
    rows = [(i, f"https://h.org/{i}", f"<html><title>{t}</title><p>text &quot;more&quot;</p></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    ours = queries.QUERIES[name](spark, str(tmp_path))
    columns = sorted(ours.columns)
    theirs = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert canonical(ours.select(*columns).collect()) == canonical(theirs) and theirs

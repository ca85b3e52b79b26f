"""Polling as a stream, paged archives, delivery by bundle and the ledger of calls."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from gazelark.operators import ledger
from gazelark.plans import delivery
from gazelark.sources import archive, feeds, versioned

SF = "/root/testdata/sf0.001"


def test_a_poll_resumes_where_it_was(spark, tmp_path):
    paths = {k: tmp_path / f"{k}.xml" for k in "abc"}
    for k, p in paths.items():
        p.write_text(f"<rss>{k}1</rss>")
    catalogue = [(k, str(p)) for k, p in paths.items()] + [("gone", str(tmp_path / "none.xml"))]

    def poll():
        got = []
        q = feeds.polled(spark, catalogue).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        return sorted((r["source_key"], r["body"], r["error"] is not None) for r in got)

    gone = ("gone", None, True)
    assert poll() == [("a", "<rss>a1</rss>", False), ("b", "<rss>b1</rss>", False), ("c", "<rss>c1</rss>", False), gone]
    assert poll() == []  # a new query: nothing has changed since
    paths["b"].write_text("<rss>b2, longer</rss>")
    assert poll() == [("b", "<rss>b2, longer</rss>", False)]
    (tmp_path / "none.xml").write_text("<rss>here</rss>")
    os.remove(paths["c"])
    assert poll() == [("c", None, True), ("gone", "<rss>here</rss>", False)]
    batch = feeds.fetch(spark, catalogue).where("source_key = 'a'")
    assert [r["body"] for r in batch.collect()] == ["<rss>a1</rss>"]


def write_archive(folder, posts, per_page):
    folder.mkdir()
    (folder / "total.txt").write_text(str(len(posts)))
    for n in range(max(1, -(-len(posts) // per_page))):
        (folder / f"page-{n + 1}.json").write_text(json.dumps(posts[n * per_page : (n + 1) * per_page]))


def test_archive_pages_are_partitions(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()
    posts = [{"id": r["page_id"], "date": "2024-01-01T00:00:00", "link": r["url"], "content": {"rendered": r["html"]}} for r in pages]
    write_archive(tmp_path / "a", posts, 7)
    df = archive.archive(spark, str(tmp_path / "a"), per_page=7)
    assert df.rdd.getNumPartitions() == -(-len(posts) // 7)
    got = df.orderBy("page", "ord").collect()
    assert [(r["id"], r["link"], r["html"]) for r in got] == [(r["page_id"], r["url"], r["html"]) for r in pages] and {r["error"] for r in got} == {None}
    (tmp_path / "a" / "page-2.json").write_text("no list")
    bad = archive.archive(spark, str(tmp_path / "a"), per_page=7, attempts=1).collect()
    assert len(bad) == len(posts) - 7 + 1 and [r["page"] for r in bad if r["error"]] == [2]
    write_archive(tmp_path / "empty", [], 7)
    assert archive.archive(spark, str(tmp_path / "empty")).isEmpty()
    with pytest.raises(Exception, match="first page"):
        archive.archive(spark, str(tmp_path / "none"), attempts=1).collect()


ITEMS = "stream string, url string, title string, outlet string, desk string, category string, score int, published timestamp"


def items(spark, rows):
    df = spark.createDataFrame([(s, f"https://x/{n}", f"Remarkable headline number{n} zebra{n}", "X", "", "c", 5, dt.datetime(2024, 1, 1)) for s, n in rows], ITEMS)
    return df.withColumns({"axes": F.array(F.lit("a")), "paywall": F.lit(False), "words": F.array(F.lit("w")), "corroboration": F.lit(1), "kind": F.col("stream")})


def test_a_failing_bundle_gives_its_claims_back_alone(spark, tmp_path):
    claims, log, titles = versioned.Versioned(spark, str(tmp_path / "c")), delivery.posted_log(spark, str(tmp_path / "l")), delivery.posted_titles(spark, str(tmp_path / "t"))
    sent = []

    def send(stream, text):
        if stream == "bad":
            raise RuntimeError("refused")
        sent.append((stream, text))

    texts = lambda df: df.groupBy("stream").agg(F.array_join(F.array_sort(F.collect_list("url")), " ").alias("text"))
    box = delivery.Outbox(claims, send, log, titles)
    assert box.deliver(items(spark, [("good", 1), ("good", 2), ("bad", 3)]), texts, 0) == {"bad": "RuntimeError: refused", "good": None}
    assert sent == [("good", "https://x/1 https://x/2")]
    assert sorted(r["url"] for r in log.read().collect()) == ["https://x/1", "https://x/2"] and titles.read().count() == 2
    assert claims.read().count() == 4  # two keys each
    # the next run: what was refused is open, what was sent is not
    good = delivery.Outbox(claims, lambda stream, text: sent.append((stream, text)), log, titles)
    assert good.deliver(items(spark, [("good", 2), ("bad", 3)]), texts, 1) == {"bad": None, "good": None}
    assert sent[1:] == [("bad", "https://x/3")] and log.read().count() == 3
    # the same batch again: claimed under the same tag, logged once
    good.deliver(items(spark, [("bad", 3)]), texts, 1)
    assert log.read().count() == 3


def test_ledger_counts_successes_once_a_day(spark, tmp_path):
    day = [dt.date(2024, 1, 1)]
    one, other = (ledger.Ledger(spark, str(tmp_path / "l"), 10, lambda: day[0]) for _ in range(2))
    entry, granted = one.reserve(6)
    assert granted == 6 and other.reserve(6)[1] == 4 and other.left == 0
    one.settle(entry, 2)
    assert one.left == 4 and one.reserve(9)[1] == 4
    day[0] = dt.date(2024, 1, 2)
    assert other.left == 10 and other.used(dt.date(2024, 1, 1)) == 10


def test_screening_within_the_ledger(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "l"), 5)
    rows = spark.range(100).select(F.col("id").alias("ord"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("title")).repartition(7)
    tried = tmp_path / "tried"

    def judge(batch):
        ids = sorted(r["ord"] for r in batch)
        if ids[0] == 20:
            raise OSError("no answer")
        if ids[0] == 40:
            return None
        if ids[0] == 60 and not tried.exists():
            tried.write_text("x")
        return {i for i in ids if i % 2}

    got = {r["ord"]: r["kept"] for r in ledger.screened_within(rows, judge, book, size=20).collect()}
    assert got == {i: None if i // 20 in (1, 2) else i % 2 == 1 for i in range(100)}
    assert book.left == 2  # three of five calls gave an answer
    again = ledger.screened_within(rows, judge, book, size=20).collect()
    assert sum(r["kept"] is not None for r in again) == 20 and book.left == 1  # two calls granted, one of them failed
    assert ledger.screened_within(rows.limit(0), judge, book).isEmpty() and book.left == 1


def test_files_of_the_shared_folder_are_read_on_a_cluster():
    from gazelark.shared import within
    from gazelark.sources.archive import ArchiveSource
    from gazelark.sources.feeds import FeedSource

    lines = "a\t///shared/run/feeds/a.xml\nb\thttps://h.org/b"
    assert len(FeedSource({"catalogue": lines, "shared": "/shared/run"})._catalogue()) == 2
    assert ArchiveSource({"url": "file:///shared/run/archive", "shared": "/shared/run"}).reader(None).base == "/shared/run/archive"
    for refused in ("", "/shared/other", "/shared/ru"):
        with pytest.raises(ValueError):
            FeedSource({"catalogue": lines, "shared": refused})._catalogue()
    assert not within("/shared/run/../x", "/shared/run") and within("/any/x", "/")

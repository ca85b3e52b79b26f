"""Versioned state, and the streams that keep state: races, expiry, queue, first sights."""

import datetime as dt
import json
import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gazelark.operators import observe
from gazelark.sources import versioned
from gazelark.streaming import jobs
from gazelark.streaming import state as jobs_state

SF = "/root/testdata/sf0.001"


def keys(spark, names, day=1):
    return spark.createDataFrame([(n, dt.datetime(2024, 1, day)) for n in names], "key string, at timestamp")


def held(table, **kw):
    return {r["key"]: r["at"].day for r in table.read(**kw).collect()}


def test_the_loser_of_a_race_merges_and_tries_again(spark, tmp_path):
    one, other = (versioned.Versioned(spark, str(tmp_path / "s")) for _ in range(2))
    base = one.commit(keys(spark, "ab", 5))
    assert one.commit(keys(spark, "bc", 3), base) == base + 1
    assert other.commit(keys(spark, "cd", 4), base) == base + 2  # its number was taken
    assert held(one) == {"a": 5, "b": 3, "c": 3, "d": 4} and held(one, version=base) == {"a": 5, "b": 5}
    assert one.replace(keys(spark, "z", 9)) == base + 3 and held(other) == {"z": 9}


def test_two_writers_at_once_lose_no_key(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").cast("string").alias("key"), F.col("ts").alias("at"), "event_type").persist()
    tables = [versioned.Versioned(spark, str(tmp_path / "s"), attempts=50) for _ in range(2)]
    failed = []

    def write(table, part):
        try:
            for i in range(6):
                table.commit(events.where((F.pmod(F.xxhash64("key", "at"), F.lit(12)) == 2 * i + part)).select("key", "at"))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(t, i)) for i, t in enumerate(tables)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and tables[0].latest() == 12
    expected = {r["key"]: r["at"] for r in events.groupBy("key").agg(F.min("at").alias("at")).collect()}
    assert {r["key"]: r["at"] for r in tables[1].read().collect()} == expected
    events.unpersist()


def test_a_writer_gives_up_after_its_attempts(spark, tmp_path, monkeypatch):
    table = versioned.Versioned(spark, str(tmp_path / "s"), attempts=3)
    tried = []
    monkeypatch.setattr(table.files, "create", lambda sub, content: tried.append(sub) and False)
    with pytest.raises(versioned.Conflict):
        table.commit(keys(spark, "a"))
    assert len(tried) == 3


def test_tags_and_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versioned, "KEPT_VERSIONS", 2)
    table = versioned.Versioned(spark, str(tmp_path / "s"))
    for i in range(5):
        table.commit(keys(spark, f"k{i}", i + 1), tag=f"t{i}")
    table.commit(keys(spark, ["x4"], 5), tag="t4")  # repeated: in place of k4's characters
    assert held(table) == {"k": 1, "0": 1, "1": 2, "2": 3, "3": 4, "x4": 5}
    table.compact(F.dayofmonth("at") >= 2, but_tag="t4")
    assert held(table) == {"1": 2, "2": 3, "3": 4, "x4": 5} and len(table.manifest().folders) == 2
    table.withdraw("t4")
    assert held(table) == {"1": 2, "2": 3, "3": 4} and table.withdraw("t4") == table.latest()
    table.compact()
    assert len(table.files.names("versions")) <= 3 and len(table.files.names("data")) <= 4
    assert not table.files.names("drafts")


def test_compaction_beside_a_commit_and_beside_another(spark, tmp_path):
    table = versioned.Versioned(spark, str(tmp_path / "s"))
    table.commit(keys(spark, "a"))
    table.commit(keys(spark, "b"))
    own = table._write

    def interrupted(rows):
        name = own(rows)
        table._write = own
        table.commit(keys(spark, "c"))  # between the compaction's reading and its commit
        return name

    table._write = interrupted
    table.compact()
    assert set(held(table)) == {"a", "b", "c"}

    def overtaken(rows):
        name = own(rows)
        table._write = own
        table.compact()
        return name

    table._write = overtaken
    with pytest.raises(versioned.Conflict):
        table.compact()
    assert set(held(table)) == {"a", "b", "c"}


def test_overlapping_runs_claim_a_key_once(spark, tmp_path):
    one, other = (jobs.Claims(spark, str(tmp_path / "c"), days=100_000) for _ in range(2))
    wanted = spark.createDataFrame([("a",), ("b",)], "key string")
    assert one.claim(0, wanted).count() == 0
    assert sorted(r["key"] for r in other.claim(7, spark.createDataFrame([("b",), ("c",)], "key string")).collect()) == ["b"]
    assert sorted(r["key"] for r in one.read(but=0).collect()) == ["c"]
    other.release(7)
    assert sorted(r["key"] for r in one.read().collect()) == ["a", "b"]


def test_claims_stay_bounded_over_many_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versioned, "COMPACT_AT", 5)
    claims = jobs.Claims(spark, str(tmp_path / "c"), days=100_000)
    most = 0
    for batch in range(18):
        claims.claim(batch, spark.createDataFrame([(f"k{batch % 7}",), (f"k{(batch + 1) % 7}",)], "key string"))
        claims.table.compact_when_due(versioned.live_keys(100_000), f"batch {batch}", at=5)
        most = max(most, len(claims.table.manifest().folders))
    assert most <= 6 and claims.read().count() == 7
    assert len(claims.table.files.names("versions")) <= versioned.KEPT_VERSIONS + 7


# --- streams with state ---

HELD = "url string, desk string, queued_at timestamp, score int"


def minutes(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)


class Feed:
    """Rows as files of a stream, a micro-batch each, with one checkpoint over all runs."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, folder, schema

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def run(self, apply, empty_batches=False):
        """The rows that come out of everything put since the last run."""
        got = []
        self.spark.conf.set("spark.sql.shuffle.partitions", "1")
        # by the time of day there is always another batch to run, so that one that takes all there is must not run empty ones
        self.spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(empty_batches).lower())
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        query = apply(stream).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        ended = query.awaitTermination(60)
        query.stop()
        self.spark.conf.set("spark.sql.shuffle.partitions", "4")
        self.spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
        assert ended
        assert query.exception() is None
        self.progress = query.lastProgress
        return got


class Store:
    """The state of one key, with a clock that the test moves."""

    def __init__(self):
        self.values, self.maps, self.timers, self.clock = {}, {}, set(), 0

    def getValueState(self, name, schema, ttlDurationMs=None):  # noqa: N802, N803
        store = self.values

        class Value:
            exists = staticmethod(lambda: name in store)
            get = staticmethod(lambda: store[name])
            update = staticmethod(lambda v: store.__setitem__(name, v))

        return Value()

    def getMapState(self, name, key, schema, ttlDurationMs=None):  # noqa: N802, N803
        store = self.maps.setdefault(name, {})

        class Map:
            containsKey = staticmethod(lambda k: k in store)  # noqa: N815
            updateValue = staticmethod(store.__setitem__)  # noqa: N815
            removeKey = staticmethod(store.pop)  # noqa: N815
            iterator = staticmethod(lambda: iter(list(store.items())))

        return Map()

    def listTimers(self):  # noqa: N802
        return list(self.timers)

    def deleteTimer(self, t):  # noqa: N802
        self.timers.discard(t)

    def registerTimer(self, t):  # noqa: N802
        self.timers.add(t)

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.clock


def test_holding_queue_by_a_moved_clock():
    store = Store()
    asked = []

    def queue(judge):
        own = jobs_state.HoldingQueue(judge and (lambda rows: asked.append(len(rows)) or judge(rows)), 4, 60, 6, 60, 15, False)
        own.init(store)
        return own

    def turn(rows, clock, judge):
        """What leaves when the rows come at so many minutes, or when timers fire until then."""
        frames = []
        while store.timers and min(store.timers) <= clock * 60_000:
            store.clock = min(store.timers)
            store.timers.clear()
            frames += queue(judge).handleExpiredTimer(("a",), store, None)
        store.clock = clock * 60_000
        if rows:
            frame = pd.DataFrame({"url": [r[0] for r in rows], "queued_ms": [int(r[1] * 60_000) for r in rows], "row": [json.dumps({"url": r[0], "score": r[2]}) for r in rows]})
            frames += queue(judge).handleInputRows(("a",), iter([frame]), store)
        return sorted((u, a) for f in frames for u, a in zip(f["url"], f["action"]))

    keep = lambda rows: {r["url"] for r in rows if r["score"] > 5}
    row = lambda url, at, score=9: (url, at, score)
    assert turn([row("u1", 9), row("u1", 10), row("u2", 10)], 10, keep) == [] and asked == []  # too few, and a url waits once
    assert turn([row("u3", 30, 1), row("u4", 30)], 30, keep) == [("u1", "released"), ("u2", "released"), ("u3", "rejected"), ("u4", "released")] and asked == [4]
    assert turn([row("v1", 40)], 50, keep) == [] and not store.maps["queue"].keys() - {("v1",)}
    assert turn([], 99, keep) == [] and turn([], 100, keep) == [("v1", "released")] and asked == [4, 1]  # alone, after an hour
    assert turn([row(f"w{i}", 110) for i in range(4)], 110, lambda rows: None) == [] and asked == [4, 1, 4]  # no verdict
    assert turn([], 124, lambda rows: None) == [] and asked == [4, 1, 4]
    assert turn([], 125, lambda rows: None) == [] and asked == [4, 1, 4, 4]  # asked again
    assert turn([], 469, None) == []
    assert turn([], 470, keep) == [(f"w{i}", "dropped") for i in range(4)] and not store.timers  # six hours, and not asked any more
    assert turn([row(f"x{i:02d}", 500 + i / 60) for i in range(70)], 510, None) == [(f"x{i:02d}", "cut") for i in range(10)]
    assert len(store.maps["queue"]) == 60


def test_holding_queue_by_the_watermark(spark, tmp_path):
    feed = Feed(spark, tmp_path, HELD)
    apply = lambda df: jobs_state.holding_queue(df.withWatermark("queued_at", "0 minutes"), "desk", lambda rows: {"u1"}, event_time=True)
    feed.put([("u1", "a", minutes(0), 9)])
    assert feed.run(apply, True) == []
    feed.put([("tick", "clock", minutes(61), 0)])  # moves the clock of all queues
    assert [(r["url"], r["action"], r["desk"], r["score"]) for r in feed.run(apply, True)] == [("u1", "released", "a", 9)]


def test_holding_queue_by_the_time_of_day(spark, tmp_path):
    feed = Feed(spark, tmp_path, HELD)
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    feed.put([("u1", "a", now, 9), ("u2", "b", now - dt.timedelta(hours=7), 9), ("u3", "c", now - dt.timedelta(minutes=61), 9)])
    got = feed.run(lambda df: jobs_state.holding_queue(df, "desk", lambda rows: {r["url"] for r in rows}))
    assert sorted((r["url"], r["action"], r["desk"], r["score"]) for r in got) == [("u2", "dropped", "b", 9), ("u3", "released", "c", 9)]


def test_the_batch_queue_is_capped(spark):
    from gazelark.plans import pipelines

    queue = spark.createDataFrame([(f"u{i:03d}", minutes(i)) for i in range(100)], "url string, queued_at timestamp")
    for judge in (None, lambda rows: None):
        released, left, dropped = pipelines.screened_queue(spark, queue.limit(0), queue, F.lit(minutes(120)).cast("timestamp"), judge)
        assert sorted(r["url"] for r in left.collect()) == [f"u{i:03d}" for i in range(40, 100)] and released.isEmpty() and dropped.isEmpty()


SIGHTS = "source string, url string, published timestamp, at timestamp"


def test_first_sights_and_undated_ages_in_a_stream_and_in_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    source = F.col("event_type").alias("source")
    published = F.when(F.col("event_id") % 3 == 0, F.col("ts") - F.make_interval(mins=(F.col("event_id") % 90).cast("int"))).alias("published")
    rows = events.select(source, F.concat("event_type", F.lit("/"), F.col("user_id").cast("string")).alias("url"), published, F.col("ts").alias("at")).persist()
    window = F.when(F.col("source") == "click", 20).otherwise(45)
    feed = Feed(spark, tmp_path, SIGHTS)
    for k in range(4):  # in the order of arrival
        part = rows.orderBy("at", "url").offset(k * (rows.count() // 4 + 1)).limit(rows.count() // 4 + 1)
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = feed.run(lambda df: jobs_state.aged_from_sight(jobs_state.first_sights(df, "url", "at"), "at", window).drop("again"))
    expected = jobs_state.aged_from_sight(observe.stamped(rows, "url", "at"), "at", window).select("source", "url", "published", "at", "first_seen", "effective_date").collect()
    tidy = lambda found: sorted((r["source"], r["url"], str(r["published"]), r["at"], r["first_seen"], r["effective_date"]) for r in found)
    assert tidy(got) == tidy(expected) and 0 < len(got) < rows.count()
    rows.unpersist()


def test_expired_sights_are_new_and_state_is_bounded(spark, tmp_path):
    feed = Feed(spark, tmp_path, SIGHTS)
    apply = lambda df: jobs_state.first_sights(df, "url", "at", hours=2 / 3600)
    sizes = []
    for batch in range(6):
        feed.put([("s", f"u{batch}-{i}", None, minutes(batch)) for i in range(20)] + [("s", "always", None, minutes(batch))])
        got = {r["url"]: r for r in feed.run(apply)}
        assert got["always"]["first_seen"] == minutes(batch) and not got["always"]["again"]  # expired since
        sizes.append(feed.progress.stateOperators[0].numRowsTotal)
        time.sleep(2)
    assert max(sizes) <= 3 * 21, sizes  # of 126 keys


def test_recent_titles(spark, tmp_path):
    feed = Feed(spark, tmp_path, "desk string, ord long, outlet string, words array<string>")
    apply = lambda df: jobs_state.recent_titles(df, "desk", most=3)
    words = lambda n: [f"w{n}a", f"w{n}b", f"w{n}c", f"w{n}d"]
    feed.put([("a", 1, "X", words(1))])
    assert [r["similar"] for r in feed.run(apply)] == [False]
    feed.put([("a", 2, "x", words(1)), ("a", 3, "Y", words(1)[:3]), ("b", 4, "Y", words(1)), ("a", 5, "Y", [])])
    assert {r["ord"]: r["similar"] for r in feed.run(apply)} == {2: False, 3: True, 4: False, 5: False}
    feed.put([("a", 10 + n, "X", words(n)) for n in range(2, 5)])
    feed.run(apply)
    feed.put([("a", 20, "Y", words(1)), ("a", 21, "Y", words(4))])
    assert {r["ord"]: r["similar"] for r in feed.run(apply)} == {20: False, 21: True}  # the last three only

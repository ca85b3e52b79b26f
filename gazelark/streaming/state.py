"""Streams with state of their own: first sights, remembered headlines and the holding queue.

State is held by key in Spark's state store (the RocksDB one, which `use_state_store` sets) and comes
back with the checkpoint. What ages out does so by the store's expiry; what has to happen at some time
happens by a timer. By the time of day Spark always sees another batch to run, so a query that takes
what there is and ends (availableNow) needs spark.sql.streaming.noDataMicroBatches.enabled off. No key's rows are gathered beyond a micro-batch's own.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gazelark import fixed
from gazelark.functions import text as X

HOUR_MS = 3_600_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """The state store that expiry, timers and maps need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _micros(at) -> int:
    import pandas as pd

    return pd.Timestamp(at).value // 1_000


class FirstSights(StatefulProcessor):
    """Rows of a key with the time at which the key was first seen, and whether that was before this row."""

    def __init__(self, at: str, hours: float):
        self.at, self.hours = at, hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "micros long", ttlDurationMs=int(self.hours * HOUR_MS))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import pandas as pd

        known = self.first.get()[0] if self.first.exists() else None
        kept = list(rows)
        stamps = [frame[self.at].map(_micros) for frame in kept]
        first = min(int(s.min()) for s in stamps) if known is None else known
        if known is None:
            self.first.update((first,))
        for frame, own in zip(kept, stamps):
            yield frame.assign(first_seen=pd.Timestamp(first, unit="us"), again=(own > first) | (known is not None))

    def close(self) -> None:
        pass


def first_sights(rows: DataFrame, key: str, at: str, hours: float = 24 * fixed.SEEN_DAYS) -> DataFrame:
    """Streaming rows with first_seen and again. A key that was seen is known for `hours` after its
    first sight, by the clock, and then new again; at: the arrival time of a row."""
    use_state_store(rows.sparkSession)
    schema = T.StructType([*rows.schema, T.StructField("first_seen", T.TimestampType()), T.StructField("again", T.BooleanType())])
    return rows.groupBy(key).transformWithStateInPandas(FirstSights(at, hours), schema, "append", "processingTime")


def aged_from_sight(stamped: DataFrame, at: str, window_minutes: Column, least_minutes: int = fixed.UNDATED_MINUTES) -> DataFrame:
    """Rows with effective_date that are within their source's window when they arrive.

    stamped: rows with published and first_seen, of a stream or not. A dated row ages from its date, an
    undated one from its first sight, and has least_minutes at least. This is a filter of single rows,
    so that a late row costs no state; the cut of each source holds whatever the watermark is.
    """
    allowed = F.when(F.col("published").isNotNull(), window_minutes).otherwise(F.greatest(window_minutes, F.lit(least_minutes)))
    dated = stamped.withColumn("effective_date", F.coalesce("published", "first_seen"))
    return dated.where(X.hours_between(F.col("effective_date"), F.col(at)) * 60 <= allowed)


class RecentTitles(StatefulProcessor):
    """Whether a headline is similar to one remembered from another outlet; the others are remembered."""

    def __init__(self, threshold: float, hours: float, most: int):
        self.threshold, self.hours, self.most = threshold, hours, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.titles = handle.getMapState("titles", "seq long", "outlet string, words string", ttlDurationMs=int(self.hours * HOUR_MS))
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import pandas as pd

        # a bounded list: `most` at most, with words as one string, since a stored value holds plain columns
        held = {k[0]: (v[0], frozenset(v[1].split(" "))) for k, v in self.titles.iterator()}
        n = self.count.get()[0] if self.count.exists() else 0
        for frame in rows:
            found = []
            for outlet, words in zip(frame["outlet"], frame["words"]):
                own = frozenset(words if words is not None else ())
                similar = len(own) >= fixed.MIN_WORDS and any(other != (outlet or "").lower() and len(w) >= fixed.MIN_WORDS and len(own & w) / min(len(own), len(w)) >= self.threshold for other, w in held.values())
                found.append(similar)
                if own and not similar:
                    held[n] = ((outlet or "").lower(), own)
                    self.titles.updateValue((n,), ((outlet or "").lower(), " ".join(sorted(own))))
                    n += 1
                    for old in sorted(held)[: -self.most]:
                        del held[old]
                        self.titles.removeKey((old,))
            yield frame.assign(similar=pd.array(found, dtype="boolean"))
        self.count.update((n,))

    def close(self) -> None:
        pass


def recent_titles(items: DataFrame, by: str, threshold: float = fixed.SIMILARITY, hours: float = fixed.TITLE_HOURS, most: int = fixed.TITLES_KEPT) -> DataFrame:
    """Streaming items (by, outlet, words, ...) with `similar`: to one of the last `most` headlines kept within `hours`."""
    use_state_store(items.sparkSession)
    schema = T.StructType([*items.schema, T.StructField("similar", T.BooleanType())])
    return items.groupBy(by).transformWithStateInPandas(RecentTitles(threshold, hours, most), schema, "append", "processingTime")


class HoldingQueue(StatefulProcessor):
    """A queue by key that waits for a judge: asked at `due` rows, or when the oldest has waited
    due_minutes; rows that wait for overdue_hours are dropped, and beyond `most` the oldest are cut."""

    def __init__(self, judge: Callable[[list[dict]], set | None] | None, due: int, due_minutes: float, overdue_hours: float, most: int, retry_minutes: float, event_time: bool):
        self.judge, self.due, self.most, self.event_time = judge, due, most, event_time
        self.due_ms, self.overdue_ms, self.retry_ms = int(due_minutes * 60_000), int(overdue_hours * HOUR_MS), int(retry_minutes * 60_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getMapState("queue", "url string", "seq long, queued_ms long, row string")
        self.count = handle.getValueState("count", "n long")

    def _now(self, timer_values) -> int:
        return timer_values.getCurrentWatermarkInMs() if self.event_time else timer_values.getCurrentProcessingTimeInMs()

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        n = self.count.get()[0] if self.count.exists() else 0
        for frame in rows:
            for url, ms, row in zip(frame["url"], frame["queued_ms"], frame["row"]):
                if not self.queue.containsKey((url,)):
                    self.queue.updateValue((url,), (n, int(ms), row))
                    n += 1
        self.count.update((n,))
        yield from self._run(key, self._now(timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        yield from self._run(key, self._now(timerValues))

    def _run(self, key, now: int) -> Iterator:
        import pandas as pd

        waiting = sorted((v[0], v[1], k[0], v[2]) for k, v in self.queue.iterator())  # `most` and a micro-batch's own
        gone: list[tuple[str, str, str]] = []

        def leave(entries, action: str) -> None:
            for entry in entries:
                gone.append((entry[2], action, entry[3]))
                self.queue.removeKey((entry[2],))

        leave([e for e in waiting if now - e[1] >= self.overdue_ms], "dropped")
        waiting = [e for e in waiting if now - e[1] < self.overdue_ms]
        asked = bool(waiting) and (len(waiting) >= self.due or now - min(e[1] for e in waiting) >= self.due_ms)
        verdict = self.judge([json.loads(e[3]) for e in waiting]) if asked and self.judge else None
        if verdict is not None:
            leave([e for e in waiting if e[2] in verdict], "released")
            leave([e for e in waiting if e[2] not in verdict], "rejected")
            waiting = []
        leave(waiting[: -self.most], "cut")
        waiting = waiting[-self.most :]
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if waiting:
            oldest = min(e[1] for e in waiting)
            at_due = now + self.retry_ms if asked else oldest + self.due_ms
            self.handle.registerTimer(max(now + 1, min(at_due, oldest + self.overdue_ms)))
        if gone:
            yield pd.DataFrame({"queue": key[0], "url": [g[0] for g in gone], "action": [g[1] for g in gone], "row": [g[2] for g in gone]})

    def close(self) -> None:
        pass


def holding_queue(
    held: DataFrame, by: str, judge: Callable[[list[dict]], set | None] | None, due: int = fixed.QUEUE_DUE, due_minutes: float = fixed.QUEUE_DUE_MINUTES, overdue_hours: float = fixed.QUEUE_OVERDUE_HOURS,
    most: int = fixed.QUEUE_ENTRIES, retry_minutes: float = 15, event_time: bool = False,
) -> DataFrame:
    """queue, url, action and the columns of streaming rows held(url, queued_at, ...) as they leave their queue.

    action: released (kept by the judge), rejected or dropped (both to be claimed, so that they don't
    come back), cut (by the cap; not claimed). judge gets the queue's rows and gives the urls that it
    keeps, or None without a verdict: then all stay and it is asked again after retry_minutes. A url
    waits once. event_time: the clock is the stream's watermark, which held must have, and not the time of day.
    """
    use_state_store(held.sparkSession)
    at = F.unix_millis("queued_at").alias("queued_ms")
    rows = held.where("url IS NOT NULL").select(F.coalesce(F.col(by).cast("string"), F.lit("")).alias("queue"), "url", at, F.to_json(F.struct("*")).alias("row"), *(["queued_at"] if event_time else []))
    own = HoldingQueue(judge, due, due_minutes, overdue_hours, most, retry_minutes, event_time)
    out = rows.groupBy("queue").transformWithStateInPandas(own, "queue string, url string, action string, row string", "append", "eventTime" if event_time else "processingTime")
    parsed = F.from_json("row", held.schema).alias("row")
    return out.select("queue", "url", "action", parsed).select("queue", "url", "action", *[F.col(f"row.{c}").alias(c) for c in held.columns if c not in ("queue", "url", "action")])

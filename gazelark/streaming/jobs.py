"""Structured Streaming: micro-batches with claims, first sights and a holding queue."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gazelark import fixed
from gazelark.functions import text as X
from gazelark.shared import checkpointed
from gazelark.sources.versioned import Versioned, live_keys


class Claims:
    """A claim table: a batch's keys are written before it is sent and taken back if it fails.

    Each batch has a tag of its own under which it is committed once, also when it is repeated. Runs
    that overlap commit to the same table; who comes second gets the keys that are left. Every
    COMPACT_AT commits the live claims are put together, so neither their number nor their files grow
    with the number of batches.
    """

    def __init__(self, spark: SparkSession, path: str, days: int = fixed.SEEN_DAYS):
        self.table, self.days = Versioned(spark, path), days

    def read(self, but: int | None = None) -> DataFrame:
        return self.table.read(but_tag=None if but is None else f"batch {but}").where(live_keys(self.days))

    def claim(self, batch_id: int, keys: DataFrame) -> DataFrame:
        """Claims the keys; the result is what of them other runs have claimed since they were read."""
        own = checkpointed(keys.select("key").distinct())
        tag, stamped = f"batch {batch_id}", own.select("key", F.current_timestamp().alias("at"))
        version = self.table.commit_decided(lambda state: stamped.join(state.where(live_keys(self.days)).select("key"), "key", "left_anti"), tag=tag)
        mine = self.table._of([f["name"] for f in self.table.manifest(version).folders if f["tag"] == tag])
        return own.join(mine.select("key"), "key", "left_anti")

    def release(self, batch_id: int) -> None:
        self.table.withdraw(f"batch {batch_id}")

    def compact_when_due(self, batch_id: int) -> bool:
        """Puts the live claims together; the last batch's stay apart, as it may be repeated."""
        return self.table.compact_when_due(live_keys(self.days), but_tag=f"batch {batch_id}")


def run_stream(
    items: DataFrame, claims: Claims, process: Callable[[DataFrame], DataFrame], send: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """items (streaming: ord, url, title, ...) -> process -> claim -> send, a failure takes the claim back.

    every: a processing-time trigger such as '15 minutes'; None takes all there is and ends.
    """
    from gazelark.operators.dedup import already_posted

    def one(batch: DataFrame, batch_id: int) -> None:
        new = process(already_posted(batch, claims.read(but=batch_id))).persist()
        try:
            taken = claims.claim(batch_id, new.select(F.explode(X.keys_for(F.col("url"), F.col("title"))).alias("key")))
            try:
                send(already_posted(new, taken), batch_id)
            except Exception:
                claims.release(batch_id)
                raise
            claims.compact_when_due(batch_id)
        finally:
            new.unpersist()

    writer = items.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def late_filtered(items: DataFrame, at: str, now: Column, window_minutes: Column, watermark: str) -> DataFrame:
    """Rows within their source's own window; the watermark, of the longest window, only frees state."""
    return items.withWatermark(at, watermark).where(X.hours_between(F.col(at), now) * 60 <= window_minutes)


def first_seen_stream(items: DataFrame, key: str, at: str, watermark: str = "7 days") -> DataFrame:
    """The first row of each key within the watermark; state goes with it."""
    return items.withWatermark(at, watermark).dropDuplicatesWithinWatermark([key])


def tumbling_counts(events: DataFrame, at: str, by: str, width: str = "15 minutes", watermark: str = "1 hour") -> DataFrame:
    return events.withWatermark(at, watermark).groupBy(F.window(at, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


STREAK_STATE = "streak int"


def streak_stream(outcomes: DataFrame, key: str, ok: str) -> DataFrame:
    """key, streak, runs after each micro-batch: failures in a row, kept as state of each source.

    outcomes: streaming rows with the key, a boolean `ok` and the order column `at`.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(k: tuple, frames: Iterator, state):
        import pandas as pd

        streak, runs = (state.get[0], 0) if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values("at")
        for good in rows[ok]:
            streak, runs = (0 if good else streak + 1), runs + 1
        state.update((streak,))
        yield pd.DataFrame({key: [k[0]], "streak": [streak], "runs": [runs]})

    kind = outcomes.schema[key].dataType.simpleString()
    return outcomes.select(key, ok, "at").groupBy(key).applyInPandasWithState(update, f"{key} {kind}, streak int, runs int", STREAK_STATE, "update", GroupStateTimeout.NoTimeout)

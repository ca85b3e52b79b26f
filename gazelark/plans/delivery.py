"""Delivery of bundles: claimed, sent, logged; a bundle that fails gives its claims back, and no other does.

Claims and the log are versioned tables, each bundle under a tag of its own, so that a bundle's claims
can be taken back by themselves and a batch that is repeated is logged once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazelark import fixed
from gazelark.functions import text as X
from gazelark.operators.dedup import merge_log, merge_titles
from gazelark.shared import checkpointed
from gazelark.sources.config import LOG
from gazelark.sources.versioned import Versioned, live_keys

TITLES = "at timestamp, outlet string, words array<string>"


def posted_log(spark: SparkSession, path: str) -> Versioned:
    """The log of what was posted, merged as logs are."""
    return Versioned(spark, path, LOG, lambda rows: merge_log(rows, rows.limit(0)))


def posted_titles(spark: SparkSession, path: str) -> Versioned:
    """Headlines to compare with: the last TITLES_KEPT."""
    return Versioned(spark, path, TITLES, lambda rows: merge_titles(rows, rows.limit(0)))


class Outbox:
    """Sends the bundles of a batch; log and titles may be left out."""

    def __init__(self, claims: Versioned, send: Callable[[str, str], None], log: Versioned | None = None, titles: Versioned | None = None, days: int = fixed.SEEN_DAYS):
        self.claims, self.send, self.log, self.titles, self.days = claims, send, log, titles, days

    def deliver(self, items: DataFrame, texts: Callable[[DataFrame], DataFrame], batch_id: int) -> dict[str, str | None]:
        """Bundle (stream) -> None once delivered, or the error. items: stream, url, title and LOG's columns.

        texts gives stream, text of the items handed to it. Items of which another run has claimed a key
        aren't sent. A few bundles a batch, each a message's size.
        """
        items = checkpointed(items)
        out: dict[str, str | None] = {}
        for stream in sorted(r["stream"] for r in items.select("stream").distinct().collect()):  # a few
            tag = f"batch {batch_id} {stream}"
            out[stream] = self._bundle(items.where(F.col("stream") == stream), texts, tag)
        self.claims.compact_when_due(live_keys(self.days))
        return out

    def _bundle(self, own: DataFrame, texts: Callable[[DataFrame], DataFrame], tag: str) -> str | None:
        keys = own.select("url", F.explode(X.keys_for(F.col("url"), F.col("title"))).alias("key"))
        stamped = keys.select("key", F.current_timestamp().alias("at")).distinct()
        version = self.claims.commit_decided(lambda state: stamped.join(state.where(live_keys(self.days)).select("key"), "key", "left_anti"), tag=tag)
        mine = self.claims._of([f["name"] for f in self.claims.manifest(version).folders if f["tag"] == tag])
        taken = keys.join(mine.select("key"), "key", "left_anti").select("url").distinct()
        left = checkpointed(own.join(taken, "url", "left_anti"))
        if left.isEmpty():
            return None
        try:
            for row in texts(left).toLocalIterator():  # a message
                self.send(row["stream"], row["text"])
        except Exception as e:  # noqa: BLE001 - a sink is the caller's
            self.claims.withdraw(tag)
            return f"{type(e).__name__}: {e}"
        if self.log is not None:
            self.log.commit(left.withColumn("at", F.current_timestamp()), tag=tag)
        if self.titles is not None:
            self.titles.commit(left.select(F.current_timestamp().alias("at"), "outlet", X.title_words(F.col("title")).alias("words")), tag=tag)
        return None

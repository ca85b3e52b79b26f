"""Joins of items with dimensions, verdicts, caches and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def source_dim(items: DataFrame, sources: DataFrame, default_window: int) -> DataFrame:
    """items with their source's window_minutes and threshold. Spark broadcasts the dimension by its size."""
    dim = sources.select("source_key", F.coalesce("window_minutes", F.lit(default_window)).alias("window_minutes"), "threshold")
    return items.join(dim, "source_key", "left").withColumn("window_minutes", F.coalesce("window_minutes", F.lit(default_window)))


def verdict_by_id(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """rows by position with the model's verdict: without one they stay, `false` drops them."""
    return rows.join(verdicts.select("id", "is_gift", "note"), "id", "left").where(F.coalesce("is_gift", F.lit(True)))


def pick_items(picks: DataFrame, pool: DataFrame) -> DataFrame:
    """picks (id, section, line) joined to the pool's rows by position; unknown ids and `neither` go."""
    return picks.where("section <> 'neither'").join(pool, "id")


def page_cache(pages: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages whose signature is the cached one, with the cached events; pages still to be read)."""
    known = cache.select("url", F.col("sig"), "events")
    return pages.join(known, ["url", "sig"]), pages.join(known, ["url", "sig"], "left_anti")


def queue_add(queue: DataFrame, new: DataFrame) -> DataFrame:
    """queue and those new rows whose url isn't queued, each once."""
    return queue.unionByName(new.dropDuplicates(["url"]).join(queue.select("url"), "url", "left_anti").select(*queue.columns))


def queue_remove(queue: DataFrame, urls: DataFrame) -> DataFrame:
    return queue.join(urls.select("url").distinct(), "url", "left_anti")


def live_keys(findings: DataFrame, fetched: DataFrame) -> DataFrame:
    """Findings of sources that this run fetched."""
    return findings.join(fetched.select("source_key").distinct(), "source_key", "left_semi")


def url_in_set(items: DataFrame, urls: DataFrame, inside: bool = True) -> DataFrame:
    return items.join(urls.select("url").distinct(), "url", "left_semi" if inside else "left_anti")


def already_shown(items: DataFrame, titles: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Backfill: items (ord, outlet, words) without a remembered title that is nearly the same."""
    from gazelark.operators.dedup import with_similar

    return items.join(with_similar(items, titles, threshold), "ord", "left_anti")


def fail_closed(items: DataFrame, axis: str, screened: bool) -> tuple[DataFrame, DataFrame]:
    """(passing, held) gifts: without the axis they are held for screening, or dropped without one."""
    has = F.array_contains("axes", axis) | (F.col("stream") != "major_gift")
    return items.where(has), items.where(~has) if screened else items.where(F.lit(False))

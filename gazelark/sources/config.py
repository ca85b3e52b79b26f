"""Catalogues and saved documents as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazelark.shared import checkpointed, remove_folder

SOURCE = "source_key string, outlet string, method string, url string, query string, publisher array<string>, threshold int, window_minutes int, stale_days int, enabled boolean, paywall boolean, desk string, category string, link_pattern string, base string"
STATE = "key string, at timestamp"
LOG = "at timestamp, title string, url string, outlet string, desk string, category string, score int, axes array<string>, paywall boolean, published timestamp, words array<string>, corroboration int, kind string"
QUEUE = "title string, url string, outlet string, desk string, published timestamp, body string, score int, source_key string, queued_at timestamp"


def sources(spark: SparkSession, config: list[dict], only: list[str] | None = None) -> DataFrame:
    """The enabled sources of a catalogue; an unknown key in `only` is an error."""
    names = [f.split()[0] for f in SOURCE.split(", ")]
    rows = [{n: s.get("key" if n == "source_key" else n) for n in names} for s in config]
    unknown = set(only or []) - {r["source_key"] for r in rows}
    if unknown:
        raise ValueError(f"unknown sources: {', '.join(sorted(unknown))}")
    for r in rows:
        r["enabled"] = r["enabled"] is not False
        r["publisher"] = [r["publisher"]] if isinstance(r["publisher"], str) else r["publisher"]
    live = [tuple(r[n] for n in names) for r in rows if r["enabled"] and (not only or r["source_key"] in only)]
    return spark.createDataFrame(live, SOURCE)


def saved(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a known schema; damaged lines are dropped, a missing folder is empty."""
    try:
        lines = spark.read.text(path).where("trim(value) <> ''")
        parsed = F.from_json("value", f"{schema}, _damaged string", {"columnNameOfCorruptRecord": "_damaged"})
        return lines.select(parsed.alias("row")).where("row._damaged IS NULL").select("row.*").drop("_damaged")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def people(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """name, n: the dimension that JSON objects {name: n} at the path hold, an object a line, or (lines=False)
    a file. What isn't such an object holds nobody, and a path that isn't there neither; repeated names add up."""
    try:
        texts = spark.read.text(path, wholetext=not lines)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "name string, n long")
        raise
    return texts.select(F.explode(F.from_json("value", "map<string,bigint>")).alias("name", "n")).groupBy("name").agg(F.sum("n").alias("n"))


def save(rows: DataFrame, path: str) -> None:
    """rows as JSON lines in place of what is at the path, which they may come from.

    They are written beside it and then moved, so a reader finds the old or the new document; a run
    that is lost between the two steps leaves the new one under `path.next`, where recover() finds it.
    """
    spark = rows.sparkSession
    recover(spark, path)
    checkpointed(rows).write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{path}.next")
    _replace(spark, path)


def recover(spark: SparkSession, path: str) -> None:
    """Ends a save that was lost after its rows were whole."""
    jvm = spark._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}.next/_SUCCESS")
    if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        _replace(spark, path)


def _replace(spark: SparkSession, path: str) -> None:
    made = spark._jvm.org.apache.hadoop.fs.Path
    fs = made(path).getFileSystem(spark._jsc.hadoopConfiguration())
    remove_folder(spark, path)
    if not fs.rename(made(f"{path}.next"), made(path)):
        raise OSError(f"{path}.next could not be moved to {path}")


def feed_catalogue(feeds: DataFrame) -> DataFrame:
    """source, url, own, key of rows (source, url, own): a catalogue of feeds; `own` ones serve only to leave
    out what was published already. A name or an address that stands twice is an error where it is read."""
    key = F.regexp_replace(F.regexp_replace(F.lower("source"), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    # each name and each address is counted by itself; only those that stand twice go on
    once = lambda c: feeds.groupBy(F.col(c).alias("twice")).agg(F.count("*").alias("n")).where("n > 1").select("twice")
    twice = once("source").unionByName(once("url")).agg(F.array_sort(F.collect_set("twice")).alias("twice"))
    wrong = F.raise_error(F.concat(F.lit("feeds that stand twice: "), F.array_join(F.slice("twice", 1, 20), ", "))).cast("boolean")
    # one row against all, so that the error is raised whichever part is read
    return feeds.join(F.broadcast(twice), F.lit(True)).where((F.size("twice") == 0) | wrong).select("source", "url", F.coalesce("own", F.lit(False)).alias("own"), key.alias("key"))

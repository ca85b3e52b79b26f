"""A Spark data source of feed, search, listing or page bodies in files: one partition a file.

Path-based files only, opened by Spark's reader in scan_bodies(); the data source `gazelark_feeds`
is for catalogues with a fetch policy: a row of the catalogue is a partition, read with retries.
"""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, InputPartition

from gazelark.shared import shared_path, within

SCHEMA = "source_key string, url string, status int, body string, error string"


def scan_bodies(spark: SparkSession, path: str) -> DataFrame:
    """source_key (the file's name), body of every file under a path, wherever Spark can read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("source_key"), F.decode("content", "UTF-8").alias("body"))


class Fetched(InputPartition):
    def __init__(self, key: str, url: str):
        self.key, self.url = key, url


def fetch_with_retries(url: str, get: Callable[[str], tuple[int, str]], attempts: int = 3, wait: float = 1.5) -> tuple[int | None, str | None, str | None]:
    """(status, body, error): only no answer, 429 and 5xx are tried again, after a growing wait."""
    status, error = None, None
    for attempt in range(1, attempts + 1):
        try:
            status, body = get(url)
        except OSError as e:
            status, error = None, f"{type(e).__name__}: {e}"
        else:
            if status < 400:
                return status, body, None
            error = f"HTTP {status}"
            if status != 429 and status < 500:
                break
        if attempt < attempts:
            time.sleep(wait * attempt)
    return status, None, error


def http_answer(url: str, timeout: float = 25.0, method: str = "GET", data: bytes | None = None, kind: str | None = None) -> tuple[int, str, dict[str, str]]:
    """(status, body, headers in lower case)."""
    import urllib.error
    import urllib.request

    headers = {"User-Agent": "Mozilla/5.0 (compatible; gazelark)"} | ({"Content-Type": kind} if kind else {})
    request = urllib.request.Request(url, data=data, headers=headers, method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace"), {k.lower(): v for k, v in answer.headers.items()}
    except urllib.error.HTTPError as e:
        return e.code, "", {}


def http_get(url: str, timeout: float = 25.0) -> tuple[int, str]:
    return http_answer(url, timeout)[:2]


class FeedReader(DataSourceReader):
    def __init__(self, catalogue: list[tuple[str, str]], attempts: int):
        self.catalogue, self.attempts, self.keys = catalogue, attempts, None

    def pushFilters(self, filters):  # noqa: N802
        """source_key = '...' leaves only that source to be fetched."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("source_key",):
                self.keys = {f.value} if self.keys is None else self.keys & {f.value}
            else:
                yield f

    def partitions(self):
        return [Fetched(k, u) for k, u in self.catalogue if self.keys is None or k in self.keys] or [Fetched("", "")]

    def read(self, partition):
        if partition.url:
            get = http_get if re.match("https?://", partition.url) else _local
            yield (partition.key, partition.url, *fetch_with_retries(partition.url, get, self.attempts))


def _local(path: str) -> tuple[int, str]:
    with open(path.removeprefix("file://"), encoding="utf-8", errors="replace") as f:
        return 200, f.read()


class FeedStreamReader(DataSourceStreamReader):
    """A stream of the sources that changed. The offset holds the mark of each source's last sight (what
    its server says of the body: tag, date of change; of a file its time and size), so a poll resumes
    after a restart and reads only what has changed since. A micro-batch is a partition a source.

    A source that can't be asked has the error for a mark, and gives a row with it, once until it changes;
    one whose server gives no mark counts as changed every `every` seconds.
    """

    AT_ONCE = 10

    def __init__(self, catalogue: list[tuple[str, str]], attempts: int, every: float):
        self.catalogue, self.attempts, self.every = catalogue, attempts, every

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(self.AT_ONCE) as pool:
            marks = pool.map(self._mark, [url for _, url in self.catalogue])
        return {key: mark for (key, _), mark in zip(self.catalogue, marks)}

    def _mark(self, url: str) -> str:
        try:
            if not re.match("https?://", url):
                own = os.stat(url.removeprefix("file://"))
                return f"{own.st_mtime_ns} {own.st_size}"
            status, _, headers = http_answer(url, method="HEAD")
        except OSError as e:
            return f"error {type(e).__name__}"
        if status >= 400 and status not in (403, 405, 501):  # those may only mean that this way of asking isn't allowed
            return f"error HTTP {status}"
        said = " ".join(headers[h] for h in ("etag", "last-modified") if h in headers)
        return said or f"at {int(time.time() // self.every)}"

    def partitions(self, start: dict, end: dict) -> list[Fetched]:
        return [Fetched(k, u) for k, u in self.catalogue if k in end and start.get(k) != end[k]]

    def read(self, partition: Fetched):
        get = http_get if re.match("https?://", partition.url) else _local
        yield (partition.key, partition.url, *fetch_with_retries(partition.url, get, self.attempts))

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    """Options: catalogue, lines of `key<TAB>url`; attempts; every, seconds after which a source of a
    stream that says nothing of its changes is read again; shared, the folder whose files may be read."""

    @classmethod
    def name(cls) -> str:
        return "gazelark_feeds"

    def schema(self) -> str:
        return SCHEMA

    def _catalogue(self) -> list[tuple[str, str]]:
        rows = [tuple(line.split("\t", 1)) for line in self.options.get("catalogue", "").splitlines() if "\t" in line]
        for _, url in rows:
            if not re.match("https?://", url) and not within(url, self.options.get("shared", "")):
                raise ValueError(f"no web address, and files are read only from the folder that all executors share, or where Spark runs on one machine: {url}")
        return rows

    def reader(self, schema):
        return FeedReader(self._catalogue(), int(self.options.get("attempts", "3")))

    def streamReader(self, schema):  # noqa: N802
        return FeedStreamReader(self._catalogue(), int(self.options.get("attempts", "3")), float(self.options.get("every", "900")))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedSource)


def _options(spark: SparkSession, catalogue: list[tuple[str, str]]) -> dict[str, str]:
    register(spark)
    files = any(not re.match("https?://", u) for _, u in catalogue)
    return {"shared": shared_path(spark) if files else "", "catalogue": "\n".join(f"{k}\t{u}" for k, u in catalogue)}


def fetch(spark: SparkSession, catalogue: list[tuple[str, str]]) -> DataFrame:
    return spark.read.format("gazelark_feeds").options(**_options(spark, catalogue)).load()


def polled(spark: SparkSession, catalogue: list[tuple[str, str]], every: float = 900) -> DataFrame:
    """The same rows as a stream: at each trigger, those of the sources that changed since the last one."""
    return spark.readStream.format("gazelark_feeds").options(**_options(spark, catalogue), every=str(every)).load()

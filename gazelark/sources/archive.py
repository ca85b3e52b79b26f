"""A data source of a paged archive: the first answer says how many posts there are, and so how many pages.

Each page is a partition, fetched by its own task with retries; a page that can't be read is a row with
an error, and no other page is lost. Archives are read by their interface (`page` and `per_page` in the
address, the total in the header x-wp-total) or, where Spark runs on one machine, from a folder with
page-N.json and total.txt.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gazelark.shared import shared_path, within
from gazelark.sources.feeds import fetch_with_retries, http_answer

SCHEMA = "page int, ord int, id long, date string, link string, html string, error string"


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


def _page_url(base: str, number: int, per_page: int) -> str:
    return f"{base}{'&' if '?' in base else '?'}per_page={per_page}&page={number}&orderby=date&order=desc&_fields=id,date,link,content"


class ArchiveReader(DataSourceReader):
    def __init__(self, base: str, per_page: int, attempts: int):
        self.base, self.per_page, self.attempts = base, per_page, attempts
        self.web = re.match("https?://", base) is not None

    def _get(self, number: int) -> tuple[str | None, int, str | None]:
        """(body, posts in the archive, error) of a page."""
        total = [0]

        def get(url: str) -> tuple[int, str]:
            if self.web:
                status, body, headers = http_answer(url)
                total[0] = int(headers.get("x-wp-total") or 0)
                return status, body
            with open(f"{self.base}/total.txt", encoding="utf-8") as f:
                total[0] = int(f.read())
            with open(url, encoding="utf-8") as f:
                return 200, f.read()

        url = _page_url(self.base, number, self.per_page) if self.web else f"{self.base}/page-{number}.json"
        _, body, error = fetch_with_retries(url, get, self.attempts)
        return body, total[0], error

    def partitions(self) -> list[Page]:
        _, total, error = self._get(1)
        if error:
            raise OSError(f"the archive's first page can't be read: {error}")
        return [Page(n) for n in range(1, max(1, -(-total // self.per_page)) + 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        body, _, error = self._get(partition.number)
        try:
            posts = json.loads(body) if body is not None else []
        except ValueError as e:
            posts, error = [], f"no JSON: {e}"
        if error:
            yield (partition.number, None, None, None, None, None, error)
        for i, post in enumerate(posts):
            content = post.get("content")
            yield (partition.number, i, post.get("id"), post.get("date"), post.get("link"), content.get("rendered") if isinstance(content, dict) else content, None)


class ArchiveSource(DataSource):
    """Options: url or folder; per_page; attempts; shared, the folder within which folders may be read."""

    @classmethod
    def name(cls) -> str:
        return "gazelark_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        base = self.options.get("url", "").removeprefix("file://")
        if not re.match("https?://", base) and not within(base, self.options.get("shared", "")):
            raise ValueError(f"no web address, and folders are read only from the one that all executors share, or where Spark runs on one machine: {base}")
        return ArchiveReader(base.rstrip("/"), int(self.options.get("per_page", "100")), int(self.options.get("attempts", "4")))


def archive(spark: SparkSession, url: str, per_page: int = 100, attempts: int = 4) -> DataFrame:
    """page, ord, id, date, link, html, error: every post of the archive, a partition a page."""
    spark.dataSource.register(ArchiveSource)
    shared = "" if re.match("https?://", url) else shared_path(spark)
    return spark.read.format("gazelark_archive").options(url=url, per_page=str(per_page), attempts=str(attempts), shared=shared).load()

"""A data source of JSON documents that a server hands out by page: one partition for each page of each league."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "sport string, league string, page int, payload string, ingested timestamp"
#: Answers after which a request is tried again.
AGAIN = (429, 500, 502, 503, 504)


@dataclass
class Page(InputPartition):
    sport: str
    league: str
    page: int

    def __post_init__(self) -> None:
        super().__init__(None)


class PagedJson(DataSource):
    """``spark.read.format("paged_json")`` after ``register``; rows (sport, league, page, payload, ingested).

    Options: ``url`` with {sport}, {league} and {page}; ``leagues``, such as ``soccer/eng.1,basketball/nba``; ``pages`` of
    each league (1); ``retries`` of a request (3), ``wait`` seconds before the first of them, doubled each time (0.5), and
    ``timeout`` seconds (30). A page that is not there (404) has no row; other errors fail the task, which Spark tries again.
    Filters on sport, league and page (=, in) leave out requests, where spark.sql.python.filterPushdown.enabled is set.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.allowed: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in ("sport", "league", "page"):
                name = f.attribute[0]
                self.allowed[name] = self.allowed.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[Page]:
        leagues = [x.strip().split("/", 1) for x in self.options["leagues"].split(",") if x.strip()]
        pages = [Page(sport, league, page) for sport, league in leagues for page in range(1, int(self.options.get("pages", 1)) + 1)]
        return [p for p in pages if all(getattr(p, name) in values for name, values in self.allowed.items())]

    def read(self, partition: Page) -> Iterator[tuple]:
        payload = self.fetch(self.options["url"].format(sport=partition.sport, league=partition.league, page=partition.page))
        if payload is not None:
            yield partition.sport, partition.league, partition.page, payload, datetime.now(timezone.utc)

    def fetch(self, url: str) -> str | None:
        retries, wait = int(self.options.get("retries", 3)), float(self.options.get("wait", 0.5))
        for left in range(retries, -1, -1):
            try:
                with urllib.request.urlopen(url, timeout=float(self.options.get("timeout", 30))) as answer:
                    return answer.read().decode("utf-8", "replace")
            except urllib.error.HTTPError as error:
                if error.code == 404:
                    return None
                if error.code not in AGAIN or not left:
                    raise
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if not left:
                    raise
            time.sleep(wait)
            wait *= 2
        return None


def register(spark: SparkSession) -> None:
    """Make the source known and its filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedJson)

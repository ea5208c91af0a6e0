"""A paged feed as a stream: offsets hold the validity, the confirmed pages and the stated total; tasks fetch the pages.

A page is a JSON document with ``validity``, ``total``, ``pages`` and ``items`` (objects with an ``id``), found at a URL in which ``{page}``
stands for its number from 0. A batch reads the pages beyond the offset and again the ``overlap`` pages before it, as the last page may have
been filled up. Another validity means from the beginning. Nothing is read while validity, pages and total stay the same.

A stop between batches repeats the same range of pages; ``streaming.ingest`` replaces the batch and keeps each id once, the newest batch
first, so nothing is lost or doubled. Items without an id have a null one (``ingested`` counts those as one key). Fetches that fail are tried again after growing pauses, then the batch
fails and its offset doesn't move.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


def _fetch(url: str, page: int, tries: int, pause: float) -> dict:
    for k in range(tries):
        try:
            with urllib.request.urlopen(url.replace("{page}", str(page)), timeout=30) as answer:
                return json.load(answer)
        except (OSError, ValueError):
            if k + 1 == tries:
                raise
            time.sleep(pause * 2**k)
    raise ValueError("tries must be positive")


class PagedSource(DataSource):
    """Options: ``url``, ``overlap`` (1), ``tries`` (4), ``pause`` in seconds (0.25)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "validity string, page long, id string, item string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Pages(self.options["url"], int(self.options.get("overlap", "1")), int(self.options.get("tries", "4")), float(self.options.get("pause", "0.25")))


class _Page(InputPartition):
    def __init__(self, number: int, validity: str):
        self.number, self.validity = number, validity


class _Pages(DataSourceStreamReader):
    def __init__(self, url: str, overlap: int, tries: int, pause: float):
        if overlap < 1 or tries < 1:
            raise ValueError("overlap and tries must be positive")
        self.url, self.overlap, self.tries, self.pause = url, overlap, tries, pause

    def initialOffset(self) -> dict:
        return {"validity": "", "pages": 0, "total": 0}

    def latestOffset(self) -> dict:
        head = _fetch(self.url, 0, self.tries, self.pause)
        return {"validity": str(head["validity"]), "pages": int(head["pages"]), "total": int(head["total"])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start == end:
            return []
        first = max(0, min(start["pages"], end["pages"]) - self.overlap) if start["validity"] == end["validity"] else 0
        return [_Page(k, end["validity"]) for k in range(first, end["pages"])]

    def read(self, partition: _Page) -> Iterator[tuple]:
        own = _fetch(self.url, partition.number, self.tries, self.pause)
        if str(own["validity"]) != partition.validity:
            return  # the feed began anew since the offset was taken: the next batch reads it from its beginning
        for item in own["items"]:
            key = item.get("id")
            yield partition.validity, partition.number, None if key is None else str(key), json.dumps(item, sort_keys=True, ensure_ascii=False)


def paged_stream(spark: SparkSession, url: str, **options):
    spark.dataSource.register(PagedSource)
    return spark.readStream.format("paged").options(url=url, **options).load()

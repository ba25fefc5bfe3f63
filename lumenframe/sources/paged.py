"""Paged web sources as a Spark data source: pages are fetched by tasks, not by the driver."""

from __future__ import annotations

import itertools
import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


READERS = 4             # tasks that read in turn where the number of pages is not given


class PageRange(InputPartition):
    """Pages from ``first`` by ``step`` to ``last``, or to the end of the source where that is None."""

    def __init__(self, first: int, last: int | None, step: int = 1):
        self.first, self.last, self.step = first, last, step


def page_url(options: dict, page: int) -> str:
    """``{page}`` and ``{offset}`` in the address are replaced; else the paging parameter is added."""
    url, size = options["url"], int(options.get("page_size", "100"))
    if "{page}" in url or "{offset}" in url:
        return url.replace("{page}", str(page)).replace("{offset}", str((page - 1) * size))
    style = options.get("pagination", "none")
    if style == "none":
        return url
    query = {"page": page} if style == "page" else {"offset": (page - 1) * size}
    return url + ("&" if "?" in url else "?") + urllib.parse.urlencode({**query, "limit": size})


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        pages = int(self.options.get("max_pages", "0"))
        if self.options.get("pagination", "none") == "none" and "{" not in self.options["url"]:
            pages = 1
        if not pages:
            return [PageRange(p, None, READERS) for p in range(1, READERS + 1)]
        per_task = max(1, int(self.options.get("pages_per_task", "1")))
        return [PageRange(p, min(p + per_task - 1, pages)) for p in range(1, pages + 1, per_task)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        token = self.options.get("token")
        headers = {"Authorization": f"Bearer {token}"} if token else {}
        before = None
        for page in itertools.count(partition.first, partition.step) if partition.last is None else range(partition.first, partition.last + 1):
            request = urllib.request.Request(page_url(self.options, page), headers=headers)
            try:
                with urllib.request.urlopen(request, timeout=15) as reply:
                    node = json.loads(reply.read().decode("utf-8"))
            except urllib.error.HTTPError as error:
                # Some sources have no page after the last one.
                if partition.last is None and page > 1 and error.code == 404:
                    return
                raise
            for part in filter(None, self.options.get("data_path", "").split(".")):
                if not (isinstance(node, dict) and part in node):
                    break
                node = node[part]
            items = node if isinstance(node, list) else [node if isinstance(node, dict) else {"value": node}]
            if partition.last is None:
                if not items:
                    return
                if items == before:
                    raise ValueError(f"page {page} repeats page {page - partition.step}: give max_pages")
                before = items
            for i, item in enumerate(items):
                yield page, i, json.dumps(item)


class PagedSource(DataSource):
    """Format ``paged_json``: one row per item with its page, place and JSON text."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, place int, item string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


def read_pages(spark: SparkSession, url: str, item_schema: str, data_path: str = "", pagination: str = "none",
               max_pages: int | None = None, page_size: int = 100, token: str | None = None) -> DataFrame:
    """Items of all pages as columns of ``item_schema`` (DDL), flattened. Pages after the end are empty.

    Pages are read until an empty one, or up to ``max_pages`` where that is given.
    """
    from lumenframe.sources.files import flatten_documents

    spark.dataSource.register(PagedSource)
    reader = spark.read.format("paged_json").option("url", url).option("data_path", data_path)
    reader = reader.option("pagination", pagination).option("page_size", page_size)
    if max_pages:
        reader = reader.option("max_pages", max_pages)
    if token:
        reader = reader.option("token", token)
    return flatten_documents(reader.load().select(F.from_json("item", item_schema).alias("x")).select("x.*"))

"""A paper search service as a Spark data source (A4, A5), with bounded retries.

    spark.dataSource.register(PaperSearch)
    spark.read.format("paper_search").option("queries", "a;b").option("endpoint", url).load()

The transport is a module-level function, so tests and offline runs give their
own; each query is one partition, pages are followed by token.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIELDS = "paperId,title,abstract,year,citationCount,venue,url"
SCHEMA = "query string, position bigint, paperId string, title string, abstract string, year int, citationCount int, venue string, url string"


class SearchError(RuntimeError):
    """A page could not be had within the allowed attempts."""


def http_get(url: str, timeout: float) -> tuple[int, dict[str, str], str]:
    """(status, headers, body) of a GET request."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310  the caller's endpoint
            return r.status, dict(r.headers), r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), ""


def pages(get: Callable, endpoint: str, query: str, years: str, delay: float, max_results: int, retries: int, timeout: float, max_wait: float, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """The records of a query, up to max_results.

    A failed page is asked for again after delay * 2 ** (n - 1) seconds, or what
    Retry-After says, never longer than max_wait; after ``retries`` failures in a
    row it is an error.
    """
    token, sent, failed = None, 0, 0
    while True:
        args = {"query": query, "fields": FIELDS, "year": years} | ({"token": token} if token else {})
        try:
            status, headers, body = get(f"{endpoint}?{urllib.parse.urlencode(args)}", timeout)
        except OSError:
            status, headers, body = 0, {}, ""
        if status != 200:
            failed += 1
            if failed >= retries:
                raise SearchError(f"{failed} failures in a row, the last with status {status}")
            wait = headers.get("Retry-After", "")
            sleep(min(float(wait) if status == 429 and wait.replace(".", "", 1).isdigit() else delay * 2 ** (failed - 1), max_wait))
            continue
        failed = 0
        page = json.loads(body)
        for record in page.get("data") or []:
            if sent >= max_results:
                return
            sent += 1
            yield record
        token = page.get("token")
        if not token or sent >= max_results:
            return


class _Query(InputPartition):
    def __init__(self, text: str):
        self.text = text


class PaperSearch(DataSource):
    """Options: endpoint, queries (separated by ';'), years, max_results, retries, delay, timeout, max_wait, transport ('module:function')."""

    @classmethod
    def name(cls) -> str:
        return "paper_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Query(q.strip()) for q in self.options.get("queries", "").split(";") if q.strip()]

    def read(self, partition: _Query) -> Iterator[tuple]:
        o = self.options
        module, _, function = o.get("transport", f"{__name__}:http_get").partition(":")
        get = getattr(importlib.import_module(module), function)
        found = pages(get, o["endpoint"], partition.text, o.get("years", "2019-2025"), float(o.get("delay", 5)), int(o.get("max_results", 1000)), int(o.get("retries", 3)), float(o.get("timeout", 15)), float(o.get("max_wait", 20)))
        for i, r in enumerate(found):
            yield (partition.text, i, *(r.get(f) for f in ("paperId", "title", "abstract", "year", "citationCount", "venue", "url")))

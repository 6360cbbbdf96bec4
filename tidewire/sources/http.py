"""Requests over HTTP: tables of requests (ask), and Python data sources for a few of them. A host is asked by one task, with pauses and few retries."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlencode, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window as W

#: Partitions that hosts are packed into.
HOST_PARTS = 64
PAGE, JSON = "canonical_url string, html string", "key string, body string"
_KINDS = {"string": pa.string(), "int": pa.int32(), "timestamp": pa.timestamp("us", "UTC"), "binary": pa.binary()}


def ask(requests: DataFrame, reader: type[PoliteReader], schema: str, parts: int = HOST_PARTS, **options) -> DataFrame:
    """The answers to a table of requests: the URL first, then what ``reader.answer`` takes; null URLs are not asked.

    A host's requests are in one task, which takes turns between its hosts and waits only where one was asked less than
    ``delay`` seconds ago. Asking happens whenever the result is evaluated: write it once and read that. A task that is
    run again, after a lost executor, asks again.
    """
    columns = requests.columns
    url, set_ = F.col(f"`{columns[0]}`"), {k: str(v) for k, v in options.items()}
    host = F.lower(F.regexp_extract(url, "^[^:]*://([^/?#]*)", 1))
    dealt = requests.filter(url.isNotNull()).withColumn("__host", host).repartition(parts, "__host")
    turns = dealt.withColumn("__turn", F.row_number().over(W.partitionBy("__host").orderBy(*columns))).sortWithinPartitions("__turn", "__host")
    fields = [x.split() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = reader(set_), {}
        for batch in batches:
            for at, *row in zip(batch.column("__host").to_pylist(), *(batch.column(c).to_pylist() for c in columns), strict=True):
                if at in last:
                    time.sleep(max(0.0, last[at] + own.delay - time.monotonic()))
                last[at] = time.monotonic()
                got = own.answer(*("" if x is None else x for x in row))
                yield pa.RecordBatch.from_arrays([pa.array([x], _KINDS[k]) for x, (_, k) in zip(got, fields, strict=True)], names=[n for n, _ in fields])

    return turns.select("__host", *(F.col(f"`{c}`").cast("string").alias(c) for c in columns)).mapInArrow(run, schema)


class HostPart(InputPartition):
    def __init__(self, host: str, rows: list[tuple]):
        self.host, self.rows = host, rows


class PoliteReader(DataSourceReader):
    """Options: requests (a line each, fields separated by tabs, the URL first), delay, timeout (seconds), tries, agent, max_bytes."""

    def __init__(self, options: dict):
        self.rows = [tuple(x.split("\t")) for x in options.get("requests", "").splitlines() if x.strip()]
        self.delay, self.timeout, self.tries = float(options.get("delay", 1.0)), float(options.get("timeout", 15)), int(options.get("tries", 3))
        self.agent, self.most = options.get("agent", "tidewire/1.0"), int(options.get("max_bytes", 0))

    def partitions(self) -> list[InputPartition]:
        by: dict[str, list] = {}
        for row in self.rows:
            by.setdefault(urlsplit(row[0]).netloc, []).append(row)
        return [HostPart(h, r) for h, r in by.items()] or [HostPart("", [])]

    def read(self, partition: HostPart) -> Iterator[tuple]:
        for k, row in enumerate(partition.rows):
            if k:
                time.sleep(self.delay)
            yield self.answer(*row)

    def answer(self, url: str, *fields: str) -> tuple:
        raise NotImplementedError

    def request(self, url: str, head: dict[str, str]) -> tuple[int, bytes, dict]:
        """status (0: no answer), body, headers. Failures of the line and of the server are tried again, other answers not."""
        status, body, got = 0, b"", {}
        for n in range(self.tries):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": self.agent} | head), timeout=self.timeout) as r:
                    return r.status, r.read(self.most) if self.most else r.read(), r.headers
            except urllib.error.HTTPError as e:
                status, got = e.code, e.headers
                if e.code < 500:
                    break
            except (OSError, ValueError):
                status = 0
            if n + 1 < self.tries:
                time.sleep(1.5 * (n + 1))
        return status, body, got


class PageReader(PoliteReader):
    def __init__(self, options: dict):
        super().__init__({"max_bytes": 250_000, "agent": "Mozilla/5.0 (compatible; tidewire)", **options})

    def answer(self, url: str, *fields: str) -> tuple:
        _, body, got = self.request(url, {})
        charset = got.get_content_charset() if hasattr(got, "get_content_charset") else None
        try:
            return url, body.decode(charset or "utf-8", "replace")
        except LookupError:
            return url, body.decode("utf-8", "replace")


class PageSource(DataSource):
    """``spark.read.format("tidewire_pages")``: the first bytes of pages (canonical_url, html); empty where that fails."""

    @classmethod
    def name(cls) -> str:
        return "tidewire_pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)


class JsonReader(PoliteReader):
    def answer(self, url: str, key: str = "", *parameters: str) -> tuple:
        query = urlencode([tuple(p.split("=", 1)) for line in parameters for p in line.split("\t") if "=" in p])
        status, body, _ = self.request(url + ("?" + query if query else ""), {"Accept": "application/json"})
        return key or url, body.decode("utf-8", "replace") if status == 200 else None


class JsonSource(DataSource):
    """``spark.read.format("tidewire_json")``: API answers (key, body), from lines ``url<TAB>key<TAB>name=value...``; body null where that fails.

    Bodies are parsed by from_json (see json_sources), which gives null for what is no JSON.
    """

    @classmethod
    def name(cls) -> str:
        return "tidewire_json"

    def schema(self) -> str:
        return JSON

    def reader(self, schema) -> DataSourceReader:
        return JsonReader(self.options)


def register(spark) -> None:
    """All of this package's data sources."""
    from tidewire.sources.feeds import FeedSource
    from tidewire.sources.files import DocumentSink, FilesSink

    for source in (FeedSource, PageSource, JsonSource, FilesSink, DocumentSink):
        spark.dataSource.register(source)

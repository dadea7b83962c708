"""Numbered HTTP requests as a data source: ``spark.read.format("http_pages")``.

Options: ``url`` with ``{n}`` where the number stands, ``first`` and ``last``
(both read), ``per_partition`` requests of one input partition (100), ``method``
(GET), ``headers`` (JSON), ``retries`` (3), ``backoff`` and ``timeout`` in seconds (1
and 30), ``allowed`` domains (comma-separated), ``transport``: the function that
sends one request, as module:name.  Every request passes the guard and is tried
again as ``fetch`` does; one that fails is a row with its error.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .http import check_url, fetch

SCHEMA = "request_no long, url string, status int, body string, error string"
ARROW = pa.schema([("request_no", pa.int64()), ("url", pa.string()), ("status", pa.int32()), ("body", pa.string()), ("error", pa.string())])
#: Requests whose answers are handed over together.
BATCH = 100


@dataclass
class Requests(InputPartition):
    """Requests number ``first`` to ``last``."""

    first: int
    last: int


def echo(url: str, method: str, body: bytes | None, headers: dict, timeout: float) -> tuple[int, str]:
    """A transport without a network: answers with the url's last part, and 404 where that ends in 7."""
    name = url.rpartition("/")[2]
    return (404, "none") if name.endswith("7") else (200, json.dumps({"n": name}))


class HttpPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(dict(self.options))


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.first, self.last = options["url"], int(options.get("first", 0)), int(options["last"])
        self.per_partition = int(options.get("per_partition", 100))
        if self.per_partition < 1:
            raise ValueError("per_partition must be positive")
        self.transport, self.method = options.get("transport", f"{fetch.__module__}:opener"), options.get("method", "GET")
        self.headers = json.loads(options.get("headers", "{}"))
        self.allowed = [d.strip() for d in options.get("allowed", "").split(",") if d.strip()]
        self.limits = {"retries": int(options.get("retries", 3)), "backoff": float(options.get("backoff", 1)), "timeout": float(options.get("timeout", 30))}

    def partitions(self) -> list[Requests]:
        return [Requests(n, min(n + self.per_partition - 1, self.last)) for n in range(self.first, self.last + 1, self.per_partition)] or [Requests(0, -1)]

    def read(self, partition: Requests) -> Iterator[pa.RecordBatch]:
        module, _, name = self.transport.partition(":")
        send, rows = getattr(importlib.import_module(module), name), []

        def guard(url: str) -> str:
            return check_url(url, self.allowed or None)

        for n in range(partition.first, partition.last + 1):
            url = self.url.replace("{n}", str(n))
            status, text = fetch(url, self.method, headers=self.headers, send=send, guard=guard, **self.limits)
            rows.append((n, url, status, text if status < 400 else None, None if status < 400 else text))
            if len(rows) == BATCH or n == partition.last:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ARROW)], schema=ARROW)
                rows = []

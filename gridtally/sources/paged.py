"""A Spark data source over an API that serves pages by key.

Options: fetch, as "module:function" with signature (after, limit, low, high)
-> list of rows in key order with after < key; key, the field to page by; page,
rows per page; ranges, as "low:high,low:high", one input partition each.  A table
without a key is paged by offset: key is then empty, and after the number of
rows read so far.  Instead of schema, describe may name a function that returns
the fields of the source with their types.  Transport errors and answers of status
429 or 5xx are retried with growing pauses before the task fails; other refusals
fail at once.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRIES = 3
PAUSE = 0.05


class FetchError(Exception):
    """A refused or failed request; status is the answer's, None if there was none."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message, status)
        self.status = status

    @property
    def passing(self) -> bool:
        return self.status is None or self.status == 429 or self.status >= 500


def named(path: str):
    """The function that "module:function" names."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def reported_total(path: str) -> int:
    """The number of records that the source itself reports, by the function that path names."""
    return int(patient(named(path)))


def patient(call, *args):
    """call(*args), again after passing errors; what stays is raised as a FetchError."""
    for attempt in range(RETRIES + 1):
        try:
            return call(*args)
        except (ConnectionError, TimeoutError, FetchError) as error:
            passing = not isinstance(error, FetchError) or error.passing
            if not passing or attempt == RETRIES:
                if isinstance(error, FetchError):
                    raise
                raise FetchError(str(error)) from error
            time.sleep(PAUSE * 2**attempt)


class KeyRange(InputPartition):
    def __init__(self, low: str, high: str):
        self.low, self.high = low, high


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridtally_pages"

    def schema(self) -> str:
        if "schema" in self.options:
            return self.options["schema"]
        fields = patient(named(self.options["describe"]))
        return ", ".join(f"`{name}` {kind}" for name, kind in fields.items())

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options), schema)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.options, self.fields = options, schema.names

    def partitions(self) -> list[KeyRange]:
        ranges = self.options.get("ranges", ":")
        return [KeyRange(*r.split(":")) for r in ranges.split(",")]

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        fetch = named(self.options["fetch"])
        key, size = self.options.get("key"), int(self.options.get("page", 1000))
        after = None if key else 0
        while True:
            rows = patient(fetch, after, size, partition.low or None, partition.high or None)
            for row in rows:
                yield tuple(row.get(f) for f in self.fields)
            if len(rows) < size:
                return
            after = rows[-1][key] if key else after + len(rows)

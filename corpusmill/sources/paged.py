"""Paged sources: rows that a service gives page by page, read in batch or as a stream that goes on where it stopped.

A connector says what the newest page is and gives the rows of a page; paged_source makes a Spark data source of it. The
offset of a stream is a page number, kept in the stream's checkpoint, so that a stream that starts again, after a stop or
a failure, asks for exactly the pages it has not finished. Pages are dealt to tasks in ranges, and a task holds one page
at a time. The connector travels to the tasks, so it must be picklable, with a class that the tasks can import or that
cloudpickle sends by value; it should hold addresses, not connections.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class Connector(Protocol):
    """Pages are numbered from 1 and don't change once they are there."""

    def newest(self) -> int:
        """The number of the last page; 0 if there is none."""

    def rows(self, page: int) -> Iterator[tuple]:
        """The rows of a page, as tuples of the schema."""


@dataclass
class Pages(InputPartition):
    """Pages after `after`, up to `last`."""

    after: int
    last: int


def _dealt(after: int, last: int, size: int) -> list[Pages]:
    return [Pages(a, min(a + size, last)) for a in range(after, last, size)]


def paged_source(name: str, schema: str, connector: Connector) -> type[DataSource]:
    """A data source to register with spark.dataSource.register, read by format(name).

    Options: pages (a task takes so many; 16), since (a batch, and a new stream, begin after this page; 0), and upto (a
    batch of a stream takes at most so many pages; all there are).
    """

    def read(pages: Pages) -> Iterator[tuple]:
        for page in range(pages.after + 1, pages.last + 1):
            yield from connector.rows(page)

    class Batch(DataSourceReader):
        def __init__(self, options: dict):
            self.since, self.size = int(options.get("since", 0)), int(options.get("pages", 16))

        def partitions(self) -> list[Pages]:
            return _dealt(self.since, connector.newest(), self.size) or [Pages(0, 0)]

        def read(self, partition: Pages) -> Iterator[tuple]:
            return read(partition)

    class Stream(DataSourceStreamReader):
        def __init__(self, options: dict):
            self.since, self.size, self.most = int(options.get("since", 0)), int(options.get("pages", 16)), int(options.get("upto", 0))
            self.given = None

        def initialOffset(self) -> dict:
            return {"page": self.since}

        def latestOffset(self) -> dict:
            newest = connector.newest()
            if self.most and self.given is not None:
                newest = min(newest, self.given + self.most)
            return {"page": newest}

        def partitions(self, start: dict, end: dict) -> list[Pages]:
            return _dealt(start["page"], end["page"], self.size)

        def read(self, partition: Pages) -> Iterator[tuple]:
            return read(partition)

        def commit(self, end: dict) -> None:
            self.given = end["page"]

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Batch(self.options)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Stream(self.options)

    return Source

"""Pages as a data source: partitions are ranges of pages, so a long file is many tasks.

``spark.dataSource.register(page_source(count, read))`` makes the format
``pages`` of two functions that a caller gives: ``count(path)``, the pages of a
file, and ``read(path, first, after)``, the texts of a range of them. The
driver lists names and sizes only; a file is cut into as many ranges as it has
``rangeBytes``, and each task turns its share into page numbers by itself.

A read without ``text`` in its schema calls ``count`` alone; with ``pushdown``
an equality on ``path`` leaves the other files out. A range that cannot be read is a row with
an ``error`` and no text, and the rest of the file is read. Functions open files
by path, so this is for folders that all workers can open; what only Spark can
open goes through ``files.pages``.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

PageCount = Callable[[str], int]
PageRange = Callable[[str, int, int], list[str]]

SCHEMA = "path string, page int, text string, error string"
#: Bytes of a file to a range, about.
RANGE_BYTES = 4 << 20


class Share(InputPartition):
    """Part ``number`` of ``parts`` of a file's pages."""

    def __init__(self, path: str, number: int, parts: int):
        self.path, self.number, self.parts = path, number, parts


def page_source(count: PageCount, read: PageRange, name_: str = "pages", suffix: str = ".pdf", pushdown: bool = False) -> type[DataSource]:
    """The data source of files that end in ``suffix`` (any case), under ``path``; its ``rangeBytes`` is an option.

    ``pushdown`` is for sessions with ``spark.sql.python.filterPushdown.enabled``.
    """

    class Reader(DataSourceReader):
        def __init__(self, options: dict, schema: StructType):
            self.path, self.bytes = options["path"].removeprefix("file:"), int(options.get("rangebytes", RANGE_BYTES))
            self.columns, self.only = schema.names, None

        def partitions(self) -> list[Share]:
            files = [self.path] if os.path.isfile(self.path) else sorted(glob.glob(f"{glob.escape(self.path)}/**", recursive=True))
            if not files:
                raise FileNotFoundError(f"nothing at {self.path}")
            own = [f for f in files if f.lower().endswith(suffix) and os.path.isfile(f) and self.only in (None, f)]
            sizes = {f: max(1, -(-os.path.getsize(f) // self.bytes)) for f in own}
            return [Share(f, k, n) for f, n in sizes.items() for k in range(n)] or [Share("", 0, 0)]

        def read(self, share: Share) -> Iterator[tuple]:
            if not share.parts:
                return
            first = after = 0
            try:
                n = count(share.path)
                first, after = n * share.number // share.parts, n * (share.number + 1) // share.parts
                texts = read(share.path, first, after) if "text" in self.columns and first < after else [None] * (after - first)
                if len(texts) != after - first:
                    raise ValueError(f"{len(texts)} texts for {after - first} pages")
                rows = [(share.path, first + i, t, None) for i, t in enumerate(texts)]
            except Exception as e:  # noqa: BLE001 - becomes a row
                rows = [(share.path, first, None, f"{type(e).__name__}: {e}")]
            for r in rows:
                whole = dict(zip(("path", "page", "text", "error"), r, strict=True))
                yield tuple(whole[c] for c in self.columns)

    class Pushed(Reader):
        def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
            for f in filters:
                if isinstance(f, EqualTo) and f.attribute == ("path",):
                    self.only = f.value
                yield f  # Spark checks again

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name_

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: StructType) -> DataSourceReader:
            return (Pushed if pushdown else Reader)(self.options, schema)

    return Pages

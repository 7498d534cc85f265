"""Search engines as data sources: ``spark.read.format("searchresults")`` reads saved result pages in any known format.

Another engine is added by an entry in ``sources.results`` (formats) or by subclassing ``SearchResults``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from setweave.sources.results import JSON_FORMATS


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class SearchResults(DataSource):
    """Options: ``path`` (a folder of saved pages, or its URI on a file system that all machines reach), ``kind`` (a JSON
    format), ``split`` (files to a task)."""

    @classmethod
    def name(cls) -> str:
        return "searchresults"

    def schema(self) -> str:
        return "file string, rank int, url string, title string, summary string, cache_url string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    @staticmethod
    def parse(kind: str, page: str) -> Iterator[tuple]:
        """(rank, url, title, summary, cache_url) of a saved page; none of a broken one."""
        path, url, title, summary, cache = JSON_FORMATS[kind]
        try:
            rows = json.loads(page)
            for step in path.split("."):
                rows = rows[step]
        except (ValueError, KeyError, TypeError):
            return
        rank = 0
        for row in rows:
            if isinstance(row, dict) and row.get(url) and row.get(title) is not None:
                rank += 1
                yield rank, row[url], re.sub("<[^<>]+>", "", row[title]), row.get(summary), row.get(cache)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind, self.split = options["path"], options.get("kind", "items"), int(options.get("split", 100))

    def partitions(self) -> list[_Files]:
        system, root = _system(self.path)
        paths = sorted(e.path for e in system.get_file_info(fs.FileSelector(root)) if e.is_file)
        return [_Files(paths[i : i + self.split]) for i in range(0, len(paths), self.split)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, _ = _system(self.path)
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                for row in SearchResults.parse(self.kind, f.read().decode("utf-8", "replace")):
                    yield (path.rpartition("/")[2], *row)

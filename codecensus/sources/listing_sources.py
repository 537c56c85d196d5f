"""Listings as Python data sources.

``listing_pages`` reads landed reply pages (Parquet files of repo, page and
the reply's JSON), a partition for each row group; ``landed_tree`` lists a
directory tree of repositories, a partition for each directory below a
repository. ``register`` makes them known to a session.

With the option ``pushdown`` the pages take Spark's filters on ``repo`` and
``page`` before anything is read. Spark keeps the filters of a Python source
with the loaded table, not with the scan, so such a frame is for one set of
filters and one use: load again for another. The tree, whose listing is read
several times to number its files, takes the option ``repos`` (a JSON list)
instead.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
                                    InputPartition, LessThan, LessThanOrEqual)

RANGES = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt,
          LessThanOrEqual: operator.le}
CHECKSUM = re.compile(r"\..*\.crc")
BATCH = 10_000


class Pushed:
    """The filters on known columns, as tests of values and of ranges."""

    def __init__(self, columns: tuple[str, ...]):
        self.columns, self.kept = columns, []

    def take(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps what can be tested here and returns the rest to Spark."""
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if name in self.columns and type(f) in RANGES:
                self.kept.append((name, RANGES[type(f)], f.value))
            elif name in self.columns and isinstance(f, In):
                self.kept.append((name, lambda value, values: value in values, tuple(f.value)))
            else:
                yield f

    def holds(self, **values) -> bool:
        return all(values[n] is not None and test(values[n], value) for n, test, value in self.kept if n in values)

    def may_hold(self, name: str, low, high) -> bool:
        """Whether a value between ``low`` and ``high`` can pass."""
        for n, test, value in self.kept:
            if n != name:
                continue
            if test in (operator.gt, operator.ge):
                ok = test(high, value)
            elif test in (operator.lt, operator.le):
                ok = test(low, value)
            elif test is operator.eq:
                ok = low <= value <= high
            else:
                ok = any(low <= v <= high for v in value if v is not None)
            if not ok:
                return False
        return True


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class RowGroup(InputPartition):
    path: str
    number: int


class PagesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.pushed = path, Pushed(("repo", "page"))

    def partitions(self) -> list[InputPartition]:
        """Row groups whose statistics let the filters pass."""
        store, root = _filesystem(self.path)
        found: list[InputPartition] = []
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            if not info.path.endswith(".parquet"):
                continue
            meta = pq.read_metadata(store.open_input_file(info.path))
            for number in range(meta.num_row_groups):
                group = meta.row_group(number)
                stats = {group.column(i).path_in_schema: group.column(i).statistics for i in range(group.num_columns)}
                if all(s is None or not s.has_min_max or self.pushed.may_hold(n, s.min, s.max)
                       for n, s in stats.items() if n in self.pushed.columns):
                    found.append(RowGroup(info.path, number))
        return found

    def read(self, partition: RowGroup | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no row group passes
            return
        store, _ = _filesystem(self.path)
        file = pq.ParquetFile(store.open_input_file(partition.path))
        for batch in file.iter_batches(batch_size=256, row_groups=[partition.number], columns=["repo", "page", "json"]):
            rows = [row for page in batch.to_pylist() if self.pushed.holds(repo=page["repo"], page=page["page"]) for row in _items(page)]
            for i in range(0, len(rows), BATCH):
                yield pa.RecordBatch.from_pylist(rows[i:i + BATCH], schema=ListingPages.ARROW)


class PushingPagesReader(PagesReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        yield from self.pushed.take(filters)


def _items(page: dict) -> Iterator[dict]:
    try:
        items = json.loads(page["json"] or "null")
    except json.JSONDecodeError:
        return
    items = items.get("value") if isinstance(items, dict) else None
    for pos, item in enumerate(items if isinstance(items, list) else []):
        if isinstance(item, dict):
            folder = item.get("isFolder")
            yield {"repo": page["repo"], "page": page["page"], "pos": pos, "path": (item.get("path") or "").lstrip("/"),
                   "size": item.get("size") or 0, "is_folder": True if folder is None else folder}


class ListingPages(DataSource):
    """Items of landed listing replies; a malformed reply has none, an item
    without ``isFolder`` is a folder."""

    ARROW = pa.schema([("repo", pa.string()), ("page", pa.int64()), ("pos", pa.int32()), ("path", pa.string()), ("size", pa.int64()),
                       ("is_folder", pa.bool_())])

    @classmethod
    def name(cls) -> str:
        return "listing_pages"

    def schema(self) -> str:
        return "repo string, page bigint, pos int, path string, size bigint, is_folder boolean"

    def reader(self, schema) -> DataSourceReader:
        pushes = self.options.get("pushdown", "false").lower() == "true"
        return (PushingPagesReader if pushes else PagesReader)(self.options["path"])


@dataclass
class Directory(InputPartition):
    repo: str
    path: str
    whole: bool  # with everything below it


class TreeReader(DataSourceReader):
    def __init__(self, path: str, repos: list[str] | None):
        self.path, self.repos = path, repos

    def partitions(self) -> list[InputPartition]:
        store, root = _filesystem(self.path)
        found: list[InputPartition] = []
        for top in store.get_file_info(fs.FileSelector(root)):
            if top.type != fs.FileType.Directory or self.repos is not None and top.base_name not in self.repos:
                continue
            found.append(Directory(top.base_name, top.path, False))
            found += [Directory(top.base_name, d.path, True) for d in store.get_file_info(fs.FileSelector(top.path))
                      if d.type == fs.FileType.Directory]
        return found

    def read(self, partition: Directory | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no directory
            return
        store, root = _filesystem(self.path)
        skip = len(root.rstrip("/")) + len(partition.repo) + 2
        rows = [{"repo": partition.repo, "path": f.path[skip:], "name": f.base_name, "type": "file", "size": f.size}
                for f in store.get_file_info(fs.FileSelector(partition.path, recursive=partition.whole))
                if f.type == fs.FileType.File and not CHECKSUM.fullmatch(f.base_name)]
        for i in range(0, len(rows), BATCH):
            yield pa.RecordBatch.from_pylist(rows[i:i + BATCH], schema=LandedTree.ARROW)


class LandedTree(DataSource):
    """Files of the repositories that lie below a folder, one a directory.
    Checksum files of a local store are not listed."""

    ARROW = pa.schema([("repo", pa.string()), ("path", pa.string()), ("name", pa.string()), ("type", pa.string()), ("size", pa.int64())])

    @classmethod
    def name(cls) -> str:
        return "landed_tree"

    def schema(self) -> str:
        return "repo string, path string, name string, type string, size bigint"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options["path"], json.loads(self.options.get("repos", "null")))


def register(spark: SparkSession) -> None:
    """Make both sources known and let Spark push filters down to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ListingPages, LandedTree):
        spark.dataSource.register(source)

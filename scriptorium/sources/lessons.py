"""Lessons as a data source: each folder below a root is a lesson, its files are rows, and new folders arrive as a stream.

    spark.dataSource.register(LessonFolders)
    spark.read.format("lessons").load(root)
    spark.readStream.format("lessons").load(root)

Folders are dealt to partitions, and files are opened by the tasks that read them; only names are listed beforehand. A stream's
offset is a moment in the time of folders' last change and the names at that moment, so that it stays small and
a restart reads the folders that came since. A folder is read once: what is put into it later does not change its rows,
as a lesson that is done is not done again. Files that a scan skips, and kinds that none knows, give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as store
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from scriptorium.operators.classify import KIND
from scriptorium.sources.files import SKIP

SCHEMA = "lesson string, name string, kind string, size bigint, content binary"
#: Folders of a partition.
TOGETHER = 16
_KIND = {ext: kind for kind, names in KIND.items() for ext in names}


@dataclass
class Folders(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


def opened(root: str) -> tuple[store.FileSystem, str]:
    return store.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (store.LocalFileSystem(), root)


def folders(root: str) -> list[tuple[int, str]]:
    """Last change (nanoseconds) and path of the folders below a root."""
    where, path = opened(root)
    found = where.get_file_info(store.FileSelector(path.rstrip("/")))
    return sorted((f.mtime_ns or 0, f.path) for f in found if f.type == store.FileType.Directory and not f.base_name.startswith((".", "__")))


def partitions(paths: list[str]) -> list[Folders]:
    return [Folders(paths[k : k + TOGETHER]) for k in range(0, len(paths), TOGETHER)]


def rows(root: str, part: Folders) -> Iterator[pa.RecordBatch]:
    """The files of folders, by name without regard to case, one at a time."""
    where, _ = opened(root)
    for path in part.paths:
        files = [f for f in where.get_file_info(store.FileSelector(path)) if f.type == store.FileType.File]
        for f in sorted(files, key=lambda f: (f.base_name.lower(), f.base_name)):
            kind = _KIND.get(f.extension.lower())
            if kind is None or f.base_name.startswith((".", "__")) or f.base_name.lower() in SKIP:
                continue
            with where.open_input_stream(f.path) as stream:
                content = stream.read()
            columns = [[path.rstrip("/").rpartition("/")[2]], [f.base_name], [kind], [len(content)], [content]]
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lesson", "name", "kind", "size", "content"])


class LessonFolders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lessons"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LessonReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LessonStream(self.options["path"])


class LessonReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Folders]:
        return partitions([path for _, path in folders(self.root)])

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        return rows(self.root, partition)


class LessonStream(DataSourceStreamReader):
    """Offsets: `upto`, the last change that has been read, and `names`, the folders of that very moment, as JSON."""

    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {"upto": "-1", "names": "[]"}

    def latestOffset(self) -> dict:
        found = folders(self.root)
        if not found:
            return self.initialOffset()
        last = found[-1][0]
        return {"upto": str(last), "names": json.dumps([path for t, path in found if t == last])}

    def partitions(self, start: dict, end: dict) -> list[Folders]:
        low, high, seen, known = int(start["upto"]), int(end["upto"]), set(json.loads(start["names"])), set(json.loads(end["names"]))
        new = lambda t, path: (t > low or t == low and path not in seen) and (t < high or t == high and path in known)
        return partitions([path for t, path in folders(self.root) if new(t, path)])

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        return rows(self.root, partition)

    def commit(self, end: dict) -> None:
        pass

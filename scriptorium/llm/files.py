"""Files that executors write and read in the shared store, by URI (file, hdfs, s3, gs, abfs)."""

from __future__ import annotations

import io

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Committed:
    """A file that appears under its name only when it is whole; a task that runs twice replaces it by equal bytes."""

    def __init__(self, uri: str, attempt: str):
        self.fs, self.path = opened(uri)
        self.part = f"{self.path}.{attempt}.part"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.part, self.path)
        else:
            self.fs.delete_file(self.part)


def read_whole(uri: str) -> bytes:
    f, path = opened(uri)
    with f.open_input_stream(path, compression=None) as s:
        return s.read()


def streamed(uri: str, block: int = 1 << 20) -> io.BufferedReader:
    """A file as a buffered stream."""
    store, path = opened(uri)
    return io.BufferedReader(store.open_input_stream(path, compression=None), block)


def attempt_name() -> str:
    from pyspark import TaskContext

    return str(TaskContext.get().taskAttemptId())

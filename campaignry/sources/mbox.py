"""Mbox files as a Spark data source: `spark.read.format("mbox").load(path)`, planned as byte ranges of each file.

A message belongs to the range in which its separator begins, so a large file is read by as many tasks as it has ranges,
each from its first separator to the first one beyond its end, block by block. Paths are whatever pyarrow's file systems
take: local and mounted folders, and the stores that it knows. Ranges are planned from sizes alone; nothing is read before.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RAW = "path string, block long, at long, separator string, raw binary, changed long"
SEPARATOR = b"\nFrom "
READ = 1 << 20


def opened(uri: str):
    """(file system, path there) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def messages(source, start: int, end: int) -> Iterator[tuple[bytes, bytes]]:
    """(separator line, message) of those whose separator begins in [start, end) of an open file."""
    at = max(0, start - 1)  # the line feed before a separator at start
    source.seek(at)
    held, done = (b"\n" if start == 0 else b""), False  # a file begins as if after a line feed
    base = at - len(held)  # position of held's first byte
    inside = None  # where the present message begins in held

    def more() -> bool:
        nonlocal held, done
        data = source.read(READ)
        held += data
        done = not data
        return not done

    while True:
        look = 0 if inside is None else inside + 1
        found = held.find(SEPARATOR, look)
        while found < 0 and not done:
            look = max(look, len(held) - len(SEPARATOR) + 1)
            if more():
                found = held.find(SEPARATOR, look)
        if inside is not None:
            body = held[inside + len(SEPARATOR) : found if found >= 0 else len(held)]
            line, _, rest = body.partition(b"\n")
            yield line, rest
        if found < 0 or base + found + 1 >= end:
            return
        held, base, inside = held[found:], base + found, 0


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, changed: int):
        self.path, self.start, self.end, self.changed = path, start, end, changed


class MboxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("partitionbytes", options.get("partitionBytes", 64 << 20)))

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, path = opened(self.path)
        info = system.get_file_info(path)
        files = system.get_file_info(fs.FileSelector(path, recursive=True)) if info.type == fs.FileType.Directory else [info]
        files = sorted((f for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        return [Range(f.path, at, min(f.size, at + self.size), f.mtime_ns // 1000 if f.mtime_ns else 0) for f in files for at in range(0, f.size, self.size)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        system, _ = opened(self.path)
        with system.open_input_file(partition.path) as source:
            for at, (line, raw) in enumerate(messages(source, partition.start, partition.end)):
                yield partition.path, partition.start, at, line.decode("ascii", "replace"), raw, partition.changed


class MboxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mbox"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> MboxReader:
        return MboxReader(self.options)

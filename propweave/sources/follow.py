"""Text files that grow: every whole line is read once, from where the last read ended.

Spark's file stream takes a file for done once it has seen it. A training log grows, so this
streaming source keeps an offset in bytes for each file. The offsets of a batch end behind the
last line break that stands then: a half-written line waits for its end. They go into the
query's checkpoint, so a query that is started again goes on where it stopped. New bytes are
cut into blocks that tasks read side by side; a line belongs to the block it begins in.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from propweave.session import importable

LINES = "file string, at bigint, line string"
#: Bytes of a block, bytes read at once, bytes looked at for the last line break.
BLOCK, READ, TAIL = 64 << 20, 4 << 20, 64 << 10


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


class Range(InputPartition):
    """Lines that begin in [first, last) of a file, which is known up to ``end``; ``whole``: a line begins at ``first``."""

    def __init__(self, file: str, first: int, last: int, end: int, whole: bool):
        self.file, self.first, self.last, self.end, self.whole = file, first, last, end, whole


class Files:
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.pattern = options.get("pattern", "*")
        self.header = options.get("header", "false").lower() == "true"
        self.block = int(options.get("blockbytes", options.get("blockBytes", BLOCK)))

    def ends(self) -> dict[str, int]:
        """Of each file the place behind its last whole line."""
        system, root = _system(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.File:
            found = [info]
        elif info.type == fs.FileType.Directory:
            found = [i for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File
                     and fnmatch(i.base_name, self.pattern) and not i.base_name.startswith((".", "_"))]
        else:
            found = []
        return {posixpath.relpath(i.path, root) if i.path != root else "": _last_line_end(system, i.path, i.size) for i in found}

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        out = []
        for file, stop in sorted(end.items()):
            first = start.get(file, 0)
            if stop < first:
                raise ValueError(f"{self.path}/{file} has become shorter: read up to byte {first}, whole lines up to {stop}")
            for a in range(first, stop, self.block):
                out.append(Range(file, a, min(a + self.block, stop), stop, a == first))
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, root = _system(self.path)
        path = posixpath.join(root, part.file) if part.file else root
        with system.open_input_file(path) as f:
            at = part.first
            if not part.whole:  # the line that reaches into the block belongs to the one before
                at = _next_line(f, part.first - 1, part.end)
            rest = b""
            position = at
            while at < part.last:
                if position < part.end:
                    got = f.read_at(min(READ, part.end - position), position)
                    position += len(got)
                    rest += got
                lines = rest.split(b"\n")
                rest = lines.pop()
                starts, texts = [], []
                for line in lines:
                    if at >= part.last:
                        break
                    text = line.removesuffix(b"\r").decode("utf-8", "replace")
                    if text and not (self.header and at == 0):
                        starts.append(at)
                        texts.append(text)
                    at += len(line) + 1
                if texts:
                    yield pa.RecordBatch.from_arrays([pa.array([part.file] * len(texts), pa.string()), pa.array(starts, pa.int64()),
                                                      pa.array(texts, pa.string())], names=["file", "at", "line"])


def _last_line_end(system: fs.FileSystem, path: str, size: int) -> int:
    with system.open_input_file(path) as f:
        while size > 0:
            first = max(size - TAIL, 0)
            found = f.read_at(size - first, first).rfind(b"\n")
            if found >= 0:
                return first + found + 1
            size = first
    return 0


def _next_line(f, at: int, end: int) -> int:
    """Where the line after the one at byte ``at`` begins."""
    while at < end:
        got = f.read_at(min(TAIL, end - at), at)
        found = got.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(got)
    return end


class _Stream(DataSourceStreamReader):
    def __init__(self, files: Files):
        self.files = files

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.files.ends()

    def partitions(self, start: dict, end: dict):
        return self.files.ranges(start, end)

    def read(self, partition: Range):
        return self.files.read(partition)

    def commit(self, end: dict) -> None:
        pass


class _Table(DataSourceReader):
    def __init__(self, files: Files):
        self.files = files

    def partitions(self):
        return self.files.ranges({}, self.files.ends()) or [Range("", 0, 0, 0, True)]

    def read(self, partition: Range):
        return self.files.read(partition) if partition.end else iter(())


class GrowingText(DataSource):
    """``growing_text``: (file, at, line) of a file, or of the files of a folder whose names match ``pattern``.

    Options: ``path``; ``pattern`` (default all); ``header`` (the first line of each file is
    none); ``blockBytes``. Empty lines are no rows; bytes that are no UTF-8 become U+FFFD; a
    file that has become shorter is an error; a file that is gone has no more lines.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_text"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(Files(self.options))

    def reader(self, schema) -> DataSourceReader:
        return _Table(Files(self.options))


def lines(spark: SparkSession, path: str, streaming: bool = True, **options) -> DataFrame:
    """(file, at, line): the lines of growing files as a stream, or as they stand now."""
    importable(spark)
    spark.dataSource.register(GrowingText)
    reader = spark.readStream if streaming else spark.read
    return reader.format("growing_text").option("path", path).options(**{k: str(v) for k, v in options.items()}).load()


def log_rows(lines_: DataFrame) -> DataFrame:
    """(type, batch, loss, lr) of tab-separated log lines; a line without a batch and a loss is none."""
    part = F.split("line", "\t")
    cell = lambda i, kind: F.get(part, F.lit(i)).try_cast(kind)
    return lines_.select(F.get(part, F.lit(0)).alias("type"), cell(1, "bigint").alias("batch"), cell(2, "double").alias("loss"),
                         cell(3, "double").alias("lr")).filter(F.col("batch").isNotNull() & F.col("loss").isNotNull())


def append_log(log: DataFrame, folder: str, writers: int = 4) -> str:
    """Adds rows (type, batch, loss, lr) to the growing files of a folder, one for each writer, in the order of batches.

    A type belongs to one writer, so its file has one author. A task that is run again starts
    at the same byte and writes the same lines. The folder must lie on a file system that can
    append and that all executors share.
    """
    importable(log.sparkSession)
    system, root = _system(folder)
    if not isinstance(system, fs.LocalFileSystem):
        raise ValueError(f"{folder}: files can only grow on a mounted file system")
    system.create_dir(root, recursive=True)
    sizes = {i.base_name: i.size for i in system.get_file_info(fs.FileSelector(root))}

    def write(rows) -> None:
        open_files = {}
        try:
            for r in rows:
                name = f"log-{r['writer']}.tsv"
                if name not in open_files:
                    f = open(posixpath.join(root, name), "ab")
                    f.truncate(sizes.get(name, 0))
                    if not sizes.get(name):
                        f.write(b"type\tbatch\tloss\tlr\n")
                    open_files[name] = f
                open_files[name].write(f"{r['type']}\t{r['batch']}\t{r['loss']!r}\t{r['lr']!r}\n".encode())
        finally:
            for f in open_files.values():
                f.close()

    own = log.select("type", "batch", "loss", "lr", F.pmod(F.xxhash64("type"), F.lit(writers)).cast("int").alias("writer"))
    own.repartition(writers, "writer").sortWithinPartitions("writer", "batch").foreachPartition(write)
    return folder

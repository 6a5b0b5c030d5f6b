"""Tensor shards: training examples as numpy files that other programs read.

A shard holds the examples of one split: a block of fixed width, a ragged column as values
with offsets, and the row's id, each an array of a ``.npz`` file. Tasks write below a
temporary folder and report their files; the commit moves the reported ones into place and
lists them with their rows, so a task that failed or ran twice leaves no shard, and a reader
sees either the former table or the new one. Empty partitions write nothing.
"""

from __future__ import annotations

import io
import json
import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from propweave.session import importable
from propweave.sources.follow import _system

SHARD = "split string, id bigint, fixed array<bigint>, ragged array<bigint>"
LIST, ROWS = "_shards.json", 65_536


class Written(WriterCommitMessage):
    """Files of a task: (temporary name, final name, split, rows)."""

    def __init__(self, files: list[tuple[str, str, str, int]]):
        self.files = files


def pack(ids: np.ndarray, fixed: list[list[int]], ragged: list[list[int]]) -> bytes:
    widths = {len(x) for x in fixed}
    if len(widths) > 1:
        raise ValueError(f"the fixed column has rows of different widths: {sorted(widths)}")
    out = io.BytesIO()
    np.savez(out, id=ids, fixed=np.array(fixed, np.int32).reshape(len(fixed), -1), offsets=np.cumsum([0, *map(len, ragged)]),
             values=np.array([v for x in ragged for v in x], np.int32))
    return out.getvalue()


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.rows = int(options.get("rowspershard", options.get("rowsPerShard", ROWS)))
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _system(self.path)
        context = TaskContext.get()
        task, files = f"{context.partitionId():05d}", []
        held: dict[str, list[pa.Table]] = {}

        def flush(split: str) -> None:
            t = pa.concat_tables(held.pop(split))
            data = pack(t["id"].to_numpy(), t["fixed"].to_pylist(), t["ragged"].to_pylist())
            name = f"split={split}/part-{task}-{len(files):03d}-{self.job[-8:]}.npz"
            temporary = f"{self.job}/{task}-{context.attemptNumber()}-{len(files)}.npz"
            system.create_dir(posixpath.join(root, self.job), recursive=True)
            with system.open_output_stream(posixpath.join(root, temporary)) as f:
                f.write(data)
            files.append((temporary, name, split, t.num_rows))

        for batch in iterator:
            table = pa.Table.from_batches([batch])
            if table["split"].null_count or table["fixed"].null_count or table["ragged"].null_count or table["id"].null_count:
                raise ValueError("a shard's columns hold no nulls")
            for split in table["split"].unique().to_pylist():
                own = table.filter(pa.compute.equal(table["split"], split))
                for i in range(0, own.num_rows, self.rows):
                    held.setdefault(split, []).append(own.slice(i, self.rows))
                    if sum(t.num_rows for t in held[split]) >= self.rows:
                        flush(split)
        for split in list(held):
            flush(split)
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = _system(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        before = [] if self.overwrite else _listed(system, root)
        for temporary, name, *_ in files:
            system.create_dir(posixpath.dirname(posixpath.join(root, name)), recursive=True)
            system.move(posixpath.join(root, temporary), posixpath.join(root, name))
        now = before + [{"file": name, "split": split, "rows": rows} for _, name, split, rows in files]
        system.create_dir(root, recursive=True)
        part = posixpath.join(root, f"{self.job}.json")
        with system.open_output_stream(part) as f:
            f.write(json.dumps(now).encode())
        former = {x["file"] for x in _listed(system, root)} - {x["file"] for x in now}
        system.move(part, posixpath.join(root, LIST))
        for name in former:
            system.delete_file(posixpath.join(root, name))
        self._clear(system, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_system(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        folder = posixpath.join(root, self.job)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


def _listed(system: fs.FileSystem, root: str) -> list[dict]:
    path = posixpath.join(root, LIST)
    if system.get_file_info(path).type != fs.FileType.File:
        return []
    with system.open_input_file(path) as f:
        return json.loads(f.read())


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split = options["path"], options.get("split")

    def partitions(self) -> list[InputPartition]:
        found = [x for x in _listed(*_system(self.path)) if self.split is None or x["split"] == self.split]
        return [InputPartition((x["file"], x["split"])) for x in found] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        system, root = _system(self.path)
        file, split = partition.value
        with system.open_input_file(posixpath.join(root, file)) as f:
            shard = np.load(io.BytesIO(f.read()))
        ids, fixed, offsets, values = (shard[k] for k in ("id", "fixed", "offsets", "values"))
        width = fixed.shape[1]
        for i in range(0, len(ids), 4096):
            own, at = ids[i : i + 4096], offsets[i : i + 4097]
            yield pa.RecordBatch.from_arrays([
                pa.array([split] * len(own), pa.string()), pa.array(own, pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * width, pa.int32()), pa.array(fixed[i : i + 4096].ravel(), pa.int64())),
                pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(values[at[0] : at[-1]], pa.int64()))],
                names=["split", "id", "fixed", "ragged"])


class TokenShards(DataSource):
    """``token_shards``: (split, id, fixed, ragged). Options: ``path``, ``rowsPerShard``; ``split`` reads one split only."""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return SHARD

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def write_tensors(rows: DataFrame, path: str, per_shard: int = ROWS, mode: str = "overwrite") -> str:
    """Rows (split, id, fixed, ragged) as shards; ``append`` adds to those that are there."""
    importable(rows.sparkSession)
    rows.sparkSession.dataSource.register(TokenShards)
    rows.select("split", "id", "fixed", "ragged").write.format("token_shards").mode(mode).option("path", path).option(
        "rowsPerShard", str(per_shard)).save()
    return path


def read_tensors(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    importable(spark)
    spark.dataSource.register(TokenShards)
    reader = spark.read.format("token_shards").option("path", path)
    return (reader.option("split", split) if split else reader).load()

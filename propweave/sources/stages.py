"""Stored stages: a job that runs again does only what has changed.

A stage has a name, the inputs and stages it needs, modules of code and parameters. Their
fingerprint, which holds those of the stages before it, names the stage's output. When the
output is complete, a record with fingerprint, paths, rows and schema is put into the folder.
A later run reads every stage whose record has the fingerprint it would have now, and works out
the others: a changed parameter, input file or module reaches what depends on it and nothing
else. A run that ends in the middle leaves the records of what it finished, so the next one
goes on there. The folder must be shared by all executors; records of former fingerprints are
overwritten, their outputs are removed by ``tidy``.
"""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType


def digest(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


class Files:
    """Small files and listings on whatever file system a path belongs to."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def read(self, path: str) -> str | None:
        system, p = self._at(path)
        if not system.exists(p):
            return None
        stream = system.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Whole or not at all: written beside and renamed."""
        system, p = self._at(path)
        _, part = self._at(f"{path}.part")
        stream = system.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        system.delete(p, False)
        if not system.rename(part, p):
            raise RuntimeError(f"{path} cannot be written")

    def listing(self, path: str) -> list[list]:
        """(path, bytes, time of change) of the files of a table, in order."""
        system, root = self._at(path)
        if not system.exists(root):
            return []
        out, found = [], system.listFiles(root, True)
        while found.hasNext():
            f = found.next()
            if not f.getPath().getName().startswith(("_", ".")):
                out.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
        return sorted(out)

    def folders(self, path: str) -> list[str]:
        system, root = self._at(path)
        return [s.getPath().toString() for s in system.listStatus(root) if s.isDirectory()] if system.exists(root) else []

    def remove(self, path: str) -> None:
        system, p = self._at(path)
        system.delete(p, True)


class Stages:
    """The stages of one job below one folder. ``done`` tells of each whether it was ``kept`` or ``ran``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark)
        self.marks: dict[str, str] = {}
        self.tables: dict[str, DataFrame | dict[str, DataFrame]] = {}
        self.records: dict[str, dict] = {}
        self.done: dict[str, str] = {}

    def source(self, name: str, path: str) -> None:
        """An input table, known by its files, their sizes and times of change."""
        self.marks[name] = digest(["source", self.files.listing(path)])
        if name not in self.tables:
            self.tables[name] = self.spark.read.parquet(path)

    def stage(self, name: str, fn: Callable[..., DataFrame | dict[str, DataFrame]], needs: list[str], code: tuple[ModuleType, ...] = (), **params):
        """The stage's table (or tables by name), read back. ``fn`` takes the tables it needs, then the parameters.

        Its own source text and that of the modules in ``code`` are part of the fingerprint.
        """
        missing = [n for n in needs if n not in self.marks]
        if missing:
            raise KeyError(f"stage {name} needs {missing}, which no stage or source before it gives")
        if name in self.marks:
            raise KeyError(f"two stages are called {name}")
        mark = digest({"name": name, "needs": [[n, self.marks[n]] for n in needs], "params": params,
                       "code": [inspect.getsource(fn), *(inspect.getsource(m) for m in code)]})
        self.marks[name] = mark
        record = json.loads(self.files.read(self._record(name)) or "{}")
        if record.get("fingerprint") == mark:
            self.done[name] = "kept"
        else:
            self.done[name] = "ran"
            record = self._run(name, mark, fn(*(self.tables[n] for n in needs), **params))
        self.records[name] = record
        read = {k: self.spark.read.schema(StructType.fromJson(o["schema"])).parquet(o["path"]) for k, o in record["outputs"].items()}
        self.tables[name] = read[""] if list(read) == [""] else read
        return self.tables[name]

    def _record(self, name: str) -> str:
        return f"{self.folder}/records/{name}.json"

    def _run(self, name: str, mark: str, made: DataFrame | dict[str, DataFrame]) -> dict:
        outputs = {}
        for key, df in (made if isinstance(made, dict) else {"": made}).items():
            path, seen = f"{self.folder}/stages/{name}-{mark[:16]}/{key or 'table'}", Observation()
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
            outputs[key] = {"path": path, "rows": seen.get["rows"], "schema": df.schema.jsonValue()}
        record = {"stage": name, "fingerprint": mark, "outputs": outputs}
        self.files.write(self._record(name), json.dumps(record, indent=1))
        return record

    def manifest(self) -> DataFrame:
        """(stage, output, rows, state): one row per stored table."""
        rows = [(n, k, o["rows"], self.done[n]) for n, r in self.records.items() for k, o in r["outputs"].items()]
        return self.spark.createDataFrame(rows, "stage string, output string, rows bigint, state string")

    def tidy(self) -> int:
        """Removes outputs that no record names any more, such as those of a run that was killed; how many."""
        named = {f"{n}-{m[:16]}" for n, m in self.marks.items() if n in self.records}
        old = [f for f in self.files.folders(f"{self.folder}/stages") if f.rsplit("/", 1)[1] not in named]
        for f in old:
            self.files.remove(f)
        return len(old)

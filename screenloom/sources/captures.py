"""Folders of captures as a data source of Spark: ``spark.read.format("captures").load(root)``, and as a stream.

A capture is a file ``captures/{baseline}/runs/{run}/{plugin}/{raw|transformed}/{file}`` at or below the root; other files are
left out. Files are read in partitions of about ``partitionBytes`` (32 MB), each file whole. A stream takes files in the order
of their times, as many as have landed by then; files are to be moved into place when they are complete.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "baseline_id string, run_id string, plugin string, stage string, file string, bytes long, content string"
FIELDS = ["baseline_id", "run_id", "plugin", "stage", "file", "bytes", "content"]
WHERE = re.compile(r"captures/([^/]+)/runs/([^/]+)/([^/]+)/(raw|transformed)/([^/]+)$")
PARTITION_BYTES = 32_000_000

#: A file: its time in nanoseconds, its path and its size.
File = tuple[int, str, int]


class Files(InputPartition):
    """Files that one task reads."""

    def __init__(self, paths: list[str]):
        self.paths = paths


class Folder:
    """The files below a root, in any file system that Arrow opens by its address."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.bytes = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))

    def open(self) -> tuple[pyarrow.fs.FileSystem, str]:
        if self.root.startswith("/"):
            return pyarrow.fs.LocalFileSystem(), self.root
        # Spark writes local addresses with one slash
        return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", self.root))

    def found(self) -> list[File]:
        system, root = self.open()
        infos = system.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True))
        return sorted((i.mtime_ns or 0, i.path, i.size) for i in infos if i.is_file and WHERE.search(i.path) and not i.base_name.startswith((".", "_")))

    def dealt(self, files: list[File]) -> list[Files]:
        """Partitions of about ``bytes``, in the order of paths so that the files of a run stay together."""
        out, size = [], 0
        for _, path, n in sorted(files, key=lambda f: f[1]):
            if not out or size + n > self.bytes:
                out.append([])
                size = 0
            out[-1].append(path)
            size += n
        return [Files(paths) for paths in out]

    def rows(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        system, _ = self.open()
        for path in partition.paths if partition else []:  # without a file there is one empty partition
            with system.open_input_stream(path) as stream:
                content = stream.read()
            values = [*WHERE.search(path).groups(), len(content), content.decode("utf-8", "replace")]
            yield pa.RecordBatch.from_pydict({name: [v] for name, v in zip(FIELDS, values, strict=True)})


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = Folder(options)

    def partitions(self) -> list[Files]:
        return self.folder.dealt(self.folder.found())

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.folder.rows(partition)


class CaptureStream(DataSourceStreamReader):
    """An offset is the time and path of the last file taken."""

    def __init__(self, options: dict):
        self.folder = Folder(options)

    def initialOffset(self) -> dict:
        return {"at": 0, "path": ""}

    def latestOffset(self) -> dict:
        files = self.folder.found()
        return {"at": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        first, last = ((o["at"], o["path"]) for o in (start, end))
        return self.folder.dealt([f for f in self.folder.found() if first < f[:2] <= last])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.folder.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class CaptureSource(DataSource):
    """Captures of a folder, one row for each file."""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(dict(self.options))

    def streamReader(self, schema) -> CaptureStream:
        return CaptureStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format ``captures`` known to a session. Its code goes to the workers with it."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(CaptureSource)

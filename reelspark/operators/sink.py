"""A sink for packets whose files appear together or not at all (K8, K12 of the blueprint).

A source of Spark's Python Data Source API: each task writes one file of its rows
under a hidden name that no other attempt shares, and says which. When all tasks have
said so, the commit gives the files of the attempts that count their names and writes
a list of them; an abort, or whatever a failed attempt left, never gets one. A reader
takes the files that the list names.

    register(spark)
    packets.write.format("packets").mode("append").save(folder)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

HIDDEN = "_attempts"
LISTS = "_lists"


def _place(path: str):
    """(pyarrow file system, path) of a URI or a local path; absent schemes are local, as in tests."""
    return FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    """What one task's attempt wrote: its file under HIDDEN, and rows; no file without rows."""

    name: str | None
    rows: int


class PacketWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = _place(self.path)
        fs.create_dir(f"{folder}/{HIDDEN}/{self.run}", recursive=True)
        task = TaskContext.get()
        name = f"{task.partitionId() if task else 0:06d}-{uuid.uuid4().hex}.parquet"
        rows, writer = 0, None
        try:
            for b in batches:
                writer = writer or pq.ParquetWriter(f"{folder}/{HIDDEN}/{self.run}/{name}", b.schema, filesystem=fs)
                writer.write_batch(b)
                rows += b.num_rows
        finally:
            if writer:
                writer.close()
        return Written(name if writer else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = _place(self.path)
        kept = [m for m in messages if m and m.name]
        for m in kept:
            fs.move(f"{folder}/{HIDDEN}/{self.run}/{m.name}", f"{folder}/{m.name}")
        fs.create_dir(f"{folder}/{LISTS}", recursive=True)
        before = [] if not self.overwrite else _lists(self.path)
        # one list stands for the whole write: it is there or it isn't
        with fs.open_output_stream(f"{folder}/{LISTS}/.{self.run}") as f:
            f.write(json.dumps({"files": [m.name for m in kept], "rows": sum(m.rows for m in kept), "instead_of": before}).encode())
        fs.move(f"{folder}/{LISTS}/.{self.run}", f"{folder}/{LISTS}/{self.run}.json")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, folder = _place(self.path)
        if fs.get_file_info(f"{folder}/{HIDDEN}/{self.run}").type == FileType.Directory:
            fs.delete_dir(f"{folder}/{HIDDEN}/{self.run}")


class PacketSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packets"

    def schema(self) -> str:
        return "source_id long, frame_no long, packet binary"

    def writer(self, schema: StructType, overwrite: bool) -> PacketWriter:
        return PacketWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PacketSink)


def _lists(path: str) -> list[str]:
    """Names of the lists that count, of finished writes."""
    fs, folder = _place(path)
    found = [x for x in fs.get_file_info(FileSelector(f"{folder}/{LISTS}", allow_not_found=True)) if x.base_name.endswith(".json")]
    said = {x.base_name: json.loads(fs.open_input_stream(x.path).read()) for x in found}
    gone = {name for s in said.values() for name in s["instead_of"]}
    return sorted(set(said) - gone)


def read_packets_of(spark: SparkSession, path: str, schema: str | StructType = "source_id long, frame_no long, packet binary") -> DataFrame:
    """The rows of all finished writes to a folder, by their lists: a list for each write, a name for each of its tasks."""
    fs, folder = _place(path)
    files = [f"{path}/{f}" for name in _lists(path) for f in json.loads(fs.open_input_stream(f"{folder}/{LISTS}/{name}").read())["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)

"""A queue of text records as a partitioned stream source, and a stream sink that keeps each batch once.

The queue is a folder of files of lines that producers only add to. Folders are URIs of any store that
pyarrow opens; a client of a message broker takes the place of the file system.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes at the end of a file that are searched for its last whole line at a time.
TAIL = 1 << 16


def _store(folder: str):
    """The file system of a folder and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if urlparse(folder).scheme else (fs.LocalFileSystem(), folder)


@dataclass
class Range(InputPartition):
    """The lines of a file that begin in [first, last)."""

    path: str
    first: int
    last: int


class QueueReader(DataSourceStreamReader):
    """Offsets are the bytes of whole lines of each file, so a batch is a set of ranges, read by the executors alone."""

    def __init__(self, folder: str, size: int):
        self.folder, self.size = folder, size

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        store, folder = _store(self.folder)
        files = [f for f in store.get_file_info(fs.FileSelector(folder)) if f.is_file and f.base_name[0] not in "._"]
        return {f.base_name: end for f in sorted(files, key=lambda f: f.base_name) if (end := self._whole(store, f.path, f.size))}

    @staticmethod
    def _whole(store, path: str, size: int) -> int:
        """Bytes up to the last line end; a line still being written waits."""
        with store.open_input_file(path) as f:
            at = size
            while at > 0:
                low = max(0, at - TAIL)
                f.seek(low)
                found = f.read(at - low).rfind(b"\n")
                if found >= 0:
                    return low + found + 1
                at = low
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        folder = _store(self.folder)[1].rstrip("/")
        out = []
        for name, last in end.items():
            first = start.get(name, 0)
            out += [Range(f"{folder}/{name}", a, min(a + self.size, last)) for a in range(first, last, self.size)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        store, _ = _store(self.folder)
        with store.open_input_file(partition.path) as f:
            at = max(partition.first - 1, 0)
            f.seek(at)
            rest, skip = b"", partition.first > 0  # the line that goes on from before belongs to the range before
            while True:
                block = f.read(1 << 20)
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    if skip:
                        skip = False
                    elif at < partition.last:
                        yield (line.decode("utf-8", "replace"),)
                    else:
                        return
                    at += len(line) + 1
                if not block:
                    return

    def commit(self, end: dict) -> None:
        pass


class QueueSource(DataSource):
    """Lines of a folder of growing files as a stream of `text`. Options: path; bytes, the size of a partition."""

    @classmethod
    def name(cls) -> str:
        return "headwater_queue"

    def schema(self) -> str:
        return "text string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return QueueReader(self.options["path"], int(self.options.get("bytes", 64 << 20)))


def queue(spark: SparkSession, folder: str, partition_bytes: int = 64 << 20) -> DataFrame:
    """The queue as a stream. Each record is read once and none is lost: after a failure the same ranges are read again."""
    spark.dataSource.register(QueueSource)
    return spark.readStream.format("headwater_queue").option("path", folder).option("bytes", partition_bytes).load()


@dataclass
class Written(WriterCommitMessage):
    """A file that a task has written, and its records."""

    name: str
    records: int


class LinesWriter(DataSourceStreamWriter):
    """Tasks write files of names of their own; a batch's manifest, written last, says which of them count."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator) -> Written:
        store, folder = _store(self.folder)
        store.create_dir(folder, recursive=True)
        name, n = f"part-{uuid.uuid4().hex}.jsonl", 0
        with store.open_output_stream(f"{folder}/{name}") as f:
            for row in iterator:
                f.write(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False).encode() + b"\n")
                n += 1
        return Written(name, n)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        store, folder = _store(self.folder)
        kept = [{"name": m.name, "records": m.records} for m in messages if m and m.records]
        with store.open_output_stream(f"{folder}/.manifest-{batchId}.tmp") as f:
            f.write(json.dumps({"batch": batchId, "files": kept}).encode())
        store.move(f"{folder}/.manifest-{batchId}.tmp", f"{folder}/_manifest-{batchId}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        store, folder = _store(self.folder)
        for m in messages:
            if m:
                store.delete_file(f"{folder}/{m.name}")


class LinesSink(DataSource):
    """Rows as JSON lines. Option: path."""

    @classmethod
    def name(cls) -> str:
        return "headwater_lines"

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return LinesWriter(self.options["path"])


def to_lines(stream: DataFrame, folder: str, checkpoint: str):
    """Writes a stream's rows so that committed() has each batch once, whatever tasks or batches run again."""
    stream.sparkSession.dataSource.register(LinesSink)
    return stream.writeStream.format("headwater_lines").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """The lines (value) of all committed batches."""
    from pyarrow import fs

    store, path = _store(folder)
    manifests = [f.path for f in store.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("_manifest-")]
    files = []
    for m in manifests:
        with store.open_input_stream(m) as f:
            files += [f"{folder.rstrip('/')}/{x['name']}" for x in json.loads(f.read())["files"]]
    return spark.read.text(files) if files else spark.createDataFrame([], "value string")

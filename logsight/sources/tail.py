"""Tailing of growing files by byte offsets, as a streaming data source (A2).

The offset of the stream holds the size of each file by its inode. What lies
between two offsets are the lines that end between them, so a line is read when
its end is there, once. A rotated file keeps its inode and is read on under its
new name, if the pattern has it; the file that takes the old name begins at 0. A
file that is shorter than before was truncated and begins at 0 too. Restarts go
on from the checkpoint. Blank lines, lines with NUL and lines that are too long
are left out. The folder must be seen by the driver and all executors.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "value string, source_id string, position long"
#: Bytes of a file that one task reads.
PART = 64 << 20
_LOOK = 1 << 16


class _Range(InputPartition):
    def __init__(self, path: str, inode: int, begin: int, end: int):
        self.path, self.inode, self.begin, self.end = path, inode, begin, end


def _whole_lines(path: str, low: int, high: int) -> int:
    """The end of the last whole line of the file between low and high; low if there is none."""
    with open(path, "rb") as f:
        at = high
        while at > low:
            begin = max(low, at - _LOOK)
            f.seek(begin)
            found = f.read(at - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            at = begin
    return low


class _TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.pattern = options["path"]
        self.max_line = int(options.get("maxlinebytes", 65_536))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": {}}

    def _files(self) -> dict[int, tuple[str, int]]:
        """inode: (path, size); the whole folder, so that rotated names are met."""
        out = {}
        for path in sorted(glob.glob(self.pattern)):
            stat = os.stat(path)
            if os.path.isfile(path):
                out[stat.st_ino] = (path, stat.st_size)
        return out

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": {str(inode): size for inode, (_, size) in self._files().items()}}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        now, out = self._files(), []
        for inode, size in end["files"].items():
            if int(inode) not in now:
                continue  # removed since
            path = now[int(inode)][0]
            before = start["files"].get(inode, 0)
            before = 0 if before > size else before  # truncated
            low, high = _whole_lines(path, 0, before), _whole_lines(path, before, size)
            high = max(high, low)
            for begin in range(low, high, PART):
                out.append(_Range(path, int(inode), begin, min(begin + PART, high)))
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        values, places = [], []
        with open(partition.path, "rb") as f:
            at = partition.begin
            if at:  # a line that began before belongs to the part before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < partition.end:
                line = f.readline()
                if not line.endswith(b"\n"):
                    break
                if line.strip() and len(line) <= self.max_line and b"\x00" not in line:
                    values.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                    places.append(at)
                at += len(line)
                if len(values) >= 10_000:
                    yield self._batch(values, places, partition.path)
                    values, places = [], []
        if values:
            yield self._batch(values, places, partition.path)

    @staticmethod
    def _batch(values: list[str], places: list[int], path: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values), pa.array([path] * len(values)), pa.array(places, pa.int64())], names=["value", "source_id", "position"])

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class TailSource(DataSource):
    """Options: path (a glob pattern, rotated names included), maxLineBytes."""

    @classmethod
    def name(cls) -> str:
        return "tailed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return _TailReader({k.lower(): v for k, v in self.options.items()})


def tail_lines(spark: SparkSession, pattern: str, max_line_bytes: int = 65_536) -> DataFrame:
    """New whole lines of the files of the pattern as a stream: value, source_id (path), position (byte where the line begins) (A2)."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tailed").option("path", pattern).option("maxLineBytes", max_line_bytes).load()

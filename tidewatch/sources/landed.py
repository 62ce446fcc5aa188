"""Payloads landed in logs, as a data source for batches and streams.

A log is a folder for each source that holds segments, files of one payload a line; a new segment has a
name above those before it, and only the last one grows. So a place in a log is a segment and a byte in it,
and the offset of a stream has one place for each source, however many segments there are. Names that
begin with _ or . aren't segments.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .records import raw_posts, split_records

COLUMNS = "value string, source string, segment string, start long"
#: Bytes of a segment that one task reads, and of the lines in one batch of rows.
BLOCK, CHUNK = 64 << 20, 1 << 20


@dataclass
class Block(InputPartition):
    """The lines of a segment that begin in [lo, hi); `begins` is a byte at which one is known to begin."""

    source: str
    segment: str
    begins: int
    lo: int
    hi: int


class _Log:
    """What is in a folder of any file system that Arrow knows; a path without a scheme is one that all machines have mounted."""

    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("a landed log needs a path")
        self.path, self.block = options["path"], int(options.get("blockBytes", BLOCK))
        if self.block < 1:
            raise ValueError("blockBytes must be at least 1")
        named = options.get("source")
        self.named = [s.strip() for s in named.split(",")] if named else None

    def files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def _listed(self, folder: str, kind: fs.FileType) -> list[fs.FileInfo]:
        files, _ = self.files()
        found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted((f for f in found if f.type == kind and f.base_name[0] not in "_."), key=lambda f: f.base_name)

    def segments(self) -> dict[str, list[tuple[str, int]]]:
        """source -> (name, bytes) of its segments, oldest first."""
        _, root = self.files()
        sources = self.named if self.named is not None else [f.base_name for f in self._listed(root, fs.FileType.Directory)]
        return {s: [(f.base_name, f.size) for f in self._listed(f"{root}/{s}", fs.FileType.File)] for s in sources}

    def whole_lines(self, source: str, segment: str, size: int, known: int = 0) -> int:
        """Where the last whole line of a segment ends; `known` is the end of one that is whole."""
        files, root = self.files()
        with files.open_input_file(f"{root}/{source}/{segment}") as f:
            hi = size
            while hi > known:
                lo = max(known, hi - CHUNK)
                f.seek(lo)
                at = f.read(hi - lo).rfind(b"\n")
                if at >= 0:
                    return lo + at + 1
                hi = lo
        return known

    def blocks(self, source: str, segment: str, lo: int, hi: int) -> list[Block]:
        return [Block(source, segment, lo, at, min(at + self.block, hi)) for at in range(lo, hi, self.block)]

    def lines(self, block: Block) -> Iterator[tuple[int, bytes]]:
        files, root = self.files()
        with io.BufferedReader(files.open_input_file(f"{root}/{block.source}/{block.segment}"), CHUNK) as f:
            at = block.lo
            if at > block.begins:  # a line begins here only if one ends at the byte before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            else:
                f.seek(at)
            while at < block.hi:
                line = f.readline()
                if not line:
                    return
                yield at, line
                at += len(line)

    def read(self, block: Block) -> Iterator[pa.RecordBatch]:
        """Lines without their ends, blank ones left out; bytes that aren't UTF-8 are replaced."""
        starts, values, held = [], [], 0

        def made() -> pa.RecordBatch:
            same = [pa.array([v] * len(starts), pa.string()) for v in (block.source, block.segment)]
            return pa.RecordBatch.from_arrays([pa.array(values, pa.string()), *same, pa.array(starts, pa.int64())], ["value", "source", "segment", "start"])

        for at, line in self.lines(block):
            text = line.rstrip(b"\r\n").decode("utf-8", "replace")
            if text.strip():
                starts.append(at)
                values.append(text)
                held += len(line)
            if held >= CHUNK:
                yield made()
                starts, values, held = [], [], 0
        if starts:
            yield made()


class _Whole(DataSourceReader):
    """All lines of a log as it stands, an unfinished last one too."""

    def __init__(self, options: dict):
        self.log = _Log(options)

    def partitions(self) -> list[Block]:
        return [b for source, known in self.log.segments().items() for name, size in known for b in self.log.blocks(source, name, 0, size)] or [Block("", "", 0, 0, 0)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        return self.log.read(partition) if partition.hi else iter(())


class _Growing(DataSourceStreamReader):
    """Offsets are {source: [segment, byte]}; a line of the last segment is taken once its end is there."""

    def __init__(self, options: dict):
        self.log, self.seen = _Log(options), {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        latest = dict(self.seen)
        for source, known in self.log.segments().items():
            if known:
                name, size = known[-1]
                before, end = self.seen.get(source, ("", 0))
                latest[source] = [name, self.log.whole_lines(source, name, size, end if before == name else 0)]
        self.seen = latest
        return latest

    def partitions(self, start: dict, end: dict) -> list[Block]:
        made, segments = [], self.log.segments()
        for source, (last, stop) in end.items():
            first, begin = start.get(source, ("", 0))
            for name, size in segments.get(source, []):
                if first <= name <= last:
                    made += self.log.blocks(source, name, begin if name == first else 0, stop if name == last else size)
            if last and last not in dict(segments.get(source, [])):
                raise ValueError(f"segment {last} of {source} is gone before it was read")
        return made

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        return self.log.read(partition)


class LandedLog(DataSource):
    """Options: path, the folder of the log; source, the sources to read, comma-separated (all); blockBytes."""

    @classmethod
    def name(cls) -> str:
        return "landed_log"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return _Whole(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Growing(self.options)


def read_log(spark: SparkSession, path: str, source: str | None = None, stream: bool = False, block: int = BLOCK) -> DataFrame:
    """(value, source, segment, start): the payloads of one source of a log, or of all."""
    spark.dataSource.register(LandedLog)
    reader = (spark.readStream if stream else spark.read).format(LandedLog.name()).option("blockBytes", str(block))
    return (reader.option("source", source) if source else reader).load(path)


def logged_posts(spark: SparkSession, path: str, source: str, stream: bool = False, block: int = BLOCK) -> DataFrame:
    """Raw posts and failed records (see records.py) of a source of a log."""
    return raw_posts(split_records(read_log(spark, path, source, stream, block), source), source)

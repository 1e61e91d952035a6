"""Lines of growing files: a streaming source with a cursor for each file.

``spark.readStream.format("tracelake_lines")`` gives (path, offset, line) of
every complete line below a folder, once, while the files grow. The stream's
offset holds a cursor for each file: its identity, how far complete lines
reach, and a digest of its head. A batch reads from the old cursor to the new
one; a file that isn't the one of the old cursor (other inode, shorter, or
another head) was rotated or truncated, and is read from its start. A last
line without an end waits until it is complete.

A batch is planned from its two offsets alone, so that a restarted query
repeats an unfinished batch as it was, and a file replaced in between gives
nothing to that batch and all its lines to the next one. Large files are read
in ranges of bytes, one task each. An offset has one entry for each file
(about 150 bytes); for more than some 100,000 files, give each stream a folder
of its own.

Options: ``path`` (folder, as a path or a URI of a file system that pyarrow
knows), ``glob`` (names, "*.jsonl" by default), ``split`` (bytes of a range).
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import RecordBatch, array, int64, string
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that are digested as a file's head, read at a time, and returned in a batch of lines.
HEAD, CHUNK, BATCH = 1024, 1 << 20, 4 << 20


@dataclass(frozen=True)
class Cursor:
    """What is known of a file: its inode (0 where there is none), the end of its complete lines, a digest of its first ``head`` bytes."""

    inode: int
    offset: int
    head: int
    digest: str

    def to_json(self) -> str:
        return json.dumps([self.inode, self.offset, self.head, self.digest])

    @classmethod
    def from_json(cls, value: str) -> Cursor:
        return cls(*json.loads(value))


@dataclass
class Range(InputPartition):
    """Lines that start from ``first`` up to ``last`` of a file whose cursor, when it was planned, was ``cursor``."""

    path: str
    first: int
    last: int
    begin: int
    cursor: Cursor


class Files:
    """The files below a folder, through the file system that its URI names."""

    def __init__(self, path: str, glob: str) -> None:
        self.glob = glob
        if "://" in path or path.startswith("file:"):
            self.fs, self.folder = arrow_fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
        else:
            self.fs, self.folder = arrow_fs.LocalFileSystem(), path

    def listed(self) -> dict[str, tuple]:
        """path -> what changes when the file does: size, time, inode."""
        found = self.fs.get_file_info(arrow_fs.FileSelector(self.folder, recursive=True, allow_not_found=True))
        return {f.path: (f.size, f.mtime_ns, self.inode(f.path)) for f in found if f.is_file and fnmatch.fnmatch(f.base_name, self.glob)}

    def inode(self, path: str) -> int:
        if not isinstance(self.fs, arrow_fs.LocalFileSystem):
            return 0
        try:
            return os.stat(path).st_ino
        except FileNotFoundError:
            return -1

    def digest(self, path: str, n: int) -> str:
        with self.fs.open_input_file(path) as f:
            return hashlib.sha1(f.read(n)).hexdigest()

    def cursor(self, path: str) -> Cursor | None:
        """The cursor after the file's last complete line; None: the file is gone."""
        try:
            inode = self.inode(path)
            with self.fs.open_input_file(path) as f:
                end = last_line_end(f, f.size())
                f.seek(0)
                head = min(HEAD, end)
                return Cursor(inode, end, head, hashlib.sha1(f.read(head)).hexdigest())
        except FileNotFoundError:
            return None

    def continues(self, path: str, old: Cursor, new: Cursor) -> bool:
        """Whether the file of the new cursor is that of the old one, grown."""
        if old.inode != new.inode or old.offset > new.offset:
            return False
        if old.head == new.head:
            return old.digest == new.digest
        try:  # the head has grown since: the file has at least the old one's bytes
            return self.digest(path, old.head) == old.digest
        except FileNotFoundError:
            return False


def last_line_end(f, last: int) -> int:
    """The place after the last newline before ``last``, 0 if there is none."""
    while last > 0:
        start = max(0, last - CHUNK)
        f.seek(start)
        at = f.read(last - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        last = start
    return 0


def lines_of(f, first: int, last: int, begin: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that start in [first, last); ``begin`` is known to be the start of a line.

    A line may end after ``last``; the line that crosses ``first`` belongs to the range before.
    """
    at = first
    if first > begin:
        f.seek(first - 1)
        at = first - 1
        while True:  # to the end of the line that first - 1 is in
            block = f.read(CHUNK)
            if not block:
                return
            end = block.find(b"\n")
            if end >= 0:
                at += end + 1
                break
            at += len(block)
    f.seek(at)
    rest = b""
    while at < last:
        block = f.read(CHUNK)
        if not block:
            return
        parts = (rest + block).split(b"\n")
        rest = parts.pop()
        for p in parts:
            if at >= last:
                return
            yield at, p
            at += len(p) + 1


class LineReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.glob, self.split = options["path"], options.get("glob", "*.jsonl"), int(options.get("split", 64 << 20))
        self.seen: dict[str, tuple[tuple, str]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, seen = Files(self.path, self.glob), {}
        for path, state in files.listed().items():
            if self.seen.get(path, (None,))[0] == state:
                seen[path] = self.seen[path]
            elif (cursor := files.cursor(path)) is not None:
                seen[path] = (state, cursor.to_json())
        self.seen = seen
        return {path: cursor for path, (_, cursor) in seen.items()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        files, out = Files(self.path, self.glob), []
        for path, value in end.items():
            new = Cursor.from_json(value)
            old = Cursor.from_json(start[path]) if path in start else None
            begin = old.offset if old and files.continues(path, old, new) else 0
            out += [Range(path, first, min(first + self.split, new.offset), begin, new) for first in range(begin, new.offset, self.split)]
        return out

    def read(self, partition: Range) -> Iterator[RecordBatch]:
        files, p = Files(self.path, self.glob), partition
        try:
            if files.inode(p.path) != p.cursor.inode or files.digest(p.path, p.cursor.head) != p.cursor.digest:
                return  # replaced since: the next batch reads it from its start
            with files.fs.open_input_file(p.path) as f:
                if f.size() < p.cursor.offset:
                    return
                offsets, texts, size = [], [], 0
                for at, line in lines_of(f, p.first, p.last, p.begin):
                    offsets.append(at)
                    texts.append(line.rstrip(b"\r").decode("utf-8", "replace"))
                    size += len(line)
                    if size >= BATCH:
                        yield _batch(p.path, offsets, texts)
                        offsets, texts, size = [], [], 0
                yield _batch(p.path, offsets, texts)
        except FileNotFoundError:
            return


def _batch(path: str, offsets: list[int], texts: list[str]) -> RecordBatch:
    return RecordBatch.from_arrays([array([path] * len(texts), string()), array(offsets, int64()), array(texts, string())], ["path", "offset", "line"])


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tracelake_lines"

    def schema(self) -> str:
        return "path string, offset long, line string"

    def streamReader(self, schema) -> LineReader:
        return LineReader(self.options)


def line_stream(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """A stream of (path, offset, line) of the files below ``path``."""
    spark.dataSource.register(LineSource)
    reader = spark.readStream.format("tracelake_lines").option("path", path)
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()


def consumer_cursors(spark: SparkSession, checkpoints: dict[str, str]) -> DataFrame:
    """consumer, path, inode, offset: how far each consumer's committed batches reach, read from the checkpoints of their queries.

    Every query has a checkpoint, hence cursors, of its own; a batch that was
    planned and not committed doesn't count.
    """
    schema, out = "consumer string, path string, inode long, offset long", None
    for consumer, folder in checkpoints.items():
        done = spark.read.text(f"{folder}/commits").select(F.regexp_extract(F.input_file_name(), r"(\d+)$", 1).cast("long").alias("batch")).agg(F.max("batch").alias("batch"))
        logged = spark.read.text(f"{folder}/offsets").select(F.regexp_extract(F.input_file_name(), r"(\d+)$", 1).cast("long").alias("batch"), "value")
        cursors = logged.join(F.broadcast(done), "batch").select(F.explode(F.from_json("value", "map<string, string>")).alias("path", "cursor"))
        fields = F.from_json("cursor", "array<string>")
        rows = cursors.where(F.col("cursor").startswith("[")).select(F.lit(consumer).alias("consumer"), "path", fields[0].cast("long").alias("inode"), fields[1].cast("long").alias("offset"))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], schema)


def file_snapshot(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """path, length, modified of the files below a folder, listed by Spark; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def changed_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """The paths of ``now`` that must be parsed anew as a whole: new and not empty, or another length or time than before.

    Take the snapshot before parsing and keep it once the results are stored:
    what is appended meanwhile then shows as a change the next time.
    """
    old = before.select("path", F.col("length").alias("_l"), F.col("modified").alias("_m"))
    both = now.join(old, "path", "left")
    known = F.col("_l").isNotNull()
    return both.where(F.when(known, (F.col("length") != F.col("_l")) | (F.col("modified") != F.col("_m"))).otherwise(F.col("length") > 0)).select("path", "length", "modified")

"""A stream of the lines that are appended to the files of a folder, from their ends on.

The driver lists the folder and reads the end of each grown file; ranges of bytes are
read by as many tasks as there are, on whatever file system pyarrow has for the folder.
An offset says for each file how many bytes of whole lines have been given out, so that
a stream that starts again from its checkpoint loses none and repeats none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a file that are looked at once, and that one task reads.
STEP, SHARE = 1 << 16, 64 << 20


@dataclass
class Range(InputPartition):
    """The lines of a file that begin within a range of bytes; ``end`` of the file's whole lines bounds the last one."""

    file: str
    start: int
    stop: int
    end: int


def files_of(folder: str):
    """The file system of a folder, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def whole(f, start: int, size: int) -> int:
    """Where the last whole line of a file ends, looked for from its end back to ``start``; ``start`` if there is none."""
    at = size
    while at > start:
        low = max(start, at - STEP)
        f.seek(low)
        found = f.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return start


def lines_of(f, r: Range) -> Iterator[tuple[int, bytes]]:
    """The place and bytes of each line that begins in a range. A range that begins within a line leaves it to the one before."""
    place = r.start
    rest = b""
    if r.start:
        f.seek(r.start - 1)
        inside = f.read(1) != b"\n"
    else:
        inside = False
    f.seek(r.start)
    at = r.start
    while at < r.end and (place < r.stop or inside):
        data = f.read(min(STEP, r.end - at))
        if not data:
            return
        at += len(data)
        *found, rest = (rest + data).split(b"\n")
        for line in found:
            if not inside and place < r.stop:
                yield place, line
            inside = False
            place += len(line) + 1
            if place >= r.stop:
                return


class Tail(DataSource):
    """``spark.readStream.format("lines_tail").option("path", folder)`` after ``register``.

    Options: ``begin`` (``end``, which is the default, or ``start``) for files that are
    there when the stream first starts; ``share`` for the bytes of a task. Hidden files
    are left out. Files that appear later are read from their first line, a file that
    became shorter from its first line again, and one that is gone no more. A line is
    given out once its line end is there. Offsets grow with the files of the folder.
    """

    @classmethod
    def name(cls) -> str:
        return "lines_tail"

    def schema(self) -> str:
        return "file string, place long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(self.options)


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.begin = options.get("begin", "end")
        if self.begin not in ("start", "end"):
            raise ValueError(self.begin)
        self.share = int(options.get("share", SHARE))
        self.known: dict[str, int] = {}

    def ends(self, known: dict[str, int]) -> dict[str, int]:
        """Where the whole lines of each file end, of which some is known."""
        from pyarrow import fs

        system, folder = files_of(self.folder)
        found = {}
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            name = info.base_name
            if info.type != fs.FileType.File or name.startswith((".", "_")):
                continue
            start = known.get(name, 0)
            start = start if start <= info.size else 0
            if info.size == start:
                found[name] = start
                continue
            with system.open_input_file(info.path) as f:
                found[name] = whole(f, start, info.size)
        return found

    def initialOffset(self) -> dict:
        return {} if self.begin == "start" else self.ends({})

    def latestOffset(self) -> dict:
        self.known = self.ends(self.known)
        return self.known

    def partitions(self, start: dict, end: dict) -> list[Range]:
        found = []
        for name in sorted(end):
            since, until = start.get(name, 0), end[name]
            since = since if since <= until else 0
            found += [Range(name, k, min(k + self.share, until), until) for k in range(since, until, self.share)]
        # A batch has a range, if an empty one.
        return found or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.file:
            return
        system, folder = files_of(self.folder)
        with system.open_input_file(f"{folder.rstrip('/')}/{partition.file}") as f:
            for place, line in lines_of(f, partition):
                yield partition.file, place, line.rstrip(b"\r").decode("utf-8", "replace")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Tail)

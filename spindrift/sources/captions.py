"""WebVTT captions as a data source: ``spark.read.format("captions")`` and ``df.write.format("captions")``.

Files are split over tasks by their sizes and parsed line by line, so no task holds a whole caption file; filters on the
video pass over files without opening them. Writing makes a file for each video, in the order of its cues; a file takes
its name once it is whole.

A file is read through Arrow's file systems, which know local paths and the stores that Arrow was built for. For stores
that only Spark reads, ``sources/files.py`` has readers that go through Spark.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

CUES = "vid string, cue_no int, start double, end double, text string"
#: Bytes of files that a task reads, about.
SPLIT = 32 << 20


def seconds(stamp: str) -> float:
    total = 0.0
    for part in stamp.split(":"):
        total = total * 60 + float(part)
    return total


def stamp(at: float) -> str:
    ms = round(at * 1000)
    return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"


def parse(lines: Iterator[str]) -> Iterator[tuple[int, float, float, str]]:
    """number, start, end and text of the cues in the lines of a file; one block is held at a time.

    Blocks are parted by empty lines and numbered from 0 over all of them, the header's too; those without an arrow, or
    whose times can't be read, are no cues.
    """
    number, block = 0, []
    for line in lines:
        line = line.rstrip("\r\n")
        if line:
            block.append(line)
        elif block:
            yield from _cue(number, block)
            number, block = number + 1, []
    if block:
        yield from _cue(number, block)


def _cue(number: int, block: list[str]) -> Iterator[tuple[int, float, float, str]]:
    at = next((i for i, line in enumerate(block) if "-->" in line), None)
    if at is None:
        return
    before, after = block[at].split("-->", 1)
    try:
        times = seconds(before.split()[-1]), seconds(after.split()[0])
    except (ValueError, IndexError):
        return
    yield number, *times, "\n".join(block[at + 1 :])


@dataclass
class Files(InputPartition):
    """What one task reads."""

    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class CaptionReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split, self.wanted = path, split, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the video are answered by the files' names; others are left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("vid",):
                names = {str(x) for x in ([f.value] if isinstance(f, EqualTo) else f.value)}
                self.wanted = names if self.wanted is None else self.wanted & names
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Files in the order of their names, as many to a task as SPLIT bytes hold; only names and sizes are looked at."""
        fs, root = pafs.FileSystem.from_uri(_uri(self.path))
        found = sorted((x.path, x.size) for x in fs.get_file_info(pafs.FileSelector(root)) if x.is_file and x.extension == "vtt" and not x.base_name.startswith((".", "_")))
        parts, size = [[]], 0
        for path, own in found:
            if self.wanted is not None and _stem(path) not in self.wanted:
                continue
            if parts[-1] and size + own > self.split:
                parts.append([])
                size = 0
            parts[-1].append(path)
            size += own
        return [Files(p) for p in parts]

    def read(self, partition: Files) -> Iterator[tuple]:
        fs = pafs.FileSystem.from_uri(_uri(self.path))[0]
        for path in partition.paths:
            with fs.open_input_stream(path) as raw:
                for cue in parse(_lines(raw)):
                    yield _stem(path), *cue


def _lines(raw) -> Iterator[str]:
    """The lines of a stream of bytes, read a megabyte at a time; bytes that aren't UTF-8 are marked as such."""
    left = b""
    while chunk := raw.read(1 << 20):
        *whole, left = (left + chunk).replace(b"\r\n", b"\n").split(b"\n")
        for line in whole:
            yield line.decode("utf-8", "replace")
    if left:
        yield left.decode("utf-8", "replace")


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(".vtt")


@dataclass
class Written(WriterCommitMessage):
    drafts: list[tuple[str, str]]


class CaptionWriter(DataSourceWriter):
    """Takes cues that are sorted by video and number within each task, all of a video in one task."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator[Row]) -> Written:
        fs, root = pafs.FileSystem.from_uri(_uri(self.path))
        fs.create_dir(root, recursive=True)
        drafts, vid, out = [], None, None
        for r in rows:
            if out is None or r["vid"] != vid:
                if out is not None:
                    out.close()
                vid = r["vid"]
                if not vid or "/" in vid or vid[0] in "._":
                    raise ValueError(f"no file can be named after the video {vid!r}")
                drafts.append((f"{root}/_{uuid.uuid4().hex}.draft", f"{root}/{vid}.vtt"))
                out = fs.open_output_stream(drafts[-1][0])
                out.write(b"WEBVTT\n")
            text = "\n".join(line for line in (r["text"] or "").splitlines() if line.strip())
            out.write(f"\n{stamp(r['start'])} --> {stamp(r['end'])}\n{text}\n".encode())
        if out is not None:
            out.close()
        return Written(drafts)

    def commit(self, messages: list[Written | None]) -> None:
        """Each draft takes its name; a name taken twice would lose cues, so it is an error before any is."""
        fs, root = pafs.FileSystem.from_uri(_uri(self.path))
        drafts = [d for m in messages if m for d in m.drafts]
        names = [name for _, name in drafts]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("a video's cues come from several tasks; deal them out by video first")
        if self.overwrite:
            for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if x.extension == "vtt" and x.path not in set(names):
                    fs.delete_file(x.path)
        for draft, name in drafts:
            fs.move(draft, name)

    def abort(self, messages: list[Written | None]) -> None:
        fs = pafs.FileSystem.from_uri(_uri(self.path))[0]
        for draft, _ in (d for m in messages if m for d in m.drafts):
            fs.delete_file(draft)


class Captions(DataSource):
    """Options: path; split, the bytes of files that a task reads."""

    @classmethod
    def name(cls) -> str:
        return "captions"

    def schema(self) -> str:
        return CUES

    def reader(self, schema: StructType) -> CaptionReader:
        return CaptionReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> CaptionWriter:
        return CaptionWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Captions)

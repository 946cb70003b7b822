"""Zipped day files as a data source of their own: ``spark.read.format("dayfiles")``, its stream and its writer.

Reading gives the lines of every file below a folder; ``bars.parse_lines`` makes bars of them. A task opens the files
themselves and unpacks them as it reads, so a file's size is not bounded by what a row can hold, and small files are dealt out
many to a task. Folders are reached by ``pyarrow.fs``: a path every executor can open, or the address of a store it knows.
"""

import datetime as dt
import json
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from barfold.session import ship_by_value
from barfold.sources.bars import DATE_IN_NAME, LINES, file_lines, good_bars, parse_lines

ship_by_value(__name__)

FORMAT = "dayfiles"
#: Bytes and files that one task reads at least before another one is used.
TASK_BYTES, TASK_FILES = 32 << 20, 256
_TEMPORARY = "_temporary"
#: What the writer takes: the name of a zip (it begins with the year), the header and one line of it.
FILE_LINES = "file string, header string, line string"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    uri = re.sub(r"^file:/*", "/", path)
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(path)


def _listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of every zip below a folder, by path; none if it isn't there."""
    store, root = _opened(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(".zip") and f"/{_TEMPORARY}/" not in f.path)


@dataclass
class Files(InputPartition):
    paths: list[str]


def _dealt(files: Sequence[tuple[str, int]]) -> list[Files]:
    out, size = [], 0
    for path, n in files:
        if not out or size + n > TASK_BYTES or len(out[-1].paths) == TASK_FILES:
            out, size = [*out, Files([])], 0
        out[-1].paths.append(path)
        size += n
    return out


class _Reading:
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.bounds = [dt.date.fromisoformat(options[o]) if o in options else None for o in ("start", "end")]
        self.log = options.get("log")

    def files(self) -> list[tuple[str, int]]:
        """Those whose name has a date within the bounds; without bounds all, dated or not."""
        start, end = self.bounds
        return [f for f in _listed(self.path) if (start is None and end is None) or self._within(f[0], start, end)]

    @staticmethod
    def _within(path: str, start: dt.date | None, end: dt.date | None) -> bool:
        named = re.search(DATE_IN_NAME, path)
        try:
            day = dt.date.fromisoformat(named[1]) if named else None
        except ValueError:
            day = None
        return day is not None and (start is None or day >= start) and (end is None or day <= end)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.path)
        for path in partition.paths:
            yield from file_lines(path, lambda p=path: store.open_input_file(p))


class DayFileReader(_Reading, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        return _dealt(self.files()) or [Files([])]


class DayFileStreamReader(_Reading, DataSourceStreamReader):
    """New files in the order they were found. Each look at the folder that finds some adds a numbered list of them to the
    log; an offset is such a number. Nothing depends on the files' times, so a file that is copied in late with an old
    time is found like any other, and a batch that is repeated reads the same files."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        if not self.log:
            raise ValueError('a stream of day files needs option "log", a folder for the lists of files found')

    def _lists(self) -> dict[int, list[tuple[str, int]]]:
        store, root = _opened(self.log)
        out = {}
        for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.is_file and re.fullmatch(r"\d+\.json", f.base_name):
                with store.open_input_file(f.path) as stored:
                    out[int(f.base_name[:-5])] = [tuple(x) for x in json.loads(stored.read())]
        return out

    def initialOffset(self) -> dict:
        return {"list": 0}

    def latestOffset(self) -> dict:
        lists = self._lists()
        seen = {path for files in lists.values() for path, _ in files}
        new, last = [f for f in self.files() if f[0] not in seen], max(lists, default=0)
        if new:
            store, root = _opened(self.log)
            store.create_dir(root, recursive=True)
            last += 1
            draft = posixpath.join(root, f".{uuid.uuid4().hex}")
            with store.open_output_stream(draft) as out:
                out.write(json.dumps(new).encode())
            store.move(draft, posixpath.join(root, f"{last}.json"))
        return {"list": last}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return _dealt([f for n, files in sorted(self._lists().items()) if start["list"] < n <= end["list"] for f in files])


class DayFileWriter(DataSourceArrowWriter):
    """One zip per ``file``; all become visible when the job commits, none if it fails."""

    def __init__(self, options: dict[str, str]):
        self.path, self.job = options["path"], uuid.uuid4().hex

    def _draft(self) -> str:
        return posixpath.join(_opened(self.path)[1], _TEMPORARY, self.job)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, _ = _opened(self.path)
        folder = posixpath.join(self._draft(), f"{TaskContext.get().taskAttemptId()}")
        store.create_dir(folder, recursive=True)
        done, archive, member, stored = [], None, None, None

        def close() -> None:
            if archive is not None:
                member.close()
                archive.close()
                stored.close()

        for batch in iterator:
            for file, header, line in zip(*(batch.column(c).to_pylist() for c in ("file", "header", "line")), strict=True):
                if not done or file != done[-1]:
                    close()
                    if file in done:
                        raise ValueError(f"the lines of {file} are not together")
                    stored = store.open_output_stream(posixpath.join(folder, file))
                    archive = zipfile.ZipFile(stored, "w", zipfile.ZIP_DEFLATED)
                    member = archive.open("day.csv", "w", force_zip64=True)
                    member.write(header.encode())
                    done.append(file)
                member.write(b"\n" + (line or "").encode())
        close()
        return Written(folder, done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _opened(self.path)
        written = [m for m in messages if m is not None]
        names = [f for m in written for f in m.files]
        if len(set(names)) < len(names):
            raise ValueError("a file's lines were dealt to several tasks")
        for year in sorted({f[:4] for f in names}):
            store.create_dir(posixpath.join(root, year), recursive=True)
        for m in written:
            for f in m.files:
                store.move(posixpath.join(m.folder, f), posixpath.join(root, f[:4], f))
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = _opened(self.path)
        if store.get_file_info(self._draft()).type == fs.FileType.Directory:
            store.delete_dir(self._draft())


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: list[str]


class DayFiles(DataSource):
    """Options: ``path``; ``start`` and ``end`` (ISO dates: other files are not opened); ``log`` (streams only)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> DataSourceReader:
        return DayFileReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return DayFileStreamReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return DayFileWriter(dict(self.options))


def _format(spark: SparkSession) -> str:
    spark.dataSource.register(DayFiles)
    return FORMAT


def day_file_lines(spark: SparkSession, path: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """The lines of the zipped day files below ``path``, of the days within the bounds if there are any."""
    bounds = {o: d.isoformat() for o, d in (("start", start), ("end", end)) if d is not None}
    return spark.read.format(_format(spark)).options(**bounds).load(path)


def day_file_line_stream(spark: SparkSession, path: str, log: str) -> DataFrame:
    """A stream of the lines of zipped day files as they land below ``path``; ``log`` is a folder of the stream's own."""
    return spark.readStream.format(_format(spark)).option("log", log).load(path)


def read_bars_from_source(spark: SparkSession, path: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    return good_bars(parse_lines(day_file_lines(spark, path, start, end)))


def write_day_files(lines: DataFrame, path: str) -> None:
    """(file, header, line) rows as one zip per ``file`` below ``path``, its lines in their order."""
    dealt = lines.select("file", "header", "line").repartition("file").sortWithinPartitions("file", F.col("line"))
    dealt.write.format(_format(lines.sparkSession)).mode("append").save(path)

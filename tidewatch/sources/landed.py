"""Landed JSON files as a data source of its own: ``spark.read.format("landed").load(folder)``.

A row is one element of a file: ``key`` (the file's name up to the first ``.`` or ``_``), ``file``, ``n`` (its place in the file),
``value`` (its JSON text) and ``error``. A file is an array, or an object with an array under ``comments``, ``replies`` or
``items``. It is one partition and read in pieces, so a task holds a piece and an element, however large the file is. What is
no JSON ends its file with a row that has the reason in ``error``, and the text from there (at most a piece) as value.

A filter on ``key`` leaves out files before any is opened. As a stream, files come in the order of their time of change and name; ``files_per_batch`` bounds a batch. Written batches appear by one rename
of a folder, or not at all.
"""

from __future__ import annotations

import codecs
import json
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

SCHEMA = "key string, file string, n long, value string, error string"
LISTS = ("comments", "replies", "items")
PIECE = 1 << 20
SPACE = re.compile(r"[ \t\r\n]*")


class Pieces:
    """The text of a stream, of which only what is not yet used is held."""

    def __init__(self, stream, piece: int = PIECE):
        self.stream, self.piece, self.text, self.at, self.ended = stream, piece, "", 0, False
        self.decode = codecs.getincrementaldecoder("utf-8")("replace").decode
        self.json = json.JSONDecoder()

    def more(self) -> bool:
        if self.ended:
            return False
        data = self.stream.read(max(self.piece, len(self.text) - self.at))
        self.ended = not data
        self.text, self.at = self.text[self.at :] + self.decode(data, self.ended), 0
        return True

    def next(self) -> str:
        """The next character that is no space, which stays; empty at the end."""
        while True:
            self.at = SPACE.match(self.text, self.at).end()
            if self.at < len(self.text) or not self.more():
                return self.text[self.at : self.at + 1]

    def value(self):
        """The next JSON value and its text."""
        self.next()
        while True:
            try:
                found, end = self.json.raw_decode(self.text, self.at)
                if end < len(self.text) or self.ended or not self.more():
                    text, self.at = self.text[self.at : end], end
                    return found, text
            except json.JSONDecodeError:
                if not self.more():
                    raise

    def take(self, wanted: str) -> str:
        found = self.next()
        if not found or found not in wanted:
            raise json.JSONDecodeError(f"{wanted!r} expected", self.text, self.at)
        self.at += 1
        return found


def elements(stream, piece: int = PIECE) -> Iterator[tuple[str | None, str | None]]:
    """(value, error) of the elements of a file."""
    pieces = Pieces(stream, piece)
    try:
        if not pieces.next():
            return
        if pieces.take("[{") == "{":
            while True:
                if pieces.next() == "}":
                    return
                key, _ = pieces.value()
                pieces.take(":")
                if key in LISTS and pieces.next() == "[":
                    pieces.take("[")
                    break
                pieces.value()
                if pieces.take(",}") == "}":
                    return
        if pieces.next() == "]":
            return
        while True:
            yield pieces.value()[1], None
            if pieces.take(",]") == "]":
                return
    except json.JSONDecodeError as error:
        yield pieces.text[pieces.at : pieces.at + piece], error.msg


def place_of(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def listed(path: str) -> list[tuple[int, str]]:
    """(time of change, file) of the JSON files in a folder and below, in that order; hidden ones are left out."""
    from pyarrow import fs

    store, folder = place_of(path)
    found = store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
    inner = [(f.mtime_ns or 0, f.path) for f in found if f.is_file and f.extension == "json"]
    return sorted((t, p) for t, p in inner if not any(part.startswith((".", "_")) for part in p.removeprefix(folder).split("/")))


def key_of(file: str) -> str:
    return re.match(r"[^._]*", file.rsplit("/", 1)[-1])[0]


class LandedFile(InputPartition):
    def __init__(self, file: str):
        super().__init__(file)
        self.file = file


class Reading:
    """Reads one file; shared by batch and stream."""

    def __init__(self, options: dict):
        self.path, self.piece = options["path"], int(options.get("piece", PIECE))

    def read(self, partition: LandedFile) -> Iterator[tuple]:
        store, _ = place_of(self.path)
        with store.open_input_stream(partition.file) as stream:
            for n, (value, error) in enumerate(elements(stream, self.piece)):
                yield key_of(partition.file), partition.file, n, value, error


class LandedReader(Reading, DataSourceReader):
    keys: set | None = None

    def pushFilters(self, filters):
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("key",):
                self.keys = wanted if self.keys is None else self.keys & wanted
            else:
                yield f

    def partitions(self):
        return [LandedFile(file) for _, file in listed(self.path) if self.keys is None or key_of(file) in self.keys]


class LandedStream(Reading, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.most, self.at = int(options.get("files_per_batch", 1_000)), None

    def initialOffset(self) -> dict:
        return {"time": -1, "file": ""}

    def latestOffset(self) -> dict:
        since = self.at or self.initialOffset()
        new = [x for x in listed(self.path) if x > (since["time"], since["file"])][: self.most]
        self.at = {"time": new[-1][0], "file": new[-1][1]} if new else since
        return self.at

    def partitions(self, start: dict, end: dict):
        self.at = max((start, end, self.at or start), key=lambda o: (o["time"], o["file"]))
        low, high = ((o["time"], o["file"]) for o in (start, end))
        return [LandedFile(file) for time, file in listed(self.path) if low < (time, file) <= high]


class Written(WriterCommitMessage):
    def __init__(self, file: str | None):
        self.file = file


class LandedWriter(DataSourceWriter):
    """Each task writes an array of its rows' values to a hidden folder; the commit renames it."""

    def __init__(self, options: dict):
        self.path, self.batch = options["path"], uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        store, folder = place_of(self.path)
        store.create_dir(f"{folder}/.{self.batch}", recursive=True)
        name = f"{folder}/.{self.batch}/{uuid.uuid4().hex}"
        with store.open_output_stream(name) as out:
            for n, row in enumerate(rows):
                out.write((("," if n else "[") + row["value"]).encode())
            out.write(b"]" if "n" in locals() else b"[]")
        return Written(name)

    def commit(self, messages) -> None:
        store, folder = place_of(self.path)
        from pyarrow import fs

        kept = {m.file for m in messages if m is not None}
        for f in store.get_file_info(fs.FileSelector(f"{folder}/.{self.batch}", allow_not_found=True)):
            if f.path in kept:
                store.move(f.path, f"{f.path}.json")
            else:  # of a task that was tried again
                store.delete_file(f.path)
        if kept:
            store.move(f"{folder}/.{self.batch}", f"{folder}/batch-{self.batch}")

    def abort(self, messages) -> None:
        store, folder = place_of(self.path)
        from pyarrow import fs

        if store.get_file_info(f"{folder}/.{self.batch}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/.{self.batch}")


class LandedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandedReader:
        return LandedReader(self.options)

    def streamReader(self, schema) -> LandedStream:
        return LandedStream(self.options)

    def writer(self, schema, overwrite: bool) -> LandedWriter:
        return LandedWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session. The module goes to the workers by value, as the one that plans has no files of the session."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # readers that take filters need it
    spark.dataSource.register(LandedSource)

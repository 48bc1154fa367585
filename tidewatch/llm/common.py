"""Small helpers that the corpus operators share."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.storage import Workspace, shared_dir, written

__all__ = ["Workspace", "ascii_lower", "binary_column", "make_dir", "move_file", "open_file", "rows_per_batch", "shared_dir", "table", "words_of", "written"]

#: Lower-cases A-Z, keeps digits, a-z and every byte of a non-ASCII character, turns the rest into spaces.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text after lower-casing A-Z; none for null."""
    return text.translate(WORD_BYTES).split() if text else []


def binary_column(batch, name: str) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes."""
    import pyarrow as pa

    column = batch.column(name)
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def rows_per_batch(spark: SparkSession, n: int):
    """While it lasts, Arrow batches have at most ``n`` rows; for tables whose rows are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def open_file(path: str, mode: str):
    """Opens a file of the shared folder: local and mounted paths directly, other stores through pyarrow."""
    if "://" not in path and not path.startswith("file:"):
        return open(path, mode)
    if path.startswith("file:"):
        return open("/" + path[5:].lstrip("/"), mode)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_stream(inner) if "r" in mode else store.open_output_stream(inner)


def make_dir(path: str) -> None:
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    store.create_dir(inner, recursive=True)


def move_file(source: str, target: str) -> None:
    """Puts a finished file in its place; a second attempt of the same task writes the same bytes again."""
    from pyarrow import fs

    store, old = fs.FileSystem.from_uri(source)
    store.move(old, fs.FileSystem.from_uri(target)[1])


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z, all other characters as they are."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A window is 13 consecutive words of a benchmark item (an item with fewer words, but some, is one window). The search
treats words as the alphabet. For each pattern length a shift table holds, by the hash of up to three words, the distance
that the search may skip; where the shift is zero, the hash selects the bucket of patterns that end so, and a direct
comparison of the words confirms an occurrence. Tables are numpy arrays of word numbers and places.

A benchmark beyond ``max_block_bytes`` is dealt into several blocks. Tasks build the tables of a block each and leave them as
a file of the shared folder; the driver gets the number of blocks only. The documents are read once: a task holds
``HELD_BYTES`` of texts and searches them with the tables of one block after the other, so documents are neither written
nor shuffled for it. A block of 1.5 MB of text takes about 12 MB in a worker.

Defined results: a null or empty text has no words (zero hits, not contaminated); a very long text is searched whole; null
ids stay null; repeated rows each give a row; an item whose id is null matches and appears as an empty id; items that share
a window are all named; an empty benchmark gives no hit; an empty table gives an empty result; other columns of either
table are ignored and may have any name.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import binary_column, make_dir, move_file, open_file, shared_dir, words_of

WINDOW = 13
BLOCK_WORDS = 3
MAX_BLOCK_BYTES = 8 << 20
#: Texts that a task holds while it goes through the blocks.
HELD_BYTES = 32 << 20


class WindowTable:
    """Shift table and suffix buckets of the windows of one length."""

    def __init__(self, length: int, numbers: np.ndarray, starts: np.ndarray, items: np.ndarray, suffixes: np.ndarray, bits: int):
        """``numbers`` are the word numbers of all items, ``starts`` the places of the windows in them, ``items`` their
        items, and ``suffixes`` for each place the hash of the words before it that select a bucket."""
        self.length, self.block, self.bits = length, min(BLOCK_WORDS, length), bits
        # Equal windows are one, with all their items.
        rows = np.ascontiguousarray(numbers[starts[:, None] + np.arange(length)]).view(np.dtype((np.void, 4 * length))).ravel()
        _, first, which = np.unique(rows, return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([which, items], 1), axis=0)
        self.item_ends = np.cumsum(np.bincount(pairs[:, 0], minlength=len(first))).astype(np.int32)
        self.items = pairs[:, 1].astype(np.int32)
        starts = starts[first]
        farthest = length - self.block + 1
        shifts = np.full(1 << bits, farthest, np.uint8)
        for end in range(self.block, length + 1):  # later ends shift less and overwrite
            at = suffixes[starts + end] & (1 << bits) - 1
            np.minimum.at(shifts, at, length - end)
        self.shifts = shifts.tobytes()
        self.keys = suffixes[starts + length]
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.starts, self.order = self.keys[order], starts[order].astype(np.int32), order.astype(np.int32)


class WindowSearch:
    """The windows of a set of items (id, words): one table for each window length."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int = WINDOW):
        number: dict[bytes, int] = {}
        numbers = np.array([number.setdefault(w, len(number)) for _, words in items for w in words], np.int32)
        self.words, self.numbers = list(number), numbers
        self.items = [i for i, _ in items]
        text = [w for _, words in items for w in words]
        sizes = np.array([len(words) for _, words in items], int)
        first = np.cumsum(sizes) - sizes
        self.tables = []
        for length in sorted({min(n, size) for n in sizes.tolist() if n}):
            block = min(BLOCK_WORDS, length)
            suffixes = np.zeros(len(text) + 1, np.uint32)
            for end in range(block, len(text) + 1):
                suffixes[end] = hashed(text[end - block : end])
            own = np.nonzero((sizes >= size) if length == size else (sizes == length))[0]
            n_windows = sizes[own] - length + 1
            starts = np.repeat(first[own], n_windows) + np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
            bits = max(12, int(np.ceil(np.log2(8 * max(1, sizes[own].sum())))))
            self.tables.append(WindowTable(length, numbers, starts, np.repeat(own, n_windows), suffixes, bits))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans [start, end) of words inside occurrences, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        n, crc = len(words), zlib.crc32
        for table in self.tables:
            length, block, shifts, mask = table.length, table.block, table.shifts, (1 << table.bits) - 1
            end = length
            while end <= n:
                key = crc(b" ".join(words[end - block : end]))
                step = shifts[key & mask]
                if step:
                    end += step
                    continue
                low = int(np.searchsorted(table.keys, key))
                while low < len(table.keys) and table.keys[low] == key:
                    at = table.starts[low]
                    if [self.words[w] for w in self.numbers[at : at + length].tolist()] == words[end - length : end]:
                        spans.append((end - length, end))
                        window = table.order[low]
                        begin = table.item_ends[window - 1] if window else 0
                        found.update([self.items[i] for i in table.items[begin : table.item_ends[window]].tolist()])
                    low += 1
                end += 1
        return merged(spans), found


def hashed(words: list[bytes]) -> int:
    return zlib.crc32(b" ".join(words))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def windows_of(words: list[bytes], size: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    if 0 < len(words) <= size:
        yield tuple(words)
    else:
        for i in range(len(words) - size + 1):
            yield tuple(words[i : i + size])


def write_tables(benchmark: DataFrame, item_col: str, text_col: str, max_block_bytes: int) -> tuple[str, int]:
    """The folder with a file of search tables for each block, and the number of blocks; a block's texts have about
    ``max_block_bytes`` at most."""
    import pyarrow as pa

    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-total // max_block_bytes) or 1
    folder = shared_dir(spark, "search-tables")
    make_dir(folder)

    def build(table: pa.Table) -> pa.Table:
        number = table.column("block")[0].as_py()
        search = WindowSearch([(item, words_of(text.encode())) for item, text in zip(table.column("item").to_pylist(), table.column("text").to_pylist(), strict=True)])
        part = f"{folder}/part-{uuid.uuid4().hex}"
        with open_file(part, "wb") as out:
            out.write(pickle.dumps(search))
        move_file(part, table_file(folder, number))
        return pa.table({"block": pa.array([number], pa.int64())})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)).cast("long"))
    n_tasks = min(n_blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    built = dealt.repartition(n_tasks, "block").groupBy("block").applyInArrow(build, "block long")
    built.write.format("noop").mode("overwrite").save()
    return folder, n_blocks


def table_file(folder: str, number: int) -> str:
    return f"{folder}/block-{number}"


#: The tables that a worker read last, by file.
_last_tables: dict[str, WindowSearch | None] = {}


def read_tables(folder: str, number: int) -> WindowSearch | None:
    """The tables of a block; None for one without items."""
    path = table_file(folder, number)
    if path not in _last_tables:
        _last_tables.clear()
        try:
            with open_file(path, "rb") as file:
                _last_tables[path] = pickle.loads(file.read())
        except FileNotFoundError:
            _last_tables[path] = None
    return _last_tables[path]


SPANS = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def find_benchmark_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    max_block_bytes: int = MAX_BLOCK_BYTES,
    held_bytes: int = HELD_BYTES,
) -> DataFrame:
    """Per document row: id, n_words, merged spans of hit words, items (as strings, sorted) with occurring windows."""
    import pyarrow as pa

    folder, n_blocks = write_tables(benchmark, item_col, item_text_col, max_block_bytes)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def searched(texts: list[bytes | None]):
        spans, items, n_words = [[] for _ in texts], [set() for _ in texts], [0] * len(texts)
        for number in range(n_blocks):
            search = read_tables(folder, number)
            for i, text in enumerate(texts):
                words = words_of(text)
                n_words[i] = len(words)
                if search is not None:
                    own, found = search.search(words)
                    spans[i] += own
                    items[i] |= found
        return n_words, [[{"start": a, "end": b} for a, b in merged(s)] for s in spans], [sorted(i) for i in items]

    def run(batches):
        held: list = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= held_bytes:
                yield from given(held)
                held, size = [], 0
        yield from given(held)

    def given(held):
        texts = [text for batch in held for text in binary_column(batch, "text")]
        found = searched(texts)
        at = 0
        for batch in held:
            own = [pa.array(column[at : at + batch.num_rows], kind) for column, kind in zip(found, (pa.int64(), span_type, pa.list_(pa.string())), strict=True)]
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("id"), *own], ["id", "n_words", "spans", "items"])

    shape = f"id {rows.schema['id'].dataType.simpleString()}, {SPANS}"
    return rows.mapInArrow(run, shape).select(F.col("id").alias(id_col), "n_words", "spans", "items")


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated (some word hit, and at least one word in twenty)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The document rows that are not contaminated, with their own columns. The whole row travels with its text, so no
    join by a document id is needed and repeated ids do no harm."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), F.col(text_col).alias("text"))
    found = judged(find_benchmark_spans(whole, benchmark, "row", "text"))
    kept = found.filter(~F.col("contaminated"))
    return kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def items_digest(items: list[str]) -> str:
    """What ``items_sha256`` holds, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()

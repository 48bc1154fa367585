"""Token ids in binary files: frequency-ranked, byte-aligned variable-length codes with separate control bytes.

Ids are replaced by their rank in the corpus (0: most frequent), so that the common ones fit in one byte. Four values
share a control byte of four two-bit lengths; control bytes and data bytes lie in separate runs, and a reader decodes a
whole run at once by looking up lengths, offsets and masks of each control byte in numpy tables.

A file is a sequence of blocks of about a million ids: a header (magic, documents, ids, control bytes, data bytes), the
document ids with a validity byte each, the ids per document, the control run and the data run. ``ranks.bin`` beside the
files lists the token ids by rank. Files are written in ascending document order, one per partition of a range
partitioning, under a temporary name that is moved in place when it is complete: a repeated task writes the same file.

Defined results: a null text counts as empty and has the end id alone; a very long text is one document of one block,
however many ids it has; null document ids come first; documents of equal id follow each other in the order of a hash of
their texts; ids of equal frequency are ranked by their number; repeated rows each give a document; an empty table gives no
file and no row; other columns are ignored and may have any name.
"""

from __future__ import annotations

import struct
import zlib
from array import array

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import make_dir, move_file, open_file, shared_dir, written

MAGIC = b"TWF1"
HEADER = "<4sQQQQ"
BLOCK_IDS = 1 << 20
CACHE_ENTRIES = 300_000
CACHED_CHARS = 64

#: The split pattern of the tokenizer, in force on lower-case text.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall

# Tables by control byte: bytes of the four values together, offset and mask of each.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
TOTAL = _LENGTHS.sum(1)
OFFSET = np.cumsum(_LENGTHS, 1) - _LENGTHS
MASK = ((1 << (8 * _LENGTHS.astype(np.uint64))) - 1).astype(np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values; the last group is filled with zeros."""
    full = np.zeros(-(-len(values) // 4) * 4, "<u4")
    full[: len(values)] = values
    sizes = np.ones(len(full), np.uint8)
    for bits in (8, 16, 24):
        longer = full >> bits != 0
        if not longer.any():
            break
        sizes += longer
    control = ((sizes - 1).reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    ends = np.cumsum(sizes, dtype=np.int64)
    data, starts = np.empty(ends[-1] if len(ends) else 0, np.uint8), ends - sizes
    data[starts] = full & 0xFF
    for k in range(1, int(sizes.max(initial=1))):
        wide = np.nonzero(sizes > k)[0]
        data[starts[wide] + k] = full[wide] >> (8 * k) & 0xFF
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first ``n`` values of a run."""
    codes = np.frombuffer(control, np.uint8)
    padded = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    starts = np.cumsum(TOTAL[codes]) - TOTAL[codes]
    at = (starts[:, None] + OFFSET[codes]).ravel()
    found = padded[at]
    for k in range(1, int(_LENGTHS[codes].max(initial=1))):
        found |= padded[at + k] << np.uint32(8 * k)
    return (found & MASK[codes].ravel())[:n]


class WordEncoder:
    """Ids of a text by the tokenizers library, remembering those of space-separated pieces.

    The tokenizer lower-cases and drops white space, and no token spans it, so a text's ids are those of its pieces.
    Pieces of characters below U+0250 (all of which are composed) are split as the tokenizer does and go straight to its
    vocabulary model; all others run through the whole tokenizer. What is remembered is kept in two generations: a full one
    becomes the old one."""

    def __init__(self, tokenizer_json: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json.decode())
        self.tokenize = self.tokenizer.model.tokenize
        self.pieces: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.words: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        moved = [b for b in range(256) if b not in kept]
        self.shown = {b: chr(256 + i) for i, b in enumerate(moved)}
        self.ends = {c: self.word(c) for c in ".,;:!?"}

    def word(self, word: str) -> bytes:
        """Ids of one match of the split pattern."""
        new, old = self.words
        ids = new.get(word)
        if ids is None:
            ids = old.get(word)
            if ids is None:
                seen = word if word.isascii() else word.encode().decode("latin-1").translate(self.shown)
                ids = array("I", [t.id for t in self.tokenize(seen)]).tobytes()
            if len(word) <= CACHED_CHARS:
                remember(new, old, word, ids)
        return ids

    def piece(self, piece: str) -> bytes:
        new, old = self.pieces
        ids = old.get(piece)
        if ids is None:
            if piece.isascii() or max(piece) < "\u0250" and "\u0130" not in piece:
                low = piece.lower()
                if low.isalpha():
                    ids = self.word(low)
                elif (end := self.ends.get(low[-1])) and low[:-1].isalpha():
                    ids = self.word(low[:-1]) + end
                elif len(piece) <= CACHED_CHARS and piece.isprintable() and "<|" not in piece:
                    ids = b"".join([self.word(w) for w in WORDS(low)])
            if ids is None:
                ids = array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        if len(piece) <= CACHED_CHARS:
            remember(new, old, piece, ids)
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known, piece = self.pieces[0].get, self.piece
        return b"".join([known(p) or piece(p) for p in text.replace("\n", " ").split(" ") if p])


def remember(new: dict[str, bytes], old: dict[str, bytes], key: str, ids: bytes) -> None:
    if len(new) >= CACHE_ENTRIES:
        old.clear()
        old.update(new)
        new.clear()
    new[key] = ids


#: Per Python worker: the encoder in use, so that what it remembers lives on from task to task.
ENCODERS: dict[str, WordEncoder] = {}


def encoder(key: str, held) -> WordEncoder:
    if key not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[key] = WordEncoder(held.value)
    return ENCODERS[key]


ENCODED = "id long, tie long, ids binary, tokens array<long>, counts array<long>"


def encoded(texts: DataFrame, key: str, held, end_id: int) -> DataFrame:
    """Rows (id, tie, ids) with the compressed ids of a text, and at the end of each task one row (tokens, counts)."""
    import pyarrow as pa
    import zstandard

    types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [c.split()[0] for c in ENCODED.split(", ")]

    def run(batches):
        encode, total = encoder(key, held).encode, np.zeros(end_id + 1, np.int64)
        end, zipped = np.array([end_id], "<u4").tobytes(), zstandard.ZstdCompressor(level=1).compress

        def count(waiting):
            own = np.bincount(np.concatenate(waiting), minlength=len(total))
            own[: len(total)] += total
            return own

        for batch in batches:
            packed, waiting, size = [], [], 0
            for text in batch.column("text").to_pylist():
                ids = np.frombuffer(encode(text or "") + end, "<u4")
                waiting.append(ids)
                size += len(ids)
                if size >= BLOCK_IDS:
                    total, waiting, size = count(waiting), [], 0
                packed.append(zipped(ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else b"4" + ids.tobytes()))
            if waiting:
                total = count(waiting)
            n = len(packed)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tie"), pa.array(packed, types[2]), pa.nulls(n, types[3]), pa.nulls(n, types[4])], names)
        seen = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((None, None, None, seen, total[seen]), types, strict=True)], names)

    return texts.mapInArrow(run, ENCODED)


def unzipped(packed: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(packed)
    return np.frombuffer(raw, "<u4", offset=1) if len(raw) % 2 else np.frombuffer(raw, "<u2").astype("<u4")


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes all documents once, ranks the ids, and writes the files; returns the manifest: part, path, n_docs, n_ids."""
    import pyarrow as pa
    from pyspark import TaskContext

    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as file:
        held = spark.sparkContext.broadcast(file.read())
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    rows = written(encoded(texts, tokenizer_path, held, end_id), "encoded-texts")
    counts = rows.filter("tokens IS NOT NULL").select(F.explode(F.arrays_zip("tokens", "counts")).alias("c")).groupBy("c.tokens").agg(F.sum("c.counts").alias("n"))
    # At most one row for each entry of the vocabulary.
    by_rank = np.array([row["tokens"] for row in counts.orderBy(F.desc("n"), "tokens").collect()], "<u4")
    make_dir(folder)
    with open_file(f"{folder}/ranks.bin", "wb") as file:
        file.write(by_rank.tobytes())
    ranks = spark.sparkContext.broadcast(by_rank)

    def run(batches):
        by_rank = ranks.value
        rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, "<u4")
        rank_of[by_rank] = np.arange(len(by_rank))
        task = TaskContext.get()
        path, n_docs, n_ids, file = f"{folder}/part-{task.partitionId():06d}.twf", 0, 0, None
        temporary = f"{path}.{task.taskAttemptId()}.tmp"
        ids, texts, size = [], [], 0

        def flush():
            values = rank_of[np.concatenate(texts)]
            control, data = pack(values)
            file.write(struct.pack(HEADER, MAGIC, len(ids), len(values), len(control), len(data)))
            file.write(np.array([i or 0 for i in ids], "<i8").tobytes() + bytes(i is not None for i in ids))
            file.write(np.array([len(t) for t in texts], "<u8").tobytes() + control)
            file.write(data)
            ids.clear()
            texts.clear()

        for batch in batches:
            for id_, packed in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                file = file or open_file(temporary, "wb")
                ids.append(id_)
                texts.append(unzipped(packed))
                size += len(texts[-1])
                n_docs += 1
                n_ids += len(texts[-1])
                if size >= BLOCK_IDS:
                    flush()
                    size = 0
        if file:
            if ids:
                flush()
            file.close()
            move_file(temporary, path)
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]})

    order = [F.col("id").asc_nulls_first(), F.col("tie")]
    in_order = rows.filter("tokens IS NULL").select("id", "tie", "ids").repartitionByRange(*order).sortWithinPartitions(*order)
    return written(in_order.mapInArrow(run, "part long, path string, n_docs long, n_ids long"), "token-file-manifest")


def read_blocks(path: str):
    """Document ids, ids per document and ranks of each block of a file."""
    with open_file(path, "rb") as file:
        while head := file.read(struct.calcsize(HEADER)):
            magic, n_docs, n_ids, n_control, n_data = struct.unpack(HEADER, head)
            if magic != MAGIC:
                raise ValueError(f"{path}: not a block of token ids")
            ids = np.frombuffer(file.read(8 * n_docs), "<i8").tolist()
            valid = file.read(n_docs)
            sizes = np.frombuffer(file.read(8 * n_docs), "<u8").astype(np.int64)
            ranks = unpack(file.read(n_control), file.read(n_data), n_ids)
            yield [i if v else None for i, v in zip(ids, valid, strict=True)], sizes, ranks


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and its ids if asked for."""
    import pyarrow as pa

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))

    def run(batches):
        with open_file(f"{folder}/ranks.bin", "rb") as file:
            by_rank = np.frombuffer(file.read(), "<u4")
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                for ids, sizes, ranks in read_blocks(path):
                    tokens = by_rank[ranks]
                    ends = np.cumsum(sizes)
                    parts = [tokens[e - n : e] for e, n in zip(ends, sizes, strict=True)]
                    columns = [
                        pa.array(ids, pa.int64()),
                        pa.array(start + ends - sizes, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)
                    start += int(ends[-1]) if len(ends) else 0

    n_tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return files.repartition(n_tasks).mapInArrow(run, schema)


def token_file_digests(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes the files to the shared folder and describes each document as read back from them."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "token-files")
    return read_token_files(spark, folder, write_token_files(docs, tokenizer_path, end_id, folder))

"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token (a match of the split pattern) starts as single bytes in a linked list. Every adjacent pair that is a
token waits in the bucket of its merge rank, which holds the positions of left partners; bits in words of 256 mark the
ranks whose buckets are not empty, and bits above them the words in use. Find-first-set gives the lowest rank, the smallest
position of its bucket is merged, and the pairs that this changes enter their buckets. Entries whose pair has changed
meanwhile are stale and skipped. The cost is O(n log n) at worst for one pre-token of n bytes.

Texts are first cut in front of white space that follows other characters, where no match of the pattern can span, so
that equal pieces share one cached result in each Python worker. A full cache becomes the old generation, from which
what is asked for again is taken over; this changes the speed only.

Defined results: a null text counts as empty and has no tokens; null ids are kept; very long texts and pre-tokens are
coded whole; of equal ranks in a pre-token the leftmost pair is merged first; repeated rows each give a row; an empty table
gives an empty result; other columns may have any name, names that differ in case only included.
"""

from __future__ import annotations

import base64
import hashlib
import re
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as the split pattern understands it (Unicode White_Space).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
#: White space beside single spaces and line ends between words: such texts are cut by PIECES, all others by str.split.
UNEVEN = re.compile("[ \\n]{2}|[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
CACHE_ENTRIES = 400_000
CACHED_CHARS = 64


class RankedMerges:
    """Encodes and decodes by a table of byte strings and their ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.n_ranks = max(ranks.values(), default=-1) + 1
        self.token = [b""] * self.n_ranks
        for piece, rank in ranks.items():
            self.token[rank] = piece
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")).findall
        # Results by what comes before: entries since the last change of generation, and those of the generation before.
        self.known: dict[str, tuple[dict, dict]] = {lead: ({}, {}) for lead in ("", " ", "\n")}

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        ranks = self.ranks.get
        whole = ranks(word)
        if whole is not None:
            return (whole,)
        n = len(word)
        end = list(range(1, n + 1))  # of the part that starts at a position
        before = list(range(-1, n - 1))
        pair = [ranks(word[i : i + 2]) for i in range(n - 1)] + [None]  # rank of the part and its right neighbour
        # The queue: positions by rank, a bit for each waiting rank in words of 256 bits, a bit for each word in use.
        buckets: dict[int, list[int]] = {}
        low: dict[int, int] = {}
        top = 0
        changed = range(n - 1)
        while True:
            for i in changed:
                rank = pair[i]
                if rank is not None:
                    if bucket := buckets.get(rank):
                        heappush(bucket, i)
                    else:
                        buckets[rank] = [i]
                        high = rank >> 8
                        low[high] = low.get(high, 0) | 1 << (rank & 255)
                        top |= 1 << high
            changed = ()
            if not top:
                break
            high = (top & -top).bit_length() - 1
            bits = low[high]
            rank = high << 8 | (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                low[high] = bits = bits & (bits - 1)
                if not bits:
                    top &= top - 1
            if pair[i] != rank:
                continue  # stale
            right = end[i]
            stop = end[i] = end[right]
            pair[right] = None
            if stop < n:
                before[stop] = i
                pair[i] = ranks(word[i : end[stop]])
            else:
                pair[i] = None
            left = before[i]
            if left >= 0:
                pair[left] = ranks(word[left:stop])
                changed = (i, left)
            else:
                changed = (i,)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return tuple(out)

    def ids_of(self, lead: str, rest: str) -> tuple[int, ...]:
        """Ids of ``lead + rest``, a text that no match of the pattern leaves; kept under its lead."""
        new, old = self.known[lead]
        ids = old.get(rest)
        if ids is None:
            words = self.split(lead + rest)
            if len(words) == 1:
                ids = self.merge(words[0].encode())
            else:
                parts: list[int] = []
                for word in words:
                    parts += self.word_ids(word)
                ids = tuple(parts)
        if len(rest) <= CACHED_CHARS:
            if len(new) >= CACHE_ENTRIES:
                old.clear()
                old.update(new)
                new.clear()
            new[rest] = ids
        return ids

    def word_ids(self, word: str) -> tuple[int, ...]:
        lead, rest = (" ", word[1:]) if word[0] == " " else ("", word)
        new, old = self.known[lead]
        ids = new.get(rest) or old.get(rest)
        if ids is None:
            ids = self.merge(word.encode())
            if len(rest) <= CACHED_CHARS and len(new) < CACHE_ENTRIES:
                new[rest] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if UNEVEN(text):
            get = self.known[""][0].get
            for piece in PIECES(text):
                out += get(piece) or self.ids_of("", piece)
            return out
        get, lead = self.known[" "][0].get, ""
        for line in text.split("\n"):
            first, *words = line.split(" ")
            out += self.ids_of(lead, first) if lead or first else ()
            for word in words:
                out += get(word) or self.ids_of(" ", word)
            lead = "\n"
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


#: Per Python worker: the coder of each broadcast, so that caches live on from task to task.
CODERS: dict[str, RankedMerges] = {}


def coder(key: str, held) -> RankedMerges:
    if key not in CODERS:
        CODERS.clear()
        CODERS[key] = RankedMerges(*held.value)
    return CODERS[key]


def encode_column(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns of ``docs`` and ``ids_col`` (array<int>), which replaces a column of that name."""
    import pyarrow as pa

    spark = docs.sparkSession
    held, key = spark.sparkContext.broadcast((load_ranks(ranks_path), pattern)), f"{ranks_path}|{pattern}"
    rest = [c for c in docs.columns if c != ids_col]
    whole = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]).alias("row"), F.col(text_col).alias("text"))

    def run(batches):
        encode = coder(key, held).encode
        for batch in batches:
            ids = [encode(text or "") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(ids, pa.list_(pa.int32()))], ["row", "ids"])

    out = whole.mapInArrow(run, f"row {whole.schema['row'].dataType.simpleString()}, ids array<int>")
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(rest)], F.col("ids").alias(ids_col))


def decode_column(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns of ``df`` and ``out_col`` (binary), the bytes that the ids stand for; null ids give null."""
    held, key = df.sparkSession.sparkContext.broadcast((load_ranks(ranks_path), pattern)), f"{ranks_path}|{pattern}"

    @F.pandas_udf("binary")
    def decoded(ids: pd.Series) -> pd.Series:
        decode = coder(key, held).decode
        return ids.map(lambda x: None if x is None else decode(x))

    return df.withColumn(out_col, decoded(ids_col))


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, number of tokens, digest of the decimal ids joined by commas, digest of the decoded bytes.

    Encodes, then decodes the ids in the same task; neither ids nor bytes leave the worker."""
    import pyarrow as pa

    held, key = docs.sparkSession.sparkContext.broadcast((load_ranks(ranks_path), pattern)), f"{ranks_path}|{pattern}"
    pairs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        codes = coder(key, held)
        decimal = [str(i) for i in range(codes.n_ranks)].__getitem__
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for text in batch.column("text").to_pylist():
                ids = codes.encode(text or "")
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                out[2].append(hashlib.sha256(codes.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return pairs.mapInArrow(run, f"id {pairs.schema['id'].dataType.simpleString()}, {DIGESTS}").withColumnRenamed("id", id_col)

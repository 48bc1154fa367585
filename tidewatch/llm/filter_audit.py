"""Audit of five filters in every order, behind a counting Bloom prepass for repeated texts.

Filters, named by their failure: A under 50 words; B 100 * distinct words < 65 * words; C 100 * ``[A-Z]`` characters > 5 *
characters; D a character of ``#$%&*|``; E the same text as a row of a smaller id, anywhere in the table and removed or not.

Whether a text repeats is settled in two steps. Each task adds the hashes of its texts to a counting sketch, in which counts
stop at two, and sends the cells that it touched; cells are merged by ranges. A text of which some cell was met only once
is unique for certain. Only the other rows are shuffled with their texts, to find the smallest id of each text exactly. The
merged sketch is held by every task, so its size is bounded by ``most_bytes``; for a table beyond that, nothing is cleared and the
smallest ids are found for all rows by digest and length of the whole text instead, so that no text is shuffled there.

The five failures of a row are the bits of a mask, and all the audit needs are additive counts of rows by part and mask:
what is left after a set of filters is the sum over masks without its bits, which is laid out for the 32 sets once a part.

Defined results: a null text is empty, has no words and fails A only (and E); a null part is the empty string; rows of
null id never fail E and make no other row fail it; of rows with equal ids and equal texts none fails E for the other's
sake; labels that are missing or null count as 0, and repeated labels of an id as their largest; a row counts once,
however often it is repeated in the labels; very long texts are judged whole; further columns are ignored, whatever their
names; an empty table has no parts and gives no rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import Workspace

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(LETTERS)]
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, "[#$%&*|]"
#: Cells of the sketch for each row, and cells that a text touches: of unique texts in a full sketch 1 in 150 is not cleared.
CELLS, PROBES = 12, 4
#: Cells of a range, which are merged together; one bit each once merged.
RANGE = 1 << 22
#: Rows whose cells a task holds before it sends them on.
HELD = 1 << 19
MOST_BYTES = 128 << 20


def failures(text: Column) -> Column:
    """Bits of the failures A to D of a text that is not null."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    rules = [
        n_words < LEAST_WORDS,
        100 * n_distinct < LEAST_DISTINCT * n_words,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text),
        text.rlike(SYMBOLS),
    ]
    return sum(F.when(rule, 1 << i).otherwise(0) for i, rule in enumerate(rules)).cast("int")


def cells_of(hashes: np.ndarray, n_cells: int) -> np.ndarray:
    """The PROBES cells of each hash, one row each."""
    h = hashes.view(np.uint64)
    start, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((start[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(n_cells)).astype(np.int64)


def part_sketches(n_cells: int):
    """Arrow function: of each HELD rows the touched cells by range, (range, once, often), both as 32-bit offsets."""
    import pyarrow as pa

    def sent(hashes: list[np.ndarray]) -> pa.RecordBatch:
        cells, counts = np.unique(cells_of(np.concatenate(hashes), n_cells), return_counts=True)
        cuts = np.searchsorted(cells, np.arange(0, n_cells + RANGE, RANGE))
        rows = [(r, cells[a:b] - r * RANGE, counts[a:b] > 1) for r, (a, b) in enumerate(itertools.pairwise(cuts)) if b > a]
        columns = [[r for r, _, _ in rows], *[[c[m == often].astype("<u4").tobytes() for _, c, m in rows] for often in (False, True)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["range", "once", "often"])

    def sketch(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            n += batch.num_rows
            if n >= HELD:
                yield sent(held)
                held, n = [], 0
        if n:
            yield sent(held)

    return sketch


def merged(group):
    """Arrow function: the cells of a range that were met twice or more, as bits; counts stop at two."""
    import pyarrow as pa

    counts = np.zeros(RANGE, np.uint8)
    for name, n in (("once", 1), ("often", 2)):
        for cells in group.column(name):
            at = np.frombuffer(cells.as_py(), "<u4")
            counts[at] = np.minimum(counts[at] + n, 2)
    return pa.table([group.column("range").slice(0, 1), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())], ["range", "bits"])


def repeat_test(rows: DataFrame, n_cells: int):
    """A function of a hash column: whether its text may be met twice in ``rows``; false for texts that are unique for certain."""
    spark = rows.sparkSession
    parts = rows.select("text_hash").mapInArrow(part_sketches(n_cells), "range int, once binary, often binary")
    n_tasks = min(-(-n_cells // RANGE), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = parts.repartition(n_tasks, "range").groupBy("range").applyInArrow(merged, "range int, bits binary")
    bits = np.zeros(-(-n_cells // RANGE) * RANGE // 8, np.uint8)
    for r in ranges.toLocalIterator():  # most_bytes in all
        bits[r["range"] * RANGE // 8 : (r["range"] + 1) * RANGE // 8] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf(T.BooleanType())
    def may_repeat(hashes):
        import pandas as pd

        at = cells_of(hashes.to_numpy(), n_cells)
        return pd.Series(((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1))

    return may_repeat


def masks(docs: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, part, mask) of each row; bit i stands for the failure of filter i."""
    space = Workspace(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    n_cells = max(RANGE, CELLS * rows.count())
    if n_cells // 8 <= most_bytes:
        repeats = repeat_test(rows, n_cells)("text_hash")
        judged = rows.select("doc_id", "part", failures(F.col("text")).alias("mask"), F.when(repeats, F.struct("text")).alias("same"))
    else:
        judged = rows.select("doc_id", "part", failures(F.col("text")).alias("mask"), F.struct(F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("n")).alias("same"))
    judged = space.write(judged, "judged-texts")
    unsettled = judged.filter("same IS NOT NULL")
    # Rows meet their text's smallest id by text and id, so that the copies of one text are dealt to all tasks.
    first = unsettled.groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    later = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    settled = unsettled.join(first, ["same", "doc_id"], "left").select("doc_id", "part", F.when(later, F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))
    return judged.filter("same IS NULL").select("doc_id", "part", "mask").unionByName(settled)


def mask_counts(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): additive counts of rows, of those of good quality and of toxic ones."""
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(one("quality"), one("toxic"))
    return masked.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("quality", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def audit(counts: DataFrame) -> DataFrame:
    """The rows of every part, order of the filters and step, from ``mask_counts``."""
    sets = range(1 << len(LETTERS))
    free = lambda name: F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) == 0, F.col(name)).otherwise(0)) for s in sets]).alias(name)
    single = [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(len(LETTERS))]
    parts = counts.groupBy("part").agg(free("n"), free("good"), free("toxic"), F.array(*single).alias("single"))
    shapley = [sum(weight(s) * (F.col("n")[s] - F.col("n")[s | 1 << i]) for s in sets if not s >> i & 1) for i in range(len(LETTERS))]
    parts = parts.withColumn("shapley", F.array(*shapley))
    rows = parts.withColumn("filter_order", F.explode(F.split(F.lit(",".join(ORDERS)), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    before = sum(F.when(F.instr("filter_order", c) < F.col("step"), 1 << i).otherwise(0) for i, c in enumerate(LETTERS))
    own = F.instr(F.lit(LETTERS), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    rows = rows.withColumns({"before": before, "own": own}).withColumn("bit", F.element_at(F.array(*[F.lit(1 << i) for i in range(len(LETTERS))]), F.col("own") + 1))
    rows = rows.withColumn("after", F.col("before") + F.col("bit"))
    lost = lambda name: F.col(name)[F.col("before")] - F.col(name)[F.col("after")]
    failing = F.col("n")[0] - F.col("n")[F.col("bit")]
    columns = {"kept": F.col("n")[F.col("after")], "removed": lost("n"), "redundant": failing - lost("n"), "unique_fails": F.col("single")[F.col("own")], "good_lost": lost("good"), "toxic_lost": lost("toxic"), "shapley": F.col("shapley")[F.col("own")]}
    return rows.select("part", "filter_order", "step", *[c.cast("long").alias(k) for k, c in columns.items()])


def weight(before: int) -> int:
    """Orders in which exactly the filters of the set ``before`` stand before a given other one."""
    n = before.bit_count()
    return math.factorial(n) * math.factorial(len(LETTERS) - 1 - n)


def filter_audit(docs: DataFrame, labels: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row for each part, order and step: rows kept and removed, redundant and unique failures, labels lost, and the
    removals of the step's filter summed over all orders."""
    return audit(mask_counts(masks(docs, most_bytes), labels))

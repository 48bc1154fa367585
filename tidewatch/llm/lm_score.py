"""Cross-entropy difference: how much more a target model expects a text than a background model does.

Two word-bigram models share one vocabulary, all distinct words of all documents and one class for unseen ones: the
background model counts all documents, the target model those named as target. A score never meets its own evidence: the
counts of the document that is scored are taken out of both models first, whether it is a target or not. A word's
probability after another is (pairs + mu * q) / (words before + mu), q = (words + alpha) / (tokens + alpha * classes) being
that of the word alone; both sum to one over the words, the class of unseen ones, and the end of a document, which follows
its last word and is not scored. The models are matched in size: background counts are scaled by the target's share of
all tokens, so that the same evidence weighs the same against mu and alpha in both. A document's score is the mean over its
words of target loss - background loss; the lower, the closer to the target.

Counts are exact (of 56-bit hashes of words and pairs), cover every document and are nowhere held as a whole:

* documents become shards of about ``SHARD_TOKENS`` tokens, one row each;
* every shard asks for its distinct words and pairs, with its own sums, by ranges of the hash (buckets);
* a bucket adds up what all shards sent and answers each of them. A key comes once from each shard, however frequent;
* each shard scores its documents with the answers.

Buckets grow in number with the corpus, not in size. A shard that has fewer than ``LEAST_KEYS`` keys for each of them would send
mostly headers, and rows for every shard and bucket grow with the square of the corpus; from there on (some 10^10 tokens)
shards send their keys as plain rows, which Spark adds up and joins by key, and the answers are packed by shard again.

Defined results: a null or wordless text has no tokens and null losses and score; a very long text is a shard of its own;
rows of null id are background only; repeated rows are counted as often as they stand there, and each is scored against
the others; words of equal frequency need no order; without target documents the target model is uniform; an empty table
gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Workspace, binary_column, rows_per_batch, words_of

MU = 20.0
ALPHA = 0.5
SHARD_TOKENS = 1 << 20
BUCKET_KEYS = 1 << 21
#: Keys that a shard sends to a bucket at least, on average; with fewer, keys travel as rows of their own.
LEAST_KEYS = 256
WORD_CACHE = 500_000
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Key rows of an Arrow batch.
ROWS_SENT = 1 << 16
#: Stands before the first word of a document.
START = np.uint64(0x27D4EB2F165667C5)
#: Bits of a key.
KEY_BITS = 56
#: Kinds of keys, in the order in which a shard lists them.
WORD, PAIR = 0, 1

_word_hashes: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> list[int]:
    import xxhash

    known, out = _word_hashes, []
    if len(known) > WORD_CACHE:
        known.clear()
    get, add = known.get, out.append
    for word in words:
        value = get(word)
        if value is None:
            value = known[word] = xxhash.xxh3_64_intdigest(word) >> 64 - KEY_BITS
        add(value)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * MIX[1]
    return x ^ (x >> np.uint64(32))


def squeeze(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def expand(packed: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), kind)


def planes(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    return squeeze(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def from_planes(packed: bytes) -> np.ndarray:
    found = expand(packed, "u1").reshape(8, -1)
    return np.ascontiguousarray(found.T).view("<u8").ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, as their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(from_planes(packed), dtype=np.uint64)


SHARD = "shard long, ids array<{id}>, sizes array<long>, words binary, tokens binary"


def shards_of(docs: DataFrame, shard_tokens: int) -> DataFrame:
    """Rows of about ``shard_tokens`` tokens: the documents' ids and sizes, the distinct word hashes, and each token's place
    among these."""
    import pyarrow as pa
    from pyspark import TaskContext

    names = [c.split()[0] for c in SHARD.split(", ")]

    def run(batches):
        partition, n_shards = TaskContext.get().partitionId(), 0
        ids, sizes, hashes, id_type = [], [], [], None

        def row(number):
            words, tokens = np.unique(np.concatenate([np.array(h, np.uint64) for h in hashes]), return_inverse=True)
            arrays = [
                pa.array([partition << 32 | number], pa.int64()),
                pa.array([ids], pa.list_(id_type)),
                pa.array([sizes], pa.list_(pa.int64())),
                pa.array([packed_keys(words)], pa.binary()),
                pa.array([squeeze(tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(arrays, names)

        held = 0
        for batch in batches:
            id_type = batch.schema.field("id").type
            for id_, text in zip(batch.column("id").to_pylist(), binary_column(batch, "text"), strict=True):
                own = word_hashes(words_of(text))
                if held and held + len(own) > shard_tokens:
                    yield row(n_shards)
                    ids, sizes, hashes, held, n_shards = [], [], [], 0, n_shards + 1
                ids.append(id_)
                sizes.append(len(own))
                hashes.append(own)
                held += len(own)
        if ids:
            yield row(n_shards)

    return docs.select("id", "text").mapInArrow(run, SHARD.format(id=docs.schema["id"].dataType.simpleString()))


class Shard:
    """The tokens of a shard, and its distinct words and pairs with the place of each token's own among them."""

    def __init__(self, sizes: np.ndarray, words: bytes, tokens: bytes, flags: list[int] | None):
        self.sizes = sizes
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.in_target = np.zeros(len(sizes), bool)
        self.in_target[flags or []] = True
        vocabulary = unpacked_keys(words)
        at = np.ascontiguousarray(expand(tokens, "u1").reshape(4, -1).T).view("<u4").ravel().astype(np.int32)
        ends = np.cumsum(sizes)
        self.starts = (ends - sizes)[sizes > 0]
        self.before = np.r_[np.int32(0), at[:-1]] if len(at) else at
        context = mixed(vocabulary * MIX[2])[self.before] if len(at) else np.zeros(0, np.uint64)
        context[self.starts] = START
        pairs, pair_at = np.unique(mixed(context + vocabulary[at] * MIX[0]) >> np.uint64(64 - KEY_BITS), return_inverse=True)
        #: Sorted keys of each kind, and each token's place among them.
        self.keys = [vocabulary, pairs]
        self.at = [at, pair_at.astype(np.int32)]

    def sums(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """How often each key stands in the shard, and in its target documents."""
        at, n = self.at[kind], len(self.keys[kind])
        return np.bincount(at, minlength=n), np.bincount(at[self.in_target[self.doc]], minlength=n)

    def own(self, kind: int, at: np.ndarray) -> np.ndarray:
        """How often a token's document holds the key at a place, for each token's place."""
        n = len(self.keys[kind])
        codes, counts = np.unique(self.doc.astype(np.int64) * n + self.at[kind], return_counts=True)
        return counts[np.searchsorted(codes, self.doc.astype(np.int64) * n + at)] if len(codes) else counts

    def losses(self, counts: list[tuple[np.ndarray, np.ndarray]], facts: dict, mu: float, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        """Mean target and background loss of each document; ``counts`` of each kind are those of all documents."""
        before = self.before.copy()
        before[self.starts] = self.at[WORD][self.starts]  # any word of the document; replaced below
        own = self.own(WORD, self.at[WORD]), self.own(WORD, before), self.own(PAIR, self.at[PAIR])
        n_own, flag = self.sizes[self.doc], self.in_target[self.doc]
        out = []
        for side, scale, less in ((1, 1.0, flag), (0, facts["scale"], np.True_)):
            n_tokens, n_docs = facts["tokens"][side], facts["docs"][side]
            given = counts[WORD][side][self.at[WORD]], counts[WORD][side][before], counts[PAIR][side][self.at[PAIR]]
            word, context, pair = (scale * (n - less * k) for n, k in zip(given, own, strict=True))
            if len(self.starts):
                context[self.starts] = scale * (n_docs - (less[self.starts] if side else 1))
            # Tokens include an end for each document, and classes the end and unseen words.
            alone = (word + alpha) / (scale * (n_tokens + n_docs - less * (n_own + 1)) + alpha * (facts["n_words"] + 2))
            loss = -np.log((pair + mu * alone) / (context + mu))
            out.append(np.bincount(self.doc, loss, len(self.sizes)) / np.maximum(self.sizes, 1))
        return out[0], out[1]


def shard_rows(batch):
    """The shards of an Arrow batch, with their number and ids."""
    for k in range(batch.num_rows):
        row = {c: batch.column(c)[k] for c in ("shard", "ids", "sizes", "words", "tokens", "flags")}
        sizes = np.array(row["sizes"].as_py(), np.int64)
        yield row["shard"].as_py(), row["ids"].values, sizes, Shard(sizes, row["words"].as_py(), row["tokens"].as_py(), row["flags"].as_py())


def flagged(shards: DataFrame, targets: DataFrame) -> DataFrame:
    """The shards with ``flags``, the places of their target documents. Only ids are shuffled to meet the targets."""
    named = targets.toDF("target_id").filter("target_id IS NOT NULL").distinct()
    places = shards.select("shard", F.posexplode("ids").alias("place", "target_id"))
    flags = places.join(named.hint("merge"), "target_id").groupBy("shard").agg(F.collect_list("place").alias("flags"))
    return shards.join(flags.hint("merge"), "shard", "left")


def bucket_edges(n_buckets: int) -> np.ndarray:
    """Keys at which the buckets after the first begin."""
    return np.array([(k << KEY_BITS) // n_buckets for k in range(1, n_buckets)], np.uint64)


def requests(shards: DataFrame, n_buckets: int) -> DataFrame:
    """(kind, bucket, shard, keys, n, n_target): what each shard holds and asks for, by ranges of the keys."""
    import pyarrow as pa

    def run(batches):
        edges = bucket_edges(n_buckets)
        for batch in batches:
            for number, _, _, shard in shard_rows(batch):
                rows = []
                for kind in (WORD, PAIR):
                    keys, (n, n_target) = shard.keys[kind], shard.sums(kind)
                    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                    for bucket, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        if b > a:
                            rows.append((kind, bucket, number, packed_keys(keys[a:b]), planes(n[a:b]), planes(n_target[a:b])))
                if rows:
                    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["kind", "bucket", "shard", "keys", "n", "n_target"])

    return shards.mapInArrow(run, "kind int, bucket int, shard long, keys binary, n binary, n_target binary")


def answers(asked: DataFrame) -> DataFrame:
    """(kind, bucket, shard, n, n_target): the sums over all shards of the keys that a shard asked for, in its order; and
    for each kind and bucket a row of shard null whose ``n_keys`` counts the distinct keys."""
    import pyarrow as pa

    def run(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        keys = [unpacked_keys(k) for k in table.column("keys").to_pylist()]
        ends = np.cumsum([len(k) for k in keys])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        out = []
        for column in ("n", "n_target"):
            sums = np.bincount(at, np.concatenate([from_planes(p) for p in table.column(column).to_pylist()]), len(distinct))[at]
            out.append([planes(sums[e - len(k) : e]) for e, k in zip(ends, keys, strict=True)] + [None])
        n = len(keys)
        columns = [pa.array([kind] * (n + 1), pa.int32()), pa.array([bucket] * (n + 1), pa.int32()), pa.array([*table.column("shard").to_pylist(), None], pa.int64())]
        return pa.table([*columns, pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array([None] * n + [len(distinct)], pa.int64())], ["kind", "bucket", "shard", "n", "n_target", "n_keys"])

    return asked.groupBy("kind", "bucket").applyInArrow(run, "kind int, bucket int, shard long, n binary, n_target binary, n_keys long")


def key_rows(shards: DataFrame) -> DataFrame:
    """(kind, key, shard, place, n, n_target): a row for each distinct key of a shard, with its place among them."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for number, _, _, shard in shard_rows(batch):
                for kind in (WORD, PAIR):
                    keys, (n, n_target) = shard.keys[kind], shard.sums(kind)
                    for a in range(0, len(keys), ROWS_SENT):
                        own = slice(a, a + ROWS_SENT)
                        size = len(keys[own])
                        columns = [np.full(size, kind, np.int32), keys[own].astype(np.int64), np.full(size, number, np.int64), np.arange(a, a + size, dtype=np.int32), n[own].astype(np.int64), n_target[own].astype(np.int64)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "key", "shard", "place", "n", "n_target"])

    return shards.mapInArrow(run, "kind int, key long, shard long, place int, n long, n_target long")


def row_answers(asked: DataFrame) -> DataFrame:
    """What ``answers`` gives, from ``key_rows``: one row for each kind and shard, and for each kind one of the distinct keys."""
    import pyarrow as pa

    sums = asked.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))
    met = asked.select("kind", "key", "shard", "place").join(sums.hint("merge"), ["kind", "key"])

    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("place").to_numpy())
        packed = [pa.array([planes(table.column(c).to_numpy()[order])], pa.binary()) for c in ("n", "n_target")]
        first = table.slice(0, 1)
        return pa.table([first.column("kind"), pa.array([0], pa.int32()), first.column("shard"), *packed, pa.array([None], pa.int64())], ["kind", "bucket", "shard", "n", "n_target", "n_keys"])

    shape = "kind int, bucket int, shard long, n binary, n_target binary, n_keys long"
    own = met.groupBy("shard", "kind").applyInArrow(pack, shape)  # a group is a shard's keys
    none = lambda kind: F.lit(None).cast(kind)
    distinct = sums.groupBy("kind").agg(F.count("*").alias("n_keys")).select("kind", F.lit(0).alias("bucket"), none("long").alias("shard"), none("binary").alias("n"), none("binary").alias("n_target"), "n_keys")
    return own.unionByName(distinct)


def scored(shards: DataFrame, facts: dict, mu: float, alpha: float) -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score) of shards with their ``answers``."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for k, (_, ids, sizes, shard) in enumerate(shard_rows(batch)):
                given = sorted(batch.column("answers")[k].as_py() or [], key=lambda a: (a["kind"], a["bucket"]))
                counts = []
                for kind in (WORD, PAIR):
                    own = [a for a in given if a["kind"] == kind]
                    counts.append(tuple(np.concatenate([from_planes(a[c]) for a in own] or [np.zeros(0)]).astype(float) for c in ("n", "n_target")))
                target, background = shard.losses(counts, facts, mu, alpha)
                empty = sizes == 0
                columns = [ids, pa.array(sizes, pa.int64()), *[pa.array(x, pa.float64(), mask=empty) for x in (target, background)]]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "target_loss", "background_loss"])

    id_type = shards.schema["ids"].dataType.elementType.simpleString()
    found = shards.mapInArrow(run, f"id {id_type}, n_tokens long, target_loss double, background_loss double")
    return found.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def cross_entropy_difference(
    docs: DataFrame,
    targets: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    mu: float = MU,
    alpha: float = ALPHA,
    shard_tokens: int = SHARD_TOKENS,
    bucket_keys: int = BUCKET_KEYS,
    least_keys: int = LEAST_KEYS,
) -> DataFrame:
    """Scores every row of ``docs``; ``targets`` has one column, the ids of the target documents."""
    spark = docs.sparkSession
    space = Workspace(spark)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shards = space.write(shards_of(own, shard_tokens), "token-shards")
    marked = space.write(flagged(shards, targets), "marked-shards")
    space.drop("token-shards")
    total = lambda column: F.sum(F.aggregate(column, F.lit(0).cast("long"), lambda s, x: s + x))
    in_target = F.filter(F.transform("flags", lambda i: F.get("sizes", i)), lambda n: n > 0)
    written = F.filter("sizes", lambda n: n > 0)
    sums = marked.agg(total(written).alias("n"), total(in_target).alias("n_target"), F.sum(F.size(written)).alias("docs"), F.sum(F.when(F.col("flags").isNotNull(), F.size(in_target))).alias("target_docs")).first()
    tokens, texts = [sums["n"] or 0, sums["n_target"] or 0], [sums["docs"] or 0, sums["target_docs"] or 0]
    n_buckets = max(1, -(-tokens[0] // bucket_keys))
    with rows_per_batch(spark, 1):  # a row is a whole shard
        if shard_tokens >= least_keys * n_buckets:
            given = space.write(answers(requests(marked, n_buckets)), "answers")
        else:
            given = space.write(row_answers(space.write(key_rows(marked), "key-rows")), "answers")
    n_words = given.filter(f"kind = {WORD}").agg(F.sum("n_keys")).first()[0] or 0
    facts = {"tokens": tokens, "docs": texts, "n_words": n_words, "scale": tokens[1] / tokens[0] if tokens[1] else 1.0}
    # All answers to one shard, as many bytes as its keys ask for.
    own_answers = given.filter("shard IS NOT NULL").groupBy("shard").agg(F.collect_list(F.struct("kind", "bucket", "n", "n_target")).alias("answers"))
    with rows_per_batch(spark, 1):
        out = space.write(scored(marked.join(own_answers.hint("merge"), "shard", "left"), facts, mu, alpha), "lm-scores")
    space.drop("marked-shards", "answers", "key-rows")
    return out.withColumnRenamed("id", id_col)

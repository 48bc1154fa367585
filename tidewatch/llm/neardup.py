"""Near duplicates by Order MinHash, verified by banded alignment.

A text's k-mers are its runs of five words, each labelled with its occurrence number. A sketch takes, under one of
``SKETCHES`` hash functions, the two smallest labelled k-mers and keeps them in the order in which the text has them, so
equal sketches speak for a small edit distance, not only for equal sets. One replaced word takes five k-mers away, which
is much of a short text; texts of up to 75 words therefore have as many sketches again over runs of two words, those of up to
15 words a third time over single words. A text may be a candidate of one that is a quarter longer, so both of a pair
whose shorter text has up to 60 (12) words have them. Texts that have ``SHARED`` equal sketches or more are candidates.
Two candidates are linked if, in the best alignment of their word sequences, the aligned words are at
least ``threshold`` of all (aligned / (both - aligned)); only alignments within the band that such a similarity allows are
computed. Classes are the connected components of the links.

Equal word sequences are one node throughout. The nodes with an equal sketch are a set. Classes need no more links than
connect them, so sets are settled in two rounds: first every node meets its set's hub, the node that stands in the largest
sets, as a text does that many others are edited copies of; then, in the sets that still hold several components, all
candidates of different components meet, in blocks of hashed nodes, block against block. A task that holds a cell of two
blocks compares bags of words before it aligns, skips what its own links have connected meanwhile, and returns links, not
pairs. No set is held by one task, and no candidate pair of different components stays open.

Defined results: texts without words are equal if they are the same text, null counting as empty; a text with fewer words
than a run has one k-mer of that kind; very long texts are sketched and aligned whole; a class is named by
its smallest id, null if all its ids are null; repeated rows are one node; ties between hubs go to the smaller node; an
empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Workspace, binary_column, words_of

K = 5
SKETCHES = 32
THRESHOLD = 0.8
#: Further k-mers of short texts: runs of so many words, in texts of up to so many words.
SHORTER = ((2, 75), (1, 15))
#: Equal sketches of two candidates. Of pairs whose k-mers have a similarity of 0.8 one in 10 ** 12 has fewer; of pairs of more
#: than 60 words with one word in ten replaced, 4 in 100.
SHARED = 2
#: Rows of a block of a large set, and pairs of rows that are held at once.
BLOCK = 1_024
HELD_PAIRS = 200_000
WORD_CACHE = 100_000
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)
SEEDS = np.random.default_rng(20).integers(1, 2**63, SKETCHES, dtype=np.uint64)
#: Hash values that are held at once.
WIDE = 1 << 18
STEPS = 1_024

_word_hashes: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    known, out = _word_hashes, []
    if len(known) > WORD_CACHE:
        known.clear()
    get, add = known.get, out.append
    for word in words:
        value = get(word)
        if value is None:
            value = known[word] = xxhash.xxh32_intdigest(word)
        add(value)
    return np.array(out, np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * MULTIPLIERS[1]
    return x ^ (x >> np.uint64(32))


def kmers(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit value for each run of ``k`` words; one for a shorter text, none for an empty one."""
    values = hashes.astype(np.uint64) + np.uint64(1)
    if 0 < len(values) < k:
        values = np.pad(values, (0, k - len(values)))
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = mixed((total + values[i : i + n]) * MULTIPLIERS[i])
    return total


def labelled(grams: np.ndarray) -> np.ndarray:
    """K-mers mixed with their occurrence number in the text."""
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    if new.all():
        return grams
    at = np.arange(len(grams))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty_like(grams)
    out[order] = np.where(nth > 0, mixed(ordered + nth.astype(np.uint64) * MULTIPLIERS[3]), ordered)
    return out


def sketches(grams: np.ndarray) -> np.ndarray:
    """SKETCHES 64-bit values: the two smallest labelled k-mers under each hash function, in text order."""
    own = labelled(grams)
    pairs = np.zeros((SKETCHES, 2), int)
    if len(own) > 1:
        rows_at_once = max(1, WIDE // len(own))
        for start in range(0, SKETCHES, rows_at_once):
            values = mixed(own[None, :] ^ SEEDS[start : start + rows_at_once, None])
            at, first = np.arange(len(values)), values.argmin(1)
            values[at, first] = np.iinfo(np.uint64).max
            pairs[start : start + rows_at_once] = np.stack([first, values.argmin(1)], 1)
    pairs.sort(1)
    return mixed(own[pairs[:, 0]] * MULTIPLIERS[2] + own[pairs[:, 1]] + SEEDS).view(np.int64)


def text_sketches(hashes: np.ndarray) -> np.ndarray:
    """The sketches of a text's word hashes: SKETCHES of them for each kind of k-mers that a text of its length has."""
    kinds = [K, *[k for k, most in SHORTER if len(hashes) <= most]]
    return np.concatenate([sketches(kmers(hashes, k)) for k in kinds]) if len(hashes) else np.zeros(0, np.int64)


def shared_sketches(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    return int((a[:n] == b[:n]).sum())


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence of a and b among alignments that shift by at most ``band``.

    Bit-parallel over the positions of ``a``; positions that the band has left behind are counted and dropped."""
    symbols, wanted = a.tolist(), b.tolist()
    low, state, width, found = 0, 0, 0, 0
    for start in range(0, len(wanted), STEPS):
        stop = min(start + STEPS, len(wanted))
        new_low = max(low, min(start - band, len(symbols)))
        if new_low > low:
            drop = new_low - low
            found += drop - (state & ((1 << drop) - 1)).bit_count()
            state >>= drop
            low, width = new_low, width - drop
        high = min(len(symbols), stop + band)
        if high - low > width:
            state |= ((1 << (high - low - width)) - 1) << width
            width = high - low
        places: dict[int, int] = {}
        for i in range(low, high):
            places[symbols[i]] = places.get(symbols[i], 0) | 1 << (i - low)
        full, window = (1 << width) - 1, (1 << (2 * band + 1)) - 1
        for j in range(start, stop):
            match = places.get(wanted[j])
            if match:
                shift = j - band - low
                match &= window << shift if shift >= 0 else window >> -shift
                hit = state & match
                state = ((state + hit) | (state - hit)) & full
    return found + width - state.bit_count()


def bag(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words, sorted, and how often each stands."""
    ordered = np.sort(words)
    starts = np.nonzero(np.r_[True, ordered[1:] != ordered[:-1]])[0] if len(ordered) else np.zeros(0, int)
    return ordered[starts], np.diff(np.r_[starts, len(ordered)])


def common_words(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Size of the intersection of two bags, which no alignment exceeds."""
    if not len(a[0]) or not len(b[0]):
        return 0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    return int(np.minimum(a[1][at], b[1])[a[0][at] == b[0]].sum())


def similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Aligned words as a share of all words of both, or 0 where it is surely below ``threshold``."""
    total = len(a) + len(b)
    if not total:
        return 0.0
    need = int(np.ceil(threshold / (1 + threshold) * total - 1e-9))
    short = min(len(a), len(b))
    if short < need:
        return 0.0
    differ = np.nonzero(a[:short] != b[:short])[0]
    head = int(differ[0]) if len(differ) else short
    differ = np.nonzero(a[::-1][: short - head] != b[::-1][: short - head])[0]
    tail = int(differ[0]) if len(differ) else short - head
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if head + tail + common_words(bag(a), bag(b)) < need:
        return 0.0
    common = head + tail + (aligned(a, b, total - 2 * need) if len(a) and len(b) else 0)
    return common / (total - common) if common >= need else 0.0


def content_key(words: list[bytes], text: bytes | None) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(b" ".join(words) if words else b"\0" + (text or b""))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, text_hash, node, n, sketch) of rows (id, text, text_hash); the node stands for the word sequence."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            nodes, sizes, found = [], [], []
            for text in binary_column(batch, "text"):
                words = words_of(text)
                nodes.append(content_key(words, text))
                sizes.append(len(words))
                found.append(text_sketches(word_hashes(words)))
            arrays = [batch.column("id"), batch.column("text_hash"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "text_hash", "node", "n", "sketch"])

    return docs.mapInArrow(run, "id long, text_hash long, node binary, n int, sketch array<long>")


def set_rows(contents: DataFrame, space: Workspace) -> DataFrame:
    """(sketch_no, key, node, n_set) of the sets of several nodes with an equal sketch."""
    spread = contents.filter("n > 0").select("node", F.posexplode("sketch").alias("sketch_no", "key"))
    sets = spread.groupBy("sketch_no", "key").agg(F.count("*").alias("n_set")).filter("n_set > 1")
    return spread.join(space.write(sets, "sets"), ["sketch_no", "key"])


def hashed_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, n, sketch, words) of the wanted nodes (node, rep, rep_hash, n, sketch): 32-bit hashes of the words, from the
    rows whose id is ``rep`` and whose text's hash is ``rep_hash``. A text has one node, so a row meets one at most."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            nodes, packed = [], []
            for text in binary_column(batch, "text"):
                words = words_of(text)
                nodes.append(content_key(words, text))
                packed.append(word_hashes(words).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(packed, pa.binary()), *[batch.column(c) for c in ("node", "n", "sketch")]], ["own", "words", "node", "n", "sketch"])

    rows = docs.join(wanted, F.col("id").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))).select("text", "node", "n", "sketch")
    return rows.mapInArrow(run, "own binary, words binary, node binary, n int, sketch array<long>").filter("own = node").select("node", "n", "sketch", "words").dropDuplicates(["node"])


def hub_pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of each node and the hub of each of its sets; of equal weights, the smaller node's is more."""
    weighted = rows.join(rows.groupBy("node").agg(F.sum("n_set").alias("weight")), "node")
    hubs = weighted.groupBy("sketch_no", "key").agg(F.min(F.struct(-F.col("weight"), F.col("node"))).alias("hub"))
    both = rows.join(hubs.select("sketch_no", "key", F.col("hub.node").alias("hub")), ["sketch_no", "key"]).filter("node <> hub")
    return both.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def close_pairs(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes that share SHARED sketches and whose lengths allow the threshold."""
    sides = [texts.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in ("a", "b")]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    shared = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))), F.lit(0), lambda x, y: x + y)
    return both.filter((F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9) & (shared >= SHARED)).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) whose alignment reaches the threshold."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            found = []
            for left, right in zip(batch.column("words_a").to_pylist(), batch.column("words_b").to_pylist(), strict=True):
                found.append(similarity(np.frombuffer(left, "<u4"), np.frombuffer(right, "<u4"), threshold))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], ["a", "b", "similarity"])

    sides = [texts.select(F.col("node").alias(c), F.col("words").alias(f"words_{c}")) for c in ("a", "b")]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "words_a", "words_b")
    return both.mapInArrow(run, "a binary, b binary, similarity double").filter(F.col("similarity") >= threshold)


def mixed_set_rows(rows: DataFrame, roots: DataFrame, space: Workspace) -> DataFrame:
    """The rows, with their root, of the sets that hold nodes of several roots."""
    rooted = space.write(rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted-rows")
    several = rooted.groupBy("sketch_no", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    return rooted.join(several.select("sketch_no", "key"), ["sketch_no", "key"])


class Cell:
    """Rows of two blocks of a set (or of one), and the candidates among them."""

    def __init__(self, table, threshold: float):
        self.no, i, j = (int(table.column(c)[0].as_py()) for c in ("sketch_no", "i", "j"))
        self.one_block, self.threshold = i == j, threshold
        self.own, self.n = (table.column(c).to_numpy() for c in ("own", "n"))
        self.root = table.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
        lists = table.column("sketch").combine_chunks()
        sizes = lists.value_lengths().to_numpy().astype(int)
        # Sketches that a longer text does not have are equal to no other.
        self.sketch = -1 - np.arange(len(sizes))[:, None].repeat(sizes.max(), 1)
        self.sketch[np.arange(sizes.max()) < sizes[:, None]] = lists.flatten().to_numpy()

    def candidates(self):
        """Arrays of rows x and y of different roots, and in cells of two blocks of different blocks. Rows meet where a
        further sketch is equal, and a pair is given by the first two sketches that it shares, so by one set and once."""
        for other in range(self.no + 1, self.sketch.shape[1]):
            at = np.argsort(self.sketch[:, other], kind="stable")
            values, back = self.sketch[at, other], 1
            left = np.arange(len(at))
            while True:
                left = left[left + back < len(at)]
                left = left[values[left] == values[left + back]]
                if not len(left):
                    break
                for start in range(0, len(left), HELD_PAIRS):
                    x = at[left[start : start + HELD_PAIRS]]
                    y = at[left[start : start + HELD_PAIRS] + back]
                    fit = (self.root[x] != self.root[y]) & (self.one_block | (self.own[x] != self.own[y]))
                    fit &= np.minimum(self.n[x], self.n[y]) >= self.threshold * np.maximum(self.n[x], self.n[y]) - 1e-9
                    x, y = x[fit], y[fit]
                    same = self.sketch[x, : other + 1] == self.sketch[y, : other + 1]
                    fit = (same.argmax(1) == self.no) & (same.sum(1) == SHARED)
                    yield x[fit], y[fit]
                back += 1

    def links(self, words: list[bytes]):
        """Pairs of rows with a similarity of the threshold or more, as many as connect what the cell can connect."""
        texts = [np.frombuffer(w, "<u4") for w in words]
        bags: dict[int, tuple] = {}
        above = list(range(int(self.root.max()) + 1))

        def top(r):
            while above[r] != r:
                above[r] = r = above[above[r]]
            return r

        def bag_of(p):
            if p not in bags:
                bags[p] = bag(texts[p])
            return bags[p]

        share = self.threshold / (1 + self.threshold)
        for x, y in self.candidates():
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                r, s = top(self.root[p]), top(self.root[q])
                if r != s and common_words(bag_of(p), bag_of(q)) >= share * (len(texts[p]) + len(texts[q])) - 1e-9 and similarity(texts[p], texts[q], self.threshold):
                    above[r] = s
                    yield p, q


CELL = "sketch_no int, key long, i int, j int, own int, n int, node binary, root binary, sketch array<long>"


def by_cell(rows: DataFrame, names: list[str], schema: str, found) -> DataFrame:
    """What ``found`` (a table of one cell to a record batch) gives for each cell (sketch_no, key, i, j) of the rows."""
    import pyarrow as pa

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch.select(names)])
            table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
            columns = [table.column(c).to_numpy() for c in ("sketch_no", "key", "i", "j")]
            cuts = np.nonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)])[0].tolist()
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                yield found(table.slice(start, stop - start))
            rest = table.slice(cuts[-1])  # the last cell may go on in the next batch
        if rest is not None:
            yield found(rest)

    cell = ["sketch_no", "key", "i", "j"]
    return rows.select(*names).repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, schema)


def candidate_rows(rows: DataFrame, texts: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """The rows of mixed sets, dealt to cells, that have a candidate of another root in their cell."""
    import pyarrow as pa

    names = [c.split()[0] for c in CELL.split(", ")]
    n_blocks = F.ceil(F.col("n_set") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), n_blocks).cast("int")
    dealt = rows.join(texts.select("node", "n", "sketch"), "node").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def found(table):
        keep = np.zeros(table.num_rows, bool)
        for x, y in Cell(table, threshold).candidates():
            keep[x] = keep[y] = True
        return table.combine_chunks().to_batches()[0].filter(pa.array(keep))

    return by_cell(dealt, names, CELL, found)


def links_across(rows: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of links between different roots that connect what the candidates of the rows' cells connect."""
    import pyarrow as pa

    names = [*[c.split()[0] for c in CELL.split(", ")], "words"]

    def found(table):
        nodes = table.column("node").to_pylist()
        met = [sorted((nodes[p], nodes[q])) for p, q in Cell(table, threshold).links(table.column("words").to_pylist())]
        return pa.RecordBatch.from_arrays([pa.array([m[k] for m in met], pa.binary()) for k in (0, 1)], ["a", "b"])

    return by_cell(rows.join(texts.select("node", "words"), "node"), names, "a binary, b binary", found)


def components(links: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(node, root) of all linked nodes: the smallest node of their component, as a table ``name``. Each round takes the smallest label among
    neighbours and then that label's own label; hot partitions of both joins are split at run time."""
    edges = links.select("a", "b").union(links.select("b", "a"))
    labels = space.write(edges.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), name)
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        new = space.write(lower.join(jump, F.col("low") == F.col("at")).select("node", "old", F.least("low", "further").alias("label")), name)
        space.drop(f"{name}*")
        if not new.filter("label <> old").limit(1).count():
            return new.select("node", F.col("label").alias("root"))
        labels = new.select("node", "label")


def merged_roots(roots: DataFrame, links: DataFrame, space: Workspace) -> DataFrame:
    """The roots (node, root) after further links between nodes, joined at the level of roots."""
    own = [roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b")]
    lifted = links.join(own[0], "a", "left").join(own[1], "b", "left")
    lifted = space.write(lifted.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).filter("a <> b").distinct(), "root-links")
    found = components(lifted, space, "root-labels").select(F.col("node").alias("old"), F.col("root").alias("new"))
    known = roots.unionByName(found.select(F.col("old").alias("node"), F.col("old").alias("root")).join(roots.select("node"), "node", "left_anti"))
    return space.write(known.join(found, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")), "roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document row: id, text_hash, class_id (smallest id of the class), class_size (rows) and is_first (the row, or
    its equals, that stands for the class)."""
    space = Workspace(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    prints = space.write(fingerprints(rows), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), F.col("id"), F.col("text_hash"))).alias("first")
    grouped = prints.groupBy("node").agg(first, F.count("*").alias("copies"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch"))
    contents = space.write(grouped.select("node", F.col("first.id").alias("rep"), F.col("first.text_hash").alias("rep_hash"), "copies", "n", "sketch"), "contents")
    in_sets = space.write(set_rows(contents, space), "set-rows")
    wanted = contents.join(in_sets.select("node").distinct(), "node", "left_semi").select("node", "rep", "rep_hash", "n", "sketch")
    texts = space.write(hashed_words(rows, wanted), "texts")
    pairs = space.write(close_pairs(hub_pairs(in_sets), texts, threshold), "pairs")
    links = space.write(verified(pairs, texts, threshold), "links")
    roots = components(links, space, "labels")
    mixed = space.write(candidate_rows(mixed_set_rows(in_sets, roots, space), texts, threshold), "candidate-rows")
    more = space.write(links_across(mixed, texts, threshold), "links")
    if more.limit(1).count():
        roots = merged_roots(roots, more, space)
    rooted = contents.select("node", "rep", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = space.write(rooted, "rooted-nodes")
    first = F.min(F.struct(F.col("rep").isNull().alias("unnamed"), F.col("rep").alias("id"), "node")).alias("first")
    classes = named.groupBy("root").agg(first, F.sum("copies").alias("class_size"))
    nodes = space.write(named.select("node", "root").join(classes, "root").select("node", "first", "class_size"), "node-classes")
    keys = space.write(prints.select("id", "text_hash", "node"), "keys")
    space.drop("fingerprints", "contents", "sets", "set-rows", "texts", "pairs", "links", "roots", "root-links", "labels", "root-labels", "rooted-rows", "candidate-rows", "rooted-nodes")
    joined = keys.join(nodes, "node")
    is_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("node") == F.col("first.node"))
    return joined.select(F.col("id").alias(id_col), "text_hash", F.col("first.id").alias("class_id"), "class_size", is_first.alias("is_first"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with the columns of ``docs``: that of the smallest id."""
    kept = near_duplicates(docs, id_col, text_col, threshold).filter("is_first").select(F.col(id_col).alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    kept = Workspace(docs.sparkSession).write(kept, "kept-rows")
    hashed = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), F.col(id_col).cast("long").alias("own_id"), F.xxhash64(text_col).alias("own_hash"))
    met = hashed.join(kept, F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_hash") == F.col("kept_hash")), "left_semi")
    once = met.dropDuplicates(["own_id", "own_hash"])
    return once.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])

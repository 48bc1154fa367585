"""Near-duplicate comments of one content, their clusters, and digests of a user's texts.

Texts are compared by the matching-blocks ratio of the standard library, 2 * matches / total length, after
``preprocess``, whole. Equal texts are one representative. All pairs of representatives of a content at the threshold are
found, at every length: they are written once to the shared folder as blocks in order of length, and a task reads those pairs of
blocks whose lengths fit from there, so no text is copied or shuffled for each block it meets; only similar pairs leave a task.

The ratio starts a block only at characters that make up at most about 1 in 100 of the later text, if that has 200 characters or
more (its seeds; a block at the very start of both texts needs none). Seeds cut the later text into gaps, and what is matched of a gap
hangs on the seed before it or on the one behind it. If the earlier text does not have the seed with the next h characters, less than h
of the gap are matched from there; likewise from the other end. So at most the seeds, 2 * (h - 1) characters of each gap, and
the rest of those gaps are matched whose runs the earlier text has. For each later text h is taken as large as that sum without any such gap
stays below what the threshold asks for; then few runs are looked up, they are long and rare, and the pairs that have none or too few in
common are never touched (``Index``, ``Later``).

Later texts that are shorter, or so full of seeds that no h is left, are compared with all others of fitting lengths. Before the ratio
come bounds that no pair at the threshold fails, for those pairs and for what the runs leave:

* lengths, min / max >= t / (2 - t), and the characters that two texts have in common;
* runs of q characters in common. Two texts of total length T at the threshold match M >= t * T / 2 characters in at most
  K blocks, and a block of s characters holds s - q + 1 runs, so they share M - (q - 1) * K runs or more. Between two blocks
  a character stays unmatched, so K <= T - 2 * M + 1; and if the later text has 200 characters or more, the ratio starts
  blocks only at characters that make up at most about 1 in 100 of it, so K is at most their common number and one more (a block
  at the very start). Shared runs are bounded from above for all pairs of two sub-blocks at once, by a product of matrices
  of hashed counts, at first with all the starting places of the later text as K, then counted pair by pair;
* the longest common subsequence.

Clusters are the connected components of the pairs found.
"""

from __future__ import annotations

import bisect
import difflib
import functools
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.text import any_hit, preprocess, topic_runs
from tidewatch.operators.graph import components
from tidewatch.sources.storage import Workspace, written

MIN_LENGTH = 5
#: From this length of the later text on, the ratio starts no block at its frequent characters.
JUNK_FROM = 200
#: Columns of the character bags; several characters may share one.
BAG = 64
#: Lengths of the runs whose shared numbers are bounded, in their order for short and for long texts, and from which length on a
#: text is long; the hashed counts have about four columns for each character, eight for long texts.
RUNS, LONG_RUNS, LONG = (8, 5, 2, 12), (12, 8, 5, 2), 4_000
LEAST_COLUMNS, MOST_COLUMNS = 1_024, 262_144
#: Rows of a sub-block at most, and numbers of the matrix of its hashed counts; such matrices that a block holds; share of a
#: sub-block's pairs below which they are compared one by one.
SUB, HELD, MATRICES, FEW = 256, 1 << 22, 10, 0.002
#: Texts of up to so many characters are compared by their subsequences for many pairs at once.
PACKED = 512
#: Most rows of a block, and characters of a piece of it that is held at once.
BLOCK, PIECE = 2_048, 4_000_000
#: Characters behind or before a seed that a run may have; the share of what a pair needs that its shared runs must bring; and the share
#: of a piece from which on a character's runs are not indexed.
FLANKS, BROUGHT, COMMON = (1, 2, 3, 4, 5, 6, 8, 10, 13, 17, 24, 40), 0.1, 0.02
#: Characters of later texts at once, and pairs or shared runs that are added up at once.
AHEAD, ADDED = 2_000_000, 1 << 22
#: Places of two texts that match and are looked at together.
MATCHED = 1 << 18
#: Characters of the pairs of a lot that one task checks, and pairs of a batch of rows.
CHECKED, SENT = 2_000_000, 50_000
#: The code of the place before each text, that of a character is one more than its own; the odd factor of the hashes.
MARK, FACTOR = 0, 0x9E3779B97F4A7C15


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * matches / total length of two texts, the earlier one first."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def bodies(comments: DataFrame) -> DataFrame:
    """(content_id, comment_id, seq, key, body) of the comments that are long enough to compare; the key stands for the body."""
    body = preprocess(F.col("text"))
    rows = comments.select("content_id", "comment_id", "seq", body.alias("body")).filter(F.length("body") >= MIN_LENGTH)
    return rows.withColumn("key", F.md5(F.encode("body", "UTF-8")))


def representatives(rows: DataFrame) -> DataFrame:
    """(content_id, key, body, rep, seq, copies): the first comment of each compared text, from ``bodies``."""
    return rows.groupBy("content_id", "key", "body").agg(F.min_by("comment_id", "seq").alias("rep"), F.min("seq").alias("seq"), F.count("*").alias("copies"))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def character_bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of characters by code modulo BAG, of all and of those at which the ratio starts blocks in a later text; the
    overlap of two rows is at least that of the texts' characters."""
    bags, seeds = np.zeros((len(texts), BAG), np.int32), np.zeros((len(texts), BAG), np.int32)
    for row, seed, text in zip(bags, seeds, texts, strict=True):
        codes, counts = np.unique(codes_of(text), return_counts=True)
        np.add.at(row, codes % BAG, counts)
        kept = counts <= len(text) // 100 + 1 if len(text) >= JUNK_FROM else np.ones(len(counts), bool)
        np.add.at(seed, codes[kept] % BAG, counts[kept])
    return bags, seeds


def run_hashes(text: str, q: int) -> np.ndarray:
    """A 64-bit value for each run of ``q`` characters."""
    codes = codes_of(text).astype(np.uint64)
    out = np.zeros(max(0, len(codes) - q + 1), np.uint64)
    for i in range(q):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(out)]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return out ^ (out >> np.uint64(29))


class Block:
    """Texts of a content with what the bounds need of them. Rows are in order of length, so that sub-blocks whose lengths are too
    far apart are passed over; ``ranks`` tell which text of a pair is the later one."""

    def __init__(self, texts: list[str], ranks: np.ndarray):
        order = np.lexsort((ranks, [len(t) for t in texts]))
        self.texts, self.ranks = [texts[k] for k in order], ranks[order]
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        step = min(SUB, max(16, HELD // columns_for(max(map(len, texts), default=1))))
        self.cuts = [np.arange(k, min(k + step, len(texts))) for k in range(0, len(texts), step)]
        self.columns: dict[tuple[int, int], np.ndarray] = {}
        self.counts: dict[tuple[int, int, int], np.ndarray] = {}
        self.runs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    @functools.cached_property
    def of_characters(self) -> tuple[np.ndarray, np.ndarray]:
        return character_bags(self.texts)

    @property
    def bags(self) -> np.ndarray:
        return self.of_characters[0]

    @property
    def seeds(self) -> np.ndarray:
        return self.of_characters[1]

    @functools.cached_property
    def starts(self) -> np.ndarray:
        return self.seeds.sum(1)

    def columns_of(self, i: int, q: int) -> np.ndarray:
        if (i, q) not in self.columns:
            self.columns[i, q] = (run_hashes(self.texts[i], q) & np.uint64(MOST_COLUMNS - 1)).astype(np.uint32)
        return self.columns[i, q]

    def matrix(self, rows: np.ndarray, q: int, width: int) -> np.ndarray:
        key = int(rows[0]), q, width
        if key not in self.counts:
            if len(self.counts) >= MATRICES:
                del self.counts[next(iter(self.counts))]
            out = self.counts[key] = np.empty((len(rows), width), np.float32)
            for k, i in enumerate(rows.tolist()):
                out[k] = np.bincount(self.columns_of(i, q) & np.uint32(width - 1), minlength=width)
        return self.counts[key]

    def runs_of(self, i: int, q: int) -> tuple[np.ndarray, np.ndarray]:
        if (i, q) not in self.runs:
            if len(self.runs) > 4 * SUB:
                self.runs.clear()
            self.runs[i, q] = np.unique(run_hashes(self.texts[i], q), return_counts=True)
        return self.runs[i, q]


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the texts one after the other, a mark before each and behind the last, and the places of the marks."""
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    codes = codes_of("\0" + "\0".join(texts) + "\0").astype(np.int64) + 1
    codes[starts] = MARK
    return codes, starts


def powers(size: int, known: list[np.ndarray] = []) -> list[np.ndarray]:  # noqa: B006
    """Powers of the factor and of its inverse modulo 2 ** 64, ``size`` at least; they are kept."""
    if not known or size > len(known[0]):
        rows = np.full((2, max(1 << 16, 1 << (size - 1).bit_length())), 1, np.uint64)
        rows[:, 1:] = np.array([[FACTOR], [pow(FACTOR, -1, 1 << 64)]], np.uint64)
        known[:] = np.multiply.accumulate(rows, 1)
    return known


def mixed(hashes: np.ndarray, before: bool) -> np.ndarray:
    """Hashes of runs that stand behind or before a character, spread over all bits."""
    out = (hashes ^ (hashes >> np.uint64(32)) ^ np.uint64(before)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return out ^ (out >> np.uint64(29))


class Index:
    """Runs of texts at their rarer characters: a table for each number of characters behind or before them, of hashes whose last bits
    are the text's row."""

    def __init__(self, texts: list[str]):
        codes, self.starts = joined(texts)
        factors, self.inverse = powers(len(codes))
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes.astype(np.uint64) * factors[: len(codes)], out=self.sums[1:])
        self.anchor = np.bincount(codes) <= COMMON * len(codes)
        self.anchor[MARK] = True
        self.at = np.flatnonzero(self.anchor[codes[:-1]])
        self.row = np.searchsorted(self.starts, self.at, "right") - 1
        self.low = np.uint64((1 << max(1, (len(texts) - 1).bit_length())) - 1)
        self.tables: dict[int, np.ndarray] = {}

    def has(self, codes: np.ndarray) -> np.ndarray:
        """Whether runs at these characters are indexed."""
        return (codes >= len(self.anchor)) | self.anchor[np.minimum(codes, len(self.anchor) - 1)]

    def runs(self, start: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the runs from there on: sums of the codes times powers of the factor."""
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]

    def table(self, h: int) -> np.ndarray:
        if h not in self.tables:
            behind, before = self.at + h < self.starts[self.row + 1], self.at - h > self.starts[self.row]
            found = [mixed(self.runs(self.at[behind], h + 1), False) & ~self.low | self.row[behind].astype(np.uint64)]
            found.append(mixed(self.runs(self.at[before] - h, h + 1), True) & ~self.low | self.row[before].astype(np.uint64))
            table = np.sort(np.concatenate(found))
            self.tables[h] = table[np.diff(table, prepend=~table[:1]) != 0]
        return self.tables[h]

    def rows(self, h: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hash where its rows begin in the table, and their number."""
        table, keys = self.table(h), hashes & ~self.low
        first = np.searchsorted(table, keys)
        found = np.flatnonzero(table[np.minimum(first, len(table) - 1)] & ~self.low == keys) if len(table) else first[:0]
        n = np.zeros(len(keys), np.int64)
        n[found] = np.searchsorted(table, keys[found] | self.low, "right") - first[found]
        return first, n


class Later:
    """Texts of JUNK_FROM characters or more as the later ones of pairs: their seeds and the gaps between them."""

    def __init__(self, texts: Texts):
        self.lengths, self.ranks = texts.lengths, texts.ranks
        self.codes, starts = joined(texts.texts)
        seed = np.ones(len(self.codes) - 1, bool)  # the marks are seeds, too
        for first, last in zip((starts[:-1] + 1).tolist(), starts[1:].tolist(), strict=True):
            own = self.codes[first:last]
            seed[first:last] = np.bincount(own)[own] <= (last - first) // 100 + 1
        self.at = np.flatnonzero(seed)
        self.row = np.searchsorted(starts, self.at, "right") - 1
        self.next = np.append(self.at[1:], len(self.codes) - 1)
        self.gaps, self.last = self.next - self.at - 1, self.codes[self.next] == MARK
        self.seeds = np.bincount(self.row, minlength=len(self.lengths)) - 1

    def runs(self, start: np.ndarray, length: int) -> np.ndarray:
        """The same hashes as those of an index."""
        out = np.zeros(len(start), np.uint64)
        for k in range(length - 1, -1, -1):
            out = out * np.uint64(FACTOR) + self.codes[start + k].astype(np.uint64)
        return out

    def run_ends(self, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the run behind the seed before a gap begins and where that before the next seed ends: at that character of the gap which
        is nearest to the seed and indexed, mostly at the seed itself; and whether there are such characters."""
        begin, end = self.at.copy(), self.next.copy()
        known = index.has(self.codes[self.at]), self.last | index.has(self.codes[self.next])
        other = np.flatnonzero(~(known[0] & known[1]) & (self.gaps > 0))
        sizes = self.gaps[other]
        place = np.repeat(self.at[other] + 1 - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        own, has = np.cumsum(sizes) - sizes, index.has(self.codes[place])
        if len(other):
            inner = np.minimum.reduceat(np.where(has, place, len(self.codes)), own), np.maximum.reduceat(np.where(has, place, -1), own)
            begin[other] = np.where(known[0][other], begin[other], inner[0])
            end[other] = np.where(known[1][other], end[other], inner[1])
        return begin, end, (begin < self.next) & (end > self.at)

    def candidates(self, texts: Texts, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows for which no run is short enough, and of the others (row of the indexed texts, own row) of the pairs that may reach the
        threshold and whose later text is the own one."""
        index, lengths, n = texts.index, texts.lengths, self.lengths
        need = t * (n + np.maximum(lengths[0], np.ceil(n * t / (2 - t) - 1e-9))) / 2
        begin, end, open_ = self.run_ends(index)
        apart = (begin - self.at) + (self.next - end)

        def unshared(h: int) -> np.ndarray:
            """Characters of a gap that are matched at most if its runs are not shared; nothing hangs on a text's end."""
            return np.where(open_, np.minimum(self.gaps, apart + np.where(self.last, 1, 2) * (h - 1)), self.gaps)

        taken, matched = np.zeros(len(n), np.int64), np.zeros(len(n))
        for h in FLANKS:
            most = self.seeds + np.bincount(self.row, unshared(h), len(n))
            good = most <= need * (1 - BROUGHT) if h > 1 else most < need - 1e-6
            taken[good], matched[good] = h, most[good]
        brought = np.zeros(len(n) * len(lengths))
        for h in np.unique(taken[taken > 0]).tolist():
            more = self.gaps - unshared(h)
            k = np.flatnonzero((taken[self.row] == h) & (more > 0))
            inner = k[~self.last[k]]
            hashes = np.concatenate([mixed(self.runs(begin[k], h + 1), False), mixed(self.runs(end[inner] - h, h + 1), True)])
            order = np.argsort(hashes)
            gap, (first, many) = np.concatenate([k, inner])[order], index.rows(h, hashes[order])
            gap, first, many = gap[many > 0], first[many > 0], many[many > 0]
            for part in np.split(np.arange(len(many)), np.flatnonzero(np.diff(np.cumsum(many) // ADDED)) + 1):
                m = many[part]
                place = np.repeat(first[part] - np.cumsum(m) + m, m) + np.arange(m.sum())
                cell = np.repeat(self.row[gap[part]] * len(lengths), m) + (index.table(h)[place] & index.low).astype(np.int64)
                np.add.at(brought, cell, np.repeat(more[gap[part]].astype(np.float64), m))
        possible = brought.reshape(len(n), len(lengths)) >= (need - matched - 1e-6)[:, None]
        j, i = np.nonzero(possible & (taken > 0)[:, None])
        fit = (texts.ranks[i] < self.ranks[j]) & (np.minimum(n[j], lengths[i]) * (2 - t) >= t * np.maximum(n[j], lengths[i]) - 1e-9)
        fit &= brought[j * len(lengths) + i] + matched[j] >= t * (n[j] + lengths[i]) / 2 - 1e-6
        return np.flatnonzero(taken == 0), i[fit], j[fit]


def columns_for(longest: int) -> int:
    """Columns of the hashed counts of texts of up to so many characters, a power of two."""
    return min(MOST_COLUMNS, max(LEAST_COLUMNS, 1 << ((8 if longest >= LONG else 4) * longest - 1).bit_length()))


def common_subsequences(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of the pairs a[i], b[j], all at once: the bits of a text of ``a`` lie in several
    words, and its pairs take the characters of their texts of ``b`` one by one."""
    known, coded = np.unique(np.concatenate([codes_of(t) for t in a]), return_inverse=True)
    n_words = -(-max(map(len, a)) // 64)
    places = np.zeros((len(known) + 1, len(a), n_words), np.uint64)  # the last row: a character that no text of a has
    row = np.repeat(np.arange(len(a)), [len(t) for t in a])
    at = np.concatenate([np.arange(len(t)) for t in a])
    np.bitwise_or.at(places, (coded, row, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    signs = np.full((max(map(len, b)), len(b)), len(known))
    for k, text in enumerate(b):
        codes = codes_of(text)
        found = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        signs[: len(text), k] = np.where(known[found] == codes, found, len(known))
    state = [np.full(len(i), ~np.uint64(0)) for _ in range(n_words)]
    for own in signs:
        hits, carry = places[own[j], i], np.uint64(0)
        for w in range(n_words):
            hit = state[w] & hits[:, w]
            part = state[w] + hit
            added = part + carry
            carry = ((part < hit) | (added < part)).astype(np.uint64)
            state[w] = added | (state[w] & ~hits[:, w])
    return sum(64 - np.bitwise_count(x).astype(np.int64) for x in state)


def shared_runs(left: Block, i: int, right: Block, j: int, q: int) -> int:
    """Common runs of ``q`` characters, each as often as both texts have it."""
    (a, n_a), (b, n_b) = left.runs_of(i, q), right.runs_of(j, q)
    _, at, to = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return int(np.minimum(n_a[at], n_b[to]).sum())


def least_runs(q: int, total, blocks, t: float):
    """Runs of ``q`` characters that texts of that total length share at the threshold, if at most so many blocks match."""
    return t * total / 2 - (q - 1) * blocks


def most_blocks(total, later_length, starts, t: float):
    return np.minimum((1 - t) * total + 1, np.where(later_length >= JUNK_FROM, starts + 1, total))


def bag_bounds(left: Block, i: np.ndarray, right: Block, j: np.ndarray, later: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Total lengths of the pairs, most matching blocks by their common characters, and whether those are enough."""
    own, other, total = left.bags[i], right.bags[j], left.lengths[i] + right.lengths[j]
    starts = np.where(later, np.minimum(own, right.seeds[j]).sum(1), np.minimum(left.seeds[i], other).sum(1))
    blocks = most_blocks(total, np.where(later, right.lengths[j], left.lengths[i]), starts, t)
    return total, blocks, 2 * np.minimum(own, other).sum(1) >= t * total - 1e-9


def enough_runs(left: Block, right: Block, i: int, j: int, total: int, blocks: float, t: float, lengths: int = 4) -> bool:
    """Whether the pair shares enough runs of the first ``lengths`` lengths."""
    needed = [(q, least_runs(q, total, blocks, t) - 1e-9) for q in run_order(max(left.lengths[i], right.lengths[j]))[:lengths]]
    return all(least <= 0 or shared_runs(left, i, right, j, q) >= least for q, least in needed)


def run_order(longest: int) -> tuple:
    return RUNS if longest < LONG else LONG_RUNS


def candidates(left: Block, a: np.ndarray, right: Block, b: np.ndarray, t: float, both: bool | None = None):
    """(i, j, whether j is the later one) of rows of two sub-blocks that pass all bounds but the subsequence: of those pairs whose
    later one is the right one. ``both``: of two texts below JUNK_FROM also the others (True) or none at all (False)."""
    n, m = left.lengths[a][:, None], right.lengths[b][None, :]
    if min(n.max(), m.max()) * (2 - t) < t * max(n.min(), m.min()) - 1e-9:
        return
    total = n + m
    later = left.ranks[a][:, None] < right.ranks[b][None, :]  # whether the right one is the later
    fit = np.minimum(n, m) * (2 - t) >= t * np.maximum(n, m) - 1e-9
    short = (n < JUNK_FROM) & (m < JUNK_FROM)
    fit &= later if both is None else later | short if both else later & ~short
    if not fit.any():
        return
    longest = int(max(n.max(), m.max()))
    width, order = columns_for(longest), run_order(longest)
    product = lambda q: left.matrix(a, q, width) @ right.matrix(b, q, width).T
    starts = np.where(later, right.starts[b][None, :], left.starts[a][:, None])
    need = least_runs(order[0], total, most_blocks(total, np.where(later, m, n), starts, t), t)
    if (need > 0).any():
        fit &= product(order[0]) >= need * (1 - 1e-5) - 1e-3
    x, y = np.nonzero(fit)
    if not len(x):
        return
    i, j, later = a[x], b[y], later[x, y]
    total, blocks, keep = bag_bounds(left, i, right, j, later, t)
    for q in order:
        if keep.sum() > FEW * fit.size:
            keep &= product(q)[x, y] >= least_runs(q, total, blocks, t) * (1 - 1e-5) - 1e-3
    some = np.nonzero(keep)[0]
    if longest <= PACKED and len(some):
        own_texts, other_texts = [left.texts[k] for k in a], [right.texts[k] for k in b]
        common = common_subsequences(own_texts, other_texts, i[some] - a[0], j[some] - b[0])
        some = some[2 * common >= t * total[some] - 1e-9]
    for k in some.tolist():
        if enough_runs(left, right, int(i[k]), int(j[k]), total[k], blocks[k], t):
            yield int(i[k]), int(j[k]), bool(later[k])


class Texts:
    """Texts of a content in order of length, with their ranks: those of an earlier comment are smaller."""

    def __init__(self, texts: list[str], ranks: np.ndarray):
        order = np.lexsort((ranks, [len(t) for t in texts]))
        self.texts, self.ranks = [texts[k] for k in order], ranks[order]
        self.lengths = np.array([len(t) for t in self.texts], np.int64)

    def some(self, rows: np.ndarray) -> Texts:
        return Texts([self.texts[k] for k in rows.tolist()], self.ranks[rows])

    def fitting(self, other: Texts, t: float) -> np.ndarray:
        """Rows whose lengths may fit one of the others'."""
        if not len(other.texts):
            return np.zeros(0, np.int64)
        return np.flatnonzero((self.lengths * (2 - t) >= t * other.lengths[0] - 1e-9) & (other.lengths[-1] * (2 - t) >= t * self.lengths - 1e-9))

    @functools.cached_property
    def index(self) -> Index:
        return Index(self.texts)

    @functools.cached_property
    def block(self) -> Block:
        return Block(self.texts, self.ranks)


def stretches(lengths: np.ndarray, first: int, beside: int) -> list[np.ndarray]:
    """The rows from ``first`` on, in stretches that are held at once beside so many texts."""
    rows = np.arange(first, len(lengths))
    characters = (np.cumsum(lengths[first:]) // AHEAD) if len(rows) else rows
    cuts = np.flatnonzero((np.diff(characters, prepend=0) > 0) | ((rows - first) % max(1, ADDED // beside) == 0))
    return np.split(rows, cuts)[1:]


def possible(texts: Texts, others: Texts, t: float, both: bool | None = None):
    """(earlier rank, text, later rank, text) of the pairs that may reach the threshold and whose later text is one of the others;
    ``both`` as for ``candidates``."""
    others = others.some(others.fitting(texts, t))
    first = int(np.searchsorted(others.lengths, JUNK_FROM))
    plain = [np.arange(first)]
    for rows in stretches(others.lengths, first, len(texts.texts)):
        own = others.some(rows)
        later = Later(own)
        left_out, i, j = later.candidates(texts, t)
        plain.append(rows[left_out])
        total = texts.lengths[i] + own.lengths[j]
        blocks = most_blocks(total, own.lengths[j], later.seeds[j], t)
        for x, y, *known in zip(i.tolist(), j.tolist(), total.tolist(), blocks.tolist(), strict=True):
            if enough_runs(texts.block, own.block, x, y, *known, t, 1):
                yield int(texts.ranks[x]), texts.texts[x], int(own.ranks[y]), own.texts[y]
    rest = others.some(np.concatenate(plain))
    if len(rest.texts):
        left, right = texts.block, rest.block
        for a in left.cuts:
            for b in right.cuts:
                for i, j, later in candidates(left, a, right, b, t, both):
                    pair = (int(left.ranks[i]), left.texts[i]), (int(right.ranks[j]), right.texts[j])
                    x, y = pair if later else pair[::-1]
                    yield *x, *y


def similar(texts: Texts, others: Texts, t: float, both: bool | None = None):
    """(earlier, later, ratio) of the ranks of those pairs that reach the threshold."""
    for a, first, b, second in possible(texts, others, t, both):
        found = ratio_from(first, second, t)
        if found is not None:
            yield a, b, found


def seed_places(a: str, b: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of ``a`` where the ratio may start a block, if ``b`` is the later text: with the first and the number of those of ``b``
    that hold the same character, in an order by character."""
    codes, own = codes_of(b), codes_of(a)
    signs, of, counts = np.unique(codes, return_inverse=True, return_counts=True)
    kept = counts <= len(b) // 100 + 1 if len(b) >= JUNK_FROM else np.ones(len(counts), bool)
    at = np.flatnonzero(kept[of])
    at = at[np.argsort(of[at], kind="stable")]
    sign = np.minimum(np.searchsorted(signs, own), len(signs) - 1)
    starts = np.flatnonzero((signs[sign] == own) & kept[sign])
    first = np.cumsum(np.where(kept, counts, 0)) - counts
    return np.stack([starts, first[sign[starts]], counts[sign[starts]]]), at


class Matches:
    """Finds what ``find_longest_match`` of the standard library finds in parts of two texts, but passes over the characters of ``a``
    at which no block starts. All places that match are looked at together, if they are not too many."""

    def __init__(self, a: str, b: str):
        self.a, self.b = a, b
        (self.starts, first, many), self.at = seed_places(a, b)
        self.first, self.many = first, many
        self.together = many.sum() <= MATCHED
        if self.together:
            self.i = np.repeat(self.starts, many)
            self.j = self.at[np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(self.i))]
            # Only runs of several places that match need to be counted.
            beside = np.diff(self.starts, prepend=-2, append=-2) == 1
            some = np.flatnonzero(np.repeat(beside[1:] | beside[:-1], many))
            some = some[np.lexsort((self.i[some], self.j[some] - self.i[some]))]
            place, i, apart = np.arange(len(some)), self.i[some], self.j[some] - self.i[some]
            goes_on = (np.diff(i, prepend=-2) == 1) & (np.diff(apart, prepend=0) == 0)
            self.length = np.ones(len(self.i), np.int64)
            self.length[some] = place - np.maximum.accumulate(np.where(goes_on, 0, place)) + 1

    def longest(self, a_low: int, a_high: int, b_low: int, b_high: int) -> tuple[int, int, int]:
        a, b = self.a, self.b
        i, j, size = (self.of_all if self.together else self.one_by_one)(a_low, a_high, b_low, b_high)
        while i > a_low and j > b_low and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < a_high and j + size < b_high and a[i + size] == b[j + size]:
            size += 1
        return i, j, size

    def of_all(self, a_low: int, a_high: int, b_low: int, b_high: int) -> tuple[int, int, int]:
        own = slice(*np.searchsorted(self.i, (a_low, a_high)))
        i, j = self.i[own], self.j[own]
        length = np.where((j >= b_low) & (j < b_high), np.minimum(np.minimum(self.length[own], i - a_low + 1), j - b_low + 1), 0)
        if not length.any():
            return a_low, b_low, 0
        k = int(length.argmax())  # the first one, as there
        size = int(length[k])
        return int(i[k]) - size + 1, int(j[k]) - size + 1, size

    def one_by_one(self, a_low: int, a_high: int, b_low: int, b_high: int) -> tuple[int, int, int]:
        found, before, ended = (a_low, b_low, 0), -2, self.at[:0]
        lengths = np.zeros(len(self.b) + 1, np.int64)  # of the runs that end before that place of b
        low, high = np.searchsorted(self.starts, (a_low, a_high)).tolist()
        starts = self.starts[low : high + 1].tolist()
        for k, i in enumerate(starts[: high - low]):
            alone = i != before + 1 and starts[k + 1 : k + 2] != [i + 1]
            if alone and found[2]:
                continue
            first = self.first[low + k]
            places = self.at[first : first + self.many[low + k]]
            places = places[slice(*np.searchsorted(places, (b_low, b_high)))]
            own = lengths[places] + 1 if i == before + 1 else np.ones(len(places), np.int64)
            lengths[ended] = 0
            ended, before = places + 1, i
            lengths[ended] = own
            if len(own) and own.max() > found[2]:
                n, at = int(own.max()), int(places[own.argmax()])
                found = i - n + 1, at - n + 1, n
        return found


def ratio_from(a: str, b: str, threshold: float) -> float | None:
    """The ratio of two texts, or None as soon as it is sure to be below the threshold. Longest blocks are found as the standard
    library does it, the part with the most left to match first; which part comes first changes nothing in their sum."""
    matches, total = Matches(a, b), len(a) + len(b)
    # Where blocks start at many places they take longer to find than the bound that comes before them.
    if 8 * len(matches.starts) > len(a) and 2 * common_subsequence(b, places_of(a), len(a)) < threshold * total - 1e-9:
        return None
    matched, open_ = 0, min(len(a), len(b))
    parts = [(-open_, 0, len(a), 0, len(b))]
    while parts:
        if 2 * (matched + open_) < threshold * total - 1e-9:
            return None
        most, a_low, a_high, b_low, b_high = heapq.heappop(parts)
        open_ += most
        i, j, size = matches.longest(a_low, a_high, b_low, b_high)
        if size:
            matched += size
            for part in ((a_low, i, b_low, j), (i + size, a_high, j + size, b_high)):
                left = min(part[1] - part[0], part[3] - part[2])
                if left:
                    heapq.heappush(parts, (-left, *part))
                    open_ += left
    found = 2.0 * matched / total if total else 1.0
    return found if found >= threshold else None


def common_subsequence(a: str, places: dict[str, int], n: int) -> int:
    """Length of the longest common subsequence of ``a`` and a text of ``n`` characters whose ``places`` are given as bits."""
    full = state = (1 << n) - 1
    for c in a:
        hit = state & places.get(c, 0)
        state = (state + hit | state - hit) & full
    return n - state.bit_count()


def places_of(text: str) -> dict[str, int]:
    places: dict[str, int] = {}
    for i, c in enumerate(text):
        places[c] = places.get(c, 0) | 1 << i
    return places


def stored_rows(path: str):
    """A Parquet file of the shared folder as an Arrow table, read inside a task."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as file:
        return pq.read_table(file, columns=["content_id", "rep", "body"])


def similar_pairs(comments: DataFrame, threshold: float = 0.75, reps: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """(content_id, a, b, ratio) of all representatives at or above the threshold; a is the smaller id.

    The texts lie in files of about ``block`` rows of neighbouring lengths, or of 8 times the square root of their number, BLOCK at
    most. Disk and shuffles grow with the texts only; the pairs of blocks travel as two file names. A task indexes a piece of one file, which
    often is that of its next cells too, and looks up the texts of the other files as later ones."""
    import pyarrow as pa
    import pyarrow.compute as pc

    space = Workspace(comments.sparkSession)
    reps = space.write(representatives(bodies(comments)), "representatives") if reps is None else reps
    rows = reps.filter("content_id IS NOT NULL").select("content_id", "rep", "body", F.length("body").alias("length"))
    n = rows.count()
    n_blocks = max(1, -(-n // (block or min(BLOCK, max(1, int(8 * n**0.5))))))
    blocks = space.write(rows.repartitionByRange(n_blocks, "content_id", "length", "rep"), "blocks")
    known = {"least": F.min("length"), "most": F.max("length"), "pieces": F.ceil((F.sum("length") + 1) / PIECE).cast("int")}
    spans = blocks.groupBy("content_id", F.col("_metadata.file_path").alias("path")).agg(*[v.alias(c) for c, v in known.items()])
    sides = [spans.select("content_id", F.col("path").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in known]) for c in ("i", "j")]
    fits = lambda x, y: F.col(f"most_{x}") * (2 - threshold) >= F.col(f"least_{y}") * threshold - 1e-9
    cells = sides[0].join(sides[1], "content_id").filter(fits("i", "j") & fits("j", "i"))
    # Later texts that are short are compared one by one, and long ones are many characters: several tasks share them.
    parts = F.when(F.col("least_j") < JUNK_FROM, F.greatest(F.lit(8), "pieces_j")).otherwise(F.col("pieces_j"))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    cells = cells.select("content_id", "i", "j", parts.alias("parts"), each(F.col("pieces_i")).alias("piece"))
    cells = cells.select("*", each(F.col("parts")).alias("part"))
    content_type = reps.schema["content_id"].dataType.simpleString()

    def load(path, content) -> tuple[list[str], np.ndarray]:
        table = stored_rows(path)
        table = table.filter(pc.equal(table.column("content_id"), content))
        return table.column("body").to_pylist(), table.column("rep").to_numpy()

    def compare(batches):
        held: dict = {}  # the piece of the last cell, which is often that of the next one
        for batch in batches:
            for k in range(batch.num_rows):
                content, i, j = (batch.column(c)[k] for c in ("content_id", "i", "j"))
                piece, part, parts = (batch.column(c)[k].as_py() for c in ("piece", "part", "parts"))
                key = content.as_py(), i.as_py(), piece
                if key not in held:
                    held.clear()
                    texts = Texts(*load(key[1], content))
                    held[key] = texts.some(np.flatnonzero((np.cumsum(texts.lengths) - texts.lengths) // PIECE == piece))
                others = Texts(*load(j.as_py(), content))
                others = others.some(np.arange(part, len(others.texts), parts))
                both = None if i.as_py() == j.as_py() else i.as_py() < j.as_py()
                pairs, characters = [], 0
                for a, first, b, second in possible(held[key], others, threshold, both):
                    lot = characters // CHECKED
                    characters += len(first) + len(second)
                    found = None if lot else ratio_from(first, second, threshold)
                    if lot or found is not None:
                        pairs.append((a, b, (piece << 48 | part << 32) + lot, found))
                    if len(pairs) == SENT:
                        yield rows_of(batch, k, pairs)
                        pairs = []
                yield rows_of(batch, k, pairs)

    def rows_of(batch, k, pairs):
        same = [pa.array([batch.column(c)[k].as_py()] * len(pairs), batch.schema.field(c).type) for c in ("content_id", "i", "j")]
        own = [pa.array([p[c] for p in pairs], pa.float64() if c == 3 else pa.int64()) for c in range(4)]
        return pa.RecordBatch.from_arrays([*same, *own], ["content_id", "i", "j", "a", "b", "lot", "ratio"])

    def check(batches):
        held: dict = {}  # the texts of the last two files
        for batch in batches:
            content, i, j, a, b = (batch.column(c).to_pylist() for c in ("content_id", "i", "j", "a", "b"))
            rows = []
            for k in range(batch.num_rows):
                keys = [(content[k], i[k]), (content[k], j[k])]
                for key in keys:
                    if key not in held:
                        for other in [x for x in held if x not in keys]:
                            del held[other]
                        texts, ranks = load(key[1], batch.column("content_id")[k])
                        held[key] = dict(zip(ranks.tolist(), texts, strict=True))
                first, second = (held[keys[0]].get(x) or held[keys[1]][x] for x in (a[k], b[k]))
                rows.append(ratio_from(first, second, threshold))
            found = [k for k, x in enumerate(rows) if x is not None]
            columns = [batch.column(c).take(pa.array(found, pa.int64())) for c in ("content_id", "a", "b")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([rows[k] for k in found], pa.float64())], ["content_id", "a", "b", "ratio"])

    # Cells are small and slow: they are dealt to several tasks for each core, neighbours together. A cell's first lot of pairs is checked
    # at once; further ones are dealt anew, as the copies of a text lie in a few cells.
    order = ["content_id", "i", "piece", "j", "part"]
    n_tasks = 8 * int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = space.write(cells, "cells").repartitionByRange(n_tasks, *order).sortWithinPartitions(*order)
    left = space.write(dealt.mapInArrow(compare, f"content_id {content_type}, i string, j string, a long, b long, lot long, ratio double"), "possible-pairs")
    lots = left.filter("ratio IS NULL").repartition(n_tasks, "content_id", "i", "j", "lot").sortWithinPartitions("content_id", "i", "j", "lot")
    checked = lots.mapInArrow(check, f"content_id {content_type}, a long, b long, ratio double")
    pairs = space.write(left.filter("ratio IS NOT NULL").select("content_id", "a", "b", "ratio").unionByName(checked), "similar-pairs")
    space.drop("blocks", "cells", "possible-pairs")
    return pairs


def cluster_members(comments: DataFrame, threshold: float = 0.75, least: int = 3) -> DataFrame:
    """(content_id, comment_id, cluster_id, size) of comments in clusters of ``least`` or more; named by their first id."""
    space = Workspace(comments.sparkSession)
    rows = space.write(bodies(comments).drop("body"), "keys")
    reps = space.write(representatives(bodies(comments)), "representatives")
    pairs = similar_pairs(comments, threshold, reps)
    # Comment ids are unique over contents, so one edge table serves all of them.
    roots = components(pairs.select("a", "b")).select(F.col("node").alias("rep"), "root")
    # The join by key has two plain exchanges, so that the partition of a text that very many comments share is split.
    keyed = rows.select("content_id", "comment_id", "key").join(reps.select("content_id", "key", "rep"), ["content_id", "key"]).join(roots, "rep", "left")
    named = keyed.select("content_id", "comment_id", F.coalesce("root", "rep").alias("cluster_id"))
    sizes = named.groupBy("content_id", "cluster_id").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    return named.join(sizes, ["content_id", "cluster_id"])


def exact_duplicate_clusters(comments: DataFrame, least: int = 3) -> DataFrame:
    """Texts that several comments of a content share after ``preprocess``."""
    rows = comments.select("content_id", "comment_id", preprocess(F.col("text")).alias("body")).filter(F.length("body") >= MIN_LENGTH)
    return rows.groupBy("content_id", "body").agg(F.count("*").alias("size"), F.min("comment_id").alias("first_id")).filter(F.col("size") >= least).select("content_id", "first_id", "size")


def participation(comments: DataFrame, members: DataFrame) -> DataFrame:
    """Share of a user's comments on a content that stand in clusters."""
    flagged = comments.select("content_id", "user_id", "comment_id").join(members.select("comment_id", F.lit(1).alias("hit")), "comment_id", "left")
    return flagged.groupBy("content_id", "user_id").agg((F.count("hit") / F.count("*")).alias("f5"))


def cluster_details(comments: DataFrame, members: DataFrame, top: int = 10, most: int = 20) -> DataFrame:
    """The largest clusters of each content and their first members, with user and text."""
    clusters = members.select("content_id", "cluster_id", "size").distinct()
    order = F.row_number().over(Window.partitionBy("content_id").orderBy(F.desc("size"), "cluster_id"))
    best = clusters.withColumn("cluster_rank", order).filter(F.col("cluster_rank") <= top)
    rows = members.select("content_id", "cluster_id", "comment_id").join(best, ["content_id", "cluster_id"])
    rows = rows.withColumn("member_rank", F.row_number().over(Window.partitionBy("content_id", "cluster_id").orderBy("comment_id"))).filter(F.col("member_rank") <= most)
    detail = comments.select("comment_id", "user_id", F.substring("text", 1, 200).alias("text"))
    return rows.join(detail, "comment_id", "left").withColumn("text", F.coalesce("text", F.lit("(comment missing)")))


def exact_text_dedup(comments: DataFrame, keys: list[str]) -> DataFrame:
    """The first comment of each trimmed text."""
    body = F.trim("text")
    return comments.withColumn("body", body).groupBy(*keys, "body").agg(F.min("seq").alias("seq")).drop("body")


def kept_in_order(pairs: DataFrame) -> DataFrame:
    """Nodes (node) of pairs (earlier, later, seq) that go: in the order of ``seq``, that of the later one, a node goes if it
    resembles a kept earlier one.

    Components of the pairs do not depend on each other. The pairs of a component come in order to one task, which holds the
    nodes gone so far of that component only; its pairs are streamed. The number of jobs does not depend on the pairs."""
    import pyarrow as pa

    space = Workspace(pairs.sparkSession)
    edges = space.write(pairs, "ordered-pairs")
    roots = components(edges.select(F.col("earlier").alias("a"), F.col("later").alias("b"))).select(F.col("node").alias("later"), "root")

    def settle(batches):
        component, at, gone = None, None, set()
        for batch in batches:
            out = []
            for root, earlier, later in zip(*(batch.column(c).to_pylist() for c in ("root", "earlier", "later")), strict=True):
                if root != component:
                    component, at, gone = root, None, set()
                if earlier not in gone and later != at:
                    gone.add(later)
                    out.append(later)
                    at = later
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["node"])

    ordered = edges.join(roots, "later").select("root", "earlier", "later", "seq").repartition("root").sortWithinPartitions("root", "seq", "later")
    return ordered.select("root", "earlier", "later").mapInArrow(settle, "node long")


def near_dup_dedup(comments: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Comments without those whose text resembles a kept earlier one of their content, in order of arrival. Texts below
    MIN_LENGTH are not compared and all stay."""
    space = Workspace(comments.sparkSession)
    reps = space.write(representatives(bodies(comments)), "representatives")
    order = reps.select("content_id", "rep", "seq")
    sides = [order.select("content_id", F.col("rep").alias(c), F.col("seq").alias(f"seq_{c}")) for c in ("a", "b")]
    pairs = similar_pairs(comments, threshold, reps).join(sides[0], ["content_id", "a"]).join(sides[1], ["content_id", "b"])
    first = F.col("seq_a") < F.col("seq_b")
    either = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    gone = kept_in_order(pairs.select(either("a", "b").alias("earlier"), either("b", "a").alias("later"), either("seq_b", "seq_a").alias("seq")))
    kept = reps.select("content_id", F.col("rep").alias("comment_id")).join(gone.select(F.col("node").alias("comment_id")), "comment_id", "left_anti").select("content_id", "comment_id")
    length = F.length(preprocess(F.col("text")))
    short = comments.filter(F.coalesce(length, F.lit(0)) < MIN_LENGTH).select("content_id", "comment_id")
    return kept.unionByName(short)


def top_topics(comments: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """The most frequent topic runs of each key, ties by text."""
    counts = comments.select(*keys, F.explode(topic_runs(F.col("text"))).alias("topic")).groupBy(*keys, "topic").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "topic"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= n)


def sentiment_share(comments: DataFrame, keys: list[str], positive: list[str], negative: list[str]) -> DataFrame:
    """Shares of positive, negative and neutral comments; both kinds of terms or none make one neutral."""
    good, bad = any_hit(F.col("text"), positive), any_hit(F.col("text"), negative)
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return comments.groupBy(*keys).agg(share(good & ~bad).alias("positive"), share(bad & ~good).alias("negative"), share(good == bad).alias("neutral"))


def ratio_at(threshold: float):
    """Column function: the ratio of two texts, the earlier one first, or null below the threshold. Bounds on lengths, characters
    and shared runs come before it, as for ``similar_pairs``; what they need of a text is kept while its batch lasts."""

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[str, Block] = {}

        def one(first: str, second: str) -> float | None:
            total, least = len(first) + len(second), threshold * (len(first) + len(second)) - 1e-9
            if 2 * min(len(first), len(second)) < least:
                return None
            for x in (first, second):
                if x not in known:
                    if len(known) >= 64:  # pairs come in order, so the oldest text has met its others
                        del known[next(iter(known))]
                    known[x] = Block([x], np.zeros(1, np.int64))
            left, right = (known.get(x) or Block([x], np.zeros(1, np.int64)) for x in (first, second))
            if 2 * np.minimum(left.bags[0], right.bags[0]).sum() < least:
                return None
            starts = np.minimum(left.bags[0], right.seeds[0]).sum() + 1 if len(second) >= JUNK_FROM else total
            blocks = min((1 - threshold) * total + 1, starts)
            for q in RUNS:
                need = least / 2 - (q - 1) * blocks
                if need > 0 and shared_runs(left, 0, right, 0, q) < need - 1e-9:
                    return None
            return ratio_from(first, second, threshold)

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def templating(comments: DataFrame, threshold: float = 0.60, flag_at: float = 0.70, ahead: int = 9, cut: int | None = None, most: int = 2, example_cut: int = 50) -> DataFrame:
    """Mean ratio of a user's texts and their next ``ahead`` ones that reach the threshold, whether it speaks of a template,
    and the first ``most`` such pairs, cut."""
    body = preprocess(F.col("text"))
    body = body if cut is None else F.substring(body, 1, cut)
    rows = comments.select("content_id", "user_id", "seq", body.alias("body")).filter(F.length("body") >= MIN_LENGTH)
    # A number of tasks that is given is not made smaller by their size: comparing costs far more than its rows weigh.
    rows = rows.repartition(8 * int(comments.sparkSession.conf.get("spark.sql.shuffle.partitions")), "content_id", "user_id")
    own = Window.partitionBy("content_id", "user_id").orderBy("seq")
    following = rows.withColumn("following", F.array(*[F.lead("body", k).over(own) for k in range(1, ahead + 1)]))
    pairs = following.select("content_id", "user_id", "seq", "body", F.posexplode(F.array_compact("following")).alias("k", "other"))
    near = pairs.withColumn("ratio", ratio_at(threshold)("body", "other")).filter(F.col("ratio") >= threshold)
    near = near.select("content_id", "user_id", "ratio", *[F.substring(c, 1, example_cut).alias(c) for c in ("body", "other")], F.row_number().over(Window.partitionBy("content_id", "user_id").orderBy("seq", "k")).alias("place"))
    example = F.when(F.col("place") <= most, F.struct("place", F.concat_ws(" / ", "body", "other").alias("texts")))
    sums = near.groupBy("content_id", "user_id").agg(F.count("*").alias("n_pairs"), F.round(F.avg("ratio"), 6).alias("mean_ratio"), F.array_sort(F.collect_list(example)).alias("examples"))
    return sums.withColumn("templated", F.col("mean_ratio") >= flag_at).withColumn("examples", F.transform("examples", lambda e: e["texts"]))


def comment_digest(comments: DataFrame, positive: list[str], negative: list[str], n_topics: int = 5, n_examples: int = 3, cut: int = 50) -> DataFrame:
    """One row for each user: numbers of comments, of different ones and of those left by ``near_dup_dedup``, mean length,
    sentiment shares, topics, template flag, and the first comments, cut."""
    sizes = comments.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 1).alias("avg_length"))
    unique = exact_text_dedup(comments, ["user_id"]).groupBy("user_id").agg(F.count("*").alias("n_unique"))
    kept = near_dup_dedup(comments).join(comments.select("comment_id", "user_id"), "comment_id").groupBy("user_id").agg(F.count("*").alias("n_kept"))
    topics = top_topics(comments, ["user_id"], n_topics).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "topic", "n"))).alias("topics"))
    flags = templating(comments).groupBy("user_id").agg(F.max("templated").alias("templated"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("seq"))
    first = comments.select("user_id", rank.alias("k"), F.substring("text", 1, cut).alias("text")).filter(F.col("k") <= n_examples)
    examples = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("examples")).withColumn("examples", F.transform("examples", lambda e: e["text"]))
    rows = sizes
    for part in (unique, kept, sentiment_share(comments, ["user_id"], positive, negative), topics, flags, examples):
        rows = rows.join(part, "user_id", "left")
    return rows.withColumns({"templated": F.coalesce("templated", F.lit(False)), "n_kept": F.coalesce("n_kept", F.lit(0))})

"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on posterior labels.

1. Terms (whole words, and word beginnings of several lengths) are mined from labelled rows of the learning folds: those
   that occur in toxic rows far more often than chance allows. Near copies among these rows count once.
2. Voters: the mined terms are dealt into lexicons by kind, strength and a hash; beside them stand a general lexicon of
   insults and some patterns of spelling. A voter votes toxic for a text in which it finds something.
3. Label model: means and covariances of the votes over all documents give each voter's rates on toxic and clean texts
   (method of moments over triplets of voters), and the excess covariance of a pair gives their correlation, by which
   correlated voters count for less. Labels enter through the mined terms and the share of toxic rows only.
4. A logistic regression on the terms of a bounded sample of rows learns the posterior of the label model.

The labelled sample has at most about ``max_rows`` rows, chosen by a hash of the id, and at most ``max_terms`` terms are
kept, those of the most toxic rows; rows of the sample that share their smallest shingle hash count once. Both bounds are
parameters; the statistics of step 3 and the scores cover all documents.

Defined results: a null text counts as empty; an empty text gets the score of a text without any term; a very long text is
scored whole; ids that are null have no label and are held out if the checksum of the empty text is divisible; repeated
rows each give a row and are one row of the sample; terms of equal counts are ranked by text; without labels, or without toxic ones, nothing is mined and only the general lexicon and the patterns speak; other columns of
either table are ignored and may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import binary_column, words_of, written

FOLDS = 5
MAX_ROWS = 30_000
#: Lengths in bytes of word beginnings that may become terms; 0 stands for whole words.
BEGINNINGS = (4, 5, 6, 7, 8, 9, 10)
MIN_TOXIC = 5
MAX_TERMS = 6_000
#: Insults of everyday language; a voter of its own, whatever the labels say.
GENERAL_LEXICON = (
    "arschloch bastard bitch cabron clown connard conne dummkopf dumm encule fool gilipollas idiot idiota idioten imbecile "
    "imbecil jerk loser mierda moron pathetic pendejo puta putain salope scheisse schlampe scum shit stupid trash worthless disgusting"
).split()
PATTERNS = (rb"!{2,}|\?!|!\?", rb"\b[A-Z]{5,}\b(?:[^\w]+[A-Z]{3,}\b)+", rb"(?i)\b(?:you|du|tu|usted)\b\W+(?:\w+\W+){0,2}(?:idiot|loser|scum|trash|moron)")
SHINGLE = 5


def fold_of(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def distinct_words(text: bytes | None) -> set[bytes]:
    return set(words_of(text.decode().lower().encode())) if text else set()


def terms_of(words: set[bytes]) -> set[bytes]:
    """All terms a text could be asked for; whole words end in a space."""
    found = {w + b" " for w in words}
    for n in BEGINNINGS:
        found.update([w[:n] for w in words if len(w) >= n])
    return found


def signature(text: bytes | None) -> int:
    """The smallest hash of the text's runs of five words: equal for most near copies."""
    words = words_of(text)
    if len(words) < SHINGLE:
        return zlib.crc32(b" ".join(words))
    return min(zlib.crc32(b" ".join(words[i : i + SHINGLE])) for i in range(len(words) - SHINGLE + 1))


@dataclass
class ToxicityModel:
    """Terms with their weights, and the voters and their estimated rates."""

    terms: list[bytes] = field(default_factory=list)
    voter_of: list[int] = field(default_factory=list)
    n_voters: int = 0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    rates: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    trust: np.ndarray = field(default_factory=lambda: np.zeros(0))
    correlations: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    prior: float = 0.1

    def features(self, text: bytes | None) -> list[int]:
        """Indices of the terms that the text holds, in order; the general lexicon and the patterns come last."""
        if not self.__dict__.get("at"):
            self.at = {t: i for i, t in enumerate(self.terms)}
            self.sizes = sorted({len(t) for t in self.terms if not t.endswith(b" ")})
            self.short = {t[:4] for t in self.terms}
            self.general = {w.encode() for w in GENERAL_LEXICON}
            self.patterns = [re.compile(p) for p in PATTERNS]
        if not text:
            return []
        found, at = set(), self.at
        words = distinct_words(text)
        for word in words:
            if word[:4] in self.short or len(word) < 4:
                if (i := at.get(word + b" ")) is not None:
                    found.add(i)
                for n in self.sizes:
                    if n > len(word):
                        break
                    if (i := at.get(word[:n])) is not None:
                        found.add(i)
        n = len(self.terms)
        if not self.general.isdisjoint(words):
            found.add(n)
        found.update(n + 1 + k for k, p in enumerate(self.patterns) if p.search(text))
        return sorted(found)

    def votes(self, features: list[int]) -> np.ndarray:
        """1 for each voter that votes toxic."""
        out = np.zeros(self.n_voters)
        out[[self.voter_of[i] for i in features]] = 1
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of toxic for rows of votes, by the label model."""
        toxic, clean = self.rates[:, 0], self.rates[:, 1]
        seen, unseen = np.log(toxic / clean), np.log((1 - toxic) / (1 - clean))
        odds = np.log(self.prior / (1 - self.prior)) + (votes * seen + (1 - votes) * unseen) @ self.trust
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def score(self, features: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[features].sum(), -30, 30))))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_rows: int) -> DataFrame:
    """(text, toxic) of at most about ``max_rows`` labelled rows of the learning folds; their ids are broadcast."""
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1) AND label_id IS NOT NULL")
    known = known.filter(fold_of("label_id") != 0).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, max_rows / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "label_id").dropDuplicates(["label_id", "text"]).select("text", "toxic")


def mine_terms(sample: DataFrame, max_terms: int) -> tuple[list[tuple[bytes, int, int]], float]:
    """Terms with their counts in toxic and clean rows, strongest first; and the share of toxic rows."""
    import pyarrow as pa

    def signed(batches):
        for batch in batches:
            keys = [signature(t) for t in binary_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("toxic"), pa.array(keys, pa.int64())], ["text", "toxic", "key"])

    def counted(batches):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(binary_column(batch, "text"), batch.column("toxic").to_pylist(), strict=True):
                counts[toxic].update(terms_of(distinct_words(text)))
        terms = list(counts[0].keys() | counts[1].keys())
        for k in range(0, len(terms), 100_000):
            part = terms[k : k + 100_000]
            yield pa.RecordBatch.from_pydict({"term": pa.array(part, pa.binary()), "toxic": [counts[1][t] for t in part], "clean": [counts[0][t] for t in part]})

    once = sample.mapInArrow(signed, "text string, toxic int, key long").groupBy("key", "toxic").agg(F.min("text").alias("text"))
    totals = {row["toxic"]: row["count"] for row in once.groupBy("toxic").count().collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return [], 0.1
    sums = once.select("text", "toxic").mapInArrow(counted, "term binary, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # Far more frequent in toxic rows: at least 60 times, half a clean row more than seen being allowed for.
    strong = sums.filter((F.col("toxic") >= MIN_TOXIC) & (F.col("toxic") * n_clean >= 60 * n_toxic * (F.col("clean") + 0.5)))
    rows = strong.orderBy(F.desc("toxic"), "clean", "term").limit(max_terms).collect()
    return [(bytes(r["term"]), r["toxic"], r["clean"]) for r in rows], n_toxic / (n_toxic + n_clean)


def deal_voters(terms: list[tuple[bytes, int, int]]) -> tuple[list[int], int]:
    """The voter of each term: by kind (word, short or long beginning), strength (half of the rank order) and a hash bit;
    then one voter for the general lexicon and one for each pattern."""
    keys = []
    for rank, (term, _, _) in enumerate(terms):
        kind = 0 if term.endswith(b" ") else 1 if len(term) <= 6 else 2
        keys.append((kind, int(rank * 2 >= len(terms)), zlib.crc32(term[:4]) & 1))
    number = {key: i for i, key in enumerate(sorted(set(keys)))}
    voters = [number[k] for k in keys]
    return voters + [len(number) + k for k in range(1 + len(PATTERNS))], len(number) + 1 + len(PATTERNS)


def vote_moments(docs: DataFrame, model: ToxicityModel) -> tuple[float, np.ndarray, np.ndarray]:
    """Number of documents, sums of votes and sums of pairs of votes, over all documents; one small matrix for each task."""
    import pyarrow as pa

    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own, n = held.value, 0
        pairs = np.zeros((own.n_voters, own.n_voters))
        for batch in batches:
            for text in binary_column(batch, "text"):
                n += 1
                if features := own.features(text):
                    votes = np.nonzero(own.votes(features))[0]
                    pairs[np.ix_(votes, votes)] += 1
        i, j = np.nonzero(pairs)
        yield pa.RecordBatch.from_pydict({"i": [-1, *i.tolist()], "j": [-1, *j.tolist()], "n": [float(n), *pairs[i, j].tolist()]})

    sums = docs.mapInArrow(run, "i long, j long, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    pairs, total = np.zeros((model.n_voters, model.n_voters)), 0.0
    for row in sums:
        if row["i"] < 0:
            total = row["n"]
        else:
            pairs[row["i"], row["j"]] = row["n"]
    return total, np.diag(pairs).copy(), pairs


def fit_label_model(model: ToxicityModel, total: float, sums: np.ndarray, pairs: np.ndarray) -> None:
    """Rates of each voter on toxic and clean texts, and correlations of voters beyond what the label explains.

    For voters that are independent given the label, cov(i, j) = p (1 - p) d_i d_j with d = rate on toxic - rate on clean,
    so each triplet gives d_i; the median over triplets is robust against some dependent pairs."""
    n, p = model.n_voters, min(max(model.prior, 0.01), 0.5)
    mean = (sums + 0.5) / (total + 1)
    cov = (pairs + 0.25) / (total + 1) - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.outer(mean * (1 - mean), mean * (1 - mean)), 1e-12))
    active = [i for i in range(n) if sums[i] >= 3]
    d = np.zeros(n)
    for i in active:
        found = []
        for j in active:
            for k in active:
                if len({i, j, k}) == 3 and j < k and min(cov[i, j], cov[i, k], cov[j, k]) > 0:
                    found.append(np.sqrt(cov[i, j] * cov[i, k] / (cov[j, k] * p * (1 - p))))
        if len(found) >= 3:
            d[i] = np.median(found)
    d = np.clip(d, 0, np.minimum(mean / p, (1 - mean) / (1 - p)))
    clean = np.clip(mean - p * d, 1e-4, 0.999)
    toxic = np.clip(clean + d, 1e-4, 0.999)
    excess = np.clip((cov - p * (1 - p) * np.outer(d, d)) / spread, 0, 1)
    np.fill_diagonal(excess, 0)
    excess[excess < 0.05] = 0
    model.rates = np.stack([np.maximum(toxic, clean), clean], 1)
    model.correlations = excess
    model.trust = 1 / (1 + excess.sum(1))


def fit_classifier(model: ToxicityModel, rows: list[list[int]], steps: int = 400, rate: float = 0.3, decay: float = 1e-4) -> None:
    """Logistic regression of the posterior on the terms, by gradient steps with momentum; equal rows are counted once."""
    counts = Counter(map(tuple, rows))
    n_features = len(model.terms) + 1 + len(PATTERNS)
    model.weights = np.zeros(n_features)
    distinct = list(counts)
    goal = model.posterior(np.array([model.votes(list(r)) for r in distinct]).reshape(len(distinct), model.n_voters))
    weight = np.array([counts[r] for r in distinct], float)
    # Toxic and clean texts weigh the same in total.
    weight *= goal / max((weight * goal).sum(), 1e-9) + (1 - goal) / max((weight * (1 - goal)).sum(), 1e-9)
    owner = np.repeat(np.arange(len(distinct)), [len(r) for r in distinct])
    column = np.array([i for r in distinct for i in r], int)
    seen = np.maximum(np.bincount(column, weight[owner], n_features), 1e-6)
    bias, speed, bias_speed = 0.0, np.zeros(n_features), 0.0
    for _ in range(steps):
        out = 1 / (1 + np.exp(-np.clip(bias + np.bincount(owner, model.weights[column], len(distinct)), -30, 30)))
        error = (out - goal) * weight
        gradient = np.bincount(column, error[owner], n_features) / np.sqrt(seen) + decay * model.weights
        speed, bias_speed = 0.9 * speed - rate * gradient, 0.9 * bias_speed - rate * error.sum()
        model.weights, bias = model.weights + speed, bias + bias_speed
    model.bias = bias


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS) -> ToxicityModel:
    """Learns from the learning folds of ``labels`` (doc_id, toxic) and the votes on all documents."""
    import pyarrow as pa

    sample = written(labelled_sample(docs, labels, id_col, text_col, max_rows), "labelled-sample")
    terms, share = mine_terms(sample, max_terms)
    model = ToxicityModel(terms=[t for t, _, _ in terms], prior=share)
    model.voter_of, model.n_voters = deal_voters(terms)
    texts = docs.select(F.col(text_col).alias("text"))
    fit_label_model(model, *vote_moments(texts, model))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def featured(batches):
        for batch in batches:
            rows = [held.value.features(text) for text in binary_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], ["terms"])

    grouped = sample.select("text").mapInArrow(featured, "terms array<int>")
    fit_classifier(model, [row["terms"] for row in grouped.collect()])
    return model


def score_column(df: DataFrame, model: ToxicityModel, text: Column) -> Column:
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        own = held.value
        return texts.map(lambda t: own.score(own.features(t.encode() if t else b"")))

    return score(F.coalesce(text, F.lit("")))


def scored(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``score_col``, which replaces a column of that name."""
    return docs.withColumn(score_col, score_column(docs, model, F.col(text_col)))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows that score below 0.5, with their own columns."""
    model = fit(docs, labels, id_col, text_col, max_rows)
    return docs.filter(score_column(docs, model, F.col(text_col)) < 0.5)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """Per document row: id, held_out (not in a learning fold), score, predicted (1 from a score of 0.5)."""
    model = fit(docs, labels, id_col, text_col, max_rows)
    rows = scored(docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text")), model)
    return rows.select(id_col, (fold_of(id_col) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

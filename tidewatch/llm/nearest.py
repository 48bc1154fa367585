"""Approximate nearest neighbours by largest inner product: inverted lists and an adaptive scan over dimensions.

Inner products become distances by one more component, sqrt(M^2 - |x|^2) with M the largest norm (0 for queries): the
nearest by distance has the largest inner product. A random rotation spreads the distance evenly over the components.
About sqrt(n) lists hold the rows that are nearest to their centroids.

A query first measures the rows around its nearest list; the distance of the k-th is its radius from then on. A list is left
out if no row of it can be within the radius: its products are at most that with the centroid and the query's norm times
the list's reach, the largest distance of its rows from the centroid. So are rows whose norm is too small. (With a
``loss`` above 0, a normal approximation of each list's distances tells how many rows to expect within the radius
instead, and lists that hold but that share of them are left out too; where norms or widths of clusters differ much, it is far
off.) Inside the probed lists, candidates are compared block of columns by block of columns. After t of d components, a
candidate is abandoned if its partial distance is beyond the radius, or rejects the hypothesis that its full distance is
within it: partial > radius * (1 + epsilon / sqrt(t))^2 * t / d. What is left is scored exactly, in double precision on the
original vectors.

Neighbouring lists share a unit of about ``UNIT_ROWS`` rows; a longer list (copies of one vector) is cut into several. A
query goes to each unit that it probes once, the queries of a unit are cut into chunks of ``CHUNK_QUERIES``, and only
where there are several the unit's rows are copied. Rotation and centroids are fitted on at most about ``SAMPLE_ROWS`` rows
chosen by a hash; every row is indexed.

Defined results: rows whose id is null, or whose vector is null, zero, holds null or non-finite components or differs in
length from most others take no part; of rows that repeat an id the nearest counts; ties go to the smaller id; with
fewer candidates than ``k`` all are returned; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

from math import erfc, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import Workspace

SAMPLE_ROWS = 65_536
MAX_LISTS = 4_096
UNIT_ROWS = 8_192
CHUNK_QUERIES = 4_096
COLUMN_BLOCK = 16
EPSILON = 1.3
LOSS = 0.08
#: What the operator takes: 4 deviations at the first block, and no list is left out on an estimate.
SURE_EPSILON, SURE_LOSS = 2.1, 0.0
SEED = 11
#: Share of open candidates from which on a block of columns is read for all rows at once.
DENSE = 0.75
#: Queries that a task measures at once.
HELD_QUERIES = 256


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec) of the rows that take part; vec is array<double>."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).filter("id IS NOT NULL AND size(vec) > 0")
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter((F.size("vec") == (common["d"] if common else 0)) & ~bad & F.exists("vec", lambda x: x != 0))


class ListIndex:
    """Rotation, centroids, and of each list the number of rows, the mean and the variance of their squared distance from
    the centroid, its reach, and the units that hold them."""

    def __init__(self, sample: np.ndarray, largest_norm: float, n_lists: int):
        rng = np.random.default_rng(SEED)
        self.largest = largest_norm
        self.rotation = np.linalg.qr(rng.standard_normal((sample.shape[1] + 1, sample.shape[1] + 1)))[0]
        points = self.rows(sample)
        n_lists = max(1, min(n_lists, len(points)))
        self.centroids = points[rng.choice(len(points), n_lists, replace=False)]
        for _ in range(8):
            own = self.distances(points).argmin(1)
            sums, counts = np.zeros_like(self.centroids), np.bincount(own, minlength=n_lists)
            np.add.at(sums, own, points)
            filled = counts > 0
            self.centroids[filled] = sums[filled] / counts[filled, None]
        # Lists in the order of their place along the main direction of the centroids, so that a unit's lists are near each other.
        around = self.centroids - self.centroids.mean(0)
        self.centroids = self.centroids[np.argsort(around @ np.linalg.svd(around, full_matrices=False)[2][0], kind="stable")]
        self.measured(np.zeros(n_lists), np.zeros(n_lists), np.zeros(n_lists))

    def measured(self, sizes: np.ndarray, sums: np.ndarray, squares: np.ndarray, reach: np.ndarray | None = None) -> None:
        """Takes the number of rows of each list, the sums of their squared distances and of the squares of these, and the
        largest squared distance without the added component (unknown: no list is left out by it)."""
        self.sizes = sizes
        self.reach = np.full(len(sizes), np.inf) if reach is None else np.sqrt(reach)
        self.spread = sums / np.maximum(sizes, 1)
        self.variance = np.maximum(squares / np.maximum(sizes, 1) - self.spread**2, 0)
        self.first_unit, self.n_units, held, unit = np.zeros(len(sizes), int), np.ones(len(sizes), int), 0.0, 0
        for i, n in enumerate(sizes):
            if held and held + n > UNIT_ROWS:
                unit, held = unit + 1, 0.0
            self.first_unit[i], self.n_units[i] = unit, max(1, int(-(-n // UNIT_ROWS)))
            held += n
            unit += self.n_units[i] - 1

    def rows(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.largest**2 - (vectors**2).sum(1), 0))
        return np.hstack([vectors, rest[:, None]]) @ self.rotation

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        return np.hstack([vectors, np.zeros((len(vectors), 1))]) @ self.rotation

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distances from the centroids, less the point's own square."""
        return (self.centroids**2).sum(1) - 2 * points @ self.centroids.T

    def expected(self, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Rows of each list to expect within the squared radius of each point."""
        from_centroid = np.maximum(self.distances(points) + (points**2).sum(1)[:, None], 0)
        deviation = np.sqrt(4 * from_centroid * self.spread / points.shape[1] + self.variance + 1e-12)
        return self.sizes * normal_share((radius[:, None] - from_centroid - self.spread) / deviation)

    def added(self, points: np.ndarray) -> np.ndarray:
        """The component that was added to rows before their rotation."""
        return points @ self.rotation[-1]

    def least_products(self, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """For each query, the inner product of a row at the squared radius."""
        return (self.largest**2 + (points**2).sum(1) - radius) / 2

    def probed(self, points: np.ndarray, radius: np.ndarray, loss: float) -> np.ndarray:
        """For each query, whether a list is probed: if any row of it can be within the radius; with a ``loss``, those of the
        most expected rows among them, until but ``loss`` of all is left out."""
        norms = np.sqrt((points**2).sum(1))[:, None]
        most = points @ self.centroids.T + norms * self.reach * (1 + 1e-9)
        within = most + 1e-9 * norms * self.largest >= self.least_products(points, radius)[:, None]
        if not loss:
            return within & (self.sizes > 0)
        expected = self.expected(points, radius)
        order = np.argsort(-expected, 1, kind="stable")
        before = np.cumsum(np.take_along_axis(expected, order, 1), 1) - np.take_along_axis(expected, order, 1)
        out = np.zeros(expected.shape, bool)
        np.put_along_axis(out, order, before < (1 - loss) * expected.sum(1)[:, None], 1)
        out[np.isinf(radius)] = True
        return out & within & (self.sizes > 0)


def normal_share(z: np.ndarray) -> np.ndarray:
    """Distribution function of the normal distribution, from a table of steps of 1/256."""
    return _SHARES[np.clip(np.rint(z * 256) + 2560, 0, 5120).astype(int)]


_SHARES = np.array([erfc(-k / 256 / sqrt(2)) / 2 for k in range(-2560, 2561)])


def first_radius(index: ListIndex, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """For each query the squared distance of the k-th of the rows of a unit (by id, its own left out), or infinity."""
    order = np.argsort(ids, kind="stable")
    ids, points = ids[order], index.rows(vectors[order])
    starts = np.nonzero(np.r_[True, ids[1:] != ids[:-1]])[0]
    squares, out = (points**2).sum(1), []
    for a in range(0, len(query_ids), HELD_QUERIES):
        asked = index.queries(queries[a : a + HELD_QUERIES])
        distance = squares + (asked**2).sum(1)[:, None] - 2 * asked @ points.T
        distance[query_ids[a : a + HELD_QUERIES, None] == ids] = np.inf
        each = np.minimum.reduceat(distance, starts, 1)
        out.append(np.partition(each, k - 1, 1)[:, k - 1] if each.shape[1] >= k else np.full(len(asked), np.inf))
    return np.concatenate(out) * (1 + 1e-9) + 1e-12


def scan_unit(index: ListIndex, lists: np.ndarray, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, radius: np.ndarray, k: int, epsilon: float, loss: float):
    """The best k candidates of a unit for each query, as (query id, id, score), by adaptive scan; and the share of rows
    that were compared and of components that were read for them."""
    order = np.argsort(lists, kind="stable")
    lists, ids, vectors = lists[order], ids[order], vectors[order]
    points, asked = index.rows(vectors), index.queries(queries)
    probed = index.probed(asked, radius, loss)
    d = points.shape[1]
    ends = [*range(COLUMN_BLOCK, d, COLUMN_BLOCK), d]
    starts = [0, *ends[:-1]]
    blocks = [np.ascontiguousarray(points[:, a:b]) for a, b in zip(starts, ends, strict=True)]
    squares = [(block**2).sum(1) for block in blocks]
    asked_squares = np.stack([(asked[:, a:b] ** 2).sum(1) for a, b in zip(starts, ends, strict=True)])
    limits = [min(1.0, (1 + epsilon / np.sqrt(t)) ** 2 * t / d) if t < d else 1.0 for t in ends]
    norms, asked_norms = np.sqrt((vectors**2).sum(1)) * (1 + 1e-9), np.sqrt((queries**2).sum(1))
    least = index.least_products(asked, radius)
    out, met, read = [], 0, 0
    for a in range(0, len(query_ids), HELD_QUERIES):
        some = slice(a, a + HELD_QUERIES)
        head = squares[0] + asked_squares[0][some, None] - 2 * asked[some, : ends[0]] @ blocks[0].T
        open_ = (head <= limits[0] * radius[some, None]) & (query_ids[some, None] != ids)
        in_lists = probed[some][:, lists] & (asked_norms[some, None] * norms >= least[some, None])
        met += int(in_lists.sum())
        read += int(in_lists.sum()) * ends[0]
        open_ &= in_lists
        first = 1
        while first < len(ends) and open_.mean() > DENSE:
            head += squares[first] + asked_squares[first][some, None] - 2 * asked[some, starts[first] : ends[first]] @ blocks[first].T
            read += open_.size * (ends[first] - starts[first])
            open_ &= head <= limits[first] * radius[some, None]
            first += 1
        for q, (own, partial) in enumerate(zip(open_, head, strict=True), a):
            left = np.nonzero(own)[0]
            partial = partial[left]
            for n in range(first, len(ends)):
                partial = partial + squares[n][left] + asked_squares[n, q] - 2 * (blocks[n][left] @ asked[q, starts[n] : ends[n]])
                read += len(left) * (ends[n] - starts[n])
                keep = partial <= limits[n] * radius[q]
                left, partial = left[keep], partial[keep]
            score = (vectors[left] * queries[q]).sum(1)
            best = np.lexsort((ids[left], -score))
            best = best[np.sort(np.unique(ids[left][best], return_index=True)[1])][:k]
            out.append((np.full(len(best), query_ids[q]), ids[left][best], score[best]))
    found = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, int), np.zeros(0, int), np.zeros(0)]
    every = max(1, len(query_ids) * len(ids))
    return found, met / every, read / (every * d)


def matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists as rows of a matrix."""
    values = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.asarray(values.flatten().to_numpy(zero_copy_only=False), float).reshape(len(values), -1)


def fitted_index(rows: DataFrame, n: int, d: int, largest_norm: float) -> ListIndex:
    """Rotation and centroids from a sample of ``rows`` (id, vec)."""
    n_lists = int(min(MAX_LISTS, max(1, round(n**0.5))))
    share = min(1.0, min(SAMPLE_ROWS, 64 * n_lists) / n)
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(np.ceil(share * 1_000_000))).select("vec").toPandas()["vec"]
    return ListIndex(np.array(sample.tolist(), float).reshape(-1, d), largest_norm, n_lists)


def largest_inner_products(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    loss: float = SURE_LOSS,
    epsilon: float = SURE_EPSILON,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the nearest rows of ``vectors`` found for each row of ``queries`` (same columns)."""
    import pyarrow as pa

    spark = vectors.sparkSession
    space = Workspace(spark)
    rows = usable(vectors, id_col, vector_col)
    asked = usable(queries, id_col, vector_col)
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    facts = rows.agg(F.count("*").alias("n"), F.max(square).alias("most"), F.max(F.size("vec")).alias("d")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = asked.filter(F.size("vec") == facts["d"])
    index = fitted_index(rows, facts["n"], facts["d"], float(np.sqrt(facts["most"])))
    held = spark.sparkContext.broadcast(index)

    def listed(batches):
        for batch in batches:
            points = held.value.rows(matrix(batch.column("vec")))
            distance = held.value.distances(points)
            own = distance.argmin(1) if len(points) else np.zeros(0, int)
            off = np.maximum(distance[np.arange(len(points)), own] + (points**2).sum(1), 0)
            without = np.maximum(off - (held.value.added(points) - held.value.added(held.value.centroids)[own]) ** 2, 0) + 1e-9 * off
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(own, pa.int32()), pa.array(off, pa.float64()), pa.array(without, pa.float64())], ["id", "vec", "list", "off", "without"])

    dealt = space.write(rows.mapInArrow(listed, "id long, vec array<double>, list int, off double, without double"), "listed-vectors")
    sums = np.zeros((4, len(index.sizes)))
    for row in dealt.groupBy("list").agg(F.count("*").alias("n"), F.sum("off").alias("s"), F.sum(F.col("off") * F.col("off")).alias("q"), F.max("without").alias("r")).collect():  # one row for each list
        sums[:, row["list"]] = row["n"], row["s"], row["q"], row["r"]
    index.measured(*sums)
    sized = spark.sparkContext.broadcast(index)
    by_list = [F.array(*[F.lit(int(x)) for x in column]) for column in (index.first_unit, index.n_units)]
    unit = F.element_at(by_list[0], F.col("list") + 1) + F.pmod(F.xxhash64("id"), F.element_at(by_list[1], F.col("list") + 1)).cast("int")
    units = dealt.withColumn("unit", unit).drop("off", "without")

    def at_home(batches):
        for batch in batches:
            index, ids = sized.value, batch.column("id").to_numpy()
            own = np.where(index.sizes > 0, index.distances(index.queries(matrix(batch.column("vec")))), np.inf).argmin(1) if len(ids) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(index.first_unit[own] + ids % index.n_units[own], pa.int32())], ["id", "vec", "unit"])

    def chunked(waiting: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows and queries of the units, both with a chunk; rows are copied for each chunk of a unit's queries."""
        loads = waiting.groupBy("unit").agg(F.ceil(F.count("*") / CHUNK_QUERIES).cast("int").alias("n_chunks"))
        left = units.join(loads.hint("merge"), "unit").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
        right = waiting.join(loads.hint("merge"), "unit").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("n_chunks")).cast("int"))
        return left.drop("n_chunks"), right.drop("n_chunks")

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        radius = np.full(right.num_rows, np.inf)
        if left.num_rows and right.num_rows:
            radius = first_radius(sized.value, left.column("id").to_numpy(), matrix(left.column("vec")), right.column("id").to_numpy(), matrix(right.column("vec")), k)
        return pa.table({"id": right.column("id"), "vec": right.column("vec"), "radius": pa.array(radius, pa.float64())})

    def probing(batches):
        for batch in batches:
            index, found = sized.value, []
            for a in range(0, batch.num_rows, HELD_QUERIES):
                part = batch.slice(a, HELD_QUERIES)
                for own in index.probed(index.queries(matrix(part.column("vec"))), part.column("radius").to_numpy(), loss):
                    own = np.nonzero(own)[0]
                    first, n = index.first_unit[own], index.n_units[own]
                    found.append(np.unique(np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], [*batch.schema.names, "units"])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, int), np.zeros(0, int), np.zeros(0)]
        if left.num_rows and right.num_rows:
            a, b = ([t.column(c).to_numpy() for c in names] for t, names in ((left, ("list", "id")), (right, ("id", "radius"))))
            found = scan_unit(sized.value, *a, matrix(left.column("vec")), b[0], matrix(right.column("vec")), b[1], k, epsilon, loss)[0]
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    key = ["unit", "chunk"]
    left, right = chunked(space.write(asked.mapInArrow(at_home, "id long, vec array<double>, unit int"), "queries-at-home"))
    measured = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(measure, "id long, vec array<double>, radius double")
    measured = space.write(measured, "measured-queries")
    probing_queries = measured.mapInArrow(probing, "id long, vec array<double>, radius double, units array<int>")
    left, right = chunked(space.write(probing_queries.withColumn("unit", F.explode("units")).drop("units"), "probing-queries"))
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

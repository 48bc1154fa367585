"""k-means over integers by a tournament of bisectors.

Components become integers, floor(1024 * x). Of two centroids that which is nearer to a vector is told by the side of
their bisector on which it lies: with the normal n = b - a and the threshold |b|^2 - |a|^2, the sign of 2 * n . v -
threshold is positive where b is nearer, and zero on the bisector, where the smaller number wins. Normals and thresholds of
all pairs of centroids are computed once a round; a vector then takes k - 1 tests, in each of which the winner so far meets
the next number. Only the distance to the last winner is computed, in integers.

A round is one pass over the vectors: each task returns the integer sums and sizes of its clusters, at most k rows, which
Spark adds up as decimals; the driver gets k rows and divides with exact floors. Nothing is shuffled by vector.

Defined results: vectors that are null, have another number of components than ``dims`` or hold null, infinite or undefined
components take no part and are not returned; repeated rows count each; the first centroids are the ``k`` rows with the
smallest hashes of their ids, rows of equal hashes in the order of their components; rows of null id are clustered
but are never first centroids; with fewer rows than ``k`` there are fewer centroids; an empty table gives no rows; further
columns are ignored, whatever their names. Components are computed as Python integers where 64 bits could overflow; a
distance or inertia that does not fit a long raises an error.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Workspace

K, DIMS, ROUNDS, SCALE, SALT = 8, 64, 10, 1024, "3"
#: From this size of a component on, sums of products of DIMS components could overflow 64 bits.
WIDE = 1 << 27


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as 64-bit or, for very large values, as Python integers."""
    scaled = np.floor(SCALE * values)
    if not scaled.size or np.abs(scaled).max() < WIDE:
        return scaled.astype(np.int64)
    return np.array([math.floor(SCALE * float(x)) if math.isfinite(SCALE * float(x)) else SCALE * math.floor(x) for x in values.ravel()], object).reshape(values.shape)


def matrix(batch, dims: int = DIMS) -> np.ndarray:
    """The vectors of an Arrow batch, one a row, as integers."""
    import pyarrow as pa

    column = batch.column("vector")
    return whole(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), dims))


class Bisectors:
    """Normals and thresholds of all pairs of centroids; ``nearest`` settles the tournament of each row of a matrix."""

    def __init__(self, centroids: list[list[int]]):
        wide = any(abs(x) >= WIDE for c in centroids for x in c)
        self.centroids = np.array(centroids, object if wide else np.int64)
        squares = (self.centroids * self.centroids).sum(1)
        self.normals = 2 * (self.centroids[None, :, :] - self.centroids[:, None, :])
        self.thresholds = squares[None, :] - squares[:, None]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and squared distance to it."""
        winner = np.zeros(len(vectors), np.int64)
        for challenger in range(1, len(self.centroids)):
            side = (self.normals[winner, challenger] * vectors).sum(1) - self.thresholds[winner, challenger]
            winner[side > 0] = challenger
        rest = vectors - self.centroids[winner]
        return winner, (rest * rest).sum(1)


def kept_vectors(rows: DataFrame, dims: int = DIMS) -> DataFrame:
    """(vec_id, vector) of the rows that take part, as doubles."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.filter(x.isNotNull() & (F.size(x) == dims) & finite).select("vec_id", x.cast("array<double>").alias("vector"))


def first_centroids(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    named = vectors.filter("vec_id IS NOT NULL").withColumn("hash", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256))
    first = named.orderBy("hash", "vector").limit(k).collect()
    return [whole(np.array([r["vector"]]))[0].tolist() for r in first]


def cluster_sums(vectors: DataFrame, bisectors: Bisectors, dims: int) -> dict[int, tuple[int, list[int]]]:
    """Size and sums of the components of each cluster that is not empty."""
    import pyarrow as pa

    def sums(batches):
        totals: dict[int, list[int]] = {}
        for batch in batches:
            own = matrix(batch, dims)
            winner, _ = bisectors.nearest(own)
            for c in np.unique(winner).tolist():
                rows = own[winner == c]
                total = totals.setdefault(c, [0] * (dims + 1))
                for i, x in enumerate([len(rows), *rows.sum(0).tolist()]):
                    total[i] += x
        rows = list(totals.items())
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int32()), pa.array([[str(x) for x in t] for _, t in rows], pa.list_(pa.string()))], ["cluster", "totals"])

    parts = vectors.mapInArrow(sums, "cluster int, totals array<string>")
    added = parts.groupBy("cluster").agg(F.array(*[F.sum(F.col("totals")[i].cast("decimal(38,0)")) for i in range(dims + 1)]).alias("totals"))
    return {r["cluster"]: (int(r["totals"][0]), [int(x) for x in r["totals"][1:]]) for r in added.collect()}  # at most k rows


def fitted_centroids(vectors: DataFrame, k: int = K, dims: int = DIMS, rounds: int = ROUNDS, salt: str = SALT) -> list[list[int]]:
    """The centroids after all rounds; those of empty clusters stay as they were."""
    centroids = first_centroids(vectors, k, salt)
    for _ in range(rounds if centroids else 0):
        found = cluster_sums(vectors, Bisectors(centroids), dims)
        moved = [[s // found[c][0] for s in found[c][1]] if c in found else old for c, old in enumerate(centroids)]
        if moved == centroids:  # all further rounds would give the same
            break
        centroids = moved
    return centroids


def cluster(rows: DataFrame, k: int = K, dims: int = DIMS, rounds: int = ROUNDS, salt: str = SALT) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part."""
    space = Workspace(rows.sparkSession)
    vectors = space.write(kept_vectors(rows, dims), "kept-vectors")
    centroids = fitted_centroids(vectors, k, dims, rounds, salt)
    if not centroids:
        return vectors.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]).limit(0)
    bisectors, id_type = Bisectors(centroids), rows.schema["vec_id"].dataType.simpleString()

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            winner, distance = bisectors.nearest(matrix(batch, dims))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(winner, pa.int32()), pa.array(distance.tolist(), pa.int64())], ["vec_id", "cluster", "distance"])

    assigned = space.write(vectors.mapInArrow(assign, f"vec_id {id_type}, cluster int, distance long"), "assigned-vectors")
    inertia = {r["cluster"]: r["total"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # at most k rows
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    sums = [inertia.get(c, 0) for c in range(len(centroids))]
    space.drop("kept-vectors")
    return assigned.select("vec_id", "cluster", "distance", of(sums).cast("long").alias("cluster_inertia"), F.lit(sum(sums)).cast("long").alias("inertia"), of(names).alias("centroid_sha256"))

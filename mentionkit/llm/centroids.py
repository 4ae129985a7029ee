"""Integer k-means whose centroids are filtered by n-simplex projection.

Vectors are scaled to integers. A few pivot vectors span a simplex; the distances of any vector to the
pivots, taken once and kept, give it a place over that simplex (``Simplex``): coordinates within the
pivots' flat and one height above it. Between two places the plain Euclidean distance is never more
than the true one, and the distance with one height turned down never less. A round compares the
places of vectors and centroids; only centroids whose lower bound does not exceed the least upper
bound get the exact integer distance. Assignments, sums and distances are exact integers.

Scale. The scaled vectors and their places are written once; a round is one pass over them without a
shuffle of vectors: a task adds up its vectors by cluster, and one sum per cluster and component goes
through a small aggregate to the driver, which holds ``k`` centroids and ``PIVOTS`` pivots. Sizes of
clusters do not matter (a cluster may hold all rows).

Defined results: vectors with another number of components, null or non-finite ones, or null vectors are
left out. Vectors are numbered by the hash of ``<seed>:<vec_id>``; a null id counts as no digits, ties go
to the smaller id and then the smaller vector. Fewer than ``k`` vectors give as many centroids. Repeated
rows are vectors like any other. Scaled components saturate at 2^27. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionkit.llm.common import materialise
from mentionkit.llm.vectors import finite, float_exact, matrix, scaled

PIVOTS = 16
#: Rows that a task compares at a time.
CHUNK = 4096
#: Share of the distances by which the bounds are widened, for rounding.
SLACK = 1e-6
#: Pivots are used up to this condition of their simplex.
WORST_CONDITION = 1e4


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of ``a`` to every row of ``b`` (integers)."""
    if float_exact(a, b):
        a, b = a.astype(np.float64), b.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((a.astype(np.int64) - row) ** 2).sum(1) for row in b.astype(np.int64)], axis=1)


def paired_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``a`` to the same rows of ``b``."""
    kind = np.float64 if float_exact(a, b) else np.int64
    d = a.astype(kind) - b.astype(kind)
    return np.einsum("ij,ij->i", d, d).astype(np.int64)


class Simplex:
    """The simplex of some pivots and the places of vectors over it."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots.astype(np.int64)
        while True:
            edges = (self.pivots[1:] - self.pivots[:1]).astype(np.float64)
            # the pivots' own coordinates: a lower triangle (rows are pivots after the first)
            lower = np.linalg.qr(edges.T, mode="r").T if len(edges) else np.zeros((0, 0))
            if not len(edges) or (lower.shape[0] == lower.shape[1] and np.abs(np.diag(lower)).min() > 0
                                  and np.linalg.cond(lower) <= WORST_CONDITION):
                break
            self.pivots = self.pivots[:-1]
        self.inverse = np.linalg.inv(lower) if len(edges) else lower
        self.squares = (edges ** 2).sum(1)

    def places(self, x: np.ndarray) -> np.ndarray:
        """Coordinates within the flat, the height, and the squared distance to the first pivot, by row."""
        d = squared_distances(x, self.pivots).astype(np.float64)
        flat = ((d[:, :1] + self.squares - d[:, 1:]) / 2) @ self.inverse.T
        height = np.sqrt(np.maximum(0.0, d[:, 0] - (flat ** 2).sum(1)))
        return np.column_stack([flat, height, d[:, 0]])


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances between places, wide enough for rounding."""
    fa, ha, fb, hb = a[:, :-2], a[:, -2], b[:, :-2], b[:, -2]
    flat = np.maximum(0.0, (fa ** 2).sum(1)[:, None] + (fb ** 2).sum(1) - 2 * (fa @ fb.T))
    slack = SLACK * (a[:, -1][:, None] + b[:, -1]) + 1e-3
    return flat + (ha[:, None] - hb) ** 2 - slack, flat + (ha[:, None] + hb) ** 2 + slack


def nearest(x: np.ndarray, places: np.ndarray, centroids: np.ndarray, own: np.ndarray,
            distances: bool = False) -> tuple[np.ndarray, np.ndarray | None, int]:
    """The nearest centroid of each row (ties: the smaller number), if asked its distance, and how many pairs were compared.

    ``own``: the centroids' places. A row whose bounds leave one centroid needs no comparison.
    """
    low, high = bounds(places, own)
    left = low <= high.min(axis=1, keepdims=True)
    several = left.sum(axis=1) > 1
    row, number = np.nonzero(left & several[:, None])
    exact = np.full(left.shape, np.iinfo(np.int64).max)
    exact[row, number] = paired_distances(x[row], centroids[number])
    found = np.where(several, exact.argmin(axis=1), left.argmax(axis=1))
    if not distances:
        return found, None, len(row)
    return found, paired_distances(x, centroids[found]), len(row)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3,
            column: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance)`` of every kept vector, written, and the final centroids."""
    spark = vectors.sparkSession
    kept = vectors.filter((F.size(column) == dims) & finite(column)).select("vec_id", scaled(column, scale).alias("x"))
    digits = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = kept.select(F.sha2(digits.cast("binary"), 256).alias("h"), "vec_id", "x").orderBy("h", "vec_id", "x").limit(
        max(k, PIVOTS)).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dims), np.int64)
    centroids = np.array([r.x for r in first[:k]], np.int64)
    simplex = spark.sparkContext.broadcast(Simplex(np.array([r.x for r in first[:PIVOTS]])))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                places = simplex.value.places(matrix(part["x"]))
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["x"], pa.array(list(places))], names=["vec_id", "x", "place"])

    table = materialise(kept.mapInArrow(place, "vec_id long, x array<int>, place array<double>"), "vectors")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                yield part, matrix(part["x"]), matrix(part["place"])

    for _ in range(rounds):
        now = spark.sparkContext.broadcast((centroids, simplex.value.places(centroids)))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(now.value[0]), dims + 1), object)  # any number of vectors; the last: how many
            for _, x, places in parts(batches):
                found, _, _ = nearest(x, places, *now.value)
                for c in np.unique(found):
                    own = x[found == c]
                    sums[c, :dims] += own.sum(axis=0, dtype=np.int64).astype(object)
                    sums[c, dims] += len(own)
            c, component = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32()), pa.array(component, pa.int32()), pa.array([int(v) for v in sums[c, component]], pa.int64())],
                names=["cluster", "component", "total"])

        sums = np.zeros((len(centroids), dims + 1), object)
        for r in table.mapInArrow(add, "cluster int, component int, total long").groupBy("cluster", "component").agg(
                F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():  # k * (dims + 1) rows at most
            sums[r.cluster, r.component] = int(r.total)
        centroids = np.array([[int(s) // int(row[dims]) for s in row[:dims]] if row[dims] else old.tolist()
                              for row, old in zip(sums, centroids)], np.int64)

    last = spark.sparkContext.broadcast((centroids, simplex.value.places(centroids)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, places in parts(batches):
            found, distance, _ = nearest(x, places, *last.value, distances=True)
            yield pa.RecordBatch.from_arrays([part["vec_id"], pa.array(found, pa.int32()), pa.array(distance, pa.int64())],
                                             names=["vec_id", "cluster", "distance"])

    return materialise(table.mapInArrow(assign, "vec_id long, cluster int, distance long"), "clusters"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The assignment with each cluster's and the whole inertia and the hash of the cluster's centroid."""
    hashes = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    inertia = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # a row a cluster
    if not inertia:
        return assigned.select("*", *(F.lit(None).cast(t).alias(n) for n, t in (
            ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    pick = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    return assigned.select("*", pick([F.lit(inertia.get(c, 0)).cast("long") for c in range(len(centroids))]).alias("cluster_inertia"),
                           F.lit(sum(inertia.values())).cast("long").alias("inertia"),
                           pick([F.lit(h) for h in hashes]).alias("centroid_sha256"))

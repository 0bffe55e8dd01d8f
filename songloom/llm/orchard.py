"""Centroid clustering with the nearest centroid found by Orchard's search.

Every centroid has a list of the other centroids by distance. A search stands at one centroid and walks down its list. A
centroid that is closer to the vector, or as close with a smaller number, becomes the new place, and its own list is
walked from the top; what was looked at is marked and not measured again. A list ends where its centroids are strictly farther
than twice the distance at hand: by the triangle inequality none of them can be as close. All vectors of a batch search at
once, one step of each list per turn.

Components become integers ``floor(scale * x)``; distances, sums and the new centroids are exact. A round sends the centroids
to the tasks and gets one sum per centroid and dimension back, added up in the tasks first. Their number is a parameter, so
what is broadcast and what the driver holds does not grow with the table.

Defined cases: vectors that are null, of another length, or hold null or non-finite components are left out; so are those with an
integer of 2^58 or more. A distance or inertia beyond 64 bits is null, the assignment still exact. Ties go to the smaller number, an
empty cluster keeps its centroid. Rows with the same id count each; of the starting vectors those with the same id stand in the
order of their components, and a null id counts as an empty text. With fewer vectors than centroids each one starts a centroid. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.llm.common import all_finite, matrix_of
from songloom.session import stored

#: Vectors that search at once in a task.
SEARCH_ROWS = 8192
#: Integers below this have squared distances of at most 38 digits.
LARGEST = 2**58


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)``: 64-bit numbers where squared distances fit into them, Python's numbers otherwise."""
    scaled = np.floor(vectors * float(scale))
    if not scaled.size or np.abs(scaled).max() < safe_bound(vectors.shape[1]):
        return scaled.astype(np.int64)
    # From 2 ** 53 on a double is a whole number, so the product of whole numbers is exact for any scale.
    exact = [[int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * float(scale))) for x in row] for row in vectors.tolist()]
    return np.array(exact, dtype=object).reshape(vectors.shape)


def safe_bound(dims: int) -> float:
    """Integers below this have four times their squared distance in 64 bits."""
    return float(np.sqrt(2.0**63 / (16.0 * max(1, dims)))) - 1.0


def squares(difference: np.ndarray) -> np.ndarray:
    return (difference * difference).sum(axis=-1)


class Centroids:
    """Centroids by number, with the list of the others by distance for each."""

    def __init__(self, rows: list[list[int]]):
        small = all(abs(x) < safe_bound(len(r)) for r in rows for x in r)
        self.at = np.array(rows, dtype=np.int64 if small else object).reshape(len(rows), -1)
        apart = squares(self.at[:, None, :] - self.at[None, :, :])
        count = len(rows)
        self.order = np.array([sorted((j for j in range(count) if j != i), key=lambda j: (apart[i, j], j)) for i in range(count)], np.int64)
        self.order = self.order.reshape(count, count - 1)
        self.far = np.take_along_axis(apart, self.order, axis=1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and squared distance to it, for each vector."""
        if vectors.dtype == object or self.at.dtype == object:
            vectors, at, far = vectors.astype(object), self.at.astype(object), self.far.astype(object)
        else:
            at, far = self.at, self.far
        rows, length = len(vectors), self.order.shape[1]
        here = np.zeros(rows, np.int64)
        near = squares(vectors - at[0])
        place = np.zeros(rows, np.int64)
        visited = np.zeros((rows, len(at)), bool)
        visited[:, 0] = True
        active = np.arange(rows) if length else np.zeros(0, np.int64)
        while len(active):
            home, step = here[active], place[active]
            going = ~np.asarray(far[home, step] > 4 * near[active], dtype=bool)
            active, home, step = active[going], home[going], step[going]
            other = self.order[home, step]
            place[active] += 1
            new = ~visited[active, other]
            looking, other = active[new], other[new]
            visited[looking, other] = True
            found = squares(vectors[looking] - at[other])
            best = near[looking]
            closer = np.asarray((found < best) | ((found == best) & (other < here[looking])), dtype=bool)
            moved = looking[closer]
            here[moved], near[moved], place[moved] = other[closer], found[closer], 0
            active = active[place[active] < length]
        return here, near

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in self.at.tolist()]


def _searched(batches, centroids: Centroids, scale: int):
    """Batches of at most ``SEARCH_ROWS`` rows with their integers, nearest centroids and distances."""
    for whole in batches:
        for begin in range(0, whole.num_rows, SEARCH_ROWS):
            batch = whole.slice(begin, SEARCH_ROWS)
            x = integers(matrix_of(batch.column("vector")), scale)
            yield batch, x, *centroids.nearest(x)


def _sums(kept: DataFrame, rows: list[list[int]], scale: int) -> list[tuple[int, list[int]]]:
    """Count and componentwise sums of the vectors nearest to each centroid."""
    dims = len(rows[0])
    shared = kept.sparkSession.sparkContext.broadcast(rows)

    def run(batches):
        centroids = Centroids(shared.value)
        total = np.zeros((len(shared.value), dims + 1), dtype=object)
        for _, x, cluster, _ in _searched(batches, centroids, scale):
            part = np.zeros(total.shape, dtype=x.dtype)
            np.add.at(part, (cluster, slice(0, dims)), x)
            part[:, dims] = np.bincount(cluster, minlength=len(part))
            total += part
        cluster, cell = (m.ravel() for m in np.indices(total.shape))
        values = pa.array([Decimal(int(v)) for v in total.ravel()], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(cell), values], ["cluster", "cell", "value"])

    cells = kept.select("vector").mapInArrow(run, "cluster long, cell long, value decimal(38, 0)")
    found = {(r["cluster"], r["cell"]): int(r["value"]) for r in cells.groupBy("cluster", "cell").agg(F.sum("value").alias("value")).collect()}
    return [(found.get((i, dims), 0), [found.get((i, d), 0) for d in range(dims)]) for i in range(len(rows))]


def usable_vectors(table: DataFrame, id_column: str, vector: str, dims: int, scale: int) -> DataFrame:
    """``id, vector`` of the rows that take part."""
    rows = table.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    fits = F.forall("vector", lambda x: F.abs(x) < float(LARGEST // scale))
    return rows.where(all_finite(F.col("vector")) & (F.size("vector") == dims)).where(fits)


def starting(kept: DataFrame, clusters: int, seed: int, scale: int) -> list[list[int]]:
    """Integers of the vectors whose id comes first by hash; as many rows as centroids reach the driver."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(name, "vector").limit(clusters).select("vector").collect()
    return [integers(np.array([r["vector"]], np.float64), scale)[0].tolist() for r in first]


def clustered(
    table: DataFrame, clusters: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1,
    id_column: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """One row per vector that takes part: id, ``cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    kept = usable_vectors(table, id_column, vector, dims, scale)
    centroids = starting(kept, clusters, seed, scale)
    for _ in range(rounds if centroids else 0):
        sums = _sums(kept, centroids, scale)
        centroids = [[s // n for s in total] if n else old for old, (n, total) in zip(centroids, sums)]
    shared = kept.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        held = Centroids(shared.value) if shared.value else None
        for batch, _, cluster, near in _searched(batches, held, scale):
            distance = pa.array([Decimal(int(d)) for d in near.tolist()], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster.astype(np.int32)), distance], ["id", "cluster", "exact"])

    id_type = kept.schema["id"].dataType.simpleString()
    assigned = stored(kept.mapInArrow(run, f"id {id_type}, cluster int, exact decimal(38, 0)"), "assigned")
    digests = Centroids(centroids).digests() if centroids else []
    names = kept.sparkSession.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    per_cluster = assigned.groupBy("cluster").agg(F.try_sum("exact").alias("of_cluster"))
    whole = assigned.agg(F.try_sum("exact").alias("of_all")).select(F.col("of_all").try_cast("long").alias("inertia"))
    # One row per centroid at most.
    known = F.broadcast(per_cluster.join(F.broadcast(names), "cluster"))
    return assigned.join(known, "cluster").select(
        F.col("id").alias(id_column), "cluster", F.col("exact").try_cast("long").alias("distance"),
        F.col("of_cluster").try_cast("long").alias("cluster_inertia"), whole.scalar().alias("inertia"), "centroid_sha256",
    )

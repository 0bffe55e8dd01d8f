"""Whitening of vectors with components from a Golub-Kahan-Lanczos bidiagonalisation.

X has one row per vector, centred. Starting from a unit vector v, the method goes back and forth: ``u = Xv`` less its share in the
earlier u, scaled to length one, then ``v = X'u`` less its share in the earlier v. The lengths form an upper bidiagonal
matrix B, whose small singular value decomposition gives the right singular vectors of X (the components) and its
singular values (their deviations). Each family is orthogonalised against all its members.

The u are as long as the table and are never stored. All of them lie in the range of X, so each is kept as a short vector z with
``u = Xz``, and tasks make the entries they need from their rows. A product is one job over packed blocks of rows; it brings
back one number per dimension or step, added up in the tasks and then by Spark. The driver holds the v, the z
and B: as much as the square of the dimension, whatever the table's length. Steps end when the wanted components have
converged, or when there are as many as dimensions, which makes them exact.

Entries become integers ``floor(scale * c) + shift``. Sums, the centring ``n * x - S`` and squared deviations are exact; only then
does a division turn them into doubles.

Defined cases: vectors that are null, empty, hold null or non-finite entries, or integers of 2^53 or more are left out; so
are vectors of another length than most (of equally frequent lengths the shortest stays). A deviation beyond 64 bits is null.
Components with no variance are left out, so equal rows, a single row or an empty table give none and no rows. Rows with
the same id count each, and each gets its rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.llm.common import all_finite, matrix_of, rows_per_batch
from songloom.session import stored

#: Rows per packed block.
BLOCK_ROWS = 4096
#: Residual of a singular triplet against the largest singular value at which it counts as converged.
TOLERANCE = 1e-14
#: Singular values below this share of the largest one, the accuracy of doubles, count as none.
NEGLIGIBLE = 1e-12
#: Doubles are whole numbers up to here.
LARGEST = 2**53


class Blocks:
    """Rows of the fit list as integers in packed blocks, with their count and sums, and jobs over the centred rows."""

    def __init__(self, vectors: DataFrame, scale: int, shift: int):
        self.spark = vectors.sparkSession
        lengths = vectors.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n"))
        first = lengths.orderBy(F.desc("n"), "dims").first()
        self.count, self.dims = (first["n"], first["dims"]) if first else (0, 1)
        self.id_type = vectors.schema["id"].dataType.simpleString()
        dims = self.dims

        def pack(batches):
            for whole in batches:
                for begin in range(0, whole.num_rows, BLOCK_ROWS):
                    batch = whole.slice(begin, BLOCK_ROWS)
                    x = np.floor(matrix_of(batch.column("vector")) * float(scale)).astype(np.int64) + shift
                    ids = pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch.column("id"))
                    # Python's numbers: a sum may be beyond 64 bits.
                    totals = [str(sum(column)) for column in x.T.tolist()] if np.abs(x).max() > 2**40 else [str(t) for t in x.sum(0).tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([x.astype("<i8").tobytes()], pa.binary()), pa.array([totals])], ["ids", "x", "totals"]
                    )

        alike = vectors.where(F.size("vector") == dims)
        self.rows = stored(alike.mapInArrow(pack, f"ids array<{self.id_type}>, x binary, totals array<string>"), "blocks")
        sums = self.rows.select(F.posexplode("totals").alias("cell", "value")).groupBy("cell")
        held = sums.agg(F.sum(F.col("value").cast("decimal(38, 0)")).alias("value")).collect()
        self.sums = [0] * dims
        for r in held:
            self.sums[r["cell"]] = int(r["value"])

    def centred(self, block: bytes) -> np.ndarray:
        """Rows less their mean, as doubles; ``n * x - S`` before the division."""
        return _times(np.frombuffer(block, "<i8").reshape(-1, self.dims), self.count, self.sums).astype(np.float64) / self.count

    def total(self, function, given, cells: int) -> np.ndarray:
        """Sum of ``function(centred rows, given)`` over all blocks, ``cells`` numbers."""
        plain = self._plain()
        sent = self.spark.sparkContext.broadcast(given)

        def run(batches):
            total = np.zeros(cells)
            for batch in batches:
                for block in batch.column("x").to_pylist():
                    total += function(plain.centred(block), sent.value)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(total)], ["cell", "value"])

        with rows_per_batch(self.spark, 16):
            parts = self.rows.select("x").mapInArrow(run, "cell long, value double")
            rows = parts.groupBy("cell").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(cells)
        for r in rows:
            out[r["cell"]] = r["value"]
        return out

    def _plain(self) -> _Centre:
        return _Centre(self.dims, self.count, self.sums)


class _Centre:
    """What tasks need to centre a block."""

    def __init__(self, dims: int, count: int, sums: list[int]):
        self.dims, self.count, self.sums = dims, count, sums

    centred = Blocks.centred


def _times(x: np.ndarray, count: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``: 64-bit numbers where they fit, Python's numbers otherwise."""
    most = max([abs(s) for s in sums], default=0) + (int(np.abs(x).max()) if x.size else 0) * count
    if most < 2**62:
        return x * np.int64(count) - np.array(sums, np.int64)
    return x.astype(object) * count - np.array(sums, dtype=object)


def _deviations(x: np.ndarray, count: int, sums: list[int]) -> list[int | None]:
    """Sum of squares of ``n * x - S`` per row, null beyond 64 bits."""
    difference = _times(x, count, sums)
    if difference.dtype != object and difference.size and float(np.abs(difference).max()) ** 2 * x.shape[1] < 2.0**62:
        return (difference * difference).sum(1).tolist()
    exact = [sum(int(v) * int(v) for v in row) for row in difference.tolist()]
    return [v if v < 2**63 else None for v in exact]


def _against(vector: np.ndarray, family: list[np.ndarray]) -> np.ndarray:
    """``vector`` less its share in each of an orthonormal family, twice."""
    for _ in range(2):
        for v in family:
            vector = vector - (v @ vector) * v
    return vector


def _forth_and_back(y: np.ndarray, given) -> np.ndarray:
    """For ``w = X w0``: ``X'w``, the products of w with the earlier u, and its squared length."""
    w = y @ given[:, -1]
    return np.concatenate([y.T @ w, (y @ given[:, :-1]).T @ w, [w @ w]])


def bidiagonal(blocks: Blocks, wanted: int, squared: float) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right singular vectors (columns) of the centred rows, the largest ``wanted``.

    One job makes ``w = Xv`` less the step before, its products with the earlier u and ``X'w``. What w gives up to be
    orthogonal to the earlier u is taken from ``X'w`` too, as ``X'u`` is known for each of them.
    """
    dims = blocks.dims
    start = np.random.default_rng(dims).standard_normal(dims)
    v = [start / np.linalg.norm(start)]
    z: list[np.ndarray] = []
    back: list[np.ndarray] = []
    alpha: list[float] = []
    beta: list[float] = []
    least = NEGLIGIBLE * np.sqrt(squared)
    while True:
        w = v[-1] - (beta[-1] * z[-1] if z else 0)
        sums = blocks.total(_forth_and_back, np.column_stack([*z, w]), dims + len(z) + 1)
        turned, shares, length = sums[:dims], sums[dims:-1], sums[-1] - (sums[dims:-1] ** 2).sum()
        for share, earlier, known in zip(shares, z, back):
            w, turned = w - share * earlier, turned - share * known
        length = float(np.sqrt(max(0.0, length)))
        alpha.append(length if length > least else 0.0)
        residual = 0.0
        if alpha[-1]:
            z.append(w / length)
            back.append(turned / length)
            rest = _against(back[-1] - length * v[-1], v)
            residual = float(np.linalg.norm(rest)) if len(v) < dims else 0.0
        left, singular, right = np.linalg.svd(np.diag(alpha) + np.diag(beta, 1))
        converged = len(alpha) >= wanted and np.all(residual * np.abs(left[-1, :wanted]) <= TOLERANCE * singular[0])
        if residual <= least or converged:
            kept = singular[:wanted] > least
            return singular[:wanted][kept], (np.column_stack(v) @ right.T)[:, :wanted][:, kept]
        beta.append(residual)
        v.append(rest / residual)


def whitened(
    table: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100000, id_column: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """One row per vector and component: id, ``component, n, deviation, whitened, explained, identity_error``."""
    rows = table.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(all_finite(F.col("vector")) & (F.size("vector") > 0))
    rows = rows.where(F.forall("vector", lambda x: F.abs(x) < float((LARGEST - shift) // scale)))
    blocks = Blocks(rows, scale, shift)
    squared = blocks.total(lambda y, _: np.array([(y * y).sum()]), None, 1)[0]
    if squared:
        singular, axes = bidiagonal(blocks, min(components, blocks.dims), squared)
    else:
        singular, axes = np.zeros(0), np.zeros((blocks.dims, 0))
    count, found = blocks.count, len(singular)
    turn = axes / (singular / np.sqrt(count)) if found else axes
    # Covariance of the whitened rows; they are centred, but for rounding.
    moments = blocks.total(lambda y, t: np.concatenate([((y @ t).T @ (y @ t)).ravel(), (y @ t).sum(0)]), turn, found * found + found)
    mean = moments[found * found :] / max(1, count)
    covariance = moments[: found * found].reshape(found, found) / max(1, count) - np.outer(mean, mean)
    error = float(np.abs(covariance - np.eye(found)).max()) if found else 0.0
    explained = singular**2 / squared if squared else singular
    plain, sent = blocks._plain(), blocks.spark.sparkContext.broadcast(turn)

    def run(batches):
        for batch in batches:
            for ids, block in zip(batch.column("ids"), batch.column("x").to_pylist()):
                ids = ids.values
                values = plain.centred(block) @ sent.value
                away = _deviations(np.frombuffer(block, "<i8").reshape(-1, plain.dims), plain.count, plain.sums)
                each = np.repeat(np.arange(len(ids)), found)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), len(ids))),
                        pa.array(np.full(len(each), plain.count)), pa.array(away, pa.int64()).take(pa.array(each)),
                        pa.array(values.ravel()), pa.array(np.tile(explained, len(ids))), pa.array(np.full(len(each), error)),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    schema = f"id {blocks.id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = blocks.rows.select("ids", "x").mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_column)

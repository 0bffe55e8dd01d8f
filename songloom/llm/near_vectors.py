"""Links between near vectors by an epsilon grid order join.

Vectors are scaled to length one, so a cosine of at least ``c`` is a distance of at most ``sqrt(2 - 2c)``, the
epsilon. They are turned to their principal axes; the leading ones carry a grid with cells of the size of
epsilon, and the vectors are put in the order of their cells. The sequence is cut in intervals, which know the
box they fill along all axes. Intervals meet only where a cell of one is beside a cell of the other and their boxes
are not provably farther apart than epsilon. Two intervals that meet are joined recursively: halves whose
boxes are too far apart are skipped, and only short pieces compare vectors, in double precision. Pairs of intervals are
worked off in tiles of neighbours, so that a block of vectors is sent once per tile and not once per pair.

Equal vectors are one vector with a weight before all this, so a vector that most rows hold costs no more than one.
A task gives back the number of links per vector and the links of a spanning forest, never all pairs.

Vectors of different lengths have no cosine and never link; each length is joined on its own, one after the other, so
a table should not hold many lengths.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; rows with
the same id and vector count as two; labels and other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.llm.common import by_group, rows_per_batch
from songloom.llm.components import components
from songloom.operators.ordering import with_row_index
from songloom.session import stored

#: Vectors per interval, and per piece below which vectors are compared.
INTERVAL = 1024
PIECE = 128
#: Intervals in a row that are joined with as many others by one task.
TILE = 16
#: Leading axes that carry the grid.
GRID_AXES = 2


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, one of them not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so squares neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(classes: DataFrame, dims: int) -> np.ndarray:
    """Principal axes of the unit vectors, from sums that tasks make; ``dims`` squared numbers reach the driver."""

    def run(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix_of(batch.column("vector")))
                total += x.T @ x
        cells = np.arange(dims * dims)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel())], ["cell", "value"])

    parts = classes.select("vector").mapInArrow(run, "cell long, value double")
    rows = parts.groupBy("cell").agg(F.sum("value").alias("value")).collect()
    moments = np.zeros(dims * dims)
    for r in rows:
        moments[r["cell"]] = r["value"]
    moments = moments.reshape(dims, dims)
    _, axes = np.linalg.eigh((moments + moments.T) / 2)
    return axes[:, ::-1]


def _in_grid_order(classes: DataFrame, axes: np.ndarray, epsilon: float) -> DataFrame:
    """``rep, weight, vector`` with the cell ``c0, c1`` and the whole place along the axes as the order inside it."""
    shared = classes.sparkSession.sparkContext.broadcast(axes)  # as large as a vector's length squared

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            turned = unit(matrix_of(batch.column("vector"))) @ shared.value[:, : GRID_AXES + 1]
            cells = np.floor(turned[:, :GRID_AXES] / epsilon).astype(np.int64)
            if cells.shape[1] < 2:
                cells = np.pad(cells, ((0, 0), (0, 2 - cells.shape[1])))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells[:, 0]), pa.array(cells[:, 1]), pa.array(turned[:, -1])],
                [*batch.schema.names, "c0", "c1", "inner"],
            )

    return classes.mapInArrow(run, "rep long, weight long, vector array<double>, c0 long, c1 long, inner double")


def _intervals(ordered: DataFrame, axes: np.ndarray, size: int) -> DataFrame:
    """Runs of ``size`` vectors of the order: ids, weights, vectors as bytes, their cells, and their box along all axes."""
    shared = ordered.sparkSession.sparkContext.broadcast(axes)

    def packed(table: pa.Table, number: int) -> pa.RecordBatch:
        x = unit(matrix_of(table.column("vector").combine_chunks()))
        turned = x @ shared.value
        # Halves are cut along the axis on which they spread most, as deep as pieces go.
        order = _spread_order(turned, PIECE)
        x, turned = x[order], turned[order]
        reps, weights = (table.column(c).to_numpy()[order] for c in ("rep", "weight"))
        cells = sorted(set(zip(table.column("c0").to_pylist(), table.column("c1").to_pylist())))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number]), pa.array([reps.astype("<i8").tobytes()], pa.binary()),
                pa.array([weights.astype("<i8").tobytes()], pa.binary()), pa.array([x.astype("<f8").tobytes()], pa.binary()),
                pa.array([[f"{a},{b}" for a, b in cells]], pa.list_(pa.string())),
                pa.array([turned.min(0).tolist()]), pa.array([turned.max(0).tolist()]),
            ],
            ["interval", "reps", "weights", "vectors", "cells", "low", "high"],
        )

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - rows)
                batch = batch.slice(part.num_rows)
                held.append(part)
                rows += part.num_rows
                if rows == size:
                    yield packed(pa.Table.from_batches(held), number)
                    held, rows, number = [], 0, number + 1
        if rows:
            yield packed(pa.Table.from_batches(held), number)

    schema = "interval long, reps binary, weights binary, vectors binary, cells array<string>, low array<double>, high array<double>"
    return ordered.mapInArrow(run, schema)


def _spread_order(turned: np.ndarray, piece: int) -> np.ndarray:
    """Order in which each half of a run, and each half of that, is compact."""
    if len(turned) <= piece:
        return np.arange(len(turned))
    axis = int(np.argmax(turned.max(0) - turned.min(0)))
    order = np.argsort(turned[:, axis], kind="stable")
    half = len(order) // 2
    left, right = order[:half], order[half:]
    return np.concatenate([left[_spread_order(turned[left], piece)], right[_spread_order(turned[right], piece)]])


def gap(low_a, high_a, low_b, high_b) -> float:
    """Least distance of two boxes."""
    return float(np.sqrt((np.maximum(0, np.maximum(low_a - high_b, low_b - high_a)) ** 2).sum()))


class Join:
    """Recursive join of two runs; gathers weighted link counts and the links of a spanning forest."""

    def __init__(self, a, b, wa, wb, axes, cosine: float, same: bool):
        self.a, self.b, self.wa, self.wb, self.same, self.cosine = a, b, wa, wb, same, cosine
        self.epsilon = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
        self.ta, self.tb = a @ axes, b @ axes
        self.na, self.nb = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        self.parent = list(range(len(a) + (0 if same else len(b))))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def meet(self, i0: int, i1: int, j0: int, j1: int) -> None:
        if self.same and j1 <= i0:
            return  # the mirror image is met from the other side
        ta, tb = self.ta[i0:i1], self.tb[j0:j1]
        if gap(ta.min(0), ta.max(0), tb.min(0), tb.max(0)) > self.epsilon:
            return
        if i1 - i0 <= PIECE and j1 - j0 <= PIECE:
            self.compare(i0, i1, j0, j1)
            return
        cut = lambda x, y: [(x, y)] if y - x <= PIECE else [(x, (x + y) // 2), ((x + y) // 2, y)]
        for x in cut(i0, i1):
            for y in cut(j0, j1):
                self.meet(*x, *y)

    def compare(self, i0: int, i1: int, j0: int, j1: int) -> None:
        near = self.a[i0:i1] @ self.b[j0:j1].T >= self.cosine
        if self.same:
            near &= np.arange(i0, i1)[:, None] < np.arange(j0, j1)[None, :]
        if not near.any():
            return
        self.na[i0:i1] += near @ self.wb[j0:j1]
        back = near.T @ self.wa[i0:i1]
        (self.na if self.same else self.nb)[j0:j1] += back
        shift = 0 if self.same else len(self.a)
        for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
            x, y = self.root(i0 + i), self.root(shift + j0 + j)
            if x != y:
                self.parent[max(x, y)] = min(x, y)


def _join_tile(axes: np.ndarray, cosine: float):
    """Joins the intervals of one tile that were found to meet; a tile holds ``2 * TILE`` intervals at most."""

    def run(table: pa.Table):
        held, asked = {}, []
        for row in table.select(["interval", "partners", "reps", "weights", "vectors"]).to_pylist():
            reps = np.frombuffer(row["reps"], "<i8")
            vectors = np.frombuffer(row["vectors"], "<f8").reshape(len(reps), -1)
            held[row["interval"]] = reps, np.frombuffer(row["weights"], "<i8"), vectors
            asked += [(row["interval"], other) for other in row["partners"]]
        for ia, ib in sorted(asked):
            same = ia == ib
            (ra, wa, a), (rb, wb, b) = held[ia], held[ib]
            join = Join(a, b, wa, wb, axes, cosine, same)
            join.meet(0, len(a), 0, len(b))
            reps = ra if same else np.concatenate([ra, rb])
            counts = join.na if same else np.concatenate([join.na, join.nb])
            roots = reps[[join.root(i) for i in range(len(reps))]]
            linked = counts > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(reps[linked]), pa.array(counts[linked]), pa.array(roots[linked])], ["rep", "links", "root"]
            )

    return run


def _in_tiles(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """Intervals ``ia <= ib`` that meet, by tiles ``ta, tb``: each interval once per tile, with its ``partners`` there.

    ``TILE`` intervals that follow each other are a side of a tile, so a block of vectors travels once for as many
    partners.
    """
    places = stored(with_row_index(runs.select("interval"), ["interval"], "place"), "places")
    tile = lambda s: places.select(F.col("interval").alias(f"i{s}"), F.expr(f"place div {TILE}").alias(f"t{s}"))
    tiled = pairs.join(tile("a"), "ia").join(tile("b"), "ib")
    nobody = F.lit(None).cast("long")
    each = F.array(
        F.struct(F.col("ia").alias("interval"), F.col("ib").alias("partner")), F.struct(F.col("ib").alias("interval"), nobody.alias("partner"))
    )
    members = tiled.select("ta", "tb", F.inline(each)).groupBy("ta", "tb", "interval").agg(F.collect_list("partner").alias("partners"))
    return members.join(runs.select("interval", "reps", "weights", "vectors"), "interval")


def _class_links(classes: DataFrame, dims: int, cosine: float, interval: int) -> DataFrame:
    """``component`` and number of ``links`` per different vector of one length."""
    axes = principal_axes(classes, dims)
    epsilon = math.sqrt(max(1e-12, 2 - 2 * cosine))
    ordered = _in_grid_order(classes, axes, epsilon).repartitionByRange("c0", "c1", "inner").sortWithinPartitions("c0", "c1", "inner")
    runs = stored(_intervals(ordered, axes, interval), "intervals")

    # Intervals that hold neighbouring cells, the order telling which comes first; then those whose boxes are near.
    boxes = runs.select("interval", "low", "high", F.explode("cells").alias("cell"))
    beside = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    part = F.split("cell", ",")
    around = boxes.select("interval", "low", "high", part[0].cast("long").alias("x"), part[1].cast("long").alias("y"), beside.alias("d"))
    around = around.select(
        F.col("interval").alias("ia"), F.col("low").alias("la"), F.col("high").alias("ha"),
        F.concat_ws(",", F.col("x") + F.col("d.i"), F.col("y") + F.col("d.j")).alias("cell"),
    )
    met = around.join(boxes.select(F.col("interval").alias("ib"), F.col("low").alias("lb"), F.col("high").alias("hb"), "cell"), "cell")
    apart = F.zip_with(
        F.zip_with("la", "hb", lambda x, y: x - y), F.zip_with("lb", "ha", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))
    )
    far2 = F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x)
    pairs = met.where((F.col("ia") <= F.col("ib")) & (far2 <= (epsilon + 1e-6) ** 2)).select("ia", "ib").distinct()
    shipped = _in_tiles(stored(pairs, "pairs"), runs)
    with rows_per_batch(classes.sparkSession, 8):
        found = stored(by_group(shipped, ["ta", "tb"], _join_tile(axes, cosine), "rep long, links long, root long"), "near")

    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    return classes.join(counts, "rep", "left").join(named.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.struct("vector").alias("_key"), F.coalesce("component", "rep").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"),
    )


def near_links(
    table: DataFrame, cosine: float = 0.9, id_column: str = "vec_id", vector: str = "embedding", interval: int = INTERVAL,
) -> DataFrame:
    """One row per vector: id, ``n_links, component_id, kept``."""
    rows = table.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.withColumn("vector", F.when(usable(F.col("vector")), F.transform("vector", lambda x: x + F.lit(0.0))))
    known = F.col("vector").isNotNull() & F.col("id").isNotNull()
    classes = stored(
        rows.where(known).groupBy("vector")
        .agg(F.min("id").cast("long").alias("rep"), F.count("*").alias("weight")).select("rep", "weight", "vector"),
        "vectors",
    )
    lengths = [r["dims"] for r in classes.select(F.size("vector").alias("dims")).distinct().orderBy("dims").collect()]
    joined = [_class_links(classes.where(F.size("vector") == d), d, cosine, interval) for d in lengths or [1]]
    per_class = reduce(DataFrame.unionByName, joined)
    out = rows.withColumn("_key", F.when(known, F.struct("vector"))).join(per_class, "_key", "left")
    return out.select(
        F.col("id").alias(id_column), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"), (F.coalesce("component", "id").eqNullSafe(F.col("id"))).alias("kept"),
    )

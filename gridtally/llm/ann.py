"""Approximate nearest neighbours by stable projections in a kd-tree.

Vectors are scaled to length one, where order by cosine is order by Euclidean
distance, and projected on a few Gaussian directions.  For a pair at distance d
the squared projected distance over d squared is chi-square distributed, so the
projected neighbours of a query, taken in increasing order, may stop as soon as
the next is so far away that a point nearer than the k-th verified one would lie
there with small probability only.

A kd-tree over a bounded sample of the projections cuts the space into cells;
every row is indexed in the cell it falls in.  A query is answered in two
passes.  In its own cell it finds a first k-th distance, which bounds how far
the test can let it go; it then visits just the cells that this radius reaches.
In each cell projected neighbours are verified in blocks against the original
vectors, in double precision, until the test holds.  Cells hold bounded numbers
of rows and queries stream past them, so no task gathers more than one cell.

Equal vectors are one point of the index with the smallest ids that can be
asked for; equal queries are searched once.

Defined results: vectors that are null, zero or hold null or non-finite
components take no part, nor do vectors whose length is not that of most; a
row counted twice is one candidate; with too few candidates all are returned;
of equal scores the smaller id is nearer; an empty table has no neighbours; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtally.llm.common import stored

DIMENSIONS = 8
CELL_ROWS = 1024
#: Projected rows that the driver may gather to shape the tree, and the tree's most cells;
#: beyond that cells grow, and are cut into parts of CELL_ROWS when they are searched.
SAMPLE_ROWS = 40_000
MOST_CELLS = 16_384
#: Most tasks of a pass; beyond that a task searches more cells, one after the other.
MOST_TASKS = 65_536
CONFIDENCE = 0.99
BLOCK = 128
SEED = 7


def chi_square_quantile(p: float, df: int) -> float:
    """The value that a chi-square variable stays below with probability p."""

    def below(x: float) -> float:  # the series of the regularised lower gamma function
        a, h = df / 2, x / 2
        term = total = 1 / a
        for i in range(1, 1000):
            term *= h / (a + i)
            total += term
        return total * math.exp(-h + a * math.log(h) - math.lgamma(a)) if h else 0.0

    low, high = 0.0, 200.0 + 4 * df
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


class Tree:
    """A kd-tree's cuts; a point's cell is found by walking down them."""

    def __init__(self, points: np.ndarray, cells: int):
        self.axis, self.cut, self.child = [], [], []
        self.low, self.high = [], []
        m = points.shape[1]
        self._grow(points, cells, np.full(m, -np.inf), np.full(m, np.inf))
        self.axis, self.cut = np.array(self.axis), np.array(self.cut)
        self.child = np.array(self.child)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, points: np.ndarray, cells: int, low: np.ndarray, high: np.ndarray) -> int:
        spread = points.max(0) - points.min(0) if len(points) else np.zeros(len(low))
        axis = int(np.argmax(spread))
        cut = float(np.median(points[:, axis])) if len(points) else 0.0
        right = points[:, axis] > cut
        if cells < 2 or len(points) < 2 or not right.any():
            self.low.append(low)
            self.high.append(high)
            return -len(self.low)  # cells are numbered -1, -2, ...
        node = len(self.axis)
        self.axis.append(axis)
        self.cut.append(cut)
        self.child.append((0, 0))
        upper, lower = high.copy(), low.copy()
        upper[axis] = lower[axis] = cut
        self.child[node] = (
            self._grow(points[~right], cells // 2, low, upper),
            self._grow(points[right], cells - cells // 2, lower, high),
        )
        return node

    def cells_of(self, points: np.ndarray) -> np.ndarray:
        at = np.full(len(points), 0 if len(self.axis) else -1)
        while len(inner := np.flatnonzero(at >= 0)):
            node = at[inner]
            right = points[inner, self.axis[node]] > self.cut[node]
            at[inner] = self.child[node, right.astype(int)]
        return -at - 1

    def reached(self, point: np.ndarray, radius2: float) -> np.ndarray:
        """The cells with a place within the radius of point."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return np.flatnonzero((gap * gap).sum(1) <= radius2)


def usable(vector: Column, size: int) -> Column:
    """Whether vector has size components, all finite, and is not zero."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))),
    )
    return (F.size(vector) == size) & finite & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def scaled(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def directions(size: int, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, dimensions))


class Cell:
    """The points of one cell, searched by increasing projected distance."""

    def __init__(self, ids: list, vectors: np.ndarray, ways: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.norms = np.linalg.norm(vectors, axis=1)
        self.points = (vectors / self.norms[:, None]) @ ways

    def search(self, query: np.ndarray, point: np.ndarray, k: int, floor: float, limit: float):
        """The k best (score, id) above floor, the k-th score known so far."""
        gaps = ((self.points - point) ** 2).sum(1)
        order = np.argsort(gaps, kind="stable")
        unit = math.sqrt(query @ query)
        best: list[tuple[float, int]] = []
        for a in range(0, len(order), BLOCK):
            if gaps[order[a]] > limit * 2 * (1 - floor):
                break
            block = order[a : a + BLOCK]
            scores = self.vectors[block] @ query / (self.norms[block] * unit)
            for i in np.flatnonzero(scores >= floor).tolist():
                score = float(scores[i])
                best += [(-score, int(x)) for x in self.ids[block[i]]]
            best = sorted(best)[:k]
            if len(best) == k:
                floor = max(floor, -best[-1][0])
        return [(-s, i) for s, i in best]


def search_cells(size: int, k: int, limit: float, seed: int):
    """mapInArrow over rows sorted by cell and part, the cell's points before its queries."""

    def run(batches):
        ways = directions(size, seed=seed)
        key, ids, vectors, cell = None, [], [], None
        for batch in batches:
            cells, parts = batch.column("cell").to_pylist(), batch.column("part").to_pylist()
            queries = batch.column("is_query").to_pylist()
            names = batch.column("ids").to_pylist()
            floors = batch.column("floor").to_pylist()
            values = matrix(batch.column("vector"))
            points = scaled(values) @ ways
            found = []
            for i, at in enumerate(zip(cells, parts)):
                if at != key:
                    key, ids, vectors, cell = at, [], [], None
                if not queries[i]:
                    ids.append(names[i])
                    vectors.append(values[i])
                    continue
                if not ids:
                    continue
                if cell is None:
                    cell = Cell(ids, np.array(vectors), ways)
                for score, other in cell.search(values[i], points[i], k, floors[i], limit):
                    found.append((names[i][0], other, score))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([f[1] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.float64()),
                ],
                names=["query", "vec_id", "score"],
            )

    return run


def neighbours(
    df: DataFrame,
    queries: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    confidence: float = CONFIDENCE,
    seed: int = SEED,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that queries selects."""
    rows = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vector_col).cast("array<double>").alias("vector"),
        queries.alias("asked"),
    ).where("id IS NOT NULL AND vector IS NOT NULL")
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"))
    usual = sizes.where("size > 0").orderBy(F.desc("n"), "size").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if usual is None:
        return df.sparkSession.createDataFrame([], empty)
    size = usual["size"]
    rows = rows.where(usable(F.col("vector"), size))

    # One point per distinct vector, under its smallest ids: a query's own and k others.
    same = Window.partitionBy("vector").orderBy("id")
    firsts = (
        rows.select("id", "vector").distinct()
        .withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1)
    )
    points = stored(
        firsts.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")), "ann-points"
    )
    # Written before it is joined back, so that Spark can split a vector that many queries have.
    wanted = rows.where("asked").select("id", "vector").distinct()
    leads = stored(wanted.groupBy("vector").agg(F.min("id").alias("query")), "ann-leads")
    asked = stored(wanted.join(leads, "vector").select("id", "vector", "query"), "ann-asked")

    n = points.count()
    if not n:
        return df.sparkSession.createDataFrame([], empty)
    ways = directions(size, seed=seed)
    share = F.pmod(F.xxhash64("ids"), F.lit(1_000_000)) < int(1e6 * min(1.0, SAMPLE_ROWS / n))
    sample = np.array([r.vector for r in points.where(share).select("vector").toLocalIterator()])
    shape = scaled(sample) @ ways if len(sample) else np.zeros((0, DIMENSIONS))
    tree = Tree(shape, min(MOST_CELLS, max(1, n // CELL_ROWS)))
    parts = max(1, -(-n // (CELL_ROWS * len(tree.low) * 4)))
    limit = chi_square_quantile(confidence, DIMENSIONS)
    shared = df.sparkSession.sparkContext.broadcast(tree)  # at most MOST_CELLS cells
    form = "cell int, part int, is_query boolean, ids array<long>, floor double, vector array<double>"

    def placed(batches):
        """Points in their cells."""
        for batch in batches:
            cells = shared.value.cells_of(scaled(matrix(batch.column("vector"))) @ ways)
            ids = batch.column("ids")
            part = [x[0].as_py() % parts for x in ids]
            yield packed(cells, part, False, ids, np.full(len(ids), -2.0), batch.column("vector"))

    def packed(cells, part, is_query, ids, floors, vectors):
        rows = len(cells)
        columns = [
            pa.array(cells, pa.int32()), pa.array(part, pa.int32()),
            pa.array([is_query] * rows, pa.bool_()), ids.cast(pa.list_(pa.int64())),
            pa.array(floors, pa.float64()), vectors.cast(pa.list_(pa.float64())),
        ]
        return pa.RecordBatch.from_arrays(
            columns, names=["cell", "part", "is_query", "ids", "floor", "vector"]
        )

    def sent(home: bool):
        """Queries to their own cell, or to the others that their radius reaches."""

        def run(batches):
            for batch in batches:
                vectors, floors = batch.column("vector"), batch.column("floor").to_pylist()
                places = scaled(matrix(vectors)) @ ways
                homes = shared.value.cells_of(places)
                pick, cells, part = [], [], []
                for i, own in enumerate(homes.tolist()):
                    to = [own]
                    if not home:
                        radius2 = limit * 2 * (1 - floors[i])
                        to = [c for c in shared.value.reached(places[i], radius2) if c != own]
                    for c in to:
                        pick += [i] * parts
                        cells += [c] * parts
                        part += range(parts)
                take = pa.array(pick, pa.int32())
                ids = pa.array([[x] for x in batch.column("query").to_pylist()])
                kept = [floors[i] for i in pick]
                yield packed(cells, part, True, ids.take(take), kept, vectors.take(take))

        return run

    def searched(questions: DataFrame, home: bool) -> DataFrame:
        """Secondary sort: in each partition a cell's points come first, then its queries."""
        index = points.select("ids", "vector").mapInArrow(placed, form)
        sent_out = questions.mapInArrow(sent(home), form)
        return (
            index.unionByName(sent_out)
            .repartition(max(8, min(MOST_TASKS, n * 4 // CELL_ROWS)), "cell", "part")
            .sortWithinPartitions("cell", "part", "is_query", F.col("ids")[0])
            .mapInArrow(search_cells(size, k + 1, limit, seed), "query long, vec_id long, score double")
        )

    questions = asked.where("query = id").select("query", "vector")
    start = questions.withColumn("floor", F.lit(-1.0))
    first = stored(searched(start, True), "ann-home")
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    floors = (
        first.withColumn("place", F.row_number().over(ranked))
        .where(F.col("place") == k + 1)
        .select("query", F.col("score").alias("floor"))
    )
    wider = questions.join(floors, "query", "left").select(
        "query", "vector", F.coalesce("floor", F.lit(-1.0)).alias("floor")
    )
    found = first.unionByName(searched(wider, False))
    best = (
        found.withColumn("place", F.row_number().over(ranked))
        .where(F.col("place") <= k + 1)
        .groupBy("query")
        .agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))
    )
    # Every query takes the nearest k of its vector's list other than itself.
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("id")), 1, k)
    return (
        asked.select("id", "query")
        .join(best, "query")
        .select(F.col("id").alias("query_id"), F.posexplode(others).alias("rank", "near"))
        .select(
            "query_id",
            (F.col("rank") + 1).cast("int").alias("rank"),
            F.col("near.vec_id").alias("vec_id"),
            F.col("near.score").alias("score"),
        )
    )

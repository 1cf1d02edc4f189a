"""Clusters of vectors around centroids, in exact integers, by annulus search.

A centroid at distance d from a vector has a norm that differs from the vector's by d
at most.  Centroids are therefore sorted by norm.  The distance to the centroid next
in norm is an upper bound for each vector; binary search finds the centroids whose
norms lie in the annulus of that width around the vector's norm, bounds included, and
only these are compared exactly.  Ties go to the smaller number.

A round is one job: tasks assign their vectors and hand on sums and counts per
centroid, a row per task and centroid, which Spark adds up.  What reaches the driver
is one row per centroid.  No row keeps anything from round to round, so a lost task
is done again from the written vectors alone.

Components become integers, floor(scale * x), and all arithmetic is exact: sums are
decimals, means are floored.  That asks for integers within LARGEST, beyond which a
squared distance would pass 64 bits; a vector beyond it is refused with an error.

Defined results: vectors that are null, of another length, or with null or non-finite
components are left out.  Repeated rows are clustered and counted each; several
rows may start as equal centroids, of which the smaller number takes all.  Rows
without id are clustered, but start no centroid.  With fewer vectors than centroids
there are fewer centroids; an empty table gives an empty result.  Other columns are
not read.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import release_memory, stored

CENTROIDS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Of an integer component: 64 squares of twice this still fit 63 bits.
LARGEST = 2**27
#: Relative width by which annuli are widened, over the rounding of their square roots.
SLACK = 1e-9


def integer_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id, v of the vectors that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.where((F.size(vector) == DIMENSIONS) & finite)

    def whole(x: Column) -> Column:
        scaled = F.floor(F.lit(float(SCALE)) * x)
        refused = F.raise_error(F.lit(f"a component is over {LARGEST // SCALE}")).cast("int")
        return F.when(F.abs(x) > LARGEST / SCALE - 1, refused).otherwise(scaled.cast("int"))

    return kept.select(F.col(vec_id).alias("id"), F.transform(v, whole).alias("v"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """The k vectors whose ids have the least hashes; of equal ids the least vectors."""
    named = F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))
    least = vectors.where("id IS NOT NULL").orderBy(F.sha2(named, 256), "v").limit(k)
    return [row["v"] for row in least.collect()]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest of centroids, for each row of x."""
    norms = np.sqrt((centroids * centroids).sum(1).astype(float))
    order = np.argsort(norms, kind="stable")
    ranked = norms[order]
    own = np.sqrt((x * x).sum(1).astype(float))
    place = np.searchsorted(ranked, own)
    low, high = (np.clip(place - step, 0, len(order) - 1) for step in (1, 0))
    seed = order[np.where(own - ranked[low] <= ranked[high] - own, low, high)]
    bound = np.sqrt(((x - centroids[seed]) ** 2).sum(1).astype(float))
    slack = SLACK * (own + bound) + SLACK
    start = np.searchsorted(ranked, own - bound - slack, side="left")
    stop = np.searchsorted(ranked, own + bound + slack, side="right")
    number = np.full(len(x), -1)
    distance = np.full(len(x), np.iinfo(np.int64).max)
    for rank, c in enumerate(order):
        rows = np.flatnonzero((start <= rank) & (rank < stop))
        found = ((x[rows] - centroids[c]) ** 2).sum(1)
        held = distance[rows]
        better = (found < held) | ((found == held) & (c < number[rows]))
        number[rows[better]], distance[rows[better]] = c, found[better]
    return number, distance


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)


def totals(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """Of each centroid with vectors: their number, summed distance and summed components."""

    def add_up(batches):
        k, width = centroids.shape
        counts, high, low, sums = (np.zeros(n, int) for n in (k, k, k, (k, width)))
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch)
                number, distance = nearest(x, centroids)
                counts += np.bincount(number, minlength=k)
                for c in np.unique(number):
                    sums[c] += x[number == c].sum(0)
                    # In halves: the sum of many large distances passes 64 bits.
                    high[c] += (distance[number == c] >> 31).sum()
                    low[c] += (distance[number == c] & (1 << 31) - 1).sum()
        c = np.flatnonzero(counts)
        far = [Decimal((int(high[i]) << 31) + int(low[i])) for i in c]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(c),
                pa.array(counts[c]),
                pa.array(far, pa.decimal128(38, 0)),
                pa.array(sums[c].tolist(), pa.list_(pa.int64())),
            ],
            ["c", "n", "far", "sums"],
        )
        release_memory()

    parts = vectors.mapInArrow(add_up, "c long, n long, far decimal(38,0), sums array<long>")
    measured = F.concat(
        F.array(F.col("n").cast("decimal(38,0)"), "far"), F.col("sums").cast("array<decimal(38,0)>")
    )
    cells = parts.select("c", F.posexplode(measured).alias("i", "x"))
    rows = cells.groupBy("c", "i").agg(F.sum("x").alias("x")).collect()
    found: dict[int, dict[int, int]] = {}
    for row in rows:
        found.setdefault(row["c"], {})[row["i"]] = int(row["x"])
    return {c: (x[0], x[1], [x[i] for i in range(2, len(x))]) for c, x in found.items()}


def clusters(
    df: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector.

    Distances are squared; inertia is their sum over the cluster and over all.
    """
    vectors = stored(integer_vectors(df, vec_id, vector), "cluster-vectors")
    chosen = first_centroids(vectors, k)
    form = f"`{vec_id}` {df.schema[vec_id].dataType.simpleString()}"
    form += ", cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not chosen:
        return df.sparkSession.createDataFrame([], form)
    centroids = np.array(chosen, dtype=np.int64)
    for _ in range(rounds):
        for c, (n, _, sums) in totals(vectors, centroids).items():
            centroids[c] = [s // n for s in sums]
    spread = {c: far for c, (_, far, _) in totals(vectors, centroids).items()}
    inertia = sum(spread.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                number, distance = nearest(matrix(batch), centroids)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        pa.array(number.astype(np.int32)),
                        pa.array(distance),
                        pa.array([spread[c] for c in number]),
                        pa.array(np.full(len(number), inertia)),
                        pa.array([digests[c] for c in number]),
                    ],
                    [vec_id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return vectors.mapInArrow(assign, form)


def _round_sql(n: int) -> str:
    """The centroids after round n from those after the one before."""
    return f"""
near{n} AS (
  SELECT r, arg_min(c, (d, c)) AS c FROM (
    SELECT r, c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM parts v JOIN mean{n - 1} m USING (i)
    GROUP BY r, c) GROUP BY r),
sum{n} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM near{n} JOIN parts USING (r) GROUP BY c, i),
mean{n} AS (
  SELECT m.c, m.i, CASE WHEN n IS NULL THEN m.x ELSE (s - ((s % n) + n) % n) // n END AS x
  FROM mean{n - 1} m LEFT JOIN sum{n} USING (c, i))"""


#: All rounds, one after another, over components as rows.
CLUSTERS_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {DIMENSIONS}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
parts AS MATERIALIZED (SELECT r, unnest(v) AS x, unnest(range({DIMENSIONS})) AS i FROM kept),
firsts AS (
  SELECT r, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS c FROM kept
  WHERE vec_id IS NOT NULL ORDER BY c LIMIT {CENTROIDS}),
mean0 AS (SELECT c, i, x FROM firsts JOIN parts USING (r)),
{",".join(_round_sql(n) for n in range(1, ROUNDS + 1))},
apart AS (
  SELECT r, c, sum((v.x - m.x) * (v.x - m.x))::BIGINT AS d FROM parts v JOIN mean{ROUNDS} m USING (i)
  GROUP BY r, c),
final AS (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM apart GROUP BY r),
digests AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM mean{ROUNDS} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM final JOIN kept USING (r) JOIN digests USING (c)"""

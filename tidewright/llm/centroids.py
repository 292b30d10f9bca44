"""Centroid clustering whose vectors keep bounds from round to round (Yinyang k-means).

Vectors are integers, so distances are exact and ties are decided alike
everywhere. The centroids are clustered into groups once, before the first
round. A vector keeps an upper bound of the distance to its own centroid and
one lower bound for each group: no other centroid of the group is nearer.
When centroids move, the bounds move by as much, and by the triangle
inequality

* a vector whose upper bound is below all its lower bounds stays where it is
  (global filter; the upper bound is measured anew before it gives up);
* else a group whose lower bound is above the upper bound is passed over;
* of the other groups, a centroid that moved too little to come nearer is
  passed over too, and the rest are measured exactly.

Bounds are compared with a margin for rounding, and a centroid that may tie is
always measured, so no filter changes a result.

Each round reads the rows with their bounds, writes them with the new ones to
the shared folder, and sums the components of each cluster (partial sums before
the shuffle). Only centroids, k rows, reach the driver and are sent to tasks;
vectors are never grouped, so equal vectors are no hot key.

Defined cases: vectors that are null, of another length, or with a null or
non-finite component are left out, and so are those with an integer component
beyond LIMIT, whose squared distances 64 bits do not hold; ids may repeat, a
null id hashes as the empty text; ties go to the smaller number; fewer vectors
than k make fewer centroids; a centroid without vectors stays; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

DIMENSIONS, SCALE, K, ROUNDS, GROUPS = 64, 64, 16, 3, 4
#: Greatest magnitude of a component, and up to which sums of 64 squares are exact in doubles.
LIMIT, EXACT_IN_DOUBLES = 1 << 27, 1 << 22
#: Part of a bound that rounding may be off by, with much to spare.
MARGIN = 1e-9
#: Rounds of clustering the centroids themselves.
GROUPING_ROUNDS = 5


def vectors(rows: DataFrame, id_column: str = "vec_id", column: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component of the vectors that can be used."""
    x = F.col(column).cast("array<double>")
    good = (F.size(x) == dimensions) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) <= LIMIT / scale))
    return rows.where(F.coalesce(good, F.lit(False))).select(F.col(id_column).alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("int")).alias("v"))


def first_centroids(rows: DataFrame, k: int = K) -> np.ndarray:
    """The k vectors whose id has the smallest hash, in order of it."""
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    top = rows.orderBy(key, "v").limit(k).collect()  # k rows, whatever the table's size
    return np.array([r["v"] for r in top], np.int64).reshape(len(top), -1 if top else 0)


def squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors (rows) to centers (columns), 64-bit integers."""
    if not x.size or max(np.abs(x).max(), np.abs(centers).max()) < EXACT_IN_DOUBLES:
        a, b = x.astype(np.float64), centers.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centers], axis=1)


def grouped(centers: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The group of each centroid: a few rounds of clustering, from the first ones."""
    seeds = centers[: max(1, groups)].astype(np.float64)
    for _ in range(GROUPING_ROUNDS):
        own = ((centers[:, None, :] - seeds[None, :, :]) ** 2).sum(2).argmin(1)
        seeds = np.array([centers[own == g].mean(0) if (own == g).any() else seeds[g] for g in range(len(seeds))])
    return np.unique(own, return_inverse=True)[1]


def assigned(x: np.ndarray, centers: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower) by measuring every centroid: the first round."""
    d = squared(x, centers)
    own, rows = d.argmin(1), np.arange(len(x))
    far = np.sqrt(d)
    upper = far[rows, own]
    far[rows, own] = np.inf
    return own, upper, np.stack([far[:, group == g].min(1) for g in range(group.max() + 1)], axis=1)


def reassigned(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centers: np.ndarray, moved: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower, distances measured) after the centroids moved by `moved`."""
    drift = np.array([moved[group == g].max() for g in range(lower.shape[1])])
    before, own, upper, lower = lower, own.copy(), upper + moved[own], lower - drift
    measured = np.zeros(len(x), np.int64)
    least = lower.min(1)
    at = np.flatnonzero(upper * (1 + MARGIN) + MARGIN >= least)
    best = np.zeros(len(x), np.int64)  # squared, of those measured
    best[at] = own_distance(x[at], centers, own[at])
    upper[at] = np.sqrt(best[at])
    measured[at] += 1
    at = at[upper[at] * (1 + MARGIN) + MARGIN >= least[at]]
    if not len(at):
        return own, upper, lower, measured
    old, known = own[at], upper[at].copy()  # of each row at hand
    far = np.full((len(at), len(centers)), np.inf)
    scanned = known[:, None] * (1 + MARGIN) + MARGIN >= lower[at]
    for c in range(len(centers)):
        g = group[c]
        bound = before[at, g] - moved[c]
        rows = np.flatnonzero(scanned[:, g] & (c != old))
        far[rows, c] = bound[rows]
        rows = rows[upper[at[rows]] * (1 + MARGIN) + MARGIN >= bound[rows]]
        if len(rows):
            i = at[rows]
            d = squared(x[i], centers[c : c + 1])[:, 0]
            measured[i] += 1
            far[rows, c] = np.sqrt(d)
            nearer = (d < best[i]) | (d == best[i]) & (c < own[i])
            i, d = i[nearer], d[nearer]
            own[i], best[i], upper[i] = c, d, np.sqrt(d)
    rows = np.arange(len(at))
    far[rows, old] = known
    far[rows, own[at]] = np.inf
    for g in range(lower.shape[1]):
        near = far[:, group == g].min(1)
        lower[at, g] = np.where(scanned[:, g], near, np.minimum(lower[at, g], near))
    return own, upper, lower, measured


def own_distance(x: np.ndarray, centers: np.ndarray, own: np.ndarray) -> np.ndarray:
    return ((x - centers[own]) ** 2).sum(1)


def moved_by(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each centroid moved, rounded up."""
    return np.sqrt(((new - old) ** 2).sum(1).astype(np.float64)) * (1 + MARGIN)


def _matrix(b: pa.RecordBatch, column: str, n: int) -> np.ndarray:
    return b.column(column).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, n)


def round_of(rows: DataFrame, centers: np.ndarray, group: np.ndarray, before: np.ndarray | None, last: bool = False) -> DataFrame:
    """rows (vec_id, v[, bounds]) with new bounds; before: the centroids that the bounds are of. last: with the squared distance instead of bounds."""
    vec = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, "
    groups, dimensions = int(group.max()) + 1, centers.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b, "v", dimensions).astype(np.int64)
            if before is None:
                own, upper, lower = assigned(x, centers, group)
                measured = np.full(len(x), len(centers))
            else:
                own, upper, lower, measured = reassigned(x, b.column("cluster").to_numpy().astype(np.int64), b.column("upper").to_numpy(), _matrix(b, "lower", groups), centers, moved_by(before, centers), group)
                measured += b.column("measured").to_numpy()
            out = {"vec_id": b.column("vec_id"), "cluster": own.astype(np.int32)}
            if last:
                out |= {"distance": own_distance(x, centers, own)}
            else:
                out |= {"v": b.column("v"), "upper": upper, "lower": pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * groups, pa.array(lower.ravel()))}
            yield pa.RecordBatch.from_pydict(out | {"measured": measured})

    return rows.mapInArrow(run, vec + ("cluster int, distance long, measured long" if last else "cluster int, v array<int>, upper double, lower array<double>, measured long"))


def centers_of(rows: DataFrame, before: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean; before: where it has no vectors."""
    sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*(F.sum(F.get("v", F.lit(i)).cast("long")) for i in range(before.shape[1]))).alias("s"))
    out = before.copy()
    for r in sums.collect():  # at most one row for each centroid
        out[r["cluster"]] = [s // r["n"] for s in r["s"]]
    return out


def clustered(rows: DataFrame, k: int = K, rounds: int = ROUNDS, groups: int = GROUPS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance: squared, measured: distances to centroids taken in all) of rows (vec_id, v), and the centroids."""
    centers, before = first_centroids(rows, k), None
    if not len(centers):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("measured")).where("false"), centers
    group = grouped(centers, groups)
    for _ in range(rounds):
        rows = staged(round_of(rows, centers, group, before), "bounds")
        before, centers = centers, centers_of(rows, centers)
    return staged(round_of(rows, centers, group, before, last=True), "clusters"), centers


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after three rounds, with its distance, the inertia and its centroid's digest."""
    rows, centers = clustered(vectors(table(spark, sf_dir, "embeddings")))
    sums = rows.groupBy("cluster").agg(F.sum("distance")).collect()  # at most one row for each centroid
    total = sum(s for _, s in sums)
    facts = [(c, s, total, hashlib.sha256(",".join(map(str, centers[c].tolist())).encode()).hexdigest()) for c, s in sums]
    own = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.drop("measured").join(F.broadcast(own), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """Three rounds and the last assignment, each over all centroids."""
    steps = [
        f"kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {K}))",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS (SELECT r, vec_id, v, k, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, k) AS place FROM (SELECT r, vec_id, v, k, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, c{i})) WHERE place = 1)")
        if i < ROUNDS:
            steps.append(f"s{i} AS (SELECT k, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, {DIMENSIONS + 1}) t(i) GROUP BY k, i)")
            steps.append(f"m{i} AS (SELECT k, list((s - ((s % n + n) % n)) // n ORDER BY i) AS c FROM s{i} GROUP BY k)")
            steps.append(f"c{i + 1} AS (SELECT k, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (k))")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (k)"""


OP12_SQL = _sql()

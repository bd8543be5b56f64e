"""Centroid clustering in whole numbers: assignments by a blocked matrix product that is exact.

A vector's components are floor(SCALE * x). |x - c|² is |x|² - 2 x·c + |c|², of which x·c is one
BLAS product for a block of vectors and all centroids. Float64 holds whole numbers below 2^53
exactly; a block whose largest component, with the centroids', keeps every sum below that is
multiplied in float64, another one below 2^63 in 64-bit integers, and any other in Python's
integers. So distances are exact, ties go to the smaller number, and results don't depend on
how rows are dealt out.

A round is one pass: tasks read their rows again from the source, keep sums and counts for each
centroid, and RDD.treeAggregate adds those up, a few kilobytes a task. Driver and tasks hold the
centroids, never rows.

* Vectors of another length, with null or non-finite components, and null vectors are left out.
* Vectors with one identifier are vectors each. Among the first centroids, equal hashes (equal
  identifiers) are in order of their components; a null identifier is hashed as an empty one.
* With fewer than ``clusters`` vectors each is a centroid; an empty table gives no rows.
* A distance or a sum of distances that 64 bits can't hold is null.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import arrow_types, lean

SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = 1
#: Rows that are multiplied at once.
BLOCK = 4096
EXACT, LONG = 1 << 53, 1 << 63


def usable(vector: str, size: int) -> Column:
    """Whether a vector has so many components, all finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == size) & finite, F.lit(False))


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, or Python's where those can't hold it."""
    if not x.size or np.abs(x).max() * scale < EXACT:
        return np.floor(x * scale).astype(np.int64)
    return np.array([scale * n // d for n, d in (float(v).as_integer_ratio() for v in x.ravel())], object).reshape(x.shape)


def greatest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min()), 0) if x.size else 0


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The exact squared distance of each row of x from each centroid."""
    most = x.shape[1] * (greatest(x) + greatest(centroids)) ** 2  # bounds each term and partial sum
    kind = np.float64 if most < EXACT else np.int64 if most < LONG else object
    x, c = x.astype(kind), centroids.astype(kind)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of the nearest centroid and the squared distance."""
    off = squared_distances(x, centroids)
    to = np.argmin(off, axis=1)
    near = off[np.arange(len(x)), to]
    return to, near if near.dtype == object else near.astype(np.int64)


def blocks(batches: Iterator[pa.RecordBatch], at: int, size: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut to blocks, and their vectors in whole numbers."""
    for batch in batches:
        for start in range(0, len(batch), BLOCK):
            some = batch.slice(start, BLOCK)
            flat = some.column(at).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            yield some, whole(flat.reshape(len(some), size), scale)


def added(a: list, b: list) -> list:
    """Sums of two tasks, centroid by centroid."""
    return [x + y for x, y in zip(a, b, strict=True)] if a and b else a or b


def summed(vectors: DataFrame, centroids: np.ndarray, scale: int, components: bool) -> list[int]:
    """By centroid: how many vectors it is nearest to, the sum of their distances and, if asked
    for, of each component; as Python's integers, one after the other."""
    k, size = centroids.shape
    width = 2 + size * components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0] * (k * width)
        for _, x in blocks(batches, 0, size, scale):
            to, off = nearest(x, centroids)
            for c in np.unique(to).tolist():
                mine = to == c
                # a block's sum of numbers below 2^51 is below 2^63
                near, part = off[mine], x[mine]
                near = near if near.dtype != object and greatest(near) < 1 << 51 else near.astype(object)
                part = part if part.dtype != object and greatest(part) < 1 << 51 else part.astype(object)
                row = [int(mine.sum()), int(near.sum()), *(int(v) for v in part.sum(0)[: size * components])]
                sums[c * width : (c + 1) * width] = map(int.__add__, sums[c * width : (c + 1) * width], row)
        yield pa.RecordBatch.from_pydict({"part": pa.array([pickle.dumps(sums)], pa.binary())})

    parts = vectors.mapInArrow(lean(run), "part binary").rdd
    return parts.treeAggregate([], lambda now, row: added(now, pickle.loads(row.part)), added, depth=2 if parts.getNumPartitions() < 1000 else 3) or [0] * (k * width)


def first_centroids(vectors: DataFrame, key: str, vector: str, size: int, clusters: int, seed: int, scale: int) -> np.ndarray:
    """The vectors whose seeded identifiers have the smallest hashes, in order of those."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    found = vectors.select(named.alias("h"), vector).orderBy("h", vector).limit(clusters).collect()
    return whole(np.array([r[1] for r in found], np.float64).reshape(len(found), size), scale)


def moved(centroids: np.ndarray, sums: list[int]) -> np.ndarray:
    """Each centroid at the floor of its vectors' mean; one without vectors stays."""
    k, size = centroids.shape
    rows = np.array(sums, object).reshape(k, 2 + size)
    now = [[s // n for s in row] if n else list(old) for (n, _, *row), old in zip(rows, centroids.astype(object), strict=True)]
    out = np.array(now, object).reshape(k, size)
    return out.astype(np.int64) if greatest(out) < 1 << 62 else out


def clustered(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = 64, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``key``, cluster and distance (squared) of every usable vector, and the centroids; the
    rounds run at once, the assignment when its rows are asked for."""
    own = vectors.select(F.col(key).alias("_key"), F.col(vector).alias("_vector")).where(usable("_vector", size))
    centroids = first_centroids(own, "_key", "_vector", size, clusters, seed, scale)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(centroids, summed(own.select("_vector"), centroids, scale, True))
    schema = pa.schema([pa.field(key, arrow_types(own, ["_key"])[0]), pa.field("cluster", pa.int32()), pa.field("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in blocks(batches, 1, size, scale):
            to, off = nearest(x, centroids)
            near = pa.array([held(d) for d in off.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(to, pa.int32()), near], schema=schema)

    from pyspark.sql.pandas.types import from_arrow_schema

    return own.mapInArrow(lean(run), from_arrow_schema(schema)), centroids


def held(x: float | int) -> int | None:
    """A whole number, or null if 64 bits can't hold it."""
    return int(x) if x < LONG else None


def inertias(vectors: DataFrame, centroids: np.ndarray, vector: str = "embedding", scale: int = SCALE) -> list[int]:
    """For each centroid the sum of the distances of the vectors that are nearest to it."""
    size = centroids.shape[1]
    own = vectors.select(F.col(vector).alias("_vector")).where(usable("_vector", size))
    return summed(own, centroids, scale, False)[1::2]


def digest(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = 64) -> DataFrame:
    """``key``, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable
    vector."""
    rows, centroids = clustered(vectors, key, vector, size)
    sums = inertias(vectors, centroids, vector) if len(centroids) else []
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def of(values: list, kind: str) -> Column:
        chosen = [F.when(F.col("cluster") == i, F.lit(v).cast(kind)) for i, v in enumerate(values)]
        return reduce(lambda a, b: F.coalesce(a, b), chosen, F.lit(None).cast(kind))

    return rows.select(
        key,
        "cluster",
        "distance",
        of([held(s) for s in sums], "long").alias("cluster_inertia"),
        F.lit(held(sum(sums))).cast("long").alias("inertia"),
        of(names, "string").alias("centroid_sha256"),
    )


def _sql(size: int, clusters: int, rounds: int) -> str:
    """The same in SQL, with one common table a round."""
    distance = f"list_sum(list_transform(range(1, {size + 1}), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::bigint"
    steps = [
        f"kept as materialized (select vec_id, list_transform(embedding, lambda v: floor(64 * v::double)::bigint) as x from embeddings where len(embedding) = {size} and len(list_filter(embedding, lambda v: v is not null and isfinite(v))) = {size})",
        f"c0 as materialized (select row_number() over (order by sha256('1:' || vec_id::varchar), x) - 1 as k, x as c from kept qualify k < {clusters})",
    ]
    for r in range(rounds + 1):
        nearest = f"select vec_id, x, arg_min(k, (d, k)) as cluster, min(d) as distance from (select row, vec_id, x, k, {distance} as d from (select *, row_number() over () as row from kept), c{r}) group by row, vec_id, x"
        steps.append(f"a{r} as materialized ({nearest})")
        if r < rounds:
            means = f"select cluster, i, floor_div(sum(x[i]), count(*)) as m from a{r}, range(1, {size + 1}) t(i) group by cluster, i".replace("floor_div(sum(x[i]), count(*))", "((sum(x[i])::bigint - (((sum(x[i])::bigint % count(*)) + count(*)) % count(*))) // count(*))")
            steps.append(f"c{r + 1} as materialized (select k, coalesce(n, c) as c from c{r} left join (select cluster, list(m order by i) as n from ({means}) group by cluster) on k = cluster)")
    last = f"select vec_id, cluster::integer as cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256 from a{rounds} join c{rounds} on k = cluster"
    return f"with {', '.join(steps)} {last}"


SQL = _sql(64, CLUSTERS, ROUNDS)

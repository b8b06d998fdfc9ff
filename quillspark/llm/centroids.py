"""Centroid clustering with an incremental matrix of distances, in exact whole numbers.

A vector's squared distance to a centroid is |x|^2 - 2 x.c + |c|^2, so that the nearest centroid follows from the dot products x.c alone.
Every vector carries its dot products with all centroids in a written table. When a round moves centroids, a vector's products change by
x.(new - old): only the components in which a centroid's change isn't zero are read and multiplied, unmoved centroids cost nothing, and
when no centroid moved the remaining rounds would change nothing and are left out. Each round is one pass that updates the products,
takes the argmin again and adds up its task's vectors by cluster; the driver sees one sum for each cluster and component.

Whole numbers: a component x becomes floor(scale * x). Those of 2**LIMIT_BITS or more have no distance that a long is sure to hold, and
such a vector isn't kept, like one with another number of components, a null or a value that isn't finite. A cluster whose inertia
a long can't hold has a null there.

Nulls and ties: a null id is hashed as the word null. Repeated rows are vectors of their own; among equal ids the start centroids are
the least by components. With fewer vectors than centroids each is a centroid. An empty table, or one without a kept vector, gives an
empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import discard, passing, written

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Components stay below 2**27, so that a squared distance of 64 of them is below 2**62.
LIMIT_BITS = 27
#: Vectors that Python works on at once.
SLICE = 8192


def whole(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """The kept vectors: vec_id, and x as an array of whole numbers."""
    e = F.col("e")
    scaled = F.transform(e, lambda v: F.floor(v.cast("double") * F.lit(float(scale))))
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * F.lit(float(scale))) < F.lit(float(1 << LIMIT_BITS) - 1))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("e"))
    rows = rows.where(e.isNotNull() & (F.size(e) == dimensions)).where(F.forall(e, fine))
    return rows.select("vec_id", scaled.cast("array<int>").alias("x"))


def first_centroids(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors of the smallest hashes, in their order: as many rows as clusters come to the driver."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    found = rows.select(h.alias("h"), "x").orderBy("h", "x").limit(clusters).collect()
    return np.array([r["x"] for r in found], np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(table: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * table.shape[1], pa.int32()), pa.array(table.reshape(-1), kind))


def nearest(dots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per vector the nearest centroid, the first of several, and its |c|^2 - 2 x.c."""
    part = (centroids * centroids).sum(axis=1) - 2 * dots
    cluster = part.argmin(axis=1)
    return cluster, part[np.arange(len(dots)), cluster]


def _pass(old: np.ndarray | None, new: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (vec_id, x, dots) by ``old`` to those by ``new`` with cluster and distance, and at last a row for each cluster's sum.

    Without ``old`` the products start from zero, as if all centroids had come from there.
    """
    change = new - (old if old is not None else np.zeros_like(new))
    moved = [(k, np.flatnonzero(change[k])) for k in range(len(new)) if change[k].any()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clusters, width = new.shape
        sums, counts, kind = np.zeros((clusters, width), np.int64), np.zeros(clusters, np.int64), None
        for whole_batch in batches:
            kind = whole_batch.schema.field(0).type
            for at in range(0, whole_batch.num_rows, SLICE):
                batch = whole_batch.slice(at, SLICE)
                x = _matrix(batch.column(1), width).astype(np.int64)
                dots = _matrix(batch.column(2), clusters).copy() if old is not None else np.zeros((len(x), clusters), np.int64)
                for k, parts in moved:
                    dots[:, k] += x[:, parts] @ change[k, parts]
                cluster, part = nearest(dots, new)
                for k in range(clusters):
                    own = cluster == k
                    sums[k] += x[own].sum(axis=0)
                    counts[k] += own.sum()
                columns = [batch.column(0), batch.column(1), _lists(dots, pa.int64()), pa.array(cluster.astype(np.int32)), pa.array((x * x).sum(axis=1) + part), pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=_NAMES)
        if kind is not None:
            columns = [pa.nulls(clusters, kind), pa.nulls(clusters, pa.list_(pa.int32())), pa.nulls(clusters, pa.list_(pa.int64())), pa.array(np.arange(clusters, dtype=np.int32)), pa.nulls(clusters, pa.int64()), pa.array(counts), _lists(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    return run


_NAMES = ["vec_id", "x", "dots", "cluster", "distance", "n", "sums"]


def assigned(rows: DataFrame, old: np.ndarray | None, new: np.ndarray) -> DataFrame:
    """Written table of the vectors with their products, cluster and distance by ``new``, and of the tasks' sums (rows with n)."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    source = rows if old is None else rows.where("n IS NULL")
    return written(source.select("vec_id", "x", *(["dots"] if old is not None else [])).mapInArrow(_pass(old, new), f"vec_id {kind}, x array<int>, dots array<bigint>, cluster int, distance bigint, n bigint, sums array<bigint>"), "assigned")


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids moved to floor(sum / count) of their vectors; those without vectors stay. One row a cluster and component comes to the driver."""
    sums = state.where("n > 0").select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i")
    out = centroids.copy()
    for r in sums.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        out[r["cluster"], r["i"]] = r["s"] // r["n"]
    return out


def cluster(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 (of the centroid's components, joined by commas)."""
    spark = vectors.sparkSession
    rows = whole(vectors, vec_id, embedding, dimensions, scale)
    centroids = first_centroids(rows, clusters, seed)
    if not len(centroids):
        return rows.select("vec_id", *[F.lit(None).cast(k).alias(n) for n, k in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]).limit(0)
    with passing(spark) as keep:
        state = assigned(rows, None, centroids)
        for _ in range(rounds):
            moved = means(state, centroids)
            if (moved == centroids).all():
                break
            before, state = state, assigned(state, centroids, moved)
            discard(before)
            centroids = moved
        keep(state)
    found = state.where("n IS NULL").select("vec_id", "cluster", "distance")
    own = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda v: v if v < 1 << 63 else None
    shown = [(k, fits(own[k]), hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()) for k in sorted(own)]
    sizes = spark.createDataFrame(shown, "cluster int, cluster_inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(sizes), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(fits(sum(own.values()))).cast("long").alias("inertia"), "centroid_sha256")

"""Centroid clustering in exact integers, screened by float32 products with error intervals.

A vector's components are floor(scale * x). Each round multiplies blocks of vectors with
all centroids in float32 and bounds the rounding error of every distance (for a dot
product of n terms, in any order: n * u / (1 - n * u) times the product of both norms).
Centroids whose interval reaches the least upper end are compared again with exact
integers, ties to the smallest number; every other centroid is proven farther. The tasks
send a count and 64-bit sums per cluster; Spark adds these up as decimals, so a centroid's
floor(sum / count) is exact. The driver sees the centroids alone, never vectors.

Defined cases: vectors that are null, of another length, or hold a null or non-finite
component are left out; a null vec_id is clustered and kept as null, and seeds a centroid
only if there are too few others; repeated rows count each, equal hashes are ordered by
their vectors; fewer vectors than centroids make fewer centroids; an empty table gives no
rows; other columns are ignored. A component of 2**27 or more after scaling, for which
squared distances might leave 64 bits, ends the run with an error that names it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import written

LARGEST = 1 << 27
UNIT = 2.0**-24
#: Vectors multiplied at once: bounds a task's memory, not the result.
BLOCK = 8192


def kept_vectors(df: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): whole vectors, as integers."""
    x = F.col("embedding")
    finite = ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    scaled = F.transform(x, lambda e: F.floor(e.cast("double") * scale))
    large = F.exists(x, lambda e: F.abs(e.cast("double")) * scale >= LARGEST)
    checked = F.when(large, F.raise_error(F.concat(F.lit("a component is too large for 64-bit distances: vec_id "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))))).otherwise(scaled)
    return df.where(F.coalesce((F.size(x) == dims) & finite, F.lit(False))).select("vec_id", checked.cast("array<int>").alias("v"))


def screened(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and exact squared distance of integer vectors, and how many needed exact comparison."""
    vv, cc = (vectors * vectors).sum(1), (centroids * centroids).sum(1)
    dots = vectors.astype(np.float32) @ centroids.astype(np.float32).T
    n = vectors.shape[1] + 2  # two more roundings, as components beyond 2**24 are rounded to float32
    norms = np.sqrt(vv.astype(np.float64))[:, None] * np.sqrt(cc.astype(np.float64))
    total = vv.astype(np.float64)[:, None] + cc.astype(np.float64)
    about = total - 2.0 * dots.astype(np.float64)
    error = 2.0 * (n * UNIT / (1 - n * UNIT)) * norms * (1 + 1e-9) + (total + 2.0 * norms) * 2.0**-49
    near = about - error <= (about + error).min(1)[:, None]
    found = near.argmax(1)
    several = np.flatnonzero(near.sum(1) > 1)
    if len(several):
        row, number = np.nonzero(near[several])
        exact = np.full((len(several), len(centroids)), np.iinfo(np.int64).max)
        exact[row, number] = ((vectors[several[row]] - centroids[number]) ** 2).sum(1)
        found[several] = exact.argmin(1)  # the first of equal distances
    return found, ((vectors - centroids[found]) ** 2).sum(1), len(several)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            part = batch.slice(i, BLOCK)
            values = part.column("v").flatten().to_numpy(zero_copy_only=False)
            yield part.column("vec_id"), values.astype(np.int64).reshape(-1, dims)


def _sums(centroids: np.ndarray):
    """Per task, the count and sums of every cluster that has vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for _, vectors in _blocks(batches, centroids.shape[1]):
            found, _, _ = screened(vectors, centroids)
            for c in np.unique(found):
                own = vectors[found == c]
                sums[c] += own.sum(0)
                counts[c] += len(own)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"]
        )

    return run


def _assign(centroids: np.ndarray, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in _blocks(batches, centroids.shape[1]):
            found, distance, _ = screened(vectors, centroids)
            yield pa.RecordBatch.from_arrays([ids.cast(id_type), pa.array(found.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the driver gets at most (centroids x components) sums."""
    partial = vectors.mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
    wide = partial.select("cluster", "n", F.posexplode("sums").alias("dim", "s"))
    rows = wide.groupBy("cluster", "dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
    moved = centroids.copy()
    for r in rows:
        moved[r["cluster"], r["dim"]] = int(r["s"]) // r["n"]
    return moved


def cluster(df: DataFrame, centroids: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every whole vector of (vec_id, embedding)."""
    spark = df.sparkSession
    schema = f"vec_id {df.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    vectors = written(kept_vectors(df.select("vec_id", "embedding"), dims, scale))
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    start = vectors.orderBy(rank.asc_nulls_last(), "v").limit(centroids).collect()
    means = np.array([r["v"] for r in start], np.int64).reshape(len(start), dims)
    for _ in range(rounds if len(start) else 0):
        means = _moved(vectors, means)
    if not len(start):
        vectors = vectors.limit(0)
        means = np.zeros((1, dims), np.int64)
    from pyspark.sql.pandas.types import to_arrow_type

    found = written(vectors.mapInArrow(_assign(means, to_arrow_type(df.schema["vec_id"].dataType)), schema))
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    total = sum(r["cluster_inertia"] for r in inertia)
    digests = {c: hashlib.sha256(",".join(map(str, m.tolist())).encode()).hexdigest() for c, m in enumerate(means)}
    own = [(r["cluster"], r["cluster_inertia"], total, digests[r["cluster"]]) for r in inertia]
    summary = spark.createDataFrame(own, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(summary), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

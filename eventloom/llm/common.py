"""What the operators of this subpackage share: the shared folder, written cuts of
lineage, connected components, and hashing of words over Arrow buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = bytes([0x20, *range(0x09, 0x0E)])
U = np.uint64
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which driver and executors share.

    A temporary folder serves only where that setting is unset (tests, one machine).
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='eventloom-')}"
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from a table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # the shuffle files of this step go when it ends
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a table made by ``written`` that no later plan reads."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, so that others of the caller's cannot clash with ours."""
    return df.select(*columns)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node on an edge (u, v).

    Alternating large-star and small-star steps: each needs a minimum per node (combined
    before the shuffle) and a join that adaptive execution may split, so a node of any
    degree is no task of its own. Each step is written and reread; the number of steps
    is logarithmic in practice. Raises if ``rounds`` do not settle it.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        if large:
            out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(rounds):
        new = written(star(star(now, True), False))
        row = new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        dropped(now)
        now = new
        if row == mark or not row[0]:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        mark = row
    raise RuntimeError("components did not settle")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply) over an array."""
    x = x.astype(U)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


R = 0x9E3779B97F4A7C15 | 1
R_INVERSE = pow(R, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64 for i < n at least."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        out = []
        for r in (R, R_INVERSE):
            p = np.full(size, r, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[size] = (out[0], out[1])
    return _powers[size]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[list(SPACES)] = 0x20


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; nulls are empty."""
    if not pa.types.is_large_binary(column.type):
        column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``most`` bytes; a longer text stands alone."""
    data, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) and, per text, where its words start (n + 1)."""
    low = LOWER[data]
    space = low == 0x20
    n = len(low)
    begins = np.ones(n + 1, bool)
    begins[1:n] = space[:-1] if n else begins[1:n]
    begins[offsets[offsets < n]] = True
    begins = begins[:n] & ~space
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    ends_at = np.ones(n, bool)
    ends_at[: n - 1] = space[1:]
    ends_at[offsets[(offsets > 0) & (offsets <= n)] - 1] = True
    ends = np.flatnonzero(ends_at & ~space) + 1
    power, inverse = powers(n + 1)
    prefix = np.zeros(n + 1, U)
    np.cumsum(low.astype(U) * power[:n], out=prefix[1:])
    h = mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))
    return h, np.searchsorted(starts, offsets)

"""What the operators of this subpackage share: tables, scratch folders, byte-wise word spans, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in the contracts of this subpackage.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MADE: dict[str, SparkSession] = {}
_KEEP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir); a session without one, as in tests, gets a local folder.

    What is left of it goes when the driver's Python ends (`sweep`). A driver that is killed leaves folders named tessera-*, which any later job may delete.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(sweep)
    _MADE[path] = spark
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sweep() -> None:
    """Deletes the scratch folders that this driver made and has not discarded."""
    while _MADE:
        path, spark = _MADE.popitem()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be stopped already
            return


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage with data that outlives executors, and gives the planner real sizes.

    The shuffle files of the write are dropped with its end: the written table replaces them, so disk holds one step's shuffles and not all steps'.
    """
    spark = df.sparkSession
    path = scratch(spark)
    before = spark.conf.get(_KEEP_SHUFFLES, None)
    spark.conf.set(_KEEP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_KEEP_SHUFFLES) if before is None else spark.conf.set(_KEEP_SHUFFLES, before)
    found = spark.read.schema(df.schema).parquet(path)
    found._tessera_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing reads any more: every reader has been written itself."""
    for df in tables:
        if path := getattr(df, "_tessera_path", None):
            _MADE.pop(path, None)
            _delete(df.sparkSession, path)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each, so that working memory follows the range and not the batch; a longer row is a range of its own."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, is_space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in data, and how many words end before each offset (len(offsets) counts, the first 0)."""
    inside = ~is_space[data]
    cut = np.zeros(len(data) + 1, bool)  # a boundary between texts also separates words
    cut[offsets] = True
    starts = np.flatnonzero(inside & (~np.append(False, inside[:-1]) | cut[:-1]))
    ends = np.flatnonzero(inside & (~np.append(inside[1:], False) | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def space_table(spaces: bytes = SPACES) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(spaces)] = True
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = 0xD6E8FEB86659FD93


def powers(step: int, n: int) -> np.ndarray:
    """step ** 0 ... step ** (n - 1) modulo 2 ** 64."""
    out = np.full(max(n, 1), step, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    within = np.arange(total, dtype=np.int64) - np.repeat(first, lengths)
    values = _BYTE[data[within + np.repeat(starts, lengths)]]
    values *= powers(_STEP, int(lengths.max()))[within]
    return mix(np.add.reduceat(values, first) ^ (lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def unique_key(docs: DataFrame, key: str = "doc_id") -> bool:
    """Whether every row has a key of its own; reads the key's column only."""
    n, known, distinct = docs.agg(F.count(F.lit(1)), F.count(key), F.countDistinct(key)).first()
    return n == known == distinct


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (u long, v long) by alternating large-star and small-star steps over joins; returns (node, root), root the smallest node.

    Each step is written to the shared folder. The minimum per node is a partial aggregate, joined back under adaptive skew splitting; no component is gathered in a task.
    Loops and repeated edges are allowed; nodes without an edge to another node don't appear.
    """
    spark = edges.sparkSession
    e = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(rounds):
        n = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n == mark or not n[0]:
            break
        mark = n
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = materialize(small.union(least.select("u", "m")).toDF("u", "v").distinct())
        discard(e, large)
        e = after
    else:
        raise RuntimeError(f"components: no end after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())

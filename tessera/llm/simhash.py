"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are dealt to tiles by population counts. Two tiles whose counts differ by more than the radius hold no pair within it and are skipped;
the others are compared whole, with numpy's exclusive or and bit counts, large ones by finer counts of the same kind. The pairs of tiles come from a join of
the table of tiles with itself on neighbouring counts. A task returns a spanning forest of the links that it finds, so a group of n near copies gives n links
and not n * n; components come from a distributed large-star/small-star over those. Exact copies meet before, in one aggregate with a row for each
distinct fingerprint.

Null and empty texts have no words and fingerprint zero. Repeated rows are copies of each other. A null doc_id is no representative unless all are null.
`near.py` uses the same tiles on fingerprints of 128 bits, for the pipeline's stage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Fingerprints in a tile, and in a block of comparisons.
TILE, BLOCK = 1 << 16, 1 << 18
SHINGLE, SEED, RADIUS = 3, 42, 3


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of the word shingles of a text, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z, and ASCII white space
    if not words:
        return 0
    ones, n = np.zeros(64, np.int64), max(1, len(words) - width + 1)
    for at in range(0, n, 1 << 15):  # a long text is taken in parts
        part = words[at : at + (1 << 15) + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        h = np.array([xxh64_intdigest(x, SEED) for x in shingles], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp as a signed long) of every whole text."""

    def run(batches):
        for batch in batches:
            data, offsets = common.utf8(batch.column(1))
            got = np.array([fingerprint(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], names=["doc_id", "fp"])

    return docs.select(F.col(key).alias("doc_id"), text).mapInArrow(run, f"doc_id {docs.schema[key].dataType.simpleString()}, fp bigint")


class Forest:
    """Union-find over positions, with the least position as root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        for _ in range(64):
            x, y = root[a], root[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root != root[root]).any():
                root[:] = root[root]
        raise RuntimeError("union-find: no end")


def _counts(x: np.ndarray, word: int) -> np.ndarray:
    return np.bitwise_count((x >> np.uint64(16 * word)) & np.uint64(0xFFFF)).astype(np.int64)


def _fine(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Groups of positions with equal counts in each 16-bit word, with the counts."""
    counts = np.stack([_counts(x, w) for w in range(4)], 1)
    order = np.lexsort(counts.T)
    cuts = np.flatnonzero((np.diff(counts[order], axis=0) != 0).any(1)) + 1
    return [(counts[g[0]], g) for g in np.split(order, cuts) if len(g)]


def links(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, root) of the pairs within the radius, between a and b or, without b, inside a."""
    both = a if b is None else np.concatenate([a, b])
    forest, other, shift = Forest(len(both)), (a if b is None else b), (0 if b is None else len(a))
    whole = [(None, np.arange(len(a)))], [(None, np.arange(len(other)))]
    left, right = (_fine(a), _fine(other)) if len(a) * len(other) > 32 * BLOCK else whole
    for ca, ga in left:
        for cb, gb in right:
            if ca is not None and np.abs(ca - cb).sum() > radius:
                continue
            step = max(1, BLOCK // len(gb))
            for at in range(0, len(ga), step):
                part = ga[at : at + step]
                i, j = np.nonzero(np.bitwise_count(a[part][:, None] ^ other[gb][None, :]) <= radius)
                if len(i):
                    forest.link(part[i], gb[j] + shift)
    node = np.flatnonzero(forest.root != np.arange(len(both)))
    return both[node], both[forest.root[node]]


def tile_pairs(tiles: DataFrame, cells: int, radius: int, axes: int) -> DataFrame:
    """(a, b) of the tiles to compare, a <= b: those whose cells differ by at most the radius. tiles: (tile, cell); a cell numbers `axes` counts of 0 to cells - 1."""
    steps = range(-radius, radius + 1)
    near = [(0, d) for d in steps] if axes == 1 else [(c, d) for c in steps for d in steps if abs(c) + abs(d) <= radius]
    moves = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.lit(d).alias("d")) for c, d in near))).alias("m")
    first, second = F.floor(F.col("cell") / cells) + F.col("m.c"), F.pmod("cell", F.lit(cells)) + F.col("m.d")
    inside = first.between(0, cells - 1) & second.between(0, cells - 1)
    own = tiles.select(F.col("tile").alias("a"), "cell", moves).where(inside).select("a", (first * cells + second).cast("int").alias("cell"))
    return own.join(tiles.withColumnRenamed("tile", "b"), "cell").where("a <= b").select("a", "b")


def tiled(marks: DataFrame) -> DataFrame:
    """marks (fp, cell, ...) with a column tile: a cell's rows are dealt to as many tiles of TILE rows as they fill. Collects a count for each cell, 1,089 at most."""
    sizes = dict(marks.groupBy("cell").count().collect())
    parts = [F.lit(max(1, -(-sizes.get(c, 0) // TILE))) for c in range(max(sizes, default=0) + 1)]
    split = F.element_at(F.array(*parts), F.col("cell") + 1)
    return marks.withColumn("tile", F.col("cell").cast("bigint") * (1 << 32) + F.pmod(F.xxhash64("fp"), split))


def near_links(marks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """marks: (fp), distinct. Returns links (u, v) with the same components as all pairs within the radius."""
    half = lambda x: F.bit_count(x).cast("int")
    cell = half(F.shiftrightunsigned("fp", 32)) * 33 + half(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    marks = tiled(marks.select("fp", cell.alias("cell")))
    tiles = common.materialize(marks.groupBy("tile", "cell").agg(F.collect_list("fp").alias("fps")))
    pairs = tile_pairs(tiles.select("tile", "cell"), 33, radius, 2)
    fps = tiles.select("tile", "fps")
    work = pairs.join(fps.toDF("a", "x"), "a").join(fps.toDF("b", "y"), "b")
    work = work.select("a", "b", "x", F.when(F.col("a") != F.col("b"), F.col("y")).alias("y")).repartition("a", "b")

    def run(batches):
        for batch in batches:
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a = x.values.to_numpy(zero_copy_only=False).view(np.uint64)
                b = y.values.to_numpy(zero_copy_only=False).view(np.uint64) if y.is_valid else None
                u, v = links(a, b, radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return work.mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the least doc_id reachable over links of fingerprints within the radius."""
    marks = common.materialize(fingerprints(docs))
    distinct = common.materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = common.components(near_links(distinct.select("fp"), radius))
    distinct = distinct.join(linked, distinct.fp == linked.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    distinct = common.materialize(distinct)
    roots = distinct.groupBy("root").agg(F.min("least").alias("component_id"))
    of = distinct.join(roots, "root").select(F.col("fp").alias("__fp"), "component_id")
    return marks.join(of, F.col("fp") == F.col("__fp")).select("doc_id", "fp", "component_id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

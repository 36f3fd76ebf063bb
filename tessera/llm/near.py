"""The pipeline's stage of SimHash near-dedup: one document stays of each group linked by a Jaccard similarity of SIMILAR over the sets of SHINGLE-word runs.

Texts are compared as words in lower case (A-Z) between ASCII white space; a text with fewer words is one run, and texts without words, null ones too, are
equal. Candidates come from SimHash by tiles, as in `simhash.py`: fingerprints have BITS bits and lie within RADIUS. At a similarity of just 0.8 bits differ
with a chance of acos(2 * 0.8 / 1.8) / pi = 0.15, so 19 of 128 are expected, with a deviation of 4, and 30 are exceeded by 0.3 % of pairs (sets of under 10
runs: some 5 %); unrelated texts differ in 64, with a deviation of 5.7, and one pair in 10^9 lies within 30. Tiles hold texts of like size, as sets that
differ in size by more than a factor of 1.25 can't be that similar, and blocks whose population counts differ beyond the radius are skipped.

Every link is verified on the whole sets, of 64-bit hashes. Groups of candidates are first compared with their least, which joins groups of near copies
without their pairs; those that still hold several components are compared pair by pair in blocks, skipping what is joined.

The survivor of a group is the row of least doc_id (null ids last), then least hash of its text, so ids may repeat or be null.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, simhash

SHINGLE, SIMILAR, BITS, RADIUS = 5, 0.8, 128, 30
#: Most bits that may differ in the first half of a fingerprint: its mean at 0.8 is 9.7, its deviation 2.9.
HALF_RADIUS = 22
#: Documents in a block of a group that is compared pair by pair.
BLOCK = 200
_C = np.uint64(0x9E3779B97F4A7C15)
_SPACE = common.space_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of words; none for a text without words."""
    data = _LOWER[data]
    starts, ends, first = common.word_spans(data, offsets, _SPACE)
    words = common.word_hashes(data, starts, ends)
    found = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        width = min(SHINGLE, int(b - a))
        h = np.full(max(0, int(b - a) - width + 1) if width else 0, width, np.uint64)
        for i in range(width):
            h = h * _C + words[a + i : a + i + len(h)]
        found.append(np.unique(common.mix(h)))
    return found


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets reaches SIMILAR."""
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILAR * (len(a) + len(b) - both)


def prints(found: list[np.ndarray]) -> np.ndarray:
    """A row of BITS // 64 words for each set: the bits that over half of its members, hashed anew for each word, have."""
    out = np.zeros((len(found), BITS // 64), np.uint64)
    for row, x in enumerate(found):
        for word in range(BITS // 64):
            h = common.mix(x ^ np.uint64(int(_C) * (word + 1) % (1 << 64)))
            ones = sum(np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for at in range(0, len(h), 1 << 15))
            out[row, word] = np.packbits(2 * ones > len(x), bitorder="little").view(np.uint64)[0] if len(x) else 0
    return out


def _key() -> list:
    return [F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("h")]


def _texts(batch, at: int):
    data, offsets = common.utf8(batch.column(at))
    for a, b in common.groups(offsets):
        yield a, b, sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _marks(docs: DataFrame) -> DataFrame:
    """(no_id, d, h, node, size, p0, p1) of every row: a hash of the set of runs, its size and fingerprint."""
    rows = docs.select(*_key(), "text")

    def run(batches):
        for batch in batches:
            for a, b, found in _texts(batch, 3):
                node = [int(np.bitwise_xor.reduce(x)) ^ len(x) for x in found]
                node = common.mix(np.array(node, np.uint64)).view(np.int64)
                fp = prints(found).view(np.int64)
                own = [batch.column(i).slice(a, b - a) for i in range(3)]
                size = pa.array([len(x) for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*own, pa.array(node), size, *(pa.array(fp[:, k]) for k in range(2))], names=["no_id", "d", "h", "node", "size", "p0", "p1"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"no_id boolean, d {kind}, h bigint, node bigint, size bigint, p0 bigint, p1 bigint")


def links(a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, root) of the pairs within RADIUS. a, b: rows of node, p0, p1, as uint64."""

    def ordered(x):
        ones = np.bitwise_count(x[:, 1:]).sum(axis=1, dtype=np.int64)
        by = np.argsort(ones, kind="stable")
        return x[by], ones[by]

    a, ones = ordered(a)
    other, counts = (a, ones) if b is None else ordered(b)
    both = a if b is None else np.concatenate([a, other])
    shift = 0 if b is None else len(a)
    forest, rows = simhash.Forest(len(both)), 64
    for at in range(0, len(a), rows):
        to = min(len(a), at + rows)
        first = max(at if b is None else 0, int(np.searchsorted(counts, ones[at] - RADIUS, "left")))
        last = int(np.searchsorted(counts, ones[to - 1] + RADIUS, "right"))
        step = simhash.BLOCK // rows
        for lo in range(first, last, step):
            hi = min(last, lo + step)
            half = np.bitwise_count(a[at:to, 1][:, None] ^ other[lo:hi, 1][None, :])
            i, j = np.nonzero(half <= HALF_RADIUS)
            good = half[i, j] + np.bitwise_count(a[at:to, 2][i] ^ other[lo:hi, 2][j]) <= RADIUS
            if good.any():
                forest.link(i[good] + at, j[good] + lo + shift)
    node = np.flatnonzero(forest.root != np.arange(len(both)))
    return both[node, 0], both[forest.root[node], 0]


def candidates(nodes: DataFrame) -> DataFrame:
    """nodes: (node, size, p0, p1), a row a node. Links (u, v) with the same components as all pairs of like size within RADIUS."""
    cell = F.floor(F.log("size") / F.log(F.lit(1.26))).cast("int")
    marks = simhash.tiled(nodes.select(F.col("node").alias("fp"), "p0", "p1", cell.alias("cell")))
    tiles = marks.groupBy("tile", "cell").agg(F.collect_list("fp").alias("n"), F.collect_list("p0").alias("p0"), F.collect_list("p1").alias("p1"))
    tiles = common.materialize(tiles)
    pairs = simhash.tile_pairs(tiles.select("tile", "cell"), 129, 1, 1)
    sides = [tiles.select(F.col("tile").alias(side), F.struct("n", "p0", "p1").alias(f"of_{side}")) for side in "ab"]
    work = pairs.join(sides[0], "a").join(sides[1], "b")
    work = work.select("a", "b", "of_a", F.when(F.col("a") != F.col("b"), F.col("of_b")).alias("of_b")).repartition("a", "b")

    def side(x) -> np.ndarray:
        return np.stack([x[k].values.to_numpy(zero_copy_only=False).view(np.uint64) for k in ("n", "p0", "p1")], 1)

    def run(batches):
        for batch in batches:
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = links(side(x), side(y) if y.is_valid else None)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    found = common.materialize(work.mapInArrow(run, "u bigint, v bigint"))
    common.discard(tiles)
    return found


def _sets(docs: DataFrame, places: DataFrame) -> DataFrame:
    """places: (no_id, d, h, node). (node, runs) of each, runs as bytes."""
    rows = docs.select(*_key(), "text").join(places.toDF("__n", "__d", "__h", "node"), F.col("d").eqNullSafe(F.col("__d")) & (F.col("h") == F.col("__h")))

    def run(batches):
        for batch in batches:
            for a, b, found in _texts(batch, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "runs"])

    found = rows.select("node", "text").mapInArrow(run, "node bigint, runs binary")
    return found.groupBy("node").agg(F.min("runs").alias("runs"))  # rows may repeat


def _verify(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """Those of pairs (u, v) that are similar."""

    def run(batches):
        for batch in batches:
            u, v, x, y = batch.columns
            good = [similar(np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)) for p, q in zip(x, y, strict=True)]
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([u.filter(keep), v.filter(keep)], names=["u", "v"])

    return pairs.join(runs.toDF("u", "x"), "u").join(runs.toDF("v", "y"), "v").select("u", "v", "x", "y").mapInArrow(run, "u bigint, v bigint")


def _rest(bands: DataFrame, runs: DataFrame) -> DataFrame:
    """bands: (band, node, root), without each group's least. Links between texts of a group and different roots, found pair by pair."""
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    rows = bands.join(sizes.select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "band")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.select("band", "node", "root", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rows = rows.select("band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "root").join(runs, "node")

    def run(batches):
        u, v = [], []
        flat = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (_, x, y), part in groupby(flat, lambda row: row[:3]):  # a group may go on in the next batch
            own, nodes, roots, found = zip(*(row[3:] for row in part), strict=True)
            label, own, found = np.array(roots), np.array(own), [np.frombuffer(f, np.uint64) for f in found]
            for i in range(1, len(nodes)):
                near = label[:i] != label[i]
                if x != y:
                    near &= own[:i] != own[i]
                for j in np.flatnonzero(near):
                    if label[j] != label[i] and similar(found[i], found[j]):
                        label[label == max(label[i], label[j])] = min(label[i], label[j])
                        u.append(nodes[i])
                        v.append(nodes[j])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    rows = rows.select("band", "x", "y", "own", "node", "root", "runs").repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")
    return rows.mapInArrow(run, "u bigint, v bigint")


def _linked(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """nodes: (node, size, p0, p1, f). (__n, root) of the nodes with a similar one."""
    groups = common.materialize(common.components(candidates(nodes.where("size > 0"))).toDF("__n", "band"))
    wanted = nodes.join(groups, F.col("node") == F.col("__n"))
    runs = common.materialize(_sets(docs, wanted.select("f.no_id", "f.d", "f.h", "node")))
    others = groups.where("__n <> band")
    good = common.materialize(_verify(others.select(F.col("__n").alias("u"), F.col("band").alias("v")), runs))
    star = good.select(F.col("u").alias("__u"), F.col("v").alias("root"))
    bands = others.join(star, F.col("__n") == F.col("__u"), "left").select("band", F.col("__n").alias("node"), F.coalesce("root", "__n").alias("root"))
    more = common.materialize(_rest(bands, runs))
    linked = good.unionByName(good.select(F.col("v").alias("u"), "v").distinct()) if more.isEmpty() else common.components(good.union(more))
    linked = common.materialize(linked.toDF("__n", "root"))
    common.discard(groups, runs, good, more)
    return linked


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the first of their group, unchanged; one of rows that are equal in id and text."""
    marks = common.materialize(_marks(docs))
    own = [F.first(k).alias(k) for k in ("size", "p0", "p1")]
    nodes = common.materialize(marks.groupBy("node").agg(*own, F.min(F.struct("no_id", "d", "h")).alias("f")))
    linked = _linked(nodes, docs)
    roots = nodes.join(linked, F.col("node") == F.col("__n"), "left").groupBy(F.coalesce("root", "node")).agg(F.min("f").alias("f"))
    stay = common.materialize(roots.select(F.col("f.d").alias("__d"), F.col("f.h").alias("__h")))
    common.discard(marks, nodes, linked)
    kept = docs.join(stay, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__h")), "left_semi")
    if common.unique_key(docs):
        return kept
    row = F.struct(*docs.columns)
    return kept.groupBy("doc_id", F.xxhash64("text")).agg(F.min(row).alias("__row")).select("__row.*")

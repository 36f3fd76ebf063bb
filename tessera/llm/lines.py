"""Fuzzy line dedup by MinHash.

Lines are compared in lower case (A-Z) with runs of ASCII white space as one space; lines of nothing but white space are left alone. A line's set is its
8-character shingles (a shorter line is one shingle). One-permutation MinHash with densification gives 60 values in 12 bands of 5, which finds 99 % of pairs at
a Jaccard similarity of 0.8 and more above; every pair that counts is verified on the exact sets, which are made only for pairs that a bound on bit maps of
their shingles leaves (see `apart`). Each line of a bucket is first compared with the bucket's
least line, which joins groups of near copies without their pairs; buckets that still hold several components are then compared pair by pair, skipping
what is joined, in blocks of bounded size. Components come from a distributed union-find, and the first line of each (least doc_id, then place) stays.

Equal lines meet by a 64-bit hash, in one aggregate; they are one node. Null texts have no lines. Rows that repeat an id are one document whose texts
follow each other in the order of their hashes: see `numbered`.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.substrings import _with_uid

SHINGLE, SIMILAR, BANDS, ROWS = 8, 0.8, 12, 5
#: Lines in a block of a bucket that is compared pair by pair.
BLOCK = 500
#: Bits of a line's map of shingles, a multiple of 64.
MAP = 2048
_C = np.uint64(0x9E3779B97F4A7C15)


def normal(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def line_id(normalised: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(normalised, 42)


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def similar(a: set, b: set) -> bool:
    """Whether the Jaccard similarity reaches SIMILAR."""
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both >= SIMILAR * (len(a) + len(b) - both)


def _hashed(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each shingle, repeats included, and the number of its line."""
    lengths = np.array([len(x) for x in lines], np.int64)
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = common.mix(chars + np.uint64(1))
    width = 1
    while width < SHINGLE:
        h = h[: max(0, len(h) - width)] * np.uint64(pow(int(_C), width, 1 << 64)) + h[width:]
        width *= 2
    starts = np.cumsum(lengths) - lengths
    counts = np.maximum(0, lengths - SHINGLE + 1)
    owner = np.repeat(np.arange(len(lines)), counts)
    at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    h = common.mix(h[at])
    short = np.flatnonzero(counts == 0)
    if len(short):
        own = np.array([line_id(b"\0" + lines[i].encode("utf-8", "surrogatepass")) for i in short], np.uint64)
        h, owner = np.append(h, own), np.append(owner, short)
    return h, owner


def maps(lines: list[str]) -> np.ndarray:
    """A row of MAP bits for each line (normalised, not empty), as 64-bit words: the bits that its shingles pick."""
    h, owner = _hashed(lines)
    table = np.zeros((len(lines), MAP), bool)
    table[owner, ((h >> np.uint64(32)) % np.uint64(MAP)).astype(np.int64)] = True
    return np.packbits(table, axis=1).view(np.uint64)


def apart(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether maps a and b (rows of each, or one b) rule similar() out; n: at least the shingles of both together.

    Each differing bit takes a shingle that only one line has, so at least d shingles are not shared; a similarity of s needs d <= n (1 - s) / (1 + s).
    """
    d = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return d * (1 + SIMILAR) > n * (1 - SIMILAR) + 1e-6 * n


def count(line: str) -> int:
    """At least the number of the line's different shingles."""
    return max(1, len(line) - SHINGLE + 1)


def bands(lines: list[str]) -> np.ndarray:
    """A row of BANDS keys for each line (normalised, not empty)."""
    return keys(*_hashed(lines), len(lines))


def keys(h: np.ndarray, owner: np.ndarray, n: int, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A row of keys, one a band, for each of n sets, from the hashes of their members and the numbers of the sets that these are in."""
    bins = bands * rows
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    table = np.full(n * bins, none)
    place = (((h >> np.uint64(40)) * np.uint64(bins)) >> np.uint64(24)).astype(np.int64)
    np.minimum.at(table, owner * bins + place, common.mix(h))
    table = table.reshape(n, bins)
    full = table != none
    row, column = np.nonzero(~full)
    for k in range(1, 400):  # an empty bin takes the value of one that its number picks, the same in every line
        if not len(row):
            break
        source = (common.mix(column.astype(np.uint64) * np.uint64(1000) + np.uint64(k)) % np.uint64(bins)).astype(np.int64)
        got = full[row, source]
        table[row[got], column[got]] = table[row[got], source[got]]
        row, column = row[~got], column[~got]
    table[row, column] = table[row].min(1) if len(row) else 0
    found = np.broadcast_to(common.mix(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands)).copy()
    for k in range(rows):
        found = common.mix(found * _C + table[:, k::rows])
    return found


def numbered(rows: DataFrame) -> DataFrame:
    """rows: (uid, text). (uid, no, id, keys): a row for each line that isn't blank; keys, the bands, only where the id is new to the batch."""

    def run(batches):
        for batch in batches:
            data, offsets = common.utf8(batch.column(1))
            for a, b in common.groups(offsets):
                uid, no, ids, fresh, texts = [], [], [], [], []
                seen: set[int] = set()
                for u, i, j in zip(batch.column(0)[a:b].to_pylist(), offsets[a:b], offsets[a + 1 : b + 1], strict=True):
                    for n, line in enumerate(data[i:j].tobytes().split(b"\n")):
                        if not (line := normal(line)):
                            continue
                        k = line_id(line)
                        uid.append(u)
                        no.append(n)
                        ids.append(k)
                        fresh.append(k not in seen)
                        if k not in seen:
                            seen.add(k)
                            texts.append(line.decode("utf-8", "surrogatepass"))
                if not ids:
                    continue
                fresh = np.array(fresh)
                flat = pa.array(bands(texts).view(np.int64).ravel())
                cuts = np.append(0, np.cumsum(fresh) * BANDS).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(cuts), flat)
                yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(no, pa.int32()), pa.array(np.array(ids, np.uint64).view(np.int64)), keys], names=["uid", "no", "id", "keys"])

    return rows.select("uid", "text").mapInArrow(run, "uid bigint, no int, id bigint, keys array<bigint>")


def _texts(rows: DataFrame, places: DataFrame) -> DataFrame:
    """places: (id, uid, no). (id, line, map) of each."""
    wanted = places.groupBy("uid").agg(F.collect_list(F.struct("no", "id")).alias("at")).withColumnRenamed("uid", "__u")

    def run(batches):
        for batch in batches:
            ids, lines = [], []
            for text, at in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = (text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")
                for x in at:
                    ids.append(x["id"])
                    lines.append(normal(own[x["no"]]).decode("utf-8", "surrogatepass"))
            for at in range(0, len(ids), 2000):
                part = lines[at : at + 2000]
                bits = [row.tobytes() for row in maps(part)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 2000], pa.int64()), pa.array(part, pa.string()), pa.array(bits, pa.binary())], names=["id", "line", "map"])

    return rows.join(wanted, F.col("uid") == F.col("__u")).select("text", "at").mapInArrow(run, "id bigint, line string, map binary")


def _words(bits) -> np.ndarray:
    """Maps as rows of 64-bit words."""
    return np.frombuffer(b"".join(bits.to_pylist() if isinstance(bits, pa.Array) else bits), np.uint64).reshape(-1, MAP // 64)


def _counts(lines: pa.Array) -> np.ndarray:
    """count() of each."""
    return np.maximum(1, pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64) - SHINGLE + 1)


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (u, v) whose lines are similar."""

    def run(batches):
        last, own = None, set()
        for batch in batches:
            u, v, x, y, p, q = batch.columns
            if not len(u):
                continue
            n = np.add(_counts(x), _counts(y))
            good = np.zeros(len(u), bool)
            for i in np.flatnonzero(~apart(_words(p), _words(q), n)):
                if v[i] != last:
                    last, own = v[i], shingles(y[i].as_py())
                good[i] = similar(shingles(x[i].as_py()), own)
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([u.filter(keep), v.filter(keep)], names=["u", "v"])

    joined = pairs.join(texts.toDF("u", "x", "p"), "u").join(texts.toDF("v", "y", "q"), "v").select("u", "v", "x", "y", "p", "q")
    return joined.mapInArrow(run, "u bigint, v bigint")


def _rest(buckets: DataFrame, texts: DataFrame) -> DataFrame:
    """buckets: (band, id, root), without each bucket's least line, which all others were compared with. Links between lines of a bucket and different roots, found pair by pair."""
    sizes = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    part = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = buckets.join(sizes.select(F.col("band").alias("__b"), part.alias("parts")), F.col("band") == F.col("__b"))
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    rows = rows.withColumn("own", own).select("band", "id", "root", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rows = rows.select("band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "root").join(texts, "id")

    def run(batches):
        u, v = [], []
        flat = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (_, x, y), part in groupby(flat, lambda row: row[:3]):  # a group may go on in the next batch
            own, ids, roots, texts, bits = zip(*(row[3:] for row in part), strict=True)
            label = np.array(roots)
            if (label == label[0]).all():
                continue
            own, bits, n = np.array(own), _words(bits), np.array([count(t) for t in texts])
            sets: dict[int, set] = {}  # of the lines that a pair needs
            for i in range(1, len(ids)):
                near = label[:i] != label[i]
                if x != y:
                    near &= own[:i] != own[i]
                near = np.flatnonzero(near)
                for j in near[~apart(bits[near], bits[i], n[near] + n[i])]:
                    if label[j] == label[i]:
                        continue
                    for k in (i, j):
                        if k not in sets:
                            sets[k] = shingles(texts[k])
                    if similar(sets[i], sets[j]):
                        label[label == max(label[i], label[j])] = min(label[i], label[j])
                        u.append(ids[i])
                        v.append(ids[j])
            if len(u) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
                u, v = [], []
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    rows = rows.select("band", "x", "y", "own", "id", "root", "line", "map").repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")
    return rows.mapInArrow(run, "u bigint, v bigint")


def repeated_lines(rows: DataFrame) -> DataFrame:
    """rows: (uid, text). (uid, no, id, root): the lines that are not the first of their component."""
    lines = common.materialize(numbered(rows))
    keyed = lines.where(F.size("keys") > 0).select("id", F.explode("keys").alias("band"))
    least = Window.partitionBy("band")
    keyed = keyed.withColumns({"rep": F.min("id").over(least), "most": F.max("id").over(least)}).where("rep <> most")
    keyed = common.materialize(keyed.select("band", "id", "rep").distinct())
    wanted = lines.join(keyed.select("id").distinct(), "id", "left_semi")
    places = wanted.groupBy("id").agg(F.min(F.struct("uid", "no")).alias("f")).select("id", "f.uid", "f.no")
    texts = common.materialize(_texts(rows, places))
    good = common.materialize(_verify(keyed.where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v")).distinct(), texts))
    linked = common.components(good)
    buckets = keyed.where("id <> rep").join(linked, F.col("id") == F.col("node"), "left").select("band", "id", F.coalesce("root", "id").alias("root"))
    more = common.materialize(_rest(buckets, texts))
    if not more.isEmpty():
        linked = common.components(good.union(more))
    nodes = lines.groupBy("id").agg(F.min(F.struct("uid", "no")).alias("f"), F.count(F.lit(1)).alias("n")).join(linked.toDF("node", "root"), F.col("id") == F.col("node"), "left")
    nodes = nodes.select("id", "f", "n", F.coalesce("root", "id").alias("root"))
    roots = nodes.groupBy("root").agg(F.min("f").alias("first"), F.sum("n").alias("all")).where("all > 1")
    several = nodes.join(roots.withColumnRenamed("root", "__r"), F.col("root") == F.col("__r")).select(F.col("id").alias("__i"), "root", "first")
    several = common.materialize(several)
    common.discard(keyed, texts, good, more)
    found = lines.select("uid", "no", "id").join(several, F.col("id") == F.col("__i"))
    return found.where(F.struct("uid", "no") != F.col("first")).select("uid", "no", "id", "root")


def _per_document(rows: DataFrame) -> DataFrame:
    gone = repeated_lines(rows).groupBy("uid").agg(F.array_sort(F.collect_set("no")).alias("__removed")).withColumnRenamed("uid", "__u")
    return common.materialize(gone)


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) of every row: the numbers, from 0, of the lines that go."""
    rows = _with_uid(docs.select("doc_id", "text"))
    gone = _per_document(rows)
    n = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    n = F.when(F.octet_length("text") > 0, n).otherwise(F.lit(0)).cast("bigint")
    counts = rows.select("uid", "doc_id", n.alias("n_lines"))
    removed = F.coalesce("__removed", F.array().cast("array<int>"))
    return counts.join(gone, F.col("uid") == F.col("__u"), "left").select("doc_id", "n_lines", F.size(removed).cast("bigint").alias("n_removed"), removed.alias("removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs without the repeated lines, other columns unchanged (n_chars, where there is one, follows the text). Documents stay, if need be with an empty text.
    Rows that repeat an id, or have none, are told apart by a hash of their text, as in removed_lines."""
    names = docs.columns
    if common.unique_key(docs):
        gone = _per_document(docs.select(F.col("doc_id").cast("bigint").alias("uid"), "text"))
        joined = docs.join(gone, F.col("doc_id") == F.col("__u"), "left")
    else:
        rows = _with_uid(docs.select("doc_id", "text"))
        marks = rows.select("uid", F.col("doc_id").alias("__d"), F.xxhash64("text").alias("__k")).distinct()
        gone = common.materialize(_per_document(rows).join(marks, F.col("__u") == F.col("uid")).select("__d", "__k", "__removed"))
        joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__k")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("__removed", i)), "\n")
    text = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(kept)
    joined = joined.withColumn("text", text)
    if "n_chars" in names:
        joined = joined.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return joined.select(*names)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    return removed_lines(common.read(spark, sf_dir, "documents"))

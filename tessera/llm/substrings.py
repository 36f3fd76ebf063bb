"""Substring dedup by level-wise doubling.

A window is 20 consecutive words. Level one takes runs of 5 words; those that occur once alone end there. At each further level, runs of twice the length
whose two halves both repeat are compared, 10 words and then 20, until no candidate survives or the windows' own length is reached. At the first level only
the run of least hash in each window is looked at, which every copy of the window picks too, so this saves rows and loses no window. Windows are then ordered
by place under their hash, and all but the first of each are repeats; their words go.

Documents are ordered by id (nulls first); rows that repeat an id are ordered by a hash of their text, and rows equal in both are one document, whose
result each gets. Null texts have no words. Words and windows are compared by 64-bit hashes. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

WINDOW, RUN = 20, 5
_C = 0x9E3779B97F4A7C15 | 1
_SPACE = common.space_table()


def _double(h: np.ndarray, n: int) -> np.ndarray:
    """From hashes of runs of n words those of runs of 2 * n."""
    return h[: max(0, len(h) - n)] * np.uint64(pow(_C, n, 1 << 64)) + h[n:]


class Runs:
    """Hashes of the runs of words in the texts of a range of rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, self.first = common.word_spans(data, offsets, _SPACE)
        words = common.word_hashes(data, starts, ends)
        self.h = words[: max(0, len(words) - RUN + 1)].copy()
        for i in range(1, RUN):
            self.h = self.h * np.uint64(_C) + words[i : len(words) - RUN + 1 + i]
        self.left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(words))  # words from here to the text's end

    def at(self, length: int) -> np.ndarray:
        """Hashes of the runs of RUN * 2 ** k words, by their starts; runs across texts are among them."""
        h, n = self.h, RUN
        while n < length:
            h, n = _double(h, n), 2 * n
        return common.mix(h)

    def picked(self) -> np.ndarray:
        """Starts of the first level's runs: the leftmost least hash in each window."""
        least = common.mix(self.h)
        pick, width = np.arange(len(least)), 1
        while width < WINDOW - RUN + 1:  # of 2, 4, 8, 16 runs
            right = least[width:] < least[:-width]
            least, pick, width = np.where(right, least[width:], least[:-width]), np.where(right, pick[width:], pick[:-width]), 2 * width
        return pick

    def extended(self, alive: np.ndarray, length: int) -> np.ndarray:
        """Starts of the candidates of this length; alive: a mask of the places that repeat at half of it.

        After the first level, whose runs are picked ones, those are the halves of the windows whose pick repeats."""
        if length == 2 * RUN:
            windows = np.flatnonzero(self.left[: len(self.left) - WINDOW + 1] >= WINDOW) if len(self.left) >= WINDOW else np.zeros(0, np.int64)
            windows = windows[alive[self.picked()[windows]]]
            marks = np.zeros(len(self.left) + 1, bool)
            for half in range(0, WINDOW, length):
                marks[windows + half] = True
            return np.flatnonzero(marks)
        at = np.flatnonzero(alive[: max(0, len(self.left) - length + 1)])
        return at[alive[at + length // 2] & (self.left[at] >= length)]

    def row(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1


def _with_uid(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, text): uid is the id where ids are unique, else a number by id and text."""
    if common.unique_key(docs):
        return docs.select(F.col("doc_id").cast("bigint").alias("uid"), "doc_id", "text")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("__h"))
    order = rows.select(F.col("doc_id").alias("__d"), F.col("__h").alias("__k")).distinct().orderBy(F.col("__d").asc_nulls_first(), "__k")
    ids = common.materialize(order.select("*", F.monotonically_increasing_id().alias("uid")))  # of sorted partitions, so it follows the order
    return rows.join(ids, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__k"))).select("uid", "doc_id", "text")


def _salts(key: np.ndarray, uid: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Spreads what a range of rows repeats by itself: for each key, the first place stands for the range, with salt 0, or -1 if the key has other places here;
    those get salts above 0 of their own. So a key has a row for each range under its own hash, however often it occurs."""
    order = np.lexsort((pos, uid, key))
    k, u, p = key[order], uid[order], pos[order]
    first = np.append(True, k[1:] != k[:-1])
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    other = (u != u[head]) | (p != p[head])
    several = np.zeros(len(k), bool)
    several[head[other]] = True
    own = (common.mix(u.astype(np.uint64) * np.uint64(_C) + p.astype(np.uint64)) >> np.uint64(34)).astype(np.int32) + 1
    salt = np.where(other, own, np.where(several[head], -1, 0)).astype(np.int32)
    out = np.empty_like(salt)
    out[order] = salt
    return out


def _rows(key: np.ndarray, uid: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    pos = pos.astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(uid), pa.array(pos), pa.array(_salts(key, uid, pos))], names=["run", "uid", "pos", "salt"])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column; null is empty."""
    n = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(n))


def _level(length: int):
    """A function over batches of (uid, text) and, above the first level, the places that repeat at half the length: rows of the candidates."""

    def run(batches):
        for batch in batches:
            data, offsets = common.utf8(batch.column(1))
            uid = batch.column(0).to_numpy()
            pos, cuts = _lists(batch.column(2)) if length > RUN else (None, None)
            for a, b in common.groups(offsets):
                x = Runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if length == RUN:
                    windows = np.flatnonzero(x.left[: max(0, len(x.left) - WINDOW + 1)] >= WINDOW)
                    at = x.picked()[windows] if len(windows) else windows
                    at = at[np.flatnonzero(np.diff(at, prepend=-1))]
                else:
                    alive = np.zeros(len(x.left) + 1, bool)
                    alive[pos[cuts[a] : cuts[b]] + np.repeat(x.first[:-1], np.diff(cuts[a : b + 1]))] = True
                    at = x.extended(alive, length)
                if len(at):
                    row = x.row(at)
                    yield _rows(x.at(length)[at], uid[a + row], at - x.first[row])

    return run


def _cut(batches):
    names = ["doc_id", "n_words", "n_removed", "kept"]
    for batch in batches:
        data, offsets = common.utf8(batch.column(1))
        pos, cuts = _lists(batch.column(2))
        for a, b in common.groups(offsets):
            part = data[offsets[a] : offsets[b]]
            starts, ends, first = common.word_spans(part, offsets[a : b + 1] - offsets[a], _SPACE)
            edge = np.zeros(len(starts) + WINDOW + 1, np.int32)
            at = pos[cuts[a] : cuts[b]] + np.repeat(first[:-1], np.diff(cuts[a : b + 1]))
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            gone = np.cumsum(edge)[: len(starts)] > 0
            removed = np.add.reduceat(np.append(gone, False).astype(np.int64), first[:-1])
            removed[np.diff(first) == 0] = 0
            kept = []
            raw = part.tobytes()
            for i, j in zip(first[:-1], first[1:], strict=True):
                on = np.flatnonzero(~gone[i:j]) + i
                kept.append(b" ".join([raw[s:e] for s, e in zip(starts[on].tolist(), ends[on].tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(first)), pa.array(removed), pa.array([x.decode() for x in kept], pa.string())], names=names)


def repeated_windows(rows: DataFrame) -> DataFrame:
    """rows: (uid, text). (__u, pos): the starts of the windows whose words also start earlier, by row."""
    own = F.greatest("salt", F.lit(0))
    alive, length = None, RUN
    while True:
        texts = rows.select("uid", "text")
        if alive is not None:
            texts = texts.join(alive, F.col("uid") == F.col("__u")).select("uid", "text", "pos")
        runs = texts.mapInArrow(_level(length), "run bigint, uid bigint, pos int, salt int")
        if length == WINDOW:
            order = Window.partitionBy("run", own).orderBy("uid", "pos")
            runs = runs.withColumns({"u": F.first("uid").over(order), "p": F.first("pos").over(order)}).where("salt > 0 or uid > u or pos > p")
        else:
            runs = runs.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("run", own))).where("n > 1 or salt <> 0")
        found = common.materialize(runs.groupBy("uid").agg(F.collect_set("pos").alias("pos")).withColumnRenamed("uid", "__u"))
        if alive is not None:
            common.discard(alive)
        if length == WINDOW or found.isEmpty():
            return found
        alive, length = found, 2 * length


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row of docs; kept is what stays of the text, its words joined by a space."""
    rows = _with_uid(docs.select("doc_id", "text"))
    repeats = repeated_windows(rows)
    joined = rows.join(repeats, F.col("uid") == F.col("__u"), "left").select("doc_id", "text", "pos")
    return joined.mapInArrow(_cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept string")


def op9_substrings(spark, sf_dir: str) -> DataFrame:
    found = dedup_substrings(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

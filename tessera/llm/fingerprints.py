"""Document fingerprints by consistent weighted sampling.

The terms of a text are its lower-cased words, each weighing 1 + ln(count). For every term and every one of SAMPLES hash functions, r and c are
Gamma(2, 1) and b is uniform, all functions of a hash of the term; with t = floor(ln(weight) / r + b), the term of least c * exp(-r * (t - b) - r) is the
sample, together with t. Two texts agree in a sample with the probability of their generalised Jaccard similarity. A fingerprint keeps a byte of each
sample; `likeness` takes out the chance that bytes agree by accident.

Null and empty texts, and texts of white space, have the fingerprint of zero bytes and likeness 1 to each other.
Rows are in order of id, nulls first; rows that repeat an id are ordered by text.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Hash functions, and terms with their weight whose draws a worker keeps.
SAMPLES, CACHE = 128, 60_000
#: Bytes of text in a range of ids, and the most ranges, whose ends the plan holds.
RANGE_BYTES, MAX_RANGES = 8 << 20, 10_000
_BITS = 16
_U = (np.arange(1 << _BITS, dtype=np.float64) + 0.5) / (1 << _BITS)


def _gamma2() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at _U, by Newton steps on 1 - (1 + x) exp(-x)."""
    x = np.sqrt(2 * _U) + _U
    for _ in range(60):
        x = np.maximum(1e-9, x - (1 - (1 + x) * np.exp(-x) - _U) / np.maximum(x * np.exp(-x), 1e-12))
    return x


class Sampler:
    """Draws by term and weight: one row of keys (the logarithm that is least for the sample) and one of sample bytes."""

    def __init__(self, samples: int = SAMPLES):
        self.gamma = _gamma2().astype(np.float32)
        self.log_gamma = np.log(_gamma2()).astype(np.float32)
        self.streams = common.mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.rows: dict[tuple[bytes, int], int] = {}
        self.keys = np.empty((1 << 10, samples), np.float32)
        self.codes = np.empty((1 << 10, samples), np.uint8)

    def _learn(self, new: list[tuple[bytes, int]]) -> None:
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            seeds = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w, _ in part), np.uint64)
            log_weight = np.log1p(np.log(np.array([n for _, n in part], np.float64))).astype(np.float32)[:, None]
            h = common.mix(seeds[:, None] ^ self.streams[None, :])
            low = np.uint64((1 << _BITS) - 1)
            r = self.gamma[h & low]
            log_c = self.log_gamma[(h >> np.uint64(_BITS)) & low]
            b = _U.astype(np.float32)[(h >> np.uint64(2 * _BITS)) & low]
            t = np.floor(log_weight / r + b)
            n = len(self.rows)
            while n + len(part) > len(self.keys):
                self.keys, self.codes = (np.concatenate([x, np.empty_like(x)]) for x in (self.keys, self.codes))
            self.keys[n : n + len(part)] = log_c - r * (t - b) - r
            self.codes[n : n + len(part)] = (common.mix(h ^ (t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(56)).astype(np.uint8)
            self.rows.update(zip(part, range(n, n + len(part)), strict=True))

    def fingerprint(self, text: str) -> bytes:
        terms = list(Counter(text.lower().encode("utf-8", "replace").split()).items())
        if not terms:
            return bytes(self.keys.shape[1])
        best = code = None
        for at in range(0, len(terms), CACHE // 2):  # a text of more terms is taken in parts
            part = terms[at : at + CACHE // 2]
            if len(self.rows) + len(part) > CACHE:
                self.rows.clear()
            self._learn([x for x in part if x not in self.rows])
            rows = np.fromiter(map(self.rows.__getitem__, part), np.int64, len(part))
            keys = self.keys[rows]
            least = keys.argmin(0)
            every = np.arange(keys.shape[1])
            k, c = keys[least, every], self.codes[rows[least], every]
            best, code = (k, c) if best is None else (np.minimum(best, k), np.where(k < best, c, code))
        return code.tobytes()


@functools.cache
def shared_sampler() -> Sampler:
    """A worker's sampler: tasks that follow each other in one process find the draws that the ones before made."""
    return Sampler()


def likeness(a: bytes, b: bytes) -> float:
    """The generalised Jaccard similarity that two fingerprints estimate, 0 to 1."""
    if a == b:
        return 1.0
    share = float(np.mean(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)))
    return max(0.0, (share - 1 / 256) / (1 - 1 / 256))


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _place(opens: list[int]) -> Column:
    """How many of the sorted ids in `opens` are at most doc_id; null has none. Looks in two steps of about sqrt(len(opens)) comparisons."""
    wide = math.isqrt(len(opens)) + 1
    parts = [opens[i : i + wide] for i in range(0, len(opens), wide)]
    count = lambda a: F.size(F.filter(a, lambda x: x <= F.col("doc_id")))
    part = count(F.array(*(F.lit(x[0]) for x in parts)))
    inside = count(F.element_at(F.array(*(F.array(*map(F.lit, x)) for x in parts)), F.greatest(part, F.lit(1))))
    return F.when(F.col("doc_id").isNull() | (part == 0), F.lit(0)).otherwise((part - 1) * wide + inside)


def with_neighbours(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text (see `edited`; the first text follows the last), and their likeness.

    One shuffle: rows are dealt to ranges of ids at quantiles of the id column, about RANGE_BYTES of text each and each a partition of its own; the first rows of
    a range also go to the range before, as followers. A range streams through its task after a sort that spills. Rows that share one id are in one range.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    if parts is None:
        whole = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
        parts = max(2, min(MAX_RANGES, -(-whole // RANGE_BYTES)))
    known, nulls = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(parts)], 100_000), F.count_if(F.col("doc_id").isNull())).first()
    marks = sorted(set(known or []))
    first = None if nulls or not marks else ids.agg(F.min("doc_id")).first()[0]
    if marks and first is not None:
        marks = sorted({first, *marks})
    opens = marks[1:] if first is not None else marks  # the least id opens the first range unless nulls do
    n = len(opens) + 1
    bucket = _place(opens) if opens else F.lit(0)
    is_first = F.col("doc_id").isNull() if first is None else F.col("doc_id") == F.lit(first)
    leads = is_first | F.coalesce(F.col("doc_id").isin(opens), F.lit(False)) if opens else is_first
    follows = F.when(leads, F.array(F.struct(F.col("__b").alias("b"), F.lit(0).alias("f")), F.struct(F.pmod(F.col("__b") - 1, F.lit(n)).alias("b"), F.lit(1).alias("f")))).otherwise(F.array(F.struct(F.col("__b").alias("b"), F.lit(0).alias("f"))))
    dealt = rows.withColumn("__b", bucket.cast("int")).select("doc_id", "text", F.explode(follows).alias("__p"))
    dealt = dealt.select(F.col("__p.b").alias("b"), F.col("__p.f").alias("f"), "doc_id", "text")

    def run(batches):
        sampler = shared_sampler()
        held = None  # (range, doc_id, text, fingerprint) that waits for its follower

        def close(follower, mark):
            text = edited(held[2], follower)
            other = sampler.fingerprint(text)
            sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
            return held[1], len(held[2]), sha, held[3].hex(), other.hex(), likeness(held[3], other), likeness(held[3], mark)

        for batch in batches:
            out = []
            for b, f, doc_id, text in zip(*(batch.column(i) for i in range(4)), strict=True):
                b, text = b.as_py(), text.as_py()
                if held is not None and held[0] != b:
                    raise RuntimeError("a range has no follower")
                if held is None and f.as_py():
                    continue  # a further follower of a range that is closed
                mark = sampler.fingerprint(text)
                if held is not None:
                    out.append(close(text, mark))
                held = None if f.as_py() else (b, doc_id.as_py(), text, mark)
            if out:
                yield _batch(out)
        if held is not None:
            raise RuntimeError("the last range has no follower")

    return dealt.repartitionById(n, F.col("b")).sortWithinPartitions("b", "f", "doc_id", "text").mapInArrow(run, RESULT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    return with_neighbours(common.read(spark, sf_dir, "documents"))

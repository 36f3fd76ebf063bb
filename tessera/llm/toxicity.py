"""Toxicity by multiple-instance learning.

A text is a bag of sentences. A sentence's probability is logistic in its distinct words, each by
itself and by its stems (leading letters, which inflected forms share); a text's is the noisy-or of its sentences, and that is what
training fits to document labels. Afterwards the sentences of high probability locate the offence: `offending_sentences` lists them, and scores carry their numbers.

Training reads at most MAX_TRAIN labelled texts (those of the least hash of their id, so the choice is random, fixed and bounded), whole, and skips those
that don't fit what is left of MAX_TRAIN_CHARS characters for all together; the model is a table of at most MAX_FEATURES weights. Scoring reads every whole text. Null and empty texts, and texts without words, are one sentence without words.
Sentences end at a full stop, exclamation or question mark followed by white space, at a line's end, or after 200 words.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common

#: Labelled texts that training reads and their characters together, features in the model, texts a feature needs, words in a sentence, letters of stems, words whose weight a worker keeps.
MAX_TRAIN, MAX_TRAIN_CHARS, MAX_FEATURES, MIN_TEXTS, SENTENCE_WORDS, STEMS, CACHE = 4000, 32_000_000, 30_000, 5, 200, (4, 5), 200_000
#: Weights up to this are none: training ends with dropping them, so the model that is returned is the one that scores.
MIN_WEIGHT = 1e-3
_END = re.compile(r"(?<=[.!?])\s+|[\n\r\u0085  ]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[list[str]]:
    """The lower-cased words of each sentence that has any."""
    found = []
    for part in _END.split(text.lower()):
        words = _WORD.findall(part)
        found += [words[i : i + SENTENCE_WORDS] for i in range(0, len(words), SENTENCE_WORDS)]
    return found


def features(word: str) -> list[str]:
    return [word + "$", *(word[:n] for n in STEMS if len(word) >= n)]


class Words(dict):
    """Weights of words, worked out when they are asked for; as many as CACHE stay."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        self[word] = found = sum(self.weights.get(f, 0.0) for f in features(word))
        return found


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.words = weights, bias, Words(weights)

    def __reduce__(self):
        return Model, (self.weights, self.bias)

    def sentence_logits(self, bags: list[list[str]]) -> np.ndarray:
        get = self.words.__getitem__
        return np.array([sum(map(get, set(x))) for x in bags] or [0.0]) + self.bias

    def judge(self, text: str, least: float = 0.5) -> tuple[float, list[tuple[int, float, str]]]:
        """The noisy-or over the text's sentences, and (number, probability, words) of those that reach `least`."""
        bags = sentences(text)
        z = self.sentence_logits(bags)
        score = float(-np.expm1(-np.logaddexp(0, z).sum()))
        found = np.flatnonzero(z[: len(bags)] >= np.log(least / (1 - least)))
        return score, [(int(i), float(1 / (1 + np.exp(-z[i]))), " ".join(bags[i])) for i in found]

    def score(self, text: str) -> float:
        return self.judge(text)[0]

    def offending(self, text: str, least: float = 0.5) -> list[tuple[int, float, str]]:
        return self.judge(text, least)[1]


def _descend(rows, columns, owner, y, w, rounds, lasso, ridge):
    """Proximal gradient steps on the noisy-or's mean negative log-likelihood; w ends with the bias, which has no penalty."""

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.clip(np.bincount(rows, w[:-1][columns], len(owner)) + w[-1], -40, 40)
        p = 1 / (1 + np.exp(-z))
        none = np.bincount(owner, -np.logaddexp(0, z), len(y))  # the logarithm of the chance that no sentence offends
        some = np.maximum(-np.expm1(none), 1e-9)
        g = p * np.where(y > 0, -(1 - some) / some, 1.0)[owner] / len(y)
        grad = np.append(np.bincount(columns, g[rows], len(w) - 1), g.sum())
        grad[:-1] += ridge * w[:-1]
        return float(-np.where(y > 0, np.log(some), none).mean() + ridge / 2 * (w[:-1] ** 2).sum()), grad

    now, grad = loss(w)
    step = 1.0
    for _ in range(rounds):
        while True:
            to = w - step * grad
            to[:-1] = np.sign(to[:-1]) * np.maximum(np.abs(to[:-1]) - step * lasso, 0)
            then, after = loss(to)
            moved = to - w
            if then <= now + grad @ moved + moved @ moved / (2 * step) + 1e-12 or step < 1e-6:
                break
            step /= 2
        turned = after - grad
        w, now, grad = to, then, after
        step = float(np.clip(moved @ moved / max(moved @ turned, 1e-12), 1e-2, 1e4))  # Barzilai and Borwein's step
    return w


def train(texts: list[str], labels: list[int], rounds: int = 80, lasso: float = 3e-4, ridge: float = 1e-5) -> Model:
    """Fits the weights of features and the bias to document labels.

    A first descent under an absolute penalty finds the few features that many texts share; a second fits those alone, so that rare words aren't learnt by heart.
    """
    bags = [sentences(x) or [[]] for x in texts]
    seen: dict[str, int] = {}
    for bag in bags:
        for f in {f for w in {w for s in bag for w in s} for f in features(w)}:
            seen[f] = seen.get(f, 0) + 1
    words = sorted((w for w, n in seen.items() if n >= MIN_TEXTS), key=lambda w: (-seen[w], w))[:MAX_FEATURES]
    at = {w: i for i, w in enumerate(words)}
    rows, columns, owner = [], [], []
    for d, bag in enumerate(bags):
        for s in bag:
            got = [at[f] for w in set(s) for f in features(w) if f in at]
            rows += [len(owner)] * len(got)
            columns += got
            owner.append(d)
    rows, columns, owner = (np.array(x, np.int32) for x in (rows, columns, owner))
    y = np.array(labels, float)
    w = np.zeros(len(words) + 1)
    w[-1] = np.log(max(y.mean(), 1e-3) / max(len(owner) / len(y), 1)) if len(y) else -5.0
    if len(y):
        w = _descend(rows, columns, owner, y, w, rounds, lasso, 0.0)
        kept = np.flatnonzero(w[:-1])
        of = np.full(len(words), -1)
        of[kept] = np.arange(len(kept))
        own = of[columns] >= 0
        w = _descend(rows[own], of[columns[own]], owner, y, np.append(w[kept], w[-1]), rounds, 0.0, ridge)
        words = [words[i] for i in kept]
    return Model({x: float(v) for x, v in zip(words, w[:-1], strict=True) if abs(v) > MIN_WEIGHT}, float(w[-1]))


def held_out() -> Column:
    """Whether a row is kept from training: crc32 of its id modulo 5 is 0. A null id is kept from training."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Trains on labelled rows outside the held-out fold, at most MAX_TRAIN of them; the join sends ids and labels of that many rows, then their texts."""
    named = labels.select("doc_id", F.col("toxic").cast("int").alias("__y")).where(F.col("__y").isin(0, 1) & ~held_out())
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id", "__y").limit(MAX_TRAIN)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__t")).join(F.broadcast(chosen), "doc_id").withColumn("__h", F.xxhash64("__t"))
    key = ["doc_id", "__h", "__y"]
    order = rows.select(*key, F.length("__t").alias("__n")).orderBy(F.xxhash64("doc_id"), "__h", "__y").limit(MAX_TRAIN).collect()
    taken, left = Counter(), MAX_TRAIN_CHARS
    for *row, n in order:
        if n <= left:
            left -= n
            taken[tuple(row)] += 1
    wanted = docs.sparkSession.createDataFrame([*taken], rows.select(*key).schema)
    got = rows.join(F.broadcast(wanted), key).dropDuplicates(key).select(*key, "__t").toArrow()
    found = {tuple(row): t for *row, t in zip(*(c.to_pylist() for c in got.columns), strict=True)}
    both = [(found[row], row[2]) for row, n in taken.items() for _ in range(n)]
    return train([t for t, _ in both], [y for _, y in both])


def score_column(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with the columns score and offending (numbers of the sentences that reach 0.5) after its own, in place of any of these names; whole rows pass through."""
    df = df.drop("score", "offending")
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)
    new = [pa.field("score", pa.float64()), pa.field("offending", pa.list_(pa.int32()))]

    def run(batches):
        own = shared.value
        for batch in batches:
            _, offsets = common.utf8(batch.column(at))
            for a, b in common.groups(offsets):
                part = batch.slice(a, b - a)
                found = [own.judge(x or "") for x in part.column(at).to_pylist()]
                columns = [pa.array([s for s, _ in found], pa.float64()), pa.array([[i for i, _, _ in x] for _, x in found], pa.list_(pa.int32()))]
                schema = part.schema
                for field in new:
                    schema = schema.append(field)
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], schema=schema)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("offending", T.ArrayType(T.IntegerType()))]))


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, sentence, probability, words): a row for each sentence of each text that reaches `least`; words are lower-cased and joined by a space."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            _, offsets = common.utf8(batch.column(1))
            for a, b in common.groups(offsets):
                found = [own.offending(x or "", least) for x in batch.column(1).slice(a, b - a).to_pylist()]
                owner = [a + i for i, x in enumerate(found) for _ in x]
                number, chance, words = zip(*(y for x in found for y in x), strict=True) if owner else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(chance, pa.float64()), pa.array(words, pa.string())], names=["doc_id", "sentence", "probability", "words"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, sentence int, probability double, words string")


def reject_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, unchanged, whose score is under `least`."""
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        own = shared.value
        for batch in batches:
            _, offsets = common.utf8(batch.column(at))
            for a, b in common.groups(offsets):
                part = batch.slice(a, b - a)
                kept = part.filter(pa.array([own.score(x or "") < least for x in part.column(at).to_pylist()], pa.bool_()))
                if kept.num_rows:
                    yield kept

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_column(docs, fit(docs, common.read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"), "offending")

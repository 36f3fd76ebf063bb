"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every run of GRAM words is hashed and the least hash of each SPAN consecutive ones is kept, so that texts which share WINDOW = SPAN + GRAM - 1 words
share a kept hash. Documents that share one with the benchmark are candidates; there, the hits are extended: the windows of WINDOW words around each hit
are compared, word for word, with the items' windows. Items of fewer words are one window each, compared at every place of every document.

The benchmark's hashes and windows are broadcast where they are counted to be few (BROADCAST_ROWS), else joined by shuffle.
Null texts have no words. Rows are told apart by id and text: rows that repeat both get the same result each. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1
BROADCAST_ROWS = 1_000_000
_BETWEEN = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.filter(F.split(F.translate(text, _UPPER + _BETWEEN, _LOWER + " " * len(_BETWEEN)), " "), lambda x: x != "")  # one plain character splits faster than a pattern


def _runs(n: Column, width: int) -> Column:
    """0 ... n - width, or nothing."""
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


def _grams(rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep and g: hashes of GRAM words of the array w. Steps are columns of their own, so that none is worked out anew inside a lambda, and
    elements are taken one by one: slices copy their whole array."""
    h = rows.select(*keep, F.transform("w", lambda x: F.xxhash64(x)).alias("__e"))
    return h.select(*keep, F.transform(_runs(F.size("__e"), GRAM), lambda i: F.xxhash64(*(F.get("__e", i + k) for k in range(GRAM)))).alias("g"))


def _winnowed() -> Column:
    """The distinct least hashes of SPAN consecutive elements of g."""
    return F.array_distinct(F.transform(_runs(F.size("g"), SPAN), lambda i: F.least(*(F.get("g", i + k) for k in range(SPAN)))))


def _windows(at: Column, n: int) -> Column:
    """A row (i, window) for each place in the array `at`: the n words of w from there. Made before rows are, so that none carries w."""
    return F.explode(F.transform(at, lambda i: F.struct(i.alias("i"), F.concat_ws(" ", *(F.get("w", i + k) for k in range(n))).alias("window")))).alias("x")


def _small(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """Broadcasts a table that is counted to be small; a larger one is joined as the planner sees fit."""
    n = df.agg(F.sum(F.lit(1) if weight is None else weight)).first()[0] or 0
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, __h, n_words, n_rows, n_hit, items) of every document, __h a hash of the text; n_rows rows of docs have both."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"))
    items = common.materialize(items).where(F.size("w") > 0)
    long_ = items.where(F.size("w") >= WINDOW)
    none = F.lit(0).cast("bigint")  # what every document has as a mark, so that all have a row
    marks = _grams(long_, []).select(F.explode(_winnowed()).alias("m")).where(F.col("m") != none)
    marks = _small(common.materialize(marks.union(items.sparkSession.range(1).select(none)).distinct()))
    windows = long_.select("item_id", _windows(_runs(F.size("w"), WINDOW), WINDOW)).select("item_id", "x.window").distinct()
    windows = _small(common.materialize(windows))
    key = ["doc_id", "__h"]
    texts = docs.select("doc_id", F.xxhash64("text").alias("__h"), "text")
    rows = texts.select(*key, words(F.col("text")).alias("w"))
    each = _grams(rows.withColumn("n_words", F.size("w")), [*key, "n_words"])
    each = each.select(*key, "n_words", F.explode(F.concat(F.array(none), _winnowed())).alias("m")).join(marks, "m")
    own = F.col("m") == none
    hits = each.groupBy(*key).agg(F.max("n_words").cast("bigint").alias("n_words"), F.count_if(own).alias("n_rows"), F.collect_set(F.when(~own, F.col("m"))).alias("marks"))
    hits = common.materialize(hits)
    near = hits.where(F.size("marks") > 0).select(F.col("doc_id").alias("__d"), F.col("__h").alias("__k"), "marks")
    near = texts.join(_small(near, F.size("marks") + 2), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__k")))
    near = near.select(*key, "marks", words(F.col("text")).alias("w"))
    near = _grams(near, [*key, "marks", "w"])
    near = near.select(*key, "w", F.filter(F.transform("g", lambda g, i: F.when(F.array_contains("marks", g), i)), lambda i: i.isNotNull()).alias("p"))
    starts = F.array_distinct(F.flatten(F.transform("p", lambda p: F.sequence(F.greatest(F.lit(0), p - (SPAN - 1)), F.least(p, F.size("w") - WINDOW)))))
    near = near.select(*key, "w", starts.alias("s")).select(*key, _windows(F.col("s"), WINDOW))
    near = near.select(*key, F.struct("x.i", F.lit(WINDOW).alias("n")).alias("at"), "x.window").join(windows, "window").select(*key, "at", "item_id")
    for n in sorted(r[0] for r in items.where(F.size("w") < WINDOW).select(F.size("w")).distinct().collect()):  # WINDOW - 1 lengths at most
        short = _small(items.where(F.size("w") == n).select("item_id", F.array_join("w", " ").alias("window")).distinct())
        place = rows.select(*key, _windows(_runs(F.size("w"), n), n)).select(*key, F.struct("x.i", F.lit(n).alias("n")).alias("at"), "x.window")
        near = near.union(place.join(short, "window").select(*key, "at", "item_id"))
    covered = F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["i"], x["i"] + x["n"] - 1))))
    near = near.groupBy(*key).agg(F.collect_set("at").alias("at"), F.array_sort(F.collect_set("item_id")).alias("items"))
    near = near.select(F.col("doc_id").alias("__d"), F.col("__h").alias("__k"), F.size(covered).cast("bigint").alias("n_hit"), "items")
    found = hits.join(near, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__k")), "left")
    return found.select(*key, "n_words", "n_rows", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    found = found.withColumn("__r", F.explode(F.sequence(F.lit(1).cast("bigint"), "n_rows")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, unchanged, that hold no window of an item."""
    found = common.materialize(contamination(docs, benchmark).where("n_hit > 0").select(F.col("doc_id").alias("__d"), F.col("__h").alias("__k")))
    return docs.join(_small(found), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__k")), "left_anti")


def sql(docs: str = "documents") -> str:
    """op6 in DuckDB's SQL."""
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {docs}),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS t FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
hit AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, t)),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN names USING (r)"""


ORACLES = {"op6_decontamination": sql()}

"""Packing paragraphs into chunks under a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import token_estimate


def chunk_summary(docs: DataFrame, budget: int = 400) -> DataFrame:
    """(doc_id, n_chunks, max_tokens, total_tokens): a paragraph is a line that isn't empty and costs its tokens + 1; a chunk takes paragraphs while they fit.

    A fold over an array of the document's own: no shuffle.
    """
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(x) > 0)
    costs = docs.select("doc_id", F.transform(lines, lambda x: token_estimate(x) + 1).alias("costs"))
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("n"), zero.alias("cur"), zero.alias("most"), zero.alias("total"))

    def step(a, t):
        fits = (a["cur"] > 0) & (a["cur"] + t <= budget)
        cur = F.when(fits, a["cur"] + t).otherwise(t)
        return F.struct((a["n"] + F.when(fits, 0).otherwise(1)).alias("n"), cur.alias("cur"), F.greatest(a["most"], cur).alias("most"), (a["total"] + t).alias("total"))

    packed = costs.select("doc_id", F.aggregate("costs", start, step).alias("a"))
    return packed.select("doc_id", F.col("a.n").alias("n_chunks"), F.col("a.most").alias("max_tokens"), F.col("a.total").alias("total_tokens"))

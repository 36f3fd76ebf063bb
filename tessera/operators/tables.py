"""Profiling, sampling, deduplication, ranking and joins over any DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def priority_dedup(df: DataFrame, by: list[Column], order: list[Column]) -> DataFrame:
    """One row for each value of `by`: the least in `order`. A partial aggregate, so that a value with a third of all rows is no single task."""
    key = [c.alias(f"__k{i}") for i, c in enumerate(by)]
    row = F.struct(*(o.alias(f"__o{i}") for i, o in enumerate(order)), F.struct(*df.columns).alias("__row"))
    return df.groupBy(*key).agg(F.min(row).alias("__m")).select("__m.__row.*")


def with_totals(df: DataFrame, by: list[str], **totals: Column) -> DataFrame:
    """df with aggregates over its groups on every row: an aggregate, joined back; a hot group is split by adaptive execution, not sorted in one task."""
    sums = df.groupBy(*(F.col(b).alias(f"__{b}") for b in by)).agg(*(c.alias(n) for n, c in totals.items()))
    same = reduce(lambda a, b: a & b, (F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by))
    return df.join(sums, same).select(*df.columns, *totals)


def head_tail(df: DataFrame, by: str, order: str, head: int = 100, tail: int = 20) -> DataFrame:
    """df's first `head` and last `tail` rows of each group, with pos (from 1) and omitted; groups of up to head + tail rows stay whole.

    Two bounded top-n windows, which the planner limits before its shuffle, and a partial count; no group is sorted whole."""
    counted = df.groupBy(F.col(by).alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    first = df.withColumn("__p", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("__p") <= head)
    last = df.withColumn("__b", F.row_number().over(Window.partitionBy(by).orderBy(F.col(order).desc()))).where(F.col("__b") <= tail)
    first = first.join(counted, F.col(by).eqNullSafe(F.col("__g"))).withColumn("pos", F.col("__p").cast("bigint"))
    last = last.join(counted, F.col(by).eqNullSafe(F.col("__g"))).withColumn("pos", F.col("__n") - F.col("__b") + 1).where(F.col("pos") > head)
    omitted = F.greatest(F.col("__n") - head - tail, F.lit(0).cast("bigint")).alias("omitted")
    return first.select(*df.columns, "pos", omitted).unionByName(last.select(*df.columns, "pos", omitted))


def column_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, nulls, distinct_values, least, most) of numeric columns: one scan, rows turned to (name, value) and counted once by value, then by name."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns))).alias("p")
    values = df.select(pairs).groupBy("p.name", "p.v").agg(F.count(F.lit(1)).alias("n"))
    return values.groupBy("name").agg(
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("nulls"), F.count("v").alias("distinct_values"), F.min("v").alias("least"), F.max("v").alias("most")
    )


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, n, share): counts in long form, every value kept; share is of the row's."""
    counts = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    return with_totals(counts, [row], __all=F.sum("n")).select(row, column, "n", F.round(F.col("n") / F.col("__all"), 6).alias("share"))


def exact_percentiles(df: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """(by, p0, p1, ...): linearly interpolated percentiles at any size. Values are counted by value, running sums go by ranges of values (quantile cuts of an
    approximate sketch), so neither a group's values nor their order is one task's; the values around each rank are then picked by comparison."""
    rows = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("__c"))
    cuts = df.groupBy(by).agg(F.percentile_approx(value, [i / 64 for i in range(1, 64)], 10_000).alias("__cuts"), F.count(value).alias("__n"))
    cuts = cuts.withColumnRenamed(by, "__b")
    rows = rows.join(cuts, F.col(by).eqNullSafe(F.col("__b"))).withColumn("__r", F.size(F.filter("__cuts", lambda x: x < F.col(value))))
    ranges = rows.groupBy("__b", "__r").agg(F.sum("__c").alias("__s"))
    base = F.coalesce(F.sum("__s").over(Window.partitionBy("__b").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base")
    ranges = ranges.select(F.col("__b").alias("__b2"), F.col("__r").alias("__r2"), base)
    placed = rows.join(ranges, F.col("__b").eqNullSafe(F.col("__b2")) & (F.col("__r") == F.col("__r2")))
    upto = F.col("__base") + F.sum("__c").over(Window.partitionBy("__b", "__r").orderBy(value))
    placed = placed.withColumn("__upto", upto)
    out = []
    for i, share in enumerate(shares):
        at = (F.col("__n") - 1) * F.lit(share)
        low = F.min(F.when(F.col("__upto") > F.floor(at), F.col(value)))
        high = F.min(F.when(F.col("__upto") > F.ceil(at), F.col(value)))
        part = F.max(at - F.floor(at))
        out.append((low + (high - low) * part).alias(f"p{i}"))
    return placed.groupBy(by).agg(*out)


def counted(df: DataFrame, by: str, order: list[str], slices: Column) -> DataFrame:
    """df with counter: its place, from 1, among the rows of its group. slices: a column that rises with the order, by which a group is cut into tasks."""
    rows = df.withColumn("__s", slices)
    sizes = rows.groupBy(by, "__s").agg(F.count(F.lit(1)).alias("__n"))
    base = F.coalesce(F.sum("__n").over(Window.partitionBy(by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(by).alias("__by"), F.col("__s").alias("__s2"), base.alias("__base"))
    inside = F.row_number().over(Window.partitionBy(by, "__s").orderBy(*order))
    joined = rows.join(sizes, F.col(by).eqNullSafe(F.col("__by")) & F.col("__s").eqNullSafe(F.col("__s2")))
    return joined.select(*df.columns, (F.col("__base") + inside).cast("bigint").alias("counter"))


def word_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, n): a text's words ([a-z0-9], three letters at least) with their counts, summed before they are shuffled."""
    words = df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0))).alias("word"))
    return words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))


def multiset_recall(witness: DataFrame, output: DataFrame, a: str, b: str, text: str = "text") -> DataFrame:
    """(a, b, words, shared) of every witness and output that share a word; shared counts a word as often as both have it. Keys are columns a and b."""
    x, y = word_counts(witness, a, text), word_counts(output, b, text).withColumnRenamed("n", "m")
    words = x.groupBy(a).agg(F.sum("n").cast("bigint").alias("words"))
    shared = x.join(y, "word").groupBy(a, b).agg(F.sum(F.least("n", "m")).cast("bigint").alias("shared"))
    return shared.join(words, a)


def line_repeats(text: Column, least: int = 12) -> Column:
    """(longest_run, most_repeated) of a text's lines of `least` characters or more; shorter ones break a run, empty ones don't. One fold and one sorted pass
    within the row."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) > 0)
    zero = F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.lit(0).alias("most"))

    def step(a, x):
        n = F.when(F.length(x) < least, 0).when(x == a["last"], a["n"] + 1).otherwise(1)
        return F.struct(x.alias("last"), n.alias("n"), F.greatest(a["most"], n).alias("most"))

    long = F.array_sort(F.filter(lines, lambda x: F.length(x) >= least))

    def count(a, x):
        n = F.when(x == a["last"], a["n"] + 1).otherwise(1)
        return F.struct(x.alias("last"), n.alias("n"), F.greatest(a["most"], n).alias("most"))

    return F.struct(F.aggregate(lines, zero, step)["most"].alias("longest_run"), F.aggregate(long, zero, count)["most"].alias("most_repeated"))


def json_paths(df: DataFrame, column: str) -> DataFrame:
    """(pointer, type, n, share, examples) of the members of JSON objects, two levels down, [] for lists' members: types by their first character."""
    top = df.select(F.explode(F.from_json(column, "map<string,string>")).alias("k", "v"))
    top = top.select(F.concat(F.lit("/"), F.replace(F.replace("k", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))).alias("pointer"), "v")
    inner = top.where(F.col("v").startswith("{")).select("pointer", F.explode(F.from_json("v", "map<string,string>")).alias("k", "w")).select(F.concat("pointer", F.lit("/"), "k").alias("pointer"), F.col("w").alias("v"))
    every = top.unionByName(inner)
    kind = (
        F.when(F.col("v").isNull(), "null").when(F.col("v").startswith("{"), "object").when(F.col("v").startswith("["), "array").when(F.col("v").isin("true", "false"), "boolean")
        .when(F.col("v").rlike(r"^-?\d+$"), "integer").when(F.col("v").rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "number").otherwise("string")
    )
    return with_totals(every.groupBy("pointer", kind.alias("type")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("example")), ["pointer"], total=F.sum("n"))


def bootstrap(df: DataFrame, value: str, by: str | None = None, samples: int = 2000, seed: int = 20261013) -> DataFrame:
    """(mean, low, high) of a column's mean by Poisson resampling: every row's weight in each resample is a function of a hash of its place, so partial sums do
    all of it in one pass. The result holds as many sums as resamples, whatever the rows."""
    keyed = df.where(F.col(value).isNotNull()).withColumn("__h", F.xxhash64(*df.columns, F.lit(seed)))
    # Cumulative chances of a Poisson variable of mean 1.
    cuts = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975]
    each = keyed.select(*([by] if by else []), F.col(value).cast("double").alias("__v"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda s: F.struct(s.alias("s"), (F.pmod(F.xxhash64("__h", s), F.lit(1 << 30)) / float(1 << 30)).alias("u")))).alias("r"))
    weight = reduce(lambda a, c: a + F.when(F.col("r.u") >= c, 1).otherwise(0), cuts, F.lit(0))
    each = each.select(*([by] if by else []), "__v", F.col("r.s").alias("s"), weight.alias("w"))
    sums = each.groupBy(*([by] if by else []), "s").agg((F.sum(F.col("w") * F.col("__v")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    means = df.groupBy(*([by] if by else [])).agg(F.avg(F.col(value).cast("double")).alias("mean"), F.count(value).alias("n"))
    ends = sums.groupBy(*([by] if by else [])).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return means.join(ends, by) if by else means.crossJoin(ends)


def verdict(low: Column, high: Column, higher: bool = True) -> Column:
    a, b = (low, high) if higher else (-high, -low)
    return F.when(a > 0, "beats").when(b < 0, "trails").otherwise("ties")


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """df with unique: a name that occurs again gets -2, -3, ... in `order`."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return df.withColumn("unique", F.when(n > 1, F.concat_ws("-", name, n.cast("string"))).otherwise(F.col(name)))


def last_wins(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last in `order`."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("__r")).select("__r.*")


def merged_intervals(df: DataFrame, by: str, low: str, high: str) -> DataFrame:
    """(by, low, high, members): intervals that overlap or touch, as one."""
    order = Window.partitionBy(by).orderBy(low, high)
    before = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("__new", F.when(before.isNull() | (F.col(low) > before), 1).otherwise(0))
    rows = rows.withColumn("__g", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(by, "__g").agg(F.min(low).alias("low"), F.max(high).alias("high"), F.count(F.lit(1)).alias("members")).drop("__g")


def islands(df: DataFrame, by: str, order: list[str], fresh: Column, name: str = "island") -> DataFrame:
    """df with the number, from 1, of the run that each row is in; `fresh` says where one starts, and may use lag over the same order."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("__f", F.when(fresh, 1).otherwise(0)).withColumn(name, F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("__f")


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """left with the value of the last right row of its key at or before its time: a union and a running last, so neither side is multiplied."""
    both = left.select("*", F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v")).unionByName(right.select(by, at, F.lit(0).alias("__side"), F.col(value).alias("__v")), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where("__side = 1").select(*left.columns, F.col("__last").alias(value))

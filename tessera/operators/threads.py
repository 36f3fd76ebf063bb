"""Mail threads: parents by References, roots and depths by pointer doubling, roots of one subject merged."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import normalize_subject


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder of spark.checkpoint.dir, which outlives executors. A session without one, as in tests, gets a local folder."""
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint()


def parents(messages: DataFrame) -> DataFrame:
    """messages: (id, references array, in_reply_to, ts, ...), the first row of an id counts. (id, parent): the last reference that is a message, else the reply's; never itself."""
    key = F.struct(F.col("ts").isNotNull(), "ts")
    own = messages.where("id is not null").groupBy("id").agg(F.min_by(F.struct("references", "in_reply_to"), key).alias("m"))
    asked = F.concat(F.reverse(F.coalesce("m.references", F.array().cast("array<string>"))), F.array("m.in_reply_to"))
    wanted = own.select("id", F.posexplode(asked).alias("place", "up")).where("up is not null and up <> id")
    found = wanted.join(own.select(F.col("id").alias("up")), "up").groupBy("id").agg(F.min_by("up", "place").alias("parent"))
    return own.select("id").join(found, "id", "left")


def rooted(links: DataFrame) -> DataFrame:
    """links: (id, parent or null). (id, root, depth): each round doubles the steps that a pointer has gone, so a chain of n takes log n rounds of one join; members of a cycle are roots."""
    links = cut(links)
    while True:
        at = cut(links.select("id", F.coalesce("parent", "id").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("depth"), F.col("parent").isNull().alias("done")))
        total, gone = at.count(), 1
        while not at.where("not done").isEmpty() and gone <= 2 * total:
            far = at.select(F.col("id").alias("__i"), F.col("up").alias("__u"), F.col("depth").alias("__d"), F.col("done").alias("__e"))
            at = cut(at.join(far, F.col("up") == F.col("__i")).select("id", F.when(F.col("done"), F.col("up")).otherwise(F.col("__u")).alias("up"), F.when(F.col("done"), F.col("depth")).otherwise(F.col("depth") + F.col("__d")).alias("depth"), (F.col("done") | F.col("__e")).alias("done")))
            gone *= 2
        lost = at.where("not done")
        if lost.isEmpty():
            return at.select("id", F.col("up").alias("root"), "depth")
        # After more steps than there are messages a pointer stands on a cycle, and every member of one is some pointer's place.
        members = cut(lost.select(F.col("up").alias("id")).distinct())
        links = cut(links.join(members.withColumn("__c", F.lit(True)), "id", "left").select("id", F.when(F.col("__c").isNull(), F.col("parent")).alias("parent")))


def merged_roots(roots: DataFrame, days: int = 30) -> DataFrame:
    """roots: (id, ts, subject, people array). (id, parent): the earliest other root before it of the same normalized subject (not empty) within `days` with a shared
    address. Pairs meet by (subject, address, span of days), so a common subject alone joins nothing."""
    span = days * 86400
    second = F.coalesce(F.unix_seconds("ts"), F.lit(0))
    rows = roots.select("id", second.alias("s"), normalize_subject("subject").alias("subject"), F.explode("people").alias("who")).where("subject <> ''")
    rows = rows.withColumn("b", F.floor(F.col("s") / span))
    early = rows.select(F.col("id").alias("first"), F.col("s").alias("t"), "subject", "who", F.explode(F.array(F.col("b"), F.col("b") + 1)).alias("b"))
    near = (F.struct("t", "first") < F.struct("s", "id")) & (F.col("s") - F.col("t") <= span)
    found = rows.join(early, ["subject", "who", "b"]).where(near).groupBy("id").agg(F.min_by("first", F.struct("t", "first")).alias("parent"))
    return roots.select("id").join(found, "id", "left")


def threads(messages: DataFrame) -> DataFrame:
    """messages: (id, references, in_reply_to, ts, subject, people). (id, thread, depth, place): threads by their first root, members in order of time."""
    from pyspark.sql import Window

    tree = rooted(parents(messages))
    facts = messages.where("id is not null").groupBy("id").agg(F.min(F.struct(F.col("ts").isNotNull().alias("k"), "ts", "subject", "people")).alias("m")).select("id", "m.ts", "m.subject", "m.people")
    roots = tree.where("id = root").select("id").join(facts, "id")
    groups = rooted(merged_roots(roots)).select(F.col("id").alias("root"), F.col("root").alias("thread"))
    rows = tree.join(groups, "root").join(facts.select("id", "ts"), "id")
    place: Column = F.row_number().over(Window.partitionBy("thread").orderBy(F.col("ts").asc_nulls_first(), "id"))
    return rows.select("id", "thread", "depth", place.alias("place"))

"""Threads, state by key, jobs, and manifests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.operators import threads as H
from tessera.plans.engine import inline, on
from tessera.streaming import folds as S

_EVENTS = "key string, event_id long, s double, kind string, member string"


def replayed(name: str, fold, rows: list[tuple], want: str, columns: str) -> None:
    """A fold over inline events, with what it must give."""
    step, result = fold
    names = ["event_id", *(x.split()[0] for x in result.split(", "))]

    def query(spark, sf_dir):
        df = spark.createDataFrame(rows, _EVENTS).select("key", "event_id", F.timestamp_seconds("s").alias("ts"), "kind", "member")
        return S.replay(df, step, result).select(*names)

    register(name, f"SELECT {columns} FROM (VALUES {want}) v({', '.join(names)})")(query)


hit = lambda i, s, kind="hit", member=None: ("u", i, float(s), kind, member or str(i))
replayed("st01_rate_limit", S.limiter([(2, 60)]), [hit(1, 0), hit(2, 30), hit(3, 50), hit(4, 70), ("v", 5, 70.0, "hit", "5")],
         "(1, true, 1, 60.0), (2, true, 0, 60.0), (3, false, 0, 60.0), (4, true, 0, 90.0), (5, true, 1, 130.0)", "CAST(event_id AS BIGINT) AS event_id, allowed, remaining, CAST(reset AS DOUBLE) AS reset")
replayed("st02_refund", S.limiter([(1, 60)]), [hit(1, 0), hit(2, 10, "refund", "1"), hit(3, 20), hit(4, 30, "refund", "zz")],
         "(1, true, 0, 60.0), (2, true, NULL, NULL), (3, true, 0, 80.0), (4, false, NULL, NULL)", "CAST(event_id AS BIGINT) AS event_id, allowed, remaining, CAST(reset AS DOUBLE) AS reset")
replayed("st03_two_windows", S.limiter([(2, 60), (3, 86400)]), [hit(1, 0), hit(2, 10), hit(3, 20), hit(4, 100), hit(5, 200)],
         "(1, true, 1, 60.0), (2, true, 0, 60.0), (3, false, 0, 60.0), (4, true, 0, 86400.0), (5, false, 0, 86400.0)", "CAST(event_id AS BIGINT) AS event_id, allowed, remaining, CAST(reset AS DOUBLE) AS reset")
replayed("st04_gauge", S.gauge(60), [hit(1, 0, "up"), hit(2, 10, "up"), hit(3, 61, "up"), hit(4, 65, "down")], "(1, 1), (2, 2), (3, 2), (4, 1)", "CAST(event_id AS BIGINT) AS event_id, level")
replayed("st06_event_log", S.event_log(3), [*(hit(i, i, "event") for i in range(1, 6)), hit(6, 6, "resume", "4"), hit(7, 7, "resume", "1")],
         "(1, 1, NULL, NULL), (2, 2, NULL, NULL), (3, 3, NULL, NULL), (4, 4, NULL, NULL), (5, 5, NULL, NULL), (6, NULL, 1, false), (7, NULL, 3, true)", "CAST(event_id AS BIGINT) AS event_id, seq, pending, lost")
LEGAL = {"queued": ["running", "cancelled"], "running": ["done", "failed", "queued"], "failed": ["queued"]}
replayed("st07_job_states", S.machine(LEGAL, "queued"), [hit(1, 0, "running"), hit(2, 1, "done"), hit(3, 2, "running"), ("v", 4, 0.0, "done", "")],
         "(1, 'queued', true), (2, 'running', true), (3, 'done', false), (4, 'queued', false)", "CAST(event_id AS BIGINT) AS event_id, before, legal")
replayed("st11_token_bucket", S.bucket(1.0, 2.0, 0.5, 0.5, 0.25), [hit(1, 0), hit(2, 0), hit(3, 0), hit(4, 1, "busy"), hit(5, 2)],
         "(1, true, 1.5), (2, true, 2.0), (3, false, 2.0), (4, NULL, 1.0), (5, true, 1.5)", "CAST(event_id AS BIGINT) AS event_id, taken, CAST(rate AS DOUBLE) AS rate")

_JOBS = [(1, "running", "light", 0, 0), (2, "running", "heavy", 0, 900), (3, "queued", "light", 0, 0), (4, "done", "light", 0, 10), (5, "running", "light", 0, 950)]


@inline("st08_reapers", "job int, state string, queue string, created int, updated int", _JOBS, "SELECT * FROM (VALUES (1, 'stale'), (3, 'unclaimed')) v(job, reason)")
def st08(df):
    """At second 1,000: running jobs past their queue's limit and a grace of 60, queued ones that nobody took in 600."""
    limit = F.when(F.col("queue") == "heavy", 300).otherwise(120)
    stale = (F.col("state") == "running") & (F.col("updated") + limit + 60 < 1000)
    idle = (F.col("state") == "queued") & (F.col("created") + 600 < 1000)
    return df.select("job", F.when(stale, "stale").when(idle, "unclaimed").alias("reason")).where("reason is not null")


@on("st09_retention", "SELECT event_type, count(*) AS purged FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY event_type")
def st09(t):
    """What a retention of seven days removes; the newest time is one row, broadcast."""
    newest = t("events").agg(F.max("ts").alias("newest"))
    old = t("events").join(F.broadcast(newest), F.expr("ts < newest - INTERVAL 7 DAYS"))
    return old.groupBy("event_type").agg(F.count(F.lit(1)).alias("purged"))


@on("st10_admission", "SELECT event_id, active, active < 3 AS admitted FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 3600 PRECEDING AND 0 PRECEDING) - 1 AS active FROM events) u")
def st10(t):
    """A caller's other jobs of the last hour, this second's included, decide whether a new one is let in."""
    second = F.unix_seconds(F.col("ts").cast("timestamp")) + (F.unix_micros(F.col("ts").cast("timestamp")) % 1000000) / 1e6
    near = Window.partitionBy("user_id").orderBy(second).rangeBetween(-3600, 0)
    active = F.count(F.lit(1)).over(near) - 1
    return t("events").select("event_id", active.alias("active"), (active < 3).alias("admitted"))


_MAIL = [
    ("a", [], None, 0, "Plan", ["x@e", "y@e"]), ("b", ["a"], "a", 5, "Re: Plan", ["y@e"]), ("c", ["zz", "a", "b"], "a", 9, "Re: Plan", ["x@e"]), ("d", [], "b", 7, "Re: Plan", ["x@e"]),
    ("e", [], None, 20, "Re: plan", ["y@e"]), ("f", [], "g", 30, "Loop", ["q@e"]), ("g", [], "f", 31, "Loop", ["r@e"]), ("h", ["h"], "h", 40, "", ["x@e"]), ("i", ["g"], None, 50, "x", []), ("j", [], None, 40 * 86400, "Plan", ["x@e"]),
]
_MAIL_SCHEMA = "id string, references array<string>, in_reply_to string, s long, subject string, people array<string>"


def _mail(df):
    return df.withColumn("ts", F.timestamp_seconds("s")).drop("s")


@inline("j03_threads", _MAIL_SCHEMA, _MAIL, "SELECT * FROM (VALUES ('a', NULL), ('b', 'a'), ('c', 'b'), ('d', 'b'), ('e', NULL), ('f', 'g'), ('g', 'f'), ('h', NULL), ('i', 'g'), ('j', NULL)) v(id, parent)")
def j03(df):
    return H.parents(_mail(df))


@inline("j04_merged_roots", _MAIL_SCHEMA, _MAIL, "SELECT * FROM (VALUES ('a', NULL), ('e', 'a'), ('h', NULL), ('j', NULL)) v(id, parent)")
def j04(df):
    return H.merged_roots(_mail(df).where("id in ('a', 'e', 'h', 'j')"))


@inline("w27_thread_members", _MAIL_SCHEMA, _MAIL, "SELECT id, thread, CAST(depth AS BIGINT) AS depth, CAST(place AS INTEGER) AS place FROM (VALUES ('a','a',0,1), ('b','a',1,2), ('d','a',2,3), ('c','a',2,4), ('e','a',0,5), ('f','f',0,1), ('g','g',0,1), ('i','g',1,2), ('h','h',0,1), ('j','j',0,1)) v(id, thread, depth, place)")
def w27(df):
    return H.threads(_mail(df))


@on("w27_long_chains", "SELECT conv_id, turn, turn - min(turn) OVER (PARTITION BY conv_id) AS depth FROM conversations")
def chains(t):
    """Every turn answers the one before: depths by doubling, whatever the length of a conversation."""
    name = lambda n: F.concat_ws("-", F.col("conv_id").cast("string"), n.cast("string"))
    turns = t("conversations").select("conv_id", "turn", name(F.col("turn")).alias("id"), name(F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))).alias("up"), F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("before"))
    found = H.rooted(turns.select("id", F.when(F.col("before").isNotNull(), F.col("up")).alias("parent")))
    return turns.select("conv_id", "turn", "id").join(found, "id").select("conv_id", "turn", "depth")


@inline("j30_cid_images", "doc int, html string", [(1, '<img src="cid:a@x"><img src="cid:zz">'), (2, "<p>")], "SELECT 1 AS doc, 'cid:a@x' AS ref, 'a.png' AS attachment UNION ALL SELECT 1, 'cid:zz', NULL")
def j30(df):
    parts = df.sparkSession.createDataFrame([(1, "a@x", "a.png")], "doc int, cid string, attachment string")
    refs = df.select("doc", F.explode(F.regexp_extract_all("html", F.lit(r'src="(cid:[^"]+)"'), F.lit(1))).alias("ref")).withColumn("cid", F.substring_index("ref", ":", -1))
    return refs.join(parts, ["doc", "cid"], "left").select("doc", "ref", "attachment")


@inline("j11_anchored_comments", "no int, kind string, anchor string, text string", [(1, "p", "c1", "Para one"), (2, "comment", "c1", "Why?"), (3, "p", None, "Para two"), (4, "comment", "c9", "Lost")], "SELECT 1 AS block, 'Why?' AS comment UNION ALL SELECT NULL, 'Lost'")
def j11(df):
    blocks = df.where("kind = 'p'").select(F.col("no").alias("block"), "anchor")
    return df.where("kind = 'comment'").select("anchor", F.col("text").alias("comment")).join(blocks, "anchor", "left").select("block", "comment")


@inline("j22_captions", "no int, kind string, text string", [(1, "table", "t"), (2, "note", "n"), (3, "caption", "Table 1"), (4, "image", "i"), (5, "p", "x"), (6, "caption", "alone")], "SELECT 1 AS block, 'Table 1' AS caption")
def j22(df):
    """A caption goes to the table or image right before it; notes between them don't count."""
    rows = df.where("kind <> 'note'")
    w = Window.orderBy("no")
    rows = rows.select("no", "kind", F.lead("kind").over(w).alias("next"), F.lead("text").over(w).alias("caption"))
    return rows.where("kind in ('table', 'image') and next = 'caption'").select(F.col("no").alias("block"), "caption")


@inline("j23_reply_links", "id int, parent int, at int", [(1, None, 1), (2, 1, 2), (3, 2, 3), (4, 9, 4)], "SELECT * FROM (VALUES (1, NULL, false), (2, 1, true), (3, 2, true), (4, NULL, false)) v(id, reply_to, linked)")
def j23(df):
    known = df.select(F.col("id").alias("reply_to"))
    return df.join(known, F.col("parent") == F.col("reply_to"), "left").select("id", "reply_to", F.col("reply_to").isNotNull().alias("linked"))


@inline("j27_table_goes_on", "no int, page int, y double, cols int, header string", [(1, 1, 0.9, 3, "a|b"), (2, 2, 0.1, 3, "a|b"), (3, 2, 0.8, 2, "c"), (4, 4, 0.1, 2, "c")], "SELECT 2 AS no, 1 AS continues")
def j27(df):
    """A table at the top 30 % of a page goes on one at the bottom 30 % of the page before, with its columns and header."""
    w = Window.orderBy("page", "y")
    before = {c: F.lag(c).over(w) for c in ("no", "page", "y", "cols", "header")}
    good = (F.col("page") == before["page"] + 1) & (before["y"] >= 0.7) & (F.col("y") <= 0.3) & (F.col("cols") == before["cols"]) & (F.col("header") == before["header"])
    return df.select("no", F.when(good, before["no"]).alias("continues")).where("continues is not null")


@inline("so02_flatten_children", "doc string, parent string, no int, kind string, level int", [("m", None, 1, "heading", 1), ("m", None, 2, "child:c", 0), ("c", "m", 1, "heading", 1), ("c", "m", 2, "p", 0), ("m", None, 3, "p", 0)], "SELECT * FROM (VALUES ('m/1', 'heading', 1, 1), ('m/2/c/1', 'heading', 2, 2), ('m/2/c/2', 'p', 0, 3), ('m/3', 'p', 0, 4)) v(id, kind, level, place)")
def so02(df):
    """A child's blocks in the place of the block that holds it, identifiers prefixed and headings a level down."""
    holes = df.where("kind like 'child:%'").select(F.substring("kind", 7, 100).alias("__c"), F.col("doc").alias("__m"), F.col("no").alias("__n"))
    rows = df.where("kind not like 'child:%'").join(F.broadcast(holes), F.col("doc") == F.col("__c"), "left")
    path = F.when(F.col("__c").isNull(), F.concat_ws("/", "doc", F.col("no").cast("string"))).otherwise(F.concat_ws("/", "__m", F.col("__n").cast("string"), "doc", F.col("no").cast("string")))
    order = F.when(F.col("__c").isNull(), F.struct(F.col("no").alias("a"), F.lit(0).alias("b"))).otherwise(F.struct(F.col("__n").alias("a"), F.col("no").alias("b")))
    level = F.when((F.col("kind") == "heading") & F.col("__c").isNotNull(), F.col("level") + 1).otherwise(F.col("level"))
    return rows.select(path.alias("id"), "kind", level.alias("level"), F.row_number().over(Window.orderBy(order)).alias("place"))


@inline("pf16_job_lookup", "job int, hash string, options string, state string, expires int", [(1, "h", "o", "done", 50), (2, "h", "o", "done", 200), (3, "h", "o", "failed", 300), (4, "h", "p", "done", 300), (5, "h", "o", "done", 150)], "SELECT 'h' AS hash, 'o' AS options, 2 AS job UNION ALL SELECT 'h', 'p', 4")
def pf16(df):
    """The job whose result serves a new request at second 100: same input and options, done, not expired, the one that lasts longest."""
    return df.where("state = 'done' and expires > 100").groupBy("hash", "options").agg(F.max_by("job", "expires").alias("job"))


@inline("pf17_available", "id string, experimental boolean, installed boolean, score double", [("a", False, True, 0.5), ("b", True, True, 0.9), ("c", False, False, 0.9), ("d", False, True, 0.7)], "SELECT * FROM (VALUES ('d', 1), ('a', 2)) v(id, place)")
def pf17(df):
    return df.where("installed and not experimental").select("id", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")).alias("place"))


@inline("w26_ranking", "id string, chain int, score double, priority int", [("a", 1, 0.6, 0), ("b", 2, 0.6, 0), ("s", None, 0.95, 5), ("t", None, 0.5, 9)], "SELECT * FROM (VALUES ('s', 1), ('a', 2), ('b', 3), ('t', 4)) v(id, place)")
def w26(df):
    """A chain's order first, but for specialists that beat its best score; the rest by score, priority and name."""
    best = df.agg(F.max(F.when(F.col("chain").isNotNull(), F.col("score"))).alias("best"))
    group = F.when(F.col("chain").isNull() & (F.col("score") > F.col("best")), 0).when(F.col("chain").isNotNull(), 1).otherwise(2)
    order = [group, F.col("chain").asc_nulls_last(), F.col("score").desc(), F.col("priority").desc(), F.col("id")]
    return df.join(F.broadcast(best)).select("id", F.row_number().over(Window.orderBy(*order)).alias("place"))


@on("sk12_manifest", "SELECT source, n, place FROM (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*), source) AS place FROM documents GROUP BY source) u")
def sk12(t):
    counts = t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy("n", "source")).cast("bigint"))


@on("qs13_pairwise", "SELECT a.lang AS a, b.lang AS b, round(avg(a.q) - avg(b.q), 6) AS difference FROM (SELECT lang, avg(CAST(quality AS DOUBLE)) AS q FROM labels JOIN documents USING (doc_id) GROUP BY lang) a JOIN (SELECT lang, avg(CAST(quality AS DOUBLE)) AS q FROM labels JOIN documents USING (doc_id) GROUP BY lang) b ON a.lang < b.lang GROUP BY a.lang, b.lang")
def qs13(t):
    """Every pair of engines (here languages, which are few) by the difference of their means."""
    means = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.avg(F.col("quality").cast("double")).alias("q"))
    b = means.select(F.col("lang").alias("b"), F.col("q").alias("r"))
    return means.join(F.broadcast(b), F.col("lang") < F.col("b")).select(F.col("lang").alias("a"), "b", F.round(F.col("q") - F.col("r"), 6).alias("difference"))


@on("qs10_rates", "SELECT source, round(avg(CASE WHEN n_chars < 200 THEN 1.0 ELSE 0.0 END), 6) AS loss, round(sum(n_chars / 3.8) / count(*), 4) AS tokens FROM documents GROUP BY source")
def qs10(t):
    return t("documents").groupBy("source").agg(F.round(F.avg(F.when(F.col("n_chars") < 200, 1.0).otherwise(0.0)), 6).alias("loss"), F.round(F.sum(F.col("n_chars") / 3.8) / F.count(F.lit(1)), 4).alias("tokens"))


@inline("qs11_second_half", "doc int, at int, size int", [(1, 10, 100), (2, 60, 100), (3, 50, 100), (4, None, 9)], "SELECT * FROM (VALUES (1, false), (2, true), (3, true), (4, NULL)) v(doc, late)")
def qs11(df):
    return df.select("doc", (F.col("at") >= F.col("size") / 2).alias("late"))


@on("qs14_readable_share", "SELECT page_id, len(regexp_replace(html, '<[^>]*>', '', 'g')) > 0 AS readable FROM pages")
def qs14(t):
    """Extracted characters as a share of the page's: here whether any are left."""
    from tessera.plans.documents import page_facts

    return page_facts(t("pages")).select("page_id", (F.col("chars") > 0).alias("readable"))


@on("qs19_family_scores", "SELECT lang, round(avg(CAST(quality AS DOUBLE)), 6) AS score, min(quality) AS least, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def qs19(t):
    rows = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.round(F.avg(F.col("quality").cast("double")), 6).alias("score"), F.min("quality").alias("least"), F.count(F.lit(1)).alias("n"))

"""Queries that call the operators on DataFrames, with oracles written apart."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.operators import tables as O
from tessera.plans.tables import table


def on(name: str, oracle: str | None = None):
    """Registers a function of a reader of tables."""

    def put(f):
        register(name, oracle)(lambda spark, sf_dir: f(lambda t: table(spark, sf_dir, t)))
        return f

    return put


def inline(name: str, schema: str, rows: list[tuple], oracle: str):
    """Registers a function of a small table of rows."""

    def put(f):
        register(name, oracle)(lambda spark, sf_dir: f(spark.createDataFrame(rows, schema)))
        return f

    return put


@on("w01_priority_dedup", """SELECT doc_id, lang, source FROM (
  SELECT doc_id, lang, source, row_number() OVER (PARTITION BY md5(text) ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, n_chars, doc_id) AS rn FROM documents) t WHERE rn = 1""")
def w01(t):
    rows = t("documents").select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("digest"))
    return O.priority_dedup(rows, [F.col("digest")], [F.when(F.col("lang") == "en", 0).otherwise(1), F.col("n_chars"), F.col("doc_id")]).select("doc_id", "lang", "source")


@on("w03_partition_totals", "SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS in_source, CAST(sum(n_chars) OVER (PARTITION BY source) AS BIGINT) AS source_chars FROM documents")
def w03(t):
    return O.with_totals(t("documents").select("doc_id", "source", "n_chars"), ["source"], in_source=F.count(F.lit(1)), source_chars=F.sum("n_chars")).drop("n_chars")


@on("w13_head_tail_sample", """SELECT o_orderkey, o_custkey, pos, omitted FROM (
  SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS pos, count(*) OVER (PARTITION BY o_orderpriority) AS n,
    greatest(count(*) OVER (PARTITION BY o_orderpriority) - 120, 0) AS omitted FROM orders) t WHERE pos <= 100 OR pos > n - 20""")
def w13(t):
    return O.head_tail(t("orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderpriority", "o_orderkey").drop("o_orderpriority")


@on("w14_line_runs", """
WITH lines AS (SELECT doc_id, no, line FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS no, unnest(string_split(text, chr(10))) AS line FROM documents) u WHERE length(line) > 0),
marked AS (SELECT *, CASE WHEN line = lag(line) OVER (PARTITION BY doc_id ORDER BY no) THEN 0 ELSE 1 END AS fresh FROM lines),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY no) AS run FROM marked),
sizes AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(line) >= 12 GROUP BY doc_id, run),
totals AS (SELECT doc_id, line, count(*) AS n FROM lines WHERE length(line) >= 12 GROUP BY doc_id, line)
SELECT d.doc_id, CAST(coalesce((SELECT max(n) FROM sizes s WHERE s.doc_id = d.doc_id), 0) AS INTEGER) AS longest_run, CAST(coalesce((SELECT max(n) FROM totals x WHERE x.doc_id = d.doc_id), 0) AS INTEGER) AS most_repeated FROM documents d""")
def w14(t):
    return t("documents").select("doc_id", O.line_repeats(F.coalesce("text", F.lit(""))).alias("r")).select("doc_id", "r.longest_run", "r.most_repeated")


@on("a02_column_statistics", " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS most FROM lineitem" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def a02(t):
    return O.column_statistics(t("lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@on("a11_crosstab", "SELECT source, lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM documents GROUP BY source, lang")
def a11(t):
    return O.crosstab(t("documents"), "source", "lang")


@on("a13_percentiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY l_returnflag")
def a13(t):
    found = O.exact_percentiles(t("lineitem").select("l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice", [0.5, 0.95])
    return found.select("l_returnflag", F.round("p0", 4).alias("p50"), F.round("p1", 4).alias("p95"))


@on("a36_speed_summary", "SELECT event_type, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.95), 4) AS p95, round(max(value), 4) AS most FROM events GROUP BY event_type")
def a36(t):
    rows = t("events").select("event_type", "value")
    found = O.exact_percentiles(rows, "event_type", "value", [0.5, 0.95, 1.0])
    return found.select("event_type", F.round("p0", 4).alias("median"), F.round("p1", 4).alias("p95"), F.round("p2", 4).alias("most"))


@on("st12_monotone_counters", "SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS counter FROM events")
def st12(t):
    return O.counted(t("events").select("event_id", "event_type", "ts"), "event_type", ["ts", "event_id"], F.to_date("ts")).drop("ts")


_RECALL = """
WITH b AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS w FROM benchmark) u GROUP BY item_id, w),
d AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS w FROM documents) u GROUP BY doc_id, w),
both_ AS (SELECT b.item_id, d.doc_id, CAST(sum(least(b.n, d.n)) AS BIGINT) AS shared FROM b JOIN d USING (w) GROUP BY b.item_id, d.doc_id),
words AS (SELECT item_id, CAST(sum(n) AS BIGINT) AS words FROM b GROUP BY item_id)"""


def _recall(t):
    return O.multiset_recall(t("benchmark"), t("documents"), "item_id", "doc_id")


@on("j14_multiset_recall", _RECALL + " SELECT item_id, doc_id, words, shared, round(CAST(shared AS DOUBLE) / words, 6) AS recall FROM both_ JOIN words USING (item_id)")
def j14(t):
    return _recall(t).select("item_id", "doc_id", "words", "shared", F.round(F.col("shared") / F.col("words"), 6).alias("recall"))


@on("pf18_recall_gate", _RECALL + ", best AS (SELECT item_id, max(CAST(shared AS DOUBLE) / words) AS recall FROM both_ JOIN words USING (item_id) GROUP BY item_id) SELECT item_id, round(recall, 6) AS recall, recall < 0.95 AND item_id % 2 = 1 AS silent FROM best")
def pf18(t):
    """An item is lost when no document has 95 % of its words; a loss is declared for even items here, as the driver's tables declare none."""
    best = _recall(t).groupBy("item_id").agg(F.max(F.col("shared") / F.col("words")).alias("recall"))
    return best.select("item_id", F.round("recall", 6).alias("recall"), ((F.col("recall") < 0.95) & (F.col("item_id") % 2 == 1)).alias("silent"))


_DOCS = [(1, "x", "a"), (2, "This sentence is flooding. " * 11 + "Once only is fine here.", "b"), (3, "Short. " * 20, "c"), (4, "", "b"), (5, None, None)]


@inline("a33_flooding", "doc_id long, text string, source string", _DOCS, "SELECT CAST(2 AS BIGINT) AS doc_id, 'This sentence is flooding.' AS sentence, CAST(11 AS BIGINT) AS n")
def a33(df):
    parts = df.select("doc_id", F.explode(F.split("text", r"(?<=[.!?])\s+")).alias("sentence")).where(F.length("sentence") > 20)
    return parts.groupBy("doc_id", "sentence").agg(F.count(F.lit(1)).alias("n")).where("n > 10")


@on("so05_set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def so05(t):
    return t("documents").select("doc_id").subtract(t("labels").where("quality = 1").select("doc_id"))


@on("so03_set_ops", "SELECT doc_id, 'both' AS side FROM documents INTERSECT SELECT doc_id, 'both' FROM labels UNION ALL SELECT DISTINCT doc_id, 'either' FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) u")
def so03(t):
    a, b = t("documents").select("doc_id"), t("labels").select("doc_id")
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.union(b).distinct().withColumn("side", F.lit("either")))


@on("so06_ordered_dedup", "SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY conv_id, role) u GROUP BY conv_id")
def so06(t):
    turns = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return turns.select("conv_id", F.array_join(F.array_distinct(F.transform("r", lambda x: x["role"])), ",").alias("roles"))


@on("a31_distinct_codes", "SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS codes FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) u GROUP BY user_id")
def a31(t):
    first = t("events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("first", "event_type"))).alias("r")).select("user_id", F.array_join(F.transform("r", lambda x: x["event_type"]), ",").alias("codes"))


@on("a04_json_path_schema", "SELECT '/' || k AS pointer, 'integer' AS type, count(*) AS n, CAST(min(v) AS VARCHAR) AS example, count(*) AS total FROM (SELECT k, json_extract_string(props, '$.' || k) AS v FROM (SELECT props, unnest(json_keys(props)) AS k FROM events) u) x GROUP BY k")
def a04(t):
    return O.json_paths(t("events").select("props"), "props")


@on("a06_infer_column_types", """WITH s AS (SELECT 'o_orderkey' AS name, CAST(o_orderkey AS VARCHAR) AS v FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders UNION ALL SELECT 'o_totalprice', CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) FROM orders UNION ALL SELECT 'o_orderdate', CAST(o_orderdate AS VARCHAR) FROM orders)
SELECT name, CASE WHEN max(t) = min(t) THEN max(t) WHEN min(t) = 'float' AND max(t) = 'int' THEN 'float' ELSE 'text' END AS type, count(t) AS votes FROM (
  SELECT name, CASE WHEN v IS NULL OR trim(v) = '' THEN NULL WHEN regexp_matches(v, '^[+-]?[0-9]+$') THEN 'int' WHEN regexp_matches(v, '^[+-]?[0-9]*[.][0-9]+$') THEN 'float' WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date' ELSE 'text' END AS t FROM s) u GROUP BY name""")
def a06(t):
    from tessera.functions.text import infer_type

    rows = t("orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"), "o_orderdate")
    return infer_columns(rows, infer_type)


def infer_columns(df, cell_type):
    """(name, type, votes) of every column: a vote a cell; one type wins, int and float are float, else text."""
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in df.columns))).alias("x"))
    votes = cells.select("x.name", cell_type(F.col("x.v")).alias("t")).groupBy("name").agg(F.collect_set("t").alias("kinds"), F.count("t").alias("votes"))
    kind = F.when(F.size("kinds") == 1, F.get("kinds", F.lit(0))).when(F.array_sort("kinds") == F.array(F.lit("float"), F.lit("int")), "float").otherwise("text")
    return votes.select("name", kind.alias("type"), "votes")


@on("a09_modal_size", "SELECT bin, n FROM (SELECT round(l_quantity * 2) / 2 AS bin, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY 1) u ORDER BY n DESC, bin LIMIT 1")
def a09(t):
    """The weighted mode of sizes in bins of a half: what a body's font size is by its characters."""
    bins = t("lineitem").groupBy((F.round(F.col("l_quantity") * 2) / 2).alias("bin")).agg(F.sum("l_linenumber").alias("n"))
    return bins.orderBy(F.col("n").desc(), "bin").limit(1)


@on("a14_bootstrap")
def a14(t):
    return O.bootstrap(t("labels"), "quality")


@on("a14_bootstrap_check", "SELECT true AS holds, true AS narrow, round(avg(CAST(quality AS DOUBLE)), 6) AS mean FROM labels")
def a14_check(t):
    """The interval holds the mean and is as wide as theory says, within a fifth."""
    found = O.bootstrap(t("labels"), "quality")
    width = 2 * 1.959964 * F.sqrt(F.col("mean") * (1 - F.col("mean")) / F.col("n"))
    return found.select(F.col("mean").between(F.col("low"), F.col("high")).alias("holds"), ((F.col("high") - F.col("low")).between(0.75 * width, 1.25 * width)).alias("narrow"), F.round("mean", 6).alias("mean"))


@on("a15_paired_verdict", "SELECT round(avg(CAST(quality - toxic AS DOUBLE)), 6) AS difference, 'beats' AS verdict FROM labels")
def a15(t):
    found = O.bootstrap(t("labels").select("doc_id", (F.col("quality") - F.col("toxic")).alias("d")), "d")
    return found.select(F.round("mean", 6).alias("difference"), O.verdict(F.col("low"), F.col("high")).alias("verdict"))


@on("a16_stratified_interval", "SELECT lang, round(avg(CAST(quality AS DOUBLE)), 6) AS mean, count(*) AS n, true AS holds FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY lang")
def a16(t):
    rows = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id").select("doc_id", "lang", "quality")
    found = O.bootstrap(rows, "quality", "lang")
    return found.select("lang", F.round("mean", 6).alias("mean"), "n", F.col("mean").between(F.col("low"), F.col("high")).alias("holds"))


@on("a20_batch_summary", "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS slow, round(sum(value), 4) AS total FROM events GROUP BY event_type UNION ALL SELECT 'all', count(*), count(*) FILTER (value > 50), round(sum(value), 4) FROM events")
def a20(t):
    own = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("slow"), F.round(F.sum("value"), 4).alias("total")]
    return t("events").rollup("event_type").agg(*own).withColumn("event_type", F.coalesce("event_type", F.lit("all")))


_PAGES = [(1, 1, "Annual Report 2024"), (1, 2, "Body one"), (1, 3, "Page 1"), (2, 4, "Annual Report 2024"), (2, 5, "Body two"), (2, 6, "Page 2"), (3, 7, "Body three"), (3, 8, "Page 3"), (4, 9, "Body"), (4, 10, "Page 4")]


@inline("a26_running_lines", "page int, line int, text string", _PAGES, "SELECT * FROM (VALUES ('annual report #', CAST(2 AS BIGINT)), ('page #', CAST(4 AS BIGINT))) v(shape, pages)")
def a26(df):
    """Lines that are equal but for digits on half the pages and two at least."""
    shape = F.lower(F.trim(F.regexp_replace(F.regexp_replace("text", r"\d+", "#"), r"\s+", " ")))
    pages = df.agg(F.countDistinct("page").alias("all"))
    return df.groupBy(shape.alias("shape")).agg(F.countDistinct("page").alias("pages")).join(F.broadcast(pages), F.col("pages") >= F.greatest(F.lit(2), F.col("all") / 2)).select("shape", "pages")


@inline("a27_decorative_refs", "page int, ref string", [(1, "logo.png"), (2, "logo.png"), (3, "logo.png"), (1, "fig.png"), (1, "fig.png"), (2, "fig.png")], "SELECT 'logo.png' AS ref, CAST(3 AS BIGINT) AS pages")
def a27(df):
    return df.groupBy("ref").agg(F.countDistinct("page").alias("pages")).where("pages >= 3")


@on("a29_kind_counts", "SELECT regexp_extract(url, '^https?://[^/:]*[.]([a-z]+)', 1) AS kind, count(*) AS n, CAST(sum(strlen(html)) AS BIGINT) AS bytes, count(*) || ' of ' || regexp_extract(url, '^https?://[^/:]*[.]([a-z]+)', 1) AS shown FROM pages GROUP BY 1")
def a29(t):
    kind = F.regexp_extract("url", r"^https?://[^/:]*[.]([a-z]+)", 1)
    found = t("pages").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("html")).cast("bigint").alias("bytes"))
    return found.withColumn("shown", F.concat_ws(" of ", F.col("n").cast("string"), "kind"))


@on("a30_redaction_counts", "SELECT 'hex_secret' AS rule, CAST(sum(len(regexp_extract_all(text, '\\b[0-9a-f]{40}\\b'))) AS BIGINT) AS n, count(*) AS files FROM documents WHERE regexp_matches(text, '\\b[0-9a-f]{40}\\b') HAVING count(*) > 0")
def a30(t):
    from tessera.functions.text import SECRET_RULES

    found = t("documents").select("doc_id", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.regexp_count("text", F.lit(p)).alias("n")) for r, p in SECRET_RULES))).alias("x"))
    return found.where("x.n > 0").groupBy("x.rule").agg(F.sum("x.n").cast("bigint").alias("n"), F.count(F.lit(1)).alias("files"))


@on("a37_sibling_counts", "SELECT regexp_extract(url, '^[a-z]+://[^/?#]+(/[^/?#]*)', 1) AS parent, count(*) AS n FROM pages GROUP BY 1")
def a37(t):
    return t("pages").groupBy(F.regexp_extract("url", r"^[a-z]+://[^/?#]+(/[^/?#]*)", 1).alias("parent")).agg(F.count(F.lit(1)).alias("n"))


@on("j02_size_by_name", "SELECT n_name, CAST(sum(c.c_acctbal * 100) AS BIGINT) AS cents FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n_name")
def j02(t):
    return t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum(F.col("c_acctbal") * 100).cast("bigint").alias("cents"))


@inline("j12_pattern_join", "mime string", [("text/html",), ("audio/mpeg",), ("x/y",)], "SELECT * FROM (VALUES ('text/html', 'html', 1), ('text/html', 'any', 2), ('audio/mpeg', 'sound', 1), ('audio/mpeg', 'any', 2), ('x/y', 'any', 1)) v(mime, converter, place)")
def j12(df):
    """Inputs with the converters whose glob fits, best first: exact types, then families, then all; priority and name decide ties. The registry is small and known."""
    registry = df.sparkSession.createDataFrame([("html", "text/html", 10), ("sound", "audio/*", 5), ("any", "*/*", 0)], "converter string, glob string, priority int")
    like = F.expr("mime LIKE replace(glob, '*', '%')")
    exact = F.length(F.replace("glob", F.lit("*"), F.lit("")))
    found = df.join(F.broadcast(registry), like)
    return found.select("mime", "converter", F.row_number().over(Window.partitionBy("mime").orderBy(exact.desc(), F.col("priority").desc(), "converter")).alias("place"))


@inline("j13_merged_cells", "r int, c int, rows int, cols int, text string", [(0, 0, 2, 2, "a"), (0, 2, 1, 1, "b"), (1, 2, 1, 1, "c")], "SELECT * FROM (VALUES (0,0,'a',true),(0,1,'a',false),(1,0,'a',false),(1,1,'a',false),(0,2,'b',true),(1,2,'c',true)) v(r, c, text, anchor)")
def j13(df):
    grid = df.select("r", "c", "text", F.explode(F.sequence("r", F.col("r") + F.col("rows") - 1)).alias("r2"), "cols").select("r", "c", "text", "r2", F.explode(F.sequence("c", F.col("c") + F.col("cols") - 1)).alias("c2"))
    return grid.select(F.col("r2").alias("r"), F.col("c2").alias("c"), "text", ((F.col("r") == F.col("r2")) & (F.col("c") == F.col("c2"))).alias("anchor"))


_HEADS = [("x", 1, "A"), ("x", 2, "B"), ("x", 2, "B"), ("y", 1, "A"), ("y", 2, "B"), ("y", 3, "C")]


@inline("j15_heading_f1", "side string, level int, text string", _HEADS, "SELECT CAST(2 AS BIGINT) AS shared, round(2 * 2 / (3.0 + 3.0), 6) AS f1")
def j15(df):
    """F1 of two multisets of (level, text)."""
    sums = df.groupBy("level", "text").agg(F.count_if(F.col("side") == "x").alias("x"), F.count_if(F.col("side") == "y").alias("y"))
    return sums.agg(F.sum(F.least("x", "y")).cast("bigint").alias("shared"), F.sum("x").alias("a"), F.sum("y").alias("b")).select("shared", F.round(2 * F.col("shared") / (F.col("a") + F.col("b")), 6).alias("f1"))


@inline("j18_point_in_rect", "id int, x double, y double", [(1, 5.0, 5.0), (2, 15.0, 5.0), (3, 30.0, 1.0)], "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) v(id, href)")
def j18(df):
    """The smallest rectangle that holds a point; rectangles of one page are few."""
    links = df.sparkSession.createDataFrame([("a", 0.0, 0.0, 10.0, 10.0), ("b", 10.0, 0.0, 20.0, 10.0), ("w", 0.0, 0.0, 20.0, 10.0)], "href string, x0 double, y0 double, x1 double, y1 double")
    hit = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return df.join(F.broadcast(links), hit, "left").groupBy("id").agg(F.min_by("href", F.struct(size, "href")).alias("href"))


@inline("j19_nearest_column", "id int, x double", [(1, 1.0), (2, 48.0), (3, 90.0)], "SELECT * FROM (VALUES (1, 0), (2, 1), (3, 2)) v(id, col)")
def j19(df):
    starts = F.array(F.lit(0.0), F.lit(50.0), F.lit(100.0))
    return df.select("id", F.array_sort(F.transform(starts, lambda s, i: F.struct(F.abs(F.col("x") - s).alias("d"), i.alias("i"))))[0]["i"].alias("col"))


@inline("j20_merged_intervals", "page int, x0 double, x1 double", [(1, 0.0, 10.0), (1, 5.0, 20.0), (1, 30.0, 40.0), (2, 0.0, 1.0), (1, 20.0, 22.0)], "SELECT * FROM (VALUES (1, 0e0, 22e0, CAST(3 AS BIGINT)), (1, 30e0, 40e0, CAST(1 AS BIGINT)), (2, 0e0, 1e0, CAST(1 AS BIGINT))) v(page, low, high, members)")
def j20(df):
    return O.merged_intervals(df, "page", "x0", "x1")


@on("j21_as_of", "SELECT e.event_id, o.value AS before FROM events e ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1) o ON e.user_id = o.user_id AND e.ts >= o.ts WHERE e.event_type = 'click'")
def j21(t):
    """Each click with its user's last purchase at or before it."""
    events = t("events")
    bought = O.last_wins(events.where("event_type = 'purchase'").select("user_id", "ts", "value", "event_id"), ["user_id", "ts"], ["event_id"]).withColumnRenamed("value", "before")
    return O.as_of(events.where("event_type = 'click'").select("event_id", "user_id", "ts"), bought, "user_id", "ts", "before").select("event_id", "before")


@inline("j24_first_titles", "no int, href string, title string", [(1, "a.xhtml#x", "One"), (2, "a.xhtml", "Two"), (3, "b.xhtml", "Three")], "SELECT * FROM (VALUES ('a.xhtml', 'One'), ('b.xhtml', 'Three')) v(file, title)")
def j24(df):
    return df.groupBy(F.substring_index("href", "#", 1).alias("file")).agg(F.min_by("title", "no").alias("title"))


@inline("j26_fact_pivot", "tag string, value string, context int", [("dei:Name", "Acme", 1), ("dei:Name", "Other", 2), ("dei:Type", "8-K", 1), ("x:Y", "z", 1)], "SELECT 'Acme' AS \"Name\", '8-K' AS \"Type\", CAST(NULL AS VARCHAR) AS \"Date\"")
def j26(df):
    """The first fact of each wanted tag, a column a tag."""
    return df.groupBy().pivot("tag", ["dei:Name", "dei:Type", "dei:Date"]).agg(F.min_by("value", "context")).toDF("Name", "Type", "Date")


@on("j29_cached_by_hash", "SELECT d.doc_id, l.quality AS cached FROM documents d LEFT JOIN (SELECT md5(text) AS h, max(quality) AS quality FROM documents JOIN labels USING (doc_id) GROUP BY 1) l ON md5(d.text) = l.h")
def j29(t):
    """Verdicts found by a text's hash: copies of a judged text aren't judged again."""
    docs = t("documents").select("doc_id", F.md5("text").alias("h"))
    known = docs.join(t("labels").select("doc_id", "quality"), "doc_id").groupBy("h").agg(F.max("quality").alias("cached"))
    return docs.join(known, "h", "left").select("doc_id", "cached")


@inline("j32_code_registry", "doc_id int, code string", [(1, "truncated"), (1, "odd"), (2, "ocr-low")], "SELECT * FROM (VALUES (1, 'truncated', 'high', true), (1, 'odd', 'medium', false), (2, 'ocr-low', 'low', false)) v(doc_id, code, severity, truncates)")
def j32(df):
    codes = df.sparkSession.createDataFrame([("truncated", "high", True), ("ocr-low", "low", False)], "code string, severity string, truncates boolean")
    return df.join(F.broadcast(codes), "code", "left").select("doc_id", "code", F.coalesce("severity", F.lit("medium")).alias("severity"), F.coalesce("truncates", F.lit(False)).alias("truncates"))


@on("sl01_deterministic_sort", "SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, lang, doc_id) AS rank FROM documents) u WHERE rank <= 3")
def sl01(t):
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "lang", "doc_id")).cast("bigint")
    return t("documents").select("source", "doc_id", rank.alias("rank")).where("rank <= 3")


@on("sl04_probe_and_tail", "SELECT o_orderkey, side FROM (SELECT o_orderkey, 'head' AS side, row_number() OVER (ORDER BY o_orderkey) AS a FROM orders) u WHERE a <= 20 UNION ALL SELECT o_orderkey, 'tail' FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) AS b FROM orders) u WHERE b <= 5")
def sl04(t):
    """20 + 5 + 1 rows tell whether a table is sampled; the tail is read backwards. Both are top-n plans; the feature is the limit."""
    rows = t("orders").select("o_orderkey")
    return rows.orderBy("o_orderkey").limit(20).withColumn("side", F.lit("head")).unionByName(rows.orderBy(F.col("o_orderkey").desc()).limit(5).withColumn("side", F.lit("tail")))


@on("sl08_orientation", "SELECT doc_id, len(regexp_extract_all(text, '\\n')) >= 5 OR greatest(1, CAST(round_even(length(text) / 3.8, 0) AS BIGINT)) > 3000 AS contents FROM documents")
def sl08(t):
    from tessera.functions.text import token_estimate

    return t("documents").select("doc_id", ((F.regexp_count("text", F.lit("\n")) >= 5) | (token_estimate("text") > 3000)).alias("contents"))


@on("w12_cursor", "SELECT doc_id, rtrim(replace(replace(to_base64(encode('{\"profile\":\"full\",\"unit\":' || n_chars || ',\"v\":1}')), '+', '-'), '/', '_'), '=') AS cursor FROM documents")
def w12(t):
    body = F.concat(F.lit('{"profile":"full","unit":'), F.col("n_chars").cast("string"), F.lit(',"v":1}'))
    return t("documents").select("doc_id", F.rtrim(F.translate(F.base64(body.cast("binary")), "+/", "-_"), F.lit("=")).alias("cursor"))


@inline("w21_file_order", "path string", [("src/a.py",), ("README.md",), ("docs/x.md",), ("tests/t.py",), ("setup.py",), ("src/b/c.py",)], "SELECT * FROM (VALUES ('README.md', 1), ('setup.py', 2), ('src/a.py', 3), ('src/b/c.py', 4), ('docs/x.md', 5), ('tests/t.py', 6)) v(path, place)")
def w21(df):
    depth = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    part = F.when(F.lower("path").rlike(r"^readme(\.|$)"), 0).when(depth == 0, 1).when(F.col("path").rlike(r"(^|/)tests?/|(^|/)test_"), 4).when(F.col("path").rlike(r"^docs?/"), 3).otherwise(2)
    return df.select("path", F.row_number().over(Window.orderBy(part, depth, "path")).alias("place"))


@inline("w25_unique_names", "no int, name string", [(1, "a"), (2, "b"), (3, "a"), (4, "a")], "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, 'a-2'), (4, 'a-3')) v(no, \"unique\")")
def names(df):
    return O.unique_names(df, "name", "no").select("no", "unique")


@inline("w29_sibling_numbers", "path string, no int", [("/items", 0), ("/items", 1), ("/meta", 0), ("/items", 2)], "SELECT * FROM (VALUES ('/items', 0, 'items 1'), ('/items', 1, 'items 2'), ('/items', 2, 'items 3'), ('/meta', 0, 'meta')) v(path, no, title)")
def w29(df):
    all_ = F.count(F.lit(1)).over(Window.partitionBy("path"))
    name = F.substring_index("path", "/", -1)
    return df.select("path", "no", F.when(all_ > 1, F.concat_ws(" ", name, (F.col("no") + 1).cast("string"))).otherwise(name).alias("title"))


@inline("w31_link_runs", "doc int, no int, href string", [(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a"), (2, 1, "c")], "SELECT * FROM (VALUES (1, CAST(3 AS BIGINT)), (2, CAST(1 AS BIGINT))) v(doc, links)")
def w31(df):
    fresh = ~F.coalesce(F.lag("href").over(Window.partitionBy("doc").orderBy("no")) == F.col("href"), F.lit(False))
    return O.islands(df, "doc", ["no"], fresh, "run").groupBy("doc").agg(F.max("run").alias("links"))


@inline("w32_last_marker", "doc int, no int, item string", [(1, 1, "1"), (1, 2, "1A"), (1, 9, "1"), (1, 12, "1A")], "SELECT * FROM (VALUES (1, 9, '1'), (1, 12, '1A')) v(doc, no, item)")
def w32(df):
    return O.last_wins(df, ["doc", "item"], ["no"])


@inline("w34_monotone", "page int, place int, stream int", [(1, 1, 1), (1, 2, 3), (1, 3, 2), (2, 1, 1), (2, 2, 2)], "SELECT * FROM (VALUES (1, true), (2, false)) v(page, interleaved)")
def w34(df):
    back = F.col("stream") < F.lag("stream").over(Window.partitionBy("page").orderBy("place"))
    return df.withColumn("b", F.coalesce(back, F.lit(False))).groupBy("page").agg(F.bool_or("b").alias("interleaved"))


@on("w37_time_span", "SELECT user_id, epoch_us(min(ts)) AS first, epoch_us(max(ts)) - epoch_us(min(ts)) AS span FROM events GROUP BY user_id")
def w37(t):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return t("events").groupBy("user_id").agg(F.min(micros).alias("first"), (F.max(micros) - F.min(micros)).alias("span"))


@inline("w08_page_markers", "no int, page int", [(1, 1), (2, 1), (3, 2), (4, None), (5, 4)], "SELECT * FROM (VALUES (1, 1), (2, NULL), (3, 2), (4, NULL), (5, 4)) v(no, marker)")
def w08(df):
    """The page's mark before its first unit; units without a page are on the page before."""
    page = F.last("page", ignorenulls=True).over(Window.orderBy("no").rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("p", page)
    before = F.lag("p").over(Window.orderBy("no"))
    return rows.select("no", F.when(before.isNull() | (before != F.col("p")), F.col("p")).alias("marker"))


@inline("w15_repeated_headings", "no int, kind string, text string", [(1, "heading", "Intro"), (2, "text", "intro"), (3, "heading", "Next"), (4, "text", "a"), (5, "text", "b"), (6, "text", "c"), (7, "text", "Next")], "SELECT 1 AS no")
def w15(df):
    """Headings that come again as a paragraph within three lines."""
    w = Window.orderBy("no")
    key = F.lower(F.trim("text"))
    again = F.lit(False)
    for k in (1, 2, 3):
        again = again | F.coalesce((F.lead(key, k).over(w) == key) & (F.lead("kind", k).over(w) == "text"), F.lit(False))
    return df.select("no", "kind", again.alias("again")).where("kind = 'heading' and again").select("no")


@inline("w19_contents_page", "page int, text string", [(1, f"Chapter {i} ..... {i * 3}") for i in range(5)] + [(2, "Text"), (2, "More 5"), (2, "a"), (2, "b"), (2, "c")], "SELECT 1 AS page, CAST(5 AS BIGINT) AS lines")
def w19(df):
    refs = F.count_if(F.col("text").rlike(r"(\.{2,}|\s{2,}|\s)\d{1,4}\s*$"))
    return df.groupBy("page").agg(F.count(F.lit(1)).alias("lines"), refs.alias("refs")).where("lines >= 5 and refs >= 0.3 * lines").select("page", "lines")


@inline("w17_bands", "r int, filled boolean", [(i, i not in (2, 3, 6)) for i in range(9)], "SELECT * FROM (VALUES (0, 1), (4, 8)) v(first, last)")
def w17(df):
    """Bands of filled rows, cut at gaps of two or more empty ones."""
    rows = df.where("filled").withColumn("one", F.lit(1))
    gap = F.col("r") - F.lag("r").over(Window.partitionBy("one").orderBy("r"))
    return O.islands(rows, "one", ["r"], gap.isNull() | (gap > 2), "band").groupBy("band").agg(F.min("r").alias("first"), F.max("r").alias("last")).drop("band")


@inline("w20_line_spacing", "page int, y double, x1 double", [(1, float(v), 90.0 + v % 3) for v in (0, 12, 24, 37, 49, 61)], "SELECT 1 AS page, 12e0 AS spacing, 91e0 AS right_edge")
def w20(df):
    """The upper median of gaps (0 under four) and the nearest-rank 90th percentile of right edges."""
    gaps = df.withColumn("g", F.col("y") - F.lag("y").over(Window.partitionBy("page").orderBy("y")))
    found = gaps.groupBy("page").agg(F.array_sort(F.collect_list("g")).alias("g"), F.array_sort(F.collect_list("x1")).alias("x"))
    spacing = F.when(F.size("g") >= 4, F.get("g", F.floor(F.size("g") / 2).cast("int"))).otherwise(0.0)
    return found.select("page", spacing.alias("spacing"), F.get("x", (F.ceil(F.size("x") * 0.9) - 1).cast("int")).alias("right_edge"))


@on("rn20_numbered_links", "SELECT page_id, no, href FROM (SELECT page_id, generate_subscripts(h, 1) AS no, unnest(h) AS href FROM (SELECT page_id, list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS h FROM pages) u) v WHERE false UNION ALL SELECT page_id, count(*) AS no, min(href) AS href FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) u GROUP BY page_id")
def rn20(t):
    """How many different links a page's list numbers, and the first by name."""
    links = numbered_links(t("pages"), "page_id", "html")
    return links.groupBy("page_id").agg(F.max("no").alias("no"), F.min("href").alias("href"))


def numbered_links(df, key: str, html: str):
    """(key, no, href): a page's links, each once, in the order of their first place, numbered from 1."""
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1)))
    return df.select(key, F.posexplode(found).alias("no", "href")).withColumn("no", (F.col("no") + 1).cast("bigint"))


@inline("rn21_warnings", "origin string, code string, severity string", [("document", "a", "low"), ("render", "a", "low"), ("render", "b", "high"), ("pipeline", "c", "medium")], "SELECT * FROM (VALUES ('b', 'high', true), ('c', 'medium', true), ('a', 'low', false)) v(code, severity, compact)")
def rn21(df):
    return df.select("code", "severity").distinct().withColumn("compact", F.col("severity") != "low")

"""Chunks, text functions and scans over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.functions import text as T
from tessera.operators import chunking
from tessera.plans.tables import table

_TOKENS = "greatest(1, CAST(round_even(length(x) / 3.8, 0) AS BIGINT))"


@register("w10_chunk_pack", f"""
WITH l AS (SELECT doc_id, [{_TOKENS} + 1 FOR x IN string_split(text, chr(10)) IF length(x) > 0] AS costs FROM documents),
s AS (SELECT doc_id, list_reduce([{{'n': CAST(0 AS BIGINT), 'cur': CAST(0 AS BIGINT), 'most': CAST(0 AS BIGINT), 'total': CAST(0 AS BIGINT)}}] || [{{'n': CAST(0 AS BIGINT), 'cur': c, 'most': CAST(0 AS BIGINT), 'total': CAST(0 AS BIGINT)}} FOR c IN costs],
  lambda a, t: {{'n': a.n + CASE WHEN a.cur > 0 AND a.cur + t.cur <= 400 THEN 0 ELSE 1 END, 'cur': CASE WHEN a.cur > 0 AND a.cur + t.cur <= 400 THEN a.cur + t.cur ELSE t.cur END,
    'most': greatest(a.most, CASE WHEN a.cur > 0 AND a.cur + t.cur <= 400 THEN a.cur + t.cur ELSE t.cur END), 'total': a.total + t.cur}}) AS a FROM l)
SELECT doc_id, a.n AS n_chunks, a.most AS max_tokens, a.total AS total_tokens FROM s""")
def chunk_pack(spark, sf_dir):
    return chunking.chunk_summary(table(spark, sf_dir, "documents"))


@register("ft01_token_estimate", f"SELECT doc_id, CASE WHEN length(x) = 0 THEN 0 ELSE {_TOKENS} END AS tokens FROM (SELECT doc_id, text AS x FROM documents) t")
def tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate("text").alias("tokens"))


@register("fs03_collapse_whitespace", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS sha FROM documents")
def collapse(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.collapse_whitespace("text")).alias("sha"))


@register("fs01_strip_control", "SELECT doc_id, md5(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) AS sha FROM documents")
def control(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.strip_control("text")).alias("sha"))


@register("fs15_message_shape", "SELECT event_id, left(regexp_replace(regexp_replace(event_type || ' ' || props, '''[^'']*''|\"[^\"]*\"', '''''', 'g'), '[0-9]+', '#', 'g'), 80) AS shape FROM events")
def shape(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.message_shape(F.concat_ws(" ", "event_type", "props")).alias("shape"))


@register("a24_dominant_script", """
WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-zÀ-ɏ]')) AS latin, len(regexp_extract_all(text, '[぀-ヿ㐀-䶿一-鿿가-힯]')) AS cjk, len(regexp_extract_all(text, '[Ѐ-ӿ]')) AS cyrillic, len(regexp_extract_all(text, '[؀-ۿ]')) AS arabic FROM documents)
SELECT doc_id, CASE WHEN latin + cjk + cyrillic + arabic = 0 THEN 'none' WHEN latin >= 0.8 * (latin + cjk + cyrillic + arabic) THEN 'latin' WHEN cjk >= 0.8 * (latin + cjk + cyrillic + arabic) THEN 'cjk' WHEN cyrillic >= 0.8 * (latin + cjk + cyrillic + arabic) THEN 'cyrillic' WHEN arabic >= 0.8 * (latin + cjk + cyrillic + arabic) THEN 'arabic' ELSE 'mixed' END AS script FROM n""")
def script(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.dominant_script("text").alias("script"))


@register("fa09_strip_tracking")
def tracking(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tracking("url").alias("url"))


@register("fs31_html_text")
def html(spark, sf_dir):
    text = T.html_text("html")
    return table(spark, sf_dir, "pages").select("page_id", F.length(text).alias("chars"), F.md5(text).alias("sha"))


@register("fs21_redact_secrets", "SELECT doc_id, len(regexp_extract_all(text, '\\b[0-9a-f]{40}\\b')) > 0 AS redacted FROM documents")
def redact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.redact_secrets("text").contains("[REDACTED:").alias("redacted"))


@register("fs23_human_size", """SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' ELSE printf('%.1f KB', n / 1024.0) END AS size FROM (SELECT doc_id, strlen(text) AS n FROM documents) t""")
def size(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.human_size(F.octet_length("text").cast("bigint")).alias("size"))


@register("fm01_parse_numbers", "SELECT o_orderkey, round(o_totalprice, 2) AS n FROM orders")
def numbers(spark, sf_dir):
    shown = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.parse_number(shown).alias("n"))


@register("fd03_time_of", "SELECT event_id, printf('%02d:%02d:%02d', event_id // 3600, event_id // 60 % 60, event_id % 60) AS t FROM events")
def clock(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.time_of("event_id").alias("t"))

"""Scalar function queries: each computes a group of column functions over a whole view."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import fields as f
from . import sqltext as t
from .base import Plans, table, view

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles


@P.add("url_functions", f"""SELECT seq, {t.norm_url('url')} AS norm, {t.url_key('url')} AS key, {t.host_of('url')} AS host,
    CASE WHEN regexp_matches(url, '(?i)^https?://[^\\x00-\\x20\\x7F]+$') THEN url ELSE '' END AS safe, regexp_replace(regexp_replace(url, '(?i)v[0-9]+$', ''), '^http:', 'https:') AS unversioned
      FROM urls""")
def url_functions(spark, sf):
    u = F.col("url")
    return view(spark, sf, "urls").select("seq", f.norm_url(u).alias("norm"), f.url_key(u).alias("key"), f.host_of(u).alias("host"), f.safe_url(u).alias("safe"), f.strip_version(u).alias("unversioned"))


@P.add("date_functions", f"""WITH d AS (SELECT seq, claim_date, publish_date, {t.day_num('claim_date')} AS day_num FROM claims)
    SELECT seq, day_num, CAST(date_diff('day', TRY_STRPTIME(CAST(day_num AS VARCHAR), '%Y%m%d'), TIMESTAMP '2026-08-13') AS INTEGER) AS age,
    coalesce(regexp_matches(publish_date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND TRY_CAST(publish_date AS DATE) IS NOT NULL, false) AS valid, coalesce(regexp_matches(claim_date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'), false) AS full_day,
    'news for ' || coalesce(publish_date, 'no day') || ' only' AS query FROM d""")
def date_functions(spark, sf):
    c = view(spark, sf, "claims").withColumn("day_num", f.normalize_date(F.col("claim_date")))
    filled = f.substitute_date(F.lit("news for {date} only"), F.coalesce("publish_date", F.lit("no day")))
    return c.select("seq", "day_num", f.days_between(F.col("day_num"), F.lit(20260813)).alias("age"), f.valid_date(F.col("publish_date")).alias("valid"), f.has_full_day(F.col("claim_date")).alias("full_day"), filled.alias("query"))


@P.add("local_days", "SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY 1")
def local_days(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(f.local_day(F.col("ts").cast("timestamp")).alias("day")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


_names = "CASE seq % 9 WHEN 0 THEN 'DeepSeek V4 Pro (beta) ' || board WHEN 1 THEN '深度求索 v4' WHEN 2 THEN 'Grok 4.6 in Copilot' WHEN 3 THEN 'Hassabis and Jeff Dean' WHEN 4 THEN 'Jeff  Dean' WHEN 5 THEN 'GPT-5.6 with Fable: math' WHEN 6 THEN 'Muse Glimmer' WHEN 7 THEN claim || ' （note） (x)' ELSE claim END"


def _fingerprint(e: str) -> str:
    return "CASE " + " ".join("WHEN " + " AND ".join(f"regexp_matches(lower({e}), {t.q(p)})" for p in ps) + f" THEN '{k}'" for k, ps in rules.FINGERPRINTS) + f" ELSE regexp_replace(regexp_replace(lower({e}), '[（(][^)）]*[)）]', '', 'g'), '\\s+', '', 'g') END"


@P.add("event_keys", f"SELECT seq, {_fingerprint(_names)} AS key FROM claims")
def event_keys(spark, sf):
    return view(spark, sf, "claims").select("seq", f.event_key(F.expr(_names)).alias("key"))


def _entities(e: str) -> str:
    for code, sign in rules.ENTITIES:
        e = f"replace({e}, {t.q(code)}, {t.q(sign)})"
    return e


def _tag(e: str, tag: str) -> str:
    body = f"regexp_extract({e}, '(?is)<{tag}(?:[^>]*)>(.*?)</{tag}>', 1)"
    return f"trim(regexp_replace(regexp_replace(regexp_replace({body}, '(?s)<!\\[CDATA\\[(.*?)\\]\\]>', '\\1', 'g'), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'))"


@P.add("page_text_functions", f"""WITH p AS (SELECT seq, title, html, {_tag('html', 'h1')} AS heading FROM page_cards)
    SELECT seq, {_entities("title || '&amp;lt;'")} AS decoded, heading, trim(regexp_replace(replace(title || ' \\|  x ', '\\|', '|'), '\\s+', ' ', 'g')) AS cleaned,
    regexp_replace(title, '[^A-Za-z0-9._-]+', '_', 'g') AS file_name,
    CASE WHEN substring(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) = '' THEN 'section' ELSE substring(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) END AS slug,
    {t.markdown("title || ' a*b_(c)+d-e!' || chr(10) || '<#|`' || chr(1)")} AS markdown, {t.cell("title || '|' || chr(10) || 'x '")} AS cell, replace(replace(replace(title || '<\\>', '\\', '\\\\'), '<', '\\<'), '>', '\\>') AS target,
    replace(replace(replace(heading, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS xml FROM p""")
def page_text_functions(spark, sf):
    p = view(spark, sf, "page_cards").withColumn("heading", f.tag_text(F.col("html"), "h1"))
    title = F.col("title")
    return p.select("seq", f.decode_entities(F.concat(title, F.lit("&amp;lt;"))).alias("decoded"), "heading", f.clean_title(F.concat(title, F.lit(" \\|  x "))).alias("cleaned"), f.safe_filename(title).alias("file_name"), f.slug(title).alias("slug"), f.escape_markdown(F.concat(title, F.lit(" a*b_(c)+d-e!\n<#|`\x01"))).alias("markdown"), f.escape_cell(F.concat(title, F.lit("|\nx "))).alias("cell"), f.escape_url(F.concat(title, F.lit("<\\>"))).alias("target"), f.escape_xml(F.col("heading")).alias("xml"))


_stop = ", ".join(map(t.q, rules.STOP_TOKENS))


@P.add("snippet_functions", f"""SELECT seq, list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9][a-z0-9.%-]*'), lambda x: length(x) >= 4 AND x NOT IN ({_stop})))) AS tokens,
    CAST(len(list_filter(string_split_regex(coalesce(snippet, ''), '[\\s,，;；:：|·]+'), lambda x: regexp_matches(x, '[一-鿿]') OR regexp_matches(x, '^[A-Za-z]{{5,}}$'))) AS INTEGER) AS readable,
    {t.low('title', rules.PROMO)} AS promo, TRY_CAST(replace(CAST(topic_id // 1000 AS VARCHAR) || ',' || lpad(CAST(topic_id % 1000 AS VARCHAR), 3, '0'), ',', '') AS INTEGER) AS number,
    CASE WHEN seq % 5 = 0 THEN '—' ELSE format('{{:,}}', topic_id * 1009) END AS shown,
    CASE day_no % 5 WHEN 0 THEN '高' WHEN 1 THEN '中' WHEN 2 THEN '低' ELSE 'other' END AS confidence, CASE WHEN prio = 2 THEN '—' ELSE CAST(seq % 3 AS VARCHAR) || '-' || CAST(prio AS VARCHAR) END AS vote
      FROM cards""")
def snippet_functions(spark, sf):
    c = view(spark, sf, "cards")
    number = F.concat((F.col("topic_id") / 1000).cast("bigint").cast("string"), F.lit(","), F.lpad((F.col("topic_id") % 1000).cast("string"), 3, "0"))
    word = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low"), F.lit("other"), F.lit("other")), F.col("day_no") % 5 + 1)
    return c.select("seq", F.array_sort(f.latin_tokens(F.col("title"))).alias("tokens"), f.readable_tokens(F.col("snippet")).alias("readable"), f.is_promo(F.col("title")).alias("promo"), f.int_with_commas(number).alias("number"), f.thousands(F.when(F.col("seq") % 5 != 0, F.col("topic_id") * 1009)).alias("shown"), f.confidence_label(word).alias("confidence"), f.vote_label(F.col("seq") % 3, F.col("prio"), F.col("prio") == 2).alias("vote"))


_fenced = "CASE doc_id % 3 WHEN 0 THEN '```json' || chr(10) || '{\"a\": ' || CAST(doc_id AS STRING) || '}' || chr(10) || '```' WHEN 1 THEN '---' || chr(10) || 'k: v' || chr(10) || '---' || chr(10) || substring(text, 1, 50) ELSE '{\"a\": \"x\"}' END"


@P.add("fence_functions", f"""WITH d AS (SELECT doc_id, {_fenced} AS raw FROM documents),
    s AS (SELECT doc_id, raw, trim(regexp_replace(regexp_replace(raw, '(?i)^\\s*```(?:json)?\\s*', ''), '\\s*```\\s*$', '')) AS bare FROM d)
    SELECT doc_id, bare, CASE WHEN regexp_extract(raw, '(?s)```[a-z]*\\n(.*?)```', 1) <> '' THEN trim(regexp_extract(raw, '(?s)```[a-z]*\\n(.*?)```', 1)) ELSE trim(regexp_replace(raw, '(?s)^---\\n.*?\\n---\\n', '')) END AS fenced,
    CASE WHEN json_valid(bare) THEN json_extract_string(bare, '$.a') END AS a FROM s""")
def fence_functions(spark, sf):
    d = table(spark, sf, "documents").withColumn("raw", F.expr(_fenced)).withColumn("bare", f.strip_code_fence(F.col("raw")))
    return d.select("doc_id", "bare", f.first_fenced(F.col("raw")).alias("fenced"), F.get_json_object("bare", "$.a").alias("a"))


_status = "CASE doc_id % 6 WHEN 0 THEN '[窗口外·重大]' WHEN 1 THEN '【窗口外．重大】' WHEN 2 THEN ' 窗口外 重大 ' WHEN 3 THEN '已核查' WHEN 4 THEN NULL ELSE '未核查' END"


@P.add("status_flags", f"SELECT doc_id, coalesce(regexp_replace(translate({_status}, '［【］】（）．', '[[]]()·'), '[\\s\\x{{3000}}\\x{{00A0}}]+', '', 'g'), '') IN ({', '.join(map(t.q, rules.UNCHECKED))}) AS unchecked FROM documents")
def status_flags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", f.is_unchecked(F.expr(_status)).alias("unchecked"))


@P.add("json_fields", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))

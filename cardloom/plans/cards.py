"""Queries of the card path: gates, scrubbing, dedupe, folding, merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import fields as f
from ..functions import scrub as sc
from ..operators import cards as op
from . import sqltext as t
from .base import Plans, view

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles
DAY = "2026-08-03"
DAY_MS = 1785686400000  # its midnight at UTC+8


def timed(spark, sf):
    cards = view(spark, sf, "cards")
    return cards.withColumns({"published_at": F.timestamp_millis("published_ms"), "created_at": F.timestamp_millis("created_ms")})


@P.add("topic_gate", f"SELECT seq, title FROM cards WHERE {t.low('title', rules.TOPIC)} AND NOT {t.low('title', rules.OFF_TOPIC)}")
def topic_gate(spark, sf):
    return op.relevant(view(spark, sf, "cards")).select("seq", "title")


# as the statement has it: fixed values of the gate over titles and URLs of feeds
_RELEVANT = "ai|artificial intelligence|llm|gpt|chatgpt|claude|anthropic|openai|deepseek|gemini|mistral|llama|cohere|perplexity|hugging|langchain|rag|agent|codex|cursor|copilot|model|大模型|machine learning|ml|neural|transformer|diffusion|token|reasoning|fine.?tun|rlhf|dpo|grpo|lora|quantization|inference|vllm|ollama|opencode|ide.*ai|ai.*coding|agent.*harness|tool.*use|mcp|function.*call"
_excluded = [("forum", "关于[“\"「].*(?:类别|分类|板块)|社区准则|邀请函|办卡|运营商|学费|步枪"), ("hosting", "关于[“\"「].*(?:类别|分类|版块)|社区准则|邀请函|办卡|运营商|学费|步枪|收.{0,6}鸡|出.{0,6}鸡|.{0,8}(?:年付|月付|季付|季续|折扣|优惠|促销|特价|活动).{0,8}(?:鸡|机|云|vps|服务器|机场)|留档|测评|测速|tq|nq|溢价|求购|出售|邀请码|纯手工|黑五|bf|闪购|秒杀|充值"), ("developers", "关于[“\"「].*(?:类别|分类|版块)|社区准则|邀请函|.{0,10}(?:合租|拼车|车位|年付|月付|折扣|优惠|促销).{0,10}(?:账号|号|车|会员|chatgpt|gpt)|邀请码|出售.*账号|求购|纯手工")]
_offers = "title || CASE seq % 9 WHEN 0 THEN ' 年付 vps' WHEN 1 THEN ' 合租 gpt' WHEN 2 THEN ' TQ' WHEN 3 THEN ' 办卡' WHEN 4 THEN ' 收一只鸡' WHEN 5 THEN ' 出售 x 账号' ELSE '' END"


@P.add("text_gate", "SELECT seq FROM cards WHERE " + t.low("CASE WHEN seq % 4 = 3 THEN reverse(title) ELSE title END || ' ' || url", _RELEVANT))
def text_gate(spark, sf):
    c = view(spark, sf, "cards").withColumn("title", F.when(F.col("seq") % 4 == 3, F.reverse("title")).otherwise(F.col("title")))
    return op.relevant_text(c).select("seq")


@P.add("site_gates", "WITH o AS (SELECT seq, " + _offers + " AS title FROM cards) " + " UNION ALL ".join(f"SELECT '{site}' AS site, seq, title FROM o WHERE {t.low('title', rules.TOPIC)} AND NOT {t.low('title', p)}" for site, p in _excluded))
def site_gates(spark, sf):
    """The topic gate with each kind of site's own exclusions."""
    c = view(spark, sf, "cards").select("seq", F.expr(_offers).alias("title"))
    gates = {"forum": rules.OFF_TOPIC, "hosting": rules.OFF_TOPIC_HOSTING, "developers": rules.OFF_TOPIC_DEVELOPERS}
    parts = [op.relevant(c, p).select(F.lit(site).alias("site"), "seq", "title") for site, p in gates.items()]
    return op.reduce(lambda a, b: a.unionByName(b), parts)


@P.add("scrub_snippets", f"SELECT seq, {t.scrub('snippet')} AS clean, {t.scrub('title', 200)} AS clean_title FROM cards")
def scrub_snippets(spark, sf):
    return view(spark, sf, "cards").select("seq", sc.scrub(F.col("snippet")).alias("clean"), sc.scrub(F.col("title"), 200).alias("clean_title"))


@P.add("drop_injection_only", f"SELECT seq FROM cards WHERE {t.scrub('CASE WHEN seq % 10 = 0 THEN substr(snippet, length(snippet) - 28) ELSE snippet END')} <> '' OR {t.scrub('CASE WHEN seq % 3 = 0 THEN NULL ELSE title END')} <> ''")
def drop_injection_only(spark, sf):
    c = view(spark, sf, "cards")
    snippet = F.when(F.col("seq") % 10 == 0, F.expr("substr(snippet, length(snippet) - 28)")).otherwise(F.col("snippet"))
    title = F.when(F.col("seq") % 3 == 0, None).otherwise(F.col("title"))
    return c.where(~sc.injection_only(snippet, title)).select("seq")


_obscure = "clean <> '' AND NOT regexp_matches(clean, '[一-鿿]') AND regexp_matches(clean, '[^\\s,，;；:：|·]') AND len(list_filter(string_split_regex(clean, '[\\s,，;；:：|·]+'), lambda x: regexp_matches(x, '^[A-Za-z]{5,}$'))) = 0"


@P.add("clarify_snippets", f"WITH s AS (SELECT seq, {t.scrub('snippet')} AS clean, {t.scrub('title', 200)} AS head FROM cards) SELECT seq, CASE WHEN {_obscure} AND head <> '' THEN {t.scrub("head || '。' || clean")} ELSE clean END AS snippet FROM s")
def clarify_snippets(spark, sf):
    return view(spark, sf, "cards").select("seq", sc.clarify(F.col("snippet"), F.col("title")).alias("snippet"))


@P.add("local_day_filter", f"SELECT seq, published_ms FROM cards WHERE published_ms >= {DAY_MS} AND published_ms < {DAY_MS} + 86400000")
def local_day_filter(spark, sf):
    c = timed(spark, sf)
    return c.where(op.in_local_day(F.col("published_at"), F.lit(DAY).cast("date"))).select("seq", "published_ms")


@P.add("recency_gate", f"SELECT seq, coalesce(coalesce(published_ms, created_ms) <= 0 OR coalesce(published_ms, created_ms) >= {DAY_MS} - grace_days * 86400000, true) AS kept FROM cards")
def recency_gate(spark, sf):
    start = F.to_timestamp(F.lit(f"{DAY} 00:00:00")) - F.make_interval(hours=F.lit(8))
    return op.recency_gate(timed(spark, sf), start).select("seq", "kept")


@P.add("event_recency_by_type", "SELECT provider, count(*) FILTER (WHERE k) AS kept, count(*) FILTER (WHERE NOT k) AS dropped FROM (SELECT provider, coalesce(coalesce(published_at, created_at) >= TIMESTAMP '2024-01-14 16:00:00' - to_days(grace_days), true) AS k FROM dated) GROUP BY 1")
def event_recency_by_type(spark, sf):
    d = view(spark, sf, "dated").withColumns({c: F.col(c).cast("timestamp") for c in ("published_at", "created_at")})
    start = F.to_timestamp(F.lit("2024-01-15 00:00:00")) - F.make_interval(hours=F.lit(8))
    return op.recency_gate(d, start).groupBy("provider").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


@P.add("top_topics", f"""SELECT day_no, site, seq, rank_score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY day_no, site ORDER BY rank_score DESC, seq) AS INTEGER) AS place FROM
    (SELECT *, topic_id - CASE WHEN {t.low('title', rules.PROMO)} THEN 1000000 ELSE 0 END AS rank_score
      FROM cards
      WHERE {t.low('title', rules.TOPIC)} AND NOT {t.low('title', rules.OFF_TOPIC)}))
      WHERE place <= 8""")
def top_topics(spark, sf):
    return op.top_topics(view(spark, sf, "cards"), 8, ["day_no", "site"]).select("day_no", "site", "seq", "rank_score", "place")


@P.add("dedupe_urls", f"SELECT min(seq) AS seq, day_no, {t.norm_url('url')} AS key FROM cards WHERE trim(url) <> '' GROUP BY day_no, key")
def dedupe_urls(spark, sf):
    c = view(spark, sf, "cards")
    return op.dedupe_url(c, ["day_no"], f.norm_url(F.col("url")), ["seq"]).select("seq", "day_no", f.norm_url(F.col("url")).alias("key"))


@P.add("dedupe_page_urls", f"SELECT min(seq) AS seq, {t.norm_url('url')} AS key, count(*) AS copies FROM urls GROUP BY 2")
def dedupe_page_urls(spark, sf):
    u = view(spark, sf, "urls").withColumn("key", f.norm_url(F.col("url")))
    once = op.dedupe_url(u, [], F.col("key"), ["seq"]).select("seq", "key")
    return once.join(u.groupBy("key").agg(F.count("*").alias("copies")), "key")


@P.add("rule_match", f"SELECT seq, {t.cluster('title')} AS cluster FROM cards")
def rule_match(spark, sf):
    return op.match_rules(view(spark, sf, "cards")).select("seq", "cluster")


@P.add("substance_scores", f"SELECT seq, {t.substance('snippet')} AS substance FROM cards")
def substance_scores(spark, sf):
    return view(spark, sf, "cards").select("seq", sc.substance(F.col("snippet")).alias("substance"))


# a rule for each word that a title begins with: some want more, some have a second alternative, some exclude, some need no certain string
_rule_words = """SELECT CAST(min(seq) AS BIGINT) AS rule, word FROM (SELECT seq, lower(regexp_extract(title, '^[^ .,!?;:()*+|^$-]+', 0)) AS word FROM cards) w WHERE length(word) >= 2 AND instr(word, chr(123)) + instr(word, chr(91)) + instr(word, chr(92)) + instr(word, chr(125)) + instr(word, chr(93)) = 0 GROUP BY word"""
_rule_table = """SELECT rule, 'w:' || word AS key, CASE rule % 4 WHEN 0 THEN word || '.*gpt' WHEN 1 THEN 'zz' || CAST(rule AS STRING) || '|' || word || '|115 +api' WHEN 2 THEN word || '.*(?:token|llm)' ELSE CASE WHEN rule % 16 = 3 THEN '(?:' || word || '|zzyzx) ' ELSE word END END AS match,
    CASE WHEN rule % 3 = 0 THEN 'token|password' END AS exclude, CASE WHEN rule % 5 > 0 THEN 'Event: ' || word END AS rewrite FROM ({words}) r"""


def rule_table(spark, sf):
    words = spark.sql(_rule_words.replace("FROM cards", "FROM {cards}"), cards=view(spark, sf, "cards"))
    return spark.sql(_rule_table.replace("({words})", "{words}"), words=words)


_ruled = f"""t AS ({_rule_table.replace('STRING', 'VARCHAR').format(words=_rule_words)}),
    h AS (SELECT c.seq, min({{'rule': t.rule, 'key': t.key, 'rewrite': t.rewrite}}) AS best FROM cards c JOIN t ON regexp_matches(lower(c.title), t.match) AND NOT coalesce(regexp_matches(lower(c.title), t.exclude), false) GROUP BY 1)"""


@P.add("rule_table_match", f"WITH {_ruled} SELECT c.seq, h.best.rule AS rule, h.best.key AS cluster, h.best.rewrite AS rewrite FROM cards c LEFT JOIN h ON h.seq = c.seq")
def rule_table_match(spark, sf):
    return op.match_rule_table(view(spark, sf, "cards"), rule_table(spark, sf)).select("seq", "rule", "cluster", "rewrite")


@P.add("rule_table_fold", f"""WITH {_ruled}, m AS (SELECT c.*, h.best.key AS cluster, h.best.rewrite AS rewrite, {t.substance('c.snippet')} AS s FROM cards c LEFT JOIN h ON h.seq = c.seq),
    r AS (SELECT *, row_number() OVER (PARTITION BY day_no, cluster ORDER BY s IS NULL, s DESC, seq) AS rn, min(seq) OVER (PARTITION BY day_no, cluster) AS first_seq FROM m)
    SELECT day_no, seq, cluster, CASE WHEN cluster IS NULL THEN title ELSE {t.scrub("coalesce(rewrite, 'Several: ' || title)", 200)} END AS title, CASE WHEN cluster IS NULL THEN seq ELSE first_seq END AS position FROM r WHERE cluster IS NULL OR rn = 1""")
def rule_table_fold(spark, sf):
    headline = lambda title, text: F.coalesce(text, F.concat(F.lit("Several: "), title))
    return op.fold_by_table(view(spark, sf, "cards").select("day_no", "seq", "title", "snippet"), ["day_no"], rule_table(spark, sf), headline, ["day_no", "seq", "title"]).select("day_no", "seq", "cluster", "title", "position")


_headline = "CASE cluster " + " ".join(f"WHEN '{k}' THEN {t.q(h)}" for k, _, _, h in rules.CLUSTERS) + " ELSE title END"


@P.add("fold_events", f"""WITH m AS (SELECT *, {t.cluster('title')} AS cluster, {t.substance('snippet')} AS s FROM cards),
    r AS (SELECT *, row_number() OVER (PARTITION BY day_no, cluster ORDER BY s IS NULL, s DESC, seq) AS rn, min(seq) OVER (PARTITION BY day_no, cluster) AS first_seq FROM m)
    SELECT day_no, seq, cluster, {_headline} AS title, CASE WHEN cluster IS NULL THEN seq ELSE first_seq END AS position FROM r WHERE cluster IS NULL OR rn = 1""")
def fold_events(spark, sf):
    return op.fold_events(view(spark, sf, "cards"), ["day_no"]).select("day_no", "seq", "cluster", "title", "position")


def _merge_sql(total: int, primary: int | None, first: str = "a") -> str:
    pool = "0" if primary is None else "CASE WHEN prio > 0 THEN 1 ELSE 0 END"
    limit = str(total) if primary is None else f"CASE WHEN pool = 0 THEN {primary} ELSE {total} END"
    return f"""WITH {first} AS (SELECT *, row_number() OVER (PARTITION BY day_no, prio ORDER BY seq) AS n FROM cards),
    b AS (SELECT day_no, prio, seq, {t.url_key('url')} AS key, {t.scrub('title', 200)} AS title, {t.scrub('snippet')} AS snippet
      FROM {first}
      WHERE (prio > 0 OR n <= {total if primary is None else primary}) AND trim(url) <> ''),
    c AS (SELECT *, row_number() OVER (PARTITION BY day_no, key ORDER BY prio, seq) AS k FROM b WHERE title <> '' OR snippet <> ''),
    d AS (SELECT *, {pool} AS pool FROM c WHERE k = 1),
    e AS (SELECT *, row_number() OVER (PARTITION BY day_no, pool ORDER BY prio, seq) AS n FROM d)
    SELECT day_no, prio, seq, title, snippet, CAST(row_number() OVER (PARTITION BY day_no ORDER BY prio, seq) AS INTEGER) AS place FROM e WHERE n <= {limit}"""


@P.add("merge_sources_split", _merge_sql(18, 12))
def merge_sources_split(spark, sf):
    return op.merge_sources(view(spark, sf, "cards"), ["day_no"], 18, 12).select("day_no", "prio", "seq", "title", "snippet", "place")


@P.add("merge_sources_pooled", _merge_sql(18, None))
def merge_sources_pooled(spark, sf):
    return op.merge_sources(view(spark, sf, "cards"), ["day_no"], 18).select("day_no", "prio", "seq", "title", "snippet", "place")


@P.add("combine_cards", f"""WITH a AS (SELECT seq, day_no, url, created_ms, CASE WHEN created_ms IS NULL THEN 1 ELSE 0 END AS part FROM cards WHERE trim(url) <> ''),
    b AS (SELECT *, row_number() OVER (PARTITION BY day_no, {t.url_key('url')} ORDER BY part, CASE WHEN part = 0 THEN -created_ms ELSE 0 END, seq) AS k FROM a)
    SELECT day_no, seq, CAST(row_number() OVER (PARTITION BY day_no ORDER BY part, CASE WHEN part = 0 THEN -created_ms ELSE 0 END, seq) AS INTEGER) AS place FROM b WHERE k = 1""")
def combine_cards(spark, sf):
    c = timed(spark, sf)
    return op.combine_cards(c.where("created_at IS NOT NULL"), c.where("created_at IS NULL").drop("created_at"), ["day_no"]).select("day_no", "seq", "place")


@P.add("first_k_per_provider", f"SELECT provider, day_no, seq FROM (SELECT *, row_number() OVER (PARTITION BY day_no, provider ORDER BY seq) AS n FROM cards WHERE {t.low('title', rules.TOPIC)}) WHERE n <= 2")
def first_k_per_provider(spark, sf):
    c = op.relevant(view(spark, sf, "cards"), None)
    return op.first_k(c, 2, ["day_no", "provider"], ["seq"]).select("provider", "day_no", "seq")


@P.add("union_providers", "SELECT provider_rank, count(*) AS n, count(publish) AS dated FROM (SELECT 0 AS provider_rank, published_ms AS publish FROM cards WHERE site = 'site0' UNION ALL SELECT 1, NULL FROM urls UNION ALL SELECT 3, NULL FROM claims) GROUP BY 1")
def union_providers(spark, sf):
    c, u = view(spark, sf, "cards").where("site = 'site0'"), view(spark, sf, "urls")
    tables = {"forum": c.selectExpr("seq", "published_ms AS publish"), "pages": u.select("seq", "url"), "off": u.select("seq", "url"), "claims": view(spark, sf, "claims").select("seq", "board")}
    return op.union_sources(tables, {"off": False}).groupBy("provider_rank").agg(F.count("*").alias("n"), F.count("publish").alias("dated"))


@P.add("merge_ranked_lists", "WITH a AS (SELECT doc_id AS id, 0 AS list_no, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents UNION ALL SELECT doc_id, 1, row_number() OVER (ORDER BY doc_id) FROM documents WHERE lang = 'en'), l AS (SELECT * FROM a WHERE rank <= 80) SELECT id, CAST(list_no AS INTEGER) AS list_no, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY list_no, rank) AS k FROM l) WHERE k = 1 ORDER BY list_no, rank LIMIT 100")
def merge_ranked_lists(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id AS id", "lang", "n_chars")
    ranked = lambda df, *order: df.orderBy(*order).limit(80).withColumn("rank", F.row_number().over(op.Window.orderBy(*order))).select("id", "rank")
    return op.merge_ranked([ranked(d, F.desc("n_chars"), "id"), ranked(d.where("lang = 'en'"), "id")], "id", 100)


@P.add("valid_items", f"SELECT seq FROM cards WHERE trim(title) <> '' AND trim(url) <> '' AND prio = 1 AND published_ms >= {DAY_MS}")
def valid_items(spark, sf):
    c = timed(spark, sf).withColumn("kind", F.when(F.col("prio") == 1, "story").otherwise("job"))
    start = F.to_timestamp(F.lit(f"{DAY} 00:00:00")) - F.make_interval(hours=F.lit(8))
    return op.valid_items(c, start).select("seq")


@P.add("material_window", f"""WITH k AS (SELECT day_no, site, prio = 0 AS hard, coalesce(coalesce(published_ms, created_ms) >= {DAY_MS} - grace_days * 86400000, true) AS kept FROM cards)
    SELECT day_no, site, count(*) FILTER (WHERE hard) AS hard_sources, count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE NOT kept) AS dropped, greatest(0, count(*) FILTER (WHERE kept) - count(*) FILTER (WHERE hard)) AS other_sources, count(*) FILTER (WHERE hard) < 8 AS low_material
      FROM k
      GROUP BY 1, 2""")
def material_window(spark, sf):
    start = F.to_timestamp(F.lit(f"{DAY} 00:00:00")) - F.make_interval(hours=F.lit(8))
    gated = op.recency_gate(timed(spark, sf), start).withColumn("hard", F.col("prio") == 0)
    return op.material_window(gated, ["day_no", "site"])


@P.add("day_path", f"""WITH a AS ({_merge_sql(40, 25, 'a0')}),
    x AS (SELECT a.day_no, a.seq, a.title, a.snippet, a.place, c.published_ms, c.created_ms, c.grace_days FROM a JOIN cards c ON c.seq = a.seq),
    m AS (SELECT *, {t.cluster('title')} AS cluster, {t.substance('snippet')} AS s FROM x),
    r AS (SELECT *, row_number() OVER (PARTITION BY day_no, cluster ORDER BY s IS NULL, s DESC, place) AS rn, min(place) OVER (PARTITION BY day_no, cluster) AS p FROM m)
    SELECT day_no, seq, {_headline} AS title, CASE WHEN cluster IS NULL THEN place ELSE p END AS position, coalesce(coalesce(published_ms, created_ms) >= {DAY_MS} - grace_days * 86400000, true) AS kept
      FROM r
      WHERE cluster IS NULL OR rn = 1""")
def day_path(spark, sf):
    """Merge, then fold, then recency: a stale card may win a fold and then be dropped."""
    merged = op.merge_sources(timed(spark, sf), ["day_no"], 40, 25).withColumnsRenamed({"seq": "card", "place": "seq"})
    start = F.to_timestamp(F.lit(f"{DAY} 00:00:00")) - F.make_interval(hours=F.lit(8))
    return op.recency_gate(op.fold_events(merged, ["day_no"]), start).select("day_no", F.col("card").alias("seq"), "title", "position", "kept")


@P.add("headlines", f"SELECT day_no, seq, title, CAST(n AS INTEGER) AS place FROM (SELECT day_no, seq, {t.scrub('title', 200)} AS title, row_number() OVER (PARTITION BY day_no ORDER BY seq) AS n FROM cards WHERE {t.scrub('title', 200)} <> '') WHERE n <= 8")
def headlines(spark, sf):
    return op.headlines(view(spark, sf, "cards"), ["day_no"]).select("day_no", "seq", "title", "place")


@P.add("summary_lines", "SELECT day_no, string_agg('- ' || title, chr(10) ORDER BY score DESC, seq) AS lines FROM (SELECT day_no, seq, title, length(snippet) AS score, row_number() OVER (PARTITION BY day_no ORDER BY length(snippet) DESC NULLS LAST, seq) AS n FROM cards) WHERE n <= 10 GROUP BY 1")
def summary_lines(spark, sf):
    return op.summary_lines(view(spark, sf, "cards").withColumn("score", F.length("snippet")), ["day_no"])

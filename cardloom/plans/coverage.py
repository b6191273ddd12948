"""Queries of the coverage self-check."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as f
from ..operators import coverage as op
from . import sqltext as t
from .base import Plans, small_batches, table, view

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles

# three runs; in run r group r returned nothing, group 2 says it is degraded where it returned; from the customers of each group's nations
_returned = "returned AS (SELECT CAST(c_custkey % 3 AS INTEGER) AS run, n_regionkey AS group_no, count(*) % 2 = 0 OR n_regionkey = 2 AS degraded FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey <> c_custkey % 3 AND n_regionkey <> 4 - c_custkey % 3 GROUP BY 1, 2)"
_saved = "saved AS (SELECT DISTINCT CAST(s_suppkey % 3 AS INTEGER) AS run, n_name AS board FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey % 5 <> 0)"
_members = "ms AS (SELECT run, board, board_no, group_no FROM membership, runs)"
_states = """st AS (SELECT m.run, m.board, bool_or(r.group_no IS NULL) OR bool_or(coalesce(r.degraded, false)) AS degraded, bool_and(r.group_no IS NULL) AND NOT (m.run, m.board) IN (SELECT run, board
      FROM saved) AS missing,
    (m.run, m.board) IN (SELECT run, board
      FROM saved) AND (bool_or(r.group_no IS NULL) OR bool_or(coalesce(r.degraded, false))) AS recovered
      FROM ms m
      LEFT JOIN returned r ON r.group_no = m.group_no AND r.run = m.run
      GROUP BY m.run, m.board)"""
_all_states = f"{_returned}, {_saved}, {_members}, {_states}"


def returned(spark, sf):
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer").withColumn("run", (F.col("c_custkey") % 3).cast("int"))
    rows = n.join(c, F.col("c_nationkey") == F.col("n_nationkey")).where("n_regionkey <> run AND n_regionkey <> 4 - run")
    return rows.groupBy("run", F.col("n_regionkey").alias("group_no")).agg(((F.count("*") % 2 == 0) | (F.col("group_no") == 2)).alias("degraded"))


def saved(spark, sf):
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    return n.join(s.where("s_suppkey % 5 <> 0"), F.col("s_nationkey") == F.col("n_nationkey")).select((F.col("s_suppkey") % 3).cast("int").alias("run"), F.col("n_name").alias("board")).distinct()


def members(spark, sf):
    return view(spark, sf, "membership").join(F.broadcast(view(spark, sf, "runs")), F.lit(True))  # three rows


def states(spark, sf):
    return op.board_states(members(spark, sf), returned(spark, sf), saved(spark, sf))


@P.add("board_states", f"WITH {_all_states} SELECT run, board, degraded, missing, recovered FROM st")
def board_states(spark, sf):
    return states(spark, sf)


@P.add("missing_groups", f"WITH {_returned}, {_members} SELECT DISTINCT run, group_no FROM ms WHERE (run, group_no) NOT IN (SELECT run, group_no FROM returned)")
def missing_groups(spark, sf):
    return op.missing_groups(members(spark, sf), returned(spark, sf))


_feeds = f"SELECT key, boards, group_no, run, (first + run) % 7 = 0 AS failed FROM (SELECT {t.norm_url('url')} AS key, list(DISTINCT board) AS boards, CAST(min(seq) % 5 AS INTEGER) AS group_no, min(seq) AS first FROM feeds GROUP BY 1), runs"


def recovery(spark, sf):
    feeds = view(spark, sf, "feeds").groupBy(f.norm_url(F.col("url")).alias("key")).agg(F.collect_set("board").alias("boards"), (F.min("seq") % 5).cast("int").alias("group_no"), F.min("seq").alias("first"))
    feeds = feeds.join(F.broadcast(view(spark, sf, "runs")), F.lit(True)).withColumn("failed", (F.col("first") + F.col("run")) % 7 == 0)
    entries = view(spark, sf, "urls").select((F.col("seq") % 3).cast("int").alias("run"), f.norm_url(F.col("url")).alias("key"), F.concat(F.lit("https://e.example/"), "seq").alias("url"), F.when(F.col("seq") % 2 == 0, F.concat(F.lit("t"), "seq")).alias("title"), F.when(F.col("seq") % 4 == 0, "out").otherwise("in").alias("window"))
    return op.recover(members(spark, sf), returned(spark, sf), feeds, entries)


@P.add("fallback_recovery", f"""WITH {_returned}, {_members}, fd AS ({_feeds}),
    e AS (SELECT CAST(seq % 3 AS INTEGER) AS run, {t.norm_url('url')} AS key, 'https://e.example/' || CAST(seq AS VARCHAR) AS url, CASE WHEN seq % 2 = 0 THEN 't' || CAST(seq AS VARCHAR) END AS title
      FROM urls
      WHERE seq % 4 <> 0)
    SELECT DISTINCT m.run, m.group_no, e.url, coalesce(e.title, e.url) AS title, m.board
      FROM ms m JOIN fd ON fd.run = m.run AND fd.group_no = m.group_no AND list_contains(fd.boards, m.board) JOIN e ON e.key = fd.key AND e.run = m.run
    WHERE NOT fd.failed AND (m.run, m.group_no) NOT IN (SELECT run, group_no FROM returned)""")
def fallback_recovery(spark, sf):
    return recovery(spark, sf)


@P.add("coverage_counts", "SELECT b.run, b.board, coalesce(c.n, 0) AS claims, coalesce(u.n, 0) AS urls FROM (SELECT DISTINCT run, board FROM (SELECT board FROM claims UNION SELECT n_name FROM nation), runs) b LEFT JOIN (SELECT CAST(seq % 3 AS INTEGER) AS run, board, count(*) AS n FROM claims WHERE quality = 1 GROUP BY 1, 2) c USING (run, board) LEFT JOIN (SELECT CAST(seq % 3 AS INTEGER) AS run, board, count(DISTINCT source_url) AS n FROM claims WHERE toxic = 0 GROUP BY 1, 2) u USING (run, board)")
def coverage_counts(spark, sf):
    c = view(spark, sf, "claims").withColumn("run", (F.col("seq") % 3).cast("int"))
    boards = c.select("board").unionByName(table(spark, sf, "nation").select(F.col("n_name").alias("board"))).distinct().join(F.broadcast(view(spark, sf, "runs")), F.lit(True))
    return op.coverage(boards, c.where("toxic = 0").select("run", "board", F.col("source_url").alias("url")), c.where("quality = 1"))


_aliases = "aliases AS (SELECT n_name AS name, n_name AS alias FROM nation UNION SELECT n_name, substring(n_name, 1, 8) FROM nation UNION SELECT p_brand, p_brand FROM part UNION SELECT 'token' || CAST(n_nationkey AS VARCHAR), substring(lower(n_name), 1, 4) FROM nation)"
_texts = "texts AS (SELECT CAST(seq % 3 AS INTEGER) AS run, claim || ' ' || coalesce(quote, '') || CASE WHEN seq % 90 = 0 THEN ' Brand#' || CAST(seq % 60 AS VARCHAR) ELSE '' END AS text FROM claims UNION ALL SELECT CAST(p_partkey % 3 AS INTEGER), p_type || ' ' || p_name FROM part UNION ALL SELECT CAST(s_suppkey % 3 AS INTEGER), s_name FROM supplier)"
_hits = "h AS (SELECT DISTINCT t.run, a.name FROM aliases a JOIN texts t ON contains(t.text, a.alias))"


def aliases(spark, sf):
    n = table(spark, sf, "nation")
    whole = n.selectExpr("n_name AS name", "n_name AS alias")
    rows = whole.unionByName(n.selectExpr("n_name AS name", "substring(n_name, 1, 8) AS alias")).unionByName(table(spark, sf, "part").selectExpr("p_brand AS name", "p_brand AS alias").distinct())
    return rows.unionByName(n.selectExpr("'token' || n_nationkey AS name", "substring(lower(n_name), 1, 4) AS alias"))


def texts(spark, sf):
    small_batches(spark)
    c = view(spark, sf, "claims").selectExpr("CAST(seq % 3 AS INT) AS run", "claim || ' ' || coalesce(quote, '') || CASE WHEN seq % 90 = 0 THEN ' Brand#' || (seq % 60) ELSE '' END AS text")
    parts = table(spark, sf, "part").selectExpr("CAST(p_partkey % 3 AS INT) AS run", "p_type || ' ' || p_name AS text")
    return c.unionByName(parts).unionByName(table(spark, sf, "supplier").selectExpr("CAST(s_suppkey % 3 AS INT) AS run", "s_name AS text"))


@P.add("alias_hits", f"WITH {_aliases}, {_texts}, {_hits} SELECT run, name FROM h")
def alias_hits(spark, sf):
    return op.alias_hits(aliases(spark, sf), texts(spark, sf))


_company = f"""WITH {_all_states}, {_aliases}, {_texts}, {_hits}, ro AS (SELECT DISTINCT run, a.name, n.n_name AS board FROM aliases a JOIN nation n ON n.n_nationkey = length(a.name) % 25, runs),
    qn AS (SELECT DISTINCT name FROM aliases WHERE ascii(substring(name, length(name), 1)) % 2 = 0),
    cs AS (SELECT ro.run, ro.name, ro.board, CASE WHEN coalesce(st.missing, false) THEN 'unreached' WHEN ro.name NOT IN (SELECT name
      FROM qn) OR (ro.run, ro.name) IN (SELECT run, name
      FROM h) THEN 'has_dynamic' ELSE 'no_dynamic' END AS state,
      CASE WHEN coalesce(st.missing, false) THEN 'no_discover' WHEN ro.name IN (SELECT name
      FROM qn) AND (ro.run, ro.name) IN (SELECT run, name
      FROM h) THEN 'report_match' ELSE 'roster' END AS evidence
      FROM ro
      LEFT JOIN st ON st.board = ro.board AND st.run = ro.run)"""


def companies(spark, sf):
    names = aliases(spark, sf).select("name").distinct().join(F.broadcast(view(spark, sf, "runs")), F.lit(True))
    n = table(spark, sf, "nation")
    roster = names.join(n, F.length("name") % 25 == F.col("n_nationkey")).select("run", "name", F.col("n_name").alias("board"))
    quiet = names.where("ascii(substring(name, length(name), 1)) % 2 = 0")
    return op.company_states(roster, quiet, states(spark, sf), op.alias_hits(aliases(spark, sf), texts(spark, sf)))


@P.add("company_states", f"{_company} SELECT run, name, board, state, evidence FROM cs")
def company_states(spark, sf):
    return companies(spark, sf)


@P.add("state_lists", f"{_company} SELECT run, state, list_sort(list(name)) AS names FROM cs GROUP BY 1, 2")
def state_lists(spark, sf):
    return op.state_lists(companies(spark, sf))


_miss = "CASE WHEN seq % 6 = 0 THEN substring(claim, 3, 9) WHEN seq % 6 = 1 THEN 'The Qwen3.8-27B model ' || CAST(seq % 5 AS STRING) WHEN seq % 6 = 2 THEN substring(claim, 1, 2) || '!?' WHEN seq % 6 = 3 THEN '新 模型' ELSE substring(quote, 1, 30) END"
# as the statement has them: words that don't tell names apart
_stop = "'news', 'note', 'report', 'model', 'models', 'open', 'new', 'blog', 'post', 'api', 'app', 'apps', 'ai', 'pro', 'free', 'beta', 'tool', 'tools', 'official', 'release', 'update'"
_tok = f"list_filter(regexp_extract_all(lower({{}}), '[a-z0-9][a-z0-9.%-]*'), lambda x: length(x) >= 4 AND x NOT IN ({_stop}))"


@P.add("near_miss_overlaps", f"""WITH m AS (SELECT seq, seq // 150 AS run, trim(coalesce({_miss}, '')) AS name FROM claims),
    c AS (SELECT seq // 150 AS run, trim(regexp_replace(claim || CASE WHEN seq % 50 = 0 THEN ' qwen3.8-27b' ELSE '' END, '\\s+', ' ', 'g')) AS claim FROM claims WHERE quality = 0),
    k AS (SELECT run, list_distinct(flatten(list({_tok.format('claim')}))) AS tokens FROM c GROUP BY 1)
    SELECT m.seq, m.name
      FROM m
      LEFT JOIN k ON k.run = m.run
      WHERE NOT (list_has_any({_tok.format('m.name')}, coalesce(k.tokens, []))) AND NOT EXISTS (SELECT 1
      FROM c
      WHERE c.run = m.run AND m.name <> '' AND contains(c.claim, m.name))""")
def near_miss_overlaps(spark, sf):
    small_batches(spark)
    rows = view(spark, sf, "claims").withColumn("run", F.expr("seq div 150"))
    misses = rows.select("seq", "run", F.trim(F.coalesce(F.expr(_miss), F.lit(""))).alias("name"))
    claims = rows.where("quality = 0").selectExpr("run", "claim || CASE WHEN seq % 50 = 0 THEN ' qwen3.8-27b' ELSE '' END AS claim")
    return op.drop_overlaps(misses, claims).select("seq", "name")


@P.add("degraded_flags", f"""WITH {_all_states}, r AS (SELECT run AS day, list_sort(list(board) FILTER (WHERE missing)) AS missing, list_sort(list(board) FILTER (WHERE recovered)) AS recovered, bool_or(degraded) AS bad
      FROM st
      GROUP BY 1),
    e AS (SELECT user_id AS run, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value > 90) AS dropped FROM events GROUP BY 1)
    SELECT run, list_filter([CASE WHEN errors > 0 THEN 'verify_agent_errors:' || CAST(errors AS VARCHAR) END, CASE WHEN dropped > 0 THEN 'fetch_budget_dropped:' || CAST(dropped AS VARCHAR) END,
      CASE WHEN len(coalesce(missing, [])) > 0 AND run % 2 = 0 THEN 'discovery_degraded:missing_' || array_to_string(missing, '+') WHEN bad THEN 'discovery_degraded' END,
      CASE WHEN len(coalesce(recovered, [])) > 0 THEN 'discovery_recovered:' || array_to_string(recovered, '+') END], lambda x: x IS NOT NULL) AS flags FROM e JOIN r ON r.day = e.run % 3""")
def degraded_flags(spark, sf):
    lists = [F.array_sort(F.collect_list(F.when(F.col(c), F.col("board")))).alias(c) for c in ("missing", "recovered")]
    s = states(spark, sf).groupBy(F.col("run").alias("day")).agg(*lists, F.bool_or("degraded").alias("bad"))
    runs = table(spark, sf, "events").groupBy(F.col("user_id").alias("run")).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 90).alias("dropped"))
    missing = F.when(F.col("run") % 2 == 0, F.col("missing")).otherwise(F.array().cast("array<string>"))
    return runs.join(s, F.col("run") % 3 == F.col("day")).select("run", op.degraded_flags(F.col("errors"), F.col("dropped"), missing, F.col("bad"), F.col("recovered")).alias("flags"))


_bool = {"search_ok": 3, "synthesized": 5, "synth_failed": 11, "zero_citation": 2, "degraded_dump": 7, "no_credentials": 13, "timed_out": 4, "have_sources": 6}
_run = ", ".join(f"event_id % {k} {'<>' if c in ('search_ok', 'have_sources') else '='} 0 AS {c}" for c, k in _bool.items()) + ", user_id % 4 AS source_count, user_id % 3 AS community_count"


@P.add("run_outcomes", f"""WITH r AS (SELECT event_id, {_run} FROM events), u AS (SELECT *, zero_citation AND source_count = 0 AND NOT synthesized AND NOT degraded_dump AS unfounded FROM r)
    SELECT event_id, (search_ok OR synthesized) AND NOT synth_failed AND NOT unfounded AS ok,
    CASE WHEN synth_failed THEN 'synthesis_failed' WHEN synthesized THEN 'synthesized' WHEN no_credentials THEN 'no_credentials' WHEN NOT search_ok AND timed_out THEN 'search_timeout' WHEN NOT search_ok THEN 'search_failed' WHEN degraded_dump THEN 'degraded_dump' WHEN unfounded THEN 'unfounded' WHEN zero_citation THEN 'no_citation' ELSE 'success' END AS reason,
    have_sources AND NOT (degraded_dump AND community_count = 0) AND ((search_ok AND zero_citation) OR (NOT search_ok AND community_count > 0) OR (degraded_dump AND community_count > 0)) AS resynthesize
      FROM u""")
def run_outcomes(spark, sf):
    r = table(spark, sf, "events").selectExpr("event_id", *_run.split(", "))
    return op.classify_run(r).select("event_id", "ok", "reason", "resynthesize")


@P.add("collector_diagnostics", "SELECT CAST(doc_id % 3 AS INTEGER) AS run, source AS provider, kind, count(*) AS failures, list_sort(list_distinct(list(file))) AS files FROM (SELECT doc_id, source, CASE doc_id % 3 WHEN 0 THEN 'list' ELSE 'topic' END AS kind, lang || '.txt' AS file FROM documents WHERE doc_id % 4 = 0) GROUP BY 1, 2, 3")
def collector_diagnostics(spark, sf):
    d = table(spark, sf, "documents").where("doc_id % 4 = 0").withColumns({"run": (F.col("doc_id") % 3).cast("int"), "provider": F.col("source"), "kind": F.when(F.col("doc_id") % 3 == 0, "list").otherwise("topic"), "file": F.concat("lang", F.lit(".txt"))})
    return op.collector_diagnostics(d)

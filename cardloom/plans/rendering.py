"""Queries for citations and rendered texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import fields as f
from ..operators import rendering as op
from . import sqltext as t
from .base import Plans, view
from .cards import _obscure
from .verification import _voted, voted

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles


def items(spark, sf):
    extra = F.when(F.col("seq") % 5 == 0, "(consensus)").otherwise(F.concat(F.lit("https://Extra.example/"), F.col("seq") % 30))
    sources = F.when(F.col("seq") % 11 == 0, F.array(F.lit("(consensus)"))).when(F.col("seq") % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("source_url"), extra, F.col("source_url")))
    status = F.when(F.col("seq") % 9 == 0, "【窗口外．重大】").when(F.col("seq") % 9 == 1, "checked")
    conf = F.element_at(F.array(F.lit("high"), F.lit("low"), F.lit(None).cast("string")), (F.col("seq") % 3 + 1).cast("int"))
    return view(spark, sf, "claims").select((F.col("seq") % 7).alias("run"), F.ascii(F.expr("substring(board, length(board), 1)")).alias("section_no"), F.expr("'Section ' || ascii(substring(board, length(board), 1))").alias("section"), F.col("seq").alias("item_no"), F.substring("claim", 1, 30).alias("title"), F.substring("quote", 1, 60).alias("summary"), conf.alias("confidence"), status.alias("status"), sources.alias("sources"))


_items = """items AS (SELECT seq % 7 AS run, ascii(substring(board, length(board), 1)) AS section_no, seq AS item_no, substring(claim, 1, 30) AS title, substring(quote, 1, 60) AS summary,
    CASE seq % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS confidence, CASE seq % 9 WHEN 0 THEN '【窗口外．重大】' WHEN 1 THEN 'checked' END AS status,
    CASE WHEN seq % 11 = 0 THEN ['(consensus)'] WHEN seq % 13 = 0 THEN [] ELSE [source_url, CASE WHEN seq % 5 = 0 THEN '(consensus)' ELSE 'https://Extra.example/' || (seq % 30) END, source_url] END AS sources
      FROM claims)"""
_cites = f"""x AS (SELECT run, section_no, item_no, unnest(sources) AS url, generate_subscripts(sources, 1) AS pos FROM items),
    w AS (SELECT run, url, min((section_no, item_no, pos)) AS at_ FROM x WHERE regexp_matches(url, {t.q(rules.WEB_URL)}) GROUP BY 1, 2),
    cites AS (SELECT run, url, CAST(row_number() OVER (PARTITION BY run ORDER BY at_) AS INTEGER) AS n, {t.host_of('url')} AS title FROM w)"""
_badges = "b AS (SELECT i.*, coalesce((SELECT ' ' || string_agg('[' || n || ']', '' ORDER BY n) FROM cites c WHERE c.run = i.run AND list_contains(i.sources, c.url)), '') AS badge FROM items i)"


@P.add("citation_numbers", f"WITH {_items}, {_cites} SELECT run, url, n, title FROM cites")
def citation_numbers(spark, sf):
    return op.citations(items(spark, sf))


@P.add("citation_badges", f"WITH {_items}, {_cites}, {_badges} SELECT run, item_no, badge FROM b")
def citation_badges(spark, sf):
    i = items(spark, sf)
    return op.badges(i, op.citations(i)).select("run", "item_no", "badge")


_cover = "cv AS (SELECT seq % 7 AS run, board, count(*) AS claims, count(DISTINCT source_url) AS urls, count(*) % 3 = 0 AS degraded FROM claims GROUP BY 1, 2)"


def cover(spark, sf):
    return view(spark, sf, "claims").groupBy((F.col("seq") % 7).alias("run"), "board").agg(F.count("*").alias("claims"), F.countDistinct("source_url").alias("urls"), (F.count("*") % 3 == 0).alias("degraded"))


_block = """'**' || title || '**' || CASE WHEN coalesce(status, '') <> '' THEN ' `' || status || '`' ELSE '' END || chr(10) || chr(10) || summary || badge || CASE WHEN len(sources) > 0 AND badge = '' THEN ' [no single link]' ELSE '' END
    || CASE WHEN item_no % 9 = 0 THEN ' *[unchecked]*' ELSE '' END || CASE confidence WHEN 'high' THEN chr(10) || chr(10) || '*Confidence: 高*' WHEN 'low' THEN chr(10) || chr(10) || '*Confidence: 低*' ELSE '' END"""


_nl = "chr(10) || chr(10)"
_misses = "ms AS (SELECT seq % 7 AS run, seq, CASE WHEN seq % 5 = 0 THEN substring(claim, 3, 12) WHEN seq % 5 = 1 THEN 'Kimi-K3.1 x' ELSE left(claim, 20) || ' ' || seq END AS name, publish_date AS date, CASE WHEN seq % 3 = 0 THEN 'note ' || seq END AS note FROM claims WHERE seq % 21 < 4)"
# as the statement has them: words that don't tell names apart
_stop = "'news', 'note', 'report', 'model', 'models', 'open', 'new', 'blog', 'post', 'api', 'app', 'apps', 'ai', 'pro', 'free', 'beta', 'tool', 'tools', 'official', 'release', 'update'"
_tok = f"list_filter(regexp_extract_all(lower({{}}), '[a-z0-9][a-z0-9.%-]*'), lambda x: length(x) >= 4 AND x NOT IN ({_stop}))"


def _near(named: str) -> str:
    """The list of misses that no text of ``named`` (run, claim) has."""
    return f"""nm AS (SELECT run, string_agg('- ' || name || ' (' || coalesce(date, 'undated') || ')' || coalesce(': ' || note, ''), chr(10) ORDER BY seq) AS t FROM ms m
    WHERE NOT EXISTS (SELECT 1
      FROM {named} c
      WHERE c.run = m.run AND (contains(trim(regexp_replace(c.claim, '\\s+', ' ', 'g')), trim(m.name)) OR list_has_any({_tok.format('m.name')}, {_tok.format('c.claim')})))
      GROUP BY 1)"""


def misses(spark, sf):
    name = F.when(F.col("seq") % 5 == 0, F.substring("claim", 3, 12)).when(F.col("seq") % 5 == 1, "Kimi-K3.1 x").otherwise(F.concat(F.substring("claim", 1, 20), F.lit(" "), F.col("seq")))
    note = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("note "), F.col("seq")))
    return view(spark, sf, "claims").where("seq % 21 < 4").select((F.col("seq") % 7).alias("run"), "seq", name.alias("name"), F.col("publish_date").alias("date"), note.alias("note"))


_refs = "rf AS (SELECT run, string_agg('- [' || n || '] [' || title || '](<' || url || '>)', chr(10) ORDER BY n) AS t FROM cites GROUP BY 1)"


def _head(run: str) -> str:
    """The line with window and flags of a run."""
    return f"CASE WHEN {run} % 3 > 0 AND {run} % 2 = 0 THEN {_nl} || '> window w' || {run} || '; degraded: `a`, `b`' WHEN {run} % 3 > 0 THEN {_nl} || '> window w' || {run} WHEN {run} % 2 = 0 THEN {_nl} || '> degraded: `a`, `b`' ELSE '' END"


def headed(runs):
    """Runs with the columns of that line."""
    none = F.array().cast("array<string>")
    return runs.withColumns({"window": F.when(F.col("run") % 3 > 0, F.concat(F.lit("w"), "run")), "flags": F.when(F.col("run") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(none)})


@P.add("daily_report", f"""WITH {_items}, {_cites}, {_badges}, {_cover}, {_misses}, {_near('(SELECT run, title AS claim FROM items)')}, s AS (SELECT run, section_no, string_agg({_block}, chr(10) || chr(10) ORDER BY item_no) AS body
      FROM b
      GROUP BY 1, 2),
    sec AS (SELECT run, string_agg('### Section ' || section_no || {_nl} || body, {_nl} ORDER BY section_no) AS t FROM s GROUP BY 1), {_refs},
    co AS (SELECT run, string_agg('- **' || upper(board) || '**: ' || claims || ' claims / ' || urls || ' sources' || CASE WHEN degraded THEN ' `[degraded]`' ELSE '' END, chr(10) ORDER BY board) AS t
      FROM cv
      GROUP BY 1)
    SELECT co.run, '# Daily report ' || co.run
      || CASE WHEN co.run < 5 THEN {_nl} || '> **Material**: ' || CASE WHEN co.run = 3 THEN '?' ELSE CAST(co.run * 2 AS VARCHAR) END || ' of the day; ' || (co.run + 40) || ' sources of late.' ELSE '' END
      || CASE WHEN co.run < 5 AND (CASE WHEN co.run = 3 THEN 0 ELSE co.run * 2 END) + co.run < 8 THEN {_nl} || '> **Low material**: fewer than 8 hard sources; mind their age.' ELSE '' END
      || {_head('co.run')} || {_nl} || '## In one line' || {_nl} || 'All of it.' || CASE WHEN co.run % 3 > 0 THEN {_nl} || '## Summary' || {_nl} || 'More of ' || co.run ELSE '' END || {_nl} || '## News' || {_nl} || sec.t
      || CASE WHEN co.run % 2 = 1 THEN {_nl} || '## Unverified and limits' || {_nl} || '- weak' || chr(10) || '- weaker' ELSE '' END || coalesce({_nl} || '## Outside the window' || {_nl} || nm.t, '') || CASE WHEN co.run % 3 = 1 THEN {_nl} || '## Open questions' || {_nl} || '- why?' ELSE '' END
      || {_nl} || '## Coverage' || {_nl} || co.t || coalesce({_nl} || '## References' || {_nl} || rf.t, '') AS markdown
      FROM co
      LEFT JOIN sec USING (run)
      LEFT JOIN rf USING (run)
      LEFT JOIN nm USING (run)""")
def daily_report(spark, sf):
    i = items(spark, sf)
    none = F.array().cast("array<string>")
    run = F.col("run")
    columns = {
        "one_liner": F.lit("All of it."), "exec_summary": F.when(run % 3 > 0, F.concat(F.lit("More of "), run)), 
        "caveats": F.when(run % 2 == 1, F.array(F.lit("weak"), F.lit("weaker"))), "questions": F.when(run % 3 == 1, F.array(F.lit("why?"))).otherwise(none),
        "confirmed": F.when((run < 5) & (run != 3), run * 2), "major_out": F.when(run < 5, run), "discovered": F.when(run < 5, run + 40),
    }
    return op.report(headed(i.select("run").distinct()).withColumns(columns), i, cover(spark, sf).withColumn("title", F.upper("board")), misses(spark, sf))


_vote = "CAST(valid - refuted AS VARCHAR) || '-' || CAST(refuted AS VARCHAR)"
_outcome = "CASE WHEN seq % 10 = 7 THEN 'major_out' ELSE part END"
_one_line = "trim(regexp_replace(claim, '\\s+', ' ', 'g'))"


@P.add("degraded_report", f"""WITH {_voted}, {_cover}, {_misses}, d AS (SELECT seq % 7 AS run, seq, {_outcome} AS part, claim, CASE WHEN seq % 6 = 5 THEN NULL ELSE source_url END AS source_url, CASE WHEN seq % 4 > 0 THEN source_quality END AS q, publish_date AS date, CASE WHEN seq % 10 = 7 THEN NULL ELSE {_vote} END AS vote, seq % 3 > 0 AS by_vote, errored
      FROM p),
    w AS (SELECT run, source_url AS url, min((CASE WHEN part = 'killed' THEN 1 ELSE 0 END, seq)) AS at_
      FROM d
      WHERE source_url IS NOT NULL AND part IN ('confirmed', 'major_out', 'killed')
      GROUP BY 1, 2),
    cites AS (SELECT run, url, row_number() OVER (PARTITION BY run ORDER BY at_) AS n, {t.host_of('url')} AS title FROM w),
    x AS (SELECT d.*, {_one_line} AS line, coalesce(' [' || c.n || ']', '') AS badge, CASE WHEN errored > 0 THEN ' (' || errored || ' votes failed)' ELSE '' END AS bad
      FROM d
      LEFT JOIN cites c ON c.run = d.run AND c.url = d.source_url
      WHERE part IN ('confirmed', 'major_out', 'killed')),
    {_near("(SELECT run, claim FROM d WHERE part = 'major_out')")}, {_refs},
    co AS (SELECT run, '| Board | Title | Claims | Note |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || string_agg('| ' || {t.cell('board')} || ' | ' || upper(board) || ' | ' || claims || ' | ' || CASE WHEN board = 'src1' AND run % 2 = 1 THEN 'no news: X, Y' WHEN degraded THEN 'degraded' ELSE '' END || ' |', chr(10) ORDER BY board) AS t
      FROM cv
      GROUP BY 1),
    ls AS (SELECT run, {_nl} || '## Within the window (' || count(*) FILTER (WHERE part = 'confirmed') || ', confirmed by votes)' || coalesce({_nl} || string_agg('- ' || CASE WHEN by_vote THEN '`✓' ELSE '`◇' END || coalesce(vote, '?') || '` ' || line || badge || ' — *(' || coalesce(q, '?') || ')*' || bad, chr(10) ORDER BY seq) FILTER (WHERE part = 'confirmed'), '')
      || coalesce({_nl} || '## Outside the window: milestones (' || count(*) FILTER (WHERE part = 'major_out') || ', not voted on)' || {_nl} || string_agg('- ' || line || ' (' || coalesce(date, '?') || ')', chr(10) ORDER BY seq) FILTER (WHERE part = 'major_out'), '')
      || coalesce({_nl} || '## Refuted (' || count(*) FILTER (WHERE part = 'killed') || ', voted down)' || {_nl} || string_agg('- ~~' || line || '~~ refuted `' || coalesce(vote, '?') || '`' || badge || bad, chr(10) ORDER BY seq) FILTER (WHERE part = 'killed'), '') AS t
      FROM x
      GROUP BY 1)
    SELECT run, '# Daily report ' || run || ' (degraded)' || {_head('run')} || {_nl} || 'Reason: ' || CASE WHEN run % 4 = 1 THEN 'it timed out' ELSE 'no complete report was made' END || '. What follows is put together from the checked claims, one by one.'
      || coalesce(ls.t, {_nl} || '## Within the window (0, confirmed by votes)') || coalesce({_nl} || '## Outside the window' || {_nl} || nm.t, '') || {_nl} || '## Coverage' || {_nl} || co.t || coalesce({_nl} || '## References' || {_nl} || rf.t, '') AS markdown
      FROM co
      LEFT JOIN ls USING (run)
      LEFT JOIN nm USING (run)
      LEFT JOIN rf USING (run)""")
def degraded_report(spark, sf):
    v = voted(spark, sf).withColumns({"run": F.col("seq") % 7, "part": F.expr(_outcome), "date": F.col("publish_date"), "by_vote": F.col("seq") % 3 > 0})
    v = v.withColumns({"source_url": F.when(F.col("seq") % 6 != 5, F.col("source_url")), "source_quality": F.when(F.col("seq") % 4 > 0, F.col("source_quality")), "vote": F.when(F.col("seq") % 10 != 7, f.vote_label(F.col("valid") - F.col("refuted"), F.col("refuted"), F.lit(False)))})
    c = cover(spark, sf).withColumn("title", F.upper("board"))
    runs = headed(c.select("run").distinct()).withColumns({"reason": F.when(F.col("run") % 4 == 1, "it  timed\nout"), "quiet": F.when(F.col("run") % 2 == 1, F.array(F.lit("X"), F.lit("Y")))})
    return op.degraded_report(v, c, misses(spark, sf), runs=runs, quiet_board="src1")


@P.add("front_matter", "SELECT source, '---' || chr(10) || 'date: 2026-08-01' || chr(10) || coalesce('lang: ' || max(CASE WHEN lang = 'es' AND doc_id % 50 = 3 THEN lang END) || chr(10), '') || 'tags: [' || array_to_string(list_sort(list_distinct(list(lang))), ', ') || ']' || chr(10) || '---' AS text FROM documents GROUP BY 1")
def front_matter(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").groupBy("source").agg(F.max(F.expr("CASE WHEN lang = 'es' AND doc_id % 50 = 3 THEN lang END")).alias("lang"), F.array_sort(F.collect_set("lang")).alias("tags"))
    return d.select("source", op.front_matter(date=F.lit("2026-08-01"), lang=F.col("lang"), tags=op.bracketed(F.col("tags"))).alias("text"))


_safe = f"regexp_matches({t.trimmed('url')}, '(?i)^https?://[^\\x00-\\x20\\x7F]+$')"
_target = "replace(replace(replace({}, '\\', '\\\\'), '<', '\\<'), '>', '\\>')"
_label = t.markdown("CASE WHEN coalesce(title, '') <> '' THEN title WHEN coalesce(url, '') <> '' THEN url ELSE '(untitled)' END")
_quote = t.markdown("snippet", True)
_card = f"CASE WHEN {_safe} THEN '- [' || {_label} || '](<' || {_target.format(t.trimmed('url'))} || '>)' ELSE '- ' || {_label} END || CASE WHEN {_quote} <> '' THEN chr(10) || '  > ' || replace({_quote}, chr(10), chr(10) || '  > ') ELSE '' END"
_odd_cards = "SELECT seq, day_no, CASE WHEN seq % 12 = 1 THEN '' ELSE title END AS title, CASE WHEN seq % 10 = 3 THEN 'https://x.example/a<b>' WHEN seq % 10 = 4 THEN ' ftp://x.example ' ELSE url END AS url, snippet FROM cards WHERE day_no % 4 <> 3"


@P.add("card_lists", f"SELECT d.day_no, coalesce(l.markdown, '_No sources._') AS markdown FROM (SELECT DISTINCT day_no FROM cards) d LEFT JOIN (SELECT day_no, string_agg({_card}, chr(10) ORDER BY seq) AS markdown FROM ({_odd_cards}) GROUP BY 1) l ON l.day_no = d.day_no")
def card_lists(spark, sf):
    """Every day's cards; days of which all cards are left out show the placeholder."""
    c = view(spark, sf, "cards")
    title = F.when(F.col("seq") % 12 == 1, "").otherwise(F.col("title"))
    url = F.when(F.col("seq") % 10 == 3, "https://x.example/a<b>").when(F.col("seq") % 10 == 4, " ftp://x.example ").otherwise(F.col("url"))
    return op.card_list(c.where("day_no % 4 <> 3").withColumns({"title": title, "url": url}), ["day_no"], c.select("day_no"))


def _xml(e: str) -> str:
    return f"replace(replace(replace({e}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@P.add("model_inputs", f"""WITH s AS (SELECT day_no, seq, provider, url, {t.scrub('snippet', 800)} AS clean, {t.scrub('title', 200)} AS head FROM cards WHERE prio = 0),
    c AS (SELECT *, CASE WHEN {_obscure} AND head <> '' THEN {t.scrub("head || '。' || clean", 800)} ELSE clean END AS body, row_number() OVER (PARTITION BY day_no ORDER BY seq) AS n FROM s)
    SELECT day_no, string_agg('<untrusted-source index="' || n || '" provider="' || {_xml('provider')} || '">' || chr(10) || {_xml('head')} || chr(10) || {_xml('url')} || chr(10) || {_xml('body')} || chr(10) || '</untrusted-source>', chr(10) ORDER BY n) AS prompt
      FROM c
      GROUP BY 1""")
def model_inputs(spark, sf):
    return op.model_input(view(spark, sf, "cards").where("prio = 0"), ["day_no"])


_bodies = "bodies AS (SELECT CAST(day_no AS BIGINT) AS run, 'x' || string_agg(CASE WHEN day_no % 5 = 4 THEN ' none' ELSE ' [' || (seq % 90) || ']' END, '' ORDER BY seq) AS body FROM cards WHERE seq % 60 < 5 GROUP BY 1), src AS (SELECT CAST(day_no AS BIGINT) AS run, seq, url, title, CAST(row_number() OVER (PARTITION BY day_no ORDER BY seq) AS INTEGER) AS place FROM cards WHERE url <> '')"
_cited = f"WITH {_bodies}, m AS (SELECT DISTINCT run, CAST(unnest(regexp_extract_all(body, '\\[([0-9]{{1,4}})\\]', 1)) AS INTEGER) AS place FROM bodies), h AS (SELECT s.run, s.place FROM src s JOIN m ON m.run = s.run AND m.place = s.place), r AS (SELECT s.*, row_number() OVER (PARTITION BY s.run ORDER BY s.place) AS rank FROM src s WHERE s.run IN (SELECT run FROM bodies) AND ((s.run, s.place) IN (SELECT run, place FROM h) OR s.run NOT IN (SELECT run FROM h)))"


def cited(spark, sf):
    c = view(spark, sf, "cards").withColumn("run", F.col("day_no").cast("bigint"))
    mark = F.when(F.col("day_no") % 5 == 4, " none").otherwise(F.concat(F.lit(" ["), F.col("seq") % 90, F.lit("]")))
    bodies = c.where("seq % 60 < 5").groupBy("run").agg(F.concat(F.lit("x"), op.ordered("seq", mark, "")).alias("body"))
    place = F.row_number().over(op.Window.partitionBy("run").orderBy("seq"))
    return op.cited_sources(bodies, c.where("url <> ''").select("run", "seq", "url", "title", place.alias("place")))


@P.add("cited_sources", f"{_cited} SELECT run, place, seq FROM r WHERE rank <= 30")
def cited_sources(spark, sf):
    return cited(spark, sf).select("run", "place", "seq")


@P.add("reference_lists", f"{_cited} SELECT run, string_agg('[' || place || '] [' || {t.markdown('title')} || '](<' || {_target.format('url')} || '>)', chr(10) ORDER BY place) AS markdown FROM r WHERE rank <= 30 GROUP BY 1")
def reference_lists(spark, sf):
    return op.reference_list(cited(spark, sf))


@P.add("day_notes", f"SELECT day_no, string_agg('### ' || {t.markdown('title')} || chr(10) || url || CASE WHEN seq % 4 > 0 THEN chr(10) || 'files: ' || (seq % 4) ELSE '' END || CASE WHEN seq % 3 = 0 THEN chr(10) || '![[posts/' || seq || '.md]]' ELSE '' END, chr(10) || chr(10) ORDER BY seq) AS markdown FROM cards WHERE site = 'site1' GROUP BY 1")
def day_notes(spark, sf):
    c = view(spark, sf, "cards").where("site = 'site1'").withColumns({"files": F.col("seq") % 4, "post_file": F.when(F.col("seq") % 3 == 0, F.concat(F.lit("posts/"), "seq", F.lit(".md")))})
    return op.day_note(c, ["day_no"])

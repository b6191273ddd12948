"""Queries over claims, votes, candidates and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import fields as f
from ..operators import verification as op
from . import sqltext as t
from .base import Plans, table, view
from .fields import _fingerprint, _names

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles
LOW, HIGH = 20260803, 20260812

_rank = lambda c, names: f"coalesce(list_position([{', '.join(map(t.q, names))}], {c}), {len(names) + 1})"
_order = f"{_rank('importance', rules.IMPORTANCE)}, {_rank('source_quality', rules.QUALITY)}, seq"
_window = f"""CASE WHEN {t.day_num('publish_date')} IS NULL AND {t.day_num('claim_date')} IS NULL THEN 'unknown'
    WHEN coalesce({t.day_num('publish_date')} BETWEEN {LOW} AND {HIGH}, true) AND coalesce({t.day_num('claim_date')} BETWEEN {LOW} AND {HIGH}, true) THEN 'in' ELSE 'out' END"""
_tally = """SELECT claim_id, count(*) FILTER (WHERE NOT errored) AS valid, count(*) FILTER (WHERE NOT errored AND refuted) AS refuted, count(*) FILTER (WHERE errored) AS errored,
    count(*) FILTER (WHERE NOT errored) >= 2 AND count(*) FILTER (WHERE NOT errored AND refuted) < 2 AS survives, count(*) FILTER (WHERE NOT errored AND refuted) >= 2 AS is_refuted FROM"""
_adaptive = """(SELECT *
      FROM (SELECT *, count(*) FILTER (WHERE vote_no <= 2 AND NOT errored AND refuted) OVER (PARTITION BY claim_id) AS no_, count(*) FILTER (WHERE vote_no <= 2 AND NOT errored AND NOT refuted) OVER (PARTITION BY claim_id) AS yes_
    FROM votes WHERE vote_no <= 3) WHERE vote_no <= 2 OR (no_ < 2 AND yes_ < 2))"""


def windowed(spark, sf):
    return view(spark, sf, "claims").withColumn("window", op.claim_window(F.col("publish_date"), F.col("claim_date"), LOW, HIGH))


@P.add("claim_window", f"SELECT seq, {_window} AS window FROM claims")
def claim_window(spark, sf):
    return windowed(spark, sf).select("seq", "window")


@P.add("age_gate", f"SELECT seq FROM claims WHERE date_diff('day', TRY_STRPTIME(CAST({t.day_num('claim_date')} AS VARCHAR), '%Y%m%d'), TIMESTAMP '2026-08-26') <= 21")
def age_gate(spark, sf):
    return op.age_gate(view(spark, sf, "claims"), F.col("claim_date"), 20260826).select("seq")


@P.add("vote_tally", f"{_tally} votes WHERE vote_no <= 3 GROUP BY 1")
def vote_tally(spark, sf):
    return op.tally(view(spark, sf, "votes").where("vote_no <= 3"))


@P.add("adaptive_tally", f"{_tally} {_adaptive} GROUP BY 1")
def adaptive_tally(spark, sf):
    return op.tally(op.adaptive_votes(view(spark, sf, "votes")))


_voted = f"""v AS ({_tally} {_adaptive} GROUP BY 1),
    c AS (SELECT *, {_window} AS "window", seq % (SELECT count(DISTINCT claim_id) FROM votes) AS claim_id FROM claims),
    p AS (SELECT c.*, v.valid, v.refuted, v.errored, v.survives, CASE WHEN survives THEN CASE WHEN "window" = 'out' THEN 'out_of_window' ELSE 'confirmed' END WHEN is_refuted THEN 'killed' ELSE 'unverified' END AS part
      FROM c JOIN v USING (claim_id))"""


def voted(spark, sf):
    """Claims with the tally of a voter's events (claim seq modulo the number of voters) and their partition."""
    verdicts = op.tally(op.adaptive_votes(view(spark, sf, "votes")))
    voters = view(spark, sf, "votes").agg(F.countDistinct("claim_id"))
    claims = windowed(spark, sf).withColumn("claim_id", F.col("seq") % voters.scalar())
    return claims.join(verdicts, "claim_id").withColumn("part", op.partition_of(F.col("window")))


@P.add("claim_partition", f"""WITH {_voted} SELECT seq, "window", part FROM p""")
def claim_partition(spark, sf):
    return voted(spark, sf).select("seq", "window", "part")


@P.add("known_event_union", f"""WITH {_voted} SELECT seq, board, claim, source_url, CAST(valid - refuted AS VARCHAR) || '-' || CAST(refuted AS VARCHAR) AS vote, false AS injected FROM p WHERE part = 'confirmed'
    UNION ALL SELECT seq, 'strategy', {_names}, source_url, '—', true FROM claims WHERE seq % 40 = 0""")
def known_event_union(spark, sf):
    """Confirmed claims and injected known events, which no vote has checked."""
    known = view(spark, sf, "claims").where("seq % 40 = 0").withColumns({"claim": F.expr(_names), "board": F.lit("strategy")})
    return op.known_union(voted(spark, sf).where("part = 'confirmed'"), known)


@P.add("claim_order", f"SELECT board, seq, CAST(row_number() OVER (PARTITION BY board ORDER BY {_order}) AS INTEGER) AS place FROM claims")
def claim_order(spark, sf):
    return op.order_claims(view(spark, sf, "claims"), ["board"]).select("board", "seq", "place")


BUDGET = 25
_quota_sql = f"""WITH RECURSIVE s AS (SELECT seq % 3 AS run, board, min(seq) AS first, count(*) AS n FROM claims WHERE quality = 1 OR board IN ('src3', 'src5', 'src7') GROUP BY 1, 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY first, board) AS i, sum(n) OVER (PARTITION BY run) AS total FROM s),
    a AS (SELECT run, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS q, CAST(0 AS BIGINT) AS used FROM o WHERE i = 1
      UNION ALL SELECT o.run, o.i, x.q, CAST(a.used + x.q AS BIGINT)
      FROM a JOIN o ON o.run = a.run AND o.i = a.i + 1, LATERAL (SELECT CAST(least(CASE WHEN {BUDGET} * o.n // o.total = 0 AND a.used < {BUDGET} THEN 1 ELSE {BUDGET} * o.n // o.total END, o.n) AS BIGINT) AS q) x),
    b AS (SELECT o.run, o.board, o.n, a.q, row_number() OVER (PARTITION BY o.run ORDER BY o.n - a.q DESC, o.first, o.board) AS i FROM a JOIN o USING (run, i)),
    r AS (SELECT run, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS t, CAST({BUDGET} - max(used) AS BIGINT) AS room FROM a GROUP BY run
      UNION ALL SELECT b.run, b.i, x.t, CAST(r.room - x.t AS BIGINT)
      FROM r JOIN b ON b.run = r.run AND b.i = r.i + 1, LATERAL (SELECT CAST(greatest(0, least(b.n - b.q, r.room)) AS BIGINT) AS t) x),
    q AS (SELECT b.run, b.board, b.q + r.t AS quota FROM b JOIN r USING (run, i))"""


def quota_claims(spark, sf):
    return view(spark, sf, "claims").where("quality = 1 OR board IN ('src3', 'src5', 'src7')").withColumn("run", F.col("seq") % 3)


@P.add("verification_quotas", f"{_quota_sql} SELECT run, board, quota FROM q")
def verification_quotas(spark, sf):
    c = quota_claims(spark, sf)
    return op.quotas(c.groupBy("run", "board").agg(F.min("seq").alias("seq"), F.count("*").alias("n")), BUDGET)


@P.add("claims_within_quota", f"{_quota_sql} SELECT run, board, seq, place FROM (SELECT seq % 3 AS run, board, seq, CAST(row_number() OVER (PARTITION BY seq % 3, board ORDER BY {_order}) AS INTEGER) AS place FROM claims WHERE quality = 1 OR board IN ('src3', 'src5', 'src7')) JOIN q USING (run, board) WHERE place <= quota")
def claims_within_quota(spark, sf):
    return op.within_quota(quota_claims(spark, sf), BUDGET).select("run", "board", "seq", "place")


@P.add("round_robin_disjoint", """WITH c AS (SELECT seq, date_trunc('month', run_date)::DATE AS run_date, board, url || '/' || board AS url, row_number() OVER (PARTITION BY date_trunc('month', run_date), board, url ORDER BY seq) AS k
      FROM candidates),
    r AS (SELECT run_date, board, seq, row_number() OVER (PARTITION BY run_date, board ORDER BY seq) AS n FROM c WHERE k = 1),
    o AS (SELECT *, row_number() OVER (PARTITION BY run_date ORDER BY n, board) AS slot FROM r) SELECT run_date AS run, board, seq, CAST(slot AS INTEGER) AS slot FROM o WHERE slot <= 12""")
def round_robin_disjoint(spark, sf):
    """Boards without common URLs, where ranks alone give the answer."""
    c = view(spark, sf, "candidates").withColumns({"run": F.trunc("run_date", "month"), "url": F.concat("url", F.lit("/"), "board"), "board_no": F.ascii("board")})
    return op.round_robin(c, 12)


# one slot after the other: the state of a run is the list of keys taken and, for each board, the slot of its last turn
_round_robin = f"""WITH RECURSIVE c AS (SELECT date_trunc('month', run_date)::DATE AS run, board, ascii(board) AS board_no, seq, {t.norm_url('url')} AS key FROM candidates),
    f AS (SELECT run, board, board_no, key, min(seq) AS seq FROM c GROUP BY ALL),
    b AS (SELECT run, board, board_no, row_number() OVER (PARTITION BY run ORDER BY board_no, board) AS i, count(*) OVER (PARTITION BY run) AS boards
      FROM (SELECT DISTINCT run, board, board_no
      FROM f)),
    l AS (SELECT b.run, b.i, b.boards, b.board, list({{'seq': seq, 'key': key}} ORDER BY seq) AS urls FROM b JOIN f USING (run, board, board_no) GROUP BY ALL),
    s AS (SELECT run, CAST(0 AS BIGINT) AS turn, 0 AS slot, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS board FROM (SELECT DISTINCT run FROM l)
      UNION ALL SELECT s.run, s.turn + 1, CASE WHEN u IS NULL THEN s.slot ELSE s.slot + 1 END, CASE WHEN u IS NULL THEN s.taken ELSE list_append(s.taken, u.key) END, u.seq, l.board
      FROM s JOIN l ON l.run = s.run AND l.i = s.turn % l.boards + 1, LATERAL (SELECT list_filter(l.urls, lambda x: NOT list_contains(s.taken, x.key))[1] AS u) p
      WHERE s.slot < 12 AND s.turn < 12 * l.boards)
    SELECT run, board, seq, CAST(slot AS INTEGER) AS slot FROM s WHERE seq IS NOT NULL"""


@P.add("round_robin", _round_robin)
def round_robin(spark, sf):
    """Boards with common URLs: what one takes changes what the next takes."""
    c = view(spark, sf, "candidates").withColumn("run", F.trunc("run_date", "month")).withColumn("board_no", F.ascii("board"))
    return op.round_robin(c, 12)


@P.add("budget_dropped", """WITH c AS (SELECT seq, date_trunc('month', run_date)::DATE AS run_date, board, url || '/' || board AS url FROM candidates),
    d AS (SELECT *, row_number() OVER (PARTITION BY run_date, url ORDER BY seq) AS k FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY run_date, board ORDER BY seq) AS n FROM d WHERE k = 1),
    o AS (SELECT *, row_number() OVER (PARTITION BY run_date ORDER BY n, board) AS slot FROM r)
    SELECT c.seq, c.board FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE slot <= 12 AND o.run_date = c.run_date AND o.url = c.url)""")
def budget_dropped(spark, sf):
    c = view(spark, sf, "candidates").withColumns({"run": F.trunc("run_date", "month"), "url": F.concat("url", F.lit("/"), "board"), "board_no": F.ascii("board")})
    return op.dropped_by_budget(c, op.round_robin(c, 12)).select("seq", "board")


@P.add("duplicate_urls", f"""WITH c AS (SELECT *, date_trunc('month', run_date)::DATE AS run, {t.norm_url('url')} AS key FROM candidates)
    SELECT run, key, copies, board, seq
      FROM (SELECT *, count(*) OVER (PARTITION BY run, key) AS copies, row_number() OVER (PARTITION BY run, key ORDER BY ascii(board), seq) AS k
      FROM c)
      WHERE k = 1 AND copies > 1""")
def duplicate_urls(spark, sf):
    c = view(spark, sf, "candidates").withColumns({"run": F.trunc("run_date", "month"), "board_no": F.ascii("board")})
    return op.duplicate_urls(c)


@P.add("within_byte_budget", """WITH s AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY owner ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY owner ORDER BY seq) AS place
      FROM files
      WHERE bytes <= 8000)
    SELECT owner, seq, bytes, CAST(before AS BIGINT) AS before FROM s WHERE before < 30000 AND place <= 20""")
def within_byte_budget(spark, sf):
    small = view(spark, sf, "files").where("bytes <= 8000")
    return op.within_budget(small, "owner", 20, 30000).select("owner", "seq", "bytes", "before")


_note = "CASE WHEN seq % 4 = 1 THEN NULL ELSE 'noted by ' || board END"
_known_name = f"CASE WHEN seq % 5 = 3 THEN 'x' || (seq % 3) || '：' || ({_names}) ELSE ({_names}) END"
_known = f"""n AS (SELECT CAST(seq // 100 AS BIGINT) AS run, seq, coalesce({_known_name}, '') AS name, coalesce({_note}, '') AS note, claim_date AS date, source_url AS url, board FROM claims),
    k AS (SELECT *, name || '：' || note AS claim, {_fingerprint('name')} AS key, {_fingerprint("name || '：' || note")} AS whole_, {_fingerprint("string_split(name || '：' || note, '：')[1]")} AS first_, coalesce(regexp_matches(date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'), false) AS full_day, row_number() OVER (PARTITION BY run ORDER BY seq) AS i
      FROM n),
    r AS (SELECT run, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(pos BIGINT, name VARCHAR, note VARCHAR, date VARCHAR, whole_ VARCHAR, first_ VARCHAR, full_day BOOLEAN, url VARCHAR, board VARCHAR)[]) AS ev
      FROM (SELECT DISTINCT run
      FROM k)
      UNION ALL SELECT r.run, k.i, CASE WHEN at_ IS NULL THEN list_append(r.ev, {{'pos': k.seq, 'name': k.name, 'note': k.note, 'date': k.date, 'whole_': k.whole_, 'first_': k.first_, 'full_day': k.full_day, 'url': k.url, 'board': k.board}})
          WHEN k.full_day AND NOT r.ev[at_].full_day THEN list_concat(list_concat(r.ev[: at_ - 1], [{{'pos': r.ev[at_].pos, 'name': k.name, 'note': k.note, 'date': k.date, 'whole_': k.whole_, 'first_': k.first_, 'full_day': true, 'url': r.ev[at_].url, 'board': r.ev[at_].board}}]), r.ev[at_ + 1 :]) ELSE r.ev END
      FROM r JOIN k ON k.run = r.run AND k.i = r.i + 1, LATERAL (SELECT list_position(list_transform(r.ev, lambda e: e.whole_ = k.key OR e.first_ = k.key), true) AS p, CASE WHEN p > 0 THEN p END AS at_) q),
    e AS (SELECT run, unnest(ev) AS e FROM (SELECT run, ev, row_number() OVER (PARTITION BY run ORDER BY i DESC) AS z FROM r) WHERE z = 1)"""


@P.add("known_event_merge", f"WITH RECURSIVE {_known} SELECT run, e.pos AS position, e.name, e.note, e.name || '：' || e.note AS claim, e.note AS quote, e.date, e.url, e.board FROM e")
def known_event_merge(spark, sf):
    c = view(spark, sf, "claims").select(F.expr("seq div 100").alias("run"), "seq", F.expr(_known_name).alias("name"), F.expr(_note).alias("note"), F.col("claim_date").alias("date"), F.col("source_url").alias("url"), "board")
    return op.merge_events(c)


@P.add("source_statistics", f"WITH {_voted} SELECT source_url, count(*) AS claims, count(*) FILTER (WHERE part = 'confirmed') AS confirmed FROM p GROUP BY 1")
def source_statistics(spark, sf):
    return op.source_statistics(voted(spark, sf))


@P.add("batch_numbers", "SELECT board, seq, CAST((row_number() OVER (PARTITION BY board ORDER BY seq) + 5) // 6 AS INTEGER) AS batch FROM claims")
def batch_numbers(spark, sf):
    return op.batch_numbers(view(spark, sf, "claims"), ["board"]).select("board", "seq", "batch")


_stages = {"discovered": "SELECT seq FROM urls", "fetched": "SELECT seq FROM page_cards", "extracted": "SELECT seq FROM claims", "verified": "SELECT seq FROM p", "major_out": "SELECT seq FROM claims WHERE seq % 40 = 0"} | {part: f"SELECT seq FROM p WHERE part = '{part}'" for part in ("confirmed", "killed", "unverified", "out_of_window")} | {"dupes": "SELECT seq FROM urls WHERE seq >= 1000000000 AND seq < 2000000000", "dropped": "SELECT seq FROM claims WHERE quality = 0"}
_counts = " UNION ALL ".join(f"SELECT CAST(seq // 50 % 20 AS BIGINT) AS run, '{name}' AS stage FROM ({sql})" for name, sql in _stages.items())


@P.add("run_funnel", f"WITH {_voted}, f AS ({_counts}) SELECT run, " + ", ".join(f"count(*) FILTER (WHERE stage = '{name}') AS {name}" for name in _stages) + " FROM f GROUP BY 1")
def run_funnel(spark, sf):
    run = lambda df: df.select(F.expr("seq div 50 % 20").alias("run"))
    p, claims, urls = voted(spark, sf), view(spark, sf, "claims"), view(spark, sf, "urls")
    stages = {"discovered": urls, "fetched": view(spark, sf, "page_cards"), "extracted": claims, "verified": p, "major_out": claims.where("seq % 40 = 0"), "dupes": urls.where("seq >= 1000000000 AND seq < 2000000000"), "dropped": claims.where("quality = 0")}
    stages |= {part: p.where(F.col("part") == part) for part in ("confirmed", "killed", "unverified", "out_of_window")}
    return op.funnel({name: run(df) for name, df in stages.items()})


@P.add("vote_errors", f"WITH {_voted} SELECT CAST(seq // 50 % 20 AS BIGINT) AS run, count(*) FILTER (WHERE errored >= 1) AS vote_errors, count(DISTINCT source_url) AS sources FROM p GROUP BY 1")
def vote_errors(spark, sf):
    return voted(spark, sf).groupBy(F.expr("seq div 50 % 20").alias("run")).agg(F.count_if(F.col("errored") >= 1).alias("vote_errors"), F.countDistinct("source_url").alias("sources"))


@P.add("window_misses", f"""WITH {_voted}, m AS (SELECT seq // 100 AS run, seq, CASE WHEN seq % 3 = 0 THEN left(claim, 36) || '…' ELSE board END AS name, claim_date AS date, 0 AS part FROM claims WHERE seq % 7 = 0
    UNION ALL SELECT seq // 100, seq, CASE WHEN length(claim) > 36 THEN left(claim, 36) || '…' ELSE claim END, coalesce(publish_date, claim_date), 1 FROM p WHERE part = 'out_of_window')
    SELECT run, seq, name, date, CAST(part AS INTEGER) AS part FROM (SELECT *, row_number() OVER (PARTITION BY run, name ORDER BY part, seq) AS k FROM m WHERE name <> '') WHERE k = 1""")
def window_misses(spark, sf):
    run = F.expr("seq div 100").alias("run")
    name = F.when(F.col("seq") % 3 == 0, F.concat(F.substring("claim", 1, 36), F.lit("…"))).otherwise(F.col("board"))
    reported = view(spark, sf, "claims").where("seq % 7 = 0").select(run, "seq", name.alias("name"), F.col("claim_date").alias("date"))
    return op.window_misses(reported, voted(spark, sf).where("part = 'out_of_window'").select(run, "seq", "claim", "publish_date", "claim_date"))


@P.add("feed_dedupe", f"SELECT {t.norm_url('url')} AS key, arg_min(label, seq) AS label, list_sort(list_distinct(list(board))) AS boards FROM feeds GROUP BY 1")
def feed_dedupe(spark, sf):
    return op.dedupe_feeds(view(spark, sf, "feeds"))


@P.add("feed_attribution", f"""WITH fd AS (SELECT DISTINCT label AS grp, {t.norm_url('url')} AS key FROM feeds WHERE seq % 2 = 1),
    g AS (SELECT grp, count(*) AS n, min(key) AS only_key FROM fd GROUP BY 1),
    e AS (SELECT d.doc_id AS seq, 'feed ' || (d.doc_id % 20) AS grp, CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE 'http://feeds.example/f' || (d.doc_id % 23) || '?y' END AS feed, CASE WHEN d.doc_id % 7 < 3 THEN 'recent' ELSE 'entry' END AS kind
      FROM documents d),
    a AS (SELECT e.seq, e.grp, e.kind, CASE WHEN e.feed IS NOT NULL THEN {t.norm_url('e.feed')} WHEN g.n = 1 THEN g.only_key END AS key FROM e JOIN g ON g.grp = e.grp)
    SELECT seq, grp, key, kind
      FROM (SELECT a.*, row_number() OVER (PARTITION BY a.grp, a.key, a.kind ORDER BY a.seq) AS k
      FROM a JOIN fd ON fd.grp = a.grp AND fd.key = a.key)
      WHERE k <= CASE kind WHEN 'entry' THEN 15 ELSE 4 END""")
def feed_attribution(spark, sf):
    feeds = view(spark, sf, "feeds").where("seq % 2 = 1").select(F.col("label").alias("grp"), f.norm_url(F.col("url")).alias("key"))
    feed = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("http://feeds.example/f"), (F.col("doc_id") % 23).cast("string"), F.lit("?y")))
    kind = F.when(F.col("doc_id") % 7 < 3, "recent").otherwise("entry")
    entries = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.concat(F.lit("feed "), (F.col("doc_id") % 20).cast("string")).alias("grp"), feed.alias("feed"), kind.alias("kind"))
    return op.attribute_entries(feeds, entries)

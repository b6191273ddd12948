"""Coverage: board states, recovery of failed groups, rosters, near misses, diagnostics.

``by`` names the columns of a run; every table has them, so that all runs go through one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fields as f
from .containment import pairs

RUN = ("run",)


def board_states(membership: DataFrame, returned: DataFrame, recovered: DataFrame | None = None, by=RUN) -> DataFrame:
    """Per run and board (membership: by, board, group_no): degraded, missing, recovered.

    returned: by, group_no, degraded; a failed group has no row, repeated rows count together.
    degraded: any owning group failed or says so itself; missing: all failed and nothing
    recovered (recovered: by, board); recovered: only on that path.
    """
    said = returned.groupBy(*by, "group_no").agg(F.bool_or(F.coalesce("degraded", F.lit(False))).alias("_bad"))
    rows = membership.select(*by, "board", "group_no").distinct().join(said, [*by, "group_no"], "left")
    states = rows.groupBy(*by, "board").agg(F.bool_or(F.col("_bad").isNull()).alias("_failed"), F.bool_and(F.col("_bad").isNull()).alias("_all"), F.bool_or(F.coalesce("_bad", F.lit(False))).alias("_bad"))
    if recovered is None:
        states = states.withColumn("_saved", F.lit(False))
    else:
        states = states.join(recovered.select(*by, "board", F.lit(True).alias("_saved")).distinct(), [*by, "board"], "left").withColumn("_saved", F.coalesce("_saved", F.lit(False)))
    degraded = F.col("_failed") | F.col("_bad")
    return states.select(*by, "board", degraded.alias("degraded"), (F.col("_all") & ~F.col("_saved")).alias("missing"), (F.col("_saved") & degraded).alias("recovered"))


def missing_groups(membership: DataFrame, returned: DataFrame, by=RUN) -> DataFrame:
    """(by, group_no): groups of which a run has no row."""
    return membership.select(*by, "group_no").distinct().join(returned.select(*by, "group_no"), [*by, "group_no"], "left_anti")


def recover(membership: DataFrame, returned: DataFrame, feeds: DataFrame, entries: DataFrame, by=RUN) -> DataFrame:
    """Entries of feeds that can stand in for groups without a result in a run, a row for each board that both serve.

    feeds: by, key, boards (array), group_no (which groups read it), failed; entries: by, key, url, title, window.
    """
    failed = membership.select(*by, "group_no", "board").distinct().join(returned.select(*by, "group_no"), [*by, "group_no"], "left_anti")
    boards = failed.groupBy(*by, "group_no").agg(F.collect_set("board").alias("own"))
    usable = feeds.where(~F.col("failed")).join(boards, [*by, "group_no"]).withColumn("both", F.array_intersect("boards", "own")).where(F.size("both") > 0)
    hits = usable.join(entries.where("window <> 'out'"), [*by, "key"]).select(*by, "group_no", "url", F.coalesce("title", "url").alias("title"), F.explode("both").alias("board"))
    return hits.distinct()


def coverage(boards: DataFrame, sources: DataFrame, claims: DataFrame, by=RUN) -> DataFrame:
    """Claims and distinct source URLs of every board of each run (boards: by, board), zero where there are none."""
    key = [*by, "board"]
    n = claims.groupBy(*key).agg(F.count("*").alias("claims"))
    u = sources.groupBy(*key).agg(F.countDistinct("url").alias("urls"))
    return boards.select(*key).distinct().join(n, key, "left").join(u, key, "left").select(*key, F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("urls", F.lit(0)).alias("urls"))


def alias_hits(aliases: DataFrame, texts: DataFrame, by=RUN) -> DataFrame:
    """(by, name): names of which some alias occurs in some text of the run, case and all.

    aliases: name, alias, the same for all runs; texts: by, text; nulls and empty aliases hit nothing. A text is run
    through once for all aliases, see ``containment``.
    """
    rows = aliases.where("alias <> '' AND name IS NOT NULL").select("name", F.col("alias").alias("needle")).distinct()
    return pairs(texts, "text", rows, "needle", carry=tuple(by)).join(rows, "needle").select(*by, "name").distinct()


def company_states(roster: DataFrame, no_news: DataFrame, states: DataFrame, hits: DataFrame, by=RUN) -> DataFrame:
    """Per run and company (roster: by, name, board): unreached if its board is missing; else has_dynamic, unless it
    was reported without news, which holds as no_dynamic only if no text names it. evidence says why."""
    rows = roster.join(states.select(*by, "board", "missing"), [*by, "board"], "left")
    rows = rows.join(no_news.select(*by, "name", F.lit(True).alias("_quiet")).distinct(), [*by, "name"], "left").join(hits.select(*by, "name", F.lit(True).alias("_hit")), [*by, "name"], "left")
    quiet, hit = F.coalesce("_quiet", F.lit(False)), F.coalesce("_hit", F.lit(False))
    state = F.when(F.coalesce("missing", F.lit(False)), "unreached").when(~quiet | hit, "has_dynamic").otherwise("no_dynamic")
    evidence = F.when(F.coalesce("missing", F.lit(False)), "no_discover").when(quiet & hit, "report_match").otherwise("roster")
    return rows.select(*by, "name", "board", state.alias("state"), evidence.alias("evidence"))


def state_lists(companies: DataFrame, by=RUN) -> DataFrame:
    """(by, state, names): each state's companies, each name once, in order."""
    return companies.groupBy(*by, "state").agg(F.array_sort(F.collect_set("name")).alias("names"))


def collector_diagnostics(failures: DataFrame, by=RUN) -> DataFrame:
    """(by, provider, kind, failures, files): failures of each kind and the distinct files they concern (nulls: none)."""
    return failures.groupBy(*by, "provider", "kind").agg(F.count("*").alias("failures"), F.array_sort(F.collect_set("file")).alias("files"))


def drop_overlaps(misses: DataFrame, claims: DataFrame, run: str = "run") -> DataFrame:
    """Misses (run, name) that no claim of their run contains and that share no distinctive Latin token with one.

    Names meet the claims of their run on their rarest gram, see ``containment``; an empty or null name overlaps nothing.
    """
    named = misses.withColumn("_name", F.trim(F.coalesce("name", F.lit(""))))
    tokens = claims.select(run, F.explode(f.latin_tokens(F.col("claim"))).alias("_token")).distinct()
    shared = named.select(run, "_name", F.explode(f.latin_tokens(F.col("_name"))).alias("_token")).join(tokens, [run, "_token"], "left_semi").select(run, "_name").distinct()
    left = named.join(shared, [run, "_name"], "left_anti")
    texts = claims.select(run, F.trim(F.regexp_replace("claim", "\\s+", " ")).alias("_claim"))
    inside = pairs(texts, "_claim", left.select(run, "_name"), "_name", by=(run,)).withColumnRenamed("needle", "_name")
    return left.join(inside, [run, "_name"], "left_anti").drop("_name")


def degraded_flags(errors, dropped, missing, any_degraded, recovered):
    """The ordered flags of a run; missing and recovered are arrays of boards."""
    flags = F.array(
        F.when(errors > 0, F.concat(F.lit("verify_agent_errors:"), errors.cast("string"))),
        F.when(dropped > 0, F.concat(F.lit("fetch_budget_dropped:"), dropped.cast("string"))),
        F.when(F.size(missing) > 0, F.concat(F.lit("discovery_degraded:missing_"), F.array_join(missing, "+"))).when(any_degraded, "discovery_degraded"),
        F.when(F.size(recovered) > 0, F.concat(F.lit("discovery_recovered:"), F.array_join(recovered, "+"))),
    )
    return F.filter(flags, lambda x: x.isNotNull())


def classify_run(df: DataFrame) -> DataFrame:
    """ok, reason and resynthesize of every logged run, by ordered rules.

    Booleans search_ok, synthesized, synth_failed, zero_citation, degraded_dump, no_credentials,
    timed_out, have_sources; counts source_count, community_count.
    """
    c = F.col
    unfounded = c("zero_citation") & (c("source_count") == 0) & ~c("synthesized") & ~c("degraded_dump")
    reason = (
        F.when(c("synth_failed"), "synthesis_failed")
        .when(c("synthesized"), "synthesized")
        .when(c("no_credentials"), "no_credentials")
        .when(~c("search_ok"), F.when(c("timed_out"), "search_timeout").otherwise("search_failed"))
        .when(c("degraded_dump"), "degraded_dump")
        .when(unfounded, "unfounded")
        .when(c("zero_citation"), "no_citation")
        .otherwise("success")
    )
    community = c("community_count") > 0
    again = (c("search_ok") & c("zero_citation")) | (~c("search_ok") & community) | (c("degraded_dump") & community)
    return df.withColumns({
        "ok": (c("search_ok") | c("synthesized")) & ~c("synth_failed") & ~unfounded,
        "reason": reason,
        "resynthesize": c("have_sources") & ~(c("degraded_dump") & ~community) & again,
    })

"""Source cards: union, dedupe, folding of events, priority merge, recency.

Every function works on all run dates and sites at once; ``by`` names the columns of a run.
Order is data: ``seq`` settles every tie.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import fields as f
from ..functions import scrub as sc
from ..functions.patterns import alternatives_of, literals_of
from ..sources.shared import settled
from .held import pairs


def union_sources(tables: dict[str, DataFrame], enabled: dict[str, bool] | None = None) -> DataFrame:
    """All enabled tables in their order, with the table's place as provider_rank; missing columns are null."""
    chosen = [t.withColumn("provider_rank", F.lit(k)) for k, (name, t) in enumerate(tables.items()) if (enabled or {}).get(name, True)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), chosen)


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; partial aggregation before the shuffle, so a hot key costs a row per task."""
    names = df.columns
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*names), rank).alias("_row"))
    return best.select(*[F.col(f"_row.{c}").alias(c) for c in names])


def dedupe_url(df: DataFrame, by: list[str], key: Column, order: list) -> DataFrame:
    """First card of each URL identity; cards without a URL go."""
    keyed = df.where(F.coalesce(F.trim("url"), F.lit("")) != "").withColumn("_key", key)
    return first_by(keyed, [*by, "_key"], order).drop("_key")


def top_topics(df: DataFrame, k: int, by: list[str], exclude: str | None = rules.OFF_TOPIC) -> DataFrame:
    """On-topic titles; newest ids first, promotions a million behind; k for each run."""
    rows = relevant(df, exclude).withColumn("rank_score", F.col("topic_id") - F.when(f.is_promo(F.col("title")), 1_000_000).otherwise(0))
    place = Window.partitionBy(*by).orderBy(F.desc("rank_score"), "seq")
    return rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)


def relevant(df: DataFrame, exclude: str | None = rules.OFF_TOPIC) -> DataFrame:
    """Cards whose title is on topic and not excluded by the site's own list; a null title is off topic."""
    title = F.col("title")
    return df.where(f.matches_low(title, rules.TOPIC) & (~f.matches_low(title, exclude) if exclude else F.lit(True)))


def relevant_text(df: DataFrame) -> DataFrame:
    """Cards of feeds whose title or URL is on topic; nulls count as empty."""
    return df.where(f.matches_low(F.concat_ws(" ", f.text_of(F.col("title")), f.text_of(F.col("url"))), rules.RELEVANT))


def valid_items(df: DataFrame, day_start: Column, kind: str = "story") -> DataFrame:
    """Title and URL present, the right kind, not before the day's start. Null times, kinds, titles and URLs are invalid."""
    return df.where((F.trim("title") != "") & (F.trim("url") != "") & (F.col("kind") == kind) & (F.col("published_at") >= day_start))


def headlines(df: DataFrame, by: list[str], k: int = 8) -> DataFrame:
    """The first k cards of each run whose scrubbed title isn't empty; place: their number from 1."""
    return first_k(f.computed(df, {"title": sc.scrub(F.col("title"), 200)}).where("title <> ''"), k, by, ["seq"])


def summary_lines(df: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """(by, lines): titles of the k cards with the highest score (null: last; ties: seq) as a Markdown list; null titles are empty."""
    top = first_k(df, k, by, [F.desc_nulls_last("score"), "seq"])
    lines = F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("- "), f.text_of(F.col("title"))).alias("line"))))
    return top.groupBy(*by).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("lines"))


def first_k(df: DataFrame, k: int, by: list[str], order: list) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def match_rules(df: DataFrame, clusters=rules.CLUSTERS) -> DataFrame:
    """Adds cluster: the key of the first rule whose pattern the title matches without its exclusion, else null."""
    title = F.col("title")
    key = F.lit(None).cast("string")
    for name, match, exclude, _ in reversed(clusters):
        hit = f.matches_low(title, match)
        if exclude:
            hit = hit & ~f.matches_low(title, exclude)
        key = F.when(hit, F.lit(name)).otherwise(key)
    return df.withColumn("cluster", key)


#: Rules of a table that need no certain string, and so are tried on every title; more are an error.
LOOSE_RULES = 200
#: What makes a pattern more than a string.
SIGNS = r"[\\^$.|?*+()\[\]{}]"


def match_rule_table(df: DataFrame, table: DataFrame) -> DataFrame:
    """Adds cluster, rule and rewrite, of the rule with the smallest (rule, key) whose pattern the lower-case title
    matches without its exclusion; else nulls.

    table: rule (its priority), key, match, exclude (or null), rewrite (or null); patterns are of lower-case texts. Thousands
    of rules are no chain of conditions: a rule is tried on the titles that have a string which its pattern needs, one
    for each of its alternatives, and only up to the first that is no more than such a string (see ``held``). Of the rules that share
    an alternative and an exclusion the smallest alone is tried there. A null title counts as empty, a null key or pattern is no rule.
    """
    c = F.col
    known = settled(table.where("key IS NOT NULL AND match IS NOT NULL").select("rule", "key", "match", "exclude", "rewrite").withColumn("_needed", literals_of("match")))
    loose = known.where("_needed IS NULL").drop("_needed").orderBy("rule", "key").limit(LOOSE_RULES + 1).collect()
    if len(loose) > LOOSE_RULES:
        raise ValueError(f"more than {LOOSE_RULES} rules have alternatives that need no certain string")
    best = F.min(F.struct("rule", "key", "rewrite")).alias("_best")
    split = known.where("_needed IS NOT NULL").select("rule", "key", "rewrite", "exclude", F.explode(alternatives_of("match")).alias("match"))
    keyed = split.groupBy("match", "exclude").agg(best).select("match", "exclude", "_best", F.explode(literals_of("match")).alias("needle"))
    keyed = keyed.withColumn("_sure", (c("match") == c("needle")) & ~c("match").rlike(SIGNS) & c("exclude").isNull())
    hits = lambda low, match, exclude: F.rlike(low, match) & ~F.coalesce(F.rlike(low, exclude), F.lit(False))
    rows = pairs(df.withColumn("_low", F.lower(f.text_of(c("title")))), "_low", keyed, "needle", "_best", "_sure", lambda low, r: hits(low, r["match"], r["exclude"]))
    if loose:
        first = F.lit(None)
        kinds = table.schema
        for r in reversed(loose):
            this = F.struct(F.lit(r.rule).cast(kinds["rule"].dataType).alias("rule"), F.lit(r.key).alias("key"), F.lit(r.rewrite).cast("string").alias("rewrite"))
            first = F.when(hits(c("_low"), F.lit(r.match), F.lit(r.exclude).cast("string")), this).otherwise(first)
        rows = f.computed(rows, {"_loose": first}).withColumn("_best", F.least("_best", "_loose")).drop("_loose")
    return rows.withColumns({"cluster": c("_best.key"), "rule": c("_best.rule"), "rewrite": c("_best.rewrite")}).drop("_low", "_best")


def fold_events(df: DataFrame, by: list[str], clusters=rules.CLUSTERS) -> DataFrame:
    """One card for each cluster: the most substantial snippet (ties: first), in the first member's place, under the
    cluster's headline. Other cards pass. position orders the result."""
    headline = F.col("title")
    for name, _, _, text in clusters:
        headline = F.when(F.col("cluster") == name, text).otherwise(headline)
    return fold_matched(match_rules(df, clusters).withColumn("_substance", sc.substance(F.col("snippet"))), df.columns, by, headline)


def fold_by_table(df: DataFrame, by: list[str], table: DataFrame, rewrite: Callable[[Column, Column], Column] | None = None, names: list[str] | None = None) -> DataFrame:
    """The same under a table of rules, see ``match_rule_table``. ``rewrite`` makes the headline of the representative's
    title and the rule's text; without it that is the text, or the title where the rule has none. Headlines are scrubbed.
    ``names``: df's columns in the result (title, seq and by among them), all by default. Others, such as the snippet, aren't dealt out."""
    made = rewrite or (lambda title, text: F.coalesce(text, title))
    names = names or df.columns
    scored = df.select(*names, sc.substance(F.col("snippet")).alias("_substance"))
    return fold_matched(match_rule_table(scored, table), names, by, sc.scrub(made(F.col("title"), F.col("rewrite")), 200), ["rewrite"])


def fold_matched(marked: DataFrame, names: list[str], by: list[str], headline: Column, more: list[str] = ()) -> DataFrame:
    """Cards (names, cluster, _substance of the snippet, and columns ``more`` that the headline reads) folded by cluster."""
    plain = marked.where("cluster IS NULL").select(*names, "cluster", F.col("seq").alias("position"))
    best = F.struct(F.col("_substance").isNotNull(), "_substance", -F.col("seq"))
    held = [*names, *more]
    folded = marked.where("cluster IS NOT NULL").groupBy(*by, "cluster").agg(F.max_by(F.struct(*held), best).alias("_row"), F.min("seq").alias("position"))
    folded = folded.select(*[F.col(f"_row.{c}").alias(c) for c in held], "cluster", "position").withColumn("title", headline)
    return plain.unionByName(folded.drop(*more))


def recency_gate(df: DataFrame, day_start: Column) -> DataFrame:
    """Adds kept: published (else created) at or after the day's start less the grace, or without a usable time."""
    stamp = F.when(F.col("published_at").isNotNull(), F.col("published_at")).otherwise(F.col("created_at"))
    usable = stamp > F.timestamp_seconds(F.lit(0))
    start = day_start - F.make_interval(days=F.greatest(F.coalesce("grace_days", F.lit(0)), F.lit(0)))
    return df.withColumn("kept", F.coalesce(~usable | (stamp >= start), F.lit(True)))


def in_local_day(ts: Column, day: Column, hours: int = 8) -> Column:
    """Half open: from midnight of the local day to the next."""
    start = day.cast("timestamp") - F.make_interval(hours=F.lit(hours))
    return (ts >= start) & (ts < start + F.make_interval(days=F.lit(1)))


def merge_sources(df: DataFrame, by: list[str], total: int, primary: int | None = None) -> DataFrame:
    """Cards of three priorities (prio 0, 1, 2; seq within) in one list, each URL once, without cards that are orders only.

    With ``primary``: of priority 0 the first that many take part, and the rest shares ``total``
    places. Without: the first ``total`` of priority 0 take part, and all share ``total`` places.
    """
    cap = total if primary is None else primary
    place = F.row_number().over(Window.partitionBy(*by).orderBy("seq"))
    first = df.where("prio = 0").withColumn("_at", place).where(F.col("_at") <= cap).drop("_at")  # cut before the sort's end
    rows = first.unionByName(df.where("prio > 0"))
    rows = f.computed(rows.where(F.coalesce(F.trim("url"), F.lit("")) != ""), {"title": sc.scrub(F.col("title"), 200), "snippet": sc.scrub(F.col("snippet"))})
    rows = rows.where((F.col("title") != "") | (F.col("snippet") != ""))
    once = dedupe_url(rows, by, f.url_key(F.col("url")), ["prio", "seq"])
    pool = F.lit(0) if primary is None else (F.col("prio") > 0).cast("int")
    at = F.row_number().over(Window.partitionBy(*by, "_pool").orderBy("prio", "seq"))
    kept = once.withColumn("_pool", pool).withColumn("_at", at).where(F.col("_at") <= max(total, primary or 0))
    if primary is not None:
        kept = kept.where(F.col("_at") <= F.when(F.col("_pool") == 0, primary).otherwise(total))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("prio", "seq"))).drop("_pool", "_at")


def material_window(df: DataFrame, by: list[str], low: int = 8) -> DataFrame:
    """Per run: hard sources, others kept, dropped, and whether hard material is scarce. Needs columns hard and kept."""
    counts = df.groupBy(*by).agg(F.count_if("hard").alias("hard_sources"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))
    return counts.withColumn("other_sources", F.greatest(F.lit(0), F.col("kept") - F.col("hard_sources"))).withColumn("low_material", F.col("hard_sources") < low)


def combine_cards(primary: DataFrame, listing: DataFrame, by: list[str]) -> DataFrame:
    """Dated cards, newest first, then listing cards in their order; each URL once."""
    both = primary.withColumn("part", F.lit(0)).unionByName(listing.withColumn("part", F.lit(1)), allowMissingColumns=True)
    newest = F.when(F.col("part") == 0, -F.unix_micros("created_at")).otherwise(F.lit(0))
    once = dedupe_url(both.withColumn("_age", newest), by, f.url_key(F.col("url")), ["part", "_age", "seq"])
    place = Window.partitionBy(*by).orderBy("part", "_age", "seq")
    return once.withColumn("place", F.row_number().over(place)).drop("_age")


def merge_ranked(lists: list[DataFrame], key: str, limit: int) -> DataFrame:
    """Ranked lists behind each other, each key at its first rank, the first ``limit``."""
    tagged = reduce(DataFrame.unionByName, [t.select(key, "rank", F.lit(k).alias("list_no")) for k, t in enumerate(lists)])
    once = tagged.groupBy(key).agg(F.min(F.struct("list_no", "rank")).alias("at"))
    return once.select(key, "at.list_no", "at.rank").orderBy("list_no", "rank", key).limit(limit)

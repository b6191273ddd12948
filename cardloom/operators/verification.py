"""Claims and votes: tallies, quotas, known events, budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import fields as f
from .cards import first_by


def tally(votes: DataFrame, needed: int = 2) -> DataFrame:
    """Per claim: valid, refuted and errored votes, and the verdict. Columns claim_id, refuted, errored."""
    counts = votes.groupBy("claim_id").agg(
        F.count_if(~F.col("errored")).alias("valid"), F.count_if(~F.col("errored") & F.col("refuted")).alias("refuted"), F.count_if("errored").alias("errored"))
    return counts.withColumns({"survives": (F.col("valid") >= needed) & (F.col("refuted") < needed), "is_refuted": F.col("refuted") >= needed})


def adaptive_votes(votes: DataFrame, needed: int = 2) -> DataFrame:
    """The first two votes, and the third only if neither outcome has two valid votes by then."""
    early = (F.col("vote_no") <= 2) & ~F.col("errored")
    sums = votes.where("vote_no <= 3").groupBy("claim_id").agg(F.count_if(early & F.col("refuted")).alias("_no"), F.count_if(early & ~F.col("refuted")).alias("_yes"))
    open_ = (F.col("_no") < needed) & (F.col("_yes") < needed)
    return votes.where("vote_no <= 3").join(sums, "claim_id").where((F.col("vote_no") <= 2) | open_).drop("_no", "_yes")


def partition_of(window: Column) -> Column:
    """The one set of a voted claim: confirmed, out_of_window, killed or unverified."""
    return F.when(F.col("survives"), F.when(window == "out", "out_of_window").otherwise("confirmed")).when(F.col("is_refuted"), "killed").otherwise("unverified")


def claim_window(publish: Column, date: Column, low: int | None, high: int) -> Column:
    """in if all dates that can be read lie within, out if one doesn't, unknown without any."""
    days = F.filter(F.array(f.normalize_date(publish), f.normalize_date(date)), lambda d: d.isNotNull())
    inside = F.forall(days, lambda d: (d >= (low or 0)) & (d <= high))
    return F.when(F.size(days) == 0, "unknown").when(inside, "in").otherwise("out")


def age_gate(df: DataFrame, date: Column, report_day: int | None, most: int = 21) -> DataFrame:
    if report_day is None:
        return df
    return df.where(F.coalesce(f.days_between(f.normalize_date(date), F.lit(report_day)) <= most, F.lit(False)))


def order_claims(df: DataFrame, by: list[str]) -> DataFrame:
    """place: by importance, then source quality, then arrival."""
    order = [f.rank_in(F.col("importance"), rules.IMPORTANCE), f.rank_in(F.col("source_quality"), rules.QUALITY), F.col("seq")]
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def quotas(sizes: DataFrame, budget: int) -> DataFrame:
    """Verification places of each board: columns run, board, seq (order of the boards), n (claims).

    Floor of the proportional share, but one for a board that would get none while places are
    left; then the rest to the boards with most claims left, greedily. Boards are dozens a run;
    the fold is one native expression over a run's ordered array.
    """
    step = "struct(x.board as board, x.seq as seq, x.n as n, q as q)"
    runs = sizes.where("n > 0").groupBy("run").agg(F.array_sort(F.collect_list(F.struct("seq", "board", "n"))).alias("boards"), F.sum("n").alias("total"))
    first = f"""aggregate(boards, struct(cast(array() as array<struct<board:string,seq:bigint,n:bigint,q:bigint>>) as done, 0L as used),
        (a, x) -> transform(array(least(if({budget} * x.n div total = 0 and a.used < {budget}, 1L, {budget} * x.n div total), x.n)),
            q -> struct(array_append(a.done, {step}) as done, a.used + q as used))[0])"""
    rest = f"""aggregate(array_sort(transform(a.done, x -> struct(-(x.n - x.q) as k, x.seq as seq, x.board as board, x.n as n, x.q as q))),
        struct(cast(array() as array<struct<board:string,quota:bigint>>) as done, {budget}L - a.used as room),
        (s, x) -> transform(array(greatest(0L, least(x.n - x.q, s.room))), t -> struct(array_append(s.done, struct(x.board as board, x.q + t as quota)) as done, s.room - t as room))[0]).done"""
    return runs.withColumn("a", F.expr(first)).select("run", F.explode(F.expr(rest)).alias("q")).select("run", "q.board", "q.quota")


def within_quota(claims: DataFrame, budget: int) -> DataFrame:
    """The claims (run, board, importance, source_quality, seq) that get a place, best first."""
    sizes = claims.groupBy("run", "board").agg(F.min("seq").alias("seq"), F.count("*").alias("n"))
    return order_claims(claims, ["run", "board"]).join(quotas(sizes, budget), ["run", "board"]).where(F.col("place") <= F.col("quota"))


def round_robin(cands: DataFrame, budget: int) -> DataFrame:
    """Places (run, board, seq, slot): in each round every board, in order, takes its first URL not taken yet.

    Columns run, board, board_no, seq, url. A cross-board duplicate changes what a board takes
    next, so a run is a sequential fold. Only what can matter reaches it: of a board each URL
    once, and of these no more than ``budget`` (earlier ones are always taken or gone first),
    so a group has at most boards x budget rows.
    """
    once = first_by(cands.withColumn("_key", f.norm_url(F.col("url"))), ["run", "board", "_key"], ["seq"])
    near = once.withColumn("_n", F.row_number().over(Window.partitionBy("run", "board").orderBy("seq"))).where(F.col("_n") <= budget)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        lists = {k: g.sort_values("seq") for k, g in rows.groupby(["board_no", "board"], sort=True)}
        queues = {k: iter(g[["seq", "_key"]].itertuples(index=False)) for k, g in lists.items()}
        taken, out = set(), []
        while queues and len(out) < budget:
            for k in list(queues):
                if len(out) >= budget:
                    break
                for seq, key in queues[k]:
                    if key not in taken:
                        taken.add(key)
                        out.append((rows["run"].iloc[0], k[1], seq, len(out) + 1))
                        break
                else:
                    del queues[k]
        return pd.DataFrame(out, columns=["run", "board", "seq", "slot"])

    run = near.schema["run"].dataType.simpleString()
    kind = near.schema["seq"].dataType.simpleString()
    return near.select("run", "board", "board_no", "seq", "_key").groupBy("run").applyInPandas(fold, f"run {run}, board string, seq {kind}, slot int")


def dropped_by_budget(cands: DataFrame, granted: DataFrame) -> DataFrame:
    """Candidates whose URL no grant of their run covers."""
    key = f.norm_url(F.col("url"))
    won = cands.join(granted.select("run", "seq"), ["run", "seq"], "left_semi").select("run", key.alias("_key")).distinct()
    return cands.withColumn("_key", key).join(won, ["run", "_key"], "left_anti").drop("_key")


def duplicate_urls(cands: DataFrame) -> DataFrame:
    """The first candidate of every URL identity that a run has more than once, and how often."""
    keyed = cands.withColumn("_key", f.norm_url(F.col("url")))
    first = F.min_by(F.struct("board", "url", "seq"), F.struct("board_no", "seq"))
    return keyed.groupBy("run", F.col("_key").alias("key")).agg(F.count("*").alias("copies"), first.alias("row")).where("copies > 1").select("run", "key", "copies", "row.board", "row.seq")


def within_budget(files: DataFrame, by: str, most: int, most_bytes: int) -> DataFrame:
    """Files in order while fewer than ``most`` are taken and those before sum to less than ``most_bytes``;
    a single larger file is refused. A group's running sum needs its rows in one task: groups are posts."""
    small = files.where(F.col("bytes") <= most_bytes)
    order = Window.partitionBy(by).orderBy("seq")
    before = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return small.withColumns({"before": before, "place": F.row_number().over(order)}).where((F.col("before") < most_bytes) & (F.col("place") <= most))


def known_union(confirmed: DataFrame, known: DataFrame) -> DataFrame:
    """(seq, board, claim, source_url, vote, injected): confirmed claims with their votes, and known events
    (seq, board, claim, source_url), which no vote has checked."""
    columns = ["seq", "board", "claim", "source_url", "vote", "injected"]
    checked = confirmed.withColumns({"vote": f.vote_label(F.col("valid") - F.col("refuted"), F.col("refuted"), F.lit(False)), "injected": F.lit(False)})
    return checked.select(columns).unionByName(known.withColumns({"vote": F.lit("—"), "injected": F.lit(True)}).select(columns))


def merge_events(rows: DataFrame, run: str = "run") -> DataFrame:
    """Known events of each run, each event once: (run, position, name, note, claim, quote, date, url, board).

    rows: run, seq, name, note, date, url, board. An event's claim is its name and note, joined by a wide
    colon. In order of seq, a row is of the first event whose claim, or the part of it before the first
    wide colon, has the fingerprint of the row's name; then, if the row names a day and the event doesn't, its name,
    note and date replace the event's. Else it is an event of its own. position: the event's first seq; url and
    board stay those of the first row. Null names and notes are empty.

    The fold needs a run's order, and a run's known events are few by nature. Of rows with the same
    three fingerprints, that of the name being that of the claim or its first part, the first and the first dated
    one reach it: the others are of the same event and change nothing.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    claim = F.concat(text("name"), F.lit("："), text("note"))
    keyed = rows.withColumns({"_claim": claim, "_key": f.event_key(text("name")), "_whole": f.event_key(claim), "_first": f.event_key(F.split(claim, "：")[0]), "_day": f.has_full_day(F.col("date"))})
    kept = F.struct("seq", text("name").alias("name"), text("note").alias("note"), F.col("_claim").alias("claim"), "date", "url", "board", F.col("_day").alias("day"), F.col("_key").alias("key"), F.col("_whole").alias("whole"), F.col("_first").alias("first"))
    alone = F.when((F.col("_key") != F.col("_whole")) & (F.col("_key") != F.col("_first")), F.col("seq"))
    pairs = keyed.withColumn("_alone", alone).groupBy(run, "_key", "_whole", "_first", "_alone").agg(F.min_by(kept, "seq").alias("a"), F.min_by(kept, F.when(F.col("_day"), F.col("seq"))).alias("b"))
    own = pairs.groupBy(run).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.array("a", "b"), lambda x: x.isNotNull()))))).alias("rows"))
    kind = own.schema["rows"].dataType.elementType.simpleString()
    seq = rows.schema["seq"].dataType.simpleString()
    event = f"struct<position:{seq},x:{kind}>"
    fold = f"""aggregate(rows, cast(array() as array<{event}>), (events, r) -> transform(
        array(array_position(transform(events, e -> e.x.whole = r.key OR e.x.first = r.key), true)),
        at -> CASE WHEN at = 0 THEN array_append(events, named_struct('position', r.seq, 'x', r))
                   WHEN r.day AND NOT events[int(at) - 1].x.day THEN transform(events, (e, i) -> IF(i = at - 1,
                     named_struct('position', e.position, 'x', named_struct('seq', r.seq, 'name', r.name, 'note', r.note, 'claim', r.claim, 'date', r.date, 'url', e.x.url, 'board', e.x.board, 'day', r.day, 'key', r.key, 'whole', r.whole, 'first', r.first)), e))
                   ELSE events END)[0])"""
    events = own.select(run, F.explode(F.expr(fold)).alias("e"))
    return events.select(run, "e.position", "e.x.name", "e.x.note", "e.x.claim", F.col("e.x.note").alias("quote"), "e.x.date", "e.x.url", "e.x.board")


def source_statistics(voted: DataFrame) -> DataFrame:
    """(source_url, claims, confirmed) over voted claims with their part."""
    return voted.groupBy("source_url").agg(F.count("*").alias("claims"), F.count_if(F.col("part") == "confirmed").alias("confirmed"))


def batch_numbers(claims: DataFrame, by: list[str], size: int = 6) -> DataFrame:
    """Adds batch: claims of each run in order of seq, ``size`` to a batch, from 1."""
    return claims.withColumn("batch", F.ceil(F.row_number().over(Window.partitionBy(*by).orderBy("seq")) / size).cast("int"))


FUNNEL = ("discovered", "fetched", "extracted", "verified", "confirmed", "major_out", "killed", "unverified", "out_of_window", "dupes", "dropped")


def funnel(stages: dict[str, DataFrame], by: str = "run") -> DataFrame:
    """A row for each run, and how many rows each stage has of it: all of FUNNEL, 0 where a stage is absent or empty.

    One pass over all stages: each is counted before the shuffle.
    """
    unknown = set(stages) - set(FUNNEL)
    if unknown or not stages:
        raise ValueError(f"no such stages: {sorted(unknown)}" if unknown else "no stages")
    counts = [t.groupBy(by).agg(F.count("*").alias("n")).withColumn("stage", F.lit(name)) for name, t in stages.items()]
    whole = counts[0]
    for part in counts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(by).agg(*[F.coalesce(F.sum(F.when(F.col("stage") == name, F.col("n"))), F.lit(0)).alias(name) for name in FUNNEL])


def window_misses(reported: DataFrame, gated: DataFrame, run: str = "run") -> DataFrame:
    """(run, seq, name, date, part): near misses, each name of a run once: first those that the finders reported (run, seq,
    name, date), then claims that survived but lie outside the window (run, seq, claim, publish_date, claim_date),
    by their first 36 characters. Misses without a name don't count. part: 0 reported, 1 gated."""
    short = F.when(F.length("claim") > 36, F.concat(F.substring("claim", 1, 36), F.lit("…"))).otherwise(F.col("claim"))
    late = gated.select(run, "seq", short.alias("name"), F.coalesce("publish_date", "claim_date").alias("date"), F.lit(1).alias("part"))
    both = reported.select(run, "seq", "name", "date", F.lit(0).alias("part")).unionByName(late).where("name <> ''")
    return first_by(both, [run, "name"], ["part", "seq"])


def dedupe_feeds(feeds: DataFrame) -> DataFrame:
    """(key, label, boards): each feed (url, label, board, seq) once, with its first label and every board that subscribes to it."""
    return feeds.groupBy(f.norm_url(F.col("url")).alias("key")).agg(F.min_by("label", "seq").alias("label"), F.array_sort(F.collect_set("board")).alias("boards"))


def attribute_entries(feeds: DataFrame, entries: DataFrame, most: dict[str, int] | None = None) -> DataFrame:
    """(seq, grp, key, kind): entries (seq, grp, feed, kind) by their feed's URL; without one, by the group's only feed.

    feeds: grp, key. Of each feed the first ``most`` of each kind (15 entries, 4 recents); of
    groups without such a feed none.
    """
    most = most or {"entry": 15, "recent": 4}
    feeds = feeds.select("grp", "key").distinct()
    groups = feeds.groupBy("grp").agg(F.count("*").alias("_n"), F.min("key").alias("_only"))
    key = F.when(F.col("feed").isNotNull(), f.norm_url(F.col("feed"))).when(F.col("_n") == 1, F.col("_only"))
    found = entries.join(groups, "grp").withColumn("key", key).join(feeds, ["grp", "key"], "left_semi")
    place = F.row_number().over(Window.partitionBy("grp", "key", "kind").orderBy("seq"))
    cap = F.lit(0)
    for kind, n in most.items():
        cap = F.when(F.col("kind") == kind, n).otherwise(cap)
    return found.withColumn("_at", place).where(F.col("_at") <= max(most.values())).where(F.col("_at") <= cap).select("seq", "grp", "key", "kind")

"""Whole chains over raw texts: from the listings of a site, or the texts of feeds, to cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import fields as f
from ..functions import scrub as sc
from ..sources import parsing as sp
from . import cards as oc
from . import texts as ot
from .coverage import collector_diagnostics


def site_cards(listings: DataFrame, bodies: DataFrame, profile: sp.SiteProfile, excerpt, by: list[str], exclude: str | None = rules.OFF_TOPIC, topics: int = 8, deep: int = 5) -> DataFrame:
    """(by, url, title, snippet, score, place): cards of a site from its listings and the pages fetched for its topics.

    listings: by, listing_no, text (null: failed); bodies: url, text, seq. Links of all listings of a
    run, each URL where it comes first, on topic, best first, ``topics`` of them; the first
    ``deep`` take ``excerpt(text, title)`` of their page, all others and those without one a line with the title; titles and
    snippets are scrubbed, and cards of nothing but orders go. A run without links has no rows.
    """
    top = _listed(listings, profile, by, exclude, topics)
    return _with_pages(top.select(*by, "url", "title", F.col("rank_score").alias("score"), "place", F.lit("").alias("snippet")), bodies, excerpt, by, deep)


def _listed(listings: DataFrame, profile: sp.SiteProfile, by: list[str], exclude: str | None, topics: int) -> DataFrame:
    """The best topics of a run's listings, each URL where it comes first."""
    found = sp.extract_links(listings.where("text IS NOT NULL"), [*by, "listing_no"], "text", profile)
    once = oc.first_by(found, [*by, "url"], ["listing_no", "pos"]).withColumn("seq", F.col("topic_id"))
    return oc.top_topics(once, topics, by, exclude)


def _with_pages(rows: DataFrame, bodies: DataFrame, excerpt, by: list[str], deep: int) -> DataFrame:
    """Cards of rows (by, url, title, snippet, score, place): the first ``deep`` of a run with what ``excerpt`` takes from their page."""
    own = bodies.where("text IS NOT NULL").groupBy("url").agg(F.min_by("text", "seq").alias("_text"))
    page = F.when(F.col("place") <= deep, excerpt(F.col("_text"), F.col("title")))
    raw = F.coalesce(F.nullif(page, F.lit("")), F.nullif("snippet", F.lit("")), F.concat(F.lit("Topic: "), F.col("title")))
    cards = f.computed(f.computed(rows.join(own, "url", "left"), {"snippet": raw}), {"title": sc.scrub(F.col("title"), 200), "snippet": sc.scrub(F.col("snippet"))})
    return cards.select(*by, "url", "title", "snippet", "score", "place").where("title <> '' OR snippet <> ''")


def forum_cards(pages: DataFrame, listings: DataFrame, bodies: DataFrame, profile: sp.SiteProfile, excerpt, by: list[str], day: Column, exclude: str | None = rules.OFF_TOPIC, topics: int = 8, deep: int = 12) -> DataFrame:
    """(by, url, title, snippet, score, place): a site's cards where pages of a JSON list of topics come first.

    pages: by, page_no, text. All of its topics that were made on the local day ``day`` (a date, of the columns ``by``),
    whatever they are about, newest first, then the best topics of the listings as in ``site_cards``; each URL once, in the
    place where it comes first. A JSON topic's snippet is its scrubbed excerpt. The first ``deep`` of all take what ``excerpt``
    gives of their page; without a snippet a line with the title stands. Malformed pages and times give no topics.
    """
    keyed = pages.select(F.struct(*by, "page_no").alias("_k"), "text")
    found = sp.parse_topic_json(keyed, "_k", "text").select("_k.*", "pos", "id", F.coalesce("title", F.lit("")).alias("title"), F.try_to_timestamp("created_at").alias("created_at"), "excerpt")
    dated = f.computed(found.where(oc.in_local_day(F.col("created_at"), day)), {"snippet": sc.scrub(F.col("excerpt"), 500)})
    url = F.replace(F.lit(profile.url), F.lit("{id}"), F.col("id").cast("string"))
    first = dated.select(*by, url.alias("url"), "title", "snippet", F.col("id").alias("score"), "created_at", (F.col("page_no").cast("long") * (1 << 32) + F.col("pos")).alias("seq"))
    top = _listed(listings, profile, by, exclude, topics)
    later = top.select(*by, "url", "title", F.lit("").alias("snippet"), F.col("rank_score").alias("score"), F.lit(None).cast("timestamp").alias("created_at"), F.col("place").cast("long").alias("seq"))
    rows = oc.combine_cards(first, later, by).select(*by, "url", "title", "snippet", "score", "place")
    return _with_pages(rows, bodies, excerpt, by, deep)


def site_diagnostics(listings: DataFrame, topics: DataFrame, bodies: DataFrame, by: list[str]) -> DataFrame:
    """(by, provider, kind, failures, files): listings without a text, and topics (by, provider, url) without a page.

    listings: by, provider, listing_no, text; bodies: url, text.
    """
    lists = listings.where("text IS NULL").select(*by, "provider", F.lit("listing").alias("kind"), F.col("listing_no").cast("string").alias("file"))
    pages = topics.join(bodies.where("text IS NOT NULL").select("url").distinct(), "url", "left_anti").select(*by, "provider", F.lit("topic").alias("kind"), F.col("url").alias("file"))
    return collector_diagnostics(lists.unionByName(pages), by)


def feed_label(url: Column) -> Column:
    """The label of a vendor's feed by its URL; a null URL has the last label."""
    out = F.lit(rules.FEED_LABELS[-1][1])
    for word, label in reversed(rules.FEED_LABELS[:-1]):
        out = F.when(F.contains(f.text_of(url), F.lit(word)), label).otherwise(out)
    return out


def feed_cards(texts: DataFrame, day_start: Column, now: Column, k: int = 5) -> DataFrame:
    """(feed, pos, url, title, snippet, provider, published_at, grace_days): the first k cards of each feed (feed, feed_url, kind, text).

    kind ``link``: rows of Markdown links first, undated and so of ``now``; only a text without any is read as RSS. kind
    ``rss``: items, undated ones of ``now``. kind ``atom``: papers, all on topic, undated ones go. Of each text the first
    characters are read, as many as its kind has. Items from before the day's start less their kind's days of grace and, but
    for papers, off topic go. provider: the kind's label, or that of the feed's own URL.
    """
    part = lambda kind: texts.where(F.col("kind") == kind).withColumn("text", F.substring("text", 1, rules.FEED_KINDS[kind][0]))
    first = part("link")
    title = F.substring("title", 1, 500)
    links = sp.heading_links(first, "feed", "text").withColumns({"published_at": F.lit(None).cast("timestamp"), "snippet": title})
    bare = first.join(links.select("feed").distinct(), "feed", "left_anti")
    most = max(m for m, _, _ in rules.FEED_KINDS.values())
    items = sp.parse_rss(bare.select("feed", "text").unionByName(part("rss").select("feed", "text")), "feed", "text", most).withColumn("snippet", title)
    news = links.unionByName(items).withColumn("published_at", F.coalesce("published_at", now))
    papers = sp.parse_atom(part("atom"), "feed", "text").where("published_at IS NOT NULL")
    columns = ["feed", "pos", "url", "title", "snippet", "published_at"]
    rows = oc.relevant_text(news).select(columns).unionByName(papers.select(columns))
    kind, grace, label = F.col("kind"), F.lit(0), F.lit(None).cast("string")
    for name, (_, days, own) in rules.FEED_KINDS.items():
        grace = F.when(kind == name, days).otherwise(grace)
        label = F.when(kind == name, F.lit(own)).otherwise(label)
    feeds = texts.select("feed", grace.alias("grace_days"), F.coalesce(label, feed_label(F.col("feed_url"))).alias("provider")).distinct()
    kept = rows.join(feeds, "feed").where(F.col("published_at") >= day_start - F.make_interval(days=F.col("grace_days")))
    return oc.first_k(kept, k, ["feed"], ["pos"]).drop("place")

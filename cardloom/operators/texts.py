"""Paragraphs, briefs, threads and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import scrub as sc
from ..functions.fields import bound, computed, norm_url, text_of, trimmed


def brief(text: Column, most: int = 100) -> Column:
    """One line: the first true sentence, capped, Markdown signs escaped. A point counts only before white space and a
    capital, digit, quote or bracket, or at the end."""
    t = F.trim(F.regexp_replace(text_of(text), "\\s+", " "))
    head = F.regexp_extract(t, "^(.*?[.!?。！？])(?=\\s+[A-Z0-9\"'(（【]|$)", 1)
    first = F.trim(F.when(head != "", head).otherwise(t))
    capped = F.when(F.length(first) > most, F.concat(F.substring(first, 1, most - 1), F.lit("…"))).otherwise(first)
    return F.regexp_replace(capped, "([\\\\`*_\\[\\]])", "\\\\$1")


def one_sentence(text: Column) -> Column:
    """Up to the first terminator of any kind."""
    t = F.trim(F.regexp_replace(text_of(text), "\\s+", " "))
    head = F.regexp_extract(t, "^(.*?[.!?。！？])", 1)
    return F.when(head != "", head).otherwise(t)


def substantive_or(excerpt: Column, placeholder: Column) -> Column:
    """The excerpt if it has 40 characters and real words, else the placeholder."""
    e = F.trim(text_of(excerpt))
    return F.when((F.length(e) >= 40) & e.rlike("[一-鿿]{6,}|[A-Za-z]{12,}"), e).otherwise(placeholder)


def paragraphs(text: Column, cuts: list[tuple[str, str]]) -> Column:
    """The lines of a text after the cuts, each squeezed."""
    body = text_of(text)
    for pattern, to in cuts:
        body = F.regexp_replace(body, pattern, to)
    return F.transform(F.split(body, "\n+"), lambda p: trimmed(F.regexp_replace(p, "\\s+", " ")))


def best_paragraph(text: Column, title: Column, most: int = 500) -> Column:
    """The scrubbed longest paragraph of a topic page with real words that scrubbing leaves something of, else the
    longest such of 24 characters. Images, links, tables, banners and lines of page furniture are no
    paragraphs, nor are headings and what repeats the title. Ties: the first; none: empty."""
    squeeze = lambda s: F.regexp_replace(s, "\\s+", "")
    name = squeeze(text_of(title))
    chrome = lambda p: p.rlike("^#") | p.rlike(rules.FORUM_LINES) | p.rlike(rules.FORUM_OPENINGS) | p.rlike(rules.FORUM_BANNERS)
    fit = F.filter(paragraphs(text, rules.FORUM_CUTS), lambda p: (F.length(p) >= 24) & ~chrome(p) & p.rlike("[一-鿿A-Za-z0-9]") & ((name == "") | ~F.contains(squeeze(p), name)))
    weak = lambda p: ~((F.length(p) >= 40) & p.rlike("[一-鿿]{6,}|[A-Za-z]{12,}"))
    ranked = F.array_sort(F.transform(fit, lambda p, i: F.struct(weak(p).alias("weak"), (-F.length(p)).alias("n"), i.alias("i"), p.alias("p"))))
    clean = lambda r: sc.scrub(r["p"], most, inside=True)
    # the others only where scrubbing leaves nothing of the first
    later = lambda r: F.get(F.filter(F.transform(F.slice(r, 2, 1 << 30), clean), lambda p: p != ""), 0)
    return bound(ranked, lambda r: bound(F.coalesce(clean(F.get(r, 0)), F.lit("")), lambda first: F.when(first != "", first).otherwise(F.coalesce(later(r), F.lit("")))))


def raw_paragraph(text: Column) -> Column:
    """The first paragraph of a board page with 20 characters and 4 Han or 8 Latin ones in a row, else the first of 12,
    else null. Images, links, mentions, headings and lines of page furniture are no paragraphs."""
    lines = F.filter(paragraphs(text, rules.BOARD_CUTS), lambda p: (F.length(p) >= 12) & ~p.rlike("^#") & ~p.rlike(rules.BOARD_LINES))
    good = lambda p: (F.length(p) >= 20) & p.rlike("[一-鿿]{4,}|[A-Za-z]{8,}")
    return bound(lines, lambda own: F.coalesce(F.get(F.filter(own, good), 0), F.get(own, 0)))


def first_paragraph(text: Column, most: int = 500) -> Column:
    """The scrubbed ``raw_paragraph``, else empty. It is found anew wherever scrubbing names it; over whole tables
    ``first_paragraphs`` finds it once."""
    return sc.scrub(raw_paragraph(text), most)


def first_paragraphs(df: DataFrame, text: Column, name: str = "paragraph", most: int = 500) -> DataFrame:
    """df with the scrubbed ``raw_paragraph`` of a text, else empty, as a column."""
    return computed(df, {name: raw_paragraph(text)}).withColumn(name, sc.scrub(F.col(name), most))


def last_cell(text: Column) -> Column:
    """The last filled cell of the first table row (two cells or more) where it has 20 characters and 4 Han ones."""
    def cell(line: Column) -> Column:
        cells = F.filter(F.transform(F.split(line, "[|]"), lambda c: F.trim(c)), lambda c: c != "")
        return F.when(F.size(cells) >= 2, F.element_at(cells, -1))

    cells = F.transform(F.split(text_of(text), "\n"), cell)
    return F.coalesce(F.get(F.filter(cells, lambda c: (F.length(c) >= 20) & (F.regexp_count(c, F.lit("[一-鿿]")) >= 4)), 0), F.lit(""))


def assemble_threads(posts: DataFrame, topic: str = "topic_id") -> DataFrame:
    """Each thread's posts in order, in one text. A thread is one row of output by nature."""
    own = F.array_sort(F.collect_list(F.struct("post_number", F.coalesce("cooked", F.lit("")).alias("cooked"))))
    return posts.groupBy(topic).agg(F.count("*").alias("posts"), F.array_join(F.transform(own, lambda x: x["cooked"]), "\n").alias("text"))


def missing_posts(stream: DataFrame, posts: DataFrame) -> DataFrame:
    """Stream entries (topic_id, post_id) of which no post has come."""
    return stream.join(posts.select("topic_id", "post_id"), ["topic_id", "post_id"], "left_anti")


def rewrite_links(links: DataFrame, assets: DataFrame, identity) -> DataFrame:
    """links (url), assets (url, local): the asset's local name by URL, else by identity (smallest name), else unchanged."""
    exact = assets.groupBy(F.col("url").alias("_u")).agg(F.min("local").alias("_exact"))
    alike = assets.groupBy(identity(F.col("url")).alias("_i")).agg(F.min("local").alias("_alike"))
    rows = links.withColumn("_id", identity(F.col("url"))).join(exact, F.col("url") == F.col("_u"), "left").join(alike, F.col("_id") == F.col("_i"), "left")
    return rows.withColumn("target", F.coalesce("_exact", "_alike", "url")).drop("_u", "_i", "_id", "_exact", "_alike")


def enrich(cards: DataFrame, bodies: DataFrame) -> DataFrame:
    """Cards with the text fetched for their URL: the body, else the snippet, else a placeholder from the title."""
    own = bodies.groupBy(norm_url(F.col("url")).alias("_key")).agg(F.min_by("body", "seq").alias("body"))
    rows = cards.withColumn("_k", norm_url(F.col("url"))).join(own, F.col("_k") == F.col("_key"), "left")
    filled = F.coalesce(F.nullif(F.trim("body"), F.lit("")), F.nullif(F.trim("snippet"), F.lit("")), F.concat(F.lit("Topic: "), text_of(F.col("title"))))
    return rows.withColumn("deep_text", filled).drop("_k", "_key", "body")


def attach_threads(cards: DataFrame, threads: DataFrame) -> DataFrame:
    """Cards with the archived thread of their URL, else of their id."""
    by_url = threads.where("url IS NOT NULL").groupBy(F.col("url").alias("_u")).agg(F.min("post_file").alias("_a"))
    by_id = threads.groupBy(F.col("topic_id").alias("_t")).agg(F.min("post_file").alias("_b"))
    rows = cards.join(by_url, F.col("url") == F.col("_u"), "left").join(by_id, F.col("topic_id") == F.col("_t"), "left")
    return rows.withColumn("post_file", F.coalesce("_a", "_b")).drop("_u", "_a", "_t", "_b")

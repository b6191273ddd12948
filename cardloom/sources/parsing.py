"""Cards and rows from raw texts: a table of texts in, one row for each item found.

All parsing is native: extract all, explode, take apart with regular expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import fields as f
from ..operators.cards import first_by


@dataclass(frozen=True)
class SiteProfile:
    """How a site's listings write links: a pattern with groups for title and id, and the form of its URLs."""

    pattern: str
    url: str  # with {id}
    title_group: int = 1
    id_group: int = 2


# Four ways in which listings write a link to a topic. Titles of posts and threads are anything on their
# line, brackets and other links too; those of the other two end at a bracket.
PROFILES = {
    "topic": SiteProfile(r"\[([^\]]{2,200})\]\(https://forum[.]example/t/topic/([0-9]+)(?:/[0-9]+)?\)", "https://forum.example/t/topic/{id}"),
    "post": SiteProfile(r"\[([^\n]{2,300})\]\(/post-([0-9]+)-[0-9]+\)", "https://board.example/post-{id}-1"),
    "thread": SiteProfile(r"\[([^\n]{2,300})\]\(/t/([0-9]+)(?:#\w+)?\)", "https://talk.example/t/{id}"),
    "heading": SiteProfile(r"### \[([^\]]{2,200})\]\(https://news[.]example/i/([0-9]+)\)", "https://news.example/i/{id}"),
}


def exploded(df: DataFrame, text: Column, pattern: str, group: int = 0) -> DataFrame:
    """A row for each match, with its number pos."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return df.select("*", F.posexplode(found).alias("pos", "item"))


def extract_links(df: DataFrame, key: str | list[str], text: str, profile: SiteProfile) -> DataFrame:
    """(key, topic_id, url, title, pos): links of a listing, the first of each topic; links without a title or number are none."""
    key = [key] if isinstance(key, str) else key
    rows = exploded(df.select(*key, text), f.text_of(F.col(text)), profile.pattern)
    rows = rows.withColumns({"title": f.clean_title(F.regexp_extract("item", profile.pattern, profile.title_group)), "topic_id": F.regexp_extract("item", profile.pattern, profile.id_group).try_cast("bigint")})
    rows = rows.where("title <> '' AND topic_id IS NOT NULL").withColumn("url", F.replace(F.lit(profile.url), F.lit("{id}"), F.col("topic_id").cast("string")))
    return first_by(rows.select(*key, "topic_id", "url", "title", "pos"), [*key, "url"], ["pos"])


def heading_links(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, title, url): every heading of a text that is a link, whatever it links to; titles are cut at 300."""
    pattern = r"###\s*\[([^\]]+)\]\(([^)]+)\)"
    rows = exploded(df.select(key, text), f.text_of(F.col(text)), pattern)
    out = rows.select(key, "pos", F.substring(f.trimmed(F.regexp_extract("item", pattern, 1)), 1, 300).alias("title"), f.trimmed(F.regexp_extract("item", pattern, 2)).alias("url"))
    return out.where("title <> '' AND url <> ''")


# An RFC 822 date and time with a numeric offset or a name for none.
RFC822 = "([0-9]{1,2}) ([A-Za-z]{3})[a-z]* ([0-9]{4}) ([0-9]{2}):([0-9]{2})(?::([0-9]{2}))? *([+-][0-9]{4}|GMT|UTC|Z)?"


def rfc822(s: Column) -> Column:
    """The UTC timestamp of an RFC 822 date, else null."""
    part = lambda k: F.regexp_extract(s, RFC822, k)
    month = F.array_position(F.array(*map(F.lit, rules.MONTHS)), F.lower(part(2))).cast("int")
    zone = part(7)
    minutes = F.when(zone.rlike("^[+-]"), F.concat(F.substring(zone, 1, 1), F.lit("1")).try_cast("int") * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int"))).otherwise(0)
    local = F.try_to_timestamp(F.concat_ws(" ", F.concat_ws("-", part(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(1), 2, "0")), F.concat_ws(":", part(4), part(5), F.when(part(6) == "", "00").otherwise(part(6)))))
    return F.when(s.rlike(RFC822) & (month > 0), local - F.make_interval(mins=minutes))


def parse_rss(df: DataFrame, key: str, text: str, most: int = 20_000) -> DataFrame:
    """(key, pos, title, url, published_at) of feed items with a title and a link; bad dates are null."""
    rows = exploded(df.select(key, text), F.substring(f.text_of(F.col(text)), 1, most), "(?is)<item>(.*?)</item>", 1)
    item = F.col("item")
    date = F.coalesce(F.nullif(f.tag_text(item, "pubDate"), F.lit("")), f.tag_text(item, "date"))
    out = rows.select(key, "pos", F.substring(f.decode_entities(f.tag_text(item, "title")), 1, 300).alias("title"), f.decode_entities(f.tag_text(item, "link")).alias("url"), f.bound(date, rfc822).alias("published_at"))
    return out.where("title <> '' AND url <> ''")


def parse_atom(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, title, url, snippet, published_at) of entries; the id without version is the URL."""
    rows = exploded(df.select(key, text), f.text_of(F.col(text)), "(?is)<entry>(.*?)</entry>", 1)
    item = F.col("item")
    when = F.try_to_timestamp(f.tag_text(item, "published"))
    out = rows.select(key, "pos", F.substring(f.tag_text(item, "title"), 1, 300).alias("title"), f.strip_version(f.tag_text(item, "id")).alias("url"), F.substring(f.tag_text(item, "summary"), 1, 500).alias("snippet"), when.alias("published_at"))
    return out.where("title <> '' AND url <> ''")


def read_feed_files(spark: SparkSession, path: str, kind: str = "atom") -> DataFrame:
    """(title, url, snippet, published_at, malformed, and the columns of a partitioned folder) of every entry of XML files,
    by Spark's XML reader, which cuts files at entries, so a large file is read by several tasks.

    kind ``atom``: entry, id without its version as URL; ``rss``: item, link, no snippet. An entry that isn't well formed has
    ``malformed`` set to its text and nulls else; well-formed ones without a title or URL go. Entities are decoded by the
    reader, each once; tags inside are dropped and white space is squeezed. Bad dates are null.
    """
    tag, fields_ = ("entry", ["title", "id", "summary", "published"]) if kind == "atom" else ("item", ["title", "link", "pubDate", "date"])
    schema = ", ".join([*(f"{c} string" for c in fields_), "_malformed string"])
    rows = spark.read.format("xml").option("rowTag", tag).option("useLegacyXMLParser", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_malformed").schema(schema).load(path)
    more = [c for c in rows.columns if c not in (*fields_, "_malformed")]
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(f.text_of(F.col(c)), "<[^>]+>", ""), "\\s+", " "))
    if kind == "atom":
        columns = [F.substring(plain("title"), 1, 300).alias("title"), f.strip_version(plain("id")).alias("url"), F.substring(plain("summary"), 1, 500).alias("snippet"), F.try_to_timestamp(plain("published")).alias("published_at")]
    else:
        date = F.coalesce(F.nullif(plain("pubDate"), F.lit("")), plain("date"))
        columns = [F.substring(plain("title"), 1, 300).alias("title"), plain("link").alias("url"), F.lit(None).cast("string").alias("snippet"), f.bound(date, rfc822).alias("published_at")]
    # the parser of that option cuts at the tags first, so an entry that isn't well formed doesn't end its file;
    # the reader refuses to give the malformed texts alone, so a field goes along with them
    malformed = F.when(F.coalesce(F.length("title"), F.lit(0)) >= 0, F.col("_malformed"))
    bad = malformed.isNotNull()
    out = rows.select(*more, *[F.when(~bad, c).alias(n) for c, n in zip(columns, ("title", "url", "snippet", "published_at"), strict=True)], malformed.alias("malformed"))
    return out.where("malformed IS NOT NULL OR (title <> '' AND url <> '')")


TOPIC_JSON = "struct<topic_list: struct<topics: array<struct<id: bigint, title: string, created_at: string, excerpt: string>>>>"


def parse_topic_json(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, id, title, created_at, excerpt) of a topic list, in a code fence or not; malformed texts give no rows."""
    parsed = F.from_json(f.strip_code_fence(F.col(text)), TOPIC_JSON)
    return df.select(key, F.posexplode(parsed["topic_list"]["topics"]).alias("pos", "t")).select(key, "pos", "t.*").where("id IS NOT NULL")


# The lines of a ranked listing.
OWNER = "^([A-Za-z0-9](?:[A-Za-z0-9-]{0,38}[A-Za-z0-9])?)\\s+/$"
NAME = "^[A-Za-z0-9._-]{1,100}$"
TODAY = "(?i)^([0-9,]+)\\s+stars?\\s+today$"
BUILT_BY = "^Built by\\s*$"
NUMBER = "^[0-9,]{1,15}$"


def parse_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, repo, owner, name, stars_today, stars_total, description, position) of a ranked listing of line blocks.

    A block begins where an owner line is followed by a name. Description: the line below, if it
    has white space and is no structural line. Total: the older of the last two bare numbers
    before the first "Built by". A repository's first block that says something settles it; one
    without stars of today is dropped. Blocks are islands between owner lines of one text.
    """
    lines = df.select(key, F.posexplode(F.transform(F.split(f.text_of(F.col(text)), "\n"), lambda x: F.trim(x))).alias("pos", "line"))
    order = Window.partitionBy(key).orderBy("pos")
    line, after = F.col("line"), F.lead("line").over(order)
    begins = line.rlike(OWNER) & F.coalesce(after.rlike(NAME) & ~after.rlike(TODAY), F.lit(False))
    marked = lines.withColumn("begins", begins).withColumn("block", F.sum(F.col("begins").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(key, "block")
    rows = marked.where("block > 0").withColumn("i", F.col("pos") - F.min("pos").over(own))
    rows = rows.withColumn("today_at", F.min(F.when(line.rlike(TODAY), F.col("pos"))).over(own))
    in_time = F.coalesce(F.col("pos") < F.col("today_at"), F.lit(True))
    rows = rows.withColumn("built_at", F.min(F.when(line.rlike(BUILT_BY) & in_time, F.col("pos"))).over(own))
    number = line.rlike(NUMBER) & in_time & (F.col("pos") < F.col("built_at"))
    described = line.rlike("\\s") & ~line.rlike(NUMBER) & ~line.rlike(BUILT_BY) & ~line.rlike(TODAY) & ~line.rlike(OWNER)
    at = lambda k: F.max(F.when(F.col("i") == k, line))
    rows = rows.groupBy(key, "block").agg(
        at(0).alias("head"), at(1).alias("name"), F.max(F.when(F.col("pos") == F.col("today_at"), line)).alias("today_line"),
        F.sort_array(F.collect_list(F.when(number, F.struct("pos", "line"))), False).alias("numbers"), F.max(F.when((F.col("i") == 2) & described, line)).alias("about"))
    total = F.coalesce(F.get("numbers", 1), F.get("numbers", 0))["line"]
    rows = rows.select(key, "block", F.regexp_extract("head", OWNER, 1).alias("owner"), "name", f.int_with_commas(F.regexp_extract("today_line", TODAY, 1)).alias("today"), f.int_with_commas(total).alias("total"), "about")
    said = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("block", c)))[c]
    out = rows.groupBy(key, "owner", "name").agg(said("today").alias("stars_today"), said("total").alias("stars_total"), said("about").alias("description"), F.min("block").alias("position"))
    return out.where("stars_today IS NOT NULL").withColumn("repo", F.concat_ws("/", "owner", "name"))


def top_trending(rows: DataFrame, key: str, k: int = 15) -> DataFrame:
    """rank: by stars of today, ties in listing order; the first k of each listing."""
    order = Window.partitionBy(key).orderBy(F.desc("stars_today"), "position")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def html_to_text(html: Column) -> Column:
    """Readable text: furniture dropped, code fenced, images and links as Markdown, blocks on lines, entities decoded."""
    s = f.text_of(html)
    for tag in ("script", "style", "iframe", "nav", "header", "footer", "aside"):
        s = F.regexp_replace(s, f"(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}>", "")
    s = F.regexp_replace(s, "(?is)<pre[^>]*>(.*?)</pre>", "\n```\n$1\n```\n")
    s = F.regexp_replace(s, "(?is)<img[^>]*?src=[\"']([^\"']+)[\"'][^>]*?>", "\n![image]($1)\n")
    s = F.regexp_replace(s, "(?is)<a[^>]*?href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>", "[$2]($1)")
    s = F.regexp_replace(s, "(?is)<(?:strong|b)>(.*?)</(?:strong|b)>", "**$1**")
    s = F.regexp_replace(s, "(?is)<(?:em|i)>(.*?)</(?:em|i)>", "*$1*")
    s = F.regexp_replace(s, "(?is)<code>(.*?)</code>", "`$1`")
    s = F.regexp_replace(s, "(?i)</(?:p|div|li|h[1-6]|tr|blockquote|ul|ol|article|section)>|<br */?>", "\n")
    s = f.decode_entities(F.regexp_replace(s, "<[^>]+>", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[ \\t]+", " "), " ?\\n(?: ?\\n)+", "\n\n"))


def is_attachment(url: Column, hosts: str) -> Column:
    """A file of one of the hosts (an alternation): in a storage folder or with a known extension."""
    own = f"(?i)^(?:https?:)?//(?:[^/]*[.])?(?:{hosts})/"
    return f.text_of(url).rlike(own) & (f.text_of(url).rlike(own + "(?:uploads|system|original|optimized)[^\"'\\s]*/") | f.text_of(url).rlike(f"(?i)[.](?:{rules.ATTACHMENT_EXTENSIONS})(?:[?#].*)?$"))


def attachment_key(name: Column) -> Column:
    """A leading hash of 40 to 64 hex digits, else the name without marks of a resized copy; lower case."""
    n = F.regexp_replace(name, "(?i)_[0-9]+_[0-9]+x[0-9]+([.][^.]+)$", "$1")
    n = F.regexp_replace(F.regexp_replace(n, "(?i)_[0-9]+x[0-9]+([.][^.]+)$", "$1"), "(?i)_2x([.][^.]+)$", "$1")
    return F.lower(F.when(name.rlike("(?i)^[0-9a-f]{40}"), F.regexp_extract(name, "(?i)^([0-9a-f]{40,64})", 1)).otherwise(n))


def extract_assets(df: DataFrame, key: str, html: str, hosts: str) -> DataFrame:
    """(key, url, kind, basename, original): attachments of images, then of links; one of each identity, originals first."""
    text = f.text_of(F.col(html))
    grab = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    found = F.concat(F.transform(grab("(?i)<img[^>]*?src=[\"']([^\"']+)[\"']"), lambda u: F.struct(u.alias("raw"), F.lit("image").alias("kind"))), F.transform(grab("(?i)<a[^>]*?href=[\"']([^\"']+)[\"']"), lambda u: F.struct(u.alias("raw"), F.lit("file").alias("kind"))))
    rows = df.select(key, F.posexplode(found).alias("pos", "x")).select(key, "pos", "x.*").where(is_attachment(F.col("raw"), hosts))
    rows = rows.withColumn("url", F.regexp_extract("raw", "^([^?#]*)", 1)).withColumn("original", F.col("url").rlike("(?i)/original/")).withColumn("basename", F.element_at(F.split("url", "/"), -1))
    once = first_by(rows.select(key, "pos", "url", "kind", "basename", "original"), [key, "url"], ["pos"])
    return first_by(once.withColumn("identity", attachment_key(F.col("basename"))), [key, "identity"], [~F.col("original"), "pos"])

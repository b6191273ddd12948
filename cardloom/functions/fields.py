"""Column functions: URLs, dates, texts. All native expressions.

Lengths count code points. White space in patterns is ASCII white space; where the ideographic
and the no-break space count too, the pattern names them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def trimmed(c: Column) -> Column:
    """Without white space (blanks, tabs, line ends) at both ends."""
    return F.btrim(c, F.lit(" \t\n\r\f\x0b"))


def bound(value: Column, of) -> Column:
    """``of(value)`` with value computed once a row, however often ``of`` names it."""
    return F.get(F.transform(F.array(value), of), 0)


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once a row, whatever filters and projections follow: an exploded
    one-element array, through which the optimizer moves nothing that names them."""
    held = df.withColumn("_computed", F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
    return held.withColumns({name: F.col(f"_computed.{name}") for name in columns}).drop("_computed")


def ascii_bounds(pattern: str) -> str:
    """A pattern for Java's engine whose word boundaries look at ASCII letters, digits and _ alone: each \\b stands
    before a word's first or behind its last character."""
    before = re.sub(r"\\b(?=\w|\(\?:[a-z])", "(?<![A-Za-z0-9_])", pattern)
    return before.replace("\\b", "(?![A-Za-z0-9_])")


def norm_url(u: Column) -> Column:
    """Host without www. and path without the last slash, in lower case; anything else in lower case. Null stays null."""
    path = F.regexp_replace(F.regexp_extract(u, rules.URL, 2), "/$", "")
    return F.when(u.rlike(rules.URL), F.lower(F.concat(F.regexp_extract(u, rules.URL, 1), path))).otherwise(F.lower(u))


def url_key(u: Column) -> Column:
    """Origin and path without the last slash; other strings only lose a last slash."""
    scheme = F.lower(F.regexp_extract(u, rules.WEB_URL, 1))
    port = F.regexp_extract(u, rules.WEB_URL, 3)
    plain = ((scheme == "https") & (port == ":443")) | ((scheme == "http") & (port == ":80"))
    origin = F.concat(scheme, F.lit("://"), F.lower(F.regexp_extract(u, rules.WEB_URL, 2)), F.when(plain, "").otherwise(port))
    return F.when(u.rlike(rules.WEB_URL), F.concat(origin, F.regexp_replace(F.regexp_extract(u, rules.WEB_URL, 4), "/$", ""))).otherwise(F.regexp_replace(u, "/$", ""))


def host_of(u: Column) -> Column:
    return F.when(u.rlike(rules.URL), F.lower(F.regexp_extract(u, rules.URL, 1))).otherwise("unknown")


def safe_url(u: Column) -> Column:
    """http(s) without white space or control characters, else empty."""
    return F.when(u.rlike("(?i)^https?://[^\\x00-\\x20\\x7F]+$"), u).otherwise("")


def strip_version(u: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(u, "(?i)v[0-9]+$", ""), "^http:", "https:")


def _number(c: Column) -> Column:
    return c.try_cast("int")


def _ymd(s: Column, pattern: str, y: int, m: int, d: int) -> Column:
    """yyyymmdd of the first match; months and days are not checked."""
    part = lambda k: _number(F.regexp_extract(s, pattern, k))
    return F.when(s.rlike(pattern), part(y) * 10000 + part(m) * 100 + part(d))


def normalize_date(c: Column) -> Column:
    """Six spellings of a date as the number yyyymmdd, else null."""
    s = F.trim(c)
    month = F.lower(F.substring(s, 1, 3))
    at = F.array_position(F.array(*map(F.lit, rules.MONTHS)), month).cast("int")
    named = lambda pattern, y, d: F.when((at > 0) & s.rlike(pattern), _number(F.regexp_extract(s, pattern, y)) * 10000 + at * 100 + _number(F.regexp_extract(s, pattern, d)))
    return F.coalesce(
        _ymd(s, "^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", 1, 2, 3),
        _ymd(s, "^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})", 1, 2, 3),
        _ymd(s, "^([0-9]{4})([0-9]{2})([0-9]{2})", 1, 2, 3),
        _ymd(s, "([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4})", 3, 1, 2),
        named("([0-9]{1,2}),?\\s*([0-9]{4})", 2, 1),
        named("([0-9]{4}),?\\s+([0-9]{1,2})", 1, 2),
    )


def day_of(n: Column) -> Column:
    """The date of a number yyyymmdd; null if there is no such day."""
    return F.try_to_date(n.cast("string"), "yyyyMMdd")


def days_between(a: Column, b: Column) -> Column:
    """Days from a to b, both yyyymmdd."""
    return F.datediff(day_of(b), day_of(a))


def local_day(ts: Column, hours: int = 8) -> Column:
    """The calendar day of a UTC timestamp in a zone that many hours ahead."""
    return F.to_date(ts + F.make_interval(hours=F.lit(hours)))


def valid_date(s: Column) -> Column:
    return F.coalesce(s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(s, "yyyy-MM-dd").isNotNull(), F.lit(False))


def has_full_day(s: Column) -> Column:
    return F.coalesce(s.rlike("[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.lit(False))


def event_key(name: Column) -> Column:
    """The first fingerprint that matches, else the name in lower case without brackets' content and white space."""
    low = F.lower(name)
    out = F.regexp_replace(F.regexp_replace(low, "[（(][^)）]*[)）]", ""), "\\s+", "")
    for key, patterns in reversed(rules.FINGERPRINTS):
        hit = low.rlike(patterns[0])
        for p in patterns[1:]:
            hit = hit & low.rlike(p)
        out = F.when(hit, F.lit(key)).otherwise(out)
    return out


def clean_title(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(s, F.lit("\\|"), F.lit("|")), "\\s+", " "))


def decode_entities(s: Column) -> Column:
    """Six entities; the ampersand first, so that a doubly encoded one is decoded twice."""
    for code, sign in rules.ENTITIES:
        s = F.replace(s, F.lit(code), F.lit(sign))
    return s


def tag_text(xml: Column, tag: str) -> Column:
    """The text of the first such element: CDATA unwrapped, tags dropped, white space collapsed; empty if there is none."""
    body = F.regexp_extract(xml, f"(?is)<{tag}(?:[^>]*)>(.*?)</{tag}>", 1)
    plain = F.regexp_replace(F.regexp_replace(body, "(?s)<!\\[CDATA\\[(.*?)\\]\\]>", "$1"), "<[^>]+>", "")
    return F.trim(F.regexp_replace(plain, "\\s+", " "))


def safe_filename(s: Column) -> Column:
    return F.regexp_replace(s, "[^A-Za-z0-9._-]+", "_")


def slug(s: Column, most: int = 60, default: str = "section") -> Column:
    short = F.substring(F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)
    return F.when(F.coalesce(short, F.lit("")) == "", F.lit(default)).otherwise(short)


def without_controls(s: Column) -> Column:
    """Without control characters other than tabs and line ends."""
    return F.regexp_replace(s, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")


def escape_markdown(s: Column, multiline: bool = False) -> Column:
    """Markdown signs escaped; one line unless ``multiline``; null gives empty."""
    one = F.replace(text_of(s), F.lit("\r"), F.lit(""))
    one = one if multiline else F.regexp_replace(one, "\n+", " ")
    return F.regexp_replace(trimmed(without_controls(one)), "([\\\\`*_\\[\\]<>#+.!|()-])", "\\\\$1")


def escape_url(s: Column) -> Column:
    """For a link target in angle brackets."""
    return F.regexp_replace(s, "([\\\\<>])", "\\\\$1")


def escape_cell(s: Column) -> Column:
    """For a cell of a Markdown table: bars escaped, one line; null gives empty."""
    return trimmed(F.replace(F.replace(text_of(s), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def escape_xml(s: Column, attribute: bool = False) -> Column:
    for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#39;")) if attribute else ())):
        s = F.replace(s, F.lit(sign), F.lit(code))
    return F.regexp_replace(s, "[\\x00-\\x1F\\x7F]", " ") if attribute else s


def int_with_commas(s: Column) -> Column:
    return F.replace(s, F.lit(","), F.lit("")).try_cast("int")


def thousands(n: Column) -> Column:
    return F.when(n.isNull(), "—").otherwise(F.format_number(n, 0))


def matches_low(s: Column, pattern: str) -> Column:
    """Whether the lower-case text has a match; null counts as empty."""
    return F.lower(text_of(s)).rlike(pattern)


def is_promo(title: Column) -> Column:
    return matches_low(title, rules.PROMO)


def latin_tokens(s: Column) -> Column:
    """Distinct lower-case tokens of four characters or more that tell names apart."""
    found = F.regexp_extract_all(F.lower(text_of(s)), F.lit("[a-z0-9][a-z0-9.%-]*"), F.lit(0))
    return F.array_except(F.filter(found, lambda t: F.length(t) >= 4), F.array(*map(F.lit, rules.STOP_TOKENS)))


def readable_tokens(s: Column) -> Column:
    """How many tokens read as prose: with a Han character, or five Latin letters and more."""
    tokens = F.split(text_of(s), "[\\s,，;；:：|·]+")
    return F.size(F.filter(tokens, lambda t: t.rlike("[一-鿿]") | t.rlike("^[A-Za-z]{5,}$")))


def vote_label(ok: Column, refuted: Column, injected: Column) -> Column:
    return F.when(injected, "—").otherwise(F.concat(ok.cast("string"), F.lit("-"), refuted.cast("string")))


def strip_code_fence(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(s, "(?i)^\\s*```(?:json)?\\s*", ""), "\\s*```\\s*$", ""))


def first_fenced(s: Column) -> Column:
    """The body of the first fenced block, else the text without its front matter."""
    body = F.regexp_extract(s, "(?s)```[a-z]*\\n(.*?)```", 1)
    rest = F.trim(F.regexp_replace(s, "(?s)^---\\n.*?\\n---\\n", ""))
    return F.when(body != "", F.trim(body)).otherwise(rest)


def substitute_date(template: Column, day: Column, name: str = "{date}") -> Column:
    return F.replace(template, F.lit(name), day)


def confidence_label(c: Column) -> Column:
    out = c
    for word, label in rules.CONFIDENCE:
        out = F.when(c == word, label).otherwise(out)
    return out


def rank_in(c: Column, names: list[str]) -> Column:
    """Place of a word in a list, from 0; unknown words come last."""
    at = F.array_position(F.array(*map(F.lit, names)), c).cast("int")
    return F.when(at > 0, at - 1).otherwise(len(names))


def is_unchecked(status: Column) -> Column:
    s = F.translate(text_of(status), "［【］】（）．", "[[]]()·")
    return F.regexp_replace(s, "[\\s\\x{3000}\\x{00A0}]+", "").isin(rules.UNCHECKED)

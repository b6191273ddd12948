"""Snippets without orders to a model, and readable ones.

Most texts hold nothing suspicious: a search of the lower-case text for the words that the patterns need tells, in Arrow
batches, where a plain search costs a tenth of the engine's own. Only the others are taken apart into paragraphs, and those
with such words are tried with the patterns themselves. All else is native.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .fields import ascii_bounds, bound, text_of, trimmed
from .patterns import requirements

SIGNATURES = "(?i)" + "|".join(f"(?:{ascii_bounds(p)})" for p in rules.INSTRUCTIONS)
ORDER = "(?i)" + ascii_bounds(rules.ORDER)
#: What an order is aimed at and its verbs: a text without one of each (lower case) holds none.
TARGETS = ["system", "instruction", "rule", "prompt", "系统", "指令", "规则", "提示"]
VERBS = ["ignore", "disregard", "override", "replace", "follow", "obey", "reveal", "publish", "output", "tell", "忽略", "无视", "覆盖", "改为输出", "不要遵守", "发布", "告诉"]


#: For each pattern sets of words, of each of which a match has one; the first set tells most.
_NEEDED = [[TARGETS, VERBS]] + [sorted((sorted({w.strip() for w in need}) for need in needs), key=lambda need: -min(map(len, need))) for pattern in rules.INSTRUCTIONS for needs in requirements(pattern)]
_FIRST = sorted({word for needs in _NEEDED for word in needs[0]})


def _seen(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> bool:
        low = (text or "").lower()
        if not any(word in low for word in _FIRST):
            return False
        return any(all(any(word in low for word in need) for need in needs) for needs in _NEEDED)

    return texts.map(one).astype(bool)


def _hint(low: Column) -> Column:
    """True for every text in which a pattern matches, and for few others, from the text in lower case."""
    has = lambda need: reduce(or_, [F.contains(low, F.lit(word)) for word in need])
    return reduce(or_, [reduce(and_, map(has, needs)) for needs in _NEEDED])


def suspicious(text: Column) -> Column:
    """The same as ``_hint`` by a search in Arrow batches; not for lambdas."""
    return F.pandas_udf(_seen, "boolean")(text)


def looks_injected(s: Column) -> Column:
    return s.rlike(SIGNATURES) | s.rlike(ORDER)


def _apart(text: Column) -> Column:
    """Paragraph by paragraph, and where one looks injected sentence by sentence."""
    lines = F.transform(F.split(text, "\n+"), lambda p: trimmed(F.regexp_replace(F.regexp_replace(p, "^>\\s?", ""), "^\\s*[-*]\\s+", "")))

    def clean(p: Column) -> Column:
        parts = F.transform(F.split(p, "(?<=[。！？!?])\\s*|(?<=[.])\\s+"), trimmed)
        good = F.filter(parts, lambda s: (s != "") & ~s.rlike("^[0-9]+[.)]?$") & ~looks_injected(s))
        return F.when(bound(F.lower(p), _hint) & looks_injected(p), F.array_join(good, " ")).otherwise(p)

    return F.array_join(F.filter(F.transform(F.filter(lines, lambda p: p != ""), clean), lambda p: p != ""), " ")


def _whole(text: Column) -> Column:
    """The same for a text without anything suspicious, before runs of white space are squeezed: marks off every line, lines joined."""
    marked = F.contains(text, F.lit(">")) | F.contains(text, F.lit("-")) | F.contains(text, F.lit("*"))
    bare = F.regexp_replace(F.regexp_replace(text, "(?dm)^>[^\\S\n]?", ""), "(?dm)^[^\\S\n]*[-*][^\\S\n]+", "")
    return F.replace(F.when(marked, bare).otherwise(text), F.lit("\n"), F.lit(" "))


def scrub(text: Column, most: int = 1000, inside: bool = False) -> Column:
    """The text without sentences that read as orders to a model, on one line, cut at ``most`` characters.

    Paragraphs are lines without quote and list marks. Only a paragraph that looks injected is
    taken apart into sentences; of these, bare numbers and injected ones go. Null gives empty. ``inside``: native
    throughout, for lambdas and short texts.
    """
    plain = F.replace(text_of(text), F.lit("\r"), F.lit(""))
    if inside:
        kept = bound(plain, lambda p: F.when(bound(F.lower(p), _hint), _apart(p)).otherwise(_whole(p)))
    else:
        kept = F.when(suspicious(plain), _apart(plain)).otherwise(_whole(plain))
    return F.substring(trimmed(F.regexp_replace(kept, "\\s{2,}", " ")), 1, most)


#: Signs between tokens.
BREAKS = "\\s,，;；:：|·"


def is_obscure(clean: Column) -> Column:
    """No Han character and no token of five Latin letters or more and nothing else, but something."""
    return (clean != "") & ~clean.rlike(f"[一-鿿]|(?:^|[{BREAKS}])[A-Za-z]{{5,}}(?:[{BREAKS}]|$)") & clean.rlike(f"[^{BREAKS}]")


def clarify(snippet: Column, title: Column, most: int = 1000) -> Column:
    """The scrubbed snippet, led by the title if it is obscure. An empty snippet stays empty."""
    led = lambda c: F.when(is_obscure(c["clean"]) & (c["head"] != ""), scrub(F.concat(c["head"], F.lit("。"), c["clean"]), most, inside=True)).otherwise(c["clean"])
    return bound(F.struct(scrub(snippet, most).alias("clean"), scrub(title, 200).alias("head")), led)


def injection_only(snippet: Column, title: Column) -> Column:
    return (scrub(snippet) == "") & (scrub(title) == "")


def substance(snippet: Column, attachments: str | None = "forum-attachments") -> Column:
    """Han characters and longer Latin words outside URLs, less 10 for page furniture; null without any text.
    ``attachments``: the name of a site's folder of attachments, furniture too."""
    s = text_of(snippet)
    bare = F.regexp_replace(s, "(?i)https?://\\S+", " ")
    count = F.regexp_count(bare, F.lit("[一-鿿]")) + F.regexp_count(bare, F.lit("[A-Za-z][A-Za-z0-9'./-]{4,}"))
    furniture = ascii_bounds(rules.CHROME) + (f"|{attachments.lower()}" if attachments else "")
    return F.when(trimmed(s) != "", count - F.when(F.lower(s).rlike(furniture), 10).otherwise(0))

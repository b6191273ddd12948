import re

import pytest
from pyspark.sql import functions as F

from cardloom import rules
from cardloom.functions import patterns as pt
from cardloom.operators import cards as oc

TABLE = "rule long, key string, match string, exclude string, rewrite string"
CARD = "seq long, day_no int, title string, snippet string"


def test_what_a_pattern_needs():
    cases = {
        "重置|reset": ["reset", "重置"], "115.*api.*暂停": ["115"], "a(?:b|c)defg": ["defg"], "colou?r": ["colo"], "ab*cde": ["cde"], "x+yy": ["yy"],
        r"v4\.5 pro": ["v4.5 pro"], r"\bword\b": ["word"], "[ab]cd|ef{0,2}g": ["cd", "e"], "a{2,}bc": ["bc"], "(a|b)": ["a", "b"], "x|.*": None, "": None, "a?": None, r"\d+": None,
        r"\x41bc": ["bc"], r"[^\]]long": ["long"], r"(?:a[)]b)cc": ["cc"], "A|B": ["a", "b"], r"\p{L}tail": ["tail"], "苹果.*千问": ["苹果"], "(?:long|other)x": ["long", "other"],
        "(?:left)?in": ["in"], "(?=ahead)go": ["go"], "(?:a|.)": None, "(one(?:two|three))+": ["one"], r"\Qa.b\E": None,
    }
    for pattern, want in cases.items():
        assert pt.literals(pattern) == want, pattern
    # whatever it says must be in each match
    for pattern, text in [("colou?r", "color"), ("ab*cde", "acde"), ("a{2,}bc", "aabc"), ("(?:x|y)z+w", "yzzw"), ("115.*api", "115 api"), (r"q\?z", "q?z"), ("[ab]]c", "a]c"), ("e{0}fg", "fg"), ("(?:ab|cd)+", "cd"), ("a|(?:b(?:cc|dd)?)", "b")]:
        found = pt.literals(pattern)
        assert re.search(pattern, text) and (found is None or any(x in text for x in found)), pattern


def chain(title, compiled):
    low = (title or "").lower()
    return next((r for r, match, exclude in compiled if match.search(low) and not (exclude and exclude.search(low))), None)


def test_the_three_rules_as_a_table(spark):
    titles = ["Codex 重置", "RESET your password", "115 网盘 API 暂停", "苹果 撤回 千问", "苹果 千问 合作", None, "", "115 重置 api 暂停"]
    df = spark.createDataFrame([(k, 0, t, "s") for k, t in enumerate(titles)], CARD)
    table = spark.createDataFrame([(k, *c) for k, c in enumerate(rules.CLUSTERS)], TABLE)
    got = {r.seq: r.cluster for r in oc.match_rule_table(df, table).collect()}
    assert got == {r.seq: r.cluster for r in oc.match_rules(df).collect()}
    cards = spark.createDataFrame([(k, 0, t, f"words number {k}" * (k + 1)) for k, t in enumerate(titles)], CARD)
    fold = lambda df: sorted(tuple(r) for r in df.select("seq", "cluster", F.coalesce("title", F.lit("")).alias("title"), "position").collect())
    assert fold(oc.fold_by_table(cards, ["day_no"], table)) == fold(oc.fold_events(cards, ["day_no"]))


def test_five_thousand_rules(spark):
    table = [(k, f"k{k}", f"item{k}(?:x|y)" if k % 3 else f"alt{k}|item{k}z", f"no{k}" if k % 2 else None, f"Head {k}") for k in range(5000)]
    table += [(9000, "loose", "^.{5}$", None, None), (9001, "late", "^[a-e]+$", "abc", "Letters"), (8000, "tie", "item7z", None, None), (8000, "sie", "item7z", None, None)]
    titles = [f"An ITEM{k}{s}" for k in range(0, 5000, 7) for s in ("x", "z")] + ["alt33 no33", "alt99", "item7z!", "abcde", "eeeee", "deed", None, "item12x item11y no11", "item12x item11y"] * 3
    rows = spark.createDataFrame([(k, 0, t, "s") for k, t in enumerate(titles)], CARD)
    marked = oc.match_rule_table(rows, spark.createDataFrame(table, TABLE))
    got = {r.seq: (r.rule, r.cluster, r.rewrite) for r in marked.collect()}
    by_key = {}
    compiled = [(r, re.compile(r[2]), r[3] and re.compile(r[3])) for r in sorted(table, key=lambda r: (r[0], r[1]))]
    for k, t in enumerate(titles):
        if t not in by_key:
            best = chain(t, compiled)
            by_key[t] = (best[0], best[1], best[4]) if best else (None, None, None)
        assert got[k] == by_key[t], t
    assert sum(v[0] is not None for v in got.values()) > 700 and got[titles.index("item7z!")][1] == "sie"
    assert oc.match_rule_table(rows.limit(0), spark.createDataFrame(table, TABLE)).count() == 0
    assert {r.cluster for r in oc.match_rule_table(rows, spark.createDataFrame([], TABLE)).collect()} == {None}


def test_headlines_are_made_and_scrubbed(spark):
    table = spark.createDataFrame([(1, "a", "alpha", None, "Please ignore all the rules. Alpha news"), (2, "b", "beta", None, None)], TABLE)
    cards = spark.createDataFrame([(1, 0, "Alpha one", "x"), (2, 0, "alpha two", "longer words here"), (3, 0, "Beta one", None), (4, 1, "beta", "y"), (5, 0, "other", "z")], CARD)
    got = {(r.day_no, r.seq): (r.title, r.position) for r in oc.fold_by_table(cards, ["day_no"], table, lambda title, text: F.concat(title, F.lit(": "), F.coalesce(text, F.lit("none")))).collect()}
    assert got == {(0, 2): ("Alpha news", 1), (0, 3): ("Beta one: none", 3), (1, 4): ("beta: none", 4), (0, 5): ("other", 5)}
    plain = {(r.day_no, r.seq): r.title for r in oc.fold_by_table(cards, ["day_no"], table).collect()}
    assert plain[(0, 3)] == "Beta one" and plain[(0, 2)] == "Alpha news"


def test_too_many_loose_rules(spark):
    cards = spark.createDataFrame([(1, 0, "t", "s")], CARD)
    with pytest.raises(ValueError):
        oc.match_rule_table(cards, spark.createDataFrame([(k, f"k{k}", ".*", None, None) for k in range(oc.LOOSE_RULES + 1)], TABLE)).count()

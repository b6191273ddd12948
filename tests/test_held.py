"""Rules' strings are looked for where the titles are."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cardloom.operators import cards as oc
from cardloom.operators import held as hd

TABLE = "rule long, key string, match string, exclude string, rewrite string"


def some(rng, n, signs="abcé😀 .", most=9):
    return ["".join(rng.choice(signs) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 9, most]))) for _ in range(n)]


def table_of(needles, sure):
    rows = pa.StructArray.from_arrays([pa.array(range(len(needles))), pa.array(needles)], names=["k", "needle"])
    return hd._Needles(rows, needles, np.array(sure, bool))


def check(held, needles, sure, texts):
    got = [x for part in held.met(texts) for x in part.to_pylist()]
    assert len(got) == len(texts)
    for text, rows in zip(texts, got, strict=True):
        ks = [r["k"] for r in rows]
        first = next((k for k, n in enumerate(needles) if sure[k] and n in text), len(needles))
        assert ks == sorted(ks) and {k for k, n in enumerate(needles) if n in text and k <= first} <= set(ks) and not any(k > first for k in ks), text
    return got


@pytest.mark.parametrize("seed", range(6))
def test_needles_in_texts(seed, monkeypatch):
    """Whatever the lengths of needles and texts, and however little is held at once."""
    rng = random.Random(seed)
    needles = some(rng, 60, most=40) + ["aaaa", "aaaaa", "abababababababababab"]
    sure = [rng.random() < 0.1 * (seed % 3) for _ in needles]
    texts = ["".join(some(rng, rng.randrange(12))) + rng.choice(["", *needles]) + rng.choice(["", "a" * 30]) for _ in range(80)] + [""]
    for module, name, value in [(hd, "SENT", rng.choice([1, 50, 1 << 17])), (hd, "CHARS", rng.choice([7, 100, 1 << 18])), (__import__("cardloom.operators.containment", fromlist=["x"]), "CHARS", rng.choice([5, 60, 1 << 18]))]:
        monkeypatch.setattr(module, name, value)
    got = check(table_of(needles, sure), needles, sure, texts)
    assert all(r["needle"] in t for t, rows in zip(texts, got, strict=True) for r in rows)


def test_hashes_only_propose(monkeypatch):
    """A hash that a text shares with a needle it doesn't contain settles nothing."""
    real = hd._mixed
    monkeypatch.setattr(hd, "_mixed", lambda h: real(h) & hd.U64(63))
    monkeypatch.setattr(hd, "_kind_hash", lambda h, kind: h)
    rng = random.Random(1)
    needles, sure = ["abc", "cab", "ba c", "caé", "bb"], [True, True, True, False, True]
    texts = some(rng, 300, most=30)
    got = check(table_of(needles, sure), needles, sure, texts)
    assert any(r["needle"] not in t for t, rows in zip(texts, got, strict=True) for r in rows)


def test_titles_are_not_dealt_out(spark):
    """Rules meet titles in their own tasks: nothing is shuffled, however many strings titles share with rules."""
    table = spark.createDataFrame([(k, f"k{k}", f"w{k}" if k % 2 else f"w{k}.*x", None, None) for k in range(300)], TABLE)
    cards = spark.createDataFrame([(k, " ".join(f"W{k * j % 317}" for j in range(9)) + " x") for k in range(200)] + [(200, None)], "seq long, title string")
    marked = oc.match_rule_table(cards, table)
    assert "Exchange" not in marked._jdf.queryExecution().executedPlan().toString()
    got = {r.seq: r.rule for r in marked.collect()}
    rules = {k: min(r for r in range(300) if any(f"w{r}" in f"w{k * j % 317}" for j in range(9))) if any(k * j % 317 < 300 for j in range(9)) else None for k in range(200)}
    assert got == rules | {200: None}


def test_blocks_of_needles(spark, monkeypatch):
    """More needles than a task holds at once, among them an empty block: the same rows."""
    rng = random.Random(3)
    table = [(k, f"k{k}", s if k % 3 else f"{s}.*(?:b|c)", "cc" if k % 4 == 0 else None, None) for k, s in enumerate(some(rng, 200, "abc ", 12))]
    titles = [None, ""] + some(rng, 300, "abc ", 25) * 2
    cards = spark.createDataFrame([(k, t) for k, t in enumerate(titles)], "seq long, title string")
    rules = spark.createDataFrame(table, TABLE)
    rows = lambda: sorted(map(repr, oc.match_rule_table(cards, rules).collect()))
    want = rows()
    for held in (4000, 17000):
        monkeypatch.setattr(hd, "HELD", held)
        assert rows() == want
    few = spark.createDataFrame([(1, "k", "abc", None, None)], TABLE)
    monkeypatch.setattr(hd, "HELD", 20)
    assert {r.seq for r in oc.match_rule_table(cards, few).where("rule = 1").collect()} == {k for k, t in enumerate(titles) if "abc" in (t or "")}


def test_a_string_alone_needs_no_test(spark):
    """Signs of patterns, exclusions and upper case: only a plain string settles a title."""
    table = [(1, "a", "a+b", None, None), (2, "b", "plain", "but", None), (3, "c", "Upper", None, None), (4, "d", "upper", None, None), (5, "e", "x.y", None, None), (6, "f", r"q\.z", None, None), (7, "g", "p(?:l|m)ain|other", None, None)]
    titles = {"a+b": None, "aab": 1, "plain": 2, "plain but": 7, "UPPER": 4, "xzy": 5, "q.z": 6, "qaz": None, "another": 7}
    cards = spark.createDataFrame(list(enumerate(titles)), "seq long, title string")
    assert {r.title: r.rule for r in oc.match_rule_table(cards, spark.createDataFrame(table, TABLE)).collect()} == titles


def test_folding_deals_out_narrow_rows(spark):
    """Columns that the result doesn't have, such as the snippet, are gone before rows are dealt to their clusters."""
    table = spark.createDataFrame([(1, "a", "alpha", None, "Alpha news")], TABLE)
    cards = spark.createDataFrame([(1, 0, "alpha one", "x"), (2, 0, "alpha two", "longer words here"), (3, 0, "other", None)], "seq long, day_no int, title string, snippet string")
    folded = oc.fold_by_table(cards, ["day_no"], table, names=["day_no", "seq", "title"])
    assert sorted(map(tuple, folded.select("seq", "title", "cluster", "position").collect()), key=repr) == [(2, "Alpha news", "a", 1), (3, "other", None, 3)]
    assert set(folded.columns) == {"day_no", "seq", "title", "cluster", "position"}
    lines = [x for x in folded._jdf.queryExecution().executedPlan().toString().split("\n") if "max_by" in x]
    assert lines and not any("snippet" in x for x in lines)
    whole = oc.fold_by_table(cards, ["day_no"], table).where(F.col("seq") == 2).first()
    assert whole.snippet == "longer words here"

import random

from pyspark.sql import functions as F

from cardloom.operators import containment as ct
from cardloom.operators import coverage as cv


def brute(texts, needles):
    return {(run, n) for run, t in texts for k, n in needles if n and t is not None and (k is None or k == run) and n in t}


def got(spark, texts, needles, keyed):
    t = spark.createDataFrame(texts, "run int, text string")
    n = spark.createDataFrame([(0 if k is None else k, x) for k, x in needles], "run int, name string")
    found = ct.pairs(t, "text", n, "name", by=("run",)) if keyed else ct.pairs(t, "text", n.drop("run"), "name", carry=("run",))
    rows = [(r.run, r.needle) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_all_pairs(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcé汉😀 ") for _ in range(rng.randrange(1, 9)))
    texts = [(rng.randrange(4), "".join(word() for _ in range(rng.randrange(30)))) for _ in range(200)] + [(1, None), (2, ""), (3, "x" * 3000)]
    needles = [(None, word()) for _ in range(150)] + [(None, t[5:5 + rng.randrange(20)]) for _, t in texts if t] + [(None, ""), (None, None), (None, "x" * 40)]
    assert got(spark, texts, needles, False) == brute(texts, needles)
    own = [(rng.randrange(4), n) for _, n in needles]
    assert got(spark, texts, own, True) == brute(texts, own)


def test_long_needles_and_long_texts(spark, monkeypatch):
    rng = random.Random(3)
    base = "".join(rng.choice("ab ") for _ in range(9000))
    texts = [(1, base), (2, base[:4000] + "!" + base[4000:]), (3, base[2000:2400] * 3)]
    needles = [(None, base[a:a + n]) for a, n in ((0, 129), (10, 128), (500, 300), (3900, 200), (3873, 256), (2000, 700), (8872, 128), (8999, 1), (8000, 1000))]
    needles += [(None, base[2300:2400] + base[2000:2200]), (None, "ab" * 100), (None, base + "x")]
    want = brute(texts, needles)
    assert got(spark, texts, needles, False) == want
    monkeypatch.setattr(ct, "CHARS", 1000)
    assert [len(s) for _, _, s in next(ct._segments(["y" * 2500]))] == [1003]
    assert sum(len(x) for x in ct._segments(["y" * 2500, "z"])) == 4


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "run int, name string")
    t = spark.createDataFrame([(1, "text")], "run int, text string")
    assert ct.pairs(t, "text", none, "name", by=("run",)).collect() == [] and ct.pairs(t, "text", none.drop("run"), "name", carry=("run",)).columns == ["run", "needle"]
    n = spark.createDataFrame([(1, "other"), (1, "tex")], "run int, name string")
    assert [tuple(r) for r in ct.pairs(t, "text", n, "name", by=("run",)).collect()] == [(1, "tex")]
    assert ct.pairs(t.limit(0), "text", n, "name", by=("run",)).count() == 0


def test_a_hundred_thousand_aliases(spark):
    ids = spark.range(100_000)
    aliases = ids.select(F.concat(F.lit("n"), (F.col("id") % 40_000)).alias("name"), F.substring(F.md5(F.col("id").cast("string")), 1, 9).alias("alias"))
    texts = spark.range(2_000).select((F.col("id") % 3).cast("int").alias("run"), F.concat_ws(" ", F.md5((F.col("id") * 60).cast("string")), F.lit("lorem ipsum dolor sit amet"), F.repeat(F.lit("z"), 500)).alias("text"))
    want = {(r.run, r.name) for r in texts.select("run", F.substring("text", 1, 9).alias("alias")).join(aliases, "alias").select("run", "name").collect()}
    hits = cv.alias_hits(aliases, texts)
    found = {tuple(r) for r in hits.collect()}
    assert want <= found and len(want) > 900
    values = {r.alias: r.name for r in aliases.collect()}
    inside = {(r.run, values[r.text[k:k + 9]]) for r in texts.collect() for k in range(len(r.text) - 8) if r.text[k:k + 9] in values}
    assert found == inside


def test_no_text_is_shuffled(spark):
    """Between the texts and the needles goes what stands around a hit: no exchange carries a text, no needle list is broadcast whole."""
    texts = spark.createDataFrame([(k, f"{k} " + "filler " * 2000 + "needle in it") for k in range(50)], "run int, text string")
    needles = spark.createDataFrame([("needle in it",), ("absent one",)], "name string")
    found = ct.pairs(texts, "text", needles, "name", carry=("run",))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 50 and "NestedLoop" not in plan and "Cartesian" not in plan
    sides = [line for line in plan.splitlines() if "Exchange" in line and "text#" in line]
    assert sides == []

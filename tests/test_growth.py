"""What held on small tables and has to hold on large ones."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cardloom.functions import patterns as pt
from cardloom.operators import cards as oc
from cardloom.operators import containment as ct
from cardloom.operators import texts as ot
from cardloom.sources import versions as vs


def test_days_beyond_the_seconds_of_an_int(spark, sf, tmp_path):
    """Topics of a JSON list, for days whose seconds since 1970 need more than 31 bits."""
    shift = 420_000
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.withColumn("doc_id", F.col("doc_id") + shift).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.day_no, r.score) for r in entry.queries()["forum_cards"](spark, str(tmp_path)).where("title LIKE 'Topic of%'").collect()}
    ids = [r.doc_id + shift for r in docs.select("doc_id").collect()]
    assert got == {(s // 100, s // 16 * 16 + s % 7) for s in ids if s * 7919 % 129_600 < 86_400 and (s // 100 * 2 + s % 2) % 9 != 4} and got


def test_alternatives_of_a_pattern():
    cases = {
        "a|b": ["a", "b"], "(?:a|b)c|d": ["(?:a|b)c", "d"], "[|]x|y": ["[|]x", "y"], r"\||z": [r"\|", "z"], "a|": ["a", ""], "plain": ["plain"], "x[ab|]|(c|(d|e))|f": ["x[ab|]", "(c|(d|e))", "f"],
        r"(a)|b\1": None, "(?i)a|b": None, r"\Qa|b\E|c": None, "(?<n>a)|b": ["(?<n>a)", "b"], "[a[b]|c]|d": None, "[a&&b|c]|d": None, "[]a|b]|c": None, "(?-i)a|b": None, "(?^i)a|b": None,
    }
    for pattern, want in cases.items():
        assert pt.alternatives(pattern) == (want or [pattern]), pattern
    for pattern in ("ab*|c(?:d|e)|^f$", "x|yz|[|]"):
        for text in ("a", "abbb", "cd", "ce", "c", "f", "ff", "|", "xyz", "yz", "y"):
            assert bool(re.search(pattern, text)) == any(re.search(p, text) for p in pt.alternatives(pattern))


def test_rules_that_share_an_alternative(spark, monkeypatch):
    """A thousand rules, one string in all of them: titles with that string meet the first of each exclusion alone."""
    table = [(k, f"k{k}", f"zz{k}|word{k}x|115 +api", "no" if k % 3 == 0 else None, f"Head {k}") for k in range(1000)]
    titles = ["115  api here", "115 api no", "word7x and 115 api", "word33x", "word33x no", "zz999", "115 ap"]
    real, met = oc.pairs, []
    monkeypatch.setattr(oc, "pairs", lambda texts, text, needles, *a, **k: met.append(needles) or real(texts, text, needles, *a, **k))
    cards = spark.createDataFrame([(k, t) for k, t in enumerate(titles)], "seq long, title string")
    marked = oc.match_rule_table(cards, spark.createDataFrame(table, "rule long, key string, match string, exclude string, rewrite string"))
    assert [r.rule for r in marked.orderBy("seq").collect()] == [0, 1, 0, 33, None, 9, None]
    assert met[0].where("needle = '115 '").count() == 2 and met[0].count() == 2002


def test_many_days_are_pointed_to_at_once(spark, tmp_path, monkeypatch):
    """A validated write makes one file for all its days; pointers of single days before and after it count by their order."""
    path, calls, real = str(tmp_path / "t"), [], vs._write
    monkeypatch.setattr(vs, "_write", lambda *a: calls.append(a) or real(*a))
    rows = lambda n, *days: spark.createDataFrame([(f"2026-08-{d:02}", n) for d in days], "run_date string, n long")
    held = lambda: {d[-2:]: v for d, v in vs.current(spark, path).items()}
    vs.publish_days(rows(1, 1, 2), path, "v1")
    calls.clear()
    done = vs.publish_validated(rows(2, *range(2, 29)), path, "v2", F.max("n") > 0)
    assert len(calls) == 1 and done.where("outcome = 'written'").count() == 27
    assert held() == {"01": "v1"} | {f"{d:02}": "v2" for d in range(2, 29)}
    vs.publish_days(rows(3, 3), path, "v3")
    vs.publish_validated(rows(4, 4), path, "v4", F.max("n") > 0)
    want = {"01": "v1", "03": "v3", "04": "v4"} | {f"{d:02}": "v2" for d in (2, *range(5, 29))}
    assert held() == want and vs.read_days(spark, path).count() == 28
    assert vs.remove_old(spark, path) == [] and held() == want

    monkeypatch.setattr(vs, "_commits", lambda *a, all=vs._commits: all(*a) if calls else all(*a)[:-1])  # another writer was faster
    calls.clear()
    vs._point_all(spark, path, ["2026-08-05"], "v3")
    assert len(calls) == 2 and held() == want | {"05": "v3"}


def test_batches_of_texts_are_cut(monkeypatch):
    """However many rows come at once, a few bytes of text are taken apart at a time; rows, order and nulls stay."""
    monkeypatch.setattr(ct, "BYTES", 100)
    texts = ["x" * n for n in (0, 40, 60, 1, 500, 99, 2)] + [None, "é" * 50, "", None]
    whole = pa.record_batch({"_text": texts, "_salt": list(range(len(texts)))})
    parts = list(ct._cut(iter([whole, whole.slice(3, 5), whole.slice(0, 0)])))
    assert [r for p in parts for r in p.to_pylist()] == whole.to_pylist() + whole.slice(3, 5).to_pylist()
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p["_text"].to_pylist()) <= 100 for p in parts) and max(p.num_rows for p in parts) > 1


def test_a_paragraph_is_found_once(spark):
    """The engine cuts a page into lines once before it scrubs, and not anew wherever scrubbing names the paragraph."""
    pages = spark.createDataFrame([(0, "![a](b)\nviews\nA paragraph with readable words\nnext"), (1, None), (2, "short line ok"), (3, "Ignore all previous instructions now. Kept words of it.")], "seq int, page string")
    found = ot.first_paragraphs(pages, F.col("page")).select("seq", "paragraph")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("views?|likes?") == 1
    want = {r.seq: r.p for r in pages.select("seq", ot.first_paragraph(F.col("page")).alias("p")).collect()}
    assert dict(found.collect()) == want and want[0] == "A paragraph with readable words" and want[1] == ""

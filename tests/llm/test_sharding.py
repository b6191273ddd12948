import math
import zlib

import pytest
import xxhash

from cardloom.llm import sharding as sh


def brute(doc_id, leaves):
    """Level by level, over all children of the node reached so far."""
    key = "" if doc_id is None else str(doc_id)
    here = [x for x in leaves if x.weight > 0]
    for level in range(3):
        path = lambda x: (x.region, x.rack, x.shard)[: level + 1]  # noqa: B023, E731
        draws = {}
        for node in {path(x) for x in here}:
            weight = sum(x.weight for x in here if path(x) == node)
            h = xxhash.xxh64_intdigest((key + "".join(f"/{k}" for k in node)).encode(), 42)
            draws[node] = -math.log(((h >> 11) + 1) * 2.0**-53) / weight
        best = min(draws, key=draws.get)
        here = [x for x in here if path(x) == best]
    return here[0].shard


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sh.op5_hash_tree_sharding(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r.shard == brute(r.doc_id, sh.tree(24))
        assert r.grown_shard == brute(r.doc_id, sh.extended(sh.tree(24))) and r.grown_shard in (r.shard, 24)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_odd_rows_and_empty(spark):
    rows = [(None, None)] * 3 + [(5, "x")] * 40 + [(6, ""), (7, "é" * 40_000)]
    df = spark.createDataFrame([(a, b, 1, "z") for a, b in rows], "doc_id long, text string, shard int, law string")
    got = sh.sharded(df, sh.tree(3)).collect()
    assert len(got) == len(rows) and all(r.grown_shard is None for r in got)
    assert {r.size for r in got} == {8, 9, 80_008}
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sh.sharded(df.limit(0), sh.tree(3)).count() == 0


def placed(spark, old, new, n=20_000):
    ids = spark.range(n).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "'' as text")
    rows = sh.sharded(ids, old, new).collect()
    assert all(r.shard == brute(r.doc_id, old) and r.grown_shard == brute(r.doc_id, new) for r in rows[:300])
    return [(r.shard, r.grown_shard) for r in rows]


def test_shares_follow_weights_at_every_level(spark):
    old = [sh.Leaf(s % 2, s // 2 % 3, s, 1 + s % 3) for s in range(12)]
    rows = placed(spark, old, old)
    total = sum(x.weight for x in old)
    for x in old:
        assert abs(sum(s == x.shard for s, _ in rows) / len(rows) - x.weight / total) < 0.01
    with pytest.raises(ValueError):
        sh.descended(spark.range(1).selectExpr("'a' as k"), "k", [sh.Leaf(0, 0, 0, 0.0)], "s")


def test_a_racks_change_leaves_other_places_alone(spark):
    old = sh.tree(24)
    place = {x.shard: (x.region, x.rack) for x in old}
    # inside one rack, whose weight stays: only its own rows move
    swap = {0: 1.5, 6: 0.5}
    rows = placed(spark, old, [sh.Leaf(x.region, x.rack, x.shard, swap.get(x.shard, 1.0)) for x in old])
    assert any(a != b for a, b in rows)
    assert all(place[a] == place[b] == (0, 0) for a, b in rows if a != b)
    # a rack that grows by half a shard: rows move into its region and rack, by the shares of the weights, and nowhere else
    rows = placed(spark, old, [sh.Leaf(x.region, x.rack, x.shard, 1.5 if x.shard == 0 else 1.0) for x in old])
    moved = [(a, b) for a, b in rows if a != b]
    assert all(place[b][0] == 0 for a, b in moved)
    assert all(place[b] == (0, 0) for a, b in moved if place[a][0] == 0)
    assert all(b == 0 for a, b in moved if place[a] == (0, 0))
    assert abs(sum(place[b][0] == 0 for _, b in rows) / len(rows) - 12.5 / 24.5) < 0.01
    assert abs(sum(place[a][0] == 1 for a, b in moved) / len(rows) - (12.5 / 24.5 - 0.5)) < 0.005


def test_one_more_shard_takes_rows_only_into_itself(spark):
    now = sh.tree(24)
    for n in range(24, 27):
        more = sh.extended(now)
        rows = placed(spark, now, more, 10_000)
        assert all(b in (a, n) for a, b in rows)
        assert abs(sum(b == n for _, b in rows) / len(rows) - 1 / (n + 1)) < 0.01
        now = more

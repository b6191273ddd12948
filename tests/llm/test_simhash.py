import re

import xxhash
from pyspark.sql import functions as F

from cardloom.llm import simhash
from cardloom.llm.components import connected_components


def brute_mix(h, kind):
    """The hash for the fingerprint of another kind, in plain integers."""
    m = (1 << 64) - 1
    h = h + kind & m
    h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD & m
    h = (h ^ h >> 29) * 0xC4CEB9FE1A85EC53 & m
    return h ^ h >> 32


def brute_fp(text, k=3, kind=0):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    hs = [brute_mix(h, kind) for h in hs] if kind else hs
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute(docs, prints=1):
    """Groups over links of any kind of fingerprint."""
    fps = {d: brute_fp(t) for d, t in docs}
    more = {d: [brute_fp(t, kind=kind) for kind in range(1, prints)] for d, t in docs}
    out = {}
    for d in fps:
        if d in out:
            continue
        seen, todo = {d}, [d]
        while todo:
            x = todo.pop()
            for y in fps:
                if y not in seen and any((a ^ b).bit_count() <= 3 for a, b in zip([fps[x], *more[x]], [fps[y], *more[y]], strict=True)):
                    seen.add(y)
                    todo.append(y)
        out |= dict.fromkeys(seen, min(seen))
    return {d: (f"{fps[d]:016x}", out[d]) for d in fps}


def test_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op2_simhash_near_dedup(spark, sf).collect()}
    assert got == brute(docs)


def test_odd_texts_and_extra_columns(spark):
    docs = [(1, None), (2, ""), (3, "  \t\n"), (4, "one"), (5, "One"), (6, "one two"), (7, "a b c " * 30_000), (8, "A b\tc " * 30_000), (9, "ü ö ä é")]
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in docs], "doc_id long, text string, fp string, component int")
    got = {r.doc_id: (f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in simhash.near_duplicate_groups(df).collect()}
    assert got == brute(docs)
    assert simhash.near_duplicate_groups(df.limit(0)).count() == 0


def test_links_of_flipped_bits(spark):
    import random

    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = {b for b in base} | {b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randint(1, 4))) for b in base for _ in range(12)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    found = {r.node: r.component for r in connected_components(simhash.near_links(spark.createDataFrame(signed, "fp long"))).collect()}
    label = {x: {x} for x in fps}
    for x in fps:
        for y in fps:
            if x != y and (x ^ y).bit_count() <= 3 and label[x] is not label[y]:
                both = label[x] | label[y]
                for z in both:
                    label[z] = both
    as_signed = lambda v: v - (1 << 64) if v >> 63 else v
    want = {as_signed(x): min(map(as_signed, g)) for x, g in label.items() if len(g) > 1}
    assert found == want


def test_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert connected_components(edges).where("component <> 0").count() == 0
    assert connected_components(edges).count() == 61


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "only here, with other words"), (3, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicate_groups(df).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (None, None), (3, 3)], key=str)


def test_more_fingerprints_link_more(spark):
    """Rows are one group if any kind of fingerprint links them; groups over several kinds by brute force."""
    import random

    import pyarrow as pa

    rnd = random.Random(5)
    base = [[rnd.choice("abcdefghijklmnop") + str(rnd.randint(0, 60)) for _ in range(150)] for _ in range(12)]
    docs = []
    for words in base:
        for _ in range(6):
            copy = list(words)
            for i in rnd.sample(range(150), rnd.randint(0, 6)):
                copy[i] = f"z{rnd.randint(0, 999)}"
            docs.append((len(docs), " ".join(copy)))
    docs += [(200, None), (201, ""), (None, docs[3][1]), (3, docs[3][1])]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, fp1 string")
    sizes = []
    for prints in (1, 2, 3):
        fps = simhash.fingerprints_of(pa.chunked_array([[t for _, t in docs]]), 3, prints)
        group = list(range(len(docs)))
        for i in range(len(docs)):
            for j in range(i):
                if any((int(f[i]) ^ int(f[j])).bit_count() <= 3 for f in fps) and group[i] != group[j]:
                    low, high = sorted((group[i], group[j]))
                    group = [low if g == high else g for g in group]
        least = {g: min((docs[i][0] for i in range(len(docs)) if group[i] == g and docs[i][0] is not None), default=None) for g in group}
        want = sorted((str(docs[i][0]), least[group[i]]) for i in range(len(docs)))
        assert sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicate_groups(df, prints=prints).collect()) == want
        sizes.append(len(set(group)))
    assert sizes[0] > sizes[1] >= sizes[2]

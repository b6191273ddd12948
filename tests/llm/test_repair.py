import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from cardloom.llm import repair as rp

LANGUAGE = re.compile(r"(s?(ua)+)?")


def exhaustive(kinds):
    """Every edit script with up to two insertions at each place."""
    inserts = [("I" * n, "".join(p)) for n in range(3) for p in itertools.product("ua", repeat=n)]
    best = None
    choices = []
    for must_go, cut, initial in kinds:
        edits = [("D", "", 4)]
        if not must_go:
            edits += [("K", initial or "?", 3 * cut)] + [("R", r, 3 + 3 * cut) for r in "ua"]
        choices.append([(i + e, ri + re_, 3 * len(i) + c) for i, ri in inserts for e, re_, c in edits])
    for script in itertools.product(*choices, [(i, r, 3 * len(i)) for i, r in inserts]):
        if LANGUAGE.fullmatch("".join(s[1] for s in script)):
            found = (sum(s[2] for s in script), "".join(s[0] for s in script))
            best = min(best, found) if best else found
    return best


def by_rows(kinds):
    """One row after the other, with whole audits; what a prefix needs next is read off its last two initials."""
    step = lambda s, r: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((s, r))

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for s, (c, a) in list(out.items()):
                for r in "ua":
                    if (t := step(s, r)) and (t not in out or (c + 3, a + "I") < out[t]):
                        out[t] = (c + 3, a + "I")
        return out

    # insertions that return to their state are never the cheapest
    now = {"": (0, "")}
    for must_go, cut, initial in kinds:
        later = {}

        def put(s, c, a, later=later):
            if s is not None and (s not in later or (c, a) < later[s]):
                later[s] = (c, a)

        for s, (c, a) in inserted(now).items():
            put(s, c + 4, a + "D")
            if not must_go:
                put(step(s, initial), c + 3 * cut, a + "K")
                for r in "ua":
                    put(step(s, r), c + 3 + 3 * cut, a + "R")
        now = later
    return min(v for s, v in inserted(now).items() if s in ("", "a"))


def some_kinds(rng, n):
    return [(rng.random() < 0.2, rng.random() < 0.3, rng.choice(["s", "u", "u", "a", "a", ""])) for _ in range(n)]


def clean(kinds):
    return [(g, c and not g, i) for g, c, i in kinds]


def test_agenda_against_all_scripts():
    rng = random.Random(3)
    for n in [0, 1, 1, 1, 2, 2, 2, 2, 2, 2, 3, 3, 3, 3]:
        kinds = clean(some_kinds(rng, n))
        assert rp.lightest_repair([rp.piece_items(kinds)]) == exhaustive(kinds) == by_rows(kinds), kinds


def test_long_runs_in_pieces():
    rng = random.Random(5)
    for n in [4, 7, 8, 30, 63, 64, 65, 200, 500]:
        kinds = clean(some_kinds(rng, n))
        want = by_rows(kinds)
        cuts = sorted([0, n, *(rng.randrange(n + 1) for _ in range(3))])
        assert rp.lightest_repair([rp.piece_items(kinds[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]) == want
        assert rp.lightest_repair([rp.row_items(*k) for k in kinds]) == want
        assert LANGUAGE.fullmatch("".join(r[0] for r, _ in rp.replayed(want[1], [k[2] or "x" for k in kinds], [""] * n)[0]))


def test_agenda_ends_at_the_goal():
    popped = []

    def deduced(item, cost, audit, final):
        popped.append(item)
        if item[0] < 50:
            yield (item[0] + 1,), 1, cost + 1, audit + "x"

    found = rp.lightest([((0,), 1, 0, "")], deduced, (3,))
    assert found[(3,)] == (3, "xxx") and len(popped) == 3


def brute(rows):
    """The digest columns of one conversation's damaged rows [(turn, role, text)], in order."""
    sp = " \t\n\x0b\x0c\r"
    seen, kinds, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        fault = 0 if not text.strip(sp) else 1 if (role, text) in seen else 2 if text.strip(sp)[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        kinds.append((fault in (0, 1), fault == 2, role[:1] if role[:1] in tuple("sua") else ""))
    cost, audit = by_rows(kinds)
    at, last, lines = 0, "", []
    for e in audit:
        if e != "D":
            name = "user" if last in ("", "s", "a") else "assistant"
            lines.append({"K": f"{rows[at][1]}:{rows[at][2]}" if e == "K" else "", "R": f"{name}:{rows[at][2]}" if e == "R" else "", "I": f"{name}:"}[e])
            last = lines[-1][0]
        at += e != "I"
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def python_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        mine += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def compared(spark, df, gone=True):
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    want = {}
    for conv, mine in python_damage(rows).items():
        # equal turns: by role, then by the engine's hash of the text
        texts = {t: h for t, h in spark.createDataFrame([(m[2],) for m in mine], "t string").select("t", F.xxhash64("t")).collect()} if len({m[0] for m in mine}) < len(mine) else {}
        want[conv] = brute(sorted(mine, key=lambda m: (m[0] is not None, m[0] or 0, m[1], texts.get(m[2], 0))))
    got = {}
    for r in rp.report(rp.repaired(rp.damaged(df), gone=F.col("gone"))).collect():
        assert r.conv_id not in got
        got[r.conv_id] = tuple(r)[1:]
    assert got == want
    return got


def test_query(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    got = compared(spark, df)
    rows = {r.conv_id: tuple(r)[1:] for r in rp.op11_lightest_repair(spark, sf).collect()}
    assert rows == got
    assert sum(r[5] for r in got.values()) > 0


def test_odd_rows_hot_conversation_and_empty(spark):
    rng = random.Random(9)
    schema = "conv_id long, turn long, role string, text string, piece string, audit int, whole string, cut string"
    texts = ["Yes.", "Yes.", "no", " \t", "", None, "Why?", "é!", "x" * 50_000 + ".", "a. "]
    rows = [(7, t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "Ua"]), rng.choice(texts) if rng.random() < 0.5 else f"t{t}.") for t in range(1500)]
    rows += [(None, None, None, None), (None, None, "user", "a."), (None, 4, "user", "a.")]
    rows += [(3, 1, "user", "same.")] * 400 + [(4, None, "user", "n.")] * 3
    rows += [(k, t, r, f"{r} {k}.") for k in range(100, 140) for t, r in enumerate(["system", "user", "assistant"])]
    rows += [(900, -(2**63), "user", "far."), (900, 2**63 - 1, "assistant", "off.")]
    df = spark.createDataFrame([(*r, "p", 1, "w", "c") for r in rows], schema)
    got = compared(spark, df.where("conv_id IS NULL OR conv_id <> 900"))
    assert len(got) == 44 and len(got[7][6]) >= 1400
    far = {r.conv_id: r for r in rp.report(rp.repaired(df.where("conv_id = 900"))).collect()}[900]
    assert (far.gaps, far.cost, far.audit) == (2**63 - 1, 0, "KK")
    assert rp.report(rp.repaired(df.limit(0))).count() == 0
    none = rp.report(rp.repaired(df.where("conv_id = 100"), gone=F.lit(True))).collect()
    assert [tuple(r) for r in none] == [(100, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_pieces_hold_the_turns(spark):
    df = spark.createDataFrame([("c", t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(999)], "conv_id string, turn int, role string, text string")
    pieces = rp.repaired(df).orderBy("piece").collect()
    assert len(pieces) > 1 and not any(p.whole for p in pieces)
    turns = [t for p in pieces for t in p.turns]
    assert [t.text for t in turns] == [f"{t}." for t in range(999)] + [""] and turns[-1].role == "assistant"
    assert "".join(p.audit for p in pieces) == "K" * 999 + "I" and [p.cost for p in pieces] == [3] + [0] * (len(pieces) - 1)

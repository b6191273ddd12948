"""Conversation structure repair by Knuth's lightest-derivation agenda.

The role initials of a repaired conversation match ``(s?(ua)+)?``, a regular language of four states. Items of
the deduction system say that a run of rows can be edited so that it takes the automaton from one state to
another; the value of an item is (cost, audit), the audit being the initials of the edits. Deductions:

* inside a row: nothing is inserted yet (axiom); an item with insertions takes one more (Insert, 3); an item with
  insertions and the row's own edit (Keep 0, Rerole 3, Delete 4; a truncated row that stays adds 3) is the row's;
* hyperedges with two antecedents: the items of two neighbouring runs that meet in a state are one of the run of both;
* the end of the conversation is a run of its own, which inserts what is left to an accepting state.

Runs are those of a balanced tree over the rows. An item is popped off the agenda in order of (cost, rows of its
run, audit) and then final. All functions are superior: a deduction doesn't lower the cost and has more rows than each
antecedent, or costs more. They are monotone: two derivations of one item that cost the same have audits of which neither
begins the other (what it adds could only be insertions, which cost), so the lesser stays the lesser whatever
stands before and after. The agenda ends when the goal, from the start state to the end, is popped.

Chunks of 64 rows are solved for all pairs of states and serve as leaves for longer runs; results of equal
chunks are kept. So a conversation cut into pieces over several partitions is solved piece by piece, and only
the pieces' items (16 at most, an audit each) meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, staged, tidy
from .turns import beside, conversation_runs, digests, in_order, joined

#: States: nothing yet, after s, after u, after a; END closes the conversation.
START, AFTER_S, AFTER_U, AFTER_A, END = range(5)
STEPS = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows of a chunk, and of how many chunks and conversations results are kept.
CHUNK, REMEMBERED = 64, 1 << 15
SPACE = " \t\n\x0b\x0c\r"

Items = dict[tuple[int, int], tuple[int, str]]


def lightest(axioms: Iterable[tuple[tuple, int, int, str]], deduced: Callable, goal: tuple | None = None) -> dict[tuple, tuple[int, str]]:
    """The least (cost, audit) of every item that can be deduced, or of those popped until ``goal`` is.

    axioms: (item, rank, cost, audit). ``deduced(item, cost, audit, final)`` gives the same for each deduction in which
    item is the antecedent popped last. An item's rank never changes.
    """
    final: dict[tuple, tuple[int, str]] = {}
    best: dict[tuple, tuple[int, str]] = {}
    agenda = []
    for item, rank, cost, audit in axioms:
        agenda.append((cost, rank, audit, item))
    heapify(agenda)
    while agenda:
        cost, _, audit, item = heappop(agenda)
        if item in final:
            continue
        final[item] = (cost, audit)
        if item == goal:
            break
        for made, rank, c, a in deduced(item, cost, audit, final):
            if made not in final and (made not in best or (c, a) < best[made]):
                best[made] = (c, a)
                heappush(agenda, (c, rank, a, made))
    return final


@lru_cache(maxsize=None)
def row_items(must_go: bool, truncated: bool, initial: str) -> Items:
    """A row's items: insertions before it and its edit, by the states before and after. 30 kinds of rows at most."""
    extra = TRUNCATED if truncated else 0

    def deduced(item, cost, audit, final):
        edited, q, m = item
        if edited:
            return
        for r in ROLES:
            if (m, r) in STEPS:
                yield (0, q, STEPS[m, r]), 0, cost + INSERT, audit + "I"
                if not must_go:
                    yield (1, q, STEPS[m, r]), 1, cost + REROLE + extra, audit + "R"
        if not must_go and (m, initial) in STEPS:
            yield (1, q, STEPS[m, initial]), 1, cost + KEEP + extra, audit + "K"
        yield (1, q, m), 1, cost + DELETE, audit + "D"

    final = lightest([((0, q, q), 0, 0, "") for q in range(4)], deduced)
    return {(q, m): value for (edited, q, m), value in final.items() if edited}


def end_items() -> Items:
    def deduced(item, cost, audit, final):
        done, q, m = item
        if done:
            return
        if m in (START, AFTER_A):
            yield (1, q, END), 1, cost, audit
        for r in ROLES:
            if (m, r) in STEPS:
                yield (0, q, STEPS[m, r]), 0, cost + INSERT, audit + "I"

    final = lightest([((0, q, q), 0, 0, "") for q in range(4)], deduced)
    return {(q, m): value for (done, q, m), value in final.items() if done}


def run_items(leaves: list[Items], goal: tuple[int, int] | None = None) -> Items:
    """Items of the run of all leaves: for all pairs of states, or for ``goal`` alone."""
    mate, above, is_left, width = [], [], [], []

    def node(w: int) -> int:
        mate.append(-1), above.append(-1), is_left.append(False), width.append(w)
        return len(mate) - 1

    level = [node(1) for _ in leaves]
    while len(level) > 1:
        upper = []
        for a, b in zip(level[::2], level[1::2], strict=False):
            up = node(width[a] + width[b])
            above[a] = above[b] = up
            mate[a], mate[b], is_left[a] = b, a, True
            upper.append(up)
        level = upper + level[2 * len(upper) :]
    root = level[0]

    def deduced(item, cost, audit, final):
        k, q, m = item
        if k == root:
            return
        up, other = above[k], mate[k]
        if is_left[k]:
            for r in range(5):
                if (right := final.get((other, m, r))) is not None:
                    yield (up, q, r), width[up], cost + right[0], audit + right[1]
        else:
            for p in range(4):
                if (before := final.get((other, p, q))) is not None:
                    yield (up, p, m), width[up], before[0] + cost, before[1] + audit

    axioms = [((k, q, m), 1, cost, audit) for k, items in enumerate(leaves) for (q, m), (cost, audit) in items.items() if k or goal is None or q == goal[0]]
    final = lightest(axioms, deduced, (root, *goal) if goal else None)
    return {(q, m): value for (k, q, m), value in final.items() if k == root}


Kind = tuple[bool, bool, str]


@lru_cache(maxsize=REMEMBERED)
def _chunk(kinds: tuple[Kind, ...]) -> Items:
    return run_items([row_items(*k) for k in kinds])


def piece_items(kinds: list[Kind]) -> Items:
    """Items of a piece of a conversation for all pairs of states; of no rows: that nothing changes."""
    leaves = [_chunk(tuple(kinds[k : k + CHUNK])) for k in range(0, len(kinds), CHUNK)]
    return run_items(leaves) if leaves else {(q, q): (0, "") for q in range(4)}


def lightest_repair(pieces: list[Items]) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of a conversation of these pieces, ties by the ASCII-least audit."""
    return run_items([*pieces, end_items()], (START, END))[START, END]


@lru_cache(maxsize=REMEMBERED)
def _short(kinds: tuple[Kind, ...]) -> tuple[int, str]:
    return lightest_repair([row_items(*k) for k in kinds])


def replayed(audit: str, roles: list[str], texts: list[str], state: int = START) -> tuple[list[tuple[str, str]], int]:
    """The repaired (role, text) of rows under an audit, and the state after it. The audit says all: an inserted or
    reroled row has the one role that can follow."""
    out, k = [], 0
    for edit in audit:
        if edit == "D":
            k += 1
            continue
        role, text = ("", "") if edit == "I" else (roles[k], texts[k])
        k += edit != "I"
        initial = role[:1] if edit == "K" else "a" if state == AFTER_U else "u"
        out.append((role if edit == "K" else ROLES[initial], text))
        state = STEPS[state, initial]
    return out, state


def _faults(roles: list[str], texts: list[str], blank: list[bool], cut: list[bool], known: frozenset[bytes] = frozenset()) -> tuple[list[Kind], tuple[int, int, int]]:
    """Each row's kind and the number of blank, duplicate and truncated rows; known: keys seen in pieces before."""
    seen, kinds, counts = set(), [], [0, 0, 0]
    for role, text, empty, short in zip(roles, texts, blank, cut, strict=True):
        again = (role, text) in seen or bool(known) and _key(role, text) in known
        seen.add((role, text))
        fault = 0 if empty else 1 if again else 2 if short else None
        if fault is not None:
            counts[fault] += 1
        initial = role[:1]
        kinds.append((empty or again, fault == 2, initial if initial in ("s", "u", "a") else ""))
    return kinds, tuple(counts)


def _key(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def _illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))


TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
ROWS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("blank", pa.bool_()), ("cut", pa.bool_())]))
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_COUNTS_SQL = ", ".join(f"{c} long" for c in COUNTS)
_TURNS_SQL = "turns array<struct<role: string, text: string>>"
_ROWS_SQL = "rows array<struct<turn: long, role: string, text: string, blank: boolean, cut: boolean>>"
_MOST = (1 << 63) - 1


def _gaps(low: int | None, high: int | None, distinct: int) -> int:
    return 0 if low is None else min(high - low + 1 - distinct, _MOST)


@tidy
def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations are repaired; those at a partition's edges leave as rows."""
    held: list[tuple] = []
    size = piece = 0

    def out(id_type):
        columns = list(zip(*held, strict=True))
        kinds = [id_type, pa.int64(), pa.bool_(), *[pa.int64()] * 6, pa.string(), TURNS, ROWS]
        batch = pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", "piece", "whole", *COUNTS, "audit", "turns", "rows"])
        held.clear()
        return batch

    def typed(source):
        nonlocal id_type, piece
        for batch in source:
            id_type = batch.schema.field("conv_id").type
            piece = batch.column(batch.schema.get_field_index("piece"))[0].as_py() if batch.num_rows else piece
            yield batch

    id_type = pa.null()
    for conv, rows, edge in conversation_runs(typed(batches)):
        at = [k for k, gone in enumerate(rows["gone"]) if not gone]
        turn, role, text, blank, cut = ([rows[c][k] for k in at] for c in ("turn", "role", "text", "blank", "cut"))
        if edge:
            raw = [dict(zip(("turn", "role", "text", "blank", "cut"), r, strict=True)) for r in zip(turn, role, text, blank, cut, strict=True)]
            held.append((conv, rows["piece"][0], False, *[None] * 6, None, None, raw))
        else:
            kinds, counts = _faults(role, text, blank, cut)
            cost, audit = _short(tuple(kinds)) if len(kinds) <= CHUNK else lightest_repair([piece_items(kinds)])
            turns = [{"role": r, "text": t} for r, t in replayed(audit, role, text)[0]]
            real = [t for t in turn if t is not None]
            gaps = _gaps(real[0], real[-1], len(set(real))) if real else 0
            held.append((conv, rows["piece"][0], True, gaps, *counts, _illegal(role), cost, audit, turns, None))
        size += sum(map(len, text)) + 100
        if size > 4 << 20:
            yield out(id_type)
            size = 0
    if held:
        yield out(id_type)


@tidy
def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A piece's counts, borders and items; rows and known keys in, no texts out."""
    for batch in batches:
        made = []
        for conv, piece, rows, known in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            role, text = [r["role"] for r in rows], [r["text"] for r in rows]
            kinds, counts = _faults(role, text, [r["blank"] for r in rows], [r["cut"] for r in rows], frozenset(known or ()))
            items = sorted(piece_items(kinds).items())
            real = [r["turn"] for r in rows if r["turn"] is not None]
            made.append((conv, piece, len(rows), *counts, _illegal(role), role[0][:1] if role else None, role[-1][:1] if role else None, real[0] if real else None, real[-1] if real else None, len(set(real)), [q * 8 + m for (q, m), _ in items], [c for _, (c, _) in items], [a for _, (_, a) in items]))
        if made:
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], _SUMMARY)


_SUMMARY = ["conv_id", "piece", "n", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "distinct_turns", "states", "costs", "audits"]
_SUMMARY_SQL = "piece long, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, distinct_turns long, states array<long>, costs array<long>, audits array<string>"


@tidy
def _decided(table: pa.Table) -> pa.Table:
    """The pieces of one conversation meet, without texts: each one's share of the audit and the state before it.
    Counts of the whole conversation stand at its first piece, zeros at the others."""
    rows = sorted(table.to_pylist(), key=lambda r: r["piece"])
    items = [{(s >> 3, s & 7): (c, a) for s, c, a in zip(r["states"], r["costs"], r["audits"], strict=True)} for r in rows]
    cost, audit = lightest_repair(items)
    totals = [sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal")]
    full = [r for r in rows if r["n"]]
    totals[3] += sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(full, full[1:], strict=False))
    dated = [r for r in rows if r["low"] is not None]
    distinct = sum(r["distinct_turns"] for r in dated) - sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:], strict=False))
    gaps = _gaps(dated[0]["low"], dated[-1]["high"], distinct) if dated else 0
    begin, state, out = 0, START, []
    for k, r in enumerate(rows):
        end, left = begin, r["n"]
        while left:
            left -= audit[end] != "I"
            end += 1
        share = audit[begin:end]
        # all roles follow from the state before and the audit, so one state after it has this audit
        after = next(m for (q, m), (_, a) in items[k].items() if q == state and a == share)
        out.append((r["conv_id"], r["piece"], *([gaps, *totals, cost] if k == 0 else [0] * 6), audit[begin:] if k == len(rows) - 1 else share, state))
        begin, state = end, after
    kinds = [table.schema.field("conv_id").type, pa.int64(), *[pa.int64()] * 6, pa.string(), pa.int64()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "piece", *COUNTS, "audit", "state"])


@tidy
def _replays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        columns = [batch.column(k) for k in range(len(names) - 1)]
        turns = []
        for audit, state, rows in zip(batch.column(names.index("audit")).to_pylist(), batch.column(names.index("state")).to_pylist(), batch.column(names.index("rows")).to_pylist(), strict=True):
            turns.append([{"role": r, "text": t} for r, t in replayed(audit, [r["role"] for r in rows], [r["text"] for r in rows], state)[0]])
        keep = [k for k, n in enumerate(names[:-1]) if n != "state"]
        yield pa.record_batch([*[columns[k] for k in keep], pa.array(turns, TURNS)], [*[names[k] for k in keep], "turns"])


def repaired(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone: Column | None = None) -> DataFrame:
    """The cheapest repair of every conversation: (conv_id, piece, whole, gaps, blank, duplicate, truncated, illegal,
    cost, audit, turns: the repaired (role, text) in order).

    A conversation is one row, or, where it went over several partitions (``whole`` is false then, and also
    for others at a partition's edge), a row for each piece: audits and turns of its pieces follow
    each other by ``piece``, counts stand at the first. Rows are taken by turn, null turns first, equal turns by role, then by
    a hash of the text; a null conversation id is one conversation. A null role or text is one
    space. A row's first fault counts: blank, duplicate (its role and text were there before), truncated (it
    doesn't end with . ! or ?). A role that doesn't begin with s, u or a, an empty one too, can't be
    kept. ``gaps`` above a long's range is its greatest. Rows where ``gone`` is true only keep their conversation in
    the result: one without other rows has zeros, an empty audit and no turns. Other columns are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(" "))
    core = F.rtrim(text, F.lit(SPACE))
    rows = conversations.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"), text.alias("text"),
        (core == "").alias("blank"), (~F.substring(core, -1, 1).isin(".", "!", "?")).alias("cut"), (F.lit(False) if gone is None else gone).alias("gone"),
    )
    kind = rows.schema["conv_id"].dataType.simpleString()
    dealt = in_order(rows).withColumn("piece", F.spark_partition_id().cast("long"))
    first = staged(dealt.mapInArrow(_solved, f"conv_id {kind}, piece long, whole boolean, {_COUNTS_SQL}, audit string, {_TURNS_SQL}, {_ROWS_SQL}"), "repairs")
    whole = first.where("whole").drop("rows")
    # at most two conversations a partition from here on
    edges = first.where("NOT whole").select("conv_id", "piece", "rows")
    # the key of a row is its SHA-256, as _key() has it
    one = edges.select("conv_id", "piece", F.explode("rows").alias("r")).select("conv_id", "piece", F.unhex(F.sha2(F.concat(F.length("r.role").cast("string"), F.lit(":"), "r.role", "r.text"), 256)).alias("key"))
    before = one.groupBy("conv_id", "key").agg(F.min("piece").alias("first"), F.collect_set("piece").alias("pieces"))
    later = before.select("conv_id", "key", "first", F.explode("pieces").alias("piece")).where("piece > first").groupBy("conv_id", "piece").agg(F.collect_list("key").alias("known"))
    known = beside(edges, later, ("conv_id", "piece"), "left").select("conv_id", "piece", "rows", "known")
    items = known.mapInArrow(_summaries, f"conv_id {kind}, {_SUMMARY_SQL}")
    decided = staged(items.groupBy("conv_id").applyInArrow(_decided, f"conv_id {kind}, piece long, {_COUNTS_SQL}, audit string, state long"), "repairs")
    shares = beside(decided, edges, ("conv_id", "piece")).select("conv_id", "piece", F.lit(False).alias("whole"), *COUNTS, "audit", "state", "rows")
    return whole.unionByName(shares.mapInArrow(_replays, whole.schema))


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with known faults, by crc32("conv_id:turn") % 20: 0 drops the row, 1 empties
    its text, 2 takes . ! and ? out, 3 repeats it, 4 makes its role user. Nulls count as one space, in the key too.
    Dropped rows stay, marked ``gone``."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).cast("int").alias("_fault"))
    fault = F.col("_fault")
    rows = rows.withColumn("text", F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))).withColumn("role", F.when(fault == 4, "user").otherwise(F.col("role")))
    times = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", "role", "text", (fault == 0).alias("gone"), times.alias("_time")).drop("_time")


def report(pieces: DataFrame) -> DataFrame:
    """A row for each conversation: its counts, whole audit and repaired_sha256, over its ``role:text`` joined by line feeds."""
    lines = lambda sep: F.array_join(F.transform("turns", lambda t: F.concat(*sep, t["role"], F.lit(":"), t["text"])), "" if sep else "\n")
    whole = pieces.where("whole").select("conv_id", *COUNTS, "audit", F.sha2(lines([]), 256).alias("repaired_sha256"))
    parts = pieces.where("NOT whole").select("conv_id", "piece", *COUNTS, "audit", lines([F.lit("\n")]).alias("body"))
    totals = parts.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in COUNTS], joined(parts, "audit").alias("audit"))
    hashes = digests(parts, {"repaired_sha256": "body"}, skip=1)
    return whole.unionByName(beside(totals, hashes))


def op11_lightest_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return report(repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), gone=F.col("gone")))


QUERIES = {"op11_lightest_repair": op11_lightest_repair}
ORACLES: dict[str, str] = {}

"""Chat formatting: a finite-state machine over roles and a declarative template.

A ``Template`` says how a turn is written, segment by segment, and which segments count for the loss. Control
strings of the template inside a text or a role get a backslash before them, and so does a backslash; reading back
takes every pair of a backslash and a character for the character. A text can't end or open a turn, therefore, and
``read_back`` gives each role and text exactly.

A ``Machine`` says which role may follow which. It marks conversations whose turns break that order, and where; they
are formatted all the same, and the caller decides.

A conversation that reaches over several partitions is formatted in pieces; each piece has the machine's moves from every
state, so the pieces' moves compose to those of the conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, staged, tidy
from .turns import beside, conversation_runs, digests, in_order

ROLE, TEXT = "{role}", "{text}"
ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """A turn is its ``segments`` in order: plain text, ROLE or TEXT, each with the roles for which it counts for the loss."""

    segments: tuple[tuple[str, frozenset[str]], ...] = (
        ("### ", frozenset()),
        (ROLE, frozenset()),
        (": ", frozenset()),
        (TEXT, frozenset({"assistant"})),
        (" </turn>\n", frozenset()),
    )
    #: How roles are written; others stand as they are, after "=".
    names: tuple[tuple[str, str], ...] = (("system", "System"), ("user", "User"), ("assistant", "Assistant"))
    #: What gets a backslash inside texts and inside roles; one of them has to be in the plain segment that follows.
    text_controls: tuple[str, ...] = ("###", "</turn>")
    role_controls: tuple[str, ...] = ("###", ":")

    def __post_init__(self):
        kinds = [s for s, _ in self.segments]
        if kinds.count(ROLE) != 1 or kinds.count(TEXT) != 1:
            raise ValueError("a turn has one role and one text")
        for kind in (ROLE, TEXT):
            after = self.after(kind)
            if not any(c in after for c in self.controls(kind)):
                raise ValueError("a plain segment with a control string must follow the role and the text")
            for c in self.controls(kind):
                if c[:1] in ("", ESCAPE) or any(after.startswith(c[k:]) for k in range(1, len(c))):
                    raise ValueError(f"the control string {c!r} is empty, begins with a backslash or may end in the segment after it")

    def controls(self, kind: str) -> tuple[str, ...]:
        return self.text_controls if kind == TEXT else self.role_controls

    def after(self, kind: str) -> str:
        """The plain segment after a role or a text."""
        kinds = [s for s, _ in self.segments]
        k = kinds.index(kind) + 1
        return "" if k == len(kinds) or kinds[k] in (ROLE, TEXT) else kinds[k]

    def lead(self, kind: str) -> int:
        """How much of that segment stands before its first control string."""
        return min(p for c in self.controls(kind) if (p := self.after(kind).find(c)) >= 0)

    def escaped(self, kind: str, part: str) -> str:
        return _control(self.controls(kind)).sub(r"\\\g<0>", part)


_PAIR = re.compile(r"\\(.)", re.S)


@lru_cache(maxsize=64)
def _control(controls: tuple[str, ...]) -> re.Pattern:
    """Every character that gets a backslash: one itself, and the first of each control string, overlapping ones too."""
    return re.compile(rf"\\|(?=(?:{'|'.join(map(re.escape, controls))}))[{re.escape(''.join(sorted({c[0] for c in controls})))}]")


@lru_cache(maxsize=64)
def _turn(template: Template) -> re.Pattern:
    """A formatted turn. A role or text runs over escaped pairs and all that begins no control string; the runs are
    possessive, so reading is linear. The lead of the segment that follows can't be told from it and is taken off later."""
    out, lead = "", 0
    for kind, _ in template.segments:
        if kind in (ROLE, TEXT):
            controls = template.controls(kind)
            first = re.escape("".join(sorted({c[0] for c in controls})))
            out += rf"((?:[^\\{first}]++|\\.|(?!{'|'.join(map(re.escape, controls))})[{first}])*+)"
            lead = template.lead(kind)
        else:
            out += re.escape(kind[lead:])
            lead = 0
    return re.compile(out, re.S)


@dataclass(frozen=True)
class Machine:
    """Roles that may follow each state; a state is the role before, "" at the start. A conversation may end in ``ends``."""

    moves: tuple[tuple[str, tuple[str, ...]], ...] = (("", ("system", "user")), ("system", ("user",)), ("user", ("assistant",)), ("assistant", ("user",)))
    ends: frozenset[str] = field(default=frozenset({"assistant"}))

    @property
    def states(self) -> list[str]:
        return [s for s, _ in self.moves]

    def run(self, roles: list[str], state: str = "") -> tuple[str | None, int | None]:
        """The state after these roles, or None and the place of the first that may not come."""
        after = dict(self.moves)
        for k, role in enumerate(roles):
            if role not in after.get(state, ()):
                return None, k
            state = role
        return state, None


def format_turns(template: Template, roles: list[str], texts: list[str]) -> tuple[str, list[tuple[int, bool]]]:
    """The formatted turns, and their segments as (code points, whether they count for the loss), neighbours that agree as one."""
    names = dict(template.names)
    out: list[str] = []
    segments: list[list] = []
    for role, text in zip(roles, texts, strict=True):
        for kind, loss in template.segments:
            part = template.escaped(TEXT, text) if kind == TEXT else kind if kind != ROLE else names[role] if role in names else "=" + template.escaped(ROLE, role)
            out.append(part)
            flag = role in loss
            if segments and segments[-1][1] == flag:
                segments[-1][0] += len(part)
            else:
                segments.append([len(part), flag])
    return "".join(out), [(n, flag) for n, flag in segments]


def read_turns(template: Template, whole: str) -> list[tuple[str, str]]:
    """The (role, text) of formatted turns; anything else is an error."""
    turn = _turn(template)
    names = {shown: role for role, shown in template.names}
    order = [k for k, _ in template.segments if k in (ROLE, TEXT)]
    lead = {kind: template.lead(kind) for kind in order}
    out, at = [], 0
    while at < len(whole):
        found = turn.match(whole, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        parts = {kind: found[k + 1][: len(found[k + 1]) - lead[kind]] for k, kind in enumerate(order)}
        role = parts[ROLE]
        role = _PAIR.sub(r"\1", role[1:]) if role.startswith("=") else names[role]
        out.append((role, _PAIR.sub(r"\1", parts[TEXT])))
        at = found.end()
    return out


def loss_text(whole: str, segments: list[tuple[int, bool]]) -> str:
    """What stands under the loss mask, unescaped."""
    out, at = [], 0
    for n, flag in segments:
        if flag:
            out.append(_PAIR.sub(r"\1", whole[at : at + n]))
        at += n
    return "".join(out)


SEGMENTS = pa.list_(pa.struct([("chars", pa.int64()), ("loss", pa.bool_())]))
MOVES = pa.list_(pa.struct([("state", pa.string()), ("fault", pa.int64())]))


def formatted(conversations: DataFrame, template: Template | None = None, machine: Machine | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, piece, whole, n_turns, formatted, segments: array of (chars, loss), moves) for every conversation.

    One row for a conversation, or for each piece of one that goes over several partitions (``whole`` is false then, and for
    others at a partition's edge); pieces follow each other by ``piece``. Rows are taken by turn, null turns first,
    equal turns by role, then by a hash of the text; repeated rows stay. A null text or role is empty, a null id one
    conversation. ``moves``: for each of the machine's states, the state after the piece's turns, or null and the place
    of the first turn that may not come. Other columns are ignored.
    """
    template, machine = template or Template(), machine or Machine()
    rows = conversations.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, id_type = 0, pa.null()

        def typed():
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field("conv_id").type
                yield batch

        def out():
            kinds = [id_type, pa.int64(), pa.bool_(), pa.int64(), pa.string(), SEGMENTS, MOVES]
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], ["conv_id", "piece", "whole", "n_turns", "formatted", "segments", "moves"])
            held.clear()
            return batch

        for conv, columns, edge in conversation_runs(typed()):
            text, segments = format_turns(template, columns["role"], columns["text"])
            moves = [dict(zip(("state", "fault"), machine.run(columns["role"], s), strict=True)) for s in machine.states]
            held.append((conv, columns["piece"][0], not edge, len(columns["role"]), text, [{"chars": n, "loss": f} for n, f in segments], moves))
            size += len(text) + 100
            if size > 4 << 20:
                yield out()
                size = 0
        if held:
            yield out()

    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, piece long, whole boolean, n_turns long, formatted string, segments array<struct<chars: long, loss: boolean>>, moves array<struct<state: string, fault: long>>"
    return in_order(rows).withColumn("piece", F.spark_partition_id().cast("long")).mapInArrow(run, schema)


def validity(pieces: DataFrame, machine: Machine | None = None) -> DataFrame:
    """(conv_id, valid, first_illegal) from ``formatted``: whether the machine takes all turns in order and may end there,
    and the place (from 0) of the first turn that may not come, null if there is none."""
    machine = machine or Machine()
    states = F.array(*[F.lit(s) for s in machine.states])
    begin = F.struct(F.lit("").alias("state"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("fault"))

    def onward(acc, p):
        move = F.get(p["moves"], F.array_position(states, acc["state"]).cast("int") - 1)
        stopped = acc["fault"].isNotNull()
        return F.struct(
            F.when(stopped, acc["state"]).otherwise(F.coalesce(move["state"], acc["state"])).alias("state"),
            (acc["n"] + p["n_turns"]).alias("n"), F.when(stopped, acc["fault"]).otherwise(acc["n"] + move["fault"]).alias("fault"),
        )

    one = F.array(F.struct("piece", "n_turns", "moves"))
    alone = pieces.where("whole").select("conv_id", one.alias("parts"))
    cut = pieces.where("NOT whole").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("piece", "n_turns", "moves"))).alias("parts"))
    ended = alone.unionByName(cut).select("conv_id", F.aggregate("parts", begin, onward).alias("end"))
    return ended.select("conv_id", (F.col("end.fault").isNull() & F.col("end.state").isin(*machine.ends)).alias("valid"), F.col("end.fault").alias("first_illegal"))


def read_back(pieces: DataFrame, template: Template | None = None) -> DataFrame:
    """A row for each conversation, from the formatted texts and segments alone: (conv_id, n_turns, turns_sha256 over role, line
    feed, text, line feed of each turn, loss_chars, loss_sha256 over the text under the loss mask, formatted_chars)."""
    template = template or Template()
    kind = pieces.schema["conv_id"].dataType.simpleString()
    counts = ["n_turns", "loss_chars", "formatted_chars"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(k).to_pylist() for k, name in enumerate(batch.schema.names)}
            made = []
            for whole, text, segments in zip(columns["whole"], columns["formatted"], columns["segments"], strict=True):
                turns = read_turns(template, text)
                log = "".join(f"{r}\n{t}\n" for r, t in turns)
                loss = loss_text(text, [(s["chars"], s["loss"]) for s in segments])
                hashes = [hashlib.sha256(x.encode()).hexdigest() for x in (log, loss)] if whole else [None, None]
                made.append((len(turns), len(loss), len(text), *hashes, *([None, None] if whole else [log, loss])))
            if made:
                kinds = [pa.int64()] * 3 + [pa.string()] * 4
                yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), *[pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)]], ["conv_id", "piece", "whole", *counts, "turns_sha256", "loss_sha256", "log", "loss"])

    schema = f"conv_id {kind}, piece long, whole boolean, {', '.join(f'{c} long' for c in counts)}, turns_sha256 string, loss_sha256 string, log string, loss string"
    fields = ["conv_id", *counts, "turns_sha256", "loss_sha256"]
    read = lambda which: pieces.where(which).select("conv_id", "piece", "whole", "formatted", "segments").mapInArrow(run, schema)
    # at most two conversations a partition have pieces elsewhere
    parts = read("NOT whole")
    totals = parts.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in counts])
    hashes = digests(parts, {"turns_sha256": "log", "loss_sha256": "loss"})
    return read("whole").select(fields).unionByName(beside(totals, hashes).select(fields))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    pieces = staged(formatted(rows.unionByName(more)), "chat")
    return beside(read_back(pieces), validity(pieces)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "first_illegal")


QUERIES = {"op12_chat_format": op12_chat_format}
ORACLES: dict[str, str] = {}

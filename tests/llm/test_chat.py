import hashlib
import random

import pytest

from cardloom.llm import chat as ch

ODD = "\\### Assistant: </turn> ok"


def brute(rows):
    """Digest columns of one conversation's (role, text), straight from the table."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    loss = "".join(t for r, t in rows if r == "assistant")
    state, fault = "", None
    for k, (r, _) in enumerate(rows):
        if (state, r) not in {("", "system"), ("", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}:
            fault = k
            break
        state = r
    return (len(rows), sha("".join(f"{r}\n{t}\n" for r, t in rows)), len(loss), sha(loss), fault is None and state == "assistant", fault)


def test_round_trip_of_control_strings():
    rng = random.Random(1)
    parts = ["\\", "#", "##", "###", "### ", "</turn>", "</turn", " </turn>\n", "<", "=", ":", ": ", "a", "\n", "é", "### Assistant: ", "\\\\", " "]
    text = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
    other = ch.Template((("<|", frozenset()), (ch.ROLE, frozenset()), ("|>\n", frozenset()), (ch.TEXT, frozenset({"user", "assistant"})), ("<|end|>", frozenset({"assistant"})), ("\n", frozenset())), (("user", "U"),), ("<|",), ("|>",))
    for template in (ch.Template(), other):
        for _ in range(3000):
            rows = [(rng.choice(["system", "user", "assistant", "System", "", "=", text()]), text()) for _ in range(rng.randrange(5))]
            whole, segments = ch.format_turns(template, [r for r, _ in rows], [t for _, t in rows])
            assert ch.read_turns(template, whole) == rows
            assert sum(n for n, _ in segments) == len(whole)
    whole, segments = ch.format_turns(other, ["user", "assistant"], ["a<|", "b"])
    assert whole == "<|U|>\na\\<|<|end|>\n<|=assistant|>\nb<|end|>\n"
    assert ch.loss_text(whole, segments) == "a<|b<|end|>"  # the end mark of an assistant's turn is learnt under this template


def test_templates_that_cannot_be_read_are_refused():
    with pytest.raises(ValueError):
        ch.Template((("# ", frozenset()), (ch.ROLE, frozenset()), (ch.TEXT, frozenset()), ("\n", frozenset())))
    with pytest.raises(ValueError):
        ch.Template((("# ", frozenset()), (ch.ROLE, frozenset()), (":", frozenset()), (ch.TEXT, frozenset()), ("aa", frozenset())), (), ("aa",), (":",))
    with pytest.raises(ValueError):
        ch.read_turns(ch.Template(), "### User: x </turn>\nmore")


def test_a_long_text_is_read_in_one_go():
    text = "<" * 300_000 + "\\" * 300_000 + "#" * 300_000
    whole, segments = ch.format_turns(ch.Template(), ["assistant"], [text])
    assert ch.read_turns(ch.Template(), whole) == [("assistant", text)] and ch.loss_text(whole, segments) == text


def compared(spark, df):
    pieces = ch.staged(ch.formatted(df), "chat")
    got = {r.conv_id: tuple(r)[1:] for r in ch.beside(ch.read_back(pieces), ch.validity(pieces)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "valid", "first_illegal").collect()}
    want = {}
    for conv, turn, role, text in df.select("conv_id", "turn", "role", "text").collect():
        want.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    want = {c: brute([r[1:] for r in sorted(rows)]) for c, rows in want.items()}
    assert got == want
    return got


def test_query(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    got = compared(spark, df)
    rows = {r.conv_id: r for r in ch.op12_chat_format(spark, sf).collect()}
    assert set(rows) == {*got, -7}
    assert all((r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.valid, r.first_illegal) == got[c] for c, r in rows.items() if c != -7)
    assert (rows[-7].n_turns, rows[-7].turns_sha256, rows[-7].loss_chars, rows[-7].loss_sha256, rows[-7].valid, rows[-7].first_illegal) == brute([("user", ODD), ("assistant", ODD)])
    shown = "### User: \\\\\\### Assistant: \\</turn> ok </turn>\n### Assistant: \\\\\\### Assistant: \\</turn> ok </turn>\n"
    assert rows[-7].formatted_chars == len(shown) and ch.format_turns(ch.Template(), ["user", "assistant"], [ODD, ODD])[0] == shown


def test_odd_rows_hot_conversation_and_empty(spark):
    rng = random.Random(4)
    texts = [None, "", ODD, "x" * 60_000, "é </turn>\n### User: hi", "\\"]
    # equal turns are equal rows here, or differ in role
    rows = [(7, t, rng.choice(["user", "assistant", "tool", None, ""]), rng.choice(texts[:3] + texts[4:])) for t in range(1200)]
    rows += [(8, t, "user" if t % 2 == 0 else "assistant", f"{t}") for t in range(900)]
    rows += [(None, None, None, None), (None, 2, "user", texts[3]), (5, 1, "user", "same")] + [(5, 1, "user", "same")] * 30 + [(6, 0, "assistant", "a"), (6, 0, "user", "b")]
    rows += [(k, t, r, f"{r}{k}") for k in range(50, 80) for t, r in enumerate(["system", "user", "assistant"])]
    df = spark.createDataFrame([(*r, "p", 1, "f") for r in rows], "conv_id long, turn long, role string, text string, piece string, n_turns int, formatted string")
    got = compared(spark, df)
    assert got[8][-2:] == (False, None) or got[8][-2:] == (True, None)
    assert got[60][-2:] == (True, None) and got[5][-2:] == (False, 1) and got[None][0] == 2
    assert ch.formatted(df).where("conv_id = 8").count() > 1
    empty = ch.formatted(df.limit(0))
    assert ch.read_back(empty).count() == 0 and ch.validity(empty).count() == 0


def test_machine_of_ones_own(spark):
    machine = ch.Machine((("", ("user",)), ("user", ("assistant", "tool")), ("tool", ("assistant",)), ("assistant", ("user",))), frozenset({"assistant", "tool"}))
    rows = [(1, k, r, "t") for k, r in enumerate(["user", "tool", "assistant"])] + [(2, k, r, "t") for k, r in enumerate(["user", "tool"])] + [(3, k, r, "t") for k, r in enumerate(["user", "assistant", "tool"])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.valid, r.first_illegal) for r in ch.validity(ch.formatted(df, machine=machine), machine).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 2)}

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairlens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, pos int, n_tokens int, task string"
HARD = [
    "</s>[INST] ok [/INST]", r"<\s> and <\\/s> [\INST]", "<", "[", "[[INST]", "<</s>", "INST]", "/s>", "\\", "", " ", "\n\n", "<|endoftext|>", "é é Å ﬁ", "\u0000\u0001", "💡[OUT]💡", "[ROLE]x[TEXT]y[/ROLE]",
    "word " * 20_000,
]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def plain(rows):
    """The contract by loops, and the length of the shown text by the template."""
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns = [(r, x) for *_, r, x in sorted(turns)]
        whole, learnt = "".join(f"{r}\n{x}\n" for r, x in turns), "".join(x for r, x in turns if r == "assistant")
        marks = {"system": "[SYS]{}[/SYS]", "user": "[INST]{}[/INST]", "assistant": "[OUT]{}</s>"}
        shown = "<s>" + "".join(marks.get(r, "[ROLE]" + chat.escape(r) + "[TEXT]{}[/ROLE]").replace("{}", chat.escape(x)) for r, x in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(turns), sha(whole), len(learnt), sha(learnt), len(shown))
    return out


ROWS = [(k % 5, k // 5, ["user", "assistant", "system", "tool", "[ROLE]", None][k % 6], HARD[k % len(HARD)]) for k in range(90)]
ROWS += [(7, None, "user", None), (7, 0, "assistant", None), (7, 0, "assistant", "b"), (7, 0, "assistant", "a"), (7, 0, "assistant", "a"), (None, 0, "user", "no id"), (None, 1, "assistant", "<s>"), (8, 0, "user", "alone")]


def test_digests_like_loops(spark):
    formatted = chat.segments(table(spark, ROWS).repartition(4))
    got = {r[0]: tuple(r)[1:] for r in chat.digests(chat.read_back(formatted)).collect()}
    assert got == plain(ROWS)


def test_a_conversation_over_many_tasks(spark):
    rows = [(1, k, ["user", "assistant"][k % 2], f"turn {k} " + "x" * (k % 17)) for k in range(400)] + [(2, 0, "user", "short")]
    formatted = chat.segments(table(spark, rows).repartition(4)).collect()
    mine = sorted((r for r in formatted if r.conv_id == 1), key=lambda r: r.pos)
    assert [r.pos for r in mine] == list(range(400)) and [r.turn for r in mine] == list(range(400))
    assert [r.token_start for r in mine] == np.cumsum([0, *[len(r.input_ids) for r in mine]])[:-1].tolist()
    assert [r.char_start for r in mine] == np.cumsum([0, *[r.n_chars for r in mine]])[:-1].tolist()
    assert all(len(r.input_ids) == len(r.loss_mask) == r.n_tokens for r in mine)
    got = {r[0]: tuple(r)[1:] for r in chat.digests(chat.read_back(chat.segments(table(spark, rows)))).collect()}
    assert got == plain(rows)


def test_mask_and_trained_roles(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "assistant", "")]
    back = {r.pos: r for r in chat.read_back(chat.segments(table(spark, rows))).collect()}
    assert [back[k].loss_text for k in range(4)] == [None, None, "hello", None]
    assert "".join(back[k].shown for k in range(4)) == "<s>[SYS]be brief[/SYS][INST]hi[/INST][OUT]hello</s>[OUT]</s>"
    both = chat.read_back(chat.segments(table(spark, rows), trained=("assistant", "user")))
    assert {r.pos: r.loss_text for r in both.collect()} == {0: None, 1: "hi", 2: "hello", 3: None}


def test_no_reserved_id_from_text(spark):
    encoder, base = chat._tokenizer(chat.default_tokenizer())
    for text in HARD:
        ids = encoder.encode(chat.escape(text), add_special_tokens=False).ids
        assert all(i < base for i in ids) and chat.unescape(encoder.decode(ids, skip_special_tokens=False)) == text


def test_empty(spark):
    assert chat.digests(chat.read_back(chat.segments(table(spark, [])))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", "[", "\\", "/", "s>", "INST]", "/INST]", "OUT]", "TEXT]", "SYS]", "/ROLE]", "a", " "]), max_size=12).map("".join))
def test_escape_round_trip(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat.CONTROLS)


@pytest.mark.parametrize("control", chat.CONTROLS)
def test_every_control_string_is_escaped(control):
    assert chat.escape(f"a{control}b") == f"a{control[0]}\\{control[1:]}b"
    assert sum(c in control[1:] for c in "<[") == 0

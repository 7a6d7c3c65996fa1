import hashlib
import random

import pytest

from seatflow.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, segments string, formatted int"
BITS = ["[INST]", "</s>", "<s>", "\\", "[/ROLE]", "<<SYS>>", "x", "\n", " ", "[", "<", "/INST]", "é", "日", "\\[", "[ANS] ", "$1", "[ROLE] "]


def chats(seed, n=40):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "[ROLE] a [/ROLE] \\"])
            text = None if rng.random() < 0.1 else "".join(rng.choice(BITS) for _ in range(rng.randrange(12)))
            rows.append((c if c else None, t, role, text, "s", 1))
    return rows + [(3, 0, "user", "again", "s", 1), (3, 0, "user", "again", "s", 1), (4, None, "user", "first", "s", 1)]


def expected(rows):
    by = {}
    for c, t, r, x, *_ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}


@pytest.mark.parametrize("seed", range(3))
def test_round_trip(spark, rows, seed):
    data = chats(seed)
    want = expected(data)
    found = C.read_chats(C.format_chats(rows(data, SCHEMA).repartition(5))).collect()
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in found} == want
    for r in found:
        assert r["loss_text"] == "".join(x for role, x in want[r["conv_id"]] if role == "assistant")


def test_very_long_texts_come_back(spark, rows):
    data = [(1, 0, "user", "ask </s> " * 60_000, "", 0), (1, 1, "assistant", "[INST] \\ é " * 60_000, "", 0)]
    found = C.read_chats(C.format_chats(rows(data, SCHEMA))).first()
    assert [tuple(t) for t in found["turns"]] == [(r, x) for _, _, r, x, *_ in data]
    assert found["loss_text"] == data[1][3]


def test_segments_make_up_the_text(spark, rows):
    data = [(1, 0, "user", "hi </s>", "", 0), (1, 1, "assistant", "yes", "", 0)]
    formatted = C.format_chats(rows(data, SCHEMA))
    got = [(r["text"], r["loss"]) for r in C.segments(formatted).orderBy("place").collect()]
    assert got == [
        ("<s>", False), ("[INST] ", False), ("hi <\\/s>", False), (" [/INST]</s>", False),
        ("[ANS] ", False), ("yes", True), ("</s>", False),
    ]
    assert formatted.first()["formatted"] == "".join(t for t, _ in got)


@pytest.mark.parametrize(
    ("roles", "bad", "complete"),
    [
        ("ua", None, True), ("sua", None, True), ("u", None, False), ("a", 1, False), ("uu", 2, False),
        ("usa", 2, False), ("uaa", 3, False), ("uauauaua", None, True), ("suax", 4, False), ("ss", 2, False),
    ],
)
def test_role_machine(spark, rows, roles, bad, complete):
    names = {"u": "user", "a": "assistant", "s": "system", "x": "other"}
    data = [(1, i, names[r], "t", "", 0) for i, r in enumerate(roles)]
    got = C.format_chats(rows(data, SCHEMA)).first()
    assert (got["bad_turn"], got["complete"]) == (bad, complete)


def test_another_template(spark, rows):
    template = C.Template(
        roles={"user": C.Role("<|u|>"), "bot": C.Role("<|b|>", "<|e|>", loss=True)},
        other=("<|r|>", "<|n|>"), start="", end="<|z|>\n",
        controls=("<|u|>", "<|b|>", "<|e|>", "<|r|>", "<|n|>", "<|z|>"),
        initial="a", moves={("a", "user"): "b", ("b", "bot"): "a"}, final=("a",),
    )
    data = [(1, 0, "user", "<|z|>\n", "", 0), (1, 1, "bot", "x<|e|><", "", 0), (1, 2, "else", "", "", 0)]
    got = C.read_chats(C.format_chats(rows(data, SCHEMA), template), template).first()
    assert [tuple(t) for t in got["turns"]] == [("user", "<|z|>\n"), ("bot", "x<|e|><"), ("else", "")]
    assert got["loss_text"] == "x<|e|><"


def test_templates_that_cannot_be_read_back_are_refused():
    good = dict(other=("[R]", "[/R]"), start="", end="[E]", initial="a", moves={}, final=())
    with pytest.raises(ValueError):
        C.Template(roles={"user": C.Role("u: ")}, controls=("[R]", "[/R]", "[E]"), **good)
    with pytest.raises(ValueError):
        C.Template(roles={"a": C.Role("[R] x")}, controls=("[R]", "[/R]", "[E]"), **good)


def test_no_python_and_one_shuffle(spark):
    from seatflow.llm.queries import QUERIES

    df = QUERIES["op9_chat_format"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = {r["conv_id"]: r for r in df.collect()}[-7]
    text = "</s>[INST] ok [/INST]"
    assert (got["n_turns"], got["loss_chars"]) == (2, len(text))
    assert got["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert got["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark, rows):
    assert C.read_chats(C.format_chats(rows([], SCHEMA))).count() == 0

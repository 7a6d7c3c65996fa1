"""Chat formatting: a role machine checks the turns, a template turns them into text segments.

All of it is native column work: one shuffle brings the turns of a conversation together.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"
FAILED = "failed"


@dataclass(frozen=True)
class Role:
    """Texts around a turn of this role, and whether its text is trained on."""

    header: str
    footer: str = ""
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """A declarative chat format.

    ``roles`` gives the marks of each known role; a turn of any other role carries its own
    name between the two marks of ``other``. ``controls`` are the strings that a text must
    not hold: inside texts an escape character is put behind their first character. Every
    header starts with a control string, so that reading back is unambiguous.

    The machine starts in ``initial``; ``moves`` maps (state, role) to the next state, and a
    missing move fails. A conversation that ends outside ``final`` is incomplete.
    """

    roles: dict[str, Role]
    other: tuple[str, str]
    start: str
    end: str
    controls: tuple[str, ...]
    initial: str
    moves: dict[tuple[str, str], str]
    final: tuple[str, ...]
    other_loss: bool = field(default=False)

    def __post_init__(self) -> None:
        marks = [r.header for r in self.roles.values()] + [self.other[0]]
        for mark in (*marks, self.other[1].strip(), self.end):
            if not mark.startswith(self.controls):
                raise ValueError(f"{mark!r} does not start with a control string")
        if any(len(c) < 2 or ESCAPE in c for c in self.controls):
            raise ValueError("a control string has two characters or more and no escape character")
        if any(a != b and a.startswith(b) for a in marks for b in marks):
            raise ValueError("one header starts another")


INSTRUCT = Template(
    roles={
        "system": Role("<<SYS>>\n", "\n<</SYS>>"),
        "user": Role("[INST] ", " [/INST]"),
        "assistant": Role("[ANS] ", "", loss=True),
    },
    other=("[ROLE] ", " [/ROLE] "),
    start="<s>",
    end="</s>",
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ANS]", "[ROLE]", "[/ROLE]"),
    initial="start",
    moves={
        ("start", "system"): "ready",
        ("start", "user"): "asked",
        ("ready", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
    },
    final=("answered",),
)


def escape(text: Column, template: Template) -> Column:
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for c in template.controls:
        text = F.replace(text, F.lit(c), F.lit(c[0] + ESCAPE + c[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _segment(text: Column, loss: Column | bool) -> Column:
    loss = F.lit(loss) if isinstance(loss, bool) else loss
    return F.struct(text.alias("text"), loss.alias("loss"))


def _turn_segments(turn: Column, template: Template) -> Column:
    """Header, text and footer of a turn; the end mark belongs to the footer."""
    name = F.lit(template.other[0])
    header = F.concat(name, escape(turn["role"], template), F.lit(template.other[1]))
    footer, loss = F.lit(template.end), F.lit(template.other_loss)
    for role, marks in template.roles.items():
        own = turn["role"] == role
        header = F.when(own, F.lit(marks.header)).otherwise(header)
        footer = F.when(own, F.lit(marks.footer + template.end)).otherwise(footer)
        loss = F.when(own, F.lit(marks.loss)).otherwise(loss)
    return F.array(
        _segment(header, False), _segment(escape(turn["text"], template), loss), _segment(footer, False)
    )


def _machine(turns: Column, template: Template) -> Column:
    """(state at the end, 1-based place of the first turn without a move) of the role machine."""
    moves = F.create_map(
        *chain.from_iterable((F.lit(f"{s}\n{r}"), F.lit(t)) for (s, r), t in template.moves.items())
    )

    def step(at: Column, turn: Column) -> Column:
        to = F.element_at(moves, F.concat_ws("\n", at["state"], turn["role"]))
        bad = at["bad"].isNull() & to.isNull()
        return F.struct(
            F.coalesce(to, F.lit(FAILED)).alias("state"),
            F.when(bad, at["seen"] + 1).otherwise(at["bad"]).alias("bad"),
            (at["seen"] + 1).alias("seen"),
        )

    begin = F.struct(
        F.lit(template.initial).alias("state"),
        F.lit(None).cast("int").alias("bad"),
        F.lit(0).alias("seen"),
    )
    return F.aggregate(turns, begin, step)


def format_chats(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per conversation: its segments with loss flags, its text, the machine's verdict.

    Reads ``conv_id, turn, role, text`` and no other column, so extra columns of any name do
    no harm. Turns are ordered by turn, then role, then text, nulls first; repeated rows are
    turns of their own. A null role or text counts as empty; rows with a null ``conv_id`` are
    one conversation. A conversation, very long texts included, is formatted by one task. An
    empty table gives no rows. Invalid conversations are kept whole and
    marked: ``bad_turn`` is the place of the first turn that the machine has no move for (null
    if none) and ``complete`` says whether it ended in a final state.
    """
    turns = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("at"),
    )
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("at")).alias("turns"))
    segments = F.flatten(F.transform("turns", lambda t: _turn_segments(t, template)))
    first = F.array(_segment(F.lit(template.start), False))
    machine = _machine(F.col("turns"), template)
    return chats.select("conv_id", F.concat(first, segments).alias("segments"), machine.alias("machine")).select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.col("machine.bad").alias("bad_turn"),
        F.col("machine.state").isin(*template.final).alias("complete"),
    )


def segments(chats: DataFrame) -> DataFrame:
    """One row per segment: conv_id, place, text, loss."""
    return chats.select("conv_id", F.posexplode("segments").alias("place", "s")).select(
        "conv_id", "place", "s.text", "s.loss"
    )


def _read_turn(piece: Column, template: Template) -> Column:
    def between(header: int, footer: int) -> Column:
        size = F.length(piece) - F.lit(header + footer)
        return F.substring(piece, F.lit(header + 1), size)

    left, right = template.other
    pattern = rf"(?s)^\Q{left}\E(.*?)\Q{right}\E(.*)$"
    role, text = F.regexp_extract(piece, pattern, 1), F.regexp_extract(piece, pattern, 2)
    role = unescape(role)
    for name, marks in template.roles.items():
        own = piece.startswith(marks.header)
        role = F.when(own, F.lit(name)).otherwise(role)
        text = F.when(own, between(len(marks.header), len(marks.footer))).otherwise(text)
    return F.struct(role.alias("role"), unescape(text).alias("text"))


def read_chats(chats: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Turns parsed back from ``formatted``, and the trained text from the loss mask.

    Columns: conv_id, formatted, turns (role, text), loss_text.
    """
    body = F.substring(F.col("formatted"), F.lit(len(template.start) + 1), F.length("formatted"))
    pieces = F.split(body, rf"\Q{template.end}\E", -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    trained = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return chats.select(
        "conv_id",
        "formatted",
        F.transform(pieces, lambda p: _read_turn(p, template)).alias("turns"),
        F.array_join(trained, "").alias("loss_text"),
    )

"""Chat formatting (operator 13), with DataFrame functions only.

A conversation's roles run through a finite-state machine that a ``Template`` declares. Each turn becomes three text
segments, the opening mark of its role, the text, and the stop, each with a flag that tells whether it counts in the
loss; the machine's verdict on the turn is in the mark, so the text alone tells which turns came out of order. Control
strings inside a text are escaped: a backslash is doubled, and a control string becomes a backslash and a digit. No
control string is left in an escaped text, so a conversation is split at its stops and read back exactly.

A conversation is one row of the output, so its turns meet in one task, in one shuffle of the texts; a conversation is
bounded by the 2 GB of a string. The machine runs over pieces of ``PIECE`` turns, so its work grows with the turns.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 64


@dataclass(frozen=True)
class Template:
    """Marks, the roles in the loss, and the machine: ``moves`` gives, by state and role, the next state. A role without a
    move there is out of order: it leads to its state in ``resume``, and one that has none leaves the state as it was."""

    names: Mapping[str, str] = field(default_factory=lambda: MappingProxyType({"system": "System", "user": "User", "assistant": "Assistant"}))
    opening: str = "### "
    closing: str = ": "
    late: str = " (out of turn)"
    #: Stands before a role that has no name.
    other: str = "="
    stop: str = "</turn>"
    gap: str = "\n"
    in_loss: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    accepting: frozenset[str] = frozenset({"answered"})
    moves: Mapping[str, Mapping[str, str]] = field(default_factory=lambda: MappingProxyType({
        "start": {"system": "told", "user": "asked"}, "told": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}}))
    resume: Mapping[str, str] = field(default_factory=lambda: MappingProxyType({"system": "told", "user": "asked", "assistant": "answered"}))

    def __post_init__(self):
        if any("\\" in c or any(d in c for d in "0123456789") or not c for c in self.controls):
            raise ValueError("control strings hold no backslash and no digit")
        if self.opening.startswith(self.stop) or self.stop.startswith(self.opening):
            raise ValueError("no control string begins another")
        end, marks = self.stop, [self.opening, self.closing, self.late, self.other, *self.names.values()]
        if any(end[:k] == end[-k:] for k in range(1, len(end))) or any(m.endswith(end[:k]) for m in marks for k in range(1, len(end) + 1) if m):
            raise ValueError("a stop may begin neither in itself nor in a mark")
        if len(set(self.names.values())) < len(self.names) or any(
                x in n for n in self.names.values() for x in (self.closing, self.late, self.stop, self.opening) if x) or any(
                n.startswith(self.other) for n in self.names.values()) or not (self.closing and self.late and self.other):
            raise ValueError("names differ and hold no mark")
        states = self.states
        if {*self.accepting, *self.resume.values()} - set(states):
            raise ValueError("a state without a way to it")

    @property
    def controls(self) -> tuple[str, ...]:
        return self.opening, self.stop

    @property
    def role_controls(self) -> tuple[str, ...]:
        """What a role's name may not hold either."""
        return *self.controls, self.closing[0], self.late.strip()[0]

    @property
    def states(self) -> list[str]:
        return list(dict.fromkeys([self.start, *self.moves, *(t for m in self.moves.values() for t in m.values())]))

    @property
    def roles(self) -> list[str]:
        return list(dict.fromkeys([*self.names, *(r for m in self.moves.values() for r in m), *self.resume]))

    def table(self) -> list[list[int]]:
        """By state and role (the last stands for all others): twice the next state, plus 1 if in order."""
        place = {s: k for k, s in enumerate(self.states)}

        def entry(state: str, role: str | None) -> int:
            to = self.moves.get(state, {}).get(role)
            return 2 * place[to] + 1 if to else 2 * place[self.resume.get(role, state)]

        return [[entry(s, r) for r in [*self.roles, None]] for s in self.states]


def escaped(text: Column, controls: tuple[str, ...]) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for k, control in enumerate(controls):
        text = F.replace(text, F.lit(control), F.lit(f"\\{k}"))
    return text


def unescaped(text: Column, controls: tuple[str, ...]) -> Column:
    """Doubled backslashes part the text from left to right; between them a backslash stands before a digit only."""
    def back(part: Column) -> Column:
        for k, control in enumerate(controls):
            part = F.replace(part, F.lit(f"\\{k}"), F.lit(control))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), back), "\\")


def _machine(roles: Column, template: Template) -> Column:
    """struct(state, in_order) of an array of role numbers: the last state and a flag for each."""
    table = F.array(*(F.array(*map(F.lit, row)) for row in template.table()))
    none = F.expr("CAST(array() AS array<boolean>)")

    def step(seen: Column, role: Column) -> Column:
        move = F.get(F.get(table, seen["state"]), role)
        return F.struct(F.shiftright(move, 1).alias("state"), F.concat(seen["out"], F.array(move % 2 == 1)).alias("out"))

    def piece(seen: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(seen["state"].alias("state"), none.alias("out")), step)
        return F.transform(F.array(inner), lambda x: F.struct(x["state"].alias("state"), F.concat(seen["out"], F.array(x["out"])).alias("out")))[0]

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(roles) - 1) / PIECE).cast("int")), lambda k: F.slice(roles, k * PIECE + 1, PIECE))
    begin = F.struct(F.lit(template.states.index(template.start)).alias("state"), F.expr("CAST(array() AS array<array<boolean>>)").alias("out"))
    return F.aggregate(pieces, begin, piece, lambda x: F.struct(x["state"].alias("state"), F.flatten(x["out"]).alias("in_order")))


def format_conversations(turns: DataFrame, template: Template = Template(), conv_column: str = "conv_id", turn_column: str = "turn",
                         role_column: str = "role", text_column: str = "text") -> DataFrame:
    """(conv_id, n_turns, valid, n_late, segments) of each conversation; segments are struct(text, loss), three a turn.

    Turns are in order of turn, role and text, a null turn first. A null text and a null role are empty; rows that repeat
    are turns like any other, and all rows without a conv_id are one conversation. ``valid``: every turn was in order, and
    the machine ended in an accepting state. A turn out of order is kept, under a mark that says so. Other columns are
    left out.
    """
    t = template
    number = F.coalesce(*(F.when(F.col(role_column) == r, F.lit(k)) for k, r in enumerate(t.roles)), F.lit(len(t.roles)))
    turn = F.struct(F.col(turn_column).alias("turn"), F.coalesce(F.col(role_column), F.lit("")).alias("role"),
                    F.coalesce(F.col(text_column), F.lit("")).alias("text"), number.alias("number"))
    gathered = (turns.select(F.col(conv_column).alias("conv_id"), turn.alias("turn"))
                .groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns")))
    run = gathered.withColumn("run", _machine(F.transform("turns", lambda x: x["number"]), t))

    def segments(x: Column, in_order: Column) -> Column:
        known = [F.when(x["role"] == role, F.lit(name)) for role, name in t.names.items()]
        name = F.coalesce(*known, F.concat(F.lit(t.other), escaped(x["role"], t.role_controls)))
        mark = F.concat(F.lit(t.opening), name, F.when(in_order, F.lit("")).otherwise(F.lit(t.late)), F.lit(t.closing))
        parts = ((mark, F.lit(False)), (escaped(x["text"], t.controls), x["role"].isin(*t.in_loss)), (F.lit(t.stop + t.gap), F.lit(False)))
        return F.array(*(F.struct(text.alias("text"), loss.alias("loss")) for text, loss in parts))

    state = F.element_at(F.array(*(F.lit(s in t.accepting) for s in t.states)), F.col("run.state") + 1)
    n_late = F.size(F.filter("run.in_order", lambda ok: ~ok))
    return run.select("conv_id", F.size("turns").cast("long").alias("n_turns"), (state & (n_late == 0)).alias("valid"), n_late.cast("long").alias("n_late"),
                      F.flatten(F.zip_with("turns", "run.in_order", segments)).alias("segments"))


def formatted(segments: str = "segments") -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def turns_back(text: Column, template: Template = Template()) -> Column:
    """array of struct(role, text, late): the turns of a formatted text."""
    t = template
    pieces = F.split(text, f"\\Q{t.stop}{t.gap}\\E")

    def turn(piece: Column) -> Column:
        rest = F.substr(piece, F.lit(len(t.opening) + 1))
        head = F.substring_index(rest, t.closing, 1)
        late = F.endswith(head, F.lit(t.late))
        name = F.when(late, F.left(head, F.length(head) - len(t.late))).otherwise(head)
        role = F.coalesce(*(F.when(name == n, F.lit(r)) for r, n in t.names.items()), unescaped(F.substr(name, F.lit(len(t.other) + 1)), t.role_controls))
        return F.struct(role.alias("role"), unescaped(F.substr(rest, F.length(head) + len(t.closing) + 1), t.controls).alias("text"), late.alias("late"))

    # What follows the last stop is empty.
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def loss_text(segments: str = "segments", template: Template = Template()) -> Column:
    """The text under the loss flags, in order, unescaped segment by segment."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template.controls)), "")

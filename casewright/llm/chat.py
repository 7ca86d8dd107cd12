r"""Chat formatting: a finite-state machine over roles, a declarative template, and a loss mask.

A template gives each role's text before and after a turn and says whether its text counts for the loss. A machine
over roles checks the order of turns: its states are the roles, with the roles that may follow each; a conversation
that breaks it is marked invalid, with the first turn that does, and is formatted all the same.

The output of a conversation is its turns' segments, each a text and a loss flag. Control strings of the template
inside texts and names are broken up by a backslash after their first character, so ``[INST]`` becomes ``[\INST]``,
and ones that hold backslashes there already get one more; nothing else is changed. No control string is left in a
text, and as a template's control strings must not overlap, none can form where a text meets a marker: the formatted
stream of a whole conversation has one reading, and ``Reader`` reads it back to the very roles and texts.

Turns are sorted by conversation and turn inside hash partitions and formatted as they stream by: no conversation is
gathered, so a very long one only takes its own time. Null texts count as empty, null roles as the empty role,
which no template knows: unknown roles are written with their name in the marker. Turns with equal numbers keep the
order of role and text. Rows with a null conv_id are one conversation. Extra columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.shared import partitions


@dataclass(frozen=True)
class Template:
    """``roles``: role to (marker before, marker after, text counts for the loss). ``other``: markers of any other role,
    with ``{}`` for its escaped name. ``follows``: the roles that may follow a role; "" stands for the start.
    """

    roles: dict[str, tuple[str, str, bool]]
    other: tuple[str, str, str]
    follows: dict[str, tuple[str, ...]]
    ends: tuple[str, ...] = ()
    controls: tuple[str, ...] = field(default=())

    def all_controls(self) -> list[str]:
        marks = {m for b, a, _ in self.roles.values() for m in (b, a)} | set(self.other) | set(self.controls)
        return sorted(marks, key=lambda m: (-len(m), m))

    def __post_init__(self):
        """Control strings have two characters at least, no backslash, and never overlap each other."""
        marks = self.all_controls()
        starts = [b for b, _, _ in self.roles.values()] + [self.other[0]]
        if any(len(m) < 2 or "\\" in m for m in marks) or len(set(starts)) < len(starts):
            raise ValueError("control strings need two characters, no backslash, and one start mark for each role")
        for one in marks:
            for two in marks:
                meet = any(two.startswith(one[k:]) or one[k:].startswith(two) for k in range(1, len(one)))
                if meet or (one != two and one.startswith(two)):
                    raise ValueError(f"the control strings {one!r} and {two!r} overlap")


#: Fixed values of the default template.
INSTRUCT = Template(
    roles={
        "system": ("<<SYS>>", "<</SYS>>", False),
        "user": ("[INST]", "[/INST]", False),
        "assistant": ("<s>", "</s>", True),
    },
    other=("<role=", "|role>", "</role>"),
    follows={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("assistant",),
)


class Formatter:
    def __init__(self, template: Template = INSTRUCT):
        self.template = template
        marks = template.all_controls()
        broken = "|".join(re.escape(m[0]) + r"(?=\\*" + re.escape(m[1:]) + ")" for m in marks)
        mended = "|".join(re.escape(m[0]) + r"\\(?=\\*" + re.escape(m[1:]) + ")" for m in marks)
        self._break, self._mend = re.compile(broken), re.compile(mended)
        self.mark = re.compile("|".join(re.escape(m) for m in marks))
        self.longest = max(map(len, marks))

    def escape(self, text: str) -> str:
        """A backslash after the first character of every control string, whatever backslashes are there."""
        return self._break.sub(lambda m: m.group() + "\\", text)

    def unescape(self, text: str) -> str:
        return self._mend.sub(lambda m: m.group()[:-1], text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, counts for the loss) of a turn, escaped; the loss holds the text alone, not its markers."""
        known = self.template.roles.get(role)
        if known is None:
            start, mid, end = self.template.other
            return [(start + self.escape(role) + mid, False), (self.escape(text), False), (end, False)]
        return [(known[0], False), (self.escape(text), known[2]), (known[1], False)]

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The (role, text) of each turn of a formatted conversation."""
        reader = Reader(self)
        turns = list(reader.feed(formatted))
        reader.end()
        return turns

    def next_ok(self, before: str, role: str) -> bool:
        return role in self.template.follows.get(before, ())


class Reader:
    """Reads a formatted conversation as a stream, in pieces of any length: its state is the mark that has to come next.

    Raises ValueError where another mark or a text outside turns comes.
    """

    def __init__(self, made: Formatter):
        self.made, self.wanted, self.role = made, None, None
        self.held: list[str] = []
        self.tail = ""
        t = made.template
        self.starts = {b: (r, a) for r, (b, a, _) in t.roles.items()} | {t.other[0]: (None, t.other[1])}

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        piece, at = self.tail + piece, 0
        for m in self.made.mark.finditer(piece):
            self._text(piece[at : m.start()])
            at = m.end()
            if self.wanted is None:
                if m.group() not in self.starts:
                    raise ValueError(f"{m.group()!r} outside a turn")
                self.role, self.wanted = self.starts[m.group()]
            elif m.group() != self.wanted:
                raise ValueError(f"{m.group()!r} where {self.wanted!r} has to come")
            else:
                said, self.held = self.made.unescape("".join(self.held)), []
                if self.role is None:
                    self.role, self.wanted = said, self.made.template.other[2]
                else:
                    yield self.role, said
                    self.role = self.wanted = None
        # the end may be the beginning of a mark
        keep = max(at, len(piece) - self.made.longest + 1)
        self._text(piece[at:keep])
        self.tail = piece[keep:]

    def _text(self, part: str) -> None:
        if part and self.wanted is None:
            raise ValueError("text outside a turn")
        if part:
            self.held.append(part)

    def end(self) -> None:
        if self.tail or self.wanted is not None:
            raise ValueError("the conversation ends inside a turn")


SEGMENTS = "conv_id long, turn_no long, segment_no int, text string, loss boolean, role string"


def _turns(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    clean = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return clean.repartition(partitions(turns), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_segments(turns: DataFrame, template: Template = INSTRUCT, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The formatted text in segments, in order, with loss flags: joined by turn_no and segment_no it is the output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, now, n = Formatter(template), object(), 0
        for batch in batches:
            rows = []
            for conv, _, who, what in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = n + 1 if conv == now else 0
                now = conv
                rows += [(conv, n, k, s, loss, who) for k, (s, loss) in enumerate(made.segments(who, what))]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "turn_no", "segment_no", "text", "loss", "role"])

    return _turns(turns, conv_id, turn, role, text).mapInArrow(run, SEGMENTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, first_invalid long"


class _State:
    """What is known of a conversation while its formatted stream is read back."""

    def __init__(self, conv, made: Formatter):
        self.conv, self.n, self.chars, self.loss_chars = conv, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.last, self.wrong, self.formatted = "", None, 0
        self.reader = Reader(made)

    def add(self, made: Formatter, role: str, text: str) -> None:
        for s, loss in made.segments(role, text):
            self.chars += len(s)
            if loss:
                said = made.unescape(s)
                self.loss_chars += len(said)
                self.loss.update(said.encode("utf-8", "surrogatepass"))
            for back, said in self.reader.feed(s):
                self.turns.update(f"{back}\n{said}\n".encode("utf-8", "surrogatepass"))
                self.n += 1
        if self.wrong is None and not made.next_ok(self.last, role):
            self.wrong = self.formatted
        self.last = role
        self.formatted += 1

    def row(self, made: Formatter) -> tuple:
        self.reader.end()
        if self.wrong is None and made.template.ends and self.last not in made.template.ends:
            self.wrong = self.n
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.wrong is None, self.wrong


def digests(turns: DataFrame, template: Template = INSTRUCT, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """For each conversation what is read back from its formatted turns, and the machine's verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, state = Formatter(template), None
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64()]
        names = [c.split()[0] for c in DIGESTS.split(", ")]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in batches:
            done = []
            for conv, _, who, what in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != state.conv:
                    if state is not None:
                        done.append(state.row(made))
                    state = _State(conv, made)
                state.add(made, who, what)
            if done:
                yield pack(done)
        if state is not None:
            yield pack([state.row(made)])

    return _turns(turns, conv_id, turn, role, text).mapInArrow(run, DIGESTS)

"""Chat formatting by a finite-state machine over roles and a declarative template."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What marks a turn, which roles bear loss, and which role may follow which.

    A turn is written head + label + sep + text + tail. Labels and texts are escaped: each character of
    `escaped` gets a backslash before it. Head and tail begin with such a character, so neither can occur in
    an escaped text; that makes the format reversible.
    """

    head: str = "### "
    sep: str = ": "
    tail: str = " </turn>\n"
    labels: tuple[tuple[str, str], ...] = (("system", "System"), ("user", "User"), ("assistant", "Assistant"), ("tool", "Tool"))
    loss: frozenset[str] = frozenset({"assistant"})
    escaped: str = "\\#<:"
    #: State -> role -> next state; a conversation is well-formed if it ends in an accepting state.
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked", "tool": "asked"},
    }, hash=False)
    accepting: frozenset[str] = frozenset({"asked", "answered", "told"})

    def escape(self, text: str) -> str:
        return re.sub(f"([{re.escape(self.escaped)}])", r"\\\1", text)

    def unescape(self, text: str) -> str:
        return re.sub(r"(?s)\\(.)", r"\1", text)

    def label(self, role: str) -> str:
        """Roles that the template doesn't name are written after an equals sign."""
        return dict(self.labels).get(role) or "=" + self.escape(role)

    def role(self, label: str) -> str:
        return self.unescape(label[1:]) if label.startswith("=") else {b: a for a, b in self.labels}[label]


PLAIN = Template()


@dataclass
class Segment:
    """A piece of the formatted text, in code points; loss tells whether it is learned."""

    start: int
    end: int
    loss: bool


def accepts(roles: list[str], template: Template = PLAIN) -> bool:
    state = "start"
    for role in roles:
        state = template.moves.get(state, {}).get(role)
        if state is None:
            return False
    return state in template.accepting


def render(turns: list[tuple[str, str]], template: Template = PLAIN) -> tuple[str, list[Segment]]:
    """The formatted text and its segments, which cover it without gaps."""
    parts, segments, at = [], [], 0
    for role, text in turns:
        for piece, loss in ((template.head + template.label(role) + template.sep, False), (template.escape(text), role in template.loss), (template.tail, False)):
            parts.append(piece)
            segments.append(Segment(at, at := at + len(piece), loss))
    return "".join(parts), segments


def parse(formatted: str, template: Template = PLAIN) -> list[tuple[str, str]]:
    """The turns of a formatted text; raises ValueError on anything that render() doesn't write."""
    body = rf"(?:[^{re.escape(template.escaped)}]|\\.)*"
    one = re.compile(rf"(?s){re.escape(template.head)}({body}){re.escape(template.sep)}({body}){re.escape(template.tail)}")
    at, turns = 0, []
    while at < len(formatted):
        m = one.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((template.role(m[1]), template.unescape(m[2])))
        at = m.end()
    return turns


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


FORMAT_SCHEMA = "conv_id long, formatted string, segments array<struct<start:long,end:long,loss:boolean>>, well_formed boolean"
READ_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, well_formed boolean"
_SEGMENTS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("loss", pa.bool_())]))


def format_conversations(df: DataFrame, template: Template = PLAIN) -> DataFrame:
    """A row for each conv_id: formatted text, segments with loss flags, and whether the turn order is accepted.

    Rows are ordered by turn (null last), then role and text; null roles and texts count as empty; rows with a
    null conv_id form one conversation. Conversations that the state machine rejects are formatted all the
    same and marked. Repeated rows are repeated turns; other columns aren't looked at; an empty table gives
    an empty one. A conversation is one output row and must fit in one.
    """
    turn = F.struct(F.col("turn").isNull().alias("last"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = df.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))

    def rows(batches):
        for batch in batches:
            formatted, segments, good = [], [], []
            for turns in batch.column(1):
                turns = [(t["role"], t["text"]) for t in turns.as_py()]
                text, parts = render(turns, template)
                formatted.append(text)
                segments.append([s.__dict__ for s in parts])
                good.append(accepts([r for r, _ in turns], template))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(formatted, pa.string()), pa.array(segments, _SEGMENTS), pa.array(good, pa.bool_())], names=["conv_id", "formatted", "segments", "well_formed"])

    return grouped.mapInArrow(rows, FORMAT_SCHEMA)


def read_back(formatted: DataFrame, template: Template = PLAIN) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, taken from the formatted text and its segments alone."""

    def rows(batches):
        for batch in batches:
            out = {k.split()[0]: [] for k in READ_SCHEMA.split(", ")[1:]}
            for text, segments, good in zip(*(batch.column(i) for i in (1, 2, 3))):
                text = text.as_py()
                turns = parse(text, template)
                learned = "".join(template.unescape(text[s["start"] : s["end"]]) for s in segments.as_py() if s["loss"])
                for column, value in zip(out.values(), (len(turns), _digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), _digest(learned), len(text), good.as_py())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v) for v in out.values())] if len(batch) else [batch.column(0), *(pa.array([], t) for t in (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()))], names=["conv_id", *out])

    return formatted.mapInArrow(rows, READ_SCHEMA)

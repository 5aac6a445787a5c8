"""Chat formatting with a grammar round trip.

A turn is rendered as `[INST] text [/INST]` (user), `[OUT] text </s>` (assistant), `[SYS] text [/SYS]`
(system) or `[TURN role] text [/TURN]`; a conversation is `<s>` and its turns. The rendered text is
parsed again by a deterministic parser; where the turns it finds differ from the source, the text
in conflict is escaped (a backslash after the first character of each control string, with any
backslashes already there) and the turn rendered anew, until the parse is identical.

Rows of a conversation are taken by turn, then role and text where turns tie; all rows are formatted,
repeated ones too. Null text is empty, a null role an empty role, a null turn comes first and a null
conv_id is a conversation of its own. An empty table gives no rows, further columns are ignored.
Rows are rendered and checked one by one before the shuffle; a conversation's rows then pass through one task as a
stream in turn order. There the joined text is parsed again, without knowing where rows end; the state is a few hashes
and the text of the turn that is open, however long the conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import exchange as X

# The template.
BEGIN = "<s>"
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", " </s>"), "system": ("[SYS] ", " [/SYS]")}
OTHER = ("[TURN {}] ", " [/TURN]")
CONTROL = re.compile(r"([\[<])(\\*)(/?(?:INST|OUT|SYS|TURN|s)(?=[\] >]))")
ESCAPED = re.compile(r"([\[<])\\(\\*)(/?(?:INST|OUT|SYS|TURN|s)(?=[\] >]))")
OPENER = re.compile(r"\[(INST|OUT|SYS)\] |\[TURN ([^\]\s]*)\] ")
CLOSER = {"INST": " [/INST]", "OUT": " </s>", "SYS": " [/SYS]"}
ROLE = {"INST": "user", "OUT": "assistant", "SYS": "system"}
CLOSERS = re.compile(r" \[/(?:INST|SYS|TURN)\]| </s>")

RENDERED = "conv_id long, turn long, role string, text string, rendered string"


class ParseError(ValueError):
    pass


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def role_name(role: str) -> str:
    """A role as one word of the header: other characters by their code point."""
    return "".join(c if c.isascii() and (c.isalnum() or c in "_-") else f".{ord(c):x}." for c in role)


def role_of(name: str) -> str:
    return re.sub(r"\.([0-9a-f]+)\.", lambda m: chr(int(m[1], 16)), name)


def render(role: str, text: str) -> str:
    head, tail = MARKS[role] if role in MARKS else (OTHER[0].format(role_name(role)), OTHER[1])
    return head + text + tail


class Reader:
    """Turns of a formatted text that comes in pieces of any size: where a turn ends is for the grammar alone to say.

    A turn ends at the first closer after its opener, which must be the opener's own. The text is looked at again when
    it has doubled, so that the work stays linear; what is kept is the turn that is still open."""

    LOOK = 1 << 16

    def __init__(self, begin: str = BEGIN):
        self.begin, self.pieces, self.size, self.look = begin, [], 0, self.LOOK

    def feed(self, piece: str) -> list[tuple[str, str]]:
        self.pieces.append(piece)
        self.size += len(piece)
        return self.read(False) if self.size >= self.look else []

    def close(self) -> list[tuple[str, str]]:
        return self.read(True)

    def read(self, last: bool) -> list[tuple[str, str]]:
        text, out, at = "".join(self.pieces), [], 0
        if self.begin:
            if not text.startswith(self.begin):
                raise ParseError(f"no {self.begin!r}")
            at, self.begin = len(self.begin), ""
        while at < len(text):
            m = OPENER.match(text, at)
            # an opener's last space may be the closer's first, if the text is empty
            c = CLOSERS.search(text, m.end()) if m else None
            if not c and not last:
                break
            if not m:
                raise ParseError(f"no opener at {at}")
            closer = CLOSER.get(m[1], OTHER[1])
            if not c or c[0] != closer:
                raise ParseError(f"no {closer!r} after {at}")
            out.append((ROLE[m[1]] if m[1] else role_of(m[2]), unescape(text[m.end() : c.start()])))
            at = c.end()
        self.pieces, self.size = [text[at:]], len(text) - at
        self.look = max(self.LOOK, 2 * self.size)
        return out


def parse(rendered: str) -> list[tuple[str, str]]:
    """The turns of a run of rendered turns."""
    r = Reader("")
    return r.feed(rendered) + r.close()


def render_checked(role: str, text: str) -> str:
    """Plain if it parses back to the turn, else with the text escaped."""
    for form in (text, escape(text)):
        out = render(role, form)
        try:
            if parse(out) == [(role, text)]:
                return out
        except ParseError:
            pass
    raise AssertionError(f"the grammar cannot hold a turn of {role!r}")


def render_turns(conversations: DataFrame) -> DataFrame:
    """RENDERED: each row with its own part of the formatted text, checked by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = [r or "" for r in batch.column(2).to_pylist()]
            texts = [t or "" for t in batch.column(3).to_pylist()]
            made = [render_checked(r, t) for r, t in zip(roles, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array(made, pa.string())], names=["conv_id", "turn", "role", "text", "rendered"])

    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).mapInArrow(X.trimmed(run), RENDERED)


def streamed(rendered: DataFrame) -> DataFrame:
    """RENDERED with each conversation's rows one after the other in turn order."""
    spark = rendered.sparkSession
    return rendered.repartition(X.partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chat(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq, piece): the formatted text of each conversation, in rows of one turn, each after
    the other. Its whole text is `<s>` and the pieces in order of seq."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq = object(), 0
        for batch in batches:
            ids, seqs = batch.column(0).to_pylist(), []
            for c in ids:
                seq, now = (seq + 1 if c == now else 0), c
                seqs.append(seq)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seqs, pa.int64()), batch.column(4)], names=["conv_id", "seq", "piece"])

    return streamed(render_turns(conversations)).mapInArrow(X.trimmed(number), "conv_id long, seq long, piece string")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, escaped_turns long, identical boolean"


def round_trip(conversations: DataFrame) -> DataFrame:
    """DIGEST of each conversation, read back from its formatted text."""

    class State:
        def __init__(self, conv):
            self.conv, self.turns, self.loss, self.source = conv, hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
            self.n = self.loss_chars = self.escaped = 0
            self.chars = len(BEGIN)
            self.reader = Reader()
            self.reader.feed(BEGIN)

        def add(self, role: str, text: str, rendered: str) -> None:
            self.chars += len(rendered)
            self.source.update(f"{role}\n{text}\n".encode())
            self.take(self.reader.feed(rendered))
            self.escaped += rendered != render(role, text)

        def take(self, turns: list[tuple[str, str]]) -> None:
            for r, t in turns:
                self.n += 1
                self.turns.update(f"{r}\n{t}\n".encode())
                if r == "assistant":
                    self.loss.update(t.encode())
                    self.loss_chars += len(t)

        def row(self) -> tuple:
            self.take(self.reader.close())
            return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.escaped, self.turns.digest() == self.source.digest()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = None, []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split(" ")[0] for x in DIGEST.split(", ")])

        for batch in batches:
            for c, r, t, x in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if state is None or state.conv != c:
                    if state:
                        out.append(state.row())
                    state = State(c)
                state.add(r, t, x)
            yield flush()
            out.clear()
        if state:
            out.append(state.row())
            yield flush()

    return streamed(render_turns(conversations)).mapInArrow(X.trimmed(fold), DIGEST)

"""Conversations to training text: turn order checked, text in segments with loss flags.

`format_chats` walks each conversation's turns in order with a finite-state machine and
emits three segments a turn (header, body, footer) from a declarative `ChatTemplate`.
Only the body of a learned role carries the loss flag. Control strings inside texts and
roles are escaped, so that `read_back` recovers every role and text from the output alone.

Rows of a conversation are brought together by one shuffle on its id and sorted on disk
by Spark. Python sees them as a stream, one Arrow batch at a time, so that a
conversation of any length needs no more memory than its longest turn. Its digest is one
SHA-256 over all of it, which is sequential by definition.

Defined cases:

* null text, null role: empty strings; null conversation id: one conversation of its own
* rows with the same turn: ordered by role, then text; repeated rows stay; null turns first
* a turn out of order (`ok` false): the text is still emitted, the machine goes on from
  that role; `read_back` reports `valid` false for the conversation
* a role without a title: written as `@` and the escaped role, never learned
* an empty table gives an empty result; other columns are ignored
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = "conv_id long, position long, part int, text string, loss boolean, ok boolean"
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, valid boolean, complete boolean"
)
HEADER, BODY, FOOTER = range(3)


@dataclass(frozen=True)
class ChatTemplate:
    """titles: role -> name in headers. moves: state -> roles allowed next (a role is a state).

    `opening` and `closing` are the control strings: no text may hold them unescaped.
    """

    titles: tuple[tuple[str, str], ...] = (
        ("system", "System"),
        ("user", "User"),
        ("assistant", "Assistant"),
    )
    opening: str = "### "
    after_title: str = ": "
    closing: str = "</turn>"
    before_closing: str = " "
    after_closing: str = "\n"
    learned: tuple[str, ...] = ("assistant",)
    moves: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("", ("system", "user")),
        ("system", ("user",)),
        ("user", ("assistant",)),
        ("assistant", ("user",)),
    )
    final: tuple[str, ...] = ("assistant",)

    def escaped(self, text: str, *more: str) -> str:
        marks = "|".join(map(re.escape, ("\\", self.opening, self.closing, *more)))
        return re.sub(f"(?={marks})", r"\\", text)

    @staticmethod
    def unescaped(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def header(self, role: str) -> str:
        title = dict(self.titles).get(role)
        if title is None:
            title = "@" + self.escaped(role, self.after_title[0])
        return self.opening + title + self.after_title

    @property
    def footer(self) -> str:
        return self.before_closing + self.closing + self.after_closing

    def turn_pattern(self) -> re.Pattern:
        titles = "|".join(re.escape(t) for _, t in self.titles)
        until = re.escape(self.after_title[0])
        return re.compile(
            f"{re.escape(self.opening)}(?:(?P<title>{titles})|@(?P<role>(?:\\\\.|[^\\\\{until}])*))"
            f"{re.escape(self.after_title)}(?P<text>.*){re.escape(self.footer)}",
            re.DOTALL,
        )


def format_chats(
    conversations: DataFrame,
    template: ChatTemplate = ChatTemplate(),
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Segments of every turn, in order within a conversation: concatenated, the training text."""
    titled, learned, moves = dict(template.titles), set(template.learned), dict(template.moves)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, position, state = object(), 0, ""
        for batch in batches:
            out: list[tuple] = []
            for conv, who, said in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv != current:
                    current, position, state = conv, 0, ""
                ok = who in moves.get(state, ())
                state = who if who in titled else "other"
                out += (
                    (conv, position, HEADER, template.header(who), False, ok),
                    (conv, position, BODY, template.escaped(said), who in learned, ok),
                    (conv, position, FOOTER, template.footer, False, ok),
                )
                position += 1
            if out:
                yield as_batch(out, SEGMENT_SCHEMA)

    rows = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(segments, SEGMENTS)


def read_back(segments: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Parse formatted segments, as `format_chats` left them, into one digest row a conversation.

    Turns are recovered from the concatenated text alone; the learned text is what lies
    under the loss flags, unescaped.
    """
    roles = {t: r for r, t in template.titles}
    allowed, pattern = dict(template.moves), template.turn_pattern()

    class Digest:
        def __init__(self, conv):
            self.conv, self.turns, self.learned, self.chars = conv, 0, 0, 0
            self.said, self.under_loss = hashlib.sha256(), hashlib.sha256()
            self.pending, self.valid, self.state = "", True, ""

        def take(self, text: str, loss: bool) -> None:
            self.chars += len(text)
            self.pending += text
            if loss:
                plain = template.unescaped(text)
                self.learned += len(plain)
                self.under_loss.update(plain.encode())
            elif text.endswith(template.footer) and (found := pattern.fullmatch(self.pending)):
                role = roles[found["title"]] if found["title"] else template.unescaped(found["role"])
                self.valid &= role in allowed.get(self.state, ())
                self.state = role if role in roles.values() else "other"
                self.turns += 1
                self.said.update(f"{role}\n{template.unescaped(found['text'])}\n".encode())
                self.pending = ""

        def row(self) -> tuple:
            return (
                self.conv, self.turns, self.said.hexdigest(), self.learned,
                self.under_loss.hexdigest(), self.chars, self.valid, self.state in template.final,
            )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = None
        for batch in batches:
            out = []
            for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss"))):
                if digest is None or conv != digest.conv:
                    if digest is not None:
                        out.append(digest.row())
                    digest = Digest(conv)
                digest.take(text, loss)
            if out:
                yield as_batch(out, DIGEST_SCHEMA)
        if digest is not None:
            yield as_batch([digest.row()], DIGEST_SCHEMA)

    return segments.mapInArrow(digests, DIGESTS)


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema
    )


SEGMENT_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("position", pa.int64()), ("part", pa.int32()), ("text", pa.string()),
     ("loss", pa.bool_()), ("ok", pa.bool_())]
)
DIGEST_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
     ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
     ("valid", pa.bool_()), ("complete", pa.bool_())]
)

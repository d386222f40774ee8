"""Chat formatting from event logs: logs are dealt by conversation and sorted, streamed pieces, edits and regenerations
are folded into final messages, and these are rendered with a loss mask.

A conversation may hold a third of all events, so the unit of work is a part of it: 256 message numbers in a row. Parts
go through tasks as sorted streams, one message in memory at a time. What reaches across parts is one number for each,
the last regeneration before it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A part holds 2 ** PART_BITS message numbers; from PIECE characters on it is cut between messages.
PART_BITS, PIECE = 8, 1 << 20
#: Rows of one Arrow batch that holds formatted texts.
ROWS = 256
#: Characters of a streamed piece in ``log_of``, or more where a text would have over so many pieces.
DELTA, DELTAS = 512, 64

EVENTS = "conv_id long, message long, entry string, seq long, kind string, role string, text string"
PIECES = "conv_id long, part long, piece int, n_turns int, formatted string, loss array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Template:
    """Marks before and after a message of each role; the closing mark tells the role. Other roles are named in theirs.

    ``controls`` are what a text must not hold: each gets a backslash behind its first character, and each backslash of
    the text is doubled. No control string begins inside a mark and ends in a text or the other way round.
    """

    roles: dict[str, tuple[str, str]]
    other: tuple[str, str, str]
    controls: tuple[str, ...]
    learnt: str

    def guard(self) -> re.Pattern:
        """Backslashes, and first characters of control strings."""
        return re.compile("|".join([r"\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)]))

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text

    def writer(self):
        """(role, text) to (marks before, text escaped, marks after)."""
        guard = self.guard()

        def write(role: str, text: str) -> tuple[str, str, str]:
            if "\\" in text or "<" in text or "[" in text:
                text = guard.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)
            if role in self.roles:
                before, after = self.roles[role]
                return before, text, after
            return self.other[0] + quote(role, safe="") + self.other[1], text, self.other[2]

        return write

    def reader(self):
        """Formatted text to its messages, in order: role and text as they were."""
        of = {close: (role, open_) for role, (open_, close) in self.roles.items()}
        closing = re.compile("|".join(map(re.escape, [*of, self.other[2]])))

        def read(formatted: str) -> Iterator[tuple[str, str]]:
            at = 0
            for mark in closing.finditer(formatted):
                if mark[0] in of:
                    role, open_ = of[mark[0]]
                    low = at + len(open_)
                else:
                    low = formatted.index(self.other[1], at) + len(self.other[1])
                    role = unquote(formatted[at + len(self.other[0]) : low - len(self.other[1])])
                yield role, self.unescape(formatted[low : mark.start()])
                at = mark.end()
            if at != len(formatted):
                raise ValueError("formatted text ends inside a message")

        return read


#: Instruction format: the user's turns between [INST] marks, the assistant's up to </s>.
INST = Template(
    {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", "</s>"), "system": ("<<SYS>>", "<</SYS>>")},
    ("<<ROLE ", ">>", "<</ROLE>>"),
    ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE ", "<</ROLE>>"),
    "assistant",
)


def log_of(conversations: DataFrame, delta: int = DELTA) -> DataFrame:
    """The event log (EVENTS) that leaves the rows of conversations (conv_id, turn, role, text) behind: each row is a
    message of its own, those of the assistant streamed in pieces of ``delta`` characters.

    Rows of one conversation and turn stay apart; they are ordered by role and by a hash of the text. Null texts are
    empty ones; other columns are not looked at.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("message"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"),
    )
    name = F.concat_ws("\n", "role", F.lpad(F.hex(F.xxhash64("text")), 16, "0"), F.lpad(F.hex("row"), 16, "0"))
    size = F.greatest(F.lit(delta), F.ceil(F.length("text") / DELTAS)).cast("int")
    numbers = F.when(F.col("role") == "assistant", F.sequence(F.lit(1), F.greatest(F.ceil(F.length("text") / F.col("size")), F.lit(1)).cast("int")))
    whole = F.col("seq") == 0
    return (
        rows.withColumn("size", size)
        .select("*", name.alias("entry"), F.explode(F.coalesce(numbers, F.array(F.lit(0)))).alias("seq"))
        .select(
            "conv_id", "message", "entry", F.col("seq").cast("long").alias("seq"), F.when(whole, "message").otherwise("delta").alias("kind"), "role",
            F.when(whole, F.col("text")).otherwise(F.substring("text", (F.col("seq") - 1) * F.col("size") + 1, F.col("size"))).alias("text"),
        )
    )


def _part(message: Column) -> Column:
    return F.coalesce(F.shiftright(message, PART_BITS), F.lit(-(1 << 62)))


def rendered(events: DataFrame, template: Template = INST, piece: int = PIECE) -> DataFrame:
    """Formatted conversations (PIECES): the rows of a conversation in order of part and piece, put together, are its
    text; ``loss`` holds the places (code points from 0, end exclusive) of what is learnt in the row's text.

    events (conv_id, message, seq, kind, role, text; entry may be missing) are sorted by seq, ties by kind and text,
    and folded for each message: ``message`` writes it, ``delta`` appends, ``edit`` replaces its text, ``regenerate``
    empties it and takes back what was said in later messages before that event, ``delete`` removes it with its role. Messages follow
    their numbers, those of one number their entries; the role is the last one named. Null texts are empty, a null seq
    comes first, a null message number before all others; null conversations are one conversation; events of other
    kinds or of none count for nothing. Repeated events apply each time. Other columns are not looked at.
    """
    entry = F.coalesce(F.col("entry"), F.lit("")) if "entry" in events.columns else F.lit("")
    kinds = ("message", "delta", "edit", "regenerate", "delete")
    e = events.where(F.col("kind").isin(*kinds)).select(
        "conv_id", _part(F.col("message")).alias("part"), "message", entry.alias("entry"), F.coalesce("seq", F.lit(-(1 << 62))).alias("seq"), "kind", "role", "text"
    )
    # the last regeneration of the parts before, where there is one; a row for each part that regenerates or is after
    parts = e.groupBy("conv_id", "part").agg(F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("last"))
    before = F.max("last").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    floors = parts.withColumn("seq", before).where("seq is not null").select(
        "conv_id", "part", F.lit(None).cast("long").alias("message"), F.lit("").alias("entry"), "seq", F.lit("floor").alias("kind"),
        F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
    )
    dealt = e.unionByName(floors).repartition("conv_id", "part").sortWithinPartitions(
        "conv_id", "part", F.col("kind") != "floor", "message", "entry", "seq", "kind", "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write, out = template.writer(), _Rows(piece, template.learnt)
        here, message, floor, next_floor = None, None, None, None
        role, texts, alive = "", [], False

        def close():
            if alive:
                out.add(here, *write(role, "".join(texts)), role)

        for batch in batches:
            for conv, part, number, name, seq, kind, said, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv, part) != here or here is None:
                    close()
                    here, message, alive, floor, next_floor = (conv, part), None, False, None, None
                if kind == "floor":
                    floor = next_floor = seq
                    continue
                if (number, name) != message or message is None:
                    close()
                    if message is None or number != message[0]:
                        floor = next_floor
                    message, role, texts, alive = (number, name), "", [], False
                if kind == "regenerate":
                    next_floor = seq if next_floor is None else max(seq, next_floor)
                if floor is not None and seq < floor:
                    continue
                alive = kind != "delete"
                if kind != "delta":
                    texts = []
                if kind not in ("regenerate", "delete") and text:
                    texts.append(text)
                role = "" if kind == "delete" else said if said is not None else role
                if len(out.rows) >= ROWS or out.held >= piece * 4:
                    yield out.batch()
        close()
        yield out.batch(last=True)

    return dealt.mapInArrow(run, PIECES)


class _Rows:
    """Formatted rows: one for each part, more where it is longer than ``piece`` characters."""

    def __init__(self, piece: int, learnt: str):
        self.piece, self.learnt, self.rows, self.held = piece, learnt, [], 0
        self.here, self.number = None, 0
        self._new()

    def _new(self):
        self.texts, self.loss, self.at, self.turns = [], [], 0, 0

    def _end(self):
        if self.turns:
            self.rows.append((*self.here, self.number, self.turns, "".join(self.texts), self.loss))
            self.held += self.at
        self._new()

    def add(self, here, before: str, text: str, after: str, role: str):
        if here != self.here:
            self._end()
            self.here, self.number = here, 0
        elif self.at and self.at + len(text) > self.piece:
            self._end()
            self.number += 1
        self.texts += (before, text, after)
        low = self.at + len(before)
        if role == self.learnt and text:
            self.loss.append({"start": low, "end": low + len(text)})
        self.at = low + len(text) + len(after)
        self.turns += 1

    def batch(self, last: bool = False) -> pa.RecordBatch:
        if last:
            self._end()
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        names = ("conv_id", "part", "piece", "n_turns", "formatted", "loss")
        columns = list(zip(*self.rows, strict=True)) or [()] * len(types)
        self.rows, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def messages(pieces: DataFrame, template: Template = INST) -> DataFrame:
    """conv_id, part, piece, place, role, text: the messages read back from formatted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = template.reader()
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(read(batch["formatted"][i].as_py()))
                keys = [pa.array([batch[c][i].as_py()] * len(found), t) for c, t in (("conv_id", pa.int64()), ("part", pa.int64()), ("piece", pa.int32()))]
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(range(len(found)), pa.int32()), pa.array([r for r, _ in found], pa.string()), pa.array([t for _, t in found], pa.string())],
                    names=["conv_id", "part", "piece", "place", "role", "text"],
                )

    return pieces.select("conv_id", "part", "piece", "formatted").mapInArrow(run, "conv_id long, part long, piece int, place int, role string, text string")


def digests(pieces: DataFrame, template: Template = INST) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, from formatted
    rows alone: messages are read back, learnt text is cut out by its places.

    A hash over a conversation is made in order, so its rows pass one task, one at a time: two running hashes and four
    numbers are all it holds. Conversations whose messages were all taken back are not in formatted rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, rows, here = template.reader(), [], None
        for batch in batches:
            for conv, formatted, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here is None or conv != here[0]:
                    if here:
                        rows.append(_ended(here))
                    here = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read(formatted):
                    here[1] += 1
                    here[2].update(f"{role}\n{text}\n".encode())
                for place in loss:
                    text = template.unescape(formatted[place["start"] : place["end"]])
                    here[3] += len(text)
                    here[4].update(text.encode())
                here[5] += len(formatted)
            if len(rows) >= 10_000:
                yield _digest_batch(rows)
                rows = []
        yield _digest_batch([*rows, _ended(here)] if here else rows)

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return ordered.select("conv_id", "formatted", "loss").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def _ended(here: list) -> tuple:
    return (here[0], here[1], here[2].hexdigest(), here[3], here[4].hexdigest(), here[5])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))

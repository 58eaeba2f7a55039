"""Chat formatting by prefix-target expansion.

A turn becomes a segment ``<|im_start|>role LF text<|im_end|> LF``; control strings inside roles and texts
are escaped reversibly (each ``<``, backslashes, ``|`` gets one more backslash). Every assistant turn
is the target of its own example: all preceding turns of the conversation are its context, and only
that reply's text is trainable. ``expand`` makes every example in full, so a conversation's output
grows with the square of its turns. ``store`` writes them as Parquet, with the turns after a
conversation's last target, which are in no example; ``digest`` computes from stored rows alone.

Defined cases: a null text or role is empty; turns sort by turn, role, text, nulls first, equal ones
count each; a null conversation id is a conversation; a conversation without assistant turns has no
example and formatted_chars of 0, but its turns are read back; very long texts and conversations are
written whole, one example at a time; an empty table gives an empty table; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise

START, END, TARGET = "<|im_start|>", "<|im_end|>", "assistant"
SEGMENT = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
BATCH_CHARS = 4 << 20
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def format_turns(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Segments: (conv_id, turn, role, text, segment, loss_start, loss_end, is_target).

    loss_start and loss_end bound the trainable characters of a target's segment; others have none.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    head = F.concat(F.lit(START), _escape_role(role), F.lit("\n"))
    body = escape(text)
    target = role == TARGET
    return turns.select(
        F.col(id_col).alias("conv_id"),
        F.col("turn").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.concat(head, body, F.lit(END + "\n")).alias("segment"),
        F.when(target, F.length(head)).alias("loss_start"),
        F.when(target, F.length(head) + F.length(body)).alias("loss_end"),
        target.alias("is_target"),
    )


def in_order(segments: DataFrame) -> DataFrame:
    """Whole conversations in a partition, their segments in order."""
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _written(segments: DataFrame) -> DataFrame:
    """Examples in full and, with a null example, the turns after a conversation's last target.

    A conversation's rows follow each other in one partition. The prefix is built turn by turn; the
    last example of a conversation is marked. A batch ends at BATCH_CHARS, so few examples are held.
    """
    names = ["conv_id", "example", "target_turn", "text", "loss_start", "loss_end", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = object()
        prefix, at, example, chars = "", 0, 0, 0
        rows: list[list] = []  # a conversation's latest example stays until it is known whether it is the last
        waiting: list | None = None
        kinds: list[pa.DataType] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        def close() -> None:
            if waiting:
                rows.append([*waiting, True])
            if at < len(prefix):
                rows.append([conv, None, None, prefix[at:], None, None, True])

        for b in batches:
            kinds = [b.schema.field("conv_id").type, pa.int64(), b.schema.field("turn").type, pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            cols = (b.column(c).to_pylist() for c in ("conv_id", "turn", "segment", "loss_start", "loss_end", "is_target"))
            for c, turn, segment, start, end, target in zip(*cols, strict=True):
                if c != conv:
                    close()
                    chars += len(prefix)
                    conv, prefix, at, example, waiting = c, "", 0, 0, None
                whole = prefix + segment
                if target:
                    if waiting:
                        rows.append([*waiting, False])
                        chars += at
                    waiting = [c, example, turn, whole, len(prefix) + start, len(prefix) + end]
                    at, example = len(whole), example + 1
                prefix = whole
                if chars >= BATCH_CHARS and rows:
                    yield flush()
                    rows, chars = [], 0
        close()
        if rows:
            yield flush()

    kinds = dict(segments.dtypes)
    return in_order(segments).mapInArrow(run, f"conv_id {kinds['conv_id']}, example long, target_turn {kinds['turn']}, text string, loss_start long, loss_end long, last boolean")


def expand(segments: DataFrame) -> DataFrame:
    """Examples in full: (conv_id, example, target_turn, text, loss_start, loss_end)."""
    return _written(segments).where("example is not null").drop("last")


def store(segments: DataFrame) -> DataFrame:
    """The written examples and closing turns, as read from the shared folder."""
    return materialise(_written(segments), "examples")


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each stored row its characters, checksum and loss; the text only of last examples and closing turns."""
    for b in batches:
        examples, texts = b.column("example").to_pylist(), b.column("text").to_pylist()
        loss = [None if e is None else unescape(t[lo:hi]) for e, t, lo, hi in zip(examples, texts, b.column("loss_start").to_pylist(), b.column("loss_end").to_pylist(), strict=True)]
        whole = [t if last else None for t, last in zip(texts, b.column("last").to_pylist(), strict=True)]
        crc = [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts]
        columns = [b.column("conv_id"), b.column("example"), pa.array([*map(len, texts)], pa.int64()), pa.array(crc, pa.int64()), pa.array(loss, pa.string()), pa.array(whole, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "example", "chars", "crc", "loss", "whole"])


DIGESTS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples", "expanded_chars"]


class _Conversation:
    """The digests of one conversation's stored rows, which come by example, closing turns last."""

    def __init__(self, conv: object):
        self.conv = conv
        self.loss, self.loss_chars, self.chars = hashlib.sha256(), 0, 0
        self.seen: list[tuple[int, int]] = []
        self.text = ""

    def add(self, example: int | None, chars: int, crc: int, loss: str | None, whole: str | None) -> None:
        self.text += whole or ""
        if example is None:
            return
        if example != len(self.seen):
            raise ValueError(f"conversation {self.conv}: example {len(self.seen)} is missing")
        self.seen.append((chars, crc))
        self.chars += chars
        self.loss_chars += len(loss)
        self.loss.update(loss.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        """Turns are those of the last example and after it; every earlier example must be a prefix of it."""
        turns, n, at, crc = hashlib.sha256(), 0, 0, 0
        ends: list[tuple[int, int]] = []
        for m in SEGMENT.finditer(self.text):
            if m.start() != at:
                break
            role = unescape_role(m[1])
            turns.update(f"{role}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
            n, at, crc = n + 1, m.end(), zlib.crc32(m[0].encode("utf-8", "surrogatepass"), crc)
            if role == TARGET:
                ends.append((at, crc))
        if at != len(self.text) or ends != self.seen:
            raise ValueError(f"conversation {self.conv}: malformed examples")
        return (self.conv, n, turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, len(self.seen), self.chars)


def digest(stored: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples,
    expanded_chars) of each conversation in stored rows; the loss is what the examples' masks bound,
    formatted_chars counts the examples' characters; expanded_chars is the same number.

    Only the losses, the last examples and the closing turns are shuffled.
    """
    kind = dict(stored.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        done: list[tuple] = []
        id_kind = None

        def flush() -> pa.RecordBatch:
            kinds = [id_kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], DIGESTS)

        for b in batches:
            id_kind = b.schema.field("conv_id").type
            for conv, *rest in zip(*(b.column(c).to_pylist() for c in ("conv_id", "example", "chars", "crc", "loss", "whole")), strict=True):
                if now is None or conv != now.conv:
                    if now:
                        done.append(now.row())
                    if len(done) >= 5000:
                        yield flush()
                        done = []
                    now = _Conversation(conv)
                now.add(*rest)
        if now:
            done.append(now.row())
        if done:
            yield flush()

    parts = stored.mapInArrow(_read_rows, f"conv_id {kind}, example long, chars long, crc long, loss string, whole string")
    parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", F.col("example").asc_nulls_last())
    return parts.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, expanded_chars long")


def read_back(segments: DataFrame) -> DataFrame:
    """Write all examples out, read them back and digest each conversation."""
    return digest(store(segments))

"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. The renderings of successive prefixes of a
conversation are compared: where each begins with the one before, what it adds is the last turn's span. Where it does
not, the template rewrites history; the turn at which that happened is flagged, and what it adds begins where the two
renderings part. Within a turn's span the text's own place is where renderings with two different marks instead of the
text differ.

Conversations are sorted, not gathered: a task reads turns in order and keeps those of one conversation. Each prefix is
rendered whole, so work grows with the square of a conversation's turns. A template that is declared prefix-stable
(`prefix_stable`: a turn's piece depends on that turn alone) may be given a `lookback`: from so many turns on, the first
turn and the last few stand for the prefix.

The template `tagged` marks turns by control strings and escapes their first characters within texts and roles, so that
no text can hold a control string and the output can be read back exactly.

Defined results: null text or role is empty; turns are taken in order of turn, role and text, nulls first, repeats
included; a null conv_id is a conversation of its own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame

OPEN, BODY, CLOSE = "<|turn|>", "<|says|>", "<|done|>\n"
Turn = tuple[str, str]


def escape(text: str) -> str:
    """No '<' and no '[' remains, hence no control string of this or of a common other template; reversible."""
    return text.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b")


def unescape(text: str) -> str:
    parts = text.split("\\\\")
    return "\\".join(p.replace("\\l", "<").replace("\\b", "[") for p in parts)


def tagged(turns: list[Turn]) -> str:
    return "".join(f"{OPEN}{escape(role)}{BODY}{escape(text)}{CLOSE}" for role, text in turns)


tagged.prefix_stable = True


def read_turn(piece: str) -> Turn:
    """The (role, text) that `tagged` wrote into one turn's span."""
    role, text = piece.removeprefix(OPEN).removesuffix(CLOSE).split(BODY)
    return unescape(role), unescape(text)


class Spans:
    """Spans of one conversation's turns, one turn after another."""

    def __init__(self, render: Callable[[list[Turn]], str], lookback: int | None = None):
        if lookback is not None and not getattr(render, "prefix_stable", False):
            raise ValueError("a lookback needs a template that is declared prefix_stable")
        self.render, self.lookback = render, lookback
        self.turns, self.before, self.at, self.seen = [], render([]), 0, 0

    def add(self, turn: Turn) -> tuple[int, str, int, int, bool]:
        """Start of the turn's span in the whole, what the span holds, the text's start and end in it, whether history changed."""
        if self.lookback is not None and len(self.turns) >= self.lookback:  # the first turn and the latest stand for the prefix
            self.turns = [self.turns[0], *self.turns[-(self.lookback // 2) :]]
            self.before = self.render(self.turns)
        turns = [*self.turns, turn]
        now = self.render(turns)
        rewritten = not now.startswith(self.before)
        known = len(commonprefix([self.before, now])) if rewritten else len(self.before)
        marks = [self.render([*self.turns, (turn[0], mark)]) for mark in "\x00\x01"]
        head = len(commonprefix(marks))
        tail = min(map(len, marks)) - head - 1  # marks are one character long
        start = self.at if self.seen else 0
        if not self.seen:  # what the template writes before any turn belongs to the first span
            known = 0
        piece = now[known:]
        out = start, piece, head - known, len(now) - tail - known, rewritten
        self.turns, self.before, self.at, self.seen = turns, now, start + len(piece), self.seen + 1
        return out


def format_turns(rows: DataFrame, render: Callable[[list[Turn]], str] = tagged, trained: tuple[str, ...] = ("assistant",), lookback: int | None = None) -> DataFrame:
    """A row per turn, in order within each task: conv_id, nth, start, formatted, text_start, text_end, trained, rewritten.

    start is the span's place in the conversation's whole rendering; text_start and text_end lie within `formatted`."""
    Spans(render, lookback)  # refuses a lookback here, not in a task
    names = ["conv_id", "nth", "start", "formatted", "text_start", "text_end", "trained", "rewritten"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, conv, any_yet = None, None, False
        for b in batches:
            out = []
            for c, role, text in zip(*(b.column(i).to_pylist() for i in (0, 2, 3))):
                if not any_yet or c != conv:
                    spans, conv, any_yet = Spans(render, lookback), c, True
                nth = spans.seen
                start, piece, a, z, rewritten = spans.add((role or "", text or ""))
                out.append((c, nth, start, piece, a, z, (role or "") in trained, rewritten))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=names)

    order = ["conv_id", "turn", "role", "text"]
    ddl = "conv_id long, nth long, start long, formatted string, text_start long, text_end long, trained boolean, rewritten boolean"
    return rows.select(*order).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, ddl)


def digests(formatted: DataFrame, read: Callable[[str], Turn] = read_turn, undo: Callable[[str], str] = unescape) -> DataFrame:
    """A row per conversation, read back from format_turns' rows in the order in which it gives them."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    utf8 = lambda s: s.encode("utf-8", "surrogatepass")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def closed():
            return (now["id"], now["n"], now["turns"].hexdigest(), now["loss"], now["masked"].hexdigest(), now["chars"], now["rewritten"])

        for b in batches:
            out = []
            for row in b.to_pylist():
                if row["nth"] == 0:
                    if now:
                        out.append(closed())
                    now = {"id": row["conv_id"], "n": 0, "turns": hashlib.sha256(), "loss": 0, "masked": hashlib.sha256(), "chars": 0, "rewritten": False}
                piece = row["formatted"]
                role, text = read(piece)
                now["turns"].update(utf8(f"{role}\n{text}\n"))
                if row["trained"]:
                    masked = undo(piece[row["text_start"] : row["text_end"]])
                    now["loss"] += len(masked)
                    now["masked"].update(utf8(masked))
                now["n"] += 1
                now["chars"] += len(piece)
                now["rewritten"] |= row["rewritten"]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(closed(), kinds)], names=names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten boolean")

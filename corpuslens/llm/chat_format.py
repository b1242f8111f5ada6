"""Chat formatting that is read back before it is let out."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean_batches

START, END = "<|im_start|>", "<|im_end|>"
ESCAPED = re.compile(r"<\\(\\*\|im_(?:start|end)\|>)")
CONTROL = re.compile(r"<(\\*\|im_(?:start|end)\|>)")


def escape(text: str) -> str:
    """A backslash after the < of each control string, and of each string that has some already."""
    return CONTROL.sub(r"<\\\1", text)


def unescape(text: str) -> str:
    """Takes the backslash away that escape put in."""
    return ESCAPED.sub(r"<\1", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """The turns of rendered text: role, text, and where the text's escaped form begins and ends.

    Grammar: turns follow each other, each START role newline body END newline; a role ends at the
    first newline, a body at the first END, and neither holds START. Anything else is an error.
    """
    turns, at = [], 0
    while at < len(rendered):
        line, stop = rendered.find("\n", at), rendered.find(END, at)
        if not rendered.startswith(START, at) or not at < line < stop or rendered.find(START, at + 1, stop) >= 0 or rendered[stop + len(END) : stop + len(END) + 1] != "\n":
            raise ValueError(f"no turn at {at}")
        turns.append((unescape_role(rendered[at + len(START) : line]), unescape(rendered[line + 1 : stop]), line + 1, stop))
        at = stop + len(END) + 1
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and the span of its text; escapes what conflicts until the parser gives the source back."""
    for role_form, text_form in ((role, text), (role, escape(text)), (escape_role(role), escape(text))):
        rendered = f"{START}{role_form}\n{text_form}{END}\n"
        try:
            turns = parse(rendered)
        except ValueError:
            continue
        if [x[:2] for x in turns] == [(role, text)]:
            return rendered, turns[0][2], turns[0][3]
    raise ValueError("the grammar can't carry this turn")


def format_turns(conversations: DataFrame, *, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Each turn of conversations(conv_id, turn, role, text) rendered: conv_id, turn, rendered, loss_from, loss_to.

    A conversation's text is its rendered turns in order, one after the other. loss_from and
    loss_to are the characters of the turn that are learned from; both 0 for other roles. Null role
    or text counts as empty. Rows stay where they are, however long their conversation is; an empty
    table gives an empty table; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [render(r or "", t or "") for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            learned = [r in learn_from for r in batch.column(2).to_pylist()]
            spans = [(i, j) if ok else (0, 0) for (_, i, j), ok in zip(made, learned, strict=True)]
            columns = [batch.column(0), batch.column(1), pa.array([x[0] for x in made], pa.string()), *[pa.array([s[k] for s in spans], pa.int64()) for k in (0, 1)]]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "rendered", "loss_from", "loss_to"])

    lean_batches(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "conv_id long, turn long, rendered string, loss_from long, loss_to long")


def read_back(turns: DataFrame) -> DataFrame:
    """What the output of format_turns says, by its parser: a row for each conversation.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Turns of a conversation
    are sorted across the cluster and stream through two running digests, so one of any length takes
    no more memory than a batch. Ties of turn are in the order of their rendered text. Rows without a
    conv_id are one conversation, whose turns go through one task as those of any other do: its
    digest takes them in order. A turn of any length is rendered, parsed and compared whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, done, state = object(), [], None

        def close() -> None:
            if state is not None:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for conv, rendered, i, j in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(rendered):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                learned = unescape(rendered[i:j])
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(rendered)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "rendered").select("conv_id", "rendered", "loss_from", "loss_to")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

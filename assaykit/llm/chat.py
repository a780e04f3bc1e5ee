"""Chat formatting by columnar byte assembly.

All turns of a batch are formatted at once: control strings inside texts are escaped by vectorised replacement,
segment lengths and their running sums give every segment's place, and headers, texts and footers are scattered
from three byte columns into one preallocated buffer, which becomes the Arrow column of formatted conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.wordhash import string_buffer


@dataclass(frozen=True)
class Template:
    """A turn is ``open + role + close + text + end``; ``controls`` never appear unescaped inside a role or text.

    Escaping doubles backslashes and puts one after the first character of every control string, so removing one
    level of backslashes restores the text exactly.
    """

    open: str = "<|"
    close: str = "|>\n"
    end: str = "</s>\n"
    controls: tuple[str, ...] = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    trained: tuple[str, ...] = ("assistant",)


_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(column: pa.Array, template: Template) -> pa.Array:
    column = pc.replace_substring(column, "\\", "\\\\")
    for c in template.controls:
        column = pc.replace_substring(column, c, f"{c[0]}\\{c[1:]}")
    return column


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def assemble(segments: list[pa.Array], groups: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Concatenate the segments of each row, and the rows of each group, into one string per group.

    ``groups`` holds the first row of every group and the number of rows. Also gives each segment's first byte,
    ``[row, segment]``, counted from its group's first.
    """
    buffers = [string_buffer(s) for s in segments]
    lengths = np.stack([np.diff(o) for _, o in buffers], axis=1)
    rows, width = lengths.shape
    at = np.zeros(rows * width + 1, np.int64)
    np.cumsum(lengths.ravel(), out=at[1:])
    out = np.empty(at[-1], np.uint8)
    start = at[:-1].reshape(rows, width)
    for j, (raw, offsets) in enumerate(buffers):
        # Byte i of a column goes to its segment's start plus its place within the segment.
        out[np.arange(len(raw)) + np.repeat(start[:, j] - offsets[:-1], lengths[:, j])] = raw
    bounds = at[groups * width]
    column = pa.LargeStringArray.from_buffers(len(groups) - 1, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(out))
    return column, start - np.repeat(bounds[:-1], np.diff(groups))[:, None]


def _chars(raw: np.ndarray) -> np.ndarray:
    """Running count of code points before each byte."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out


def _format(table: pa.Table, template: Template) -> pa.RecordBatch:
    """One row per run of equal ``conv_id``: its text and the character spans of trained texts."""
    ids = table.column("conv_id").to_pylist()
    first = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]]
    groups = np.array([*first, len(ids)], np.int64)
    text, role = (escape(pc.fill_null(table.column(c).combine_chunks().cast(pa.large_string()), ""), template) for c in ("text", "role"))
    fixed = lambda s: pa.array([s] * len(ids), pa.large_string())
    column, start = assemble([fixed(template.open), role, fixed(template.close), text, fixed(template.end)], groups)
    raw, offsets = string_buffer(column)
    chars = _chars(raw)
    base = np.repeat(offsets[:-1], np.diff(groups))
    lo, hi = (chars[start[:, j] + base] - chars[base] for j in (3, 4))
    trained = np.array([r in template.trained for r in table.column("role").to_pylist()], bool)
    counts = np.add.reduceat(trained.astype(np.int64), groups[:-1]) if len(first) else np.zeros(0, np.int64)
    ends = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array([ids[i] for i in first], pa.int64()), column.cast(pa.string()), pa.ListArray.from_arrays(ends, pa.array(lo[trained].astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(hi[trained].astype(np.int32)))],
        ["conv_id", "formatted", "loss_from", "loss_to"],
    )


def format_chats(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """``conv_id, formatted, loss_from, loss_to``: a row per conversation, with the character spans under the loss mask.

    ``rows`` has ``conv_id, turn, role, text``; further columns are ignored. Turns stand by ``turn`` (nulls first), ties
    by role, then text, so repeated rows are turns of their own. A null role or text is empty; rows whose ``conv_id`` is
    null make up one conversation without an id. An empty table gives none. A conversation is one row of the result
    and has to fit into memory; a task holds little more than one Arrow batch and the conversation at its end.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            last = ids[-1].as_py()
            same = pc.is_null(ids) if last is None else pc.fill_null(pc.equal(ids, last), False)
            cut_at = batch.num_rows - int(pc.sum(pc.cast(same, pa.int64())).as_py())
            if cut_at or (held and held[-1].column(0)[-1].as_py() != last):
                ready = pa.Table.from_batches([*held, batch.slice(0, cut_at)]) if cut_at else pa.Table.from_batches(held)
                if ready.num_rows:
                    yield _format(ready, template)
                held = []
            held.append(batch.slice(cut_at))
        if held:
            yield _format(pa.Table.from_batches(held), template)

    r = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    r = r.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return r.mapInArrow(kernel, "conv_id long, formatted string, loss_from array<int>, loss_to array<int>")


def parse_chat(formatted: str, template: Template = Template()) -> list[tuple[str, str]]:
    """The ``(role, text)`` turns of a formatted conversation; the exact inverse of formatting."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(template.open, at):
            raise ValueError(f"no turn begins at {at}")
        close = formatted.index(template.close, at + len(template.open))
        body = close + len(template.close)
        end = formatted.index(template.end, body)
        turns.append((unescape(formatted[at + len(template.open) : close]), unescape(formatted[body:end])))
        at = end + len(template.end)
    return turns


def read_back(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of what formatted conversations hold, read from their text and loss spans alone."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                turns = parse_chat(text, template)
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                loss = "".join(unescape(text[a:b]) for a, b in zip(lo, hi))
                out.append((conv, len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return chats.select("conv_id", "formatted", "loss_from", "loss_to").mapInArrow(kernel, schema)

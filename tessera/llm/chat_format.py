"""Chat formatting: turns of a conversation become one training text and the spans its loss covers.

Template per turn: `<|turn|>role<|text|>text<|end|>\\n`. Inside role and text a backslash precedes each
backslash and each `<|`, so no control string occurs there and unescape() restores every text. Loss
spans are code points of the formatted text; they hold the escaped text of assistant turns and nothing else.

Rows are dealt by conversation and sorted, then assembled batch by batch: segment lengths, cumulative
offsets and gather indices in numpy, headers and contents copied into one preallocated Arrow buffer. A
conversation that crosses a batch comes out as several consecutive parts, so memory is bounded by the
batch however long a conversation is.

Defined results: null text and role are empty; null conv_id is a conversation of its own; null turns
come first; ties in turn are ordered by role, then text; repeated rows are repeated turns; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import blocks, utf8

TURN, TEXT, END = b"<|turn|>", b"<|text|>", b"<|end|>\n"
FORMATTED = "conv_id long, part int, last boolean, formatted string, loss array<struct<start: long, stop: long>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_BODY = r"((?:[^\\<]|\\.|<(?!\|))*+)"
_TURN = re.compile(rf"<\|turn\|>{_BODY}<\|text\|>{_BODY}<\|end\|>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escaped(column: pa.Array) -> pa.Array:
    column = pc.fill_null(column.cast(pa.large_string()), "")
    column = pc.replace_substring(column, "\\", "\\\\")
    return pc.replace_substring(column, "<|", "\\<|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def _assemble(keys: list, roles: pa.Array, texts: pa.Array) -> tuple[list, list[int], pa.Array, pa.Array]:
    """One formatted text for each run of equal keys: run keys, formatted texts, loss spans."""
    assistant = pc.fill_null(pc.equal(roles, "assistant"), False).to_numpy(zero_copy_only=False)
    r, t = utf8(escaped(roles)), utf8(escaped(texts))
    fixed = np.frombuffer(TURN + TEXT + END, np.uint8)
    source = np.concatenate([fixed, r.data, t.data])
    n = len(keys)
    lengths = np.empty((n, 5), np.int64)
    origin = np.empty((n, 5), np.int64)
    lengths[:, 0], origin[:, 0] = len(TURN), 0
    lengths[:, 1], origin[:, 1] = np.diff(r.offsets), len(fixed) + r.offsets[:-1]
    lengths[:, 2], origin[:, 2] = len(TEXT), len(TURN)
    lengths[:, 3], origin[:, 3] = np.diff(t.offsets), len(fixed) + len(r.data) + t.offsets[:-1]
    lengths[:, 4], origin[:, 4] = len(END), len(TURN) + len(TEXT)
    flat = lengths.ravel()
    to = np.cumsum(flat) - flat
    total = int(flat.sum())
    gather = np.arange(total) + np.repeat(origin.ravel() - to, flat)
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8)
    np.take(source, gather, out=out)

    fresh = np.array([True] + [keys[i] != keys[i - 1] for i in range(1, n)])
    first = np.flatnonzero(fresh)
    ends = np.append(to.reshape(n, 5)[first, 0], total)
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    run = np.cumsum(fresh) - 1
    begin = to.reshape(n, 5)[:, 3]
    base = points[ends[run]]
    spans = pa.StructArray.from_arrays([pa.array((points[begin] - base)[assistant]), pa.array((points[begin + lengths[:, 3]] - base)[assistant])], ["start", "stop"])
    per_run = np.bincount(run[assistant], minlength=len(first))
    loss = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_run)]), pa.int32()), spans)
    texts_out = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends.astype(np.int64).tobytes()), buffer)
    return [keys[i] for i in first], texts_out, loss


def _format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("last", pa.bool_()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
    held = None  # the latest run waits until it is known whether its conversation goes on
    for batch in batches:
        for block in blocks(batch.column("text")):
            rows = batch.slice(block.first, len(block))
            keys, texts, loss = _assemble(rows.column("conv_id").to_pylist(), rows.column("role"), rows.column("text"))
            goes_on = held is not None and held["conv_id"][0].as_py() == keys[0]
            part = held["part"][0].as_py() + 1 if goes_on else 0
            made = {"conv_id": pa.array(keys, pa.int64()), "part": pa.array([part] + [0] * (len(keys) - 1), pa.int32()), "formatted": texts.cast(pa.string()), "loss": loss}
            if held is not None:
                yield pa.RecordBatch.from_arrays([held["conv_id"], held["part"], pa.array([not goes_on]), held["formatted"], held["loss"].cast(schema.field("loss").type)], schema=schema)
            done = len(keys) - 1
            if done:
                yield pa.RecordBatch.from_arrays([made["conv_id"][:done], made["part"][:done], pa.array([True] * done), made["formatted"][:done], made["loss"][:done].cast(schema.field("loss").type)], schema=schema)
            held = {k: pa.concat_arrays([v[done:]]) for k, v in made.items()}
    if held is not None:
        yield pa.RecordBatch.from_arrays([held["conv_id"], held["part"], pa.array([True]), held["formatted"], held["loss"].cast(schema.field("loss").type)], schema=schema)


def format_conversations(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) as FORMATTED rows: the parts of a conversation, in order, are its text.

    One shuffle, by conversation: the turns of one conversation are one sequence, which one task
    streams through in sorted order without gathering it."""
    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id")
    rows = rows.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(_format_batches, FORMATTED)


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    turns, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
    for batch in batches:
        rows = []
        for conv, last, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "last", "formatted", "loss")), strict=True):
            for role, said in parse(text):
                turns.update(f"{role}\n{said}\n".encode())
                n += 1
            for s in spans:
                said = unescape(text[s["start"] : s["stop"]])
                chars += len(said)
                loss.update(said.encode())
            size += len(text)
            if last:
                rows.append({"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size})
                turns, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def digests(formatted: DataFrame) -> DataFrame:
    """What each conversation holds, read from its formatted text alone. Conversations of one part,
    nearly all, need no shuffle; the parts of the others are brought into order first."""
    whole = (F.col("part") == 0) & F.col("last")
    rest = formatted.where(~whole).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return formatted.where(whole).mapInArrow(_digest_batches, DIGESTS).unionByName(rest.mapInArrow(_digest_batches, DIGESTS))

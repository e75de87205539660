"""Conversations rendered by a compiled template, with the spans that a model is to learn, and read back again.

Rows of one conversation meet in one task in turn order and stream through the template; what is held is the longest turn
and one piece of output, however many turns a conversation has. The formatted text of a conversation comes as one row, or as
several pieces in order where it exceeds ``piece_chars``.

Defined results: turns with equal numbers are ordered by role and text; null text and null role count as empty; rows whose
conversation id is null form one conversation; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.chat_template import Guard, Template

#: The strings that mark turns, open and close.
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE] ", " [TEXT] ", " [/ROLE]")
CONTROLS = ("[SYS]", "[/SYS]", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[TEXT]", "[/ROLE]")
DEFAULT = """
{%- for m in messages -%}
  {%- if m.role == 'assistant' -%}
    {{ '<s>' }}{% generation %}{{ m.text | guard }}{% endgeneration %}{{ '</s>' }}
  {%- elif m.role == 'user' -%}
    {{ '[INST] ' }}{{ m.text | guard }}{{ ' [/INST]' }}
  {%- elif m.role == 'system' -%}
    {{ '[SYS] ' }}{{ m.text | guard }}{{ ' [/SYS]' }}
  {%- else -%}
    {{ '[ROLE] ' }}{{ m.role | guard }}{{ ' [TEXT] ' }}{{ m.text | guard }}{{ ' [/ROLE]' }}
  {%- endif -%}
{%- endfor -%}
"""
FORMATTED = "conv_id long, piece int, formatted string, loss_spans array<struct<start:int,stop:int>>"
FORMATTED_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("piece", pa.int32()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]
)
PIECE_CHARS = 1 << 20


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True)


def in_batches(rows: Iterator[tuple], schema: pa.Schema, weight: int, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """``rows`` as Arrow batches of about ``limit`` characters; ``weight`` is the column that counts."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 64 + len(row[weight] or "")
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def format_conversations(turns: DataFrame, template: str = DEFAULT, controls: tuple[str, ...] = CONTROLS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``conv_id, piece, formatted, loss_spans`` (spans in code points of the piece) from ``conv_id, turn, role, text``."""

    def pieces(compiled: Template, conv: int | None, messages: Iterator[dict]) -> Iterator[tuple]:
        piece, size = 0, 0
        parts: list[str] = []
        spans: list[dict] = []
        for text, generated in compiled.stream(messages=messages):
            if generated and text:
                spans.append({"start": size, "stop": size + len(text)})
            parts.append(text)
            size += len(text)
            if size >= piece_chars:
                yield conv, piece, "".join(parts), spans
                piece, size, parts, spans = piece + 1, 0, [], []
        if parts or not piece:
            yield conv, piece, "".join(parts), spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template, controls)
        grouped = groupby(rows_of(batches), key=lambda r: r[0])
        rows = (p for conv, turns in grouped for p in pieces(compiled, conv, ({"role": r[1] or "", "text": r[2] or ""} for r in turns)))
        yield from in_batches(rows, FORMATTED_ARROW, 2)

    picked = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    ordered = picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


CLOSE_OF = {"[SYS]": ("system", " [/SYS]"), "[INST]": ("user", " [/INST]"), "<s>": ("assistant", "</s>"), "[ROLE]": (None, " [/ROLE]")}
OPEN = re.compile(r"\[SYS\] |\[INST\] |<s>|\[ROLE\] ")


def read_turns(text: str, guard: Guard) -> tuple[list[tuple[str, str]], str]:
    """Role and text of each whole turn of a text of the default template, and what is left of it."""
    turns: list[tuple[str, str]] = []
    at = 0
    while m := OPEN.match(text, at):
        role, close = CLOSE_OF[m[0].strip()]
        stop = text.find(close, m.end())
        if stop < 0:
            break
        inside = text[m.end() : stop]
        if role is None:
            role, _, inside = inside.partition(OTHER[1])
            role = guard.unescape(role)
        turns.append((role, guard.unescape(inside)))
        at = stop + len(close)
    return turns, text[at:]


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the formatted rows as they come (pieces of a conversation in order, in one partition)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guard = Guard(CONTROLS)
        out: list[tuple] = []
        for conv, rows in groupby(rows_of(batches), key=lambda r: r[0]):
            turns = loss_chars = chars = 0
            rest = ""
            all_turns, loss = hashlib.sha256(), hashlib.sha256()
            for _, _, text, spans in rows:
                chars += len(text)
                found, rest = read_turns(rest + text, guard)
                turns += len(found)
                for role, said in found:
                    all_turns.update(f"{role}\n{said}\n".encode())
                for s in spans or ():
                    learnt = guard.unescape(text[s["start"] : s["stop"]])
                    loss_chars += len(learnt)
                    loss.update(learnt.encode())
            if rest:
                raise ValueError(f"conversation {conv}: not the form of a turn: {rest[:40]!r}")
            out.append((conv, turns, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), READ_ARROW, strict=True)], schema=READ_ARROW)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), READ_ARROW, strict=True)], schema=READ_ARROW)

    return formatted.mapInArrow(run, READ)


READ_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

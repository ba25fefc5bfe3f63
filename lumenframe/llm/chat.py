"""Formatting conversations with a compiled template, with a loss mask, and reading them back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenframe.llm.template import compile_template

# Control strings of the format; inside texts each gets a backslash after its first character.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]"]
TEMPLATE = """{#- header, role, body; only assistants' texts are learned -#}
{%- for m in messages -%}
<s>[INST]{{ m.role | escape }}[/INST]
{%- if m.role == 'assistant' -%}
{%- generation -%}{{ m.text | escape }}{%- endgeneration -%}
{%- else -%}{{ m.text | escape }}{%- endif -%}
</s>
{%- endfor -%}"""
TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)
PART_CHARS = 1 << 16     # a part of the output is closed at the first turn's end after so many characters
_unsafe = re.compile("|".join(["\\\\", *map(re.escape, CONTROLS)]))
_marked = re.compile(r"\\(\\?)")


def escape(text: str | None) -> str:
    """The text with backslashes doubled and control strings broken up; no control string is left in it."""
    return _unsafe.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text or "")


def unescape(text: str) -> str:
    """Undoes ``escape``: of a doubled backslash one stays, a single one goes."""
    return _marked.sub(r"\1", text)


def arrow_type(kind: str) -> pa.DataType:
    """Of a conversation's id: a whole number or text."""
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


class Rows:
    """A stream of rows in order, with one row of look-ahead, dealt out by conversation."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.rows = (r for b in batches for r in b.to_pylist())
        self.next = next(self.rows, None)

    def conversation(self) -> Iterator[dict]:
        conv = self.next["conv"]
        while self.next is not None and self.next["conv"] == conv:
            row, self.next = self.next, next(self.rows, None)
            yield {"role": row["role"] or "", "text": row["text"] or ""}


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, part, formatted, spans) of each conversation, its parts in order and in one partition.

    Turns are sorted by ``turn``, ties by role and text; nulls come first. A null role or text
    counts as empty, rows with a null conversation form one conversation, equal rows are turns of
    their own, and an empty table gives no rows. ``spans`` are the (start, end) code points of a
    part under the loss mask. Rows are sorted in the partitions and rendered as a stream: only a
    part is held in memory, whatever the length of the conversation. Other columns are left out.
    """
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    kind = rows.schema["conv"].dataType.simpleString()

    schema = pa.schema([("conv", arrow_type(kind)), ("part", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, {"escape": escape})
        rows = Rows(batches)
        while rows.next is not None:
            owner, number, parts, size, spans = rows.next["conv"], 0, [], 0, []

            def closed():
                return pa.RecordBatch.from_pylist([{"conv": owner, "part": number, "formatted": "".join(parts), "spans": spans}], schema=schema)

            for piece, learned in render(messages=rows.conversation()):
                if learned and piece:
                    spans.append({"start": size, "end": size + len(piece)})
                parts.append(piece)
                size += len(piece)
                if size >= PART_CHARS and piece.endswith("</s>"):
                    yield closed()
                    number, parts, size, spans = number + 1, [], 0, []
            if parts or number == 0:
                yield closed()

    order = ["conv", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    sorted_rows = rows.repartition("conv").sortWithinPartitions(*order).select("conv", "role", "text")
    return sorted_rows.mapInArrow(run, f"conv {kind}, part long, formatted string, spans array<struct<start: long, end: long>>").withColumnRenamed("conv", conv)


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of what ``format_conversations`` gave, found in its output alone, part by part.

    (conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars): the turns' roles and
    texts, and all text under the loss mask, both unescaped.
    """
    kind = formatted.schema[conv].dataType.simpleString()

    schema = pa.schema([("conv", arrow_type(kind)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, state = None, None

        def result():
            turns, loss, n, chars, size = state
            return pa.RecordBatch.from_pylist([{"conv": owner, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size}], schema=schema)

        for row in (r for b in batches for r in b.to_pylist()):
            if row["part"] == 0:
                if state:
                    yield result()
                owner, state = row[conv], [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
            text = row["formatted"]
            for m in TURN.finditer(text):
                state[0].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                state[2] += 1
            for span in row["spans"]:
                learned = unescape(text[span["start"]:span["end"]])
                state[1].update(learned.encode())
                state[3] += len(learned)
            state[4] += len(text)
        if state:
            yield result()

    return formatted.mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("conv", conv)

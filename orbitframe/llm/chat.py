"""Chat formatting: conversations rendered through a compiled template, with the loss mask of generated text.

Control strings inside texts are escaped before rendering (a backslash becomes two, ``<|`` becomes ``<\\|``), so
that the output holds ``<|`` only where the template put it, and reading back restores every text exactly.
Rows of a conversation are dealt to one task in turn order and streamed through the template: memory holds
two turns at a time, however long a conversation is.

Defined cases: null text or role is empty; rows with the same turn are ordered by role and text; null
conv_ids form one conversation; an empty table gives only what the caller adds; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitframe.llm.template import Template

START, END = "<|im_start|>", "<|im_end|>"
CHAT_TEMPLATE = (
    "{% for m in messages %}{{ '<|im_start|>' + m.role }}\n"
    "{% if m.plain_role == 'assistant' %}{% generation %}{{ m.text }}{% endgeneration %}{% else %}{{ m.text }}{% endif %}{{ '<|im_end|>' }}\n{% endfor %}"
)
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\N")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "N" else m[1], text, flags=re.S)


class Reader:
    """Reads rendered text back, segment by segment."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.open: list[str] = []
        self.counted: list[str] = []

    def __call__(self, text: str, counted: bool) -> None:
        self.chars += len(text)
        if counted:
            self.counted.append(text)
        self.open.append(text)
        if not counted and END in text:
            self.read()

    def read(self) -> None:
        whole = "".join(self.open)
        done = 0
        while (end := whole.find(END, done)) >= 0:
            start = whole.index(START, done) + len(START)
            role, _, text = whole[start:end].partition("\n")
            self.turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
            self.n_turns += 1
            done = end + len(END)
        self.open = [whole[done:]]
        spoken = unescape("".join(self.counted))
        self.loss.update(spoken.encode())
        self.loss_chars += len(spoken)
        self.counted = []

    def row(self, conv_id) -> tuple:
        return conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def messages_of(rows: Iterable[tuple]) -> Iterator[dict]:
    for _, role, text in rows:
        yield {"role": escape_role(role or ""), "plain_role": role or "", "text": escape(text or "")}


def _grouped(batches: Iterator[pa.RecordBatch]):
    rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
    return itertools.groupby(rows, key=lambda r: r[0])


def digests(template: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template)
        names = [f.split()[0] for f in DIGEST.split(", ")]
        out = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "sha" in n else pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)], names)

        for conv_id, rows in _grouped(batches):
            reader = Reader()
            compiled.render(messages_of(rows), reader)
            out.append(reader.row(conv_id))
            if len(out) == 2000:
                yield batch()
                out = []
        if out:
            yield batch()

    return run


def _in_turn_order(conversations: DataFrame) -> DataFrame:
    dealt = conversations.select(F.col("conv_id").cast("long"), "role", "text", F.col("turn").cast("long"))
    return dealt.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_digests(conversations: DataFrame, template: str = CHAT_TEMPLATE) -> DataFrame:
    """Per conversation, what reading the rendered text back gives."""
    return _in_turn_order(conversations).mapInArrow(digests(template), DIGEST)


def format_conversations(conversations: DataFrame, template: str = CHAT_TEMPLATE) -> DataFrame:
    """conv_id, formatted, loss_spans: the rendered text, and the code-point ranges that the loss counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template)
        for conv_id, rows in _grouped(batches):
            parts, spans, at = [], [], 0

            def emit(text: str, counted: bool) -> None:
                nonlocal at
                if counted and text:
                    spans.append({"start": at, "end": at + len(text)})
                parts.append(text)
                at += len(text)

            compiled.render(messages_of(rows), emit)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([conv_id], pa.int64()), pa.array(["".join(parts)]), pa.array([spans], kind)], ["conv_id", "formatted", "loss_spans"])

    return _in_turn_order(conversations).mapInArrow(run, "conv_id long, formatted string, loss_spans array<struct<start: long, end: long>>")

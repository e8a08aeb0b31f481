"""Conversations rendered by a compiled template, and read back.

The template marks turns by control strings. Inside texts and roles, control
strings (those of the template and others that models know) are replaced by
``ESCAPE`` and a letter, and ``ESCAPE`` itself too, so rendering is reversible:
no control string but the template's own is left in the output.

Turns are sorted inside a partition and streamed: a conversation of any length
needs memory for one turn and one chunk. Its output comes in chunks of about
``CHUNK`` characters, with the spans that are trained on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import template

# The control strings of this format, then those of common others.
BEGIN, SAYS, END = "<|turn|>", "<|says|>", "<|done|>"
CONTROL = [BEGIN, SAYS, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
ESCAPE = "\\"
CHUNK = 1 << 20

TEMPLATE = (
    "{% for turn in turns %}"
    + BEGIN
    + "{{ turn.role | escape }}"
    + SAYS
    + "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}"
    "{% else %}{{ turn.text | escape }}{% endif %}"
    + END
    + "{% if not loop.last %}\n{% endif %}"
    "{% endfor %}"
)

_CODES = {c: ESCAPE + chr(ord("a") + i) for i, c in enumerate(CONTROL)} | {ESCAPE: ESCAPE + "z"}
_BACK = {v[1]: k for k, v in _CODES.items()}
CONTROL_PATTERN = "|".join(re.escape(c) for c in [ESCAPE, *CONTROL])
_CONTROL = re.compile(CONTROL_PATTERN)
_ESCAPED = re.compile(re.escape(ESCAPE) + "(.)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: _CODES[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(k).to_pylist() for k in range(3)))


def render(rows: Iterator[tuple], run: Callable, chunk: int = CHUNK) -> Iterator[tuple]:
    """Chunks ``(conv_id, place, text, [(start, stop)])`` for sorted ``(conv_id, role, text)``."""
    for conv, group in groupby(rows, key=lambda r: r[0]):
        turns = ({"role": r[1] or "", "text": r[2] or ""} for r in group)
        place, size, texts, spans = 0, 0, [], []
        for text, trained in run({"turns": turns}):
            for at in range(0, len(text), chunk):
                part = text[at : at + chunk]
                if trained:
                    if spans and spans[-1][1] == size:
                        spans[-1] = (spans[-1][0], size + len(part))
                    else:
                        spans.append((size, size + len(part)))
                texts.append(part)
                size += len(part)
                if size >= chunk:
                    yield conv, place, "".join(texts), spans
                    place, size, texts, spans = place + 1, 0, [], []
        if texts or not place:
            yield conv, place, "".join(texts), spans


FORMATTED = "conv_id long, chunk long, text string, spans array<struct<start:long,stop:long>>"


def _rendered(batches: Iterator[pa.RecordBatch], source: str, chunk: int) -> Iterator[pa.RecordBatch]:
    run = template.compiled(source, {"escape": lambda x: escape(template.show(x))})
    rows: list[tuple] = []
    held = 0

    def out() -> pa.RecordBatch:
        spans = pa.array([[{"start": a, "stop": b} for a, b in r[3]] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), spans],
            names=["conv_id", "chunk", "text", "spans"],
        )

    for row in render(_turns(batches), run, chunk):
        rows.append(row)
        held += len(row[2])
        if held >= 4 * CHUNK or len(rows) >= 1000:
            yield out()
            rows.clear()
            held = 0
    yield out()


def format_conversations(rows: DataFrame, source: str = TEMPLATE, chunk: int = CHUNK) -> DataFrame:
    """Each conversation of ``rows`` (conv_id, turn, role, text) rendered: ``(conv_id, chunk, text, spans)``.

    Turns are ordered by turn, then role, then text (nulls first), so ties and
    repeated rows have one order. A null role or text is empty; rows with a
    null conv_id are one conversation. Spans count code points of the chunk's
    text. Chunks of a conversation follow each other in its partition. An empty
    table gives no rows; other columns are ignored.
    """
    template.compiled(source, {"escape": escape})  # errors show on the driver
    turns = (
        rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )
    return turns.mapInArrow(lambda b: _rendered(b, source, chunk), FORMATTED)


class _Reader:
    """Reads the output of ``TEMPLATE`` chunk by chunk."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss, self.chars = conv, 0, 0, 0
        self.all, self.trained = hashlib.sha256(), hashlib.sha256()
        self.rest = self.cut = ""

    def feed(self, text: str, spans: list[dict]) -> None:
        self.chars += len(text)
        for s in spans:
            masked = self.cut + text[s["start"] : s["stop"]]
            odd = len(re.search(r"\\*$", masked)[0]) % 2  # an escape that the next chunk ends
            self.cut, masked = (masked[-1], masked[:-1]) if odd else ("", masked)
            plain = unescape(masked)
            self.loss += len(plain)
            self.trained.update(plain.encode("utf-8", "surrogatepass"))
        parts = (self.rest + text).split(END)
        self.rest = parts.pop()
        for part in parts:
            role, _, said = part[part.index(BEGIN) + len(BEGIN) :].partition(SAYS)
            self.turns += 1
            self.all.update(f"{unescape(role)}\n{unescape(said)}\n".encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss, self.trained.hexdigest(), self.chars


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now: _Reader | None = None
    done: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = list(zip(*done)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=names)

    for batch in batches:
        for conv, chunk, text, spans in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if chunk == 0:
                if now:
                    done.append(now.row())
                now = _Reader(conv)
            now.feed(text, spans)
        if len(done) >= 1000:
            yield out()
            done.clear()
    if now:
        done.append(now.row())
    yield out()


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what ``format_conversations`` made with ``TEMPLATE``, read from its output alone.

    One row for each conversation; it takes the chunks as their partitions
    deliver them, so ``formatted`` must not be dealt out anew in between.
    """
    return formatted.mapInArrow(_digests, DIGEST)

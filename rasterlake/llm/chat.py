"""Chat formatting with typed content parts.

A turn's content is text or a list of parts (text, image, audio, document). A
visitor flattens the parts into one string in which every attachment is a
placeholder at its place, and records for each placeholder the attachment it
refers to and the tokens that it will expand to. The template marks turns with
control strings; whatever looks like one inside a text gets a backslash after
its ``<`` and loses it on reading back. Turns are formatted where they lie, with
no shuffle; digests of conversations stream over sorted turns and hold one turn.

Defined cases: a null text or role is empty; a conversation's turns follow turn,
then role, then text, so repeated rows all stay; rows with a null conversation id
form one conversation; a part of unknown type becomes an attachment placeholder
of one token; an empty table gives an empty result; other columns are not read; a
very long text is one turn, the largest thing that a task holds.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass
class PartVisitor:
    """Flattens parts; ``text`` grows, ``spans`` are its text parts, ``attachments`` its placeholders."""

    patch: int = 28
    audio_tokens_per_second: float = 12.5
    document_tokens_per_page: int = 256
    text: str = ""
    spans: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type')}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        at = len(self.text)
        self.text += escape(part.get("text") or "")
        self.spans.append((at, len(self.text)))

    def visit_image(self, part: dict) -> None:
        self._place("image", part, math.ceil((part.get("width") or self.patch) / self.patch) * math.ceil((part.get("height") or self.patch) / self.patch))

    def visit_audio(self, part: dict) -> None:
        self._place("audio", part, max(1, math.ceil((part.get("seconds") or 0) * self.audio_tokens_per_second)))

    def visit_document(self, part: dict) -> None:
        self._place("document", part, max(1, part.get("pages") or 1) * self.document_tokens_per_page)

    def visit_other(self, part: dict) -> None:
        self._place("attachment", part, 1)

    def _place(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": str(part.get("ref") or part.get("url") or ""), "at": len(self.text), "tokens": tokens})
        self.text += f"<|{kind}|>"


def parts_of(content: str, typed: bool) -> list[dict]:
    """A typed content is a JSON list of parts; anything else is one text part."""
    if typed and content.lstrip().startswith("["):
        try:
            found = json.loads(content)
        except ValueError:
            found = None
        if isinstance(found, list) and all(isinstance(p, dict) and "type" in p for p in found):
            return found
    return [{"type": "text", "text": content}]


def format_turn(role: str, content: str, typed: bool = False, trained: tuple[str, ...] = ("assistant",)) -> tuple[str, list[tuple[int, int]], list[dict]]:
    """(formatted turn, spans under the loss mask, attachments); offsets are code points of the turn."""
    visitor = PartVisitor(text=f"{START}{escape_role(role)}\n")
    for part in parts_of(content, typed):
        visitor.visit(part)
    return f"{visitor.text}{END}\n", visitor.spans if role in trained else [], visitor.attachments


def read_turn(formatted: str) -> tuple[str, str]:
    """(role, text) back from a formatted turn; placeholders stay as they are."""
    role, body = _TURN.fullmatch(formatted).groups()
    return unescape_role(role), unescape(body)


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_ATTACHMENT = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))
TURN_FIELDS = "formatted string, loss_spans array<struct<start:long,stop:long>>, attachments array<struct<kind:string,ref:string,at:long,tokens:long>>"


def _format(typed: bool):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            done = [format_turn(r, t, typed) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            texts, spans, attached = ([d[k] for d in done] for k in range(3))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string()), pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], _SPAN), pa.array(attached, _ATTACHMENT)],
                names=[*batch.schema.names, "formatted", "loss_spans", "attachments"],
            )

    return run


def format_turns(conversations: DataFrame, typed: bool = False) -> DataFrame:
    """(conv_id, turn, role, text) with each turn's formatted text, loss spans and attachments."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_format(typed), f"{head}, {TURN_FIELDS}")


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.n, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, spans: list[dict]) -> None:
        role, text = read_turn(formatted)
        self.n += 1
        self.chars += len(formatted)
        self.turns.update(f"{role}\n{text}\n".encode())
        for span in spans:
            masked = unescape(formatted[span["start"] : span["stop"]])
            self.loss_chars += len(masked)
            self.loss.update(masked.encode())


def _digest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def emit(done: list[_Digest], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([d.conv_id for d in done], kind), *(pa.array([f(d) for d in done]) for f in (lambda d: d.n, lambda d: d.turns.hexdigest(), lambda d: d.loss_chars, lambda d: d.loss.hexdigest(), lambda d: d.chars))], names=names
        )

    open_, kind = None, None
    for batch in rows:
        done, kind = [], batch.schema.field("conv_id").type
        for conv_id, formatted, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")), strict=True):
            if open_ is None or conv_id != open_.conv_id:
                if open_ is not None:
                    done.append(open_)
                open_ = _Digest(conv_id)
            open_.add(formatted, spans)
        if done:
            yield emit(done, kind)
    if open_ is not None:
        yield emit([open_], kind)


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Read back from formatted turns: one row per conversation."""
    order = ["conv_id", "turn", "role", "text"]
    sorted_turns = turns.select(*order, "formatted", "loss_spans").repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "formatted", "loss_spans")
    kind = turns.schema["conv_id"].dataType.simpleString()
    return sorted_turns.mapInArrow(_digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

"""Chat formatting: turns of typed content parts flattened into one marked-up text.

A turn's content is its text, or a JSON list of parts: text, image, audio, document (itself a list of parts) and whatever
else. A visitor goes through them in order. Text is escaped, so that no text can hold a control string; every other part
becomes a placeholder, and an attachment with its reference, its place and the number of tokens that it will
expand to. What the loss is taken on (texts of the assistant, no placeholders) is recorded as spans.

Turns are formatted where they are read, whatever conversation they belong to. Then they are dealt out by
conversation, sorted, and get their place in it as they stream by: no conversation is held as a whole, in either step or
when the output is read back. (``whole`` does join them, for users who want one row per conversation.)

Turns go by ``turn``, null first, then by role and formatted text; repeated rows are turns of their own. A null role, text and conversation id
are an empty role, an empty text, and a conversation of their own. Content that is no JSON list is text. Other columns
are not read; an empty table gives no rows.
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

from stevedore.llm.common import slices

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """``text`` without any ``<|``: one more backslash in each ``<``, backslashes, ``|``."""
    return _CONTROL.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    """As ``escape``, and on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass(frozen=True)
class Template:
    """The marks of a turn, and how many tokens an attachment expands to."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: Side of an image patch in pixels, and the tokens of an image of unknown size.
    patch: int = 28
    image_tokens: int = 256
    #: Tokens a second of audio, and those of audio of unknown length.
    audio_rate: float = 25.0
    audio_tokens: int = 750
    #: Tokens of a document without listed contents, a page.
    page_tokens: int = 512

    def of_image(self, part: dict) -> int:
        width, height = _number(part.get("width")), _number(part.get("height"))
        return math.ceil(width / self.patch) * math.ceil(height / self.patch) if width and height else self.image_tokens

    def of_audio(self, part: dict) -> int:
        seconds = _number(part.get("seconds"))
        return math.ceil(seconds * self.audio_rate) if seconds else self.audio_tokens


def _valid(text: str) -> str:
    """JSON may hold halves of characters, which no text column can: each becomes U+FFFD."""
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _number(value) -> float:
    """A positive finite number, else 0."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return 0
    return value if 0 < value < 1e9 else 0


@dataclass
class Visitor:
    """Flattens the parts of one turn: the marked-up text in ``out``, spans of it, and attachments."""

    template: Template
    in_loss: bool
    out: list[str] = field(default_factory=list)
    size: int = 0
    plain: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    open_documents: list[dict] = field(default_factory=list)

    def put(self, marked: str) -> None:
        self.out.append(marked)
        self.size += len(marked)

    def visit(self, parts: list) -> None:
        """All parts in order, depth first. Open documents are a list, not recursion: nesting has no limit."""
        lists: list[tuple[Iterator, dict | None]] = [(iter(parts), None)]
        while lists:
            rest, document = lists[-1]
            part = next(rest, _DONE)
            if part is _DONE:
                lists.pop()
                if document is not None:
                    self.leave_document(document)
            elif isinstance(part, dict) and part.get("type") == "document" and isinstance(part.get("parts"), list):
                lists.append((iter(part["parts"]), self.enter_document(part)))
            elif part is not None:
                part = {"type": "text", "text": part} if isinstance(part, str) else part if isinstance(part, dict) else {}
                kind = part.get("type")
                getattr(self, f"visit_{kind}" if kind in ("text", "image", "audio", "document") else "visit_other")(part)
        self.flush()

    def visit_text(self, part: dict) -> None:
        text = part.get("text")
        self.plain.append(_valid(text) if isinstance(text, str) else "")

    def flush(self) -> None:
        """Texts side by side are escaped as one: a control string could lie across them."""
        text = escape("".join(self.plain))
        if text and self.in_loss:
            self.spans.append((self.size, self.size + len(text)))
        self.put(text)
        self.plain = []

    def attach(self, part: dict, kind: str, tokens: int) -> dict:
        self.flush()
        ref = next((_valid(part[k]) for k in ("ref", "url", "path") if isinstance(part.get(k), str)), None)
        self.attachments.append({"kind": kind, "ref": ref, "at": self.size, "n_tokens": tokens})
        for document in self.open_documents[-1:]:
            document["n_tokens"] += tokens
        return self.attachments[-1]

    def visit_image(self, part: dict) -> None:
        self.attach(part, "image", self.template.of_image(part))
        self.put("<|image|>")

    def visit_audio(self, part: dict) -> None:
        self.attach(part, "audio", self.template.of_audio(part))
        self.put("<|audio|>")

    def visit_document(self, part: dict) -> None:
        pages = _number(part.get("pages")) or 1
        self.attach(part, "document", math.ceil(pages) * self.template.page_tokens)
        self.put("<|document|><|/document|>")

    def enter_document(self, part: dict) -> dict:
        """A document whose parts are given holds them between its marks, and expands to their tokens."""
        document = self.attach(part, "document", 0)
        self.open_documents.append(document)
        self.put("<|document|>")
        return document

    def leave_document(self, document: dict) -> None:
        self.flush()
        self.put("<|/document|>")
        self.open_documents.pop()
        for outer in self.open_documents[-1:]:
            outer["n_tokens"] += document["n_tokens"]

    def visit_other(self, part: dict) -> None:
        self.attach(part, "other", 0)
        self.put("<|attachment|>")


_DONE = object()


def parts_of(text: str | None, content: str | None) -> list:
    """The parts of a turn: the JSON list of ``content``, where there is one, else the text alone."""
    if content is not None:
        try:
            found = json.loads(content)
        except (ValueError, RecursionError):
            found = None
        return found if isinstance(found, list) else [content]
    return [text or ""]


def format_turn(role: str | None, text: str | None, content: str | None, template: Template):
    """(formatted turn, loss spans in it, attachments)."""
    visitor = Visitor(template, role in template.loss_roles)
    visitor.put(f"{template.start}{escape_role(role or '')}\n")
    visitor.visit(parts_of(text, content))
    visitor.put(f"{template.end}\n")
    return "".join(visitor.out), visitor.spans, visitor.attachments


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_ATTACHMENT = pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("n_tokens", pa.int64())])
_SPANS_SQL = "array<struct<start: bigint, end: bigint>>"
_ATTACHMENTS_SQL = "array<struct<kind: string, ref: string, at: bigint, n_tokens: bigint>>"
_TURN_SQL = f"conv_id bigint, turn bigint, role string, formatted string, loss {_SPANS_SQL}, attachments {_ATTACHMENTS_SQL}"
_MARKED = [("formatted", pa.string()), ("loss", pa.list_(_SPAN)), ("attachments", pa.list_(_ATTACHMENT))]
_TURN = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), *_MARKED])
_PLACED_SQL = f"conv_id bigint, place bigint, role string, start bigint, formatted string, loss {_SPANS_SQL}, attachments {_ATTACHMENTS_SQL}"
_PLACED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("start", pa.int64()), *_MARKED])


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _format(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        out = []
        for conv, turn, role, text, content in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "content")), strict=True):
            formatted, spans, attached = format_turn(role, text, content, template)
            out.append((conv, turn, role, formatted, [{"start": a, "end": b} for a, b in spans], attached))
        if out:
            yield _batch(out, _TURN)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn: their number, and spans and attachments by their place in the conversation."""
    conv, place, start, begun = None, 0, 0, False
    for batch in slices(batches, "formatted"):
        out = []
        for c, role, text, spans, attached in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "formatted", "loss", "attachments")), strict=True):
            if not begun or c != conv:
                conv, place, start, begun = c, 0, 0, True
            moved = [{"start": s["start"] + start, "end": s["end"] + start} for s in spans]
            out.append((c, place, role, start, text, moved, [{**a, "at": a["at"] + start} for a in attached]))
            place, start = place + 1, start + len(text)
        if out:
            yield _batch(out, _PLACED)


def format_chat(rows: DataFrame, template: Template = Template(), content: str | None = None) -> DataFrame:
    """(conv_id, place, role, start, formatted, loss, attachments), one row per turn, in the order of each conversation and
    all of one conversation in one partition: the formatted conversation is the turns' ``formatted`` one after another.

    ``start``, the spans of ``loss`` and ``at`` of the attachments (kind, ref, at, n_tokens) count code points of it.
    ``content`` names a column of JSON lists of parts; rows where it is null have their ``text`` alone.
    """
    given = F.col(content).cast("string") if content else F.lit(None).cast("string")
    taken = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", given.alias("content"))
    turns = taken.mapInArrow(lambda batches: _format(batches, template), _TURN_SQL)
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), F.coalesce("role", F.lit("")), "formatted")
    return dealt.mapInArrow(_place, _PLACED_SQL)


def whole(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss, attachments): one row per conversation, which is held whole."""
    turn = F.struct("place", "formatted", "loss", "attachments")
    grouped = formatted.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.select(
        "conv_id",
        F.array_join("turns.formatted", "").alias("formatted"),
        F.flatten("turns.loss").alias("loss"),
        F.flatten("turns.attachments").alias("attachments"),
    )


def read_turns(pieces: Iterator[str], template: Template) -> Iterator[tuple[str, str]]:
    """(role, text with its placeholders) of each turn of a formatted conversation, given in pieces."""
    start, end = template.start, f"{template.end}\n"
    rest = ""
    for piece in pieces:
        rest += piece
        while (stop := rest.find(end)) >= 0:
            if not rest.startswith(start):
                raise ValueError(f"not a turn: {rest[:40]!r}")
            role, _, text = rest[len(start) : stop].partition("\n")
            yield unescape_role(role), unescape(text)
            rest = rest[stop + len(end) :]
    if rest:
        raise ValueError(f"text after the last turn: {rest[:40]!r}")


_DIGEST_SQL = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, "
    "n_attachments bigint, attachment_tokens bigint"
)
_DIGEST = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string())]
    + [("formatted_chars", pa.int64()), ("n_attachments", pa.int64()), ("attachment_tokens", pa.int64())]
)


def _read_back(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    """Digests of the conversations as their formatted turns stream by: turns are found by their marks, the
    loss by its spans."""
    conv, state, out = None, None, []

    def close() -> tuple:
        s = state
        return (conv, s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"], s["attached"], s["tokens"])

    for batch in batches:
        for c, text, spans, attached in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "formatted", "loss", "attachments")), strict=True):
            if state is None or c != conv:
                if state is not None:
                    out.append(close())
                conv, state = c, {"n": 0, "chars": 0, "loss_chars": 0, "attached": 0, "tokens": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256()}
            for role, said in read_turns(iter([text]), template):
                state["n"] += 1
                state["turns"].update(f"{role}\n{said}\n".encode())
            for s in spans:
                said = unescape(text[s["start"] - state["chars"] : s["end"] - state["chars"]])
                state["loss_chars"] += len(said)
                state["loss"].update(said.encode())
            state["chars"] += len(text)
            state["attached"] += len(attached)
            state["tokens"] += sum(a["n_tokens"] for a in attached)
        if out:
            yield _batch(out, _DIGEST)
            out = []
    if state is not None:
        yield _batch([close()], _DIGEST)


def digest(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation what its formatted text says when read back: turns, loss, sizes, attachments."""
    return format_chat(rows, template).mapInArrow(lambda batches: _read_back(batches, template), _DIGEST_SQL)

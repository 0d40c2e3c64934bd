"""Chat formatting from typed content parts.

A turn's content is a list of typed parts (text, image, audio, document).  A
visitor flattens the parts in order: text is escaped, every other part becomes
a placeholder numbered within the conversation, its reference is recorded and
its expanded token count comes from its kind.  A part of an unknown kind is an
attachment too, `other`, that expands to no token.  A turn turns into one segment
    <|im_start|>role \\n content <|im_end|> \\n
and a conversation is its segments one after the other, in order of turn.

Escaping: a backslash doubles and "<|" becomes "<\\|", so no text can hold a
control string, and undoing it gives the text back.  Text parts that follow one
another are escaped as one text, so none can be put together from two.  Loss falls on the text of
assistant turns.

Defined results: null texts and roles are empty; null turns come first; equal
turns are ordered by role, then content; rows with a null id are one
conversation; a part without units, or with fewer than one, has one; repeated rows are turns like any others; an empty table gives
only conversations asked for beside it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, arrow_schema, map_columns

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens that a part of each kind expands to, for each of its units.
TOKENS = {"image": 256, "audio": 25, "document": 512}
PART_TYPE = "struct<type:string,text:string,ref:string,units:int>"
OTHER = "other"
TRAINED_ROLE = "assistant"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


class PartVisitor:
    """Flattens the parts of one turn; one method for each kind of part.  first: the conversation's next free slot."""

    def __init__(self, first: int = 0) -> None:
        self.out: list[str] = []
        self.run: list[str] = []
        self.attachments: list[dict[str, Any]] = []
        self.tokens = 0
        self.first = first

    def visit(self, part: dict[str, Any]) -> None:
        kind = part.get("type") or "text"
        if kind == "text":
            self.text(part.get("text") or "")
        else:
            self.attachment(kind if kind in TOKENS else OTHER, part.get("ref"), max(part.get("units") or 1, 1))

    def text(self, text: str) -> None:
        self.run.append(text)

    def end_of_text(self) -> None:
        run = "".join(self.run)
        self.out.append(escape(run))
        self.tokens += len(run.split())
        self.run.clear()

    def attachment(self, kind: str, ref: str | None, units: int) -> None:
        self.end_of_text()
        slot, expanded = self.first + len(self.attachments), TOKENS.get(kind, 0) * units
        self.out.append(f"<|{kind}_{slot}|>")
        self.attachments.append({"slot": slot, "kind": kind, "ref": ref or "", "tokens": expanded})
        self.tokens += expanded

    def content(self) -> str:
        self.end_of_text()
        return "".join(self.out)


def format_turn(role: str | None, parts: list[dict[str, Any]], first: int = 0) -> dict[str, Any]:
    """Segment of one turn with its attachments (numbered from first), token count and loss span in it."""
    v = PartVisitor(first)
    for p in parts or []:
        if p is not None:
            v.visit(p)
    head, body = f"{START}{escape_role(role or '')}\n", v.content()
    loss = [len(head), len(head) + len(body)] if role == TRAINED_ROLE else []
    return {"segment": f"{head}{body}{END}\n", "attachments": v.attachments, "tokens": v.tokens, "loss": loss}


_SEGMENT = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
_PLACEHOLDER = re.compile(r"<\|(?:image|audio|document|other)_[0-9]+\|>")


def read_segments(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the content) of each turn in a formatted string."""
    out, at = [], 0
    while at < len(formatted):
        m = _SEGMENT.match(formatted, at)
        if not m:
            raise ValueError(f"no turn begins at {at}")
        out.append((unescape_role(m[1]), unescape(_PLACEHOLDER.sub("", m[2])), m.start(2), m.end(2)))
        at = m.end()
    return out


_TURNS = "conv_id long, turn long, segment string, attachments array<struct<slot:int,kind:string,ref:string,tokens:long>>, tokens long, loss array<long>"


def format_turns(rows: DataFrame, parts_col: str | None = None) -> DataFrame:
    """A row a turn: its segment, attachments, expanded token count and loss span.

    rows: conv_id, turn, role, and text or a column of typed parts.  Plain
    texts go row by row.  Typed parts are numbered through a conversation, so
    its turns come sorted into one partition and pass through one at a time;
    they leave in that order.
    """
    parts = F.col(parts_col) if parts_col else F.array(F.struct(F.lit("text").alias("type"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))
    pick = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), parts.cast(f"array<{PART_TYPE}>").alias("parts"))

    def made(cols: dict, turns: list[dict[str, Any]]) -> dict:
        return {"conv_id": cols["conv_id"], "turn": cols["turn"]} | {k: [t[k] for t in turns] for k in ("segment", "attachments", "tokens", "loss")}

    if not parts_col:
        return map_columns(pick, lambda cols: made(cols, [format_turn(r, p) for r, p in zip(cols["role"], cols["parts"])]), _TURNS)
    arrow = arrow_schema(_TURNS)
    ordered = pick.repartition("conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), F.to_json("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, slot = object(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                cols, turns = batch.slice(start, ROWS_AT_ONCE).to_pydict(), []
                for conv, role, parts in zip(cols["conv_id"], cols["role"], cols["parts"]):
                    if conv != at:
                        at, slot = conv, 0
                    turns.append(format_turn(role, parts, slot))
                    slot += len(turns[-1]["attachments"])
                got = made(cols, turns)
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in arrow], schema=arrow)

    return ordered.mapInArrow(run, _TURNS)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, tokens long, n_attachments long"


class _Digest:
    """What is read back from one conversation's segments, as they pass."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = self.tokens = self.attached = 0

    def add(self, segment: str, loss: list[int], tokens: int, attached: int) -> None:
        for role, text, _, _ in read_segments(segment):
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.n += 1
        if loss:
            text = unescape(_PLACEHOLDER.sub("", segment[loss[0] : loss[1]]))
            self.loss.update(text.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(text)
        self.chars += len(segment)
        self.tokens += tokens
        self.attached += attached

    def row(self, conv: int | None) -> dict[str, Any]:
        return {"conv_id": conv, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars, "tokens": self.tokens, "n_attachments": self.attached}


def digest_conversations(turns: DataFrame, in_order: bool = False) -> DataFrame:
    """A row a conversation, read back from its formatted segments.

    in_order: the turns come as format_turns leaves typed parts, sorted already.

    Segments are sorted within their partition and pass through one at a time,
    so a conversation of any length needs no more memory than one batch.
    """
    order = turns if in_order else turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")

    schema = arrow_schema(_DIGEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, at, done = None, None, []
        for batch in batches:
            c = batch.to_pydict()
            for conv, segment, loss, tokens, attached in zip(c["conv_id"], c["segment"], c["loss"], c["tokens"], c["attachments"]):
                if open_ is None or conv != at:
                    if open_ is not None:
                        done.append(open_.row(at))
                    open_, at = _Digest(), conv
                open_.add(segment, loss, tokens, len(attached))
            if len(done) >= 4096:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done = []
        if open_ is not None:
            done.append(open_.row(at))
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)

    return order.select("conv_id", "segment", "loss", "tokens", "attachments").mapInArrow(run, _DIGEST)


"""Chat formatting over typed content parts.

A turn's content is a list of parts: text, image, audio, document. A visitor flattens them, in order, into one text in
which every other part is a numbered placeholder; what a placeholder stands for is recorded with the tokens that it
expands to. The template then marks each turn:

    <s>ROLE[INST]CONTENT[/INST]</s>

Control strings inside roles and texts are escaped by a backslash after their first character, and backslashes by
another one, so they never occur in the output except as marks, and every text can be read back. The loss mask covers
the contents of assistant turns.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
KINDS = ("image", "audio", "document")
CONTROL = (BEGIN, OPEN, CLOSE, END, *(f"<|{k}:" for k in KINDS))
_ESCAPED = re.compile("|".join([r"\\", *map(re.escape, CONTROL)]))
_TURN = re.compile(f"{re.escape(BEGIN)}(.*?){re.escape(OPEN)}(.*?){re.escape(CLOSE)}{re.escape(END)}", re.S)
_PLACE = re.compile(r"<\|(image|audio|document):(\d+)\|>")

#: Tokens that an attachment expands to unless its part says so: a tile of an image, a second of audio, a page.
IMAGE_TILE, IMAGE_TILE_TOKENS, AUDIO_SECOND_TOKENS, PAGE_TOKENS = 512, 256, 25, 600


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


@dataclass
class Flattener:
    """Visitor of content parts. Numbers run through a conversation."""

    start: int = 0
    text: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        method = getattr(self, f"visit_{kind}", None)
        if method is None:
            raise ValueError(f"unknown content part: {kind}")
        method(part)

    def visit_text(self, part: dict) -> None:
        self.text.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        tiles = max(1, -(-(part.get("width") or 1) // IMAGE_TILE)) * max(1, -(-(part.get("height") or 1) // IMAGE_TILE))
        self._attach("image", part, tiles * IMAGE_TILE_TOKENS)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, int(-(-(part.get("seconds") or 0) * AUDIO_SECOND_TOKENS // 1))))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 1) * PAGE_TOKENS)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        number = self.start + len(self.attachments)
        self.text.append(f"<|{kind}:{number}|>")
        self.attachments.append({"number": number, "kind": kind, "ref": part.get("ref"), "tokens": int(part.get("tokens") or tokens)})


def parts_of(content: str) -> list[dict]:
    """Content given as JSON: a list of parts; anything else is one text part."""
    return json.loads(content)


def format_turn(role: str, parts: list[dict], start: int = 0) -> tuple[str, int, int, list[dict]]:
    """The turn's output, the span of its content in it, and its attachments."""
    flat = Flattener(start)
    for part in parts:
        flat.visit(part)
    head = f"{BEGIN}{escape(role)}{OPEN}"
    content = "".join(flat.text)
    return f"{head}{content}{CLOSE}{END}", len(head), len(head) + len(content), flat.attachments


def read_turn(output: str) -> tuple[str, str]:
    """Role and content of one turn, escapes undone; placeholders stay."""
    m = _TURN.fullmatch(output)
    if not m:
        raise ValueError("not one formatted turn")
    return unescape(m[1]), unescape(m[2])


def split_turns(output: str) -> list[tuple[str, str, int, int]]:
    """Role, content and the content's span, for each turn of a whole conversation's output."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(output)]


def _formatted(parts: bool):
    """conv_id, turn, role, text sorted by them. Offsets and numbers run on from row to row of a conversation."""
    at: dict = {"conv": None, "chars": 0, "number": 0, "ordinal": 0, "any": False}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attachment = pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])
        names = ["conv_id", "ordinal", "formatted", "begin", "loss_start", "loss_end", "attachments", "attachment_tokens"]
        types = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 3, pa.list_(attachment), pa.int64()]
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if not at["any"] or at["conv"] != conv:
                    at.update(conv=conv, chars=0, number=0, ordinal=0, any=True)
                content = parts_of(text) if parts and text else [{"type": "text", "text": text}]
                turn, a, b, attachments = format_turn(role or "", content, at["number"])
                begin = at["chars"]
                loss = (begin + a, begin + b) if role == "assistant" else (None, None)
                out.append((conv, at["ordinal"], turn, begin, *loss, attachments, sum(x["tokens"] for x in attachments)))
                at.update(chars=begin + len(turn), number=at["number"] + len(attachments), ordinal=at["ordinal"] + 1)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


FORMATTED = "conv_id long, ordinal long, formatted string, begin long, loss_start long, loss_end long, attachments array<struct<number:int,kind:string,ref:string,tokens:long>>, attachment_tokens long"


def format_conversations(turns: DataFrame, parts: bool = False) -> DataFrame:
    """turns: conv_id, turn, role, text. One row per turn, by conversation and in its order: the turn's output, where
    it begins in the conversation's output, its span under the loss mask (assistant turns), its attachments.

    With parts, text is a JSON list of typed parts. Null texts and roles are empty. Turns are ordered by (turn, role,
    text), so ties have a defined order and repeated rows are turns of their own; null turns come first. Rows with a
    null conv_id are one conversation. A conversation's output is its turns' outputs one after the other; it is never
    gathered in memory, so a conversation may be of any length; it is one task's, as each turn's place in its output
    depends on the turns before. An empty table gives an empty table. Other columns are ignored.
    """
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_formatted(parts), FORMATTED)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now: dict | None = None

    def close(x: dict) -> tuple:
        return x["conv"], x["n"], x["turns"].hexdigest(), x["loss_chars"], x["loss"].hexdigest(), x["chars"]

    for batch in batches:
        out = []
        for conv, output, begin, start, end in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
            if now is None or conv != now["conv"]:
                if now is not None:
                    out.append(close(now))
                now = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
            role, content = read_turn(output)
            now["turns"].update(f"{role}\n{content}\n".encode())
            now["n"] += 1
            now["chars"] += len(output)
            if start is not None:
                masked = unescape(output[start - begin : end - begin])
                now["loss"].update(masked.encode())
                now["loss_chars"] += len(masked)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(close(now), types, strict=True)], names)


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted: what format_conversations returned, in its order. One row per conversation, all from the output:
    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Empty texts count as turns; a conversation
    without an assistant has loss_chars 0 and the digest of nothing; an empty table gives an empty table."""
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio and document. A visitor flattens
them in order: text is escaped, each attachment becomes one placeholder whose number is
its place in the turn's list of attachments, with its reference and the number of tokens
that it expands to. A turn is

    <|turn|>ROLE<|text|>CONTENT<|end|>

and a conversation is its turns, one after the other. Control strings in roles and texts
(this template's and those of other common ones) get a backslash after their first
character, and a backslash is doubled; undoing both gives the text back exactly. The loss
mask is the place of the content of the turns of `LOSS_ROLES`, in code points.

Turns are formatted where they are. To read a conversation back, rows are dealt by
conv_id, sorted and streamed: a task keeps the running digests of one conversation and
never its turns, so a conversation of any length needs constant memory (its digest, a
chain over its turns, is one task's work by definition).

Defined results: null text and roles are empty; a null part has no content, an unknown part type is an error
text in `problems` and has no content; audio of no finite length is noted there and has no tokens. Turns are ordered by (turn, formatted segment), nulls first, so ties and
repeated rows have a place; rows with a null conv_id are one conversation. An empty
table gives an empty result. Columns beside conv_id, turn, role, text (and parts) are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import by_value, read, small_batches

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LOSS_ROLES = ("assistant",)
#: Strings that this template or other common ones give a meaning; fixed values.
CONTROL = [
    "<|turn|>", "<|text|>", "<|end|>", "<|image:", "<|audio:", "<|document:",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>",
    "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<start_of_turn>", "<end_of_turn>",
]
#: The first character of each place where a control string begins.
BEGINS = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
PLACEHOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")

#: Expanded tokens: an image's square tiles, an audio's seconds, a document's pages.
TILE, TILE_TOKENS, SECOND_TOKENS, PAGE_TOKENS = 336, 144, 25, 512

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENTS = pa.list_(pa.struct([("number", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))
SEGMENT = (
    "conv_id long, turn long, segment string, loss_start long, loss_end long, "
    "attachments array<struct<number:int,type:string,ref:string,at:long,tokens:long>>, expanded_tokens long, problems string"
)


def escaped(text: str) -> str:
    return BEGINS.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class Flattener:
    """Visits the parts of one turn in order and collects its content, attachments and token count."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.length = 0
        self.attachments: list[dict] = []
        self.problems: list[str] = []

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part.get('type')}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.add(escaped(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        tiles = math.ceil(max(part.get("width") or 0, 1) / TILE) * math.ceil(max(part.get("height") or 0, 1) / TILE)
        self.attach(part, tiles * TILE_TOKENS)

    def visit_audio(self, part: dict) -> None:
        seconds = part.get("seconds") or 0
        if not math.isfinite(seconds):
            self.problems.append(f"audio of {seconds} seconds")
            seconds = 0
        self.attach(part, math.ceil(max(seconds, 0) * SECOND_TOKENS))

    def visit_document(self, part: dict) -> None:
        self.attach(part, max(part.get("pages") or 0, 0) * PAGE_TOKENS)

    def visit_unknown(self, part: dict) -> None:
        self.problems.append(f"unknown part type {part.get('type')!r}")

    def attach(self, part: dict, tokens: int) -> None:
        number = len(self.attachments)
        self.attachments.append({"number": number, "type": part["type"], "ref": part.get("ref"), "at": self.length, "tokens": tokens})
        self.add(f"<|{part['type']}:{number}|>")

    def add(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)


def segment_of(role: str | None, parts: list[dict | None]) -> dict:
    """One formatted turn: its string, loss mask, attachments (places in the segment) and expanded tokens."""
    flat = Flattener()
    for part in parts:
        flat.visit(part)
    head = f"{TURN}{escaped(role or '')}{TEXT}"
    for a in flat.attachments:
        a["at"] += len(head)
    masked = role in LOSS_ROLES
    return {
        "segment": head + "".join(flat.pieces) + END,
        "loss_start": len(head) if masked else None,
        "loss_end": len(head) + flat.length if masked else None,
        "attachments": flat.attachments,
        "expanded_tokens": sum(a["tokens"] for a in flat.attachments),
        "problems": "; ".join(flat.problems) or None,
    }


def read_back(segment: str) -> tuple[str, str]:
    """Role and content (unescaped, placeholders as they are) of a formatted turn."""
    role, _, content = segment.removeprefix(TURN).removesuffix(END).partition(TEXT)
    return unescaped(role), unescaped(content)


def parts_of(segment: str) -> list[tuple[str, str]]:
    """The content's parts: ("text", unescaped text) and (type, number), in order."""
    content = segment.removeprefix(TURN).removesuffix(END).partition(TEXT)[2]
    out, at = [], 0
    for m in PLACEHOLDER.finditer(content):
        out += [("text", unescaped(content[at:m.start()])), (m[1], m[2])]
        at = m.end()
    return [p for p in [*out, ("text", unescaped(content[at:]))] if p != ("text", "")]


def formatted(conversations: DataFrame) -> DataFrame:
    """One formatted segment for each row: SEGMENT's columns and the keys that order a conversation.

    `conversations` has conv_id, turn, role and either text or parts (an array of PART).
    """
    small_batches(conversations.sparkSession)
    has_parts = "parts" in conversations.columns
    content = F.col("parts") if has_parts else F.lit(None)
    text = F.lit(None) if has_parts else F.col("text")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role",
        text.cast("string").alias("text"), content.cast(f"array<{PART}>").alias("parts"),
    )
    names = ["segment", "loss_start", "loss_end", "attachments", "expanded_tokens", "problems"]
    types = [pa.string(), pa.int64(), pa.int64(), ATTACHMENTS, pa.int64(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts, parts = (batch.column(c).to_pylist() for c in ("role", "text", "parts"))
            made = [segment_of(r, p or [] if has_parts else [{"type": "text", "text": t}]) for r, t, p in zip(roles, texts, parts, strict=True)]
            columns = [pa.array([m[n] for m in made], t) for n, t in zip(names, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), *columns], ["conv_id", "turn", *names])

    return rows.mapInArrow(work, SEGMENT)


def summaries(segments: DataFrame) -> DataFrame:
    """conv_id and what is read back from a conversation's segments: counts and digests of turns and loss-masked text."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def ended(done: list[tuple]) -> Iterator[pa.RecordBatch]:
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

        def row() -> tuple:
            return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end")]
            for conv, segment, start, end in zip(*columns, strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, content = read_back(segment)
                state[0] += 1
                state[1].update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
                if start is not None:
                    masked = unescaped(segment[start:end])
                    state[2] += len(masked)
                    state[3].update(masked.encode("utf-8", "surrogatepass"))
                state[4] += len(segment)
            yield from ended(done)
        if state is not None:
            yield from ended([row()])

    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = segments.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return dealt.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(
        work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return summaries(formatted(rows.unionByName(probe)))


_CONTROLS = "|".join(re.escape(c).replace("'", "''") for c in CONTROL)
_LENGTH = "(length({0}) + length(regexp_replace({0}, '[^\\\\]', '', 'g')) + len(regexp_extract_all({0}, '%s')))" % _CONTROLS

ORACLE_SQL = f"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum({len(TURN) + len(TEXT) + len(END)} + {_LENGTH.format('role')} + {_LENGTH.format('text')})::BIGINT AS formatted_chars
FROM said GROUP BY conv_id
"""

by_value(__name__)

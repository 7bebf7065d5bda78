"""Chat formatting with a grammar round trip (operator 3)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common

START, END = "<|im_start|>", "<|im_end|>\n"
_MARK = re.compile(r"<(\\*)\|")
_MARKED = re.compile(r"<(\\*)\\\|")
_ROLE = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Put one more backslash between each ``<`` and ``|``, so that no marker is left; :func:`unescape` takes it away."""
    return _MARK.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _MARKED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return _ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render_turn(role: str, text: str, escaped: bool) -> str:
    return f"{START}{escape_role(role) if escaped else role}\n{escape(text) if escaped else text}{END}"


def parse(text: str) -> list[tuple[str, str]] | None:
    """Turns of ``(START role LF content END)*``, read from left to right without choice; None where the text isn't of that form.

    A role ends at the first line feed, content at the first ``<|`` that must begin the end marker.
    """
    out, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            return None
        line = text.find("\n", at + len(START))
        stop = text.find("<|", line + 1) if line >= 0 else -1
        role = text[at + len(START) : line]
        if stop < 0 or "<|" in role or not text.startswith(END, stop):
            return None
        out.append((unescape_role(role), unescape(text[line + 1 : stop])))
        at = stop + len(END)
    return out


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, int, bool]:
    """The rendered text, how many turns had to be escaped, and whether it parses back to the turns.

    Turns are rendered as they are and parsed; one that doesn't come back is escaped.  The grammar joins turns without
    overlap, so each is tried for itself, and the whole once more.
    """
    parts, changed = [], 0
    for turn in turns:
        one = render_turn(*turn, False)
        if parse(one) != [turn]:
            one = render_turn(*turn, True)
            changed += 1
        parts.append(one)
    text = "".join(parts)
    return text, changed, parse(text) == turns


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, text, n_turns, n_escaped, identical), one row a conversation, its turns in order.

    Null roles and texts count as empty.  Turns of equal or null number (nulls first) go by role, then text; repeated
    rows are turns of their own; rows of null id form one conversation.  Content of any length stays whole.  Other
    columns aren't read.
    """
    common.prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [format_turns([(t["r"], t["x"]) for t in turns]) for turns in batch.column(1).to_pylist()]
            n = [len(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array(n, pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.bool_())], names=[conv, "text", "n_turns", "n_escaped", "identical"])

    kind = df.schema[conv].dataType.simpleString()
    cell = F.struct(F.col(f"`{turn}`").alias("t"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("r"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("x"))
    turns = df.groupBy(F.col(f"`{conv}`").alias("c")).agg(F.sort_array(F.collect_list(cell)).alias("turns"))
    return turns.mapInArrow(run, f"`{conv}` {kind}, text string, n_turns bigint, n_escaped bigint, identical boolean")


def parse_chats(df: DataFrame, conv: str = "conv_id", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) of rendered conversations, the inverse of :func:`format_chats`; a text that isn't of the grammar gives no row."""
    common.prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c, i, r, x) for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, (r, x) in enumerate(parse(t or "") or [])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string())], names=[conv, "turn", "role", "text"])

    kind = df.schema[conv].dataType.simpleString()
    return df.select(F.col(f"`{conv}`").alias("c"), F.col(f"`{text}`").alias("t")).mapInArrow(run, f"`{conv}` {kind}, turn bigint, role string, text string")

"""Token counts by field and line from one encoding of the whole document (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import bpe, common, encode, textvec

RULES = ("start", "end", "majority")


def intervals(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of lines, cut also at the given field bounds (bytes, one more than fields), and each line's field; a line keeps its line feed.  An empty field has no line."""
    cut = np.zeros(len(buf) + 1, bool)
    cut[bounds] = True
    cut[np.flatnonzero(buf == 10) + 1] = True
    starts = np.flatnonzero(cut[:-1]) if len(buf) else np.zeros(0, np.int64)
    return starts, np.searchsorted(bounds, starts, side="right") - 1


def allocate(token_start: np.ndarray, token_end: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The interval to which each token counts, and whether it crosses a bound."""
    first = np.searchsorted(starts, token_start, side="right") - 1
    last = np.searchsorted(starts, token_end - 1, side="right") - 1
    crossing = last > first
    if rule == "start":
        return first, crossing
    if rule == "end":
        return last, crossing
    own = first.copy()
    for i in np.flatnonzero(crossing):
        at = np.concatenate([[token_start[i]], starts[first[i] + 1 : last[i] + 1], [token_end[i]]])
        own[i] = first[i] + int(np.argmax(np.diff(at)))
    return own, crossing


def attribute_tokens(df: DataFrame, fields: Sequence[str] = ("source", "lang", "text"), id_col: str = "doc_id", rule: str = "start", vocabulary: str = encode.VOCABULARY) -> DataFrame:
    """(id, field, line, char_start, char_end, n_tokens, n_crossing): tokens of each line of each field.

    The fields are joined by line feeds and encoded once, as a model would see them; the line feed that joins belongs to
    the field before it.  A token that crosses a bound counts whole, by ``rule``, to the interval of its first byte
    (``start``), of its last (``end``), or to the one that has most of its bytes, the earlier of equals (``majority``).
    So the counts of a document sum to its length.  ``n_crossing`` counts an interval's tokens that cross.  Offsets are
    in characters of the joined document.  A null field counts as empty; the first two fields' line feeds remain.  Null
    ids and repeated rows give their own rows; other columns aren't read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    common.prepare(df.sparkSession)
    names, k = list(fields), len(fields)
    shared = df.sparkSession.sparkContext.broadcast(bpe.Bpe(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            cols = [pc.fill_null(batch.column(i + 1), "") for i in range(k)]
            size = np.stack([pc.binary_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in cols], axis=1)
            size[:, :-1] += 1
            joined = pc.binary_join_element_wise(*(c.cast(pa.large_string()) for c in cols), pa.scalar("\n", pa.large_string()))
            buf, offsets = textvec.column(joined)
            ids, _ = coder.encode_exact(buf, offsets)
            field_bounds = np.concatenate([[0], np.cumsum(size.ravel())])
            starts, field = intervals(buf, np.unique(field_bounds))
            filled = np.flatnonzero(np.diff(field_bounds))
            field = filled[field] if len(filled) else field
            end = np.cumsum(coder.lengths[ids])
            own, crossing = allocate(end - coder.lengths[ids], end, starts, rule)
            n = np.bincount(own, minlength=len(starts))
            over = np.bincount(own[crossing], minlength=len(starts))
            chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
            row = field // k
            base = chars[offsets[row]]
            line = np.arange(len(starts)) - np.searchsorted(field, field)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(np.array(names, object)[field % k], pa.string()), pa.array(line, pa.int64()), pa.array(chars[starts] - base), pa.array(chars[np.append(starts[1:], len(buf))[: len(starts)]] - base), pa.array(n, pa.int64()), pa.array(over, pa.int64())],
                names=[id_col, "field", "line", "char_start", "char_end", "n_tokens", "n_crossing"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(f"`{id_col}`").alias("d"), *(F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(names))).mapInArrow(run, f"`{id_col}` {kind}, field string, line bigint, char_start bigint, char_end bigint, n_tokens bigint, n_crossing bigint")

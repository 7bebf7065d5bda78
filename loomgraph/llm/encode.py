"""Byte-level BPE encoding and decoding of whole columns (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import bpe, common, textvec

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def lists(ids: np.ndarray, bounds: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    mask = None if valid is None or valid.all() else pa.array(~valid)
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()), mask=mask)


def valid(arr: pa.Array) -> np.ndarray:
    return arr.is_valid().to_numpy(zero_copy_only=False)


def encode_documents(df: DataFrame, text: str = "text", id_col: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, token_ids, n_tokens, n_bytes, round_trip) of each row, in one pass without a shuffle.

    ``round_trip`` says that the ids decode to exactly the text's bytes.  A null text has null ids and counts and a null
    ``round_trip``; an empty one has an empty list.  Repeated rows and null ids each give their own row; other columns
    are neither read nor returned, so their names can't clash.  Texts of any length are encoded whole.
    """
    common.prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(bpe.Bpe(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            col = batch.column(1)
            buf, offsets = textvec.column(col)
            ids, bounds = coder.encode_exact(buf, offsets)
            ok = valid(col)
            back = coder.decode(ids)
            same = np.array_equal(back, buf)
            good = np.full(len(col), same) if same else np.array([np.array_equal(coder.decode(ids[bounds[i] : bounds[i + 1]]), buf[offsets[i] : offsets[i + 1]]) for i in range(len(col))], bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists(ids, bounds, ok), pa.array(np.diff(bounds), pa.int64(), mask=~ok), pa.array(np.diff(offsets), pa.int64(), mask=~ok), pa.array(good, pa.bool_(), mask=~ok)],
                names=[id_col, "token_ids", "n_tokens", "n_bytes", "round_trip"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(f"`{id_col}`").alias("d"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, f"`{id_col}` {kind}, token_ids array<int>, n_tokens bigint, n_bytes bigint, round_trip boolean")


def decode_tokens(df: DataFrame, ids: str = "token_ids", id_col: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, text) from lists of ids; null lists give null texts.  Bytes that aren't UTF-8 become U+FFFD; an id outside the vocabulary is an error."""
    common.prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(bpe.Bpe(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            col = batch.column(1)
            texts = [None if x is None else bytes(coder.decode(np.array(x, np.int64))).decode("utf-8", "replace") for x in col.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(f"`{id_col}`").alias("d"), F.col(f"`{ids}`").alias("ids")).mapInArrow(run, f"`{id_col}` {kind}, text string")

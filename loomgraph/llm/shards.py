"""Training-order token shards by a keyed Feistel permutation (operator 4)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import bpe, common, encode, textvec

#: Fills the last sequence of a document; not an id of the vocabulary.
PAD = 65535
#: Shards that one task writes at most.
TASK_SHARDS = 64


def permute(index: np.ndarray, size: int, key: int, rounds: int = 6) -> np.ndarray:
    """A bijection of [0, size) chosen by the key: a balanced Feistel network over the next even power of two, walked on until back in range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64(textvec.mix_int((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03 + 1) & (2**64 - 1))) for r in range(rounds)]
    out = index.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        x = out[walk]
        left, right = x >> h, x & mask
        for k in keys:
            left, right = right, left ^ (textvec.mix(right + k) & mask)
        out[walk] = x = (left << h) | right
        walk = walk[x >= np.uint64(size)]
    return out.astype(np.int64)


def token_shards(df: DataFrame, key: int = 42, length: int = 512, per_shard: int = 2048, text: str = "text", id_col: str = "doc_id", vocabulary: str = encode.VOCABULARY) -> DataFrame:
    """(shard, first_slot, n_sequences, stride, doc_ids, lengths, payload), one row a shard.

    Each document's ids are cut into sequences of ``length``, the last one padded with 65535; a sequence never holds two
    documents.  Sequence i of N, in the order of the scan, gets slot ``permute(i, N, key)``; shard s holds the slots from
    ``s * per_shard`` on, each ``stride`` (``2 * length``) bytes of little-endian uint16, so slot x is at byte
    ``(x - first_slot) * stride`` and reading can resume anywhere.  The ids are encoded once and kept in the shared
    folder, which also fixes the order for retried tasks; one shuffle then moves them to range partitions
    of consecutive shards, as many to a task as :data:`TASK_SHARDS` allows, whatever the size of the input.  Null and empty
    texts have no sequence; null ids appear as null in ``doc_ids``; repeated rows are sequences of their own; an empty
    table gives no shard.  Other columns aren't read.
    """
    spark = df.sparkSession
    common.prepare(spark)
    coder = bpe.Bpe(vocabulary)
    if len(coder.lengths) > PAD:
        raise ValueError("ids of this vocabulary don't fit 16 bits")
    shared = spark.sparkContext.broadcast(coder)
    kind = df.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            buf, offsets = textvec.column(batch.column(1))
            ids, bounds = coder.encode_exact(buf, offsets)
            n = -(-np.diff(bounds) // length)
            row = np.repeat(np.arange(len(n)), n)
            within = np.arange(len(row)) - (np.cumsum(n) - n)[row]
            at = bounds[row] + within * length
            ends = np.append(at[1:], len(ids)) if len(at) else at
            data = pa.py_buffer(ids.astype("<u2").tobytes())
            off = np.append(at, ends[-1:]).astype(np.int32) * 2 if len(at) else np.zeros(1, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(off.tobytes()), data])], names=["d", "seq"])

    cutted = df.select(F.col(f"`{id_col}`").alias("d"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(cut, f"d {kind}, seq binary")
    stored = common.materialise(cutted.withColumn("m", F.monotonically_increasing_id()))
    by_task = {r[0]: r[1] for r in stored.groupBy(F.shiftright("m", 33).alias("p")).count().collect()}  # a row for each task of the scan
    base, total = {}, 0
    for p in sorted(by_task):
        base[p] = total
        total += by_task[p]
    tasks, starts = np.array(sorted(base), np.int64), np.array([base[p] for p in sorted(base)], np.int64)

    @F.pandas_udf("long")
    def slot(m: pd.Series) -> pd.Series:
        x = m.to_numpy()
        return pd.Series(permute(starts[np.searchsorted(tasks, x >> 33)] + (x & ((1 << 33) - 1)), total, key))

    stride = 2 * length
    kinds = f"shard bigint, first_slot bigint, n_sequences int, stride int, doc_ids array<{kind}>, lengths array<int>, payload binary"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            n, size = len(t), textvec.column(t["seq"])
            data, off = size
            out = np.full((n, length), PAD, "<u2")
            lengths = np.diff(off) // 2
            out[np.arange(length) < lengths[:, None]] = np.ascontiguousarray(data).view("<u2")
            s = t["s"][0].as_py()
            first = t["slot"][0].as_py()
            ids = t["d"].combine_chunks()
            ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
            bound = pa.array([0, n], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([s], pa.int64()), pa.array([first], pa.int64()), pa.array([n], pa.int32()), pa.array([stride], pa.int32()), pa.ListArray.from_arrays(bound, ids), pa.ListArray.from_arrays(bound, pa.array(lengths, pa.int32())), pa.array([out.tobytes()], pa.binary())],
                names=["shard", "first_slot", "n_sequences", "stride", "doc_ids", "lengths", "payload"],
            )

        held: list[pa.RecordBatch] = []
        for batch in batches:
            s = batch.column(0).to_numpy()
            if len(s) == 0:
                continue
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(s)) + 1, [len(s)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[0].column(0)[0].as_py() != s[a]:
                    yield shard(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield shard(held)

    placed = stored.select(slot("m").alias("slot"), "d", "seq")
    placed = placed.select(F.expr(f"slot div {per_shard}").alias("s"), "slot", "d", "seq")
    count = -(-total // per_shard)
    tasks_wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // TASK_SHARDS))
    each = max(1, -(-count // tasks_wanted))  # consecutive shards of one task
    ranges = placed.repartitionById(max(1, -(-count // each)), F.expr(f"cast(s div {each} as int)"))
    return ranges.sortWithinPartitions("s", "slot").mapInArrow(write, kinds)


def write_shards(shards: DataFrame, folder: str) -> DataFrame:
    """(shard, path, bytes): each shard as one file of fixed stride in a folder that all executors share.

    The folder is a path or a URI of any file system that Arrow knows (file, hdfs, s3, gs).  A file is written beside its
    place and moved, so a retried task leaves whole files only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for s, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                path = f"{root}/shard-{s:08d}.bin"
                with store.open_output_stream(part := f"{path}.{uuid.uuid4().hex}") as f:
                    f.write(payload.as_buffer())
                store.move(part, path)
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([path]), pa.array([len(payload.as_buffer())], pa.int64())], names=["shard", "path", "bytes"])

    return shards.select("shard", "payload").mapInArrow(run, "shard bigint, path string, bytes bigint")


def read_slots(folder: str, first: int, n: int, length: int, per_shard: int) -> np.ndarray:
    """Sequences of the slots [first, first + n), read by seeking; for resuming on one reader."""
    out = []
    store, root = fs.FileSystem.from_uri(folder)
    for x in range(first, first + n):
        with store.open_input_file(f"{root}/shard-{x // per_shard:08d}.bin") as f:
            f.seek((x % per_shard) * 2 * length)
            out.append(np.frombuffer(f.read(2 * length), "<u2"))
    return np.stack(out) if out else np.zeros((0, length), "<u2")

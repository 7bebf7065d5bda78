"""Exact duplicates by counting quotient filters and byte verification (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import common

#: Bytes of keys, as rows in memory, up to which a join broadcasts them; beyond, both sides are shuffled.
BROADCAST_BYTES = 32 << 20
#: Repeated rows that one task writes at most.
REPEATS = 100_000
_HEAD = 4


@dataclass
class QuotientFilter:
    """A counting quotient filter over 64-bit fingerprints.

    The top q bits of a fingerprint are its home slot, the rest its remainder.  ``occupied`` marks homes in use,
    ``runend`` the last slot of each home's run.  A count above one is kept in slots after its remainder, marked in
    ``counter``, as digits of the base 2**(64 - q), the least first.  Nothing is lost, so filters of other sizes merge.
    """

    q: int
    occupied: np.ndarray
    runend: np.ndarray
    counter: np.ndarray
    slots: np.ndarray

    @classmethod
    def build(cls, fps: np.ndarray, counts: np.ndarray) -> QuotientFilter:
        """From sorted distinct fingerprints."""
        n = len(fps)
        q = max(1, int(np.ceil(np.log2(max(n, 1) / 0.75 + 1))))
        r = np.uint64(64 - q)
        home = (fps >> r).astype(np.int64)
        extra = np.zeros(n, np.int64)
        rest = counts.astype(np.uint64) - np.uint64(1)
        left = rest.copy()
        while (left > 0).any():
            extra += left > 0
            left >>= r
        size = 1 + extra
        before = np.cumsum(size) - size
        start = np.maximum.accumulate(home - before) + before if n else home
        total = max(1 << q, int(start[-1] + size[-1]) if n else 0)
        f = cls(q, np.zeros(1 << q, bool), np.zeros(total, bool), np.zeros(total, bool), np.zeros(total, np.uint64))
        f.occupied[home] = True
        f.slots[start] = fps & ((np.uint64(1) << r) - np.uint64(1))
        for d in range(int(extra.max()) if n else 0):
            at = start[extra > d] + 1 + d
            f.slots[at] = (rest[extra > d] >> (r * np.uint64(d))) & ((np.uint64(1) << r) - np.uint64(1))
            f.counter[at] = True
        last = np.append(home[1:] != home[:-1], True) if n else np.zeros(0, bool)
        f.runend[(start + extra)[last]] = True
        return f

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints and their counts."""
        home, end = np.flatnonzero(self.occupied), np.flatnonzero(self.runend)
        start = np.maximum(home, np.append(-1, end[:-1]) + 1) if len(end) else home
        size = end - start + 1
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        of = np.repeat(home, size).astype(np.uint64)
        r = np.uint64(64 - self.q)
        head = ~self.counter[at]
        fps = (of[head] << r) | self.slots[at[head]]
        which = np.cumsum(head) - 1
        first = np.flatnonzero(head)
        counts = np.ones(len(fps), np.uint64)
        digit = np.flatnonzero(~head)
        place = (digit - first[which[digit]] - 1).astype(np.uint64)
        np.add.at(counts, which[digit], self.slots[at[digit]] << (r * place))
        return fps, counts.astype(np.int64)

    def dump(self) -> bytes:
        width = (64 - self.q + 7) // 8
        body = self.slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        return bytes([self.q]) + len(self.slots).to_bytes(_HEAD, "little") + b"".join(np.packbits(x).tobytes() for x in (self.occupied, self.runend, self.counter)) + body.tobytes()

    @classmethod
    def load(cls, data: bytes) -> QuotientFilter:
        q, n = data[0], int.from_bytes(data[1 : 1 + _HEAD], "little")
        raw, at, bits = np.frombuffer(data, np.uint8), 1 + _HEAD, []
        for size in (1 << q, n, n):
            bits.append(np.unpackbits(raw[at : at + (size + 7) // 8], count=size).astype(bool))
            at += (size + 7) // 8
        width = (64 - q + 7) // 8
        body = np.zeros((n, 8), np.uint8)
        body[:, :width] = raw[at:].reshape(n, width)
        return cls(q, *bits, body.view("<u8").ravel().astype(np.uint64))

    @classmethod
    def merge(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """Sorted remainders are merged and the counts of equal ones added."""
        fps, counts = (np.concatenate(x) for x in zip(*(f.entries() for f in filters), strict=True))
        order = np.argsort(fps, kind="stable")
        fps, counts = fps[order], counts[order]
        first = np.append(True, fps[1:] != fps[:-1]) if len(fps) else np.zeros(0, bool)
        return cls.build(fps[first], np.add.reduceat(counts, np.flatnonzero(first)) if len(fps) else counts)

    def count(self, fp: int) -> int:
        fps, counts = self.entries()
        at = int(np.searchsorted(fps, np.uint64(fp)))
        return int(counts[at]) if at < len(fps) and fps[at] == np.uint64(fp) else 0


def repeated_fingerprints(fps: DataFrame) -> DataFrame:
    """(fp, n): fingerprints (a bigint column ``fp``) that occur more than once, and how often.

    Each task builds one filter for each range of fingerprints; one shuffle brings a range's filters together, where they
    are merged.  The ranges grow in number with ``spark.sql.shuffle.partitions``, so a merged filter stays small.
    """
    spark = fps.sparkSession
    bits = min(20, max(4, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length() + 2))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).drop_null().to_numpy().view(np.uint64) for b in batches]
        if not parts:
            return
        got, counts = np.unique(np.concatenate(parts), return_counts=True)
        segment = (got >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(segment)) + 1, [len(got)]])
        spans = [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
        low = np.uint64(bits)
        yield pa.RecordBatch.from_arrays([pa.array([segment[a] for a, _ in spans], pa.int64()), pa.array([QuotientFilter.build(got[a:b] << low, counts[a:b]).dump() for a, b in spans], pa.binary())], names=["segment", "filter"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def over(segment: int, filters: list[bytes]) -> pa.RecordBatch:
            found, counts = QuotientFilter.merge([QuotientFilter.load(x) for x in filters]).entries()
            found = (found >> np.uint64(bits)) | (np.uint64(segment) << np.uint64(64 - bits))
            many = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(found[many].view(np.int64)), pa.array(counts[many], pa.int64())], names=["fp", "n"])

        now, held = None, []
        for batch in batches:
            for s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != now and held:
                    yield over(now, held)
                    held = []
                now = s
                held.append(x)
        if held:
            yield over(now, held)

    built = fps.select("fp").mapInArrow(build, "segment bigint, filter binary")
    return built.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "fp bigint, n bigint")


def small(df: DataFrame) -> bool:
    """Whether a materialised table's rows take few enough bytes to broadcast: 16 and 8 for each field, and what lies in strings and the like."""
    plain = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)
    other = [F.col(f"`{f.name}`").cast("string") for f in df.schema if not isinstance(f.dataType, plain)]
    size = F.count("*") * (16 + 8 * len(df.columns))
    for c in other:
        size = size + F.coalesce(F.sum(F.octet_length(c)), F.lit(0))
    return df.agg(size).first()[0] <= BROADCAST_BYTES


def maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small(df) else df


def find_exact_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, keep_id, copies, keep): each row's group of byte-identical texts.

    ``keep_id`` is the least id of the group and ``copies`` its rows; one row of a group has ``keep`` (of the least id;
    which of several rows of that id isn't visible here).  Texts whose fingerprint occurs once never move; the others are
    grouped by their bytes, so a collision can't join two texts.  A null text is a group of its own with its own id;
    empty texts are equal; null ids come last.  Other columns aren't read, so their names can't clash.
    """
    common.prepare(df.sparkSession)
    docs = df.select(F.col(f"`{id_col}`").alias("d"), F.col(f"`{text}`").cast("string").alias("t")).withColumn("fp", F.when(F.col("t").isNotNull(), F.xxhash64("t")))
    dup = common.materialise(repeated_fingerprints(docs.select("fp")))
    cand = docs.filter("fp is not null").join(maybe_broadcast(dup.select("fp")), "fp", "left_semi")
    marks = F.hash("t").alias("v"), F.xxhash64(F.lit("b"), "t").alias("w")
    groups = cand.groupBy("fp", "t").agg(F.min("d").alias("m"), F.count("*").alias("n"))  # the bytes are compared here
    groups = common.materialise(groups.select("fp", *marks, "m", "n"))
    split = groups.groupBy("fp").count().filter("count > 1").select("fp")  # different texts of one fingerprint
    light = docs.select("d", "fp", F.lit(0).alias("v"), F.lit(0).cast("bigint").alias("w"))
    if split.limit(1).count():
        split = maybe_broadcast(common.materialise(split))
        light = light.join(split, "fp", "left_anti").unionByName(docs.join(split, "fp", "left_semi").select("d", "fp", *marks))
        one = groups.join(split, "fp", "left_anti")
        groups = groups.join(split, "fp", "left_semi")
    else:
        one, groups = groups, groups.limit(0)
    groups = one.withColumns({"v": F.lit(0), "w": F.lit(0).cast("bigint")}).unionByName(groups)
    key = ["fp", "v", "w"]
    groups = maybe_broadcast(common.materialise(groups))
    rows = light.join(groups, key, "left")
    least = F.col("d").eqNullSafe(F.col("m"))
    out = rows.select("d", F.when(F.col("n").isNull(), F.col("d")).otherwise(F.col("m")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("bigint").alias("copies"), (F.col("n").isNull() | least).alias("keep"), *key)
    # the least id of a text may itself be repeated: such rows are counted, and written as one that stays and the others
    repeated = common.materialise(rows.filter(F.col("n").isNotNull() & least).groupBy(*key).agg(F.first("m").alias("m"), F.first("n").alias("n"), F.count("*").alias("c")).filter("c > 1"))
    shown = ["d", "keep_id", "copies", "keep"]
    if repeated.limit(1).count():
        some = maybe_broadcast(repeated.select(*key, F.lit(True).alias("again")))
        out = out.join(some, key, "left").filter("not (keep and coalesce(again, false))")
        runs = repeated.select("m", "n", "c", F.explode(F.sequence(F.lit(0), F.col("c") - 1, F.lit(REPEATS).cast("bigint"))).alias("from")).repartition("from", "m")
        each = runs.select("m", "n", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + REPEATS, F.col("c")) - 1)).alias("i"))
        out = out.select(*shown).unionByName(each.select(F.col("m").alias("d"), F.col("m").alias("keep_id"), F.col("n").alias("copies"), (F.col("i") == 0).alias("keep")))
    return out.select(*shown).withColumnsRenamed({"d": id_col})


def drop_exact_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of the input, with all their columns, but one for each text: that of the least id (null ids last).

    Rows of a text and an id that are repeated count as copies too: any one stays.  Null texts all stay.
    """
    common.prepare(df.sparkSession)
    columns = df.columns
    fp, rid, whole = "loomgraph_fp", "loomgraph_id", "loomgraph_whole"
    docs = df.withColumns({fp: F.when(F.col(f"`{text}`").isNotNull(), F.xxhash64(F.col(f"`{text}`").cast("string"))), rid: F.col(f"`{id_col}`")})
    dup = common.materialise(repeated_fingerprints(docs.select(F.col(fp).alias("fp"))).select(F.col("fp").alias(fp)))
    keys = maybe_broadcast(dup)
    single = docs.join(keys, fp, "left_anti")
    cand = docs.join(keys, fp, "left_semi")
    texts = cand.select(fp, rid, F.col(f"`{text}`").cast("string").alias("loomgraph_t"))
    least = texts.groupBy(fp, "loomgraph_t").agg(F.min(rid).alias("loomgraph_least"))
    least = common.materialise(least.select(fp, F.hash("loomgraph_t").alias("loomgraph_h"), F.length("loomgraph_t").alias("loomgraph_n"), "loomgraph_least").distinct())
    h = F.hash(F.col(f"`{text}`").cast("string"))
    kept = cand.withColumns({"loomgraph_h": h, "loomgraph_n": F.length(F.col(f"`{text}`").cast("string"))}).join(maybe_broadcast(least), [fp, "loomgraph_h", "loomgraph_n"]).filter(F.col(rid).eqNullSafe(F.col("loomgraph_least")))
    kept = kept.withColumn(whole, F.col(f"`{text}`").cast("string")).dropDuplicates([fp, whole])
    return single.select(*[f"`{c}`" for c in columns]).unionByName(kept.select(*[f"`{c}`" for c in columns]))

"""Near duplicates by SimHash and pigeonhole blocks (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common, components, exact_dedup, textvec

#: 64-bit words of a fingerprint, and its bits.
WORDS = 4
BITS = 64 * WORDS
#: Pairs of at most this Hamming distance are near duplicates.
DISTANCE = 42
#: Rows of one block value that one task compares at most; more are split into parts, and tasks take pairs of parts.
PART_ROWS = 2_000_000
_SEEDS = [np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1)) for k in range(1, WORDS + 1)]
_LANES = np.array([[sum(((b >> (7 - i)) & 1) << (16 * (i % 4)) for i in range(4 * h, 4 * h + 4)) for b in range(256)] for h in (0, 1)], np.uint64)


def simhash(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (rows by four words) of rows of word hashes, each distinct word counting once, and how many words were distinct.

    A bit is set where more than half of the row's words have it set.  A row's fingerprint depends on its words only.
    """
    rows = len(bounds) - 1
    row = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(bounds))
    bits = np.uint64(max(1, int(rows).bit_length()))
    key = (row << (np.uint64(64) - bits)) | (hashes >> bits)
    order = np.argsort(key)
    key, feature = key[order], hashes[order]
    same = key[1:] == key[:-1]
    if (same & (feature[1:] != feature[:-1])).any():  # words that differ in the bits which the row's number took
        order = np.lexsort((hashes, row))
        feature = hashes[order]
    row = row[order].astype(np.int64)
    fresh = np.append(True, (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])) if len(row) else np.zeros(0, bool)
    row, feature = row[fresh], feature[fresh]
    n = np.bincount(row, minlength=rows)
    start = np.cumsum(n) - n
    # lanes of 16 bits hold sums of up to 65535 words; longer rows are summed in pieces
    piece = 60_000
    pieces = np.maximum(1, -(-n // piece))
    of = np.repeat(np.arange(rows), pieces)
    at = start[of] + (np.arange(len(of)) - (np.cumsum(pieces) - pieces)[of]) * piece
    full = n[of] > 0
    out = np.zeros((rows, WORDS), np.uint64)
    for w in range(WORDS):
        octets = textvec.mix(feature + _SEEDS[w]).view(np.uint8).reshape(-1, 8)
        total = np.zeros((rows, 64), np.int64)
        for o in range(8):
            for h in (0, 1):
                part = np.add.reduceat(_LANES[h][octets[:, o]], at[full]) if full.any() else np.zeros(0, np.uint64)
                lanes = part.view(np.uint16).reshape(-1, 4)
                if len(of) == rows:
                    total[of[full], 8 * o + 4 * h : 8 * o + 4 * h + 4] = lanes
                else:
                    np.add.at(total[:, 8 * o + 4 * h : 8 * o + 4 * h + 4], of[full], lanes.astype(np.int64))
        out[:, w] = np.packbits(2 * total > n[:, None], axis=1).view(np.uint64).ravel()
    return out, n


def fingerprints(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, offsets = textvec.column(arr)
    parts = [simhash(*(lambda w: (w[0], w[3]))(textvec.words(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))) for a, b in textvec.chunks(offsets)]
    if not parts:
        return np.zeros((0, WORDS), np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Blocks:
    """A fingerprint's bits as a ring of blocks, more than ``distance`` of them, each within one word.

    Two fingerprints within the distance differ in fewer bits than there are blocks, so some block is equal in both.  By
    the cycle lemma one can start at such a block that the first l blocks from there on differ in at most
    l * distance / blocks bits, for every l: this sorts out most pairs that share a block only by chance.
    """

    def __init__(self, distance: int):
        self.distance = distance
        self.n = max(8, distance + 1)
        if self.n > BITS:
            raise ValueError(f"the distance must be less than {BITS}")
        self.width: list[int] = []
        for w in range(WORDS):
            k = (self.n + WORDS - 1 - w) // WORDS
            self.width += [64 * (i + 1) // k - 64 * i // k for i in range(k)]
        self.start = [sum(self.width[:b]) for b in range(self.n)]

    def value(self, fp: np.ndarray, b: int) -> np.ndarray:
        s = self.start[b]
        return (fp[:, s // 64] >> np.uint64(s % 64)) & np.uint64((1 << self.width[b]) - 1)

    def column(self, b: int) -> F.Column:
        """The value of block b with its number, as a bigint."""
        s = self.start[b]
        return F.lit(b << 32) + F.shiftrightunsigned(_FP[s // 64], s % 64).bitwiseAND(F.lit((1 << self.width[b]) - 1))

    def turned(self, fp: np.ndarray, b: int) -> np.ndarray:
        """The 64 bits from the start of block b on."""
        w, s = divmod(self.start[b], 64)
        low = fp[:, w] >> np.uint64(s)
        return low | (fp[:, (w + 1) % WORDS] << np.uint64(64 - s)) if s else low

    def allowed(self, length: int) -> int:
        return length * self.distance // self.n

    def prefix(self, b: int) -> tuple[np.uint64, int]:
        """A mask of the blocks from b on that fit in 64 bits, and the bits that may differ there."""
        size = length = 0
        while length < self.n and size + self.width[(b + length) % self.n] <= 64:
            size += self.width[(b + length) % self.n]
            length += 1
        return np.uint64((1 << size) - 1), self.allowed(length)

    def probes(self, b: int, length: int) -> tuple[int, list[int]]:
        """Bits of the given number of blocks after b, and the differences that they may have."""
        size, got = 0, [0]
        for k in range(1, length + 1):
            width, most = self.width[(b + k) % self.n], self.allowed(k + 1)
            parts = [[] for _ in range(min(width, most) + 1)]
            for x in range(1 << width):
                if x.bit_count() < len(parts):
                    parts[x.bit_count()].append(x)
            got = [g | (x << size) for g in got for p in parts[: max(0, most - g.bit_count()) + 1] for x in p]
            size += width
        return size, got


def _within(fp: np.ndarray, i: np.ndarray, j: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1) <= distance


def _dense(fp: np.ndarray, value: np.ndarray, size: int, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Clusters in crowded buckets: a component's number of each row (-1: none) and the edges (leader, row) that show it."""
    n = len(fp)
    count = np.bincount(value, minlength=1 << size)
    limit = max(64, 8 * n >> size)
    a, b, label = [], [], np.full(n, -1)
    for bucket in np.flatnonzero(count > limit):
        rows = np.flatnonzero(value == bucket)
        while True:
            rows = rows[label[rows] < 0]
            if len(rows) <= limit:
                break
            near = np.flatnonzero(np.bitwise_count(fp ^ fp[rows[0]]).sum(axis=1) <= distance)
            a.append(np.full(len(near), rows[0]))
            b.append(near)
            label[near] = 1
            if 2 * (label[rows] < 0).sum() > len(rows):  # it isn't a cluster
                break
    if not a:
        return label, np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = np.concatenate(a), np.concatenate(b)
    nodes, least = components.join_sets(x, y)
    label[nodes] = least
    return label, x, y


def _meet(value: np.ndarray, rows: np.ndarray, other: np.ndarray, size: int, probes: list[int], piece: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one of ``rows`` and one of ``other`` whose values differ by a probe; if both are the same rows, each pair once."""
    own = rows is other
    order = other[np.argsort(value[other], kind="stable")].astype(np.int32)
    count = np.bincount(value[other], minlength=1 << size).astype(np.int32)
    start = np.cumsum(count, dtype=np.int32) - count
    value = value.astype(np.int32)
    kinds: dict[int, list[int]] = {}
    for p in probes:
        kinds.setdefault(p.bit_length() if own else 0, []).append(p)
    for top, some in kinds.items():
        if own and not top:  # the same bucket
            place = np.empty(len(value), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            left, masks = rows, np.zeros(1, np.int32)
        else:
            left, masks = rows[(value[rows] >> (top - 1)) & 1 == 0] if own else rows, np.array(some, np.int32)
        step = max(1, piece // len(masks))
        for at in range(0, len(left), step):
            i = left[at : at + step]
            target = (value[i][:, None] ^ masks).ravel()
            first, n = start[target], count[target]
            if own and not top:
                n, first = first + n - place[i] - 1, place[i] + 1
            hit = np.flatnonzero(n > 0)
            i, first, n = i[hit // len(masks)], first[hit], n[hit]
            ends = np.cumsum(n, dtype=np.int64)
            lo = 0
            while lo < len(i):
                base = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, base + 4 * piece, side="right")))
                c = n[lo:hi]
                yield np.repeat(i[lo:hi], c), order[np.repeat(first[lo:hi] - (ends[lo:hi] - c - base), c) + np.arange(c.sum())]
                lo = hi


def near_in_block(fp: np.ndarray, b: int, blocks: Blocks, few: int = 512, many: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs among rows equal in block b: all that the ring shows from b on, but those of two rows of one dense cluster.

    ``few`` rows are compared directly; more are sorted into buckets by the two, or three, following blocks.
    """
    n = len(fp)
    turned = blocks.turned(fp, b)
    mask, most = blocks.prefix(b)
    x, y = [], []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        likely = np.bitwise_count((turned[i] ^ turned[j]) & mask) <= most
        i, j = i[likely], j[likely]
        good = _within(fp, i, j, blocks.distance)
        x.append(i[good])
        y.append(j[good])

    following = 3 if n > many else 2
    size = sum(blocks.width[(b + k) % blocks.n] for k in range(1, following + 1))
    if n <= few or size > 24:
        step = max(1, min(64, (1 << 20) // n))
        turned &= mask
        for at in range(0, n, step):
            i, j = np.nonzero(np.bitwise_count(turned[at : at + step, None] ^ turned[None, at:]) <= most)
            later = j > i
            keep(i[later] + at, j[later] + at)
    else:
        size, probes = blocks.probes(b, following)
        value = ((turned >> np.uint64(blocks.width[b])) & np.uint64((1 << size) - 1)).astype(np.int64)
        label, i, j = _dense(fp, value, size, blocks.distance)
        x.append(i)
        y.append(j)
        cold = np.flatnonzero(label < 0)
        for pairs in _meet(value, cold, cold, size, probes):
            keep(*pairs)
        for k in np.unique(label[label >= 0]):
            one = np.flatnonzero(label == k)
            for pairs in _meet(value, cold, one, size, probes):
                keep(*pairs)
            for pairs in _meet(value, one, np.flatnonzero(label > k), size, probes):
                keep(*pairs)
    return (np.concatenate(x), np.concatenate(y)) if x else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def near_edges(key: np.ndarray, fp: np.ndarray, ident: np.ndarray, blocks: Blocks) -> tuple[np.ndarray, np.ndarray]:
    """From rows sorted by block key: (row, least row) of the components of the near pairs of each block value, each once."""
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    a, b = [], []
    for lo, hi in zip(cut, np.append(cut[1:], len(key)), strict=True):
        if hi - lo < 2:
            continue
        x, y = near_in_block(fp[lo:hi], int(key[lo] >> 32) & 0xFFFF, blocks)
        if len(x):
            nodes, least = components.join_sets(ident[lo:hi][x], ident[lo:hi][y])
            a.append(nodes[nodes != least])
            b.append(least[nodes != least])
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
    return out[:, 0], out[:, 1]


_FP = [f"f{i}" for i in range(WORDS)]


def _fingerprint_table(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """(d, h, tie, f0 .. f3), written: null fingerprints where a text has no word; h tells texts of one id apart, tie all rows."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, n = fingerprints(batch.column(3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(fp[:, w].view(np.int64), mask=n == 0) for w in range(WORDS))], names=["d", "h", "tie", *_FP])

    t = F.col(f"`{text}`").cast("string")
    cols = df.select(F.col(f"`{id_col}`").alias("d"), F.xxhash64(t).alias("h"), F.monotonically_increasing_id().alias("tie"), t.alias("t"))
    return common.materialise(cols.mapInArrow(run, f"d {kind}, h bigint, tie bigint, " + ", ".join(f"{c} bigint" for c in _FP)))


def _block_rows(uniq: DataFrame, blocks: Blocks, part_rows: int) -> DataFrame:
    """(key, u, fingerprint) for each block; a value of more rows than a task takes is split, and its rows go to each pair of parts that theirs is in."""
    rows = uniq.select(F.explode(F.array(*[blocks.column(b) for b in range(blocks.n)])).alias("key"), "u", *_FP)
    if uniq.count() <= part_rows:  # no block value can have more
        return rows
    hot = common.materialise(rows.groupBy("key").count().filter(F.col("count") > part_rows).select(F.col("key").alias("k"), F.ceil(F.col("count") / part_rows).cast("int").alias("parts")))
    cold = rows.join(exact_dedup.maybe_broadcast(hot), F.col("key") == F.col("k"), "left")
    own = F.pmod(F.xxhash64("u"), F.col("parts")).cast("bigint")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(own, q.cast("bigint")).alias("p"), F.greatest(own, q.cast("bigint")).alias("q")))
    split = cold.filter("parts is not null").select("key", "u", *_FP, F.explode(cells).alias("cell"))
    # the cell's number goes above the block's, so that keys of cells stay distinct
    cell = F.col("cell.q") * (F.col("cell.q") + 1) / 2 + F.col("cell.p") + 1
    return cold.filter("parts is null").select("key", "u", *_FP).unionByName(split.select((F.col("key") + F.shiftleft(cell.cast("bigint"), 48)).alias("key"), "u", *_FP))


def _grouped(marks: DataFrame, distance: int, part_rows: int) -> DataFrame:
    """(fingerprint, g, n, lead) of fingerprints of groups of two rows or more: the group's least id and size, and the row that stays."""
    spark = marks.sparkSession
    blocks = Blocks(distance)
    lead = F.min(F.struct(F.col("d").isNull().alias("none"), "d", "h", "tie")).alias("lead")
    uniq = marks.filter("f0 is not null").groupBy(*_FP).agg(F.count("*").alias("n"), lead)
    uniq = common.materialise(uniq.withColumn("u", F.monotonically_increasing_id()))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(held: list[np.ndarray]) -> pa.RecordBatch:
            m = np.concatenate(held)
            a, b = near_edges(m[:, 0], np.ascontiguousarray(m[:, 2:]).view(np.uint64), m[:, 1], blocks)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        held: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            m = np.stack([batch.column(i).to_numpy() for i in range(2 + WORDS)], axis=1)
            held.append(m)
            rows += len(m)
            if rows >= 100_000 and held[0][0, 0] != m[-1, 0]:  # all but the last key is whole
                m = np.concatenate(held)
                cut = int(np.searchsorted(m[:, 0], m[-1, 0]))
                yield found([m[:cut]])
                held, rows = [m[cut:]], len(m) - cut
        if held:
            yield found(held)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _block_rows(uniq.select("u", *_FP), blocks, part_rows)
    edges = common.materialise(rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(pairs, "a bigint, b bigint").distinct())
    comp = common.materialise(components.connected_components(edges))
    of = uniq.join(exact_dedup.maybe_broadcast(comp), uniq["u"] == comp["node"], "left").filter("n > 1 or component is not null").select(*_FP, "n", "lead", F.coalesce("component", "u").alias("c"))
    of = common.materialise(of)
    whole = of.groupBy("c").agg(F.sum("n").alias("n"), F.min("lead").alias("lead"))
    return common.materialise(of.select(*_FP, "c").join(whole, "c").select(*_FP, F.col("lead.d").alias("g"), "n", "lead"))


def _marked(df: DataFrame, text: str, id_col: str, distance: int, part_rows: int) -> DataFrame:
    """(d, h, g, n, first) of every row: its group's least id and size, and whether it is the one that stays; g and n are null where it is alone."""
    marks = _fingerprint_table(df, text, id_col)
    groups = _grouped(marks, distance, part_rows)
    return marks.join(exact_dedup.maybe_broadcast(groups), _FP, "left").select("d", "h", "g", "n", (F.col("n").isNull() | (F.col("tie") == F.col("lead.tie"))).alias("first"))


def find_near_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", distance: int = DISTANCE, part_rows: int = PART_ROWS) -> DataFrame:
    """(doc_id, group_id, group_size, keep): connected groups of documents whose fingerprints are near.

    A fingerprint has 256 bits, over the distinct words of the whole text, and depends on that text only.  It is split
    into one block more than ``distance``, so every pair within the distance shares a block and is found; the blocks that
    follow the shared one must differ in few bits too before the whole is compared.  At a distance of 42 that looks at
    64 bits of some 1 % of all pairs of distinct fingerprints (a sixth of that where a block value has over 50,000), so
    this work grows with the square of their number; a lower distance has wider blocks and far fewer.  A block value shared by more than ``part_rows`` fingerprints is split into parts
    that are compared by pairs in several tasks.  ``group_id`` is the least id of the group; one row of each keeps.
    Null texts and texts without a word are alone, with their own id.  Null ids come last; repeated rows are copies of
    one another.  Other columns aren't read.
    """
    common.prepare(df.sparkSession)
    rows = _marked(df, text, id_col, distance, part_rows)
    alone = F.col("n").isNull()
    return rows.select(F.col("d").alias(id_col), F.when(alone, F.col("d")).otherwise(F.col("g")).alias("group_id"), F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"), F.col("first").alias("keep"))


def drop_near_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", distance: int = DISTANCE, part_rows: int = PART_ROWS) -> DataFrame:
    """The rows of the input, with all their columns, but one of each group of near duplicates: that of the least id.

    Null texts and texts without a word all stay.
    """
    common.prepare(df.sparkSession)
    columns = [f"`{c}`" for c in df.columns]
    rows = _marked(df, text, id_col, distance, part_rows).filter("n is not null").groupBy("d", "h").agg(F.count("*").alias("rows"), F.max("first").alias("first"))
    rows = common.materialise(rows.filter("not first or rows > 1"))
    d, h = "loomgraph_d", "loomgraph_h"
    docs = df.withColumns({d: F.col(f"`{id_col}`"), h: F.xxhash64(F.col(f"`{text}`").cast("string"))})

    def on(keys: DataFrame) -> F.Column:
        return docs[d].eqNullSafe(keys["d"]) & (docs[h] == keys["h"])

    touched = exact_dedup.maybe_broadcast(rows.select("d", "h"))
    out = docs.join(touched, on(touched), "left_anti").select(*columns)
    ties = rows.filter("first")
    if ties.limit(1).count() == 0:
        return out
    ties = exact_dedup.maybe_broadcast(ties)
    return out.unionByName(docs.join(ties, on(ties), "left_semi").dropDuplicates([d, h]).select(*columns))

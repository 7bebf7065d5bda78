"""Byte-level BPE on numpy matrices.

Distinct pre-tokens are put in buckets of equal (short) or similar length, one padded matrix of ids a bucket.  In each
round every row merges its leftmost pair of least rank and is compacted; pair ranks come from an open-addressed hash
table.  A row leaves when no pair of it is in the table.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np

from loomgraph.llm import pretoken, textvec

NONE = np.int32(2**31 - 1)
_STRIDE = np.uint64(1 << 20)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Longer pre-tokens are merged with a heap, in n log n rather than n * n.
LONG = 256
#: Distinct pre-tokens that a worker remembers.
CACHE = 300_000
#: Bytes of text whose pre-tokens are looked up at once; a longer single text is handled alone.
PART = 2 << 20


class Bpe:
    """Ranks of a ``.tiktoken`` file, ready for :meth:`encode`; picklable, to be broadcast (a few MB, whatever the corpus)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for t, i in ranks.items():
            tokens[i] = t
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[a], ranks[b], i) for t, i in ranks.items() for k in range(1, len(t)) if (a := t[:k]) in ranks and (b := t[k:]) in ranks]
        left, right, rank = (np.array(x, np.uint64) for x in zip(*pairs, strict=True))
        keys = left * _STRIDE + right + np.uint64(1)
        bits = max(10, int(np.ceil(np.log2(len(keys)))) + 2)
        self.shift, mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.zeros(1 << bits, np.uint64), np.full(1 << bits, NONE, np.int32)
        left_over = np.arange(len(keys))
        slot = ((keys * _SPREAD) >> self.shift).astype(np.int64)
        while len(left_over):  # one of those that want a free slot gets it, the others go on to the next
            want = slot[left_over]
            free = self.keys[want] == 0
            _, first = np.unique(want, return_index=True)
            won = np.zeros(len(want), bool)
            won[first] = True
            won &= free
            self.keys[want[won]], self.ranks[want[won]] = keys[left_over[won]], rank[left_over[won]].astype(np.int32)
            left_over = left_over[~won]
            slot[left_over] = (slot[left_over] + 1) & mask

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE where there is none (an id of -1 is padding)."""
        key = (a.astype(np.int64) * int(_STRIDE) + b + 1).view(np.uint64)
        slot = ((key * _SPREAD) >> self.shift).astype(np.int64)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], NONE)
        out[(a < 0) | (b < 0)] = NONE
        open_ = np.flatnonzero(((found != key) & (found != 0) & (a >= 0) & (b >= 0)).ravel())
        if len(open_):
            flat, key, slot, mask = out.reshape(-1), key.reshape(-1)[open_], slot.reshape(-1)[open_], len(self.keys) - 1
            while len(open_):
                slot = (slot + 1) & mask
                found = self.keys[slot]
                hit = found == key
                flat[open_[hit]] = self.ranks[slot[hit]]
                go = ~hit & (found != 0)
                open_, key, slot = open_[go], key[go], slot[go]
        return out

    def _heap(self, ids: list[int]) -> list[int]:
        n = len(ids)
        prev, after, dead = list(range(-1, n - 1)), [*range(1, n), -1], [False] * n

        def rank(i: int) -> int:
            return int(self.lookup(np.array([ids[i]], np.int32), np.array([ids[after[i]]], np.int32))[0])

        first = self.lookup(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if dead[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], dead[j], after[i] = r, True, after[j]
            if after[j] >= 0:
                prev[after[j]] = i
            for k in (prev[i], i):
                if k >= 0 and after[k] >= 0 and (x := rank(k)) != NONE:
                    heapq.heappush(heap, (x, k, ids[k], ids[after[k]]))
        return [t for t, d in zip(ids, dead, strict=True) if not d]

    def merge(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens, one after another, and how many each has."""
        n = len(starts)
        counts = np.zeros(n, np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []  # rows, and their ids padded with -1
        for i in np.flatnonzero(lengths > LONG):
            ids = self._heap(self.byte_ids[buf[starts[i] : starts[i] + lengths[i]]].tolist())
            done.append((np.array([i]), np.array([ids], np.int32)))
        short = np.flatnonzero(lengths <= LONG)
        width = lengths[short]
        width = np.where(width > 16, 1 << np.ceil(np.log2(np.maximum(width, 1))).astype(np.int64), width)
        order = np.argsort(width, kind="stable")
        cuts = np.flatnonzero(np.diff(width[order])) + 1
        for part in np.split(order, cuts) if len(order) else []:
            rows, w = short[part], int(width[part[0]])
            if w > 16:
                at = starts[rows][:, None] + np.arange(w)
                inside = np.arange(w) < lengths[rows][:, None]
                ids = np.where(inside, self.byte_ids[buf[np.minimum(at, len(buf) - 1)]], np.int32(-1))
            else:
                ids = self.byte_ids[buf[starts[rows][:, None] + np.arange(w)]]
            rank = self.lookup(ids[:, :-1], ids[:, 1:]) if w > 1 else np.zeros((len(rows), 0), np.int32)
            while rank.shape[1]:
                at = rank.argmin(axis=1)
                best = np.take_along_axis(rank, at[:, None], 1)[:, 0]
                stop = best == NONE
                if stop.any():
                    done.append((rows[stop], ids[stop]))
                    go = ~stop
                    rows, ids, rank, at, best = rows[go], ids[go], rank[go], at[go], best[go]
                    if len(rows) == 0:
                        break
                r = np.arange(len(rows))
                ids[r, at] = best
                cols = np.arange(ids.shape[1] - 1)
                ids = np.where(cols <= at[:, None], ids[:, :-1], ids[:, 1:])  # without column at + 1
                cols = cols[:-1]
                rank = np.where(cols < at[:, None], rank[:, :-1], rank[:, 1:])  # without column at
                has = at > 0
                if has.any() and ids.shape[1] > 1:
                    rank[r[has], at[has] - 1] = self.lookup(ids[r[has], at[has] - 1], ids[r[has], at[has]])
                has = at < ids.shape[1] - 1
                if has.any():
                    rank[r[has], at[has]] = self.lookup(ids[r[has], at[has]], ids[r[has], at[has] + 1])
            if len(rows):
                done.append((rows, ids))
        for rows, ids in done:
            counts[rows] = (ids >= 0).sum(axis=1)
        ends = np.cumsum(counts)
        flat = np.empty(int(ends[-1]) if n else 0, np.int32)
        for rows, ids in done:
            real = ids >= 0
            base = ends[rows] - counts[rows]
            flat[(base[:, None] + np.arange(ids.shape[1]))[real]] = ids[real]
        return flat, counts

    def _cached(self, keys: np.ndarray, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens, where each one's begin, and how many it has; what a worker met before isn't merged again."""
        c = self.__dict__.setdefault("_cache", [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)])
        at = np.searchsorted(c[0], keys)
        near = np.minimum(at, max(len(c[0]) - 1, 0))
        hit = (c[0][near] == keys) & (c[3][near] == lengths) if len(c[0]) else np.zeros(len(keys), bool)
        begin, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        begin[hit], count[hit] = c[1][near[hit]], c[2][near[hit]]
        miss = np.flatnonzero(~hit)
        flat, counts = self.merge(buf, starts[miss], lengths[miss])
        count[miss] = counts
        begin[miss] = len(c[4]) + np.cumsum(counts) - counts
        ids = np.concatenate([c[4], flat])
        if len(c[0]) < CACHE:
            new = miss[lengths[miss] <= 32]
            new = new[np.append(c[0], np.uint64(0))[at[new]] != keys[new]]
            c[:4] = [np.insert(x, at[new], y[new]) for x, y in zip(c[:4], (keys, begin, count, lengths), strict=True)]
            c[4] = ids
        return ids, begin, count

    def encode_rows(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows of text, one after another, and the bounds of each row (one more than rows).

        Each distinct pre-token of a part of the rows, told apart by a 64-bit hash and its length, is merged once.
        """
        parts = list(textvec.chunks(offsets, PART))
        if len(parts) < 2:
            return self._encode_part(buf, offsets)
        ids, bounds = zip(*(self._encode_part(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in parts), strict=True)
        base = np.cumsum([0] + [len(x) for x in ids])
        return np.concatenate(ids), np.concatenate([x[: None if i == len(parts) - 1 else -1] + base[i] for i, x in enumerate(bounds)])

    def _encode_part(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for a, b in textvec.chunks(offsets):
            o = offsets[a : b + 1] - offsets[a]
            text = buf[offsets[a] : offsets[b]]
            s = pretoken.token_starts(text, o)
            parts.append((s + offsets[a], textvec.span_hashes(text, s, np.append(s[1:], len(text)))))
        if not parts:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        starts, key = (np.concatenate(x) for x in zip(*parts, strict=True))
        lengths = np.diff(np.append(starts, len(buf)))
        key ^= lengths.astype(np.uint64) << np.uint64(58)
        distinct, first, which = np.unique(key, return_index=True, return_inverse=True)
        flat, begin, count = self._cached(distinct, buf, starts[first], lengths[first])
        own = count[which]
        bounds = np.concatenate([[0], np.cumsum(own)])
        ids = flat[np.repeat(begin[which] - bounds[:-1], own) + np.arange(bounds[-1])]
        return ids, bounds[np.searchsorted(starts, offsets)]

    def encode_exact(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode_rows`, decoded again and compared byte by byte; should two pre-tokens of a batch have one hash, each is merged for itself."""
        ids, row = self.encode_rows(buf, offsets)
        if not np.array_equal(self.decode(ids), buf):
            starts = np.concatenate([pretoken.token_starts(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) + offsets[a] for a, b in textvec.chunks(offsets)])
            ids, own = self.merge(buf, starts, np.diff(np.append(starts, len(buf))))
            row = np.concatenate([[0], np.cumsum(own)])[np.searchsorted(starts, offsets)]
        return ids, row

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_cache"}

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of ids, one after another."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ids) else 0
        return self.bytes[np.repeat(self.starts[ids] - (ends - size), size) + np.arange(total)]

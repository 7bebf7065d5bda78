"""Vectorised text primitives: words, their 64-bit hashes and per-row reductions straight from Arrow buffers.

A row's text is never turned into a Python string.  A *word* is a maximal run of ASCII letters, digits, ``_`` and
bytes above 0x7f; ASCII and Latin-1 capitals are folded.  All arithmetic is uint64 and wraps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
#: Bytes handled at once; a longer single text is handled alone.
CHUNK = 1 << 20

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[95] = True
WORD[128:] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """P**i (or its inverse) for i < n, kept between calls while it is of ordinary size."""
    key, base = ("i", _PINV) if inverse else ("p", _P)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 8 * CHUNK:
            _powers[key] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def mix_int(h: int) -> int:
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return h ^ (h >> 31)


def column(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (one more than rows) of a string or binary column; a null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    if len(arr) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes are within the limit, or of one longer row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def fold(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the capitals of Latin-1 in UTF-8."""
    low = FOLD[buf]
    if (buf >= 0xC3).any():
        at = np.flatnonzero(buf[:-1] == 0xC3) + 1
        b = low[at]
        up = (b >= 0x80) & (b <= 0x9E) & (b != 0x97)
        low[at[up]] = b[up] + 32
    return low


def spans(is_in: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at the rows' bounds."""
    n = len(is_in)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = is_in[:-1]
    cut = offsets[:-1][offsets[:-1] < n]
    prev[cut] = False
    starts = np.flatnonzero(is_in & ~prev)
    nxt = np.empty(n, bool)
    nxt[-1] = False
    nxt[:-1] = is_in[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    nxt[cut - 1] = False
    ends = np.flatnonzero(is_in & ~nxt) + 1
    return starts, ends


class SpanHasher:
    """64-bit hashes of any spans of the given bytes."""

    def __init__(self, low: np.ndarray):
        self.pre = np.empty(len(low) + 1, U64)
        self.pre[0] = 0
        np.cumsum((low.astype(U64) + U64(1)) * powers(len(low)), out=self.pre[1:])
        self.inverse = powers(len(low) + 1, inverse=True)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.pre[ends] - self.pre[starts]) * self.inverse[starts])


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return SpanHasher(low)(starts, ends)


def word_hash(word: str) -> int:
    """What :func:`span_hashes` gives for one word, in plain Python."""
    data = bytes(fold(np.frombuffer(word.encode(), np.uint8)))
    return mix_int(sum((b + 1) * pow(_P, i, 1 << 64) for i, b in enumerate(data)) & (2**64 - 1))


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows' words: hash, start, end, and how many words begin before each row's start (one more than rows)."""
    low = fold(buf)
    starts, ends = spans(WORD[buf], offsets)
    return span_hashes(low, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums over [bounds[i], bounds[i+1]); 0 where empty."""
    pre = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=pre[1:])
    return pre[bounds[1:]] - pre[bounds[:-1]]


class Table:
    """Values of hashes, looked up behind a bit table that most tokens don't pass."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(keys >> np.uint64(42)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are there, and their places in the given keys."""
        maybe = np.flatnonzero(self.bits[(h >> np.uint64(42)).astype(np.int64)])
        if len(maybe) == 0 or len(self.keys) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == h[maybe]
        return maybe[hit], self.order[at[hit]]

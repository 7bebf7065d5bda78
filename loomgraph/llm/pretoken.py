"""Pre-tokenisation by the public byte-level BPE pattern, vectorised over UTF-8 bytes.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.  It only looks at runs of
letters, numbers, white space and the rest, so its matches follow from the bounds of those runs.
"""

from __future__ import annotations

import numpy as np
import regex

OTHER, LETTER, NUMBER, SPACE, UNKNOWN = 0, 1, 2, 3, 255
_KINDS = ((LETTER, regex.compile(r"\p{L}")), (NUMBER, regex.compile(r"\p{N}")), (SPACE, regex.compile(r"[\t-\r \x85\xa0  -     　]")))
_table = np.full(0x110000, UNKNOWN, np.uint8)


def _kind(code: int) -> int:
    return next((k for k, p in _KINDS if p.fullmatch(chr(code))), OTHER)


_table[:128] = [_kind(i) for i in range(128)]


def kinds(buf: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte belongs to; the bytes are valid UTF-8."""
    out = _table[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead) == 0:
        return out
    b0 = buf[lead].astype(np.uint32)
    size = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
    code = np.where(size == 2, b0 & 0x1F, np.where(size == 3, b0 & 0x0F, b0 & 0x07))
    for i in (1, 2, 3):
        has = size > i
        code[has] = (code[has] << 6) | (buf[lead[has] + i] & 0x3F)
    kind = _table[code]
    if (kind == UNKNOWN).any():
        for c in np.unique(code[kind == UNKNOWN]):
            _table[c] = _kind(int(c))
        kind = _table[code]
    out[lead] = kind
    for i in (1, 2, 3):
        has = size > i
        out[lead[has] + i] = kind[has]
    return out


def token_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pre-tokens start; each ends where the next starts, and none crosses a row's bounds."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = kinds(buf)
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    edge[1:n] = kind[1:] != kind[:-1]
    row = np.zeros(n + 1, bool)
    row[offsets] = True
    edge |= row
    bounds = np.flatnonzero(edge)
    rs, re = bounds[:-1], bounds[1:]
    rk = kind[rs]
    last_space = (rk == SPACE) & (buf[re - 1] == 32)
    joined = np.empty(len(rs), bool)  # the run before is in the same row
    joined[0] = False
    joined[1:] = ~row[rs[1:]]
    attach = np.zeros(len(rs), bool)
    attach[1:] = last_space[:-1] & joined[1:] & (rk[1:] != SPACE)
    start = np.zeros(n + 1, bool)
    start[rs - attach] = True
    space = np.flatnonzero(rk == SPACE)
    start[rs[space]] = True
    followed = space[:-1] if len(space) and space[-1] == len(rs) - 1 else space
    followed = followed[joined[followed + 1] & ~last_space[followed]]
    if len(followed):
        last = re[followed] - 1
        while (cont := (buf[last] & 0xC0) == 0x80).any():
            last = last - cont
        start[last] = True
    start[rs[(rk != SPACE) & attach]] = False
    quote = np.flatnonzero((rk[:-1] == OTHER) & (buf[rs[:-1]] == 39) & (re[:-1] - rs[:-1] == 1) & ~attach[:-1] & (rk[1:] == LETTER) & joined[1:])
    if len(quote):
        at, stop = rs[quote + 1], re[quote + 1]
        a = buf[at]
        b = np.where(at + 1 < stop, buf[np.minimum(at + 1, n - 1)], 0)
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        hit = one | two
        at, stop, length = at[hit], stop[hit], np.where(one[hit], 1, 2)
        start[at] = False
        start[(at + length)] = True
    return np.flatnonzero(start[:n])

"""Benchmark decontamination by canonical templates (operator 2)."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common, textvec

#: Tokens of a template window, plain words that it needs, and the share of an item's windows that makes a leak.
WINDOW, PLAIN, COVERAGE = 8, 4, 0.5
#: Windows of one pass over the documents, at most (some 40 bytes each, broadcast); a larger benchmark takes more passes.
PASS_WINDOWS = 2_000_000
WORD_, NUMBER, NAME, UNIT = 0, 1, 2, 3
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles g kg mg gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years percent degree degrees celsius fahrenheit kelvin dollar dollars cent cents euro euros usd eur gbp "
    "mph kph watt watts volt volts joule joules newton newtons hertz hz khz mhz ghz kb mb gb tb byte bytes bit bits meter meters metre metres kilometer kilometers centimeter centimeters"
).split()
_UNITS = textvec.Table(np.array([textvec.word_hash(u) for u in UNITS], np.uint64))
_PLACE = np.array([textvec.word_hash(x) for x in ("", "<number>", "<name>", "<unit>")], np.uint64)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def template(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows' tokens: template hash (the word's, or its placeholder's), the value's hash, the type, and the rows' bounds.

    A word that starts with a digit is a number (parts joined by one point or comma are one number), one that starts with
    a capital is a name, one of the list of units is a unit.
    """
    low = textvec.fold(buf)
    starts, ends = textvec.spans(textvec.WORD[buf], offsets)
    digit = _DIGIT[buf[starts]]
    if digit.any():  # 1,250.75 is one token
        rest = np.zeros(len(starts), bool)
        rest[1:] = digit[1:] & digit[:-1] & (starts[1:] - ends[:-1] == 1)
        at = np.flatnonzero(rest)
        rest[at] = (buf[starts[at] - 1] == 44) | (buf[starts[at] - 1] == 46)
        rest[np.searchsorted(starts, offsets[:-1])[np.searchsorted(starts, offsets[:-1]) < len(starts)]] = False
        last = np.append(~rest[1:], True) if len(rest) else rest
        starts, ends, digit = starts[~rest], ends[last], digit[~rest]
    value = textvec.span_hashes(low, starts, ends)
    first = buf[starts]
    second = buf[np.minimum(starts + 1, len(buf) - 1)] if len(buf) else first
    kind = np.zeros(len(starts), np.int8)
    kind[_UPPER[first] | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))] = NAME
    kind[_UNITS.find(value)[0]] = UNIT
    kind[digit] = NUMBER
    return np.where(kind == WORD_, value, _PLACE[kind]), value, kind, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n tokens from each place on; the last n - 1 places have none."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    pre = np.empty(len(hashes) + 1, np.uint64)
    pre[0] = 0
    np.cumsum(hashes * textvec.powers(len(hashes)), out=pre[1:])
    return textvec.mix((pre[n:] - pre[:-n]) * textvec.powers(len(hashes) - n + 1, inverse=True) + np.uint64(n))


@dataclass
class Item:
    ident: object
    value: np.ndarray
    kind: np.ndarray
    size: int  # tokens of its windows
    valid: int  # windows with enough plain words
    exact: int  # windows with fewer, found by their values only


@dataclass
class Benchmark:
    items: list[Item]
    tables: dict[int, tuple[textvec.Table, np.ndarray, np.ndarray]]  # by window size: template hashes, and each one's item and place
    exact: dict[int, tuple[textvec.Table, np.ndarray, np.ndarray]] = field(default_factory=dict)  # the same of value hashes


def build(rows: list[tuple[object, str | None]], limit: int = PASS_WINDOWS) -> list[Benchmark]:
    """Items in passes of bounded size.  An item of fewer tokens than a window is one window; only one without a token has none."""
    out, items, total = [], [], 0
    got: tuple[dict, dict] = defaultdict(list), defaultdict(list)  # template windows, exact windows

    def close() -> None:
        nonlocal items, got, total
        tables = [{n: (textvec.Table(np.array([h for h, _, _ in x], np.uint64)), np.array([i for _, i, _ in x]), np.array([p for *_, p in x])) for n, x in g.items()} for g in got]
        out.append(Benchmark(items, *tables))
        items, got, total = [], (defaultdict(list), defaultdict(list)), 0

    for ident, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        h, value, kind, _ = template(data, np.array([0, len(data)]))
        n = min(WINDOW, len(h))
        if n == 0:
            continue
        plain = np.convolve(kind == WORD_, np.ones(n, int), "valid")
        w, exact = windows(h, n), windows(value, n)
        good, rest = np.flatnonzero(plain >= PLAIN), np.flatnonzero(plain < PLAIN)
        for g, x, places in ((got[0], w, good), (got[1], exact, rest)):
            if len(places):
                g[n] += [(int(x[p]), len(items), int(p)) for p in places]
        items.append(Item(ident, value, kind, n, len(good), len(rest)))
        total += len(w)
        if total >= limit:
            close()
    if items:
        close()
    return out


def _consistent(item: Item, value: np.ndarray, kind: np.ndarray, shift: int, places: np.ndarray) -> tuple[bool, int]:
    """Whether the item's slot values map one to one to the text's, over the tokens of the matched windows; and how many slots have another value."""
    own = np.unique(places[:, None] + np.arange(item.size))
    own = own[item.kind[own] != WORD_]
    a, b = item.value[own], value[own + shift]
    to, back = {}, {}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if to.setdefault(x, y) != y or back.setdefault(y, x) != x:
            return False, 0
    return True, int((a != b).sum())


def _agreeing(item: Item, value: np.ndarray, shift: int, places: np.ndarray) -> tuple[list[int], int]:
    """The windows whose slot values are the item's, or all follow the value that most of the slot's occurrences have; and how many of their slots have another value."""
    own = np.unique(places[:, None] + np.arange(item.size))
    own = own[item.kind[own] != WORD_]
    a, b = item.value[own], value[own + shift]
    votes: dict[int, Counter] = defaultdict(Counter)
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        votes[x][y] += 1
    most = {x: max(v, key=lambda y: (v[y], y == x, y)) for x, v in votes.items()}
    same = dict(zip(own.tolist(), (a == b).tolist(), strict=True))
    fits = dict(zip(own.tolist(), (most[x] == y for x, y in zip(a.tolist(), b.tolist(), strict=True)), strict=True))
    kept = [p for p in places.tolist() if all(same.get(k, True) for k in range(p, p + item.size)) or all(fits.get(k, True) for k in range(p, p + item.size))]
    used = {k for p in kept for k in range(p, p + item.size)}
    return kept, sum(not x for k, x in same.items() if k in used)


def match(buf: np.ndarray, offsets: np.ndarray, bench: Benchmark, coverage: float = COVERAGE, strict: bool = True) -> list[tuple[int, int, float, int]]:
    """(row, item, share of its windows, slots with another value) of the leaks in rows of text.

    ``strict`` drops an alignment whole if slots don't map one to one; else only its windows that disagree with most.
    """
    out = []
    for a, b in textvec.chunks(offsets):
        h, value, kind, bounds = template(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        # equal hashes of several windows: the table holds each, so look up the distinct and expand
        hits, same = defaultdict(list), defaultdict(set)
        for tables, tokens, exact in ((bench.tables, h, False), (bench.exact, value, True)):
            for n, (table, of, place) in tables.items():
                w = windows(tokens, n)
                at, _ = table.find(w)
                for p in at.tolist():
                    row = int(np.searchsorted(bounds, p, side="right")) - 1
                    if p + n > bounds[row + 1]:
                        continue
                    if n < PLAIN and n != bounds[row + 1] - bounds[row]:  # a few tokens are a copy only as the whole text
                        continue
                    lo = int(np.searchsorted(table.keys, w[p]))
                    while lo < len(table.keys) and table.keys[lo] == w[p]:
                        k = table.order[lo]
                        if exact:
                            same[row, int(of[k])].add(int(place[k]))
                        else:
                            hits[row, int(of[k])].append((p - int(place[k]), int(place[k])))
                        lo += 1
        for row, i in hits.keys() | same.keys():
            item, got, verbatim = bench.items[i], hits.get((row, i), []), len(same.get((row, i), ()))
            n = len({p for _, p in got})
            if (not item.valid or n < coverage * item.valid) and n + verbatim < coverage * (item.valid + item.exact):
                continue
            by_shift = defaultdict(list)
            for shift, p in got:
                by_shift[shift].append(p)
            found, changed = set(), 0
            for shift, places in sorted(by_shift.items(), key=lambda x: (-len(x[1]), x[0])):
                new = sorted(set(places) - found)
                if not new:
                    continue
                if strict:
                    ok, n = _consistent(item, value, kind, shift, np.array(new))
                    new = new if ok else []
                else:
                    new, n = _agreeing(item, value, shift, np.array(new))
                found.update(new)
                changed += n
            if item.valid and len(found) >= coverage * item.valid:
                out.append((a + row, i, len(found) / item.valid, changed))
            elif len(found) + verbatim >= coverage * (item.valid + item.exact):
                out.append((a + row, i, (len(found) + verbatim) / (item.valid + item.exact), changed))
    return sorted(out)


def _items(benchmark: DataFrame, id_col: str, text: str) -> list[Benchmark]:
    """The benchmark is gathered in chunks on the driver (it doesn't grow with the corpus)."""
    return build([(r[0], r[1]) for r in benchmark.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").cast("string")).toLocalIterator()])


def find_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", item_col: str = "item_id", coverage: float = COVERAGE, strict: bool = True) -> DataFrame:
    """(doc_id, item_id, coverage, changed_slots): documents that hold a benchmark item, as it is or with other numbers, names or units.

    Windows of eight canonical tokens of at least four plain words are hash-joined; matches of an item are put in line
    by their offset and dropped where a slot's value doesn't map one to one, all of them or, if not ``strict``, those that disagree with
    most, and values may become equal.  Windows of fewer plain words are joined on
    the values of all their tokens.  A leak has half of the item's template windows, or half of all; an item of fewer
    than four tokens is found only as a whole text.
    Null and empty texts hold nothing; null items are skipped; an item that occurs twice in the benchmark is found as
    both.  Repeated rows and null ids give their own rows; other columns aren't read.  One pass over the documents,
    without a shuffle, for each two million windows of the benchmark.
    """
    spark = df.sparkSession
    common.prepare(spark)
    kind, item_kind = df.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(item_kind.simpleString(), pa.string())
    docs = df.select(F.col(f"`{id_col}`").alias("d"), F.col(f"`{text}`").cast("string").alias("t"))
    out = None
    for bench in _items(benchmark.withColumn(item_col, F.col(f"`{item_col}`").cast("string")) if arrow == pa.string() else benchmark, item_col, text) or [Benchmark([], {})]:
        shared = spark.sparkContext.broadcast(bench)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            b = shared.value
            for batch in batches:
                got = match(*textvec.column(batch.column(1)), b, coverage, strict)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([x[0] for x in got], pa.int64())), pa.array([b.items[x[1]].ident for x in got], arrow), pa.array([x[2] for x in got], pa.float64()), pa.array([x[3] for x in got], pa.int64())], names=[id_col, item_col, "coverage", "changed_slots"])

        part = docs.mapInArrow(run, f"`{id_col}` {kind}, `{item_col}` {'string' if arrow == pa.string() else item_kind.simpleString()}, coverage double, changed_slots bigint")
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id", coverage: float = COVERAGE, strict: bool = True) -> DataFrame:
    """The rows of the input, with all their columns, that hold no benchmark item; null texts stay."""
    common.prepare(df.sparkSession)
    place = df.columns.index(text)
    for bench in _items(benchmark, item_col, "text"):
        shared = df.sparkSession.sparkContext.broadcast(bench)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in match(*textvec.column(batch.column(place)), shared.value, coverage, strict)]] = False
                yield batch.filter(pa.array(keep))

        df = common.map_rows(df, run)
    return df

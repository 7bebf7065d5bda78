"""Document quality from a linear-chain conditional random field over lines (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common, textvec

#: Labelled documents that the field is fitted on at most, those of least hash.
SAMPLE_ROWS = 6_000
#: Documents of at least this quality are good.
THRESHOLD = 0.5
_SET = {name: np.isin(np.arange(256), np.frombuffer(chars, np.uint8)) for name, chars in (("stop", b".!?"), ("comma", b",;:'\"()-"), ("symbol", b"#$%&*+/<=>@[\\]^_`{|}~"))}
_CLASSES = [textvec.WORD & (np.arange(256) >= 65), np.isin(np.arange(256), np.arange(48, 58)), np.isin(np.arange(256), [9, 32]), np.isin(np.arange(256), np.arange(65, 91)), np.arange(256) >= 128, _SET["stop"], _SET["comma"], _SET["symbol"]]
#: Features of a line itself.
OWN = len(_CLASSES) + 8


def lines(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (without the line feed) of the lines that aren't empty, and the rows' bounds."""
    starts, ends = textvec.spans(buf != 10, offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line, its length in characters, and the rows' bounds."""
    starts, ends, bounds = lines(buf, offsets)
    n = len(starts)
    if n == 0:
        return np.zeros((0, OWN), np.float32), np.zeros(0, np.int64), bounds

    def total(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return c[ends] - c[starts]

    size = (ends - starts).astype(np.float64)
    out = np.zeros((n, OWN), np.float32)
    for i, c in enumerate(_CLASSES):
        out[:, i] = total(c[buf]) / size
    h, s, _, _ = textvec.words(buf, offsets)
    first = np.searchsorted(s, np.append(starts, len(buf)))
    count = np.diff(first)
    line = np.repeat(np.arange(n), count)
    k = len(_CLASSES)
    key = np.sort((line.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))) if len(h) else h
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n)
    runs = np.diff(np.append(np.flatnonzero(new), len(key))) if len(key) else np.zeros(0, np.int64)
    most = np.zeros(n)
    np.maximum.at(most, (key[new] >> np.uint64(40)).astype(np.int64), runs)
    words = np.maximum(count, 1)
    out[:, k] = np.log1p(size) / 8
    out[:, k + 1] = np.log1p(count) / 6
    out[:, k + 2] = np.minimum(size / words, 40) / 10
    out[:, k + 3] = distinct / words
    out[:, k + 4] = most / words
    last = buf[ends - 1]
    out[:, k + 5] = _SET["stop"][last]
    out[:, k + 6] = _SET["symbol"][last]
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    own = textvec.span_hashes(buf, starts, ends) ^ row.astype(np.uint64)
    _, inverse, times = np.unique(own, return_inverse=True, return_counts=True)
    out[:, k + 7] = np.minimum(times[inverse] - 1, 5) / 5
    return out, total((buf & 0xC0) != 0x80), bounds


def with_neighbours(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A line's features beside those of the lines before and after it (0 at the ends), whether it is first or last, and 1."""
    n = len(x)
    out = np.zeros((n, 3 * OWN + 3), np.float32)
    out[:, :OWN] = x
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    inner = np.flatnonzero(~first[:n])
    out[inner, OWN : 2 * OWN] = x[inner - 1]
    out[inner - 1, 2 * OWN : 3 * OWN] = x[inner]
    out[:, 3 * OWN] = first[:n]
    out[:, 3 * OWN + 1] = first[1:]
    out[:, 3 * OWN + 2] = 1
    return out


def forward_backward(score: np.ndarray, mask: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of padded sequences (rows by lines) with log-odds for good: P(good) of each line, expected transitions, log partition."""
    rows, n = score.shape
    top = np.maximum(score, 0)
    emit = np.stack([np.exp(-top), np.exp(score - top)], axis=2)
    m = transition.max()
    step = np.exp(transition - m)
    alpha, scale = np.empty((rows, n, 2)), np.empty((rows, n))
    a = np.exp(start - start.max()) * emit[:, 0]
    for t in range(n):
        if t:
            a = (alpha[:, t - 1] @ step) * emit[:, t]
        scale[:, t] = a.sum(axis=1)
        alpha[:, t] = a / scale[:, t, None]
        if t and not mask[:, t].all():
            off = ~mask[:, t]
            alpha[off, t] = alpha[off, t - 1]
            scale[off, t] = 1
    beta = np.ones((rows, 2))
    good, pairs = np.empty((rows, n)), np.zeros((2, 2))
    for t in range(n - 1, -1, -1):
        p = alpha[:, t] * beta
        good[:, t] = p[:, 1] / p.sum(axis=1)
        if t:
            e = emit[:, t] * beta / scale[:, t, None]
            on = mask[:, t]
            both = alpha[on, t - 1][:, :, None] * step[None] * e[on][:, None, :]
            pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            beta = np.where(on[:, None], e @ step.T, beta)
    lengths = mask.sum(axis=1)
    log_z = (np.log(scale) + top * mask).sum(axis=1) + start.max() + m * (lengths - 1)
    return good, pairs, log_z


@dataclass
class Field:
    mean: np.ndarray
    deviation: np.ndarray
    weight: np.ndarray
    transition: np.ndarray
    start: np.ndarray

    def odds(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return with_neighbours((x - self.mean) / self.deviation, bounds) @ self.weight


def buckets(bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of similar length (the next power of two), the places of their lines, and which are real."""
    size = np.diff(bounds)
    width = np.where(size > 0, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), 0)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        mask = np.arange(w) < size[rows][:, None]
        yield rows, np.where(mask, bounds[rows][:, None] + np.arange(w), 0), mask


def marginals(odds: np.ndarray, bounds: np.ndarray, field: Field) -> np.ndarray:
    out = np.zeros(len(odds))
    for _, at, mask in buckets(bounds):
        good, _, _ = forward_backward(odds[at].astype(np.float64), mask, field.transition, field.start)
        out[at[mask]] = good[mask]
    return out


def train(x: np.ndarray, bounds: np.ndarray, y: np.ndarray, rounds: int = 150, ridge: float = 1e-3) -> Field:
    """Fit by Adam on the conditional likelihood; y has a label of each document.

    A document's label isn't each line's: in three rounds, a logistic fit to lines by themselves relabels the lines of
    bad documents that it finds good, but for the worst of each.
    """
    mean, deviation = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(OWN), np.ones(OWN))
    full = with_neighbours((x - mean) / deviation, bounds).astype(np.float64)
    line_y = np.repeat(y, np.diff(bounds)).astype(np.float64)
    weight = np.zeros(full.shape[1])
    field = Field(mean.astype(np.float32), deviation.astype(np.float32), weight, np.zeros((2, 2)), np.zeros(2))
    if len(x) == 0 or y.min() == y.max():
        field.weight = np.zeros(full.shape[1])
        field.weight[-1] = 0 if len(y) == 0 else (4 if y[0] else -4)
        return field
    each = 1 / np.repeat(np.maximum(np.diff(bounds), 1), np.diff(bounds))  # a document's lines weigh one together
    mine = np.append(np.arange(OWN), full.shape[1] - 1)  # a line by itself
    alone = full[:, mine]
    one, of = np.zeros(len(mine)), np.repeat(np.arange(len(y)), np.diff(bounds))
    for _ in range(3):
        m, v = 0.0, 0.0
        for t in range(1, rounds + 1):
            p = 1 / (1 + np.exp(-np.clip(alone @ one, -30, 30)))
            g = alone.T @ ((p - line_y) * each) / each.sum() + ridge * one
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            one -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        z = alone @ one
        worst = np.full(len(y), np.inf)
        np.minimum.at(worst, of, z)
        line_y = np.where((y[of] == 0) & ((z <= 0) | (z == worst[of])), 0.0, 1.0)
    cells = [(at, mask, line_y[at]) for _, at, mask in buckets(bounds)]
    rows = sum(len(at) for at, _, _ in cells)
    theta = np.zeros(full.shape[1] + 6)
    theta[mine] = one
    k, m, v = full.shape[1], np.zeros(len(theta)), np.zeros(len(theta))
    seen_pairs, seen_start = np.zeros((2, 2)), np.zeros(2)
    for _, mask, lab in cells:
        seen_start += [np.sum(lab[:, 0] == 0), np.sum(lab[:, 0] == 1)]
        on = mask[:, 1:]
        for a in (0, 1):
            for b in (0, 1):
                seen_pairs[a, b] += np.sum(on & (lab[:, :-1] == a) & (lab[:, 1:] == b))
    total = len(full)
    for t in range(1, rounds // 3 + 1):
        odds = full @ theta[:k]
        g = np.zeros(len(theta))
        pairs, start, diff = np.zeros((2, 2)), np.zeros(2), np.zeros(total)
        for at, mask, lab in cells:
            good, pr, _ = forward_backward(odds[at], mask, theta[k : k + 4].reshape(2, 2), theta[k + 4 :])
            pairs += pr
            start += [np.sum(1 - good[:, 0]), np.sum(good[:, 0])]
            diff[at[mask]] = (good - lab)[mask]
        g[:k] = full.T @ diff / total + ridge * theta[:k]
        g[k : k + 4] = (pairs - seen_pairs).ravel() / total
        g[k + 4 :] = (start - seen_start) / rows
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    field.weight, field.transition, field.start = theta[:k], theta[k : k + 4].reshape(2, 2), theta[k + 4 :]
    return field


def fit(df: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Field:
    """Features of a bounded sample of labelled documents go to the driver (some 100 bytes a line), where the field is fitted."""
    common.prepare(df.sparkSession)
    chosen = labels.filter(F.col(f"`{label}`").isNotNull() & F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("d")).agg(F.max(f"`{label}`").cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64(F.col("d"), F.lit(5)), "d").limit(sample_rows)
    sample = df.select(F.col(f"`{id_col}`").alias("d"), F.col(f"`{text}`").cast("string").alias("t")).join(F.broadcast(chosen), "d").select("d", "y", "t")
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = textvec.column(batch.column(2))
            xs = [features(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in textvec.chunks(offsets)]
            data, n = [], []
            for x, _, bounds in xs:
                n += np.diff(bounds).tolist()
                data += [x[p:q].tobytes() for p, q in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["d", "y", "x"])

    got = sample.mapInArrow(run, f"d {kind}, y int, x binary").toArrow().sort_by([("d", "ascending"), ("x", "ascending")])
    xs = [np.frombuffer(x, np.float32).reshape(-1, OWN) for x in got["x"].to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int64)
    return train(np.concatenate(xs) if xs else np.zeros((0, OWN), np.float32), bounds, np.minimum(got["y"].to_numpy(), 1))


def score_documents(df: DataFrame, field: Field, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, quality, good, n_lines, bad_lines): the mean of the lines' marginals for good, weighted by their characters.

    ``bad_lines`` lists the places (among the lines that aren't empty) of marginal below a half.  A null or empty text,
    or one of line feeds only, has quality 0 and isn't good.  Null ids and repeated rows give their own rows; other
    columns aren't read.
    """
    common.prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            buf, offsets = textvec.column(batch.column(1))
            quality, count, bad, ends = [], [], [], []
            for a, b in textvec.chunks(offsets):
                x, chars, bounds = features(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                p = marginals(f.odds(x, bounds), bounds, f)
                w = textvec.segment_sum(chars, bounds)
                quality.append(np.where(w > 0, textvec.segment_sum(p * chars, bounds) / np.maximum(w, 1), 0.0))
                count.append(np.diff(bounds))
                low = np.flatnonzero(p < 0.5)
                row = np.searchsorted(bounds, low, side="right") - 1
                bad.append(low - bounds[row])
                ends.append(np.bincount(row, minlength=b - a))
            q = np.concatenate(quality) if quality else np.zeros(0)
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(ends))]) if ends else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(q), pa.array(q >= threshold), pa.array(np.concatenate(count) if count else [], pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(bad) if bad else [], pa.int32()))], names=[id_col, "quality", "good", "n_lines", "bad_lines"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(f"`{id_col}`").alias("d"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, f"`{id_col}` {kind}, quality double, good boolean, n_lines bigint, bad_lines array<int>")


def classify(df: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fit on labels and score all documents; see :func:`score_documents`.  With no labels the quality is a half."""
    return score_documents(df, fit(df, labels, sample_rows=sample_rows))

"""Toxic passages as maximum-scoring segments of token log-odds (operator 6)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common, textvec

#: Labelled documents that the model is fitted on at most, those of least hash; all documents give the prior.
SAMPLE_ROWS = 20_000
#: Tokens' worth of the prior.
PRIOR = 1000.0
#: z of a token's log-odds from which it counts; what each other token costs; p-value from which a document is toxic.
SIGNIFICANT, COST, ALPHA = 3.5, 1.0, 1e-5
#: Most that one preceding word may have of a token's toxic occurrences; words of copied passages always follow the same.
DOMINANCE = 0.5
#: Tokens are words and, so that inflected forms share evidence, their first characters.
PREFIXES = (4, 6)
#: Toxic documents of the sample in which a token has to occur.
LEAST_DOCUMENTS = 3


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and of their prefixes (a column each; 0 where a word is no longer than the prefix), starts, ends and the rows' bounds."""
    low = textvec.fold(buf)
    starts, ends = textvec.spans(textvec.WORD[buf], offsets)
    of = textvec.SpanHasher(low)
    out = np.zeros((len(starts), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = of(starts, ends)
    lead = (buf & 0xC0) != 0x80
    if lead.all():
        chars, place = None, None
    else:
        chars, place = np.cumsum(lead), np.append(np.flatnonzero(lead), len(buf))
    for i, k in enumerate(PREFIXES):
        stop = starts + k if chars is None else place[np.minimum(chars[starts] - 1 + k, len(place) - 1)] if len(starts) else starts
        long = np.flatnonzero(stop < ends)
        out[long, i + 1] = of(starts[long], stop[long]) ^ np.uint64(0x5851F42D4C957F2D * (i + 1) & (2**64 - 1))
    return out, starts, ends, np.searchsorted(starts, offsets)


@dataclass
class Model:
    """Log-odds of the tokens that tell toxic from clean text, and the extreme-value law of clean text's segments."""

    table: textvec.Table
    score: np.ndarray
    slope: float  # lambda of the law: a segment of score s is expected k * n * exp(-slope * s) times in n clean tokens
    k: float


def log_odds(toxic: np.ndarray, clean: np.ndarray, background: np.ndarray, n_toxic: float, n_clean: float, n_background: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds ratios under a Dirichlet prior in proportion to the background (and a half for each token), and their z."""
    a = PRIOR * background / (n_background + 1) + 0.5
    t, c = toxic + a, clean + a
    delta = np.log(t / np.maximum(n_toxic + PRIOR - t, 1)) - np.log(c / np.maximum(n_clean + PRIOR - c, 1))
    return delta, delta / np.sqrt(1 / t + 1 / c)


def karlin_slope(score: np.ndarray, probability: np.ndarray) -> float:
    """The positive root of sum p exp(x s) = 1, where all other tokens score -COST."""
    rest = max(1e-9, 1 - probability.sum())

    def over(x: float) -> bool:
        return float((probability * np.exp(np.minimum(x * score, 700))).sum()) + rest * math.exp(-x * COST) > 1

    hi = 1e-3
    while not over(hi) and hi < 50:
        hi *= 2
    lo = hi / 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if over(mid) else (mid, hi)
    return hi


def segments(at: np.ndarray, score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score) in one pass: the tokens given score above 0, all others -COST."""
    stack: list[list] = []  # first, last, sum before, sum after
    total, before = 0.0, 0
    for i, s in zip(at.tolist(), score.tolist(), strict=True):
        total -= COST * (i - before)
        new = [i, i, total, total + s]
        total += s
        before = i + 1
        while True:
            j = next((j for j in range(len(stack) - 1, -1, -1) if stack[j][2] < new[2]), None)
            if j is None or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(a, b, r - left) for a, b, left, r in stack]


def p_value(scores: list[float], n: int, slope: float, k: float) -> float:
    """Of a document's segments, the best of the sum statistics of its r highest, each r at half the weight of the one before."""
    best, total, base = 1.0, 0.0, math.log(max(k * n, 1e-300))
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        total += slope * s - base
        if total <= r:
            break
        log_p = r * math.log(2) - total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)
        p = -math.expm1(-math.exp(min(log_p, 700))) if r == 1 else math.exp(min(log_p, 0))
        best = min(best, p)
    return best


def score_rows(buf: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[list[list[tuple[int, int, float]]], np.ndarray]:
    """Segments of each row as (first byte, end byte, score), and its tokens."""
    out, counts = [], []
    for a, b in textvec.chunks(offsets):
        o = offsets[a : b + 1] - offsets[a]
        h, starts, ends, bounds = tokens(buf[offsets[a] : offsets[b]], o)
        found = np.zeros(len(starts))
        for i in range(h.shape[1]):
            at, which = model.table.find(h[:, i])
            np.maximum.at(found, at, model.score[which])
        hot = np.flatnonzero(found > 0)
        cut = np.searchsorted(hot, bounds)
        counts.append(np.diff(bounds))
        for r in range(b - a):
            x, y = cut[r], cut[r + 1]
            out.append([(int(starts[p] - o[r]), int(ends[q] - o[r]), s) for p, q, s in segments(hot[x:y], found[hot[x:y]])] if y > x else [])
    return out, np.concatenate(counts) if counts else np.zeros(0, np.int64)


def fit(df: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, dominance: float = DOMINANCE) -> Model:
    """Token counts of a bounded sample of labelled documents, and of the candidates' background in all documents.

    Each text of a label counts once, and a token's toxic occurrences once for each different word before them, so that
    copies of a document or passage neither make its words toxic nor hide those that it shares with others.

    ``dominance`` is the most that one preceding word may have of a token's toxic occurrences.  The later words of a
    passage that toxic documents quote always follow the same word; without the bound they would count as toxic by
    themselves.  Its price is that the later word of a fixed insult counts only where it also occurs otherwise; 1 counts
    every word.
    """
    spark = df.sparkSession
    common.prepare(spark)
    chosen = labels.filter(F.col(f"`{label}`").isNotNull() & F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("d")).agg(F.max(f"`{label}`").cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64(F.col("d"), F.lit(7)), "d").limit(sample_rows)
    docs = df.select(F.col(f"`{id_col}`").alias("d"), F.col(f"`{text}`").cast("string").alias("t"))
    sample = docs.join(F.broadcast(chosen), "d").select("y", "t").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.minimum(batch.column(0).to_numpy(), 1)
            buf, offsets = textvec.column(batch.column(1))
            for a, b in textvec.chunks(offsets):
                h, _, _, bounds = tokens(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                size = np.diff(bounds)
                toxic = np.repeat(y[a:b], size) == 1
                row = np.repeat(np.arange(b - a), size)
                flat = h.ravel()
                real = flat != 0
                flat, t, row = flat[real], np.repeat(toxic, h.shape[1])[real], np.repeat(row, h.shape[1])[real]
                keys, inverse = np.unique(flat, return_inverse=True)
                n_t, n_c = np.bincount(inverse[t], minlength=len(keys)), np.bincount(inverse[~t], minlength=len(keys))
                pair = np.unique(inverse[t].astype(np.int64) * (b - a) + row[t]) // max(b - a, 1)
                docs_t = np.bincount(pair, minlength=len(keys))
                keys = np.append(keys, np.uint64(0))  # 0 carries the number of words
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.append(n_t, size[y[a:b] == 1].sum())), pa.array(np.append(n_c, size[y[a:b] != 1].sum())), pa.array(np.append(docs_t, (y[a:b] == 1).sum()))], names=["h", "t", "c", "k"])

    counted = sample.mapInArrow(count, "h bigint, t bigint, c bigint, k bigint").groupBy("h").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum("k").alias("k")).filter((F.col("h") == 0) | (F.col("k") >= LEAST_DOCUMENTS)).toPandas()
    totals = counted[counted["h"] == 0]
    n_t, n_c = (float(totals[x].sum()) for x in "tc")
    # a token more common in clean than in toxic text can't count
    counted = counted[(counted["h"] != 0) & (counted["t"] * max(n_c, 1) > 2 * counted["c"] * max(n_t, 1))].sort_values("h")
    keys = counted["h"].to_numpy(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(textvec.Table(keys))

    def background(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        n, words = np.zeros(len(table.keys), np.int64), 0
        for batch in batches:
            buf, offsets = textvec.column(batch.column(0))
            for a, b in textvec.chunks(offsets):
                h, *_ = tokens(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                words += len(h)
                for i in range(h.shape[1]):
                    n += np.bincount(table.find(h[:, i])[1], minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(n[some], words))], names=["i", "n"])

    back = docs.select("t").mapInArrow(background, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    total = float(back.loc[back["i"] < 0, "n"].sum())
    bg = np.zeros(len(keys))
    back = back[back["i"] >= 0]
    bg[back["i"].to_numpy(np.int64)] = back["n"].to_numpy()
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            buf, offsets = textvec.column(batch.column(0))
            for a, b in textvec.chunks(offsets):
                h, _, _, bounds = tokens(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                before = np.append(np.uint64(0), h[:-1, 0])[: len(h)]
                before[bounds[:-1][bounds[:-1] < len(h)]] = 0
                row = np.repeat(np.arange(b - a), np.diff(bounds))
                found = [table.find(h[:, i]) for i in range(h.shape[1])]
                pair = np.stack([np.concatenate([w for _, w in found]), np.concatenate([before[at] for at, _ in found]).view(np.int64), np.concatenate([row[at] for at, _ in found])], axis=1)
                pair, n = np.unique(np.unique(pair, axis=0)[:, :2], axis=0, return_counts=True)  # a text counts once
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(n)], names=["i", "before", "n"])

    near = sample.filter("y = 1").select("t").mapInArrow(contexts, "i bigint, before bigint, n bigint").groupBy("i", "before").agg(F.sum("n").alias("n")).groupBy("i").agg(F.count("*").alias("kinds"), F.max("n").alias("most"), F.sum("n").alias("n")).toPandas()
    t, most = np.zeros(len(keys)), np.ones(len(keys))
    at = near["i"].to_numpy(np.int64)
    t[at], most[at] = near["kinds"], near["most"] / near["n"]
    c = counted["c"].to_numpy(float)
    delta, z = log_odds(t, c, bg, n_t, n_c, max(total, 1))
    good = (z >= SIGNIFICANT) & (delta > COST) & (most <= dominance) if len(keys) else np.zeros(0, bool)
    score = delta[good] - COST
    p = (c[good] + 0.5) / (n_c + PRIOR)
    slope = karlin_slope(score, p) if good.any() else 1.0
    model = Model(textvec.Table(keys[good]), score, slope, 1.0)

    # calibration: how many segments above a level the sample's clean documents really have
    packed = spark.sparkContext.broadcast(model)
    level = 2 / slope

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = above = 0
        for batch in batches:
            found, size = score_rows(*textvec.column(batch.column(0)), packed.value)
            n += int(size.sum())
            above += sum(s >= level for r in found for _, _, s in r)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([above], pa.int64())], names=["n", "above"])

    n, above = sample.filter("y = 0").select("t").mapInArrow(clean, "n bigint, above bigint").agg(F.sum("n"), F.sum("above")).first()
    model.k = max((above or 0) + 0.5, 1e-9) / (max(n or 0, 1) * math.exp(-slope * level))
    return model


_PASSAGES = "array<struct<first_byte:bigint,end_byte:bigint,score:double>>"
_PASSAGE = pa.list_(pa.struct([("first_byte", pa.int64()), ("end_byte", pa.int64()), ("score", pa.float64())]))


def score_documents(df: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id", alpha: float = ALPHA) -> DataFrame:
    """(doc_id, p_value, passages, toxic): every passage whose own p-value is below alpha, and the document's.

    A null or empty text has p-value 1, no passage and isn't toxic.  Null ids and repeated rows give their own rows;
    other columns aren't read.
    """
    common.prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found, n = score_rows(*textvec.column(batch.column(1)), m)
            p = [p_value([s for *_, s in r], int(k), m.slope, m.k) if r else 1.0 for r, k in zip(found, n, strict=True)]
            rows = [[{"first_byte": a, "end_byte": b, "score": round(s, 6)} for a, b, s in r if p_value([s], int(k), m.slope, m.k) < alpha] for r, k in zip(found, n, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array(rows, _PASSAGE), pa.array([x < alpha for x in p], pa.bool_())], names=[id_col, "p_value", "passages", "toxic"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(f"`{id_col}`").alias("d"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, f"`{id_col}` {kind}, p_value double, passages {_PASSAGES}, toxic boolean")


def find_toxic(df: DataFrame, labels: DataFrame, alpha: float = ALPHA, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fit on labels and score all documents; see :func:`score_documents`.  With no labels, or of one kind only, nothing is toxic."""
    return score_documents(df, fit(df, labels, sample_rows=sample_rows), alpha=alpha)


def drop_toxic(df: DataFrame, labels: DataFrame, text: str = "text", alpha: float = ALPHA) -> DataFrame:
    """The rows of the input, with all their columns, whose text isn't toxic; null texts stay."""
    model = fit(df, labels, text=text)
    shared = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found, n = score_rows(*textvec.column(batch.column(place)), m)
            yield batch.filter(pa.array([not r or p_value([s for *_, s in r], int(k), m.slope, m.k) >= alpha for r, k in zip(found, n, strict=True)], pa.bool_()))

    return common.map_rows(df, run)

"""Ranked retrieval over tables: BM25, vectors, fusion, diversity, chunks, summary trees and manifolds."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph import session
from loomgraph.functions import values
from loomgraph.operators import graph


#: Decimal digits of a personalised rank that order it, so that the order of a sum's terms doesn't.
DIGITS = 12


def tokens(c):
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)


def terms(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The index of a corpus: (id, term, tf, length)."""
    t = df.select(F.col(id_col).alias("id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    t = t.select("id", F.size("w").alias("length"), F.explode("w").alias("term"))
    return t.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def bm25(df: DataFrame, query: str, k: int = 10, k1: float = 1.5, b: float = 0.75, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, score) of the k best documents, ties by id.

    Texts are read once: a document's words are counted in place and its length and few frequencies written, from which
    the corpus statistics, one aggregate, and the scores are taken.
    """
    words = list(dict.fromkeys(re.findall("[a-z0-9]+", query.lower())))
    if not words:
        return df.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    # regexp_count inlines nothing, unlike an array of tokens; a word's runs are counted whole
    low = df.select(F.col(f"`{id_col}`").alias("id"), F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("x"))
    counts = [F.regexp_count("x", F.lit(f"(?<![a-z0-9]){q}(?![a-z0-9])")).alias(f"tf{i}") for i, q in enumerate(words)]
    base = session.cut(low.select("id", F.regexp_count("x", F.lit("[a-z0-9]++")).alias("length"), *counts))
    stats = base.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    hit = base.filter(reduce(lambda x, y: x | y, [F.col(f"tf{i}") > 0 for i in range(len(words))])).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(words)):
        tf, d = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - d + 0.5) / (d + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return hit.select("id", score.alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def cosine_top_k(df: DataFrame, query: list[float], k: int = 10, vector: str = "embedding", id_col: str = "vec_id", where=None) -> DataFrame:
    """(id, score): exact, in one scan with a top-k of each partition before the merge."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = df if where is None else df.filter(where)
    return rows.select(F.col(id_col).alias("id"), values.cosine(F.col(vector), q).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


@F.pandas_udf(T.StringType())
def encode_vec(v: pd.Series) -> pd.Series:
    """A vector as base64 of its little-endian 32-bit floats; null stays null."""
    return v.map(lambda x: None if x is None else base64.b64encode(np.asarray(x, "<f4").tobytes()).decode())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vec(s: pd.Series) -> pd.Series:
    """The inverse of :func:`encode_vec`; bytes beyond the last whole float are dropped."""
    def one(x):
        raw = base64.b64decode(x)
        return np.frombuffer(raw[: len(raw) // 4 * 4], "<f4")

    return s.map(lambda x: None if x is None else one(x))


def vectorize(df: DataFrame, embed: Callable[[Column], Column], text: str = "text", id_col: str = "doc_id", size: int = 1500, overlap: int = 200) -> DataFrame:
    """(doc_id, chunk_index, text, embedding) of every chunk, embedded by a column expression, for instance a pandas UDF that calls a model."""
    return chunk_documents(df, size, overlap, text, id_col).withColumn("embedding", embed(F.col("text")))


def semantic_search(chunks: DataFrame, query: str, vector: list[float], k: int = 5, scope: str | None = None, least: float = 0.05) -> DataFrame:
    """(id, filename, text, score) of the k best chunks (id, filename, text, embedding), then those above ``least``; ties by id.

    The score is the cosine; where there is no vector, or it is 0, half the share of the query's words of more than two
    letters that the chunk has.  ``scope`` keeps the chunks whose file name contains it, unless none does.
    """
    if scope is not None:
        some = chunks.filter(F.contains(F.lower(F.coalesce("filename", F.lit(""))), F.lit(scope.lower())))
        chunks = some if some.limit(1).count() else chunks
    words = sorted({w for w in re.split(r"[^A-Za-z0-9_]+", query.lower()) if len(w) > 2})
    have = F.array_distinct(F.split(F.lower("text"), "[^A-Za-z0-9_]+"))
    lexical = F.size(F.array_intersect(have, F.array(*map(F.lit, words)))) / len(words) * 0.5 if words else F.lit(0.0)
    close = values.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector])) if vector else F.lit(0.0)
    close = F.coalesce(F.when(F.size("embedding") > 0, close), F.lit(0.0))
    scored = chunks.filter("text is not null and text <> ''").select("id", "filename", "text", F.when(close != 0, close).otherwise(lexical).alias("score"))
    return scored.orderBy(F.col("score").desc(), "id").limit(k).filter(F.col("score") > least)


def cosine_join(queries: DataFrame, df: DataFrame, k: int, vector: str = "embedding", id_col: str = "vec_id", batch: int = 2048, cell: int = 32768) -> DataFrame:
    """(query, id, score, place): the exact k nearest of every query, by blocks of a matrix product.

    Both sides are cut in blocks of ``cell`` rows at most, and each pair of blocks is a task: what a task reads doesn't grow
    with the tables, and what is shuffled is each row once for every block of the other side.  The task multiplies ``batch``
    rows at a time and gives k rows a query.  Ties go to the lower id; a row isn't its own neighbour.
    """
    spark = df.sparkSession
    session.ship(spark)
    wide = max(1, int(spark.sparkContext.defaultParallelism**0.5))
    nq, nd = (max(-(-n // cell), min(wide, -(-n // 4096)), 1) for n in (queries.count(), df.count()))
    kinds = [x.schema[id_col].dataType.simpleString() for x in (queries, df)]

    def side(x: DataFrame, query: bool) -> DataFrame:
        own = F.pmod(F.xxhash64(id_col), F.lit(nq if query else nd)).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.lit((nd if query else nq) - 1))).alias("o")
        rows = x.select(own.alias("b"), F.col(id_col).alias("i"), F.col(vector).cast("array<double>").alias("v"), other)
        at = F.col("b") * nd + F.col("o") if query else F.col("o") * nd + F.col("b")
        none = lambda c: F.lit(None).cast(c)
        return rows.select(at.alias("cell"), (F.col("i") if query else none(kinds[0])).alias("q"), (none(kinds[1]) if query else F.col("i")).alias("d"), F.lit(query).alias("query"), "v")

    def best(batches):
        held = {True: [], False: []}
        for b in batches:
            of = b.column(3).to_numpy(zero_copy_only=False)
            for query in (True, False):
                some = pa.array(np.flatnonzero(of == query))
                if len(some):
                    v = b.column(4).take(some)
                    m = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
                    held[query].append((b.column(1 if query else 2).take(some).to_numpy(zero_copy_only=False), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)))
        if not held[True] or not held[False]:
            return
        (qi, q), (di, d) = ([np.concatenate(x) for x in zip(*held[x], strict=True)] for x in (True, False))
        held.clear()
        for a in range(0, len(qi), batch):
            now = np.empty(0, int), np.empty(0, int), np.empty(0)
            for c in range(0, len(di), 2 * batch):
                ids = di[c : c + 2 * batch]
                s = q[a : a + batch] @ d[c : c + 2 * batch].T
                s[qi[a : a + batch, None] == ids[None, :]] = -np.inf
                # all ties with the k-th best stay, and the order decides
                line = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None] if s.shape[1] > k else -np.inf
                r, x = np.nonzero((s >= line) & np.isfinite(s))
                r, x, y = (np.concatenate(z) for z in zip(now, (r, x + c, s[r, x]), strict=True))
                order = np.lexsort((di[x], -y, r))
                r, x, y = r[order], x[order], y[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                now = r[keep], x[keep], y[keep]
            r, x, y = now
            yield pa.RecordBatch.from_arrays([pa.array(qi[a + r]), pa.array(di[x]), pa.array(y)], names=["query", "id", "score"])

    cells = side(queries, True).unionByName(side(df, False)).repartitionById(nq * nd, F.col("cell"))
    found = cells.mapInArrow(best, f"query {kinds[0]}, id {kinds[1]}, score double")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """(id, score) of ranked lists (id, place): the sum of 1 / (k + place), an id's first place in each list."""
    one = [x.groupBy("id").agg(F.min("place").alias("place")) for x in lists]
    return reduce(DataFrame.union, one).groupBy("id").agg(F.sum(1.0 / (k + F.col("place"))).alias("score"))


def placed(df: DataFrame, score: str = "score") -> DataFrame:
    """Places of a short ranked list (of top-k rows)."""
    return df.select("id", F.row_number().over(Window.orderBy(F.col(score).desc(), "id")).alias("place"))


def mmr(candidates: list[tuple[object, float, list[float]]], k: int, trade: float = 0.5) -> list[object]:
    """Greedy maximal marginal relevance over a short list of (id, relevance, vector), ties by id."""
    left = sorted(candidates, key=lambda c: str(c[0]))
    unit = {c[0]: np.asarray(c[2], float) / (np.linalg.norm(c[2]) or 1.0) for c in left}
    out: list[object] = []
    while left and len(out) < k:
        def worth(c):
            return trade * c[1] - (1 - trade) * max((float(unit[c[0]] @ unit[o]) for o in out), default=0.0)

        best = max(left, key=worth)
        out.append(best[0])
        left.remove(best)
    return out


def hybrid(legs: list[DataFrame], k: int = 10, vectors: DataFrame | None = None, trade: float = 0.5) -> DataFrame:
    """(id, score): legs (id, score), each its own top 3k, fused by rank; a graph leg is :func:`graph_leg`.

    With vectors (id, vector) the fused candidates are reranked for diversity and the i-th scores 1 / i.
    """
    fused = reciprocal_rank_fusion([placed(x.orderBy(F.col("score").desc(), "id").limit(3 * k)) for x in legs]).orderBy(F.col("score").desc(), "id")
    if vectors is None:
        return fused.limit(k)
    top = fused.limit(3 * k * len(legs)).join(vectors, "id", "left").orderBy(F.col("score").desc(), "id").collect()  # all candidates: legs of 3k rows
    chosen = mmr([(r["id"], 1.0 / (i + 1), r["vector"] or [0.0]) for i, r in enumerate(top)], k, trade)
    return fused.sparkSession.createDataFrame([(x, 1.0 / (i + 1), i + 1) for i, x in enumerate(chosen)], f"id {fused.schema['id'].dataType.simpleString()}, score double, place int")


def graph_leg(edges: DataFrame, seeds: list, rounds: int = 20) -> DataFrame:
    """(id, score) by personalised rank from the seeds, a leg of :func:`hybrid`."""
    kind = edges.schema["src"].dataType.simpleString()
    s = edges.sparkSession.createDataFrame([(x, 1.0) for x in seeds], f"id {kind}, weight double")
    return graph.pagerank(edges, rounds=rounds, tolerance=None, teleport=s).select("id", F.round("rank", DIGITS).alias("score"))


def ranked(df: DataFrame, *order) -> DataFrame:
    """(id, place) of a whole table: a range sort, whose partitions are numbered by the sizes of those before, so that no task holds all rows."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = session.cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", F.monotonically_increasing_id().alias("m")))
    part = F.shiftright("m", 33)
    sizes = sorted((r[0], r[1]) for r in rows.groupBy(part.alias("p")).count().collect())  # a row a partition
    base, total = {}, 0
    for p, n in sizes:
        base[p] = total
        total += n
    if not base:
        return rows.select("id", F.lit(0).cast("bigint").alias("place"))
    start = F.create_map(*[F.lit(x).cast("bigint") for kv in base.items() for x in kv])
    return rows.select("id", (F.try_element_at(start, part) + F.col("m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("place"))


def chunk_documents(df: DataFrame, size: int = 1500, overlap: int = 200, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, chunk_index, text): windows of ``size`` characters, each ``overlap`` after the last one's end; the last ends with the text."""
    step = size - overlap
    n = F.length(text)
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)).cast("int")
    t = df.filter(n > 0).select(F.col(id_col), F.col(text).alias("t_"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    return t.select(id_col, "chunk_index", F.substring("t_", F.col("chunk_index") * step + 1, F.lit(size)).alias("text"))


def raptor_tree(leaves: list[tuple[str, str, list[float]]], branching: int = 3, levels: int = 4, least: float = 0.0, summarise=None, embed=None) -> list[tuple[str, int, str, list[float], list[str]]]:
    """(id, level, text, vector, children): greedy clusters of the nearest ``branching`` by cosine, level by level.

    ``summarise`` and ``embed`` are callables; without them a cluster's text is its members' first sentences and its
    vector their mean.
    """
    out = [(i, 0, t, v, []) for i, t, v in sorted(leaves)]
    now = out[:]
    for level in range(1, levels + 1):
        if len(now) <= 1:
            break
        left, nxt = now[:], []
        while left:
            seed = left.pop(0)
            a = np.asarray(seed[3], float)

            def near(x, a=a):
                b = np.asarray(x[3], float)
                d = np.linalg.norm(a) * np.linalg.norm(b)
                return float(a @ b / d) if d else 0.0

            pick = [x for x in sorted(left, key=lambda x: (-near(x), x[0])) if near(x) >= least][: branching - 1]
            left = [x for x in left if x not in pick]
            group = [seed, *pick]
            texts = [x[2] for x in group]
            text = summarise(texts) if summarise else " ".join(t.split(".")[0] for t in texts)
            vector = embed(text) if embed else np.mean([x[3] for x in group], axis=0).tolist()
            nxt.append((f"L{level}:{len(nxt)}", level, text, vector, [x[0] for x in group]))
        if len(nxt) == len(now):
            break
        out += nxt
        now = nxt
    return out


def manifold(df: DataFrame, k: int = 8, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(src, dst, weight): edges to the k nearest, weighted by cosine distance, each pair once."""
    near = cosine_join(df, df, k, vector, id_col)
    e = near.select(F.least("query", "id").alias("src"), F.greatest("query", "id").alias("dst"), F.greatest(1 - F.col("score"), F.lit(1e-12)).alias("weight"))
    return e.groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def geodesic_nearest(edges: DataFrame, source, k: int = 10) -> DataFrame:
    """The k vertices nearest along the manifold."""
    return graph.sssp(edges, source).filter(F.col("id") != source).orderBy("distance", "id").limit(k)


def explore_from(edges: DataFrame, seeds: list, k: int = 10, rounds: int = 20) -> DataFrame:
    """(id, score) of the k best of all vertices with a personalised rank, without the seeds: their rank and their adjacency to the seeds, in either direction, fused over whole lists."""
    kind = edges.schema["src"].dataType.simpleString()
    ids = edges.sparkSession.createDataFrame([(x,) for x in seeds], f"id {kind}")
    edges = session.cut(edges.select("src", "dst"))
    rank = graph.reached_rank(edges, ids.withColumn("weight", F.lit(1.0)), rounds=rounds).select("id", F.round("rank", DIGITS).alias("score"))
    ppr = session.cut(rank.filter("score > 0").join(F.broadcast(ids), "id", "left_anti"))
    # the seeds' edges first, as only these have to be told apart
    ends = [edges.join(F.broadcast(ids.withColumnRenamed("id", x)), x).select(x, F.col(y).alias("id")).distinct().select("id") for x, y in (("src", "dst"), ("dst", "src"))]
    near = ends[0].unionByName(ends[1])
    adjacent = ppr.select("id").join(near.groupBy("id").agg(F.count("*").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("score"))
    lists = [ranked(x, F.col("score").desc(), F.col("id")) for x in (ppr, adjacent)]
    return reciprocal_rank_fusion(lists).orderBy(F.col("score").desc(), "id").limit(k)

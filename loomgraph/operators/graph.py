"""Iterative and local graph analytics over edge tables ``(src, dst[, weight])`` of any id type.

Iterations are joins and grouped sums on one hash partitioning; after each round the state is written to the shared
folder, so plans stay short and a lost executor repeats one round.  Sums are combined before the shuffle, as a message to a
vertex is a partial sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomgraph import session

#: Edges (16 bytes each) that a task of source-parallel algorithms may hold.
HELD_EDGES = 50_000_000


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def undirected(edges: DataFrame, *cols: str) -> DataFrame:
    """Both directions of each edge, without loops."""
    e = edges.filter("src <> dst")
    return e.select("src", "dst", *cols).unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *cols))


def neighbours(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) of the undirected simple graph."""
    return undirected(edges).distinct()


def degree(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, in_degree, out_degree), of all nodes; one pass and one shuffle of the edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    if nodes is not None:
        ends = ends.unionByName(nodes.select("id", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-9, teleport: DataFrame | None = None, warm: DataFrame | None = None) -> DataFrame:
    """(id, rank), summing to 1.  Parallel edges count; the mass of vertices without an out-edge goes to the teleport vector.

    ``teleport`` (id, weight) makes it personalised; without weight in the graph it is uniform.  ``warm`` (id, rank) starts
    from earlier ranks.  A round joins the state to the links and sums messages and the state itself by id in one
    aggregate; with the one row of the sinks' mass it has three exchanges at most.  The written state tells how far the
    ranks moved.  With ``tolerance`` None exactly ``rounds`` rounds run; with a ``teleport`` they run on what it reaches.
    """
    if teleport is not None and nodes is None and warm is None and tolerance is None:
        edges = session.cut(edges.select("src", "dst"))
        some = reached_rank(edges, teleport, damping, rounds)
        return vertices(edges).join(some, "id", "left").select("id", F.coalesce("rank", F.lit(0.0)).alias("rank"))
    ids = (nodes.select("id").distinct() if nodes is not None else vertices(edges))
    if nodes is not None:
        edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    links = session.cut(edges.groupBy("src", "dst").agg(F.count("*").alias("k")).join(out, "src").select("src", "dst", (F.col("k") / F.col("out")).alias("share")))
    base = ids.join(out.withColumnRenamed("src", "id"), "id", "left").select("id", F.col("out").isNull().alias("sink"))
    if teleport is not None:
        base = base.join(teleport.groupBy("id").agg(F.sum("weight").cast("double").alias("w")), "id", "left").fillna({"w": 0.0})
    else:
        base = base.withColumn("w", F.lit(1.0))
    base = session.cut(base)
    n, total = base.agg(F.count("*"), F.sum("w")).first()
    if not n:
        return base.select("id", F.lit(0.0).alias("rank"))
    base = base.select("id", "sink", ((F.col("w") / total) if total else F.lit(1.0 / n)).alias("t"))
    state = base.withColumn("rank", F.col("t"))
    if warm is not None:
        state = base.join(warm.select("id", F.col("rank").alias("r0")), "id", "left").select("id", "sink", "t", F.coalesce("r0", F.lit(1.0 / n)).alias("rank"))
        mass = state.agg(F.sum("rank")).first()[0]
        state = state.withColumn("rank", F.col("rank") / mass)
    state = state.withColumn("before", F.col("rank"))
    written = None
    for k in range(rounds):
        if k and tolerance is not None and state.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0] < tolerance:
            break
        lost = state.filter("sink").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        given = links.join(state.select(F.col("id").alias("src"), "rank"), "src").select(F.col("dst").alias("id"), (F.col("rank") * F.col("share")).alias("given"))
        own = state.select("id", F.lit(0.0).alias("given"), "sink", "t", "rank")
        both = given.select("id", "given", F.lit(None).cast("boolean").alias("sink"), F.lit(None).cast("double").alias("t"), F.lit(None).cast("double").alias("rank")).unionByName(own)
        new = both.groupBy("id").agg(F.sum("given").alias("given"), F.max("sink").alias("sink"), F.max("t").alias("t"), F.max("rank").alias("before")).crossJoin(F.broadcast(lost))
        state = session.cut(new.select("id", "sink", "t", ((1 - damping) * F.col("t") + damping * (F.col("given") + F.col("lost") * F.col("t"))).alias("rank"), "before"))
        if written is not None:
            session.discard(written)
        written = state
    return state.select("id", "rank")


def surroundings(edges: DataFrame, seeds: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """The edges (src, dst) on walks of at most ``hops`` steps from the seeds (id), parallel ones too, and the vertices (id) on them with the seeds in the graph.

    A vertex's edges are fetched once, when it is first met, and nothing is read after the last new one.
    """
    ids = session.cut(seeds.select("id").distinct())
    front = session.cut(edges.select(F.explode(F.array("src", "dst")).alias("id")).join(ids, "id").distinct())
    seen, near = front, [front.select(F.col("id").alias("src"), F.col("id").alias("dst")).limit(0)]
    for _ in range(hops):
        step = session.cut(edges.join(front.withColumnRenamed("id", "src"), "src").select("src", "dst"))
        near.append(step)
        front = session.cut(step.select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"))
        if front.limit(1).count() == 0:
            break
        seen = session.cut(seen.union(front))
    return session.cut(reduce(DataFrame.union, near)), seen


def reached_rank(edges: DataFrame, teleport: DataFrame, damping: float = 0.85, rounds: int = 100) -> DataFrame:
    """(id, rank) after ``rounds`` rounds of :func:`pagerank` with a teleport vector, without the vertices that no rank has come to.

    A vertex at k hops has rank from round k on, so the last ones' missing out-edges would be used after the end only.
    """
    near, ids = surroundings(edges, teleport, rounds)
    if not ids.join(teleport, "id").agg(F.sum("weight")).first()[0]:
        return pagerank(edges, damping=damping, rounds=rounds, tolerance=None)
    return pagerank(near, ids, damping, rounds, None, teleport)


def top_k(scores: DataFrame, k: int, value: str = "rank") -> DataFrame:
    return scores.orderBy(F.col(value).desc(), "id").limit(k)


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): the least id of each weakly connected component, by alternating large-star and small-star contraction.

    Each round is a grouped minimum and a join; stars at least halve the depth of the forest, so rounds are few even on
    chains, where label propagation would need one a hop.
    """
    edges = session.cut(edges.select("src", "dst"))
    now = session.cut(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        now = session.cut(small)
        new = tuple(now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if new == mark:
            break
        mark = new
    ids = vertices(edges) if nodes is None else nodes.select("id").union(vertices(edges)).distinct()
    return ids.join(now.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def bfs(edges: DataFrame, source, directed: bool = False, max_rounds: int = 10_000) -> DataFrame:
    """(id, hops) of the vertices that are reached; only the frontier is joined in a round."""
    step = session.cut(edges.select("src", "dst").distinct() if directed else neighbours(edges))
    kind = step.schema["src"].dataType
    front = step.sparkSession.createDataFrame([(source,)], "id " + kind.simpleString()).withColumn("hops", F.lit(0))
    seen = [front]
    for k in range(1, max_rounds):
        nxt = front.join(step, front["id"] == step["src"]).select(F.col("dst").alias("id")).distinct().join(reduce(DataFrame.union, seen), "id", "left_anti").withColumn("hops", F.lit(k))
        front = session.cut(nxt)
        if front.limit(1).count() == 0:
            return reduce(DataFrame.union, seen)
        seen.append(front)
        if len(seen) > 8:
            seen = [session.cut(reduce(DataFrame.union, seen))]
    raise RuntimeError(f"more than {max_rounds} hops")


def sssp(edges: DataFrame, source, weight: str = "weight", directed: bool = False, max_rounds: int = 10_000) -> DataFrame:
    """(id, distance) by rounds of relaxation from the vertices that improved; weights that aren't positive count as 1."""
    w = F.when(F.col(weight) > 0, F.col(weight).cast("double")).otherwise(F.lit(1.0))
    e = edges.select("src", "dst", w.alias("w"))
    step = session.cut((e if directed else undirected(e, "w")).groupBy("src", "dst").agg(F.min("w").alias("w")))
    best = step.sparkSession.createDataFrame([(source, 0.0)], f"id {step.schema['src'].dataType.simpleString()}, distance double").withColumn("fresh", F.lit(True))
    for _ in range(max_rounds):
        moves = best.filter("fresh").join(step, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("distance") + F.col("w")).alias("distance"), F.lit(True).alias("fresh"))
        both = best.select("id", "distance", F.lit(False).alias("fresh")).union(moves)
        # of equal distances the old one stays, so that it isn't fresh again
        best = session.cut(both.groupBy("id").agg(F.min(F.struct("distance", "fresh")).alias("m")).select("id", "m.distance", "m.fresh"))
        if best.filter("fresh").limit(1).count() == 0:
            return best.select("id", "distance")
    raise RuntimeError(f"more than {max_rounds} rounds")


def shortest_path(edges: DataFrame, source, target, directed: bool = True, max_rounds: int = 10_000) -> list | None:
    """The shortest path, of several the least in order of ids; None where there is none.

    Breadth-first from the source until the target is met; each vertex keeps its least path, of which there is one a vertex.
    """
    step = session.cut(edges.select("src", "dst").distinct() if directed else neighbours(edges))
    kind = step.schema["src"].dataType.simpleString()
    front = step.sparkSession.createDataFrame([(source, [source])], f"id {kind}, path array<{kind}>")
    seen = front.select("id")
    for _ in range(max_rounds):
        hit = front.filter(F.col("id") == target).select("path").first()
        if hit:
            return list(hit[0])
        nxt = front.join(step, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("v")).agg(F.min("path").alias("path"))
        front = session.cut(nxt.join(seen.withColumnRenamed("id", "v"), "v", "left_anti").select(F.col("v").alias("id"), F.concat("path", F.array("v")).alias("path")))
        if front.limit(1).count() == 0:
            return None
        seen = session.cut(seen.union(front.select("id")))
    raise RuntimeError(f"more than {max_rounds} hops")


def shortest_path_weighted(edges: DataFrame, source, target, weight: str = "weight", directed: bool = True) -> tuple[list, float] | None:
    """The cheapest path and its cost; a missing weight is 1, a negative one raises.  Ties go to the predecessor that is nearer, then of least id."""
    e = edges.select("src", "dst", F.coalesce(F.col(weight).cast("double"), F.lit(1.0)).alias("w"))
    if e.filter("w < 0").limit(1).count():
        raise ValueError("negative weight")
    e = e if directed else undirected(e, "w")
    tiny = e.withColumn("w", F.when(F.col("w") == 0, 1e-300).otherwise(F.col("w")))
    dist = session.cut(sssp(tiny, source, "w", directed=True))
    end = dist.filter(F.col("id") == target).first()
    if end is None:
        return None
    d = dist.withColumnsRenamed({"id": "src", "distance": "du"})
    tight = e.join(d, "src").join(dist.withColumnsRenamed({"id": "dst", "distance": "dv"}), "dst").filter("abs(du + w - dv) < 1e-9 and src <> dst")
    prev = session.cut(tight.groupBy("dst").agg(F.min(F.struct("du", "src")).alias("p")).select("dst", F.col("p.src").alias("src")))
    path = [target]
    while path[-1] != source:
        path.append(prev.filter(F.col("dst") == path[-1]).first()["src"])
        if len(path) != len(set(path)):
            raise RuntimeError("a circle of edges of weight 0")
    return path[::-1], end["distance"]


#: Edges that a task of a round of :func:`cdlp` joins.
ROUND_EDGES = 1_000_000


def cdlp(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, label): synchronous label propagation on the undirected multigraph; ties go to the least label.

    The most frequent label is a grouped count and a maximum of structs, both combined before the shuffle, not a window.
    Edges are joined in so many partitions that none holds more than :data:`ROUND_EDGES` on average; the planner, which goes by
    compressed bytes or takes a fixed number, lets a task's tables grow with the input.
    """
    edges = session.cut(edges.select("src", "dst"))
    e = session.cut(undirected(edges))
    parts = max(1, -(-e.count() // ROUND_EDGES))
    # a vertex's own label counts nothing, so it stays only where there is no neighbour
    alone = edges.filter("src = dst").select(F.col("src").alias("id")).distinct().join(e.select(F.col("src").alias("id")), "id", "left_anti").withColumn("label", F.col("id"))
    if rounds < 1:
        return vertices(edges).withColumn("label", F.col("id"))
    # at first a neighbour's label is its id
    given = e.select(F.col("dst").alias("id"), F.col("src").alias("label")).repartition(parts, "id", "label")
    state = None
    for _ in range(rounds):
        best = given.groupBy("id", "label").agg((-F.count("*")).alias("n")).groupBy("id").agg(F.min(F.struct("n", "label")).alias("b"))
        old, state = state, session.cut(best.select("id", "b.label"))
        if old is not None:
            session.discard(old)
        labels = state.select(F.col("id").alias("src"), "label").repartition(parts, "src")
        given = e.repartition(parts, "src").join(labels, "src").select(F.col("dst").alias("id"), "label")
    return state.unionByName(alone)


def _oriented(pairs: DataFrame) -> DataFrame:
    """Each edge once, from its end of lower (degree, id): no vertex has more than sqrt(2 m) out-edges, so a hub makes few wedges."""
    deg = pairs.groupBy("src").agg(F.count("*").alias("k"))
    e = pairs.filter("src < dst").join(deg.withColumnRenamed("k", "ks"), "src").join(deg.withColumnsRenamed({"src": "dst", "k": "kd"}), "dst")
    up = F.struct("ks", "src") < F.struct(F.col("kd").alias("ks"), F.col("dst").alias("src"))
    return e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"), F.greatest("ks", "kd").alias("kb"))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), each triangle of the undirected simple graph once."""
    return _triangles(session.cut(neighbours(edges)))


def _triangles(pairs: DataFrame) -> DataFrame:
    o = session.cut(_oriented(pairs).select("a", "b"))
    wedge = o.join(o.select("a", F.col("b").alias("c")), "a").filter("b <> c")
    return wedge.join(o.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"]).select("a", "b", "c")


def _numbered(pairs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The pairs by 64-bit numbers in the order of their ids, and (id, n) unless the ids are such numbers."""
    if pairs.schema["src"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return pairs.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")), None
    n = session.cut(pairs.select(F.col("src").alias("id")).distinct().orderBy("id").withColumn("n", F.monotonically_increasing_id()))
    e = pairs.join(n.select(F.col("id").alias("src"), F.col("n").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("n").alias("b")), "dst")
    return session.cut(e.select(F.col("a").alias("src"), F.col("b").alias("dst"))), n


def _blocks(ids: DataFrame, blocks: int) -> np.ndarray:
    """Upper bounds of ranges of the column ``id``, so many ranges of about equal rows at most."""
    if blocks < 2:
        return np.empty(0, np.int64)
    return np.unique(np.array(ids.approxQuantile("id", [k / blocks for k in range(1, blocks)], 0.2 / blocks), np.float64).astype(np.int64))


def _triangles_of(pairs: DataFrame) -> DataFrame:
    """(id, t): the number of triangles of each vertex that has any, of the directed pairs of an undirected simple graph with numbers as ids.

    No wedge is a row.  Vertices are cut in ranges of ids; a vertex's out-list (of :func:`_oriented`, in its order) is the
    edges that its range holds, and goes once to each other range that has one of its out-neighbours.  There its wedges
    are formed in arrays, :data:`WEDGES` at a time, and looked up in the range's edges.  Of m edges, at most m times the
    lesser of ranges and out-degree ids are shuffled.
    """
    spark = pairs.sparkSession
    session.ship(spark)
    lists = session.cut(_oriented(pairs).groupBy("a").agg(F.sort_array(F.collect_list(F.struct("kb", "b"))).alias("x")).select(F.col("a").alias("id"), F.col("x.b").alias("out")))
    m = lists.agg(F.coalesce(F.sum(F.size("out")), F.lit(0))).first()[0]
    bounds = _blocks(lists, max(spark.sparkContext.defaultParallelism, -(-m // BLOCK_EDGES)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0), batch.column(1)
            size = out.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(ids)), size)
            to = np.unique(row * (len(bounds) + 1) + np.searchsorted(bounds, out.flatten().to_numpy()))
            to = to[size[to // (len(bounds) + 1)] > 1]
            take = np.concatenate([np.arange(len(ids)), to // (len(bounds) + 1)])
            block = np.concatenate([np.searchsorted(bounds, ids.to_numpy()), to % (len(bounds) + 1)])
            guest = np.arange(len(take)) >= len(ids)
            for at in range(0, len(take), 2048):
                part = pa.array(take[at : at + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(block[at : at + 2048], pa.int32()), pa.array(guest[at : at + 2048]), ids.take(part), out.take(part)], names=["block", "guest", "id", "out"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        now, edges = None, None

        def rows(ids, t) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids[t > 0]), pa.array(t[t > 0], pa.int64())], names=["id", "t"])

        def close() -> Iterator[pa.RecordBatch]:
            if edges is not None and len(edges.keys):
                yield rows(edges.src, np.bincount(edges.keys // len(edges.dst), edges.hits, len(edges.src)).astype(np.int64))
                yield rows(edges.dst, np.bincount(edges.keys % len(edges.dst), edges.hits, len(edges.dst)).astype(np.int64))

        for batch in batches:
            block, guest = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for k in np.unique(block):
                if k != now:
                    yield from close()
                    now, edges, held = k, None, []
                for g in (False, True):
                    some = pa.array(np.flatnonzero((block == k) & (guest == g)))
                    if not len(some):
                        continue
                    ids, out = batch.column(2).take(some).to_numpy(), batch.column(3).take(some)
                    part = ids, out.value_lengths().to_numpy().astype(np.int64), out.flatten().to_numpy()
                    if not g:
                        held.append(part)
                        continue
                    if edges is None:
                        edges = _Edges(*(np.concatenate(x) for x in zip(*held, strict=True))) if held else _Edges(*(x[:0] for x in part))
                        held = []
                    yield rows(ids, edges.close(part[1], part[2]))
        yield from close()

    kinds = "block int, guest boolean, id bigint, out array<bigint>"
    sent = lists.mapInArrow(send, kinds).repartitionById(len(bounds) + 1, F.col("block")).sortWithinPartitions("block", "guest")
    return sent.mapInArrow(count, "id bigint, t bigint").groupBy("id").agg(F.sum("t").alias("t"))


#: Numbers (8 bytes) of the vectors of a range of vertices of :func:`fast_rp`.
BLOCK_NUMBERS = 16_000_000
#: Edges of a range of vertices, and wedges at a time, of :func:`_triangles_of`.
BLOCK_EDGES, WEDGES = 4_000_000, 4_000_000


class _Edges:
    """Out-lists in arrays, and how often each of their edges closed a wedge."""

    def __init__(self, ids: np.ndarray, size: np.ndarray, out: np.ndarray):
        self.src, self.dst = np.unique(ids), np.unique(out)
        self.keys = np.sort(np.searchsorted(self.src, np.repeat(ids, size)) * max(len(self.dst), 1) + np.searchsorted(self.dst, out))
        self.hits = np.zeros(len(self.keys), np.int64)
        self.bits = np.uint64(64 - max(10, int(len(self.keys) * 16).bit_length()))
        self.some = np.zeros(1 << (64 - int(self.bits)), bool)
        self.some[self._hash(self.keys)] = True

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits

    @staticmethod
    def _find(table: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Places in a sorted table, -1 where x isn't there."""
        if not len(table):
            return np.full(len(x), -1)
        at = np.minimum(np.searchsorted(table, x), len(table) - 1)
        return np.where(table[at] == x, at, -1)

    def close(self, size: np.ndarray, out: np.ndarray) -> np.ndarray:
        """For each list the number of its ordered pairs that are edges."""
        b, c = self._find(self.src, out), self._find(self.dst, out)
        row = np.repeat(np.arange(len(size)), size)
        # of a list, what is no end of an edge here can't close a wedge
        on = (b >= 0) | (c >= 0)
        b, c, row = b[on], c[on], row[on]
        end = np.cumsum(np.bincount(row, minlength=len(size)))
        first = np.flatnonzero(b >= 0)
        most = end[row[first]] - 1 - first
        total = np.zeros(len(size), np.int64)
        cuts = np.searchsorted(np.cumsum(most), np.arange(WEDGES, int(most.sum()) + WEDGES, WEDGES), side="right") if len(first) else []
        at = 0
        for stop in [*cuts, len(first)]:
            stop = max(int(stop), at + 1)
            f, n = first[at:stop], most[at:stop]
            at = stop
            if not len(f):
                continue
            u = np.repeat(f, n)
            v = u + 1 + np.arange(len(u)) - np.repeat(np.cumsum(n) - n, n)
            key = b[u] * len(self.dst) + c[v]
            hit = (c[v] >= 0) & self.some[self._hash(key)]
            u, key = u[hit], key[hit]
            place = self._find(self.keys, key)
            u, place = u[place >= 0], place[place >= 0]
            np.add.at(self.hits, place, 1)
            total += np.bincount(row[u], minlength=len(size))
            if at >= len(first):
                break
        return total


def triangle_count(edges: DataFrame) -> DataFrame:
    """One row (triangles) of the undirected simple graph, without forming them."""
    pairs, _ = _numbered(session.cut(neighbours(edges)))
    return _triangles_of(pairs).agg(F.expr("coalesce(sum(t), 0) div 3").alias("triangles"))


def lcc(edges: DataFrame) -> DataFrame:
    """(id, lcc): the share of a vertex's pairs of neighbours that are joined; 0 below two neighbours."""
    edges = session.cut(edges.select("src", "dst"))
    pairs = session.cut(neighbours(edges))
    deg = pairs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k"))
    numbers, names = _numbered(pairs)
    hits = _triangles_of(numbers)
    if names is not None:
        hits = hits.withColumnRenamed("id", "n").join(names, "n").select("id", "t")
    k = F.col("k")
    return vertices(edges).join(deg, "id", "left").join(hits, "id", "left").select("id", F.when(k >= 2, 2.0 * F.coalesce("t", F.lit(0)) / (k * (k - 1))).otherwise(0.0).alias("lcc"))


def twins(pairs: DataFrame) -> DataFrame:
    """(id, class, n, k, core) of the directed pairs of :func:`neighbours`: vertices of the same degree k and the same neighbours of
    more than one neighbour are a class, named by its least id, of n members.

    A neighbour of degree one is no pair's common neighbour, so members of a class have the same link scores with anything.
    """
    deg = session.cut(pairs.groupBy("src").agg(F.count("*").alias("k")))
    inner = pairs.join(deg.filter("k > 1").select(F.col("src").alias("dst")), "dst", "left_semi")
    core = inner.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("core"))
    kind = pairs.schema["dst"].dataType.simpleString()
    v = session.cut(deg.join(core, "src", "left").select(F.col("src").alias("id"), "k", F.coalesce("core", F.expr(f"cast(array() as array<{kind}>)")).alias("core")))
    g = v.groupBy("k", "core").agg(F.min("id").alias("class"), F.count("*").alias("n"))
    return v.join(g, ["k", "core"]).select("id", "class", "n", "k", "core")


def link_classes(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, pairs, scores as of :func:`link_scores`) of the pairs a <= b of classes of :func:`twins`, and the members (id, class).

    ``pairs`` counts the vertex pairs that a row stands for; a = b are the pairs within a class.  A hub of d neighbours makes
    pairs of its classes, not d squared of them.
    """
    pairs = session.cut(neighbours(edges))
    t = session.cut(twins(pairs))
    r = session.cut(t.filter("id = class").select("class", "n", "k", F.explode("core").alias("m")))
    deg = t.select(F.col("id").alias("m"), F.col("k").alias("km"))
    left, right = (r.select("m", F.col("class").alias(x), F.col("n").alias("n" + x), F.col("k").alias("k" + x)) for x in "ab")
    w = left.join(right, "m").filter("a < b or (a = b and na > 1)").join(deg, "m")
    km = F.col("km").cast("double")
    one = w.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.first("ka").alias("ka"), F.first("kb").alias("kb"), F.count("*").alias("c"), F.sum(1 / F.log(km)).alias("adamic_adar"), F.sum(1.0 / km).alias("resource_allocation"))
    n = F.when(F.col("a") == F.col("b"), F.expr("na * (na - 1) div 2")).otherwise(F.col("na") * F.col("nb"))
    c = F.col("c")
    out = one.select("a", "b", n.alias("pairs"), c.alias("common_neighbours"), (c / (F.col("ka") + F.col("kb") - c)).alias("jaccard"), "adamic_adar", "resource_allocation", (F.col("ka") * F.col("kb")).alias("preferential_attachment"))
    return out, t.select("id", "class")


def attachment_classes(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, pairs, preferential_attachment) of all pairs of vertices, with a common neighbour or not, by classes of equal degree; and the members (id, class)."""
    deg = session.cut(neighbours(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k")))
    g = session.cut(deg.groupBy("k").agg(F.min("id").alias("class"), F.count("*").alias("n")))
    a, b = (g.select(F.col("class").alias(x), F.col("n").alias("n" + x), F.col("k").alias("k" + x)) for x in "ab")
    n = F.when(F.col("a") == F.col("b"), F.expr("na * (na - 1) div 2")).otherwise(F.col("na") * F.col("nb"))
    both = a.crossJoin(b).filter("a < b or (a = b and na > 1)")
    return both.select("a", "b", n.alias("pairs"), (F.col("ka") * F.col("kb")).alias("preferential_attachment")), deg.join(g, "k").select("id", "class")


def link_table(edges: DataFrame, metric: str) -> DataFrame:
    """(kind, a, b, pairs, metric): a row of kind 'pair' for each pair of classes, and one of kind 'member' for each vertex a and its class b."""
    pairs, members = attachment_classes(edges) if metric == "preferential_attachment" else link_classes(edges)
    value = pairs.schema[metric].dataType.simpleString()
    one = members.select(F.lit("member").alias("kind"), F.col("id").alias("a"), F.col("class").alias("b"), F.lit(None).cast("bigint").alias("pairs"), F.lit(None).cast(value).alias(metric))
    return pairs.select(F.lit("pair").alias("kind"), "a", "b", "pairs", metric).unionByName(one)


def link_scores(edges: DataFrame, node=None) -> DataFrame:
    """(a, b, common_neighbours, jaccard, adamic_adar, resource_allocation, preferential_attachment) of pairs a < b with a common neighbour.

    With ``node``, the pairs of that node only, as (node, other).  The pairs of :func:`link_classes` with each class spelt out,
    so its rows grow with the square of a hub's degree; for large graphs take the classes.
    """
    pairs, members = link_classes(edges)
    if node is not None:
        own = members.filter(F.col("id") == node).select("class")
        rest = pairs.columns[2:]
        flip = pairs.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), *rest).unionByName(pairs).join(own.withColumnRenamed("class", "a"), "a", "left_semi")
        out = flip.withColumnRenamed("b", "cb").join(members.select(F.col("class").alias("cb"), F.col("id").alias("b")), "cb").filter(F.col("b") != node).withColumn("a", F.lit(node))
    else:
        ends = pairs.withColumnsRenamed({"a": "ca", "b": "cb"}).join(members.select(F.col("class").alias("ca"), F.col("id").alias("x")), "ca").join(members.select(F.col("class").alias("cb"), F.col("id").alias("y")), "cb")
        out = ends.filter("ca <> cb or x < y").withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")})
    return out.select("a", "b", "common_neighbours", "jaccard", "adamic_adar", "resource_allocation", "preferential_attachment")


def predict_links(edges: DataFrame, node, k: int = 10, metric: str = "adamic_adar") -> DataFrame:
    """The k best-scored vertices that aren't neighbours of the node."""
    n = session.cut(neighbours(edges))
    own = n.filter(F.col("src") == node).select(F.col("dst").alias("b"))
    if metric == "preferential_attachment":  # needs no common neighbour
        deg = n.groupBy(F.col("src").alias("b")).agg(F.count("*").alias("k"))
        scores = deg.filter(F.col("b") != node).crossJoin(F.broadcast(own.agg(F.count("*").alias("d")))).select("b", (F.col("k") * F.col("d")).alias(metric))
    else:
        scores = link_scores(edges, node)
    return scores.join(own, "b", "left_anti").filter(F.col(metric) > 0).select(F.col("b").alias("id"), F.col(metric).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def _rows_of(s: np.ndarray, d: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, at = np.unique(np.concatenate([s, d]), return_inverse=True)
    s, d = at[: len(s)], at[len(s) :]
    if both:
        s, d = np.concatenate([s, d]), np.concatenate([d, s])
    order = np.lexsort((d, s))
    return ids, np.searchsorted(s[order], np.arange(len(ids) + 1)), d[order]


#: Numbers of an array of a task of :func:`betweenness`, and the most sources that it takes at a time.
HELD_NUMBERS, COLUMNS = 4_000_000, 16
#: Edges times sources below which a task of :func:`betweenness` isn't split.
TASK_WORK = 1_000_000_000


class _Rows:
    """Adjacency in arrays, whose product with a matrix is formed in tiles of rows of like length."""

    def __init__(self, s: np.ndarray, d: np.ndarray, n: int):
        order = np.lexsort((d, s))
        self.n, self.to = n, d[order].astype(np.int32)
        self.start = np.searchsorted(s[order], np.arange(n + 1))
        self.size = np.diff(self.start)
        self.tiles: list[tuple[np.ndarray, np.ndarray]] = []

    def expand(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lengths of the rows v, and their entries one after the other."""
        size = self.size[v]
        return size, self.to[np.repeat(self.start[v] - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    def _cut(self) -> None:
        rows = np.argsort(-self.size, kind="stable")
        rows = rows[self.size[rows] > 0]
        long = -self.size[rows]
        at = 0
        while at < len(rows):
            most = -long[at]
            # shorter rows are filled up with the place n, twice their length at most
            end = min(at + max(1, min(64, 65_536 // most)), int(np.searchsorted(long, -((most + 1) // 2), side="right")))
            r, k = rows[at:end], np.arange(most)[:, None]
            self.tiles.append((r, np.where(k < self.size[r], self.to[np.minimum(self.start[r] + k, len(self.to) - 1)], np.int32(self.n))))
            at = end

    def times(self, x: np.ndarray) -> np.ndarray:
        """For each row the sum of the rows of x, of n + 1 rows with zeros in the last, that it names."""
        if not self.tiles:
            self._cut()
        out = np.zeros((self.n, x.shape[1]), x.dtype)
        # of a tile of many rows, or a part of one row
        held = np.empty((65_536, x.shape[1]), x.dtype)
        for r, names in self.tiles:
            for k in range(0, len(names), 65_536):
                some = names[k : k + 65_536]
                part = np.take(x, some.ravel(), axis=0, mode="clip", out=held[: some.size])
                out[r] += part.reshape(len(some), -1).sum(axis=0).reshape(len(r), -1)
        return out


def _brandes(out: _Rows, into: _Rows, of: np.ndarray, turn: int, turns: int) -> np.ndarray:
    """For each vertex the sum of its dependencies on the sources of a turn; ``of`` names the component of a vertex.

    A column of the arrays is a source of every component at once, as their paths don't meet; entries (vertex, column) are
    flat places.  Levels with few edges are walked edge by edge, others are a product with the whole graph.
    """
    n = out.n
    size = np.bincount(of)
    order = np.argsort(of, kind="stable")
    seat = np.empty(n, np.int64)
    seat[order] = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
    total, most = np.zeros(n), size[of]
    wide = int(max(1, min(COLUMNS, HELD_NUMBERS // n)))
    mine = np.arange(turn, size.max(), turns)
    by_seat = np.argsort(seat, kind="stable")
    sorted_seats = seat[by_seat]
    for first in range(0, len(mine), wide):
        cols = mine[first : first + wide]
        b = len(cols)
        dense = len(out.to) * b // 5
        # -1 not reached yet, -2 in a component without a source in this column
        dist = np.where(most[:, None] > cols, np.int32(-1), np.int32(-2)).ravel()
        lo, hi = np.searchsorted(sorted_seats, cols), np.searchsorted(sorted_seats, cols, side="right")
        front = np.concatenate([by_seat[x:y] * b + j for j, (x, y) in enumerate(zip(lo, hi, strict=True))])
        sigma, delta = np.zeros(n * b), np.zeros(n * b)
        left = int(np.count_nonzero(dist == -1)) - len(front)
        dist[front], sigma[front] = 0, 1
        levels = [front]
        while left and len(front):
            level = len(levels)
            if out.size[front // b].sum() > dense:
                # whole numbers below 2**24 are exact in 32 bits
                for kind in (np.float32, np.float64):
                    x = np.zeros((n + 1) * b, kind)
                    x[front] = sigma[front]
                    new = into.times(x.reshape(n + 1, b)).ravel()
                    if kind is np.float64 or max(new.max(), x.max()) < 2**24:
                        break
                front = np.flatnonzero((dist == -1) & (new > 0))
                sigma[front] = new[front]
            else:
                each, v = out.expand(front // b)
                v = v * np.int64(b) + np.repeat(front % b, each)
                on = dist[v] == -1
                v = v[on]
                np.add.at(sigma, v, np.repeat(sigma[front], each)[on])
                if len(v) * 8 > len(dist):
                    dist[v] = level
                    front = np.flatnonzero(dist == level)
                else:
                    front = np.unique(v)
            dist[front] = level
            left -= len(front)
            if len(front):
                levels.append(front)
        share = np.zeros((n + 1) * b)
        for level in range(len(levels) - 1, 1, -1):
            far, near = levels[level], levels[level - 1]
            if out.size[near // b].sum() > dense:
                share[:] = 0
                share[far] = (1 + delta[far]) / sigma[far]
                delta[near] = sigma[near] * out.times(share.reshape(n + 1, b)).ravel()[near]
            else:
                share[far] = (1 + delta[far]) / sigma[far]
                near = near[out.size[near // b] > 0]
                if len(near):
                    each, v = out.expand(near // b)
                    v = v * np.int64(b) + np.repeat(near % b, each)
                    on = np.flatnonzero(dist[v] == level)
                    given = np.zeros(len(v))
                    given[on] = share[v[on]]
                    delta[near] = sigma[near] * np.add.reduceat(given, np.cumsum(each) - each)
        total += delta.reshape(n, b).sum(axis=1)
    return total


def betweenness(edges: DataFrame, directed: bool = True) -> DataFrame:
    """(id, betweenness), unnormalised; halved if undirected.  Parallel edges count as paths.

    Exact from all sources.  A task holds the edges of some connected components of like size, or of one, and takes all or a
    share of their sources, :data:`COLUMNS` a component at a time; a component may have :data:`HELD_EDGES`.
    """
    spark = edges.sparkSession
    session.ship(spark)
    e = edges.filter("src <> dst").select("src", "dst")
    e = session.cut(e if directed else e.distinct())
    part = session.cut(connected_components(e))
    held = session.cut(e.join(part.withColumnRenamed("id", "src"), "src").select("component", "src", "dst"))
    sizes = session.cut(held.groupBy("component").agg(F.count("*").alias("m")).join(part.groupBy("component").agg(F.count("*").alias("n")), "component"))
    total, largest = sizes.agg(F.sum("m"), F.max("m")).first()
    kind = edges.schema["src"].dataType.simpleString()
    if not total:
        return part.select("id", F.lit(0.0).alias("betweenness"))
    if largest > HELD_EDGES:
        raise ValueError(f"{largest} edges of a component are more than a task may hold ({HELD_EDGES})")
    # a large component is alone, small ones of like size are together
    h = F.xxhash64("component")
    sizes = sizes.withColumn("bin", F.when(F.col("m") >= BLOCK_EDGES // 16, h).otherwise(F.floor(F.log2("n")) * 2**32 + F.pmod(h, F.lit(-(-total // BLOCK_EDGES)))))
    bins = sizes.groupBy("bin").agg(F.sum("m").alias("m"), F.max("n").alias("n")).collect()  # some a BLOCK_EDGES edges
    unit = max(TASK_WORK, sum(r["m"] * r["n"] for r in bins) // (spark.sparkContext.defaultParallelism * 4))
    turns: list[tuple[int, int]] = []
    place = []
    for r in sorted(bins, key=lambda r: -r["m"] * r["n"]):
        k = min(r["n"], -(-r["m"] * r["n"] // unit))
        place.append((r["bin"], len(turns), len(turns) + k - 1))
        turns += [(x, k) for x in range(k)]
    at = sizes.join(F.broadcast(spark.createDataFrame(place, "bin bigint, first int, last int")), "bin").select("component", F.explode(F.sequence("first", "last")).alias("task"))
    sent = held.join(at, "component").select("task", "component", "src", "dst").repartitionById(len(turns), F.col("task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = [b for b in batches if b.num_rows]
        if not t:
            return
        task = t[0].column(0)[0].as_py()
        c, s, d = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in t]) for k in (1, 2, 3))
        t.clear()
        ids, where = np.unique(np.concatenate([s, d]), return_inverse=True)
        s, d = where[: len(s)], where[len(s) :]
        of = np.zeros(len(ids), np.int64)
        of[s] = of[d] = np.unique(c, return_inverse=True)[1]
        if directed:
            out, into = _Rows(s, d, len(ids)), _Rows(d, s, len(ids))
        else:
            out = into = _Rows(np.concatenate([s, d]), np.concatenate([d, s]), len(ids))
        sums = _brandes(out, into, of, *turns[task])
        # the first turn gives every vertex
        some = np.flatnonzero((sums > 0) | (turns[task][0] == 0))
        for k in range(0, len(some), 65_536):
            i = some[k : k + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(ids[i].tolist(), schema), pa.array(sums[i])], names=["id", "c"])

    schema = to_arrow_type(edges.schema["src"].dataType)
    sums = sent.mapInArrow(run, f"id {kind}, c double").groupBy("id").agg(F.sum("c").alias("c"))
    return sums.select("id", (F.col("c") / (1 if directed else 2)).alias("betweenness"))


def louvain(edges: DataFrame, passes: int = 20, aggregate: bool = True) -> DataFrame:
    """(id, community), named by the least id of each.  Nodes are visited by ascending id, ties go to the lowest community.

    The order of visits is part of the definition.  Moves in one connected component depend on no other, but for the total
    weight, so each component is worked through in a task of its own with the same results; one may have
    :data:`HELD_EDGES`.  Parallel edges weigh, loops don't.  ``aggregate`` repeats on the graph of communities.
    """
    session.ship(edges.sparkSession)
    e = session.cut(edges.filter("src <> dst").select("src", "dst"))
    part = session.cut(connected_components(e))
    held = session.cut(e.join(part.withColumnRenamed("id", "src"), "src").select("component", "src", "dst"))
    total, most = 0, 0
    sizes = held.groupBy("component").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    if sizes[0]:
        total, most = 2.0 * sizes[0], sizes[1]
    if most > HELD_EDGES:
        raise ValueError(f"{most} edges of a component are more than a task may hold ({HELD_EDGES})")

    def run(t: pa.Table) -> pa.Table:
        s, d = (t[c].to_numpy() for c in ("src", "dst"))
        ids, start, to = _rows_of(s, d, True)
        least = _louvain(start, to, total, passes, aggregate)
        return pa.table({"id": pa.array(ids.tolist(), t.schema.field("src").type), "community": pa.array(ids[least].tolist(), t.schema.field("src").type)})

    kind = edges.schema["src"].dataType.simpleString()
    return held.groupBy("component").applyInArrow(run, f"id {kind}, community {kind}")


def _louvain(start: np.ndarray, to: np.ndarray, total: float, passes: int, aggregate: bool) -> np.ndarray:
    """For each vertex the least one of its community."""
    n = len(start) - 1
    rows: list[dict[int, float]] = []
    for i in range(n):
        near, w = np.unique(to[start[i] : start[i + 1]], return_counts=True)
        rows.append(dict(zip(near.tolist(), w.astype(float).tolist(), strict=True)))
    loops = [0.0] * n
    member = np.arange(n)
    while True:
        k = [sum(r.values()) + loops[i] for i, r in enumerate(rows)]
        com, mass = list(range(len(rows))), k[:]
        moved_ever = False
        for _ in range(passes):
            moved = False
            for i, r in enumerate(rows):
                own = com[i]
                mass[own] -= k[i]
                weight: dict[int, float] = {own: 0.0}
                for j, w in r.items():
                    weight[com[j]] = weight.get(com[j], 0.0) + w
                best, gain = own, weight[own] - mass[own] * k[i] / total if total else 0.0
                for c in sorted(weight):
                    g = weight[c] - mass[c] * k[i] / total if total else 0.0
                    if g > gain + 1e-12:
                        best, gain = c, g
                mass[best] += k[i]
                if best != own:
                    com[i], moved, moved_ever = best, True, True
            if not moved:
                break
        names = {c: x for x, c in enumerate(sorted(set(com)))}
        com = [names[c] for c in com]
        member = np.array(com)[member] if n else member
        if not aggregate or not moved_ever:
            break
        grown: list[dict[int, float]] = [{} for _ in names]
        inner = [0.0] * len(names)
        for i, r in enumerate(rows):
            inner[com[i]] += loops[i]
            for j, w in r.items():
                if com[i] == com[j]:
                    inner[com[i]] += w
                else:
                    grown[com[i]][com[j]] = grown[com[i]].get(com[j], 0.0) + w
        rows, loops = grown, inner
    least: dict[int, int] = {}
    for i, c in enumerate(member.tolist()):
        least.setdefault(c, i)
    return np.array([least[c] for c in member.tolist()], int)


def community_summaries(members: DataFrame, edges: DataFrame, summarise=None) -> DataFrame:
    """(community, members, internal_edges, summary): sorted members and edges within; ``summarise`` maps a column of members to one of text."""
    a = members.select(F.col("id").alias("src"), F.col("community").alias("community"))
    b = members.select(F.col("id").alias("dst"), F.col("community").alias("other"))
    inner = edges.join(a, "src").join(b, "dst").filter("community = other").groupBy("community").agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("internal_edges"))
    out = members.groupBy("community").agg(F.array_sort(F.collect_list("id")).alias("members")).join(inner, "community", "left")
    text: Column = summarise(F.col("members")) if summarise else F.concat_ws(", ", F.transform("members", lambda x: x.cast("string")))
    return out.withColumn("summary", text)


def fast_rp(edges: DataFrame, dim: int = 128, weights: tuple[float, ...] = (0.0, 1.0, 1.0, 1.0), seed: int = 42) -> DataFrame:
    """(id, embedding): sparse random projection, averaged over neighbours hop by hop, each hop normalised and weighted.

    Entries are +-sqrt(3) with probability 1/6 each, drawn from a hash of (seed, id, place): no state to share, so every
    partition draws its own.  Vertices are cut in ranges of ids; in a hop a vector goes once to each range that has a
    neighbour of its vertex, not once an edge, and is added up there in arrays.
    """
    spark = edges.sparkSession
    session.ship(spark)
    edges = session.cut(edges.select("src", "dst"))
    ids = vertices(edges)

    def draw(i: Column) -> Column:
        h = F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(6))
        return F.when(h == 0, F.lit(3**0.5)).when(h == 1, F.lit(-(3**0.5))).otherwise(F.lit(0.0))

    base = session.cut(ids.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), draw).alias("v")))
    pairs, names = _numbered(session.cut(undirected(edges)))
    if names is None:
        hop = base.select(F.col("id").cast("bigint").alias("id"), "v")
    else:
        hop = base.join(names, "id").select(F.col("n").alias("id"), "v")
    lists = session.cut(pairs.groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("to")))
    n = lists.count()
    bounds = _blocks(lists, max(spark.sparkContext.defaultParallelism, -(-n * dim // BLOCK_NUMBERS)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                out, v = batch.column(1), batch.column(2)
                to = out.flatten().to_numpy()
                row = np.repeat(np.arange(len(out)), out.value_lengths().to_numpy())
                block = np.searchsorted(bounds, to)
                order = np.lexsort((block, row))
                row, block, to = row[order], block[order], to[order]
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])]) if len(row) else row
                ends = pa.array(np.r_[first, len(row)], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(block[first], pa.int32()), pa.ListArray.from_arrays(ends, pa.array(to)), v.take(pa.array(row[first]))], names=["block", "to", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition is one block, whose vertices get their places as they come
        known, total, count = np.empty(0, np.int64), np.empty((0, dim)), np.empty(0, np.int64)
        for batch in batches:
            out = batch.column(1)
            to, size = out.flatten().to_numpy(), out.value_lengths().to_numpy()
            new = np.setdiff1d(to, known)
            if len(new):
                # vertices of a sorted merge keep their sums
                at = np.searchsorted(known, new)
                known, total, count = np.insert(known, at, new), np.insert(total, at, 0.0, axis=0), np.insert(count, at, 0)
            v = batch.column(2).flatten().to_numpy().reshape(len(out), dim)
            place, row = np.searchsorted(known, to), np.repeat(np.arange(len(out)), size)
            order = np.argsort(place, kind="stable")
            for a in range(0, len(order), 65_536):
                o = order[a : a + 65_536]
                p = place[o]
                start = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
                total[p[start]] += np.add.reduceat(v[row[o]], start, axis=0)
            count += np.bincount(place, minlength=len(known))
        for a in range(0, len(known), 4096):
            m = total[a : a + 4096] / count[a : a + 4096, None]
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            m = np.where(norm > 0, m / np.where(norm > 0, norm, 1), m)
            yield pa.RecordBatch.from_arrays([pa.array(known[a : a + 4096]), pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * dim, pa.int32()), pa.array(m.ravel()))], names=["id", "v"])

    out = hop.select("id", F.transform("v", lambda x: x * weights[0]).alias("sum"))
    for w in weights[1:]:
        sent = lists.join(hop, "id").select("id", "to", "v").mapInArrow(send, "block int, to array<bigint>, v array<double>")
        hop = session.cut(sent.repartitionById(len(bounds) + 1, F.col("block")).select("block", "to", "v").mapInArrow(add, "id bigint, v array<double>"))
        out = out.join(hop, "id", "left").select("id", F.when(F.col("v").isNotNull(), F.zip_with("sum", "v", lambda s, x: s + w * x)).otherwise(F.col("sum")).alias("sum"))
    if names is not None:
        out = out.withColumnRenamed("id", "n").join(names, "n").select("id", "sum")
        # vertices with loops only have no number
        alone = base.join(names, "id", "left_anti").select("id", F.transform("v", lambda x: x * weights[0]).alias("sum"))
        out = out.unionByName(alone)
    return out.select(F.col("id").cast(edges.schema["src"].dataType).alias("id"), F.col("sum").alias("embedding"))


def edge_cut(edges: DataFrame, part: DataFrame) -> DataFrame:
    """One row (cut, total, share): edges whose ends lie in different parts of ``part`` (id, part)."""
    a, b = part.select(F.col("id").alias("src"), F.col("part").alias("pa")), part.select(F.col("id").alias("dst"), F.col("part").alias("pb"))
    return edges.join(a, "src").join(b, "dst").agg(F.count_if(F.col("pa") != F.col("pb")).alias("cut"), F.count("*").alias("total"), F.avg((F.col("pa") != F.col("pb")).cast("double")).alias("share"))


def balance(part: DataFrame, parts: int) -> DataFrame:
    """One row (balance): the largest part against the mean."""
    sizes = part.groupBy("part").count()
    return sizes.agg((F.max("count") * parts / F.sum("count")).alias("balance"))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rmat(spark, scale: int, edge_factor: int = 16, seed: int = 1) -> DataFrame:
    """(src, dst) of a recursive-matrix graph (.57, .19, .19, .05): each edge's draws are hashes of its number, so partitions are independent."""
    session.ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.column(0).to_numpy().astype(np.uint64)
            s, d = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
            for level in range(scale):
                u = (_mix(i * np.uint64(scale) + np.uint64(level + 1 + seed * 0x9E3779B97F4A7C15 % 2**62)) >> np.uint64(11)).astype(np.float64) / 2**53
                s = 2 * s + (u >= 0.76)
                d = 2 * d + (((u >= 0.57) & (u < 0.76)) | (u >= 0.95))
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(d)], names=["src", "dst"])

    return spark.range((1 << scale) * edge_factor).mapInArrow(run, "src bigint, dst bigint")


def rank_window(key: str, *order) -> Column:
    return F.row_number().over(Window.partitionBy(key).orderBy(*order))

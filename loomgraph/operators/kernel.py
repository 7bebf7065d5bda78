"""The temporal value store, proofs, fibres, causal cuts, and the record surface of a knowledge graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import session


def commit_values(writes: DataFrame, order: str, key: list[str]) -> DataFrame:
    """Adds ``committed`` and ``retired``: each write of a key retires the one before it (null: still open)."""
    w = Window.partitionBy(*key).orderBy(order)
    return writes.withColumns({"committed": F.col(order), "retired": F.lead(order).over(w)})


def as_of(store: DataFrame, at, key: list[str]) -> DataFrame:
    """The value of every key at a time: committed by then and not retired.  A filter only, which reaches the scan."""
    return store.filter((F.col("committed") <= at) & (F.col("retired").isNull() | (F.col("retired") > at)))


def as_of_join(reads: DataFrame, store: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """Each read with the last value committed by its time, by one shuffle on the key: reads and values are sorted together and the value is carried on.

    No pair of a read and an earlier value is ever formed, so a key of a million values costs a sort.
    """
    r = reads.withColumns({"_t": F.col(at), "_k": F.lit(1), "_v": F.lit(None).cast(store.schema[value].dataType)})
    s = store.select(*key, F.col("committed").alias("_t"), F.lit(0).alias("_k"), F.col(value).alias("_v"))
    both = r.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).filter("_k = 1").select(*reads.columns, value)


def fold_log(log: DataFrame, until=None) -> DataFrame:
    """(id, key, value) of a log (seq, op, id, key, value): the last write of each key, without removed nodes' earlier ones.

    One grouped maximum a key, combined before the shuffle; ``until`` gives the state at a sequence number.
    """
    log = log if until is None else log.filter(F.col("seq") <= until)
    last = log.filter("op = 'set'").groupBy("id", "key").agg(F.max(F.struct("seq", "value")).alias("m"))
    gone = log.filter("op = 'remove'").groupBy("id").agg(F.max("seq").alias("gone"))
    return last.join(gone, "id", "left").filter("gone is null or m.seq > gone").select("id", "key", F.col("m.value").alias("value"))


def incident_links(links: DataFrame) -> DataFrame:
    """(member, link, role, ordinal) of links with an array of (role, target)."""
    return links.select(F.col("id").alias("link"), F.posexplode("members").alias("ordinal", "m")).select(F.col("m.target").alias("member"), "link", F.col("m.role").alias("role"), "ordinal")


def active_count(store: DataFrame, at, subject: str) -> DataFrame:
    return as_of(store, at, []).groupBy(subject).agg(F.count("*").alias("active"))


def check_bounded(states: DataFrame, lo: float = 0.0, hi: float = 1.0, epsilon: float = 0.1) -> DataFrame:
    """Adds ``violations`` and ``verdict`` for (id, field array, evidence, epsilon): without evidence inconclusive, any value out of bounds or too large an epsilon violated, fewer than three pieces inconclusive, else proved."""
    bad = F.size(F.filter("field", lambda x: (x < lo) | (x > hi) | F.isnan(x)))
    v = F.when(F.col("evidence") < 1, "inconclusive").when((bad > 0) | (F.col("epsilon") > epsilon), "violated").when(F.col("evidence") < 3, "inconclusive").otherwise("proved")
    return states.withColumns({"violations": bad, "verdict": v})


def apply_deltas(fields: DataFrame, deltas: DataFrame) -> DataFrame:
    """(id, field, epsilon): the deltas (id, dim, delta) of each dimension are summed and the field clamped to [0, 1]; epsilon is the mean change and half of dimension 18."""
    d = deltas.groupBy("id", "dim").agg(F.sum("delta").alias("d")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "d"))).alias("m"))
    j = fields.join(d, "id", "left")
    moved = F.transform("field", lambda x, i: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x + F.coalesce(F.try_element_at("m", i), F.lit(0.0)))))
    j = j.withColumn("new", moved)
    change = F.aggregate(F.zip_with("field", "new", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / F.size("field")
    tail = F.coalesce(F.try_element_at("new", F.lit(19)), F.lit(0.0))
    return j.select("id", F.col("new").alias("field"), F.least(F.lit(1.0), change + 0.5 * tail).alias("epsilon"))


def glue(edges: DataFrame, claims: DataFrame, tolerance: float = 0.0, floor: int = 0, anchors: DataFrame | None = None) -> DataFrame:
    """(src, dst, verdict, witness, doubly_grounded) of relational edges (src, dst), each once, by the claims of both ends.

    Claims are (doc, var, value, grade), with ``at`` for their order (else that of the variables); of several of one
    document and variable the last counts at dst.  In the order of src's claims, the first variable that both claim and
    that is below the ``floor`` on a side gives ZERO, or that differs by more than the tolerance gives NEG with it as
    witness; if none does, POS with the last as witness; without a shared variable ZERO.  ``anchors`` (id) ground ends.
    """
    c = claims if "at" in claims.columns else claims.withColumn("at", F.lit(0))
    e = edges.select("src", "dst").distinct()
    right = c.groupBy(F.col("doc").alias("dst"), "var").agg(F.max(F.struct("at", F.col("value").alias("y"), F.col("grade").alias("h"))).alias("r")).select("dst", "var", "r.y", "r.h")
    both = e.join(c.select(F.col("doc").alias("src"), "var", "at", F.col("value").alias("x"), F.col("grade").alias("g")), "src").join(right, ["dst", "var"])
    low, apart = F.least("g", "h") < floor, F.abs(F.col("x") - F.col("y")) > tolerance
    seen = both.select("src", "dst", F.when(low | apart, F.struct("at", "var", low.alias("low"))).alias("stop"), F.struct("at", "var").alias("seen"))
    v = seen.groupBy("src", "dst").agg(F.min("stop").alias("stop"), F.max("seen").alias("last"))
    v = e.join(v, ["src", "dst"], "left")
    none = F.col("last").isNull() | F.coalesce(F.col("stop.low"), F.lit(False))
    out = v.select("src", "dst", F.when(none, "ZERO").when(F.col("stop").isNull(), "POS").otherwise("NEG").alias("verdict"), F.when(~none, F.coalesce("stop.var", "last.var")).alias("witness"))
    if anchors is None:
        return out.withColumn("doubly_grounded", F.lit(False))
    ids = anchors.select("id").distinct()
    for end in ("src", "dst"):
        out = out.join(ids.select(F.col("id").alias(end), F.lit(True).alias(f"{end}_")), end, "left")
    return out.select("src", "dst", "verdict", "witness", (F.coalesce("src_", F.lit(False)) & F.coalesce("dst_", F.lit(False))).alias("doubly_grounded"))


# causal cuts: (writer, seq) tables


def cut_join(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("writer").agg(F.max("seq").alias("seq"))


def cut_meet(a: DataFrame, b: DataFrame) -> DataFrame:
    """The least of both where both have the writer."""
    return a.groupBy("writer").agg(F.max("seq").alias("s")).join(b.groupBy("writer").agg(F.max("seq").alias("t")), "writer").select("writer", F.least("s", "t").alias("seq"))


def ops_in_cut(ops: DataFrame, cut: DataFrame) -> DataFrame:
    return ops.join(cut.withColumnRenamed("seq", "top"), "writer").filter("seq <= top").drop("top")


def subsumes(a: DataFrame, b: DataFrame) -> bool:
    """Whether all of b lies in a."""
    return b.join(a.withColumnRenamed("seq", "top"), "writer", "left").filter("top is null or seq > top").limit(1).count() == 0


# records


def scan_edges(edges: DataFrame, after: str | None = None, page: int = 100, relation: str | None = None) -> DataFrame:
    """The next page of edges by id in byte order, after a cursor; tombstones (``deleted``) are left out."""
    e = edges.filter(~F.coalesce(F.col("deleted"), F.lit(False))) if "deleted" in edges.columns else edges
    e = e.filter(F.col("relation") == relation) if relation else e
    e = e.filter(F.col("id") > after) if after is not None else e
    return e.orderBy("id").limit(page)


def resolve_same_as(same: DataFrame, ids: DataFrame, hops: int = 3) -> DataFrame:
    """(id, canonical): the least id within so many same-as steps, both ways."""
    both = session.cut(same.select("src", "dst").union(same.select("dst", "src")).distinct())
    now = ids.select("id", F.col("id").alias("at"))
    for _ in range(hops):
        step = now.join(both, F.col("at") == F.col("src")).select("id", F.col("dst").alias("at"))
        now = session.cut(now.union(step).distinct())
    return now.groupBy("id").agg(F.min("at").alias("canonical"))


def subgraph(edges: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """Edges within so many hops of the seeds (id)."""
    near = seeds.select("id").distinct()
    for _ in range(hops):
        out = edges.join(near, F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id"))
        back = edges.join(near, F.col("dst") == F.col("id"), "left_semi").select(F.col("src").alias("id"))
        near = session.cut(near.union(out).union(back).distinct())
    return edges.join(near, F.col("src") == F.col("id"), "left_semi").join(near, F.col("dst") == F.col("id"), "left_semi")


def content_hash(*cols: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", *cols), 256)

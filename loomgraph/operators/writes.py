"""Writes to a property graph as folds of tables: upserts, unique constraints and transactions.

Nodes are (id, labels, properties), edges (label, src, dst, properties); ``properties`` is a map of strings.  A batch has
``seq`` beside, the order of its writes.  A write gives a new table and leaves the old one as it is.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import session


class ConstraintViolation(ValueError):
    """A batch would give two nodes of a label the same value of a unique property."""


def _merged(old: DataFrame, batch: DataFrame, keys: list[str], labels: bool) -> DataFrame:
    """One row a key: per property the last write, and the union of labels.

    Properties are grouped by key and name first, so a node that is written often is combined before the shuffle.
    """
    cols = [*keys, *(["labels"] if labels else []), "properties", "seq"]
    rows = old.withColumn("seq", F.lit(-1).cast("bigint")).select(cols).unionByName(batch.select(cols))
    entries = F.map_entries(F.coalesce("properties", F.expr("cast(map() as map<string,string>)")))
    # a row without properties stays as one of no name
    props = rows.select(*keys, "seq", F.explode_outer(entries).alias("e")).groupBy(*keys, F.col("e.key").alias("k")).agg(F.max_by("e.value", "seq").alias("v"))
    packed = props.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v"))))).alias("properties"))
    if not labels:
        return packed
    names = rows.select(*keys, F.explode_outer("labels").alias("l")).groupBy(*keys).agg(F.array_sort(F.collect_set("l")).alias("labels"))
    return names.join(packed, keys).select(*keys, "labels", "properties")


def upsert_nodes(nodes: DataFrame, batch: DataFrame) -> DataFrame:
    """New nodes join, known ones get the union of labels and, of each property, the last written value."""
    return _merged(nodes, batch, ["id"], True)


def upsert_edges(edges: DataFrame, batch: DataFrame) -> DataFrame:
    """Edges are one by (label, src, dst); of each property the last written value counts."""
    return _merged(edges, batch, ["label", "src", "dst"], False)


def set_property(nodes: DataFrame, writes: DataFrame) -> DataFrame:
    """Single writes (id, key, value, seq); those to unknown nodes are dropped."""
    known = writes.join(nodes.select("id"), "id", "left_semi")
    return upsert_nodes(nodes, known.select("id", F.expr("cast(array() as array<string>)").alias("labels"), F.create_map("key", "value").alias("properties"), "seq"))


def unique_violations(nodes: DataFrame, constraints: list[tuple[str, str]], touched: DataFrame | None = None) -> DataFrame:
    """(label, key, value, n) of values that several nodes of the label have; with ``touched`` (id) only where one of those is among them."""
    one = [nodes.filter(F.array_contains("labels", label)).select("id", F.lit(label).alias("label"), F.lit(key).alias("key"), F.try_element_at("properties", F.lit(key)).alias("value")) for label, key in constraints]
    rows = one[0]
    for x in one[1:]:
        rows = rows.unionByName(x)
    rows = rows.filter("value is not null")
    mark: Column = F.lit(True)
    if touched is not None:
        rows = rows.join(touched.select("id", F.lit(True).alias("hit")).distinct(), "id", "left")
        mark = F.coalesce(F.max("hit"), F.lit(False))
    got = rows.groupBy("label", "key", "value").agg(F.count_distinct("id").alias("n"), mark.alias("hit") if touched is not None else F.lit(True).alias("hit"))
    return got.filter("n > 1 and hit").drop("hit")


@dataclass(frozen=True)
class Store:
    """The tables of a graph, the unique constraints (label, key), and how many writes made it."""

    nodes: DataFrame
    edges: DataFrame
    constraints: tuple[tuple[str, str], ...] = field(default_factory=tuple)
    version: int = 0

    def add_unique_constraint(self, label: str, key: str) -> Store:
        """From now on :meth:`transaction` refuses two nodes of the label with one value of the property."""
        return replace(self, constraints=(*self.constraints, (label, key)))

    def transaction(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> Store:
        """All of a batch or, if it would break a constraint, none of it: then :class:`ConstraintViolation` is raised.

        Values within the batch count too; a node keeps its own value.  The new tables are written before they are
        returned, so that a reader sees the state before or after.
        """
        new_nodes, new_edges, ticks = self.nodes, self.edges, 0
        if nodes is not None:
            new_nodes = session.cut(upsert_nodes(self.nodes, nodes))
            if self.constraints:
                bad = unique_violations(new_nodes, list(self.constraints), nodes).orderBy("label", "key", "value").first()
                if bad is not None:
                    raise ConstraintViolation(f"uniqueness constraint ({bad.label}.{bad.key}): {bad.n} nodes have {bad.value!r}")
            ticks += nodes.count()
        if edges is not None:
            new_edges = session.cut(upsert_edges(self.edges, edges))
            ticks += edges.count()
        return replace(self, nodes=new_nodes, edges=new_edges, version=self.version + ticks)


def clock(log: DataFrame) -> DataFrame:
    """One row (version, earliest, latest) of a log (seq, ts)."""
    return log.agg(F.max("seq").alias("version"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"))

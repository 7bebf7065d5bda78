"""The property graph as tables, and its triple projection.

A graph is a list of node tables and edge tables that keep their own columns.  A query asks for the tables of a label, a
predicate or an edge type and for named properties only, so that scans read the columns and files that it needs.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import session
from loomgraph.functions import values

TYPE = "rdf:type"


@dataclass(frozen=True)
class NodeTable:
    """``df`` has ``id`` and a column for each property; every row has the given labels, or those in its array column ``labels``."""

    df: DataFrame
    labels: tuple[str, ...] | None = None

    @property
    def properties(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("id", "labels")]

    def label_array(self) -> Column:
        return F.col("labels") if self.labels is None else F.array(*map(F.lit, self.labels)) if self.labels else F.expr("cast(array() as array<string>)")

    def kind(self, prop: str) -> str:
        return self.df.schema[prop].dataType.simpleString()


@dataclass(frozen=True)
class EdgeTable:
    """``df`` has ``src``, ``dst`` and a column for each property.  Edges are distinct by (label, src, dst)."""

    label: str
    df: DataFrame

    @property
    def properties(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("src", "dst")]


def _union(parts: Iterable[DataFrame]) -> DataFrame | None:
    parts = list(parts)
    return reduce(DataFrame.unionByName, parts) if parts else None


@dataclass
class Graph:
    spark: object
    node_tables: list[NodeTable] = field(default_factory=list)
    edge_tables: list[EdgeTable] = field(default_factory=list)

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    # nodes and edges

    def nodes(self, label: str | None = None, properties: Iterable[str] = ()) -> DataFrame:
        """(id, labels, and for each property p: ``p`` printed and ``p#`` as a number) of the nodes that have the label."""
        want, out = list(properties), []
        for t in self.node_tables:
            if label is not None and t.labels is not None and label not in t.labels:
                continue
            df = t.df if label is None or t.labels is not None else t.df.filter(F.array_contains("labels", label))
            cols = [F.col("id"), t.label_array().alias("labels")]
            for p in want:
                if p in t.properties:
                    cols += [values.printed(F.col(f"`{p}`"), t.kind(p)).alias(p), values.number(F.col(f"`{p}`"), t.kind(p)).alias(f"{p}#")]
                else:
                    cols += [F.lit(None).cast("string").alias(p), F.lit(None).cast("double").alias(f"{p}#")]
            out.append(df.select(*cols))
        return _union(out) or self._empty(", ".join(["id string", "labels array<string>", *(f"`{p}` string, `{p}#` double" for p in want)]))

    def edges(self, label: str | None = None, properties: Iterable[str] = ()) -> DataFrame:
        """(label, src, dst, and each property printed) of the edges of the label."""
        want, out = list(properties), []
        for t in self.edge_tables:
            if label in (None, t.label):
                cols = [(values.printed(F.col(f"`{p}`"), t.df.schema[p].dataType.simpleString()) if p in t.properties else F.lit(None).cast("string")).alias(p) for p in want]
                out.append(t.df.select(F.lit(t.label).alias("label"), "src", "dst", *cols))
        return _union(out) or self._empty(", ".join(["label string", "src string", "dst string", *(f"`{p}` string" for p in want)]))

    def property_names(self, label: str | None = None) -> set[str]:
        return {p for t in self.node_tables if label is None or t.labels is None or label in t.labels for p in t.properties}

    def out(self, ids: DataFrame, label: str | None = None) -> DataFrame:
        return ids.join(self.edges(label), F.col("id") == F.col("src")).select(F.col("dst").alias("id"))

    def in_(self, ids: DataFrame, label: str | None = None) -> DataFrame:
        return ids.join(self.edges(label), F.col("id") == F.col("dst")).select(F.col("src").alias("id"))

    # triples

    def triples(self, predicate: str | None = None, signed: bool = False) -> DataFrame:
        """(s, p, o, n, is_iri): a type triple for each label, a literal for each property, an IRI for each edge; edge properties have none.  ``signed`` prints -0.0 as -0."""
        out = []
        for t in self.node_tables:
            if predicate in (None, TYPE):
                types = t.df.select(F.col("id").alias("s"), F.explode(t.label_array()).alias("o"))
                out.append(types.select("s", F.lit(TYPE).alias("p"), "o", values.number(F.col("o")).alias("n"), F.lit(False).alias("is_iri")))
            for c in t.properties:
                if predicate in (None, c):
                    k = t.kind(c)
                    out.append(t.df.filter(F.col(f"`{c}`").isNotNull()).select(F.col("id").alias("s"), F.lit(c).alias("p"), values.printed(F.col(f"`{c}`"), k, signed).alias("o"), values.number(F.col(f"`{c}`"), k).alias("n"), F.lit(False).alias("is_iri")))
        for e in self.edge_tables:
            if predicate in (None, e.label):
                out.append(e.df.select(F.col("src").alias("s"), F.lit(e.label).alias("p"), F.col("dst").alias("o"), values.number(F.col("dst")).alias("n"), F.lit(True).alias("is_iri")))
        return _union(out) or self._empty("s string, p string, o string, n double, is_iri boolean")

    # health

    def dangling_edges(self) -> DataFrame:
        """Edges one of whose ends is no node."""
        ids = self.nodes().select("id").distinct()
        e = self.edges()
        return e.join(ids, e["src"] == ids["id"], "left_anti").unionByName(e.join(ids, e["src"] == ids["id"], "left_semi").join(ids, F.col("dst") == ids["id"], "left_anti"))

    def orphan_nodes(self) -> DataFrame:
        e = self.edges()
        touched = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id")))
        return self.nodes().select("id").join(touched, "id", "left_anti")

    def health(self) -> DataFrame:
        """One row: (nodes, edges, dangling_edges, orphan_nodes).

        The distinct ends of edges are compared with the nodes; edges are joined only to the ends that are no nodes, if any.
        """
        ids = session.cut(self.nodes().select("id").distinct())
        ends = session.cut(self.edges().select(F.explode(F.array("src", "dst")).alias("id")).distinct())
        missing = session.cut(ends.join(ids, "id", "left_anti"))
        e = self.edges()
        if missing.limit(1).count():
            src, dst = (missing.select(F.col("id").alias(c), F.lit(True).alias(c + "!")) for c in ("src", "dst"))
            bad = e.join(src, "src", "left").join(dst, "dst", "left").filter("`src!` or `dst!` or src is null or dst is null")
        else:
            bad = e.limit(0)
        counts = [(ids, "nodes"), (e, "edges"), (bad, "dangling_edges"), (self.nodes().select("id").join(ends, "id", "left_anti"), "orphan_nodes")]
        return reduce(DataFrame.crossJoin, [df.agg(F.count("*").alias(n)) for df, n in counts])

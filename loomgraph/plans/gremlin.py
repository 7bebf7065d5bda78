"""Gremlin traversals as DataFrame plans: ``g.V().hasLabel('Customer').out('PLACED').values('o_totalprice').limit(3)``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import values
from loomgraph.model import Graph
from loomgraph.plans.sparql import UnsupportedQuery

_STEP = re.compile(r"\s*\.?\s*(\w+)\s*\(([^()]*)\)")
_ARG = re.compile(r"""\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|(-?\d+(?:\.\d+)?|true|false))\s*(?:,|$)""")


def parse(text: str) -> list[tuple[str, list[str]]]:
    at, out = 0, []
    text = text.strip()
    if not text.startswith("g"):
        raise UnsupportedQuery("a traversal starts with g")
    at = 1
    while at < len(text):
        m = _STEP.match(text, at)
        if not m:
            raise UnsupportedQuery(f"no step: {text[at:]!r}")
        args, k = [], 0
        while k < len(m[2].strip()):
            a = _ARG.match(m[2].strip(), k)
            if not a:
                raise UnsupportedQuery(f"no argument: {m[2]!r}")
            args.append(next(x for x in a.groups() if x is not None))
            k = a.end()
        out.append((m[1], args))
        at = m.end()
    if not out or out[0][0] not in ("V", "E"):
        raise UnsupportedQuery("a traversal starts with V or E")
    return out


class Traversal:
    """Elements on the way: nodes as (id), edges as (label, src, dst), or values as (value, number)."""

    def __init__(self, graph: Graph):
        self.graph, self.kind, self.df = graph, "", None

    def with_property(self, key: str) -> DataFrame:
        if self.kind == "edge":
            e = self.graph.edges(None, [key]).withColumnsRenamed({key: "value"})
            return self.df.join(e, ["label", "src", "dst"], "left").withColumn("number", values.number(F.col("value")))
        p = self.graph.nodes(None, [key]).select("id", F.col(f"`{key}`").alias("value"), F.col(f"`{key}#`").alias("number"))
        return self.df.join(p, "id", "left")

    def need(self, *kinds: str) -> None:
        if self.kind not in kinds:
            raise UnsupportedQuery(f"this step needs a {' or '.join(kinds)}")

    def step(self, name: str, args: list[str]) -> None:
        g, df, label = self.graph, self.df, args[0] if args else None
        if name == "V":
            self.kind, self.df = "node", g.nodes().select("id")
        elif name == "E":
            self.kind, self.df = "edge", g.edges()
        elif name == "hasLabel":
            self.need("node")
            self.df = df.join(g.nodes(label).select("id"), "id", "left_semi")
        elif name == "has":
            self.need("node")
            self.df = self.with_property(args[0]).filter(F.col("value") == args[1]).select("id")
        elif name in ("out", "in", "both"):
            self.need("node")
            a = g.out(df, label) if name != "in" else None
            b = g.in_(df, label) if name != "out" else None
            self.df = a.unionByName(b) if name == "both" else a if b is None else b
        elif name in ("outE", "inE"):
            self.need("node")
            e = g.edges(label)
            self.df = df.join(e, df["id"] == e["src" if name == "outE" else "dst"]).select("label", "src", "dst")
            self.kind = "edge"
        elif name == "values":
            self.need("node", "edge")
            self.df, self.kind = self.with_property(args[0]).filter("value is not null").select("value", "number"), "value"
        elif name == "valueMap":
            self.need("node")
            names = sorted(g.property_names())
            p = g.nodes(None, names)
            entries = F.array(*[F.struct(F.lit(n).alias("k"), F.col(f"`{n}`").alias("v")) for n in names])
            p = p.select("id", F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())).alias("value"))
            self.df, self.kind = df.join(p, "id").select("value"), "map"
        elif name == "dedup":
            self.df = df.dropDuplicates()
        elif name == "order":
            down = len(args) > 1 and args[1] in ("desc", "decr")
            keyed = self.with_property(args[0]) if args and self.kind != "value" else df
            tie = [F.col(c) for c in (["id"] if self.kind == "node" else ["label", "src", "dst"] if self.kind == "edge" else [])]
            self.df = keyed.orderBy(*values.sort_keys(F.col("value"), F.col("number"), down), *tie).select(*df.columns)
        elif name == "limit":
            self.df = df.limit(int(args[0]))
        elif name == "count":
            self.df, self.kind = df.agg(F.count("*").alias("value")), "count"
        else:
            raise UnsupportedQuery(f"step {name}")


def run(graph: Graph, text: str) -> DataFrame:
    """The traversal as a lazy DataFrame.  Duplicates stay, as traversers do, until ``dedup``; ``order`` breaks ties by id."""
    t = Traversal(graph)
    steps = parse(text)
    for i, (name, args) in enumerate(steps):
        if i == 1 and name == "hasLabel" and steps[0][0] == "V":  # V().hasLabel(l) reads only the label's tables
            t.df = graph.nodes(args[0]).select("id")
        else:
            t.step(name, args)
    return t.df.drop("number") if t.kind == "value" else t.df

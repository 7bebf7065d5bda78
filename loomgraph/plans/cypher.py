"""Read-only Cypher as DataFrame joins: MATCH chains, MATCH LINK, WHERE, RETURN, ORDER BY, LIMIT.

OPTIONAL MATCH is an inner match, ``-[:R]-`` goes outwards, and every cell of the result is a string (missing ones are
empty).  What isn't supported raises.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import values
from loomgraph.model import Graph
from loomgraph.plans.sparql import UnsupportedQuery

_LEX = re.compile(r"""\s+|//[^\n]*|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+(?:\.\d+)?)(?!\.\d)|(?P<name>[A-Za-z_]\w*)|(?P<param>\$\w+)|(?P<op><-|->|\.\.|<>|<=|>=|!=|[()\[\]{}:,.*=<>|-])""", re.X)
REFUSED = {"CREATE", "MERGE", "SET", "DELETE", "DETACH", "REMOVE", "WITH", "UNWIND", "UNION", "CALL", "XOR", "SKIP", "DISTINCT"}


@dataclass
class Node:
    var: str
    label: str | None
    props: dict[str, str]


@dataclass
class Edge:
    var: str | None
    label: str | None
    direction: str
    lo: int = 1
    hi: int = 1


@dataclass
class Ast:
    chains: list = field(default_factory=list)  # [node, edge, node, ...]
    links: list = field(default_factory=list)  # (type, [(role, var)])
    where: object = None
    returns: list | None = None  # (var, prop or None); None is *
    order: list = field(default_factory=list)
    limit: int | None = None
    explain: bool = False


class Parser:
    def __init__(self, text: str, params: dict | None = None):
        self.tokens, at, self.params, self.fresh = [], 0, params or {}, 0
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise UnsupportedQuery(f"unexpected {text[at]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k][1] if self.at + k < len(self.tokens) else ""

    def maybe(self, word: str) -> bool:
        if self.peek().upper() == word:
            self.at += 1
            return True
        return False

    def take(self, word: str) -> None:
        if not self.maybe(word):
            raise UnsupportedQuery(f"expected {word}, found {self.peek()!r}")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise UnsupportedQuery(f"expected a name, found {self.peek()!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def literal(self) -> str:
        sign = "-" if self.maybe("-") else ""
        kind, x = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        self.at += 1
        if kind == "num":
            return sign + (re.sub(r"(\.\d*?)0+$", r"\1", x).rstrip(".") if "." in x else x)
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", x[1:-1])
        if kind == "param":
            if x[1:] not in self.params:
                raise UnsupportedQuery(f"no parameter {x}")
            return str(self.params[x[1:]])
        if kind == "name" and x.lower() in ("true", "false"):
            return x.lower()
        raise UnsupportedQuery(f"expected a value, found {x!r}")

    def query(self) -> Ast:
        a = Ast()
        a.explain = self.maybe("EXPLAIN")
        self.maybe("PROFILE")
        if self.maybe("USE"):
            self.take("SPACE")
            self.name()
        while self.at < len(self.tokens):
            word = self.peek().upper()
            if word in REFUSED:
                raise UnsupportedQuery(f"{word} isn't supported")
            if word == "OPTIONAL":
                self.at += 1
            elif word == "MATCH":
                self.at += 1
                if self.maybe("LINK"):
                    a.links.append(self.link())
                else:
                    a.chains.append(self.chain())
                if self.peek() == ",":
                    raise UnsupportedQuery("several patterns in one MATCH aren't supported")
            elif word == "WHERE":
                self.at += 1
                a.where = self.boolean()
            elif word == "RETURN":
                self.at += 1
                if self.peek().upper() in REFUSED:
                    raise UnsupportedQuery(f"{self.peek()} isn't supported")
                a.returns = None if self.maybe("*") else [self.field()]
                while a.returns is not None and self.maybe(","):
                    a.returns.append(self.field())
                if self.maybe("AS") or self.peek() == "(":
                    raise UnsupportedQuery("RETURN takes variables and properties only")
            elif word == "ORDER":
                self.at += 1
                self.take("BY")
                while True:
                    f = self.field()
                    down = self.maybe("DESC") or (self.maybe("ASC") and False)
                    a.order.append((f, down))
                    if not self.maybe(","):
                        break
            elif word == "LIMIT":
                self.at += 1
                a.limit = int(self.literal())
            else:
                raise UnsupportedQuery(f"unexpected {self.peek()!r}")
        return a

    def field(self) -> tuple[str, str | None]:
        v = self.name()
        return (v, self.name() if self.maybe(".") else None)

    def node(self) -> Node:
        self.take("(")
        var = self.name() if self.peek() not in (":", ")", "{") else None
        label = self.name() if self.maybe(":") else None
        props = {}
        if self.maybe("{"):
            if var is None:
                raise UnsupportedQuery("properties need a named node")
            while not self.maybe("}"):
                k = self.name()
                self.take(":")
                props[k] = self.literal()
                self.maybe(",")
        self.take(")")
        if var is None:
            self.fresh += 1
            var = f"_{self.fresh}"
        return Node(var, label, props)

    def chain(self) -> list:
        out = [self.node()]
        while self.peek() in ("-", "<-"):
            direction = "in" if self.maybe("<-") else "out"
            if direction == "out":
                self.take("-")
            e = Edge(None, None, direction)
            if self.maybe("["):
                if self.peek() not in (":", "]", "*"):
                    e.var = self.name()
                if self.maybe(":"):
                    e.label = self.name()
                if self.maybe("*"):
                    e.lo = int(self.literal()) if self.peek().isdigit() else 1
                    if not self.maybe(".."):
                        e.hi = e.lo
                    elif self.peek().isdigit():
                        e.hi = int(self.literal())
                    else:
                        raise UnsupportedQuery("a path needs an upper bound")
                self.take("]")
            if not self.maybe("->"):
                self.take("-")
            out += [e, self.node()]
        return out

    def link(self) -> tuple[str, list]:
        kind = self.name()
        self.take("(")
        roles = []
        while not self.maybe(")"):
            role = self.name()
            self.take("=")
            roles.append((role, self.name()))
            self.maybe(",")
        if self.maybe("AS"):
            self.name()
        return kind, roles

    def boolean(self):
        left = self.conjunction()
        while self.maybe("OR"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.negation()
        while self.maybe("AND"):
            left = ("and", left, self.negation())
        if self.peek().upper() == "XOR":
            raise UnsupportedQuery("XOR isn't supported")
        return left

    def negation(self):
        if self.maybe("NOT"):
            return ("not", self.negation())
        if self.maybe("("):
            e = self.boolean()
            self.take(")")
            return e
        f = self.field()
        op = self.peek()
        self.at += 1
        if op not in ("=", "<>", "!=", "<", "<=", ">", ">="):
            raise UnsupportedQuery(f"operator {op}")
        return ("cmp", op, f, self.literal())


def _fields(e) -> list:
    return [] if e is None else [e[2]] if e[0] == "cmp" else [f for x in e[1:] for f in _fields(x)]


ID = ("form", "id", None)


def run(graph: Graph, text: str, params: dict | None = None, *, max_hops: int = 3, max_rows: int = 1000, require_limit: bool = False, links: dict[str, DataFrame] | None = None) -> DataFrame:
    """The query as a DataFrame of strings.  ``links`` has, by type, tables of hyperedges, a column for each position.

    Rows are distinct before WHERE.  A property in WHERE that no node table has raises.  With EXPLAIN the result is the
    plan, one row a step.
    """
    a = Parser(text, params).query()
    if require_limit and a.limit is None:
        raise UnsupportedQuery("LIMIT is required")
    if a.limit is not None and a.limit > max_rows:
        raise UnsupportedQuery(f"LIMIT is above {max_rows}")
    nodes = {}
    edge_vars = {}
    for chain in a.chains:
        for x in chain[::2]:
            old = nodes.get(x.var)
            nodes[x.var] = Node(x.var, x.label or (old.label if old else None), {**(old.props if old else {}), **x.props})
        for e in chain[1::2]:
            if e.hi > max_hops:
                raise UnsupportedQuery(f"more than {max_hops} hops")
            if e.var:
                edge_vars[e.var] = e
    for _, roles in a.links:
        for _, v in roles:
            nodes.setdefault(v, Node(v, None, {}))
    used = [*(a.returns or []), *_fields(a.where), *(f for f, _ in a.order)]
    used += [(v, p) for v, n in nodes.items() for p in n.props]
    for v, p in used:
        if v not in nodes and v not in edge_vars:
            raise UnsupportedQuery(f"unknown variable {v}")
    for v, p in _fields(a.where):
        if v in nodes and p not in ID and p != "name" and p not in graph.property_names(nodes[v].label):
            raise UnsupportedQuery(f"no node has the property {p}")
    wanted = {v: sorted({p for x, p in used if x == v and p not in ID}) for v in nodes}
    steps: list[str] = []
    df, known = None, set()

    def attach(df: DataFrame | None, v: str, key: str | None) -> DataFrame:
        n = nodes[v]
        t = graph.nodes(n.label, wanted[v]).select(F.col("id").alias(f"{v}.id"), *[c for p in wanted[v] for c in (F.col(f"`{p}`").alias(f"{v}.{p}"), F.col(f"`{p}#`").alias(f"{v}.{p}#"))])
        for p, x in n.props.items():
            t = t.filter(F.col(f"`{v}.id`" if p in ID else f"`{v}.{p}`") == x)
        steps.append(f"NodeScan {v}{':' + n.label if n.label else ''}")
        return t if df is None else df.join(t, f"{v}.id") if key else df.crossJoin(t)

    def extend(df: DataFrame, e: Edge, a_: str, b: str, hops: int) -> DataFrame:
        src, dst = (a_, b) if e.direction == "out" else (b, a_)
        t = graph.edges(e.label, ["strength", "confidence"] if e.var else ())
        pair = t.select(F.col("src").alias("x"), F.col("dst").alias("y"))
        walk = pair
        for _ in range(hops - 1):
            walk = walk.select("x", F.col("y").alias("m")).join(pair.select(F.col("x").alias("m"), "y"), "m").select("x", "y")
        if hops > 1:
            walk = walk.distinct()
        if e.var:
            walk = t.select(F.col("src").alias("x"), F.col("dst").alias("y"), *[F.coalesce(F.col(c), F.lit(d)).alias(f"{e.var}.{c}") for c, d in (("strength", "1"), ("confidence", "1"))])
        walk = walk.withColumnsRenamed({"x": f"{src}.id", "y": f"{dst}.id"}) if src != dst else walk.filter("x = y").withColumnRenamed("x", f"{src}.id").drop("y")
        return walk if df is None else df.join(walk, [f"{v}.id" for v in {a_, b} & known])

    for chain in a.chains:
        only = chain[1] if len(chain) == 3 else None
        first = chain[0].var
        if len(chain) == 1:
            if first not in known:
                df = attach(df, first, None)
                known.add(first)
            continue
        if df is not None and not {x.var for x in chain[::2]} & known:
            df = attach(df, first, None)
            known.add(first)
        for k in range(1, len(chain), 2):
            e, u, v = chain[k], chain[k - 1].var, chain[k + 1].var
            lo, hi = (e.lo, e.hi) if only else (1, 1)
            before = df
            parts = [extend(before, e, u, v, h) for h in range(lo, hi + 1)]
            df = parts[0]
            for p in parts[1:]:
                df = df.unionByName(p)
            df = df.distinct() if len(parts) > 1 else df
            steps.append(f"EdgeJoin {u}-{e.label or '*'}{f'*{lo}..{hi}' if hi > 1 else ''}-{v}")
            for x in (u, v):
                if x not in known:
                    df = attach(df, x, "id")
                    known.add(x)
    for kind, roles in a.links:
        t = (links or {}).get(kind)
        if t is None:
            raise UnsupportedQuery(f"no links of type {kind}")
        t = t.select(*[F.col(c).alias(f"{v}.id") for c, (_, v) in zip(t.columns, roles, strict=True)])
        both = [f"{v}.id" for _, v in roles if v in known]
        df = t if df is None else df.join(t, both) if both else df.crossJoin(t)
        steps.append(f"LinkMatch {kind}")
        for _, v in roles:
            if v not in known and wanted[v]:
                df = attach(df, v, "id")
            known.add(v)
    if df is None:
        raise UnsupportedQuery("no MATCH")
    if a.explain:
        steps += [s for s in ("Filter" if a.where else "", "Project", "Sort" if a.order else "", f"Limit {a.limit}" if a.limit is not None else "") if s]
        return graph.spark.createDataFrame([(i, s) for i, s in enumerate(steps)], "step int, operator string")

    def cell(f) -> tuple[Column, Column]:
        v, p = f
        if v in edge_vars:
            c = F.col(f"`{v}.{p}`") if p in ("strength", "confidence") else F.lit(None).cast("string")
            return c, values.number(c)
        if p in ID:
            c = F.col(f"`{v}.id`")
            return c, values.number(c)
        s, n = F.col(f"`{v}.{p}`"), F.col(f"`{v}.{p}#`")
        return (F.coalesce(s, F.col(f"`{v}.id`")), n) if p == "name" else (s, n)

    def where(e) -> Column:
        if e[0] == "cmp":
            s, n = cell(e[2])
            return F.coalesce(values.ordered(e[1], s, n, F.lit(e[3]), values.number(F.lit(e[3]))), F.lit(False))
        if e[0] == "not":
            return ~where(e[1])
        x, y = where(e[1]), where(e[2])
        return x & y if e[0] == "and" else x | y

    keep = [c for c in df.columns if not c.split(".")[0].startswith("_")] or df.columns
    df = df.select(*[f"`{c}`" for c in keep]).distinct()
    if a.where is not None:
        df = df.filter(where(a.where))
    fields = [(v, None) for v in nodes if not v.startswith("_")] if a.returns is None else a.returns
    keys = []
    for f, down in a.order:
        s, n = cell(f)
        keys += values.sort_keys(s, n, down)
    if keys:
        df = df.orderBy(*keys)
    df = df.select(*[F.coalesce(cell(f)[0], F.lit("")).alias(f[0] if f[1] is None else f"{f[0]}.{f[1]}") for f in fields])
    return df.limit(a.limit) if a.limit is not None else df


def query_hash(text: str) -> str:
    return hashlib.sha256(" ".join(text.split()).encode()).hexdigest()

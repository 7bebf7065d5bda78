"""SPARQL SELECT and CONSTRUCT as lazy DataFrame plans over the triple projection.

Each pattern reads only the tables of its predicate.  Variables known to be bound stay equi-join keys; only those that
OPTIONAL, UNION or UNDEF may leave unbound join by a null-tolerant condition.  Comparison follows
:mod:`loomgraph.functions.values`; ``&&`` and ``||`` have one precedence, and so have ``+ - * /``, from left to right.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import session
from loomgraph.functions import values
from loomgraph.model import TYPE, Graph

MAX_DEPTH, MAX_PATTERN, MAX_INPUT, MAX_ROUNDS = 256, 512, 8192, 1000
_LEX = re.compile(r"""\s+|\#[^\n]*|(?P<iri><[^<>\s]*>)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<var>\?\w+)|(?P<num>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][\w-]*(?::[\w./#-]*)?)|(?P<op>&&|\|\||!=|<=|>=|[{}().;,=<>+*/?!|^-])""", re.X)
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")


class UnsupportedQuery(ValueError):
    """The text isn't of the language that is supported; nothing is silently left out."""


@dataclass(frozen=True)
class Term:
    kind: str  # var, iri, lit
    text: str


@dataclass
class Group:
    triples: list = field(default_factory=list)
    groups: list = field(default_factory=list)
    unions: list = field(default_factory=list)
    values: list = field(default_factory=list)
    binds: list = field(default_factory=list)
    optionals: list = field(default_factory=list)
    minuses: list = field(default_factory=list)
    filters: list = field(default_factory=list)


@dataclass
class Query:
    where: Group
    select: list | None = None  # None is *
    distinct: bool = False
    template: list | None = None
    group_by: list = field(default_factory=list)
    aggregates: list = field(default_factory=list)
    order_by: list = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


class Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise UnsupportedQuery(f"unexpected {text[at]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.prefixes = 0, {}

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k][1] if self.at + k < len(self.tokens) else ""

    def upper(self) -> str:
        return self.peek().upper()

    def next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise UnsupportedQuery("the query ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def take(self, word: str) -> None:
        if self.next()[1].upper() != word:
            raise UnsupportedQuery(f"expected {word} before {self.peek()!r}")

    def maybe(self, word: str) -> bool:
        if self.upper() == word:
            self.at += 1
            return True
        return False

    def term(self) -> Term:
        kind, x = self.next()
        if kind == "var":
            return Term("var", x[1:])
        if kind == "iri":
            return Term("iri", x[1:-1])
        if kind == "str":
            return Term("lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), x[1:-1]))
        if kind == "num":
            return Term("lit", re.sub(r"(\.\d*?)0+$", r"\1", x).rstrip(".") if "." in x else x)
        if kind == "name":
            if x == "a":
                return Term("iri", TYPE)
            prefix, colon, rest = x.partition(":")
            if colon:
                return Term("iri", self.prefixes[prefix] + rest if prefix in self.prefixes else x)
            return Term("lit", x)
        raise UnsupportedQuery(f"no term: {x!r}")

    def query(self) -> Query:
        while self.maybe("PREFIX"):
            name = self.next()[1]
            self.prefixes[name.rstrip(":")] = self.next()[1][1:-1]
        if self.maybe("CONSTRUCT"):
            self.take("{")
            template = []
            while not self.maybe("}"):
                template.append((self.term(), self.term(), self.term()))
                self.maybe(".")
            self.maybe("WHERE")
            q = Query(self.group(), template=template)
        elif self.maybe("SELECT"):
            distinct = self.maybe("DISTINCT")
            chosen, aggregates = [], []
            while self.upper() not in ("WHERE", "{"):
                if self.maybe("*"):
                    chosen = None
                elif self.maybe("("):
                    f = self.next()[1].upper()
                    if f not in AGGREGATES:
                        raise UnsupportedQuery(f"aggregate {f}")
                    self.take("(")
                    unique = self.maybe("DISTINCT")
                    arg = None if self.maybe("*") else self.term().text
                    self.take(")")
                    self.take("AS")
                    aggregates.append((f, unique, arg, self.term().text))
                    self.take(")")
                else:
                    t = self.term()
                    if t.kind != "var":
                        raise UnsupportedQuery(f"can't select {t.text!r}")
                    chosen.append(t.text)
            self.maybe("WHERE")
            q = Query(self.group(), chosen, distinct, aggregates=aggregates)
        else:
            raise UnsupportedQuery(f"only SELECT and CONSTRUCT: {self.peek()!r}")
        while self.at < len(self.tokens):
            if self.maybe("GROUP"):
                self.take("BY")
                while self.tokens[self.at : self.at + 1] and self.tokens[self.at][0] == "var":
                    q.group_by.append(self.term().text)
            elif self.maybe("ORDER"):
                self.take("BY")
                n = len(q.order_by)
                while True:
                    if self.upper() in ("ASC", "DESC"):
                        down = self.next()[1].upper() == "DESC"
                        self.take("(")
                        q.order_by.append((self.term().text, down))
                        self.take(")")
                    elif self.at < len(self.tokens) and self.tokens[self.at][0] == "var":
                        q.order_by.append((self.term().text, False))
                    else:
                        break
                if n == len(q.order_by):
                    raise UnsupportedQuery("ORDER BY without a variable")
            elif self.upper() in ("LIMIT", "OFFSET"):
                setattr(q, self.next()[1].lower(), int(self.next()[1]))
            else:
                raise UnsupportedQuery(f"{self.peek()} isn't supported")
        return q

    def group(self, depth: int = 0) -> Group:
        if depth > MAX_DEPTH:
            raise UnsupportedQuery("groups are nested too deep")
        self.take("{")
        g = Group()
        while not self.maybe("}"):
            word = self.upper()
            if word == ".":
                self.at += 1
            elif word in ("SERVICE", "GRAPH", "SELECT", "EXISTS"):
                raise UnsupportedQuery(f"{word} isn't supported")
            elif word == "OPTIONAL":
                self.at += 1
                g.optionals.append(self.group(depth + 1))
            elif word == "MINUS":
                self.at += 1
                g.minuses.append(self.group(depth + 1))
            elif word == "FILTER":
                self.at += 1
                g.filters.append(self.condition())
            elif word == "BIND":
                self.at += 1
                self.take("(")
                e = self.expression()
                self.take("AS")
                g.binds.append((e, self.term().text))
                self.take(")")
            elif word == "VALUES":
                self.at += 1
                g.values.append(self.inline())
            elif word == "{":
                arms = [self.group(depth + 1)]
                while self.maybe("UNION"):
                    arms.append(self.group(depth + 1))
                if len(arms) > 1:
                    g.unions.append(arms)
                else:
                    g.groups += arms
            else:
                s, p = self.term(), self.term()
                path = ""
                if self.peek() in ("+", "*") or (self.peek() == "?" and p.kind != "var"):
                    path = self.next()[1]
                    if p.kind == "var":
                        raise UnsupportedQuery("a path needs a predicate")
                g.triples.append((s, p, self.term(), path))
                if self.peek() in (";", ","):
                    raise UnsupportedQuery("predicate lists aren't supported")
        return g

    def inline(self) -> tuple[list[str], list[list[Term | None]]]:
        def cell() -> Term | None:
            return None if self.maybe("UNDEF") else self.term()

        names, rows = [], []
        if self.maybe("("):
            while not self.maybe(")"):
                names.append(self.term().text)
            self.take("{")
            while not self.maybe("}"):
                self.take("(")
                row = []
                while not self.maybe(")"):
                    row.append(cell())
                if len(row) != len(names):
                    raise UnsupportedQuery("a row of VALUES has another length")
                rows.append(row)
        else:
            names.append(self.term().text)
            self.take("{")
            while not self.maybe("}"):
                rows.append([cell()])
        return names, rows

    def condition(self, depth: int = 0):
        if depth > MAX_DEPTH:
            raise UnsupportedQuery("a filter is nested too deep")
        left = self.atom(depth)
        while self.peek() in ("&&", "||"):
            op = self.next()[1]
            left = (op, left, self.atom(depth))
        return left

    def atom(self, depth: int):
        word = self.upper()
        if word == "!":
            raise UnsupportedQuery("! isn't supported")
        if self.maybe("("):
            c = self.condition(depth + 1)
            self.take(")")
            return c
        if word in ("REGEX", "CONTAINS", "BOUND"):
            self.at += 1
            self.take("(")
            args = [self.term()]
            while self.maybe(","):
                args.append(self.term())
            self.take(")")
            return (word, *args)
        left, op, right = self.term(), self.next()[1], self.term()
        if op not in ("=", "!=", "<", "<=", ">", ">="):
            raise UnsupportedQuery(f"operator {op}")
        return ("cmp", op, left, right)

    def expression(self, depth: int = 0):
        if depth > MAX_DEPTH:
            raise UnsupportedQuery("an expression is nested too deep")

        def one():
            if self.maybe("("):
                e = self.expression(depth + 1)
                self.take(")")
                return e
            if self.upper() in ("CONCAT", "STR"):
                f = self.next()[1].upper()
                self.take("(")
                args = [self.expression(depth + 1)]
                while self.maybe(","):
                    args.append(self.expression(depth + 1))
                self.take(")")
                return (f, *args)
            return self.term()

        left = one()
        while self.peek() in ("+", "-", "*", "/"):
            left = (self.next()[1], left, one())
        return left


def parse(text: str) -> Query:
    return Parser(text).query()


@dataclass
class Rel:
    """Solutions: columns ``v_x`` (printed) and ``n_x`` (number) of each variable; ``bound`` says which are never null."""

    df: DataFrame | None  # None is the one empty solution
    bound: dict[str, bool]


def _cols(names) -> list[str]:
    return [c for x in names for c in (f"v_{x}", f"n_{x}")]


def _rename(r: Rel, names, tag: str) -> DataFrame:
    return r.df.withColumnsRenamed({c: c + tag for c in _cols(names)})


def join(a: Rel, b: Rel, how: str = "inner") -> Rel:
    """Natural join on the shared variables, where an unbound one agrees with anything."""
    if a.df is None:
        return b
    if b.df is None:
        return a
    shared = [x for x in a.bound if x in b.bound]
    right = _rename(b, shared, "_r")
    conds = []
    for x in shared:
        same = F.col(f"v_{x}") == F.col(f"v_{x}_r")
        if not (a.bound[x] and b.bound[x]):
            same = same | F.col(f"v_{x}").isNull() | F.col(f"v_{x}_r").isNull()
        conds.append(same)
    df = a.df.join(right, reduce(Column.__and__, conds), how) if conds else a.df.crossJoin(right) if how == "inner" else a.df.join(right, F.lit(True), how)
    merged = {}
    for x in shared:
        if not a.bound[x]:
            merged |= {c: F.coalesce(F.col(c), F.col(f"{c}_r")) for c in _cols([x])}
    names = [*a.bound, *(x for x in b.bound if x not in a.bound)]
    df = df.select(*[(merged[c] if c in merged else F.col(c)).alias(c) for c in _cols(names)])
    return Rel(df, {x: a.bound.get(x, False) or (how == "inner" and b.bound.get(x, False)) for x in names})


class Compiler:
    def __init__(self, graph: Graph):
        self.graph = graph

    def scan(self, s: Term, p: Term, o: Term) -> Rel:
        t = self.graph.triples(None if p.kind == "var" else p.text)
        seen: dict[str, str] = {}
        cond, cols = [], []
        for term, c in ((s, "s"), (p, "p"), (o, "o")):
            if term.kind != "var":
                if c != "p":
                    cond.append(F.col(c) == term.text)
            elif term.text in seen:
                cond.append(F.col(c) == F.col(seen[term.text]))
            else:
                seen[term.text] = c
                cols += [F.col(c).alias(f"v_{term.text}"), (F.col("n") if c == "o" else values.number(F.col(c))).alias(f"n_{term.text}")]
        for c in cond:
            t = t.filter(c)
        if not cols:  # nothing to bind: one solution for each match
            return Rel(t.select(F.lit(True).alias("hit")), {})
        return Rel(t.select(*cols), {x: True for x in seen})

    def path(self, s: Term, p: Term, o: Term, kind: str) -> Rel:
        pairs = self.graph.triples(p.text).select(F.col("s").alias("a"), F.col("o").alias("b")).distinct()
        if kind in ("+", "*"):
            reach = closure(pairs, s.text if s.kind != "var" else None, o.text if o.kind != "var" and s.kind == "var" else None)
        else:
            reach = pairs
        if kind in ("*", "?"):
            nodes = pairs.select(F.col("a").alias("x")).union(pairs.select("b"))
            for t in (s, o):
                if t.kind != "var":
                    nodes = nodes.union(self.graph.spark.createDataFrame([(t.text,)], "x string"))
            reach = reach.union(nodes.distinct().select("x", F.col("x").alias("y"))).distinct()
        if s.kind != "var":
            reach = reach.filter(F.col("a") == s.text)
        if o.kind != "var":
            reach = reach.filter(F.col("b") == o.text)
        if s.kind == o.kind == "var" and s.text == o.text:
            reach, o = reach.filter("a = b"), Term("lit", "")
        names = {t.text: c for t, c in ((s, "a"), (o, "b")) if t.kind == "var"}
        if not names:
            return Rel(reach.select(F.lit(True).alias("hit")), {})
        return Rel(reach.select(*[x for v, c in names.items() for x in (F.col(c).alias(f"v_{v}"), values.number(F.col(c)).alias(f"n_{v}"))]), {v: True for v in names})

    def inline(self, names: list[str], rows: list) -> Rel:
        data = [tuple(None if c is None else c.text for c in r) for r in rows]
        df = self.graph.spark.createDataFrame(data, ", ".join(f"v_{x} string" for x in names))
        df = df.select(*[c for x in names for c in (F.col(f"v_{x}"), values.number(F.col(f"v_{x}")).alias(f"n_{x}"))])
        return Rel(df, {x: all(r[i] is not None for r in rows) for i, x in enumerate(names)})

    def group(self, g: Group) -> Rel:
        rel = Rel(None, {})
        for s, p, o, kind in self.ordered(g.triples):
            rel = join(rel, self.path(s, p, o, kind) if kind else self.scan(s, p, o))
        for sub in g.groups:
            rel = join(rel, self.group(sub))
        for arms in g.unions:
            rel = join(rel, self.union([self.group(a) for a in arms]))
        for names, rows in g.values:
            rel = join(rel, self.inline(names, rows))
        for e, name in g.binds:
            base = rel.df if rel.df is not None else self.graph.spark.range(1).select()
            s, n = self.value(e, rel)
            rel = Rel(base.withColumns({f"v_{name}": s, f"n_{name}": n}), rel.bound | {name: False})
        for sub in g.optionals:
            if rel.df is None:
                rel = Rel(self.graph.spark.range(1).select(F.lit(True).alias("hit")), {})
            rel = join(rel, self.group(sub), "left")
        for sub in g.minuses:
            rel = self.minus(rel, self.group(sub))
        for c in g.filters:
            if rel.df is not None:
                rel = Rel(rel.df.filter(self.condition(c, rel)), rel.bound)
        return rel

    @staticmethod
    def ordered(triples: list) -> list:
        """Patterns with constants first, then those that share a variable with what came before, so that no product arises where a join is possible."""
        left, out, seen = list(triples), [], set()

        def variables(t) -> set[str]:
            return {x.text for x in t[:3] if x.kind == "var"}

        while left:
            best = min(left, key=lambda t: (bool(seen) and not (variables(t) & seen), len(variables(t)), triples.index(t)))
            left.remove(best)
            seen |= variables(best)
            out.append(best)
        return out

    @staticmethod
    def union(arms: list[Rel]) -> Rel:
        names = list(dict.fromkeys(x for a in arms for x in a.bound))
        parts = [a.df.select(*[(F.col(c) if c in a.df.columns else F.lit(None).cast("string" if c[0] == "v" else "double")).alias(c) for c in _cols(names)]) for a in arms]
        return Rel(reduce(DataFrame.unionByName, parts), {x: all(a.bound.get(x, False) for a in arms) for x in names})

    @staticmethod
    def minus(a: Rel, b: Rel) -> Rel:
        shared = [x for x in a.bound if x in b.bound]
        if not shared:
            return a
        right = _rename(b, shared, "_r").select(*[f"v_{x}_r" for x in shared])
        if all(a.bound[x] and b.bound[x] for x in shared):
            return Rel(a.df.join(right, reduce(Column.__and__, [F.col(f"v_{x}") == F.col(f"v_{x}_r") for x in shared]), "left_anti"), a.bound)
        both = [F.col(f"v_{x}").isNotNull() & F.col(f"v_{x}_r").isNotNull() for x in shared]
        same = [F.col(f"v_{x}").isNull() | F.col(f"v_{x}_r").isNull() | (F.col(f"v_{x}") == F.col(f"v_{x}_r")) for x in shared]
        return Rel(a.df.join(right, reduce(Column.__or__, both) & reduce(Column.__and__, same), "left_anti"), a.bound)

    def operand(self, t: Term, rel: Rel) -> tuple[Column, Column]:
        """A missing variable compares as the string null and as 0."""
        if t.kind == "var":
            if t.text not in rel.bound:
                return F.lit("null"), F.lit(0.0)
            s = F.col(f"v_{t.text}")
            if rel.bound[t.text]:
                return s, F.col(f"n_{t.text}")
            return F.coalesce(s, F.lit("null")), F.when(s.isNull(), 0.0).otherwise(F.col(f"n_{t.text}"))
        return F.lit(t.text), values.number(F.lit(t.text))

    def condition(self, c, rel: Rel) -> Column:
        if c[0] in ("&&", "||"):
            a, b = self.condition(c[1], rel), self.condition(c[2], rel)
            return a & b if c[0] == "&&" else a | b
        if c[0] == "BOUND":
            return F.col(f"v_{c[1].text}").isNotNull() if c[1].text in rel.bound else F.lit(False)
        if c[0] == "cmp":
            return values.ordered(c[1], *self.operand(c[2], rel), *self.operand(c[3], rel))
        s = self.operand(c[1], rel)[0]
        if c[0] == "CONTAINS":
            return s.contains(self.operand(c[2], rel)[0])
        pattern, flags = c[2].text, c[3].text if len(c) > 3 else ""
        if len(pattern) > MAX_PATTERN or re.search(r"[+*}]\)*[+*{]|\([^()]*[+*][^()]*\)[+*{]", pattern):
            return F.lit(False)
        try:
            re.compile(pattern)
        except re.error:
            return F.lit(False)
        return (F.length(s) <= MAX_INPUT) & s.rlike(("(?i)" if "i" in flags else "") + pattern)

    def value(self, e, rel: Rel) -> tuple[Column, Column]:
        if isinstance(e, Term):
            if e.kind == "var" and e.text not in rel.bound:
                return F.lit(None).cast("string"), F.lit(None).cast("double")
            if e.kind == "var":
                return F.col(f"v_{e.text}"), F.col(f"n_{e.text}")
            return F.lit(e.text), values.number(F.lit(e.text))
        args = [self.value(x, rel) for x in e[1:]]
        if e[0] == "CONCAT":
            s = F.concat(*[F.coalesce(a[0], F.lit("")) for a in args])
            return s, values.number(s)
        if e[0] == "STR":
            return args[0]
        a, b = args[0][1], args[1][1]
        n = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[e[0]]()
        return values.printed(n, "double"), n


def closure(pairs: DataFrame, start: str | None = None, stop: str | None = None) -> DataFrame:
    """(a, b): b is reached from a in one step or more.  Semi-naive rounds, each written, until nothing is new; from one end where that is given."""
    forward = stop is None
    step = pairs if forward else pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    fix = start if start is not None else stop
    reach = session.cut(step if fix is None else step.filter(F.col("a") == fix))
    new, parts = reach, [reach]
    for _ in range(MAX_ROUNDS):
        grown = new.select("a", F.col("b").alias("m")).join(step.select(F.col("a").alias("m"), "b"), "m").select("a", "b").distinct()
        new = session.cut(grown.join(reduce(DataFrame.union, parts), ["a", "b"], "left_anti"))
        if new.limit(1).count() == 0:
            out = reduce(DataFrame.union, parts)
            return out if forward else out.select(F.col("b").alias("a"), F.col("a").alias("b"))
        parts.append(new)
        if len(parts) > 8:
            parts = [session.cut(reduce(DataFrame.union, parts))]
    raise RuntimeError(f"a path is longer than {MAX_ROUNDS} steps")


def _aggregate(rel: Rel, q: Query) -> DataFrame:
    out = []
    for f, unique, arg, name in q.aggregates:
        if arg is None:
            out.append(F.count("*").alias(name))
            continue
        s, n = F.col(f"v_{arg}"), F.when(F.col(f"v_{arg}").isNotNull(), F.coalesce(F.col(f"n_{arg}"), F.lit(float("nan"))))
        if f == "COUNT":
            out.append((F.count_distinct(s) if unique else F.count(s)).alias(name))
        elif f in ("SUM", "AVG"):
            out.append(F.coalesce(({("SUM", False): F.sum, ("SUM", True): F.sum_distinct}.get((f, unique)) or F.avg)(n) if not (f == "AVG" and unique) else F.expr(f"avg(distinct n_{arg})"), F.lit(0.0)).alias(name))
        else:
            out.append(F.coalesce((F.min_by if f == "MIN" else F.max_by)(s, F.struct(F.col(f"n_{arg}"), s)), F.lit("0")).alias(name))
    keys = [F.coalesce(F.col(f"v_{x}"), F.lit("")).alias(x) if x in rel.bound else F.lit("").alias(x) for x in q.group_by]
    return rel.df.groupBy(*keys).agg(*out) if keys else rel.df.agg(*out)


def run(graph: Graph, text: str) -> DataFrame:
    """The query as one lazy DataFrame, a column for each variable; CONSTRUCT gives (s, p, o, is_iri).

    An unbound variable is null.  With aggregates the columns are the grouping variables and then the aggregates.
    """
    q = parse(text)
    c = Compiler(graph)
    rel = c.group(q.where)
    if rel.df is None:
        rel = Rel(graph.spark.range(1).select(F.lit(True).alias("hit")), {})
    if q.template is not None:
        def cell(t: Term) -> Column:
            return F.lit(t.text) if t.kind != "var" else F.col(f"v_{t.text}") if t.text in rel.bound else F.lit(None).cast("string")

        rows = F.array(*[F.struct(cell(s).alias("s"), cell(p).alias("p"), cell(o).alias("o"), F.lit(o.kind == "iri").alias("is_iri")) for s, p, o in q.template])
        return rel.df.select(F.explode(rows).alias("t")).select("t.*").filter("s is not null and p is not null and o is not null")
    if q.aggregates or q.group_by:
        out = _aggregate(rel, q)
        kinds = dict(out.dtypes)
        keys = [k for x, down in q.order_by if x in kinds for k in values.sort_keys(F.col(f"`{x}`").cast("string"), values.number(F.col(f"`{x}`"), kinds[x]), down)]
        out = out.orderBy(*keys) if keys else out
    else:
        names = list(rel.bound) if q.select is None else q.select
        keys = [k for x, down in q.order_by if x in rel.bound for k in values.sort_keys(F.col(f"v_{x}"), F.col(f"n_{x}"), down)]
        chosen = [(F.col(f"v_{x}") if x in rel.bound else F.lit(None).cast("string")).alias(x) for x in names]
        if q.distinct and keys:  # one sort, after the rows are few
            ranked = rel.df.select(*chosen, F.struct(*[F.lit(0)]).alias("z_"), *[F.col(k) for x, _ in q.order_by if x in rel.bound for k in _cols([x])])
            one = ranked.groupBy(*[f"`{x}`" for x in names]).agg(*[F.min(k).alias(k) for k in dict.fromkeys(k for x, _ in q.order_by if x in rel.bound for k in _cols([x]))])
            out = one.orderBy(*keys).select(*[f"`{x}`" for x in names])
        else:
            df = rel.df.orderBy(*keys) if keys else rel.df
            out = df.select(*chosen)
            out = out.distinct() if q.distinct else out
    if q.offset:
        out = out.offset(q.offset)
    return out.limit(q.limit) if q.limit is not None else out

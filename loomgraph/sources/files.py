"""Files as graph tables: CSV nodes and edges, KGTK and ConceptNet and ATOMIC edges, Turtle, S-expressions and bundles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.model import EdgeTable, NodeTable

RELATIONS = {"/r/IsA": "IsA", "/r/RelatedTo": "RelatedTo", "/r/Synonym": "Synonym", "/r/PartOf": "PartOf", "/r/UsedFor": "UsedFor", "mw:SameAs": "SameAs", "/r/Causes": "Causes"}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted commas, line feeds and doubled quotes; blank rows dropped; every cell a string, empty ones null."""
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path)


def csv_nodes(df: DataFrame, id_col: str = "id", labels: tuple[str, ...] = (), label_col: str | None = None, props: list[str] | None = None) -> NodeTable:
    """Rows without id are skipped; the label column's value is added to the fixed labels."""
    keep = props if props is not None else [c for c in df.columns if c not in (id_col, label_col)]
    fixed = F.array(*map(F.lit, labels)) if labels else F.expr("cast(array() as array<string>)")
    own = F.array_distinct(F.array_compact(F.concat(fixed, F.array(F.col(label_col))))) if label_col else fixed
    return NodeTable(df.filter(F.col(id_col).isNotNull() & (F.col(id_col) != "")).select(F.col(id_col).alias("id"), own.alias("labels"), *keep))


def csv_edges(df: DataFrame, src: str = "src", dst: str = "dst", label: str | None = None, label_col: str | None = None, props: list[str] = ()) -> DataFrame:
    """(label, src, dst, props...): rows without an end or a label are skipped; the label column wins over the fixed label."""
    own = F.coalesce(F.col(label_col), F.lit(label)) if label_col else F.lit(label)
    return df.select(own.alias("label"), F.col(src).alias("src"), F.col(dst).alias("dst"), *props).filter("label is not null and src is not null and dst is not null").dropDuplicates(["label", "src", "dst"])


def edge_tables(edges: DataFrame, labels: list[str]) -> list[EdgeTable]:
    return [EdgeTable(x, edges.filter(F.col("label") == x).drop("label")) for x in labels]


def cell_list(c: Column) -> Column:
    """A multi-valued cell: split at |, empty values dropped, distinct, in byte order."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: x != "")))


def relation_name(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, c), F.regexp_replace(c, "^/r/", ""))


def label_of_id(c: Column) -> Column:
    """/c/en/rain/n is rain; prefix:name is name."""
    parts = F.split(c, "/")
    return F.when(c.startswith("/c/"), F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(4)), c), "_", " ")).otherwise(F.regexp_replace(c, "^[A-Za-z0-9]+:", ""))


def truth_of_weight(w: Column) -> Column:
    w = F.when(w.isNull() | F.isnan(w) | (w <= 0), 1.0).otherwise(w.cast("double"))
    return F.struct(F.lit(1.0).alias("strength"), F.least(F.lit(1.0), w / (w + 1)).alias("confidence"))


def read_kgtk(spark: SparkSession, path: str) -> DataFrame:
    """(id, node1, relation, node2, labels..., source, sentence, truth); rows without an end or relation are skipped."""
    df = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    df = df.filter("node1 is not null and relation is not null and node2 is not null and node1 <> '' and node2 <> '' and relation <> ''")
    lists = [c for c in df.columns if ";" in c or c in ("source", "sentence")]
    weight = F.col("weight").try_cast("double") if "weight" in df.columns else F.lit(None).cast("double")
    ident = F.when(F.coalesce(F.col("id"), F.lit("")) != "", F.col("id")).otherwise(F.concat_ws("-", "node1", "relation", "node2"))
    return df.select(ident.alias("id"), F.col("node1"), relation_name(F.col("relation")).alias("relation"), F.col("node2"), *[cell_list(F.col(f"`{c}`")).alias(c.replace(";", "_")) for c in lists], truth_of_weight(weight).alias("truth"))


def read_conceptnet(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("sep", "\t").option("quote", "").schema("uri string, rel string, start string, end string, meta string").csv(path).filter("start is not null and end is not null and rel is not null")
    w = F.coalesce(F.get_json_object("meta", "$.weight").try_cast("double"), F.lit(1.0))
    return df.select(F.col("uri").alias("id"), F.col("start").alias("node1"), relation_name(F.col("rel")).alias("relation"), F.col("end").alias("node2"), F.lit("CN").alias("source"), truth_of_weight(w).alias("truth"))


def read_atomic(spark: SparkSession, path: str) -> DataFrame:
    """Head, relation, tail; empty tails and ``none`` are dropped."""
    df = spark.read.option("sep", "\t").option("quote", "").schema("node1 string, relation string, node2 string, weight double").csv(path)
    return df.filter("node2 is not null and trim(node2) not in ('', 'none')").select("node1", "relation", "node2", F.lit("AT").alias("source"), truth_of_weight(F.col("weight")).alias("truth"))


# Turtle

_TTL = re.compile(r'\s+|#[^\n]*|(?P<iri><[^<>"\s]*>)|(?P<long>"""(?:[^"\\]|\\.|"(?!""))*""")|(?P<str>"(?:[^"\\\n]|\\.)*")|(?P<lang>@[a-zA-Z][\w-]*)|(?P<dt>\^\^)|(?P<num>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>\w[\w-]*:(?=\s)|(?:_:)?[\w.-]*[\w-]?:?[\w%.-]*[\w%-]|\w*:)|(?P<op>[.;,()\[\]])')
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def parse_turtle(text: str, base: str = "") -> list[tuple[str, str, str, bool]]:
    """(s, p, o, is_iri) of Turtle: prefixes, predicate and object lists, blank nodes, collections, long strings; a bad statement is skipped to its end."""
    toks, at = [], 0
    while at < len(text):
        m = _TTL.match(text, at)
        if not m:
            at += 1
            continue
        if m.lastgroup:
            toks.append((m.lastgroup, m[0]))
        at = max(m.end(), at + 1)
    out: list[tuple[str, str, str, bool]] = []
    prefix: dict[str, str] = {}
    pos, blank = 0, 0

    def fresh() -> str:
        nonlocal blank
        blank += 1
        return f"_:b{blank}"

    def peek() -> str:
        return toks[pos][1] if pos < len(toks) else ""

    def term(depth: int = 0) -> tuple[str, bool]:
        nonlocal pos
        if depth > 512 or pos >= len(toks):
            raise ValueError("too deep, or cut off")
        kind, x = toks[pos]
        pos += 1
        if kind == "iri":
            x = x[1:-1]
            return (x if re.match(r"\w+:", x) else base + x), True
        if kind in ("str", "long"):
            s = x[3:-3] if kind == "long" else x[1:-1]
            s = re.sub(r"\\(u[0-9A-Fa-f]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), s)
            if pos < len(toks) and toks[pos][0] == "lang":
                pos += 1
            elif pos < len(toks) and toks[pos][0] == "dt":
                pos += 2
            return s, False
        if kind == "num":
            return x, False
        if x == "a":
            return RDF + "type", True
        if x in ("true", "false"):
            return x, False
        if kind == "name" and ":" in x:
            if x.startswith("_:"):
                return x, True
            p, _, rest = x.partition(":")
            return prefix.get(p, p + ":") + rest, True
        if x == "[":
            node = fresh()
            if peek() != "]":
                predicates(node, depth + 1)
            if peek() != "]":
                raise ValueError("a bracket isn't closed")
            pos += 1
            return node, True
        if x == "(":
            items = []
            while peek() != ")":
                items.append(term(depth + 1))
            pos += 1
            head = RDF + "nil"
            for o, iri in reversed(items):
                node = fresh()
                out.append((node, RDF + "first", o, iri))
                out.append((node, RDF + "rest", head, True))
                head = node
            return head, True
        raise ValueError(f"no term: {x}")

    def predicates(s: str, depth: int = 0) -> None:
        nonlocal pos
        while peek() not in (".", "]", ""):
            p, _ = term(depth)
            while True:
                o, iri = term(depth)
                out.append((s, p, o, iri))
                if peek() != ",":
                    break
                pos += 1
            while peek() == ";":
                pos += 1

    while pos < len(toks):
        begin, had = pos, len(out)
        try:
            if peek().lower() in ("@prefix", "prefix"):
                prefix[toks[pos + 1][1].rstrip(":")] = toks[pos + 2][1][1:-1]
                pos += 3
            elif peek().lower() in ("@base", "base"):
                base = toks[pos + 1][1][1:-1]
                pos += 2
            else:
                predicates(term()[0])
            if peek() == ".":
                pos += 1
        except (ValueError, IndexError):
            del out[had:]
            while pos < len(toks) and peek() != ".":
                pos += 1
            pos = max(pos + 1, begin + 1)
    return out


def read_turtle(spark: SparkSession, path: str, separator: str | None = None, base: str = "") -> DataFrame:
    """(s, p, o, is_iri).  With a separator the file is read in blocks, each parsed by itself with the prefixes of its own block, over all executors."""
    from pyspark.sql.functions import pandas_udf

    reader = spark.read.option("lineSep", separator) if separator else spark.read.option("wholetext", True)
    text = reader.text(path)

    @pandas_udf("array<struct<s:string,p:string,o:string,is_iri:boolean>>")
    def parsed(x):
        return x.map(lambda t: [{"s": a, "p": b, "o": c, "is_iri": d} for a, b, c, d in parse_turtle(t, base)])

    return text.select(F.explode(parsed("value")).alias("t")).select("t.*")


# bundles


def read_bundle(lines: DataFrame) -> dict[str, DataFrame]:
    """Tables of a tab-separated bundle (N id type, C parent child, R type src dst, A id anchor, K id var value grade); any bad line or unknown id raises."""
    t = lines.filter(F.length(F.trim("value")) > 0).select(F.split("value", "\t").alias("f"), "value")
    need = {"N": 3, "C": 3, "R": 4, "A": 3, "K": 5}
    size = F.create_map(*[F.lit(x) for kv in need.items() for x in kv])
    bad = t.filter(F.coalesce(F.try_element_at(size, F.col("f")[0]), F.lit(-1)) != F.size("f")).select("value").first()
    if bad:
        raise ValueError(f"bad line: {bad[0]!r}")

    def part(verb: str, *names: str) -> DataFrame:
        return t.filter(F.col("f")[0] == verb).select(*[F.col("f")[i + 1].alias(n) for i, n in enumerate(names)])

    out = {"nodes": part("N", "id", "type"), "contains": part("C", "parent", "child"), "relations": part("R", "type", "src", "dst"), "anchors": part("A", "id", "anchor"), "claims": part("K", "id", "var", "value", "grade").withColumns({"value": F.col("value").cast("double"), "grade": F.col("grade").cast("int")})}
    used = out["contains"].select("parent").union(out["contains"].select("child")).union(out["relations"].select("src")).union(out["relations"].select("dst")).union(out["anchors"].select("id")).union(out["claims"].select("id"))
    lost = used.toDF("id").join(out["nodes"], "id", "left_anti").first()
    if lost:
        raise ValueError(f"unknown node: {lost[0]!r}")
    return out

"""Profiling, recommendation, shapes, uncertain inference, attention, admissibility and content manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import session
from loomgraph.functions import values
from loomgraph.model import EdgeTable, Graph, NodeTable
from loomgraph.operators.retrieval import reciprocal_rank_fusion
from pyspark.sql import Window


def profile_class(graph: Graph, label: str) -> DataFrame:
    """(kind, key, coverage, count, distinct_values) of the properties, out-edges and in-edges of a label's nodes, by coverage."""
    ids = graph.nodes(label).select("id")
    total = ids.agg(F.count("*").alias("total"))
    parts = []
    for t in graph.node_tables:
        if t.labels is None or label in t.labels:
            for p in t.properties:
                df = t.df if t.labels is not None else t.df.filter(F.array_contains("labels", label))
                parts.append(df.filter(F.col(f"`{p}`").isNotNull()).select(F.lit("property").alias("kind"), F.lit(p).alias("key"), "id", values.printed(F.col(f"`{p}`"), t.kind(p)).alias("value")))
    e = graph.edges()
    parts.append(e.join(ids, F.col("src") == F.col("id"), "left_semi").select(F.lit("out").alias("kind"), F.col("label").alias("key"), F.col("src").alias("id"), F.col("dst").alias("value")))
    parts.append(e.join(ids, F.col("dst") == F.col("id"), "left_semi").select(F.lit("in").alias("kind"), F.col("label").alias("key"), F.col("dst").alias("id"), F.col("src").alias("value")))
    rows = reduce(DataFrame.union, parts)
    out = rows.groupBy("kind", "key").agg(F.count_distinct("id").alias("have"), F.count("*").alias("count"), F.count_distinct("value").alias("distinct_values"))
    return out.crossJoin(F.broadcast(total)).select("kind", "key", (F.col("have") / F.col("total")).alias("coverage"), "count", "distinct_values").orderBy(F.col("coverage").desc(), "key")


def keys_of(graph: Graph) -> DataFrame:
    """(id, kind, key): the property names (kind property) and the types of the out-edges and in-edges of each node."""
    parts = [t.df.filter(F.col(f"`{p}`").isNotNull()).select("id", F.lit("property").alias("kind"), F.lit(p).alias("key")) for t in graph.node_tables for p in t.properties]
    e = graph.edges()
    parts += [e.select(F.col(end).alias("id"), F.lit(kind).alias("kind"), F.col("label").alias("key")) for end, kind in (("src", "out"), ("dst", "in"))]
    return reduce(DataFrame.union, parts).distinct()


def recommend_attributes(graph: Graph, label: str, least: float = 0.2, k: int = 10) -> DataFrame:
    """(kind, key, peer_coverage, own_coverage, score), the k best: attributes that peers have more often than the label's nodes.

    Peers are nodes of other labels that share an attribute with some node of the label; the score is
    peer_coverage * (1 - own_coverage), ties by key.
    """
    ids = graph.nodes(label).select("id").distinct()
    every = session.cut(keys_of(graph).join(graph.nodes().select("id").distinct(), "id", "left_semi"))
    own = every.join(ids, "id", "left_semi")
    peers = session.cut(every.join(own.select("kind", "key").distinct(), ["kind", "key"], "left_semi").select("id").distinct().join(ids, "id", "left_anti"))
    n = peers.agg(F.count("*").alias("peers")).crossJoin(ids.agg(F.count("*").alias("own")))
    have = every.join(peers, "id", "left_semi").groupBy("kind", "key").agg(F.count("*").alias("p")).join(own.groupBy("kind", "key").agg(F.count("*").alias("o")), ["kind", "key"], "left").crossJoin(F.broadcast(n))
    pc, oc = F.col("p") / F.col("peers"), F.coalesce(F.col("o"), F.lit(0)) / F.col("own")
    out = have.select("kind", "key", pc.alias("peer_coverage"), oc.alias("own_coverage"), (pc * (1 - oc)).alias("score"))
    return out.filter((F.col("peer_coverage") >= least) & (F.col("own_coverage") < F.col("peer_coverage"))).orderBy(F.col("score").desc(), "key").limit(k)


def rank_attributes(graph: Graph, label: str, rank: DataFrame, least: float = 0.2) -> DataFrame:
    """(key, score): recommendations ranked by coverage, by the trust (``rank``: id, rank) of the peers that have them, and by expected gain, fused."""
    rec = session.cut(recommend_attributes(graph, label, least))
    trust = keys_of(graph).join(rec.select("kind", "key"), ["kind", "key"], "left_semi").join(rank, "id").groupBy("key").agg(F.avg("rank").alias("trust"))
    r = rec.join(trust, "key", "left").fillna({"trust": 0.0})

    def place(c: str) -> DataFrame:
        return r.select(F.col("key").alias("id"), F.row_number().over(Window.orderBy(F.col(c).desc(), "key")).alias("place"))

    return reciprocal_rank_fusion([place("peer_coverage"), place("trust"), place("score")]).select(F.col("id").alias("key"), "score").orderBy(F.col("score").desc(), "key")


# shapes


def validate(graph: Graph, shapes: list[dict]) -> DataFrame:
    """(focus, path, value, constraint, shape) of each violation.

    A shape is {name, target: label or subjects_of: predicate, properties: [{path, min_count, max_count, datatype,
    node_kind, pattern, in, has_value, min_inclusive, max_inclusive, min_length}]}.  Each property is one grouped pass over
    the triples of its path, for all its constraints together.
    """
    out = []
    for s in shapes:
        focus = graph.nodes(s["target"]).select(F.col("id").alias("focus")) if "target" in s else graph.triples(s["subjects_of"]).select(F.col("s").alias("focus"))
        focus = focus.distinct()
        for p in s["properties"]:
            t = graph.triples(p["path"]).select(F.col("s").alias("focus"), "o", "n", "is_iri")
            joined = focus.join(t, "focus", "left")
            if {"min_count", "max_count", "has_value"} & p.keys():
                count = joined.groupBy("focus").agg(F.count("o").alias("c"), F.max((F.col("o") == str(p.get("has_value"))).cast("int")).alias("has"))
                for c, bad in (("min_count", lambda: F.col("c") < p["min_count"]), ("max_count", lambda: F.col("c") > p["max_count"]), ("has_value", lambda: F.coalesce(F.col("has"), F.lit(0)) == 0)):
                    if c in p:
                        out.append(count.filter(bad()).select("focus", F.lit(p["path"]).alias("path"), F.lit(None).cast("string").alias("value"), F.lit(c).alias("constraint"), F.lit(s["name"]).alias("shape")))
            o, n = F.col("o"), F.col("n")
            checks: dict[str, Column] = {}
            if "min_inclusive" in p:
                checks["min_inclusive"] = n.isNull() | (n < p["min_inclusive"])
            if "max_inclusive" in p:
                checks["max_inclusive"] = n.isNull() | (n > p["max_inclusive"])
            if "pattern" in p:
                checks["pattern"] = ~o.rlike(p["pattern"])
            if "min_length" in p:
                checks["min_length"] = F.length(o) < p["min_length"]
            if "in" in p:
                checks["in"] = ~o.isin([str(x) for x in p["in"]])
            if "node_kind" in p:
                checks["node_kind"] = F.col("is_iri") != F.lit(p["node_kind"] == "iri")
            if "datatype" in p:
                checks["datatype"] = {"integer": ~o.rlike(r"^[+-]?\d+$"), "decimal": n.isNull(), "boolean": ~o.isin("true", "false"), "string": F.lit(False), "date": ~o.rlike(r"^\d{4}-\d\d-\d\d")}[p["datatype"]]
            if checks:
                failed = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))
                out.append(joined.filter("o is not null").select("focus", F.lit(p["path"]).alias("path"), F.col("o").alias("value"), F.explode(failed).alias("constraint"), F.lit(s["name"]).alias("shape")))
    return reduce(DataFrame.unionByName, out)


def apply_rules(graph: Graph, rules: list[str]) -> tuple[Graph, DataFrame]:
    """The graph with what CONSTRUCT rules add, and the added triples (s, p, o, is_iri).

    Every rule reads the given graph.  Triples with an IRI become edges of their predicate, the others (literals and bound
    variables) properties; what the graph has already isn't added again.  A rule that makes ``sh:result`` is one for
    validation and is skipped.
    """
    from loomgraph.plans import sparql

    result = F.col("p").isin("sh:result", "http://www.w3.org/ns/shacl#result")
    each = [sparql.run(graph, r).select("s", "p", "o", "is_iri") for r in rules]
    each = [x for x in each if x.filter(result).limit(1).count() == 0]
    if not each:
        return graph, graph.triples().select("s", "p", "o", "is_iri").limit(0)
    made = reduce(DataFrame.unionByName, each).distinct()
    new = session.cut(made.join(graph.triples().select("s", "p", "o", "is_iri"), ["s", "p", "o", "is_iri"], "left_anti"))
    nodes, edges = list(graph.node_tables), list(graph.edge_tables)
    for p, iri in sorted((r.p, r.is_iri) for r in new.select("p", "is_iri").distinct().toLocalIterator()):  # predicates of the rules' templates
        part = new.filter((F.col("p") == p) & (F.col("is_iri") == iri))
        if iri:
            edges.append(EdgeTable(p, part.select(F.col("s").alias("src"), F.col("o").alias("dst"))))
        else:
            nodes.append(NodeTable(part.select(F.col("s").alias("id"), F.col("o").alias(p)), ()))
    return Graph(graph.spark, nodes, edges), new


# uncertain inference


def revise(beliefs: DataFrame, gain: float = 1.05) -> DataFrame:
    """One belief a (src, dst).

    Two or more of a pair are revised to the strength weighted by confidence and the confidence 1 - product(1 - c), at
    most .99, if that beats the strength or the confidence of the strongest by ``gain``; else the strongest stays.
    """
    c, s = F.col("confidence"), F.col("strength")
    total = F.sum(c)
    g = beliefs.groupBy("src", "dst").agg(
        F.count("*").alias("n"), F.max(F.struct(s.alias("s"), c.alias("c"))).alias("best"), F.when(total > 0, F.sum(s * c) / total).alias("s"),
        F.least(F.lit(0.99), 1 - F.when(F.max(c) >= 1, 0.0).otherwise(F.exp(F.sum(F.log(F.when(c < 1, 1 - c)))))).alias("c"),
    )
    s = F.coalesce("s", "best.s")
    better = (F.col("n") > 1) & ((s > F.col("best.s") * gain) | (F.col("c") > F.col("best.c") * gain))
    return g.select("src", "dst", F.when(better, F.least(s, F.lit(1.0))).otherwise(F.col("best.s")).alias("strength"), F.when(better, F.col("c")).otherwise(F.col("best.c")).alias("confidence"))


def deduce(beliefs: DataFrame, least: float = 0.3) -> DataFrame:
    """(src, dst, strength, confidence) of a -> c from a -> b -> c: s = s1 s2, c = .9 c1 c2; of each pair the strongest derivation, where it is stronger than what is known."""
    a = beliefs.select("src", F.col("dst").alias("m"), F.col("strength").alias("s1"), F.col("confidence").alias("c1"))
    b = beliefs.select(F.col("src").alias("m"), "dst", F.col("strength").alias("s2"), F.col("confidence").alias("c2"))
    d = a.join(b, "m").filter("src <> dst").select("src", "dst", (F.col("s1") * F.col("s2")).alias("strength"), (0.9 * F.col("c1") * F.col("c2")).alias("confidence"))
    best = d.filter(F.col("strength") >= least).groupBy("src", "dst").agg(F.max(F.struct("strength", "confidence")).alias("b")).select("src", "dst", "b.strength", "b.confidence")
    known = beliefs.groupBy("src", "dst").agg(F.max("strength").alias("known"))
    return best.join(known, ["src", "dst"], "left").filter("known is null or strength > known").drop("known")


def forward_chain(beliefs: DataFrame, rounds: int = 80, least: float = 0.3, abduction: bool = True) -> DataFrame:
    """(src, dst, strength, confidence, rule): revision, deduction in rounds over all pairs at once until none is new or stronger, then abduction.

    No bound on how many are derived: at the fixpoint a pair has its strongest chain, whatever the order.
    """
    now = session.cut(revise(beliefs).withColumn("rule", F.lit("given")))
    for _ in range(rounds):
        new = session.cut(deduce(now, least).withColumn("rule", F.lit("deduction")))
        if new.limit(1).count() == 0:
            break
        both = now.unionByName(new).groupBy("src", "dst").agg(F.max(F.struct("strength", "confidence", "rule")).alias("b"))
        now = session.cut(both.select("src", "dst", "b.*"))
    if abduction:
        now = now.unionByName(abduce(now, least=least).select(F.col("a").alias("src"), F.col("b").alias("dst"), "strength", "confidence", F.lit("abduction").alias("rule")))
    return now


def abduce(beliefs: DataFrame, shared: int = 3, strong: float = 0.55, least: float = 0.3) -> DataFrame:
    """(a, b, shared, strength, confidence) of unlinked pairs a < b that both point strongly at ``shared`` targets or more: .4 of the squares of the least strength and confidence among those edges.

    All pairs of a target's sources meet, so a target of many sources is costly.
    """
    e = beliefs.filter(F.col("strength") >= strong).select("src", "dst", "strength", "confidence")
    x = e.select(F.col("src").alias("a"), "dst", F.col("strength").alias("sa"), F.col("confidence").alias("ca"))
    y = e.select(F.col("src").alias("b"), "dst", F.col("strength").alias("sb"), F.col("confidence").alias("cb"))
    pairs = x.join(y, "dst").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"), F.min(F.least("sa", "sb")).alias("s"), F.min(F.least("ca", "cb")).alias("c")).filter(F.col("shared") >= shared)
    linked = beliefs.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    out = pairs.join(linked, ["a", "b"], "left_anti").select("a", "b", "shared", (F.col("s") * F.col("s") * 0.4).alias("strength"), (F.col("c") * F.col("c") * 0.4).alias("confidence"))
    return out.filter(F.col("strength") >= least)


def promote_merges(proposals: DataFrame, least: float = 0.7) -> DataFrame:
    """(src, dst, confidence) of RELATED_TO edges from merge proposals of at least that confidence, the surest of each pair."""
    return proposals.filter(F.col("confidence") >= least).groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))


def consolidate(beliefs: DataFrame, proposals: DataFrame, attention: DataFrame, rate: float = 0.85) -> dict[str, DataFrame]:
    """One pass of forgetting and inference.

    ``beliefs`` (src, dst, strength, confidence, age_days) lose confidence with age; promoted ``proposals`` (src, dst,
    confidence) join them; then they are chained.  Gives ``related``, ``beliefs``, ``attention`` decayed, and ``promoted``,
    the ids of lasting importance.
    """
    aged = decay_confidence(beliefs, "age_days", rate).select("src", "dst", "strength", "confidence")
    related = session.cut(promote_merges(proposals))
    chained = forward_chain(aged.unionByName(related.select("src", "dst", F.col("confidence").alias("strength"), "confidence")))
    return {"related": related, "beliefs": chained, "attention": decay_attention(attention, rate), "promoted": attention.filter(F.col("vlti") | (F.col("lti") >= 700)).select("id")}


def decay_confidence(df: DataFrame, age_days: str, rate: float = 0.85, grace: int = 14, floor: float = 0.1) -> DataFrame:
    """Confidence falls by ``rate`` a day after the grace, never below the floor; younger edges keep theirs."""
    late = F.col(age_days) - grace
    return df.withColumn("confidence", F.when(late > 0, F.greatest(F.lit(floor), F.col("confidence") * F.pow(F.lit(rate), late))).otherwise(F.col("confidence")))


# attention

CAP, SHARE, SPREAD, FIRST = 1000.0, 0.65, 0.4, 12


def stimulate(attention: DataFrame, amounts: DataFrame) -> DataFrame:
    """(id, sti, lti, vlti): short-term importance rises up to 1000, a tenth of the stimulus goes to long term; very long term from 700 on."""
    j = attention.join(amounts.groupBy("id").agg(F.sum("amount").alias("amount")), "id", "left").fillna({"amount": 0.0})
    sti = F.least(F.lit(CAP), F.col("sti") + F.col("amount"))
    lti = F.least(F.lit(CAP), F.col("lti") + 0.1 * F.col("amount"))
    return j.select("id", sti.alias("sti"), lti.alias("lti"), (F.col("vlti") | (lti >= 700)).alias("vlti"))


def spread_attention(attention: DataFrame, edges: DataFrame, least: float = 20.0) -> DataFrame:
    """Each node of importance ``least`` or more gives .65 x .4 of it to each of its first twelve neighbours (by id) of each edge type, all at once."""
    hot = attention.filter(F.col("sti") >= least).select(F.col("id").alias("src"), "sti")
    rank = F.row_number().over(Window.partitionBy("src", "label").orderBy("dst"))
    near = edges.join(hot, "src").withColumn("r", rank).filter(F.col("r") <= FIRST)
    give = near.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("sti") * SHARE * SPREAD).alias("got"))
    return attention.join(give, "id", "left").select("id", F.when(F.col("got").isNull(), F.col("sti")).otherwise(F.least(F.lit(CAP), F.col("sti") + F.col("got"))).alias("sti"), "lti", "vlti")


def decay_attention(attention: DataFrame, rate: float = 0.85, floor: float = 100.0) -> DataFrame:
    """Importance falls by the rate; what is important in the very long term stays at the floor at least.  Nodes without importance stay so."""
    s = F.col("sti") * rate
    return attention.withColumn("sti", F.when(F.col("sti") <= 0, F.col("sti")).when(F.col("vlti"), F.greatest(F.lit(floor), s)).otherwise(s))


# claims

def admit(claims: DataFrame, scopes: list[str], relevance: float = 0.2, depth: int = 2, trust: float = 0.1, allow_opinion: bool = True, exceptions: list[tuple[str, Column]] = (), policy: Column | None = None) -> DataFrame:
    """Adds ``admitted``, ``weight``, ``excluded_at`` (the gate, or null) and ``exception`` (what let hearsay pass, or null).

    Gates in turn: relevance (below the floor; unscored is relevant), hearsay (a chain deeper than ``depth``, unless it is a
    business record, an admission, or one of ``exceptions``, pairs of a name and a condition), opinion (model-generated
    claims, if not allowed; else they weigh half), credibility (trust below the floor; unmeasured is unimpeached),
    privilege (a scope that isn't held) and discretion (``policy``, a condition that must hold).  Columns: relevance,
    chain_depth, signed_connector, source_kind, source_trust, visibility_scope.
    """
    no_scope = F.expr("cast(array() as array<string>)")
    known = [("business-record", F.coalesce(F.col("signed_connector"), F.lit(False))), ("admission", F.coalesce(F.col("source_kind") == "attested", F.lit(False))), *exceptions]
    deep = F.coalesce(F.col("chain_depth"), F.lit(0)) > depth
    exception = F.when(deep, F.coalesce(*[F.when(c, F.lit(n)) for n, c in known]))
    opinion = F.coalesce(F.col("source_kind") == "model-generated", F.lit(False))
    held = F.array(*map(F.lit, scopes)) if scopes else no_scope
    gate = (
        F.when(F.col("relevance") < relevance, "relevance").when(deep & exception.isNull(), "hearsay").when(opinion if not allow_opinion else F.lit(False), "opinion")
        .when(F.col("source_trust") < trust, "credibility").when(F.size(F.array_except(F.coalesce(F.col("visibility_scope"), no_scope), held)) > 0, "privilege")
    )
    if policy is not None:
        gate = gate.when(~F.coalesce(policy, F.lit(False)), "discretion")
    out = claims.withColumns({"excluded_at": gate, "exception": exception})
    passed = F.col("excluded_at").isNull()
    # a gate before hearsay ends the chain, so no exception was needed
    return out.withColumns({"admitted": passed, "weight": F.when(passed, F.when(opinion, 0.5).otherwise(1.0)).otherwise(0.0), "exception": F.when(passed | ~F.col("excluded_at").isin("relevance", "hearsay"), F.col("exception"))})


# content manifests

MODULI = (5, 7, 17, 19)


def manifest(c: Column) -> Column:
    """A struct of a text's facets: letter sum, place-weighted letter sum, spaces' gaps, (letters, words), residues and a digest."""
    low = F.lower(c)
    letters = F.filter(F.split(low, ""), lambda x: (x >= "a") & (x <= "z") & (F.length(x) == 1))
    codes = F.transform(letters, lambda x: F.ascii(x) - 96)
    total = F.aggregate(codes, F.lit(0), lambda a, x: a + x)
    weighted = F.aggregate(F.transform(codes, lambda x, i: x * (i + 1)), F.lit(0), lambda a, x: a + x)
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    gaps = F.transform(F.regexp_extract_all(F.trim(c), F.lit(r"\s+"), 0), lambda w: F.length(w))
    return F.struct(total.alias("gematria"), weighted.alias("sequence"), gaps.alias("spacing"), F.array(F.size(letters), F.size(words)).alias("structure"), F.array(*[total % m for m in MODULI]).alias("residue"), F.substring(F.sha2(c.cast("binary"), 256), 1, 16).alias("digest"))


def syndrome(before: Column, after: Column) -> Column:
    """The facets in which two manifests differ."""
    return F.array_compact(F.array(*[F.when(before[f] != after[f], F.lit(f)) for f in ("gematria", "sequence", "spacing", "structure", "residue", "digest")]))


def mask(c: Column, key: str) -> Column:
    """AES-GCM of a value, wrapped so that masked ones are recognised."""
    return F.concat(F.lit("{#"), F.base64(F.aes_encrypt(c, F.lit(key), F.lit("GCM"))), F.lit("#}"))


def unmask(c: Column, key: str) -> Column:
    inner = F.regexp_extract(c, r"^\{#(.*)#\}$", 1)
    return F.when(inner != "", F.aes_decrypt(F.unbase64(inner), F.lit(key), F.lit("GCM")).cast("string")).otherwise(c)


def decide(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """Adds ``effect``: deny overrides allow; without a matching policy (null fields match all) it is deny.

    Policies: (effect, subject, action, resource); few, so broadcast if the optimizer's estimate allows.
    """
    p = policies.select("effect", *[F.col(c).alias(f"p_{c}") for c in ("subject", "action", "resource")])
    cond = reduce(Column.__and__, [F.col(f"p_{c}").isNull() | (F.col(f"p_{c}") == F.col(c)) for c in ("subject", "action", "resource")])
    keyed = requests.withColumn("row_", F.monotonically_increasing_id())
    keyed = session.cut(keyed)
    hit = keyed.join(p, cond).groupBy("row_").agg(F.max((F.col("effect") == "deny").cast("int")).alias("deny"))
    return keyed.join(hit, "row_", "left").withColumn("effect", F.when(F.col("deny") == 0, "allow").otherwise("deny")).drop("row_", "deny")


def advance(states: DataFrame, model: DataFrame, event: str = "event") -> DataFrame:
    """One step of a finite-state lifecycle: (id, state, event) by the table (state, event, next); without a transition the state stays."""
    return states.join(model.withColumnRenamed("event", event), ["state", event], "left").select("id", F.coalesce("next", "state").alias("state"), F.col("next").isNotNull().alias("moved"))


def type_ancestors(sub_class: DataFrame, entities: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, type): the first ancestors of each entity's class that are among the roots; nothing beyond a root is climbed.

    ``sub_class`` (sub, sup), ``entities`` (id, class), ``roots`` (class).
    """
    front = session.cut(entities.select("id", F.col("class").alias("c")).distinct())
    found, seen = [], front
    for _ in range(1000):
        hit = front.join(roots.select(F.col("class").alias("c")), "c", "left_semi")
        found.append(hit.select("id", F.col("c").alias("type")))
        up = front.join(roots.select(F.col("class").alias("c")), "c", "left_anti").join(sub_class.withColumnRenamed("sub", "c"), "c").select("id", F.col("sup").alias("c")).distinct()
        front = session.cut(up.join(seen, ["id", "c"], "left_anti"))
        if front.limit(1).count() == 0:
            return reduce(DataFrame.union, found).distinct()
        seen = session.cut(seen.unionByName(front))
    raise RuntimeError("the class hierarchy is too deep")

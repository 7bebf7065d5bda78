"""Entities of texts: ordered patterns with confidences, their kinds and topics, the mention graph and co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_IN, _NOT_IN = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: (name, pattern, group, confidence, least and most characters), in order of precedence.  Group -1 is the match without its first and last character.
PATTERNS = [
    ("quoted", r"\"[^\"]{2,80}\"|'[^']{2,80}'", -1, 0.9, 0, 80),
    ("code", r"`([^`]{2,60})`", 1, 0.85, 0, 60),
    ("path", r"(?m)(?:^|\s)((?:[~.]/|/)[^\s,;:'\"(){}\[\]]{3,80})", 1, 0.8, 0, 90),
    ("camel", _IN + r"[A-Z][a-z]+(?:[A-Z][a-z]+)+" + _NOT_IN, 0, 0.75, 0, 60),
    ("snake", _IN + r"[a-z][a-z0-9]*(?:[_-][a-z][a-z0-9]+){1,8}" + _NOT_IN, 0, 0.7, 6, 60),
    ("phrase", _IN + r"[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){1,4}" + _NOT_IN, 0, 0.65, 0, 80),
]
#: Mentions of a text that are paired.
FIRST = 20
TOPICS = {
    "ENGINEER": "algorithm api async benchmark branch build bun c++ cache cd ci class cli commit complexity coverage database deno deploy docker endpoint function git go index interface java javascript k8s kubernetes lint memory merge middleware migration mysql nextjs node pipeline postgres promise python query react redis repo runtime rust schema sdk spec swift tailwind terraform test thread type typecheck typescript vite webhook webpack",
    "RESEARCHER": "ablation accuracy arxiv attention baseline benchmark citation dataset doi embedding evaluation experiment f1 gradient hypothesis inference layer loss model neural paper precision recall sota training transformer vector weight",
    "SECURITY_RESEARCHER": "afl aslr authentication authorization backdoor bypass canary certificate cipher ctf cve escalation exploit fuzzing hash heap injection malware mitm overflow payload pentest pie privilege ransomware rop sanitizer shellcode signature sqli ssl stack tls vulnerability xss",
    "HEALTH": "biomarker clinical cpt diagnosis dosage drug ehr fhir genomics hipaa icd medication patient phenotype phi protocol symptom therapy treatment trial",
}
KINDS = [
    (r"^[~/.]|\.(ts|js|py|rs|go|json|yaml|md|sh|txt)$|^https?://", "RECORD"),
    (r"^[A-Z][a-z]+ [A-Z][a-z]+$", "PERSON"),
    (r"(?i)(engineer|researcher|developer|manager|analyst|scientist|architect|founder|cto|ceo|vp|director)$", "ROLE"),
    (r"(?i)(inc\.?|llc\.?|corp\.?|ltd\.?|company|organization|foundation)$", "ORG"),
]


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalised(c: Column) -> Column:
    return F.regexp_replace(F.lower(trimmed(c)), r"\s+", " ")


def kind_of(surface: Column) -> Column:
    """The first class whose pattern fits: record, person, role, organisation, else a feature."""
    return F.coalesce(*[F.when(surface.rlike(p), k) for p, k in KINDS], F.lit("FEATURE_ATOM"))


def topics_of(surface: Column) -> Column:
    """The topics, sorted, whose vocabulary has one of the words; CITIZEN where none has."""
    words = F.split(F.lower(surface), r"[\s\-_./\\()\[\]{},;:'\"!?<>@#$%^&*+=|~`]+")
    hit = [F.when(F.arrays_overlap(words, F.array(*map(F.lit, v.split()))), F.lit(k)) for k, v in sorted(TOPICS.items())]
    found = F.array_compact(F.array(*hit))
    return F.when(F.size(found) == 0, F.array(F.lit("CITIZEN"))).otherwise(found)


def _mention(rule: int, group: int, confidence: float):
    def f(x: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), (F.substring(x, F.lit(2), F.length(x) - 2) if group < 0 else x).alias("surface"), F.lit(confidence).alias("confidence"))

    return f


def _sized(low: int, high: int):
    return lambda x: F.length(x).between(low, high)


def extract(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, entity, surface, kind, topics, confidence, place): of a text's mentions the first of each normalised form of three characters or more, in order of precedence, then of the text."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = F.concat(*[F.transform(F.filter(F.regexp_extract_all(t, F.lit(p), max(g, 0)), _sized(lo, hi + 2 * (g < 0))), _mention(k, g, c)) for k, (_, p, g, c, lo, hi) in enumerate(PATTERNS)])
    m = df.select(F.col(f"`{id_col}`").alias("id"), F.posexplode(found).alias("at", "m")).select("id", "at", "m.*").withColumn("entity", normalised(F.col("surface"))).filter(F.length("entity") >= 3)
    one = m.groupBy("id", "entity").agg(F.min(F.struct("at", trimmed(F.col("surface")).alias("surface"), "confidence")).alias("b")).select("id", "entity", "b.*")
    return one.select("id", "entity", "surface", kind_of(F.col("surface")).alias("kind"), topics_of(F.col("surface")).alias("topics"), "confidence", F.row_number().over(Window.partitionBy("id").orderBy("at")).alias("place"))


def atom_id(entity: Column) -> Column:
    """The id of a normalised entity."""
    return F.concat(F.lit("urn:feature-atom:"), F.substring(F.regexp_replace(entity, "[^a-z0-9]", "-"), 1, 80))


def atoms(mentions: DataFrame) -> DataFrame:
    """(id, entity, kind, confidence, topics, mentions): the entities' nodes, upserted in the order of the texts' ids: the last mention's values, the union of all topics."""
    m = mentions.select(atom_id(F.col("entity")).alias("atom"), "id", "place", "entity", "kind", "confidence", "topics")
    last = F.max(F.struct("id", "place", "entity", "kind", "confidence")).alias("l")
    g = m.groupBy("atom").agg(last, F.array_sort(F.array_distinct(F.flatten(F.collect_set("topics")))).alias("topics"), F.count("*").alias("mentions"))
    return g.select(F.col("atom").alias("id"), "l.entity", "l.kind", "l.confidence", "topics", "mentions")


def mentioned_in(mentions: DataFrame) -> DataFrame:
    """(src, dst, confidence): each entity to the texts that mention it."""
    return mentions.groupBy(atom_id(F.col("entity")).alias("src"), F.col("id").alias("dst")).agg(F.max_by("confidence", "place").alias("confidence"))


def co_occurrence(mentions: DataFrame, first: int = FIRST) -> DataFrame:
    """(src, dst, n): how many texts have both among their first entities, the earlier one as src; at most 190 pairs a text."""
    m = mentions.filter(F.col("place") <= first).select("id", "place", atom_id(F.col("entity")).alias("atom"))
    a, b = m.select("id", F.col("place").alias("p"), F.col("atom").alias("src")), m.select("id", F.col("place").alias("q"), F.col("atom").alias("dst"))
    return a.join(b, "id").filter("p < q").select("id", "src", "dst").distinct().groupBy("src", "dst").agg(F.count("*").alias("n"))

"""Entities typed by reference concepts: labels, vectors and the concepts' upper classes."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.knowledge import type_ancestors
from loomgraph.operators.retrieval import cosine_join

TYPED_AS = "kko:typedAs"


def _tables() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatible decomposition without its accents is one other character, and what it is; and those that give several."""
    a, b, several = [], [], {}
    for x in map(chr, range(0x80, 0xFFFF)):
        if unicodedata.category(x) in ("Cs", "Co", "Cn"):
            continue
        y = "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower()
        if y.isascii() and y != x:
            if len(y) == 1 and y.isalnum():
                a.append(x), b.append(y)
            elif len(y) > 1 and y.isalnum():
                several[x] = y
    return "".join(a), "".join(b), several


_FROM, _TO, _SEVERAL = _tables()


def normal_label(c: Column) -> Column:
    """Lower case, without accents, other characters than ASCII letters and digits as one space.

    Of the characters that decompose to several letters only the ligatures of f are spelled out.
    """
    c = F.regexp_replace(F.lower(c), "[̀-ͯ]", "")
    for x, y in _SEVERAL.items():
        if 0xFB00 <= ord(x) <= 0xFB06:
            c = F.replace(c, F.lit(x), F.lit(y))
    return F.trim(F.regexp_replace(F.translate(c, _FROM, _TO), "[^a-z0-9]+", " "))


def label_index(concepts: DataFrame) -> DataFrame:
    """(label, ids) from (id, pref_label, alt_labels): the concepts of each normal label, by id."""
    names = concepts.select("id", F.explode(F.concat(F.array("pref_label"), F.coalesce("alt_labels", F.expr("cast(array() as array<string>)")))).alias("label"))
    return names.select("id", normal_label(F.col("label")).alias("label")).filter("label <> ''").groupBy("label").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def map_entities(entities: DataFrame, concepts: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(entity, matched, pref_label, candidates, types): the first concept, by id, that has the entity's label; of no match, nulls and 0.

    ``types`` (id, type) are the concepts' upper classes, as of :func:`~loomgraph.operators.knowledge.type_ancestors`.
    """
    found = entities.select("entity", normal_label(F.col("entity")).alias("label")).join(label_index(concepts), "label", "left")
    out = found.select("entity", F.try_element_at("ids", F.lit(1)).alias("matched"), F.coalesce(F.size("ids"), F.lit(0)).alias("candidates"))
    out = out.withColumn("candidates", F.greatest("candidates", F.lit(0))).join(concepts.select(F.col("id").alias("matched"), "pref_label"), "matched", "left")
    if types is not None:
        out = out.join(types.groupBy(F.col("id").alias("matched")).agg(F.array_sort(F.collect_set("type")).alias("types")), "matched", "left")
    else:
        out = out.withColumn("types", F.lit(None).cast("array<string>"))
    return out.select("entity", "matched", "pref_label", "candidates", F.coalesce("types", F.expr("cast(array() as array<string>)")).alias("types"))


def map_entities_by_vector(entities: DataFrame, concepts: DataFrame, least: float = 0.6) -> DataFrame:
    """(entity, matched, via, similarity): the exact label first, else the nearest concept by cosine of at least ``least``.

    Entities have ``entity`` and ``vector``, concepts ``id``, ``pref_label``, ``alt_labels`` and ``vector``; ids are strings.
    """
    exact = map_entities(entities, concepts).select("entity", "matched")
    rest = exact.filter("matched is null").join(entities.select("entity", "vector"), "entity").filter("size(vector) > 0").select(F.concat(F.lit("e:"), "entity").alias("vec_id"), F.col("vector").alias("embedding"))
    pool = concepts.filter("size(vector) > 0").select(F.concat(F.lit("c:"), "id").alias("vec_id"), F.col("vector").alias("embedding"))
    near = cosine_join(rest, pool, 1).filter(F.col("score") >= least).select(F.substring("query", 3, 1 << 30).alias("entity"), F.substring("id", 3, 1 << 30).alias("near"), "score")
    out = exact.join(near, "entity", "left")
    via = F.when(F.col("matched").isNotNull(), "exact").when(F.col("near").isNotNull(), "semantic").otherwise("none")
    return out.select("entity", F.coalesce("matched", "near").alias("matched"), via.alias("via"), F.when(F.col("matched").isNull(), F.col("score")).alias("similarity"))


def typed_as(nodes: DataFrame, concepts: DataFrame) -> DataFrame:
    """(src, dst) of edges ``kko:typedAs`` from nodes (id, name) to the concept that has their name, or their id where it is null."""
    named = nodes.select("id", F.coalesce("name", "id").alias("entity"))
    hit = map_entities(named.select("entity").distinct(), concepts).filter("matched is not null")
    return named.join(hit, "entity").select(F.col("id").alias("src"), F.col("matched").alias("dst"))


def entity_types(typed: DataFrame, sub_class: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, type): the upper classes of entities through their typed edges (src, dst)."""
    return type_ancestors(sub_class, typed.select(F.col("src").alias("id"), F.col("dst").alias("class")), roots)

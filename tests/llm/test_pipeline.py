"""The pipeline against a brute-force version of its stages."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomgraph.llm import common, decontaminate, near_dedup, textvec, toxicity

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_pipeline_matches_brute_force(spark):
    docs = common.table(spark, SF, "documents")
    model = toxicity.fit(docs, common.table(spark, SF, "labels"))
    left = sorted(map(tuple, docs.collect()))
    found, n = toxicity.score_rows(*textvec.column(pa.array([r[1] for r in left])), model)
    left = [r for r, s, k in zip(left, found, n, strict=True) if not s or toxicity.p_value([x for *_, x in s], int(k), model.slope, model.k) >= toxicity.ALPHA]
    first = {}
    for r in left:
        first.setdefault(r[1], r)
    left = sorted(first.values())
    fp, n = near_dedup.fingerprints(pa.array([r[1] for r in left]))
    label = list(range(len(left)))
    for i in range(len(left)):
        for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp).sum(axis=1) <= near_dedup.DISTANCE):
            if n[i] and n[j] and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    left = [r for i, r in enumerate(left) if label[i] == i]
    bench = decontaminate.build([(r[0], r[1]) for r in common.table(spark, SF, "benchmark").collect()])[0]
    leaks = {r for r, *_ in decontaminate.match(*textvec.column(pa.array([r[1] for r in left])), bench)}
    want = sorted(r[0] for i, r in enumerate(left) if i not in leaks)
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == want and 0 < len(want) < docs.count()
    texts = dict(docs.select("doc_id", "text").collect())
    assert all(r.round_trip and r.n_bytes == len(texts[r.doc_id].encode()) for r in out)


def test_stages_keep_columns_and_stand_awkward_input(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    odd = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (None, None, None, None, None), (2, "", "en", "s", 0), (3, "word " * 50_000, "en", "s", 1)]
    clash = {c: F.lit(1) for c in ("fp", "d", "h", "n", "k", "keep", "toxic", "item_id", "token_ids")}
    for df in (spark.createDataFrame(odd, schema).withColumns(clash), spark.createDataFrame([], schema).withColumns(clash)):
        docs = df
        for name, stage in corpus_pipeline.STAGES:
            out = common.materialise(stage(spark, docs, SF))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == df.columns
                docs = out
        assert docs.count() == (4 if df.count() else 0)


def test_planted_cases(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    item = common.table(spark, SF, "benchmark").orderBy("item_id").first()
    base = common.table(spark, SF, "documents")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    new = [(10**6, text, "en", "s", 1), (10**6 + 1, text, "en", "s", 1), (10**6 + 2, text + " again", "en", "s", 1), (10**6 + 3, "Before it. " + item.text + " After.", "en", "s", 1)]
    docs = base.unionByName(spark.createDataFrame(new, base.schema))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, SF))
    got = {r.doc_id for r in docs.collect()}
    assert got - kept == {10**6}

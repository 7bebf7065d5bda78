"""The training-data operators against brute force, exact round trips and held-out accuracy, and on awkward input."""

from __future__ import annotations

import base64
import itertools
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import bpe, chat, common, components, decontaminate, encode, exact_dedup, html, near_dedup, quality, queries, shards, textvec, token_counts, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
random.seed(3)
LONG = " ".join(random.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(random.randrange(50)) for _ in range(60_000))
AWKWARD = [
    (1, "the same text here", "en", "a", 18),
    (1, "the same text here", "en", "a", 18),
    (2, "the same text here", None, "b", None),
    (None, "the same text here", "en", "a", 18),
    (3, None, None, None, None),
    (None, None, "en", "a", 0),
    (4, "", "en", "a", 0),
    (5, "", "en", "a", 0),
    (6, LONG, "en", "a", len(LONG)),
    (7, LONG, "en", "a", len(LONG)),
    (8, "  \n\n \t", "en", "a", 6),
    (9, "ünï çödé 漢字 😀 it's\r\n", "de", "a", 9),
]


def docs(spark, rows=AWKWARD, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in ("d", "t", "fp", "h", "f0", "n", "g", "keep", "token_ids", "quality", "label", "k", "y", "v", "slot")}) if extra else df


def empty(spark):
    return docs(spark, [])


def oracle(sql):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con.sql(sql).df()


def same(df, sql):
    got, want = df.toPandas(), oracle(sql)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


# --- shared machinery


def test_words_and_hashes():
    texts = ["It's Übung 42!", "", "a-b_c", "é"]
    buf, offsets = textvec.column(pa.array(texts))
    h, starts, ends, bounds = textvec.words(buf, offsets)
    got = [bytes(buf[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    assert got == ["It", "s", "Übung", "42", "a", "b_c", "é"]
    assert bounds.tolist() == [0, 4, 4, 6, 7]
    assert h.tolist() == [textvec.word_hash(w) for w in got]
    assert textvec.word_hash("ÜBUNG") == textvec.word_hash("übung")


def test_column_of_slices_and_nulls():
    arr = pa.array(["zz", None, "a", "bc", ""])[1:]
    buf, offsets = textvec.column(arr)
    assert bytes(buf) == b"abc" and offsets.tolist() == [0, 0, 1, 3, 3]


def test_checkpoint_folder_is_the_sessions(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


# --- 1 exact dedup


def test_quotient_filter_merges_without_loss():
    rng = np.random.default_rng(1)
    whole: dict[int, int] = {}
    parts = []
    for size in (0, 1, 50, 3000):
        fps, counts = np.unique(rng.integers(0, 2**64 - 1, size, dtype=np.uint64) >> np.uint64(rng.integers(0, 3)), return_counts=True)
        counts = counts + rng.integers(0, 3, len(fps))
        for f, c in zip(fps.tolist(), counts.tolist(), strict=True):
            whole[f] = whole.get(f, 0) + c
        parts.append(exact_dedup.QuotientFilter.load(exact_dedup.QuotientFilter.build(fps, counts).dump()))
    shared = np.array(sorted(whole)[:100], np.uint64)
    parts.append(exact_dedup.QuotientFilter.build(shared, np.full(len(shared), 70_000)))
    for f in shared.tolist():
        whole[f] += 70_000
    merged = exact_dedup.QuotientFilter.merge(parts)
    fps, counts = merged.entries()
    assert dict(zip(fps.tolist(), counts.tolist(), strict=True)) == whole
    assert merged.count(int(shared[0])) == whole[int(shared[0])] and merged.count(12345) == 0


def test_quotient_filter_crowded_homes_and_large_counts():
    fps = np.sort(np.concatenate([np.arange(500, dtype=np.uint64), np.uint64(2**63) + np.arange(3, dtype=np.uint64)]))
    counts = np.arange(len(fps)) % 7 + 1
    counts[3] = 2**40
    got = exact_dedup.QuotientFilter.load(exact_dedup.QuotientFilter.build(fps, counts).dump()).entries()
    assert got[0].tolist() == fps.tolist() and got[1].tolist() == counts.tolist()


def test_exact_duplicates_match_sql(spark):
    same(queries.op1_exact_dedup(spark, SF), queries.ORACLES["op1_exact_dedup"])


def brute_exact(rows):
    out = []
    for r in rows:
        group = [x for x in rows if x[1] == r[1]] if r[1] is not None else [r]
        ids = [x[0] for x in group if x[0] is not None]
        out.append((r[0], (min(ids) if ids else None) if r[1] is not None else r[0], len(group)))
    return sorted(out, key=repr)


def test_exact_duplicates_awkward(spark, monkeypatch):
    for size in (1 << 20, -1):  # broadcast, and shuffled
        monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", size)
        monkeypatch.setattr(exact_dedup, "REPEATS", 2)
        got = exact_dedup.find_exact_duplicates(docs(spark)).collect()
        assert sorted([(r.doc_id, r.keep_id, r.copies) for r in got], key=repr) == brute_exact(AWKWARD)
        assert sum(r.keep for r in got) == len({r[1] for r in AWKWARD if r[1] is not None}) + 2
        kept = exact_dedup.drop_exact_duplicates(docs(spark))
        assert kept.columns == docs(spark).columns
        texts = [r.text for r in kept.collect()]
        assert sorted(t for t in texts if t is not None) == sorted({r[1] for r in AWKWARD if r[1] is not None}) and texts.count(None) == 2
    assert exact_dedup.find_exact_duplicates(empty(spark)).count() == 0 and exact_dedup.drop_exact_duplicates(empty(spark)).count() == 0


def test_equal_fingerprints_of_other_bytes_stay_apart(spark, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("bigint") if len(c) == 1 else real(*c))
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(["x", "y", "x", "z", "y", "x", None])]
    got = exact_dedup.find_exact_duplicates(docs(spark, rows)).collect()
    assert sorted([(r.doc_id, r.keep_id, r.copies) for r in got], key=repr) == brute_exact(rows)
    assert sorted(str(r.text) for r in exact_dedup.drop_exact_duplicates(docs(spark, rows)).collect()) == ["None", "x", "y", "z"]


# --- 2 decontamination


def brute_template(text):
    out = []
    for m in re.finditer(r"[0-9A-Za-z_\x80-\U0010ffff]+", text):
        w = m[0]
        if w[0].isdigit() and w[0].isascii():
            if out and out[-1][0] == "<number>" and text[m.start() - 1] in ",." and out[-1][2] == m.start() - 1:
                out[-1] = ("<number>", out[-1][1] + text[m.start() - 1] + w, m.end())
                continue
            out.append(("<number>", w, m.end()))
        elif w.lower() in decontaminate.UNITS:
            out.append(("<unit>", w.lower(), m.end()))
        elif re.match(r"[A-ZÀ-ÖØ-Þ]", w):
            out.append(("<name>", w.lower(), m.end()))
        else:
            out.append((w.lower(), w.lower(), m.end()))
    return [(a, b) for a, b, _ in out]


def brute_leaks(texts, items):
    out = []
    n = decontaminate.WINDOW
    for d, text in texts:
        t = brute_template(text or "")
        for i, item in items:
            q = brute_template(item or "")
            size = min(n, len(q))
            places = [p for p in range(len(q) - size + 1) if sum(not a.startswith("<") for a, _ in q[p : p + size]) >= decontaminate.PLAIN] if size >= decontaminate.PLAIN else []
            if not places:
                continue
            shifts = {}
            for p in places:
                for s in range(len(t) - size + 1):
                    if [a for a, _ in t[s : s + size]] == [a for a, _ in q[p : p + size]]:
                        shifts.setdefault(s - p, []).append(p)
            found = set()
            for s, ps in sorted(shifts.items(), key=lambda x: (-len(x[1]), x[0])):
                new = sorted(set(ps) - found)
                own = sorted({p + k for p in new for k in range(size) if q[p + k][0].startswith("<")})
                pairs = {(q[k][1], t[k + s][1]) for k in own}
                if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
                    found.update(new)
            if len(found) >= decontaminate.COVERAGE * len(places):
                out.append((d, i))
    return sorted(out)


ITEM = "Alice has 12 apples and gives 3 apples to Bob while the train travels 1,250.5 km before Alice counts the rest again"
TEXTS = [
    (1, "Intro text. " + ITEM + " and more."),
    (2, "Intro. " + ITEM.replace("Alice", "Carol").replace("12", "77").replace("Bob", "Dave").replace("1,250.5 km", "90 miles")),
    (3, "x " + ITEM.replace("Alice has", "Carol has").replace("Bob", "Dave")),  # Alice is Carol here and Alice there
    (4, "the train travels slowly and someone counts the rest again"),
    (5, ""),
    (6, None),
    (7, "fully unrelated words " * 40),
]


def test_leaks_by_template(spark):
    items = [(1, ITEM), (2, None), (3, ""), (4, "short item of five words"), (5, "Only Names Here And There Are Capital Letters"), (6, ITEM)]
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in TEXTS] + [(8, "so this short item of five words is here", "en", "s", 0)], SCHEMA).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.find_leaks(df, bench).collect()
    want = brute_leaks([*TEXTS, (8, "so this short item of five words is here")], items)
    assert sorted((r.doc_id, r.item_id) for r in got) == want
    assert {(1, 1), (2, 1), (1, 6), (8, 4)} <= set(want) and all(d not in (4, 5, 6, 7) for d, _ in want)
    changed = {(r.doc_id, r.item_id): r.changed_slots for r in got}
    assert changed[1, 1] == 0 and changed[2, 1] >= 5
    kept = decontaminate.drop_leaks(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == ({d for d, _ in TEXTS} | {8}) - {d for d, _ in want}


def test_leaks_in_passes_are_the_same(spark):
    items = [(i, t) for i, t in enumerate(oracle("select text from benchmark order by item_id").text)]
    one, many = decontaminate.build(items), decontaminate.build(items, limit=100)
    assert len(one) == 1 and len(many) > 3
    buf, offsets = textvec.column(pa.array(oracle("select text from documents").text.tolist()))
    first = {(r, one[0].items[i].ident) for r, i, *_ in decontaminate.match(buf, offsets, one[0])}
    assert first == {(r, b.items[i].ident) for b in many for r, i, *_ in decontaminate.match(buf, offsets, b)} and first


def test_leaks_on_given_tables_match_brute_force(spark):
    texts = [tuple(r) for r in oracle("select doc_id, text from documents").itertuples(index=False)]
    items = [tuple(r) for r in oracle("select item_id, text from benchmark").itertuples(index=False)]
    bench = common.table(spark, SF, "benchmark")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(common.table(spark, SF, "documents"), bench).collect()}
    assert got == set(brute_leaks_indexed(texts, items)) and got >= {(d, i) for d, t in texts for i, q in items if q in t}
    registered = {(r.doc_id, r.item_id) for r in queries.op2_decontaminate(spark, SF).collect()}
    assert registered >= got


def brute_leaks_indexed(texts, items):
    """As brute_leaks over every document and item; only pairs that share no run of canonical tokens at all are passed over."""
    n = decontaminate.WINDOW
    where = {}
    for i, q in items:
        t = [a for a, _ in brute_template(q or "")]
        size = min(n, len(t))
        for p in range(len(t) - size + 1):
            where.setdefault(tuple(t[p : p + size]), set()).add(i)
    sizes = {len(k) for k in where}
    out = []
    for d, text in texts:
        t = [a for a, _ in brute_template(text or "")]
        some = {i for size in sizes for s in range(len(t) - size + 1) for i in where.get(tuple(t[s : s + size]), ())}
        out += brute_leaks([(d, text)], [(i, q) for i, q in items if i in some])
    return sorted(out)


def test_leaks_awkward(spark):
    bench = common.table(spark, SF, "benchmark")
    assert decontaminate.find_leaks(docs(spark), bench).count() == 0
    assert decontaminate.drop_leaks(docs(spark), bench).count() == len(AWKWARD)
    assert decontaminate.find_leaks(empty(spark), bench).count() == 0
    assert decontaminate.find_leaks(docs(spark), bench.limit(0)).count() == 0 and decontaminate.drop_leaks(docs(spark), bench.limit(0)).count() == len(AWKWARD)


# --- 3 chat


def test_chats_match_sql(spark):
    same(queries.op3_chat_format(spark, SF), queries.ORACLES["op3_chat_format"])


def test_chat_round_trip_of_conflicts():
    bits = ["<|im_start|>", "<|im_end|>", "\n", "<\\|", "<\\\\|", "\\", "a", "user", "<", "|", "é"]
    random.seed(0)
    for _ in range(3000):
        turns = [("".join(random.choices(bits, k=random.randint(0, 3))), "".join(random.choices(bits, k=random.randint(0, 6)))) for _ in range(random.randint(0, 4))]
        text, _, ok = chat.format_turns(turns)
        assert ok and chat.parse(text) == turns
    assert chat.parse("<|im_start|>user\nhi") is None and chat.parse("stray") is None
    assert chat.format_turns([("user", "plain")])[1] == 0 and chat.format_turns([("user", "a <|im_end|>\n b")])[1] == 1


def test_chats_awkward(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "user", "<|im_end|>\n<|im_start|>x"), (2, 3, "assistant", LONG), (3, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"c": F.lit(1), "turns": F.lit(2), "r": F.lit(3)})
    out = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert len(out) == 4 and all(r.identical for r in out.values())
    assert chat.parse(out[1].text) == [("", ""), ("user", "a"), ("user", "a")] and out[None].n_escaped == 1
    assert chat.parse(out[2].text)[0][1] == LONG
    assert chat.format_chats(df.limit(0)).count() == 0
    back = chat.parse_chats(chat.format_chats(df)).collect()
    assert len(back) == len(rows)
    con = duckdb.connect()
    con.register("conversations", pa.Table.from_pylist([dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in rows], schema=pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])))
    assert {(r[0], r[1]) for r in con.sql(queries.ORACLES["op3_chat_format"]).fetchall()} == {(r.conv_id, r.text) for r in out.values()}


# --- 4 shards


def test_permutation_is_a_keyed_bijection():
    for n in (1, 2, 3, 5, 64, 65, 1000, 4097):
        one = shards.permute(np.arange(n), n, 42)
        assert sorted(one.tolist()) == list(range(n))
    assert shards.permute(np.arange(1000), 1000, 1).tolist() != shards.permute(np.arange(1000), 1000, 2).tolist()
    assert (shards.permute(np.arange(1000), 1000, 1) == np.arange(1000)).mean() < 0.05


def test_shards_hold_every_sequence_once(spark, tmp_path):
    length, per = 16, 64
    df = common.table(spark, SF, "documents").unionByName(docs(spark, extra=False))
    out = shards.token_shards(df, length=length, per_shard=per)
    rows = sorted(out.collect(), key=lambda r: r.shard)
    coder = bpe.Bpe(encode.VOCABULARY)
    want = []
    for d, text in df.select("doc_id", "text").collect():
        ids, _ = coder.encode_rows(*textvec.column(pa.array([text], pa.string())))
        want += [(d, tuple(ids[a : a + length].tolist())) for a in range(0, len(ids), length)]
    got = []
    for s, r in enumerate(rows):
        assert r.shard == s and r.first_slot == s * per and len(r.payload) == r.n_sequences * r.stride and r.stride == 2 * length
        m = np.frombuffer(r.payload, "<u2").reshape(-1, length)
        for d, n, x in zip(r.doc_ids, r.lengths, m, strict=True):
            assert (x[n:] == shards.PAD).all()
            got.append((d, tuple(x[:n].tolist())))
    assert all(r.n_sequences == per for r in rows[:-1])
    assert sorted(got, key=repr) == sorted(want, key=repr)
    # slot permute(i) holds sequence i of the scan: undoing the permutation gives each document's sequences in a row, in order
    order = [got[x] for x in shards.permute(np.arange(len(got)), len(got), 42)]
    runs = [[x for _, x in run] for _, run in itertools.groupby(order, key=lambda x: x[0])]
    flat = {}
    for d, x in want:
        flat.setdefault(d, []).append(x)
    whole = [run for run, (d, _) in zip(runs, itertools.groupby(order, key=lambda x: x[0]), strict=True) if d is not None and d > 9]
    assert whole == [flat[d] for d, _ in itertools.groupby(order, key=lambda x: x[0]) if d is not None and d > 9] and len(whole) > 100
    again = sorted(shards.token_shards(df, length=length, per_shard=per).collect(), key=lambda r: r.shard)
    assert [bytes(r.payload) for r in again] == [bytes(r.payload) for r in rows]
    files = shards.write_shards(out, str(tmp_path)).collect()
    assert len(files) == len(rows)
    part = shards.read_slots(str(tmp_path), per - 2, 5, length, per)
    assert [tuple(x) for x in part.tolist()] == [tuple(np.frombuffer(rows[x // per].payload, "<u2").reshape(-1, length)[x % per].tolist()) for x in range(per - 2, per + 3)]


def test_shards_awkward(spark):
    assert shards.token_shards(empty(spark)).count() == 0
    rows = shards.token_shards(docs(spark), length=8, per_shard=10**6).collect()
    assert len(rows) == 1 and rows[0].doc_ids.count(1) == 2 and None in rows[0].doc_ids and 3 not in rows[0].doc_ids and 4 not in rows[0].doc_ids


# --- 5 quality


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    transition, start, score = rng.normal(size=(2, 2)), rng.normal(size=2), rng.normal(size=(3, 4))
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]], bool)
    good, pairs, log_z = quality.forward_backward(score, mask, transition, start)
    all_pairs = np.zeros((2, 2))
    for r in range(3):
        n = mask[r].sum()
        z, p = 0.0, np.zeros(4)
        e = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(start[y[0]] + sum(score[r, t] * y[t] for t in range(n)) + sum(transition[y[t - 1], y[t]] for t in range(1, n)))
            z += w
            for t in range(n):
                p[t] += w * y[t]
            for t in range(1, n):
                e[y[t - 1], y[t]] += w
        assert np.allclose(good[r][mask[r]], (p / z)[mask[r]]) and np.isclose(log_z[r], np.log(z))
        all_pairs += e / z
    assert np.allclose(pairs, all_pairs)


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    even = F.col("doc_id") % 2 == 0
    field = quality.fit(d, labels.filter(even))
    out = quality.score_documents(d, field).join(labels.filter(~even).select("doc_id", F.col("quality").alias("y")), "doc_id").toPandas()
    assert (out.good == (out.y == 1)).mean() > 0.9


def test_quality_finds_the_bad_line():
    rng = random.Random(0)
    words = "river stone walked slowly under bright morning sky and then rested near water".split()

    def good():
        return " ".join(rng.choices(words, k=12)).capitalize() + "."

    def bad():
        return "".join(rng.choices("#$%&|*", k=3)).join(rng.choices(words, k=10))

    texts = ["\n".join(good() for _ in range(6)) for _ in range(60)] + ["\n".join(bad() for _ in range(6)) for _ in range(60)]
    texts += ["\n".join((bad if i == j % 5 else good)() for i in range(5)) for j in range(60)]
    x, _, bounds = quality.features(*textvec.column(pa.array(texts)))
    f = quality.train(x, bounds, np.repeat([1, 0, 0], 60))
    lines = [good(), good(), bad(), good(), good()]
    x, _, bounds = quality.features(*textvec.column(pa.array(["\n".join(lines)])))
    p = quality.marginals(f.odds(x, bounds), bounds, f)
    assert p[2] < 0.5 and p[2] == p.min() and p[0] > 0.5 and p[4] > 0.5


def test_the_quality_query_matches_a_plain_chain(spark):
    """Each document for itself, with sums over labellings by logarithms in plain Python."""
    d, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    f = quality.fit(d, labels)

    def add(values):
        top = max(values)
        return top + np.log(sum(np.exp(v - top) for v in values))

    want = {}
    for doc, text in d.select("doc_id", "text").collect():
        x, chars, bounds = quality.features(*textvec.column(pa.array([text], pa.string())))
        odds = f.odds(x, bounds).tolist()
        lines = [t for t in (text or "").split("\n") if t]
        assert len(lines) == len(odds)
        n, p = len(odds), []
        ahead, back = [[0.0, 0.0] for _ in range(n)], [[0.0, 0.0] for _ in range(n)]
        for t in range(n):
            for y in (0, 1):
                ahead[t][y] = odds[t] * y + (f.start[y] if t == 0 else add([ahead[t - 1][u] + f.transition[u, y] for u in (0, 1)]))
        for t in range(n - 2, -1, -1):
            for y in (0, 1):
                back[t][y] = add([f.transition[y, u] + odds[t + 1] * u + back[t + 1][u] for u in (0, 1)])
        for t in range(n):
            both = [ahead[t][y] + back[t][y] for y in (0, 1)]
            p.append(float(np.exp(both[1] - add(both))))
        mean = float(np.dot(p, chars) / chars.sum()) if n else 0.0
        want[doc] = (pytest.approx(mean, abs=1e-9), mean >= quality.THRESHOLD, n, [t for t in range(n) if p[t] < 0.5])
    got = {r.doc_id: (r.quality, r.good, r.n_lines, r.bad_lines) for r in queries.op5_quality(spark, SF).collect()}
    assert got == want and 0 < sum(x[1] for x in got.values()) < len(got)


def test_quality_awkward(spark):
    labels = common.table(spark, SF, "labels")
    f = quality.fit(common.table(spark, SF, "documents"), labels)
    got = quality.score_documents(docs(spark), f)
    rows = got.collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.quality <= 1 for r in rows)
    assert all(r.quality == 0 and not r.good and r.n_lines == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert quality.classify(empty(spark), labels).count() == 0
    none = quality.classify(docs(spark), labels.limit(0)).collect()
    assert len(none) == len(AWKWARD) and {r.quality for r in none if r.n_lines} == {0.5}
    assert quality.classify(docs(spark), spark.createDataFrame([(None, None, None), (1, 1, 0)], "doc_id bigint, quality int, toxic int")).count() == len(AWKWARD)


# --- 6 toxicity


def brute_segments(scores):
    """Maximal segments by the recursive definition, the shortest of equal ones."""
    if not scores or max(scores) <= 0:
        return []
    pre = np.concatenate([[0], np.cumsum(scores)])
    best, at = 0, None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            if pre[b] - pre[a] > best + 1e-9 or (at and pre[b] - pre[a] > best - 1e-9 and b - a < at[1] - at[0]):
                best, at = pre[b] - pre[a], (a, b)
    a, b = at
    return brute_segments(scores[:a]) + [(a, b - 1, best)] + [(x + b, y + b, s) for x, y, s in brute_segments(scores[b:])]


def test_segments_match_the_definition():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.choice([-toxicity.COST] * 4 + [0.25, 0.75, 1.25, 3.0]) for _ in range(rng.randint(0, 25))]
        hot = [i for i, x in enumerate(s) if x > 0]
        got = toxicity.segments(np.array(hot, int), np.array([s[i] for i in hot], float))
        want = brute_segments(s)
        assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_tokens_and_prefixes():
    buf, offsets = textvec.column(pa.array(["größer größte the", "thea"]))
    h, starts, ends, bounds = toxicity.tokens(buf, offsets)
    assert h[0, 1] == h[1, 1] != 0 and h[0, 2] == 0 and h[2, 1] == 0 and h[0, 0] != h[1, 0] and bounds.tolist() == [0, 3, 4] and h[3, 1] == 0


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    even = F.col("doc_id") % 2 == 0
    model = toxicity.fit(d, labels.filter(even))
    out = toxicity.score_documents(d, model).withColumnRenamed("toxic", "found").join(labels.filter(~even), "doc_id").toPandas()
    clean = out[out.toxic == 0]
    assert clean.found.mean() == 0
    insults = re.compile(r"\b(idiot|moron|scum|trash|stupid|loser|clown|pathetic|worthless)\b", re.I)
    texts = dict(d.select("doc_id", "text").collect())
    sure = out[[bool(insults.search(texts[i])) for i in out.doc_id]]
    assert len(sure) > 5 and sure.found.mean() >= 0.9
    passages = [(texts[r.doc_id].encode(), p) for r in sure.itertuples() for p in r.passages]
    assert all(t[p["first_byte"] : p["end_byte"]].strip() for t, p in passages)


def brute_passages(hot):
    """Maximal segments of (token, score) pairs among tokens that cost 1 each, by trying every pair of ends, then both sides."""
    best, at = 0, None
    for x in range(len(hot)):
        total = 0
        for y in range(x, len(hot)):
            total += hot[y][1] - (toxicity.COST * (hot[y][0] - hot[y - 1][0] - 1) if y > x else 0)
            if total > best + 1e-9:
                best, at = total, (x, y)
    if at is None:
        return []
    x, y = at
    return brute_passages(hot[:x]) + [(hot[x][0], hot[y][0], best)] + brute_passages(hot[y + 1 :])


def test_the_toxicity_query_matches_brute_force(spark):
    d, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    model = toxicity.fit(d, labels)
    weight = {int(k): float(model.score[i]) for k, i in zip(model.table.keys, model.table.order, strict=True)}
    want = {}
    for doc, text in d.select("doc_id", "text").collect():
        words = list(re.finditer(r"[0-9A-Za-z_\x80-\U0010ffff]+", text or ""))
        scores = []
        for m in words:
            w = m[0]
            keys = [textvec.word_hash(w)] + [textvec.word_hash(w[:k]) ^ (0x5851F42D4C957F2D * (i + 1) & (2**64 - 1)) for i, k in enumerate(toxicity.PREFIXES) if len(w) > k]
            scores.append(max(0.0, *(weight.get(k, 0.0) for k in keys)))
        found = brute_passages([(i, x) for i, x in enumerate(scores) if x > 0])
        p = toxicity.p_value([x for *_, x in found], len(words), model.slope, model.k) if found else 1.0
        shown = [(len(text[: words[a].start()].encode()), len(text[: words[b].end()].encode()), round(x, 6)) for a, b, x in found if toxicity.p_value([x], len(words), model.slope, model.k) < toxicity.ALPHA]
        want[doc] = (pytest.approx(p, rel=1e-6, abs=1e-12), shown, p < toxicity.ALPHA)
    got = {r.doc_id: (r.p_value, [(q.first_byte, q.end_byte, q.score) for q in r.passages], r.toxic) for r in queries.op6_toxicity(spark, SF).collect()}
    assert got == want and 0 < sum(x[2] for x in got.values()) < len(got)


def test_toxicity_awkward(spark):
    labels = common.table(spark, SF, "labels")
    rows = toxicity.find_toxic(docs(spark), labels).collect()
    assert len(rows) == len(AWKWARD) and not any(r.toxic for r in rows) and all(r.p_value == 1 for r in rows if r.doc_id in (3, 4, 5))
    assert toxicity.find_toxic(empty(spark), labels).count() == 0
    assert not any(r.toxic for r in toxicity.find_toxic(docs(spark), labels.limit(0)).collect())
    kept = toxicity.drop_toxic(docs(spark), labels)
    assert kept.count() == len(AWKWARD) and kept.columns == docs(spark).columns


# --- 7 near dedup


def brute_simhash(text):
    words = {textvec.word_hash(w) for w in re.findall(r"[0-9A-Za-z_\x80-\U0010ffff]+", text or "")}
    return words


def test_simhash_matches_plain_python():
    texts = ["a b c a", "only", "", LONG, "größe Größe GRÖSSE x y z"]
    fp, n = near_dedup.fingerprints(pa.array(texts))
    for i, t in enumerate(texts):
        words = np.array(sorted(brute_simhash(t)), np.uint64)
        assert n[i] == len(words)
        bits = np.concatenate([np.unpackbits(textvec.mix(words + s).view(np.uint8).reshape(-1, 8), axis=1) for s in near_dedup._SEEDS], axis=1) if len(words) else np.zeros((0, 256), int)
        want = np.packbits(2 * bits.sum(axis=0, dtype=int) > len(words)).view(np.uint64)
        assert fp[i].tolist() == want.tolist()


def test_fingerprints_do_not_depend_on_other_rows():
    texts = [*oracle("select text from documents order by doc_id").text.tolist(), "", LONG, "one two three"]
    whole, n = near_dedup.fingerprints(pa.array(texts))
    for parts in (2, 7, len(texts)):
        cuts = np.linspace(0, len(texts), parts + 1).astype(int)
        got = [near_dedup.fingerprints(pa.array(texts[a:b])) for a, b in itertools.pairwise(cuts)]
        assert (np.concatenate([f for f, _ in got]) == whole).all() and (np.concatenate([m for _, m in got]) == n).all()


def test_words_that_differ_in_their_lowest_bits_are_two():
    h = np.array([5 << 40, (5 << 40) + 1, 5 << 40, 9], np.uint64)
    fp, n = near_dedup.simhash(h, np.array([0, 3, 4, 4]))
    assert n.tolist() == [2, 1, 0]
    assert near_dedup.simhash(h[:2], np.array([0, 2]))[0][0].tolist() == fp[0].tolist()


def brute_groups(fp, n, distance=near_dedup.DISTANCE):
    label = list(range(len(fp)))
    pairs = set()
    for i in range(len(fp)):
        d = np.bitwise_count(fp[i] ^ fp).sum(axis=1)
        for j in np.flatnonzero((d <= distance) & (n > 0)):
            if n[i] > 0 and j > i:
                pairs.add((i, int(j)))
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label, pairs


def block_edges(fp, blocks):
    """The edges of the join of all blocks, without Spark."""
    key = np.concatenate([(np.int64(b) << 32) + blocks.value(fp, b).astype(np.int64) for b in range(blocks.n)])
    row = np.tile(np.arange(len(fp)), blocks.n)
    order = np.argsort(key, kind="stable")
    return near_dedup.near_edges(key[order], fp[row[order]], row[order], blocks)


def at_distance(rng, fp, d):
    out = fp.copy()
    for p in rng.permutation(near_dedup.BITS)[:d].tolist():
        out[p // 64] ^= np.uint64(1) << np.uint64(p % 64)
    return out


@pytest.mark.parametrize("distance", [0, 3, 18, 42, 60])
def test_blocks_find_every_pair_within_the_distance(distance):
    rng = np.random.default_rng(distance)
    blocks = near_dedup.Blocks(distance)
    assert blocks.n > distance and sum(blocks.width) == near_dedup.BITS and blocks.start[-1] + blocks.width[-1] == near_dedup.BITS
    fp = rng.integers(0, 2**64 - 1, (400, near_dedup.WORDS), dtype=np.uint64)
    near = np.array([at_distance(rng, f, distance) for f in fp[:200]])
    spread = fp[200].copy()  # an error in as many blocks as there may be
    for b in range(distance):
        spread[blocks.start[b] // 64] ^= np.uint64(1) << np.uint64(blocks.start[b] % 64)
    far = np.array([at_distance(rng, f, distance + 1) for f in fp[201:300]])
    every = np.concatenate([fp, near, [spread], far])
    a, b = block_edges(every, blocks)
    label, pairs = brute_groups(every, np.ones(len(every)), distance)
    assert len(pairs) == 201
    nodes, least = components.join_sets(a, b)
    n = np.bincount(label)
    assert dict(zip(nodes.tolist(), least.tolist(), strict=True)) == {i: x for i, x in enumerate(label) if n[x] > 1}


def test_buckets_and_direct_comparison_find_the_same_pairs():
    rng = np.random.default_rng(5)
    blocks = near_dedup.Blocks(42)
    centre = rng.integers(0, 2**64 - 1, (40, near_dedup.WORDS), dtype=np.uint64)
    fp = np.array([at_distance(rng, c, int(rng.integers(0, 45))) for c in centre for _ in range(20)])
    for b in (0, 20, 42):
        for v in np.unique(blocks.value(fp, b))[:4]:
            rows = fp[blocks.value(fp, b) == v]
            found = [near_dedup.near_in_block(rows, b, blocks, **how) for how in ({"few": 10**6}, {"few": 1}, {"few": 1, "many": 1})]
            sets = [set(map(tuple, np.sort(np.stack(x, axis=1), axis=1).tolist())) for x in found]
            ring = set()
            for x, y in itertools.combinations(range(len(rows)), 2):
                apart = [int(np.bitwise_count(blocks.value(rows[[x]], (b + k) % blocks.n) ^ blocks.value(rows[[y]], (b + k) % blocks.n))[0]) for k in range(blocks.n)]
                if all(t <= blocks.allowed(k + 1) for k, t in enumerate(itertools.accumulate(apart))):
                    ring.add((x, y))
            assert ring <= sets[2] <= sets[1] <= sets[0]  # three blocks sort out more than two
            n = [len(x[0]) for x in found]
            assert n == [len(x) for x in sets]


def test_a_dense_cluster_is_joined_without_its_pairs():
    rng = np.random.default_rng(6)
    blocks = near_dedup.Blocks(42)
    centre = rng.integers(0, 2**64 - 1, (2, near_dedup.WORDS), dtype=np.uint64)
    other = at_distance(rng, centre[0], 70)
    fp = np.array([at_distance(rng, centre[0], int(rng.integers(0, 24))) for _ in range(1500)] + [at_distance(rng, other, int(rng.integers(0, 24))) for _ in range(700)] + [at_distance(rng, centre[1], 60) for _ in range(50)])
    rows = fp[blocks.value(fp, 3) == blocks.value(centre, 3)[0]]
    x, y = near_dedup.near_in_block(rows, 3, blocks)
    assert len(rows) > 512 and len(x) < len(rows) ** 2 / 8
    close = np.zeros((len(fp), len(fp)), np.int64)
    for w in range(near_dedup.WORDS):
        close += np.bitwise_count(fp[:, w, None] ^ fp[None, :, w])
    want = components.join_sets(*np.nonzero(np.triu(close <= blocks.distance, 1)))
    assert [x.tolist() for x in components.join_sets(*block_edges(fp, blocks))] == [x.tolist() for x in want]


def test_near_duplicates_do_not_depend_on_partitions_or_parts(spark):
    rows = [tuple(r) for r in oracle("select doc_id, text, lang, source, n_chars from documents").itertuples(index=False)]
    df = spark.createDataFrame([(int(r[0]), *r[1:4], 1) for r in rows] + AWKWARD, SCHEMA)
    want = sorted(map(repr, near_dedup.find_near_duplicates(df.repartition(1)).select("doc_id", "group_id", "group_size").collect()))
    assert sorted(map(repr, near_dedup.find_near_duplicates(df.repartition(7)).select("doc_id", "group_id", "group_size").collect())) == want
    split = near_dedup.find_near_duplicates(df.repartition(7), part_rows=5)
    assert sorted(map(repr, split.select("doc_id", "group_id", "group_size").collect())) == want


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    rows = [tuple(r) for r in oracle("select doc_id, text, lang, source, n_chars from documents").itertuples(index=False)] + AWKWARD[:-1]
    rows = [(None if r[0] is None else int(r[0]) + (10**6 if i >= len(rows) - 11 else 0), *r[1:4], None) for i, r in enumerate(rows)]
    fp, n = near_dedup.fingerprints(pa.array([r[1] for r in rows], pa.string()))
    label, _ = brute_groups(fp, n)
    want = {}
    for i, g in enumerate(label):
        want.setdefault(g if n[i] else ("alone", i), []).append(rows[i][0])
    for limit in (components.ONE_TASK_EDGES, 0):
        monkeypatch.setattr(components, "ONE_TASK_EDGES", limit)
        monkeypatch.setattr(components.connected_components, "__defaults__", (limit,))
        got = near_dedup.find_near_duplicates(docs(spark, rows)).collect()
        assert len(got) == len(rows)
        groups = {}
        for r in got:
            if r.group_size > 1:
                groups.setdefault(r.group_id, []).append(r.doc_id)
        assert sorted(sorted(v, key=repr) for v in groups.values()) == sorted(sorted(v, key=repr) for v in want.values() if len(v) > 1)
        assert sum(r.keep for r in got) == len(want)
    kept = near_dedup.drop_near_duplicates(docs(spark, rows))
    assert kept.count() == len(want) and kept.columns == docs(spark, rows).columns


def test_near_duplicates_empty(spark):
    assert near_dedup.find_near_duplicates(empty(spark)).count() == 0 and near_dedup.drop_near_duplicates(empty(spark)).count() == 0


def test_components_in_one_task_and_by_joins(spark):
    rng = np.random.default_rng(2)
    pairs = [(i, i + 1) for i in range(60)] + [(int(a) + 100, int(b) + 100) for a, b in rng.integers(0, 200, (150, 2)) if a != b]
    edges = common.materialise(spark.createDataFrame(pairs, "a bigint, b bigint"))
    one, many = (sorted(map(tuple, components.connected_components(edges, n).collect())) for n in (10**6, 0))
    assert one == many and dict(one)[60] == 0


# --- 8 encoding


@pytest.fixture(scope="module")
def coder():
    return bpe.Bpe(encode.VOCABULARY)


@pytest.fixture(scope="module")
def peer():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(encode.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_a_public_encoder(coder, peer):
    rng = random.Random(0)
    bits = list("ab cd's't're'll   \n\n\t'''1 2٣é漢字😀  .,!?-#\r") + ["'ve", "'s", " 's", "I'm", "\x1c", " ", " ", "the quick"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 50))) for _ in range(3000)] + ["", None, "a" * 3000, " " * 700, "#" * 1000 + "abc", "supercalifragilistic" * 4]
    texts += oracle("select text from documents").text.tolist()
    ids, bounds = coder.encode_exact(*textvec.column(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == peer.encode_ordinary(t or "")


def test_parts_of_a_batch_encode_as_the_whole(coder, monkeypatch):
    buf, offsets = textvec.column(pa.array(["", *oracle("select text from documents").text.tolist(), None, LONG, ""]))
    whole = [x.tolist() for x in coder.encode_exact(buf, offsets)]
    for size in (1, 1000, 50_000, 1 << 30):
        monkeypatch.setattr(bpe, "PART", size)
        assert [x.tolist() for x in coder.encode_exact(buf, offsets)] == whole


def test_encode_awkward(spark):
    out = encode.encode_documents(docs(spark))
    rows = out.collect()
    assert len(rows) == len(AWKWARD) and all(r.round_trip for r in rows if r.token_ids is not None)
    assert [r.n_tokens for r in rows if r.doc_id in (4, 5)] == [0, 0] and next(r for r in rows if r.doc_id == 3).token_ids is None
    back = sorted(map(repr, ((r.doc_id, r.text) for r in encode.decode_tokens(out).collect())))
    assert back == sorted(map(repr, ((r[0], r[1]) for r in AWKWARD)))
    assert encode.encode_documents(empty(spark)).count() == 0


def test_equal_hashes_are_told_apart(coder, monkeypatch):
    fresh = bpe.Bpe(encode.VOCABULARY)
    monkeypatch.setattr(bpe.textvec, "span_hashes", lambda buf, s, e: np.zeros(len(s), np.uint64))
    buf, offsets = textvec.column(pa.array(["one two six ten", "abc"]))
    ids, _ = fresh.encode_exact(buf, offsets)
    assert bytes(fresh.decode(ids)) == bytes(buf)


# --- 9 token counts


def test_token_counts_match_brute_force(spark, peer):
    rows = [r for r in AWKWARD if r[1] != LONG] + [(20, "a\n\nb \n  c\n", "en", "s\nt", 1), (21, "tail\n", "", "", 1)]
    for rule in token_counts.RULES:
        got = sorted(map(repr, map(tuple, token_counts.attribute_tokens(docs(spark, rows), rule=rule).collect())))
        want = []
        for r in rows:
            fields = [("source", r[3] or ""), ("lang", r[2] or ""), ("text", r[1] or "")]
            joined = "\n".join(v for _, v in fields)
            cuts, at = [], 0
            for k, (name, v) in enumerate(fields):
                whole = v + ("\n" if k < 2 else "")
                for i, line in enumerate(re.findall(r"[^\n]*\n|[^\n]+", whole)):
                    cuts.append((name, i, at, at + len(line)))
                    at += len(line)
            place = np.cumsum([0] + [len(c.encode()) for c in joined])
            n, over = [0] * len(cuts), [0] * len(cuts)
            pos = 0
            for t in peer.encode_ordinary(joined):
                size = len(peer.decode_single_token_bytes(t))
                parts = [max(0, min(pos + size, place[e]) - max(pos, place[s])) for *_, s, e in cuts]
                hit = [i for i, x in enumerate(parts) if x]
                own = hit[0] if rule == "start" else hit[-1] if rule == "end" else int(np.argmax(parts))
                n[own] += 1
                over[own] += len(hit) > 1
                pos += size
            want += [(r[0], *c, a, b) for c, a, b in zip(cuts, n, over, strict=True)]
        assert got == sorted(map(repr, want))
    assert token_counts.attribute_tokens(empty(spark)).count() == 0
    assert token_counts.attribute_tokens(docs(spark)).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).count() == 10
    with pytest.raises(ValueError):
        token_counts.attribute_tokens(docs(spark), rule="none")


# --- 10 pages


def article(page):
    body = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    import html as plain

    return " ".join(plain.unescape(re.sub("<[^>]+>", " ", body)).split())


def test_pages_on_held_out_pages(spark):
    pages = common.table(spark, "/root/testdata/sf0.01", "pages")
    model = html.fit(pages.filter("page_id % 2 = 0"))
    rows = html.extract(pages, model).join(pages.select("page_id", "html"), "page_id").filter("page_id % 2 = 1").collect()
    assert np.mean([" ".join(r.text.split()) == article(r.html) for r in rows]) > 0.95
    plain = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<(/?)(article|nav|footer)>", "<$1div>"), ' class="ad"', ""))
    rows = html.extract(plain, model).join(pages.select("page_id", "html"), "page_id").filter("page_id % 2 = 1").collect()
    assert np.mean([" ".join(r.text.split()) == article(r.html) for r in rows]) > 0.9


def test_decoding_is_the_best_without_contradiction():
    rng = np.random.default_rng(0)
    page = "<div>aa<p>bb<b>c</b></p><ul><li>d</li><li>ee</li></ul></div><p>f</p>"
    t = html.parse(page)
    n = len(t.tag)
    own = np.zeros(n)
    for i, x in t.pieces:
        own[i] += len(x)
    for _ in range(40):
        p = rng.uniform(0.02, 0.98, n)
        got = html.decode(t, p)
        w = 0.05 + np.log1p(own)
        best = None
        for y in itertools.product((0, 1, 2), repeat=n):  # dropped, kept, open
            if any(t.parent[i] >= 0 and y[t.parent[i]] != 2 and y[i] != y[t.parent[i]] for i in range(n)):
                continue
            v = sum(w[i] * (np.log(p[i]) if y[i] == 1 else np.log(1 - p[i]) if y[i] == 0 else max(np.log(p[i]), np.log(1 - p[i]))) - 0.5 * (y[i] == 2) for i in range(n))
            if best is None or v > best[0]:
                best = (v, y)
        want = [y == 1 or (y == 2 and p[i] > 0.5) for i, y in enumerate(best[1])]
        assert got.tolist() == want


def test_pages_awkward(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "no tags at all"), (3, "u", "no tags at all"), (None, "u", "<p>unclosed <b>bold <i>deep"), (4, "u", "</p></div><br/><script>x<p>"), (5, "u", "<div>" * 3000 + "deep"), (6, "u", "<p class='" + "x" * 100_000 + "'>" + "long text. " * 50_000 + "</p>"), (7, "u", "<!-- open <p>a</p>"), (8, "u", "<a href='>'>t</a> &amp; <"), (9, "u", "<p>a<p>b<li>c<td>d")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"text": F.lit("x"), "h": F.lit(1), "t": F.lit(2)})
    model = html.fit(common.table(spark, SF, "pages"))
    out = html.extract(df, model).collect()
    assert len(out) == len(rows) and next(r for r in out if r.page_id == 1).text is None and next(r for r in out if r.page_id == 2).text == ""
    assert html.extract(df.limit(0), html.fit(df.limit(0))).count() == 0


# --- findings of the first review


def found(spark, items, texts, **how):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    leaks = {(r.doc_id, r.item_id): r.changed_slots for r in decontaminate.find_leaks(df, bench, **how).collect()}
    kept = {r.doc_id for r in decontaminate.drop_leaks(df, bench, **how).collect()}
    assert kept == {d for d, _ in texts} - {d for d, _ in leaks}
    return leaks


def test_copies_of_items_with_few_plain_words_are_found(spark):
    items = [(1, "What is 12 times 7 plus 9"), (2, "Only Names Here And There Are Capital Letters In Titles"), (3, "Add 7")]
    texts = [(1, f"so {items[0][1]}, they asked"), (2, f"a book called {items[1][1]} came"), (3, "What is 13 times 7 plus 9"), (4, "please Add 7 to it"), (5, "add 7"), (6, "Quite Other Names Stand There As Capital Letters Do Too"), (7, "")]
    assert found(spark, items, texts) == {(1, 1): 0, (2, 2): 0, (5, 3): 0}


def test_one_edited_slot_does_not_hide_a_leak(spark):
    question = "Tom has 3 red apples and 4 green apples so how many apples does he have in the basket at home today"
    items = [(1, ITEM), (2, question)]
    texts = [
        (1, "x " + ITEM.replace("Alice has", "Carol has")),  # one of two
        (2, "x " + ITEM.replace("before Alice", "before Carol").replace("12", "13")),
        (3, question.replace("3", "5").replace("4", "5")),  # two numbers become equal
        (4, question),
        (5, "Tom has 3 red apples and a bicycle"),
    ]
    assert found(spark, items, texts, strict=False) == {(1, 1): 0, (2, 1): 1, (3, 2): 2, (4, 2): 0}
    assert found(spark, items, texts).keys() == {(4, 2)}


def test_registered_decontamination_keeps_the_windows_that_agree(spark, tmp_path):
    import corpus_pipeline

    text = ITEM.replace("Alice has", "Carol has")
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, text, "en", "s", 0), (2, "nothing of it", "en", "s", 0)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert [r.doc_id for r in queries.op2_decontaminate(spark, str(tmp_path)).collect()] == [1]
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [r.doc_id for r in corpus_pipeline.remove_leaks(spark, df, str(tmp_path)).collect()] == [2]


def test_copies_of_a_toxic_text_do_not_hide_its_words(spark):
    rng = random.Random(3)
    filler = [f"plain{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    bad = ["blorgish", "snarfed", "grickle", "wumpous"]

    def text(toxic):
        words = rng.choices(filler, k=60)
        for w in bad * (2 * toxic):
            words.insert(rng.randrange(1, len(words)), w)
        return " ".join(words)

    copied = " ".join(w for b in bad for w in (filler[0], b)) + " " + " ".join(rng.choices(filler, k=40))
    texts = [text(True) for _ in range(30)] + [copied] * 400 + [text(False) for _ in range(300)]
    fresh = [text(True) for _ in range(10)] + [text(False) for _ in range(10)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + fresh)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 430)) for i in range(len(texts))], "doc_id bigint, toxic int")
    found = {r.doc_id: r.toxic for r in toxicity.find_toxic(df, labels).collect()}
    assert [found[len(texts) + i] for i in range(20)] == [True] * 10 + [False] * 10


def test_names_with_a_dot(spark):
    df = docs(spark, extra=False).withColumnsRenamed({"doc_id": "a.id", "text": "a.text"})
    how = {"text": "a.text", "id_col": "a.id"}
    bench = spark.createDataFrame([(1, ITEM)], "`b.id` bigint, `a.text` string")
    labels = spark.createDataFrame([(1, 1, 0)], "`a.id` bigint, `l.quality` int, `l.toxic` int")
    for out in (exact_dedup.find_exact_duplicates(df, **how), decontaminate.find_leaks(df, bench, item_col="b.id", **how), shards.token_shards(df, **how), near_dedup.find_near_duplicates(df, **how), encode.encode_documents(df, **how), token_counts.attribute_tokens(df, fields=["source", "a.text"], id_col="a.id")):
        out.collect()
    assert exact_dedup.drop_exact_duplicates(df, **how).columns == near_dedup.drop_near_duplicates(df, **how).columns == df.columns
    near_dedup.drop_near_duplicates(df, **how).collect(), exact_dedup.drop_exact_duplicates(df, **how).collect()
    quality.score_documents(df, quality.fit(df, labels, label="l.quality", **how), **how).collect()
    toxicity.score_documents(df, toxicity.fit(df, labels, label="l.toxic", **how), **how).collect()


def test_equal_hashes_in_shards_and_counts(spark, monkeypatch):
    coder = bpe.Bpe(encode.VOCABULARY)
    monkeypatch.setattr(bpe.textvec, "span_hashes", lambda buf, s, e: np.zeros(len(s), np.uint64))
    buf, offsets = textvec.column(pa.array(["one two six ten", "abc two"]))
    ids, bounds = coder.encode_exact(buf, offsets)
    assert bytes(coder.decode(ids[bounds[1] : bounds[2]])) == b"abc two"
    import inspect

    assert all("encode_exact" in inspect.getsource(m) and "encode_rows" not in inspect.getsource(m) for m in (shards, token_counts, encode))


def test_later_words_of_fixed_phrases_count_by_choice(spark):
    rng = random.Random(4)
    filler = [f"plain{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]

    def text(toxic):
        words = rng.choices(filler, k=40)
        for _ in range(4 * toxic):
            at = rng.randrange(1, len(words))
            words[at:at] = ["yonder", "grickle"]
        return " ".join(words)

    texts = [text(i < 60) for i in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(300)], "doc_id bigint, toxic int")
    word = np.array([textvec.word_hash("grickle")], np.uint64)
    strict, free = (toxicity.fit(df, labels, dominance=x) for x in (toxicity.DOMINANCE, 1.0))
    assert len(strict.table.find(word)[0]) == 0 and len(free.table.find(word)[0]) == 1


def test_pages_without_a_label_keep_their_text(spark):
    df = spark.createDataFrame([(1, "<div><p>one</p><p>two</p></div>"), (2, "<span>three</span>")], "page_id bigint, html string")
    assert {r.page_id: r.text for r in html.extract(df, html.fit(df)).collect()} == {1: "one\ntwo", 2: "three"}
    only_bad = spark.createDataFrame([(1, "<div><p>one</p><nav>menu</nav></div>")], "page_id bigint, html string")
    assert html.extract(only_bad, html.fit(only_bad)).first().text == "one\nmenu"


def test_features_count_whole_pieces_and_subtrees():
    page = "<div class='ad x'><p>" + "7 words here " * 40 + "</p></div><p>1</p>"
    t = html.parse(page)
    f = html.node_features(t)
    digits = 10
    assert f[0, digits] == pytest.approx(40 / (13 * 40) * 10) and f[1, digits] == f[0, digits] and f[2, digits] == 10
    base = 22 + html.OTHER + 1 + html._HASHED
    assert (f[0, base:] == f[1, base:]).all() and f[0, base:].sum() == len({__import__("zlib").crc32(x) % html._HASHED for x in (b"ad", b"x")}) and f[2, base:].sum() == 0
    deep = html.parse("<a class='ad'>" * 20_000 + "</b>" * 20_000 + "x")
    assert len(deep.tag) == 20_000 and html.node_features(deep).shape[0] == 20_000 and (html.teacher(deep) == 0).all()


def test_svg_does_not_swallow_the_page():
    def texts(page):
        return "".join(x for _, x in html.parse(page).pieces)

    assert texts("<p>one</p><svg width='1'/><p>two</p>") == "onetwo"
    assert texts("<svg/><p>two</p><svg><path d='M0'/><text>drawn</text></svg><p>three</p>") == "twothree"
    assert texts("<p>one</p><svg viewBox='0'><p>two</p>") == "onetwo"

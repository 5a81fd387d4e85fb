"""Near-duplicates, top-k, mixing, chat, rules, licences, pipeline."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixframe.llm import chat, components, licenses, mixing, near_dedup, quality_rules, topk
from helixframe.llm.common import lookup_join, write_table
from helixframe.llm.near_dedup import least_matches

SF = "/root/testdata/sf0.001"


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def groups(texts, width):
    sets, root = [shingles(t, width) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [(i, len(s), top(i)) for i, s in enumerate(sets)]


def texts_with_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = ["", None, "  \n", "one", "ONE", "one two", "x" * 5000, " ".join(rng.choices(vocabulary, k=20_000))]
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(5, 120))
        for _ in range(rng.randint(1, 12)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 14))):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            out.append(rng.choice([" ", "\n", " \t"]).join(t))
    return out + out[-5:]


@pytest.mark.parametrize("width,block,options", [(2, 2048, {}), (2, 3, {"star": 2}), (2, 2048, {"block_bytes": 3000, "star": 5}), (5, 2048, {"max_broadcast": 0})])
def test_near_duplicates(spark, width, block, options):
    texts = texts_with_copies(width)
    d = docs(spark, texts).withColumn("node", F.lit("clash")).withColumn("component_id", F.lit(1))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(d, width=width, block=block, **options).collect())
    assert got == groups(texts, width)
    assert near_dedup.near_duplicates(d.limit(0), width=width).count() == 0


def test_lookup_join_by_salts_and_by_broadcast(spark):
    d = spark.createDataFrame([(i % 7 if i % 3 else 1, i, "x") for i in range(500)], "k long, v long, _s string")
    small = spark.createDataFrame([(k, f"n{k}") for k in range(5)], "k long, name string")
    want = rows_of(lookup_join(d, small, "k"))
    assert rows_of(lookup_join(d, small, "k", max_rows=2)) == want and len(want) == 500


def test_rows_made_by_explode_are_not_broadcast(spark, monkeypatch):
    """Their tables pass for small ones: 64 rows a key of a lookup table, 32 of a class."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    small = write_table(spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v")), "small")
    d = write_table(spark.range(900).select((F.col("id") % 400).alias("k"), "id"), "rows")
    salted = lookup_join(d, small, "k", max_rows=100)
    assert "Broadcast" in plan(lookup_join(d, small, "k")) and "Broadcast" not in plan(salted)
    assert sorted((r.id, r.k, r.v) for r in salted.collect()) == [(i, i % 400, i % 400 * 3 if i % 400 < 300 else None) for i in range(900)]
    plans = {}
    monkeypatch.setattr(near_dedup, "write_table", lambda df, name: plans.setdefault(name, plan(df)) and write_table(df, name))
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(20)]
    got = near_dedup.near_duplicates(docs(spark, [*texts, *(f"{t} end" for t in texts)]), width=2).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, i % 20) for i in range(40)}
    assert "Broadcast" not in plans["members"]


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.select("k", "v", "_s", "name").collect())))


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"t{i}" for i in range(40))
    d = spark.createDataFrame([(None, text), (7, text), (7, text), (9, text + " more"), (None, "other words here")], "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.component_id) for r in near_dedup.near_duplicates(d, width=2).collect()), key=str)
    assert got == [("7", 7), ("7", 7), ("9", 7), ("None", 7), ("None", None)]
    kept = near_dedup.drop_near_duplicates(d.withColumn("row", F.lit("x")), width=2)
    assert kept.columns == ["doc_id", "text", "row"] and kept.count() == 2


def test_pruning_bound():
    need = least_matches(0.8, 128, 1e-9)
    rng = np.random.default_rng(0)
    draws = rng.random((20_000, 128)) < 0.8
    assert all((draws[:, :n].sum(axis=1) >= m).mean() > 0.9999 for n, m in need.items()) and need[128] > 60


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    root = list(range(400))
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root[x] for a, b in edges if a != b for x in (a, b)}


def test_topk(spark):
    rng = np.random.default_rng(2)
    v = [rng.normal(size=8).tolist() for _ in range(150)] + [[0.5] * 8] * 60 + [[0.0] * 8] * 3
    rows = [(i, x, "e") for i, x in enumerate(v)] + [(900, None, "e"), (920, [None] + [1.0] * 7, "e"), (940, [float("nan")] * 8, "e"), (None, [1.0] * 8, "e"), (960, [1.0, 2.0], "e"), (980, [], "e")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string")
    q = {i: np.floor(64 * np.array(np.array(x, dtype=np.float32), dtype=float)).astype(int) for i, x in enumerate(v)}
    want = []
    for i in range(0, len(v), 20):
        best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:20]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    for block in (8192, 40):
        assert sorted(tuple(r) for r in topk.top_k(d, F.col("vec_id") % 20 == 0, block_rows=block, batch_queries=5).collect()) == want
    assert topk.top_k(d.limit(0), F.lit(True)).count() == 0
    few = topk.threshold_topk(np.array([1]), np.array([[1, -2]]), np.array([1, 2, 3]), np.array([[9, 9], [2, 1], [2, 1]]), 20)
    assert [x.tolist() for x in few[:3]] == [[0, 0], [2, 3], [0, 0]]


def brute_topk(x, ids, asked, k):
    out = {}
    for i in asked:
        best = sorted((-int(x[i] @ x[j]), int(ids[j])) for j in range(len(x)) if ids[j] != ids[i])[:k]
        out[int(ids[i])] = [(j, -s) for s, j in best]
    return out


@pytest.mark.parametrize("shape", ["few dimensions", "unequal dimensions", "even dimensions", "long list ties"])
def test_threshold_stops_where_the_bound_lets_it(shape):
    rng = np.random.default_rng(6)
    n, k = 3000, 10
    x = {
        "few dimensions": rng.integers(-60, 60, (n, 2)),
        "unequal dimensions": np.round(rng.normal(size=(n, 24)) * 200 * 0.4 ** np.arange(24)).astype(np.int64),
        "even dimensions": rng.integers(-20, 20, (n, 64)),
        "long list ties": rng.integers(0, 2, (n, 5)),
    }[shape]
    ids, asked = rng.permutation(n), np.arange(0, n, 100)
    want = brute_topk(x, ids, asked, k)
    for floors in (None, np.array([want[int(ids[i])][-1][1] for i in asked]), np.full(len(asked), 10**9)):
        scored = []
        for i, f in zip(asked, [None] * len(asked) if floors is None else floors, strict=True):
            _, got, score, work = topk.threshold_topk(ids[[i]], x[[i]], ids, x, k, 16, None if f is None else np.array([f]))
            found = list(zip(got.tolist(), score.tolist(), strict=True))
            assert f == 10**9 or found == want[int(ids[i])]
            scored.append(work[0, 0] / n)
        share = float(np.mean(scored))
        if shape == "even dimensions":
            assert f == 10**9 or share > 0.9  # nothing to spare there, and none is left out
        elif shape != "long list ties":
            assert share < (0.35 if floors is None else 0.3)
    together = topk.threshold_topk(ids[asked], x[asked], ids, x, k, 16)
    assert {int(ids[asked[r]]): [] for r in together[0]}.keys() == want.keys()
    for r, j, s in zip(*together[:3], strict=True):
        assert (int(j), int(s)) in want[int(ids[asked[r]])]


def test_floors_of_the_first_block_spare_rows_of_the_others(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(4000, 16)) * 3 * 0.3 ** np.arange(16), 3).astype(np.float32)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    options = {"k": 5, "block_rows": 500, "batch_queries": 20, "first_depth": 8}
    q = np.floor(64 * x.astype(float)).astype(np.int64)
    want = brute_topk(q, np.arange(len(q)), range(0, 4000, 400), 5)
    got = {}
    for r in sorted(topk.top_k(d, F.col("vec_id") % 400 == 0, **options).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want
    work = topk.search_work(d, F.col("vec_id") % 400 == 0, **options).first()
    assert work.queries == 10 and work.scored < 0.5


def test_mixing(spark):
    d = spark.createDataFrame([(i, "x" * 10, "a" if i % 3 else None, 5) for i in range(3000)] + [(None, None, "a", 5)], "doc_id long, text string, source string, copy int")
    w = spark.createDataFrame([("a", 3.0), (None, 1.0)], "source string, weight double")
    rates = mixing.source_rates(d, w)
    got = mixing.mix(d, rates)
    assert got.columns == ["doc_id", "text", "source", "copy", "shuffle_key"]
    n = dict((r["source"], r["n"]) for r in got.groupBy("source").agg(F.count("*").alias("n")).collect())
    assert abs(n["a"] - 2250) < 200 and abs(n[None] - 750) < 120
    once = sorted(map(str, got.collect()))
    assert once == sorted(map(str, mixing.mix(d.repartition(7), rates).collect()))
    counts = Counter(r.doc_id for r in got.where("source = 'a'").collect())
    share = Counter(counts.get(i, 0) for i in range(3000) if i % 3)
    assert abs(share[0] / 2000 - np.exp(-1.125)) < 0.05
    high = mixing.mix(d.where("doc_id < 30").select("doc_id", "source"), spark.createDataFrame([("a", 900.0), (None, 0.0)], "source string, rate double"))
    assert abs(high.count() / 20 - 900) < 40
    assert mixing.mix(d.limit(0), mixing.source_rates(d.limit(0), None)).count() == 0


def test_mixing_weights(spark):
    d = spark.createDataFrame([(i, "x" * 10, "ab"[i % 2]) for i in range(2000)], "doc_id long, text string, source string")
    weights = lambda *w: spark.createDataFrame(list(w), "source string, weight double")
    rate = lambda w, **o: {r.source: round(r.rate, 9) for r in mixing.source_rates(d, w, **o).collect()}
    assert rate(weights(("a", 0.5), ("a", 0.5), ("b", 1.0))) == rate(weights(("a", 1.0), ("b", 1.0))) == {"a": 1.0, "b": 1.0}
    twice = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("b", None)], "source string, rate double")
    assert sorted(map(tuple, mixing.mix(d, twice).collect())) == sorted(map(tuple, mixing.mix(d, spark.createDataFrame([("a", 1.0)], "source string, rate double")).collect()))
    assert rate(weights(("a", None)), default_weight=2.0) == {"a": 1.0, "b": 1.0}
    for bad in (weights(("a", 1.0), ("b", -1.0)), weights(("a", 0.0)), weights(("elsewhere", 1.0)), weights(("a", float("nan"))), weights(("a", float("inf")))):
        with pytest.raises(ValueError):
            mixing.source_rates(d, bad)
    long_ = spark.createDataFrame([(1, "w " * 400_000, "a")], "doc_id long, text string, source string")
    assert mixing.mix(long_, spark.createDataFrame([("a", 5.0)], "source string, rate double")).select(F.length("text")).distinct().collect() == [(800_000,)]


def test_chat(spark):
    a = [(1, 0, "user", "hi"), (1, 1, "assistant", "ho")]
    rows = a + [(2, *r[1:]) for r in a] + [(2, 2, "user", "more")] + [(3, 5, "user", "hi")] + [(4, *r[1:]) for r in a + [(1, 2, "user", "more")]] + [(5, None, None, None)] * 2 + [(None, 0, "user", "no id"), (6, 0, "user", "HI")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, place string")
    got = {r.conv_id: r for r in chat.format_chats(d).collect()}
    assert set(got) == {2, 5, 6, None} and got[2].n_copies == 2 and got[2].n_turns == 3
    assert got[2].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nho<|im_end|>\n<|im_start|>user\nmore<|im_end|>"
    assert got[5].text == "<|im_start|>unknown\n<|im_end|>"
    long_ = spark.createDataFrame([(c, t, "user", str(t)) for c, n in ((1, 25), (2, 9), (3, 25), (4, 30)) for t in range(n)], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(long_, block=4).orderBy("chunk").collect()
    assert {r.conv_id for r in out} == {4} and [r.chunk_turns for r in out] == [4] * 7 + [2]
    assert chat.format_chats(d.limit(0)).count() == 0


def test_chat_snapshots_that_end_within_a_turn(spark):
    x, y, z = (0, "user", "x"), (0, "user", "y"), (None, None, None)
    snapshots = {1: [x], 2: [x, y], 3: [y], 4: [z], 5: [z, (None, "user", None)], 6: [y, (0, "assistant", "x")], 7: [(3, "user", "x"), (3, "user", "y"), (4, "user", "z")]}
    rng = random.Random(5)
    for c in range(8, 80):
        rows = sorted({(rng.randrange(4), rng.choice(["assistant", "user"]), rng.choice("ab")) for _ in range(rng.randrange(1, 7))})
        snapshots[c] = rows[: rng.randrange(1, len(rows) + 1)]
    clean = {}
    for c, rows in snapshots.items():
        turns = sorted({(t or 0, r or "unknown", x or "") for t, r, x in rows})
        clean[c] = [(t - turns[0][0], r, x) for t, r, x in turns]
    want = {c for c, a in clean.items() if not any(len(b) > len(a) and b[: len(a)] == a or b == a and o < c for o, b in clean.items())}
    assert not want & {1, 2, 4} and {3, 5, 6, 7} - want <= {3, 6}
    d = spark.createDataFrame([(c, *r) for c, rows in snapshots.items() for r in rows], "conv_id long, turn long, role string, text string")
    for block in (2, 256):
        got = {(r.conv_id, r.n_turns, r.n_copies) for r in chat.format_chats(d, block=block).collect()}
        assert got == {(c, len(clean[c]), sum(b == clean[c] for b in clean.values())) for c in want}


def test_chat_chunks_by_position(spark):
    cols = "conv_id long, turn long, role string, text string"
    one_turn = spark.createDataFrame([(1, 0, "user", f"{i:05}") for i in range(700)] + [(None, None, None, f"x{i:05}") for i in range(600)] + [(2, 9, "user", f"{i:05}") for i in range(300)], cols)
    got = sorted(((r.conv_id or 0, r.chunk, r.chunk_turns, r.n_turns, r.text) for r in chat.format_chats(one_turn).collect()))
    assert [g[:4] for g in got] == [(0, 0, 256, 600), (0, 1, 256, 600), (0, 2, 88, 600), (1, 0, 256, 700), (1, 1, 256, 700), (1, 2, 188, 700)]
    line = lambda i: f"<|im_start|>user\n{i:05}<|im_end|>"
    assert [g[4] for g in got[3:]] == ["\n".join(map(line, range(lo, min(700, lo + 256)))) for lo in (0, 256, 512)]  # conversation 2 is a prefix of it


def brute_rules(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    g = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + j for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if g[x] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), sum(c in quality_rules.SYMBOLS for c in t), len(lines) - len(set(lines)), len(lines), len(hit))


def test_rules(spark):
    texts = ["", None, " \n\t", "a b a b a b a b", "x\nx\n\n x\nx", "# * $ | a", "😀 é b c", "a b c a b c", "w " * 20_000, "A B"] + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    d = docs(spark, texts).withColumn("words", F.lit("clash"))
    got = quality_rules.apply_rules(d)
    for r in got.collect():
        assert tuple(r)[1:7] == brute_rules(texts[r.row.doc_id]), texts[r.row.doc_id]
        n = r.n_words
        assert r.base_failed == (n < 50 or 100 * r.n_repeat_words > 50 * n) and not (r.base_failed and r.kept)
    one = {name: {r.row.doc_id for r in quality_rules.apply_rules(d, {name: rule}, least_words=0).where("NOT kept").collect()} for name, rule in quality_rules.RULES.items()}
    assert {r.row.doc_id for r in got.where("NOT kept").collect()} == {r.row.doc_id for r in got.where("base_failed").collect()}.union(*one.values())
    assert quality_rules.apply_rules(d.limit(0)).count() == 0
    assert got.where("kept").select("row.*").columns == d.columns
    bad = {i for i, t in enumerate(texts) for n, _, _, _, _, repeat in [brute_rules(t)] if n < 1 or 100 * repeat > 50 * n}
    stay = quality_rules.reject_rules(d)
    assert stay.columns == d.columns and {r.doc_id for r in stay.collect()} == set(range(len(texts))) - bad - set().union(*one.values())
    assert {r.doc_id for r in quality_rules.reject_rules(d, least_words=50).collect()} == {r.row.doc_id for r in got.where("kept").collect()}
    assert quality_rules.reject_rules(d.limit(0)).count() == 0


def test_rule_order_is_counted(spark):
    """The order comes from rejections and steps of hashed rows of the whole table, whatever the row order and the run."""
    clean, odd = "some words that stand here " * 12, "# * $ % & | < > " * 20
    d = spark.createDataFrame([(i, clean if i < 900 else odd) for i in range(1000)], "doc_id long, text string").repartition(3)
    rules = {"capitals": quality_rules.RULES["capitals"], "symbols": quality_rules.RULES["symbols"], "no_letters": quality_rules.RULES["no_letters"]}
    for measured in (False, True):
        orders = {tuple(quality_rules.order_rules(x, rules, measured, 500)) for x in (d, d.orderBy("doc_id"), d.orderBy(F.desc("doc_id")), d.repartition(7))}
        assert orders == {("symbols", "no_letters", "capitals")}
    costly = {"cheap": quality_rules.few_words(1000), "costly": quality_rules.REPEATED_WINDOWS}
    assert quality_rules.order_rules(d, dict(reversed(costly.items())), False) == ["cheap", "costly"]


def license_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute_licenses(texts, templates, rare=24, span=64, need=2, least=3, most=16):
    words = [license_words(t) for t in texts]
    df = Counter(w for ws in words for w in set(ws))
    rank = lambda w: (df[w], w)
    split = [(label, license_words(text), [license_words(p) for p in phrases]) for label, text, phrases in templates]
    indexed = [sorted(set(t), key=rank)[: min(most, max(least, -(-len(set(t)) // 2)))] for _, t, _ in split]
    index = set().union(*map(set, indexed))
    at_of = lambda ws, p: [i for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
    out = []
    for ws in words:
        looked_up = {}
        for lo in range(0, len(ws), span):
            chosen = set(sorted(index & set(ws[lo : lo + span]), key=rank)[:rare])
            looked_up |= {i: ws[i] for i in range(lo, min(len(ws), lo + span)) if ws[i] in chosen}
        base_at = {label: at_of(ws, p.split()) for label, (p, _) in licenses.BASE.items()}
        labels, best = {k for k, v in base_at.items() if v}, 0.0
        for (label, t, phrases), mine in zip(split, indexed, strict=True):
            places = {w: [j for j, x in enumerate(t) if x == w] for w in mine}
            votes = Counter(i - j for i, w in looked_up.items() for j in places.get(w, ()))
            offsets = [o for o, n in votes.items() if n >= min(need, sum(map(len, places.values())))]
            if offsets and all(any(o + at_of(t, p)[0] >= 0 and ws[o + at_of(t, p)[0] :][: len(p)] == p for o in offsets) for p in phrases):
                labels.add(label)
                best = max(best, sum(any(0 <= o + j < len(ws) and ws[o + j] == w for o in offsets) for j, w in enumerate(t)) / len(t))
        every = [i for v in base_at.values() for i in v]
        base = sorted(k for k, v in base_at.items() if v)
        out.append((len(ws), len(every), min(every, default=None), max(every, default=None), ",".join(base), ",".join(sorted(labels)), 1.0 if every else best))
    return out


def same_licenses(got, want):
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got] == [w[:6] for w in want]
    assert np.allclose([r.score for r in got], [w[6] for w in want])


def test_licenses(spark):
    texts = ["", None, "!!", "CC BY", "cc-by cc  by 4.0", "Released under the MIT License. Released under the MIT License.", "All rights reserved all rights reserved", "under the MIT license", "GNU General\nPublic License", "this work is licensed under a Creative Commons Attribution 4.0 International License", "mit mit mit license", "é ü " * 5000 + "all rights reserved", "é ü " * 9000 + "released under the ISC license " + "é ü " * 9000]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text RLIKE '(?i)licen|reserved|cc'").limit(60).collect()]
    bodies = [t for _, t, _ in licenses.TEXTS]
    texts += [*bodies, "\n".join(bodies), " ".join(license_words(bodies[-1])[7:]), next(x for x in bodies if "deal in the Software without" in x).replace("without restriction,", "without any restriction at all,"), "word " * 300 + bodies[1] + " word" * 300]
    d = docs(spark, texts + texts[:9]).withColumn("hits", F.lit("clash")).withColumn("words", F.lit("clash"))
    got = licenses.scan_licenses(d).orderBy("row.doc_id").collect()
    same_licenses(got, brute_licenses(texts + texts[:9], licenses.TEXTS + licenses.NOTICES))
    assert got[0].asDict()["row"].asDict().keys() == {"doc_id", "text", "hits", "words"} and got[12].labels == "isc"
    assert licenses.scan_licenses(d.limit(0)).count() == 0


def test_many_and_long_templates(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(900)] + ["the", "of", "to"] * 60
    templates = []
    for i in range(100):
        t = rng.choices(vocabulary, k=3000 if i == 0 else rng.randint(1, 90))
        cut = sorted(rng.sample(range(len(t)), 2)) if len(t) > 5 else [0, 0]
        templates.append((f"l{i % 80}", " ".join(t), [" ".join(t[c : c + 4]) for c in cut]))
    texts = []
    for label, t, _ in templates:
        w = t.split()
        at = rng.randrange(len(w))
        texts += [t, "the of to " * 20 + t, " ".join(w[:at] + ["put", "in"] + w[at:]), " ".join(w[at:])]
    texts += [" ".join(rng.choices(vocabulary, k=400)) for _ in range(30)] + [" ".join(t for _, t, _ in rng.sample(templates, 12))]
    d = docs(spark, texts)
    table = licenses.template_table(spark, templates)
    got = licenses.scan_licenses(d, table).orderBy("row.doc_id")
    same_licenses(got.collect(), brute_licenses(texts, templates))
    assert sum(templates[i][0] in r.labels.split(",") for i, r in enumerate(got.collect()[0:400:4])) >= 97
    operators = lambda x: len(x._jdf.queryExecution().sparkPlan().toString().split("\n"))
    assert operators(licenses.scan_licenses(d, table)) == operators(licenses.scan_licenses(d, licenses.template_table(spark, templates[:2])))
    assert {r.labels for r in licenses.scan_licenses(docs(spark, ["mit license", "cc by"]), table.limit(0)).collect()} == {"", "cc-by"}
    for bad in ([("x", "one two three", ["two one"])], [("x", "a " * 30, [])]):
        with pytest.raises(ValueError):
            licenses.scan_licenses(d, licenses.template_table(spark, bad), max_words=20)


def test_license_base_columns_equal_sql(spark):
    import duckdb

    sf_dir = "/root/testdata/sf0.01"
    sql = f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM '{sf_dir}/documents.parquet'),
    p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
    h AS (SELECT doc_id, i - 1 AS pos, CASE WHEN ws[i:i+1] = ['cc', 'by'] THEN 'cc-by' WHEN ws[i:i+2] = ['general', 'public', 'license'] THEN 'gpl' WHEN ws[i:i+2] = ['all', 'rights', 'reserved'] THEN 'reserved' END AS label FROM p)
    SELECT w.doc_id, len(ws), count(label), min(pos) FILTER (label IS NOT NULL), max(pos) FILTER (label IS NOT NULL), coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') FROM w LEFT JOIN h USING (doc_id) GROUP BY w.doc_id, len(ws)"""
    got = licenses.scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(sql).fetchall())


def test_license_bodies_and_versions(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Retain the notice. 2. Reproduce it in the documentation and/or other materials provided with the distribution. "
    third = "3. Neither the name of X nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
    end = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AS IS"
    gnu = "you can redistribute it and/or modify\n# it under the terms of the GNU {}General Public License as published by\n# the Free Software Foundation, either version {} of the License"
    want = {
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc-4.0",
        "Licensed under the GNU General Public License, version 2.": "gpl,gpl-2.0",
        "This work is licensed under the GNU General Public License, version 2.": "gpl,gpl-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "Licensed under the GNU Lesser General Public License, version 2.1": "gpl,lgpl-2.1",
        "Released under the BSD 2-Clause License": "bsd-2-clause",
        "Released under the ISC License": "isc",
        "// Permission is hereby granted, free of charge, to any person obtaining a copy\n// of this software and associated documentation files (the \"Software\"), to deal": "mit",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
        bsd + end: "bsd,bsd-2-clause",
        bsd + third + end: "bsd,bsd-3-clause",
        gnu.format("", 2): "gpl,gpl-2.0",
        gnu.format("", 3): "gpl,gpl-3.0",
        gnu.format("Lesser ", "2.1"): "gpl,lgpl-2.1",
        gnu.format("Affero ", 3): "agpl-3.0,gpl",
        "permission to use the forms with or without a fee": "",
    }
    got = licenses.scan_licenses(docs(spark, list(want))).collect()
    assert {r.row.text: r.labels for r in got} == want


def test_pipeline(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    step, seen = d, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.write_table(stage(spark, step, SF), "stage")
        if k < 4:
            assert out.columns == d.columns
        seen.append((step, out))
        step = out
    ids = lambda x: [r["doc_id"] for r in x.select("doc_id").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(ids(seen[0][1]))
    assert sum(labels[i] != (i in kept) for i in labels if i in set(ids(d))) <= 2
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in seen[2])
    order = sorted(before)
    found = groups([before[i] for i in order], 5)
    assert set(after) == {order[i] for i, n, top in found if top == i or not n}
    assert set(ids(seen[4][1])) == set(ids(seen[4][0])) and {"sequence_id", "offset"} <= set(seen[4][1].columns)
    assert corpus_pipeline.rules(spark, d.limit(0), SF).count() == 0

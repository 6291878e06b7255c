"""The training-data operators: brute force, round trips, held-out accuracy, and odd inputs."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import components as cc
from plumbline.llm import (
    cover_tree_topk,
    decontaminate,
    hilbert_shards,
    jaccard_join,
    language_id,
    line_dedup,
    piece_scan,
    substring_dedup,
    token_files,
    toxicity,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s1", 0),
    (3, " \t\n ", "en", "s1", 4),
    (4, "one two three", "en", "s1", 13),
    (4, "one two three", "en", "s1", 13),  # a repeated row
    (None, "no id here at all, but words", "en", "s2", 28),
    (5, "word " * 30_000, "en", "s1", 150_000),  # a very long text
    (6, "x" * 70_000, "en", None, 70_000),  # one very long word
    (7, "ünïcödé — ✓ 日本語 ▁ tail", "de", "s3", 22),
]


def table(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def odd(spark):
    """Odd rows with columns whose names clash with those that operators use."""
    extra = {"shard": F.lit(1), "key": F.lit("k"), "score": F.lit(0.5), "lang_pred": F.lit("zz"), "chunk": F.lit(3), "n": F.lit(4), "part": F.lit(5), "row": F.lit(6), "rank": F.lit(7), "size": F.lit(8)}
    extra |= {"letters": F.lit("abc"), "n_lines": F.lit(-1), "n_removed": F.lit(-2), "node": F.lit(9), "n_links": F.lit(10), "item_id": F.lit(11), "copy": F.lit(12), "toxic": F.lit(13), "held_out": F.lit(14)}
    extra |= {c: F.lit(15) for c in ("__bad", "__doc", "__kept", "__later", "__dirty", "__lines", "__gone", "Doc", "Gone", "kept", "later", "dirty", "lines", "a.b")}
    return table(spark, ODD).withColumns(extra)


def empty(spark):
    return table(spark, [])


def crc(x):
    return zlib.crc32(str(x).encode())


# --- 1 ---------------------------------------------------------------------------------------------


def test_hilbert_index_is_a_curve(spark):
    cells = spark.range(512).select((F.col("id") % 8).alias("x"), (F.floor(F.col("id") / 8) % 8).alias("y"), F.floor(F.col("id") / 64).alias("z"))
    rows = hilbert_shards.with_hilbert_index(cells, ["x", "y", "z"], 3, "h").orderBy("h").collect()
    assert [r.h for r in rows] == list(range(512))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1 for a, b in zip(rows, rows[1:]))


def test_shards_by_rows(spark):
    rng = random.Random(1)
    rows = [(i, "a" * rng.randint(0, 300), rng.choice(["en", "de", None]), f"s{rng.randint(0, 3)}", 0) for i in range(500)]
    out = hilbert_shards.shard(table(spark, rows)).collect()
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
        text = rows[r.doc_id][1]
        assert (r.size, r.text_crc32) == (len(text) + 8, zlib.crc32(text.encode()))
    assert sorted(by) == list(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    last = -1
    for s in sorted(by):
        own = sorted(by[s], key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert [r.hilbert for r in own] == sorted(r.hilbert for r in own) and own[0].hilbert >= last
        last = own[-1].hilbert
    m = hilbert_shards.shard_manifest(hilbert_shards.shard(table(spark, rows))).collect()
    assert len(m) == 24 and all(r.min_hilbert <= r.max_hilbert for r in m)
    assert hilbert_shards.shard(empty(spark)).count() == 0
    assert hilbert_shards.shard(odd(spark)).count() == len(ODD)


# --- 2 ---------------------------------------------------------------------------------------------


def test_line_dedup_counts_sites_not_documents(spark):
    rows = [(i, f"own {i}\n shared \nlocal", "en", f"s{i % 12}" if i < 40 else None, 0) for i in range(60)]
    rows += [(100 + i, f"few\n{i}", "en", f"s{i}", 0) for i in range(line_dedup.MIN_SITES - 1)]
    rows += [(200 + i, f"enough\n{i}", "en", f"s{i % line_dedup.MIN_SITES}", 0) for i in range(40)]
    got = {r.doc_id: r for r in line_dedup.remove_boilerplate(table(spark, rows)).collect()}
    assert got[0].text == "own 0" and got[0].n_removed == 2
    assert got[59].n_removed == 2  # no site of its own, but the line is boilerplate
    assert got[100].text == "few\n0" and got[200].text == "0"


def test_line_dedup_with_hot_and_seldom_keys_apart(spark):
    rng = random.Random(2)
    lines = [f"line {k}" for k in range(40)]
    rows = [(i, "\n".join([f"own {i}", "everywhere", *(x for k, x in enumerate(lines) if rng.random() < 1 / (k + 1))]), "en", f"s{rng.randrange(10)}", 0) for i in range(300)]
    want = {}
    sites = {}
    for i, t, _, s, _ in rows:
        for x in set(t.split("\n")):
            sites.setdefault(x, set()).add(s)
    for i, t, *_ in rows:
        want[i] = "\n".join(x for x in t.split("\n") if len(sites[x]) < line_dedup.MIN_SITES)
    for hot in (3, 10_000):  # a few keys by broadcast and the rest shuffled; all by broadcast
        assert {r.doc_id: r.text for r in line_dedup.remove_boilerplate(table(spark, rows), hot=hot).collect()} == want


def test_line_dedup_odd_inputs(spark):
    got = line_dedup.remove_boilerplate(odd(spark))
    assert got.count() == len(ODD) and got.filter("doc_id = 1").first().text is None and got.filter("doc_id = 1").first().n_lines == 0
    own = line_dedup.remove_boilerplate(odd(spark), counts=("a", "b"))
    assert {(r.n_lines, r.n_removed) for r in own.collect()} == {(-1, -2)}
    assert line_dedup.remove_boilerplate(empty(spark)).count() == 0


# --- 3 ---------------------------------------------------------------------------------------------


def near_copies(rng, n, words):
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        own[rng.randrange(words)] = f"e{rng.randint(0, 10**9)}"
        out.append(" ".join(own))
    return out


def brute_links(texts, threshold=0.8):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    links = {}
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and sets[i] != sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links.setdefault(i, set()).add(frozenset(sets[j]))
                links.setdefault(j, set()).add(frozenset(sets[i]))
    return sets, links


def test_jaccard_join_against_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(3, 60))) for _ in range(60)]
    for k in range(6):
        texts += near_copies(rng, rng.randint(2, 30), 60)
    texts += texts[:5] + ["a b", "a b", "a c"]
    out = {r.doc_id: r for r in jaccard_join.jaccard_classes(table(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]), limit=8).collect()}
    sets, links = brute_links(texts)
    label = list(range(len(texts)))
    for _ in range(len(texts)):
        for i in range(len(texts)):
            for j in range(len(texts)):
                if sets[i] and (sets[i] == sets[j] or frozenset(sets[j]) in links.get(i, ())):
                    label[i] = label[j] = min(label[i], label[j])
        if all(label[label[i]] == label[i] for i in range(len(texts))):
            break
    assert {i: r.class_id for i, r in out.items()} == dict(enumerate(label))
    whole = {r.doc_id: r.n_links for r in jaccard_join.jaccard_classes(table(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])).collect()}
    assert whole == {i: len(links.get(i, ())) for i in range(len(texts))}


def test_jaccard_join_counts_all_links_of_a_family_over_the_limit(spark):
    rng = random.Random(7)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(base[:c] + [f"x{c}_{k}"] + base[c + 1 :]) for k in range(130) for c in [rng.randrange(150)]]
    _, links = brute_links(texts)
    got = {r.doc_id: r for r in jaccard_join.jaccard_classes(table(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]), levels=1, limit=8).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: len(links[i]) for i in range(len(texts))}
    assert {r.class_id for r in got.values()} == {0}


def test_jaccard_join_repeats_runs_until_the_target_recall(spark):
    assert [jaccard_join.runs_for(r) for r in (0.3, 0.9, 0.9997)] == [1, 5, 16]
    rng = random.Random(8)
    texts = []
    for _ in range(150):  # pairs near the threshold, which one run often misses
        base = [f"w{rng.randint(0, 10**7)}" for _ in range(100)]
        own = list(base)
        for at in rng.sample(range(5, 95, 10), 2):
            own[at] = f"x{rng.randint(0, 10**7)}"
        texts += [" ".join(base), " ".join(own)]
    _, links = brute_links(texts)
    docs = table(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    recall = lambda r: sum(x.n_links for x in jaccard_join.jaccard_classes(docs, target_recall=r).collect()) / sum(map(len, links.values()))
    assert len(links) > 200 and recall(0.9997) == 1 > recall(0.3)


def test_jaccard_join_odd_inputs(spark):
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_classes(odd(spark)).collect()}
    assert got[None] == (None, 0) and all(v == (k, 0) for k, v in got.items() if k is not None)
    assert jaccard_join.jaccard_classes(empty(spark)).count() == 0
    assert jaccard_join.one_of_each_class(odd(spark)).count() == len(ODD)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 50)]
    got = {r.node: r.label for r in cc.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100 + i: 100 for i in range(50)}


def test_components_of_odd_links(spark):
    links = [(7, 7), (9, 8), (8, 9), (9, 8), (None, 3), (3, None), (5, 6)]
    got = {r.node: r.label for r in cc.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {7: 7, 8: 8, 9: 8, 5: 5, 6: 5}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 4 ---------------------------------------------------------------------------------------------


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 5000)}"
    items = [" ".join(word() for _ in range(n)) for n in (5, 6, 8, 9, 13, 21, 40, 90, 200, 4, 0)]
    docs = []
    for i in range(150):
        w = [word() for _ in range(rng.randint(0, 700))]
        if i % 2:
            item = rng.choice(items).split()
            cut = rng.randint(0, len(item) // 4)
            at = rng.randint(0, len(w))
            w[at:at] = item[cut:] if i % 4 == 1 else item
        docs.append(" ".join(w))
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    want = set()
    for d, t in enumerate(docs):
        for i, s in enumerate(items):
            own = shingles(s.split())
            if own and len(own & shingles(t.split())) >= 0.8 * len(own) - 1e-9:
                want.add((d, i))
    rows = table(spark, [(i, t, "en", "s", 0) for i, t in enumerate(docs)])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contained_items(rows, bench).collect()} == want and len(want) > 40
    assert decontaminate.clean_documents(rows, bench).count() == 150 - len({d for d, _ in want})
    blocks = list(decontaminate.item_blocks(bench, limit=100))
    assert sum(len(ids) for ids, _ in blocks) == len(items) and len(blocks) > 2


def test_decontamination_odd_inputs(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two three"), (None, "word word word word word word")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contained_items(odd(spark), bench).collect()] == [(5, None)]
    assert decontaminate.contained_items(odd(spark), bench.limit(0)).count() == 0
    assert decontaminate.contained_items(empty(spark), bench).count() == 0
    assert decontaminate.clean_documents(odd(spark), bench).count() == len(ODD) - 1


# --- 5 ---------------------------------------------------------------------------------------------


def brute_repeats(docs):
    first = {}
    words = {i: (t or "").encode().split() for i, t in docs}
    for i in sorted(words):
        w = words[i]
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def test_repeats_against_brute_force(spark):
    rng = random.Random(5)
    passages = [[f"p{rng.randint(0, 10**6)}" for _ in range(n)] for n in (12, 13, 14, 30, 80)]
    docs = []
    for i in range(120):
        w = [rng.choice("abcdefgh") if i % 5 == 0 else f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        docs.append((i * 3 % 361, rng.choice([" ", "\n", "\t "]).join(w)))
    docs += [(1000 + i, docs[i][1]) for i in range(10)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(table(spark, [(i, t, "en", "s", 0) for i, t in docs]), chunk_bytes=3000).collect()}
    assert got == brute_repeats(docs)


def test_repeats_of_rows_without_id_are_spread_over_chunks(spark):
    rng = random.Random(4)
    shared = " ".join(f"s{k}" for k in range(20))
    rows = [(None if i % 3 else 7, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(30)) + " " + (shared if i % 2 else ""), "en", "s", 0) for i in range(120)] + [(3, shared, "en", "s", 0)]
    n_chunks = -(-sum(len(r[1].encode()) for r in rows) // 2000)
    dealt = table(spark, rows).filter("doc_id IS NULL").groupBy(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).alias("chunk")).count().collect()
    assert len(dealt) > n_chunks // 2 and max(r["count"] for r in dealt) < 40
    one, many = (sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(table(spark, rows), chunk_bytes=b).collect()) for b in (10**9, 2000))
    assert one == many and {r[2] for r in many if r[0] == 7} == {0, 20}


def test_repeats_odd_inputs(spark):
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(odd(spark)).collect()}
    assert (got[1].n_words, got[1].kept_text) == (0, "") and got[3].n_words == 0
    assert got[5].n_removed == 0 and got[4].n_removed == 0
    assert substring_dedup.remove_repeats(odd(spark)).count() == len(ODD)
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


# --- 6 and 8 ---------------------------------------------------------------------------------------


def synthetic(spark, n=500):
    rng = random.Random(6)
    syllables = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["schr", "ung", "eit", "ver"], "cc": ["ção", "ñe", "que", "ll"]}
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(sorted(syllables))
        w = ["".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            for k in range(max(1, len(w) // 20)):
                w[rng.randrange(len(w))] = "zgrob" + rng.choice(["ix", "ul", "ar", str(i)])
        rows.append((i, " ".join(w), lang, "s", 0))
        labels.append((i, 1, int(toxic)))
    return table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_from_training_folds_only(spark):
    docs, labels = synthetic(spark)
    out = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) for r in out) and len(held) > 50
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.9
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped).collect()}
    assert all(again[r.doc_id] == r.score for r in out)  # held-out labels do not matter


def test_folded_scores_equal_the_networks_forward_pass(spark):
    docs, labels = synthetic(spark, 200)
    model = toxicity.train(*toxicity.training_bags(docs, labels), epochs=3)
    got = {r.doc_id: r.score for r in toxicity.score(docs, *model.folded()).collect()}
    for r in docs.collect():
        bucket, _ = toxicity.features(pa.array([r.text]))
        assert abs(got[r.doc_id] - model.forward(bucket)) < 1e-4
    assert len({round(x, 3) for x in got.values()}) > 20


def test_toxicity_odd_inputs(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 8)] + [(2, 1, None)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(odd(spark), labels).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    none = toxicity.toxicity(odd(spark), labels.limit(0)).collect()
    assert all(r.score < 1e-6 for r in none)
    assert toxicity.toxicity(empty(spark), labels).count() == 0


def test_language_identification(spark):
    docs, _ = synthetic(spark)
    net = language_id.learn(docs)
    out = language_id.predict(docs, net).withColumn("held", language_id.held_out(F.col("doc_id"))).filter("held").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.95
    assert net.languages == ["aa", "bb", "cc"]
    odd_out = {r.doc_id: r for r in language_id.predict(odd(spark), net).collect()}
    assert len(odd_out) == len({r[0] for r in ODD})
    for i in (1, 2, 3):
        assert odd_out[i].lang_pred == "und" and odd_out[i].score == 0
    assert odd_out[4].lang_pred != "und"
    assert language_id.predict(empty(spark), net).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd(spark), language_id.learn(empty(spark))).collect()} == {"und"}
    kept = language_id.identified(odd(spark))
    assert kept.columns == odd(spark).columns and {r.letters for r in kept.collect()} == {"abc"}
    assert language_id.identified(empty(spark)).count() == 0


def test_language_stage_rejects_by_the_prediction(spark):
    docs, _ = synthetic(spark)
    docs = docs.unionByName(table(spark, [(9000, "kalomita mikalo tatalo " * 9, None, "s", 0), (9001, "kalo eitung qaoll xyzzy 0w " * 3, None, "s", 0)]))
    kept = {r.doc_id: r.lang for r in language_id.identified(docs, min_score=0.95).collect()}
    all_ = {r.doc_id: r.score for r in language_id.predict(docs, language_id.learn(docs)).collect()}
    assert set(kept) == {k for k, v in all_.items() if v >= 0.95} and kept[9000] == "aa"
    assert 400 < len(kept) < len(all_)
    only = {r.lang for r in language_id.identified(docs, languages=["bb"]).collect()}
    assert only == {"bb"}


def test_language_stage_acts_on_contradicted_labels(spark):
    docs, _ = synthetic(spark)
    wrong = table(spark, [(9000, "kalomita mikalo tatalo " * 9, "bb", "s", 0), (9001, "mita", "bb", "s", 0)])
    both = docs.unionByName(wrong)
    shown = {r.doc_id: r for r in language_id.predict(both, language_id.learn(both)).collect()}
    kept = {r.doc_id: r.lang for r in language_id.identified(both).collect()}
    for i, r in shown.items():
        contradicted = r.lang is not None and r.lang != r.lang_pred
        assert (i in kept) == (r.score >= language_id.MIN_SCORE and not (contradicted and r.score < language_id.SURE))
        assert i not in kept or kept[i] == r.lang_pred
    assert kept[9000] == "aa"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the given tables are not here")
def test_language_stage_changes_the_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    kept = language_id.identified(docs).select("doc_id", F.col("lang").alias("told"))
    both = docs.join(kept, "doc_id", "left").cache()
    dropped = both.filter("told IS NULL").count()
    relabelled = both.filter("told <> lang").count()
    assert 0 < dropped < 0.01 * both.count() and 0 < relabelled < 0.01 * both.count()


def test_tables_equal_the_convolution():
    net = language_id.ByteNet(["a", "b"])
    x = np.random.default_rng(1).integers(0, 256, (3, language_id.WINDOW)).astype(np.uint8)
    e = net.p["embed"][x]
    pooled = [np.stack([np.einsum("nkd,kdf->nf", e[:, i : i + w], net.p[f"f{w}"].reshape(w, language_id.DIM, -1)) for i in range(language_id.WINDOW - w + 1)]).max(0) + net.p[f"b{w}"] for w in language_id.WIDTHS]
    logits = np.maximum(np.concatenate(pooled, 1), 0) @ net.p["out"] + net.p["out_bias"]
    q = np.exp(logits - logits.max(1, keepdims=True))
    assert np.allclose(net.probabilities(x, net.tables()), q / q.sum(1, keepdims=True), atol=1e-5)


# --- 7 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["random", "clusters", "same", "few", "large"])
def test_dual_tree_is_exact(kind):
    rng = np.random.default_rng(7)
    n = 7 if kind == "few" else 1500
    x = {
        "random": lambda: rng.integers(-20, 20, (n, 64)),
        "clusters": lambda: rng.integers(-400, 400, (30, 8))[rng.integers(0, 30, n)] + rng.integers(-3, 4, (n, 8)),
        "same": lambda: np.tile(rng.integers(-9, 9, (1, 16)), (n, 1)),
        "few": lambda: rng.integers(-3, 3, (n, 4)),
        "large": lambda: rng.integers(-(2**28), 2**28, (n, 4)),
    }[kind]()
    ids = rng.permutation(n * 3)[:n]
    q = ids % 5 == 0 if kind != "few" else ids >= 0
    dual = cover_tree_topk.DualTree(ids[q], x[q], 20)
    for a in range(0, n, 500):
        dual.search(ids[a : a + 500], x[a : a + 500])
    least = np.iinfo(np.int64).min
    for r, (own, row) in enumerate(zip(ids[q], x[q] @ x.T)):
        want = sorted((-int(s), int(i)) for s, i in zip(row, ids) if i != own)[:20]
        assert want == [(-int(s), int(i)) for s, i in zip(dual.best.score[r], dual.best.id[r]) if s > least]
    assert dual.offered == q.sum() * n and dual.evaluated <= dual.offered
    if kind == "clusters":
        assert dual.evaluated < 0.5 * dual.offered  # node pairs were pruned


def test_cover_tree_invariants():
    rng = np.random.default_rng(17)
    x = rng.integers(-400, 400, (40, 6))[rng.integers(0, 40, 3000)] + rng.integers(-6, 7, (3000, 6))
    tree = cover_tree_topk.CoverTree(x, leaf=8)
    assert len(tree.centre) > 40 and np.array_equal(np.sort(tree.beneath(0)), np.arange(len(x)))
    for node, kids in enumerate(tree.children):
        under, centre = tree.beneath(node), x[tree.centre[node]]
        away = np.linalg.norm(x[under] - centre, axis=1)
        assert tree.centre[node] in under and away.max() <= tree.radii[node]
        if kids:
            own = x[[tree.centre[c] for c in kids]].astype(float)
            between = np.linalg.norm(own[:, None] - own[None], axis=2) + 1e9 * np.eye(len(kids))
            assert tree.centre[kids[0]] == tree.centre[node]  # nesting
            assert between.min() > away.max() / 2 * (1 - 1e-6)  # separation
            assert max(tree.radii[c] for c in kids) <= away.max() / 2 + 1e-3  # covering


def test_topk_odd_inputs(spark):
    nan = float("nan")
    rows = [(0, [0.5, -0.3]), (1, [0.5]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (20, [0.1, 0.2]), (20, [0.1, 0.2]), (None, [1.0, 1.0]), (5, [float("inf"), 0.0]), (6, [0.0, -0.001])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit(1), "rank": F.lit(2)})
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in cover_tree_topk.top_inner_products(t).collect())
    v = [(0, 32, -20), (1, 32, 0), (20, 6, 12), (20, 6, 12), (6, 0, -1)]  # of equal rows only the query's own is left out
    want = []
    for k, q in enumerate(v):
        if q[0] % 20 == 0:
            s = sorted((-(q[1] * b[1] + q[2] * b[2]), b[0]) for j, b in enumerate(v) if j != k)
            want += [(q[0], r + 1, i, -x) for r, (x, i) in enumerate(s)]
    assert got == sorted(want)
    assert cover_tree_topk.top_inner_products(t.limit(0)).count() == 0


# --- 9 ---------------------------------------------------------------------------------------------

HARD = ["a<|endoftext|>b", "a <|endoftext|> b", "a<|endoftext|> <|endoftext|>é", "<|endoftext|>  b", "", "  a  b\n\n c  d x y　z", "don't 's  it's\t x ", "“ q” x", "a \x1c b", "<|endoftext|> x", "日本 語 テスト", "é è  ü", "x ", " x", "  ", "\n", None, "a" * 3000, " 1 2 33 4.5 -- !! ?", "l'école d'ici l' 's", "tab\t tab \x85 nel  line"]


def test_token_files_round_trip(spark):
    from plumbline.session import new_path

    rng = random.Random(9)
    texts = HARD + [" ".join(rng.choice(["the", "of", "Wort", "señal", "été", "x1", "?!"]) for _ in range(rng.randint(0, 300))) for _ in range(80)]
    rows = [(i * 7 % 1009, t, "en", "s", 0) for i, t in enumerate(texts)]
    path = new_path(spark, "tokens")
    token_files.write_token_files(table(spark, rows), path, shard_tokens=2000)
    got = {r.doc_id: r for r in token_files.read_token_files(spark, path).collect()}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())  # a fresh one, nothing set
    start, held = 0, {}
    for i, t, *_ in sorted(rows):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        assert (got[i].start, got[i].n_tokens) == (start, len(ids)) and bytes(got[i].ids) == np.array(ids, "<u4").tobytes()
        start += len(ids)
        held[i] = ids
    assert spark.read.parquet(path).count() > 3
    checks = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(spark, path, digests=True).collect()}
    assert checks == {i: (got[i].start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in held.items()}
    wanted = [0, 262, 50256, held[7][0], 60_000_000]
    assert {r.token: r.n for r in token_files.token_counts(spark, path, wanted).collect()} == {t: sum(ids.count(t) for ids in held.values()) for t in wanted}
    for t in (0, 262):
        assert {(r.doc_id, r.place) for r in token_files.occurrences(spark, path, t).collect()} == {(i, k) for i, ids in held.items() for k, x in enumerate(ids) if x == t}


def test_token_files_order_rows_of_one_doc_id_by_text(spark):
    from plumbline.session import new_path

    rows = [(5, t, "en", "s", 0) for t in ("b b", None, "a", "", "a", "c c c")] + [(1, "x", "en", "s", 0)]
    seen = []
    for parts in (1, 3):
        path = new_path(spark, "tokens")
        token_files.write_token_files(table(spark, rows).repartition(parts), path)
        seen.append(sorted((r.start, r.n_tokens, bytes(r.ids)) for r in token_files.read_token_files(spark, path).collect()))
    assert seen[0] == seen[1] and len(seen[0]) == len(rows)


def test_token_files_odd_inputs(spark):
    from plumbline.session import new_path

    for docs, n in ((odd(spark), len(ODD)), (empty(spark), 0)):
        path = new_path(spark, "tokens")
        token_files.write_token_files(docs, path)
        assert token_files.read_token_files(spark, path).count() == n


def test_wavelet_matrix_queries():
    x = np.random.default_rng(9).integers(0, 50_000, 3000)
    x[::7] = 5
    m = token_files.WaveletMatrix.build(x, 16)
    assert (m.tokens() == x).all()
    for i in (0, 1, 511, 512, 2999):
        assert m.access(i) == x[i]
    for t in (5, int(x[3]), 49_999):
        at = np.flatnonzero(x == t)
        assert m.count(t) == len(at) and m.rank(t, 1000) == (x[:1000] == t).sum()
        assert [m.select(t, k) for k in range(len(at))] == at.tolist() and m.select(t, len(at)) == m.select(t, -1) == -1
    none = token_files.WaveletMatrix.build(x[:0], 16)
    assert len(none.tokens()) == 0 and none.count(3) == 0


# --- 10 --------------------------------------------------------------------------------------------


def unigram_library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(piece_scan.default_model(), "rb").read())
    m.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def whole(v, text):
    data = np.frombuffer(text.encode(), np.uint8)
    return v.encode_bytes(data, np.array([0, len(data)]))[0].tolist()


def test_pieces_equal_the_librarys_unigram_search():
    v, library, rng = piece_scan.vocabulary(piece_scan.default_model()), unigram_library(), random.Random(10)
    for _ in range(300):
        text = " ".join("".join(rng.choice("aeinorstlhdmucpgbfyvwkxqjz") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 12)))
        assert whole(v, " " + text) == library.encode(text)


def test_pieces_have_the_largest_score():
    v, rng = piece_scan.vocabulary(piece_scan.default_model()), random.Random(11)
    for text in [" ab\ncd 梦龘x", "   a", " " + "é" * 90, " " + "x" * 200, " " + "".join(rng.choice("我的一是不了人在有他中国大学日本語の東京") for _ in range(300)), *(" " + "".join(rng.choice("ab é\n梦龘") for _ in range(40)) for _ in range(30))]:
        data = text.encode()
        best, _ = v.lattice(data, {0: 0}, len(data))
        assert v.score[whole(v, text)].sum() == best[len(data)]


def test_any_cut_gives_the_whole_texts_pieces():
    v, rng = piece_scan.vocabulary(piece_scan.default_model()), random.Random(12)
    n = v.longest + 4
    for case in range(60):
        text = " " + "".join(rng.choice(["the ", "and", "er", "ing ", "é", "梦", "\n", "  ", "x"]) for _ in range(rng.randint(1, 120)))
        if case % 4 == 0:  # no space anywhere
            text = "".join(rng.choice("我的一是不了人在中国大学東京ab") for _ in range(rng.randint(100, 300)))
        size = rng.choice([1, 3, 7, 40, 90])
        parts = [text[k : k + size] for k in range(0, len(text), size)]
        now, made, matrices = np.full((1, n), piece_scan.NEVER, np.int64), [], []
        now[0, 0] = 0
        for k, part in enumerate(parts):
            look, before = text[(k + 1) * size :].encode()[:256], text[k * size - 1 : k * size].encode() if k else b""
            made.append(v.backtrace(part.encode(), look, before, {i: int(s) for i, s in enumerate(now[0]) if s > piece_scan.NEVER}))
            matrices.append(v.transfer(part.encode(), look, before))
            now = piece_scan.maxplus(now, matrices[-1])
        state, ids = 0, []
        for m in made[::-1]:
            own, state = m[state]
            ids = own + ids
        assert ids == whole(v, text) and now[0, 0] == v.score[ids].sum()
        if len(matrices) > 2:
            a, b, c = matrices[:3]
            assert (piece_scan.maxplus(piece_scan.maxplus(a, b), c) == piece_scan.maxplus(a, piece_scan.maxplus(b, c))).all()
        every = np.full((1, n), piece_scan.NEVER, np.int64)
        every[0, 0] = 0
        assert (piece_scan.maxplus(every, piece_scan.product(matrices)) == now).all()


def test_chunks_end_between_characters():
    for text in ["", "a", "é梦😀" * 50, "x" * 99, "ab梦" * 30]:
        data = np.frombuffer(text.encode(), np.uint8)
        for size in (4, 5, 7, 64):
            if len(data):
                ends = piece_scan.cut_bytes(data, size)
                assert ends[-1] == len(data) and "".join(bytes(data[a:b]).decode() for a, b in zip([0, *ends], ends)) == text
                assert np.diff([0, *ends]).max() <= size + 3


def test_encode_and_decode_giant_and_odd_texts(spark):
    texts = [(r[0], r[1]) for r in ODD] + [(50, "giant words here " * 300), (51, "y" * 900 + " 梦" * 400)]
    docs = table(spark, [(i, t, "en", "s", 0) for i, t in texts])
    small = {r.doc_id: bytes(r.ids) for r in piece_scan.encode(docs).collect()}
    cut = piece_scan.decode(piece_scan.encode(docs, chunk_bytes=500, fan=3)).collect()
    assert len(cut) == len(texts)
    for r in cut:
        assert bytes(r.ids) == small[r.doc_id]
        assert r.decoded == (dict(texts)[r.doc_id] or "").replace("▁", " ")
    assert piece_scan.encode(empty(spark)).count() == 0
    assert piece_scan.digest(odd(spark)).filter("not round_trip").count() == 0


# --- the pipeline ----------------------------------------------------------------------------------


def test_pipeline_stages_keep_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    clean = [(i, " ".join(f"wort{rng.randint(0, 10**6)}" for _ in range(50)) + "\n" + f"line {i}", "en", f"s{i % 10}", 400) for i in range(40)]
    item = " ".join(f"item{k}" for k in range(30))
    rows = clean + [
        (100, clean[0][1], "en", "s1", 400),  # a copy
        (101, clean[1][1].replace(" ", " x ", 1), "en", "s1", 400),  # a near copy
        (102, "before " + item + " after", "en", "s1", 400),
        (103, "123 ... !!", "en", "s1", 10),
        (104, None, "en", "s1", None),
    ]
    rows += [(200 + i, f"own{i} " * 9 + "\nsame line everywhere", "en", f"s{i}", 30) for i in range(10)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, str(tmp_path))
        assert seen.columns == docs.columns, name
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert kept == {r[0] for r in clean} | {200 + i for i in range(10)}
    assert {r.text.split("\n")[-1] for r in seen.filter("doc_id >= 200").collect()} == {f"own{i} " * 9 for i in range(10)}


def test_pipeline_stages_on_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "word word word word word word word"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd(spark), empty(spark)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= n, name
            if n:
                assert {(r.n_lines, r.n_removed, r.letters, r.score) for r in out.collect()} == {(-1, -2, "abc", 0.5)}, name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert last.columns == ["doc_id", "n_pieces", "score", "ids"] and last.count() == n
    assert {r.doc_id for r in corpus_pipeline.with_language(spark, odd(spark), str(tmp_path)).collect()} >= {4, 5}
    assert corpus_pipeline.without_benchmark(spark, odd(spark), str(tmp_path)).filter("doc_id = 5").count() == 0
    odd(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {None, 4, 6, 7}


def test_token_files_special_literals_against_a_fresh_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = token_files.default_tokenizer()
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b c", "one two  <|endoftext|>  three", "<|endoftext|> <|endoftext|> é <|endof text|>", "plain words"]
    ids, counts = token_files.Encoder(path).encode_texts(pa.array(texts))
    fresh = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(fresh, []) and counts.tolist() == [len(f) for f in fresh]


def test_segments_of_one_hash_keep_their_own_ids(monkeypatch):
    from plumbline.llm import segments

    def encode(parts):
        return np.array([b for p in parts for b in p], np.int32), np.array([len(p) for p in parts], np.int64)

    words_ = [b"alpha", b"beta", b"", b"gamma", b"alpha", b"delta", b"betb", b"beta"]
    data = np.frombuffer(b"".join(words_), np.uint8)
    end = np.cumsum([len(w) for w in words_])
    start = end - [len(w) for w in words_]
    for hash_ in (None, lambda d, a, b: np.zeros(len(a), np.uint64), lambda d, a, b: (b - a).astype(np.uint64)):
        if hash_:
            monkeypatch.setattr(segments, "span_hashes", hash_)
        for most in (1000, 3):  # emptied in between
            store = segments.SegmentStore(encode, most)
            for _ in range(3):
                where, length = store.spans(data, start, end)
                assert [bytes(store.pool[w : w + n].astype(np.uint8)) for w, n in zip(where, length)] == words_

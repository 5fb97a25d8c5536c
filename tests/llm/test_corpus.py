"""The corpus operators against brute force, and on nulls, empty and very long texts, repeated rows and empty tables."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, size long, n string, score string"


def docs_of(spark, texts, start=0):
    """Documents with columns whose names clash with those that operators use."""
    return spark.createDataFrame([(start + i, t, "en", "s", 0, 1, 2, "x", "y") for i, t in enumerate(texts)], DOCS)


def words(t, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def sample(seed, n, vocabulary=200, size=60):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(1, size))) for _ in range(n)]


ODD = [None, "", " \t\n", "a", "A  b", "a b", "é ▁ x y", "x" * 5000, "one two " * 4000]


def test_words():
    from segloom.llm.words import NOT_ALNUM, SPACES, Lexer, runs

    texts = ["A b  c", None, "", "a B c d", "xé-y z", " tail "]
    for delimiters, pattern in ((SPACES, r"[^\x20\x09-\x0D]+"), (NOT_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        code = {}
        for most in (3, 1 << 20):
            for block in Lexer(delimiters).blocks(pa.array(texts).slice(0), most):
                for k in range(len(block.first) - 1):
                    mine = words(texts[block.rows.start + k], pattern)
                    got = block.code[block.first[k] : block.first[k + 1]].tolist()
                    assert len(got) == len(mine)
                    for w, c in zip(mine, got, strict=True):
                        assert code.setdefault(w, c) == c
        assert len(set(code.values())) == len(code)
    made, offsets = runs(np.arange(1, 8, dtype=np.uint64), np.array([0, 0, 2, 7]), 3)
    assert np.diff(offsets).tolist() == [0, 1, 3] and len(set(made.tolist())) == 4


def test_exact_groups(spark):
    from segloom.llm.exact_dedup import drop_exact_copies, exact_groups

    texts = [*ODD, *ODD, "a\tb", *sample(1, 30, 3, 4)]
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    for every, limits in ((False, {}), (True, {}), (False, {"most": 1, "hot": 2}), (False, {"most": 6, "hot": 2}), (True, {"most": 1, "hot": 2})):
        got = {r.doc_id: r for r in exact_groups(docs_of(spark, texts), digest_all=every, **limits).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(norm):
            same = [j for j, u in enumerate(norm) if u == t]
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (same[0], len(same), same[0] == i)
            if every:
                assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    kept = drop_exact_copies(docs_of(spark, texts))
    assert kept.count() == len(set(norm)) and kept.columns == docs_of(spark, []).columns
    assert exact_groups(docs_of(spark, [])).count() == 0
    twice = docs_of(spark, ["q", None]).unionByName(docs_of(spark, ["q"]))
    assert [r.kept for r in exact_groups(twice).where("keep_id = 0").collect()] == [True, True]


def test_hilbert_curve(spark):
    from segloom.llm.hilbert_sharding import hilbert_index

    n = 16
    cells = spark.range(n**3).select((F.col("id") % n).cast("int").alias("x"), F.expr(f"CAST(id div {n} % {n} AS INT)").alias("y"), F.expr(f"CAST(id div {n * n} AS INT)").alias("z"))
    rows = cells.select("x", "y", "z", hilbert_index([F.col("x"), F.col("y"), F.col("z")], 4).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(n**3))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_shards(spark, sf, tmp_path):
    from segloom.llm.hilbert_sharding import assign_shards, write_shards
    from segloom.llm.queries import QUERIES

    for df in (QUERIES["op8_hilbert_sharding"](spark, sf), assign_shards(docs_of(spark, [*ODD, *["same"] * 50]))):
        rows = df.select("shard", "slot", "size", "text_crc32").collect()
        by = collections.defaultdict(list)
        for r in rows:
            by[r.shard].append(r.slot)
        assert max(map(len, by.values())) - min([len(by[s]) for s in range(40)]) <= 1 and set(by) <= set(range(40))
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert assign_shards(docs_of(spark, [])).count() == 0
    write_shards(assign_shards(docs_of(spark, ODD), 3), f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == len(ODD)


def test_shards_of_long_prefixes(spark):
    from segloom.llm.hilbert_sharding import assign_shards, text_cuts

    rng = random.Random(3)
    names = [f"https://example.org/common_crawl_{k:02d}" for k in range(20)]
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(names) if i % 3 else names[0], None if i % 7 == 0 else "en", i % 5, "x") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, part int, AT string")
    ordered = sorted(r[2] for r in rows)
    want = sorted({ordered[-(-i * len(rows) // 16) - 1] for i in range(1, 16)})
    assert text_cuts(docs, "source") == want and len(want) > 8
    out = assign_shards(docs, 8).orderBy("doc_id").collect()
    assert [(r.doc_id, r.part, r.AT) for r in out] == [(r[0], r[4], "x") for r in rows]
    # a shard holds a few neighbouring sources, so that files can be pruned on them
    assert max(len({r.source for r in out if r.shard == s}) for s in range(8)) < len(names)


def links(texts, percent):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


@pytest.mark.parametrize(("node", "depth"), [(2048, None), (8, None), (4, 2)])
def test_near_duplicates(spark, node, depth):
    from segloom.llm.near_dedup import drop_near_duplicates, near_duplicates

    rng = random.Random(3)
    texts = [*ODD, *ODD[:6]]
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(120)]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(9)}"
            texts.append(" ".join(copy))
    sizes, wanted = links(texts, 85)
    got = {r.doc_id: r for r in near_duplicates(docs_of(spark, texts), node=node, depth=depth).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == wanted
    kept = drop_near_duplicates(docs_of(spark, texts))
    assert kept.count() == len(set(wanted)) and kept.columns == docs_of(spark, []).columns


def test_large_groups_of_near_copies(spark, monkeypatch, seed=2):
    """Groups many times as large as a node, with copies that drift away from the first, and one like them but apart."""
    from segloom.llm import near_dedup

    rng = random.Random(seed)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    cousin = [w if rng.random() < 0.93 else f"c{rng.randrange(900)}" for w in base]
    texts = []
    for source, n in ((base, 90), (cousin, 60), ([f"v{rng.randrange(900)}" for _ in range(150)], 50)):
        mine = [source]
        for _ in range(n):
            copy = list(rng.choice(mine[-8:]))
            for _ in range(rng.randrange(1, 4)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            mine.append(copy)
            texts.append(" ".join(copy))
    texts += sample(seed, 40, 50, 30)
    rng.shuffle(texts)
    seen = []
    hubs = near_dedup._hubs
    monkeypatch.setattr(near_dedup, "_hubs", lambda *a: seen.append(hubs(*a)) or seen[-1])
    sizes, wanted = links(texts, 85)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs_of(spark, texts), node=8).collect()}
    assert [got[i].component_id for i in range(len(texts))] == wanted
    assert any(x is not None for x in seen) and len(set(wanted)) > 30


@pytest.mark.parametrize("percent", [85, 80])
def test_recall_by_depth(percent):
    """Of pairs of token rows that agree as texts at the threshold do, as many are still together after some steps as computed."""
    from segloom.llm.near_dedup import TOKENS, _children, deepest, recall_at

    rng, pairs, trees = np.random.default_rng(percent), 600, 12
    a = rng.integers(0, 1 << 32, (pairs, TOKENS), dtype=np.uint64).astype(np.uint32)
    b = np.where(rng.random(a.shape) < percent / 100, a, rng.integers(0, 1 << 32, a.shape, dtype=np.uint64).astype(np.uint32))
    together, nodes = {}, [(np.full(pairs, t, np.uint64), np.arange(pairs)) for t in range(1, trees + 1)]
    for depth in range(1, 19):
        after = []
        for node, rows in nodes:
            x, y = (_children(node, rows, tokens, 0.0 if depth == 1 else 100 / percent - 1) for tokens in (a, b))
            same = x[0] == y[0]  # children of one node in one order
            after.append((x[0][same], x[1][same]))
        nodes = after
        together[depth] = len({r for _, rows in nodes for r in rows.tolist()}) / pairs
    for depth, share in together.items():
        assert abs(share - recall_at(depth, percent, trees)) < 0.02, (depth, share)
    assert together[deepest(percent, trees)] > 0.975 and recall_at(deepest(percent, trees), percent, trees) >= 0.99


@pytest.mark.parametrize("percent", [85, 80])
def test_recall_against_all_pairs(spark, percent):
    from segloom.llm.near_dedup import near_duplicates

    rng, texts = random.Random(percent), []
    for _ in range(60):  # pairs about the threshold
        base = [f"w{rng.randrange(400)}" for _ in range(160)]
        copy = list(base)
        for _ in range(rng.randrange(1, 5)):
            copy[rng.randrange(160)] = f"e{rng.randrange(99)}"
        texts += [" ".join(base), " ".join(copy)]
    _, wanted = links(texts, percent)
    for node in (8,):
        got = {r.doc_id: r.component_id for r in near_duplicates(docs_of(spark, texts), percent=percent, node=node).collect()}
        linked = [i for i, c in enumerate(wanted) if c != i]
        assert len(linked) > 20 and sum(got[i] == wanted[i] for i in linked) >= 0.99 * len(linked)
        assert all(got[i] in (i, c) for i, c in enumerate(wanted))


def test_hot_keys(spark):
    """One text, line and page in a third of all rows, with limits so small that no table is broadcast whole."""
    from segloom.llm.near_dedup import near_duplicates
    from segloom.llm.repeated_spans import drop_repeated_spans
    from segloom.llm.warc import archive_folder, read_records, write_archives

    rng, small = random.Random(9), {"most": 1, "hot": 5}
    line = " ".join(f"l{i}" for i in range(60)) + ". "
    texts = [t for k, x in enumerate(sample(9, 60, 5000, 90)) for t in ((line + x, "the same text of six words", x + " " + line) if k % 2 else (x, x, line + x))]
    rng.shuffle(texts)
    docs = docs_of(spark, texts)
    every = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
    assert every(near_duplicates(docs, **small)) == every(near_duplicates(docs))
    assert every(drop_repeated_spans(docs, **small)) == every(drop_repeated_spans(docs))
    assert sum(line.strip() in r.text for r in drop_repeated_spans(docs, **small).collect()) == 1
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    folder = archive_folder(spark)
    got = {r.id: r.refers_to for r in read_records(write_archives(pages, folder, **small), folder).collect()}
    assert got == {i: (None if texts.index(t) == i else texts.index(t)) for i, t in enumerate(texts)}


def test_near_duplicates_odd_rows(spark):
    from segloom.llm.near_dedup import near_duplicates

    assert near_duplicates(docs_of(spark, [])).count() == 0
    rows = docs_of(spark, ["a b", "a b"]).unionByName(docs_of(spark, ["a b"])).unionByName(docs_of(spark, ["a b"]).withColumn("doc_id", F.lit(None).cast("long")))
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_duplicates(rows).collect())
    assert got == [("0", "0", True), ("0", "0", True), ("1", "0", False), ("None", "None", True)]


def test_components(spark):
    from segloom.llm.common import connected_components, stored

    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 540)]
    up = {x: x for p in pairs for x in p}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    table = stored(spark.createDataFrame(pairs, "a long, b long").repartition(4), "pairs")
    for each in (1_000_000, 60):
        got = {r.node: r.component for r in connected_components(table, each).collect()}
        assert got == {x: root(x) for p in pairs if p[0] != p[1] for x in p}


def test_benchmark_hits(spark):
    from segloom.llm.decontaminate import benchmark_hits, drop_contaminated

    texts = [*ODD, *sample(2, 40, 6, 120)]
    items = [("b", "w1 w2"), ("a", None), ("c", "!!"), *[(f"i{k}", t) for k, t in enumerate(sample(3, 10, 6, 40))], ("i0", "w1 w2"), (None, "w3 w4")]
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    bench = spark.createDataFrame(items, "item_id string, text string")
    for options in ({}, {"shard_bytes": 100}, {"bench_bytes": 300}):
        got = {r.doc_id: r for r in benchmark_hits(docs_of(spark, texts), bench, **options).collect()}
        for i, t in enumerate(texts):
            w = words(t, pattern)
            hit, seen = set(), set()
            for name, x in items:
                v = words(x, pattern)
                k = min(10, len(v))
                for a in range(len(v) - k + 1 if v else 0):
                    for b in range(len(w) - k + 1):
                        if w[b : b + k] == v[a : a + k]:
                            hit |= set(range(b, b + k))
                            seen.add(name or "null")
            flat = got[i].hit_spans
            mine = {x for a, b in zip(flat[::2], flat[1::2], strict=True) for x in range(a, b)}
            assert (got[i].n_words, mine, got[i].item_ids) == (len(w), hit, sorted(seen))
    assert benchmark_hits(docs_of(spark, texts), bench.where("false")).where("size(hit_spans) > 0").count() == 0
    assert benchmark_hits(docs_of(spark, []), bench).count() == 0
    clean = drop_contaminated(docs_of(spark, ["w1 w2", "w9"]), bench)
    assert [r.doc_id for r in clean.collect()] == [1]


def test_longest_matches(spark):
    from segloom.llm.decontaminate import benchmark_hits

    stem = [f"s{i}" for i in range(10)]
    a, b = [*stem, "a1", "a2"], [*stem, *(f"b{i}" for i in range(30))]
    first, second = [f"f{i}" for i in range(12)], [f"g{i}" for i in range(12)]
    third = ["f11", *second]  # begins with the last word of the item before
    items = [("a", a), ("b", b), ("f", first), ("g", second), ("h", first), ("i", third), ("short", ["x", "y"]), *[(f"i{k}", x.split()) for k, x in enumerate(sample(3, 10, 3, 40))]]
    texts = [b, ["z", *b, "z"], [*a, *b[10:]], [*first, *second], ["f11", *second], ["f11", "z", *second], ["x", "y", *stem], [], *[x.split() for x in sample(2, 30, 3, 120)]]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id string, text string")
    for options in ({}, {"shard_bytes": 100}, {"bench_bytes": 300}):
        got = {r.doc_id: r for r in benchmark_hits(docs_of(spark, [" ".join(w) for w in texts]), bench, **options).collect()}
        for i, w in enumerate(texts):
            best = (0, 0, "")
            for name, v in items:
                for p in range(len(v)):
                    for q in range(len(w)):
                        n = 0
                        while p + n < len(v) and q + n < len(w) and v[p + n] == w[q + n]:
                            n += 1
                        if n >= 10 or (n == len(v) and p == 0):
                            best = min(best, (-n, q, name))
            assert (-got[i].longest_words, got[i].longest_at, got[i].longest_item or "") == best
    assert got[0].longest_words == 40 and got[0].longest_item == "b"


def test_suffix_array():
    from segloom.llm.decontaminate import suffix_array

    rng = np.random.default_rng(1)
    for _ in range(20):
        codes = rng.integers(1, 4, 60).astype(np.uint64)
        order = suffix_array(codes, 16)
        keys = [codes[i : i + 16].tolist() for i in order]
        assert keys == sorted(keys) and sorted(order.tolist()) == list(range(60))


def test_toxicity(spark, sf):
    from segloom.llm.toxicity import score_toxicity

    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    scores = score_toxicity(d, labels.where(~held)).join(labels, "doc_id").where(held).toPandas()
    a, b = scores.score[scores.toxic == 1], scores.score[scores.toxic == 0]
    assert len(a) and (a.to_numpy()[:, None] > b.to_numpy()[None, :]).mean() > 0.85  # some 300 labelled rows; 1.0 with 15,000
    odd = score_toxicity(docs_of(spark, ODD), labels.limit(0))
    assert {r.score for r in odd.collect()} == {0.0} and odd.count() == len(ODD)
    few = docs_of(spark, [*ODD, "you idiot you", "fine day"])
    marked = spark.createDataFrame([(len(ODD), 1, 0), (len(ODD) + 1, 0, 0), (None, 1, 0)], "doc_id long, toxic int, text int")
    assert all(0 <= r.score <= 1 for r in score_toxicity(few, marked).collect())


def test_label_model():
    from segloom.llm.toxicity import fit_label_model

    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.2
    hit, false = np.array([0.7, 0.5, 0.6, 0.6, 0.1]), np.array([0.05, 0.1, 0.02, 0.02, 0.1])
    votes = (rng.random((20000, 5)) < np.where(y[:, None], hit, false)).astype(float)
    votes[:, 3] = votes[:, 2]  # a copy of another voter
    model = fit_label_model(votes.T @ votes, len(y), votes[:300], y[:300].astype(float))
    assert np.abs(model.hit[:3] - hit[:3]).max() < 0.12 and model.discount[2] < 0.8 < model.discount[0] + 0.2
    z = model.logit(votes)
    assert z[y].mean() > z[~y].mean() + 2


def test_quality(spark):
    from segloom.llm.quality import keep_selected, resample, top_k_threshold
    from segloom.llm.common import stored

    good, junk = sample(7, 60, 50, 60), ["#$% zz! " * 30] * 30
    rows = docs_of(spark, [*good, *junk, *ODD[:3]])
    target = spark.range(40).select(F.col("id").alias("doc_id"))
    got = {r.doc_id: r.selected for r in resample(rows, target).collect()}
    assert all(got[i] for i in range(60)) and not any(got[i] for i in range(60, 90)) and all(got[i] for i in (90, 91, 92))
    assert keep_selected(rows, target).columns == rows.columns
    assert resample(rows, target.limit(0)).where("selected").count() == 93 and resample(docs_of(spark, []), target).count() == 0
    assert resample(rows, target, k=10).where("selected").count() == 10
    values = [random.Random(i).choice([1.0, 2.0, random.Random(i).random() * 9]) for i in range(500)]
    table = stored(spark.createDataFrame([(v,) for v in values], "v double"), "values")
    for k in (1, 7, 250, 499):
        assert top_k_threshold(table, "v", k, 8) == sorted(values, reverse=True)[k - 1]


def test_quality_weights(spark):
    """Weights, noise, size and members of the sample from counts of the words and word pairs themselves."""
    import math

    from segloom.llm.quality import BUCKETS, gumbel, resample

    texts = [*sample(31, 80, 6, 40), *(" ".join(random.Random(i).choice(["w7", "w8", "w1"]) for _ in range(30)) for i in range(40)), None, "", "w1"]
    rows, target = docs_of(spark, texts), spark.range(60).select(F.col("id").alias("doc_id"))
    fits = {r.doc_id for r in target.where(F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(4)) != 0).collect()}
    noise = {r.doc_id: r.g for r in rows.select("doc_id", gumbel(7, "doc_id").alias("g")).collect()}

    def grams(t):
        w = (t or "").split()
        return [*w, *("twice" if a == b else (a, b) for a, b in zip(w, w[1:], strict=False))]

    raw, good = (collections.Counter(g for i, t in enumerate(texts) if pick(i) for g in grams(t)) for pick in (lambda i: True, fits.__contains__))
    share = lambda c, g: math.log((c[g] + 1) / (sum(c.values()) + BUCKETS))
    weight = [sum(share(good, g) - share(raw, g) for g in grams(t)) for t in texts]
    got = {r.doc_id: r for r in resample(rows, target).collect()}
    for i, x in enumerate(weight):
        assert (got[i].n_grams, got[i].log_weight, got[i].gumbel_score) == (len(grams(texts[i])), pytest.approx(x, abs=1e-9), pytest.approx(x + noise[i], abs=1e-9))
    low = min(min(weight[i] for i in set(range(60)) - fits), 0.0) - 8
    k = sum(x >= low for x in weight)
    best = sorted(range(len(texts)), key=lambda i: -(weight[i] + noise[i]))
    assert {i for i in got if got[i].selected} == set(best[:k]) and 60 <= k < len(texts)
    assert {r.doc_id for r in resample(rows, target, k=25).where("selected").collect()} == set(best[:25])


def test_chat(spark):
    from segloom.llm.chat import BODY, END, TURN, escape, format_conversations, read_back, unescape

    rng = random.Random(2)
    bits = ["<", "|", "~", "<|", "<~|", TURN, BODY, END, "</s>", " hi\n", "é", "<|endoftext|>", "日本"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(300)]
    assert all(unescape(escape(t)) == t and "<|" not in escape(t) for t in texts) and len({escape(t) for t in texts}) == len(set(texts))
    rows = [(k // 7 if k < 210 else 99, k, rng.choice(["user", "assistant", None, "sys<|end|>"]), rng.choice([t, None]), 5) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    for part in (1 << 20, 40):
        got = {r.conv: r for r in read_back(format_conversations(df, part_chars=part)).collect()}
        for c in {r[0] for r in rows}:
            mine = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
            said = "".join(t for r, t in mine if r == "assistant")
            assert got[c].n_turns == len(mine) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
            assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert read_back(format_conversations(df.where("false"))).count() == 0


def test_warc(spark):
    from segloom.llm.warc import archive_folder, read_records, write_archives

    html = ["<p>a</p>", None, "", "<p>a</p>", "é" * 3000, "x\r\n\r\ny", "<p>a</p>"]
    rows = [(10 - i, f"http://x/{i}\n" if i else None, h, "p") for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    for size in (1 << 28, 200):
        folder = archive_folder(spark)
        index = write_archives(pages, folder, archive_bytes=size)
        got = {r.id: r for r in read_records(index, folder, payloads=True).collect()}
        for page, url, h, _ in rows:
            raw = (h or "").encode()
            first = min(p for p, _, x, _ in rows if (x or "").encode() == raw)
            r = got[page]
            assert (r.payload_bytes, r.digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
            assert (r.record_type, r.refers_to) == (("response", None) if first == page else ("revisit", first))
            assert r.payload == (raw if first == page else None) and r.url == (url and url.replace("\n", "%0A"))
        some = read_records(index.where("id % 2 = 0"), folder).collect()
        assert sorted(r.id for r in some) == [p for p in sorted(got) if p % 2 == 0]
    assert write_archives(pages.where("false"), archive_folder(spark)).count() == 0


def test_repeated_spans(spark):
    from segloom.llm.repeated_spans import drop_repeated_spans

    sentence = lambda k, n=20: " ".join(f"s{k}x{i}" for i in range(n)) + "."
    passage = f"{sentence(1)} {sentence(2)}\n{sentence(3)}"
    texts = [f"{sentence(10)} {passage} {sentence(11)}", f"{sentence(12)}\n{passage.upper()}\n{sentence(13)}", f"{sentence(14)} {sentence(1)}", f"{sentence(15, 60)} tail.", f"head. {sentence(15, 60)}", f"{passage} {passage}", *ODD]
    got = {r.doc_id: r for r in drop_repeated_spans(docs_of(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[0].n_removed == 0
    assert got[1].text == f"{sentence(12)}\n{sentence(13)}" and got[1].n_removed == 3
    assert got[2].text == texts[2] and got[3].text == texts[3] and got[4].text == "head. " and got[5].text == ""
    for i, t in enumerate(ODD[:7]):
        assert got[6 + i].text == t
    assert drop_repeated_spans(docs_of(spark, [])).count() == 0


def test_repeated_stretches(spark):
    from segloom.llm.repeated_spans import drop_repeated_spans

    rng = random.Random(11)
    new = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    stretch = new(70)
    stretch[29] += "."  # 30 + 25 words and more, the first glued to the words before it
    plain, short = new(50), new(49)
    loop = (["one", "two"] * 80)
    texts = [[*new(9), *stretch, *new(9)], [*new(4), *stretch, *new(30)], [*new(7), *plain], [*plain, *new(3)], [*short, *new(5)], [*new(5), *short], [*stretch[:40], *new(20), *stretch[20:70]], loop, [*plain[:25], *new(1), *plain[25:]]]
    size = 50
    seen, wanted = set(), []
    for w in texts:
        gone, own = set(), {}
        for i in range(len(w) - size + 1):
            x = tuple(w[i : i + size])
            if x in seen or i >= own.setdefault(x, i) + size:
                gone |= set(range(i, i + size))
        seen |= set(own)
        wanted.append([x for i, x in enumerate(w) if i not in gone])
    got = {r.doc_id: r for r in drop_repeated_spans(docs_of(spark, [" ".join(w) for w in texts])).collect()}
    assert [got[i].text.split() for i in range(len(texts))] == wanted
    assert [len(w) - len(x) for w, x in zip(texts, wanted, strict=True)] == [0, 70, 0, 50, 0, 0, 50, 110, 0]
    assert [got[i].n_removed > 0 for i in range(len(texts))] == [w != x for w, x in zip(texts, wanted, strict=True)]


def slow_spans(texts):
    """What repeated runs leave of texts given as sentences (lists of words): words that no later run covers."""
    seen, out = {"run": set(), "stretch": set()}, []
    for sentences in texts:
        w, gone, own = [x.lower() for s in sentences for x in s], set(), {"run": {}, "stretch": {}}
        at = [0, *np.cumsum([len(s) for s in sentences]).tolist()]
        found = []
        for i, s in enumerate(sentences):
            e = i + 1
            while len(s) < 50 and e <= len(sentences) and (e < i + 2 or at[e] - at[i] < 25):
                e += 1
            if e <= len(sentences):
                found.append(("run", at[i], at[e]))
        found += [("stretch", i, i + 50) for i in range(len(w) - 49)]
        for kind, a, b in found:
            x = tuple(w[a:b])
            first = own[kind].setdefault(x, (a, b))
            if x in seen[kind] or (a > first[0] if kind == "run" else a >= first[1]):
                gone |= set(range(a, b))
        for kind in seen:
            seen[kind] |= set(own[kind])
        out.append([x for i, x in enumerate(x for s in sentences for x in s) if i not in gone])
    return out


def test_repeated_spans_leave_no_shuffle_files(spark, monkeypatch):
    import time

    from segloom.llm import repeated_spans

    def files():
        every = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(every.size()) if (name := every.apply(i).getName()).startswith("shuffle_")}

    steps, stored = [], repeated_spans.stored

    def watched(df, name):
        before = files()
        out = stored(df, name)
        steps.append(name)
        until = time.time() + 10  # they are removed in the background
        while files() - before and time.time() < until:
            time.sleep(0.05)
        assert not files() - before, name
        return out

    monkeypatch.setattr(repeated_spans, "stored", watched)
    texts = sample(5, 40, vocabulary=10_000, size=200)
    docs = docs_of(spark, [*texts, *texts])
    out = repeated_spans.drop_repeated_spans(docs)
    assert steps == ["repeated_anchors", "repeated_runs", "later_runs"]
    assert out.where("n_removed > 0").count() > 0
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_sentence_runs_against_all_runs(spark):
    from segloom.llm.repeated_spans import drop_repeated_spans

    rng = random.Random(21)
    pool = [[*(f"p{k}x{i}" for i in range(rng.choice([5, 9, 14, 26, 51]))), f"end{k}."] for k in range(14)]
    texts = []
    for _ in range(60):
        some = [list(rng.choice(pool)) for _ in range(rng.randrange(1, 9))]
        if rng.random() < 0.4:
            rng.choice(some)[0] += str(rng.randrange(10**6))
        if rng.random() < 0.3:
            some = [[x.upper() for x in s] for s in some]
        texts.append(some)
    rows = [rng.choice([" ", "\n", "  \n"]).join(" ".join(s) for s in t) for t in texts]
    for limits in ({}, {"most": 1, "hot": 3}):
        got = {r.doc_id: r for r in drop_repeated_spans(docs_of(spark, rows), **limits).collect()}
        wanted = slow_spans(texts)
        assert [got[i].text.split() for i in range(len(texts))] == wanted and [got[i].n_sentences for i in range(len(texts))] == [len(t) for t in texts]
    assert 10 < sum(len(x) < sum(map(len, t)) for x, t in zip(wanted, texts, strict=True)) < 60
    odd = {r.doc_id: r.text for r in drop_repeated_spans(docs_of(spark, ODD)).collect()}
    for i, t in enumerate(ODD):
        assert odd[i] == t if i < 8 else odd[i].split() == slow_spans([[t.split()]])[0]


def every_path(chunk, known):
    out = []

    def go(at, score, ids):
        if at == len(chunk):
            out.append((score, ids))
            return
        for e in range(at + 1, min(len(chunk), at + known.longest) + 1):
            for s, more, new in known.edges(chunk)[e]:
                if s == at:
                    go(e, score + more, ids + new)

    go(0, 0.0, ())
    return sorted(out, key=lambda x: -x[0])


def test_pieces(spark):
    from segloom.llm.pieces import MODEL, decode, encode, encode_checked, nbest_chunk, vocabulary

    known = vocabulary(MODEL)
    for chunk in (" hello", "  a", " éx", "\n", " x執▁"):
        full, few = every_path(chunk.encode(), known), nbest_chunk(chunk.encode(), 4, known)
        assert [x for x, _ in few] == pytest.approx([x for x, _ in full[:4]])
    texts = [*ODD, "the cat  sat\non é mats ", "y" * 90, "a line\n" + "#" * 401 + "\n" + "-" * 801, "=" * 100_000, "漢字仮名" * 20_000, base64.b64encode(random.Random(5).randbytes(150_000)).decode()]
    got = {r.doc_id: r for r in decode(encode(docs_of(spark, texts))).collect()}
    for i, t in enumerate(texts):
        assert got[i].decoded == (t or "") and got[i].others_decode
        if t and len(t) < 12:
            full = every_path((" " + t).encode(), known)
            assert got[i].score == pytest.approx(full[0][0])
            assert list(got[i].other_scores) == pytest.approx([x for x, _ in full[1:3]])
    for r in encode_checked(docs_of(spark, texts)).collect():
        assert r.round_trip and r.others_decode and r.ids == got[r.doc_id].ids
    assert encode(docs_of(spark, [])).count() == 0


def test_nbest_of_ties_and_long_chunks():
    import resource

    from segloom.llm.pieces import MODEL, _alone, _Lattice, _lattice, _nbest, nbest_chunk, vocabulary

    known, rng = vocabulary(MODEL), random.Random(1)
    for _ in range(150):
        chunk = (" " + "".join(rng.choice(["a", "e", "the", "#", "-", "x", "é", "漢", "=="]) for _ in range(rng.randrange(1, 5)))).encode()
        full = every_path(chunk, known)
        for n in (1, 3, 6):
            few = nbest_chunk(chunk, n, known)
            assert [x for x, _ in few] == pytest.approx([x for x, _ in full[:n]])
            assert len({ids for _, ids in few}) == len(few) and {ids for _, ids in few} <= {tuple(ids) for _, ids in full}
        small, (edges, ahead, second) = _Lattice(chunk, known, window=5), _lattice(chunk, known)
        best, other = small.forward()
        assert list(best) == list(ahead) and other == second
        assert [small[e] for e in range(1, len(chunk) + 1)] == edges[1:]
        assert _nbest(small, best, len(chunk), 3) == nbest_chunk(chunk, 3, known)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for chunk in (b" " + b"y" * 1601, b"#" * 100_000, "漢字仮名交じり文".encode() * 12_000, base64.b64encode(rng.randbytes(225_000))):
        few = nbest_chunk(chunk, 3, known)
        ids, best, second = _alone(chunk, known)
        assert few[0] == (best, tuple(ids)) and (len(few) == 1 or few[1][0] == second)
        for _, ids in few:
            assert b"".join(known.text[i] for i in ids) == chunk
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 << 10


def test_pieces_memory():
    from segloom.llm.pieces import _Block, _codes, _Known, vocabulary, MODEL
    from segloom.llm.words import Lexer

    known, lexer = vocabulary(MODEL), Lexer((), lower=False)
    rng = random.Random(8)
    texts = ["", "a", "été 漢字", "x" * 90, *[" ".join(rng.choice(["lorem", "ipsumed", "dolor\n", "12", "Ω"]) * rng.randint(1, 30) for _ in range(rng.randint(1, 9))) for _ in range(60)]]
    kept, brief = _Known(), _Known(most=5)
    for at in range(0, len(texts), 4):
        raw = [t.encode() for t in texts[at : at + 4]]
        data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        made = [_Block(data, bounds, known, lexer, met) for met in (kept, brief, _Known())]
        for block in made[:2]:  # whatever was met before, and whatever was forgotten
            for x, y in zip(block.best_ids(), made[2].best_ids(), strict=True):
                assert np.array_equal(x, y)
            assert np.array_equal(block.best, made[2].best) and np.array_equal(block.gap, made[2].gap)
    assert len(brief.code) < len(kept.code)
    names = [b"a", b"ab", "é".encode(), b" the", b" "]
    assert len(set(_codes(names).tolist())) == 5 and _codes(names)[1] == _codes([b"xab", b"ab"])[1]


def test_pieces_query(spark, sf):
    from segloom.llm.pieces import MODEL, vocabulary
    from segloom.llm.queries import QUERIES

    known, text = vocabulary(MODEL), {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op6_pieces"](spark, sf).limit(20).collect()
    assert any(r.other_edits for r in rows)
    for r in rows:
        assert len(r.ids) == r.n_pieces and len(r.other_edits) == len(r.other_scores)
        for edit in [[], *r.other_edits]:
            ids, at = list(r.ids), 0
            parts, done = [], 0
            while at < len(edit):
                a, b, n = edit[at : at + 3]
                parts += [*ids[done:a], *edit[at + 3 : at + 3 + n]]
                at, done = at + 3 + n, b
            assert b"".join(known.text[i] for i in [*parts, *ids[done:]])[1:].decode() == text[r.doc_id]


def test_pipeline(spark, sf):
    import corpus_pipeline
    from segloom.llm.common import stored

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        given = docs
        docs = stored(stage(spark, docs, sf), f"test_{name}")
        assert docs.count() <= before and docs.count() > 0
        before = docs.count()
        if name != "pieces":
            assert docs.columns == columns
        if name == "exact_dedup":
            norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in given.orderBy("doc_id").collect()]
            assert docs.count() == len(set(norm))
        if name == "near_dedup":
            rows = given.orderBy("doc_id").collect()
            _, roots = links([r.text for r in rows], 80)
            assert {r.doc_id for r in docs.collect()} == {rows[k].doc_id for k in set(roots)}
        if name == "pieces":
            assert docs.where("NOT round_trip").count() == 0


def test_pipeline_on_odd_rows(spark, sf):
    import corpus_pipeline
    from segloom.llm.common import stored

    docs = docs_of(spark, [*ODD, *ODD, "漢字仮名" * 5000, "#" * 20_000]).unionByName(docs_of(spark, ["no id"]).withColumn("doc_id", F.lit(None).cast("long")))
    for given in (docs, docs.limit(0)):
        rows = given
        for name, stage in corpus_pipeline.STAGES:
            rows = stored(stage(spark, rows, sf), f"odd_{name}")
            assert name == "pieces" or rows.columns == docs.columns
        assert rows.where("NOT round_trip").count() == 0
        assert given is not docs or 5 <= rows.count() < docs.count()


def test_queries_match_sql(spark, sf):
    import duckdb

    from segloom.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in ORACLES.items():
        found = con.execute(sql)
        columns = [c[0] for c in found.description]
        df = QUERIES[name](spark, sf)
        assert sorted(columns) == sorted(df.columns), name
        assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, found.fetchall())), name

"""Operators on ordered sections, on the cases that pin their semantics."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segloom.functions import labels as L
from segloom.operators import comparison as C
from segloom.operators import decoding as D
from segloom.operators import evaluation as E
from segloom.operators import grid as T
from segloom.operators import policies as P
from segloom.operators import similarity as G
from segloom.operators import vocabulary as O

SECTION = "track_id string, idx int, start_time double, end_time double, label string, confidence double"


def made(spark, *labels, times=None, track="t"):
    spans = times or [(float(i), float(i + 1)) for i in range(len(labels))]
    return spark.createDataFrame([(track, i, *s, x, None) for i, (s, x) in enumerate(zip(spans, labels, strict=True))], SECTION)


def listed(df):
    return [(r.start_time, r.end_time, r.label) for r in df.orderBy("idx").collect()]


def names(df):
    return [r.label for r in df.orderBy("idx").collect()]


@pytest.mark.parametrize(
    ("policy", "given", "wanted"),
    [
        ("enumerate_all_occurrences", "verse chorus verse verse outro", "verse 1,chorus,verse 2,verse 3,outro"),
        ("enumerate_consecutive_repeats", "verse chorus verse verse chorus", "verse 1,chorus,verse 2,verse 3,chorus"),
        ("enumerate_base_occurrences", "verse2 chorus verse_5 verse2 bridge1a bridge_2", "verse 1,chorus,verse 2,verse 3,bridge 1,bridge 2"),
        ("salami_function_occurrences", "silence verse no_function chorus verse silence", "silence,verse 1,chorus,verse 2,silence"),
        ("salami_function_merge", "no_function verse no_function", "verse"),
        ("keep", "a b a", "a,b,a"),
    ],
)
def test_policies(spark, policy, given, wanted):
    assert ",".join(names(P.apply_policy(made(spark, *given.split()), policy))) == wanted


def test_merge_and_confidence(spark):
    rows = [("t", i, float(i), i + 1.0, x, c) for i, (x, c) in enumerate([("a", 0.4), ("a", None), ("a", 0.8), ("b", None)])]
    out = P.merge_consecutive(spark.createDataFrame(rows, SECTION)).orderBy("idx").collect()
    assert [(r.start_time, r.end_time, r.label) for r in out] == [(0, 3, "a"), (3, 4, "b")]
    assert out[0].confidence == pytest.approx(0.6) and out[1].confidence is None
    assert listed(P.apply_policy(made(spark, "verse1", "verse 2", "chorus1", "verse3"), "base_labels")) == [(0, 2, "verse"), (2, 3, "chorus"), (3, 4, "verse")]


def test_replace_no_function(spark):
    assert names(P.replace_no_function(made(spark, "silence", "intro", "no_function", "verse", "no_function"))) == ["silence", "intro", "intro", "verse", "verse"]
    assert names(P.replace_no_function(made(spark, "no_function", "no_function"))) == ["no_function", "no_function"]


def test_projected_lower(spark):
    function = made(spark, "verse", "chorus", times=[(0.0, 4.0), (4.0, 8.0)])
    lower = made(spark, "a", "b", "a", times=[(0.0, 2.0), (2.0, 5.0), (5.0, 8.0)])
    wanted = ["verse subsegment a", "verse subsegment b", "chorus subsegment a"]
    assert names(P.project_lower(function, lower)) == wanted
    assert names(P.apply_policy(function, "salami_function_projected_lower", lower=lower)) == wanted


def test_random_policies():
    p = P.RandomPolicy.of(["merge", "enumerate_base_occurrences"], separator="-")
    assert p.for_validation().name == "enumerate_base_occurrences" and p.choices[0].separator == "-"
    with pytest.raises(ValueError):
        P.RandomPolicy.of(["random"])
    with pytest.raises(ValueError):
        P.Policy("nonsense")


def test_labels(spark):
    rows = spark.createDataFrame([(x,) for x in ("intchorus7", "section15", "stutter2", "raps", "verse1a", " Pre-Chorus_2 ")], "x string")
    out = [tuple(r) for r in rows.select(L.normalize_label("x", "harmonix"), L.label_base("x"), L.label_family("x")).collect()]
    assert [o[0] for o in out] == ["interlude chorus 7", "generic section 15", "stutter section 2", "rap", "verse 1a", "pre chorus 2"]
    assert out[5][1:] == ("pre chorus", "prechorus") and out[4][1] == "verse"
    one = spark.range(1).select(L.silence_label_in(F.array(F.lit("Nothing"), F.lit("Silence"))), L.ordinal(F.lit(112)), L.ordinal_word(F.lit(3)), F.size(L.hash_embedding(F.lit("x"), 40)), F.array_join(L.ensure_silence_label(F.array(F.lit("Si-lence"))), ",")).first()
    assert tuple(one) == ("Silence", "112th", "third", 40, "Si-lence,silence")
    assert L.policy_slug("merge", sep=" x") == "merge_sep__x"


def test_prompts(spark):
    v = spark.createDataFrame([("d", x) for x in ("fadeout", "verseinst", "instrumentalverse", "inst6", "silence")], "dataset string, label string")
    out = {r.label: r for r in O.encode_labels(v, ["dataset"], "harmonix", disambiguate=True, mode="descriptive").collect()}
    assert out["verseinst"].prompt_label == "instrumental verse (verseinst)" and out["fadeout"].prompt_label == "fade out"
    assert out["inst6"].prompt == "Music structure label: instrumental 6. Base type: instrumental. Occurrence: the 6th instrumental section in chronological order. Meaning: a section without lead vocals or with instrumental focus. Use this label for frames belonging to this section."
    assert sum(x * x for x in out["inst6"].vec) == pytest.approx(1)


def test_grid(spark):
    tracks = spark.createDataFrame([("t", 2.75)], "track_id string, duration double")
    beats = spark.createDataFrame([("t", i, float(i), False) for i in range(3)], "track_id string, beat_idx long, time double, is_downbeat boolean")
    assert [(r.start_time, r.end_time) for r in T.beat_intervals(beats, tracks).orderBy("idx").collect()] == [(0, 1), (1, 2), (2, 2.75)]
    assert T.trim_beats(beats, tracks.withColumn("duration", F.lit(-1.0))).first().time == 0.0
    with pytest.raises(Exception, match="beats must increase"):
        T.beat_intervals(beats, tracks.withColumn("duration", F.lit(1.0))).collect()
    frames = spark.createDataFrame([("t", i, t, [v, v]) for i, (t, v) in enumerate([(0.1, 0.0), (0.9, 2.0), (1.1, 10.0), (1.9, 14.0)])], "track_id string, frame_idx int, time double, vec array<double>")
    spans = spark.createDataFrame([("t", 0, 0.0, 1.0), ("t", 1, 1.0, 2.0), ("t", 2, 2.0, 3.0)], "track_id string, idx int, start_time double, end_time double")
    assert [r.vec for r in T.mean_pool(frames, spans).orderBy("idx").collect()] == [[1, 1], [12, 12], [14, 14]]
    assert [r.vec for r in T.mean_pool(frames, spans, empty="zeros").orderBy("idx").collect()][2] == [0, 0]


def test_targets(spark):
    tracks = spark.createDataFrame([("t", 3.0)], "track_id string, duration double")
    s = made(spark, "verse", times=[(1.0, 2.0)])
    points = spark.createDataFrame([("t", 0, 0.0, 0.5), ("t", 1, 1.0, 1.5), ("t", 2, 2.5, 3.0)], "track_id string, idx int, start_time double, end_time double")
    assigned = T.assign_points(points, T.adjust_timeline(s, tracks))
    with_silence = spark.createDataFrame([("t", "Silence", 0), ("t", "verse", 1)], "track_id string, label string, label_idx int")
    assert [r.target for r in T.encode_timeline(assigned, with_silence).orderBy("idx").collect()] == [0, 1, 0]
    without = with_silence.where("label = 'verse'").withColumn("label_idx", F.lit(0))
    assert [r.target for r in T.encode_timeline(assigned, without).orderBy("idx").collect()] == [-100, 0, -100]
    with pytest.raises(Exception, match="no candidate"):
        T.encode_timeline(assigned, without, no_overlap=None).collect()
    spans = spark.createDataFrame([("t", 0, 0.5, 1.5), ("t", 1, 1.5, 2.5), ("t", 2, 3.0, 4.0), ("t", 3, 9.0, 9.5)], points.schema)
    got = T.assign_overlap(spans, made(spark, "intro", "verse", times=[(0.0, 2.0), (2.0, 5.0)])).orderBy("idx").collect()
    assert [r.label for r in got] == ["intro", "intro", "verse", None]
    seg = spark.createDataFrame([("t", i, x) for i, x in enumerate([1, 1, -100, 1, 2])], "track_id string, idx int, target int")
    assert [r.segment_target for r in T.segment_targets(seg).orderBy("idx").collect()] == [0, 0, -100, 1, 2]


def test_overlap_sweep(spark):
    """The pairs are those of all intervals, also where intervals of a side overlap, touch, repeat, are empty or have null ends."""
    from segloom.plans.sequences import overlap_sweep

    rng = random.Random(7)
    rows = {"l": [], "r": []}
    for side in rows:
        for track in range(40):
            at = 0.0
            for i in range(rng.randrange(0, 9)):
                end = None if rng.random() < 0.03 else at + rng.choice([0.0, 0.5, 1.0, 3.0])
                rows[side].append((None if track == 0 else str(track), i, at, end, rng.choice("abc"), None))
                at += rng.choice([0.0, 0.5, 1.0] if track % 2 else [1.0, 3.0, 4.0])
    left, right = (spark.createDataFrame(rows[side], SECTION) for side in "lr")
    wanted = []
    for a in rows["l"]:
        for b in rows["r"]:
            if a[0] == b[0] and None not in (a[3], b[3]) and min(a[3], b[3]) > max(a[2], b[2]):
                wanted.append((a[0] or "", a[1], b[1], min(a[3], b[3]) - max(a[2], b[2])))
    got = overlap_sweep(left, right, ["track_id"])
    assert sorted((r.track_id or "", r.idx, r.r_idx, r.overlap) for r in got.collect()) == sorted(wanted) and len(wanted) > 100
    both = overlap_sweep(left, right, ["track_id"], how="left")
    assert sorted((r.track_id or "", r.idx) for r in both.where("overlap IS NULL").collect()) == sorted((a[0] or "", a[1]) for a in rows["l"])
    assert sorted((r.track_id or "", r.idx, r.r_idx, r.overlap) for r in both.where("overlap IS NOT NULL").collect()) == sorted(wanted)
    assert overlap_sweep(left, right.limit(0), ["track_id"]).count() == 0 and overlap_sweep(left.limit(0), right, ["track_id"], how="left").count() == 0


def test_overlap_of_long_tracks(spark):
    n = 100_000
    long = lambda step, label: spark.range(n).select(F.lit("t").alias("track_id"), F.col("id").alias("idx"), (F.col("id") * step).alias("start_time"), ((F.col("id") + 1) * step).alias("end_time"), F.concat(F.lit(label), (F.col("id") % 2).cast("string")).alias("label"))
    a, b = long(1.0, "x"), long(0.5, "y")
    got = {(r.original_label, r.revised_label): r.seconds for r in C.overlap_seconds(a, b).collect()}
    assert got == {(f"x{i}", f"y{j}"): n / 8 for i in (0, 1) for j in (0, 1)}
    out = T.assign_overlap(b, a, unknown="-")
    assert out.where("label <> concat('x', CAST(idx div 2 % 2 AS STRING))").count() == 0 and out.count() == n
    for df in (C.overlap_seconds(a, b), C.agreement(a, b), out, P.project_lower(b, a.withColumn("confidence", F.lit(None).cast("double")))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "CartesianProduct" not in plan


def best_path(scores, penalty, prior, weight):
    n, k = scores.shape
    def value(p):
        v = sum(scores[t, p[t]] for t in range(n))
        for t in range(1, n):
            if p[t] != p[t - 1]:
                v += -penalty + (weight * math.log(prior[t - 1]) if prior is not None else 0)
            elif prior is not None:
                v += weight * math.log1p(-prior[t - 1])
        return v
    return max(value(p) for p in itertools.product(range(k), repeat=n)), value


@pytest.mark.parametrize("seed", range(30))
def test_viterbi(seed):
    rng = np.random.default_rng(seed)
    scores = rng.integers(0, 4, (5, 3)).astype(float)
    prior = rng.uniform(0.1, 0.9, 4) if seed % 2 else None
    path = D.viterbi(scores, 1.0, prior, 0.7 if seed % 2 else 0.0)
    top, value = best_path(scores, 1.0, prior, 0.7)
    assert value(path) == pytest.approx(top)


def test_viterbi_cases():
    d = lambda x, *a: D.viterbi(np.array(x, float), *a).tolist()
    assert d([[3, 0], [0, 2], [4, 0]]) == [0, 1, 0] and d([[3, 0], [0, 2], [3, 0]], 2.0) == [0, 0, 0]
    assert d([[2, 0], [0, 2], [2, 0]], 3.0, np.array([0.95, 0.95]), 3.0) == [0, 1, 0]
    assert d([[2, 0], [0, 2], [2, 0]], 0.0, np.array([0.05, 0.05]), 3.0) == [0, 0, 0]


def test_cleaning():
    assert D.clean_segments([(0, 5, "verse"), (5, 5.5, "bridge"), (5.5, 10, "chorus")], 1) == [(0, 5.5, "verse"), (5.5, 10, "chorus")]
    assert D.clean_segments([(0, 5, "verse"), (5, 5.5, "bridge"), (5.5, 10, "verse")], 1) == [(0, 10, "verse")]
    assert D.clean_segments([(0, 0.5, "a"), (0.5, 3, "b")], 1) == [(0, 3, "b")]


def test_smoothing_and_splits(spark):
    rows = spark.createDataFrame([("t", i, s, float(i), i + 1.0, x) for i, (s, x) in enumerate(zip([[0.0, 1.0], [10.0, 0.0], [0.0, 1.0]], ["verse", "chorus", "chorus"], strict=True))], "track_id string, frame_idx int, scores array<double>, start_time double, end_time double, label string")
    middle = D.smooth_scores(rows, 3).where("frame_idx = 1").first().scores
    assert middle == pytest.approx([10 / 3, 2 / 3])
    p = spark.createDataFrame([("t", 0, 0.9), ("t", 1, 0.1)], "track_id string, frame_idx int, probability double")
    assert listed(D.merge_with_boundaries(rows, p)) == [(0, 1, "verse"), (1, 3, "chorus")]
    same = spark.createDataFrame([("t", i, float(i), i + 1.0, "verse") for i in range(4)], "track_id string, frame_idx int, start_time double, end_time double, label string")
    p = spark.createDataFrame([("t", i, x) for i, x in enumerate([0.1, 0.9, 0.1])], p.schema)
    assert listed(D.merge_with_boundaries(same, p)) == [(0, 1.5, "verse"), (1.5, 4, "verse")]
    assert D.decode_viterbi(rows, penalty=0.0).orderBy("frame_idx").select("label_idx").toPandas().label_idx.tolist() == [1, 0, 1]


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_viterbi_of_blocks(spark, block):
    """Cut into blocks, tracks get the path of one pass, on random scores, on ties, and with boundary probabilities."""
    rng = np.random.default_rng(11)
    rows, wanted = [], {}
    for t, (n, k) in enumerate([(1, 3), (6, 3), (7, 1), (8, 2), (70, 3), (150, 4), (64, 3)]):
        scores = rng.integers(0, 4, (n, k)).astype(float) if t % 2 else rng.random((n, k))
        p = rng.uniform(0, 1, n)
        rows += [(str(t), i, scores[i].tolist(), float(p[i]), f"x{i}") for i in range(n)]
        for weight in (0.0, 0.5):
            wanted[str(t), weight] = D.viterbi(scores, 0.5, p[:-1], weight).tolist()
    df = spark.createDataFrame(rows, "track_id string, frame_idx int, scores array<double>, p double, other string").repartition(5)
    for weight in (0.0, 0.5):
        out = D.decode_viterbi(df, penalty=0.5, weight=weight, boundary="p", block=block)
        assert out.columns == [*df.columns, "label_idx"] and out.where("other <> concat('x', frame_idx)").count() == 0
        got = {r.track_id: [x.label_idx for x in r.s] for r in out.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "label_idx"))).alias("s")).collect()}
        assert got == {t: path for (t, w), path in wanted.items() if w == weight}
    assert D.decode_viterbi(df.limit(0), block=block).count() == 0


def slow_clean(segments, least):
    out = list(segments)
    while len(out) > 1:
        at = next((i for i, (s, e, _) in enumerate(out) if e - s < least), None)
        if at is None:
            break
        a, b = at - 1, at + 1
        if a >= 0 and b < len(out) and out[a][2] == out[b][2]:
            out[a : b + 1] = [(out[a][0], out[b][1], out[a][2])]
        elif a < 0 or (b < len(out) and out[b][1] - out[b][0] > out[a][1] - out[a][0]):
            out[at : b + 1] = [(out[at][0], out[b][1], out[b][2])]
        else:
            out[a : at + 1] = [(out[a][0], out[at][1], out[a][2])]
    return [(g[0][0], g[-1][1], x) for x, g in ((x, list(g)) for x, g in itertools.groupby(out, key=lambda y: y[2]))]


def test_cleaning_is_linear_and_the_same(spark):
    import time

    rng, tracks = random.Random(2), {}
    for t in range(300):
        at, segments = 0.0, []
        for _ in range(rng.randrange(1, 14)):
            end = at + rng.choice([0.25, 0.5, 1.0, 2.0])
            segments.append((at, end, rng.choice("ab" if t % 2 else "abc")))
            at = end
        tracks[str(t)] = segments
        assert D.clean_segments(segments, 0.6) == slow_clean(segments, 0.6) and D.clean_segments(segments, 0.0) == segments
    rows = spark.createDataFrame([(t, i, *x) for t, xs in tracks.items() for i, x in enumerate(xs)], "track_id string, idx int, start_time double, end_time double, label string")
    got = {}
    for r in D.remove_short(rows, 1.5).orderBy("track_id", "idx").collect():
        got.setdefault(r.track_id, []).append((r.start_time, r.end_time, r.label))
    assert got == {t: slow_clean(x, 1.5) for t, x in tracks.items()}
    long, began = [(i, i + rng.choice([0.3, 1.0]), rng.choice("ab")) for i in range(100_000)], time.time()
    assert len(D.clean_segments(long, 0.8)) < 60_000 and time.time() - began < 10


def test_smoothing_plan(spark):
    rng = np.random.default_rng(3)
    scores = {t: rng.random((n, 3)) for t, n in (("a", 1), ("b", 2), ("c", 9), ("d", 40))}
    rows = spark.createDataFrame([(t, i, x.tolist(), "kept") for t, xs in scores.items() for i, x in enumerate(xs)], "track_id string, frame_idx int, scores array<double>, other string").repartition(3)
    for size, mode in ((3, "mean"), (7, "median"), (11, "mean"), (11, "median")):
        out = D.smooth_scores(rows, size, mode)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
        for r in out.collect():
            x = np.pad(scores[r.track_id], ((size // 2, size // 2), (0, 0)), mode="edge")[r.frame_idx : r.frame_idx + size]
            assert r.scores == pytest.approx(getattr(np, mode)(x, axis=0).tolist()) and r.other == "kept"


def test_hits_are_a_largest_matching():
    rng = random.Random(1)
    for _ in range(300):
        a, b = (sorted(rng.randint(0, 12) for _ in range(rng.randint(0, 5))) for _ in "ab")
        best = 0
        for k in range(min(len(a), len(b)), 0, -1):
            if any(all(abs(x - y) <= 2 for x, y in zip(p, q, strict=True)) for p in itertools.permutations(a, k) for q in itertools.combinations(b, k)):
                best = k
                break
        assert E.count_hits(a, b, 2) == best


def test_evaluate(spark):
    s = made(spark, "intro", "verse", "chorus")
    row = E.evaluate(s, s).first()
    assert row.f_0_5 == row.f_3 == row.pairwise_f == row.adjusted_rand == 1 and row.nce_f == pytest.approx(1) and row.adjusted_mutual_information == pytest.approx(1)
    f = spark.createDataFrame([("t", t, p) for t, p in zip([0, 0, 0, 1, -100], [0, 1, 1, 1, 0], strict=True)], "track_id string, target int, predicted int")
    got = E.frame_scores(f).first()
    assert got.acc == 0.5 and got.balanced_acc == pytest.approx((1 / 3 + 1) / 2)
    with pytest.raises(ValueError, match="no prediction"):
        E.evaluate_predictions(s, s.where("false"), s)


def test_expected_information():
    def by_factorials(a, b):
        n, total, g = sum(a), 0.0, lambda x: math.lgamma(x + 1)
        for x, y in itertools.product(a, b):
            for k in range(max(1, x + y - n), min(x, y) + 1):
                p = math.exp(g(x) + g(y) + g(n - x) + g(n - y) - g(n) - g(k) - g(x - k) - g(y - k) - g(n - x - y + k))
                total += p * k / n * math.log(n * k / (x * y))
        return total

    rng = random.Random(1)
    for _ in range(150):
        n = rng.randrange(1, 400)
        cut = lambda k, n=n: [b - a for a, b in itertools.pairwise([0, *sorted(rng.sample(range(1, n), min(k, n - 1))), n])]
        a, b = cut(rng.randrange(0, 6)), cut(rng.randrange(0, 6))
        assert E.expected_information(a, b) == pytest.approx(by_factorials(a, b), rel=1e-9, abs=1e-12)
    assert 0 < E.expected_information([10_000_000, 6_000_000, 3_000_000, 1], [9_000_000, 9_000_000, 1_000_001]) < 1e-6


def test_contingency(spark):
    """Counted cells are those of the points themselves, with gaps, overlaps and sections shorter than a step."""
    rng = random.Random(5)
    rows = {"r": [], "e": []}
    for side in rows:
        for track in range(24):
            at = rng.choice([0.0, 0.0, 0.35])
            for i in range(rng.randrange(1, 9)):
                end = at + rng.choice([0.04, 0.1, 0.3, 1.0, 1.7])
                rows[side].append((str(track), i, at, end, rng.choice("abc"), None))
                at = end + rng.choice([0.0, 0.0, 0.0, 0.2, -0.02])
    ref, est = (spark.createDataFrame(rows[side], SECTION) for side in "re")
    ends = spark.createDataFrame([(str(track), rng.choice([0.05, 2.0, 5.3, 9.0])) for track in range(24)], "track_id string, duration double")
    points = ends.selectExpr("track_id", "inline(transform(filter(sequence(0, 100), k -> k < floor(round(duration / 0.1D, 6))), k -> struct(k * 0.1D AS start_time)))")
    both = T.assign_points(T.assign_points(points, ref).withColumnRenamed("label", "ref"), est).withColumnRenamed("label", "est")
    wanted = {(r.track_id, r.ref, r.est): r["count"] for r in both.groupBy("track_id", "ref", "est").count().collect()}
    got = {(r.track_id, r.ref, r.est): r.n for r in E.contingency(ref, est, ends).collect()}
    assert got == wanted and len(got) > 30


def test_comparison(spark):
    a, b = made(spark, "x", "y", times=[(0.0, 4.0), (4.0, 6.0)]), made(spark, "x", "y", times=[(0.0, 5.0), (5.0, 6.0)])
    got = {(r.original_label, r.revised_label): r.seconds for r in C.overlap_seconds(a, b).collect()}
    assert got == {("x", "x"): 4, ("y", "x"): 1, ("y", "y"): 1}
    row = C.compare_tracks(a, b).first()
    assert row.precision_0_5 == 0 and row.recall_3 == 1 and row.label_agreement_fraction == pytest.approx(5 / 6)


def by_pairs(vec, scores, target):
    """G4, M2, M3, M7 and M9 of one track from all pairs of its frames."""
    ok = target != -100
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    soft = np.exp(scores - scores.max(1, keepdims=True))
    soft /= soft.sum(1, keepdims=True)
    same, off = target[ok][:, None] == target[ok][None, :], ~np.eye(int(ok.sum()), dtype=bool)
    cos, prob = unit[ok] @ unit[ok].T, soft[ok] @ soft[ok].T

    def bce(p):
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return (-np.log(p[off & same]).mean() - np.log(1 - p[off & ~same]).mean()) / 2

    e = np.where(off, np.exp((cos - 1) / 0.07), 0)
    own = (e * same).sum(1)
    every = (unit @ unit.T)[np.triu_indices(len(unit), 1)]
    return {"same": cos[off & same].mean(), "different": cos[off & ~same].mean(), "m2": bce(prob), "m3": bce((cos + 1) / 2), "m7": np.log(np.exp(-2 * (2 - 2 * every)).mean()), "m9": (np.log(e.sum(1)) - np.log(own))[own > 0].mean()}


def test_tiles(spark):
    """Metrics over pairs from tiles of any size are those of all pairs, on a track of 5,000 frames too, and without a row a pair."""
    rng = np.random.default_rng(6)
    tracks, schema = {}, "track_id string, frame_idx int, vec array<double>, scores array<double>, target int"
    for t, n in (("a", 30), ("b", 7), ("c", 5000)):
        tracks[t] = rng.normal(size=(n, 6)) + 0.5, rng.normal(size=(n, 4)), rng.integers(0, 3, n)
        tracks[t][2][::9] = -100
    frames = spark.createDataFrame([(t, i, v[i].tolist(), s[i].tolist(), int(y[i])) for t, (v, s, y) in tracks.items() for i in range(len(v))], schema).repartition(3)
    short = frames.where("track_id <> 'c'")
    for rows, size in ((frames, 1024), (short, 1024), (short, 8)):
        got = {}
        for name, df, column in (("same", G.similarity_means(rows), "same_label_mean"), ("different", G.similarity_means(rows), "different_label_mean"), ("m2", G.probability_bce(rows, size=size), "loss"), ("m3", G.structure_bce(rows, size=size), "loss"), ("m7", G.uniformity(rows, size=size), "loss"), ("m9", G.supervised_contrastive(rows, size=size), "loss")):
            for r in df.collect():
                got[r.track_id, name] = r[column]
        assert {t for t, _ in got} == ({"a", "b", "c"} if rows is frames else {"a", "b"})
        for t in {t for t, _ in got}:
            for name, value in by_pairs(*tracks[t]).items():
                assert got[t, name] == pytest.approx(value, rel=1e-6), (t, name)
    for df in (G.similarity_means(short), G.probability_bce(short), G.structure_bce(short), G.uniformity(short), G.supervised_contrastive(short)):
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    vec, _, target = tracks["a"]
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    for size in (1024, 8):
        rows = G.pairs(frames.where("track_id = 'a'"), size=size).collect()
        assert sorted((r.i, r.j) for r in rows) == [(i, j) for i in range(30) for j in range(30) if i != j]
        assert all(r.value == pytest.approx(unit[r.i] @ unit[r.j]) and r.same == (target[r.i] == target[r.j] != -100) and (r.target_i, r.target_j) == (target[r.i], target[r.j]) for r in rows)
        assert sorted((r.i, r.j) for r in G.pairs(frames.where("track_id = 'a'"), ordered=True, carry=(), size=size).collect()) == [(i, j) for i in range(30) for j in range(i + 1, 30)]
    assert G.supervised_contrastive(frames.limit(0)).count() == G.similarity_means(frames.limit(0)).count() == 0


def test_filters_and_splits(spark):
    s = made(spark, "silence", "silence", track="u").unionByName(made(spark, "intro", "verse"))
    assert [r.track_id for r in O.filter_tracks(s, min_useful_labels=2, ignore=("silence",)).collect()] == ["t"]
    assert O.split_counts(10) == {"train": 8, "val": 2, "test": 0}
    tracks = spark.range(10).select(F.col("id").alias("track_id"), F.col("id").alias("manifest_ord"))
    got = O.split_tracks(tracks, seed=4)
    assert sorted(r.split for r in got.collect()) == ["train"] * 8 + ["val"] * 2
    assert {r.track_id: r.split for r in got.collect()} == {r.track_id: r.split for r in O.split_tracks(tracks.repartition(3), seed=4).collect()}
    assert [r.track_id for r in O.split_tracks(tracks, shuffle=False).where("split = 'val'").orderBy("track_id").collect()] == [8, 9]
    flawed = made(spark, "a", "", times=[(0.0, 1.0), (2.0, 2.0)])
    row = O.validate_tracks(s.select("track_id").distinct().where("track_id = 't'").union(spark.createDataFrame([("none",)], "track_id string")), flawed).orderBy("track_id").collect()
    assert [list(r.errors) for r in row] == [["No sections found in namespace 'segment_open'"], ["Section 1 has non-positive duration", "Section 1 has an empty label"]]


def test_sources(spark, tmp_path):
    from segloom.sources import annotations as A
    from segloom.sources import manifests as M
    from segloom.sources import stores as S

    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    doc = {"annotations": [{"namespace": "segment_open", "data": [{"time": 0.0, "duration": 2.0, "value": "intro", "confidence": 1.0}, {"time": 2.0, "duration": 1.0, "value": {"label": "verse"}, "confidence": None}]}], "file_metadata": {"duration": 3.0}}
    (tmp_path / "a/1.jams").write_text(json.dumps(doc))
    (tmp_path / "b/1.txt").write_text("# note\n0 intro\n\n1.5 verse two\n3 end\n")
    (tmp_path / "b/2.txt").write_text("0 intro\nbad\n")
    rows = A.read_annotations(spark, f"{tmp_path}/a/*.jams").orderBy("idx").collect()
    assert [(r.track_id, r.start_time, r.end_time, r.label) for r in rows] == [("1", 0, 2, "intro"), ("1", 2, 3, "verse")]
    with pytest.raises(ValueError, match="number 1"):
        A.pick_annotation(A.read_annotations(spark, f"{tmp_path}/a/*.jams"), A.annotation_counts(spark, f"{tmp_path}/a/*.jams"), 1)
    assert listed(A.read_text_annotations(spark, f"{tmp_path}/b/1.txt")) == [(0, 1.5, "intro"), (1.5, 3, "verse two")]
    with pytest.raises(Exception, match="bad annotation row"):
        A.read_text_annotations(spark, f"{tmp_path}/b/2.txt").collect()
    pairs = A.pair_annotation_sets(M.file_listing(spark, f"{tmp_path}/a"), M.file_listing(spark, f"{tmp_path}/b"))
    assert {(r.stem, r.side) for r in pairs.collect()} == {("1", "both"), ("2", "revised_only")}
    assert A.identity_summary(A.file_identity(spark, pairs, f"{tmp_path}/a", f"{tmp_path}/b")).first().different_ids == ["1"]
    (tmp_path / "m.jsonl").write_text('{"track_id": "1", "audio_path": "x.wav", "jams_path": "/y.jams", "dataset": "d"}\n\n')
    tracks = M.read_manifest(spark, f"{tmp_path}/m.jsonl")
    row = tracks.first()
    assert row.audio_path == f"{tmp_path}/x.wav" and row.jams_path == "/y.jams" and row.metadata == {}
    M.write_manifest(tracks, f"{tmp_path}/out")
    assert M.read_manifest(spark, f"{tmp_path}/out").first() == row
    with pytest.raises(ValueError, match="without annotation"):
        M.pair_files(spark.createDataFrame([("1", "p")], "stem string, path string"), spark.createDataFrame([], "stem string, path string"), "d")
    s = made(spark, "a", "b")
    S.write_segments(s, f"{tmp_path}/seg")
    assert names(A.read_annotations(spark, f"{tmp_path}/seg")) == ["a", "b"]
    S.write_report(s.select("track_id", "label"), f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    S.write_features(s.withColumn("encoder", F.lit("e")).withColumn("dataset", F.lit("d")), f"{tmp_path}/store")
    assert S.read_features(spark, f"{tmp_path}/store", encoder="e").count() == 2


def track_scores(reference, estimate, step=0.1):
    """F at 0.5 and 3 s (trimmed), pairwise F and NCE F of one track, point by point."""
    from collections import Counter

    duration = max(reference[-1][1], estimate[-1][1])
    adjust = lambda x: ([(0.0, x[0][0], "__T_MIN")] if x[0][0] > 0 else []) + x + ([(x[-1][1], duration, "__T_MAX")] if x[-1][1] < duration else [])
    ref, est = adjust(list(reference)), adjust(list(estimate))
    times = lambda x: sorted({round(t, 5) for s, e, _ in x for t in (s, e)})[1:-1]
    r, e = times(ref), times(est)
    f = lambda p, q: 2 * p * q / (p + q) if p + q else 0.0
    hit = lambda w: f(E.count_hits(r, e, w + 1e-9) / len(e), E.count_hits(r, e, w + 1e-9) / len(r)) if r and e else 0.0

    def sampled(x):
        out, at = [], 0
        for k in range(int(round(duration / step, 6))):
            while at + 1 < len(x) and x[at + 1][0] <= k * step:
                at += 1
            out.append(x[at][2])
        return out

    a, b = sampled(ref), sampled(est)
    n = len(a)
    if not n:
        return {"f05": hit(0.5), "f30": hit(3.0), "pairwise_f": 0.0, "nce_f": 0.0}
    cells, ra, eb = Counter(zip(a, b, strict=True)), Counter(a), Counter(b)
    pairs = lambda c: sum(v * (v - 1) / 2 for v in c.values())
    m, p_r, p_e = pairs(cells), pairs(ra), pairs(eb)
    e_r = -sum(v / n * math.log2(v / ra[x]) for (x, _), v in cells.items())
    r_e = -sum(v / n * math.log2(v / eb[y]) for (_, y), v in cells.items())
    over = 1 - e_r / math.log2(len(eb)) if len(eb) > 1 else 0.0
    under = 1 - r_e / math.log2(len(ra)) if len(ra) > 1 else 0.0
    return {"f05": hit(0.5), "f30": hit(3.0), "pairwise_f": f(m / p_e if p_e else 0.0, m / p_r if p_r else 0.0), "nce_f": f(over, under)}


def test_repeated_writes(spark, tmp_path):
    """Jobs that die before, between or after their two outputs, and are repeated, leave each row once."""
    from segloom.sources.manifests import pending
    from segloom.sources.stores import committed, read_features, write_features

    tracks = spark.createDataFrame([(str(i), "d" if i % 2 else None) for i in range(6)], "track_id string, dataset string")
    rows = lambda some, x: some.select("track_id", "dataset", F.lit("e").alias("encoder"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("idx")).withColumn("x", F.lit(x))
    frames, beats = f"{tmp_path}/frames", f"{tmp_path}/beats"
    todo = lambda limit=None: pending(tracks, committed(spark, frames), committed(spark, beats), limit=limit)
    assert todo().count() == 6
    with pytest.raises(Exception, match="killed"):  # all rows are written, the record is not
        write_features(rows(tracks, 1), frames, tracks=tracks.withColumn("encoder", F.raise_error(F.lit("killed")).cast("string")))
    assert todo().count() == 6 and read_features(spark, frames).count() == 0
    first = [r.track_id for r in todo(limit=4).collect()]
    some = tracks.where(F.col("track_id").isin(first)).cache()
    write_features(rows(some, 2), frames)  # the job dies before its second output
    assert todo().count() == 6 and read_features(spark, frames).count() == 16
    write_features(rows(some, 3), frames)
    write_features(rows(some.limit(3), 3), beats, tracks=some.withColumn("encoder", F.lit("e")))  # one track has no beats, and is done
    assert sorted(r.track_id for r in todo().collect()) == ["4", "5"]
    write_features(rows(todo().cache(), 3), frames)
    got = read_features(spark, frames)
    assert got.count() == 24 and got.select("track_id", "idx").distinct().count() == 24 and got.where("x <> 3").count() == 0 and "run" not in got.columns
    assert read_features(spark, frames, dataset="d").count() == 12 and read_features(spark, beats).count() == 12


def test_grid_search(spark):
    rng = np.random.default_rng(4)
    frames = {t: (rng.random((24, 3)), rng.random(24)) for t in ("s", "t")}
    rows = spark.createDataFrame([(t, i, i * 0.5, i * 0.5 + 0.5, x.tolist(), float(b)) for t, (scores, p) in frames.items() for i, (x, b) in enumerate(zip(scores, p, strict=True))], "track_id string, frame_idx int, start_time double, end_time double, scores array<double>, p double")
    ref = spark.createDataFrame([(t, a, b, x) for t in frames for a, b, x in ((0.0, 4.0, "0"), (4.0, 9.0, "1"), (9.0, 12.0, "2"))], "track_id string, start_time double, end_time double, label string")
    grid = {"sizes": (1, 3), "modes": ("mean", "median"), "decoders": ("viterbi", "argmax"), "penalties": (0.0, 0.6), "weights": (0.0, 0.7), "eps_values": (1e-4, 0.3), "least": (0.0, 1.5)}
    found = D.grid_search(rows, ref, boundary="p", **grid)
    got = {tuple(r[k] for k in ("window", "mode", "decoder", "penalty", "weight", "eps", "least")): r for r in found.collect()}
    assert set(got) == set(itertools.product(*grid.values()))
    for (size, mode, decoder, penalty, weight, eps, least), r in got.items():
        scores = []
        for x, p in frames.values():
            padded = np.pad(x, ((size // 2, size // 2), (0, 0)), mode="edge")
            smooth = np.array([getattr(np, mode)(padded[i : i + size], axis=0) for i in range(len(x))])
            path = D.viterbi(smooth, penalty, p[:-1], weight, eps) if decoder == "viterbi" else smooth.argmax(1)
            runs = [(k, [i for i, _ in g]) for k, g in itertools.groupby(enumerate(path.tolist()), key=lambda y: y[1])]
            segments = D.clean_segments([(g[0] * 0.5, g[-1] * 0.5 + 0.5, str(k)) for k, g in runs], least)
            scores.append({**track_scores([(0.0, 4.0, "0"), (4.0, 9.0, "1"), (9.0, 12.0, "2")], segments), "segments": len(segments)})
        assert r.num_tracks == 2
        for m in ("f05", "f30", "pairwise_f", "nce_f", "segments"):
            assert r[f"{m}_mean"] == pytest.approx(np.mean([y[m] for y in scores])) and r[f"{m}_std"] == pytest.approx(np.std([y[m] for y in scores]), abs=1e-9)
    assert len({r.segments_mean for k, r in got.items() if k[:4] == (1, "mean", "viterbi", 0.6)}) > 2
    assert [r.f30_mean for r in D.top_settings(found, 3).collect()] == pytest.approx(sorted((r.f30_mean for r in got.values()), reverse=True)[:3])


def test_stored_sequences_are_not_broadcast(spark):
    """Small files may hold many rows: joins on a sequence's key are shuffled, whatever the files' size."""
    from segloom.plans.scratch import stored

    s = made(spark, "a", "b", "a").withColumn("setting", F.explode(F.sequence(F.lit(0), F.lit(2000))))
    keys = ["track_id", "setting"]
    ref, est, ends = (stored(x, "sequences") for x in E.adjust_pair(s, s, keys))
    for df in (*E.adjust_pair(s, s, keys), E.boundary_hits(ref, est, (0.5, 3.0), keys), E.boundary_deviation(ref, est, keys), E.contingency(ref, est, ends, keys)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert E.boundary_hits(ref, est, (0.5,), keys).where("f = 1").count() == 2001


def test_pairs_of_timelines(spark):
    """Tracks without one of the timelines and null keys have no rows, whatever their ends; a duration that is not positive raises."""
    rows = lambda *r: spark.createDataFrame([(k, i, s, e, x, None) for k, i, s, e, x in r], SECTION)
    left = rows(("t", 0, 1.0, 2.0, "a"), ("t", 1, 2.0, 6.0, "b"), ("only", 0, -2.0, -1.0, "a"), (None, 0, 0.0, 1.0, "a"), ("u", 7, 0.0, 3.0, "c"))
    right = rows(("t", 3, -1.0, 4.0, "c"), ("alone", 0, -2.0, -1.0, "a"), (None, 0, 0.0, 1.0, "a"), ("u", 1, 0.0, None, "d"), ("u", 0, 0.0, 5.0, "e"))
    ref, est, ends = E.adjust_pair(left, right.withColumn("idx", F.col("idx").cast("long")))
    assert {r.track_id: r.duration for r in ends.collect()} == {"t": 6.0, "u": 3.0}
    assert listed(ref.where("track_id = 't'")) == [(0.0, 1.0, T.T_MIN), (1.0, 2.0, "a"), (2.0, 6.0, "b")]
    assert listed(est.where("track_id = 't'")) == [(0.0, 4.0, "c"), (4.0, 6.0, T.T_MAX)]
    assert listed(ref.where("track_id = 'u'")) == [(0.0, 3.0, "c")] and listed(est.where("track_id = 'u'")) == [(0.0, 3.0, "e")]
    assert {r.track_id for r in ref.union(est).collect()} == {"t", "u"}
    assert dict(ref.dtypes)["idx"] == "int" and dict(est.dtypes)["idx"] == "bigint"
    with pytest.raises(Exception, match="positive"):
        E.adjust_pair(rows(("t", 0, 0.0, 2.0, "a"), ("t", 1, 2.0, -1.0, "b")), rows(("t", 0, -3.0, -2.0, "a")))[0].collect()


def test_boundary_deviation_against_all_pairs(spark, seed=3):
    """Each boundary's nearest of the other side, with equal times, and where one side or both have none."""
    rng = random.Random(seed)
    sides = [{f"t{k}": sorted(rng.sample(range(30), rng.choice([1, 2, 3, 9, 15]))) for k in range(40)} for _ in range(2)]
    df = [spark.createDataFrame([(k, i, float(s), float(e), "x", None) for k, v in side.items() for i, (s, e) in enumerate(zip(v, [*v[1:], v[-1] + 1], strict=True))], SECTION) for side in sides]
    for trim in (True, False):
        got = {r.track_id: (r.ref_to_est, r.est_to_ref) for r in E.boundary_deviation(*df, trim=trim).collect()}
        for k in sides[0]:
            r, e = ([*side[k], side[k][-1] + 1] for side in sides)
            r, e = (r[1:-1], e[1:-1]) if trim else (r, e)
            way = lambda a, b: float(np.median([min(abs(x - y) for y in b) for x in a])) if a and b else None
            assert (k in got) == bool(r or e) and got.get(k, (None, None)) == (way(r, e), way(e, r))


@pytest.mark.parametrize(("name", "most"), [("e04_boundary_deviation", 7), ("e06_pair_scores", 11), ("e07_entropy_scores", 11)])
def test_few_sorts_in_a_task(spark, sf, monkeypatch, name, most):
    """A task holds a page of memory at least for each of its sorts, so that both timelines are made once, in a step of their own."""
    from segloom.queries import QUERIES

    sorts, stored = [], E.stored
    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Sort [")
    monkeypatch.setattr(E, "stored", lambda df, name: sorts.append(count(df)) or stored(df, name))
    sorts.append(count(QUERIES[name](spark, sf)))
    assert len(sorts) == 2 and max(sorts) <= most


def test_pairs_are_dealt_by_their_number(spark, sf, monkeypatch):
    """More sections make more tasks of e07, not larger ones, up to its result."""
    from segloom.plans.sequences import dealt
    from segloom.queries import QUERIES

    given = []
    for each in (100, 200):
        monkeypatch.setattr(E, "dealt", lambda df, keys, each=each: given.append(df.count()) or dealt(df, keys, each))
        tasks = QUERIES["e07_entropy_scores"](spark, sf).rdd.getNumPartitions()
        assert tasks == -(-given[-1] // each) > 4


def test_listing_of_folders(spark, tmp_path):
    """Files in sub-folders and empty files are listed, in tasks; the driver's file index holds none of them."""
    from segloom.sources import annotations as A
    from segloom.sources import manifests as M
    from segloom.sources import stores as S

    rows = spark.createDataFrame([(f"{i} %2.txt", "x" * (i % 3)) for i in range(40)], "name string, value string")
    assert S.write_files(rows, f"{tmp_path}/a", 8) == 40
    assert S.write_files(rows.withColumn("value", F.when(F.col("name") == "3 %2.txt", "y").otherwise(F.col("value"))), f"{tmp_path}/b") == 40
    (tmp_path / "a/.hidden").write_text("z")
    (tmp_path / "a/c.wav").write_text("")
    assert 1 < len([x for x in (tmp_path / "a").iterdir() if x.is_dir()]) <= 8
    listing = M.file_listing(spark, f"{tmp_path}/a", "*.txt")
    assert sorted(r.stem for r in listing.collect()) == sorted(f"{i} %252" for i in range(40))
    assert [r.path for r in M.file_listing(spark, f"{tmp_path}/a", "*.wav").collect()] == [f"file:{tmp_path}/a/c.wav"]
    assert "FileScan" not in listing._jdf.queryExecution().executedPlan().toString()
    pairs = A.pair_annotation_sets(listing, M.file_listing(spark, f"file://{tmp_path}/b"))
    same = A.file_identity(spark, pairs, f"{tmp_path}/a", f"file://{tmp_path}/b")
    tracks = (M.pair_files(listing, listing, "d"), M.pair_prefixed(listing, listing, "d", ""))
    assert not any("Broadcast" in x._jdf.queryExecution().executedPlan().toString() for x in (pairs, same, *tracks))
    assert [x.count() for x in tracks] == [40, 40]
    found = same.collect()
    assert len(found) == 40 and [(r.stem, r.same_size) for r in found if not r.same_sha256] == [("3 %252", False)]


def test_blocks_reach_python_a_few_at_a_time(spark, monkeypatch):
    """Kernels get a bounded part of a batch, and files of blocks hold few of them."""
    import pandas as pd

    flat, n = pd.Series([np.zeros(4096 * 3) for _ in range(300)]), pd.Series([4096] * 300)
    parts = list(D._by_labels(flat, n))
    assert max(sum(x.size for x in scores) for _, scores in parts) <= 1_000_000 and sorted(i for at, _ in parts for i in at) == list(range(300))
    seen = []
    monkeypatch.setattr(D, "stored", lambda df, name, f=D.stored: seen.append((name, f(df, name))) or seen[-1][1])
    rows = spark.range(6000).select((F.col("id") % 1).alias("track_id"), F.col("id").cast("int").alias("frame_idx"), F.array(*[F.lit(0.0)] * 3).alias("scores"))
    assert D.decode_viterbi(rows, penalty=1.0, block=10).count() == 6000
    sizes = seen[0][1].groupBy(F.input_file_name()).count().collect()
    assert seen[0][0] == "blocks" and len(sizes) >= 30 and max(r["count"] for r in sizes) < 60

"""Segmentation metrics: boundaries, pairs of points, entropies, frames; summaries over tracks and policies."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segloom.operators.grid import IGNORE, fit_timeline
from segloom.operators.policies import KEYS
from segloom.plans.scratch import stored
from segloom.plans.sequences import dealt, join_sequences, window

Segments = list[tuple[float, float, str]]


def adjust_pair(reference: DataFrame, estimate: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both timelines from 0 to the later of the two ends, and that duration. Tracks without one of them are left out.

    Each timeline is made once: both go through one window for the duration and are stored, so that no task of what reads them
    repeats their sorts."""
    side = lambda df, n: df.select(*keys, F.lit(n).alias("_side"), "idx", "start_time", "end_time", "label")
    both = side(reference, 0).unionByName(side(estimate, 1)).where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]))
    own, of = Window.partitionBy(*keys), lambda n, c: F.when(F.col("_side") == n, F.col(c))
    last = [F.max_by(of(n, "end_time"), of(n, "idx")).over(own) for n in (0, 1)]
    both = both.withColumns({"duration": F.greatest(*last), "_both": F.min("_side").over(own) < F.max("_side").over(own)})
    both = dealt(stored(both.where("_both").drop("_both"), "adjusted_pair"), keys)

    def fitted(df: DataFrame, n: int) -> DataFrame:
        kept = [F.col(c).cast(df.schema[c].dataType).alias(c) if c in ("idx", "label") else F.col(c) for c in ("idx", "start_time", "end_time", "label")]
        return fit_timeline(both.where(F.col("_side") == n).select(*keys, *kept, "duration"), keys)

    return fitted(reference, 0), fitted(estimate, 1), both.groupBy(*keys).agg(F.first("duration").alias("duration"))


def boundaries(timeline: DataFrame, keys: Sequence[str] = KEYS, trim: bool = True) -> DataFrame:
    """The different starts and ends of a timeline to 5 decimals (track, time), without the first and last if trimmed."""
    times = timeline.select(*keys, F.explode(F.array(F.round("start_time", 5), F.round("end_time", 5))).alias("time")).distinct()
    if not trim:
        return times
    w = Window.partitionBy(*keys)
    ends = times.withColumns({"_lo": F.min("time").over(w), "_hi": F.max("time").over(w)})
    return ends.where("time > _lo AND time < _hi").drop("_lo", "_hi")


def count_hits(reference: Sequence[float], estimate: Sequence[float], size: float) -> int:
    """The largest number of pairs of sorted times no farther apart than ``size``, each used once: on a line the earliest
    times that still fit can always be paired."""
    i = j = hits = 0
    while i < len(reference) and j < len(estimate):
        gap = estimate[j] - reference[i]
        if abs(gap) <= size:
            hits, i, j = hits + 1, i + 1, j + 1
        elif gap > 0:
            i += 1
        else:
            j += 1
    return hits


def boundary_hits(reference: DataFrame, estimate: DataFrame, sizes: Sequence[float] = (0.5, 3.0), keys: Sequence[str] = KEYS, trim: bool = True) -> DataFrame:
    """(track, window, precision, recall, f) of one-to-one boundary matches; 0 where a side has no boundaries."""

    def lists(timeline: DataFrame, name: str) -> DataFrame:  # as boundaries(), a row for each track
        times = F.array_sort(F.array_distinct(F.concat(F.collect_list(F.round("start_time", 5)), F.collect_list(F.round("end_time", 5)))))
        rows = timeline.groupBy(*keys).agg(times.alias(name))
        return rows.withColumn(name, F.slice(name, F.lit(2), F.greatest(F.size(name) - 2, F.lit(0)))) if trim else rows

    both = join_sequences(lists(reference, "_r"), lists(estimate, "_e"), keys)

    def hits(size: Column) -> Column:  # as count_hits: a walk along both lists, over a step for each of their times
        def step(at: Column, _: Column) -> Column:
            gap = F.get("_e", at["j"]) - F.get("_r", at["i"])
            move = lambda c: F.coalesce(c.cast("int"), F.lit(0))
            return F.struct((at["i"] + move(gap >= -size)).alias("i"), (at["j"] + move(gap <= size)).alias("j"), (at["n"] + move(F.abs(gap) <= size)).alias("n"))

        zero = F.lit(0)
        return F.aggregate(F.sequence(zero, F.size("_r") + F.size("_e")), F.struct(zero.alias("i"), zero.alias("j"), zero.alias("n")), step, lambda at: at["n"].cast("long"))

    windows = F.array(*[F.struct(F.lit(float(s)).alias("window"), hits(F.lit(s + 1e-9)).alias("hits")) for s in sizes])
    h = both.select(*keys, F.size("_r").alias("r"), F.size("_e").alias("e"), F.inline(windows))
    p, r = F.coalesce(F.col("hits") / F.nullif("e", F.lit(0)), F.lit(0.0)), F.coalesce(F.col("hits") / F.nullif("r", F.lit(0)), F.lit(0.0))
    h = h.withColumns({"precision": p, "recall": r})
    return h.select(*keys, "window", "hits", "precision", "recall", f_measure(F.col("precision"), F.col("recall")).alias("f"))


def f_measure(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def boundary_deviation(reference: DataFrame, estimate: DataFrame, keys: Sequence[str] = KEYS, trim: bool = True) -> DataFrame:
    """Medians of the distance to the nearest boundary of the other side, each way; null where a side has none.

    Both sides' boundaries go through one sort in time and one against it, each carrying the other side's last along."""
    side = lambda df, n: df.select(*keys, F.lit(n).alias("_side"), "start_time", "end_time")
    times = boundaries(side(reference, 0).unionByName(side(estimate, 1)), [*keys, "_side"], trim)
    of = lambda n: F.when(F.col("_side") == n, F.col("time"))
    # of equal times each is in one of the two directions after the other
    ways = [window(keys, *order).rowsBetween(Window.unboundedPreceding, 0) for order in (("time", "_side"), (F.desc("time"), F.desc("_side")))]
    before, after = (F.when(F.col("_side") == 0, F.last(of(1), True).over(w)).otherwise(F.last(of(0), True).over(w)) for w in ways)
    gaps = times.withColumns({"_before": before, "_after": after}).withColumn("_gap", F.least(F.col("time") - F.col("_before"), F.col("_after") - F.col("time")))
    way = lambda n, name: F.median(F.when(F.col("_side") == n, F.col("_gap"))).alias(name)
    return gaps.groupBy(*keys).agg(way(0, "ref_to_est"), way(1, "est_to_ref"))


def _label_steps(timeline: DataFrame, keys: Sequence[str], step: float, name: str) -> DataFrame:
    """The number of the first point from which each section's label counts, as ``assign_points`` has it: where the section
    begins or the one before has ended, whichever is first; the first section's from 0."""
    since = F.least(F.lag("end_time").over(window(keys, "idx")), "start_time")
    first = F.row_number().over(window(keys, "idx")) == 1
    begun = timeline.select(*keys, "idx", F.col("label").alias(name), F.when(~first, since).alias("_since")).withColumn("_k", F.ceil(F.col("_since") / F.lit(step)))
    at = lambda k: k * F.lit(step) >= F.col("_since")
    k = F.when(F.col("_since").isNull(), F.lit(0).cast("long")).when(at(F.col("_k") - 1), F.col("_k") - 1).when(at(F.col("_k")), F.col("_k")).otherwise(F.col("_k") + 1)
    return begun.select(*keys, "idx", name, F.greatest(k, F.lit(0).cast("long")).alias("_k"))


def contingency(reference: DataFrame, estimate: DataFrame, durations: DataFrame, keys: Sequence[str] = KEYS, step: float = 0.1) -> DataFrame:
    """E5: how many points, every ``step`` seconds, have each pair of labels: (track, ref, est, n).

    No point is made: both timelines' sections go through one sort, and between two of them the points are counted."""
    side = lambda df, own, other, n: df.select(*keys, "_k", F.lit(n).alias("_side"), "idx", own, F.lit(None).cast("string").alias(other))
    both = side(_label_steps(reference, keys, step, "ref"), "ref", "est", 0).unionByName(side(_label_steps(estimate, keys, step, "est"), "est", "ref", 1))
    w = window(keys, "_k", "_side", "idx")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    runs = both.select(*keys, "_k", F.last("ref", True).over(upto).alias("ref"), F.last("est", True).over(upto).alias("est"), F.lead("_k").over(w).alias("_next"))
    points = F.floor(F.round(F.col("duration") / F.lit(step), 6)).cast("long")
    n = F.least(F.coalesce("_next", "_points"), "_points") - F.least("_k", "_points")
    counted = join_sequences(runs, durations.select(*keys, points.alias("_points")), keys).withColumn("n", n).where("n > 0")
    return counted.groupBy(*keys, "ref", "est").agg(F.sum("n").alias("n"))


def _margins(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each cell with its row and column totals, each of which counts once in ``ref_one`` and ``est_one``. Totals come after the
    numbers, whose sort they share."""
    by = lambda *c: Window.partitionBy(*keys, *c)
    rows = cells.withColumn("ref_one", F.row_number().over(by("ref").orderBy("est")) == 1).withColumn("a", F.sum("n").over(by("ref")))
    both = rows.withColumn("est_one", F.row_number().over(by("est").orderBy("ref")) == 1).withColumn("b", F.sum("n").over(by("est")))
    return both.withColumn("total", F.sum("n").over(by()))


def pair_scores(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pairwise precision, recall and F, Rand and adjusted Rand index of a contingency table."""
    pairs = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    m = _margins(cells, keys).groupBy(*keys).agg(F.sum(pairs("n")).alias("m"), F.sum(F.when(F.col("ref_one"), pairs("a"))).alias("a"), F.sum(F.when(F.col("est_one"), pairs("b"))).alias("b"), F.first(pairs("total")).alias("t"))
    p, r = F.coalesce(F.col("m") / F.nullif("b", F.lit(0.0)), F.lit(0.0)), F.coalesce(F.col("m") / F.nullif("a", F.lit(0.0)), F.lit(0.0))
    chance = F.col("a") * F.col("b") / F.nullif("t", F.lit(0.0))
    ari = (F.col("m") - chance) / F.nullif((F.col("a") + F.col("b")) / 2 - chance, F.lit(0.0))
    return m.select(*keys, p.alias("pairwise_precision"), r.alias("pairwise_recall"), f_measure(p, r).alias("pairwise_f"), ((2 * F.col("m") + F.col("t") - F.col("a") - F.col("b")) / F.nullif("t", F.lit(0.0))).alias("rand"), F.coalesce(ari, F.lit(1.0)).alias("adjusted_rand"))


def entropy_scores(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Normalised conditional entropies (over- and under-segmentation and F), V-measure with its two parts, mutual
    information, and that by the geometric mean of the entropies."""
    c = _margins(cells, keys).withColumns({"p": F.col("n") / F.col("total"), "pa": F.col("a") / F.col("total"), "pb": F.col("b") / F.col("total")})
    part = lambda flag, q: F.coalesce(-F.sum(F.when(F.col(flag), F.col(q) * F.log2(q))), F.lit(0.0))
    s = c.groupBy(*keys).agg(
        F.sum(-F.col("p") * F.log2(F.col("p") / F.col("pa"))).alias("e_given_r"), F.sum(-F.col("p") * F.log2(F.col("p") / F.col("pb"))).alias("r_given_e"),
        part("ref_one", "pa").alias("h_r"), part("est_one", "pb").alias("h_e"), F.count_if("ref_one").alias("k_r"), F.count_if("est_one").alias("k_e"),
        F.sum(F.col("p") * F.log(F.col("p") / (F.col("pa") * F.col("pb")))).alias("mutual_information"),
    )
    share = lambda h, top: F.when(top > 1e-12, 1 - h / top).otherwise(0.0)
    over, under = share(F.col("e_given_r"), F.log2("k_e")), share(F.col("r_given_e"), F.log2("k_r"))
    v_over, v_under = share(F.col("e_given_r"), F.col("h_e")), share(F.col("r_given_e"), F.col("h_r"))
    both = F.sqrt(F.col("h_r") * F.col("h_e")) * math.log(2)
    return s.select(*keys, over.alias("nce_over"), under.alias("nce_under"), f_measure(over, under).alias("nce_f"), v_over.alias("v_precision"), v_under.alias("v_recall"), f_measure(v_over, v_under).alias("v_measure"), "mutual_information", F.when(both > 1e-12, F.col("mutual_information") / both).otherwise(0.0).alias("normalized_mutual_information"))


def expected_information(a: Sequence[int], b: Sequence[int]) -> float:
    """Mutual information to be expected of two labellings with these label counts, in nats.

    How many points two labels share is hypergeometric. Its logs are cumulative sums of the logs of the ratios of neighbouring
    terms, over 12 deviations and 12 more about the mean, beyond which all terms together are under 1e-20; they are normalised to
    a sum of 1, so no factorial is needed. Equal pairs of counts are worked out once."""
    n = int(sum(a))
    (xs, x_times), (ys, y_times) = (np.unique(np.asarray(v, np.int64), return_counts=True) for v in (a, b))
    total = 0.0
    for x, i in zip(xs.tolist(), x_times.tolist(), strict=True):
        for y, j in zip(ys.tolist(), y_times.tolist(), strict=True):
            mean = x * y / n
            reach = 12 * math.sqrt(mean * (n - x) / n * (n - y) / max(1, n - 1)) + 12
            k = np.arange(max(0, x + y - n, math.floor(mean - reach)), min(x, y, math.ceil(mean + reach)) + 1, dtype=float)
            ratio = (x - k[:-1]) * (y - k[:-1]) / ((k[:-1] + 1) * (n - x - y + k[:-1] + 1))
            log_p = np.concatenate([[0.0], np.cumsum(np.log(ratio))])
            p = np.exp(log_p - log_p.max())
            some = k > 0
            total += i * j * float((p[some] * k[some] / n * np.log(n * k[some] / (x * y))).sum() / p.sum())
    return total


def adjusted_information(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(information - expected) / (larger entropy - expected); a track's few label counts go to one row."""
    counts = lambda c: F.collect_list(F.when(F.col(f"{c}_one"), F.col("a" if c == "ref" else "b")))
    c = _margins(cells, keys)
    mi = F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("a").cast("double") * F.col("b"))))
    packed = c.groupBy(*keys).agg(counts("ref").alias("a"), counts("est").alias("b"), mi.alias("mi"))

    @F.pandas_udf("double")
    def adjusted(a: pd.Series, b: pd.Series, mi: pd.Series) -> pd.Series:
        out = []
        for x, y, m in zip(a, b, mi, strict=True):
            x, y = [int(v) for v in x], [int(v) for v in y]
            entropy = lambda v: -sum(k / sum(v) * math.log(k / sum(v)) for k in v)
            e = expected_information(x, y)
            top = max(entropy(x), entropy(y)) - e
            out.append(1.0 if len(x) == len(y) == 1 or abs(top) < 1e-12 else (m - e) / top)
        return pd.Series(out)

    return packed.select(*keys, adjusted("a", "b", "mi").alias("adjusted_mutual_information"))


def evaluate(reference: DataFrame, estimate: DataFrame, keys: Sequence[str] = KEYS, trim: bool = True) -> DataFrame:
    """All segment metrics of each track that both sides have, one wide row a track."""
    # several metrics read each of these
    ref, est, ends = (stored(df, "evaluated") for df in adjust_pair(reference, estimate, keys))
    hits = boundary_hits(ref, est, keys=keys, trim=trim)
    wide = hits.groupBy(*keys).agg(*[F.max(F.when(F.col("window") == s, F.col(m))).alias(f"{m}_{s:g}".replace(".", "_")) for s in (0.5, 3.0) for m in ("precision", "recall", "f")])
    cells = stored(contingency(ref, est, ends, keys), "evaluated_cells")
    parts = [wide, boundary_deviation(ref, est, keys, trim), pair_scores(cells, keys), entropy_scores(cells, keys), adjusted_information(cells, keys)]
    return reduce(lambda a, b: join_sequences(a, b, keys, "left"), parts)


def evaluate_predictions(references: DataFrame, predictions: DataFrame, tracks: DataFrame, keys: Sequence[str] = KEYS, trim: bool = True) -> DataFrame:
    """``evaluate`` on the given tracks; a track without a prediction raises."""
    wanted = tracks.select(*keys).distinct()
    missing = wanted.join(predictions.select(*keys).distinct(), list(keys), "left_anti")
    if not missing.isEmpty():
        raise ValueError(f"no prediction for {missing.limit(5).collect()}")
    return evaluate(references.join(wanted, list(keys), "left_semi"), predictions, keys, trim)


def remap_predictions(predictions: DataFrame, predicted_labels: DataFrame, labels: DataFrame, keys: Sequence[str] = KEYS, ignore: int = IGNORE) -> DataFrame:
    """Predicted indices in terms of another label list, by name; names that it lacks are ignored."""
    names = predicted_labels.select(*keys, F.col("label_idx").alias("predicted"), "label")
    target = labels.select(*[k for k in keys if k in labels.columns], "label", F.col("label_idx").alias("_to"))
    return predictions.join(names, [*keys, "predicted"], "left").join(target, [*[k for k in keys if k in labels.columns], "label"], "left").withColumn("predicted", F.coalesce("_to", F.lit(ignore))).drop("_to", "label")


def frame_scores(frames: DataFrame, keys: Sequence[str] = KEYS, ignore: int = IGNORE) -> DataFrame:
    """Accuracy, and the mean of the accuracies of each target label, over frames with a target; null if there are none."""
    right = (F.col("predicted") == F.col("target")).cast("double")
    each = frames.withColumn("_right", F.when(F.col("target") != ignore, right)).groupBy(*keys, "target").agg(F.avg("_right").alias("_acc"), F.sum("_right").alias("_hits"), F.count("_right").alias("_n"))
    return each.groupBy(*keys).agg((F.sum("_hits") / F.nullif(F.sum("_n"), F.lit(0))).alias("acc"), F.avg("_acc").alias("balanced_acc"))


def to_long(scores: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(track, metric, value) of a wide table of scores; NaN is null."""
    metrics = [c for c in scores.columns if c not in keys]
    wide = scores.select(*keys, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in metrics])
    return wide.unpivot(list(keys), metrics, "metric", "value")


def summarize(long: DataFrame, *by: str) -> DataFrame:
    """Mean and population deviation of each metric over the tracks that have it."""
    return long.groupBy(*by, "metric").agg(F.count("value").alias("num_tracks"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def common_tracks(long: DataFrame, keys: Sequence[str] = KEYS, policy: str = "policy") -> DataFrame:
    """The tracks that every policy has scores of."""
    n = long.select(policy).distinct().count()
    return long.groupBy(*keys).agg(F.count_distinct(policy).alias("_n")).where(F.col("_n") == n).select(*keys)


def policy_table(long: DataFrame, metrics: Sequence[str], policy: str = "policy") -> DataFrame:
    """A row for each policy, a column for each metric's mean."""
    return long.where(F.col("metric").isin(*metrics)).groupBy(policy).pivot("metric", list(metrics)).agg(F.avg("value"))


def improvements(history: DataFrame, keys: Sequence[str], order: str = "epoch", value: str = "value", mode: str = "max", min_delta: float = 0.0) -> DataFrame:
    """Adds the best value before each epoch and whether the epoch is better by more than ``min_delta``."""
    if mode not in ("max", "min"):
        raise ValueError("mode is max or min")
    before = window(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    best = (F.max if mode == "max" else F.min)(value).over(before)
    gain = F.col(value) - best if mode == "max" else best - F.col(value)
    return history.withColumn("best_before", best).withColumn("improved", F.coalesce(gain > min_delta, F.col(value).isNotNull()))

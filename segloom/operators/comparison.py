"""Comparison of two annotation sets of the same tracks: original (reference) and revised (estimate) sections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segloom.functions.labels import label_base, label_family
from segloom.operators.evaluation import f_measure
from segloom.operators.policies import KEYS
from segloom.plans.sequences import nearest, overlap_sweep, window


def overlap_seconds(original: DataFrame, revised: DataFrame, keys: Sequence[str] = KEYS, per_track: bool = False, base: bool = False) -> DataFrame:
    """Seconds that each original label shares with each revised one, of the corpus or by track, or by base label."""
    spans = lambda df: df.select(*keys, "start_time", "end_time", "label")
    pairs = overlap_sweep(spans(original), spans(revised), keys)
    name = label_base if base else F.col
    by = [*(keys if per_track else ()), "original_label", "revised_label"]
    return pairs.select(*keys, name("label").alias("original_label"), name("r_label").alias("revised_label"), "overlap").groupBy(*by).agg(F.sum("overlap").alias("seconds"))


def top_changed(confusion: DataFrame, n: int = 40) -> DataFrame:
    """The pairs of different labels with the most seconds."""
    return confusion.where("original_label <> revised_label").orderBy(F.desc("seconds"), "original_label", "revised_label").limit(n)


def agreement(original: DataFrame, revised: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Seconds and share of the common time with the same label, and with the same base label; the shares are null
    without common time."""
    spans = lambda df: df.select(*keys, "start_time", "end_time", "label")
    p = overlap_sweep(spans(original), spans(revised), keys)
    same, base = F.col("label") == F.col("r_label"), label_base("label") == label_base("r_label")
    out = p.groupBy(*keys).agg(F.sum("overlap").alias("total"), F.sum(F.when(same, F.col("overlap")).otherwise(0.0)).alias("label_agreement_seconds"), F.sum(F.when(base, F.col("overlap")).otherwise(0.0)).alias("base_label_agreement_seconds"))
    share = lambda c: F.col(c) / F.nullif("total", F.lit(0.0))
    return out.select(*keys, "label_agreement_seconds", "base_label_agreement_seconds", share("label_agreement_seconds").alias("label_agreement_fraction"), share("base_label_agreement_seconds").alias("base_label_agreement_fraction"))


def internal_boundaries(sections: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """C4: the ends of all sections of a track but the last: (track, idx, time)."""
    last = F.lead("idx").over(window(keys, "idx"))
    return sections.withColumn("_next", last).where("_next IS NOT NULL").select(*keys, "idx", F.col("end_time").alias("time"))


def nearest_distances(query: DataFrame, reference: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each query boundary of a track whose other side has any, with the distance to the nearest."""
    return nearest(query, reference.select(*keys, "time"), keys).where("distance IS NOT NULL")


def signed_shifts(query: DataFrame, reference: DataFrame, keys: Sequence[str] = KEYS, most: float = 3.0) -> DataFrame:
    """Nearest reference less query time, the earlier on ties, within ``most`` seconds."""
    near = nearest_distances(query, reference, keys)
    back = F.col("before").isNotNull() & (F.col("after").isNull() | (F.col("time") - F.col("before") <= F.col("after") - F.col("time")))
    return near.withColumn("shift", F.when(back, F.col("before")).otherwise(F.col("after")) - F.col("time")).where(F.abs("shift") <= most)


def _tag(tolerance: float) -> str:
    return f"{tolerance:g}".replace(".", "_")


def _matches(query: DataFrame, reference: DataFrame, keys: Sequence[str], tolerances: Sequence[float], name: str, spread: str | None = None) -> DataFrame:
    """By track how many query boundaries there are and have a neighbour within each tolerance; with ``spread`` also the median
    and the 90th percentile of the distances, as columns of that name."""
    near = nearest(query, reference.select(*keys, "time"), keys)
    within = [F.count_if(F.coalesce(F.col("distance") <= t, F.lit(False))).alias(f"{name}_within_{_tag(t)}") for t in tolerances]
    middle = [F.median("distance").alias(f"{spread}_median"), F.percentile("distance", F.lit(0.9)).alias(f"{spread}_p90")] if spread else []
    return near.groupBy(*keys).agg(F.count("*").alias(f"n_{name}"), *within, *middle)


def tolerance_scores(reference: DataFrame, estimate: DataFrame, tracks: DataFrame, keys: Sequence[str] = KEYS, tolerances: Sequence[float] = (0.5, 3.0)) -> DataFrame:
    """Precision, recall and F of boundaries with any neighbour within each tolerance (not one to one), and the counts
    of those without. A side without boundaries scores 1 if the other has none either, else 0."""
    return _tolerance(_matches(reference, estimate, keys, tolerances, "ref"), _matches(estimate, reference, keys, tolerances, "est"), tracks, keys, tolerances)


def _tolerance(ref: DataFrame, est: DataFrame, tracks: DataFrame, keys: Sequence[str], tolerances: Sequence[float], keep: Sequence[str] = ()) -> DataFrame:
    counts = [c for side in (ref, est) for c in side.columns if c not in (*keys, *keep)]
    out = tracks.select(*keys).distinct().join(est, list(keys), "left").join(ref, list(keys), "left").fillna(0, counts)
    columns: list[Column] = []
    for t in tolerances:
        share = lambda side, other, t=t: F.when(F.col(f"n_{side}") > 0, F.col(f"{side}_within_{_tag(t)}") / F.nullif(f"n_{side}", F.lit(0))).otherwise((F.col(f"n_{other}") == 0).cast("double"))
        p, r = share("est", "ref"), share("ref", "est")
        columns += [p.alias(f"precision_{_tag(t)}"), r.alias(f"recall_{_tag(t)}"), f_measure(p, r).alias(f"f_{_tag(t)}"), (F.col("n_est") - F.col(f"est_within_{_tag(t)}")).alias(f"added_{_tag(t)}"), (F.col("n_ref") - F.col(f"ref_within_{_tag(t)}")).alias(f"removed_{_tag(t)}")]
    return out.select(*keys, "n_ref", "n_est", *columns, *keep)


def gap_overlap(sections: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Seconds between neighbours that no section covers, and that both cover."""
    d = F.lead("start_time").over(window(keys, "idx")) - F.col("end_time")
    return sections.withColumn("_d", F.coalesce(d, F.lit(0.0))).groupBy(*keys).agg(F.sum(F.greatest("_d", F.lit(0.0))).alias("gap_seconds"), F.sum(F.greatest(-F.col("_d"), F.lit(0.0))).alias("overlap_seconds"))


def consecutive_duplicates(sections: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Neighbours with one base label."""
    based = sections.withColumn("_base", label_base("label"))
    return based.withColumn("_same", F.col("_base") == F.lag("_base").over(window(keys, "idx"))).groupBy(*keys).agg(F.count_if(F.coalesce("_same", F.lit(False))).alias("consecutive_duplicates"))


def compare_tracks(original: DataFrame, revised: DataFrame, keys: Sequence[str] = KEYS, metrics: DataFrame | None = None) -> DataFrame:
    """C11: one wide row for each track of both sets. ``metrics`` (E1) is joined if given. Each side's sections and boundaries
    are grouped once for all that is counted of them."""
    def side(s: DataFrame, name: str) -> DataFrame:
        w, length = window(keys, "idx"), F.col("end_time") - F.col("start_time")
        beside = s.withColumn("_base", label_base("label")).withColumns({"_same": F.coalesce(F.col("_base") == F.lag("_base").over(w), F.lit(False)), "_d": F.coalesce(F.lead("start_time").over(w) - F.col("end_time"), F.lit(0.0))})
        aggs = {"duration": F.max("end_time"), "n_segments": F.count("*"), "n_labels": F.count_distinct("label"), "mean_segment": F.avg(length), "median_segment": F.median(length), "consecutive_duplicates": F.count_if("_same"), "gap_seconds": F.sum(F.greatest("_d", F.lit(0.0))), "overlap_seconds": F.sum(F.greatest(-F.col("_d"), F.lit(0.0)))}
        return beside.groupBy(*keys).agg(*[x.alias(f"{c}_{name}") for c, x in aggs.items()])

    a, b = side(original, "original"), side(revised, "revised")
    oi, ri = internal_boundaries(original, keys), internal_boundaries(revised, keys)
    both, tolerances = a.join(b, list(keys)), (0.5, 3.0)
    spreads = [f"{x}_{y}" for x in ("original_to_revised", "revised_to_original") for y in ("median", "p90")]
    near = _tolerance(_matches(oi, ri, keys, tolerances, "ref", "original_to_revised"), _matches(ri, oi, keys, tolerances, "est", "revised_to_original"), both, keys, tolerances, spreads)
    parts = [agreement(original, revised, keys), near, *([metrics] if metrics is not None else [])]
    out = reduce(lambda x, y: x.join(y, list(keys), "left"), parts, both)
    delta = {f"{c}_delta": F.col(f"{c}_revised") - F.col(f"{c}_original") for c in ("duration", "n_segments")}
    return out.withColumns(delta | {"n_boundaries_delta": F.col("n_est") - F.col("n_ref")})


def label_seconds(original: DataFrame, revised: DataFrame, family: bool = False) -> DataFrame:
    """Seconds of each label (or family) in both sets, and the difference."""
    name = label_family("label") if family else F.col("label")
    total = lambda s, c: s.select(name.alias("label"), (F.col("end_time") - F.col("start_time")).alias("s")).groupBy("label").agg(F.sum("s").alias(c))
    both = total(original, "original_seconds").join(total(revised, "revised_seconds"), "label", "full_outer").fillna(0.0)
    return both.withColumn("delta", F.col("revised_seconds") - F.col("original_seconds"))


def top_counter(seconds: DataFrame, n: int = 30, value: str = "seconds") -> DataFrame:
    """The labels with the most seconds, in hours, and as a share of all."""
    total = seconds.agg(F.sum(value).alias("_total"))
    return seconds.crossJoin(F.broadcast(total)).select("label", F.col(value).alias("seconds"), (F.col(value) / 3600).alias("hours"), (F.col(value) / F.nullif("_total", F.lit(0.0))).alias("share")).orderBy(F.desc("seconds"), "label").limit(n)


def summarize_values(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """C14: count, mean, deviation, median, 10th and 90th percentile, least and largest of the finite values."""
    v = F.when(~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value).cast("double")) < float("inf")), F.col(value).cast("double"))
    return rows.withColumn("_v", v).groupBy(*by).agg(F.count("_v").alias("count"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"), F.median("_v").alias("median"), F.percentile("_v", F.lit(0.1)).alias("p10"), F.percentile("_v", F.lit(0.9)).alias("p90"), F.min("_v").alias("min"), F.max("_v").alias("max"))


def vocabulary_sets(original: DataFrame, revised: DataFrame, base: bool = False) -> DataFrame:
    """Each label (or base label) of either set, and whether it is shared, original only or revised only."""
    name = label_base("label") if base else F.col("label")
    a, b = original.select(name.alias("label")), revised.select(name.alias("label"))
    kinds = ((a.intersect(b), "shared"), (a.subtract(b), "original_only"), (b.subtract(a), "revised_only"))
    return reduce(DataFrame.unionByName, [d.withColumn("kind", F.lit(k)) for d, k in kinds])


def top_rows(rows: DataFrame, metric: str, n: int = 20, reverse: bool = True, absolute: bool = False, keys: Sequence[str] = KEYS, keep: Sequence[str] = ()) -> DataFrame:
    """The tracks with the largest (or smallest) value."""
    value = F.abs(metric) if absolute else F.col(metric)
    return rows.orderBy(value.desc_nulls_last() if reverse else value.asc_nulls_last(), *keys).limit(n).select(*keys, metric, *keep)

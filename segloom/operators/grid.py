"""Time grids, pooling of frames, and targets for grid intervals.

Beats are rows (track_id, beat_idx, time); intervals are rows (track_id, idx, start_time, end_time); tracks give a duration.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segloom.functions.labels import SILENCE_LIKE, label_base
from segloom.functions.vectors import vector_mean
from segloom.operators.policies import KEYS
from segloom.plans.sequences import asof, differs, join_sequences, nearest, overlap_sweep, window

IGNORE = -100
T_MIN, T_MAX = "__T_MIN", "__T_MAX"


def beat_intervals(beats: DataFrame, tracks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each beat up to the next, the last up to the track's ``duration``. Times that don't increase, or a duration that is
    not beyond the last beat, raise when the row is read."""
    w = window(keys, "beat_idx")
    out = beats.join(tracks.select(*keys, "duration"), list(keys))
    out = out.withColumn("end_time", F.coalesce(F.lead("time").over(w), "duration"))
    message = F.concat(F.lit("beats must increase up to the duration: "), F.to_json(F.struct(*keys, "beat_idx")))
    checked = F.when(F.col("end_time") <= F.col("time"), F.raise_error(message).cast("double")).otherwise(F.col("end_time"))
    return out.select(*keys, F.col("beat_idx").alias("idx"), F.col("time").alias("start_time"), checked.alias("end_time"))


def trim_beats(beats: DataFrame, tracks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Beats before the duration; a track without any gets one at 0. ``is_downbeat`` goes along; both counts are given."""
    both = tracks.select(*keys, "duration").join(beats, list(keys), "left")
    w = Window.partitionBy(*keys)
    inside = F.col("time") < F.col("duration")
    counted = both.withColumns({"n_before": F.count("time").over(w), "n_after": F.greatest(F.count(F.when(inside, 1)).over(w), F.lit(1)), "_any": F.coalesce(F.max(inside.cast("int")).over(w), F.lit(0)), "_first": F.row_number().over(window(keys, "beat_idx"))})
    kept = counted.where(inside | ((F.col("_any") == 0) & (F.col("_first") == 1)))
    alone = F.col("_any") == 0
    return kept.select(*keys, F.when(alone, 0).otherwise(F.col("beat_idx")).cast("long").alias("beat_idx"), F.when(alone, 0.0).otherwise(F.col("time")).alias("time"), F.when(alone, False).otherwise(F.col("is_downbeat")).alias("is_downbeat"), "n_before", "n_after")


def uniform_beats(tracks: DataFrame, period: float = 0.5, keys: Sequence[str] = KEYS) -> DataFrame:
    """A beat every ``period`` seconds before the duration, one at least; every fourth is a downbeat."""
    if period <= 0:
        raise ValueError("period must be positive")
    last = F.greatest(F.ceil(F.col("duration") / period) - 1, F.lit(0))
    out = tracks.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("beat_idx"))
    return out.withColumns({"time": F.col("beat_idx") * F.lit(float(period)), "is_downbeat": F.col("beat_idx") % 4 == 0})


def uniform_times(frames: DataFrame, tracks: DataFrame, keys: Sequence[str] = KEYS, order: str = "frame_idx") -> DataFrame:
    """T4: n frames spread evenly over the duration, the end left out."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return frames.drop("time").join(tracks.select(*keys, "duration"), list(keys)).withColumn("time", F.when(n == 1, 0.0).otherwise(F.col(order) * F.col("duration") / n)).drop("duration")


def fourier_features(tracks: DataFrame, dim: int = 16, frame_rate: float = 2.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """T5: sine and cosine columns of rising frequency over each track's time."""
    if dim <= 0 or frame_rate <= 0:
        raise ValueError("dim and frame_rate must be positive")
    hop = 1.0 / frame_rate
    last = F.greatest(F.ceil(F.col("duration") / hop) - 1, F.lit(0)).cast("long")
    rows = tracks.select(*keys, "duration", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("frame_idx")).withColumn("time", F.col("frame_idx") * F.lit(hop))
    phase = F.col("time") / F.greatest(F.col("duration"), F.lit(hop)) * (2 * math.pi)
    waves = [F.sin(phase * (i // 2 + 1)) if i % 2 == 0 else F.cos(phase * (i // 2 + 1)) for i in range(dim)]
    return rows.select(*keys, "frame_idx", "time", F.array(*waves).alias("vec"))


def mean_pool(frames: DataFrame, intervals: DataFrame, keys: Sequence[str] = KEYS, empty: str = "nearest") -> DataFrame:
    """The mean vector of the frames with start <= time < end; an interval without frames takes the frame nearest to its
    centre (the earlier on ties), zeros, or raises. Intervals of a track must not overlap.

    Frames find their interval by an as-of lookup, so no pairs are formed, and are added up before any shuffle of vectors."""
    if empty not in ("nearest", "zeros", "raise"):
        raise ValueError("empty must be nearest, zeros or raise")
    placed = asof(frames, intervals, keys, "time", "start_time", ["idx", "end_time"]).where(F.col("time") < F.col("hit.end_time"))
    pooled = vector_mean(placed.withColumn("idx", F.col("hit.idx")), [*keys, "idx"], "vec")
    out = intervals.join(pooled, [*keys, "idx"], "left")
    holes = out.where(F.col("vec").isNull()).drop("vec")
    if empty == "raise":
        return out.withColumn("vec", F.when(F.col("vec").isNull(), F.raise_error(F.lit("an interval has no frames")).cast("array<double>")).otherwise(F.col("vec")))
    if empty == "zeros":
        size = frames.select(F.size("vec").alias("n")).limit(1).select(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.lit(0.0)).alias("zero"))
        return out.crossJoin(F.broadcast(size)).withColumn("vec", F.coalesce("vec", "zero")).drop("zero")
    centred = holes.withColumn("time", (F.col("start_time") + F.col("end_time")) / 2)
    near = nearest(centred, frames.select(*keys, "time"), keys)
    pick = F.when(F.col("after").isNull() | (F.col("time") - F.col("before") <= F.col("after") - F.col("time")), F.col("before")).otherwise(F.col("after"))
    first = frames.groupBy(*keys, "time").agg(F.min_by("vec", "frame_idx").alias("vec"))
    filled = near.withColumn("time", pick).join(first, [*keys, "time"]).select(*intervals.columns, F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    return out.where(F.col("vec").isNotNull()).select(*intervals.columns, "vec").unionByName(filled)


def median_bpm(beats: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """60 by the median of the positive gaps between beats; null below two beats."""
    gaps = beats.withColumn("_gap", F.col("time") - F.lag("time").over(window(keys, "beat_idx")))
    return gaps.groupBy(*keys).agg((60.0 / F.median(F.when(F.col("_gap") > 0, F.col("_gap")))).alias("bpm"))


def subsample_beats(pooled: DataFrame, bpm: DataFrame, keys: Sequence[str] = KEYS, factor: int = 2, threshold: float = 140.0, pooling: str = "mean") -> DataFrame:
    """In tracks faster than ``threshold``, every ``factor`` intervals become one with the mean or the first vector."""
    if factor < 1 or threshold <= 0 or pooling not in ("mean", "first"):
        raise ValueError("factor must be 1 at least, threshold positive, pooling mean or first")
    fast = pooled.join(bpm, list(keys), "left").withColumn("subsampled", F.coalesce(F.col("bpm") > threshold, F.lit(False)) & F.lit(factor > 1))
    chunked = fast.withColumn("_chunk", F.when(F.col("subsampled"), F.floor(F.col("idx") / factor)).otherwise(F.col("idx")))
    groups = [*keys, "_chunk"]
    spans = chunked.groupBy(*groups).agg(F.min_by("start_time", "idx").alias("start_time"), F.max_by("end_time", "idx").alias("end_time"), F.first("subsampled").alias("subsampled"), F.min_by("vec", "idx").alias("_first"))
    if pooling == "mean":
        spans = spans.join(vector_mean(chunked, groups, "vec"), groups)
    else:
        spans = spans.withColumn("vec", F.col("_first"))
    return spans.select(*keys, F.col("_chunk").alias("idx"), "start_time", "end_time", "vec", "subsampled")


def assign_overlap(intervals: DataFrame, sections: DataFrame, keys: Sequence[str] = KEYS, unknown: str | None = None) -> DataFrame:
    """The label with the largest positive overlap, of one section, the earlier on ties; else ``unknown``; else null. ``idx``
    tells a track's intervals apart. One sweep over both tables; nothing is joined."""
    met = overlap_sweep(intervals, sections.select(*keys, "idx", "start_time", "end_time", "label"), keys, how="left")
    label = F.max_by("r_label", F.when(F.col("overlap").isNotNull(), F.struct("overlap", -F.col("r_idx"))))
    others = [c for c in intervals.columns if c not in (*keys, "idx", "label")]
    out = met.groupBy(*keys, "idx").agg(*[F.first(c).alias(c) for c in others], (label if unknown is None else F.coalesce(label, F.lit(unknown))).alias("_label"))
    return out.select(*[c for c in intervals.columns if c != "label"], F.col("_label").alias("label"))


def adjust_timeline(sections: DataFrame, tracks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sections cut to [0, duration], those outside dropped, and what is missing at either end filled with T_MIN and
    T_MAX. A duration that is not positive raises; tracks without sections have no rows."""
    return fit_timeline(join_sequences(sections.select(*keys, "idx", "start_time", "end_time", "label"), tracks.select(*keys, "duration"), keys), keys)


def fit_timeline(timed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``adjust_timeline`` of sections that have their track's ``duration`` as a column."""
    d = F.when(F.col("duration") > 0, F.col("duration")).otherwise(F.raise_error(F.lit("duration must be positive")).cast("double"))
    inside = timed.withColumn("duration", d)
    inside = inside.where((F.col("end_time") > 0) & (F.col("start_time") < F.col("duration")))
    cut = inside.withColumns({"start_time": F.greatest("start_time", F.lit(0.0)), "end_time": F.least("end_time", "duration")})
    # the first and the last section of a track bring the missing ends along, so that the sections are read once
    own = Window.partitionBy(*keys)
    cut = cut.withColumns({"_lo": F.min("start_time").over(own), "_hi": F.max("end_time").over(own), "_first": F.min("idx").over(own), "_last": F.max("idx").over(own)})
    row = lambda idx, start, end, label: F.struct(idx.cast(dict(timed.dtypes)["idx"]).alias("idx"), start.alias("start_time"), end.alias("end_time"), label.alias("label"))
    head = F.when((F.col("idx") == F.col("_first")) & (F.col("_lo") > 0), row(F.col("_first") - 1, F.lit(0.0), F.col("_lo"), F.lit(T_MIN)))
    tail = F.when((F.col("idx") == F.col("_last")) & (F.col("_hi") < F.col("duration")), row(F.col("_last") + 1, F.col("_hi"), F.col("duration"), F.lit(T_MAX)))
    every = F.array_compact(F.array(head, row(F.col("idx"), F.col("start_time"), F.col("end_time"), F.col("label")), tail))
    return cut.select(*keys, F.inline(every))


def assign_points(points: DataFrame, timeline: DataFrame, keys: Sequence[str] = KEYS, at: str = "start_time") -> DataFrame:
    """The section of each point: the last that begins by then (the first, before all), or the next if that has ended."""
    w = window(keys, "idx")
    ahead = timeline.withColumn("_next", F.lead("label").over(w))
    found = asof(points, ahead, keys, at, "start_time", ["label", "end_time", "_next"])
    out = found.join(_first_two(timeline, keys), list(keys), "left")
    early = F.when((F.col(at) >= F.col("_first_end")) & F.col("_second").isNotNull(), F.col("_second")).otherwise(F.col("_first"))
    late = F.when((F.col(at) >= F.col("hit.end_time")) & F.col("hit._next").isNotNull(), F.col("hit._next")).otherwise(F.col("hit.label"))
    return out.withColumn("label", F.when(F.col("hit").isNull(), early).otherwise(late)).drop("hit", "_first", "_first_end", "_second")


def _first_two(timeline: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = window(keys, "idx")
    ranked = timeline.withColumns({"_rank": F.row_number().over(w), "_second": F.lead("label").over(w)})
    return ranked.where("_rank = 1").select(*keys, F.col("label").alias("_first"), F.col("end_time").alias("_first_end"), "_second")


def candidate_labels(sections: DataFrame, vocabulary: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """The labels of each track as first seen, and the vocabulary's silence-like label at the end if the track lacks it:
    rows (track, label, label_idx). Labels that the vocabulary lacks raise."""
    own = sections.groupBy(*keys, "label").agg(F.min("idx").alias("_at"))
    if vocabulary is not None:
        rank = F.coalesce(*[F.when(F.lower("label") == s, F.lit(i)) for i, s in enumerate(SILENCE_LIKE)])
        best = vocabulary.withColumn("_rank", rank).where("_rank IS NOT NULL").orderBy("_rank", F.desc("label_idx")).limit(1).select(F.col("label").alias("label"))
        silent = own.select(*keys).distinct().crossJoin(F.broadcast(best)).join(own.select(*keys, "label"), [*keys, "label"], "left_anti")
        own = own.unionByName(silent.withColumn("_at", F.lit(None).cast("long")))
        known = own.join(vocabulary.select("label", F.lit(True).alias("_known")), "label", "left")
        own = known.withColumn("label", F.when(F.col("_known"), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("no such label in the vocabulary: "), F.col("label"))))).drop("_known")
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("_at"), "label")) - 1
    return own.select(*keys, "label", at.alias("label_idx"))


def encode_timeline(assigned: DataFrame, candidates: DataFrame, keys: Sequence[str] = KEYS, no_overlap: int | None = IGNORE) -> DataFrame:
    """Adds ``target``, the candidate index of the label; the padding labels stand for the track's silence-like
    candidate; what is no candidate gets ``no_overlap``, or raises if that is None."""
    rank = F.coalesce(*[F.when(F.lower("label") == s, F.lit(i)) for i, s in enumerate(SILENCE_LIKE)])
    silent = candidates.withColumn("_rank", rank).where("_rank IS NOT NULL").groupBy(*keys).agg(F.max_by("label", F.struct(-F.col("_rank"), "label_idx")).alias("_silent"))
    named = assigned.join(silent, list(keys), "left").withColumn("_name", F.when(F.col("label").isin(T_MIN, T_MAX), F.coalesce("_silent", "label")).otherwise(F.col("label")))
    out = named.join(candidates.select(*keys, F.col("label").alias("_name"), F.col("label_idx").alias("target")), [*keys, "_name"], "left")
    missing = F.lit(no_overlap) if no_overlap is not None else F.raise_error(F.concat(F.lit("no candidate label "), F.col("label"))).cast("int")
    return out.withColumn("target", F.coalesce("target", missing)).drop("_name", "_silent")


def base_targets(rows: DataFrame, candidates: DataFrame, keys: Sequence[str] = KEYS, ignore: int = IGNORE) -> DataFrame:
    """Adds ``base_target``, the place of the target's base label among the bases as first seen."""
    based = candidates.withColumn("_base", label_base("label"))
    first = based.withColumn("_at", F.min("label_idx").over(Window.partitionBy(*keys, "_base")))
    index = first.select(*keys, F.col("label_idx").alias("target"), (F.dense_rank().over(Window.partitionBy(*keys).orderBy("_at")) - 1).alias("base_target"))
    return rows.join(index, [*keys, "target"], "left").withColumn("base_target", F.coalesce("base_target", F.lit(ignore)))


def segment_targets(rows: DataFrame, keys: Sequence[str] = KEYS, order: str = "idx", ignore: int = IGNORE) -> DataFrame:
    """Adds ``segment_target``, the number of the run of equal targets; ignored rows break runs and have no number."""
    valid = F.col("target") != ignore
    new = valid & F.coalesce(differs("target", keys, order), F.lit(True))
    count = F.sum(F.col("_new").cast("int")).over(window(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_new", new).withColumn("segment_target", F.when(valid, count - 1).otherwise(ignore)).drop("_new")


def training_examples(frames: DataFrame, beats: DataFrame, tracks: DataFrame, sections: DataFrame, keys: Sequence[str] = KEYS, assignment: str = "adjusted_start", subsample: dict | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    """One row per grid interval: pooled vector, label, target, base target, segment target. Targets come from the
    adjusted timeline at the interval's start or centre; with ``max_overlap``, or where beats were subsampled, by overlap."""
    pooled = mean_pool(frames, beat_intervals(beats, tracks, keys), keys).withColumn("subsampled", F.lit(False))
    if subsample is not None:
        pooled = subsample_beats(pooled.drop("subsampled"), median_bpm(beats, keys), keys, **subsample)
    candidates = candidate_labels(sections, vocabulary, keys)
    spans = pooled.select(*keys, "idx", "start_time", "end_time", ((F.col("start_time") + F.col("end_time")) / 2).alias("centre"))
    timeline = adjust_timeline(sections, tracks, keys)
    points = assign_points(spans, timeline, keys, "centre" if assignment == "adjusted_center" else "start_time")
    by_overlap = assign_overlap(spans, sections, keys).select(*keys, "idx", F.col("label").alias("_overlap"))
    use = F.lit(True) if assignment == "max_overlap" else F.col("subsampled")
    both = points.join(by_overlap, [*keys, "idx"]).join(pooled.select(*keys, "idx", "vec", "subsampled"), [*keys, "idx"])
    named = both.withColumn("label", F.when(use, F.coalesce("_overlap", F.lit(T_MIN))).otherwise(F.col("label"))).drop("_overlap", "centre")
    return segment_targets(base_targets(encode_timeline(named, candidates, keys), candidates, keys), keys)


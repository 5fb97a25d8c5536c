"""Label vocabularies, track filters, validation and splits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segloom.functions.labels import draw_key, SILENCE, canonical_space, canonical_underscore, hash_embedding, normalize_label, prompt, prompt_label
from segloom.operators.policies import KEYS


def first_seen(rows: DataFrame, by: Sequence[str], value: str, *order: str) -> DataFrame:
    """V1: the different values of each group as first seen: rows (by, value, label_idx)."""
    seen = rows.groupBy(*by, value).agg(F.min(F.struct(*order)).alias("_at"))
    return seen.withColumn("label_idx", F.row_number().over(Window.partitionBy(*by).orderBy("_at")) - 1).drop("_at")


def vocabulary(sections: DataFrame, by: Sequence[str], *order: str, silence: bool = True) -> DataFrame:
    """V2: the labels of each ``by`` (a dataset, or a track) in the given order of first sight, and 'silence' at the end of a
    dataset's vocabulary that has none. Labels are few; what is counted and numbered is one row per label."""
    own = first_seen(sections, by, "label", *order)
    if not silence:
        return own
    quiet = F.max((canonical_underscore("label") == SILENCE).cast("int"))
    lacking = own.groupBy(*by).agg(quiet.alias("_quiet"), (F.max("label_idx") + 1).alias("label_idx")).where("_quiet = 0")
    return own.unionByName(lacking.select(*by, F.lit(SILENCE).alias("label"), "label_idx"))


def encode_labels(labels: DataFrame, by: Sequence[str], preset: str = "none", overrides: dict | None = None, disambiguate: bool = False, mode: str = "bare", template: str | None = None, dim: int = 16, encoder=None) -> DataFrame:
    """V3: adds text_label, prompt_label, prompt and vec. ``encoder`` maps the prompt column to a vector column (a pandas UDF
    of a model, say); the hash embedding stands in for it. Only different labels are encoded: ``labels`` is a vocabulary."""
    text = labels.withColumn("text_label", normalize_label("label", preset, overrides))
    same = F.count(F.lit(1)).over(Window.partitionBy(*by, "text_label"))
    told = text.withColumn("prompt_label", prompt_label("label", "text_label", same) if disambiguate else F.col("text_label"))
    asked = told.withColumn("prompt", prompt("label", "text_label", "prompt_label", mode, template))
    return asked.withColumn("vec", (encoder or (lambda c: hash_embedding(c, dim)))(F.col("prompt")))


def filter_tracks(sections: DataFrame, keys: Sequence[str] = KEYS, min_useful_labels: int = 0, min_segments: int = 0, ignore: Sequence[str] = (), mode: str = "any", policy: str | None = None) -> DataFrame:
    """V4: tracks with enough different labels outside ``ignore`` and enough sections, under any or all of the policies."""
    if mode not in ("any", "all") or min_useful_labels < 0 or min_segments < 0:
        raise ValueError("mode is any or all, the minima are not negative")
    useful = reduce(lambda a, b: a & b, [canonical_space("label") != canonical_space(F.lit(x)) for x in ignore], F.lit(True))
    groups = [*keys, *([policy] if policy else [])]
    each = sections.groupBy(*groups).agg(F.count_distinct(F.when(useful, F.col("label"))).alias("useful"), F.count("*").alias("n"))
    passed = each.withColumn("_ok", (F.col("useful") >= min_useful_labels) & (F.col("n") >= min_segments))
    return passed.groupBy(*keys).agg((F.bool_or if mode == "any" else F.bool_and)("_ok").alias("_ok")).where("_ok").select(*keys)


def validate_tracks(tracks: DataFrame, sections: DataFrame, files: DataFrame | None = None, keys: Sequence[str] = KEYS, namespace: str = "segment_open") -> DataFrame:
    """V5: one row per track: valid, num_sections, duration, labels (in order) and errors. ``files`` lists the paths that exist
    (``path``); the tracks then name them in audio_path and jams_path."""
    ordered = Window.partitionBy(*keys).orderBy("idx")
    at = sections.withColumn("_i", F.row_number().over(ordered) - 1)
    found = at.groupBy(*keys).agg(
        F.count("*").alias("num_sections"),
        F.max("end_time").alias("duration"),
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "label"))), lambda s: s["label"]).alias("labels"),
        F.array_sort(F.collect_list(F.when(F.col("end_time") <= F.col("start_time"), F.struct("_i", F.lit(0).alias("k"))))).alias("_flat"),
        F.array_sort(F.collect_list(F.when(F.coalesce("label", F.lit("")) == "", F.struct("_i", F.lit(1).alias("k"))))).alias("_blank"),
    )
    out = tracks.join(found, list(keys), "left")
    missing: list[Column] = []
    if files is not None:
        for kind, col in (("audio", "audio_path"), ("JAMS", "jams_path")):
            there = files.select(F.col("path").alias(col), F.lit(True).alias(f"_{kind}"))
            out = out.join(there, col, "left")
            missing.append(F.when(F.col(f"_{kind}").isNull(), F.concat(F.lit(f"Missing {kind} file: "), F.col(col))))
    said = lambda s: F.when(s["k"] == 0, F.concat(F.lit("Section "), s["_i"].cast("string"), F.lit(" has non-positive duration"))).otherwise(F.concat(F.lit("Section "), s["_i"].cast("string"), F.lit(" has an empty label")))
    none = F.when(F.col("num_sections").isNull(), F.lit(f"No sections found in namespace '{namespace}'"))
    rows = F.transform(F.array_sort(F.concat(F.coalesce("_flat", F.array()), F.coalesce("_blank", F.array()))), said)
    errors = F.concat(F.array_compact(F.array(*missing, none)), F.coalesce(rows, F.array().cast("array<string>")))
    out = out.withColumns({"errors": errors, "num_sections": F.coalesce("num_sections", F.lit(0)).cast("long"), "labels": F.coalesce("labels", F.array().cast("array<string>"))})
    return out.withColumn("valid", F.size("errors") == 0).drop("_flat", "_blank", "_audio", "_JAMS")


def summarize_validation(results: DataFrame) -> DataFrame:
    """V6: totals in one row; sections and duration are those of valid tracks, the duration null if none has one."""
    ok = F.col("valid")
    return results.agg(F.count("*").alias("num_tracks"), F.count_if(ok).alias("num_valid_tracks"), F.count_if(~ok).alias("num_invalid_tracks"), F.coalesce(F.sum(F.when(ok, F.col("num_sections"))), F.lit(0)).alias("num_sections"), F.sum(F.when(ok, F.col("duration"))).alias("duration"))


def label_counts(results: DataFrame) -> DataFrame:
    """V6: how often each label occurs in valid tracks."""
    return results.where("valid").select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def top_labels(counts: DataFrame, n: int = 20) -> DataFrame:
    """V7."""
    return counts.orderBy(F.desc("n"), "label").limit(n)


def split_counts(n: int, train: float = 0.8, val: float = 0.2, test: float = 0.0) -> dict[str, int]:
    """How many tracks each split gets; halves round to even, train takes the rest."""
    ratios = {"train": train, "val": val, "test": test}
    if n <= 0 or min(ratios.values()) < 0 or sum(ratios.values()) <= 0:
        raise ValueError("there must be tracks, and ratios of which none is negative and one is positive")
    total = sum(ratios.values())
    v, t = round(n * val / total), round(n * test / total)
    if n - v - t < 0:
        raise ValueError("the ratios leave no tracks for train")
    return {"train": n - v - t, "val": v, "test": t}


def split_tracks(tracks: DataFrame, train: float = 0.8, val: float = 0.2, test: float = 0.0, seed: int = 0, shuffle: bool = True, order: str = "manifest_ord", track: str = "track_id") -> DataFrame:
    """Adds ``split``. Shuffled tracks are ranked by a hash of seed and id, others by manifest order, through two numbers
    counted per hash bucket, so that no task ranks them all; the draw is not that of any one generator."""
    counts = split_counts(tracks.count(), train, val, test)
    key = draw_key(F.lit(seed), F.col(track)) if shuffle else F.col(order).cast("long")
    keyed = tracks.withColumn("_key", key)
    lo, hi = keyed.agg(F.min("_key"), F.max("_key")).first()
    width = max(1, (hi - lo) // 1024 + 1)
    keyed = keyed.withColumn("_part", F.floor((F.col("_key").cast("decimal(20,0)") - lo) / width).cast("int"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # of 1,025 rows at most
    offsets = keyed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    at = F.row_number().over(Window.partitionBy("_part").orderBy("_key", track)) - 1
    ranked = keyed.withColumn("_at", at).join(F.broadcast(offsets), "_part").withColumn("_at", F.col("_at") + F.col("_from"))
    name = F.when(F.col("_at") < counts["train"], "train").when(F.col("_at") < counts["train"] + counts["val"], "val").otherwise("test")
    return ranked.withColumn("split", name).drop("_key", "_part", "_from", "_at")


def sample_frames(frames: DataFrame, most: int = 512, keys: Sequence[str] = KEYS, order: str = "frame_idx") -> DataFrame:
    """Of tracks with more than ``most`` frames those at evenly spaced places, rounded half to even."""
    if most < 2:
        raise ValueError("most must be 2 at least")
    counted = frames.withColumns({"_n": F.count(F.lit(1)).over(Window.partitionBy(*keys)), "_at": F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1})
    step = (F.col("_n") - 1) / F.lit(most - 1)
    # the sample's place that rounds to this row, if any, is next to at / step
    near = F.floor(F.col("_at") / step)
    hit = reduce(lambda a, b: a | b, [((near + k) < most) & ((near + k) >= 0) & (F.bround((near + k) * step) == F.col("_at")) for k in (-1, 0, 1)])
    return counted.where((F.col("_n") <= most) | hit).drop("_n", "_at")


def first_tracks(tracks: DataFrame, n: int, order: str = "manifest_ord") -> DataFrame:
    """R4."""
    return tracks.orderBy(order).limit(n)

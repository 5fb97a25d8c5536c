"""Frame-label scores to segments: scoring, smoothing, decoding, merging, cleaning, and a search over their settings.

Score tables hold one row per frame: (track_id, frame_idx, scores array<double>), with start_time and end_time where segments
are made.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from segloom.functions.paths import best_paths, check, clean, clean_segments, transfers, viterbi, weights_of  # noqa: F401
from segloom.functions.vectors import argmax, dot, normalized, sigmoid, softmax
from segloom.operators.grid import IGNORE
from segloom.operators.policies import KEYS
from segloom.plans.scratch import stored
from segloom.plans.sequences import differs, islands, join_sequences, window

#: Frames of a block of a long track.
BLOCK = 4096
#: Blocks to a file, numbers that a kernel gets at a time, and blocks up to which what is known of each is broadcast.
FILE_BLOCKS, CELLS, FEW = 16, 1_000_000, 500_000
INTS = ArrayType(IntegerType())


def score_frames(frames: DataFrame, labels: DataFrame, keys: Sequence[str] = KEYS, temperature: float = 0.07, label_keys: Sequence[str] = ()) -> DataFrame:
    """Each frame's normalised product with each candidate label's vector, by ``temperature``, in label order.
    ``label_keys``: columns in which the candidates differ, such as the track; none if all frames share them."""
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    sets = labels.select(*label_keys, "label_idx", normalized("vec").alias("v")).groupBy(*label_keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("label_idx", "v"))), lambda s: s["v"]).alias("_labels"))
    unit = frames.withColumn("_v", normalized("vec"))
    both = unit.join(sets, list(label_keys)) if label_keys else unit.crossJoin(F.broadcast(sets))  # one row
    return both.withColumn("scores", F.transform("_labels", lambda t: dot(F.col("_v"), t) / temperature)).drop("_v", "_labels")


def project(frames: DataFrame, weights: Sequence[tuple[np.ndarray, np.ndarray]], vec: str = "vec") -> DataFrame:
    """Vectors through linear layers given as (matrix, bias), with GELU between them, a batch of rows at a time."""
    from math import sqrt

    layers = frames.sparkSession.sparkContext.broadcast([(np.asarray(w, float), np.asarray(b, float)) for w, b in weights])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        erf = np.vectorize(__import__("math").erf)
        for rows in batches:
            if len(rows):
                x = np.stack(rows[vec].to_numpy()).astype(float)
                for i, (w, b) in enumerate(layers.value):
                    x = x @ w + b
                    if i + 1 < len(layers.value):
                        x = 0.5 * x * (1 + erf(x / sqrt(2)))
                rows = rows.assign(**{vec: list(x)})
            yield rows

    others = [f"`{f.name}` {f.dataType.simpleString()}" if f.name != vec else f"`{vec}` array<double>" for f in frames.schema]
    return frames.mapInPandas(run, ", ".join(others))


def frame_confidence(rows: DataFrame) -> DataFrame:
    """Adds the softmax of the scores and its largest value."""
    return rows.withColumn("probabilities", softmax("scores")).withColumn("confidence", F.array_max("probabilities"))


def smooth_scores(rows: DataFrame, size: int = 1, mode: str = "mean", keys: Sequence[str] = KEYS) -> DataFrame:
    """D3: each label's mean or median over ``size`` frames around, the first and last repeated beyond the ends."""
    if size <= 1:
        return rows
    if size % 2 == 0 or mode not in ("mean", "median"):
        raise ValueError("the window must be odd, the mode mean or median")
    radius = size // 2
    w = window(keys, "frame_idx")
    near = F.collect_list(F.col("scores").cast("array<double>")).over(w.rowsBetween(-radius, radius))
    held = rows.withColumn("_near", near).withColumn("_before", F.least(F.row_number().over(w) - 1, F.lit(radius)))
    # the window is cut at a track's ends, where its first and last row stand for the missing ones
    first, last = F.array_repeat(F.get("_near", F.lit(0)), radius - F.col("_before")), F.array_repeat(F.element_at("_near", -1), radius + 1 + F.col("_before") - F.size("_near"))
    whole = held.withColumn("_near", F.concat(first, "_near", last))
    if mode == "mean":
        total = F.aggregate(F.slice("_near", 2, size - 1), F.get("_near", F.lit(0)), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
        value = F.transform(total, lambda x: x / size)
    else:
        value = F.transform(F.get("_near", F.lit(0)), lambda x, i: F.get(F.array_sort(F.transform("_near", lambda row: F.get(row, i))), F.lit(radius)))
    return whole.withColumn("scores", value).drop("_near", "_before")


def decode_argmax(rows: DataFrame) -> DataFrame:
    """Adds ``label_idx``."""
    return rows.withColumn("label_idx", argmax("scores").cast("int"))


def _packed(rows: DataFrame, by: Sequence[str], boundary: str | None) -> DataFrame:
    """A row for each group, with its frames in order (``_frames``), their scores end to end, and the boundary probabilities."""
    others = [c for c in rows.columns if c not in (*by, "frame_idx")]
    frames = F.array_sort(F.collect_list(F.struct("frame_idx", *others)))
    prior = F.transform("_frames", lambda f: f[boundary].cast("double")) if boundary else F.lit(None).cast("array<double>")
    return rows.groupBy(*by).agg(frames.alias("_frames")).withColumns({"_n": F.size("_frames"), "_flat": F.flatten(F.transform("_frames", lambda f: f["scores"].cast("array<double>"))), "_prior": prior})


def _between(prior: pd.Series, weight: Sequence[float], eps: Sequence[float]) -> list[tuple[np.ndarray, np.ndarray] | None]:
    return [None if p is None or w == 0 else weights_of(np.asarray(p, float), w, e) for p, w, e in zip(prior, weight, eps, strict=True)]


def _by_labels(flat: pd.Series, n: pd.Series) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Rows with the same number of labels, and their scores as matrices; ``CELLS`` numbers at a time, as kernels pad and repeat
    what they get."""
    scores = [np.asarray(x, float).reshape(c, -1) for x, c in zip(flat, n.tolist(), strict=True)]
    for k in sorted({x.shape[1] for x in scores}):
        at, cells = [], 0
        for i, x in enumerate(scores):
            if x.shape[1] != k:
                continue
            if at and cells + x.size > CELLS:
                yield at, [scores[j] for j in at]
                at, cells = [], 0
            at.append(i)
            cells += x.size
        yield at, [scores[j] for j in at]


@F.pandas_udf(INTS)
def _paths(flat: pd.Series, n: pd.Series, prior: pd.Series, penalty: pd.Series, weight: pd.Series, eps: pd.Series, start: pd.Series, goal: pd.Series) -> pd.Series:
    """Best paths of packed rows. ``start``: scores on entering the first frame, or null; ``goal``: the label of the frame after
    the last, or null where nothing follows."""
    between = _between(prior, weight.tolist(), eps.tolist())
    out: list[list[int]] = [[] for _ in range(len(flat))]
    for at, scores in _by_labels(flat, n):
        k = scores[0].shape[1]
        goals = [goal.iloc[i] for i in at]
        goals = np.array([-1 if g is None or g != g else int(g) for g in goals])
        whole = [x if g < 0 else np.concatenate([x, np.zeros((1, k))]) for x, g in zip(scores, goals.tolist(), strict=True)]
        begin = np.array([np.zeros(k) if start.iloc[i] is None else np.asarray(start.iloc[i], float) for i in at])
        for i, x, path in zip(at, scores, best_paths(whole, penalty.to_numpy(float)[at], [between[i] for i in at], begin, goals), strict=True):
            out[i] = path[: len(x)].tolist()
    return pd.Series(out, dtype=object)


def decode_viterbi(rows: DataFrame, keys: Sequence[str] = KEYS, penalty: float = 0.0, weight: float = 0.0, eps: float = 1e-4, boundary: str | None = None, block: int = BLOCK) -> DataFrame:
    """Adds ``label_idx``. ``boundary`` names the column of the probability of a boundary after the frame.

    The tracks go to Python as one row each, with their scores only, and a batch of them is decoded together. If any frame
    index reaches ``block``, tracks are cut into blocks of so many frames: blocks give their max-plus transfer matrices in
    parallel, the products along a track give each block's scores on entering it, a second pass the label before for every
    label after a block, and a last one the paths. So a task holds a block of frames, and of a track only a matrix a block
    (labels / ``block`` of its scores). Blocks add in another order than one pass, so of paths whose scores differ by rounding
    only either may be taken.
    """
    check(penalty, weight, eps)
    number = [F.lit(float(x)) for x in (penalty, weight, eps)]
    nothing, no_goal = F.lit(None).cast("array<double>"), F.lit(None).cast("int")
    last, count = rows.agg(F.max("frame_idx"), F.count("*")).first()
    if last is None or last < block:
        packed = _packed(rows, keys, boundary)
        labels = packed.withColumn("_path", _paths("_flat", "_n", "_prior", *number, nothing, no_goal))
        return _unpacked(labels, rows, keys)
    every = [*keys, "_block"]
    # a task reads files up to a size, and Python gets what it reads at once: so a file holds few blocks, however many there are
    files = max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // (block * FILE_BLOCKS)))
    few = F.broadcast if count // block <= FEW else lambda df: df  # joined where the blocks are read
    packed = stored(_packed(rows.withColumn("_block", F.floor(F.col("frame_idx") / block)).repartition(files, *every), every, boundary), "blocks")

    @F.pandas_udf("array<double>")
    def matrices(flat: pd.Series, n: pd.Series, prior: pd.Series) -> pd.Series:
        between, out = _between(prior, [weight] * len(n), [eps] * len(n)), [[]] * len(n)
        for at, scores in _by_labels(flat, n):
            for i, matrix in zip(at, transfers(scores, penalty, [between[i] for i in at]), strict=True):
                out[i] = matrix.ravel().tolist()
        return pd.Series(out, dtype=object)

    kinds = ", ".join(f"`{c}` {dict(packed.dtypes)[c]}" for c in every)

    def entering(track: pd.DataFrame) -> pd.DataFrame:
        track = track.sort_values("_block")
        starts, at = [], None
        for flat in track["_matrix"]:
            k = int(round(len(flat) ** 0.5))
            at = np.zeros(k) if at is None else at
            starts.append(at)
            at = (at[:, None] + np.asarray(flat, float).reshape(k, k)).max(0)
        return track[every].assign(_start=pd.Series([x.tolist() for x in starts], index=track.index, dtype=object), _ends=np.arange(len(track)) == len(track) - 1)

    starts = stored(packed.select(*every, matrices("_flat", "_n", "_prior").alias("_matrix")).groupBy(*keys).applyInPandas(entering, f"{kinds}, _start array<double>, _ends boolean"), "blocks_begun")
    begun = packed.join(few(starts), _same(packed, starts, every)).select(packed["*"], "_start", "_ends")

    @F.pandas_udf("array<int>")
    def befores(flat: pd.Series, n: pd.Series, prior: pd.Series, start: pd.Series, ends: pd.Series) -> pd.Series:
        """The label of a block's first frame for each label after it; of a last block that of its own best path."""
        between, out = _between(prior, [weight] * len(n), [eps] * len(n)), [[] for _ in range(len(n))]
        for at, scores in _by_labels(flat, n):
            k = scores[0].shape[1]
            rows = [(i, x if g < 0 else np.concatenate([x, np.zeros((1, k))]), g) for i, x in zip(at, scores, strict=True) for g in ([-1] if ends.iloc[i] else range(k))]
            begin = np.array([np.asarray(start.iloc[i], float) for i, _, _ in rows])
            for (i, _, _), path in zip(rows, best_paths([x for _, x, _ in rows], np.full(len(rows), penalty), [between[i] for i, _, _ in rows], begin, np.array([g for _, _, g in rows])), strict=True):
                out[i].append(int(path[0]))
        return pd.Series(out, dtype=object)

    def following(track: pd.DataFrame) -> pd.DataFrame:
        track = track.sort_values("_block", ascending=False)
        goals, at = [], None
        for firsts in track["_firsts"]:
            goals.append(at)
            at = int(firsts[0] if at is None else firsts[at])
        return track[every].assign(_goal=pd.array(goals, "Int32"))

    goals = begun.select(*every, befores("_flat", "_n", "_prior", "_start", "_ends").alias("_firsts")).groupBy(*keys).applyInPandas(following, f"{kinds}, _goal int")
    goals = stored(goals, "blocks_goals")
    whole = begun.join(few(goals), _same(begun, goals, every)).select(begun["*"], "_goal")
    return _unpacked(whole.withColumn("_path", _paths("_flat", "_n", "_prior", *number, "_start", "_goal")), rows, keys)


def _same(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> list[Column]:
    return [a[c].eqNullSafe(b[c]) for c in columns]


def _unpacked(packed: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    pairs = packed.select(*keys, F.inline(F.arrays_zip("_frames", "_path")))
    return pairs.select(*[F.col(c) if c in keys else F.col(f"_frames.{c}") for c in rows.columns], F.col("_path").alias("label_idx"))


def merge_frames(rows: DataFrame, keys: Sequence[str] = KEYS, label: str = "label", order: str = "frame_idx") -> DataFrame:
    """Runs of equal labels as segments (track, idx, start_time, end_time, label)."""
    runs = islands(rows, keys, order, differs(label, keys, order))
    return runs.groupBy(*keys, "island").agg(F.min_by("start_time", order).alias("start_time"), F.max_by("end_time", order).alias("end_time"), F.first(label).alias("label")).withColumnRenamed("island", "idx")


def boundary_times(rows: DataFrame, keys: Sequence[str] = KEYS, order: str = "frame_idx") -> DataFrame:
    """The midpoint between each frame's start and the next's."""
    nxt = F.lead("start_time").over(window(keys, order))
    return rows.withColumn("time", (F.col("start_time") + nxt) / 2).where(F.col("time").isNotNull())


def split_mask(rows: DataFrame, keys: Sequence[str] = KEYS, threshold: float = 0.5, mode: str = "peaks", p: str = "probability", order: str = "frame_idx") -> DataFrame:
    """Adds ``split``: the probability reaches the threshold and, in peaks mode, is above both neighbours. The ends are no
    peaks, but a single value needs the threshold only."""
    if mode not in ("threshold", "peaks") or not 0 <= threshold <= 1:
        raise ValueError("the mode is threshold or peaks, the threshold between 0 and 1")
    reach = F.col(p) >= threshold
    if mode == "threshold":
        return rows.withColumn("split", reach)
    w = window(keys, order)
    peak = F.coalesce((F.col(p) > F.lag(p).over(w)) & (F.col(p) > F.lead(p).over(w)), F.lit(False))
    return rows.withColumn("split", reach & (peak | (F.count(F.lit(1)).over(Window.partitionBy(*keys)) == 1)))


def merge_with_boundaries(rows: DataFrame, probabilities: DataFrame, keys: Sequence[str] = KEYS, threshold: float = 0.5, mode: str = "peaks", label: str = "label") -> DataFrame:
    """As D6, but a split also cuts a run, at the midpoint to the frame after. ``probabilities``: (track, frame_idx,
    probability) of a boundary after the frame. A cut lies between the run's start and the frame's end; pieces without
    length are left out."""
    masks = split_mask(probabilities, keys, threshold, mode).select(*keys, (F.col("frame_idx") + 1).alias("frame_idx"), "split")
    w = window(keys, "frame_idx")
    joined = rows.join(masks, [*keys, "frame_idx"], "left").withColumns({"_new": differs(label, keys, "frame_idx"), "_before": F.lag("start_time").over(w)})
    changed = F.col("_new") | F.coalesce("split", F.lit(False))
    runs = islands(joined, keys, "frame_idx", changed)
    middle = F.least((F.col("_before") + F.col("start_time")) / 2, F.col("end_time"))
    cut = F.when(F.coalesce(F.col("_new"), F.lit(True)), F.col("start_time")).otherwise(middle)
    pieces = runs.withColumn("_cut", cut).groupBy(*keys, "island").agg(F.min_by("_cut", "frame_idx").alias("start_time"), F.max_by("end_time", "frame_idx").alias("_end"), F.first(label).alias("label"))
    ends = pieces.withColumn("end_time", F.coalesce(F.lead("start_time").over(window(keys, "island")), "_end"))
    return ends.where("end_time > start_time").select(*keys, F.col("island").alias("idx"), "start_time", "end_time", "label")


@F.pandas_udf(StructType([StructField("start_time", ArrayType(DoubleType())), StructField("end_time", ArrayType(DoubleType())), StructField("label", ArrayType(StringType()))]))
def _cleaned(start: pd.Series, end: pd.Series, label: pd.Series, least: pd.Series, same: pd.Series) -> pd.DataFrame:
    rows = [clean(s.tolist(), e.tolist(), x.tolist(), least_, same_) for s, e, x, least_, same_ in zip(start, end, label, least.tolist(), same.tolist(), strict=True)]
    return pd.DataFrame(rows, columns=["start_time", "end_time", "label"])


def remove_short(segments: DataFrame, least: float | Column, keys: Sequence[str] = KEYS, merge_same: bool = True) -> DataFrame:
    """Segments shorter than ``least`` go to their neighbours, the first of a track first; a track is one row of arrays in
    Python, where it is cleaned in linear time. ``least`` may be one of the ``keys``, as a column."""
    bound = least if isinstance(least, Column) else F.lit(float(least))
    listed = segments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", F.col("start_time").cast("double").alias("start_time"), F.col("end_time").cast("double").alias("end_time"), "label"))).alias("_s"))
    done = listed.select(*keys, _cleaned("_s.start_time", "_s.end_time", "_s.label", bound, F.lit(merge_same)).alias("_c"))
    return done.select(*keys, F.posexplode(F.arrays_zip("_c.start_time", "_c.end_time", "_c.label")).alias("idx", "_x")).select(*keys, "idx", "_x.start_time", "_x.end_time", "_x.label")


def boundary_predictions(rows: DataFrame, keys: Sequence[str] = KEYS, logit: str = "boundary_logit") -> DataFrame:
    """Time, logit and probability of the boundary after each frame but the last."""
    return boundary_times(rows, keys).select(*keys, "frame_idx", "time", F.col(logit).alias("logit"), sigmoid(F.col(logit)).alias("probability"))


def reference_segments(rows: DataFrame, keys: Sequence[str] = KEYS, ignore: int = IGNORE, order: str = "frame_idx") -> DataFrame:
    """Runs of one target whose intervals touch; ignored frames cut and are left out."""
    w = window(keys, order)
    close = F.abs(F.lag("end_time").over(w) - F.col("start_time")) <= 1e-8 + 1e-5 * F.abs(F.col("start_time"))
    cut = F.coalesce(differs("target", keys, order) | ~close, F.lit(True)) | (F.col("target") == ignore)
    runs = islands(rows, keys, order, cut).where(F.col("target") != ignore)
    # a frame after an ignored one always differs from it, so it begins a run
    return runs.groupBy(*keys, "island").agg(F.min_by("start_time", order).alias("start_time"), F.max_by("end_time", order).alias("end_time"), F.first("target").alias("target")).withColumnRenamed("island", "idx")


def infer_segments(rows: DataFrame, names: Column | None = None, keys: Sequence[str] = KEYS, size: int = 7, mode: str = "mean", decoder: str = "viterbi", penalty: float = 8.0, least: float = 0.0) -> DataFrame:
    """Smooth, decode, merge and clean the scores of all tracks. ``names`` is an array of the labels."""
    smooth = smooth_scores(rows, size, mode, keys)
    decoded = decode_viterbi(smooth, keys, penalty) if decoder == "viterbi" else decode_argmax(smooth)
    named = decoded.withColumn("label", F.get(names, F.col("label_idx")) if names is not None else F.col("label_idx").cast("string"))
    merged = merge_frames(named, keys)
    return remove_short(merged, least, keys) if least > 0 else merged


#: The parameters of a grid search, with their types.
SETTING = {"window": "int", "mode": "string", "decoder": "string", "penalty": "double", "weight": "double", "eps": "double", "least": "double"}


@F.pandas_udf(StructType([StructField("first", INTS), StructField("label", INTS)]))
def _runs(path: pd.Series) -> pd.DataFrame:
    """Where the runs of equal labels of paths begin, and their labels."""
    firsts = [np.flatnonzero(np.diff(p, prepend=p[0] - 1)) for p in path]
    return pd.DataFrame({"first": pd.Series([f.tolist() for f in firsts], dtype=object), "label": pd.Series([np.asarray(p)[f].tolist() for p, f in zip(path, firsts, strict=True)], dtype=object)})


def grid_search(rows: DataFrame, reference: DataFrame, sizes: Sequence[int] = (1, 5, 9, 13, 19), modes: Sequence[str] = ("mean",), penalties: Sequence[float] = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0), least: Sequence[float] = (0.0,), keys: Sequence[str] = KEYS, decoders: Sequence[str] = ("viterbi",), weights: Sequence[float] = (0.0,), eps_values: Sequence[float] = (1e-4,), boundary: str | None = None) -> DataFrame:
    """Every combination of window, mode, decoder, penalty, boundary weight, eps and least duration on every track: means
    and deviations of boundary F at 0.5 and 3 s, pairwise F, NCE F and segment counts, best F at 3 s first. ``boundary``
    names the column of the probability of a boundary after the frame; without it, and in argmax, weights have no effect.

    A setting is a key beside the track's: scores are smoothed once per window and mode, decoded once for settings that differ
    only in what the decoder does not use, and the segments of all settings go through the metrics of ``evaluation`` together.
    The frames of a track are one row, so tracks must fit a task; ``decode_viterbi`` has the form for longer ones.
    """
    from itertools import product

    from segloom.operators.evaluation import adjust_pair, boundary_hits, contingency, entropy_scores, pair_scores

    if not set(decoders) <= {"viterbi", "argmax"}:
        raise ValueError("a decoder is viterbi or argmax")
    # settings that give the same segments share a number, and so do those that give the same paths
    paths: dict[tuple, int] = {}
    numbers: dict[tuple, int] = {}
    table = []
    for size, mode, decoder, penalty, weight, eps, shortest in product(sizes, modes, decoders, map(float, penalties), map(float, weights), map(float, eps_values), map(float, least)):
        check(penalty, weight, eps)
        used = decoder == "viterbi" and boundary is not None and weight != 0
        path = (size, mode, decoder, penalty if decoder == "viterbi" else 0.0, weight if used else 0.0, eps if used else 1e-4)
        number = numbers.setdefault((paths.setdefault(path, len(paths)), shortest), len(numbers))
        table.append((number, size, mode, decoder, penalty, weight, eps, shortest))
    spark = rows.sparkSession
    given = rows.select(*keys, "frame_idx", "start_time", "end_time", "scores", *([F.col(boundary).cast("double").alias("_b")] if boundary else []))
    row = lambda **values: F.struct(*[F.lit(v).alias(k) for k, v in values.items()])
    decoded = []
    for size, mode in dict.fromkeys(p[:2] for p in paths):
        own = F.array(*[row(path=n, viterbi=p[2] == "viterbi", penalty=p[3], weight=p[4], eps=p[5]) for p, n in paths.items() if p[:2] == (size, mode)])
        packed = _packed(smooth_scores(given, size, mode, keys), keys, "_b" if boundary else None).withColumn("_s", F.explode(own))
        best = F.when(F.col("_s.viterbi"), _paths("_flat", "_n", "_prior", "_s.penalty", "_s.weight", "_s.eps", F.lit(None).cast("array<double>"), F.lit(None).cast("int"))).otherwise(F.transform("_frames", lambda f: argmax(f["scores"]).cast("int")))
        runs = packed.select(*keys, F.col("_s.path").alias("path"), F.transform("_frames", lambda f: f["start_time"]).alias("_from"), F.transform("_frames", lambda f: f["end_time"]).alias("_to"), _runs(best).alias("_r"))
        at = runs.select(*keys, "path", "_from", "_to", F.posexplode(F.arrays_zip("_r.first", "_r.label", F.array_append(F.slice("_r.first", F.lit(2), F.size("_r.first")), F.size("_from")).alias("until"))).alias("idx", "_x"))
        decoded.append(at.select(*keys, "path", "idx", F.get("_from", F.col("_x.first")).cast("double").alias("start_time"), F.get("_to", F.col("_x.until") - 1).cast("double").alias("end_time"), F.col("_x.label").cast("string").alias("label")))
    merged = decoded[0]
    for other in decoded[1:]:
        merged = merged.unionByName(other)
    by_path = F.create_map(*[x for p in paths.values() for x in (F.lit(p), F.array(*[row(setting=n, least=shortest) for (q, shortest), n in numbers.items() if q == p]))])
    each = merged.select("*", F.inline(by_path[F.col("path")]))
    own_keys = [*keys, "setting"]
    segments = stored(remove_short(each, F.col("least"), [*own_keys, "least"]).drop("least"), "grid_segments")
    wanted = reference.select(*keys, F.row_number().over(window(keys, "start_time", "end_time", "label")).alias("idx"), "start_time", "end_time", F.col("label").cast("string").alias("label"), F.explode(F.sequence(F.lit(0), F.lit(len(numbers) - 1))).alias("setting"))
    ref, est, ends = adjust_pair(wanted, segments, own_keys)
    ref, est = stored(ref, "grid_reference"), stored(est, "grid_estimate")
    hits = boundary_hits(ref, est, (0.5, 3.0), own_keys).groupBy(*own_keys).agg(*[F.max(F.when(F.col("window") == x, F.col("f"))).alias(name) for x, name in ((0.5, "f05"), (3.0, "f30"))])
    cells = stored(contingency(ref, est, ends, own_keys), "grid_cells")
    counts = segments.groupBy(*own_keys).agg(F.count("*").cast("double").alias("segments"))
    parts = [(pair_scores(cells, own_keys).select(*own_keys, "pairwise_f"), "left"), (entropy_scores(cells, own_keys).select(*own_keys, "nce_f"), "left"), (counts, "inner")]
    scores = reduce(lambda a, b: join_sequences(a, b[0], own_keys, b[1]), parts, hits).fillna(0.0, ["pairwise_f", "nce_f"])
    metrics = ["f05", "f30", "pairwise_f", "nce_f", "segments"]
    aggs = [f(m).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    means = scores.groupBy("setting").agg(F.count("*").alias("num_tracks"), *aggs)
    listed = spark.createDataFrame(table, "setting int, " + ", ".join(f"{k} {v}" for k, v in SETTING.items()))
    out = means.join(F.broadcast(listed), "setting").select(*SETTING, "num_tracks", *[f"{m}_{n}" for m in metrics for n in ("mean", "std")])
    return out.orderBy(F.desc_nulls_last(F.round("f30_mean", 12)), *SETTING)


def top_settings(results: DataFrame, k: int = 10) -> DataFrame:
    """D15."""
    return results.orderBy(F.desc_nulls_last(F.round("f30_mean", 12)), *SETTING).limit(k)

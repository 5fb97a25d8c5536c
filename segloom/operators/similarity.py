"""Similarity diagnostics within tracks, and embedding-quality metrics as aggregates.

Frames have (track_id, frame_idx, vec, target); scores are an array column. What needs every pair of a track's frames works on
tiles: blocks of frames as matrices, multiplied block by block in Arrow batches and reduced inside the tile, so that a pair is
a row only where ``pairs`` is asked for them. Means of pair similarities need no pairs at all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from segloom.functions.vectors import dot, logsumexp, norm, normalized, sigmoid, softmax
from segloom.operators.grid import IGNORE
from segloom.operators.policies import KEYS
from segloom.plans.sequences import window

#: Frames of a block: a tile has so many squared products.
TILE = 1024


def tiles(frames: DataFrame, keys: Sequence[str] = KEYS, vec: Column | str = "vec", carry: Sequence[str] = ("target",), size: int = TILE) -> DataFrame:
    """(track, a, b): each unordered pair of a track's blocks of ``size`` frame indices once, as structs of ``n``, ``flat`` (the
    vectors end to end), ``i`` (frame indices) and the carried columns; b is null for a block with itself.

    If no frame index reaches ``size``, every track is one tile and nothing is joined. Else a block goes to the tiles that it
    is part of, under their coordinates, so that the tiles of one long track spread over the cluster.
    """
    own = frames.select(*keys, F.floor(F.col("frame_idx") / size).alias("_block"), F.col("frame_idx").cast("long").alias("i"), *carry, (F.col(vec) if isinstance(vec, str) else vec).cast("array<double>").alias("_v"))
    listed = own.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list(F.struct("i", *carry, "_v"))).alias("_f"))
    part = lambda c: F.transform("_f", lambda f: f[c]).alias(c)
    packed = listed.select(*keys, "_block", F.struct(F.size("_f").alias("n"), F.flatten(F.transform("_f", lambda f: f["_v"])).alias("flat"), part("i"), *[part(c) for c in carry]).alias("a"))
    blank = F.lit(None).cast(packed.schema["a"].dataType).alias("b")
    alone = packed.select(*keys, "a", blank)
    last = frames.agg(F.max("frame_idx")).first()[0]
    if last is None or last < size:
        return alone
    counts = frames.groupBy(*keys).agg(F.floor(F.max("frame_idx") / size).alias("_last"))
    known = packed.alias("p").join(counts.alias("c"), [F.col(f"p.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]).select("p.*", "_last")
    first = known.where("_block < _last").select(*keys, F.col("_block").alias("_x"), F.explode(F.sequence(F.col("_block") + 1, "_last")).alias("_y"), "a")
    second = known.where("_block > 0").select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_block") - 1)).alias("_x"), F.col("_block").alias("_y"), F.col("a").alias("b"))
    met = first.alias("p").join(second.alias("c"), [F.col(f"p.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*keys, "_x", "_y")])
    return alone.unionByName(met.select(*[F.col(f"p.{k}") for k in keys], "a", "b"))


def _products(flat_a: pd.Series, n_a: pd.Series, flat_b: pd.Series, n_b: pd.Series) -> Iterator[tuple[np.ndarray, bool]]:
    """Of each tile the products of its vectors, and whether it is a block with itself."""
    for x, n, y, m in zip(flat_a, n_a.tolist(), flat_b, n_b.tolist(), strict=True):
        a = np.asarray(x, float).reshape(int(n), -1)
        yield a @ (a if y is None else np.asarray(y, float).reshape(int(m), -1)).T, y is None


def _agree(a: object, b: object) -> np.ndarray:
    """Whether the targets of two frames are there and equal."""
    x, y = np.asarray(a), np.asarray(a if b is None else b)
    return (x[:, None] == y[None, :]) & (x != IGNORE)[:, None] & (y != IGNORE)[None, :]


@F.pandas_udf(ArrayType(DoubleType()))
def _values(flat_a: pd.Series, n_a: pd.Series, flat_b: pd.Series, n_b: pd.Series) -> pd.Series:
    return pd.Series([p.ravel().tolist() for p, _ in _products(flat_a, n_a, flat_b, n_b)], dtype=object)


def pairs(frames: DataFrame, keys: Sequence[str] = KEYS, vec: str = "vec", cosine: bool = True, ordered: bool = False, carry: Sequence[str] = ("target",), size: int = TILE) -> DataFrame:
    """(track, i, j, value, same, and the carried columns of both) of different frames of a track: their cosine,
    or their plain product. ``ordered``: i < j only. ``same``: both targets are there and equal. A row for each pair."""
    t = tiles(frames, keys, normalized(vec) if cosine else vec, carry, size).withColumn("_p", _values("a.flat", "a.n", "b.flat", "b.n"))
    other = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}"))
    cell = t.select(*keys, "a", F.struct(*[other(c).alias(c) for c in ("n", "i", *carry)]).alias("o"), F.col("b").isNotNull().alias("_off"), F.posexplode("_p").alias("_at", "value"))
    x, y = F.expr("_at div o.n").cast("int"), F.expr("_at % o.n").cast("int")
    both = cell.select(*keys, "value", "_off", *[F.get(f"a.{c}", x).alias(f"{n}_i") for c, n in (("i", "_"), *((c, c) for c in carry))], *[F.get(f"o.{c}", y).alias(f"{n}_j") for c, n in (("i", "_"), *((c, c) for c in carry))])
    side = lambda a, b: F.struct(F.col(f"__{a}").alias("i"), F.col(f"__{b}").alias("j"), *[F.col(f"{c}_{a}").alias(f"{c}_i") for c in carry], *[F.col(f"{c}_{b}").alias(f"{c}_j") for c in carry])
    ways = F.array(side("i", "j")) if ordered else F.when(F.col("_off"), F.array(side("i", "j"), side("j", "i"))).otherwise(F.array(side("i", "j")))
    out = both.where("__i < __j" if ordered else "__i <> __j").select(*keys, "value", F.inline(ways)).select(*keys, "i", *[f"{c}_i" for c in carry], "j", *[f"{c}_j" for c in carry], "value")
    kind = dict(frames.dtypes)["frame_idx"]
    out = out.withColumns({"i": F.col("i").cast(kind), "j": F.col("j").cast(kind)})
    return out.withColumn("same", (F.col("target_i") != IGNORE) & (F.col("target_j") != IGNORE) & (F.col("target_i") == F.col("target_j"))) if "target" in carry else out


def similarity_means(frames: DataFrame, keys: Sequence[str] = KEYS, vec: str = "vec", cosine: bool = True) -> DataFrame:
    """Mean similarity of pairs with the same and with different targets; null where there are none.

    From sums, without pairs: the products of all pairs of a set add up to the square of the sum of its vectors less the sum
    of their squares. Components are added up by label before the shuffle, the squares and the counts as two more of them."""
    own = frames.where(F.col("target") != IGNORE).select(*keys, "target", (normalized(vec) if cosine else F.col(vec).cast("array<double>")).alias("_v"))
    entry = lambda k, x: F.struct(k.alias("_k"), x.alias("_x"))
    cells = F.concat(F.transform("_v", lambda x, k: entry(k, x)), F.array(entry(F.lit(-1), F.pow(norm("_v"), 2.0)), entry(F.lit(-2), F.lit(1.0))))
    by_label = own.select(*keys, "target", F.inline(cells)).groupBy(*keys, "target", "_k").agg(F.sum("_x").alias("_s"))
    sums = by_label.groupBy(*keys, "_k").agg(F.sum("_s").alias("all"), F.sum(F.col("_s") * F.col("_s")).alias("own"))
    one = lambda k, c: F.max(F.when(F.col("_k") == k, F.col(c)))
    total = sums.groupBy(*keys).agg(F.sum(F.when(F.col("_k") >= 0, F.col("all") * F.col("all"))).alias("t"), F.sum(F.when(F.col("_k") >= 0, F.col("own"))).alias("u"), one(-1, "all").alias("q"), one(-2, "all").alias("n"), one(-2, "own").alias("m"))
    share = lambda s, n: s / F.nullif(n, F.lit(0.0))
    return total.select(*keys, share(F.col("u") - F.col("q"), F.col("m") - F.col("n")).alias("same_label_mean"), share(F.col("t") - F.col("u"), F.col("n") * F.col("n") - F.col("m")).alias("different_label_mean"))


def score_margins(frames: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean score of the true label, and how far it is above the best wrong one."""
    own = F.element_at("scores", F.col("target") + 1)
    wrong = F.array_max(F.filter(F.transform("scores", lambda x, i: F.when(i != F.col("target"), x)), lambda x: x.isNotNull()))
    valid = frames.where(F.col("target") != IGNORE)
    return valid.groupBy(*keys).agg(F.avg(own.cast("double")).alias("gt_score_mean"), F.avg(own.cast("double") - wrong.cast("double")).alias("gt_margin_mean"))


def label_similarity(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and largest cosine of different labels' vectors."""
    one = labels.withColumn("_all", F.lit(1)).select(*by, "_all", F.col("label_idx").alias("frame_idx"), "vec")
    p = pairs(one, [*by, "_all"], carry=())
    return p.groupBy(*by).agg(F.avg("value").alias("offdiag_mean"), F.max("value").alias("offdiag_max"))


def boundary_flags(frames: DataFrame, keys: Sequence[str] = KEYS, order: str = "frame_idx") -> DataFrame:
    """Whether a boundary follows each frame: the next target differs; null where either is missing."""
    nxt = F.lead("target").over(window(keys, order))
    return frames.withColumn("boundary", F.when((F.col("target") != IGNORE) & (nxt != IGNORE), F.col("target") != nxt))


def change_at_boundaries(frames: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean of 1 less the cosine of neighbouring score vectors, at boundaries and elsewhere."""
    unit = boundary_flags(frames, keys).withColumn("_u", normalized("scores"))
    change = unit.withColumn("_c", 1 - dot(F.col("_u"), F.lead("_u").over(window(keys, "frame_idx"))))
    return change.groupBy(*keys).agg(F.avg(F.when(F.col("boundary"), F.col("_c"))).alias("change_at_boundary"), F.avg(F.when(~F.col("boundary"), F.col("_c"))).alias("change_elsewhere"))


def accuracies(frames: DataFrame, decoded: str = "decoded", keys: Sequence[str] = KEYS) -> DataFrame:
    """Share of frames whose best score, and whose decoded label, is the target."""
    from segloom.functions.vectors import argmax

    valid = frames.where(F.col("target") != IGNORE)
    return valid.groupBy(*keys).agg(F.avg((argmax("scores") == F.col("target")).cast("double")).alias("frame_accuracy"), F.avg((F.col(decoded) == F.col("target")).cast("double")).alias("decoded_frame_accuracy"))


def cross_entropy(frames: DataFrame) -> DataFrame:
    """M1: mean over all frames with a target; null without."""
    own = F.element_at("scores", F.col("target") + 1).cast("double")
    return frames.where(F.col("target") != IGNORE).agg(F.avg(logsumexp("scores") - own).alias("cross_entropy"))


def _pair_bce(t: DataFrame, cosine: bool, keys: Sequence[str], balance: bool, eps: float) -> DataFrame:
    @F.pandas_udf(StructType([StructField(c, DoubleType()) for c in ("sp", "sn", "np", "nn")]))
    def sums(flat_a: pd.Series, n_a: pd.Series, target_a: pd.Series, flat_b: pd.Series, n_b: pd.Series, target_b: pd.Series) -> pd.DataFrame:
        out = []
        for (p, own), x, y in zip(_products(flat_a, n_a, flat_b, n_b), target_a, target_b, strict=True):
            p = np.clip((p + 1) / 2 if cosine else p, eps, 1 - eps)
            same = _agree(x, y)
            used = np.triu(np.ones(p.shape, bool), 1) if own else np.ones(p.shape, bool)
            out.append((-np.log(p[used & same]).sum(), -np.log1p(-p[used & ~same]).sum(), float((used & same).sum()), float((used & ~same).sum())))
        return pd.DataFrame(out, columns=["sp", "sn", "np", "nn"])

    each = t.select(*keys, sums("a.flat", "a.n", "a.target", "b.flat", "b.n", "b.target").alias("_s")).select(*keys, "_s.*")
    s = each.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("sp", "sn", "np", "nn")]).where("np + nn > 0")
    plain = (F.col("sp") + F.col("sn")) / (F.col("np") + F.col("nn"))
    even = F.when((F.col("np") > 0) & (F.col("nn") > 0), (F.col("sp") / F.nullif("np", F.lit(0.0)) + F.col("sn") / F.nullif("nn", F.lit(0.0))) / 2).otherwise(plain)
    return s.select(*keys, (even if balance else plain).alias("loss"))


def probability_bce(frames: DataFrame, keys: Sequence[str] = KEYS, balance: bool = True, eps: float = 1e-6, size: int = TILE) -> DataFrame:
    """M2 by track: how well the product of label probabilities tells pairs with the same target. Average over tracks for the
    metric; tracks with one frame have no pairs and no row. Balanced, both classes weigh the same if both occur."""
    return _pair_bce(tiles(frames.where(F.col("target") != IGNORE), keys, softmax("scores"), size=size), False, keys, balance, eps)


def structure_bce(frames: DataFrame, keys: Sequence[str] = KEYS, balance: bool = True, eps: float = 1e-6, size: int = TILE) -> DataFrame:
    """M3 by track: as M2, with (cosine + 1) / 2 of the vectors."""
    return _pair_bce(tiles(frames.where(F.col("target") != IGNORE), keys, normalized("vec"), size=size), True, keys, balance, eps)


def relation_cross_entropy(pair_scores: DataFrame, frames: DataFrame, keys: Sequence[str] = KEYS, balance: bool = True) -> DataFrame:
    """M4 by track: cross-entropy of pair scores (track, i, j, scores of three) against 0 different, 1 same base label, 2 same
    segment. Balanced, each class weighs the same if all three occur. ``frames``: base_target and segment_target."""
    valid = frames.where((F.col("base_target") != IGNORE) & (F.col("segment_target") != IGNORE))
    left = valid.select(*keys, F.col("frame_idx").alias("i"), F.col("base_target").alias("_bi"), F.col("segment_target").alias("_si"))
    right = valid.select(*keys, F.col("frame_idx").alias("j"), F.col("base_target").alias("_bj"), F.col("segment_target").alias("_sj"))
    p = pair_scores.where("i <> j").join(left, [*keys, "i"]).join(right, [*keys, "j"])
    relation = F.when(F.col("_si") == F.col("_sj"), 2).when(F.col("_bi") == F.col("_bj"), 1).otherwise(0)
    cell = p.withColumn("relation", relation).withColumn("_l", logsumexp("scores") - F.element_at("scores", F.col("relation") + 1).cast("double"))
    by_class = cell.groupBy(*keys, "relation").agg(F.sum("_l").alias("s"), F.count("*").alias("n"))
    out = by_class.groupBy(*keys).agg(F.count("*").alias("k"), F.avg(F.col("s") / F.col("n")).alias("even"), (F.sum("s") / F.sum("n")).alias("plain"))
    return out.select(*keys, F.when(F.lit(balance) & (F.col("k") == 3), F.col("even")).otherwise(F.col("plain")).alias("loss"))


def boundary_dice(frames: DataFrame, keys: Sequence[str] = KEYS, logit: str = "boundary_logit", target: str = "segment_target", eps: float = 1e-8) -> DataFrame:
    """M5 by track: 1 less the Dice overlap of boundary probabilities and boundaries between neighbouring frames."""
    nxt = F.lead(target).over(window(keys, "frame_idx"))
    c = frames.withColumn("_next", nxt).where((F.col(target) != IGNORE) & (F.col("_next") != IGNORE))
    p, y = sigmoid(F.col(logit)), (F.col(target) != F.col("_next")).cast("double")
    return c.groupBy(*keys).agg((1 - 2 * F.sum(p * y) / F.greatest(F.sum(p * p) + F.sum(y * y), F.lit(eps))).alias("loss"))


def matching_mse(frames: DataFrame, keys: Sequence[str] = KEYS, positive: float = 1.0, negative: float = 0.0, balance: bool = True) -> DataFrame:
    """M6 by track: squared error of the scores against one-hot targets; balanced, wrong labels weigh 1 / (labels - 1)."""
    valid = frames.where(F.col("target") != IGNORE)
    k = F.size("scores")
    weight = lambda i: F.when(F.lit(not balance) | (i == F.col("target")), 1.0).otherwise(1.0 / F.greatest(k - 1, F.lit(1)))
    error = lambda x, i: F.pow(x.cast("double") - F.when(i == F.col("target"), positive).otherwise(negative), 2.0) * weight(i)
    return valid.groupBy(*keys).agg((F.sum(F.aggregate(F.transform("scores", error), F.lit(0.0), lambda s, x: s + x)) / F.sum(k)).alias("loss"))


def uniformity(frames: DataFrame, keys: Sequence[str] = KEYS, alpha: float = 2.0, size: int = TILE) -> DataFrame:
    """M7 by track: log of the mean of exp(-alpha * squared distance) over pairs of unit vectors."""
    if alpha <= 0:
        raise ValueError("alpha must be positive")

    @F.pandas_udf(StructType([StructField("s", DoubleType()), StructField("n", LongType())]))
    def sums(flat_a: pd.Series, n_a: pd.Series, flat_b: pd.Series, n_b: pd.Series) -> pd.DataFrame:
        out = []
        for p, own in _products(flat_a, n_a, flat_b, n_b):
            p = p[np.triu_indices(len(p), 1)] if own else p.ravel()
            out.append((float(np.exp(-alpha * (2 - 2 * p)).sum()), p.size))
        return pd.DataFrame(out, columns=["s", "n"])

    t = tiles(frames, keys, normalized("vec"), (), size)
    each = t.select(*keys, sums("a.flat", "a.n", "b.flat", "b.n").alias("_s")).groupBy(*keys).agg(F.sum("_s.s").alias("s"), F.sum("_s.n").alias("n")).where("n > 0")
    return each.select(*keys, F.log(F.greatest(F.col("s") / F.col("n"), F.lit(1e-12))).alias("loss"))


def label_to_frame_infonce(frames: DataFrame, labels: DataFrame, keys: Sequence[str] = KEYS, temperature: float = 0.07, label_keys: Sequence[str] = ()) -> DataFrame:
    """M8 by track and present label: log-sum-exp of the label's scores over all frames less that over its own frames."""
    valid = frames.where(F.col("target") != IGNORE).withColumn("_v", normalized("vec"))
    named = labels.select(*label_keys, F.col("label_idx").alias("label"), normalized("vec").alias("_t"))
    present = valid.select(*keys, F.col("target").alias("label")).distinct()
    both = valid.join(present, list(keys)).join(named, [*label_keys, "label"])
    s = both.withColumn("_s", dot("_v", "_t") / temperature)
    top = F.max("_s").over(Window.partitionBy(*keys, "label"))
    e = s.withColumn("_e", F.exp(F.col("_s") - top))
    return e.groupBy(*keys, "label").agg((F.log(F.sum("_e")) - F.log(F.sum(F.when(F.col("target") == F.col("label"), F.col("_e"))))).alias("loss"))


def supervised_contrastive(frames: DataFrame, keys: Sequence[str] = KEYS, temperature: float = 0.07, size: int = TILE) -> DataFrame:
    """M9 by track: mean over frames that share their target with another of log-sum-exp over all others less that over those.
    Exponents are taken from 1 / temperature, which no cosine exceeds, so the sums of tiles add up."""

    @F.pandas_udf(ArrayType(StructType([StructField("i", LongType()), StructField("all", DoubleType()), StructField("own", DoubleType())])))
    def sums(flat_a: pd.Series, n_a: pd.Series, i_a: pd.Series, target_a: pd.Series, flat_b: pd.Series, n_b: pd.Series, i_b: pd.Series, target_b: pd.Series) -> pd.Series:
        out = []
        for (p, alone), i, j, x, y in zip(_products(flat_a, n_a, flat_b, n_b), i_a, i_b, target_a, target_b, strict=True):
            e = np.exp((p - 1) / temperature)
            if alone:
                np.fill_diagonal(e, 0)
            own = np.where(_agree(x, y), e, 0)
            rows = list(zip(np.asarray(i).tolist(), e.sum(1).tolist(), own.sum(1).tolist(), strict=True))
            if not alone:
                rows += zip(np.asarray(j).tolist(), e.sum(0).tolist(), own.sum(0).tolist(), strict=True)
            out.append([dict(zip(("i", "all", "own"), r, strict=True)) for r in rows])
        return pd.Series(out, dtype=object)

    t = tiles(frames.where(F.col("target") != IGNORE), keys, normalized("vec"), size=size)
    each = t.select(*keys, F.inline(sums("a.flat", "a.n", "a.i", "a.target", "b.flat", "b.n", "b.i", "b.target"))).groupBy(*keys, "i").agg(F.sum("all").alias("_all"), F.sum("own").alias("_own"))
    return each.where("_own > 0").groupBy(*keys).agg(F.avg(F.log("_all") - F.log("_own")).alias("loss"))


def weighted_total(row: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The weighted sum of the columns with a weight other than 0."""
    used = {c: w for c, w in weights.items() if w}
    if not used:
        raise ValueError("no component has a weight")
    return row.withColumn("total", sum((F.lit(float(w)) * F.col(c) for c, w in used.items()), F.lit(0.0)))

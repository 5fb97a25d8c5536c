"""Relabelling policies on ordered sections.

A sections table has the key columns, ``idx`` (the order), ``start_time``, ``end_time``, ``label`` and ``confidence``; other
columns go along where rows are kept and are dropped where rows merge. List order, not time, makes neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segloom.functions.labels import canonical_underscore, draw_key, label_base
from segloom.plans.sequences import differs, islands, overlap_sweep, window

KEYS = ("track_id",)
#: The policies, those that need function annotations, and those that stand for a choice of others.
POLICIES = ("keep", "merge", "base_labels", "enumerate_all_occurrences", "enumerate_base_occurrences", "enumerate_consecutive_repeats", "salami_function_merge", "salami_function_occurrences", "salami_function_projected_lower")
FUNCTION_POLICIES = ("salami_function_merge", "salami_function_occurrences", "salami_function_projected_lower")
RANDOM_POLICIES = ("random", "sample")


@dataclass(frozen=True)
class Policy:
    """A policy and its options. ``replace_no_function`` and ``skip_labels`` default by policy when None."""

    name: str = "keep"
    separator: str = " "
    start_index: int = 1
    replace_no_function: bool | None = None
    no_function_label: str = "no_function"
    no_function_skip: tuple[str, ...] = ()
    function_namespace: str = "segment_salami_function"
    lower_namespace: str = "segment_salami_lower"
    label_format: str = "{function} subsegment {lower}"
    preserve: tuple[str, ...] = ("silence",)
    function_policy: str = "salami_function_merge"
    merge_projected: bool = True
    skip_labels: tuple[str, ...] | None = None
    selection: str = "first"

    def __post_init__(self) -> None:
        for what, value, known in (("policy", self.name, POLICIES), ("selection", self.selection, ("first", "richest_function")), ("function policy", self.function_policy, FUNCTION_POLICIES[:2])):
            if value not in known:
                raise ValueError(f"unknown {what} {value!r}; there are {', '.join(known)}")
        if self.start_index < 0:
            raise ValueError("start_index must not be negative")

    @property
    def replaces(self) -> bool:
        return self.name in FUNCTION_POLICIES if self.replace_no_function is None else self.replace_no_function

    @property
    def skips(self) -> tuple[str, ...]:
        if self.skip_labels is not None:
            return self.skip_labels
        return ("silence",) if self.name == "salami_function_occurrences" else ()

    def namespace(self, other: str) -> str:
        """The namespace that the policy reads where ``other`` is asked for."""
        return self.function_namespace if self.name in FUNCTION_POLICIES else other


@dataclass(frozen=True)
class RandomPolicy:
    """A choice among policies. Choices without own options take the parent's."""

    choices: tuple[Policy, ...]
    validation: Policy | None = None
    seed: int = 0

    @staticmethod
    def of(names: Sequence[str | Policy], validation: str | Policy | None = None, seed: int = 0, **options: object) -> RandomPolicy:
        if not names:
            raise ValueError("a random policy needs choices")
        make = lambda x: x if isinstance(x, Policy) else _concrete(x, options)
        return RandomPolicy(tuple(make(x) for x in names), None if validation is None else make(validation), seed)

    def for_validation(self) -> Policy:
        """The given one, else occurrences of base labels if among the choices, else the first."""
        return self.validation or next((c for c in self.choices if c.name == "enumerate_base_occurrences"), self.choices[0])


def _concrete(name: str, options: dict) -> Policy:
    if name in RANDOM_POLICIES:
        raise ValueError("random policies can't be nested")
    return Policy(name, **options)


def merge_consecutive(sections: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Neighbours of one label become one: the first start, the last row's end. Confidences fold from left to right as
    half of the sum so far and the next, nulls left out; written out, the n-th of n weighs 1/2, the one before 1/4, and the
    first as much as the second."""
    runs = islands(sections, keys, "idx", differs("label", keys, "idx"))
    run = Window.partitionBy(*keys, "island")
    n, r = F.count("confidence").over(run), F.count("confidence").over(run.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    weighed = runs.withColumn("_part", F.col("confidence") * F.pow(F.lit(2.0), -(n - F.greatest(r, F.lit(2)) + 1).cast("double")))
    merged = weighed.groupBy(*keys, "island").agg(F.min("idx").alias("idx"), F.min_by("start_time", "idx").alias("start_time"), F.max_by("end_time", "idx").alias("end_time"), F.first("label").alias("label"), F.sum("_part").alias("confidence"))
    return merged.drop("island")


def base_labels(sections: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """P2."""
    return merge_consecutive(sections.withColumn("label", label_base("label")), keys)


def repeated_flag(col: str, keys: Sequence[str] = KEYS) -> F.Column:
    """Whether the value occurs more than once in its sequence."""
    return F.count(F.lit(1)).over(Window.partitionBy(*keys, col)) > 1


def enumerate_all(sections: DataFrame, keys: Sequence[str] = KEYS, start: int = 1, separator: str = " ") -> DataFrame:
    """P3 on P4: labels that occur more than once are numbered in order."""
    return _numbered(sections.withColumn("_pick", repeated_flag("label", keys)), "label", keys, start, separator)


def enumerate_consecutive(sections: DataFrame, keys: Sequence[str] = KEYS, start: int = 1, separator: str = " ") -> DataFrame:
    """P3 on P5: all occurrences of labels that somewhere follow themselves are numbered."""
    again = sections.withColumn("_again", F.coalesce(~differs("label", keys, "idx"), F.lit(False)))
    return _numbered(again.withColumn("_pick", F.max("_again").over(Window.partitionBy(*keys, "label"))).drop("_again"), "label", keys, start, separator)


def enumerate_bases(sections: DataFrame, keys: Sequence[str] = KEYS, start: int = 1, separator: str = " ", skip: Sequence[str] = ()) -> DataFrame:
    """Base labels that occur more than once, but for the bases of ``skip``, become base and number; others stay raw."""
    based = sections.withColumn("_base", label_base("label"))
    pick = repeated_flag("_base", keys)
    if skip:
        pick = pick & reduce(lambda a, b: a & b, [F.col("_base") != label_base(F.lit(s)) for s in skip])
    return _numbered(based.withColumn("_pick", pick), "_base", keys, start, separator).drop("_base")


def _numbered(df: DataFrame, name: str, keys: Sequence[str], start: int, separator: str) -> DataFrame:
    if start < 0:
        raise ValueError("start_index must not be negative")
    at = F.row_number().over(window([*keys, name], "idx")) + (start - 1)
    return df.withColumn("label", F.when(F.col("_pick"), F.concat(F.col(name), F.lit(separator), at.cast("string"))).otherwise(F.col("label"))).drop("_pick")


def replace_no_function(sections: DataFrame, keys: Sequence[str] = KEYS, label: str = "no_function", skip: Sequence[str] = ()) -> DataFrame:
    """Placeholders take the last usable label before them, else the first after; labels of ``skip`` are not carried."""
    w = window(keys, "idx")
    canonical = canonical_underscore("label")
    marked = sections.withColumn("_hole", canonical == canonical_underscore(F.lit(label)))
    usable = ~F.col("_hole")
    for s in skip:
        usable = usable & (canonical != canonical_underscore(F.lit(s)))
    marked = marked.withColumn("_use", F.when(usable, F.col("label")))
    before = F.last("_use", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_use", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return marked.withColumn("label", F.when(F.col("_hole"), F.coalesce(before, after, F.col("label"))).otherwise(F.col("label"))).drop("_hole", "_use")


def project_lower(function: DataFrame, lower: DataFrame, keys: Sequence[str] = KEYS, label_format: str = "{function} subsegment {lower}", preserve: Sequence[str] = ("silence",), merge: bool = True) -> DataFrame:
    """Each lower section is named after the function section that it shares most time with (the earlier on ties). One sweep
    over both tables; ``idx`` tells a track's sections apart."""
    import string

    met = overlap_sweep(lower, function.select(*keys, "idx", "start_time", "end_time", "label"), keys, how="left")
    shared = F.when(F.col("overlap").isNotNull(), F.struct("overlap", -F.col("r_idx")))
    best = met.groupBy(*keys, "idx").agg(*[F.first(c).alias(c) for c in lower.columns if c not in (*keys, "idx")], F.max_by("r_label", shared).alias("r_label"))
    fields = {"function": F.col("r_label"), "function_base": label_base("r_label"), "lower": F.col("label"), "lower_base": label_base("label")}
    parts = []
    for literal, name, _, _ in string.Formatter().parse(label_format):
        parts += [F.lit(literal)] * bool(literal) + ([fields[name]] if name is not None else [])
    keep = reduce(lambda a, b: a | b, [canonical_underscore("r_label") == canonical_underscore(F.lit(p)) for p in preserve], F.lit(False))
    named = best.withColumn("label", F.when(F.col("r_label").isNull(), F.col("label")).when(keep, F.lower("r_label")).otherwise(F.concat(*parts)))
    out = named.select(*lower.columns)
    return merge_consecutive(out, keys) if merge else out


def apply_policy(sections: DataFrame, policy: Policy | str = "keep", keys: Sequence[str] = KEYS, lower: DataFrame | None = None) -> DataFrame:
    """The sections under a policy. The projected policy also needs the ``lower`` sections; its function sections are
    processed with no labels left out of the numbering unless some are given, as the defaults of its own name are empty."""
    p = Policy(policy) if isinstance(policy, str) else policy
    if p.name == "salami_function_projected_lower":
        if lower is None:
            raise ValueError("the projected policy needs the lower sections")
        function = apply_policy(sections, replace(p, name=p.function_policy, skip_labels=p.skips, replace_no_function=p.replaces), keys)
        return project_lower(function, lower, keys, p.label_format, p.preserve, p.merge_projected)
    if p.replaces:
        sections = replace_no_function(sections, keys, p.no_function_label, p.no_function_skip)
    steps: dict[str, Callable[[], DataFrame]] = {
        "keep": lambda: sections,
        "merge": lambda: merge_consecutive(sections, keys),
        "base_labels": lambda: base_labels(sections, keys),
        "enumerate_all_occurrences": lambda: enumerate_all(sections, keys, p.start_index, p.separator),
        "enumerate_base_occurrences": lambda: enumerate_bases(sections, keys, p.start_index, p.separator),
        "enumerate_consecutive_repeats": lambda: enumerate_consecutive(sections, keys, p.start_index, p.separator),
        "salami_function_merge": lambda: merge_consecutive(sections, keys),
        "salami_function_occurrences": lambda: enumerate_bases(merge_consecutive(sections, keys), keys, p.start_index, p.separator, p.skips),
    }
    return steps[p.name]()


def expand_policies(sections: DataFrame, choices: Sequence[Policy], keys: Sequence[str] = KEYS, lower: DataFrame | None = None) -> DataFrame:
    """The sections under each policy, with the columns ``policy`` and ``choice`` (its place)."""
    columns = [*keys, "idx", "start_time", "end_time", "label", "confidence"]
    parts = [apply_policy(sections, p, keys, lower).select(*columns, F.lit(p.name).alias("policy"), F.lit(i).alias("choice")) for i, p in enumerate(choices)]
    return reduce(DataFrame.unionByName, parts)


def sample_policy(tracks: DataFrame, n: int, seed: int = 0, epoch: int = 0, index: str = "track_ord", track: str = "track_id") -> DataFrame:
    """Adds ``choice``, one of n, that depends on seed, epoch, index and track alone."""
    return tracks.withColumn("choice", (draw_key(F.lit(seed), F.lit(epoch), F.col(index).cast("long"), F.col(track)) % n).cast("int"))


def select_annotation(annotations: DataFrame, keys: Sequence[str] = KEYS, selection: str = "first", ignore: Sequence[str] = ("silence", "no function")) -> DataFrame:
    """P10: of each track the annotation to use, ``annotation_idx``: the first, or the richest: most useful labels, then most
    labels, most merged sections, fewest raw sections, lowest index. ``annotations`` holds the sections of all, with their
    placeholders replaced already if the policy replaces them."""
    if selection == "first":
        return annotations.groupBy(*keys).agg(F.min("annotation_idx").alias("annotation_idx"))
    from segloom.functions.labels import canonical_space

    every = [*keys, "annotation_idx"]
    useful = reduce(lambda a, b: a & b, [canonical_space("label") != x for x in ignore])
    merged = F.coalesce(differs("label", every, "idx"), F.lit(True))
    stats = annotations.withColumn("_new", merged.cast("int")).groupBy(*every).agg(F.count_distinct(F.when(useful, F.col("label"))).alias("useful"), F.count_distinct("label").alias("labels"), F.sum("_new").alias("merged"), F.count("*").alias("raw"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("useful"), F.desc("labels"), F.desc("merged"), "raw", "annotation_idx"))
    return stats.withColumn("_rank", rank).where("_rank = 1").select(*every)


def lower_annotation(selected: DataFrame, lower: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """P10: the lower annotation that goes with a selected function annotation: the same place, or the last one."""
    count = lower.groupBy(*keys).agg((F.max("annotation_idx")).alias("_last"))
    return selected.join(count, list(keys)).select(*keys, F.least("annotation_idx", "_last").alias("annotation_idx"))


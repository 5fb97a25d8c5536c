"""Plan shapes that the operators share. Every window and join carries the sequence's key, so all sequences run in parallel
and consecutive steps on one key share an exchange."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that a task gets where a table is dealt by sequence.
TASK_ROWS = 100_000


def dealt(df: DataFrame, keys: Sequence[str], each: int = TASK_ROWS) -> DataFrame:
    """``df`` by sequence in as many tasks as its number of rows asks for: windows and joins of a sequence keep that partitioning,
    so what a task sorts doesn't grow with the table."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // each))
    return df.repartition(tasks, *keys)


def window(keys: Sequence[str], *order: str | Column) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def join_sequences(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on the sequence's key that is never broadcast. Both sides have rows for every sequence, and Spark takes one that
    was stored for as small as its files, which run lengths make many times smaller than its rows: broadcast, it would go
    through the driver whole."""
    return left.join(right.hint("merge"), list(keys), how)


def islands(df: DataFrame, keys: Sequence[str], order: str, changed: Column, name: str = "island") -> DataFrame:
    """Adds the number of the run that each row is in: 0 for the first, one more wherever ``changed`` holds (null: holds)."""
    w = window(keys, order)
    flagged = df.withColumn("_changed", F.coalesce(changed.cast("int"), F.lit(1)))
    return flagged.withColumn(name, F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.first("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


def differs(col: str, keys: Sequence[str], order: str) -> Column:
    """Whether a value differs from the row before (null-safe); null in the first row."""
    w = window(keys, order)
    return F.when(F.row_number().over(w) > 1, ~F.col(col).eqNullSafe(F.lag(col).over(w)))


def overlap_sweep(left: DataFrame, right: DataFrame, keys: Sequence[str], start: str = "start_time", end: str = "end_time", how: str = "inner") -> DataFrame:
    """Pairs of rows of one key (null included) whose intervals share some time, with ``overlap`` in seconds; the right columns
    get the prefix r_. ``how="left"`` also gives each left row once without a partner, whether it has partners or not.

    An event sweep, without a join: both sides' starts go through one sort, each event carries the interval of either side that
    is open there, and two open ones overlap from the event to the earlier of their ends, which the next start cuts. So the
    work is linear after the sort, in one exchange. Intervals of one side that overlap each other travel as one event, and only
    its members are tested against those that they meet. Intervals without a length, or with a null end, have no partners.
    """
    sides = []
    for n, (df, other) in enumerate(((left, right), (right, left))):
        w = window(keys, start, end)
        reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
        runs = df.withColumn("_new", F.when(F.col(start) < reach, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        events = runs.groupBy(*keys, "_run").agg(F.min(start).alias("_t"), F.max(end).alias("_end"), F.collect_list(F.struct(*df.columns)).alias("_rows"))
        own = F.struct("_end", "_rows").alias(f"_{n}")
        blank = F.lit(None).cast(other.select(F.struct(F.col(end).alias("_end"), F.array(F.struct(*other.columns)).alias("_rows")).alias("s")).schema[0].dataType).alias(f"_{1 - n}")
        sides.append(events.select(*keys, "_t", "_end", F.lit(n).alias("_side"), own, blank))
    upto = window(keys, "_t", "_end", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = sides[0].unionByName(sides[1]).withColumns({"_l": F.last("_0", True).over(upto), "_r": F.last("_1", True).over(upto)})
    # the runs of one side don't overlap, so two of them are open together at one event only: where the later one begins
    open_ = (F.col("_l._end") > F.col("_t")) & (F.col("_r._end") > F.col("_t"))
    times = [F.col(f"{side}.{c}") for side in "lr" for c in (start, end)]
    overlap = F.when(~reduce(Column.__or__, [t.isNull() for t in times]), F.least(times[1], times[3]) - F.greatest(times[0], times[2]))
    if how == "inner":
        pairs = both.where(open_).select(F.explode("_l._rows").alias("l"), F.col("_r._rows").alias("_rows")).select("l", F.explode("_rows").alias("r"))
    else:
        none = F.array().cast(f"array<struct<l:{left.schema.simpleString()},r:{right.schema.simpleString()}>>")
        alone = F.when(F.col("_side") == 0, F.transform("_0._rows", lambda l: F.struct(l.alias("l"), F.lit(None).cast(right.schema).alias("r"))))
        met = F.when(open_, F.flatten(F.transform("_l._rows", lambda l: F.transform("_r._rows", lambda r: F.struct(l.alias("l"), r.alias("r"))))))
        pairs = both.where((F.col("_side") == 0) | open_).select(F.inline(F.concat(F.coalesce(alone, none), F.coalesce(met, none))))
    out = pairs.withColumn("overlap", overlap).where("overlap > 0" if how == "inner" else "overlap > 0 OR r IS NULL")
    return out.select("l.*", *[F.col(f"r.{c}").alias(f"r_{c}") for c in right.columns], "overlap")


def asof(points: DataFrame, lookup: DataFrame, keys: Sequence[str], at: str, since: str, value: Sequence[str]) -> DataFrame:
    """Of each point the lookup row with the greatest ``since`` <= ``at`` of its key, as the struct ``hit`` of ``value``
    (null: none). One exchange and one sort of both together, no pair is formed."""
    p = points.select("*", F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(lookup.select(F.struct(*value).alias("h")).schema[0].dataType).alias("_hit"))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in points.schema if f.name not in keys]
    s = lookup.select(*[F.col(k) for k in keys], *blank, F.col(since).alias("_t"), F.lit(0).alias("_side"), F.struct(*value).alias("_hit"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return p.unionByName(s).withColumn("hit", F.last("_hit", ignorenulls=True).over(w)).where("_side = 1").drop("_t", "_side", "_hit")


def nearest(queries: DataFrame, reference: DataFrame, keys: Sequence[str], time: str = "time") -> DataFrame:
    """Adds to each query time of a key the reference times before (``before``, at most it) and after (``after``), null if
    there is none, and ``distance``, the smaller gap. Linear in both tables after the sort."""
    q = queries.select("*", F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_r"))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in queries.schema if f.name not in (*keys, time)]
    r = reference.select(*[F.col(k) for k in keys], F.col(time), *blank, F.lit(0).alias("_side"), F.col(time).alias("_r"))
    w = Window.partitionBy(*keys).orderBy(time, "_side")
    both = q.unionByName(r).withColumns({"before": F.last("_r", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "after": F.first("_r", True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    gap = F.least(F.col(time) - F.col("before"), F.col("after") - F.col(time))
    return both.where("_side = 1").drop("_side", "_r").withColumn("distance", gap)

"""Helpers that several corpus operators share: tables in the shared folder, bounded broadcasts, components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.plans.scratch import scratch_path, stored

#: The white space of the text contracts: space and the controls 0x09 to 0x0D.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: A table of at most so many narrow rows may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: A key of more rows than this is hot: there are few such keys, and their rows are not brought together.
HOT_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only_ids(df: DataFrame, ids: DataFrame, id_col: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose id is in ``ids`` (a stored one-column table): the ids are broadcast if at most ``most``, else shuffled."""
    return df.join(F.broadcast(ids) if ids.count() <= most else ids, id_col, "left_semi")


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str], salt: str, most: int = BROADCAST_ROWS, hot: int = HOT_ROWS) -> DataFrame:
    """``rows`` left-joined with ``keys``, a stored table of different keys and ``n``, how many of the rows each has.

    At most ``most`` keys are broadcast. Of more, the keys of over ``hot`` rows are (rows / ``hot`` at most) and their rows
    stay where they are; in the shuffle for the other keys they are spread by a hash of the column ``salt``.
    """
    if keys.count() <= most:
        return rows.join(F.broadcast(keys), on, "left")
    given = [c for c in keys.columns if c not in on]
    first = rows.join(F.broadcast(keys.where(F.col("n") > hot).withColumnsRenamed({c: f"_hot_{c}" for c in given})), on, "left")
    first = first.withColumn("_salt", F.when(F.col("_hot_n").isNotNull(), 1 + F.pmod(F.xxhash64(salt), F.lit(1 << 16))).otherwise(F.lit(0).cast("long")))
    both = first.join(keys.where(F.col("n") <= hot).withColumn("_salt", F.lit(0).cast("long")), [*on, "_salt"], "left")
    return both.select(*rows.columns, *[F.coalesce(f"_hot_{c}", c).alias(c) for c in given])


def as_text(col: str) -> F.Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars around the smallest node of what one partition's edges connect."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[y]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    pairs = [(x, r) for x in up if (r := root(x)) != x]
    for at in range(0, len(pairs), 100_000):
        part = pairs[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], names=["a", "b"])


def connected_components(edges: DataFrame, each: int = 200_000) -> DataFrame:
    """Smallest reachable node of each node of the stored table ``edges`` (a, b of longs): rows (node, component).

    Partitions of about ``each`` edges are contracted to stars on their own. If there are several, large-star and small-star
    steps follow (each node's neighbours are linked to the smallest of them) until all edges are stars: each round is a few
    pre-aggregated minima and joins, written to the shared folder, and the driver sees two numbers. Nodes without edges are
    absent.
    """
    parts = 1 + edges.count() // each
    edges = stored(edges.where("a <> b").coalesce(parts).mapInArrow(_contract, "a long, b long"), "edges")
    total = None
    while parts > 1:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("m < a").select("a", "m")).where("a <> b").distinct()
        large = stored(large, "large_star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        edges = stored(small, "small_star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == total:
            break
        total = tuple(now)
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)

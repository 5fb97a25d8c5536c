"""Shards cut from a Hilbert curve over several metadata dimensions, so that files can be pruned on each of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segloom.llm.common import as_text, stored

#: Bits of each quantised dimension: 3 dimensions of 4 bits make 4,096 cells.
BITS = 4
#: Parts of the curve whose rows one task ranks: about so many in all, and at most so many rows in each.
PARTS, PART_ROWS = 4096, 100_000


def _ones_below(i: int) -> int:
    return (~i & (i + 1)).bit_length() - 1


def hilbert_index(coords: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of integer coordinates of ``bits`` bits each, after Hamilton's compact formulation:
    one octant (cell of the current cube) is read per level, from the high bits down, while the entry corner and the
    direction of the curve within the cube are carried along."""
    n = len(coords)
    names = [f"c{j}" for j in range(n)]  # carried in the state, so that each is computed once
    full = (1 << n) - 1
    rank = [0] * (1 << n)  # rank of a corner in Gray-code order
    for i in range(1 << n):
        rank[i ^ (i >> 1)] = i
    entry = [0] + [(lambda v: v ^ (v >> 1))(2 * ((w - 1) // 2)) for w in range(1, 1 << n)]
    turn = [0] + [(_ones_below(w - 1) if w % 2 == 0 else _ones_below(w)) % n for w in range(1, 1 << n)]
    lookup = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at)
    shift = lambda x, by: F.call_function("shiftleft", x, by)
    right = lambda x, by: F.call_function("shiftright", x, by)
    left_turn = lambda x, by: shift(x, by % n).bitwiseOR(right(x, (F.lit(n) - by) % n)).bitwiseAND(F.lit(full))
    right_turn = lambda x, by: right(x, by % n).bitwiseOR(shift(x, (F.lit(n) - by) % n)).bitwiseAND(F.lit(full))

    def step(state: Column, level: Column) -> Column:
        corner = F.lit(0)
        for j, x in enumerate(names):
            corner = corner.bitwiseOR(F.shiftleft(right(state[x], level).bitwiseAND(F.lit(1)), j))
        w = lookup(rank, right_turn(corner.bitwiseXOR(state["e"]), state["d"] + 1))
        return F.struct(
            F.shiftleft(state["h"], n).bitwiseOR(w.cast("long")).alias("h"),
            state["e"].bitwiseXOR(left_turn(lookup(entry, w), state["d"] + 1)).alias("e"),
            ((state["d"] + lookup(turn, w) + 1) % n).alias("d"),
            *[state[x].alias(x) for x in names],
        )

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"), *[c.cast("int").alias(x) for c, x in zip(coords, names, strict=True)])
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda s: s["h"])


def _ordered_text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_cuts(docs: DataFrame, name: str, pieces: int = 1 << BITS) -> list[str]:
    """The strings, compared whole, that cut the rows into ``pieces`` of near equal counts: for each i of 1 to pieces - 1 the
    first value with at least i / pieces of all rows up to it. Different values are counted, their counts are added up in
    string order, range by range, and at most pieces - 1 values come to the driver."""
    counts = stored(docs.groupBy(_ordered_text(name).alias("value")).agg(F.count("*").alias("n")), "values")
    different, total = counts.agg(F.count("*"), F.sum("n")).first()
    if not different:
        return []
    ranged = stored(counts.repartitionByRange(1 + different // PART_ROWS, "value").withColumn("part", F.spark_partition_id()), "ranged")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_from"))
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) + F.col("part_from")
    sums = ranged.join(F.broadcast(parts), "part").withColumn("upto", upto)
    crosses = F.expr(f"least(upto * {pieces} div {total}, {pieces - 1}) > (upto - n) * {pieces} div {total}")
    return sorted((r.value for r in sums.where(crosses).select("value").collect()), key=str.encode)


def _code(value: Column, cuts: list) -> Column:
    """How many of the cuts lie below the value, which is computed once."""
    return F.transform(F.array(value), lambda x: sum((F.when(x > cut, 1).otherwise(0) for cut in cuts), F.lit(0)))[0]


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", text_dims: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """``docs`` with size (UTF-8 bytes of the text and 16), text_crc32, curve, law ('rows'), shard, slot and grown_shard (null).

    The dimensions are the size and the string order of ``text_dims``; each is quantised into 2^BITS codes, the size at its
    approximate quantiles, strings at those of whole values. Rows are ordered by curve index, then by the part of the cell that
    the checksums of id and text give, then by text checksum and id, and the order is cut into ``shards`` runs whose counts
    differ by one at most; slots count from 0 in each. Ranks come from counts: parts are of bounded size and ranked apart, so
    no task sorts a hot cell. Between cells only 4,096 counts are added up; the driver sees the quantiles and one count.

    Null texts count as empty, null dimensions sort first. Equal rows tie, in any order. An empty table gives no rows.
    Columns of ``docs`` that clash with the new names are replaced; ``docs`` must be the same when read again.
    """
    text = as_text(text_col)
    measured = docs.withColumns({"size": (F.octet_length(text) + 16).cast("long"), "text_crc32": F.crc32(F.encode(text, "utf-8"))})
    marks = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    sizes = measured.agg(F.percentile_approx("size", marks, 10_000)).first()[0]
    codes = [_code(F.col("size"), sorted(set(sizes or []))), *[_code(_ordered_text(c), text_cuts(docs, c)) for c in text_dims]]
    placed = measured.withColumn("curve", hilbert_index(codes))
    taken = {c.lower() for c in placed.columns}
    at, part, cell_from, cell_parts, part_from = (next(x for k in range(len(taken) + 1) if (x := "_" * k + name) not in taken) for name in ("at", "part", "cell_from", "cell_parts", "part_from"))
    everything = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy("curve").agg(F.count("*").alias("n"))
    cells = stored(cells.withColumn(cell_from, F.coalesce(F.sum("n").over(everything), F.lit(0))), "cells")
    total = cells.agg(F.sum("n")).first()[0] or 0
    part_rows = max(1, min(PART_ROWS, total // PARTS))
    cells = cells.select("curve", cell_from, F.ceil(F.col("n") / part_rows).alias(cell_parts))
    dealt = placed.join(F.broadcast(cells), "curve").withColumn(part, (F.coalesce(F.crc32(F.col(id_col).cast("string")), F.lit(0)) + F.col("text_crc32")) % F.col(cell_parts))
    earlier = Window.partitionBy("curve").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("curve", part).agg(F.count("*").alias("n")).select("curve", part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(part_from))
    within = Window.partitionBy("curve", part).orderBy("text_crc32", id_col)
    ranked = dealt.withColumn(at, F.row_number().over(within) - 1).join(parts, ["curve", part])
    ranked = ranked.withColumn(at, F.col(at) + F.col(cell_from) + F.col(part_from))
    ranked = ranked.withColumn("shard", F.expr(f"`{at}` * {shards} div {max(total, 1)}L").cast("int"))
    slot = F.col(at) - F.expr(f"(shard * {max(total, 1)}L + {shards - 1}) div {shards}")
    return ranked.withColumns({"law": F.lit("rows"), "slot": slot.cast("long"), "grown_shard": F.lit(None).cast("int")}).drop(at, part, cell_from, cell_parts, part_from)


def write_shards(assigned: DataFrame, path: str) -> None:
    """The rows of each shard in curve order, in the folder shard=N of ``path``."""
    assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

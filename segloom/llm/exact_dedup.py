"""Exact deduplication by progressive refinement: length, then a hash of the prefix, then a hash of the full text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.llm.common import BROADCAST_ROWS, HOT_ROWS, SPACE_RUN, as_text, join_counted, stored

#: Characters of the normalised text under the second level's hash.
PREFIX_CHARS = 256


def normalised(text_col: str) -> F.Column:
    """The text with every run of white space (space, 0x09 to 0x0D) as one space; null is empty. Ends are not trimmed."""
    return F.regexp_replace(as_text(text_col), SPACE_RUN, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, digest_all: bool = False, most: int = BROADCAST_ROWS, hot: int = HOT_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by normalised length; groups of one leave. The rest are grouped by length and prefix hash; groups of
    one leave again, and only the survivors' full hashes (SHA-256) are compared. A survivor's text is hashed in full; with
    ``digest_all`` the others' are too, for callers that want every digest, else theirs is null. Only hashes and lengths are
    shuffled, never texts: surviving prefixes that are over ``most``, too many to broadcast, give way to surviving lengths
    when texts are hashed. Groups are counted before the shuffle, so one of a third of all rows is a few rows, and in the
    joins with the counts the rows of groups of over ``hot`` stay where they are.

    Of equal texts the row with the smallest id stays. Null and empty texts are equal. Rows with a null id never stay in
    place of rows with one; a group of null ids only keeps them all (keep_id null, kept true). Repeated rows (same id
    and text) are all marked kept. Other columns of ``docs`` are not read, so their names don't matter.
    """
    text = normalised(text_col)
    marks = docs.select(
        F.col(id_col).alias("id"),
        F.length(text).alias("chars"),
        F.xxhash64(F.substring(text, 1, prefix_chars)).alias("prefix"),
        *([F.unhex(F.sha2(text, 256)).alias("full")] if digest_all else []),
    )
    marks = stored(marks, "marks")
    by_length = stored(marks.groupBy("chars").agg(F.count("*").alias("n")).where("n > 1"), "lengths")
    again = join_counted(marks, by_length, ["chars"], "id", most, hot).where("n IS NOT NULL").drop("n")
    by_prefix = stored(again.groupBy("chars", "prefix").agg(F.count("*").alias("n")).where("n > 1"), "survivors")
    if digest_all:
        rows = marks
        alive = join_counted(marks, by_prefix, ["chars", "prefix"], "id", most, hot).where("n IS NOT NULL").drop("n")
    else:
        texts = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("chars", F.length("text")).withColumn("prefix", F.xxhash64(F.substring("text", 1, prefix_chars)))
        few = next((k for k in (by_prefix, by_length) if k.count() <= most), None)
        texts = texts.withColumn("n", F.lit(2)) if few is None else texts.join(F.broadcast(few), [c for c in few.columns if c != "n"], "left")
        rows = stored(texts.select("id", "chars", "prefix", F.when(F.col("n").isNotNull(), F.unhex(F.sha2("text", 256))).alias("full")), "hashed")
        alive = rows.where(F.col("full").isNotNull())
    groups = stored(alive.groupBy("chars", "prefix", "full").agg(F.min("id").alias("keep"), F.count("*").alias("n")).where("n > 1"), "groups")
    out = join_counted(rows, groups, ["chars", "prefix", "full"], "id", most, hot)
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("full")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the copies: of rows of equal normalised text that with the smallest id stays, with all its columns."""
    dropped = exact_groups(docs, id_col, text_col).where("not kept").select(F.col(id_col)).distinct()
    dropped = stored(dropped, "dropped")
    return docs.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped, id_col, "left_anti")

"""Annotation files to section tables, all files of a folder in one job."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segloom.sources.manifests import file_listing, opened

#: Nested annotation files; values are kept as JSON text, as they are strings or objects.
JAMS_DDL = "annotations array<struct<namespace string, data array<struct<time double, duration double, value string, confidence double>>>>, file_metadata struct<duration double>"


def _stem(col: str = "path") -> F.Column:
    return F.regexp_extract(col, r"([^/]+?)(\.[^./]*)?$", 1)


def read_annotations(spark: SparkSession, path: str, namespace: str = "segment_open") -> DataFrame:
    """(path, track_id, annotation_idx, idx, start_time, end_time, label, confidence, metadata) of every annotation of a
    namespace. A value that is an object gives its label, else its value, else '', and is kept as metadata."""
    files = spark.read.schema(JAMS_DDL).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("path"), "annotations")
    return annotation_sections(files.select("path", _stem().alias("track_id"), "annotations"), namespace)


def annotation_sections(documents: DataFrame, namespace: str = "segment_open") -> DataFrame:
    """S5 of nested documents (path, track_id, annotations) that are read already, whatever they were stored in."""
    own = F.filter("annotations", lambda a: a["namespace"] == namespace)
    each = documents.select("path", "track_id", F.posexplode(own).alias("annotation_idx", "a"))
    rows = each.select("path", "track_id", "annotation_idx", F.posexplode("a.data").alias("idx", "d"))
    is_object = F.col("d.value").startswith("{")
    named = F.coalesce(F.get_json_object("d.value", "$.label"), F.get_json_object("d.value", "$.value"), F.lit(""))
    return rows.select(
        "path", "track_id", "annotation_idx", "idx", F.col("d.time").alias("start_time"), (F.col("d.time") + F.col("d.duration")).alias("end_time"),
        F.when(is_object, named).otherwise(F.col("d.value")).alias("label"), F.col("d.confidence").alias("confidence"), F.when(is_object, F.col("d.value")).alias("metadata"),
    )


def annotation_counts(spark: SparkSession, path: str, namespace: str = "segment_open") -> DataFrame:
    """How many annotations of a namespace each file has."""
    files = spark.read.schema(JAMS_DDL).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("path"), "annotations")
    return files.select("path", _stem().alias("track_id"), F.size(F.filter("annotations", lambda a: a["namespace"] == namespace)).alias("n"))


def pick_annotation(sections: DataFrame, counts: DataFrame, index: int = 0) -> DataFrame:
    """One annotation of each file; a file without any, or with too few, raises."""
    bad = counts.where(F.col("n") <= index).select("path", "n").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r.path} has {r.n} annotations, number {index} is asked for" for r in bad))
    return sections.where(F.col("annotation_idx") == index)


def read_text_annotations(spark: SparkSession, path: str, fallback_ends: DataFrame | None = None) -> DataFrame:
    """Sections of lines 'time label'. Blank lines and those with # in front don't count; a section ends where the next
    line begins; the last needs ``fallback_ends`` (track_id, fallback_end); lines labelled end or eof only end the one before;
    sections without length are dropped; other lines raise with their number."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return text_sections(files.select("path", _stem().alias("track_id"), "value"), fallback_ends)


def text_sections(documents: DataFrame, fallback_ends: DataFrame | None = None) -> DataFrame:
    """S6 of texts (path, track_id, value) that are read already."""
    lines = documents.select("path", "track_id", F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line", "text")).withColumn("text", F.trim(F.regexp_replace("text", r"\t", " ")))
    lines = lines.where((F.col("text") != "") & ~F.col("text").startswith("#"))
    parts = lines.withColumns({"_time": F.regexp_extract("text", r"^(\S+)\s+(\S.*)$", 1), "label": F.trim(F.regexp_extract("text", r"^(\S+)\s+(\S.*)$", 2))})
    time = F.expr("try_cast(_time AS double)")
    message = F.concat(F.lit("bad annotation row in "), F.col("path"), F.lit(":"), (F.col("line") + 1).cast("string"))
    timed = parts.withColumn("start_time", F.when(time.isNull(), F.raise_error(message).cast("double")).otherwise(time))
    if fallback_ends is not None:
        timed = timed.join(fallback_ends.select("track_id", "fallback_end"), "track_id", "left")
    else:
        timed = timed.withColumn("fallback_end", F.lit(None).cast("double"))
    w = Window.partitionBy("path").orderBy("line")
    ended = timed.withColumn("end_time", F.coalesce(F.lead("start_time").over(w), "fallback_end")).where(~F.lower("label").isin("end", "eof") & (F.col("end_time") > F.col("start_time")))
    return ended.select("path", "track_id", (F.row_number().over(w) - 1).alias("idx"), "start_time", "end_time", "label", F.lit(None).cast("double").alias("confidence"))


def annotation_files(listing: DataFrame) -> DataFrame:
    """One annotation file for each stem: of several the last path, so .txt goes before .jams."""
    own = listing.where(F.lower("path").rlike(r"\.(jams|txt)$")).withColumn("stem", _stem())
    return own.groupBy("stem").agg(F.max("path").alias("path"))


def pair_annotation_sets(original: DataFrame, revised: DataFrame) -> DataFrame:
    """(stem, original_path, revised_path, side) of two listings; side is both, original_only or revised_only."""
    a, b = annotation_files(original).withColumnRenamed("path", "original_path"), annotation_files(revised).withColumnRenamed("path", "revised_path")
    side = F.when(F.col("revised_path").isNull(), "original_only").when(F.col("original_path").isNull(), "revised_only").otherwise("both")
    return a.join(b.hint("merge"), "stem", "full_outer").withColumn("side", side)


def file_identity(spark: SparkSession, pairs: DataFrame, original: str, revised: str) -> DataFrame:
    """Of each pair whether sizes and SHA-256 of the contents are the same; hashes are made where files are read, a piece of
    a file at a time."""

    def files(folder: str) -> DataFrame:
        def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, _, start = opened(folder)
            for batch in batches:
                paths, sizes, hashes = batch.column(0).to_pylist(), [], []
                for path in paths:
                    size, digest = 0, hashlib.sha256()
                    with fs.open_input_stream(path[len(start) :]) as data:
                        while piece := data.read(1 << 20):
                            size += len(piece)
                            digest.update(piece)
                    sizes.append(size)
                    hashes.append(digest.hexdigest())
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string())], names=["path", "length", "sha"])

        return file_listing(spark, folder).select("path").mapInArrow(digests, "path string, length long, sha string")

    return _identity(pairs, files(original), files(revised))


def content_identity(pairs: DataFrame, original: DataFrame, revised: DataFrame) -> DataFrame:
    """S8 of contents (path, length, content) that are read already."""
    hashed = lambda files: files.select("path", "length", F.sha2("content", 256).alias("sha"))
    return _identity(pairs, hashed(original), hashed(revised))


def _identity(pairs: DataFrame, original: DataFrame, revised: DataFrame) -> DataFrame:
    hashed = lambda files, name: files.select(F.col("path").alias(f"{name}_path"), F.col("length").alias(f"{name}_size"), F.col("sha").alias(f"{name}_sha"))
    # a listing is estimated at a row, so without the hint it would be broadcast
    both = pairs.where("side = 'both'").join(hashed(original, "original").hint("merge"), "original_path").join(hashed(revised, "revised").hint("merge"), "revised_path")
    return both.select("stem", (F.col("original_size") == F.col("revised_size")).alias("same_size"), (F.col("original_sha") == F.col("revised_sha")).alias("same_sha256"))


def identity_summary(identity: DataFrame) -> DataFrame:
    """The counts, and the stems that differ."""
    return identity.agg(F.count_if("same_size").alias("same_size_count"), F.count_if("same_sha256").alias("same_sha256_count"), F.count_if(~F.col("same_sha256")).alias("different_sha256_count"), F.array_sort(F.collect_list(F.when(~F.col("same_sha256"), F.col("stem")))).alias("different_ids"))

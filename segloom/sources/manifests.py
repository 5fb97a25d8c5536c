"""Track manifests: JSON lines, folders of paired files, splits."""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACK = T.StructType([
    T.StructField("track_id", T.StringType()), T.StructField("audio_path", T.StringType()), T.StructField("jams_path", T.StringType()),
    T.StructField("dataset", T.StringType()), T.StructField("split", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
#: Tasks that list sub-folders.
LISTERS = 64


def read_manifest(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    """Tracks, one JSON object a line; blank lines are skipped, a bad line fails the read. Paths that don't begin at the
    root are taken from ``base``, the manifest's folder unless given."""
    rows = spark.read.schema(TRACK).option("mode", "FAILFAST").json(path)
    root = base if base is not None else path.rstrip("/").rsplit("/", 1)[0]
    full = lambda c: F.when(F.col(c).startswith("/") | F.col(c).contains("://"), F.col(c)).otherwise(F.concat(F.lit(root + "/"), F.col(c)))
    empty = F.create_map().cast("map<string,string>")
    return rows.withColumns({"audio_path": full("audio_path"), "jams_path": full("jams_path"), "metadata": F.coalesce("metadata", empty)})


def write_manifest(tracks: DataFrame, path: str, partition_by: str | None = None) -> None:
    """All six fields in the order of their names; R2 with ``partition_by`` 'split', a folder for each split."""
    rows = tracks.select(*sorted(TRACK.fieldNames()))
    writer = rows.write.option("ignoreNullFields", "false")
    (writer.partitionBy(partition_by) if partition_by else writer).json(path)


def opened(folder: str) -> tuple[pafs.FileSystem, str, str]:
    """A folder's file system, its path there, and what stands before that in the paths of a listing."""
    uri = folder if "://" in folder else f"file://{folder}"
    fs, root = pafs.FileSystem.from_uri(uri)
    return fs, root, "file:" if uri.startswith("file://") else uri[: uri.index(root)]


def file_listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Paths and stems of a folder's files and those of its sub-folders; their contents are not read. Names that begin with . or
    _ are left out. A task lists the folder and others each some of its sub-folders, so the driver sees no path; what lies
    directly in one folder is listed by one task. Join listings with a merge hint: Spark estimates them at a row and would
    broadcast them."""

    def entries(fs: pafs.FileSystem, path: str, recursive: bool) -> Iterator[tuple[str, bool]]:
        for info in fs.get_file_info(pafs.FileSelector(path, recursive=recursive)):
            inner, is_folder = info.path[len(path) :].strip("/").split("/"), info.type == pafs.FileType.Directory
            if not any(x[0] in "._" for x in inner) and (is_folder or fnmatchcase(inner[-1], pattern)):
                yield info.path, is_folder

    def batch(rows: list[tuple[str, bool]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_())], names=["path", "_more"])

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                fs, root, _ = opened(folder)
                found = list(entries(fs, root, False))
                for at in range(0, len(found), 10_000):
                    yield batch(found[at : at + 10_000])

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _, start = opened(folder)
        for rows in batches:
            given = list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))
            yield batch([(start + path, False) for path, more in given if not more])
            for path in [path for path, more in given if more]:
                yield batch([(start + p, False) for p, is_folder in entries(fs, path, True) if not is_folder])

    kind = "path string, _more boolean"
    files = spark.range(0, 1, 1, 1).mapInArrow(top, kind).repartition(LISTERS).mapInArrow(below, kind).select("path")
    return files.withColumn("stem", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1))


def natural_order(stem: Column) -> list[Column]:
    """Stems of digits first, by number, then the others by text."""
    digits = stem.rlike(r"^[0-9]+$")
    return [F.when(digits, 0).otherwise(1), F.when(digits, stem.cast("decimal(38,0)")), stem]


def pair_files(audio: DataFrame, annotations: DataFrame, dataset: str, preview: int = 10) -> DataFrame:
    """S3: a track for each audio file with its annotation of the same stem; audio without one raises."""
    lonely = audio.join(annotations.select("stem").hint("merge"), "stem", "left_anti")
    first = [r.stem for r in lonely.orderBy(*natural_order(F.col("stem"))).limit(preview).collect()]
    if first:
        raise ValueError(f"audio without annotation: {', '.join(first)}")
    both = audio.select("stem", F.col("path").alias("audio_path")).join(annotations.select("stem", F.col("path").alias("jams_path")).hint("merge"), "stem")
    return _tracks(both, F.col("stem"), dataset).orderBy(*natural_order(F.col("track_id")))


def pair_prefixed(audio: DataFrame, annotations: DataFrame, dataset: str, prefix: str) -> DataFrame:
    """A track for each annotation whose audio stem is ``prefix`` and its own; others are left out; none at all raises."""
    keyed = annotations.select(F.col("stem").alias("id"), F.col("path").alias("jams_path"), F.concat(F.lit(prefix), F.col("stem")).alias("stem"))
    out = _tracks(keyed.join(audio.select("stem", F.col("path").alias("audio_path")).hint("merge"), "stem"), F.col("id"), dataset)
    if out.isEmpty():
        raise ValueError("no annotation has audio")
    return out.orderBy(*natural_order(F.col("track_id")))


def _tracks(rows: DataFrame, name: Column, dataset: str) -> DataFrame:
    return rows.select(name.alias("track_id"), "audio_path", "jams_path", F.lit(dataset).alias("dataset"), F.lit(None).cast("string").alias("split"), F.create_map().cast("map<string,string>").alias("metadata"))


def pending(tracks: DataFrame, *done: DataFrame, keys: tuple[str, ...] = ("dataset", "track_id"), limit: int | None = None, order: str = "track_id") -> DataFrame:
    """The tracks that any of the outputs ``done`` lacks (such as ``committed`` of each store); the first ``limit`` in order."""
    counted = reduce(DataFrame.unionByName, [d.select(*keys).distinct() for d in done]).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") == len(done))
    rest = tracks.join(counted, [tracks[k].cast("string").eqNullSafe(counted[k].cast("string")) for k in keys], "left_anti")
    return rest if limit is None else rest.orderBy(order).limit(limit)


def resolve_beats(beats: DataFrame, tracks: DataFrame) -> DataFrame:
    """Stored beats of each track. A track that names a dataset takes that one's; one without takes the rows without a
    dataset, else those of the one dataset that has the track; several raise. Times must increase."""
    direct = beats.where("dataset IS NULL")
    homes = beats.where("dataset IS NOT NULL").groupBy("track_id").agg(F.min("dataset").alias("_home"), F.count_distinct("dataset").alias("_homes"))
    own = direct.select("track_id", F.lit(True).alias("_direct")).distinct()
    named = tracks.select("track_id", F.col("dataset").alias("_asked")).join(homes, "track_id", "left").join(own, "track_id", "left")
    ambiguous = F.raise_error(F.concat(F.lit("several datasets have beats of "), F.col("track_id"))).cast("string")
    use = F.when(F.col("_asked").isNotNull(), F.col("_asked")).when(F.col("_direct"), F.lit(None).cast("string")).when(F.col("_homes") > 1, ambiguous).otherwise(F.col("_home"))
    chosen = named.select(F.col("track_id").alias("_track"), use.alias("_dataset"))
    out = beats.join(chosen, (beats["track_id"] == chosen["_track"]) & beats["dataset"].eqNullSafe(chosen["_dataset"])).drop("_track", "_dataset")
    before = F.lag("time").over(Window.partitionBy("track_id").orderBy("beat_idx"))
    return out.withColumn("time", F.when(before >= F.col("time"), F.raise_error(F.lit("beats must increase")).cast("double")).otherwise(F.col("time")))

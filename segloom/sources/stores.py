"""Feature stores and report sinks."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sub-folders that files are dealt to by a checksum of their names.
FOLDERS = 256


def write_features(rows: DataFrame, path: str, partition_by: Sequence[str] = ("encoder", "dataset"), order: Sequence[str] = ("track_id", "idx"), tracks: DataFrame | None = None) -> str:
    """Frames, beats or label vectors, one row each; rows of a track stand together and in order in their file.

    A write is a run: its rows go to folders of its own below each partition, and once all are there a commit record lists
    its tracks: those of ``tracks`` (with the partition columns; those without rows too), else those with rows. Readers see
    committed runs only, and of a track that several runs wrote the last, so a job that dies leaves nothing behind that is
    read, and one that is repeated, in part or as a whole, gives each row once. Gives the run's name.
    """
    run = uuid.uuid4().hex
    keys = [*partition_by, order[0]]
    made = rows.withColumn("run", F.lit(run))
    made.repartition(*keys).sortWithinPartitions(*partition_by, *order).write.mode("append").partitionBy(*partition_by, "run").parquet(f"{path}/rows")
    written = tracks if tracks is not None else rows.sparkSession.read.parquet(f"{path}/rows").where(F.col("run") == run)
    record = written.select(*[F.col(c).cast("string").alias(c) for c in partition_by], order[0]).distinct().withColumns({"run": F.lit(run), "at": F.current_timestamp()})
    record.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return run


def committed(spark: SparkSession, path: str, keys: Sequence[str] = ("dataset", "track_id")) -> DataFrame:
    """The tracks that a store has, each with the last run that wrote it; none if nothing was committed yet."""
    try:
        records = spark.read.parquet(f"{path}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ", ".join(f"`{k}` string" for k in keys) + ", run string")
    by = [c for c in records.columns if c not in ("run", "at")]
    return records.groupBy(*by).agg(F.max_by("run", F.struct("at", "run")).alias("run"))


def read_features(spark: SparkSession, path: str, track: str = "track_id", **wanted: str) -> DataFrame:
    """The committed rows of a store, of the given partitions only."""
    rows, last = spark.read.parquet(f"{path}/rows"), committed(spark, path)
    for column, value in wanted.items():
        rows, last = rows.where(F.col(column) == value), last.where(F.col(column) == value)
    by = [c for c in last.columns if c != "run"]
    same = [rows["run"] == last["run"], *[rows[c].eqNullSafe(last[c]) if c == track else rows[c].cast("string").eqNullSafe(last[c]) for c in by]]
    return rows.join(last, same, "left_semi").drop("run")


def write_files(rows: DataFrame, folder: str, folders: int = 0) -> int:
    """One file for each row (name, value) of different names, and how many there are. A file is written beside its place and
    then moved there, so that a repeated task leaves whole files only. ``folders``: into how many sub-folders they are dealt, so
    that several tasks can list them; none unless given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        fs.create_dir(root, recursive=True)
        made = set()
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place = f"{root}/{zlib.crc32(name.encode()) % folders:04x}" if folders else root
                if place not in made:
                    fs.create_dir(place, recursive=True)
                    made.add(place)
                part = f"{place}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write((value or "").encode())
                fs.move(part, f"{place}/{quote(name, safe=' ')}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.select("name", F.col("value").cast("string")).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def nest_segments(segments: DataFrame, keys: Sequence[str] = ("track_id",), namespace: str = "segment_open", duration: str | None = None) -> DataFrame:
    """One nested annotation document a track; its duration is the given column's or the last end."""
    data = F.array_sort(F.collect_list(F.struct("idx", F.struct(F.col("start_time").alias("time"), (F.col("end_time") - F.col("start_time")).alias("duration"), F.col("label").alias("value"), F.lit(None).cast("double").alias("confidence")).alias("d"))))
    length = F.max(duration) if duration else F.max("end_time")
    rows = segments.groupBy(*keys).agg(F.transform(data, lambda s: s["d"]).alias("data"), length.alias("duration"))
    return rows.select(*keys, F.array(F.struct(F.lit(namespace).alias("namespace"), "data")).alias("annotations"), F.struct("duration").alias("file_metadata"))


def write_segments(segments: DataFrame, path: str, files: bool = False, **options) -> None:
    """Nested documents as JSON lines, nulls kept; with ``files`` a file for each track, named after it."""
    nested = nest_segments(segments, **options)
    if files:
        name = F.concat_ws("/", *[F.col(k).cast("string") for k in options.get("keys", ("track_id",))])
        write_files(nested.select(F.concat(name, F.lit(".jams")).alias("name"), F.to_json(F.struct("annotations", "file_metadata"), {"ignoreNullFields": "false"}).alias("value")), path)
    else:
        nested.write.option("ignoreNullFields", "false").json(path)


def write_report(rows: DataFrame, path: str, form: str = "csv") -> None:
    """A report table with a header line, or as JSON lines."""
    if form == "csv":
        rows.write.option("header", True).csv(path)
    else:
        rows.write.option("ignoreNullFields", "false").json(path)

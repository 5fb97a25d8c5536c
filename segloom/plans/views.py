"""Section, frame and score tables that Spark derives from the star-schema tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segloom.plans.sequences import TASK_ROWS, dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time in seconds of 2024, dealt by track."""
    rows = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return dealt(rows.select("event_id", F.col("user_id").alias("track_id"), (at / 1e6).alias("start_time"), "event_type", "value"), ["track_id"], TASK_ROWS)


def _sections(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("track_id").orderBy("start_time", "event_id")
    made = rows.withColumns({"idx": F.row_number().over(w) - 1, "end_time": F.lead("start_time").over(w)})
    return made.where("end_time IS NOT NULL").select("track_id", "idx", "start_time", "end_time", F.col("event_type").alias("label"), F.col("value").alias("confidence"), "event_id")


def sections_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(events(spark, sf_dir))


def sections_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where("event_id % 5 <> 0")
    return _sections(rows.withColumn("event_type", F.expr("CASE WHEN event_type = 'view' AND event_id % 7 = 0 THEN 'click' ELSE event_type END")))


def sections_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections_a(spark, sf_dir).where("event_id % 4 <> 0")


#: Labels of sections_num and sections_nf.
NUMBERED = "CASE WHEN event_id % 2 = 0 THEN concat(label, CAST(event_id % 3 AS STRING)) ELSE label END"
FUNCTIONS = "CASE label WHEN 'error' THEN 'no_function' WHEN 'signup' THEN 'silence' ELSE label END"


def sections_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections_a(spark, sf_dir).withColumn("label", F.expr(NUMBERED))


def sections_nf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections_a(spark, sf_dir).withColumn("label", F.expr(FUNCTIONS))


def sections_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(events(spark, sf_dir).where("event_id % 3 <> 0"))


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of parts, with their number run on, after _ or after -."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("label_id"), F.expr("concat(lower(p_type), CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '_' ELSE '-' END, CAST(p_size AS STRING))").alias("label"))


def user_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track per user, that lasts an hour longer than its last event."""
    return events(spark, sf_dir).groupBy("track_id").agg((F.max("start_time") + 3600).alias("duration"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of six hours over 30 days of each user."""
    users = events(spark, sf_dir).select("track_id").distinct()
    return users.select("track_id", F.explode(F.sequence(F.lit(0), F.lit(119))).alias("idx")).withColumns({"start_time": F.col("idx") * 21600.0, "end_time": (F.col("idx") + 1) * 21600.0})


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sections_a(spark, sf_dir)
    return rows.select("track_id", F.col("idx").alias("beat_idx"), F.col("start_time").alias("time"), (F.col("idx") % 4 == 0).alias("is_downbeat"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings, 50 to a track, a frame every half second; every eleventh has no target. ``scores``: the first ten numbers."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        F.expr("vec_id div 50").alias("track_id"), (F.col("vec_id") % 50).cast("int").alias("frame_idx"), ((F.col("vec_id") % 50) * 0.5).alias("time"), ((F.col("vec_id") % 50) * 0.5).alias("start_time"), ((F.col("vec_id") % 50 + 1) * 0.5).alias("end_time"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vec"), F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")).alias("scores"), F.expr("CASE WHEN vec_id % 11 = 0 THEN -100 ELSE CAST(label AS INT) END").alias("target"),
    )


def label_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from segloom.functions.vectors import vector_mean

    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("label_idx"), "embedding")
    return vector_mean(rows, ["label_idx"], "embedding").withColumnRenamed("embedding", "vec")


def long_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve tracks that lengthen with the table, a frame an order line, with whole numbers as scores of three labels."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 12).alias("track_id"), "l_orderkey", "l_linenumber", F.array(F.col("l_quantity").cast("double"), F.round(F.col("l_discount") * 500).cast("double"), F.round(F.col("l_tax") * 600).cast("double")).alias("scores"))
    at = F.row_number().over(Window.partitionBy("track_id").orderBy("l_orderkey", "l_linenumber", "scores")) - 1
    return rows.select("track_id", at.alias("frame_idx"), "scores").withColumns({"start_time": F.col("frame_idx") * 0.5, "end_time": (F.col("frame_idx") + 1) * 0.5})


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("track_id"), F.col("turn").alias("frame_idx"), F.col("turn").cast("double").alias("start_time"), (F.col("turn") + 1).cast("double").alias("end_time"), F.col("role").alias("label"))


def document_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("track_id"), F.col("source").alias("dataset"), F.col("doc_id").alias("manifest_ord"), "n_chars")


_SECTIONS = "SELECT track_id, row_number() OVER w - 1 AS idx, start_time, lead(start_time) OVER w AS end_time, event_type AS label, value AS confidence, event_id FROM {} WINDOW w AS (PARTITION BY track_id ORDER BY start_time, event_id) QUALIFY end_time IS NOT NULL"
_BASE = "regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[_\\-]+', ' ', 'g'), '([a-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-z])', '\\1 \\2', 'g'), '\\s+', ' ', 'g')), '\\s+[0-9]+(\\s*[a-z])?$', '')"


def base_sql(col: str) -> str:
    """label_base in the oracle's dialect."""
    return _BASE.format(col)


def merge_sql(source: str) -> str:
    """merge_consecutive of a sections view."""
    return f"""SELECT track_id, min(idx) AS idx, arg_min(start_time, idx) AS start_time, arg_max(end_time, idx) AS end_time, any_value(label) AS label,
        sum(confidence * pow(2.0, -(n - greatest(r, 2) + 1))) AS confidence
        FROM (SELECT *, count(confidence) OVER (PARTITION BY track_id, island) AS n, count(confidence) OVER (PARTITION BY track_id, island ORDER BY idx) AS r
              FROM (SELECT *, sum(ch) OVER (PARTITION BY track_id ORDER BY idx) AS island
                    FROM (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY track_id ORDER BY idx) = label THEN 0 ELSE 1 END AS ch FROM {source}))) GROUP BY track_id, island"""


#: The same tables in the oracle's SQL; each may name those before it.
VIEWS = {
    "ev": "SELECT event_id, user_id AS track_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS start_time, event_type, value FROM events",
    "sections_a": _SECTIONS.format("ev"),
    "sections_b": _SECTIONS.format("(SELECT event_id, track_id, start_time, CASE WHEN event_type = 'view' AND event_id % 7 = 0 THEN 'click' ELSE event_type END AS event_type, value FROM ev WHERE event_id % 5 <> 0)"),
    "sections_gap": "SELECT * FROM sections_a WHERE event_id % 4 <> 0",
    "sections_num": "SELECT * REPLACE (CASE WHEN event_id % 2 = 0 THEN label || CAST(event_id % 3 AS VARCHAR) ELSE label END AS label) FROM sections_a",
    "sections_nf": "SELECT * REPLACE (CASE label WHEN 'error' THEN 'no_function' WHEN 'signup' THEN 'silence' ELSE label END AS label) FROM sections_a",
    "sections_lower": _SECTIONS.format("(SELECT * FROM ev WHERE event_id % 3 <> 0)"),
    "merged_a": merge_sql("sections_a"),
    "merged_b": merge_sql("sections_b"),
    "raw_labels": "SELECT p_partkey AS label_id, lower(p_type) || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '_' ELSE '-' END || CAST(p_size AS VARCHAR) AS label FROM part",
    "user_tracks": "SELECT track_id, max(start_time) + 3600 AS duration FROM ev GROUP BY track_id",
    "grid": "SELECT track_id, CAST(i AS INTEGER) AS idx, i * 21600.0 AS start_time, (i + 1) * 21600.0 AS end_time FROM (SELECT DISTINCT track_id FROM ev), range(120) AS r(i)",
    "beats": "SELECT track_id, idx AS beat_idx, start_time AS time, idx % 4 = 0 AS is_downbeat FROM sections_a",
    "frames": "SELECT vec_id // 50 AS track_id, CAST(vec_id % 50 AS INTEGER) AS frame_idx, (vec_id % 50) * 0.5::DOUBLE AS time, (vec_id % 50) * 0.5::DOUBLE AS start_time, (vec_id % 50 + 1) * 0.5::DOUBLE AS end_time, embedding::DOUBLE[] AS vec, embedding[1:10]::DOUBLE[] AS scores, CASE WHEN vec_id % 11 = 0 THEN -100 ELSE label::INTEGER END AS target FROM embeddings",
    "long_frames": "SELECT track_id, frame_idx, scores, frame_idx * 0.5::DOUBLE AS start_time, (frame_idx + 1) * 0.5::DOUBLE AS end_time FROM (SELECT track_id, scores, CAST(row_number() OVER (PARTITION BY track_id ORDER BY l_orderkey, l_linenumber, scores) - 1 AS BIGINT) AS frame_idx FROM (SELECT l_suppkey % 12 AS track_id, l_orderkey, l_linenumber, [CAST(l_quantity AS DOUBLE), CAST(round(l_discount * 500) AS DOUBLE), CAST(round(l_tax * 600) AS DOUBLE)] AS scores FROM lineitem))",
    "label_vectors": "SELECT label_idx, list(x ORDER BY i) AS vec FROM (SELECT label::INTEGER AS label_idx, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) AS r(i) GROUP BY ALL) GROUP BY label_idx",
    "turns": "SELECT conv_id AS track_id, turn AS frame_idx, turn::DOUBLE AS start_time, (turn + 1)::DOUBLE AS end_time, role AS label FROM conversations",
    "document_tracks": "SELECT doc_id AS track_id, source AS dataset, doc_id AS manifest_ord, n_chars FROM documents",
}


def with_views(sql: str) -> str:
    """The query after the views that it needs, each with what it needs itself."""
    import re

    need, todo = [], [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in need:
                need.append(name)
                todo.append(VIEWS[name])
    own = re.match(r"\s*WITH(\s+RECURSIVE)?\b", sql)
    head = ("WITH RECURSIVE " if own and own[1] else "WITH ") + ", ".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in need) if need else ""
    if not head:
        return sql
    return head + (", " + sql[own.end() :] if own else " " + sql)

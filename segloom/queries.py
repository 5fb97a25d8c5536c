"""Registered queries: each applies operators to whole tables. ``ORACLES`` has the same in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.functions import labels as L
from segloom.functions import vectors as V
from segloom.operators import comparison as C
from segloom.operators import decoding as D
from segloom.operators import evaluation as E
from segloom.operators import grid as T
from segloom.operators import policies as P
from segloom.operators import similarity as G
from segloom.operators import vocabulary as O
from segloom.plans import sequences as Q
from segloom.plans import views as W
from segloom.plans.scratch import scratch_path
from segloom.plans.sql import clean_sql, evaluate_sql, path_sql, runs_sql, smooth_sql
from segloom.plans.views import base_sql, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return f

    return add


def r(col: str, digits: int = 6, name: str | None = None) -> F.Column:
    return F.round(F.col(col).cast("double"), digits).alias(name or col)


def sections(df: DataFrame) -> DataFrame:
    return df.select("track_id", F.col("idx").cast("long").alias("idx"), r("start_time"), r("end_time"), "label")


SECTIONS_SQL = "CAST(idx AS BIGINT) AS idx, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, label"

# --- labels -----------------------------------------------------------------------------------------------------------


def _labels(name: str, expr: Callable[[], F.Column], sql: str, kind: str = "string") -> None:
    QUERIES[name] = lambda spark, d: W.raw_labels(spark, d).select("label_id", expr().cast(kind).alias("value"))
    ORACLES[name] = with_views(f"SELECT label_id, {sql} AS value FROM raw_labels")


_CANON_ = r"regexp_replace(lower(trim(label)), '[\s_\-]+', '_', 'g')"
_KEY = r"regexp_replace(lower(trim(label)), '[\s_\-]+', '', 'g')"
_GENERIC = r"regexp_replace(regexp_replace(lower(trim(label)), '[_\-]+', ' ', 'g'), '([a-z])([0-9])', '\1 \2', 'g')"
_READ = rf"trim(regexp_replace({_GENERIC}, '\s+', ' ', 'g'))"
_OBASE = rf"CASE WHEN regexp_full_match({_READ}, '.+?\s+[0-9]+') THEN regexp_extract({_READ}, '^(.+?)\s+([0-9]+)$', 1) ELSE {_READ} END"
_ONUM = rf"TRY_CAST(CASE WHEN regexp_full_match({_READ}, '.+?\s+[0-9]+') THEN regexp_extract({_READ}, '^(.+?)\s+([0-9]+)$', 2) END AS BIGINT)"
_ORD = "CAST({0} AS VARCHAR) || CASE WHEN {0} % 100 BETWEEN 10 AND 20 THEN 'th' WHEN {0} % 10 = 1 THEN 'st' WHEN {0} % 10 = 2 THEN 'nd' WHEN {0} % 10 = 3 THEN 'rd' ELSE 'th' END"
_WORDS = "[" + ", ".join(f"'{w}'" for w in L.ORDINAL_WORDS) + "]"
_OWORD = "CASE WHEN {0} BETWEEN 1 AND 20 THEN " + _WORDS + "[{0}] ELSE " + _ORD + " END"

_labels("l01_label_base", lambda: L.label_base("label"), base_sql("label"))
_labels("l02_canonical_underscore", lambda: L.canonical_underscore("label"), _CANON_)
_labels("l03_canonical_space", lambda: L.canonical_space("label"), r"trim(regexp_replace(regexp_replace(lower(trim(label)), '[_\-]', ' ', 'g'), '\s+', ' ', 'g'))")
_labels("l04_normalize_label", lambda: L.normalize_label("label", "generic"), _READ)
_labels("l05_harmonix_label", lambda: L.normalize_label("label", "harmonix", {"promo": "promotion"}), rf"CASE WHEN regexp_extract({_KEY}, '^([a-z]+)([0-9]+[a-z]?)$', 1) = 'promo' THEN 'promotion ' || regexp_extract({_KEY}, '^([a-z]+)([0-9]+[a-z]?)$', 2) ELSE {_READ} END")
_labels("l06_generic_label", lambda: L.generic_label("label"), _GENERIC)


@query("l07_prompt_label", rf"WITH t AS (SELECT DISTINCT {base_sql('label')} AS text, label FROM raw_labels) SELECT label, CASE WHEN count(*) OVER (PARTITION BY text) > 1 THEN text || ' (' || {_READ} || ')' ELSE text END AS value FROM t")
def _(spark, d):
    from pyspark.sql import Window

    t = W.raw_labels(spark, d).select("label", L.label_base("label").alias("text")).distinct()
    return t.select("label", L.prompt_label("label", "text", F.count(F.lit(1)).over(Window.partitionBy("text"))).alias("value"))


_labels("l08_occurrence_base", lambda: L.occurrence_base(L.readable_label("label")), _OBASE)
_labels("l08_occurrence_index", lambda: L.occurrence_index(L.readable_label("label")), _ONUM, "long")
_labels("l09_ordinal", lambda: L.ordinal(F.col("label_id")), _ORD.format("label_id"))
_labels("l09_ordinal_word", lambda: L.ordinal_word(F.col("label_id") % 40), _OWORD.format("(label_id % 40)"))
_labels("l10_occurrence_description", lambda: L.occurrence_description(L.occurrence_base(L.readable_label("label")), L.occurrence_index(L.readable_label("label"))), f"'the ' || {_ORD.format('(' + _ONUM + ')')} || ' ' || {_OBASE} || ' section in chronological order'")
_labels("l10_occurrence_prompt", lambda: L.occurrence_prompt(L.occurrence_base(L.readable_label("label")), L.occurrence_index(L.readable_label("label"))), f"'the ' || {_OWORD.format('(' + _ONUM + ')')} || ' occurrence of the ' || {_OBASE} || ' section in this song'")
_labels("l11_description", lambda: L.description(L.label_base("label"), "none", {"promo": "a part on offer."}), f"CASE WHEN {base_sql('label')} = 'promo' THEN 'a part on offer' ELSE 'a music structure section annotated as ' || {base_sql('label')} END")
_labels("l12_prompt", lambda: L.prompt("label", L.readable_label("label"), L.readable_label("label"), "compact"), f"'Music structure label: ' || {_READ}")
_labels("l16_slug", lambda: L.slug("label"), r"regexp_replace(label, '[^A-Za-z0-9_\-]', '_', 'g')")


@query("l13_event_family", f"SELECT track_id, idx, CASE WHEN contains({base_sql('label')}, 'intro') THEN 'intro' WHEN contains({base_sql('label')}, 'silence') OR {base_sql('label')} IN ('none', 'no function') THEN 'silence' ELSE 'other' END AS family FROM sections_nf")
def _(spark, d):
    return W.sections_nf(spark, d).select("track_id", F.col("idx").cast("long").alias("idx"), L.label_family("label").alias("family"))


@query("l14_silence_label", "WITH t AS (SELECT track_id, list(DISTINCT label) AS l FROM sections_nf GROUP BY track_id) SELECT track_id, CASE WHEN list_contains(l, 'silence') THEN 'silence' END AS value FROM t")
def _(spark, d):
    return W.sections_nf(spark, d).groupBy("track_id").agg(F.collect_set("label").alias("l")).select("track_id", L.silence_label_in("l").alias("value"))


@query("l15_ensure_silence", "WITH t AS (SELECT track_id, list(DISTINCT label) AS l FROM sections_gap GROUP BY track_id) SELECT track_id, array_to_string(list_sort(list_distinct(list_append(l, 'silence'))), ',') AS value FROM t")
def _(spark, d):
    t = W.sections_gap(spark, d).groupBy("track_id").agg(F.collect_set("label").alias("l"))
    return t.select("track_id", F.array_join(F.array_sort(L.ensure_silence_label("l")), ",").alias("value"))


@query("l17_hash_embedding", "WITH t AS (SELECT label_id, sha256(label) AS h FROM raw_labels), v AS (SELECT label_id, i, ('0x' || substr(h, 2 * i + 1, 2))::INTEGER / 127.5 - 1 AS x FROM t, range(16) AS r(i)) SELECT label_id, i::BIGINT AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label_id)), 6) AS x FROM v")
def _(spark, d):
    return W.raw_labels(spark, d).select("label_id", F.posexplode(L.hash_embedding("label", 16)).alias("i", "x")).select("label_id", F.col("i").cast("long").alias("i"), r("x"))


# --- policies ---------------------------------------------------------------------------------------------------------


@query("p01_merge", "SELECT track_id, CAST(idx AS BIGINT) AS idx, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, label, round(confidence, 6) AS confidence FROM merged_a")
def _(spark, d):
    return P.merge_consecutive(W.sections_a(spark, d)).select("track_id", F.col("idx").cast("long").alias("idx"), r("start_time"), r("end_time"), "label", r("confidence"))


@query("p02_base_labels", f"WITH b AS (SELECT * REPLACE ({base_sql('label')} AS label) FROM sections_num), m AS ({W.merge_sql('b')}) SELECT track_id, {SECTIONS_SQL} FROM m")
def _(spark, d):
    return sections(P.apply_policy(W.sections_num(spark, d), "base_labels"))


_COUNT = "count(*) OVER (PARTITION BY track_id, label)"
_NUMBER = "row_number() OVER (PARTITION BY track_id, label ORDER BY idx)"


@query("p03_enumerate_all", f"WITH t AS (SELECT *, {_COUNT} AS n, {_NUMBER} AS k FROM sections_a) SELECT track_id, {SECTIONS_SQL.replace('label', 'CASE WHEN n > 1 THEN label || chr(32) || k ELSE label END AS label')} FROM t")
def _(spark, d):
    return sections(P.apply_policy(W.sections_a(spark, d), "enumerate_all_occurrences"))


@query("p04_repeated_labels", f"SELECT DISTINCT track_id, label FROM (SELECT *, {_COUNT} AS n FROM sections_num) WHERE n > 1")
def _(spark, d):
    return W.sections_num(spark, d).withColumn("_again", P.repeated_flag("label")).where("_again").select("track_id", "label").distinct()


@query("p05_enumerate_consecutive", f"WITH t AS (SELECT *, lag(label) OVER (PARTITION BY track_id ORDER BY idx) = label AS same FROM sections_a), u AS (SELECT *, coalesce(bool_or(same) OVER (PARTITION BY track_id, label), false) AS pick, {_NUMBER} AS k FROM t) SELECT track_id, {SECTIONS_SQL.replace('label', 'CASE WHEN pick THEN label || chr(32) || k ELSE label END AS label')} FROM u")
def _(spark, d):
    return sections(P.apply_policy(W.sections_a(spark, d), "enumerate_consecutive_repeats"))


@query("p06_enumerate_bases", f"WITH b AS (SELECT *, {base_sql('label')} AS base FROM sections_num), t AS (SELECT *, count(*) OVER (PARTITION BY track_id, base) AS n, row_number() OVER (PARTITION BY track_id, base ORDER BY idx) AS k FROM b) SELECT track_id, {SECTIONS_SQL.replace('label', 'CASE WHEN n > 1 THEN base || chr(32) || k ELSE label END AS label')} FROM t")
def _(spark, d):
    return sections(P.apply_policy(W.sections_num(spark, d), "enumerate_base_occurrences"))


_REPLACED = "SELECT * REPLACE (CASE WHEN label = 'no_function' THEN coalesce(last_value(CASE WHEN label <> 'no_function' THEN label END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_value(CASE WHEN label <> 'no_function' THEN label END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), label) ELSE label END AS label) FROM sections_nf"


_POLICIES = ["keep", "base_labels", "enumerate_base_occurrences"]


@query("p00_policies", f"""WITH b AS (SELECT *, {base_sql('label')} AS base FROM sections_num), t AS (SELECT *, count(*) OVER (PARTITION BY track_id, base) AS n, row_number() OVER (PARTITION BY track_id, base ORDER BY idx) AS k FROM b),
    c AS (SELECT * REPLACE (base AS label) FROM b), m AS ({W.merge_sql('c')})
    SELECT 'keep' AS policy, track_id, {SECTIONS_SQL} FROM sections_num UNION ALL SELECT 'base_labels', track_id, {SECTIONS_SQL} FROM m
    UNION ALL SELECT 'enumerate_base_occurrences', track_id, {SECTIONS_SQL.replace('label', 'CASE WHEN n > 1 THEN base || chr(32) || k ELSE label END AS label')} FROM t""")
def _(spark, d):
    s = W.sections_num(spark, d)
    made = [sections(P.apply_policy(s, name)).select(F.lit(name).alias("policy"), "track_id", "idx", "start_time", "end_time", "label") for name in _POLICIES]
    return made[0].union(made[1]).union(made[2])


@query("p07_replace_no_function", f"WITH t AS ({_REPLACED}) SELECT track_id, {SECTIONS_SQL} FROM t")
def _(spark, d):
    return sections(P.replace_no_function(W.sections_nf(spark, d)))


@query("p08_function_occurrences", f"WITH t AS ({_REPLACED}), m AS ({W.merge_sql('t')}), n AS (SELECT *, count(*) OVER (PARTITION BY track_id, label) AS n, row_number() OVER (PARTITION BY track_id, label ORDER BY idx) AS k FROM (SELECT track_id, idx, start_time, end_time, label FROM m)) SELECT track_id, {SECTIONS_SQL.replace('label', 'CASE WHEN n > 1 AND label <> $$silence$$ THEN label || chr(32) || k ELSE label END AS label')} FROM n")
def _(spark, d):
    return sections(P.apply_policy(W.sections_nf(spark, d), "salami_function_occurrences"))


_PROJECTED = """WITH o AS (SELECT l.track_id, l.idx, f.label AS flabel, row_number() OVER (PARTITION BY l.track_id, l.idx ORDER BY least(l.end_time, f.end_time) - greatest(l.start_time, f.start_time) DESC NULLS LAST, f.idx) AS k
    FROM sections_lower l LEFT JOIN merged_a f ON l.track_id = f.track_id AND l.start_time < f.end_time AND f.start_time < l.end_time),
    p AS (SELECT l.track_id, l.idx, l.start_time, l.end_time, l.confidence, CASE WHEN flabel IS NULL THEN l.label WHEN flabel = 'view' THEN 'view' ELSE flabel || ' subsegment ' || l.label END AS label FROM sections_lower l JOIN o ON l.track_id = o.track_id AND l.idx = o.idx AND o.k = 1),
    m AS (""" + W.merge_sql("p") + f") SELECT track_id, {SECTIONS_SQL} FROM m"


@query("p09_projected_lower", _PROJECTED)
def _(spark, d):
    function = P.merge_consecutive(W.sections_a(spark, d))
    return sections(P.project_lower(function, W.sections_lower(spark, d), preserve=("view",)))


def _annotators(spark, d):
    labels = F.array("label", F.expr(W.FUNCTIONS), F.expr(W.NUMBERED))  # sections_a, sections_nf, sections_num
    return W.sections_a(spark, d).select("*", F.posexplode(labels).alias("annotation_idx", "_label")).withColumn("label", F.col("_label")).drop("_label")


@query("p10_richest_annotation", """WITH u AS (SELECT *, 0 AS a FROM sections_a UNION ALL SELECT *, 1 FROM sections_nf UNION ALL SELECT *, 2 FROM sections_num), c AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY track_id, a ORDER BY idx) = label THEN 0 ELSE 1 END AS ch FROM u),
    s AS (SELECT track_id, a, count(DISTINCT label) FILTER (label NOT IN ('silence', 'no_function')) AS useful, count(DISTINCT label) AS labels, sum(ch) AS merged, count(*) AS n FROM c GROUP BY ALL)
    SELECT track_id, a AS annotation_idx FROM s QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY useful DESC, labels DESC, merged DESC, n, a) = 1""")
def _(spark, d):
    return P.select_annotation(_annotators(spark, d), selection="richest_function")


@query("p11_policy_choices", f"WITH m AS (SELECT track_id, idx, start_time, end_time, label FROM merged_a) SELECT 'keep' AS policy, track_id, {SECTIONS_SQL} FROM sections_a UNION ALL SELECT 'merge', track_id, {SECTIONS_SQL} FROM m")
def _(spark, d):
    rows = P.expand_policies(W.sections_a(spark, d), P.RandomPolicy.of(["keep", "merge"]).choices)
    return rows.select("policy", "track_id", F.col("idx").cast("long").alias("idx"), r("start_time"), r("end_time"), "label")


_DRAW = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"


@query("p12_sampled_policy", f"SELECT track_id, CAST({_DRAW.format("'5:2:' || manifest_ord || ':' || track_id")} % 3 AS INTEGER) AS choice FROM document_tracks")
def _(spark, d):
    return P.sample_policy(W.document_tracks(spark, d), 3, seed=5, epoch=2, index="manifest_ord").select("track_id", "choice")


# --- grids and targets ------------------------------------------------------------------------------------------------


@query("t01_beat_intervals", "SELECT b.track_id, CAST(beat_idx AS BIGINT) AS idx, round(time, 6) AS start_time, round(coalesce(lead(time) OVER (PARTITION BY b.track_id ORDER BY beat_idx), duration), 6) AS end_time FROM beats b JOIN user_tracks USING (track_id)")
def _(spark, d):
    return T.beat_intervals(W.beats(spark, d), W.user_tracks(spark, d)).select("track_id", F.col("idx").cast("long").alias("idx"), r("start_time"), r("end_time"))


@query("t02_trim_beats", """WITH c AS (SELECT track_id, duration * 0.5 AS duration FROM user_tracks), j AS (SELECT c.track_id, beat_idx, time, is_downbeat, time < duration AS ok FROM c LEFT JOIN beats b ON b.track_id = c.track_id),
    n AS (SELECT *, count(time) OVER w AS nb, count(*) FILTER (ok) OVER w AS na FROM j WINDOW w AS (PARTITION BY track_id))
    SELECT track_id, CAST(beat_idx AS BIGINT) AS beat_idx, round(time, 6) AS time, is_downbeat, CAST(nb AS BIGINT) AS n_before, CAST(na AS BIGINT) AS n_after FROM n WHERE ok
    UNION ALL SELECT DISTINCT track_id, 0, 0.0, false, CAST(nb AS BIGINT), 1 FROM n WHERE na = 0""")
def _(spark, d):
    half = W.user_tracks(spark, d).withColumn("duration", F.col("duration") * 0.5)
    return T.trim_beats(W.beats(spark, d), half).select("track_id", "beat_idx", r("time"), "is_downbeat", F.col("n_before").cast("long").alias("n_before"), F.col("n_after").cast("long").alias("n_after"))


@query("t03_uniform_beats", "SELECT track_id, CAST(i AS BIGINT) AS beat_idx, round(i * 3600.0::DOUBLE, 6) AS time, i % 4 = 0 AS is_downbeat FROM user_tracks, range(100000) AS x(i) WHERE i <= greatest(ceil(duration / 3600.0) - 1, 0)")
def _(spark, d):
    return T.uniform_beats(W.user_tracks(spark, d), 3600.0).select("track_id", "beat_idx", r("time"), "is_downbeat")


@query("t04_uniform_times", "SELECT track_id, frame_idx, round(CASE WHEN n = 1 THEN 0 ELSE frame_idx * 30.0 / n END, 6) AS time FROM (SELECT *, count(*) OVER (PARTITION BY track_id) AS n FROM frames)")
def _(spark, d):
    f = W.frames(spark, d)
    return T.uniform_times(f, f.select("track_id").distinct().withColumn("duration", F.lit(30.0))).select("track_id", "frame_idx", r("time"))


@query("t05_fourier_features", "SELECT track_id, CAST(f AS BIGINT) AS frame_idx, CAST(i AS BIGINT) AS i, round(CASE WHEN i % 2 = 0 THEN sin(p * (i // 2 + 1)) ELSE cos(p * (i // 2 + 1)) END, 5) AS x FROM (SELECT track_id, f, (f * 86400.0) / greatest(duration, 86400.0) * 2 * pi() AS p FROM user_tracks, range(1000) AS a(f) WHERE f <= greatest(ceil(duration / 86400.0) - 1, 0)), range(6) AS b(i)")
def _(spark, d):
    return T.fourier_features(W.user_tracks(spark, d), 6, 1 / 86400.0).select("track_id", "frame_idx", F.posexplode("vec").alias("i", "x")).select("track_id", "frame_idx", F.col("i").cast("long").alias("i"), r("x", 5))


_POOL_GRID = "SELECT track_id, CAST(i AS INTEGER) AS idx, i * 1.7 AS start_time, (i + 1) * 1.7 AS end_time FROM (SELECT DISTINCT track_id FROM frames), range(20) AS x(i)"


def _pool_grid(spark, d):
    tracks = W.frames(spark, d).select("track_id").distinct()
    return tracks.select("track_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("idx")).withColumns({"start_time": F.col("idx") * 1.7, "end_time": (F.col("idx") + 1) * 1.7})


@query("t06_mean_pool", f"""WITH g AS ({_POOL_GRID}), m AS (SELECT g.track_id, g.idx, i, avg(vec[i]) AS x FROM g JOIN frames f ON f.track_id = g.track_id AND f.time >= g.start_time AND f.time < g.end_time, range(1, 65) AS x(i) GROUP BY ALL),
    near AS (SELECT g.track_id, g.idx, arg_min(vec, {{'d': abs(f.time - (g.start_time + g.end_time) / 2), 'i': frame_idx}}) AS vec FROM g JOIN frames f USING (track_id) WHERE (g.track_id, g.idx) NOT IN (SELECT track_id, idx FROM m) GROUP BY ALL)
    SELECT track_id, idx, CAST(i - 1 AS INTEGER) AS i, round(x, 5) AS x FROM m UNION ALL SELECT track_id, idx, CAST(i - 1 AS INTEGER), round(vec[i], 5) FROM near, range(1, 65) AS x(i)""")
def _(spark, d):
    return T.mean_pool(W.frames(spark, d).select("track_id", "frame_idx", "time", "vec"), _pool_grid(spark, d)).select("track_id", "idx", F.posexplode("vec").alias("i", "x")).select("track_id", "idx", "i", r("x", 5))


@query("t07_median_bpm", "SELECT track_id, round(60.0 / median(g), 6) AS bpm FROM (SELECT track_id, time - lag(time) OVER (PARTITION BY track_id ORDER BY beat_idx) AS g FROM beats) WHERE g > 0 GROUP BY track_id")
def _(spark, d):
    return T.median_bpm(W.beats(spark, d)).where("bpm IS NOT NULL").select("track_id", r("bpm"))


@query("t08_subsample_beats", """WITH g AS (SELECT track_id, frame_idx AS idx, start_time, end_time, vec[1:4] AS vec, CASE WHEN track_id % 2 = 0 THEN 150.0 ELSE 90.0 END AS bpm FROM frames),
    c AS (SELECT *, bpm > 140 AS s, CASE WHEN bpm > 140 THEN idx // 2 ELSE idx END AS ch FROM g)
    SELECT track_id, CAST(ch AS BIGINT) AS idx, round(min(start_time), 6) AS start_time, round(max(end_time), 6) AS end_time, bool_or(s) AS subsampled, round(avg(vec[1]), 5) AS x0, round(avg(vec[4]), 5) AS x3 FROM c GROUP BY track_id, ch""")
def _(spark, d):
    f = W.frames(spark, d).select("track_id", F.col("frame_idx").alias("idx"), "start_time", "end_time", F.slice("vec", 1, 4).alias("vec"))
    bpm = f.select("track_id").distinct().withColumn("bpm", F.when(F.col("track_id") % 2 == 0, 150.0).otherwise(90.0))
    out = T.subsample_beats(f, bpm)
    return out.select("track_id", F.col("idx").cast("long").alias("idx"), r("start_time"), r("end_time"), "subsampled", F.round(F.col("vec")[0], 5).alias("x0"), F.round(F.col("vec")[3], 5).alias("x3"))


@query("t09_overlap_labels", """WITH e AS (SELECT track_id, start_time AS t, {'i': idx, 'e': end_time} AS g, NULL AS s FROM grid UNION ALL SELECT track_id, start_time, NULL, {'i': idx, 'e': end_time, 'label': label} FROM sections_gap),
    w AS (SELECT track_id, t, last_value(g IGNORE NULLS) OVER o AS g, last_value(s IGNORE NULLS) OVER o AS s FROM e WINDOW o AS (PARTITION BY track_id ORDER BY t, s IS NULL ROWS UNBOUNDED PRECEDING)),
    o AS (SELECT track_id, g.i AS idx, s.label AS label FROM w WHERE g.e > t AND s.e > t QUALIFY row_number() OVER (PARTITION BY track_id, g.i ORDER BY least(g.e, s.e) - t DESC, s.i) = 1)
    SELECT track_id, idx, coalesce(label, 'none') AS label FROM grid LEFT JOIN o USING (track_id, idx)""")
def _(spark, d):
    return T.assign_overlap(W.grid(spark, d), W.sections_gap(spark, d), unknown="none").select("track_id", "idx", "label")


_ADJUSTED = """adj AS (SELECT s.track_id, idx, greatest(start_time, 0) AS start_time, least(end_time, duration) AS end_time, label, duration FROM sections_gap s JOIN user_tracks USING (track_id) WHERE end_time > 0 AND start_time < duration),
    ends AS (SELECT track_id, min(start_time) AS lo, max(end_time) AS hi, min(idx) AS f, max(idx) AS l, any_value(duration) AS duration FROM adj GROUP BY track_id),
    timeline AS (SELECT track_id, idx, start_time, end_time, label FROM adj UNION ALL SELECT track_id, f - 1, 0, lo, '__T_MIN' FROM ends WHERE lo > 0 UNION ALL SELECT track_id, l + 1, hi, duration, '__T_MAX' FROM ends WHERE hi < duration)"""


@query("t10_adjust_timeline", f"WITH {_ADJUSTED} SELECT track_id, {SECTIONS_SQL} FROM timeline")
def _(spark, d):
    return sections(T.adjust_timeline(W.sections_gap(spark, d), W.user_tracks(spark, d)))


_ASSIGNED = f"""{_ADJUSTED}, ahead AS (SELECT *, lead(label) OVER (PARTITION BY track_id ORDER BY idx) AS nxt FROM timeline),
    assigned AS (SELECT g.track_id, g.idx, CASE WHEN g.start_time >= a.end_time AND nxt IS NOT NULL THEN nxt ELSE a.label END AS label FROM grid g ASOF JOIN ahead a ON g.track_id = a.track_id AND g.start_time >= a.start_time)"""


@query("t11_assign_points", f"WITH {_ASSIGNED} SELECT track_id, idx, label FROM assigned")
def _(spark, d):
    timeline = T.adjust_timeline(W.sections_gap(spark, d), W.user_tracks(spark, d))
    return T.assign_points(W.grid(spark, d), timeline).select("track_id", "idx", "label")


_CANDIDATES = "cand AS (SELECT track_id, label, row_number() OVER (PARTITION BY track_id ORDER BY min(idx)) - 1 AS label_idx FROM sections_gap GROUP BY track_id, label)"


@query("t12_encode_timeline", f"WITH {_ASSIGNED}, {_CANDIDATES} SELECT a.track_id, a.idx, CAST(coalesce(label_idx, -100) AS BIGINT) AS target FROM assigned a LEFT JOIN cand USING (track_id, label)")
def _(spark, d):
    s = W.sections_gap(spark, d)
    timeline = T.adjust_timeline(s, W.user_tracks(spark, d))
    return T.encode_timeline(T.assign_points(W.grid(spark, d), timeline), T.candidate_labels(s)).select("track_id", "idx", F.col("target").cast("long").alias("target"))


@query("t13_candidate_labels", f"WITH {_CANDIDATES} SELECT track_id, label, CAST(label_idx AS BIGINT) AS label_idx FROM cand")
def _(spark, d):
    return T.candidate_labels(W.sections_gap(spark, d)).select("track_id", "label", F.col("label_idx").cast("long").alias("label_idx"))


@query("t14_base_targets", f"""WITH c AS (SELECT track_id, label, row_number() OVER (PARTITION BY track_id ORDER BY min(idx)) - 1 AS label_idx FROM sections_num GROUP BY track_id, label), b AS (SELECT *, {base_sql('label')} AS base FROM c),
    f AS (SELECT *, min(label_idx) OVER (PARTITION BY track_id, base) AS a FROM b), k AS (SELECT *, dense_rank() OVER (PARTITION BY track_id ORDER BY a) - 1 AS base_target FROM f)
    SELECT s.track_id, CAST(s.idx AS BIGINT) AS idx, CAST(label_idx AS BIGINT) AS target, CAST(base_target AS BIGINT) AS base_target FROM sections_num s JOIN k USING (track_id, label)""")
def _(spark, d):
    s = W.sections_num(spark, d)
    c = T.candidate_labels(s)
    rows = T.encode_timeline(s, c)
    return T.base_targets(rows, c).select("track_id", F.col("idx").cast("long").alias("idx"), F.col("target").cast("long").alias("target"), F.col("base_target").cast("long").alias("base_target"))


@query("t15_segment_targets", "WITH t AS (SELECT *, CASE WHEN target <> -100 AND coalesce(lag(target) OVER w <> target, true) THEN 1 ELSE 0 END AS ch FROM frames WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx)) SELECT track_id, frame_idx, CAST(CASE WHEN target = -100 THEN -100 ELSE sum(ch) OVER (PARTITION BY track_id ORDER BY frame_idx) - 1 END AS BIGINT) AS segment_target FROM t")
def _(spark, d):
    return T.segment_targets(W.frames(spark, d), order="frame_idx").select("track_id", "frame_idx", F.col("segment_target").cast("long").alias("segment_target"))


@query("t16_training_examples", f"""WITH named AS (SELECT *, 'part ' || CAST(target AS VARCHAR) AS label FROM frames), {runs_sql("merged", "named", "track_id")}, tracks AS (SELECT track_id, max(end_time) AS hi, max(end_time) + 1.0 AS duration FROM merged GROUP BY track_id),
    timeline AS (SELECT track_id, idx, start_time, end_time, label FROM merged UNION ALL SELECT track_id, 1000000, hi, duration, '__T_MAX' FROM tracks), ahead AS (SELECT *, lead(label) OVER (PARTITION BY track_id ORDER BY idx) AS nxt FROM timeline),
    spans AS (SELECT track_id, CAST(i AS BIGINT) AS idx, i * 0.8::DOUBLE AS start_time FROM tracks, range(1000) AS x(i) WHERE i < ceil(duration / 0.8)),
    assigned AS (SELECT g.track_id, g.idx, CASE WHEN g.start_time >= a.end_time AND nxt IS NOT NULL THEN nxt ELSE a.label END AS label FROM spans g ASOF JOIN ahead a ON g.track_id = a.track_id AND g.start_time >= a.start_time),
    cand AS (SELECT track_id, label, row_number() OVER (PARTITION BY track_id ORDER BY min(idx)) - 1 AS target, {base_sql("label")} AS base FROM merged GROUP BY track_id, label), based AS (SELECT *, dense_rank() OVER (PARTITION BY track_id ORDER BY a) - 1 AS base_target FROM (SELECT *, min(target) OVER (PARTITION BY track_id, base) AS a FROM cand)),
    coded AS (SELECT a.track_id, idx, a.label, coalesce(target, -100) AS target, coalesce(base_target, -100) AS base_target FROM assigned a LEFT JOIN based b ON a.track_id = b.track_id AND a.label = b.label),
    cut AS (SELECT *, CASE WHEN target <> -100 AND coalesce(lag(target) OVER (PARTITION BY track_id ORDER BY idx) <> target, true) THEN 1 ELSE 0 END AS new FROM coded)
    SELECT track_id, idx, label, CAST(target AS BIGINT) AS target, CAST(base_target AS BIGINT) AS base_target, CAST(CASE WHEN target = -100 THEN -100 ELSE sum(new) OVER (PARTITION BY track_id ORDER BY idx) - 1 END AS BIGINT) AS segment_target, CAST(64 AS INTEGER) AS dim FROM cut""")
def _(spark, d):
    f = W.frames(spark, d).select("track_id", "frame_idx", "time", "vec")
    s = D.merge_frames(W.frames(spark, d).withColumn("label", F.concat(F.lit("part "), F.col("target").cast("string"))))
    tracks = s.groupBy("track_id").agg((F.max("end_time") + 1.0).alias("duration"))
    beats = T.uniform_beats(tracks, 0.8)
    out = T.training_examples(f, beats, tracks, s)
    return out.select("track_id", "idx", "label", *[F.col(c).cast("long").alias(c) for c in ("target", "base_target", "segment_target")], F.size("vec").alias("dim"))


@query("t16_examples_by_overlap", f"""WITH f AS (SELECT *, 'part ' || CAST(target AS VARCHAR) AS label FROM frames WHERE frame_idx % 7 <> 0), g AS (SELECT track_id, CAST(i AS BIGINT) AS idx, i * 0.8::DOUBLE AS s, (i + 1) * 0.8::DOUBLE AS e FROM (SELECT DISTINCT track_id FROM f), range(30) AS x(i)),
    o AS (SELECT g.track_id, g.idx, f.label, least(g.e, f.end_time) - greatest(g.s, f.start_time) AS o, f.frame_idx FROM g JOIN f ON f.track_id = g.track_id AND g.s < f.end_time AND f.start_time < g.e QUALIFY row_number() OVER (PARTITION BY g.track_id, g.idx ORDER BY o DESC, frame_idx) = 1)
    SELECT track_id, idx, coalesce(label, '__T_MIN') AS label FROM g LEFT JOIN o USING (track_id, idx)""")
def _(spark, d):
    f = W.frames(spark, d)
    s = f.where("frame_idx % 7 <> 0").select("track_id", F.col("frame_idx").alias("idx"), "start_time", "end_time", F.concat(F.lit("part "), F.col("target").cast("string")).alias("label"))
    tracks = f.select("track_id").distinct().withColumn("duration", F.lit(30 * 0.8))
    out = T.training_examples(f.select("track_id", "frame_idx", "time", "vec"), T.uniform_beats(tracks, 0.8), tracks, s, assignment="max_overlap")
    return out.select("track_id", "idx", "label")


# --- vocabularies, validation, splits ---------------------------------------------------------------------------------


@query("v01_first_seen", f"WITH {_CANDIDATES} SELECT track_id, label, CAST(label_idx AS BIGINT) AS label_idx FROM cand")
def _(spark, d):
    return O.first_seen(W.sections_gap(spark, d), ["track_id"], "label", "idx").select("track_id", "label", F.col("label_idx").cast("long").alias("label_idx"))


@query("v02_vocabulary", "WITH s AS (SELECT CAST(track_id % 3 AS BIGINT) AS dataset, * FROM sections_gap), f AS (SELECT dataset, label, row_number() OVER (PARTITION BY dataset ORDER BY min({'t': track_id, 'i': idx})) - 1 AS label_idx FROM s GROUP BY dataset, label) SELECT dataset, label, CAST(label_idx AS BIGINT) AS label_idx FROM f UNION ALL SELECT dataset, 'silence', max(label_idx) + 1 FROM f GROUP BY dataset")
def _(spark, d):
    s = W.sections_gap(spark, d).withColumn("dataset", F.col("track_id") % 3)
    return O.vocabulary(s, ["dataset"], "track_id", "idx").select("dataset", "label", F.col("label_idx").cast("long").alias("label_idx"))


@query("v03_encode_labels", f"WITH v AS (SELECT DISTINCT label FROM raw_labels) SELECT label, {_READ} AS text_label, 'Music structure label: ' || {_READ} AS prompt FROM v")
def _(spark, d):
    # as the result of an aggregate, as conditions on a grouping column are evaluated before it, on each part
    v = W.raw_labels(spark, d).groupBy("label").agg(F.max("label").alias("_label")).select(F.col("_label").alias("label"), F.lit("parts").alias("dataset"))
    return O.encode_labels(v, ["dataset"], "generic", mode="compact").where(F.size("vec") == 16).select("label", "text_label", "prompt")


@query("v04_filter_tracks", "SELECT track_id FROM sections_nf GROUP BY track_id HAVING count(DISTINCT label) FILTER (label NOT IN ('silence', 'no_function')) >= 3 AND count(*) >= 60")
def _(spark, d):
    return O.filter_tracks(W.sections_nf(spark, d), min_useful_labels=3, min_segments=60, ignore=("Silence", "no-function"))


_VALID = "v AS (SELECT track_id, count(*) AS n, max(end_time) AS duration, count(*) FILTER (label = '') AS bad FROM (SELECT * REPLACE (CASE WHEN event_id % 997 = 0 THEN '' ELSE label END AS label) FROM sections_a) GROUP BY track_id)"


def _validated(spark, d):
    s = W.sections_a(spark, d).withColumn("label", F.when(F.col("event_id") % 997 == 0, "").otherwise(F.col("label")))
    return O.validate_tracks(W.user_tracks(spark, d).select("track_id"), s)


@query("v05_validate_tracks", f"WITH {_VALID} SELECT track_id, bad = 0 AS valid, n AS num_sections, round(duration, 6) AS duration, CAST(bad AS BIGINT) AS n_errors FROM v")
def _(spark, d):
    return _validated(spark, d).select("track_id", "valid", "num_sections", r("duration"), F.size("errors").cast("long").alias("n_errors"))


@query("v06_summary", f"WITH {_VALID} SELECT count(*) AS num_tracks, count(*) FILTER (bad = 0) AS num_valid_tracks, count(*) FILTER (bad > 0) AS num_invalid_tracks, CAST(sum(n) FILTER (bad = 0) AS BIGINT) AS num_sections, round(sum(duration) FILTER (bad = 0), 3) AS duration FROM v")
def _(spark, d):
    return O.summarize_validation(_validated(spark, d)).select("num_tracks", "num_valid_tracks", "num_invalid_tracks", "num_sections", r("duration", 3))


@query("v07_top_labels", f"WITH {_VALID} SELECT label, count(*) AS n FROM sections_a WHERE track_id IN (SELECT track_id FROM v WHERE bad = 0) GROUP BY label ORDER BY n DESC, label LIMIT 20")
def _(spark, d):
    return O.top_labels(O.label_counts(_validated(spark, d)))


@query("r01_split_tracks", "WITH n AS (SELECT count(*) AS n FROM document_tracks), k AS (SELECT n, round_even(n * 0.15, 0) AS v, round_even(n * 0.05, 0) AS t FROM n), o AS (SELECT track_id, row_number() OVER (ORDER BY manifest_ord, track_id) - 1 AS a FROM document_tracks) SELECT track_id, CASE WHEN a < n - v - t THEN 'train' WHEN a < n - t THEN 'val' ELSE 'test' END AS split FROM o, k")
def _(spark, d):
    return O.split_tracks(W.document_tracks(spark, d), 0.8, 0.15, 0.05, shuffle=False).select("track_id", "split")


@query("r01_split_shuffled", f"WITH k AS (SELECT track_id, row_number() OVER (ORDER BY {_DRAW.format("'3:' || track_id")}, track_id) - 1 AS a, count(*) OVER () AS n FROM document_tracks), c AS (SELECT *, round_even(n * 0.15, 0) AS v, round_even(n * 0.05, 0) AS t FROM k) SELECT track_id, CASE WHEN a < n - v - t THEN 'train' WHEN a < n - t THEN 'val' ELSE 'test' END AS split FROM c")
def _(spark, d):
    return O.split_tracks(W.document_tracks(spark, d), 0.8, 0.15, 0.05, seed=3).select("track_id", "split")


@query("r03_sample_frames", "WITH c AS (SELECT track_id, idx, count(*) OVER (PARTITION BY track_id) AS n, row_number() OVER (PARTITION BY track_id ORDER BY idx) - 1 AS a FROM sections_a), s AS (SELECT DISTINCT track_id, round_even(i * (n - 1) / 39.0, 0) AS a FROM (SELECT DISTINCT track_id, n FROM c WHERE n > 40), range(40) AS x(i)) SELECT c.track_id, CAST(idx AS BIGINT) AS idx FROM c LEFT JOIN s USING (track_id, a) WHERE n <= 40 OR s.track_id IS NOT NULL")
def _(spark, d):
    return O.sample_frames(W.sections_a(spark, d), 40, order="idx").select("track_id", F.col("idx").cast("long").alias("idx"))


@query("r04_first_tracks", "SELECT track_id FROM document_tracks ORDER BY manifest_ord LIMIT 25")
def _(spark, d):
    return O.first_tracks(W.document_tracks(spark, d), 25).select("track_id")


# --- scores and decoding ----------------------------------------------------------------------------------------------


@query("d01_score_frames", "WITH u AS (SELECT track_id, frame_idx, vec, sqrt(list_dot_product(vec, vec)) AS n FROM frames), l AS (SELECT label_idx, vec AS lv, sqrt(list_dot_product(vec, vec)) AS ln FROM label_vectors) SELECT track_id, frame_idx, CAST(row_number() OVER (PARTITION BY track_id, frame_idx ORDER BY label_idx) - 1 AS INTEGER) AS k, round(list_dot_product(vec, lv) / (n * ln) / 0.07, 4) AS score FROM u, l")
def _(spark, d):
    return D.score_frames(W.frames(spark, d).select("track_id", "frame_idx", "vec"), W.label_vectors(spark, d)).select("track_id", "frame_idx", F.posexplode("scores").alias("k", "score")).select("track_id", "frame_idx", "k", r("score", 4))


@query("d01_projected_frames", "SELECT track_id, frame_idx, CAST(j AS INTEGER) AS j, round(list_sum(list_transform(range(1, 65), lambda i: vec[i] * (((i - 1) * 7 + j * 3) % 5 - 2) / 10.0)) + j * 0.1, 5) AS x FROM frames, range(3) AS x(j)")
def _(spark, d):
    import numpy as np

    rows, columns = np.arange(64)[:, None], np.arange(3)[None, :]
    out = D.project(W.frames(spark, d).select("track_id", "frame_idx", "vec"), [(((rows * 7 + columns * 3) % 5 - 2) / 10.0, np.arange(3) * 0.1)])
    return out.select("track_id", "frame_idx", F.posexplode("vec").alias("j", "x")).select("track_id", "frame_idx", "j", r("x", 5))


@query("d02_frame_confidence", "WITH e AS (SELECT track_id, frame_idx, list_transform(scores, lambda x: exp(x - list_max(scores))) AS e FROM frames) SELECT track_id, frame_idx, round(1.0 / list_sum(e), 6) AS confidence FROM e")
def _(spark, d):
    return D.frame_confidence(W.frames(spark, d)).select("track_id", "frame_idx", r("confidence"))


def _smooth_sql(agg: str) -> str:
    return f"WITH c AS (SELECT track_id, frame_idx, k, scores[k] AS x FROM frames, range(1, 11) AS a(k)), b AS (SELECT track_id, max(frame_idx) AS hi FROM frames GROUP BY track_id), w AS (SELECT c.track_id, c.frame_idx, c.k, greatest(0, least(hi, c.frame_idx + o)) AS f FROM c JOIN b USING (track_id), range(-3, 4) AS a(o)) SELECT w.track_id, w.frame_idx, CAST(w.k - 1 AS INTEGER) AS k, round({agg}(c.x), 6) AS score FROM w JOIN c ON c.track_id = w.track_id AND c.k = w.k AND c.frame_idx = w.f GROUP BY ALL"


def _cells(df):
    return df.select("track_id", "frame_idx", F.posexplode("scores").alias("k", "score")).select("track_id", "frame_idx", "k", r("score"))


@query("d03_smooth_mean", _smooth_sql("avg"))
def _(spark, d):
    return _cells(D.smooth_scores(W.frames(spark, d), 7))


@query("d03_smooth_median", _smooth_sql("median"))
def _(spark, d):
    return _cells(D.smooth_scores(W.frames(spark, d), 7, "median"))


@query("d04_argmax", "SELECT track_id, frame_idx, CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS label_idx FROM frames")
def _(spark, d):
    return D.decode_argmax(W.frames(spark, d)).select("track_id", "frame_idx", "label_idx")


@query("d05_viterbi", f"""WITH RECURSIVE given AS (SELECT track_id, CAST(frame_idx AS BIGINT) AS frame_idx, scores, 0.0::DOUBLE AS stay, -0.3::DOUBLE AS change FROM frames), {path_sql("best", "given", "track_id")}
    SELECT track_id, CAST(unnest(range(len(path))) AS INTEGER) AS frame_idx, CAST(unnest(path) AS INTEGER) AS label_idx FROM best""")
def _(spark, d):
    return D.decode_viterbi(W.frames(spark, d), penalty=0.3).select("track_id", "frame_idx", "label_idx")


@query("d05_long_tracks", """WITH RECURSIVE given AS MATERIALIZED (SELECT track_id, list(scores ORDER BY frame_idx) AS s FROM long_frames GROUP BY track_id),
    f AS (SELECT track_id, frame_idx AS t, scores AS best, [0, 0, 0] AS back FROM long_frames WHERE frame_idx = 0
          UNION ALL
          SELECT track_id, t + 1, list_transform([1, 2, 3], lambda j: list_max(list_transform([1, 2, 3], lambda i: best[i] - CASE WHEN i = j THEN 0 ELSE 20 END)) + x[j]),
                 list_transform([1, 2, 3], lambda j: CAST(list_position(list_transform([1, 2, 3], lambda i: best[i] - CASE WHEN i = j THEN 0 ELSE 20 END), list_max(list_transform([1, 2, 3], lambda i: best[i] - CASE WHEN i = j THEN 0 ELSE 20 END))) AS INTEGER))
          FROM (SELECT f.*, g.s[t + 2] AS x FROM f JOIN given g USING (track_id)) WHERE x IS NOT NULL),
    w AS MATERIALIZED (SELECT track_id, list(back ORDER BY t) AS b, CAST(list_position(last(best ORDER BY t), list_max(last(best ORDER BY t))) AS INTEGER) AS fin FROM f GROUP BY track_id),
    p AS (SELECT track_id, CAST(len(b) AS BIGINT) AS t, fin AS k FROM w UNION ALL SELECT track_id, t - 1, w.b[t][k] FROM p JOIN w USING (track_id) WHERE t > 1)
    SELECT track_id, CAST(t - 1 AS INTEGER) AS frame_idx, CAST(k - 1 AS INTEGER) AS label_idx FROM p""")
def _(spark, d):
    return D.decode_viterbi(W.long_frames(spark, d), penalty=20.0).select("track_id", "frame_idx", "label_idx")


@query("d06_merge_frames", "WITH t AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY track_id ORDER BY frame_idx) = label THEN 0 ELSE 1 END AS ch FROM turns), u AS (SELECT *, sum(ch) OVER (PARTITION BY track_id ORDER BY frame_idx) - 1 AS island FROM t) SELECT track_id, CAST(island AS BIGINT) AS idx, arg_min(start_time, frame_idx) AS start_time, arg_max(end_time, frame_idx) AS end_time, any_value(label) AS label FROM u GROUP BY track_id, island")
def _(spark, d):
    return D.merge_frames(W.turns(spark, d)).select("track_id", F.col("idx").cast("long").alias("idx"), "start_time", "end_time", "label")


@query("d07_boundary_times", "SELECT track_id, CAST(idx AS BIGINT) AS idx, (start_time + n) / 2 AS time FROM (SELECT *, lead(start_time) OVER (PARTITION BY track_id ORDER BY idx) AS n FROM sections_a) WHERE n IS NOT NULL")
def _(spark, d):
    return D.boundary_times(W.sections_a(spark, d), order="idx").select("track_id", F.col("idx").cast("long").alias("idx"), "time")


_PROBS = "probs AS (SELECT track_id, frame_idx, 1 / (1 + exp(-scores[1])) AS p FROM frames QUALIFY frame_idx < max(frame_idx) OVER (PARTITION BY track_id))"
_MASK = "mask AS (SELECT track_id, frame_idx, p >= 0.5 AND (coalesce(p > lag(p) OVER w AND p > lead(p) OVER w, false) OR count(*) OVER (PARTITION BY track_id) = 1) AS split FROM probs WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx))"


def _probabilities(spark, d):
    f = W.frames(spark, d)
    last = f.groupBy("track_id").agg(F.max("frame_idx").alias("hi"))
    return f.join(last, "track_id").where("frame_idx < hi").select("track_id", "frame_idx", V.sigmoid(F.col("scores")[0]).alias("probability"))


@query("d08_split_mask", f"WITH {_PROBS}, {_MASK} SELECT * FROM mask")
def _(spark, d):
    return D.split_mask(_probabilities(spark, d)).select("track_id", "frame_idx", "split")


@query("d09_merge_with_boundaries", f"""WITH {_PROBS}, {_MASK}, f AS (SELECT f.track_id, f.frame_idx, f.start_time, f.end_time, CAST(f.target AS VARCHAR) AS label, coalesce(m.split, false) AS split FROM frames f LEFT JOIN mask m ON m.track_id = f.track_id AND m.frame_idx + 1 = f.frame_idx),
    g AS (SELECT *, coalesce(lag(label) OVER w <> label, true) AS new, lag(start_time) OVER w AS before FROM f WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx)), h AS (SELECT *, sum(CASE WHEN new OR split THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame_idx) - 1 AS island, CASE WHEN new THEN start_time ELSE least((before + start_time) / 2, end_time) END AS cut FROM g),
    p AS (SELECT track_id, island, arg_min(cut, frame_idx) AS start_time, arg_max(end_time, frame_idx) AS fin, any_value(label) AS label FROM h GROUP BY ALL), q AS (SELECT *, coalesce(lead(start_time) OVER (PARTITION BY track_id ORDER BY island), fin) AS end_time FROM p)
    SELECT track_id, CAST(island AS BIGINT) AS idx, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, label FROM q WHERE end_time > start_time""")
def _(spark, d):
    f = W.frames(spark, d).withColumn("label", F.col("target").cast("string"))
    return sections(D.merge_with_boundaries(f, _probabilities(spark, d)))


@query("d10_remove_short", f"""WITH RECURSIVE named AS (SELECT *, CAST(target AS VARCHAR) AS label FROM frames), {runs_sql("merged", "named", "track_id")}, {clean_sql("cleaned", "merged", "track_id", "1.5")}
    SELECT track_id, {SECTIONS_SQL} FROM cleaned""")
def _(spark, d):
    return sections(D.remove_short(D.merge_frames(W.frames(spark, d).withColumn("label", F.col("target").cast("string"))), 1.5))


@query("d11_boundary_predictions", "SELECT track_id, frame_idx, round(start_time + 0.25, 6) AS time, round(scores[1], 6) AS logit, round(1 / (1 + exp(-scores[1])), 6) AS probability FROM frames QUALIFY frame_idx < max(frame_idx) OVER (PARTITION BY track_id)")
def _(spark, d):
    return D.boundary_predictions(W.frames(spark, d).withColumn("boundary_logit", F.col("scores")[0])).select("track_id", "frame_idx", r("time"), r("logit"), r("probability"))


@query("d12_reference_segments", "WITH t AS (SELECT *, CASE WHEN target = -100 OR coalesce(lag(target) OVER w <> target, true) THEN 1 ELSE 0 END AS ch FROM frames WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx)), u AS (SELECT *, sum(ch) OVER (PARTITION BY track_id ORDER BY frame_idx) - 1 AS island FROM t) SELECT track_id, CAST(island AS BIGINT) AS idx, min(start_time) AS start_time, max(end_time) AS end_time, any_value(target) AS target FROM u WHERE target <> -100 GROUP BY track_id, island")
def _(spark, d):
    return D.reference_segments(W.frames(spark, d)).select("track_id", F.col("idx").cast("long").alias("idx"), "start_time", "end_time", "target")


_INFERRED = f"""{smooth_sql("smooth", 7, "mean")}, given AS (SELECT track_id, CAST(frame_idx AS BIGINT) AS frame_idx, scores, 0.0::DOUBLE AS stay, -0.3::DOUBLE AS change FROM smooth), {path_sql("best", "given", "track_id")},
    labelled AS (SELECT track_id, unnest(range(len(path))) AS frame_idx, CAST(unnest(path) AS VARCHAR) AS label FROM best), decoded AS (SELECT f.track_id, f.frame_idx, start_time, end_time, label FROM frames f JOIN labelled USING (track_id, frame_idx)), {runs_sql("inferred", "decoded", "track_id")}"""


@query("d13_infer_segments", f"WITH RECURSIVE {_INFERRED} SELECT track_id, {SECTIONS_SQL} FROM inferred")
def _(spark, d):
    return sections(D.infer_segments(W.frames(spark, d), penalty=0.3))


@query("d13_infer_cleaned", f"WITH RECURSIVE {_INFERRED}, {clean_sql('cleaned', 'inferred', 'track_id', '4.0')} SELECT track_id, {SECTIONS_SQL} FROM cleaned")
def _(spark, d):
    return sections(D.infer_segments(W.frames(spark, d), penalty=0.3, least=4.0))


def _grid_results(spark, d):
    f = W.frames(spark, d).withColumn("boundary", V.sigmoid(F.col("scores")[0]))
    ref = D.reference_segments(f).withColumn("label", F.col("target").cast("string"))
    return D.grid_search(f, ref, sizes=(1, 5, 9), modes=("mean", "median"), penalties=(0.0, 0.2, 0.5), least=(0.0, 1.5), decoders=("viterbi", "argmax"), weights=(0.0, 0.2), eps_values=(1e-4, 1e-2), boundary="boundary")


_REFERENCE = "reference AS (SELECT track_id, CAST(run AS BIGINT) AS idx, min(start_time) AS start_time, max(end_time) AS end_time, CAST(any_value(target) AS VARCHAR) AS label FROM (SELECT *, sum(ch) OVER (PARTITION BY track_id ORDER BY frame_idx) - 1 AS run FROM (SELECT *, CASE WHEN target = -100 OR coalesce(lag(target) OVER w <> target, true) THEN 1 ELSE 0 END AS ch FROM frames WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx))) WHERE target <> -100 GROUP BY track_id, run)"
_MODES = [(size, mode) for size in (1, 5, 9) for mode in ("mean", "median")]
_SETTING = "win, mode, decoder, penalty, weight, eps, least"
_METRICS = ("f05", "f30", "pairwise_f", "nce_f", "segments")
#: Settings that differ in what the decoder does not use are decoded once (sid), as their tables are the same.
_GRID = f"""{", ".join(smooth_sql(f"smooth_{size}_{mode}", size, mode) for size, mode in _MODES)},
    smooth AS ({" UNION ALL ".join(f"SELECT {size} AS win, '{mode}' AS mode, * FROM smooth_{size}_{mode}" for size, mode in _MODES)}),
    settings AS (SELECT *, dense_rank() OVER (ORDER BY win, mode, decoder, CASE WHEN decoder = 'viterbi' THEN penalty END, CASE WHEN decoder = 'viterbi' THEN weight END, CASE WHEN decoder = 'viterbi' AND weight > 0 THEN eps END) AS sid
                 FROM (SELECT unnest([1, 5, 9]) AS win), (SELECT unnest(['mean', 'median']) AS mode), (SELECT unnest(['viterbi', 'argmax']) AS decoder), (SELECT unnest([0.0, 0.2, 0.5]::DOUBLE[]) AS penalty), (SELECT unnest([0.0, 0.2]::DOUBLE[]) AS weight), (SELECT unnest([1e-4, 1e-2]::DOUBLE[]) AS eps), (SELECT unnest([0.0, 1.5]::DOUBLE[]) AS least)),
    distinct_settings AS (SELECT sid, any_value(win) AS win, any_value(mode) AS mode, any_value(decoder) AS decoder, min(penalty) AS penalty, min(weight) AS weight, min(eps) AS eps FROM settings GROUP BY sid),
    prior AS (SELECT track_id, frame_idx, 1 / (1 + exp(-scores[1])) AS b FROM frames),
    given AS (SELECT sid, track_id, CAST(frame_idx AS BIGINT) AS frame_idx, scores, CASE WHEN weight > 0 THEN weight * ln(1 - greatest(eps, least(1 - eps, b))) ELSE 0 END AS stay, -penalty + CASE WHEN weight > 0 THEN weight * ln(greatest(eps, least(1 - eps, b))) ELSE 0 END AS change
              FROM distinct_settings JOIN smooth USING (win, mode) JOIN prior USING (track_id, frame_idx) WHERE decoder = 'viterbi'),
    {path_sql("best", "given", "sid, track_id")},
    labelled AS (SELECT sid, track_id, unnest(range(len(path))) AS frame_idx, unnest(path) AS k FROM best
                 UNION ALL SELECT sid, track_id, frame_idx, list_position(scores, list_max(scores)) - 1 FROM distinct_settings JOIN smooth USING (win, mode) WHERE decoder = 'argmax'),
    decoded AS (SELECT sid, l.track_id, l.frame_idx, start_time, end_time, CAST(k AS VARCHAR) AS label FROM labelled l JOIN frames f ON f.track_id = l.track_id AND f.frame_idx = l.frame_idx),
    {runs_sql("merged", "decoded", "sid, track_id")},
    by_least AS (SELECT m.*, least FROM merged m, (SELECT unnest([0.0, 1.5]::DOUBLE[]) AS least)), {clean_sql("cleaned", "by_least", "sid, least, track_id", "least").replace("any_value(least) AS least, 0 AS step", "0 AS step").replace("SELECT sid, least, track_id, least, unnest", "SELECT sid, least, track_id, unnest").replace("s[hi + 1:]), least, step", "s[hi + 1:]), step")},
    {_REFERENCE}, wanted AS (SELECT r.*, sid, least FROM reference r, (SELECT DISTINCT sid, least FROM settings)),
    {evaluate_sql("wanted", "cleaned", "sid, least, track_id").split(", chance AS")[0].split("chance AS")[0].rstrip().rstrip(",")},
    scored AS (SELECT s.sid, s.least, s.track_id, any_value(h.f) FILTER (h.size = 0.5) AS f05, any_value(h.f) FILTER (h.size = 3.0) AS f30, any_value(coalesce(p.ff, 0)) AS pairwise_f, any_value(coalesce(e.nce_f, 0)) AS nce_f, any_value(s.n) AS segments
               FROM (SELECT sid, least, track_id, count(*) AS n FROM cleaned GROUP BY ALL) s JOIN hits h USING (sid, least, track_id) LEFT JOIN pairwise p USING (sid, least, track_id) LEFT JOIN entropies e USING (sid, least, track_id) GROUP BY ALL),
    means AS (SELECT sid, least, count(*) AS num_tracks, {", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std" for m in _METRICS)} FROM scored GROUP BY ALL),
    results AS (SELECT win AS "window", mode, decoder, penalty, weight, eps, least, num_tracks, {", ".join(f"{m}_mean, {m}_std" for m in _METRICS)} FROM settings JOIN means USING (sid, least))"""


def _rounded(results: DataFrame) -> DataFrame:
    return results.select(*D.SETTING, "num_tracks", *[r(f"{m}_{x}") for m in _METRICS for x in ("mean", "std")])


@query("d14_grid_search", f"WITH RECURSIVE {_GRID} SELECT * FROM results")
def _(spark, d):
    return _rounded(_grid_results(spark, d))


@query("d15_top_settings", f'WITH RECURSIVE {_GRID} SELECT * FROM results ORDER BY f30_mean DESC, "window", mode, decoder, penalty, weight, eps, least LIMIT 3')
def _(spark, d):
    return _rounded(D.top_settings(_grid_results(spark, d), 3))


# --- evaluation -------------------------------------------------------------------------------------------------------

_PAIR = """ends AS (SELECT track_id, greatest(max(a), max(b)) AS duration FROM (SELECT track_id, arg_max(end_time, idx) AS a, NULL AS b FROM merged_a GROUP BY track_id UNION ALL SELECT track_id, NULL, arg_max(end_time, idx) FROM merged_b GROUP BY track_id) GROUP BY track_id HAVING count(a) > 0 AND count(b) > 0),
    {0}_c AS (SELECT s.track_id, idx, greatest(start_time, 0) AS start_time, least(end_time, duration) AS end_time, label, duration FROM merged_{1} s JOIN ends USING (track_id) WHERE end_time > 0 AND start_time < duration),
    {0}_e AS (SELECT track_id, min(start_time) AS lo, max(end_time) AS hi, min(idx) AS f, max(idx) AS l, any_value(duration) AS duration FROM {0}_c GROUP BY track_id),
    {0} AS (SELECT track_id, idx, start_time, end_time, label FROM {0}_c UNION ALL SELECT track_id, f - 1, 0, lo, '__T_MIN' FROM {0}_e WHERE lo > 0 UNION ALL SELECT track_id, l + 1, hi, duration, '__T_MAX' FROM {0}_e WHERE hi < duration)"""
_BOTH = _PAIR.format("refs", "a") + ", " + _PAIR.format("ests", "b").split("\n", 1)[1].strip()
_CELLS = _BOTH + """, pts AS (SELECT track_id, k * 3600.0 AS t FROM ends, range(100000) AS x(k) WHERE k < floor(round(duration / 3600.0, 6))),
    pr AS (SELECT p.track_id, p.t, r.label AS ref FROM pts p ASOF JOIN refs r ON p.track_id = r.track_id AND p.t >= r.start_time),
    pe AS (SELECT p.*, e.label AS est FROM pr p ASOF JOIN ests e ON p.track_id = e.track_id AND p.t >= e.start_time),
    cells AS (SELECT track_id, ref, est, count(*) AS n FROM pe GROUP BY ALL),
    mg AS (SELECT *, sum(n) OVER (PARTITION BY track_id, ref) AS a, sum(n) OVER (PARTITION BY track_id, est) AS b, sum(n) OVER (PARTITION BY track_id) AS total, row_number() OVER (PARTITION BY track_id, ref ORDER BY est) = 1 AS r1, row_number() OVER (PARTITION BY track_id, est ORDER BY ref) = 1 AS e1 FROM cells)"""


def _pair(spark, d):
    return P.merge_consecutive(W.sections_a(spark, d)), P.merge_consecutive(W.sections_b(spark, d))


def _pair_cells(spark, d):
    ref, est, ends = E.adjust_pair(*_pair(spark, d))
    return E.contingency(ref, est, ends, step=3600.0)


_NAMES = {"pp": "pairwise_precision", "rr": "pairwise_recall", "ff": "pairwise_f", "rand": "rand", "ari": "adjusted_rand"}
_ENTROPIES = {"o": "nce_over", "u": "nce_under", "nce_f": "nce_f", "vo": "v_precision", "vu": "v_recall", "v_measure": "v_measure", "mi": "mutual_information", "nmi": "normalized_mutual_information"}
_EVALUATED = f"""SELECT h.track_id, {", ".join(f"round(any_value(h.{x}) FILTER (size = {s}), 6) AS {n}_{t}" for s, t in (("0.5", "0_5"), ("3.0", "3")) for x, n in (("p", "precision"), ("r", "recall"), ("f", "f")))},
    any_value(round(re, 6)) AS ref_to_est, any_value(round(er, 6)) AS est_to_ref, {", ".join(f"any_value(round(pairwise.{x}, 6)) AS {n}" for x, n in _NAMES.items())}, {", ".join(f"any_value(round(entropies.{x}, 6)) AS {n}" for x, n in _ENTROPIES.items())}, any_value(round(ami, 6)) AS adjusted_mutual_information
    FROM hits h LEFT JOIN deviation USING (track_id) LEFT JOIN pairwise USING (track_id) LEFT JOIN entropies USING (track_id) LEFT JOIN information USING (track_id) GROUP BY h.track_id"""


def _evaluated(scores: DataFrame) -> DataFrame:
    return scores.select("track_id", *[r(c) for c in scores.columns if c != "track_id"])


@query("e01_evaluate", f"""WITH RECURSIVE {_REFERENCE}, {smooth_sql("smooth", 5, "mean", ", start_time, end_time")}, decoded AS (SELECT *, CAST(list_position(scores, list_max(scores)) - 1 AS VARCHAR) AS label FROM smooth), {runs_sql("estimate", "decoded", "track_id")},
    {evaluate_sql("reference", "estimate", "track_id")} {_EVALUATED}""")
def _(spark, d):
    f = W.frames(spark, d)
    ref = D.reference_segments(f).withColumn("label", F.col("target").cast("string"))
    est = D.merge_frames(D.decode_argmax(D.smooth_scores(f, 5)).withColumn("label", F.col("label_idx").cast("string")))
    return _evaluated(E.evaluate(ref, est))


@query("e02_evaluate_predictions", f"WITH RECURSIVE {_REFERENCE}, {_INFERRED}, {evaluate_sql('reference', 'inferred', 'track_id')} {_EVALUATED}")
def _(spark, d):
    f = W.frames(spark, d)
    ref = D.reference_segments(f).withColumn("label", F.col("target").cast("string"))
    est = D.infer_segments(f, penalty=0.3)
    return _evaluated(E.evaluate_predictions(ref, est, f.select("track_id").distinct()))


@query("e03_boundary_hits", f"""WITH {_BOTH}, rt AS (SELECT track_id, list_sort(list_distinct(list(round(start_time, 5)) || list(round(end_time, 5)))) AS r FROM refs GROUP BY track_id),
    et AS (SELECT track_id, list_sort(list_distinct(list(round(start_time, 5)) || list(round(end_time, 5)))) AS e FROM ests GROUP BY track_id),
    l AS (SELECT track_id, r[2:len(r) - 1] AS r, e[2:len(e) - 1] AS e, unnest([0.5, 3.0, 600.0]::DOUBLE[]) AS size FROM rt JOIN et USING (track_id)),
    h AS (WITH RECURSIVE walk AS (SELECT track_id, r, e, size, 1 AS i, 1 AS j, 0 AS hits FROM l
             UNION ALL
             SELECT track_id, r, e, size, CASE WHEN e[j] - r[i] >= -(size + 1e-9) THEN i + 1 ELSE i END, CASE WHEN e[j] - r[i] <= size + 1e-9 THEN j + 1 ELSE j END, CASE WHEN abs(e[j] - r[i]) <= size + 1e-9 THEN hits + 1 ELSE hits END FROM walk WHERE i <= len(r) AND j <= len(e))
        SELECT track_id, size, hits, coalesce(hits / nullif(len(e), 0), 0) AS p, coalesce(hits / nullif(len(r), 0), 0) AS q FROM walk WHERE i > len(r) OR j > len(e))
    SELECT track_id, size AS window, hits::BIGINT AS hits, p AS precision, q AS recall, CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END AS f FROM h""")
def _(spark, d):
    ref, est, _ = E.adjust_pair(*_pair(spark, d))
    return E.boundary_hits(ref, est, (0.5, 3.0, 600.0))


@query("e03_boundaries", f"WITH {_BOTH}, t AS (SELECT track_id, round(start_time, 5) AS t FROM refs UNION SELECT track_id, round(end_time, 5) FROM refs) SELECT track_id, round(t, 1) AS time FROM t QUALIFY t > min(t) OVER (PARTITION BY track_id) AND t < max(t) OVER (PARTITION BY track_id)")
def _(spark, d):
    ref, _, _ = E.adjust_pair(*_pair(spark, d))
    return E.boundaries(ref).select("track_id", r("time", 1))


@query("e04_boundary_deviation", f"""WITH {_BOTH}, rt AS (SELECT track_id, t FROM (SELECT track_id, round(start_time, 5) AS t FROM refs UNION SELECT track_id, round(end_time, 5) FROM refs) QUALIFY t > min(t) OVER (PARTITION BY track_id) AND t < max(t) OVER (PARTITION BY track_id)),
    et AS (SELECT track_id, t FROM (SELECT track_id, round(start_time, 5) AS t FROM ests UNION SELECT track_id, round(end_time, 5) FROM ests) QUALIFY t > min(t) OVER (PARTITION BY track_id) AND t < max(t) OVER (PARTITION BY track_id)),
    x AS (SELECT track_id, median(d) AS re FROM (SELECT rt.track_id, rt.t, min(abs(rt.t - et.t)) AS d FROM rt JOIN et USING (track_id) GROUP BY ALL) GROUP BY track_id), y AS (SELECT track_id, median(d) AS er FROM (SELECT et.track_id, et.t, min(abs(rt.t - et.t)) AS d FROM rt JOIN et USING (track_id) GROUP BY ALL) GROUP BY track_id)
    SELECT track_id, round(re, 4) AS ref_to_est, round(er, 4) AS est_to_ref FROM x JOIN y USING (track_id)""")
def _(spark, d):
    ref, est, _ = E.adjust_pair(*_pair(spark, d))
    return E.boundary_deviation(ref, est).select("track_id", r("ref_to_est", 4), r("est_to_ref", 4))


@query("e05_contingency", f"WITH {_CELLS} SELECT track_id, ref, est, n FROM cells")
def _(spark, d):
    return _pair_cells(spark, d)


@query("e06_pair_scores", f"""WITH {_CELLS}, s AS (SELECT track_id, sum(n * (n - 1) / 2.0) AS m, sum(a * (a - 1) / 2.0) FILTER (r1) AS a, sum(b * (b - 1) / 2.0) FILTER (e1) AS b, any_value(total * (total - 1) / 2.0) AS t FROM mg GROUP BY track_id), p AS (SELECT *, coalesce(m / nullif(b, 0), 0) AS pp, coalesce(m / nullif(a, 0), 0) AS rr FROM s)
    SELECT track_id, round(pp, 6) AS pairwise_precision, round(rr, 6) AS pairwise_recall, round(CASE WHEN pp + rr > 0 THEN 2 * pp * rr / (pp + rr) ELSE 0 END, 6) AS pairwise_f, round((2 * m + t - a - b) / t, 6) AS rand, round(coalesce((m - a * b / t) / nullif((a + b) / 2 - a * b / t, 0), 1), 6) AS adjusted_rand FROM p""")
def _(spark, d):
    s = E.pair_scores(_pair_cells(spark, d))
    return s.select("track_id", *[r(c) for c in s.columns[1:]])


@query("e07_entropy_scores", f"""WITH {_CELLS}, s AS (SELECT track_id, -sum(n / total * log2(n / a)) AS er, -sum(n / total * log2(n / b)) AS re, coalesce(-sum(a / total * log2(a / total)) FILTER (r1), 0) AS hr, coalesce(-sum(b / total * log2(b / total)) FILTER (e1), 0) AS he, count(*) FILTER (r1) AS kr, count(*) FILTER (e1) AS ke, sum(n / total * ln(n * total / (a * b))) AS mi FROM mg GROUP BY track_id),
    q AS (SELECT *, CASE WHEN ke > 1 THEN 1 - er / log2(ke) ELSE 0 END AS o, CASE WHEN kr > 1 THEN 1 - re / log2(kr) ELSE 0 END AS u, CASE WHEN he > 1e-12 THEN 1 - er / he ELSE 0 END AS vo, CASE WHEN hr > 1e-12 THEN 1 - re / hr ELSE 0 END AS vu FROM s)
    SELECT track_id, round(o, 5) AS nce_over, round(u, 5) AS nce_under, round(CASE WHEN o + u > 0 THEN 2 * o * u / (o + u) ELSE 0 END, 5) AS nce_f, round(CASE WHEN vo + vu > 0 THEN 2 * vo * vu / (vo + vu) ELSE 0 END, 5) AS v_measure, round(mi, 5) AS mutual_information FROM q""")
def _(spark, d):
    s = E.entropy_scores(_pair_cells(spark, d))
    return s.select("track_id", *[r(c, 5) for c in ("nce_over", "nce_under", "nce_f", "v_measure", "mutual_information")])


@query("e08_normalized_information", f"""WITH {_CELLS}, s AS (SELECT track_id, coalesce(-sum(a / total * ln(a / total)) FILTER (r1), 0) AS hr, coalesce(-sum(b / total * ln(b / total)) FILTER (e1), 0) AS he, sum(n / total * ln(n * total / (a * b))) AS mi FROM mg GROUP BY track_id)
    SELECT track_id, round(CASE WHEN sqrt(hr * he) > 1e-12 THEN mi / sqrt(hr * he) ELSE 0 END, 5) AS nmi FROM s""")
def _(spark, d):
    return E.entropy_scores(_pair_cells(spark, d)).select("track_id", r("normalized_mutual_information", 5, "nmi"))


_LG = lambda x: f"lgamma(CAST({x} AS DOUBLE) + 1)"


@query("e09_adjusted_information", f"""WITH {_CELLS}, s AS (SELECT track_id, coalesce(-sum(a / total * ln(a / total)) FILTER (r1), 0) AS hr, coalesce(-sum(b / total * ln(b / total)) FILTER (e1), 0) AS he, count(*) FILTER (r1) AS kr, count(*) FILTER (e1) AS ke, sum(n / total * ln(n * total / (a * b))) AS mi FROM mg GROUP BY track_id),
    c AS (SELECT a.track_id, a.a AS x, b.b AS y, CAST(a.total AS BIGINT) AS n, unnest(range(CAST(greatest(1, a.a + b.b - a.total) AS BIGINT), CAST(least(a.a, b.b) AS BIGINT) + 1)) AS k FROM mg a JOIN mg b USING (track_id) WHERE a.r1 AND b.e1),
    x AS (SELECT track_id, sum(exp({_LG("x")} + {_LG("y")} + {_LG("n - x")} + {_LG("n - y")} - {_LG("n")} - {_LG("k")} - {_LG("x - k")} - {_LG("y - k")} - {_LG("n - x - y + k")}) * k / n * ln(n * CAST(k AS DOUBLE) / (x * y))) AS emi FROM c GROUP BY track_id)
    SELECT track_id, round(CASE WHEN (kr = 1 AND ke = 1) OR abs(greatest(hr, he) - emi) < 1e-12 THEN 1 ELSE (mi - emi) / (greatest(hr, he) - emi) END, 6) AS adjusted_mutual_information FROM s JOIN x USING (track_id)""")
def _(spark, d):
    return E.adjusted_information(_pair_cells(spark, d)).select("track_id", r("adjusted_mutual_information"))


@query("e10_frame_scores", """WITH f AS (SELECT track_id, target, CASE WHEN list_position(scores, list_max(scores)) - 1 = target THEN 1.0 ELSE 0.0 END AS ok FROM frames WHERE target <> -100), l AS (SELECT track_id, target, avg(ok) AS a, sum(ok) AS h, count(*) AS n FROM f GROUP BY ALL)
    SELECT track_id, round(sum(h) / sum(n), 6) AS acc, round(avg(a), 6) AS balanced_acc FROM l GROUP BY track_id""")
def _(spark, d):
    f = D.decode_argmax(W.frames(spark, d)).withColumnRenamed("label_idx", "predicted")
    return E.frame_scores(f).select("track_id", r("acc"), r("balanced_acc"))


@query("e10_remapped_predictions", "SELECT track_id, frame_idx, CAST(CASE WHEN k % 2 = 0 THEN k // 2 ELSE -100 END AS INTEGER) AS predicted FROM (SELECT *, list_position(scores, list_max(scores)) - 1 AS k FROM frames)")
def _(spark, d):
    f = D.decode_argmax(W.frames(spark, d)).select("track_id", "frame_idx", F.col("label_idx").alias("predicted"))
    own = f.select("track_id").distinct().select("track_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("label_idx")).withColumn("label", F.concat(F.lit("class "), F.col("label_idx").cast("string")))
    shared = spark.range(5).select(F.concat(F.lit("class "), (F.col("id") * 2).cast("string")).alias("label"), F.col("id").cast("int").alias("label_idx"))
    return E.remap_predictions(f, own, shared).select("track_id", "frame_idx", "predicted")


_GAPS = "g AS (SELECT track_id, sum(greatest(dd, 0)) AS gap_seconds, sum(greatest(-dd, 0)) AS overlap_seconds FROM (SELECT track_id, coalesce(lead(start_time) OVER (PARTITION BY track_id ORDER BY idx) - end_time, 0) AS dd FROM sections_gap) GROUP BY track_id)"


@query("e11_summary", f"WITH {_GAPS} SELECT 'gap_seconds' AS metric, count(*) AS num_tracks, round(avg(gap_seconds), 4) AS mean, round(stddev_pop(gap_seconds), 4) AS std FROM g UNION ALL SELECT 'overlap_seconds', count(*), round(avg(overlap_seconds), 4), round(stddev_pop(overlap_seconds), 4) FROM g")
def _(spark, d):
    return E.summarize(E.to_long(C.gap_overlap(W.sections_gap(spark, d)))).select("metric", "num_tracks", r("mean", 4), r("std", 4))


@query("e12_policy_table", "WITH s AS (SELECT 'keep' AS policy, track_id, count(*) AS n, count(DISTINCT label) AS k FROM sections_a GROUP BY track_id UNION ALL SELECT 'merge', track_id, count(*), count(DISTINCT label) FROM merged_a GROUP BY track_id) SELECT policy, round(avg(n), 4) AS n, round(avg(k), 4) AS k FROM s GROUP BY policy")
def _(spark, d):
    rows = P.expand_policies(W.sections_a(spark, d), P.RandomPolicy.of(["keep", "merge"]).choices)
    s = rows.groupBy("policy", "track_id").agg(F.count("*").alias("n"), F.count_distinct("label").alias("k"))
    long = E.to_long(s, ("policy", "track_id"))
    long = long.join(E.common_tracks(long), "track_id", "left_semi")
    return E.policy_table(long, ["n", "k"]).select("policy", r("n", 4), r("k", 4))


@query("e13_improvements", "WITH h AS (SELECT track_id, idx, confidence, max(confidence) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM sections_a) SELECT track_id, CAST(idx AS BIGINT) AS idx, coalesce(confidence - b > 0.01, confidence IS NOT NULL) AS improved FROM h")
def _(spark, d):
    return E.improvements(W.sections_a(spark, d), ["track_id"], "idx", "confidence", min_delta=0.01).select("track_id", F.col("idx").cast("long").alias("idx"), "improved")


# --- comparison of annotation sets ------------------------------------------------------------------------------------

_OVER = "ov AS (SELECT a.track_id, a.label AS l, b.label AS rl, least(a.end_time, b.end_time) - greatest(a.start_time, b.start_time) AS s FROM merged_a a JOIN merged_b b ON a.track_id = b.track_id AND a.start_time < b.end_time AND b.start_time < a.end_time)"
_INNER = "oi AS (SELECT track_id, end_time AS t FROM sections_a QUALIFY lead(idx) OVER (PARTITION BY track_id ORDER BY idx) IS NOT NULL), ri AS (SELECT track_id, end_time AS t FROM sections_b QUALIFY lead(idx) OVER (PARTITION BY track_id ORDER BY idx) IS NOT NULL)"
_DIST = _INNER + ", od AS (SELECT oi.track_id, oi.t, min(abs(oi.t - ri.t)) AS d FROM oi JOIN ri USING (track_id) GROUP BY ALL), rd AS (SELECT ri.track_id, ri.t, min(abs(oi.t - ri.t)) AS d FROM ri JOIN oi USING (track_id) GROUP BY ALL)"


def _inner(spark, d):
    return C.internal_boundaries(W.sections_a(spark, d)), C.internal_boundaries(W.sections_b(spark, d))


@query("c01_overlap_seconds", f"WITH {_OVER} SELECT l AS original_label, rl AS revised_label, round(sum(s), 4) AS seconds FROM ov GROUP BY ALL")
def overlap(spark, d):
    return C.overlap_seconds(*_pair(spark, d)).select("original_label", "revised_label", r("seconds", 4))


@query("c01_overlap_by_track", f"WITH {_OVER} SELECT track_id, l AS original_label, rl AS revised_label, round(sum(s), 6) AS seconds FROM ov GROUP BY ALL")
def _(spark, d):
    return C.overlap_seconds(*_pair(spark, d), per_track=True).select("track_id", "original_label", "revised_label", r("seconds"))


@query("c02_top_changed", f"WITH {_OVER} SELECT l AS original_label, rl AS revised_label, round(sum(s), 4) AS seconds FROM ov WHERE l <> rl GROUP BY ALL ORDER BY sum(s) DESC LIMIT 40")
def flagship(spark, d):
    return C.top_changed(C.overlap_seconds(*_pair(spark, d))).select("original_label", "revised_label", r("seconds", 4))


@query("c03_agreement", f"WITH {_OVER} SELECT track_id, round(sum(CASE WHEN l = rl THEN s ELSE 0 END), 6) AS label_agreement_seconds, round(sum(CASE WHEN l = rl THEN s ELSE 0 END) / sum(s), 6) AS label_agreement_fraction FROM ov GROUP BY track_id")
def _(spark, d):
    return C.agreement(*_pair(spark, d)).select("track_id", r("label_agreement_seconds"), r("label_agreement_fraction"))


@query("c04_internal_boundaries", f"WITH {_INNER} SELECT track_id, round(t, 6) AS time FROM oi")
def _(spark, d):
    return _inner(spark, d)[0].select("track_id", r("time"))


@query("c05_nearest_distances", f"WITH {_DIST} SELECT track_id, round(t, 6) AS time, round(d, 6) AS distance FROM od")
def _(spark, d):
    return C.nearest_distances(*_inner(spark, d)).select("track_id", r("time"), r("distance"))


@query("c06_signed_shifts", f"WITH {_INNER}, n AS (SELECT oi.track_id, oi.t, arg_min(ri.t, {{'d': abs(ri.t - oi.t), 't': ri.t}}) AS n FROM oi JOIN ri USING (track_id) GROUP BY ALL) SELECT track_id, round(t, 6) AS time, round(n - t, 5) AS shift FROM n WHERE abs(n - t) <= 3600")
def _(spark, d):
    return C.signed_shifts(*_inner(spark, d), most=3600.0).select("track_id", r("time"), r("shift", 5))


@query("c07_tolerance_scores", f"""WITH {_DIST}, o AS (SELECT track_id, count(*) AS n, count(*) FILTER (d <= 0.5) AS h FROM od GROUP BY track_id), e AS (SELECT track_id, count(*) AS n, count(*) FILTER (d <= 0.5) AS h FROM rd GROUP BY track_id), j AS (SELECT track_id, e.h / e.n AS p, o.h / o.n AS r, e.n - e.h AS added, o.n - o.h AS removed FROM o JOIN e USING (track_id))
    SELECT track_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f FROM j""")
def _(spark, d):
    oi, ri = _inner(spark, d)
    s = C.tolerance_scores(oi, ri, W.user_tracks(spark, d)).where("n_ref > 0 AND n_est > 0")
    return s.select("track_id", F.round("precision_0_5", 6).alias("precision"), F.round("recall_0_5", 6).alias("recall"), F.round("f_0_5", 6).alias("f"))


@query("c08_added_removed", f"WITH {_DIST}, o AS (SELECT track_id, count(*) FILTER (d > 0.5) AS x FROM od GROUP BY track_id), e AS (SELECT track_id, count(*) FILTER (d > 0.5) AS x FROM rd GROUP BY track_id) SELECT track_id, e.x AS added, o.x AS removed FROM o JOIN e USING (track_id)")
def _(spark, d):
    oi, ri = _inner(spark, d)
    s = C.tolerance_scores(oi, ri, W.user_tracks(spark, d)).where("n_ref > 0 AND n_est > 0")
    return s.select("track_id", F.col("added_0_5").alias("added"), F.col("removed_0_5").alias("removed"))


@query("c09_gap_overlap", f"WITH {_GAPS} SELECT track_id, round(gap_seconds, 4) AS gap_seconds, round(overlap_seconds, 4) AS overlap_seconds FROM g")
def _(spark, d):
    return C.gap_overlap(W.sections_gap(spark, d)).select("track_id", r("gap_seconds", 4), r("overlap_seconds", 4))


@query("c10_consecutive_duplicates", f"SELECT track_id, count(*) FILTER (same) AS consecutive_duplicates FROM (SELECT track_id, {base_sql('label')} = lag({base_sql('label')}) OVER (PARTITION BY track_id ORDER BY idx) AS same FROM sections_num) GROUP BY track_id")
def _(spark, d):
    return C.consecutive_duplicates(W.sections_num(spark, d))


_SIDE = "{0}s AS (SELECT track_id, max(end_time) AS d, count(*) AS n, count(DISTINCT label) AS k, avg(end_time - start_time) AS m, median(end_time - start_time) AS md FROM sections_{0} GROUP BY track_id)"


@query("c11_compare_tracks", f"""WITH {_SIDE.format('a')}, {_SIDE.format('b')}, {_DIST}, q AS (SELECT track_id, quantile_cont(d, 0.9) AS p90 FROM od GROUP BY track_id)
    SELECT track_id, a.n AS n_segments_original, b.n AS n_segments_revised, b.n - a.n AS n_segments_delta, a.k AS n_labels_original, round(a.m, 4) AS mean_segment_original, round(b.md, 4) AS median_segment_revised, round(b.d - a.d, 4) AS duration_delta, round(p90, 4) AS original_to_revised_p90 FROM "as" a JOIN bs b USING (track_id) LEFT JOIN q USING (track_id)""".replace("as AS (SELECT track_id, max", '"as" AS (SELECT track_id, max'))
def _(spark, d):
    s = C.compare_tracks(W.sections_a(spark, d), W.sections_b(spark, d))
    return s.select("track_id", "n_segments_original", "n_segments_revised", "n_segments_delta", "n_labels_original", r("mean_segment_original", 4), r("median_segment_revised", 4), r("duration_delta", 4), r("original_to_revised_p90", 4))


_SECONDS = "ls AS (SELECT label, sum(end_time - start_time) AS s FROM sections_a GROUP BY label), rs AS (SELECT label, sum(end_time - start_time) AS s FROM sections_b GROUP BY label)"


@query("c12_label_seconds", f"WITH {_SECONDS} SELECT label, round(coalesce(ls.s, 0), 3) AS original_seconds, round(coalesce(rs.s, 0), 3) AS revised_seconds, round(coalesce(rs.s, 0) - coalesce(ls.s, 0), 3) AS delta FROM ls FULL JOIN rs USING (label)")
def _(spark, d):
    return C.label_seconds(W.sections_a(spark, d), W.sections_b(spark, d)).select("label", r("original_seconds", 3), r("revised_seconds", 3), r("delta", 3))


@query("c13_top_counter", f"WITH {_SECONDS} SELECT label, round(s, 3) AS seconds, round(s / 3600, 5) AS hours, round(s / sum(s) OVER (), 6) AS share FROM ls ORDER BY s DESC, label LIMIT 30")
def _(spark, d):
    s = C.label_seconds(W.sections_a(spark, d), W.sections_b(spark, d)).select("label", F.col("original_seconds").alias("seconds"))
    return C.top_counter(s).select("label", r("seconds", 3), r("hours", 5), r("share"))


@query("c14_value_summary", "SELECT label, count(*) AS count, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std, round(median(x), 4) AS median, round(quantile_cont(x, 0.1), 4) AS p10, round(quantile_cont(x, 0.9), 4) AS p90, round(min(x), 4) AS min, round(max(x), 4) AS max FROM (SELECT label, end_time - start_time AS x FROM sections_a) GROUP BY label")
def _(spark, d):
    s = C.summarize_values(W.sections_a(spark, d).withColumn("x", F.col("end_time") - F.col("start_time")), "x", "label")
    return s.select("label", "count", *[r(c, 4) for c in ("mean", "std", "median", "p10", "p90", "min", "max")])


@query("c15_vocabulary_sets", "WITH a AS (SELECT DISTINCT label FROM sections_num), b AS (SELECT DISTINCT label FROM sections_nf) SELECT label, CASE WHEN a.label IS NULL THEN 'revised_only' WHEN b.label IS NULL THEN 'original_only' ELSE 'shared' END AS kind FROM a FULL JOIN b USING (label)")
def _(spark, d):
    return C.vocabulary_sets(W.sections_num(spark, d), W.sections_nf(spark, d))


@query("c16_top_rows", f"WITH {_GAPS} SELECT track_id, round(gap_seconds, 4) AS gap_seconds FROM g ORDER BY g.gap_seconds DESC, track_id LIMIT 20")
def _(spark, d):
    return C.top_rows(C.gap_overlap(W.sections_gap(spark, d)), "gap_seconds").select("track_id", r("gap_seconds", 4))


# --- similarity and embedding quality ---------------------------------------------------------------------------------

_UNIT = "un AS (SELECT track_id, frame_idx, target, list_transform(vec, lambda x: x / greatest(sqrt(list_dot_product(vec, vec)), 1e-12)) AS u FROM frames)"
_COS = _UNIT + ", pr AS (SELECT a.track_id, a.frame_idx AS i, b.frame_idx AS j, list_dot_product(a.u, b.u) AS v, a.target AS ti, b.target AS tj, a.target = b.target AND a.target <> -100 AS same FROM un a JOIN un b ON a.track_id = b.track_id AND a.frame_idx <> b.frame_idx)"
_SOFT = "sm AS (SELECT track_id, frame_idx, target, list_transform(e, lambda x: x / list_sum(e)) AS p FROM (SELECT track_id, frame_idx, target, list_transform(scores, lambda x: exp(x - list_max(scores))) AS e FROM frames)), pp AS (SELECT a.track_id, a.frame_idx AS i, b.frame_idx AS j, list_dot_product(a.p, b.p) AS v, a.target = b.target AS same FROM sm a JOIN sm b ON a.track_id = b.track_id AND a.frame_idx <> b.frame_idx WHERE a.target <> -100 AND b.target <> -100)"


@query("g01_cosine_pairs", f"WITH {_COS} SELECT track_id, i, j, round(v, 5) AS value FROM pr")
def _(spark, d):
    return G.pairs(W.frames(spark, d)).select("track_id", "i", "j", r("value", 5))


@query("g02_same_label_pairs", f"WITH {_COS} SELECT track_id, count(*) FILTER (same) AS same_pairs, count(*) AS pairs FROM pr GROUP BY track_id")
def _(spark, d):
    return G.pairs(W.frames(spark, d)).groupBy("track_id").agg(F.count_if("same").alias("same_pairs"), F.count("*").alias("pairs"))


@query("g03_probability_pairs", f"WITH {_SOFT} SELECT track_id, round(avg(v), 6) AS mean_value FROM pp GROUP BY track_id")
def _(spark, d):
    f = W.frames(spark, d).where("target <> -100").withColumn("p", V.softmax("scores"))
    return G.pairs(f, vec="p", cosine=False).groupBy("track_id").agg(F.round(F.avg("value"), 6).alias("mean_value"))


@query("g04_similarity_means", f"WITH {_COS} SELECT track_id, round(avg(v) FILTER (same), 5) AS same_label_mean, round(avg(v) FILTER (NOT same), 5) AS different_label_mean FROM pr WHERE ti <> -100 AND tj <> -100 GROUP BY track_id")
def _(spark, d):
    return G.similarity_means(W.frames(spark, d)).select("track_id", r("same_label_mean", 5), r("different_label_mean", 5))


@query("g05_score_margins", "WITH t AS (SELECT track_id, scores[target + 1] AS g, list_max(list_filter(scores, lambda x, i: i <> target + 1)) AS w FROM frames WHERE target <> -100) SELECT track_id, round(avg(g), 6) AS gt_score_mean, round(avg(g - w), 6) AS gt_margin_mean FROM t GROUP BY track_id")
def _(spark, d):
    return G.score_margins(W.frames(spark, d)).select("track_id", r("gt_score_mean"), r("gt_margin_mean"))


@query("g06_label_similarity", "WITH p AS (SELECT list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec) * list_dot_product(b.vec, b.vec)) AS v FROM label_vectors a JOIN label_vectors b ON a.label_idx <> b.label_idx) SELECT round(avg(v), 5) AS offdiag_mean, round(max(v), 5) AS offdiag_max FROM p")
def _(spark, d):
    return G.label_similarity(W.label_vectors(spark, d)).select(r("offdiag_mean", 5), r("offdiag_max", 5))


@query("g07_boundary_flags", "SELECT track_id, frame_idx, CASE WHEN target <> -100 AND n <> -100 THEN target <> n END AS boundary FROM (SELECT *, lead(target) OVER (PARTITION BY track_id ORDER BY frame_idx) AS n FROM frames)")
def _(spark, d):
    return G.boundary_flags(W.frames(spark, d)).select("track_id", "frame_idx", "boundary")


@query("g08_change_at_boundaries", "WITH t AS (SELECT track_id, target, lead(target) OVER w AS n, scores AS s, lead(scores) OVER w AS z FROM frames WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx)), c AS (SELECT *, 1 - list_dot_product(s, z) / sqrt(list_dot_product(s, s) * list_dot_product(z, z)) AS c FROM t WHERE z IS NOT NULL AND target <> -100 AND n <> -100) SELECT track_id, round(avg(c) FILTER (target <> n), 5) AS change_at_boundary, round(avg(c) FILTER (target = n), 5) AS change_elsewhere FROM c GROUP BY track_id")
def _(spark, d):
    return G.change_at_boundaries(W.frames(spark, d)).select("track_id", r("change_at_boundary", 5), r("change_elsewhere", 5))


@query("g09_accuracies", "SELECT track_id, round(avg(CASE WHEN list_position(scores, list_max(scores)) - 1 = target THEN 1.0 ELSE 0.0 END), 6) AS frame_accuracy FROM frames WHERE target <> -100 GROUP BY track_id")
def _(spark, d):
    f = D.decode_argmax(W.frames(spark, d)).withColumnRenamed("label_idx", "decoded")
    return G.accuracies(f).select("track_id", r("frame_accuracy"))


@query("m01_cross_entropy", "SELECT round(avg(ln(list_sum(list_transform(scores, lambda x: exp(x)))) - scores[target + 1]), 6) AS cross_entropy FROM frames WHERE target <> -100")
def _(spark, d):
    return G.cross_entropy(W.frames(spark, d)).select(r("cross_entropy"))


_BALANCED = "SELECT track_id, round(CASE WHEN count(*) FILTER (same) > 0 AND count(*) FILTER (NOT same) > 0 THEN (avg(-ln(c)) FILTER (same) + avg(-ln(1 - c)) FILTER (NOT same)) / 2 ELSE avg(CASE WHEN same THEN -ln(c) ELSE -ln(1 - c) END) END, 5) AS loss FROM q GROUP BY track_id"


@query("m02_probability_bce", f"WITH {_SOFT}, q AS (SELECT track_id, same, least(greatest(v, 1e-6), 1 - 1e-6) AS c FROM pp) {_BALANCED}")
def _(spark, d):
    return G.probability_bce(W.frames(spark, d)).select("track_id", r("loss", 5))


@query("m03_structure_bce", f"WITH {_COS}, q AS (SELECT track_id, same, least(greatest((v + 1) / 2, 1e-6), 1 - 1e-6) AS c FROM pr WHERE ti <> -100 AND tj <> -100) {_BALANCED}")
def _(spark, d):
    return G.structure_bce(W.frames(spark, d)).select("track_id", r("loss", 5))


@query("m04_relation_cross_entropy", f"""WITH seg AS (SELECT track_id, frame_idx, CASE WHEN target = -100 THEN -100 ELSE target % 3 END AS b, CASE WHEN target = -100 THEN -100 ELSE frame_idx // 5 END AS s FROM frames), {_COS},
    c AS (SELECT pr.track_id, [v, 0.5, -v] AS z, CASE WHEN x.s = y.s THEN 2 WHEN x.b = y.b THEN 1 ELSE 0 END AS rel FROM pr JOIN seg x ON x.track_id = pr.track_id AND x.frame_idx = pr.i JOIN seg y ON y.track_id = pr.track_id AND y.frame_idx = pr.j WHERE x.b <> -100 AND y.b <> -100),
    l AS (SELECT track_id, rel, ln(list_sum(list_transform(z, lambda q: exp(q)))) - z[rel + 1] AS l FROM c), k AS (SELECT track_id, rel, sum(l) AS s, count(*) AS n FROM l GROUP BY ALL) SELECT track_id, round(CASE WHEN count(*) = 3 THEN avg(s / n) ELSE sum(s) / sum(n) END, 5) AS loss FROM k GROUP BY track_id""")
def _(spark, d):
    f = W.frames(spark, d)
    ignored = F.col("target") == -100
    named = f.select("track_id", "frame_idx", F.when(ignored, -100).otherwise(F.col("target") % 3).alias("base_target"), F.when(ignored, -100).otherwise(F.floor(F.col("frame_idx") / 5)).alias("segment_target"))
    scored = G.pairs(f).select("track_id", "i", "j", F.array(F.col("value"), F.lit(0.5), -F.col("value")).alias("scores"))
    return G.relation_cross_entropy(scored, named).select("track_id", r("loss", 5))


@query("m05_boundary_dice", "WITH c AS (SELECT track_id, 1 / (1 + exp(-scores[1])) AS p, CASE WHEN target <> n THEN 1.0 ELSE 0.0 END AS y FROM (SELECT *, lead(target) OVER (PARTITION BY track_id ORDER BY frame_idx) AS n FROM frames) WHERE target <> -100 AND n <> -100) SELECT track_id, round(1 - 2 * sum(p * y) / greatest(sum(p * p) + sum(y * y), 1e-8), 6) AS loss FROM c GROUP BY track_id")
def _(spark, d):
    f = W.frames(spark, d).withColumn("boundary_logit", F.col("scores")[0])
    return G.boundary_dice(f, target="target").select("track_id", r("loss"))


@query("m06_matching_mse", "WITH c AS (SELECT track_id, pow(scores[k] - CASE WHEN k = target + 1 THEN 1 ELSE 0 END, 2) * CASE WHEN k = target + 1 THEN 1 ELSE 1.0 / 9 END AS e FROM frames, range(1, 11) AS x(k) WHERE target <> -100) SELECT track_id, round(avg(e), 6) AS loss FROM c GROUP BY track_id")
def _(spark, d):
    return G.matching_mse(W.frames(spark, d)).select("track_id", r("loss"))


@query("m07_uniformity", f"WITH {_COS} SELECT track_id, round(ln(greatest(avg(exp(-2 * (2 - 2 * v))), 1e-12)), 5) AS loss FROM pr WHERE i < j GROUP BY track_id")
def _(spark, d):
    return G.uniformity(W.frames(spark, d)).select("track_id", r("loss", 5))


@query("m08_label_infonce", f"WITH {_UNIT}, lu AS (SELECT label_idx, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS t FROM label_vectors), pl AS (SELECT DISTINCT track_id, target AS label FROM un WHERE target <> -100), s AS (SELECT pl.track_id, label, target, list_dot_product(u, t) / 0.07 AS s FROM pl JOIN lu ON lu.label_idx = pl.label JOIN un ON un.track_id = pl.track_id WHERE target <> -100) SELECT track_id, label, round(ln(sum(exp(s - 20))) - ln(sum(exp(s - 20)) FILTER (target = label)), 4) AS loss FROM s GROUP BY ALL")
def _(spark, d):
    return G.label_to_frame_infonce(W.frames(spark, d), W.label_vectors(spark, d)).select("track_id", "label", r("loss", 4))


@query("m09_supervised_contrastive", f"WITH {_COS}, e AS (SELECT track_id, i, ln(sum(exp(v / 0.07 - 1 / 0.07))) AS a, ln(sum(exp(v / 0.07 - 1 / 0.07)) FILTER (same)) AS o FROM pr WHERE ti <> -100 AND tj <> -100 GROUP BY ALL) SELECT track_id, round(avg(a - o), 4) AS loss FROM e WHERE o IS NOT NULL GROUP BY track_id")
def _(spark, d):
    return G.supervised_contrastive(W.frames(spark, d)).select("track_id", r("loss", 4))


@query("m10_weighted_total", f"WITH {_SOFT}, q AS (SELECT track_id, same, least(greatest(v, 1e-6), 1 - 1e-6) AS c FROM pp), b AS ({_BALANCED}) SELECT round(avg(loss) * 0.5 + (SELECT avg(ln(list_sum(list_transform(scores, lambda x: exp(x)))) - scores[target + 1]) FROM frames WHERE target <> -100), 4) AS total FROM b")
def _(spark, d):
    f = W.frames(spark, d)
    row = G.cross_entropy(f).crossJoin(G.probability_bce(f).agg(F.avg("loss").alias("pairwise")))  # one row each
    return G.weighted_total(row, {"cross_entropy": 1.0, "pairwise": 0.5, "unused": 0.0}).select(r("total", 4))


# --- sources ----------------------------------------------------------------------------------------------------------


def _manifest(spark, d):
    """The documents as tracks of a manifest; every third without a split."""
    path = lambda c, ext: F.concat(F.lit(c), F.col("track_id"), F.lit(ext))
    rows = W.document_tracks(spark, d).select(F.col("track_id").cast("string").alias("track_id"), "dataset", F.col("n_chars").cast("string").alias("n"))
    return rows.select("track_id", path("audio/", ".wav").alias("audio_path"), path("/jams/", ".jams").alias("jams_path"), "dataset", F.when(F.col("track_id").cast("long") % 3 > 0, "train").alias("split"), F.create_map(F.lit("n_chars"), "n").alias("metadata"))


@query("s01_manifest_scan", "SELECT CAST(doc_id AS VARCHAR) AS track_id, '/root/set/audio/' || doc_id || '.wav' AS audio_path, '/jams/' || doc_id || '.jams' AS jams_path, source AS dataset, CASE WHEN doc_id % 3 > 0 THEN 'train' END AS split, CAST(n_chars AS VARCHAR) AS n_chars FROM documents")
def _(spark, d):
    from segloom.sources.manifests import read_manifest, write_manifest

    path = scratch_path(spark, "manifest")
    write_manifest(_manifest(spark, d), path)
    return read_manifest(spark, path, base="/root/set").select("track_id", "audio_path", "jams_path", "dataset", "split", F.col("metadata")["n_chars"].alias("n_chars"))


@query("s02_manifest_sink", "SELECT CAST(doc_id AS VARCHAR) AS track_id, 'audio_path,dataset,jams_path,metadata,split,track_id' AS fields FROM documents")
def _(spark, d):
    from segloom.sources.manifests import write_manifest

    path = scratch_path(spark, "manifest")
    write_manifest(_manifest(spark, d), path)
    return spark.read.text(path).select(F.get_json_object("value", "$.track_id").alias("track_id"), F.array_join(F.json_object_keys("value"), ",").alias("fields"))


@query("r02_split_manifests", "WITH n AS (SELECT count(*) AS n FROM document_tracks), k AS (SELECT n, round_even(n * 0.15, 0) AS v, round_even(n * 0.05, 0) AS t FROM n), o AS (SELECT track_id, dataset, row_number() OVER (ORDER BY manifest_ord, track_id) - 1 AS a FROM document_tracks) SELECT CAST(track_id AS VARCHAR) AS track_id, dataset, CASE WHEN a < n - v - t THEN 'train' WHEN a < n - t THEN 'val' ELSE 'test' END AS split FROM o, k")
def _(spark, d):
    from segloom.sources.manifests import write_manifest

    split = O.split_tracks(W.document_tracks(spark, d), 0.8, 0.15, 0.05, shuffle=False).select(F.col("track_id").cast("string").alias("track_id"), "split")
    path = scratch_path(spark, "splits")
    write_manifest(_manifest(spark, d).drop("split").join(split, "track_id"), path, partition_by="split")
    folders = [spark.read.schema("track_id string, dataset string").json(f"{path}/split={s}").withColumn("split", F.lit(s)) for s in ("train", "val", "test")]
    return folders[0].union(folders[1]).union(folders[2])


@query("s05_annotation_scan", f"SELECT track_id, {SECTIONS_SQL} FROM (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY idx) - 1 AS idx, start_time, end_time, label FROM merged_a)")
def _(spark, d):
    from segloom.sources.annotations import annotation_sections
    from segloom.sources.stores import write_segments

    path = scratch_path(spark, "segments")
    write_segments(P.merge_consecutive(W.sections_a(spark, d)), path)
    nested = spark.read.schema("track_id bigint, annotations array<struct<namespace string, data array<struct<time double, duration double, value string, confidence double>>>>").json(path)
    return sections(annotation_sections(nested.withColumn("path", F.lit(path))))


@query("s06_text_annotations", "WITH m AS (SELECT track_id, idx, start_time, label FROM merged_a), n AS (SELECT *, lead(start_time) OVER (PARTITION BY track_id ORDER BY idx) AS e FROM m), f AS (SELECT track_id, idx, start_time, coalesce(e, duration) AS end_time, label FROM n JOIN user_tracks USING (track_id)) SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY idx) - 1 AS BIGINT) AS idx, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, label FROM f WHERE end_time > start_time")
def _(spark, d):
    from segloom.sources.annotations import read_text_annotations
    from segloom.sources.stores import write_files

    line = F.concat_ws(" ", F.col("start_time").cast("string"), "label")
    texts = P.merge_consecutive(W.sections_a(spark, d)).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))).alias("l"))
    folder = scratch_path(spark, "texts")
    write_files(texts.select(F.concat(F.col("track_id").cast("string"), F.lit(".txt")).alias("name"), F.concat(F.lit("# sections\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("value")), folder)
    ends = W.user_tracks(spark, d).select(F.col("track_id").cast("string").alias("track_id"), F.col("duration").alias("fallback_end"))
    return sections(read_text_annotations(spark, folder, ends).withColumn("track_id", F.col("track_id").cast("long")))


@query("s08_file_identity", "WITH p AS (SELECT doc_id, coalesce(text, '') AS a, CASE WHEN doc_id % 7 = 0 THEN replace(coalesce(text, ''), 'e', 'i') WHEN doc_id % 5 = 0 THEN coalesce(text, '') || '.' ELSE coalesce(text, '') END AS b FROM documents) SELECT CAST(doc_id AS VARCHAR) AS stem, octet_length(encode(a)) = octet_length(encode(b)) AS same_size, sha256(a) = sha256(b) AS same_sha256 FROM p WHERE doc_id % 11 <> 0")
def _(spark, d):
    from segloom.sources.annotations import file_identity, pair_annotation_sets
    from segloom.sources.manifests import file_listing
    from segloom.sources.stores import FOLDERS, write_files

    docs = W.table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "doc_id", F.coalesce("text", F.lit("")).alias("a"))
    changed = F.when(F.col("doc_id") % 7 == 0, F.replace("a", F.lit("e"), F.lit("i"))).when(F.col("doc_id") % 5 == 0, F.concat("a", F.lit("."))).otherwise(F.col("a"))
    original, revised = scratch_path(spark, "original"), scratch_path(spark, "revised")
    write_files(docs.select("name", F.col("a").alias("value")), original, FOLDERS)
    write_files(docs.where("doc_id % 11 <> 0").select("name", changed.alias("value")), revised, FOLDERS)
    return file_identity(spark, pair_annotation_sets(file_listing(spark, original), file_listing(spark, revised)), original, revised)


@query("s10_feature_store", "SELECT track_id, CAST(frame_idx AS BIGINT) AS idx, target, len(vec) AS dim FROM frames WHERE track_id % 2 = 1")
def _(spark, d):
    from segloom.sources.stores import read_features, write_features

    path = scratch_path(spark, "features")
    rows = W.frames(spark, d).select("track_id", F.col("frame_idx").cast("long").alias("idx"), "target", "vec", F.lit("mean").alias("encoder"), F.when(F.col("track_id") % 2 == 1, "odd").otherwise("even").alias("dataset"))
    write_features(rows.where("track_id % 4 = 1"), path)
    write_features(rows, path)  # the tracks of the first run are there once
    return read_features(spark, path, encoder="mean", dataset="odd").select("track_id", "idx", "target", F.size("vec").cast("long").alias("dim"))


@query("s13_reports", "SELECT track_id, label, count(*) AS n, round(sum(end_time - start_time), 3) AS seconds FROM sections_a GROUP BY track_id, label")
def _(spark, d):
    from segloom.sources.stores import write_report

    rows = W.sections_a(spark, d).groupBy("track_id", "label").agg(F.count("*").alias("n"), F.sum(F.col("end_time") - F.col("start_time")).alias("seconds"))
    table, lines = scratch_path(spark, "report"), scratch_path(spark, "report")
    write_report(rows.select("track_id", "label", "n"), table)
    write_report(rows.select("track_id", "label", "seconds"), lines, "json")
    back = spark.read.schema("track_id bigint, label string, n bigint").option("header", True).csv(table)
    return back.join(spark.read.schema("track_id bigint, label string, seconds double").json(lines), ["track_id", "label"]).select("track_id", "label", "n", r("seconds", 3))


@query("s03_pair_files", "SELECT CAST(doc_id AS VARCHAR) AS track_id, 'docs' AS dataset FROM documents")
def _(spark, d):
    from segloom.sources.manifests import file_listing, pair_files

    audio, annotations = (_written(spark, W.document_tracks(spark, d), end) for end in (".wav", ".jams"))
    return pair_files(file_listing(spark, audio, "*.wav"), file_listing(spark, annotations), "docs").select("track_id", "dataset")


def _written(spark: SparkSession, tracks: DataFrame, end: str, start: str = "") -> str:
    """A folder with a small file for each track."""
    from segloom.sources.stores import FOLDERS, write_files

    folder = scratch_path(spark, "files")
    write_files(tracks.select(F.concat(F.lit(start), F.col("track_id").cast("string"), F.lit(end)).alias("name"), F.lit("x").alias("value")), folder, FOLDERS)
    return folder


@query("s04_pair_prefixed", "SELECT CAST(doc_id AS VARCHAR) AS track_id FROM documents WHERE doc_id % 2 = 0")
def _(spark, d):
    from segloom.sources.manifests import file_listing, pair_prefixed

    tracks = W.document_tracks(spark, d)
    audio, annotations = _written(spark, tracks.where("track_id % 2 = 0"), ".wav", "x"), _written(spark, tracks, ".jams")
    return pair_prefixed(file_listing(spark, audio), file_listing(spark, annotations), "docs", "x").select("track_id")


@query("s07_pair_sets", "SELECT CAST(doc_id AS VARCHAR) AS stem, CASE WHEN doc_id % 3 = 0 THEN 'original_only' WHEN doc_id % 5 = 0 THEN 'revised_only' ELSE 'both' END AS side FROM documents")
def _(spark, d):
    from segloom.sources.annotations import pair_annotation_sets
    from segloom.sources.manifests import file_listing

    ids = W.document_tracks(spark, d)
    sides = (ids.where("track_id % 5 <> 0 OR track_id % 3 = 0"), ids.where("track_id % 3 <> 0"))
    original, revised = (file_listing(spark, _written(spark, side, ".jams")).unionByName(file_listing(spark, _written(spark, side, ".txt"))) for side in sides)
    return pair_annotation_sets(original, revised).select("stem", "side")


@query("s09_resolve_beats", "SELECT track_id, CAST(beat_idx AS BIGINT) AS beat_idx, round(time, 6) AS time FROM beats")
def _(spark, d):
    from segloom.sources.manifests import resolve_beats

    beats = W.beats(spark, d).withColumn("dataset", F.when(F.col("track_id") % 2 == 0, "even"))
    tracks = W.user_tracks(spark, d).select("track_id", F.lit(None).cast("string").alias("dataset"))
    return resolve_beats(beats.withColumn("track_id", F.col("track_id").cast("string")), tracks.withColumn("track_id", F.col("track_id").cast("string"))).select(F.col("track_id").cast("long").alias("track_id"), F.col("beat_idx").cast("long").alias("beat_idx"), r("time"))


@query("s11_pending_tracks", "SELECT doc_id AS track_id, source AS dataset FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    from segloom.sources.manifests import pending

    tracks = W.document_tracks(spark, d)
    done = W.table(spark, d, "labels").select(F.col("doc_id").alias("track_id")).join(tracks, "track_id").select("track_id", "dataset")
    return pending(tracks, done).select("track_id", "dataset")


@query("s12_nested_segments", "SELECT track_id, count(*) AS n, round(max(end_time), 6) AS duration FROM merged_a GROUP BY track_id")
def _(spark, d):
    from segloom.sources.annotations import read_annotations
    from segloom.sources.stores import write_segments

    folder = scratch_path(spark, "segments")
    write_segments(P.merge_consecutive(W.sections_a(spark, d)), folder, files=True)
    back = read_annotations(spark, f"{folder}/*.jams").groupBy(F.col("track_id").cast("long").alias("track_id"))
    return back.agg(F.count("*").alias("n"), F.round(F.max("end_time"), 6).alias("duration"))

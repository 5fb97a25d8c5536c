"""Every registered query runs at the smallest scale with the columns of its oracle."""

import duckdb
import pytest

from segloom.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["l01_label_base", "p01_merge", "p07_replace_no_function", "p09_projected_lower", "t06_mean_pool", "t11_assign_points", "v02_vocabulary", "r03_sample_frames", "d03_smooth_median", "d09_merge_with_boundaries", "e06_pair_scores", "c02_top_changed", "c05_nearest_distances", "g04_similarity_means", "m02_probability_bce", "p00_policies", "s01_manifest_scan", "s02_manifest_sink", "s05_annotation_scan", "s06_text_annotations", "s07_pair_sets", "s08_file_identity", "s10_feature_store", "s13_reports", "r02_split_manifests", "t09_overlap_labels", "c03_agreement", "d05_viterbi", "d10_remove_short", "d13_infer_cleaned", "d15_top_settings", "e02_evaluate_predictions", "e09_adjusted_information"]


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    df = QUERIES[name](spark, sf)
    assert sorted(columns) == sorted(df.columns)
    key = lambda rows: sorted(tuple(map(repr, r)) for r in rows)
    assert key(df.select(*columns).collect()) == key(found.fetchall())


def test_registry():
    import __spark_entry__ as entry

    assert set(ORACLES) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


def test_labels_are_encoded_once(spark, sf):
    """v03 hashes different labels: nothing of the encoding stands below the aggregate that finds them."""
    import re

    plan = QUERIES["v03_encode_labels"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in plan.split("Aggregate")[0] and "sha2" not in plan.split("Aggregate")[1]
    assert len(re.findall("sha2", plan)) == 1


def test_events_are_dealt_by_their_number(spark, sf, monkeypatch):
    """More events make more tasks, not larger ones, and windows of tracks keep them; p10 makes one pass over them."""
    from segloom.plans import views as W

    monkeypatch.setattr(W, "TASK_ROWS", 100)
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    assert W.sections_num(spark, sf).rdd.getNumPartitions() == -(-n // 100) > 4
    assert QUERIES["p10_richest_annotation"](spark, sf)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
